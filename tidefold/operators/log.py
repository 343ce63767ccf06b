"""The ordered log: envelope, latest versions, dedup, refresh sweep, scrub, compaction.

A topic is a DataFrame with idx long, seq int, key string, variant ('row', 'delete', 'refresh'),
generation long and payload (a struct or VARIANT); the whole log has topic and data (JSON text) as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESERVED = "__"
ORDER = ("idx", "seq")


def envelope(df: DataFrame, idx: Column, key: Column, variant: Column | None = None, generation: Column | None = None, seq: Column | None = None, payload: list[str] | None = None) -> DataFrame:
    """A topic from a table: its columns become the payload; deletes and refresh markers have none."""
    kind = variant if variant is not None else F.lit("row")
    body = F.struct(*(payload or df.columns))
    return df.select(
        idx.cast("long").alias("idx"), (seq if seq is not None else F.lit(0)).cast("int").alias("seq"), key.cast("string").alias("key"), kind.alias("variant"),
        (generation if generation is not None else F.lit(0)).cast("long").alias("generation"), F.when(kind == "row", body).alias("payload"),
    )


def typed(log: DataFrame, topic: str, schema: str, raw: bool = False) -> DataFrame:
    """One topic of a JSON log with its payload read by the least schema that the view needs.

    raw: keep the JSON text as ``data``, by which a path that is null is told from one that is missing."""
    return log.where(F.col("topic") == topic).select("idx", "seq", "key", "variant", "generation", F.from_json("data", schema).alias("payload"), *(["data"] if raw else []))


def classified(log: DataFrame) -> DataFrame:
    """variant of raw entities: refresh before delete before row; other markers are dead letters."""
    return log.withColumn("variant", F.when(F.col("is_refresh"), "refresh").when(F.col("is_delete"), "delete").when(F.col("data").isNotNull(), "row").otherwise("dead"))


def user_entities(log: DataFrame) -> DataFrame:
    return log.where(~F.col("topic").startswith(RESERVED))


def deduplicated(log: DataFrame, highwater: DataFrame | None = None) -> DataFrame:
    """Effectively-once: drops source_seq at or below the high-water mark of its ingest_id, then
    repeats within the batch (the first idx stays); sequence 0 and unsafe rows are never dropped."""
    free = (F.col("source_seq") == 0) | F.coalesce(F.col("dedup_unsafe"), F.lit(False)) if "dedup_unsafe" in log.columns else F.col("source_seq") == 0
    if highwater is not None:
        log = log.join(highwater, "ingest_id", "left").where(free | (F.col("source_seq") > F.coalesce("highwater", F.lit(-1)))).drop("highwater")
    first = F.row_number().over(Window.partitionBy("ingest_id", "source_seq", F.when(free, F.struct("idx", "seq"))).orderBy("idx", "seq"))
    return log.withColumn("_n", first).where(free | (F.col("_n") == 1)).drop("_n")


def highwater(log: DataFrame) -> DataFrame:
    return log.where("source_seq > 0").groupBy("ingest_id").agg(F.max("source_seq").alias("highwater"))


def unswept(rows: DataFrame, topic: DataFrame) -> DataFrame:
    """``rows`` without those that a later refresh marker of the topic leaves behind (1 <= generation < its own).

    A marker sweeps what is retained when it comes, so rows after it stay whatever their generation."""
    at = F.max(F.struct("idx", "seq")).alias("at")
    marks = topic.where(F.col("variant") == "refresh").groupBy("generation").agg(at).agg(F.collect_list(F.struct("at", "generation")).alias("_marks"))
    out = rows.join(F.broadcast(marks), how="cross")  # one row, with an entry for each refresh of the topic
    left = F.exists("_marks", lambda m: (m.generation > F.col("generation")) & (m.at > F.struct("idx", "seq")))
    return out.where(~((F.col("generation") >= 1) & left)).drop("_marks")


def swept(topic: DataFrame) -> DataFrame:
    """The rows and deletes of a topic whose keys come once, without those that a refresh left behind."""
    return unswept(topic.where(F.col("variant") != "refresh"), topic)


def latest(topic: DataFrame, keep_deletes: bool = False, sweep: bool = True) -> DataFrame:
    """The last version by key; one aggregation with partial results. A key whose last version is stale is
    gone, also if an earlier version isn't."""
    rows = topic.where(F.col("variant") != "refresh")
    last = rows.groupBy("key").agg(F.max_by(F.struct("idx", "seq", "variant", "generation", "payload"), F.struct("idx", "seq")).alias("_v"))
    out = last.select("key", "_v.*")
    out = unswept(out, topic) if sweep else out
    return out if keep_deletes else out.where(F.col("variant") == "row")


def scrubbed(log: DataFrame, bound: int | None = None) -> DataFrame:
    """Right to be forgotten: rows before the last delete (up to bound) of their (topic, key) go; tombstones stay."""
    dead = (F.col("variant") == "delete") & (F.lit(True) if bound is None else F.col("idx") <= bound)
    gone = log.where(dead).groupBy("topic", "key").agg(F.max("idx").alias("_gone"))
    out = log.join(gone, ["topic", "key"], "left")
    return out.where(~((F.col("variant") == "row") & (F.col("idx") < F.coalesce("_gone", F.lit(-1))))).drop("_gone").select(*log.columns)


def compacted(log: DataFrame, snapshot_topics: list[str]) -> DataFrame:
    """Snapshot topics keep the last entry by (topic, key); the others stay whole."""
    last = log.where(F.col("topic").isin(snapshot_topics)).groupBy("topic", "key").agg(F.max_by(F.struct(*(c for c in log.columns if c not in ("topic", "key"))), F.struct("idx", "seq")).alias("_v"))
    return log.where(~F.col("topic").isin(snapshot_topics)).unionByName(last.select("topic", "key", "_v.*").select(*log.columns))


def refresh_epochs(log: DataFrame) -> DataFrame:
    return log.groupBy("topic").agg(F.max("generation").alias("epoch"))


def actual_at(log: DataFrame, idx: int) -> DataFrame:
    return log.where(F.col("idx") == idx)
