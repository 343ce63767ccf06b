"""Incremental maintenance: micro-batches of the log, replay-safe, converging to the batch definition.

A view keeps the last version of each topic's keys, for each stage an index from its keys to the inputs that
make them and to what these look up in joins, and each stage's rows, all in buckets by key. A batch
finds the keys that its changed inputs name or named before and those whose inputs look up something
that changed, folds only these again, and hands on to later stages only rows that came out different.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import log as L
from ..operators.stages import Graph, fingerprint, flat, validated
from .store import Store

LOG = "idx long, seq int, topic string, key string, variant string, generation long, data string"
TEXT = T.StringType()


class View:
    """Stages over topics of a log, kept in a folder.

    topics: name -> DDL of the payload that the stages read. Tombstones and the last place of each refresh
    marker are kept, so entries may come in any order and any number of times."""

    def __init__(self, spark: SparkSession, path: str, topics: dict[str, str], stages: list[dict], buckets: int = 64, discriminators: dict[str, str] | None = None):
        self.spark, self.path, self.topics, self.stages, self.discriminators = spark, path.rstrip("/"), topics, validated(stages), discriminators
        self.mark = fingerprint(stages)
        self.store = Store(spark, f"{self.path}/state-{self.mark[:12]}", buckets)
        self.dead = DeadLetters(spark, f"{self.path}/dead")
        self.scratch: list[str] = []
        none = spark.createDataFrame([], LOG)
        made = Graph({t: L.typed(none, t, ddl) for t, ddl in topics.items()}, stages, discriminators)
        self.rows = {t: T.StructType([f for f in L.typed(none, t, ddl).schema.fields]) for t, ddl in topics.items()}
        self.outs = {n: T.StructType([T.StructField("key", TEXT), T.StructField("out", df.schema["out"].dataType)]) for n, df in made.out.items()}

    def indexed(self, s: dict) -> T.StructType:
        return T.StructType([T.StructField(n, TEXT) for n in ["key", "src", *(f"on{i}" for i in range(len(s.get("join", []))))]])

    # one batch

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch; a batch that was committed before is left out."""
        if batch_id <= self.store.now["batch"]:
            return
        batch = batch.persist()
        try:
            bad = (F.col("variant") == "row") & F.expr("try_parse_json(data) IS NULL")
            self.dead.record(batch.where(bad), "no JSON", batch_id)
            self._advance(batch.where(~F.coalesce(bad, F.lit(False))), batch_id)
        finally:
            batch.unpersist()

    def _marks(self, batch: DataFrame) -> dict[str, dict[str, list[int]]]:
        """topic -> generation -> last place of its marker; an entry for each refresh that ever was."""
        out = {t: dict(m) for t, m in self.store.now["more"].get("marks", {}).items()}
        for r in batch.where("variant = 'refresh'").groupBy("topic", "generation").agg(F.max(F.struct("idx", "seq")).alias("at")).collect():
            mine = out.setdefault(r.topic, {})
            mine[str(r.generation)] = max(mine.get(str(r.generation), [-1, -1]), [r["at"].idx, r["at"].seq])
        return out

    def _live(self, rows: DataFrame, marks: dict[str, list[int]]) -> DataFrame:
        stale = F.lit(False)
        for g, (idx, seq) in marks.items():
            stale = stale | ((F.col("generation") >= 1) & (F.col("generation") < int(g)) & (F.struct("idx", "seq") < F.struct(F.lit(idx).cast("long").alias("idx"), F.lit(seq).alias("seq"))))
        return rows.where((F.col("variant") == "row") & ~stale)

    def _advance(self, batch: DataFrame, batch_id: int) -> None:
        store, was, marks = self.store, self.store.now["more"].get("marks", {}), self._marks(batch)
        g = Graph({}, [], self.discriminators)
        changed: dict[str, DataFrame] = {}  # (key, old, new) of each topic and stage; null where it isn't there
        for t, ddl in self.topics.items():
            new = L.typed(batch, t, ddl).where("variant <> 'refresh'")
            swept = marks.get(t, {}) != was.get(t, {})
            only = list(range(store.buckets)) if swept else store.touched(new)
            old = store.read(t, self.rows[t], only)
            both = old.unionByName(new).groupBy("key").agg(F.max_by(F.struct(*(c for c in old.columns if c != "key")), F.struct("idx", "seq")).alias("v"))
            store.write(t, both.select("key", "v.*").select(*old.columns), only, batch_id)
            place = F.struct("idx", "seq")
            before = self._live(old, was.get(t, {})).select("key", F.col("payload").alias("old"), place.alias("a"))
            after = self._live(store.read(t, self.rows[t], only), marks.get(t, {})).select("key", F.col("payload").alias("new"), place.alias("b"))
            changed[t] = self._kept(before.join(after, "key", "full_outer").where("NOT (a <=> b)").select("key", "old", "new"), f"change-{t}", batch_id)
            g.last[t] = self._live(store.read(t, self.rows[t]), marks.get(t, {}))
        for s in self.stages:
            name, schema = s["name"], self.outs[s["name"]]
            if "merge" in s:
                sides = [m if isinstance(m, str) else m["stage"] for m in s["merge"]]
                keys = self._kept(reduce(DataFrame.unionByName, [changed[n].select("key") for n in sides]).distinct(), f"keys-{name}", batch_id)
                only = store.touched(keys)
                part = Graph({}, [], self.discriminators)
                part.out = {n: store.read(n, self.outs[n], only).join(keys, "key", "left_semi") for n in sides}
                folds = part.merge(s)
            else:
                keys, only, folds = self._again(s, g, changed, marks, batch_id)
            old = store.read(name, schema, only)
            fresh = self._kept(folds.select("key", "out"), f"fold-{name}", batch_id)
            store.write(name, old.join(keys, "key", "left_anti").unionByName(fresh), only, batch_id)
            delta = old.join(keys, "key", "left_semi").select("key", F.col("out").alias("old")).join(fresh.select("key", F.col("out").alias("new")), "key", "full_outer")
            changed[name] = self._kept(delta.where(~self._same(schema)), f"change-{name}", batch_id)  # equal rows aren't handed on
            g.out[name] = store.read(name, schema)
            g.told(s)
        store.commit(batch_id, {"marks": marks})
        for path in self.scratch:
            p, fs = store._fs(path)
            fs.delete(p, True)

    def _kept(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        """``df`` written beside the state, for the steps of this batch."""
        path = f"{self.path}/work/{name}"
        self.scratch = [*(p for p in self.scratch if p != path), path]
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _same(self, schema: T.StructType):
        if "variant" in schema["out"].dataType.simpleString():
            return F.to_json("old").eqNullSafe(F.to_json("new"))
        return F.col("old").eqNullSafe(F.col("new"))

    def _again(self, s: dict, g: Graph, changed: dict[str, DataFrame], marks: dict, batch_id: int) -> tuple[DataFrame, list[int], DataFrame]:
        """(keys to fold again, their buckets, their rows); the stage's index is brought up to date."""
        store, name, schema = self.store, s["name"], self.indexed(s)
        delta = changed[s["from"]]
        side = lambda c: g.members(delta.where(F.col(c).isNotNull()).select(F.col("key").alias("_in"), F.col(c).alias("_p")), s).select(F.col("_key").alias("key"), F.col("_src").alias("src"))
        now = side("new")
        named = [side("old").select("key"), now.select("key")]
        index = store.read(f"index-{name}", schema)
        for n, j in enumerate(s.get("join", [])):
            moved = changed[j.get("from", j.get("topic"))].select(F.lower("key").alias("key") if j.get("normalize") == "lower" else F.col("key"))
            named.append(index.join(moved.select(F.col("key").alias(f"on{n}")).distinct(), f"on{n}", "left_semi").select("key"))
        keys = self._kept(reduce(DataFrame.unionByName, named).distinct(), f"keys-{name}", batch_id)
        only = store.touched(keys)
        mine = store.read(f"index-{name}", schema, only)
        sources = self._kept(mine.join(keys, "key", "left_semi").select("src").unionByName(now.select("src")).distinct(), f"src-{name}", batch_id)
        held = store.touched(sources, "src")
        if s["from"] in self.topics:
            inputs = self._live(store.read(s["from"], self.rows[s["from"]], held), marks.get(s["from"], {})).select(F.col("key").alias("_in"), F.col("payload").alias("_p"))
        else:
            inputs = store.read(s["from"], self.outs[s["from"]], held).select(F.col("key").alias("_in"), F.col("out").alias("_p"))
        members = g.members(inputs.join(sources.withColumnRenamed("src", "_in"), "_in", "left_semi"), s)
        members = members.join(keys.withColumnRenamed("key", "_key"), "_key", "left_semi")
        found = self._kept(g.looked_up(members, s), f"index-{name}", batch_id)
        store.write(f"index-{name}", mine.join(keys, "key", "left_anti").unionByName(found), only, batch_id)
        return keys, only, g.folded(members, s)

    # reading and running

    def table(self, stage: str | None = None) -> DataFrame:
        """(key, fields) of a stage, the last one if none is named."""
        name = stage or self.stages[-1]["name"]
        return flat(self.store.read(name, self.outs[name]))

    def start(self, source: DataFrame, once: bool = True, every: str = "10 seconds") -> StreamingQuery:
        """``source`` (columns of LOG) through ``apply``; readers' rate limits bound a batch."""
        writer = source.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.path}/checkpoint-{self.mark[:12]}")
        return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=every).start()

    def rebuild(self, log: DataFrame) -> None:
        """Drop the state and fold a whole log as one batch; later batches go on from there."""
        at = max(self.store.now["batch"], 0)
        self.store.drop()
        self.apply(log, at)


def visible(log: DataFrame, applied: int) -> DataFrame:
    """Readers never see past the applied index."""
    return log.where(F.col("idx") <= applied)


def affected(topic: DataFrame, changed: DataFrame, key_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The latest inputs of all keys that changed inputs name now or named before; the rest needn't be folded again."""
    touched = topic.join(changed.select("key").distinct(), "key", "left_semi")
    keys = key_of(touched.where(F.col("variant") == "row")).select("_key").distinct()
    return key_of(L.latest(topic)).join(keys, "_key", "left_semi")


def progress(query: StreamingQuery) -> dict:
    last = query.lastProgress
    return {"running": query.isActive, "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else 0}


def lag(log: DataFrame, view: View) -> DataFrame:
    """By topic: entries of the log that are newer than the newest one that the view holds."""
    held = reduce(DataFrame.unionByName, [view.store.read(t, view.rows[t]).agg(F.max("idx").alias("at")).select(F.lit(t).alias("topic"), "at") for t in view.topics])
    return log.join(F.broadcast(held), "topic").groupBy("topic").agg(F.count(F.when(F.col("at").isNull() | (F.col("idx") > F.col("at")), 1)).alias("behind"))


class Parked(RuntimeError):
    """A query that failed too often without going on."""


def supervised(start: Callable[[], StreamingQuery], most: int = 5, first: float = 1.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Runs a query to its end, starting it again after failures with growing pauses.

    Failures count only while no batch is completed between them; after ``most`` of these the query is parked."""
    failures, reached = 0, -1
    while True:
        query = start()
        try:
            query.awaitTermination()
            return query
        except Exception as e:
            last = query.lastProgress
            at = last["batchId"] if last else -1
            failures, reached = (1, at) if at > reached else (failures + 1, reached)
            if failures > most:
                raise Parked(str(e)) from e
            sleep(min(longest, first * 2 ** (failures - 1)))


class DeadLetters:
    """Entries that could not be applied: kept, listed, acknowledged, driven again."""

    KEPT = f"{LOG}, reason string, batch long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, df: DataFrame, reason: str, batch: int = -1) -> None:
        """Entries of a batch; the same batch again replaces them."""
        if df.limit(1).count():
            df.select(*(x.split()[0] for x in LOG.split(", "))).withColumn("reason", F.lit(reason)).withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/entries/batch-{batch}")

    def _all(self, folder: str, schema: str) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.path}/{folder}") if there else self.spark.createDataFrame([], schema)

    def list(self) -> DataFrame:
        """All entries, acknowledged or not."""
        done = self._all("acknowledged", "topic string, idx long, seq int").distinct().withColumn("acknowledged", F.lit(True))
        return self._all("entries", self.KEPT).join(done, ["topic", "idx", "seq"], "left").withColumn("acknowledged", F.coalesce("acknowledged", F.lit(False)))

    def acknowledge(self, entries: DataFrame) -> None:
        """Entries (topic, idx, seq) that need no more attention."""
        entries.select("topic", F.col("idx").cast("long"), F.col("seq").cast("int")).write.mode("append").parquet(f"{self.path}/acknowledged")

    def replay(self, apply: Callable[[DataFrame], None]) -> None:
        apply(self.list().where("NOT acknowledged").drop("reason", "batch", "acknowledged"))
