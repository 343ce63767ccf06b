"""Sinks: keyed mirrors, append histories, webhooks, coercion, dead letters, table teardown."""

from __future__ import annotations

import base64
import json
import re
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scope import Scope
from .log import latest, swept

NUMERIC = re.compile(r"^(TINY|SMALL|MEDIUM|BIG)?(INT|SERIAL)|^(INTEGER|DECIMAL|NUMERIC|NUMBER|MONEY|REAL|DOUBLE|FLOAT)", re.I)
APPROXIMATE = re.compile(r"^(REAL|DOUBLE|FLOAT)", re.I)
BINARY = re.compile(r"^(BYTEA|.*BLOB|.*BINARY)", re.I)
BOOLEAN = re.compile(r"^BOOL", re.I)


def coerced(value: Column, kind: T.DataType, declared: str) -> Column:
    """A payload value in the family of a declared column type; null where it doesn't fit."""
    text = value.cast("string")
    if BOOLEAN.match(declared):
        return text.try_cast("boolean")
    if APPROXIMATE.match(declared):
        return text.try_cast("double")
    if m := re.match(r"^(?:DECIMAL|NUMERIC|NUMBER)\s*\((\d+)\s*(?:,\s*(\d+))?\)", declared, re.I):
        return text.try_cast(f"decimal({m[1]},{m[2] or 0})")
    if NUMERIC.match(declared):
        return text.try_cast("bigint") if re.match(r"^(TINY|SMALL|MEDIUM|BIG)?(INT|SERIAL)|^INTEGER", declared, re.I) else text.try_cast("decimal(38,12)")
    if BINARY.match(declared):
        return F.unbase64(text)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    if re.match(r"^TIMESTAMP", declared, re.I):
        return text.try_cast("timestamp")
    return text.try_cast("date") if re.match(r"^DATE$", declared, re.I) else text


def _mapped(df: DataFrame, mappings: dict[str, str | tuple[str, str]]) -> list[Column]:
    scope = Scope({"": (F.col("payload"), df.schema["payload"].dataType)})
    out = []
    for column, m in mappings.items():
        path, declared = m if isinstance(m, tuple) else (m, "")
        if path == "$":
            out.append((F.col("data") if "data" in df.columns else F.to_json("payload")).alias(column))
        else:
            v = scope.get(path)
            out.append((coerced(v.col, v.kind, declared) if declared else v.col).alias(column))
    return out


def mirror(topic: DataFrame, mappings: dict[str, str | tuple[str, str]], primary_key: list[str], key_column: str | None = None) -> DataFrame:
    """The last row of each primary key. Deletes go by the entity's key, which stands for the primary
    key (or for ``key_column``); rows that a refresh left behind go, too."""
    rows = topic.where(F.col("variant") == "row").select("idx", "seq", "generation", F.col("key").alias("_key"), *_mapped(topic, mappings))
    marks = topic.where(F.col("variant") == "refresh").agg(F.max("generation").alias("_mark"), F.max("idx").alias("_at"))
    last = rows.groupBy(*primary_key).agg(F.max_by(F.struct("idx", "seq", "generation", *(c for c in mappings if c not in primary_key)), F.struct("idx", "seq")).alias("_v"), F.max(F.struct("idx", "seq")).alias("_o"))
    last = last.select(*primary_key, "_v.*", "_o")
    parts = [key_column] if key_column else primary_key
    text = F.to_json(F.array(*(F.col(c).cast("string") for c in parts))) if len(parts) > 1 else F.col(parts[0]).cast("string")
    gone = topic.where(F.col("variant") == "delete").groupBy(F.col("key").alias("_k")).agg(F.max(F.struct("idx", "seq")).alias("_d"))
    out = last.withColumn("_k", text).join(gone, "_k", "left").where(F.col("_d").isNull() | (F.col("_o") > F.col("_d")))
    out = out.join(F.broadcast(marks), how="cross")  # one row
    stale = (F.col("generation") >= 1) & (F.col("generation") < F.coalesce("_mark", F.lit(0))) & (F.col("idx") < F.coalesce("_at", F.lit(0)))
    return out.where(~stale).select(*mappings)


def history(topic: DataFrame, mappings: dict[str, str | tuple[str, str]]) -> DataFrame:
    """Every row once, by (idx, seq), however often it was delivered."""
    once = topic.where(F.col("variant") == "row").dropDuplicates(["idx", "seq"])
    return once.select("idx", "seq", *_mapped(once, mappings))


def webhook_envelopes(log: DataFrame, topic: str) -> DataFrame:
    """One body for each actual: operations in order, keys in base64, the index as Idempotency-Key."""
    op = F.when(F.col("variant") == "row", "upsert").otherwise(F.col("variant"))
    entry = F.struct(F.col("seq"), op.alias("op"), F.base64(F.col("key").cast("binary")).alias("key"), F.col("data"))
    body = F.to_json(F.transform(F.sort_array(F.collect_list(entry)), lambda x: F.struct(x.op.alias("op"), x.key.alias("key"), x.data.alias("data"))))
    return log.where(F.col("topic") == topic).groupBy("idx").agg(F.concat(F.lit('{"entities":'), body, F.lit("}")).alias("body")).select(F.col("idx").cast("string").alias("idempotency_key"), "idx", "body")


def post(url: str, method: str = "POST", headers: dict[str, str] | None = None, timeout: float = 5.0):
    """A foreachPartition function that sends envelopes in order; 422 and 451 concern the entry, others are transient."""

    def send(rows: Iterator) -> None:
        for r in sorted(rows, key=lambda r: r["idx"]):
            ask = urllib.request.Request(url, r["body"].encode(), {"Content-Type": "application/json", "Idempotency-Key": r["idempotency_key"], **(headers or {})}, method=method)
            try:
                urllib.request.urlopen(ask, timeout=timeout).close()
            except urllib.error.HTTPError as e:
                if e.code not in (422, 451):
                    raise

    return send


def entry_specific(status: int | None = None, sqlstate: str | None = None) -> bool:
    """Whether an error concerns the entry (it goes to the dead letters) or is transient."""
    return status in (422, 451) or bool(sqlstate and sqlstate[:2] in ("22", "23"))


def with_nul(log: DataFrame) -> DataFrame:
    """Entries that a text column of some databases refuses."""
    return log.where(F.col("data").contains("\\u0000") | F.col("data").contains("\x00"))


def decode_key(text: str) -> bytes:
    return base64.b64decode(text)


def write_snapshot(df: DataFrame, path: str, batch_id: int, indexes: list[list[str]] | None = None) -> str:
    """A parquet snapshot by batch, and a pointer that is moved when it is whole; declared indexes are kept beside it."""
    spark, at = df.sparkSession, f"{path}/snapshot-{batch_id:012d}"
    df.write.mode("overwrite").parquet(at)
    point = spark.createDataFrame([(batch_id, at, json.dumps(indexes or []))], "batch_id long, path string, indexes string")
    point.coalesce(1).write.mode("append").json(f"{path}/_pointer")
    return at


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    last = spark.read.schema("batch_id long, path string, indexes string").json(f"{path}/_pointer").orderBy(F.desc("batch_id")).first()
    return spark.read.parquet(last["path"])


def teardown(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


__all__ = ["coerced", "history", "latest", "mirror", "swept", "webhook_envelopes"]
