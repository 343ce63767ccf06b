"""Keyed tables in buckets. A batch rewrites the buckets that it touches; one manifest commits them all."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Store:
    """Tables (key, ...) as parquet, a folder for each bucket of the key's hash, and manifests that name the folders.

    Readers see the last manifest. A batch that fails before its commit leaves the tables as they were, and
    its folders are written over when it comes again. The driver holds one path for each bucket and table."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.now: dict = self._last()
        self.next: dict[str, dict[str, str]] = {}

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _last(self) -> dict:
        done = [n for n in self._names(f"{self.path}/manifest") if "_SUCCESS" in self._names(f"{self.path}/manifest/{n}")]
        if not done:
            return {"number": 0, "batch": -1, "buckets": self.buckets, "tables": {}, "more": {}}
        text = self.spark.read.text(f"{self.path}/manifest/{done[-1]}", wholetext=True).first()[0]
        found = json.loads(text)
        self.buckets = found["buckets"]
        return found

    def bucket(self, key: str = "key"):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame, key: str = "key") -> list[int]:
        """The buckets of some keys; no more numbers than there are buckets."""
        return [r[0] for r in keys.select(self.bucket(key)).distinct().collect()]

    def read(self, name: str, schema: T.StructType, only: list[int] | None = None) -> DataFrame:
        paths = self.next.get(name, self.now["tables"].get(name, {}))
        wanted = [p for b, p in paths.items() if only is None or int(b) in set(only)]
        return self.spark.read.schema(schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], schema)

    def write(self, name: str, rows: DataFrame, only: list[int], batch: int) -> None:
        """The whole new content of the buckets ``only``."""
        at = f"{self.path}/{name}/{self.now['number'] + 1:09d}-{batch}"
        rows.withColumn("_b", self.bucket()).repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(at)
        there = {n.removeprefix("_b=") for n in self._names(at) if n.startswith("_b=")}
        kept = {b: p for b, p in self.now["tables"].get(name, {}).items() if int(b) not in set(only)}
        self.next[name] = kept | {b: f"{at}/_b={b}" for b in there}

    def commit(self, batch: int, more: dict) -> None:
        """The written buckets become the tables'; folders that neither this nor the last manifest names go."""
        was = self.now
        new = {"number": was["number"] + 1, "batch": batch, "buckets": self.buckets, "tables": was["tables"] | self.next, "more": more}
        self.spark.createDataFrame([(json.dumps(new),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{new['number']:012d}")
        named = {p for m in (was, new) for t in m["tables"].values() for p in t.values()}
        for old in was.get("before", []):
            if old not in named:
                p, fs = self._fs(old)
                fs.delete(p, True)
        for n in self._names(f"{self.path}/manifest")[:-2]:
            p, fs = self._fs(f"{self.path}/manifest/{n}")
            fs.delete(p, True)
        self.now, self.next = new | {"before": [p for t in was["tables"].values() for p in t.values()]}, {}

    def drop(self) -> None:
        p, fs = self._fs(self.path)
        fs.delete(p, True)
        self.now, self.next = self._last(), {}
