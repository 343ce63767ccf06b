"""Shared pieces: the shared scratch folder, Arrow text access, row keys, connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local(spark: SparkSession) -> bool:
    """Whether the session's executors are threads of the driver."""
    return bool(re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", spark.sparkContext.master))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a fresh local one where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tidefold-")
    return _LOCAL[app]


class Scratch:
    """Tables written under the shared folder to cut lineage; they survive lost executors."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidefold-{tag}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def reclaim(self) -> None:
        """Let Spark remove the shuffle files of finished steps, which it does when their plans are
        collected; the listeners hold the last plan for a moment longer than its job runs. In a local
        session, which holds small tables, they wait for the next collection."""
        for _ in range(0 if local(self.spark) else 2):
            gc.collect()
            time.sleep(0.5)
            self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later step reads."""
        path = vars(df).pop("_scratch_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a few numbers that are broadcast, some 16 MB.
FEW_ROWS = 400_000


def bounded(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """``df`` (a written table of a few numbers a row), marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fits(columns: list[str], wanted: str) -> str:
    """``wanted``, or that with underscores in front, so that it clashes with none of ``columns``."""
    low = {c.lower() for c in columns}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values back to back, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and offs[-1] else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give back to the system what earlier tasks of this worker have freed; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, in slices of about ``most`` bytes of text (one row at least)."""
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = utf8(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    batch = None
    release()


_MULT = np.uint64(0x9E3779B97F4A7C15)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _C1
    x = x ^ (x >> np.uint64(27))
    x = x * _C2
    return x ^ (x >> np.uint64(31))


_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses."""
    if len(_POW[0]) < n:
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        for i, base in enumerate((_MULT, inverse)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _POW[i] = np.multiply.accumulate(step)
    return _POW[0][:n], _POW[1][:n]


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width``-byte window."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: n - width + 1])


def spans_hash(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[lo:hi]; equal bytes give equal hashes."""
    n = len(data)
    if not len(lo):
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[hi] - total[lo]) * down[lo] ^ (hi - lo).astype(np.uint64) * _C2)


def order_key(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """(k, doc_id, text), and whether k is the id: k is unique and ordered as (doc_id, text), null ids last.

    Where ids are unique and not null, k is the id and nothing is written. Else the rows are sorted
    once by (id, SHA-256 of the text) into a scratch table and numbered in that order."""
    n, known = docs.agg(F.count("*"), F.count(id_col)).first()
    ok = n == known and docs.groupBy(id_col).count().where("count > 1").limit(1).count() == 0
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if ok:
        return base.select(F.col("doc_id").alias("k"), "doc_id", "text"), True
    ordered = base.withColumn("_h", F.sha2(F.coalesce("text", F.lit("")), 256)).orderBy(F.col("doc_id").asc_nulls_last(), "_h")
    return scratch.write(ordered.select(F.monotonically_increasing_id().alias("k"), "doc_id", "text"), "keyed"), False


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (a, b) that one task gets."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    for at in range(0, len(nodes), 1 << 16):
        some = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], ["node", "component"])


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60, alone: int = 300_000) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); component is the smallest reachable node.

    Up to ``alone`` edges one task unites them (some 60 MB). Beyond, alternating large-star and small-star
    steps: each is an aggregation with partial sums and a join, each round is written to the shared folder,
    and no list of neighbours is ever gathered."""
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.write(now, "edges")
    if now.count() <= alone:
        return now.select("a", "b").coalesce(1).mapInArrow(united, "node long, component long")
    told = None
    for _ in range(most_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = scratch.write(small, "stars")
        scratch.drop(now)
        sums = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = new
        if tuple(sums) == told:
            break
        told = tuple(sums)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
