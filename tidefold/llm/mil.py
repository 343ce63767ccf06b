"""Op 3, a quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of ``WORDS`` words (the last may be shorter); every passage of the whole
text is encoded as a vector of word and byte statistics and hashed byte pairs. A hidden layer, gated
attention (a tanh branch times a sigmoid branch, softmax over the bag) and a logistic output are
learned from document labels alone; a document's score is the output for its weighted passages.

The model is fitted on the driver on at most ``train_docs`` labelled documents, taken in the order of
a hash of doc_id, with at most ``train_passages`` evenly spaced passages each; both bounds limit the
fitting only. Scoring is one pass without a shuffle over whole texts.

Null and empty texts are bags of one empty passage. Several labels for a doc_id: the least counts.
Without labels of both kinds every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, slices, spans_hash, table, utf8

WORDS, BUCKETS, STATS, HIDDEN, GATE = 64, 64, 15, 32, 16

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(chars)] = 1
    return out


_CLASSES = [
    _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(b"0123456789"), _class(b"#*$%&|<>"), _class(b"!"),
    _class(b".,;:?"), _class(bytes(range(128, 256))), _class(b"\n"), _class(b"@/\\=_+~^{}[]()"),
]


def encode(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages x features, document of each passage) for texts given back to back; one passage at least for each text."""
    n_docs, n = len(offs) - 1, len(data)
    space = _SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    begin = ~space
    begin[1:] &= space[:-1] | first[1:n]
    lo = np.flatnonzero(begin)
    if not len(lo):
        return np.zeros((n_docs, STATS + BUCKETS), np.float32), np.arange(n_docs)
    stop = ~space
    stop[:-1] &= space[1:] | first[1:n]
    hi = np.flatnonzero(stop) + 1
    doc = np.searchsorted(offs, lo, "right") - 1
    at = np.arange(len(lo)) - np.searchsorted(lo, offs[:-1])[doc]
    new = at % WORDS == 0
    pid, heads = np.cumsum(new) - 1, np.flatnonzero(new)
    tails = np.r_[heads[1:], len(lo)] - 1
    count = (tails - heads + 1).astype(np.float64)
    size = (hi - lo).astype(np.float64)
    total = np.bincount(pid, size)
    a, b = lo[heads], hi[tails]
    width = np.maximum(b - a, 1).astype(np.float64)
    out = np.zeros((len(heads), STATS + BUCKETS), np.float32)
    out[:, 0] = np.log1p(count)
    out[:, 1] = mean = total / count
    out[:, 2] = np.sqrt(np.maximum(np.bincount(pid, size * size) / count - mean * mean, 0))
    words = spans_hash(data, lo, hi)
    order = np.argsort(words ^ mix(pid.astype(np.uint64) + np.uint64(1)))  # equal words of a passage lie side by side
    same = (words[order][1:] == words[order][:-1]) & (pid[order][1:] == pid[order][:-1])
    out[:, 3] = np.bincount(pid[order][1:][same], minlength=len(heads)) / count
    near = (words[1:] == words[:-1]) & (pid[1:] == pid[:-1])
    out[:, 4] = np.bincount(pid[1:][near], minlength=len(heads)) / count
    out[:, 5] = np.bincount(pid[size == 1], minlength=len(heads)) / count
    for k, member in enumerate(_CLASSES):
        sums = np.zeros(n + 1, np.int64)
        np.cumsum(member[data], out=sums[1:])
        out[:, 6 + k] = (sums[b] - sums[a]) / width
    where = np.zeros(n + 1, np.int32)
    np.add.at(where, a, 1)
    where = np.cumsum(where[:n]) - 1
    if n > 1:
        pair = (data[:-1].astype(np.uint32) << np.uint32(8) | data[1:]) * np.uint32(2654435769) >> np.uint32(26)
        inside = (where[:-1] >= 0) & ~first[1:n]
        got = np.bincount(where[:-1][inside].astype(np.int64) * BUCKETS + pair[inside], minlength=len(heads) * BUCKETS)
        out[:, STATS:] = np.sqrt(got[: len(heads) * BUCKETS].reshape(-1, BUCKETS) / width[:, None])
    owner = doc[heads]
    missing = np.setdiff1d(np.arange(n_docs), owner)
    if len(missing):
        out, owner = np.vstack([out, np.zeros((len(missing), STATS + BUCKETS), np.float32)]), np.r_[owner, missing]
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def _bags(x: np.ndarray, owner: np.ndarray, m: dict) -> dict:
    """The forward pass; owner is sorted and every bag has a passage."""
    edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    bag = np.cumsum(np.r_[False, owner[1:] != owner[:-1]])
    xs = (x - m["mean"]) / m["scale"]
    h = np.tanh(xs @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * g) @ m["w"]
    e = np.exp(e - np.maximum.reduceat(e, edges)[bag])
    a = e / np.add.reduceat(e, edges)[bag]
    z = np.add.reduceat(a[:, None] * h, edges)
    return {"xs": xs, "h": h, "t": t, "g": g, "a": a, "bag": bag, "edges": edges, "z": z, "logit": z @ m["c"] + m["d"]}


def score_bags(x: np.ndarray, owner: np.ndarray, m: dict) -> np.ndarray:
    if "constant" in m:
        return np.full(len(np.unique(owner)), m["constant"])
    return 1 / (1 + np.exp(-np.clip(_bags(x.astype(np.float32), owner, m)["logit"], -40, 40))).astype(np.float64)


def fit(x: np.ndarray, owner: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 7) -> dict:
    """Adam on the logistic loss with weight decay; y is by bag, in the order of owner."""
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.5}
    rng, d = np.random.default_rng(seed), x.shape[1]
    m = {"mean": x.mean(0), "scale": x.std(0) + 0.01}
    p = {"W": rng.normal(0, d**-0.5, (d, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(())}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m = {k: v.astype(np.float32) for k, v in m.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    bounds = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True])
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            ids = np.sort(order[at : at + batch])
            rows = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in ids])
            f = _bags(x[rows], np.repeat(np.arange(len(ids)), bounds[ids + 1] - bounds[ids]), m | p)
            err = (1 / (1 + np.exp(-f["logit"])) - y[ids]).astype(np.float32) / len(ids)
            dz = err[:, None] * p["c"]
            da = (dz[f["bag"]] * f["h"]).sum(1)
            de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["edges"])[f["bag"]])
            dtg = de[:, None] * p["w"]
            dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
            dh = f["a"][:, None] * dz[f["bag"]] + dt @ p["V"].T + dg @ p["U"].T
            dh *= 1 - f["h"] ** 2
            grads = {"W": f["xs"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ err, "d": err.sum()}
            step += 1
            lr = rate * (1 - epoch / epochs) + 1e-4
            for k, g in grads.items():
                g = g + 1e-4 * p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = (p[k] - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m | p


def held_out(column: str, folds: int, fold: int):
    """Whether the row's id falls into the fold that no model learns from; a null id counts as ''."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds) == fold


def train(docs: DataFrame, labels: DataFrame, train_docs: int = 5000, train_passages: int = 64) -> dict:
    """The fitted model. What reaches the driver is bounded by train_docs * train_passages vectors of 79 floats
    (101 MB); of rows that share an id one text is taken."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_y"))
    known = known.where(~held_out("doc_id", 5, 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    picked = F.broadcast(known.withColumnRenamed("doc_id", "_id"))  # at most train_docs rows
    bags = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("_id"))
    bags = bags.groupBy("doc_id", "_y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("_t")).select("doc_id", "_y", "_t.text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x, owner = encode(*utf8(part.column(2)))
            out = []
            for i in range(part.num_rows):
                own = x[owner == i]
                if len(own) > train_passages:
                    own = own[np.linspace(0, len(own) - 1, train_passages).astype(int)]
                out.append(own.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), pa.array(out, pa.binary())], ["doc_id", "y", "x"])

    rows = sorted(bags.mapInArrow(vectors, "doc_id long, y int, x binary").collect(), key=lambda r: (r[0], r[1], bytes(r[2])))
    xs = [np.frombuffer(r[2], np.float32).reshape(-1, STATS + BUCKETS) for r in rows]
    owner = np.repeat(np.arange(len(xs)), [len(v) for v in xs]) if xs else np.zeros(0, int)
    return fit(np.vstack(xs) if xs else np.zeros((0, STATS + BUCKETS), np.float32), owner, np.array([float(r[1]) for r in rows]))


def score(docs: DataFrame, model: dict, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id if None) with score and predicted; one pass, no shuffle."""
    keep = keep or ["doc_id"]
    rows = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    at = rows.columns.index("text")
    schema = rows.select(*keep).schema.add("score", "double").add("predicted", "integer")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            s = score_bags(*encode(*utf8(part.column(at))), model)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names)

    return rows.mapInArrow(run, schema)


def op3_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over whole ``documents``."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
