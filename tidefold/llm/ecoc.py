"""Op 10, language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed byte n-grams (2 to 4 bytes,
A-Z lower-cased, square roots of shares) predicts it. Decoding sums the logistic losses of all bits
against each codeword, weighted by how well the bit was learned, and takes the codeword of least loss.
The score is the softmax of the negative losses; ``ambiguous`` tells that the second is close.

Fitting takes at most ``per_lang`` texts of each language (by a hash of doc_id; languages beyond
``most_langs`` are refused). Prediction is one pass without a shuffle over whole texts.

Null texts and texts without a letter are ``und`` with score 0, as is everything where no language can
be learned. With one language alone every other text gets it. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8
from .mil import held_out

BUCKETS = 2048
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Hashed n-gram features of each text, of length 1 (0 for texts of a byte or none)."""
    n_docs, n = len(offs) - 1, len(data)
    counts = np.zeros(n_docs * BUCKETS, np.int64)
    low = _LOWER[data]
    owner = np.repeat(np.arange(n_docs), np.diff(offs))
    code = low
    for size in (2, 3, 4):
        if n < size:
            break
        code = (code[: n - size + 1] << np.uint32(8)) | low[size - 1 :]
        inside = owner[: n - size + 1] == owner[size - 1 :]
        bucket = ((code + np.uint32(size * 7919)) * np.uint32(2654435769)) >> np.uint32(21)
        counts += np.bincount((owner[: n - size + 1] * BUCKETS + bucket)[inside], minlength=n_docs * BUCKETS)
    x = counts.reshape(n_docs, BUCKETS).astype(np.float32)
    return np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """k rows of -1 and 1: the exhaustive code up to 5 languages (up to 3, thrice), else the best of random ones."""
    if k <= 5:
        bits = [[1 if (c >> i) & 1 else -1 for i in range(k)] for c in range(1, 1 << (k - 1))]
        return np.tile(np.array(bits, np.float32).T.reshape(k, -1), 3 if k <= 3 else 1)
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    best, far = None, -1
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], (k, length)).astype(np.float32)
        apart = ((length - code @ code.T) / 2 + np.eye(k) * length).min()
        spread = np.abs(code.sum(0)).max() < k
        if spread and apart > far:
            best, far = code, apart
    return best


def fit(x: np.ndarray, y: np.ndarray, k: int, steps: int = 120) -> dict:
    """One logistic classifier for each bit, fitted together by Adam; y holds the languages' numbers. Bits that are
    there thrice are learned from a third of the features each, so that they fail apart."""
    code = codewords(k)
    seen = np.ones((BUCKETS, code.shape[1]), np.float32)
    if k <= 3:
        third = np.arange(code.shape[1]) * 3 // code.shape[1]
        seen = (np.arange(BUCKETS)[:, None] % 3 == third[None]).astype(np.float32)
    target = code[y]
    share = np.bincount(y, minlength=k) / max(len(y), 1)
    weight = (1 / np.maximum(share, 1e-6))[y]
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m1, m2, n1, n2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        g = -target * weight / (1 + np.exp(target * (x @ w + b)))
        gw, gb = (x.T @ g + 1e-5 * w) * seen, g.sum(0)
        m1, m2, n1, n2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw * gw, 0.9 * n1 + 0.1 * gb, 0.99 * n2 + 0.01 * gb * gb
        lr = 0.3 * (1 - t / (steps + 1)) + 0.01
        w -= lr * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        b -= lr * (n1 / (1 - 0.9**t)) / (np.sqrt(n2 / (1 - 0.99**t)) + 1e-8)
    right = ((target * (x @ w + b) > 0) * weight).sum(0)
    return {"code": code, "w": w, "b": b, "trust": np.maximum(2 * right - 1, 0.01).astype(np.float32)}


def decode(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the language, score, gap to the second) for each row, some 4 million losses at a time."""
    k, most = len(model["code"]), max(1, (1 << 22) // model["code"].size)
    if len(x) > most:
        return tuple(np.concatenate(c) for c in zip(*(decode(x[at : at + most], model) for at in range(0, len(x), most)), strict=True))
    if k == 1:
        one = np.ones(len(x))
        return np.zeros(len(x), int), one, one
    f = x @ model["w"] + model["b"]
    loss = (np.logaddexp(0, -model["code"][None] * f[:, None, :]) * model["trust"]).sum(2).astype(np.float64)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    top = np.sort(p, axis=1)
    return p.argmax(1), top[:, -1], top[:, -1] - top[:, -2]


def train(docs: DataFrame, per_lang: int = 700, most_langs: int = 500) -> tuple[list[str], dict | None]:
    """What reaches the driver is bounded by per_lang * most_langs vectors of BUCKETS numbers."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", 4, 2))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().orderBy("lang").limit(most_langs + 1).collect()}
    if len(counts) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not counts:
        return [], None
    langs = sorted(counts)
    row = F.xxhash64(F.lit("fit"), "doc_id", "text")
    at = F.pmod(row, F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, per_lang / counts[k]))]), F.col("lang"))
    # repeated rows count once; partial results keep a row that many share from meeting in one task
    picked = known.where(at < share).groupBy("lang", row.alias("doc_id")).agg(F.min("text").alias("text")).select("doc_id", "lang", "text").limit(2 * per_lang * len(langs))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = grams(*utf8(part.column(2))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([v.tobytes() for v in x], pa.binary())], ["lang", "x"])

    rows = sorted(picked.mapInArrow(vectors, "lang string, x binary").collect(), key=lambda r: (r[0], bytes(r[1])))
    if not rows:
        return [], None
    langs = sorted({r[0] for r in rows})
    if len(langs) == 1:
        return langs, {"code": np.ones((1, 1), np.float32)}
    x = np.stack([np.frombuffer(r[1], np.float16) for r in rows]).astype(np.float32)
    return langs, fit(x, np.array([langs.index(r[0]) for r in rows]), len(langs))


def predict(docs: DataFrame, langs: list[str], model: dict | None, close: float = 0.2) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ok = part.column(1).to_numpy(zero_copy_only=False)
            if model is None:
                pick, s, gap, ok = np.zeros(len(ok), int), np.zeros(len(ok)), np.ones(len(ok)), np.zeros(len(ok), bool)
            else:
                pick, s, gap = decode(grams(*utf8(part.column(2))), model)
            names = [langs[i] if o else "und" for i, o in zip(pick, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(np.where(ok, s, 0.0)), pa.array(ok & (gap < close))], ["doc_id", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op10_output_codes_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over whole ``documents``."""
    docs = table(spark, sf_dir, "documents")
    langs, model = train(docs)
    return predict(docs, langs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")
