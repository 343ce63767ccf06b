"""Op 4, a Jaccard self-join on word shingles by universe partitions and the pigeonhole principle.

Sets with Jaccard similarity of at least t differ in at most H = (1 - t) / (1 + t) * (r + s) elements.
The universe of shingle hashes is dealt into m segments, m by size band (sizes of one bit length). A
set gives each segment a value: 1 if it is searched for equal, 2 if also for one element more or
less (one-deletion neighbourhoods, kept for the ``RESERVE`` first segments). If the values of either set
sum to more than H, some segment matches. m and the reserve come from ``allocation``, which takes the
fewest signatures that leave room over H for partners of any size.

1. One pass makes the signatures; texts equal to an earlier one in the same task become copies of it. A
   signature met often in one chunk of rows is salted by the chunk, so that no task of the next step gets
   more than ``LOCAL`` of its rows from a chunk. Signatures met once are dropped.
2. In each signature's group neighbours of different components are candidates; those verified on the
   words of the texts join components, until a round finds few.
3. What is left are groups in which several components meet. A group with more than ``HOT`` pairs across
   components for each member (a passage in a great many texts) is priced out, and its value is taken
   from its members. In the others all pairs across components are met, so their number is in proportion
   to the members. A pair is verified if it was found by as many values as H differences leave at least.
4. Sets whose values fall to H or below (``rest``) are only not guaranteed against each other. Of their
   shingles, rarest first by the components that hold them, a pair shares one within the first
   r - o + 1 and s - o + 1, o the least overlap of the two sizes; sizes are dealt into narrow bands so
   that a shingle common to many isn't looked at unless a pair of those sizes needs it.

Verification compares the sets' hashes, and the word tuples themselves where the overlap is within two of
the least that links, so equal hashes can't decide. Links are never gathered on the driver, and none is dropped. n_shingles counts distinct 64-bit hashes of shingles.

Null, empty and blank texts have no shingles and link with nothing. Rows with equal doc_id are told
apart by their text; null ids come last and are their own components' ids only if alone. Equal rows link.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import FEW_ROWS, Scratch, bounded, components, fits, mix, order_key, slices, spans_hash, table, utf8

INDEX, OWN, LOWER, RESERVE, LINK, LOW, COPY, DOC = 1, 2, 4, 8, 16, 32, 64, 128
#: Groups with more pairs across components than so many for each member are priced out.
HOT = 16
#: Members of a group up to which it is simply joined with itself.
SMALL = 16
#: Rows of one signature in one chunk that go to its group; others are dealt by chunk.
LOCAL = 8
#: Signatures of a chunk, about.
CHUNK = 1_000_000
#: Step 2 ends with a round that finds less than this share of the first's links; they only make step 3 shorter.
FEW = 0.01
REMEMBERED = 400_000
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_TO_LOW = bytes(_LOW)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _times(k: np.uint64, n: int) -> np.uint64:
    return np.uint64(int(k) * n & (1 << 64) - 1)


def shingles(text: str | None, words: int = 5) -> set[tuple[bytes, ...]]:
    """The exact set of a text."""
    w = (text or "").encode().translate(_TO_LOW).split()
    if len(w) < words:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(words)), strict=False))


def hashed(data: np.ndarray, offs: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of texts given back to back."""
    n_docs, n = len(offs) - 1, len(data)
    if not n:
        return [np.zeros(0, np.uint64)] * n_docs
    low, space = _LOW[data], _SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    begin, stop = ~space, ~space
    begin[1:] &= space[:-1] | first[1:n]
    stop[:-1] &= space[1:] | first[1:n]
    lo, hi = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    wh = spans_hash(low, lo, hi)
    edge = np.searchsorted(lo, offs)
    out = []
    total = np.zeros(max(len(wh) - words + 1, 0), np.uint64)
    for j in range(words):
        total += mix(wh[j : len(wh) - words + 1 + j] + _times(_K[j % 5], j + 1)) if len(total) else total
    total = mix(total)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if b - a >= words:
            own = np.sort(total[a : b - words + 1])
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
        elif b > a:
            short = wh[a:b]
            out.append(mix(np.array([np.add.reduce(mix(short + _K[0] * np.arange(1, b - a + 1, dtype=np.uint64))) ^ np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache(None)
def allocation(band: int, num: int, den: int) -> tuple[int, int]:
    """(segments, reserved ones) for sizes of bit length ``band``: the fewest signatures that leave a
    margin over H for the largest sets of the band and for those from the next one searched with in it."""
    if band <= 5:  # nearly a segment for each element; fewer would now and then leave a small set short
        return 1024, 2
    hi, t = 1 << band, num / den
    need = (1 + 1 / t) * (1 - t) / (1 + t) * hi + 1  # also where the partner is the larger one
    best, cost = (0, 0), math.inf
    for share in (0.0, 0.02, 0.05, 0.1):
        m = max(2, int(need))
        while True:
            d = min(m, 2 + int(share * m))
            lam = [hi / m, hi / t / m]
            value = [m * (1 - math.exp(-x)) + d * (1 - math.exp(-x) * (1 + x)) for x in lam]
            spread = math.sqrt(m * math.exp(-lam[0]))
            if min(value) - need >= 2 * spread + 1 + 0.05 * need or m >= 4 * hi:
                break
            m += max(1, m // 50)
        rows = m * (1 - math.exp(-lam[0])) + 2 * d * lam[0] + d
        if rows < cost:
            best, cost = (m, d), rows
    return best


def signatures(us: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted sets: (set, hash, flags) of their signatures, and of each set its value in its own band and in
    the lower one (-1 if it has no partners there). Segments are ranges of the hashes, so they come in order."""
    size = np.array([len(u) for u in us], np.int64)
    bits = np.array([int(n).bit_length() for n in size], np.int64)
    everything, owner = np.concatenate(us), np.repeat(np.arange(len(us)), size)
    weights = mix(everything ^ _K[2])
    lower = np.array([n > 0 and num * int(n) <= den * ((1 << int(b) - 1) - 1) for n, b in zip(size, bits, strict=True)], bool)
    parts, values = [], []
    for probe, which in ((OWN, size > 0), (LOWER, lower)):
        band = bits - (probe == LOWER)
        alloc = {int(b): allocation(int(b), num, den) for b in np.unique(band[which])}
        of = np.zeros((65, 2), np.int64)
        for b, md in alloc.items():
            of[b] = md
        take = which[owner]
        u, v, doc = everything[take], weights[take], owner[take]
        seg = ((u >> np.uint64(32)) * of[band[doc], 0].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        head = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (doc[1:] != doc[:-1])]) if len(u) else np.zeros(0, np.int64)
        many = np.diff(np.r_[head, len(u)])
        total = np.add.reduceat(v, head) if len(u) else v
        d, at = doc[head], seg[head]
        salt = mix(at.astype(np.uint64) * _K[3] + band[d].astype(np.uint64) * _K[1])
        spare = at < of[band[d], 1]
        parts.append((d, mix(total ^ salt), np.where(spare, RESERVE, 0) | probe | (INDEX if probe == OWN else 0)))
        parts.append((d[spare], mix(total[spare] ^ salt[spare] ^ _K[4]), np.full(int(spare.sum()), RESERVE | probe)))  # found by those with one element more
        cell = np.repeat(np.arange(len(head)), many)
        one = np.repeat(spare & (many > 1), many)
        c = cell[one]
        parts.append((d[c], mix(total[c] - v[one] ^ salt[c]), np.full(len(c), RESERVE | probe)))  # finds those with one element less
        if probe == OWN:
            one = np.repeat(spare, many)
            c = cell[one]
            parts.append((d[c], mix(total[c] - v[one] ^ salt[c] ^ _K[4]), np.full(len(c), RESERVE | INDEX)))
        value = np.bincount(d, 1 + (spare & (many > 1)), len(us)).astype(np.int64)
        values.append(np.where(which, value, -1) if probe == LOWER else value)
    doc, h, x = (np.concatenate(c) for c in zip(*parts, strict=True))
    return doc, h, x, values[0], values[1]


def salted(h: np.ndarray, k: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (h, k, x) of one chunk's signatures; those of a signature beyond its first ``LOCAL`` have the chunk's
    number in the upper bits of x and mixed into h. The last of the first ones is there in both forms."""
    if len(h) <= LOCAL:
        return h, k, x
    line = np.sort(h)
    often = line[LOCAL:][line[LOCAL:] == line[:-LOCAL]]
    if not len(often):
        return h, k, x
    often = np.unique(often)
    mine = np.flatnonzero(often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h)
    mine = mine[np.lexsort(((x[mine] & INDEX) == 0, h[mine]))]  # those that others find come first
    head = np.flatnonzero(np.r_[True, h[mine][1:] != h[mine][:-1]])
    rank = np.arange(len(mine)) - np.repeat(head, np.diff(np.r_[head, len(mine)]))
    chunk = int(1 + (mix(k[:1].view(np.uint64))[0] & np.uint64((1 << 27) - 2)))
    far, ties = mine[rank >= LOCAL], mine[rank == LOCAL - 1]
    salt = chunk << 36 | chunk
    h, x = np.r_[h, h[ties] ^ salt], np.r_[x, x[ties] | LINK | chunk << 36]
    h[far] ^= salt
    x[far] |= chunk << 36
    return h, np.r_[k, k[ties]], x


def _rows(num: int, den: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        sigs: list[tuple] = []
        lone: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            parts = [salted(*(np.concatenate(c).astype(np.int64) for c in zip(*sigs, strict=True)))] if sigs else []
            h, k, x = (np.array(c, np.int64) for c in zip(*lone, strict=True))
            parts.append((h, k, x))
            sigs.clear()
            lone.clear()
            whole = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["h", "k", "x"])
            for at in range(0, whole.num_rows, 1 << 17):
                yield whole.slice(at, 1 << 17)

        for part in slices(batches, "text", 1 << 19):
            data, offs = utf8(part.column(1))
            low = _LOW[data].tobytes()
            new, us = [], []
            for i, (k, u) in enumerate(zip(part.column(0).to_pylist(), hashed(data, offs, words), strict=True)):
                n = len(u)
                same = hashlib.sha256(low[offs[i] : offs[i + 1]]).digest()
                was = seen.get(same)
                if n and was is not None:
                    lone.append((k, was, COPY | n << 8))
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[same] = k
                new.append(k)
                us.append(u)
            if not us:
                continue
            doc, h, x, own, lower = signatures(us, num, den)
            size = np.array([len(u) for u in us])
            sigs.append((h.view(np.int64), np.array(new, np.int64)[doc], x | size[doc] << 8))
            held += len(h)
            here = mix(np.array(new, np.int64).view(np.uint64)).view(np.int64)
            for told, flag in ((own, DOC), (lower + 1, LOW)):
                lone += zip(here.tolist(), new, (flag | size << 8 | told << 36).tolist(), strict=True)
            if held >= CHUNK:
                yield from flush()
                held = 0
        if lone:
            yield from flush()

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, k, x) in the order of h those that aren't met go: groups of one row, or without one that is found.

    What is held is a batch and the group that it ends in, which has at most LOCAL rows of a chunk."""
    held: list[np.ndarray] = []

    def work(rows: np.ndarray) -> pa.RecordBatch:
        h, x = rows[0], rows[2]
        head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        lone = (x & (COPY | DOC | LOW)) > 0
        many = np.add.reduceat((~lone).astype(np.int64), head)
        found = np.add.reduceat((~lone & ((x & INDEX) > 0)).astype(np.int64), head)
        keep = lone | (x >> 36 > 0) | np.repeat((many > 1) & (found > 0), np.diff(np.r_[head, len(h)]))
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in rows], ["h", "k", "x"])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.stack([c.to_numpy() for c in batch.columns])
        if held and held[-1][0, -1] != new[0, -1] or not held and new[0, 0] != new[0, -1]:
            cut = int(np.searchsorted(new[0], new[0, -1]))
            yield work(np.concatenate([*held, new[:, :cut]], axis=1))
            held = [new[:, cut:]]
        else:
            held.append(new)
    if held:
        yield work(np.concatenate(held, axis=1))


def verified(pairs: DataFrame, keyed: DataFrame, scratch: Scratch, num: int, den: int, words: int) -> DataFrame:
    """The pairs (a, b) whose sets of word tuples are similar enough."""
    pairs = scratch.write(pairs, "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    needed = F.broadcast(needed) if 2 * pairs.count() <= FEW_ROWS else needed
    texts = keyed.select("k", "text").join(needed, "k", "left_semi")
    b = pairs.join(texts.select(F.col("k").alias("b"), F.col("text").alias("tb")), "b")
    both = b.join(texts.select(F.col("k").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(slices([batch], "ta", 1 << 19), "tb", 1 << 19):
                of = part.column(0).to_numpy()
                heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                left = hashed(*utf8(part.column(2).take(pa.array(heads))), words)
                right = hashed(*utf8(part.column(3)), words)
                keep = []
                for i, (j, r) in enumerate(zip(np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(of)])).tolist(), right, strict=True)):
                    both = np.sort(np.concatenate([left[j], r]))
                    same = int(np.count_nonzero(both[1:] == both[:-1]))
                    spare = den * same - num * (len(both) - same)
                    if same and abs(spare) <= 2 * (den + num):  # near the threshold the words decide, elsewhere hashes can't err so far
                        x, y = (shingles(part.column(c)[i].as_py(), words) for c in (2, 3))
                        same = len(x & y)
                        spare = den * same - num * (len(x) + len(y) - same)
                    keep.append(same > 0 and spare >= 0)
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    out = scratch.write(both.mapInArrow(run, "a long, b long"), "links")
    scratch.drop(pairs)
    return out


def _flag(bit: int):
    return F.col("x").bitwiseAND(F.lit(bit)) != 0


SIZE = "shiftrightunsigned(x, 8) & 268435455L"


def across(seek: DataFrame, held: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``seek`` (on, c) and ``held`` (on, d) that share ``on`` and are of different components.

    Members are joined by pairs of components, so what is looked at is no more than what comes out."""
    meet = seek.select(*on, "c").distinct().join(held.select(*on, "d").distinct(), on).where("c <> d")
    return seek.join(meet, [*on, "c"]).join(held, [*on, "d"])


def links(keyed: DataFrame, scratch: Scratch, num: int = 75, den: int = 100, words: int = 5) -> tuple[DataFrame, DataFrame]:
    """((k, n) of every row, links (a, b) that connect all rows that are connected)."""
    if 2 * num < den:
        raise ValueError("a similarity of at least one half is needed")
    near = lambda a, b: F.greatest(a, b) * num <= F.least(a, b) * den
    apart = lambda total: F.floor(total * (den - num) / (den + num)).cast("long")  # noqa: E731  H
    value = F.when(_flag(RESERVE), 2).otherwise(1)
    # step 1
    made = keyed.select("k", "text").mapInArrow(_rows(num, den, words), "h long, k long, x long")
    lone, s = _flag(COPY | DOC | LOW), F.shiftrightunsigned("x", 36)
    met = made.repartition("h").sortWithinPartitions("h").mapInArrow(_met, "h long, k long, x long")
    sigs = scratch.write(met, "signatures")
    scratch.reclaim()
    n = F.expr(SIZE).alias("n")
    docs = sigs.where(_flag(DOC | LOW)).groupBy("k").agg(F.max(F.expr(SIZE)).alias("n"), F.max(F.when(_flag(DOC), s)).alias("own"), (F.max(F.when(_flag(LOW), s)) - 1).alias("lower"))
    docs = scratch.write(docs, "docs")
    small = docs.count() <= FEW_ROWS
    one = F.broadcast if small else lambda x: x  # tables with a row for each text at most
    copies = sigs.where(_flag(COPY)).select(F.col("h").alias("a"), F.col("k").alias("b"), n)
    salt = s.bitwiseXOR(F.shiftleft(s, 36))
    rows = sigs.where(~lone).select(F.col("h").alias("g"), "k", "x", n, F.when(s == 0, F.col("h")).otherwise(F.col("h").bitwiseXOR(salt)).alias("h"))
    # step 2
    told, label, late, at_first, turn = rows.withColumn("c", F.col("k")), None, None, 0, 0
    while True:
        turn += 1
        if turn % 2:  # each with the one that has most signatures of the group, which in a loose group is near to most
            score = told.groupBy("k").agg(F.count("*").alias("score"))
            ordered, other = told.join(one(score), "k"), F.first
            line = Window.partitionBy("g").orderBy(F.desc("score"), F.xxhash64("k")).rowsBetween(Window.unboundedPreceding, 0)
        else:  # neighbours in another order each time
            ordered, other = told, F.lag
            line = Window.partitionBy("g").orderBy(F.xxhash64("k", F.lit(turn)))
        chain = ordered.withColumns({"b": other("k").over(line), "d": other("c").over(line), "m": other("n").over(line)})
        chain = chain.where((F.col("d") != F.col("c")) & near(F.col("n"), F.col("m"))).groupBy(F.greatest("k", "b").alias("a"), F.least("k", "b").alias("b")).agg(F.count("*").alias("seen"), F.min(F.least("n", "m")).alias("n"))
        new = verified(chain.where("32 * seen >= n").select("a", "b"), keyed, scratch, num, den, words)
        count = new.count()
        if turn > 1 and count <= FEW * at_first:
            late = new
            break
        edges = new if label is None else new.unionByName(label.select(F.col("k").alias("a"), F.col("c").alias("b")))
        label = scratch.write(components(edges, scratch).select(F.col("node").alias("k"), F.col("component").alias("c")), "labels")
        was, now = told, (told.drop("c") if at_first else rows).join(bounded(label), "k", "left").withColumn("c", F.coalesce("c", "k"))
        mixed = now.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("h")
        told = scratch.write(now.join(mixed, "h", "left_semi"), "mixed")
        scratch.drop(was)
        scratch.reclaim()
        at_first = at_first or max(count, 1)
    # step 3: groups in which several components meet; ``told`` has no others
    told = told.where(~_flag(LINK))
    sizes = told.groupBy("h", "c").agg(F.count("*").cast("double").alias("g"))
    total = F.sum("g")
    priced = scratch.write(sizes.groupBy("h").agg(total.alias("g"), F.sum(F.col("g") * F.col("g")).alias("q")).select("h", (F.col("g") * F.col("g") - F.col("q") > HOT * F.col("g")).alias("hot"), (F.col("g") > SMALL).alias("big")), "priced")
    left = scratch.write(told.join(priced, "h"), "left")
    taken = lambda bit: F.sum(F.when(_flag(bit), value).otherwise(0))
    lost = left.where("hot").groupBy("k").agg(taken(OWN | INDEX).alias("lost_own"), taken(LOWER).alias("lost_lower"))
    room = docs.where("n > 0").join(one(lost), "k", "left").na.fill(0, ["lost_own", "lost_lower"])
    room = scratch.write(room.select("k", "n", (F.col("own") - F.col("lost_own")).alias("own"), F.when(F.col("lower") >= 0, F.col("lower") - F.col("lost_lower")).alias("lower")), "room")
    seek = left.where("NOT hot").where(_flag(OWN | LOWER)).select("h", "k", "n", "c", value.alias("v"), _flag(LOWER).alias("low"), "big")
    held = left.where("NOT hot").where(_flag(INDEX)).select("h", F.col("k").alias("b"), F.col("n").alias("m"), F.col("c").alias("d"), "big")
    few = seek.where("NOT big").drop("big").join(held.where("NOT big").drop("big"), "h").where("c <> d")
    met = few.unionByName(across(seek.where("big").drop("big"), held.where("big").drop("big"), ["h"])).where((F.col("m") <= F.col("n")) & near(F.col("n"), F.col("m")))
    found = met.groupBy("k", "b").agg(F.sum("v").alias("found"), F.max("low").alias("low"))
    # H differences take at most so many from the values of either set, so a similar pair keeps the rest
    found = found.join(one(room), "k").join(one(room.select(F.col("k").alias("b"), F.col("n").alias("m"), F.col("own").alias("other"))), "b")
    bar = F.greatest(F.when(F.col("low"), F.col("lower")).otherwise(F.col("own")), "other") - apart(F.col("n") + F.col("m"))
    second = verified(found.where(F.col("found") >= bar).select(F.greatest("k", "b").alias("a"), F.least("k", "b").alias("b")).distinct(), keyed, scratch, num, den, words)
    scratch.drop(left)
    scratch.reclaim()
    # step 4: as the larger one of a pair, and as the smaller one
    top = F.expr("shiftleft(1L, length(bin(n)) - 1) - 1")
    as_larger = (F.col("own") <= apart(2 * F.col("n"))) | F.coalesce(F.col("lower") <= apart(F.col("n") + top), F.lit(False))
    as_smaller = F.col("own") <= apart(F.col("n") + F.floor(F.col("n") * den / num))
    poor = room.select("k", "n", as_larger.alias("larger"), as_smaller.alias("smaller")).where("larger OR smaller")
    poor = scratch.write(poor.join(one(label), "k", "left").withColumn("c", F.coalesce("c", "k")), "poor")
    out = label.select(F.col("k").alias("a"), F.col("c").alias("b")).unionByName(late).unionByName(second).unionByName(copies.select("a", "b"))
    if poor.where("larger").limit(1).count():
        out = out.unionByName(rest(poor, keyed, scratch, num, den, words))
    return docs.select("k", "n").unionByName(copies.select(F.col("a").alias("k"), "n")), out


def _band(n: str) -> str:
    """SQL for the number of n's band of sizes, 64 for each bit length."""
    return f"(length(bin({n})) * 64 + shiftright(shiftleft({n}, 6), length(bin({n})) - 1) - 64)"


def _least(band: str) -> str:
    """SQL for the least size of a band."""
    return f"shiftright(shiftleft(64L + {band} % 64, CAST({band} DIV 64 - 1 AS INT)) + 63, 6)"


def rest(poor: DataFrame, keyed: DataFrame, scratch: Scratch, num: int, den: int, words: int) -> DataFrame:
    """Links between rows of ``poor`` (k, n, c, larger, smaller) of different components, the larger set marked
    ``larger`` and the smaller one ``smaller``."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 19):
            us = hashed(*utf8(part.column("text")), words)
            at = pa.array(np.repeat(np.arange(len(us)), [len(u) for u in us]))
            cols = [part.column(name).take(at) for name in ("k", "n", "c", "larger", "smaller")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(us).view(np.int64))], ["k", "n", "c", "larger", "smaller", "u"])

    rows = keyed.select("k", "text").join(bounded(poor), "k")
    rows = scratch.write(rows.mapInArrow(explode, "k long, n long, c long, larger boolean, smaller boolean, u long"), "shingles")
    spread = rows.groupBy("u", "c").agg(F.max("larger").alias("larger")).groupBy("u").agg(F.count("*").alias("f"), F.max("larger").alias("of")).where("f > 1 AND of").select("u", "f")
    # the place of a shingle among its set's, rarest first; those of one component come first and are left out
    own = Window.partitionBy("k")
    ranked = rows.join(spread, "u").withColumn("i", F.row_number().over(own.orderBy("f", "u")) - 1 + F.col("n") - F.count("*").over(own))
    least = lambda a, b: f"CAST(ceil({num} * ({a} + {b}) / {num + den}) AS BIGINT)"  # noqa: E731  the least overlap
    ranked = scratch.write(ranked, "ranked")
    seek = ranked.where("larger").where(F.expr(f"i <= n - {least('n', f'CAST(ceil({num} * n / {den}) AS BIGINT)')}")).withColumn("z", F.expr(_band("n"))).withColumn("y", F.expr(f"explode(sequence({_band(f'CAST(ceil({num} * n / {den}) AS BIGINT)')}, z))"))
    seek = seek.where(F.expr(f"i <= n - {least('n', f'greatest({_least('y')}, CAST(ceil({num} * n / {den}) AS BIGINT))')}")).select("u", "y", "z", "k", "n", "c", "i")
    held = ranked.where("smaller").where(F.expr(f"i <= n - {least('n', 'n')}")).withColumn("y", F.expr(_band("n"))).withColumn("z", F.expr(f"explode(sequence(y, {_band(f'CAST(floor({den} * n / {num}) AS BIGINT)')}))"))
    held = held.where(F.expr(f"i <= n - {least('n', f'greatest({_least('z')}, n)')}")).select("u", "y", "z", F.col("k").alias("b"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("i").alias("j"))
    seek, held = scratch.write(seek, "seek"), scratch.write(held, "held")
    o = F.expr(least("n", "m"))
    met = across(seek, held, ["u", "y", "z"]).where((F.col("m") <= F.col("n")) & (F.col("i") <= F.col("n") - o) & (F.col("j") <= F.col("m") - o) & (F.col("n") * num <= F.col("m") * den))
    pairs = met.groupBy(F.greatest("k", "b").alias("a"), F.least("k", "b").alias("b"), F.greatest("c", "d").alias("c"), F.least("c", "d").alias("d")).agg(F.count("*").alias("seen"))
    pairs = scratch.write(pairs, "met")
    # of two components the pair that shares most goes first; those that it joins need no more
    best = verified(pairs.groupBy("c", "d").agg(F.max_by(F.struct("a", "b"), F.struct("seen", "a", "b")).alias("p")).select("p.a", "p.b"), keyed, scratch, num, den, words)
    ends = best.join(pairs, ["a", "b"]).select(F.col("c").alias("a"), F.col("d").alias("b"))
    one = bounded(scratch.write(components(ends, scratch), "joined"))
    for end in ("c", "d"):
        pairs = pairs.join(one.select(F.col("node").alias(end), F.col("component").alias(f"{end}_")), end, "left").withColumn(end, F.coalesce(f"{end}_", end)).drop(f"{end}_")
    return best.unionByName(verified(pairs.where("c <> d").select("a", "b"), keyed, scratch, num, den, words))


def joined(docs: DataFrame, num: int = 75, den: int = 100, words: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """k, doc_id, n_shingles, component (the least k reachable), component_id (its doc_id) of every row."""
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    keyed, plain = order_key(docs, scratch)
    sizes, found = links(keyed, scratch, num, den, words)
    comp = bounded(scratch.write(components(found, scratch).withColumnRenamed("node", "k"), "components"))
    out = sizes.join(comp, "k", "left").select("k", F.col("n").alias("n_shingles"), F.coalesce("component", "k").alias("component"))
    if plain:
        return out.select("k", F.col("k").alias("doc_id"), "n_shingles", "component", F.col("component").alias("component_id"))
    ids = keyed.select("k", "doc_id")
    return out.join(ids, "k").join(ids.select(F.col("k").alias("component"), F.col("doc_id").alias("component_id")), "component").select("k", "doc_id", "n_shingles", "component", "component_id")


def kept(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, of each component the first row (the least doc_id; null ids last)."""
    scratch = Scratch(docs.sparkSession, "kept")
    n, ids = docs.agg(F.count("*"), F.count("doc_id")).first()
    if n == ids and not docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        gone = joined(docs, scratch=scratch).where("component <> k").select("doc_id")
        return docs.join(bounded(scratch.write(gone, "gone")), "doc_id", "left_anti").select(*docs.columns)
    # rows without an id of their own are numbered first, in the order of (doc_id, text)
    order = [F.col("doc_id").asc_nulls_last(), F.sha2(F.coalesce("text", F.lit("")), 256)]
    n = fits(docs.columns, "_n")
    rows = scratch.write(docs.orderBy(*order).withColumn(n, F.monotonically_increasing_id()), "numbered")
    gone = joined(rows.select(F.col(n).alias("doc_id"), "text"), scratch=scratch).where("component <> k").select(F.col("doc_id").alias(n))
    return rows.join(bounded(scratch.write(gone, "gone")), n, "left_anti").select(*docs.columns)


def op4_partition_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over whole ``documents``."""
    return joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
