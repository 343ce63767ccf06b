"""Op 2, suffix-array deduplication by common-prefix intervals.

A string of ``least`` bytes that repeats has the same smallest hash of its ``GRAM``-byte grams wherever
it stands. So every start of such a window belongs to one anchor, windows that are equal meet under
equal anchors, and only anchors that occur twice are followed further:

1. each text's anchors (hash, first start, number of starts) come from one pass over its bytes;
2. anchors seen once are dropped in a stream sorted by their hashes;
3. the context of each other anchor (all its windows) is cut from the text; contexts that the same
   task has met at an earlier place are settled at once, as copies, so that a text or passage in very
   many documents leaves a task once and not as often as it occurs;
4. contexts with equal anchors meet in one task. It sorts their suffixes, computes the common prefixes
   of neighbours and scans them with a stack into common-prefix intervals of at least ``least`` bytes.
   Intervals whose occurrences all have the same byte before them are passed over (a longer repeat
   holds them); each other one is a maximal repeat with all its occurrences.

``maximal_repeats`` gives these groups: in each interval the occurrences directly in it and the first
of each interval inside it, with the enclosing interval named, so that all occurrences of a group are
those of its subtree and the output stays in proportion to the input.

Order is (doc_id, start); rows with equal doc_id are ordered by the SHA-256 of their text, null ids
come last. Null and empty texts have no bytes. Texts of any length are cut into overlapping parts
for the first step only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix, order_key, rolling, table, utf8

GRAM, PART, PLACE = 24, 1 << 20, 22
#: Rows of one anchor from one part that are counted; others are known to repeat.
LOCAL, KNOWN = 8, 1 << 15
#: Contexts that a task of step 3 remembers; more only means that later copies are settled in step 4.
REMEMBERED = 150_000
GROUP_BYTES = 1 << 20


def anchors(data: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start in it, number of starts, hash) of each anchor of texts given back to back."""
    n, wide = len(data), least - GRAM + 1
    if n >= 1 << PLACE:
        raise ValueError("a part is too long")
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none, none.astype(np.uint64)
    h = rolling(data, GRAM)
    bits = np.uint64(PLACE)  # the same for every batch, so that equal windows have equal anchors
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    m = n - least + 1
    pad = -len(key) % wide
    grid = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, wide)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:m], ahead[wide - 1 : wide - 1 + m]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:m]
    good = np.arange(m) + least <= offs[1:][text]
    new = good.copy()
    new[1:] &= ~good[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return none, none, none, none.astype(np.uint64)
    total = np.r_[0, np.cumsum(good)]
    count = total[np.r_[first[1:], m]] - total[first]
    return text[first], first - offs[text[first]], count, h[at[first]]


def _scan(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(k, x, h) of all anchors, x = start << 16 | number of starts, h of 48 bits (equal hashes only lead
    to a comparison of bytes); texts are packed into parts of about PART bytes, longer ones cut. Beyond the
    first ``LOCAL`` rows of an anchor in a part x is marked ``KNOWN`` and h mixed with k, so they spread."""

    def flush(parts: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        offs = np.cumsum([0, *(len(p[2]) for p in parts)])
        text, s, c, h = anchors(np.concatenate([p[2] for p in parts]), offs, least)
        k, base = np.array([p[0] for p in parts], np.int64)[text], np.array([p[1] for p in parts], np.int64)[text]
        h, x = (h >> np.uint64(16)).view(np.int64), (s + base) << 16 | c
        order = np.argsort(h, kind="stable")
        head = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, np.int64)
        far = order[np.arange(len(h)) - np.repeat(head, np.diff(np.r_[head, len(h)])) >= LOCAL]
        x[far] |= KNOWN
        h[far] ^= spread(k[far])
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(x), pa.array(h)], ["k", "x", "h"])

    held: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for batch in batches:
        data, offs = utf8(batch.column(1))
        for i, k in enumerate(batch.column(0).to_numpy(zero_copy_only=False)):
            at, end = int(offs[i]), int(offs[i + 1])
            while end - at >= least:
                to = min(end, at + PART)
                held.append((int(k), at - int(offs[i]), data[at:to]))
                size += to - at
                if size >= PART:
                    yield flush(held)
                    held, size = [], 0
                if to == end:
                    break
                at = to - least + 1
    if held:
        yield flush(held)


def spread(k: np.ndarray) -> np.ndarray:
    """48 bits of each k."""
    return (mix(k.view(np.uint64)) >> np.uint64(16)).view(np.int64)


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (k, x, h) in the order of h those whose h comes once go, unless they are known to repeat. A batch is held."""
    last, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.stack([c.to_numpy() for c in batch.columns])
        rows = new if held is None else np.concatenate([held, new], axis=1)
        h = rows[2]
        keep = (rows[1] & KNOWN) > 0
        same = h[1:] == h[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= last == h[0]
        keep = keep[:-1]  # the last row waits for the next batch
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep]) for c in rows], ["k", "x", "h"])
        last, held = (h[-2] if len(h) > 1 else last), rows[:, -1:]
    if held is not None:
        keep = np.array([bool(held[1, 0] & KNOWN) or last == held[2, 0]])
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in held], ["k", "x", "h"])


def _contexts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """From (k, text, anchors): contexts (h, k, s, ctx), or, for a copy of an earlier context met here, e (its end) and the earlier place."""
    seen: dict[bytes, tuple[int, int]] = {}
    for batch in batches:
        data, offs = utf8(batch.column(1))
        raw = data.tobytes()
        lists = batch.column(2)
        lo = lists.offsets.to_numpy()
        item = lists.values
        x_all, h_all = (item.field(f).to_numpy() for f in range(2))
        s_all, c_all = x_all >> 16, x_all & (KNOWN - 1)
        owner = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(lo))
        first = lo[0]
        x_all, h_all, s_all, c_all = (v[first : lo[-1]] for v in (x_all, h_all, s_all, c_all))
        lo = lo - first
        h_all = np.where(x_all & KNOWN, h_all ^ spread(owner), h_all)
        for i, k in enumerate(batch.column(0).to_pylist()):
            own = slice(lo[i], lo[i + 1])
            order = np.argsort(s_all[own], kind="stable")
            ss, cs, hs = s_all[own][order].tolist(), c_all[own][order].tolist(), h_all[own][order].tolist()
            base, out = int(offs[i]), ([], [], [], [], [], [], [])
            for s, c, h in zip(ss, cs, hs, strict=True):
                ctx = raw[base + s : base + s + c + least - 1]
                was = seen.get(ctx)
                if was is not None and was < (k, s):
                    row = (h, k, s, None, s + len(ctx), *was)
                else:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[ctx] = (k, s)
                    row = (h, k, s, ctx, None, None, None)
                for col, x in zip(out, row, strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["h", "k", "s", "ctx", "e", "of_k", "of_s"])


def suffix_order(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, rank: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes buf[start:end] sorted, ties by rank; lcp[i] is shared by order[i - 1] and order[i]."""
    padded = np.concatenate([buf, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[starts].copy()
    long = ends - starts
    rows[np.arange(width)[None, :] >= long[:, None]] = 0
    by_rank = np.argsort(rank, kind="stable")
    order = by_rank[np.argsort(rows[by_rank].view(f"S{width}").ravel(), kind="stable")]
    rows = rows[order]
    differ = rows[1:] != rows[:-1]
    same = np.where(differ.any(1), differ.argmax(1), width)
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = np.minimum(same, np.minimum(long[order][1:], long[order][:-1]))
    return order, lcp


def intervals(lcp: np.ndarray, diverse: np.ndarray, least: int) -> list[tuple[int, int, int, int, bool, list[int]]]:
    """Common-prefix intervals of at least ``least``: (first, last, length, parent, left-diverse, members).

    diverse[i] tells whether the bytes before the suffixes of ranks i - 1 and i differ. Members are
    ranks directly in the interval, and one rank list entry -(index + 1) for each interval inside it."""
    total = np.cumsum(diverse)
    out: list[list] = []
    stack: list[list] = []  # [length, first, members]

    def close(length: int, first: int, last: int, members: list[int]) -> int:
        out.append([first, last, length, -1, bool(total[last] - total[first]), members])
        for m in members:
            if m < 0:
                out[-m - 1][3] = len(out) - 1
        return len(out) - 1

    hot = np.flatnonzero(lcp >= least)
    if not len(hot):
        return []
    runs = np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1)
    for run in runs:  # ranks run[0] - 1 .. run[-1] are linked by common prefixes
        begin = int(run[0]) - 1
        stack = [[0, begin, []]]
        last_leaf: int | None = begin
        for i in range(begin + 1, int(run[-1]) + 2):
            now = int(lcp[i]) if i <= int(run[-1]) else 0
            first, carried = i - 1, last_leaf
            top = stack[-1]
            while now < top[0]:
                if carried is not None:
                    top[2].append(carried)
                stack.pop()
                carried = -(close(top[0], top[1], i - 1, top[2]) + 1)
                first, top = top[1], stack[-1]
            if now > top[0]:
                stack.append([now, first, [carried]])
            elif now:
                top[2].append(carried)
            last_leaf = i
    return [tuple(x) for x in out]


def _groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """From contexts sorted by h: the occurrences of maximal repeats."""
    names = ["h", "gid", "parent", "k", "s", "e", "first", "of_s"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def work(held: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        """Whole groups of equal h; equal contexts are settled first, the rest by their suffixes."""
        rows: list[tuple] = []
        first: dict[tuple[int, bytes], tuple[int, int]] = {}
        for h, k, s, ctx in held:
            was = first.get((h, ctx))
            if was is None or (k, s) < was:
                first[h, ctx] = (k, s)
        sizes: dict[int, int] = {}
        for h, _ in first:
            sizes[h] = sizes.get(h, 0) + 1
        for h, k, s, ctx in held:
            if first[h, ctx] != (k, s):
                rows.append((h, -1, first[h, ctx][0], k, s, s + len(ctx), False, first[h, ctx][1]))
        left = [(h, k, s, ctx) for (h, ctx), (k, s) in first.items() if sizes[h] > 1]
        at = 0
        while at < len(left):  # groups stay whole; a piece has about GROUP_BYTES bytes
            to, size = at, 0
            while to < len(left) and (size < GROUP_BYTES or left[to][0] == left[to - 1][0]):
                size += len(left[to][3])
                to += 1
            rows += suffixes(left[at:to])
            at = to
        if rows:
            yield made(rows)

    def suffixes(part: list[tuple[int, int, int, bytes]]) -> list[tuple]:
        size = np.array([len(x[3]) for x in part])
        begin = np.r_[0, np.cumsum(size)[:-1]]
        buf = np.frombuffer(b"".join(x[3] for x in part), np.uint8)
        many = size - least + 1
        row = np.repeat(np.arange(len(part)), many)
        step = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many)
        start = begin[row] + step
        # a window that occurs once is in no interval
        h = rolling(buf, least)[start]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        again = np.zeros(len(h), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        row, step, start = row[again], step[again], start[again]
        if not len(start):
            return []
        k, s0 = np.array([x[1] for x in part]), np.array([x[2] for x in part])
        rank = np.empty(len(start), np.int64)
        rank[np.lexsort((s0[row] + step, k[row]))] = np.arange(len(start))
        end = (begin + size)[row]
        order, lcp = suffix_order(buf, start, end, rank, int(size.max()))
        row, step, start, rank = row[order], step[order], start[order], rank[order]
        before = np.where(step > 0, buf[np.maximum(start - 1, 0)].astype(np.int64), -1)
        diverse = np.ones(len(start), bool)
        diverse[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
        found = intervals(lcp, diverse, least)
        out, lowest = [], [0] * len(found)
        hs, ks, ss = [part[r][0] for r in row.tolist()], k[row].tolist(), (s0[row] + step).tolist()
        rk = rank.tolist()
        for g, (_, _, length, parent, wide, members) in enumerate(found):
            ranks = [lowest[-m - 1] if m < 0 else m for m in members]
            least_one = min(ranks, key=rk.__getitem__)
            lowest[g] = least_one
            if wide:
                out += [(hs[i], g, parent, ks[i], ss[i], ss[i] + length, i == least_one, None) for i in ranks]
        return out

    held: list[tuple[int, int, int, bytes]] = []
    size = 0
    for batch in batches:
        copies = batch.filter(pc.is_null(batch.column(3)))
        if copies.num_rows:
            n = copies.num_rows
            yield pa.RecordBatch.from_arrays([copies.column(0), pa.array(np.full(n, -1)), copies.column(5), copies.column(1), copies.column(2), copies.column(4), pa.array(np.zeros(n, bool)), copies.column(6)], names)
        fresh = batch.filter(pc.is_valid(batch.column(3)))
        for h, k, s, ctx in zip(*(fresh.column(i).to_pylist() for i in range(4)), strict=True):
            if size >= 4 * GROUP_BYTES and h != held[-1][0]:
                yield from work(held)
                held, size = [], 0
            held.append((h, k, s, ctx))
            size += len(ctx) + 100
    if held:
        yield from work(held)


def maximal_repeats(keyed: DataFrame, scratch: Scratch, least: int = 100) -> DataFrame:
    """Occurrences of maximal repeats of ``keyed`` (k, text): h and gid name the group within one
    task's output, parent the enclosing group, k, s, e the place, first whether it is the earliest.
    Copies of a whole context have gid -1 and the place of the earlier one in ``parent`` (k) and ``of_s``; they occur
    wherever groups of that place do. Groups are maximal within the context of an anchor (up to 2 * least -
    GRAM bytes): a longer repeat comes as groups that overlap, one for each anchor in it."""
    if not GRAM <= least < 1 << 16:
        raise ValueError(f"least is from {GRAM} to 65535 bytes")
    found = keyed.select("k", "text").mapInArrow(lambda b: _scan(b, least), "k long, x long, h long")
    # a stream in the order of the hashes, with at most LOCAL rows of an anchor from a part; written, so that the
    # shuffle of all anchors needn't be kept beside those of the texts and contexts
    twice = scratch.write(found.repartition("h").sortWithinPartitions("h").mapInArrow(_twice, "k long, x long, h long"), "anchors")
    scratch.reclaim()
    lists = twice.groupBy("k").agg(F.collect_list(F.struct("x", "h")).alias("a"))
    cut = keyed.join(lists, "k").select("k", "text", "a").mapInArrow(lambda b: _contexts(b, least), "h long, k long, s long, ctx binary, e long, of_k long, of_s long")
    # copies are settled and only pass, so they are dealt by their place
    dealt = cut.repartition(F.when(F.col("ctx").isNull(), F.xxhash64("k", "s")).otherwise(F.col("h"))).sortWithinPartitions("h")
    return dealt.mapInArrow(lambda b: _groups(b, least), "h long, gid long, parent long, k long, s long, e long, first boolean, of_s long")


def cut_repeats(docs: DataFrame, least: int = 100, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes, if asked) of every row."""
    scratch = Scratch(docs.sparkSession, "repeats")
    keyed, plain = order_key(docs, scratch)
    if plain:
        keyed = keyed.select("k", "text")
    # with the same columns and filter in both joins the texts are dealt out once
    keyed = keyed.where("k IS NOT NULL")
    spans = maximal_repeats(keyed, scratch, least).where("NOT first").groupBy("k").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    rows = keyed.join(spans, "k", "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offs = utf8(batch.column(1))
            raw = memoryview(data.tobytes())
            out = []
            lists = batch.column(2)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                text = raw[offs[i] : offs[i + 1]]
                got = lists[i].as_py() if lists[i].is_valid else []
                sha, at, gone, n, left = hashlib.sha256(), 0, 0, 0, []
                for a, b in sorted((x["s"], x["e"]) for x in got):
                    if a > at or n == 0:
                        sha.update(text[at:a])
                        if keep_text:
                            left.append(bytes(text[at:a]))
                        n, gone, at = n + 1, gone + b - a, b
                    elif b > at:
                        gone, at = gone + b - at, b
                sha.update(text[at:])
                out.append((doc, len(text), gone, n, sha.hexdigest(), *([b"".join([*left, bytes(text[at:])])] if keep_text else [])))
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds)])

    return rows.select(F.col("k" if plain else "doc_id").alias("doc_id"), "text", "spans").mapInArrow(cut, schema)


def op2_repeat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over whole ``documents``."""
    return cut_repeats(table(spark, sf_dir, "documents"))
