"""Op 9, best-fit packing improved by swap-based local search.

Texts become ids by the shared encoder, then the end id; longer documents are cut from their end
into pieces of the full capacity, so only the first piece may be shorter. Full pieces are sequences
of their own. The rest is dealt into blocks by a hash; a task packs its block by best fit in order
of falling length and then improves the underfull bins: it moves a document, exchanges one for one
or two for one whenever that raises the sum of squared fills, until a bin runs empty or nothing helps.
Bins that stay underfull give their documents to a second round over larger blocks.

With an order given, a task takes a stretch of consecutive pieces in windows: it packs a window and
what earlier ones left, and sets aside the full bins. Of what is left at most four windows are
carried on; the rest goes to the second round. A sequence has the number of its middle piece in the order, so a
prefix of the sequences holds about a prefix of the order.

Null text counts as empty (the end id alone). Repeated rows are packed as often as they occur. Empty
tables give empty results. Ties are settled by (length, doc_id, piece, checksum), so a lost task
that is run again packs the same.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .tokens import encoder, vocabulary_path

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, order: str | None = None) -> DataFrame:
    """A row for each piece of each document, with its document's ``order`` as position; one pass, no shuffle."""
    make = encoder(docs.sparkSession, path)
    end, width = end_id.to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = make()
        for batch in batches:
            out: list[tuple] = []
            for doc, text, *place in zip(batch.column(0).to_pylist(), batch.column(1), *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                ids = enc.encode(text.as_py()) + end
                first = len(ids) % width or width
                for piece, at in enumerate([0, *range(first, len(ids), width)]):
                    part = ids[at : first if not at else at + width]
                    out.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), *place))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()][: 5 if order is None else 6]
            cols = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "position"][: len(kinds)])

    place = [] if order is None else [F.col(order).cast("long").alias("position")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *place).mapInArrow(cut, PIECE if order is None else PIECE + ", position long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: the longest first, each into the fullest bin that has room."""
    room: list[int] = []  # sorted distinct rooms
    by: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        at = bisect_left(room, n)
        if at < len(room):
            r = room[at]
            b = by[r].pop()
            if not by[r]:
                del by[r]
                room.pop(at)
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := r - n:
            if left not in by:
                by[left] = []
                insort(room, left)
            by[left].append(b)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, rounds: int = 40) -> list[list[int]]:
    """Empties underfull bins into the others by moves and exchanges that raise the squared fill.

    The emptiest bin is the donor. For each of its documents, longest first: move it to the fullest
    bin that has room; else exchange it for a shorter one (one for one) or two (two for one) of a bin
    that thereby becomes fuller, so that the donor gets emptier. A donor that nothing helps is set
    aside. A change always takes from the emptier and adds to the fuller bin, which raises the sum of
    squares; so the search ends."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    todo = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: fill[b])
    open_ = set(todo)
    least = -(-sum(fill) // capacity)  # no packing has fewer bins
    used, tries = len(bins), 0
    for donor in todo:
        # as many donors as the free room could ever absorb, and as many again that may fail
        if used <= least or tries > 2 * (used - least) + 8:
            break
        if donor not in open_ or not bins[donor]:
            continue
        tries += 1
        for _ in range(rounds):
            if not bins[donor]:
                break
            best = None  # (gain, kind, target, doc, others)
            others = sorted((b for b in open_ if b != donor and fill[b] >= fill[donor]), key=lambda b: -fill[b])[:512]
            for i in sorted(bins[donor], key=lambda i: -lengths[i]):
                n = lengths[i]
                for b in others:
                    gap = capacity - fill[b]
                    if n <= gap:
                        gain = n * (fill[b] - fill[donor] + n)
                        if best is None or gain > best[0]:
                            best = (gain, b, i, ())
                        continue
                    need = n - gap  # what must leave b at least; less than n
                    inside = sorted(bins[b], key=lambda j: lengths[j])
                    at = bisect_left([lengths[j] for j in inside], need)
                    out = (inside[at],) if at < len(inside) and lengths[inside[at]] < n else ()
                    if not out and len(inside) > 1:
                        lo, hi = 0, len(inside) - 1
                        while lo < hi:
                            s = lengths[inside[lo]] + lengths[inside[hi]]
                            if need <= s < n:
                                out = (inside[lo], inside[hi])
                                break
                            lo, hi = (lo + 1, hi) if s < need else (lo, hi - 1)
                    if out:
                        d = n - sum(lengths[j] for j in out)
                        gain = d * (fill[b] - fill[donor] + d)
                        if best is None or gain > best[0]:
                            best = (gain, b, i, out)
                if best is not None:
                    break
            if best is None:
                break
            _, b, i, out = best
            bins[donor].remove(i)
            bins[b].append(i)
            for j in out:
                bins[b].remove(j)
                bins[donor].append(j)
            d = lengths[i] - sum(lengths[j] for j in out)
            fill[donor] -= d
            fill[b] += d
            if fill[b] == capacity:
                open_.discard(b)
        if not bins[donor]:
            open_.discard(donor)
            used -= 1
    return [b for b in bins if b]


def in_windows(lengths: list[int], capacity: int, window: int) -> tuple[list[list[int]], list[list[int]]]:
    """Full bins, of pieces that lie near each other, and what can't be made full, as bins."""
    full: list[list[int]] = []
    late: list[int] = []
    pool: list[int] = []

    def packed(pool: list[int]) -> list[list[int]]:
        own = [lengths[i] for i in pool]
        return [[pool[i] for i in b] for b in local_search(best_fit(own, capacity), own, capacity)]

    for at in range(0, len(lengths), window):
        left = []
        for b in packed([*pool, *range(at, min(at + window, len(lengths)))]):
            if sum(lengths[i] for i in b) == capacity:
                full.append(b)
            else:
                left += b
        left.sort()
        spare = max(0, len(left) - 4 * window)
        late += left[:spare]
        pool = left[spare:]
    return full, packed(sorted(late + pool))


def _ordered(capacity: int, window: int | None, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).sort_by("rank")
        lengths, ranks = whole["length"].to_pylist(), whole["rank"].to_numpy()
        full, rest = in_windows(lengths, capacity, window or len(lengths))
        seq, off = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
        for b in full + rest if last else full:
            b.sort()
            at, number = 0, ranks[b[len(b) // 2]]
            for i in b:
                seq[i], off[i] = number, at
                at += lengths[i]
        yield from whole.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off)).combine_chunks().to_batches()

    return run


def _packer(capacity: int, step: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("block", "length", "doc_id", "piece", "ids_crc32", "start")])
        blocks = whole["block"].to_numpy()
        edges = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1], True])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            part = whole.slice(lo, hi - lo).drop_columns(["block"])
            lengths = part["length"].to_pylist()
            bins = local_search(best_fit(lengths, capacity), lengths, capacity)
            seq, off = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
            base = ((step << 40) | int(blocks[lo])) << 20
            for n, b in enumerate(bins):
                at = 0
                for i in b:
                    seq[i], off[i] = base + n, at
                    at += lengths[i]
                if at < capacity and not last:
                    seq[b] = -1
            yield from part.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off)).combine_chunks().to_batches()

    return run


def pack(parts: DataFrame, capacity: int = 2048, block_rows: int = 40_000, scratch: Scratch | None = None) -> DataFrame:
    """``parts`` (PIECE, a written table) with sequence_id and offset.

    block_rows bounds what a task holds: a block has about so many pieces, however many there are."""
    spark = parts.sparkSession
    scratch = scratch or Scratch(spark, "pack")
    full = parts.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    short = parts.where(F.col("length") < capacity)
    out = PIECE + ", sequence_id long, offset long"

    def deal(df: DataFrame, step: int, last: bool) -> DataFrame:
        n = max(1, -(-df.count() // block_rows))
        # by the place in the written table, so that rows alike don't meet in one block
        dealt = df.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(step)), F.lit(n)))
        return dealt.repartition(n, "block").mapInArrow(_packer(capacity, step, last), out)

    first = scratch.write(deal(short, 1, False), "first")
    again = deal(first.where("sequence_id = -1").drop("sequence_id", "offset"), 2, True)
    return full.unionByName(first.where("sequence_id <> -1")).unionByName(again)


def pack_ordered(parts: DataFrame, capacity: int = 2048, block_rows: int = 40_000, window_rows: int = 500, scratch: Scratch | None = None) -> DataFrame:
    """``parts`` (PIECE and position) with sequence_id and offset; sequence_id follows the order of (position, piece).

    A task holds about block_rows pieces and packs window_rows and what is left of earlier ones at a time."""
    scratch = scratch or Scratch(parts.sparkSession, "pack")
    out = PIECE + ", rank long, sequence_id long, offset long"

    def some(df: DataFrame) -> int:
        return max(1, -(-df.count() // block_rows))

    by = ["position", "piece", "doc_id", "start"]
    sorted_ = parts.repartitionByRange(some(parts), *by).sortWithinPartitions(*by)
    ranked = scratch.write(sorted_.withColumn("rank", F.monotonically_increasing_id()).drop("position"), "ranked")
    full = ranked.where(F.col("length") == capacity).withColumn("sequence_id", F.col("rank")).withColumn("offset", F.lit(0).cast("long"))
    short = ranked.where(F.col("length") < capacity)
    first = scratch.write(short.repartitionByRange(some(short), "rank").mapInArrow(_ordered(capacity, window_rows, False), out), "first")
    rest = first.where("sequence_id = -1").drop("sequence_id", "offset")
    again = rest.repartitionByRange(some(rest), "rank").mapInArrow(_ordered(capacity, None, True), out)
    return full.unionByName(first.where("sequence_id <> -1")).unionByName(again).drop("rank")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, order: str | None = None) -> DataFrame:
    """order: a whole number for each document, whose order the sequences follow."""
    scratch = Scratch(docs.sparkSession, "pack")
    parts = scratch.write(pieces(docs, path, capacity, end_id, order), "pieces")
    return pack(parts, capacity, scratch=scratch) if order is None else pack_ordered(parts, capacity, scratch=scratch)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over whole ``documents``."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())
