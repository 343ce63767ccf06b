"""Op 7, mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of a keyed hash, are cut into blocks; each slot takes a block.
The target is a fluid: every source that has blocks left gets its weight over the weights of all
that have. With w a source's weight and n its blocks, the fluid has served t(v) = sum of min(n, w v)
slots when a source has had w v of its blocks; so block j (from 1) is released at slot
floor(t((j - 1) / w)) and due at ceil(t(j / w)), in whole numbers. In each slot the released block of
earliest deadline runs. The fluid itself runs every block between release and deadline and fills
every slot, so every deadline is met and no slot is idle: at every slot of the whole run a source is
less than one block off its target, however many sources there are, also when others have run out.
Every document is placed once; none is dropped or repeated.

The driver passes over all blocks once and holds 8 bytes for each. A block has ``block_docs`` documents, or
as many more as it takes to keep the blocks to ``most_blocks``, so this is bounded at any size, as is the
number of sources (``most_sources``). Null sources are a source of their own; null ids come last; repeated
rows each get a place; empty tables give empty results. A weight is a positive finite number (every
document is placed, so none can be 0); others are refused.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections.abc import Mapping
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fits, table

NONE = "\x00null"


#: The weights as whole numbers have about this sum; they are right to one part in it.
WHOLE = 1 << 62


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> dict[str, array]:
    """The slot of each block of each source."""
    total = sum(weights[s] for s, n in blocks.items() if n)
    w = {s: max(1, round(weights[s] / total * WHOLE)) for s, n in blocks.items() if n}
    # in the order in which the fluid empties them: what all before have had, and the weight that is left
    ends = sorted(w, key=lambda s: (blocks[s] * WHOLE // w[s], s))
    last = [blocks[s] * WHOLE // w[s] for s in ends]
    had = [0, *accumulate(blocks[s] for s in ends)]
    rest = [*accumulate((w[s] for s in reversed(ends)), initial=0)][::-1]

    def at(s: str, j: int) -> tuple[int, int]:
        """The fluid's slot when ``s`` has had j blocks, rounded down and up."""
        i = bisect_left(last, j * WHOLE // w[s])
        up = had[i] * w[s] + j * rest[i]
        return up // w[s], -(-up // w[s])

    waiting = [(0, s) for s in sorted(w)]  # (release, source)
    ready: list[tuple[int, str]] = []  # (deadline, source)
    out = {s: array("q") for s in w}
    for slot in range(had[-1]):
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (at(s, len(out[s]) + 1)[1], s))
        due, s = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError("a deadline was missed")
        out[s].append(slot)
        if len(out[s]) < blocks[s]:
            heapq.heappush(waiting, (at(s, len(out[s]))[0], s))
    return out


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.7, block_docs: int = 8, seed: int = 0, most_sources: int = 10_000, most_blocks: int = 4_000_000, scratch: Scratch | None = None) -> DataFrame:
    """All columns of ``docs`` with mix_block (in its source, from 0), mix_slot and mix_position (a
    number that orders all rows); underscores come in front where a name is taken.

    weights: target weight by source; None stands for counts to the power ``temperature``. Sources
    that ``weights`` doesn't name get the least weight given."""
    spark, scratch = docs.sparkSession, scratch or Scratch(docs.sparkSession, "pfair")
    names = docs.columns
    n_block, n_slot, n_pos = (fits(names, c) for c in ("mix_block", "mix_slot", "mix_position"))
    src, rnd, part, row, size, head, ahead, slots = (fits(names, f"_mix_{c}") for c in "src rnd part row size head ahead slots".split())
    keyed = docs.withColumn(src, F.coalesce(F.col("source").cast("string"), F.lit(NONE))).withColumn(rnd, F.xxhash64(F.lit(seed), "doc_id", "source"))
    # sorted by (source, hash, id) over many partitions, so a hot source is spread; the place in a
    # source is the place in a partition plus what earlier partitions hold of that source
    dealt = keyed.repartitionByRange(F.col(src), F.col(rnd), F.col("doc_id")).sortWithinPartitions(src, rnd, "doc_id")
    dealt = scratch.write(dealt.withColumn(row, F.monotonically_increasing_id()), "dealt").withColumn(part, F.shiftright(row, 33))
    per = dealt.groupBy(src, part).agg(F.count("*").alias(size), F.min(row).alias(head))
    counts = {r[0]: r[1] for r in dealt.groupBy(src).count().orderBy(src).limit(most_sources + 1).collect()}
    if len(counts) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    if weights is None:
        weights = {s: n**temperature for s, n in counts.items()}
    if bad := [s for s, w in weights.items() if not 0 < w < math.inf]:
        raise ValueError(f"the weight of {bad[0]} isn't a positive number")
    least = min(weights.values(), default=1.0)
    given = {s: float(weights.get(s, least)) for s in counts}
    block_docs = max(block_docs, -(-sum(counts.values()) // most_blocks))
    slot = schedule({s: -(-n // block_docs) for s, n in counts.items()}, given)
    # a row for each source and partition that has it (no more than both together): how many rows come
    # in earlier partitions, and the slots of the blocks that it touches
    rows, at = [], dict.fromkeys(counts, 0)
    for s, p, n, first in sorted(per.collect(), key=lambda r: (r[0], r[1])):
        rows.append((s, p, first, at[s], slot[s][at[s] // block_docs : (at[s] + n - 1) // block_docs + 1]))
        at[s] += n
    kinds = pa.schema([(src, pa.string()), (part, pa.int64()), (head, pa.int64()), (ahead, pa.int64()), (slots, pa.list_(pa.int64()))])
    local = pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)
    # a number for each block and few for each row, so some 40 MB at most_blocks
    sched = F.broadcast(scratch.write(spark.createDataFrame(local), "slots"))
    placed = dealt.join(sched, [src, part])
    placed = placed.withColumn(row, F.col(row) - F.col(head) + F.col(ahead)).withColumn(n_block, F.floor(F.col(row) / block_docs))
    out = placed.withColumn(n_slot, F.element_at(slots, (F.col(n_block) - F.floor(F.col(ahead) / block_docs) + 1).cast("int")))
    out = out.withColumn(n_pos, F.col(n_slot) * block_docs + F.col(row) % block_docs)
    return out.select(*names, n_block, n_slot, n_pos)


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source and the places of every row of whole ``documents``."""
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))
