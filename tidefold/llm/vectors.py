"""Op 6, near-duplicate embeddings by a robust-pruned flat graph on overlapping cluster shards.

Equal vectors of a label are one node. Each label starts as a shard; a shard above ``shard_rows`` nodes
is split by k-means centres fitted on a bounded sample of it (``sample_rows`` by a hash), level by
level, and a node goes to every centre not much farther than its nearest (by the chord of the
threshold, ``overlap`` centres at most), so shards overlap. Centres within range of each other count as
one, so a dense ball isn't cut; what is one ball alone is dealt into blocks, and every two blocks become a shard. In a shard each node's nearest
candidates, and a few taken at random, which keep the graph in one piece, are pruned robustly (a candidate
goes if a kept neighbour is nearer to it by ``ALPHA``). The adjacency lists of all shards are united. Then
each node is searched for by greedy beam search from its shard's medoid over the united lists, in both
directions, as far as both ends are in the shard; once in range the search widens over all nodes within
range until none is new. Finds are verified by cosine in double precision, and a pair counts in the least
shard that holds both, so a shard hands on each node's number of links and as few links as join what is
joined, never all pairs. ``recall`` audits the links against brute force for the queries whose id is divisible
by 100, in blocks.

Vectors that are null, zero, or hold null or non-finite components, and rows without a label, link
with nothing. Rows with equal or null ids are told apart by their vectors; null ids come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, table

DEGREE, CANDIDATES, FAR, BEAM, ALPHA = 16, 48, 8, 24, 1.2


def numbered(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """(k, vec_id, label, embedding); k is vec_id where that is unique and not null, else a number in the order of (vec_id, vector)."""
    n, known = rows.agg(F.count("*"), F.count("vec_id")).first()
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    if n == known and not rows.groupBy("vec_id").count().where("count > 1").limit(1).count():
        return base.select(F.col("vec_id").alias("k"), "*"), True
    ordered = base.orderBy(F.col("vec_id").asc_nulls_last(), "label", F.xxhash64("embedding"))
    return scratch.write(ordered.select(F.monotonically_increasing_id().alias("k"), "*"), "numbered"), False


def sound(column: str):
    """Whether a vector can be compared."""
    return F.expr(f"coalesce({column} IS NOT NULL AND size({column}) > 0 AND forall({column}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists({column}, x -> x <> 0), false)")


def _unit(v) -> np.ndarray:
    x = np.stack(v) if len(v) else np.zeros((0, 1))
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the sample."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(k):
            if (near == j).any():
                m = x[near == j].sum(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def shards(nodes: DataFrame, scratch: Scratch, shard_rows: int, sample_rows: int, overlap: int, chord: float, most_levels: int = 8) -> DataFrame:
    """(shard, k, embedding): every node once or more."""
    now = nodes.select(F.concat(F.lit("L"), F.col("label").cast("string"), F.lit("_"), F.size("embedding").cast("string")).alias("shard"), "k", "embedding")
    done: list[DataFrame] = []
    balls: list[DataFrame] = []
    for level in range(most_levels):
        now = scratch.write(now, f"level{level}")
        sizes = now.groupBy("shard").count()
        big = sizes.where(F.col("count") > shard_rows)
        done.append(now.join(big, "shard", "left_anti"))
        if not big.limit(1).count():
            break
        part = now.join(big, "shard")
        # a sample of about sample_rows by a hash, so it is spread over the shard
        picked = part.where(F.pmod(F.xxhash64("k", F.lit(level)), F.lit(1 << 20)) < F.lit(float(sample_rows) * (1 << 20)) / F.col("count"))

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("k")
            k = int(min(64, max(2, -(-3 * pdf["count"].iloc[0] // shard_rows)), len(pdf)))
            c = centres(_unit(pdf["embedding"].to_list()), k)
            # centres in range of each other stand in one crowd, which no border between them may cut
            near = np.maximum(2 - 2 * (c @ c.T), 0) <= chord * chord
            crowd = np.arange(len(c))
            for i, j in joined(near & ~np.eye(len(c), dtype=bool)):
                crowd[i] = j
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "dims": [c.shape[1]], "c": [c.ravel()], "crowd": [np.unique(crowd, return_inverse=True)[1]], "crowds": [len(set(crowd.tolist()))]})

        fitted = scratch.write(picked.groupBy("shard").applyInPandas(fit, "shard string, dims int, c array<double>, crowd array<int>, crowds int"), f"centres{level}")
        balls.append(part.drop("count").join(fitted.where("crowds = 1").select("shard"), "shard", "left_semi"))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pdf = batch.to_pandas()
                out_s, out_i = [], []
                for shard, own in pdf.groupby("shard", sort=False):
                    c, crowd = np.asarray(own["c"].iloc[0]).reshape(-1, int(own["dims"].iloc[0])), np.asarray(own["crowd"].iloc[0])
                    each = np.sqrt(np.maximum(2 - 2 * (_unit(own["embedding"].to_list()) @ c.T), 0))
                    d = np.stack([each[:, crowd == g].min(1) for g in range(crowd.max() + 1)], axis=1)
                    order = np.argsort(d, axis=1)[:, :overlap]
                    near = np.take_along_axis(d, order, 1)
                    for i, cs, ds in zip(own.index, order.tolist(), near.tolist(), strict=True):
                        for j, dist in zip(cs, ds, strict=True):
                            if dist <= ds[0] + chord:
                                out_s.append(f"{shard}/{j}")
                                out_i.append(i)
                take = pa.array(out_i, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(out_s, pa.string()), batch.column("k").take(take), batch.column("embedding").take(take)], ["shard", "k", "embedding"])

        now = part.drop("count").join(fitted.where("crowds > 1"), "shard").mapInArrow(assign, "shard string, k long, embedding array<double>")
    else:
        balls.append(now)
    if balls:
        whole = balls[0]
        for b in balls[1:]:
            whole = whole.unionByName(b)
        now = scratch.write(whole, "whole")
        blocks = now.groupBy("shard").agg(F.ceil(F.count("*") * 2 / shard_rows).cast("int").alias("_n"))
        own = now.join(blocks, "shard").withColumn("_b", F.pmod(F.xxhash64("k"), F.col("_n")).cast("int"))
        pair = F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_o")
        own = own.select("shard", "k", "embedding", "_b", pair)
        done.append(own.select(F.concat_ws("+", "shard", F.least("_b", "_o").cast("string"), F.greatest("_b", "_o").cast("string")).alias("shard"), "k", "embedding"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return scratch.write(out, "shards")


def build(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbours of each row of a shard."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    out, rng = [], np.random.default_rng(n)
    width = min(CANDIDATES, n - 1)
    for at in range(0, n, 1024):
        sim = x[at : at + 1024] @ x.T
        sim[np.arange(len(sim)), np.arange(at, at + len(sim))] = -2
        near = np.argpartition(-sim, width - 1, axis=1)[:, :width]
        if width < n - 1:  # the last ones give way to far ones
            near[:, -FAR:] = rng.integers(0, n, (len(near), FAR))
            near[near == np.arange(at, at + len(near))[:, None]] = at - 1 if at else n - 1
        order = np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        dist = 1 - np.take_along_axis(sim, near, 1)
        for cand, d in zip(near, dist, strict=True):
            among = 1 - x[cand] @ x[cand].T
            alive, kept = np.ones(width, bool), []
            for j in range(width):
                if alive[j]:
                    kept.append(j)
                    if len(kept) == DEGREE:
                        break
                    alive &= ALPHA * among[j] > d
            out.append(cand[kept])
    return out


def search(x: np.ndarray, lists: list[np.ndarray], start: int, q: int, low: float) -> np.ndarray:
    """Rows with a cosine of at least ``low`` to row q, by beam search from ``start`` and then range expansion."""
    sims = {start: float(x[start] @ x[q])}
    beam, tried = [start], set()
    while True:
        todo = next((i for i in beam if i not in tried), None)
        if todo is None:
            break
        tried.add(todo)
        new = [int(i) for i in lists[todo] if int(i) not in sims]
        if new:
            sims.update(zip(new, (x[new] @ x[q]).tolist(), strict=True))
            beam = sorted(beam + new, key=sims.__getitem__, reverse=True)[:BEAM]
    edge = [i for i, s in sims.items() if s >= low]
    done = set()
    while edge:
        i = edge.pop()
        if i in done:
            continue
        done.add(i)
        new = [int(j) for j in lists[i] if int(j) not in sims]
        if new:
            got = x[new] @ x[q]
            sims.update(zip(new, got.tolist(), strict=True))
        edge += [int(j) for j in lists[i] if int(j) not in done and sims[int(j)] >= low]
    return np.array([i for i, s in sims.items() if s >= low and i != q], np.int64)


def joined(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, an earlier row) that join what the symmetric matrix joins; fewer than its rows."""
    out, left = [], np.ones(len(adjacent), bool)
    for start in range(len(adjacent)):
        if not left[start]:
            continue
        left[start] = False
        edge = [start]
        while edge:
            new = np.flatnonzero(adjacent[edge.pop()] & left)
            left[new] = False
            out += [(int(i), start) for i in new]
            edge += new.tolist()
    return out


def linked(nodes: DataFrame, scratch: Scratch, threshold: float, shard_rows: int, sample_rows: int, overlap: int) -> DataFrame:
    """From nodes (k, label, embedding, copies): (a, null, copies of the nodes that a links with in a shard), whose sum
    over shards is a's links, and (a, b, null), links that join all that is joined."""
    chord = float(np.sqrt(2 - 2 * threshold))
    dealt = shards(nodes, scratch, shard_rows, sample_rows, overlap, chord)

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        k = pdf["k"].to_numpy()
        return pd.DataFrame({"shard": pdf["shard"], "k": k, "near": [k[i] for i in build(_unit(pdf["embedding"].to_list()))]})

    edges = dealt.groupBy("shard").applyInPandas(graph, "shard string, k long, near array<long>")
    united = edges.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.sort_array(F.collect_set("shard")).alias("homes"))
    united = scratch.write(united.join(nodes.select("k", "copies"), "k"), "adjacency")

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k").reset_index(drop=True)
        k, x, here = pdf["k"].to_numpy(), _unit(pdf["embedding"].to_list()), pdf["shard"].iloc[0]
        # the united lists run in both directions, as far as both ends are here
        place = {int(v): i for i, v in enumerate(k)}
        both: list[set[int]] = [set() for _ in k]
        for i, near in enumerate(pdf["near"]):
            for v in near:
                j = place.get(int(v))
                if j is not None:
                    both[i].add(j)
                    both[j].add(i)
        lists = [np.fromiter(sorted(s), np.int64, len(s)) for s in both]
        medoid = int((x @ x.mean(0)).argmax())
        hit = np.zeros((len(k), len(k)), bool)
        for q in range(len(k)):
            hit[q, search(x, lists, medoid, q, threshold)] = True
        hit |= hit.T
        homes = [frozenset(h) for h in pdf["homes"]]
        several = np.flatnonzero([len(h) > 1 for h in homes])
        for i in several:  # a pair of another, lesser shard is counted there
            for j in several[hit[i, several]]:
                if min(homes[i] & homes[j]) != here:
                    hit[i, j] = False
        links = hit @ pdf["copies"].to_numpy(np.int64)
        some = np.flatnonzero(links)
        ends = joined(hit)
        a = np.concatenate([k[some], k[[i for i, _ in ends]]]) if ends else k[some]
        b = pd.array([None] * len(some) + [int(k[j]) for _, j in ends], "Int64")
        return pd.DataFrame({"a": a, "b": b, "links": pd.array([int(n) for n in links[some]] + [None] * len(ends), "Int64")})

    return dealt.join(united, "k").groupBy("shard").applyInPandas(find, "a long, b long, links long")


def classes(rows: DataFrame, threshold: float = 0.98, shard_rows: int = 1200, sample_rows: int = 4000, overlap: int = 2) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``rows`` (vec_id, label, embedding)."""
    scratch = Scratch(rows.sparkSession, "vectors")
    keyed, plain = numbered(rows, scratch)
    ok = F.col("label").isNotNull() & sound("embedding")
    # partial sums keep a vector that a third of all rows share from meeting in one task
    groups = scratch.write(keyed.where(ok).groupBy("label", "embedding").agg(F.min("k").alias("r"), F.count("*").alias("copies")), "nodes")
    nodes = groups.select(F.col("r").alias("k"), "label", "embedding", "copies")
    links = scratch.write(linked(nodes, scratch, threshold, shard_rows, sample_rows, overlap), "links")
    comp = components(links.where("b IS NOT NULL").select("a", "b"), scratch)
    degree = links.where("b IS NULL").groupBy(F.col("a").alias("r")).agg(F.sum("links").alias("others"))
    told = groups.join(degree, "r", "left").join(comp.withColumnRenamed("node", "r"), "r", "left")
    told = told.select("label", "embedding", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "r").alias("c"))
    out = keyed.where(ok).join(told, ["label", "embedding"]).select("k", "vec_id", "n_links", "c")
    out = out.unionByName(keyed.where(~ok).select("k", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("c")))
    if plain:
        out = out.withColumn("component_id", F.col("c"))
    else:
        out = out.join(keyed.select(F.col("k").alias("c"), F.col("vec_id").alias("component_id")), "c")
    return out.select("vec_id", "n_links", "component_id", (F.col("k") == F.col("c")).alias("kept"))


def recall(rows: DataFrame, found: DataFrame, threshold: float = 0.98, every: int = 100, blocks: int = 16) -> float:
    """The share of the brute-force links of the rows whose vec_id is divisible by ``every`` that ``found`` (vec_id,
    n_links) counts; fails if it counts more for any of them."""
    ok = rows.where(F.col("label").isNotNull() & sound("embedding")).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = ok.where(F.col("vec_id") % every == 0)

    def brute(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"vec_id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        near = _unit(left["embedding"].to_list()) @ _unit(right["other"].to_list()).T >= threshold
        itself = left["vec_id"].to_numpy()[:, None] == right["other_id"].to_numpy()[None]
        return pd.DataFrame({"vec_id": left["vec_id"].to_numpy(), "n": (near & ~itself).sum(1)})

    dims = F.size("embedding")
    part = ok.select(F.col("label").alias("l"), dims.alias("d"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("b"), F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    each = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    true = each.groupBy("label", dims.alias("dims"), F.col("block").cast("long").alias("block")).cogroup(part.groupBy("l", "d", "b")).applyInPandas(brute, "vec_id long, n long")
    both = true.groupBy("vec_id").agg(F.sum("n").alias("n")).join(found.select("vec_id", "n_links"), "vec_id")
    n, had, more = both.agg(F.sum("n"), F.sum("n_links"), F.count(F.when(F.col("n_links") > F.col("n"), 1))).first()
    if more:
        raise AssertionError(f"{more} rows have links below the threshold")
    return had / n if n else 1.0


def op6_flat_graph_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all rows of ``embeddings``."""
    return classes(table(spark, sf_dir, "embeddings"))
