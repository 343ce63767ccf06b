"""Embeddings against brute force, components, and the pipeline's stages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidefold.llm import vectors
from tidefold.llm.common import Scratch, components

SF = "/root/testdata/sf0.001"


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1050)] + [(5, 5), (None, 1)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.component for r in components(df, Scratch(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1050), 1000)}
    assert components(df.limit(0), Scratch(spark, "t")).count() == 0


def cloud(seed, groups=60, copies=12, dims=16):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        c = rng.normal(size=dims)
        for _ in range(copies):
            out.append((len(out), int(g % 3), [float(x) for x in c + rng.normal(size=dims) * rng.choice([0.0, 0.03, 0.06, 0.5])]))
    return out


def test_links_are_those_of_brute_force(spark):
    rows = cloud(1) + [(9000, None, [1.0] * 16), (9001, 0, None), (9002, 0, [0.0] * 16), (9003, 0, [float("nan")] * 16), (9004, 0, [1.0, None] * 8), (9005, 1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("k", F.lit(1))
    got = {r.vec_id: r for r in vectors.classes(df, shard_rows=100, sample_rows=150).collect()}
    x = np.array([r[2] for r in rows[:-6]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[1] for r in rows[:-6]])
    true = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(true, False)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= true.sum(1)).all() and found.sum() >= 0.97 * true.sum() > 0
    for i in range(9000, 9006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert sum(r.kept for r in got.values()) < len(got)


def test_repeated_vectors_and_ids(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (None, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = sorted([(r.vec_id or 99, r.n_links, r.component_id, r.kept) for r in vectors.classes(df).collect()])
    assert got == [(1, 2, 1, False), (1, 2, 1, True), (2, 0, 2, True), (99, 2, 1, False)]
    assert vectors.classes(df.limit(0)).count() == 0


def test_a_ball_that_no_centres_split_is_compared_by_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 0, [float(v) for v in np.r_[1.0, rng.normal(0, 0.01, 7)]]) for i in range(260)] + [(300 + i, 0, [float(v) for v in rng.normal(size=8)]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    scratch = Scratch(spark, "t")
    nodes = df.select(F.col("vec_id").alias("k"), "label", "embedding")
    dealt = vectors.shards(nodes, scratch, 50, 100, 2, 2.0, most_levels=1)  # what is left after the levels
    assert dealt.where("shard LIKE '%+%'").groupBy("shard").count().agg(F.max("count")).first()[0] < 100
    dealt = dealt.withColumn("of", F.regexp_extract("shard", "^[^+]*", 0))
    pairs = lambda by: dealt.alias("a").join(dealt.alias("b"), by).where("a.k < b.k").select(F.col("a.k").alias("x"), F.col("b.k").alias("y")).distinct().count()
    assert pairs("shard") == pairs("of") > 0  # each pair meets
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {r.vec_id: r.n_links for r in vectors.classes(df, shard_rows=50, sample_rows=100).collect()}
    true = (x @ x.T >= 0.98).sum(1) - 1
    assert all(got[r[0]] <= n for r, n in zip(rows, true, strict=True)) and sum(got.values()) >= 0.97 * true.sum()


def test_audit(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 0.0]), (5, 0, [1.0, 0.001]), (7, 0, [0.0, 1.0])], "vec_id long, label int, embedding array<double>")
    found = lambda n: spark.createDataFrame([(0, n), (5, 1), (7, 0)], "vec_id long, n_links long")
    assert vectors.recall(df, found(1)) == 1.0 and vectors.recall(df, found(0)) == 0.0
    with pytest.raises(AssertionError):
        vectors.recall(df, found(2))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_of_the_query(spark, sf):
    path = f"/root/testdata/{sf}"
    df = spark.read.parquet(f"{path}/embeddings.parquet")
    assert vectors.recall(df, vectors.op6_flat_graph_neardup(spark, path), every=10) >= 0.9


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    scratch = Scratch(spark, "t")
    for name, f in corpus_pipeline.STAGES:
        new = scratch.write(f(spark, docs, SF), name)
        out.append((name, docs, new))
        docs = new
    return out


def test_stages_keep_the_columns(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() <= before.count()


def test_stage_decisions(stages):
    by = {n: (b, a) for n, b, a in stages}
    before, after = by["near_duplicates"]
    from tests.llm.test_text_ops import brute_components

    rows = before.select("doc_id", "text").collect()
    comp = brute_components([r.doc_id for r in rows], [r.text for r in rows])
    assert {r.doc_id for r in after.collect()} == {d for d, (_, c) in comp.items() if d == c}
    before, after = by["mixing"]
    assert sorted(before.collect()) == sorted(after.collect())
    before, after = by["personal_data"]
    assert [r.doc_id for r in before.orderBy("doc_id").collect()] == [r.doc_id for r in after.orderBy("doc_id").collect()]
    before, after = by["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def test_sequences_follow_the_mix(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma.", "Δ"]) for _ in range(rng.choice([5, 30, 90, 400]))) for _ in range(6000)]
    source = ["hot" if i < 4000 else f"s{i % 20}" for i in range(6000)]
    docs = spark.createDataFrame([(i, t, "en", source[i], len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        corpus_pipeline.mixing(spark, docs, SF).write.parquet(str(tmp_path / "mixed"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "mixed").glob("part-*"))) > 1
    rows = corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "mixed")), SF).orderBy("sequence_id", "offset").collect()
    assert {(r.doc_id, r.piece) for r in rows} >= {(i, 0) for i in range(6000)} and len(rows) == len({(r.doc_id, r.piece) for r in rows})
    fill = {}
    for r in rows:
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 2
    share = 4000**0.7 / (4000**0.7 + 20 * 100**0.7)
    seen = list(dict.fromkeys(r.doc_id for r in rows))
    for n in (500, 1000, 1500, 2000, 3000):  # every source lasts for so long
        got = sum(source[d] == "hot" for d in seen[:n]) / n
        assert abs(got - share) < 0.03 < abs(4000 / 6000 - share), n


def test_pipeline_of_no_rows(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
