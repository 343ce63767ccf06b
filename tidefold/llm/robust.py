"""Op 1, quality rules by robust multivariate outliers (DataFrame and SQL functions only).

Every text gets word, symbol, line and repetition counts. Five transformed statistics of each text
(logarithms of length, word length, symbols, repeated lines and repeated windows per 100 words, in
thousandths) form a vector. For each language and source the minimum-covariance-determinant estimate
is sought from four deterministic starts: medians with quartile scales, plain moments, and the medians
and scales with the correlations of the rows' directions or of their bent coordinates. C-steps keep the
share ``H`` of nearest rows and estimate anew: two from each start, then from the one of least
determinant until no group's log determinant falls by more than ``SETTLED`` (``MOST_STEPS`` at most). That
one is corrected for consistency, reweighted once, and rows whose Mahalanobis distance exceeds the
chi-square quantile are rejected. Each statistic has a least scale (``FLOOR``), added to the covariance, so that groups
in which nearly every value is 0 stay invertible. Groups below ``LEAST`` rows are pooled by language,
then all together; a pool that is still smaller rejects nothing.

The covariance work is sums of whole numbers by group and quantiles from counts by group and bucket,
so it doesn't depend on how the rows are dealt, and no group is gathered anywhere.

Null text has no words (all counts 0) and fails the base rule; null lang or source are values of
their own; repeated rows get equal results; empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

SPACE = r"[\x20\x09-\x0D]"
#: Least scale of each statistic, in thousandths of its unit.
FLOOR = (250, 60, 400, 400, 500)
H, LEAST, TAIL = 0.75, 60, 1e-7
SETTLED, MOST_STEPS = 0.002, 20
#: Models are broadcast for up to so many groups (some 300 bytes each), else joined by a shuffle.
MOST_BROADCAST = 10_000
P = len(FLOOR)
MOMENTS = [(i, j) for i in range(P) for j in range(i + 1)]

REPEATED = r"""
CASE WHEN n_words < 8 THEN 0
WHEN size(array_distinct(transform(sequence(1, n_words - 7), i -> xxhash64(slice(words, i, 8))))) = n_words - 7 THEN 0
ELSE transform(array(sort_array(transform(sequence(1, n_words - 7), i -> named_struct('w', array_join(slice(words, i, 8), ' '), 'i', i)))), s ->
  transform(array(sort_array(array_distinct(flatten(zip_with(s, slice(s, 2, size(s)), (a, b) -> CASE WHEN a.w = b.w THEN array(a.i, b.i) ELSE array_repeat(a.i, 0) END))))), p ->
    aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> CASE WHEN b IS NULL THEN 8 ELSE least(8, b - a) END), 0, (x, y) -> x + y))[0])[0]
END"""


def chi2_cdf(x: float, df: int) -> float:
    """By the series of the incomplete gamma function."""
    a, t = df / 2, x / 2
    if t <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= t / k
        total += term
    return min(1.0, total * math.exp(-t + a * math.log(t) - math.lgamma(a)))


def chi2_quantile(q: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, df) < q else (lo, mid)
    return (lo + hi) / 2


def consistency(share: float) -> float:
    """What a covariance of the nearest ``share`` of normal rows is short by."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row; no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", text.alias("text"), F.split(F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", ""), f"{SPACE}+").alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    two = one.select(
        "doc_id", "lang", "source", "words",
        F.when(F.length(F.element_at("words", 1)) == 0, 0).otherwise(F.size("words")).alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
    )
    out = two.withColumn("n_repeat_words", F.expr(REPEATED).cast("long")).drop("words").withColumn("n_words", F.col("n_words").cast("long"))
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def vectors(stats: DataFrame) -> DataFrame:
    """``stats`` with the transformed statistics x0..x4 as whole thousandths."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    xs = [F.log(1.0 + F.col("n_words")), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), *(F.log(1.0 + 100 * F.col(c) / n) for c in ("n_symbols", "n_dup_lines", "n_repeat_words"))]
    return stats.withColumns({f"x{i}": F.round(1000 * x).cast("long") for i, x in enumerate(xs)})


def _name(*cols: str) -> Column:
    return F.to_json(F.struct(*cols, F.lit(len(cols)).alias("level")))


def groups(rows: DataFrame) -> DataFrame:
    """(full, g): the group that judges each (lang, source): itself, else its lang, else all, by size."""
    sound = rows.where(~F.col("base_failed"))
    per = sound.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumns({"full": _name("lang", "source"), "part": _name("lang")})
    small = per.where(F.col("n") < LEAST).groupBy("part").agg(F.sum("n").alias("m"))
    return per.join(small, "part", "left").select("full", F.when(F.col("n") >= LEAST, F.col("full")).when(F.col("m") >= LEAST, F.col("part")).otherwise("all").alias("g"))


def _cholesky(df: DataFrame, cov: dict[tuple[int, int], Column], mean: list[Column], tag: str) -> DataFrame:
    """``df`` with mean{tag}i, the factor's entries l{tag}ij and log determinant det{tag}."""
    df = df.withColumns({f"m{tag}{i}": m for i, m in enumerate(mean)} | {f"l{tag}{i}{j}": c for (i, j), c in cov.items()})
    for j in range(P):
        less = sum((F.col(f"l{tag}{j}{k}") * F.col(f"l{tag}{j}{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{tag}{j}{j}", F.sqrt(F.greatest(F.col(f"l{tag}{j}{j}") - less, F.lit(1.0))))
        below = {}
        for i in range(j + 1, P):
            part = sum((F.col(f"l{tag}{i}{k}") * F.col(f"l{tag}{j}{k}") for k in range(j)), F.lit(0.0))
            below[f"l{tag}{i}{j}"] = (F.col(f"l{tag}{i}{j}") - part) / F.col(f"l{tag}{j}{j}")
        df = df.withColumns(below) if below else df
    return df.withColumn(f"det{tag}", sum((F.log(F.col(f"l{tag}{i}{i}")) for i in range(P)), F.lit(0.0)) * 2)


def _model(sums: DataFrame, tag: str, factor: Column | float = 1.0) -> DataFrame:
    n = F.greatest(F.col(f"n{tag}"), F.lit(1)).cast("double")
    mean = [F.col(f"s{tag}{i}").cast("double") / n for i in range(P)]
    cov = {(i, j): (F.col(f"q{tag}{i}{j}").cast("double") / n - mean[i] * mean[j]) * factor + (float(FLOOR[i] ** 2) if i == j else 0.0) for i, j in MOMENTS}
    return _cholesky(sums, cov, mean, tag)


def _sums(tag: str, inside: Column) -> list[Column]:
    x = [F.when(inside, F.col(f"x{i}")) for i in range(P)]
    dec = lambda c: c.cast("decimal(20,0)")
    return [F.count(F.when(inside, 1)).alias(f"n{tag}"), *(F.coalesce(F.sum(dec(x[i])), F.lit(0)).alias(f"s{tag}{i}") for i in range(P)), *(F.coalesce(F.sum(dec(x[i] * x[j])), F.lit(0)).alias(f"q{tag}{i}{j}") for i, j in MOMENTS)]


def _distance(df: DataFrame, tag: str) -> DataFrame:
    """``df`` with d{tag}, the squared Mahalanobis distance under the joined model."""
    for i in range(P):
        less = sum((F.col(f"l{tag}{i}{k}") * F.col(f"_y{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"_y{i}", (F.col(f"x{i}") - F.col(f"m{tag}{i}") - less) / F.col(f"l{tag}{i}{i}"))
    return df.withColumn(f"d{tag}", sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(P)), F.lit(0.0))).drop(*(f"_y{i}" for i in range(P)))


def _bucket(d: str) -> Column:
    return F.floor(F.log(F.col(d) + 1e-6) * 64).cast("int")


def _small(model: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(model) if few else model


def _cut(far: DataFrame, tags: str) -> DataFrame:
    """(g, c<tag>): the least bucket of distances up to which a share H of the group lies."""
    # counts by bucket, a few thousand at most for a group, are merged in one shuffle
    return far.groupBy("g").agg(*(F.expr(f"CAST(percentile_disc({H}) WITHIN GROUP (ORDER BY k{t}) AS INT)").alias(f"c{t}") for t in tags))


def _kept(tags: str) -> list[str]:
    return ["g", *(c for t in tags for c in [f"det{t}", *(f"m{t}{i}" for i in range(P)), *(f"l{t}{i}{j}" for i, j in MOMENTS)])]


def _step(rows: DataFrame, model: DataFrame, tags: str, few: bool) -> DataFrame:
    """One C-step: the nearest share H of each group's rows under each model of it, estimated anew."""
    far = rows.join(_small(model, few), "g")
    for t in tags:
        far = _distance(far, t).withColumn(f"k{t}", _bucket(f"d{t}"))
    far = far.select("g", *(f"x{i}" for i in range(P)), *(f"k{t}" for t in tags))
    near = far.join(_small(_cut(far, tags), few), "g").groupBy("g").agg(*(c for t in tags for c in _sums(t, F.col(f"k{t}") <= F.col(f"c{t}"))))
    for t in tags:
        near = _model(near, t)
    return near.select(*_kept(tags))


def estimate(rows: DataFrame, scratch: Scratch, few: bool = False) -> DataFrame:
    """A model (mean, factor) for each group ``g`` of ``rows`` (g, x0..x4); few: the groups are few enough to broadcast."""
    rows = rows.select("g", *(f"x{i}" for i in range(P)))
    plain = rows.groupBy("g").agg(*_sums("b", F.lit(True)), *(F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"t{i}") for i in range(P)))
    middle = [F.col(f"t{i}")[1].cast("double") for i in range(P)]
    scale = [F.sqrt(F.pow((F.col(f"t{i}")[2] - F.col(f"t{i}")[0]) / 1.349, F.lit(2.0)) + float(FLOOR[i] ** 2)) for i in range(P)]
    plain = _model(plain, "b").select(*_kept("b"), *(m.alias(f"mid{i}") for i, m in enumerate(middle)), *(c.alias(f"scale{i}") for i, c in enumerate(scale)))
    plain = scratch.write(plain, "plain")
    # robust starts about the medians: of each row's direction (spatial signs), and of its bent coordinates (tanh)
    z = rows.join(_small(plain.select("g", *(f"{c}{i}" for c in ("mid", "scale") for i in range(P))), few), "g")
    z = z.select("g", *((F.col(f"x{i}") - F.col(f"mid{i}")) / F.col(f"scale{i}") for i in range(P))).toDF("g", *(f"z{i}" for i in range(P)))
    long = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0)))
    # whole millionths, so that the order of rows doesn't matter
    whole = lambda c: F.round(1e6 * c).cast("long")
    z = z.select("g", *(whole(F.when(long > 0, F.col(f"z{i}") / long).otherwise(0.0)).alias(f"s{i}") for i in range(P)), *(whole(F.tanh(f"z{i}")).alias(f"h{i}") for i in range(P)))
    bent = z.groupBy("g").agg(F.count("*").alias("n"), *(F.sum((F.col(f"{c}{i}") * F.col(f"{c}{j}")).cast("decimal(20,0)")).cast("double").alias(f"{c}{i}{j}") for c in "sh" for i, j in MOMENTS))
    start = bent.join(_small(plain, few), "g")
    unit = lambda i, j: F.lit(1.0 if i == j else 0.0)
    share = lambda c, i, j: F.col(f"{c}{i}{j}") / F.greatest(F.sqrt(F.col(f"{c}{i}{i}") * F.col(f"{c}{j}{j}")), F.lit(1.0)) if i != j else F.lit(1.0)
    for tag, part in (("a", unit), ("c", lambda i, j: share("s", i, j)), ("d", lambda i, j: share("h", i, j))):
        # a little of the diagonal keeps the factor real where coordinates move together
        cov = {(i, j): (part(i, j) * (1.0 if i == j else 0.95)) * F.col(f"scale{i}") * F.col(f"scale{j}") for i, j in MOMENTS}
        start = _cholesky(start, cov, [F.col(f"mid{i}") for i in range(P)], tag)
    model = scratch.write(start.select(*_kept("abcd")), "start")
    for _ in range(2):
        half = scratch.write(_step(rows, model.select(*_kept("ab")), "ab", few), "step-ab")
        model = scratch.write(_step(rows, model.select(*_kept("cd")), "cd", few).join(_small(half, few), "g"), "steps")
        scratch.reclaim()
    least = F.least(*(f"det{t}" for t in "abcd"))
    pick = lambda c: F.coalesce(*(F.when(F.col(f"det{t}") == least, F.col(c.replace("#", t))) for t in "abcd")).alias(c.replace("#", "e"))
    best = scratch.write(model.select("g", *(pick(c) for c in ["det#", *(f"m#{i}" for i in range(P)), *(f"l#{i}{j}" for i, j in MOMENTS)])), "best")
    for _ in range(MOST_STEPS):  # a step lowers the determinant or leaves it, up to the width of a bucket; the lower one is kept
        new = _step(rows, best, "e", few)
        both = new.join(_small(best.select(*(F.col(c).alias(f"was_{c}") for c in best.columns)), few), F.col("was_g") == F.col("g"))
        lower = F.col("dete") < F.col("was_dete")
        both = scratch.write(both.select("g", (F.col("was_dete") - F.col("dete")).alias("gain"), *(F.when(lower, F.col(c)).otherwise(F.col(f"was_{c}")).alias(c) for c in _kept("e")[1:])), "step")
        best = both.drop("gain")
        if not both.where(F.col("gain") > SETTLED).limit(1).count():
            break
    inside = F.col("de") <= chi2_quantile(0.975, P) * consistency(H)
    sums = _distance(rows.join(_small(best, few), "g"), "e").groupBy("g").agg(*_sums("r", inside), F.count("*").alias("n_all"))
    out = _model(sums, "r", consistency(0.975))
    return scratch.write(out.select("g", "n_all", "nr", *(f"mr{i}" for i in range(P)), *(f"lr{i}{j}" for i, j in MOMENTS), F.col("detr")), "model")


def judged(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """Counts, base_failed, kept and distance2 (null where a pool is too small) of every row."""
    scratch = Scratch(docs.sparkSession, "robust")
    rows = scratch.write(vectors(statistics(docs)), "stats")
    names = scratch.write(groups(rows), "groups")
    few = names.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    rows = rows.withColumn("full", _name("lang", "source")).join(_small(names, few), "full", "left").drop("full")
    # the steps read their rows with the group, which no step finds again
    sound = scratch.write(rows.where(~F.col("base_failed")).select("g", *(f"x{i}" for i in range(P))), "sound")
    scratch.reclaim()
    model = estimate(sound, scratch, few)
    out = _distance(rows.join(_small(model, few), "g", "left"), "r")
    d = F.when(F.col("n_all") >= LEAST, F.col("dr"))
    ok = ~F.col("base_failed") & F.coalesce(d <= chi2_quantile(1 - tail, P), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", ok.alias("kept"), d.alias("distance2"))


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over whole ``documents``."""
    return judged(table(spark, sf_dir, "documents"))
