"""Rank tests between models over matched blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matched(rows: DataFrame, block: str, model: str, value: str) -> DataFrame:
    """block, model, value: means of repeated entries, for the blocks that have every model."""
    m = rows.groupBy(block, model).agg(F.avg(value).alias("value")).where("value is not null").withColumnsRenamed({block: "block", model: "model"})
    n = m.agg(F.countDistinct("model").alias("_n"))
    full = m.groupBy("block").agg(F.count(F.lit(1)).alias("_c")).crossJoin(F.broadcast(n)).where("_c = _n").select("block")
    return m.join(full, "block", "left_semi")


def block_ranks(m: DataFrame) -> DataFrame:
    """Ranks in each block, 1 for the largest value, ties at their mean."""
    w = Window.partitionBy("block").orderBy(F.desc("value"))
    ties = Window.partitionBy("block", "value")
    return m.withColumn("rank", F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def _tail(f, *columns) -> Column:
    """A distribution's tail as a column, computed on batches of the few rows of a test."""

    @F.pandas_udf("double")
    def run(*args: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else float(f(*row)) for row in zip(*args)], dtype="float64")

    return run(*columns)


def friedman(m: DataFrame) -> DataFrame:
    """Tie-corrected chi-square, p, blocks and models; chi-square and p are null if every block is one tie."""
    r = block_ranks(m)
    ties = r.groupBy("block", "value").count().agg(F.sum(F.col("count") ** 3 - F.col("count")).alias("ties"))
    sums = r.groupBy("model").agg(F.sum("rank").alias("s"), F.count(F.lit(1)).alias("n"))
    a = sums.agg(F.sum(F.col("s") ** 2).alias("ss"), F.max("n").cast("double").alias("n"), F.count(F.lit(1)).cast("double").alias("k")).crossJoin(F.broadcast(ties))
    k, n = F.col("k"), F.col("n")
    raw = 12 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    out = a.select(F.try_divide(raw, 1 - F.col("ties") / (n * k * (k * k - 1))).alias("chi2"), n.cast("long").alias("n_blocks"), k.cast("long").alias("n_models"))
    return out.withColumn("p", _tail(chi2_sf, F.col("chi2"), F.col("n_models") - 1))


def nemenyi(m: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Difference of mean ranks, q, p and the critical difference of every pair of models, and whether it is significant."""
    r = block_ranks(m).groupBy("model").agg(F.avg("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    k = r.agg(F.count(F.lit(1)).alias("k"))
    pairs = r.alias("x").join(r.alias("y"), F.col("x.model") < F.col("y.model")).crossJoin(F.broadcast(k))  # one row a model
    se = F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("x.n")))
    out = pairs.select(F.col("x.model").alias("a"), F.col("y.model").alias("b"), F.abs(F.col("x.r") - F.col("y.r")).alias("rank_diff"), (F.abs(F.col("x.r") - F.col("y.r")) / se).alias("q"), se.alias("_se"), "k")
    out = out.withColumn("p", _tail(lambda q, n: studentized_sf(q * math.sqrt(2), int(n)), "q", "k"))
    out = out.withColumn("critical_difference", _tail(lambda n: studentized_isf(alpha, int(n)) / math.sqrt(2), "k") * F.col("_se"))
    return out.select("a", "b", "rank_diff", "q", "p", "critical_difference", (F.col("rank_diff") > F.col("critical_difference")).alias("significant"))


def wilcoxon(m: DataFrame, a: str, b: str, alternative: str = "two-sided") -> DataFrame:
    """Signed-rank statistic, z by the normal approximation with ties, p, and effect |z| / sqrt(n); zeros are dropped.

    ``alternative`` greater means that ``a`` is larger. Without a difference p is 1 and the rest 0.
    """
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError("alternative must be two-sided, greater or less")
    d = m.groupBy("block").agg(F.max(F.when(F.col("model") == a, F.col("value"))).alias("x"), F.max(F.when(F.col("model") == b, F.col("value"))).alias("y")).select((F.col("x") - F.col("y")).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    ties = Window.partitionBy("m")
    r = d.withColumn("r", F.rank().over(Window.orderBy("m")) + (F.count(F.lit(1)).over(ties) - 1) / 2)  # one row a block
    t = d.groupBy("m").count().agg(F.coalesce(F.sum(F.col("count") ** 3 - F.col("count")), F.lit(0.0)).alias("t"))
    s = r.agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w"), F.count(F.lit(1)).cast("double").alias("n")).crossJoin(F.broadcast(t))
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48)
    z = F.coalesce(F.try_divide(F.col("w") - n * (n + 1) / 4, sd), F.lit(0.0))
    out = s.select("w", n.cast("long").alias("n"), z.alias("z"), F.coalesce(F.try_divide(F.abs(z), F.sqrt(n)), F.lit(0.0)).alias("effect"))
    tail = {"two-sided": lambda z, n: min(1.0, 2 * normal_sf(abs(z))), "greater": lambda z, n: normal_sf(z), "less": lambda z, n: normal_sf(-z)}[alternative]
    return out.withColumn("p", _tail(lambda z, n: tail(z, n) if n else 1.0, "z", "n"))


def bootstrap_interval(a: list[float], b: list[float] | None = None, draws: int = 10_000, level: float = 0.95, seed: int = 42) -> tuple[float, float, float]:
    """Mean (of paired differences) and its percentile interval; the values are one a block."""
    x = np.asarray(a, float) - (np.asarray(b, float) if b is not None else 0)
    x = x[np.isfinite(x)]
    if not len(x):
        return math.nan, math.nan, math.nan
    means = x[np.random.default_rng(seed).integers(0, len(x), (draws, len(x)))].mean(1)
    return float(x.mean()), *(float(v) for v in np.quantile(means, [(1 - level) / 2, (1 + level) / 2]))


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution, by series or continued fraction of the incomplete gamma."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for i in range(1, 1000):
            term *= x / (a + i)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def studentized_sf(q: float, k: int) -> float:
    """Upper tail of the studentized range of ``k`` groups at infinite degrees of freedom, by quadrature."""
    z = np.linspace(-9, 9, 4001)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    low = np.array([0.5 * math.erfc(-(v - q) / math.sqrt(2)) for v in z])
    f = phi * (cdf - low) ** (k - 1)
    return float(min(1.0, max(0.0, 1 - k * float(((f[1:] + f[:-1]) / 2 * np.diff(z)).sum()))))


def studentized_isf(p: float, k: int) -> float:
    lo, hi = 0.0, 50.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if studentized_sf(mid, k) > p else (lo, mid)
    return (lo + hi) / 2


def paired(m: DataFrame, a: str, b: str, alternative: str = "two-sided", draws: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Means and sample deviations of two models, their Wilcoxon test and the bootstrap interval of the mean difference: one row.

    The interval's resamples are drawn in one task from one row a block.
    """
    stats = m.where(F.col("model").isin(a, b)).groupBy("model").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    side = lambda x, y: stats.where(F.col("model") == x).select(F.lit(x).alias(y), F.col("mean").alias(f"mean_{y}"), F.col("std").alias(f"std_{y}"))
    d = m.groupBy("block").agg((F.max(F.when(F.col("model") == a, F.col("value"))) - F.max(F.when(F.col("model") == b, F.col("value")))).alias("d"))

    def interval(t: pa.Table) -> pa.Table:
        mean, lo, hi = bootstrap_interval(sorted(v for v in t["d"].to_pylist() if v is not None), None, draws, level, seed)
        return pa.table({"mean_difference": [mean], "low": [lo], "high": [hi]})

    ci = d.groupBy(F.lit(1).alias("_one")).applyInArrow(interval, "mean_difference double, low double, high double")  # one row a block
    return side(a, "a").crossJoin(side(b, "b")).crossJoin(wilcoxon(m, a, b, alternative)).crossJoin(ci)


PROTOCOL = "test string, a string, b string, statistic double, p double, effect double, low double, high double, note string"


def protocol(m: DataFrame, alpha: float = 0.05, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """The tests that the number of models asks for, as rows: test, a, b, statistic, p, effect, low, high, note.

    Three or more models: Friedman (chi-square, whose effect is Kendall's W), and where its p is
    below 0.05 one Nemenyi row a pair (statistic q, effect the difference of ranks, high the
    critical difference). Two: Wilcoxon (statistic z) with the interval of the mean difference.
    Fewer: a note. The driver learns the models' names and one p.
    """
    spark = m.sparkSession
    models = sorted(r[0] for r in m.select("model").distinct().collect())  # one row a model
    null = lambda *names: [F.lit(None).cast("string" if n == "note" else "double").alias(n) for n in names]
    names = [F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")]
    if len(models) < 2:
        return spark.createDataFrame([("none", models[0] if models else None, None, None, None, None, None, None, f"{len(models)} model")], PROTOCOL)
    if len(models) == 2:
        p = paired(m, *models, draws=draws, seed=seed)
        return p.select(F.lit("wilcoxon").alias("test"), "a", "b", F.col("z").alias("statistic"), "p", "effect", "low", "high", *null("note"))
    f = friedman(m)
    w = F.try_divide(F.col("chi2"), F.col("n_blocks") * (F.col("n_models") - 1))
    out = f.select(F.lit("friedman").alias("test"), *names, F.col("chi2").alias("statistic"), "p", w.alias("effect"), *null("low", "high", "note"))
    first = f.first()["p"]
    if first is not None and first < 0.05:
        pairs = nemenyi(m, alpha)
        out = out.unionByName(pairs.select(F.lit("nemenyi").alias("test"), "a", "b", F.col("q").alias("statistic"), "p", F.col("rank_diff").alias("effect"), *null("low"), F.col("critical_difference").alias("high"), *null("note")))
    return out
