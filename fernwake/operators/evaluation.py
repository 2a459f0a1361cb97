"""Metrics of binary scores, threshold tuning and fold summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernwake.functions.vectors import finite
from fernwake.operators.ordering import range_parts, running_sums
from fernwake.session import Scratch, broadcast_if

MOST_GROUPS = 100_000  # groups whose spans may be broadcast

# The metrics of a scored fold, in their order.
METRIC_KEYS = ("auc_pr", "sensitivity", "precision_seizure", "f1_seizure", "f1_nonseizure", "f1_macro", "specificity", "fp_per_hour", "balanced_accuracy", "accuracy", "roc_auc", "n", "n_pos", "threshold")


def _n(c: Column) -> Column:
    return F.count(F.when(c, 1)).cast("double")


def confusion_panel(scored: DataFrame, threshold: float | Column, step_seconds: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall and F1 of both classes, specificity, accuracies and false positives an hour.

    ``scored`` has y and score; a score at the threshold is positive. Rates without a denominator
    are 0, specificity and false positives an hour null; the balanced accuracy is the mean over the
    classes that occur. ``threshold`` may be a column. Rows without y or score are left out.
    """
    r = scored.where("y is not null").withColumn("score", finite(F.col("score"))).where("score is not null").withColumn("p", (F.col("score") >= threshold).cast("int"))
    c = r.groupBy(*(by or [])).agg(_n((F.col("y") == 1) & (F.col("p") == 1)).alias("tp"), _n((F.col("y") == 0) & (F.col("p") == 1)).alias("fp"), _n((F.col("y") == 1) & (F.col("p") == 0)).alias("fn"), _n((F.col("y") == 0) & (F.col("p") == 0)).alias("tn"))
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    spec = F.try_divide(tn, tn + fp)
    cols = {"precision": z(tp, tp + fp), "recall": z(tp, tp + fn), "f1": z(2 * tp, 2 * tp + fp + fn), "f1_negative": z(2 * tn, 2 * tn + fp + fn), "specificity": spec, "accuracy": z(tp + tn, n), "fp_per_hour": F.try_divide(fp, n * step_seconds / 3600)}
    out = c.select(*(by or []), *[F.col(x).cast("long").alias(x) for x in ("tp", "fp", "fn", "tn")], *[v.alias(k) for k, v in cols.items()])
    some = F.col("tp") + F.col("fn") > 0
    both = F.when(~some, F.col("specificity")).when(F.col("specificity").isNull(), F.col("recall")).otherwise((F.col("recall") + F.col("specificity")) / 2)
    return out.withColumn("balanced_accuracy", both)


def _curve(scored: DataFrame, by: list[str]) -> DataFrame:
    """Positives and negatives at each distinct score, so that later windows see distinct scores only."""
    r = scored.where("y is not null").withColumn("score", finite(F.col("score"))).where("score is not null")
    return r.groupBy(*by, "score").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))


def _ranked(scored: DataFrame, by: list[str]) -> DataFrame:
    """``_curve`` from the highest score down with ``pos_upto`` and ``neg_upto``.

    The distinct scores are cut into ranges, also inside a group, and each range continues the sums
    of those before it, so no task holds a group's scores.
    """
    key = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(by)])) if by else F.lit("")
    c = _curve(scored, by).withColumns({"_key": key, "_down": -F.col("score")})
    return running_sums(range_parts(c, "_key", ["_down"], Scratch(scored.sparkSession, "curve"), "scores"), "_key", ["_down"], ["pos", "neg"])


def curve_areas(scored: DataFrame, by: list[str]) -> DataFrame:
    """average_precision and roc_auc of each group, from one ordering of its distinct scores.

    The first is the step area over distinct scores, the second counts ties half; both are null
    unless both classes occur.
    """
    ap = F.sum(F.col("pos") * F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto")))
    above = F.sum(F.col("neg") * (F.col("pos_upto") - F.col("pos") / 2))
    agg = _ranked(scored, by).groupBy(*by).agg(ap.alias("ap"), above.alias("above"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return agg.select(*by, F.when(both, F.try_divide("ap", "p")).alias("average_precision"), F.when(both, F.try_divide("above", F.col("p") * F.col("n"))).alias("roc_auc"))


def average_precision(scored: DataFrame, by: list[str]) -> DataFrame:
    """Step average precision over distinct scores; null unless both classes occur."""
    return curve_areas(scored, by).drop("roc_auc")


def roc_auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve, ties counted half; null unless both classes occur."""
    return curve_areas(scored, by).drop("average_precision")


def metric_panel(scored: DataFrame, by: list[str], step_seconds: float = 1.0) -> DataFrame:
    """The fourteen metrics of each group of ``scored`` (by, y, score, threshold), named as in ``METRIC_KEYS``.

    A group has one threshold. Undefined metrics are null. The sources of a group's rows are read
    twice, so ``scored`` should be a written table where it is costly.
    """
    c = confusion_panel(scored, F.col("threshold"), step_seconds, by)
    t = scored.groupBy(*by).agg(F.max("threshold").alias("threshold"))
    out = c.join(curve_areas(scored, by), by).join(t, by)
    named = {
        "auc_pr": F.col("average_precision"), "sensitivity": F.col("recall"), "precision_seizure": F.col("precision"), "f1_seizure": F.col("f1"), "f1_nonseizure": F.col("f1_negative"),
        "f1_macro": (F.col("f1") + F.col("f1_negative")) / 2, "n": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), "n_pos": F.col("tp") + F.col("fn"),
    }
    return out.select(*by, *[named.get(k, F.col(k)).alias(k) for k in METRIC_KEYS])


def summarize(panel: DataFrame, by: list[str], keys: tuple[str, ...] = METRIC_KEYS) -> DataFrame:
    """Mean, deviation and number of each metric over the groups of a panel: by, key, mean, std, n."""
    long = panel.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in keys])).alias("x")).select(*by, "x.*")
    return mean_std(long, [*by, "key"], "value")


def as_text(mean: Column, std: Column, digits: int = 3) -> Column:
    """"m +/- s" with so many digits, n/a without a mean."""
    text = F.format_string(f"%.{digits}f +/- %.{digits}f", mean, std)
    return F.when(mean.isNull(), F.lit("n/a")).otherwise(text)


def tune_threshold(scored: DataFrame, criterion: str, by: list[str], target: float = 0.8, grid: int = 256) -> DataFrame:
    """The best of ``grid`` evenly spaced thresholds from the lowest to the highest score: threshold, value.

    f1 and youden take the largest value, ties the lowest threshold; sensitivity takes the highest
    threshold that reaches ``target``, else 0.5. With one class only the threshold is 0.5, with
    one score that score. Scores are counted into the grid's cells first, so the sweep sees
    ``grid`` rows a group.
    """
    if criterion not in ("f1", "youden", "sensitivity"):
        raise ValueError(f"unknown criterion {criterion}")
    c = _curve(scored, by)
    span = c.groupBy(*by).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    point = lambda i: F.col("lo") + i * ((F.col("hi") - F.col("lo")) / (grid - 1))
    cell = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("score") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / (grid - 1)))).otherwise(F.lit(0)).cast("int")
    j = c.join(broadcast_if(span, MOST_GROUPS), by) if by else c.crossJoin(F.broadcast(span))
    j = j.withColumn("i", F.least(cell, F.lit(grid - 1)))
    # the last grid point not above the score, whatever the division's rounding
    j = j.withColumn("i", F.when(point(F.col("i") + 1) <= F.col("score"), F.least(F.col("i") + 1, F.lit(grid - 1))).when(point(F.col("i")) > F.col("score"), F.col("i") - 1).otherwise(F.col("i")))
    bins = j.groupBy(*by, "i").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    steps = span.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    all_bins = steps.join(bins, [*by, "i"], "left").na.fill(0, ["pos", "neg"])
    w = Window.partitionBy(*by).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    s = all_bins.withColumns({"tp": F.sum("pos").over(w).cast("double"), "fp": F.sum("neg").over(w).cast("double")})
    s = s.withColumn("t", F.when(F.col("i") == grid - 1, F.col("hi")).otherwise(point(F.col("i"))))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("p")), F.lit(0.0))
    value = {"f1": F.coalesce(F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")), F.lit(0.0)), "youden": recall - F.coalesce(F.try_divide(F.col("fp"), F.col("n")), F.lit(0.0)), "sensitivity": recall}[criterion]
    s = s.withColumn("value", F.round(value, 12))
    if criterion == "sensitivity":
        best = s.groupBy(*by).agg(F.max(F.when(F.col("value") >= target, F.struct("t", "value"))).alias("b"), F.max("p").alias("p"), F.max("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    else:
        best = s.groupBy(*by).agg(F.max(F.struct("value", (-F.col("i")).alias("late"), "t")).alias("b"), F.max("p").alias("p"), F.max("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    one = (F.col("p") == 0) | (F.col("n") == 0)
    return best.select(*by, F.when(one, 0.5).when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.coalesce("b.t", F.lit(0.5))).alias("threshold"), F.when(~one & (F.col("lo") < F.col("hi")), F.col("b.value")).alias("value"))


def mean_std(rows: DataFrame, by: list[str], value: str, single: float | None = 0.0) -> DataFrame:
    """Mean, sample deviation (``single`` for one value) and number of the finite values."""
    v = finite(F.col(value))
    return rows.groupBy(*by).agg(F.avg(v).alias("mean"), F.when(F.count(v) == 1, F.lit(single).cast("double")).otherwise(F.stddev_samp(v)).alias("std"), F.count(v).alias("n"))
