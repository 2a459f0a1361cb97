"""Contrastive losses of batches, class and sampler weights, and augmented views."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwake.functions.layout import Layout
from fernwake.operators.ordering import positions, range_parts
from fernwake.session import Scratch, broadcast_if

LOSSES = ("supcon", "balanced", "imbalance", "focal", "simclr")


def loss_and_gradient(x: np.ndarray, y: np.ndarray, name: str, temperature: float = 0.1, base: float = 0.1, gamma: float = 2.0, minority_weight: float = 0.0, minority: int = 1) -> tuple[float, np.ndarray]:
    """Loss of one batch and its gradient by ``x``: ``x`` is rows x views x dims, ``y`` the rows' labels.

    With s the products of vectors over the temperature, an anchor's loss is the log-sum-exp of its
    s to all other vectors less the mean s to its positives (vectors of its label; for simclr its
    other views). The batch's is a weighted sum over the anchors that have a positive: supcon
    weighs them equally; balanced gives every class the same weight; imbalance weighs anchors by
    inverse class frequency over its mean (the minority's may be given); focal also by
    (1 - probability of the positives)^gamma, averaged over a row's views, which counts as a
    constant for the gradient. No anchor with a positive gives 0.
    """
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name}")
    rows, views, _ = x.shape
    u = x.reshape(rows * views, -1)
    row = np.repeat(np.arange(rows), views)
    kind = row if name == "simclr" else np.asarray(y)[row]
    s = u @ u.T / temperature
    np.fill_diagonal(s, -np.inf)
    top = s.max(1, keepdims=True)
    softmax = np.exp(s - top)
    total = softmax.sum(1, keepdims=True)
    softmax /= total
    positive = (kind[:, None] == kind[None]) & ~np.eye(len(u), dtype=bool)
    n = positive.sum(1)
    valid = n > 0
    if not valid.any():
        return 0.0, np.zeros_like(x)
    share = positive / np.maximum(n, 1)[:, None]
    mean = np.where(positive, s, 0.0).sum(1) / np.maximum(n, 1) - (top + np.log(total))[:, 0]  # mean log-probability of the positives
    weight = valid / valid.sum()
    if name == "balanced":
        classes, at = np.unique(kind[valid], return_inverse=True)
        weight = np.zeros(len(u))
        weight[valid] = 1 / (len(classes) * np.bincount(at)[at])
    if name in ("imbalance", "focal"):
        classes, at, counts = np.unique(y, return_inverse=True, return_counts=True)
        w = (1 / counts) / np.mean(1 / counts)
        if minority_weight > 0:
            w = np.where(classes == minority, minority_weight, w)
        w = w[at]
        if name == "focal":
            hard = np.where(valid, 1 - np.clip(np.exp(np.where(valid, mean, 0.0)), 0, 1), 0.0) ** gamma
            w = w * hard.reshape(rows, views).mean(1)
        weight = weight * w[row]
    weight = weight * (temperature / base)
    by_s = np.where(valid[:, None], softmax - share, 0.0) * weight[:, None]
    return float(-(weight * np.where(valid, mean, 0.0)).sum()), ((by_s + by_s.T) @ u / temperature).reshape(x.shape)


def batch_loss(x: np.ndarray, y: np.ndarray, name: str, **settings: float) -> float:
    """The loss alone, see ``loss_and_gradient``."""
    return loss_and_gradient(x, y, name, **settings)[0]


def losses(rows: DataFrame, name: str, dim: int, views: int = 1, **settings: float) -> DataFrame:
    """batch, n, loss of each ``batch`` of rows (id, batch, label, vec of views x dim numbers).

    Every pair of a batch's rows counts, so a batch is what a training step holds in memory.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, views, dim)
        return pa.table({"batch": pa.array([t["batch"][0].as_py()], pa.int64()), "n": pa.array([len(x)], pa.int64()), "loss": pa.array([batch_loss(x, t["label"].to_numpy(), name, **settings)])})

    usable = rows.select("id", F.col("batch").cast("long").alias("batch"), F.col("label").cast("int").alias("label"), F.col("vec").cast("array<double>").alias("vec")).dropna().where(F.size("vec") == views * dim)
    return usable.groupBy("batch").applyInArrow(run, "batch long, n long, loss double")


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Inverse frequency of each class over its mean over classes."""
    inv = rows.groupBy(label).agg((1 / F.count(F.lit(1))).alias("w"))
    return inv.crossJoin(F.broadcast(inv.agg(F.avg("w").alias("_m")))).select(label, (F.col("w") / F.col("_m")).alias("weight"))


def sampler_weights(rows: DataFrame, boost: float, minority: int = 1, label: str = "label") -> DataFrame:
    """A row's chance to be drawn, by class: inverse frequency, the minority's times ``boost``, summing to 1 over rows."""
    c = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("w", F.when(F.col(label) == minority, boost).otherwise(1.0) / F.col("n"))
    total = c.agg(F.sum(F.col("w") * F.col("n")).alias("_t"))
    return c.crossJoin(F.broadcast(total)).select(label, "n", (F.col("w") / F.col("_t")).alias("weight"))


def chance(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the md5 of the parts, the same in any engine: its first 13 hexadecimal digits."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def balanced_batch(rows: DataFrame, size: int, positive_fraction: float, seed: int, label: str = "label") -> DataFrame:
    """``size`` draws with replacement, of label 1 with the given chance: draw, id, label.

    A draw's class and its place among the class's rows by id come from hashes of its number, so
    they don't depend on partitioning. Places are counted over ranges, so no class is one task's.
    Rows without id or label are never drawn.
    """
    known = rows.select("id", label).dropna().withColumn("k", (F.col(label) == 1).cast("int"))
    n = {r["k"]: r["count"] for r in known.groupBy("k").count().collect()}  # one row a class
    if not n.get(1) or not n.get(0):
        raise ValueError("both classes are needed")
    numbered = positions(range_parts(known, "k", ["id"], Scratch(rows.sparkSession, "batch"), "rows"), "k", ["id"])
    draws = rows.sparkSession.range(size).withColumn("k", (chance(F.col("id"), seed, "class") < positive_fraction).cast("int"))
    draws = draws.select(F.col("id").alias("draw"), "k", F.floor(chance(F.col("id"), seed, "row") * F.when(F.col("k") == 1, n[1]).otherwise(n[0])).cast("long").alias("pos"))
    return broadcast_if(draws, 1_000_000).join(numbered, ["k", "pos"]).select("draw", "id", label)


@dataclass(frozen=True)
class Views:
    """Chances and sizes of the augmentation, in its order: noise, amplitude, whole channels, whole bands, a span of steps."""

    n: int = 2
    noise: float = 0.05
    noise_chance: float = 0.5
    scale: float = 0.1
    scale_chance: float = 0.5
    channels: int = 4
    channels_chance: float = 0.5
    bands: int = 1
    bands_chance: float = 0.3
    span: float = 0.2
    span_chance: float = 0.3

    def __post_init__(self) -> None:
        if self.n < 2:
            raise ValueError("contrastive training needs two views or more")
        if not all(0 <= c <= 1 for c in (self.noise_chance, self.scale_chance, self.channels_chance, self.bands_chance, self.span_chance)):
            raise ValueError("chances must be between 0 and 1")

    def most(self, groups: int, bands: bool) -> int:
        """How many groups may be masked; one channel at least stays where there are several."""
        return min(self.bands, groups) if bands else min(self.channels, max(groups - 1, 1)) if groups else 0


def augmented(rows: DataFrame, layout: Layout, views: Views = Views(), steps: int = 1, seed: int = 7) -> DataFrame:
    """``views.n`` augmented copies of each row (id, vec of steps x features): id, view, vec.

    Each of the five steps is left out with its own chance. Noise is Gaussian, the amplitude one
    factor a view; channels and bands are one up to the allowed number of different groups, set to
    0; of a sequence, a span of up to ``span`` of its steps is set to 0. All is drawn from hashes
    of (id, view), so a view is the same however rows are partitioned.
    """
    width = len(layout.columns)
    u = lambda *salt: (F.shiftrightunsigned(F.xxhash64("id", "view", *[F.lit(s) if not isinstance(s, Column) else s for s in (seed, *salt)]), 11).cast("double") + 0.5) / float(2**53)
    gauss = lambda *salt: F.sqrt(-2 * F.ln(u(*salt, 1))) * F.cos(2 * math.pi * u(*salt, 2))
    out = rows.select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(views.n - 1))).alias("view"))
    noise = F.when(u("n?") < views.noise_chance, F.lit(views.noise)).otherwise(0.0)
    gain = F.when(u("s?") < views.scale_chance, 1 + views.scale * (2 * u("s") - 1)).otherwise(1.0)
    out = out.withColumns({"_noise": noise, "_gain": gain})
    out = out.withColumn("vec", F.transform("vec", lambda x, i: (x.cast("double") + F.when(F.col("_noise") > 0, F.col("_noise") * gauss(i, "n")).otherwise(0.0)) * F.col("_gain")))
    for name, groups, odds, bands in (("c", layout.channel_groups(), views.channels_chance, False), ("b", layout.band_groups(), views.bands_chance, True)):
        most = views.most(len(groups), bands)
        if most < 1:
            continue
        drawn = F.slice(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(len(groups) - 1)), lambda g: F.struct(u(name, g).alias("u"), g.alias("g")))), F.lit(1), (F.floor(u(name, "n") * most) + 1).cast("int"))
        table = F.array(*[F.array(*map(F.lit, g)) for g in groups])
        mask = F.flatten(F.transform(drawn, lambda d: F.element_at(table, d["g"] + 1)))
        out = out.withColumn("_mask", F.when(u(name, "?") < odds, mask).otherwise(F.array().cast("array<int>")))
        out = out.withColumn("vec", F.transform("vec", lambda x, i: F.when(F.array_contains("_mask", (i % width).cast("int")), 0.0).otherwise(x)))
    if steps > 1:
        longest = max(1, round(views.span * steps))
        out = out.withColumn("_span", F.when(u("t?") < views.span_chance, F.floor(u("t", "n") * longest) + 1).otherwise(F.lit(0)))
        out = out.withColumn("_from", F.floor(u("t", "at") * (steps - F.col("_span") + 1)))
        at = lambda i: F.floor(i / width)
        out = out.withColumn("vec", F.transform("vec", lambda x, i: F.when((at(i) >= F.col("_from")) & (at(i) < F.col("_from") + F.col("_span")), 0.0).otherwise(x)))
    return out.select("id", "view", "vec")


def augment_matrix(x: np.ndarray, views: Views, layout: Layout, rng: np.random.Generator) -> np.ndarray:
    """One augmented copy of each row of a matrix of single windows, by the same steps."""
    n = len(x)
    x = x + (rng.random(n) < views.noise_chance)[:, None] * rng.normal(0, views.noise, x.shape)
    x = x * np.where(rng.random(n) < views.scale_chance, rng.uniform(1 - views.scale, 1 + views.scale, n), 1.0)[:, None]
    for groups, odds, bands in ((layout.channel_groups(), views.channels_chance, False), (layout.band_groups(), views.bands_chance, True)):
        most = views.most(len(groups), bands)
        if most < 1:
            continue
        rank = rng.random((n, len(groups))).argsort(1).argsort(1)
        hit = (rank < rng.integers(1, most + 1, n)[:, None]) & (rng.random(n) < odds)[:, None]
        for g, columns in enumerate(groups):
            x[np.ix_(hit[:, g], columns)] = 0.0
    return x
