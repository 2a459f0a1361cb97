"""Fold preparation: imputation, scaling, selection and projection, fitted on each fold's training rows and applied to both sides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernwake.functions.arrays import from_matrix, to_matrix
from fernwake.session import Scratch

SCALERS = ("standard", "robust", "none")
BIN_SHIFT = 45  # bins of a double's sign, exponent and 7 bits of fraction
BINS = 1 << (64 - BIN_SHIFT)
TINY = 1e-12
PREPARED = "test_group string, role string, id long, group string, label int, x array<float>"


@dataclass(frozen=True)
class Settings:
    """What is fitted: a scaler, how many columns by ANOVA F, how many components (or which share of the variance)."""

    scaler: str = "standard"
    select: int | None = None
    components: int | float | None = None
    impute: bool = True

    def __post_init__(self) -> None:
        if self.scaler not in SCALERS:
            raise ValueError(f"scaler must be one of {SCALERS}")
        if self.select is not None and self.select < 1 or self.components is not None and not self.components > 0:
            raise ValueError("select and components must be positive")


@dataclass
class Fits:
    """The fits of all folds: arrays of folds x columns; ``components`` is one matrix a fold."""

    groups: list[str]
    median: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    settings: Settings
    origin: np.ndarray | None = None  # means, from which components are taken
    f: np.ndarray | None = None
    selected: list[np.ndarray] = field(default_factory=list)
    components: list[np.ndarray] = field(default_factory=list)
    share: list[np.ndarray] = field(default_factory=list)
    covariance: list[np.ndarray] = field(default_factory=list)  # of the scaled selected columns

    def table(self, spark, columns: list[str]) -> DataFrame:
        """test_group, column, median, center, scale, f, selected."""
        rows = []
        for i, g in enumerate(self.groups):
            kept = set(self.selected[i].tolist())
            for c, name in enumerate(columns):
                f = None if self.f is None or not np.isfinite(self.f[i, c]) else float(self.f[i, c])
                rows.append((g, name, float(self.median[i, c]), float(self.center[i, c]), float(self.scale[i, c]), f, c in kept))
        return spark.createDataFrame(rows, "test_group string, column string, median double, center double, scale double, f double, selected boolean")

    def transform(self, i: int, x: np.ndarray) -> np.ndarray:
        """Rows as fold ``i`` sees them: imputed, scaled, selected and projected."""
        y = np.where(np.isfinite(x), x, self.median[i]) if self.settings.impute else x
        y = (y - (self.origin if self.components else self.center)[i]) / self.scale[i]
        y = y[:, self.selected[i]]
        return y @ self.components[i].T if self.components else y


def _rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("group").cast("string").alias("group"), F.col("label").cast("int").alias("label"), F.col("x").cast("array<double>").alias("x")).where("group is not null and x is not null")


def _bins(v: np.ndarray) -> np.ndarray:
    i = (v + 0.0).view(np.int64)
    return ((i ^ ((i >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))) >> BIN_SHIFT) + BINS // 2


def _batches(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[list[str], np.ndarray, pa.RecordBatch, np.ndarray]]:
    """(group names, group number of each row, batch of usable rows, matrix) of each batch."""
    for batch in batches:
        x, taken = to_matrix(batch.column(2), dim)
        batch = batch.filter(pa.array(taken))
        coded = batch.column(0).dictionary_encode()
        yield coded.dictionary.to_pylist(), np.asarray(coded.indices), batch, x.astype(np.float64)


def _histogram(rows: DataFrame, dim: int, chosen: np.ndarray | None) -> DataFrame:
    """group, col, bin, n of the finite values; with ``chosen`` (col * BINS + bin) also by value, of these bins only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, group, _, x in _batches(batches, dim):
            r, c = np.nonzero(np.isfinite(x))
            v = x[r, c] + 0.0
            at = c * BINS + _bins(v)
            if chosen is not None:
                hit = np.isin(at, chosen)
                r, at, v = r[hit], at[hit], v[hit]
            key = group[r].astype(np.int64) * (dim * BINS) + at
            if chosen is None:
                key, n = np.unique(key, return_counts=True)
                value = np.zeros(len(key))
            else:
                order = np.lexsort((v, key))
                key, v = key[order], v[order]
                first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (v[1:] != v[:-1])]) if len(key) else np.zeros(0, np.int64)
                n, key, value = np.diff(np.r_[first, len(key)]), key[first], v[first]
            g, at = key // (dim * BINS), key % (dim * BINS)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(g)), pa.array((at // BINS).astype(np.int32)), pa.array((at % BINS).astype(np.int32)), pa.array(value), pa.array(n.astype(np.int64))], ["group", "col", "bin", "value", "n"])

    got = rows.mapInArrow(run, "group string, col int, bin int, value double, n long")
    return got.groupBy("group", "col", "bin", "value").agg(F.sum("n").alias("n"))


def _of_folds(counts: DataFrame, folds: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each fold's training rows: those of all groups less its own."""
    own = counts.select(F.col("group").alias("test_group"), *keys, F.col("n").alias("own"))
    every = counts.groupBy(*keys).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(folds))  # one row a fold
    left = every.join(own, ["test_group", *keys], "left").withColumn("n", F.col("n") - F.coalesce("own", F.lit(0)))
    return left.where("n > 0").drop("own")


def order_statistics(rows: DataFrame, dim: int, hist: DataFrame, groups: list[str], wanted: np.ndarray, scratch: Scratch) -> np.ndarray:
    """The values of ``wanted`` ranks (folds x columns x ranks; -1 for none) among each fold's training rows.

    A radix selection: ``hist`` tells in which bin a rank lies, and one pass over the rows counts
    the distinct values of those bins by group. Nothing is sorted as a whole and no column is
    gathered.
    """
    spark = rows.sparkSession
    f, c, k = np.nonzero(wanted >= 0)
    ask = pa.table({"test_group": pa.array([groups[i] for i in f], pa.string()), "col": pa.array(c.astype(np.int32)), "k": pa.array(k.astype(np.int32)), "rank": pa.array(wanted[f, c, k].astype(np.int64))})
    out = np.full(wanted.shape, np.nan)
    if not len(f):
        return out
    folds = spark.createDataFrame([(g,) for g in groups], "test_group string")
    upto = Window.partitionBy("test_group", "col").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = _of_folds(hist, folds, ["col", "bin"]).withColumn("upto", F.sum("n").over(upto))
    met = bins.join(spark.createDataFrame(ask), ["test_group", "col"]).where("upto - n <= rank and rank < upto")
    met = scratch.keep(met.select("test_group", "col", "k", "bin", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank")), "bins")
    picked = met.select("col", "bin").distinct().toArrow()  # at most one a fold, column and rank
    chosen = np.unique(picked["col"].to_numpy().astype(np.int64) * BINS + picked["bin"].to_numpy())
    values = scratch.keep(_histogram(rows, dim, chosen), "values")
    upto = Window.partitionBy("test_group", "col", "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = _of_folds(values, folds, ["col", "bin", "value"]).withColumn("upto", F.sum("n").over(upto))
    got = ranked.join(met, ["test_group", "col", "bin"]).where("upto - n <= rank and rank < upto").select("test_group", "col", "k", "value").toArrow()
    place = {g: i for i, g in enumerate(groups)}
    out[[place[g] for g in got["test_group"].to_pylist()], got["col"].to_numpy(), got["k"].to_numpy()] = got["value"].to_numpy()
    return out


def _medians(rows, dim, hist, groups, n: np.ndarray, scratch) -> np.ndarray:
    """Median of each fold's finite training values; 0 where there are none."""
    ranks = np.where(n[..., None] > 0, np.stack([(n - 1) // 2, n // 2], -1), -1)
    return np.nan_to_num(order_statistics(rows, dim, hist, groups, ranks, scratch).mean(2), nan=0.0)


def _quantiles(rows, dim, hist, groups, n, missing, median, qs, scratch) -> np.ndarray:
    """Linear quantiles (folds x columns x qs) of the training values with ``missing`` copies of the median put in.

    The r-th of the values with the copies is the r-th finite one if that is below the median, the
    (r - missing)-th if that is above it, and else the median.
    """
    h = np.maximum(n + missing - 1, 0)[..., None] * np.array(qs)
    r = np.stack([np.floor(h), np.ceil(h)], -1).astype(np.int64)  # folds x columns x qs x 2
    late = r - missing[..., None, None]
    fits = lambda a: np.where((a >= 0) & (a < n[..., None, None]), a, -1)
    ask = np.stack([fits(r), fits(late)], -1)
    got = order_statistics(rows, dim, hist, groups, ask.reshape(*n.shape, 4 * len(qs)), scratch).reshape(ask.shape)
    mid = median[..., None, None]
    with np.errstate(invalid="ignore"):
        v = np.where(got[..., 0] < mid, got[..., 0], np.where(got[..., 1] > mid, got[..., 1], mid))
    return v[..., 0] + (h - np.floor(h)) * (v[..., 1] - v[..., 0])


def _moments(rows: DataFrame, dim: int, shift: np.ndarray, groups: list[str]) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Classes, rows (group x class), and sums (group x class x column x 3) of 1, x - shift and its square over finite values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, group, batch, x in _batches(batches, dim):
            label = batch.column(1).to_pylist()
            kinds = {k: i for i, k in enumerate(dict.fromkeys(zip(group.tolist(), label)))}
            at = np.array([kinds[k] for k in zip(group.tolist(), label)], np.int64)
            good = np.isfinite(x)
            d = np.where(good, x - shift, 0.0)
            sums = np.zeros((len(kinds), 3, dim))
            for j, m in enumerate((good.astype(float), d, d * d)):
                np.add.at(sums[:, j], at, m)
            yield pa.RecordBatch.from_arrays([pa.array([names[g] for g, _ in kinds], pa.string()), pa.array([k for _, k in kinds], pa.int32()), pa.array(np.bincount(at, minlength=len(kinds)).astype(np.int64)), from_matrix(sums.reshape(len(kinds), -1), pa.float64())], ["group", "label", "rows", "sums"])

    parts = rows.mapInArrow(run, "group string, label int, rows long, sums array<double>").select("group", "label", "rows", F.posexplode("sums").alias("i", "s"))
    got = parts.groupBy("group", "label", "i").agg(F.sum("rows").alias("rows"), F.sum("s").alias("s")).toArrow()  # a row a group, class and column
    classes = sorted({k for k in got["label"].to_pylist()}, key=lambda k: (k is None, k))
    place, kind = {g: i for i, g in enumerate(groups)}, {k: i for i, k in enumerate(classes)}
    n, sums = np.zeros((len(groups), len(classes))), np.zeros((len(groups), len(classes), 3 * dim))
    g, k = [place[x] for x in got["group"].to_pylist()], [kind[x] for x in got["label"].to_pylist()]
    sums[g, k, got["i"].to_numpy()] = got["s"].to_numpy()
    n[g, k] = got["rows"].to_numpy()
    return classes, n, sums.reshape(len(groups), len(classes), 3, dim).swapaxes(2, 3)


def _cross(rows: DataFrame, dim: int, shift: np.ndarray, groups: list[str]) -> np.ndarray:
    """Products (group x 3 x column x column) of shifted values: both finite, the first missing (the second's sum), both missing (count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for names, group, _, x in _batches(batches, dim):
            good = np.isfinite(x)
            d, gone = np.where(good, x - shift, 0.0), (~good).astype(float)
            for i, name in enumerate(names):
                a, b = d[group == i], gone[group == i]
                held[name] = held.get(name, 0) + np.stack([a.T @ a, b.T @ a, b.T @ b])
        for name, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([m.tobytes()], pa.binary())], ["group", "m"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float64) for b in t["m"].to_pylist())
        return pa.table({"group": t["group"].slice(0, 1), "m": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((len(groups), 3, dim, dim))
    for r in rows.mapInArrow(run, "group string, m binary").groupBy("group").applyInArrow(add, "group string, m binary").collect():  # a row a group
        out[groups.index(r["group"])] = np.frombuffer(r["m"], np.float64).reshape(3, dim, dim)
    return out


def _others(a: np.ndarray) -> np.ndarray:
    """For each fold the sum over all other groups, added up and not subtracted."""
    return np.stack([np.delete(a, i, 0).sum(0) for i in range(len(a))]) if len(a) else a


def fit_folds(rows: DataFrame, dim: int, settings: Settings = Settings()) -> Fits:
    """What each leave-one-group-out fold fits on its training rows, of all folds at once.

    ``rows`` has group, label and ``x`` of ``dim`` entries. In this order: medians over finite
    values (0 where a column has none), imputation, centers and scales of the imputed values
    (standard: mean and population deviation; robust: median and interquartile range; a scale of
    nothing is 1), the ``select`` columns of largest F between the classes (ties: the first column;
    a column without variance last), and the components of the selected columns' covariance, each
    with its largest loading positive.

    No statistic is computed once a fold. Counts, moments and products are taken by group and
    added up over the other groups; medians and quantiles are selected from counts. Four passes
    over the rows suffice (one of the groups alone), six with robust scaling and a projection. The driver holds numbers a
    group, class and column, and with ``components`` three matrices a group. Rows without group, or whose ``x`` is null or of
    another length, are in no fold. Without imputation the statistics are of the finite values.
    """
    scratch = Scratch(rows.sparkSession, "preparation")
    base = _rows(rows)
    groups = [r[0] for r in base.select("group").distinct().orderBy("group").collect()]
    hist = scratch.keep(_histogram(base, dim, None), "histogram")
    n = np.zeros((len(groups), dim), np.int64)
    got = hist.groupBy("group", "col").agg(F.sum("n").alias("n")).toArrow()
    n[[groups.index(g) for g in got["group"].to_pylist()], got["col"].to_numpy()] = got["n"].to_numpy()
    finite = _others(n)
    median = _medians(base, dim, hist, groups, finite, scratch)
    shift = median.mean(0) if len(groups) else np.zeros(dim)
    classes, sizes, sums = _moments(base, dim, shift, groups)
    size, total = _others(sizes), _others(sums)  # folds x classes (x columns x 3)
    gone = size[..., None] - total[..., 0] if settings.impute else np.zeros_like(total[..., 0])
    put = (median - shift)[:, None]
    number, first, second = total[..., 0] + gone, total[..., 1] + gone * put, total[..., 2] + gone * put * put
    many = np.maximum(number.sum(1), 1)
    mean = first.sum(1) / many
    std = np.sqrt(np.maximum(second.sum(1) / many - mean * mean, 0))
    center, scale = shift + mean, np.where(std <= TINY * np.maximum(1, np.abs(shift + mean)), 1.0, std)
    if settings.scaler == "robust":
        q = _quantiles(base, dim, hist, groups, finite, np.rint(gone.sum(1)).astype(np.int64), median, (0.25, 0.5, 0.75), scratch)
        width = q[..., 2] - q[..., 0]
        center, scale = q[..., 1], np.where(width <= TINY * np.maximum(1, np.abs(q[..., 1])), 1.0, width)
    elif settings.scaler == "none":
        center, scale = np.zeros_like(center), np.ones_like(scale)
    fits = Fits(groups, median, center, scale, settings, selected=[np.arange(dim)] * len(groups))
    if settings.select is not None:
        known = np.array([k is not None for k in classes], bool)
        fits.f = _f_statistic(number[:, known], first[:, known], second[:, known])
        rank = np.where(np.isnan(fits.f), -np.inf, fits.f)
        fits.selected = [np.sort(np.lexsort((np.arange(dim), -r))[: settings.select]) for r in rank]
    if settings.components is not None:
        cross = _others(_cross(base, dim, shift, groups))
        for i, kept in enumerate(fits.selected):
            d = (median[i] - shift) if settings.impute else np.zeros(dim)
            both, one, none = cross[i]
            product = both + d[:, None] * one + (d[:, None] * one).T + np.outer(d, d) * none
            cov = (product - many[i][:, None] * np.outer(mean[i], mean[i])) / np.maximum(many[i] - 1, 1)[:, None]
            fits.covariance.append((cov / np.outer(scale[i], scale[i]))[np.ix_(kept, kept)])
            v, share = _components(fits.covariance[-1], settings.components)
            fits.components.append(v)
            fits.share.append(share)
        fits.origin = shift + mean
    return fits


def _f_statistic(n: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One-way F of each fold's columns, from the classes' numbers, sums and sums of squares (folds x classes x columns)."""
    all_n, classes = n.sum(1), (n > 0).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        m = np.where(n > 0, first / n, 0.0)
        grand = first.sum(1) / all_n
        between = (n * (m - grand[:, None]) ** 2).sum(1) / (classes - 1)
        inside = np.maximum(second - n * m * m, 0).sum(1)
        within = np.where(inside <= TINY * np.maximum(second.sum(1), 1e-300), 0.0, inside) / (all_n - classes)
        return np.where((between <= TINY) & (within == 0), np.nan, between / within)


def _components(cov: np.ndarray, wanted: int | float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of loadings by falling variance, and their shares of it; a fraction takes the fewest that reach it."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    share = values / max(values.sum(), 1e-300)
    n = min(int(wanted), len(share)) if wanted >= 1 else min(int(np.searchsorted(np.cumsum(share), wanted)) + 1, len(share))
    top = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)]
    return (vectors * np.where(top < 0, -1, 1)[:, None])[:n], share[:n]


def apply_folds(rows: DataFrame, fits: Fits, only: list[str] | None = None) -> DataFrame:
    """Each row once for each fold: test_group, role (train or test), id, group, label, x as the fold sees it.

    A fold's test rows are those of its group. ``only`` restricts the folds. Rows that no fold
    could be fitted on (see ``fit_folds``) come out nowhere.
    """
    shared = rows.sparkSession.sparkContext.broadcast(fits)  # numbers a fold and column
    dim = fits.median.shape[1]
    places = [i for i, g in enumerate(fits.groups) if only is None or g in only]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, taken = to_matrix(batch.column(3), dim)
            kept = batch.filter(pa.array(taken))
            x, group = x.astype(np.float64), np.array(kept.column(1).to_pylist(), object)
            for i in places:
                g = shared.value.groups[i]
                role = pa.array(np.where(group == g, "test", "train"), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(x), pa.string()), role, kept.column(0), kept.column(1), kept.column(2), from_matrix(shared.value.transform(i, x))], ["test_group", "role", "id", "group", "label", "x"])

    base = rows.select(F.col("id").cast("long").alias("id"), F.col("group").cast("string").alias("group"), F.col("label").cast("int").alias("label"), F.col("x").cast("array<double>").alias("x")).where("group is not null and x is not null")
    return base.mapInArrow(run, PREPARED)


def prepare_folds(rows: DataFrame, dim: int, settings: Settings = Settings(), only: list[str] | None = None) -> DataFrame:
    """``apply_folds`` of ``fit_folds``."""
    return apply_folds(rows, fit_folds(rows, dim, settings), only)


def assert_disjoint(train: DataFrame, test: DataFrame, key: str = "id") -> None:
    """ValueError if a row of ``test`` is also one of ``train``."""
    both = train.select(key).join(test.select(key), key, "left_semi").limit(1).count()
    if both:
        raise ValueError(f"training and test rows share a {key}")
