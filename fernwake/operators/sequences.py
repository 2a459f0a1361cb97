"""Windows of consecutive rows, sliding features of event streams, and keyed logs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernwake.operators.ordering import positions, range_parts
from fernwake.session import Scratch


BLOCK = 4096  # places of a key that one task may hold


def _ahead(rows: DataFrame, key: str, order: list[str], length: int) -> tuple[DataFrame, Window]:
    """``rows`` with ``_own``, and the frame of each one and the ``length`` - 1 after it in its key.

    A key's rows are cut by their places into blocks, and each block also has the rows that its
    last frames reach into, not ``_own``; so the frames of a key that holds a large part of all
    rows are spread over tasks. ``order`` must be unique in a key. Rows without key or order have
    no place and are left out.
    """
    if length < 1:
        raise ValueError("length must be 1 or more")
    known = rows.dropna(subset=[key, *order])
    placed = positions(range_parts(known, key, order, Scratch(rows.sparkSession, "frames"), "rows"), key, order).drop("part_no")
    size = max(BLOCK, 8 * length)
    own = F.floor(F.col("pos") / size)
    before = F.floor((F.col("pos") - (length - 1)) / size)
    both = placed.withColumn("_block", F.explode(F.array_distinct(F.array(own, F.greatest(before, F.lit(0))))))
    both = both.withColumn("_own", F.col("_block") == own)
    return both, Window.partitionBy(key, "_block").orderBy("pos").rowsBetween(0, length - 1)


def sequence_windows(rows: DataFrame, key: str, order: list[str], length: int, label: Column) -> DataFrame:
    """``rows`` that start a window of ``length`` rows of one key, with the largest label in it as ``window_label``.

    Windows never cross keys; a key of fewer rows has none.
    """
    placed, ahead = _ahead(rows, key, order, length)
    out = placed.withColumns({"_n": F.count(F.lit(1)).over(ahead), "window_label": F.max(label).over(ahead)})
    return out.where(F.col("_own") & (F.col("_n") == length)).drop("_n", "_own", "_block", "pos")


def gather(rows: DataFrame, key: str, order: list[str], length: int, value: str) -> DataFrame:
    """Each window's ``values`` in order, as an array; a null is left out, and with it the windows that hold it."""
    placed, ahead = _ahead(rows, key, order, length)
    out = placed.withColumn("values", F.collect_list(value).over(ahead))
    return out.where(F.col("_own") & (F.size("values") == length)).drop("_own", "_block", "pos")


def sliding_features(events: DataFrame, key: str, time: str, value: str, size: str, step: str) -> DataFrame:
    """Mean, deviation, variance and number of the values in each sliding window of each key."""
    w = F.window(time, size, step)
    g = events.groupBy(key, w.alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.var_pop(value).alias("variance"))
    return g.select(key, F.col("w.start").alias("window_start"), "n", "mean", "std", "variance")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last row by ``version`` of each key of both tables, ties to the new one; columns that one lacks are null.

    One aggregate, of which each task keeps a row a key before the shuffle.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    kept = [c for c in both.columns if c != "_new"]
    last = F.max_by(F.struct(*kept), F.struct(F.col(version), F.col("_new")))
    return both.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(last.alias("_row")).select("_row.*")


def totals_by(log: DataFrame, group: str, value: str) -> DataFrame:
    return log.groupBy(group).agg(F.sum(value).alias("total"))


def group_codes(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Numbers from 0 of the groups in order of their first row."""
    first = rows.groupBy(group).agg(F.min(order).alias("_first"))
    return first.select(group, (F.row_number().over(Window.orderBy("_first", group)) - 1).alias("code"))  # one row a group


# The bands of a signal in Hz, and the bins of its entropy.
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)}
ENTROPY_BINS = 64


def spectrum(x: np.ndarray, rate: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power density: the mean of Hann-windowed segments that overlap by half, each without its mean."""
    n = min(segment, len(x))
    w = np.hanning(n + 1)[:-1] if n > 1 else np.ones(1)
    starts = range(0, len(x) - n + 1, max(1, n // 2))
    parts = [np.abs(np.fft.rfft((x[s : s + n] - x[s : s + n].mean()) * w)) ** 2 for s in starts]
    power = np.mean(parts, 0) / (rate * (w * w).sum())
    power[1 : (n + 1) // 2] *= 2  # one side stands for both
    return np.fft.rfftfreq(n, 1 / rate), power


def signal_features(samples: DataFrame, key: str, time: str, value: str, size: float, step: float, rate: float) -> DataFrame:
    """Features of each sliding window of each key's signal: mean, std, variance, entropy in bits of 64 bins, band powers.

    ``time`` is in seconds, windows of ``size`` begin at multiples of ``step``; ``rate`` is of
    samples a second. A band's power is the density summed over its frequencies, in segments of a
    second or the window where that is shorter. Samples that are null or not finite are left out,
    and windows without samples are absent. A window is what one task holds.
    """
    v, t = F.col(value).cast("double"), F.col(time).cast("double")
    known = samples.select(key, t.alias("_t"), v.alias("_v")).where("_t is not null and _v is not null and not isnan(_v) and abs(_v) < double('inf')")
    per = round(size / step)
    w = known.withColumn("_w", F.explode(F.sequence(F.lit(0), F.lit(per - 1)))).withColumn("_w", F.floor(F.col("_t") / step) - F.col("_w"))
    kind = samples.select(key).schema[0].dataType.simpleString()

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        x = table.sort_by([("_t", "ascending"), ("_v", "ascending")])["_v"].to_numpy()
        lo, hi = x.min(), x.max()
        bins = np.bincount(np.minimum((x - lo) / (hi - lo) * ENTROPY_BINS, ENTROPY_BINS - 1).astype(np.int64)) if hi > lo else np.array([len(x)])
        p = bins[bins > 0] / len(x)
        f, power = spectrum(x, rate, max(2, round(rate)))
        width = f[1] if len(f) > 1 else 0.0
        out = {key: table[key].slice(0, 1), "window_start": [keys[1].as_py() * step], "n": pa.array([len(x)], pa.int64()), "mean": [x.mean()], "std": [x.std()], "variance": [x.var()], "entropy": [float(-(p * np.log2(p)).sum()) + 0.0]}
        for name, (a, b) in BANDS.items():
            out[f"{name}_power"] = [float(power[(f >= a) & (f < b)].sum() * width)]
        return pa.table(out)

    schema = f"`{key}` {kind}, window_start double, n long, mean double, std double, variance double, entropy double, " + ", ".join(f"{b}_power double" for b in BANDS)
    return w.groupBy(key, "_w").applyInArrow(run, schema)
