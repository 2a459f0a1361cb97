"""Implausible readings: spikes and level shifts against a source's autoregression, held values, physical limits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernwake.functions.arrays import from_matrix, to_matrix
from fernwake.session import Scratch, broadcast_if, partitions

MAD_SD = 1.4826  # of a normal distribution
KINDS = ("spike", "level_shift", "stuck", "limit")
CLIP, AR_MOST, SHIFT_ROWS = 2.5, 0.95, 4
HALO = 8
BLOCK_ROWS = 256
OPEN_ROWS = 40_000  # a source of more rows in one range is fitted over all ranges
UNIT = 2.0**20  # sums are of whole multiples of 1 / UNIT, so that they don't depend on the order of adding
BIN_SHIFT = 45  # bins of a double's sign, exponent and 7 bits of fraction: 16 bits of a float32
MOST_BROADCAST = 20_000  # sources' fits, of 3 doubles a position

NO_SOURCE = "\uffff"

FLAGS = "row_id long, pos int, kind string, score double, far boolean"
BLOCKS = "src string, key string, part int, edge int, lo int, hi int, t double, rid array<long>, x array<float>"
AT_START, AT_END = 1, 2  # a block at its range's start or end, whose key may go on in the next range
ROWS = f"what string, {FLAGS}, {BLOCKS}"


@dataclass(frozen=True)
class Tests:
    """Thresholds of the tests.

    ``far`` is in robust standard deviations from the source's median. ``outlier`` is the
    additive-outlier test's, in standard deviations of the residual. A residual is
    z - phi * (z before, clipped to 2.5) with |phi| <= 0.95, so where |z| > far it is above
    far - 2.4: with ``outlier`` at most that, no reading far from its source's median escapes the
    test.
    """

    far: float = 6.5
    outlier: float = 4.0
    hold_rows: int = 8
    hold_span: float = 0.002
    low: tuple[float, ...] = ()
    high: tuple[float, ...] = ()


def limits(layout: DataFrame) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Lowest and highest possible reading of each position: Std, Variance and Power from 0, Entropy 0 to 6.

    ``layout`` is a dimension table of one row a position; a position without a row has no limits.
    """
    rows = layout.select("pos", "feature_type").where("pos is not null").collect()
    dim = max((r["pos"] for r in rows), default=-1) + 1
    low, high = [-np.inf] * dim, [np.inf] * dim
    for r in rows:
        kind = (r["feature_type"] or "").lower()
        if kind.endswith(("std", "variance", "power", "entropy")):
            low[r["pos"]] = 0.0
        if kind.endswith("entropy"):
            high[r["pos"]] = 6.0
    return tuple(low), tuple(high)


# ---- one stretch of rows -------------------------------------------------------------------------


def _z(x: np.ndarray, mid: np.ndarray, mad: np.ndarray) -> np.ndarray:
    dev, sd = x - mid, MAD_SD * mad
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.where(sd > 0, dev / sd, np.where(dev == 0, 0.0, np.copysign(np.inf, dev)))
    z[~np.isfinite(x)] = np.nan
    return z


def _lagged(z: np.ndarray, seg: np.ndarray) -> np.ndarray:
    out = np.zeros_like(z)
    before = np.clip(np.nan_to_num(z[:-1], nan=0.0, posinf=CLIP, neginf=-CLIP), -CLIP, CLIP)
    out[1:] = np.where((seg[1:] == seg[:-1])[:, None], before, 0)
    return out


def _whole(v: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(np.nan_to_num(v, nan=0.0, posinf=CLIP, neginf=-CLIP), -CLIP * CLIP, CLIP * CLIP) * UNIT).astype(np.int64)


def lag_sums(x: np.ndarray, seg: np.ndarray, mid: np.ndarray, mad: np.ndarray, phi: np.ndarray, tests: Tests, lo: int = 0, hi: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sums for the lag-one coefficient over the rows between the first ``lo`` and the last ``hi``: of products, and of squares, of clipped values.

    With a ``phi`` from an earlier round, readings that fail the outlier test are replaced by what
    it predicts first. A row's terms depend on the three rows before it.
    """
    z = _z(x, mid, mad)
    lag = _lagged(z, seg)
    with np.errstate(invalid="ignore"):
        out = np.abs(z - phi * lag) > tests.outlier * np.sqrt(1 - phi * phi)
    clean = np.where(out & (phi != 0), phi * lag, z)
    lag, now = _lagged(clean, seg), np.clip(np.nan_to_num(clean, nan=0.0, posinf=CLIP, neginf=-CLIP), -CLIP, CLIP)
    core = slice(lo, len(x) - hi)
    return _whole(now * lag)[core].sum(0), _whole(lag * lag)[core].sum(0)


def coefficient(products: np.ndarray, squares: np.ndarray) -> np.ndarray:
    return np.clip(np.where(squares > 0, products / np.where(squares > 0, squares, 1), 0), -AR_MOST, AR_MOST)


def _hold(x: np.ndarray, seg: np.ndarray, tests: Tests) -> np.ndarray:
    """Members of a stretch of ``hold_rows`` rows of one segment, all within ``hold_span``."""
    n, w = len(x), tests.hold_rows
    held = np.zeros(x.shape, bool)
    if n < w:
        return held
    top, low, have = x, x, 1
    while have < w:  # widths grow by doubling
        step = min(have, w - have)
        top, low, have = np.maximum(top[:-step], top[step:]), np.minimum(low[:-step], low[step:]), have + step
    with np.errstate(invalid="ignore"):
        start = (top - low <= tests.hold_span) & (seg[w - 1 :] == seg[: n - w + 1])[:, None]
    for i in range(w):
        held[i : i + len(start)] |= start
    return held


def detect(x: np.ndarray, seg: np.ndarray, mid: np.ndarray, mad: np.ndarray, phi: np.ndarray, tests: Tests) -> tuple[np.ndarray, ...]:
    """(row, position, kind, score, far) of the readings of consecutive rows that fail a test.

    Two rounds of the additive-outlier test, the second against values cleaned by the first. An
    outlier where the clipped means of four rows from it and four before it differ is the start of
    a level shift, not a spike. The score of both is the robust z; of the others the reading.
    """
    x = x.astype(np.float64)
    z = _z(x, mid, mad)
    sd = np.sqrt(1 - phi * phi)
    lag = _lagged(z, seg)
    with np.errstate(invalid="ignore"):
        out = np.abs(z - phi * lag) > tests.outlier * sd
        lag = _lagged(np.where(out, phi * lag, z), seg)
        out |= np.abs(z - phi * lag) > tests.outlier * sd
        far = np.abs(x - mid) > tests.far * MAD_SD * mad
    far &= np.isfinite(x)
    shift = np.zeros(x.shape, bool)
    h = SHIFT_ROWS
    if len(x) >= 2 * h:
        c = np.vstack([np.zeros((1, x.shape[1]), np.int64), np.cumsum(_whole(np.clip(z, -CLIP, CLIP)), 0)])
        after, before = (c[2 * h :] - c[h:-h]) / (h * UNIT), (c[h:-h] - c[: -2 * h]) / (h * UNIT)
        whole = (seg[2 * h - 1 :] == seg[: len(seg) - 2 * h + 1])[:, None]
        shift[h : len(x) - h + 1] = (np.abs(after - before) > tests.outlier * np.sqrt(2 / h)) & whole
    low, high = np.array(tests.low or [-np.inf] * x.shape[1]), np.array(tests.high or [np.inf] * x.shape[1])
    finite = np.isfinite(x)
    parts = []
    for code, hit, score in ((0, out & ~shift, z), (1, out & shift, z), (2, _hold(x, seg, tests), x), (3, finite & ((x < low) | (x > high)), x)):
        r, p = np.nonzero(hit)
        parts.append((r, p, np.full(len(r), code), score[r, p], far[r, p]))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _mid_and_mad(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = np.where(np.isfinite(x), x, np.nan).astype(np.float64)
    empty = ~np.isfinite(y).any(0)
    y[:, empty] = 0.0
    whole = not np.isnan(y).any()
    mid = np.median(y, 0) if whole else np.nanmedian(y, 0)
    dev = np.abs(y - mid)
    mad = np.median(dev, 0) if whole else np.nanmedian(dev, 0)
    mid[empty] = mad[empty] = np.nan
    return mid, mad


def _flag_batch(what: str, ids: np.ndarray, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    r, p, k, score, far = found
    n = len(r)
    names = pa.DictionaryArray.from_arrays(pa.array(k.astype(np.int32)), pa.array(KINDS)).cast(pa.string())
    cols = [pa.array(ids[r], pa.int64()), pa.array(p.astype(np.int32)), names, pa.array(score, pa.float64()), pa.array(far)]
    fields = ["row_id", "pos", "kind", "score", "far"]
    if not what:
        return pa.RecordBatch.from_arrays(cols, fields)
    return _filled({"what": pa.array([what] * n, pa.string()), **dict(zip(fields, cols))}, n)


_ARROW = pa.schema([("what", pa.string()), ("row_id", pa.int64()), ("pos", pa.int32()), ("kind", pa.string()), ("score", pa.float64()), ("far", pa.bool_()), ("src", pa.string()), ("key", pa.string()), ("part", pa.int32()), ("edge", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("t", pa.float64()), ("rid", pa.list_(pa.int64())), ("x", pa.list_(pa.float32()))])


def _filled(given: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in _ARROW], schema=_ARROW)


# ---- the first pass: one sorted range ------------------------------------------------------------


class _Range:
    """One range of rows sorted by source, key and time, as it streams by.

    A source that begins and ends inside the range is fitted and tested here. The first and last
    source of a range may go on in another one, and a source of more than ``OPEN_ROWS`` rows is
    not held in memory: these are open, and leave as blocks of rows with the eight rows of their
    key on each side, to be fitted over all ranges. Both ways give the same fits and flags. Blocks
    at the range's start and end lack rows that lie in other ranges; the range's first rows of its
    first key and last rows of its last key leave as edges, from which ``_with_halos`` gives each
    such block what it lacks.
    """

    def __init__(self, part: int, dim: int, tests: Tests, open_rows: int) -> None:
        self.part, self.dim, self.tests, self.most = part, dim, tests, open_rows
        self.src: str | None = None
        self.first, self.open, self.context = True, False, 0
        self.head: tuple[str, str] | None = None  # source and key of the range's first row
        self.head_rows: list[tuple] = []
        self.started: tuple | None = None  # source and key of the last block that was sent
        self.clear()

    def clear(self) -> None:
        self.ids, self.keys, self.ts, self.x, self.rows = [], [], [], [], 0

    def add(self, ids: np.ndarray, keys: np.ndarray, ts: np.ndarray, x: np.ndarray) -> None:
        for held, new in ((self.ids, ids), (self.keys, keys), (self.ts, ts), (self.x, x)):
            held.append(new)
        self.rows += len(ids)

    def joined(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(c) for c in (self.ids, self.keys, self.ts, self.x))

    def take(self, src: str, ids: np.ndarray, keys: np.ndarray, ts: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.src is not None and src != self.src:
            yield from self.finish(last=False)
            self.first, self.open = False, False
        self.src = src
        if self.head is None:
            self.head = (src, keys[0])
        if self.first and len(self.head_rows) < HALO and src == self.head[0]:
            own = np.flatnonzero(keys == self.head[1])[: HALO - len(self.head_rows)]
            self.head_rows += [(src, keys[i], ids[i], ts[i], x[i]) for i in own]
        self.add(ids, keys, ts, x)
        if self.rows - self.context > self.most:
            self.open = True
            yield from self.blocks(final=False)

    def finish(self, last: bool) -> Iterator[pa.RecordBatch]:
        if self.src is None:
            return
        if self.open or self.first or last:
            if last:
                yield self.edges()
            yield from self.blocks(final=True, last=last)
        else:
            ids, keys, _, x = self.joined()
            seg = np.r_[0, np.cumsum(keys[1:] != keys[:-1])]
            y = x.astype(np.float64)
            mid, mad = _mid_and_mad(y) if self.src != NO_SOURCE else (np.full(self.dim, np.nan),) * 2
            phi = np.zeros(self.dim)
            for _ in range(2):
                phi = coefficient(*lag_sums(y, seg, mid, mad, phi, self.tests))
            yield _flag_batch("flag", ids, detect(y, seg, mid, mad, phi, self.tests))
        self.clear()
        self.context = 0

    def edges(self) -> pa.RecordBatch:
        ids, keys, ts, x = self.joined()
        own = np.flatnonzero(keys == keys[-1])[-HALO:]
        rows = {r[:3]: r for r in [*self.head_rows, *[(self.src, keys[i], ids[i], ts[i], x[i]) for i in own]]}.values()
        m = len(rows)
        src, key, ids, ts, x = zip(*rows)
        return _filled({"what": pa.array(["edge"] * m), "src": pa.array(src), "key": pa.array(key), "part": pa.array([self.part] * m, pa.int32()), "t": pa.array(np.array(ts, np.float64)), "rid": pa.array([[int(i)] for i in ids], pa.list_(pa.int64())), "x": from_matrix(np.stack(x))}, m)

    def blocks(self, final: bool, last: bool = False) -> Iterator[pa.RecordBatch]:
        ids, keys, ts, x = self.joined()
        n = len(ids)
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        out: list[tuple] = []
        sent = self.context
        for a, b in zip(np.r_[0, change], np.r_[change, n]):
            goes_on = b == n and not final
            s = max(a, self.context)
            key = keys[a]
            while s < b:
                e = min(b, s + BLOCK_ROWS)
                if goes_on and e + HALO > b:
                    break
                lo, hi = int(min(HALO, s - a)), int(min(HALO, b - e))
                edge = AT_START if (self.src, key) == self.head and self.started is None else 0
                edge += AT_END if last and b == n and hi < HALO else 0
                out.append((key, edge, lo, hi, slice(s - lo, e + hi)))
                self.started = (self.src, key)
                s = sent = e
        if out:
            yield _filled(
                {
                    "what": pa.array(["block"] * len(out)), "src": pa.array([self.src] * len(out)), "key": pa.array([o[0] for o in out]), "part": pa.array([self.part] * len(out), pa.int32()),
                    "edge": pa.array([o[1] for o in out], pa.int32()), "lo": pa.array([o[2] for o in out], pa.int32()), "hi": pa.array([o[3] for o in out], pa.int32()),
                    "rid": pa.array([ids[o[4]] for o in out], pa.list_(pa.int64())), "x": pa.array([x[o[4]].ravel() for o in out], pa.list_(pa.float32())),
                },
                len(out),
            )
        keep = max(0, sent - HALO)
        self.clear()
        self.context = 0
        if not final:
            self.add(ids[keep:], keys[keep:], ts[keep:], x[keep:])
            self.context = sent - keep


def _first_pass(dim: int, tests: Tests, open_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = _Range(TaskContext.get().partitionId(), dim, tests, open_rows)
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = np.array(batch.column(2).to_pylist(), object)
            srcs = np.array(batch.column(1).to_pylist(), object)
            ts = batch.column(3).to_numpy(zero_copy_only=False)
            x = np.full((len(ids), dim), np.nan, np.float32)
            m, taken = to_matrix(batch.column(4), dim)
            x[taken] = m
            new = np.r_[before is None or ids[0] != before, ids[1:] != ids[:-1]]  # repeated deliveries stand side by side
            before = ids[-1]
            ids, keys, srcs, ts, x = ids[new], keys[new], srcs[new], ts[new], x[new]
            cuts = np.flatnonzero(srcs[1:] != srcs[:-1]) + 1 if len(srcs) else []
            for a, b in zip(np.r_[0, cuts].astype(int), np.r_[cuts, len(srcs)].astype(int)):
                if a < b:
                    yield from state.take(srcs[a], ids[a:b], keys[a:b], ts[a:b], x[a:b])
        yield from state.finish(last=True)

    return run


# ---- open sources: fits over all ranges ----------------------------------------------------------


def _matrices(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
    """(row, ids, matrix, rows of halo before, after) of each block."""
    at = {n: i for i, n in enumerate(batch.schema.names)}
    for i in range(batch.num_rows):
        ids = batch.column(at["rid"])[i].values.to_numpy()
        x = batch.column(at["x"])[i].values.to_numpy(zero_copy_only=False).reshape(-1, dim)
        yield i, ids, x, batch.column(at["lo"])[i].as_py(), batch.column(at["hi"])[i].as_py()


def _fit_of(batch: pa.RecordBatch, name: str, i: int, dim: int, default: float = np.nan) -> np.ndarray:
    out = np.full(dim, default)
    if name in batch.schema.names:
        for p in batch.column(name)[i].as_py() or []:
            if p["v"] is not None:
                out[p["pos"]] = p["v"]
    return out


def _ordered(v: np.ndarray) -> np.ndarray:
    i = v.astype(np.float64).view(np.int64)
    return (i ^ ((i >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))) >> BIN_SHIFT


def _medians(blocks: DataFrame, dim: int, fits: DataFrame | None) -> DataFrame:
    """Exact medians (src, pos, v) of the readings, or with ``fits`` (mid) of their distances from it.

    Two passes of a radix selection. The first counts the values of each source and position in
    bins of their leading bits, and finds the bins of the two middle ranks; the second counts the
    distinct values of those bins only. Float readings have at most 65,536 values in a bin, so
    neither pass holds a source's values anywhere.
    """
    have = blocks if fits is None else blocks.join(fits, "src")

    def values(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, int]]:
        src = batch.column("src").to_pylist()
        for i, _, x, lo, hi in _matrices(batch, dim):
            core = x[lo : len(x) - hi].astype(np.float64)
            if "mid" in batch.schema.names:
                core = np.abs(core - _fit_of(batch, "mid", i, dim))
            p = np.broadcast_to(np.arange(dim), core.shape)[np.isfinite(core)]
            yield src[i], p, core[np.isfinite(core)] + 0.0, i

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: dict[tuple, int] = {}
            for src, p, v, _ in values(batch):
                keys, n = np.unique(np.stack([p, _ordered(v)]), axis=1, return_counts=True)
                for a, b, c in zip(*keys.tolist(), n.tolist()):
                    got[src, a, b] = got.get((src, a, b), 0) + c
            yield pa.RecordBatch.from_pylist([{"src": s, "pos": p, "bin": b, "n": n} for (s, p, b), n in got.items()], pa.schema([("src", pa.string()), ("pos", pa.int32()), ("bin", pa.int64()), ("n", pa.int64())]))

    bins = have.mapInArrow(count, "src string, pos int, bin long, n long").groupBy("src", "pos", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("src", "pos")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.select("*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(group).alias("total"))
    low, high = F.expr("(total - 1) div 2"), F.expr("total div 2")
    middle = ranked.where((F.col("upto") > low) & (F.col("upto") - F.col("n") <= high))
    middle = middle.select("src", "pos", "bin", (F.col("upto") - F.col("n")).alias("before"), "total")
    picked = middle.groupBy("src").agg(F.collect_list(F.struct("pos", "bin")).alias("picked"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: dict[tuple, int] = {}
            for src, p, v, i in values(batch):
                bin_ = _ordered(v)
                wanted = np.array([(w["pos"], w["bin"]) for w in batch.column("picked")[i].as_py()], np.int64)
                first = np.full((dim, 2), np.iinfo(np.int64).min)
                for a, b in wanted.tolist():
                    first[a, 0 if first[a, 0] == np.iinfo(np.int64).min else 1] = b
                hit = (bin_ == first[p, 0]) | (bin_ == first[p, 1])
                keys, n = np.unique(np.stack([p[hit].astype(np.float64), v[hit]]), axis=1, return_counts=True)
                for a, b, c in zip(*keys.tolist(), n.tolist()):
                    got[src, int(a), b] = got.get((src, int(a), b), 0) + c
            yield pa.RecordBatch.from_pylist([{"src": s, "pos": p, "v": v, "n": n} for (s, p, v), n in got.items()], pa.schema([("src", pa.string()), ("pos", pa.int32()), ("v", pa.float64()), ("n", pa.int64())]))

    few = have.join(broadcast_if(picked, MOST_BROADCAST), "src").mapInArrow(gather, "src string, pos int, v double, n long").groupBy("src", "pos", "v").agg(F.sum("n").alias("n"))
    ahead = middle.groupBy("src", "pos").agg(F.min("before").alias("before"), F.max("total").alias("total"))
    upto = Window.partitionBy("src", "pos").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = few.join(ahead, ["src", "pos"]).withColumn("upto", F.sum("n").over(upto) + F.col("before"))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    return ranked.groupBy("src", "pos").agg(((at(low) + at(high)) / 2).alias("v"))


def _packed(long: DataFrame, name: str) -> DataFrame:
    return long.groupBy("src").agg(F.collect_list(F.struct("pos", "v")).alias(name))


def _open_fits(blocks: DataFrame, dim: int, tests: Tests, scratch: Scratch) -> DataFrame:
    """One row for each open source: mid, mad and phi as arrays of (pos, v)."""

    def small(df: DataFrame, name: str) -> DataFrame:
        return broadcast_if(scratch.keep(df, name), MOST_BROADCAST)

    mid = small(_packed(_medians(blocks, dim, None), "mid"), "mid")
    mad = small(_packed(_medians(blocks, dim, mid), "mad"), "mad")
    fits = small(mid.join(mad, "src"), "fits")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, got = batch.column("src").to_pylist(), {}
            for i, _, x, lo, hi in _matrices(batch, dim):
                a, b = lag_sums(x.astype(np.float64), np.zeros(len(x), int), _fit_of(batch, "mid", i, dim), _fit_of(batch, "mad", i, dim), _fit_of(batch, "phi", i, dim, 0.0), tests, lo, hi)
                pa_, pb = got.get(src[i], (0, 0))
                got[src[i]] = (pa_ + a, pb + b)
            rows = [{"src": s, "pos": p, "a": int(a[p]), "b": int(b[p])} for s, (a, b) in got.items() for p in range(dim)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("src", pa.string()), ("pos", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]))

    base = fits
    for _ in range(2):
        got = blocks.join(fits, "src").mapInArrow(sums, "src string, pos int, a long, b long").groupBy("src", "pos").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        phi = got.select("src", "pos", F.coalesce(F.greatest(F.lit(-AR_MOST), F.least(F.lit(AR_MOST), F.try_divide(F.col("a").cast("double"), F.col("b").cast("double")))), F.lit(0.0)).alias("v"))
        fits = small(base.join(_packed(phi, "phi"), "src"), "fits")
    return fits


def _with_halos(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocks at the ranges' ends with up to eight rows of their key from the ranges before and after.

    A range's edges hold its last eight rows of a key that may go on, or all it has, and its first
    eight likewise; so the rows around a range's end in the sequence of a key's edges are those of
    the key itself. A key has at most sixteen edges a range.
    """
    e = edges.select("src", "key", "part", "t", F.struct(F.col("rid")[0].alias("id"), "x").alias("row"))
    order = Window.partitionBy("src", "key").orderBy("t", "row.id")
    e = e.withColumns(
        {
            "before": F.collect_list("row").over(order.rowsBetween(-HALO, -1)),
            "after": F.collect_list("row").over(order.rowsBetween(1, HALO)),
            "starts": F.coalesce(F.lag("part").over(order) != F.col("part"), F.lit(True)),
            "ends": F.coalesce(F.lead("part").over(order) != F.col("part"), F.lit(True)),
        }
    )
    none = F.array().cast("array<struct<id:bigint,x:array<float>>>")
    near = e.groupBy("src", "key", "part").agg(F.max(F.when(F.col("starts"), F.col("before"))).alias("before"), F.max(F.when(F.col("ends"), F.col("after"))).alias("after"))
    b = blocks.join(near, ["src", "key", "part"], "left")
    at = lambda side: (F.col("edge").bitwiseAND(side)) > 0
    b = b.withColumn("before", F.when(at(AT_START), F.coalesce("before", none)).otherwise(none))
    b = b.withColumn("after", F.when(at(AT_END), F.slice(F.coalesce("after", none), F.lit(1), HALO - F.col("hi"))).otherwise(none))
    ids = lambda c: F.transform(c, lambda r: r["id"])
    xs = lambda c: F.flatten(F.transform(c, lambda r: r["x"]))
    return b.select("src", (F.col("lo") + F.size("before")).alias("lo"), (F.col("hi") + F.size("after")).alias("hi"), F.concat(ids("before"), "rid", ids("after")).alias("rid"), F.concat(xs("before"), "x", xs("after")).alias("x"))


def implausible(df: DataFrame, row_id: str, source: str, key: str, time: str, readings: str, dim: int, tests: Tests, open_rows: int = OPEN_ROWS) -> DataFrame:
    """Readings that fail a test: row_id, pos, kind, score, far.

    ``readings`` is an array of ``dim`` readings; a source is all rows of one ``source`` at one
    position. For each, a first-order autoregression is fitted around its median, scaled by its
    median absolute deviation, with clipped values, in two rounds between which outliers are
    replaced. Residuals are then tested (see ``detect``), and runs of held values in a ``key``'s
    rows in order of (``time``, ``row_id``) and readings beyond physical limits are separate kinds.
    ``far`` tells whether a reading is further than ``tests.far`` from its source's median.

    All rows are sorted once into ranges of (source, key, time, id). Most sources lie in one range
    and are fitted as it streams by; those that don't, hot ones above all, are fitted over all
    ranges by radix selection and sums, and never gathered. The result doesn't depend on the ranges.

    Rows repeated under one id count once. Rows without id or key are left out: nothing names or
    orders them. A null source has no normal, so its readings can only be held or beyond a limit.
    Null times come first. A null array, or one of another length, is a row of missing readings,
    which ends held runs. Readings missing, NaN or infinite are never flagged. With a deviation of
    0, every reading off the median is far. An empty input gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "spikes")
    rows = df.select(F.col(row_id).cast("long").alias("rid"), F.coalesce(F.col(source), F.lit(NO_SOURCE)).alias("src"), F.col(key).cast("string").alias("key"), F.coalesce(F.col(time).cast("double"), F.lit(float("-inf"))).alias("t"), F.col(readings).cast("array<float>").alias("x")).dropna(subset=["rid", "key"])
    ranged = rows.repartitionByRange(partitions(spark), "src", "key", "t", "rid").sortWithinPartitions("src", "key", "t", "rid")
    made = scratch.keep(ranged.mapInArrow(_first_pass(dim, tests, open_rows), ROWS), "ranges")
    columns = ["row_id", "pos", "kind", "score", "far"]
    closed = made.where("what = 'flag'").select(*columns)
    sent, fields = made.where("what = 'block'"), ["src", "lo", "hi", "rid", "x"]
    across = scratch.keep(_with_halos(sent.where("edge > 0"), made.where("what = 'edge'")), "across")
    blocks = sent.where("edge = 0").select(*fields).unionByName(across)
    fits = _open_fits(blocks.where(F.col("src") != NO_SOURCE), dim, tests, scratch)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ids, x, lo, hi in _matrices(batch, dim):
                found = detect(x, np.zeros(len(x), int), _fit_of(batch, "mid", i, dim), _fit_of(batch, "mad", i, dim), _fit_of(batch, "phi", i, dim, 0.0), tests)
                core = (found[0] >= lo) & (found[0] < len(x) - hi)
                yield _flag_batch("", ids, tuple(c[core] for c in found))

    return closed.unionByName(blocks.join(fits, "src", "left").mapInArrow(test, FLAGS))
