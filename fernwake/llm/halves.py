"""Pairs of vectors within a radius where cells keep too little apart: trees over both halves, blocks read from files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwake.functions.arrays import from_matrix, to_matrix
from fernwake.session import Scratch, partitions

PER_LEAF = 2048  # wanted vectors a leaf
SAMPLED = 8  # sampled rows a leaf, at least
UNITS = 32  # files of a half, unless they get too small or too large
LEAST_UNIT, MOST_UNIT = 8192, 65_536  # vectors of a file
AT_ONCE = 1 << 20  # pairs held at a time
SLACK = 1.001  # on squared bounds, for single precision
ROUNDING = 4e-6  # likewise, of the squared lengths
TASK_BYTES = 16 << 20  # wanted size of a task's share when the files are written

PLACED = "part int, unit int, leaf int, id long, asked boolean, vec array<float>"
FOUND = "query_id long, neighbour_id long, distance double"


class Tree:
    """A k-d tree of boxes, halved at the sample's medians along the widest axis; leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        dim, self.depth, self.inner = sample.shape[1], depth, 2**depth - 1
        self.axis, self.value = np.zeros(self.inner, np.int64), np.zeros(self.inner, np.float32)
        self.lo, self.hi = np.full((2 * self.inner + 1, dim), -np.inf), np.full((2 * self.inner + 1, dim), np.inf)
        self.middle = np.median(sample, axis=0).astype(np.float32) if len(sample) else np.zeros(dim, np.float32)
        held = [sample] + [sample[:0]] * (2 * self.inner)
        for node in range(self.inner):
            x, left, right = held[node], 2 * node + 1, 2 * node + 2
            if len(x):
                low, high = np.quantile(x, [0.05, 0.95], axis=0)
                self.axis[node] = (high - low).argmax()
                self.value[node] = np.median(x[:, self.axis[node]])
            j, v = self.axis[node], self.value[node]
            beyond = x[:, j] > v
            held[left], held[right], held[node] = x[~beyond], x[beyond], x[:0]
            self.lo[[left, right]], self.hi[[left, right]] = self.lo[node], self.hi[node]
            self.hi[left, j], self.lo[right, j] = min(self.hi[node, j], v), max(self.lo[node, j], v)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node, row = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.axis[node]] > self.value[node])
        return node - self.inner

    def reach(self, x: np.ndarray, limit: float, first: int, last: int) -> dict[int, np.ndarray]:
        """Of each leaf from ``first`` to ``last``, the rows of ``x`` whose squared distance to its box is at most ``limit``."""
        columns, out = np.ascontiguousarray(x.T, np.float64), {}
        todo = [(0, self.depth, np.arange(len(x)), np.zeros(len(x)))]
        while todo:
            node, below, rows, apart = todo.pop()
            if not below:
                out[node - self.inner] = rows
                continue
            j = self.axis[node]
            v = columns[j][rows]
            rest = apart - self._gap(node, j, v)
            for child in (2 * node + 1, 2 * node + 2):
                at = ((child + 1) << (below - 1)) - 1 - self.inner  # its first leaf
                if at > last or at + (1 << (below - 1)) <= first:
                    continue
                now = rest + self._gap(child, j, v)
                near = now <= limit
                if near.any():
                    todo.append((child, below - 1, rows[near], now[near]))
        return out

    def _gap(self, node: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(self.lo[node, j] - v, v - self.hi[node, j]), 0) ** 2


def units_of(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Each leaf's first unit and number of units, and the first and last leaf of each unit: neighbouring leaves share one, a leaf of more than ``size`` rows has several."""
    first, times, spans, held = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // size)), [], size + 1
    for leaf, c in enumerate(counts.tolist()):
        if held + c > size:
            first[leaf], held = len(spans), c
            spans += [(leaf, leaf)] * int(times[leaf])
        else:
            first[leaf], held = len(spans) - 1, held + c
            spans[-1] = (spans[-1][0], leaf)
    return first, times, spans


class _Unit:
    """The rows of one file, in order of their leaves, and what products of their halves take."""

    def __init__(self, folder: str, part: int, unit: int, span: tuple[int, int], cut: slice, middle: np.ndarray, dim: int) -> None:
        import pyarrow.parquet as pq
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(folder)
        files = where.get_file_info(fs.FileSelector(f"{path}/part={part}/unit={unit}", allow_not_found=True))
        tables = [pq.ParquetFile(where.open_input_file(f.path)).read(["leaf", "id", "asked", "vec"]) for f in sorted(files, key=lambda f: f.path) if f.path.endswith(".parquet")]
        t = pa.concat_tables(tables) if tables else pa.table({"leaf": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "asked": pa.array([], pa.bool_()), "vec": pa.array([], pa.list_(pa.float32()))})
        ids, once = np.unique(t["id"].to_numpy(), return_index=True)  # repeated deliveries of one id
        leaf = t["leaf"].to_numpy()[once]
        order = np.argsort(leaf, kind="stable")
        once = once[order]
        self.ids, self.asked, self.x = ids[order], t["asked"].to_numpy()[once], to_matrix(t["vec"], dim)[0][once]
        self.edges = np.searchsorted(leaf[order], np.arange(span[0], span[1] + 2))  # of the leaves
        self.half = self.x[:, cut]
        y = self.half - middle
        norm = (np.einsum("ij,ij->i", y, y, dtype=np.float64) * (1 - ROUNDING)).astype(np.float32)[:, None]
        self.left, self.right = np.hstack([y, norm, np.ones_like(norm)]), np.hstack([-2 * y, np.ones_like(norm), norm])


class _Best:
    """The ``k`` nearest neighbours of each query so far, ties by the smaller id."""

    def __init__(self, k: int, radius: float) -> None:
        self.k, self.radius, self.size = k, radius, 0
        self.parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def add(self, a: _Unit, i: np.ndarray, b: _Unit, j: np.ndarray) -> None:
        """Pairs of rows i of a and j of b, by their exact distance in both directions."""
        for s in range(0, len(i), 200_000):
            p, q = i[s : s + 200_000], j[s : s + 200_000]
            diff = a.x[p].astype(np.float64) - b.x[q]
            d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            near = (d <= self.radius) & (a.ids[p] != b.ids[q])
            p, q, d = p[near], q[near], d[near]
            there, back = a.asked[p], b.asked[q]
            self.parts += [(a.ids[p][there], b.ids[q][there], d[there]), (b.ids[q][back], a.ids[p][back], d[back])]
            self.size += int(there.sum() + back.sum())
            if self.size > 4 * AT_ONCE:
                self.parts = [self.ranked()]
                self.size = min(len(self.parts[0][0]), 2 * AT_ONCE)

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, n, d = (np.concatenate(p) for p in zip(*self.parts))
        order = np.lexsort((n, d, q))
        q, n, d = q[order], n[order], d[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        first = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)])) < self.k
        return q[first], n[first], d[first]


def _meet(a: _Unit, near: dict[int, np.ndarray], a_span: tuple[int, int], b: _Unit, back: dict[int, np.ndarray], b_span: tuple[int, int], limit: float, best: _Best) -> None:
    """Pairs of rows of two units, or of one, whose halves are within the squared ``limit``, leaf by leaf: only rows near the other leaf's box are held against each other."""
    there = {m: (near[m], np.searchsorted(near[m], a.edges)) for m in range(b_span[0], b_span[1] + 1) if m in near}
    for n in range(a_span[0], a_span[1] + 1):
        if n not in back:
            continue
        cuts = np.searchsorted(back[n], b.edges)
        for m, (rows, ends) in there.items():
            if a is b and m < n:
                continue
            p, q = rows[ends[n - a_span[0]] : ends[n - a_span[0] + 1]], back[n][cuts[m - b_span[0]] : cuts[m - b_span[0] + 1]]
            if not len(p) or not len(q) or not (a.asked[p].any() or b.asked[q].any()):
                continue
            right, step = b.right[q].T, max(1, AT_ONCE // len(q))
            for s in range(0, len(p), step):
                close = np.flatnonzero(~(a.left[p[s : s + step]] @ right > limit))  # what overflows is left to the exact distance
                if len(close):
                    i, j = p[s + close // len(q)], q[close % len(q)]
                    if a is b and m == n:
                        i, j = i[i < j], j[i < j]
                    best.add(a, i, b, j)


def close_pairs(df: DataFrame, sample: np.ndarray, n: int, k: int, radius: float, read: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """At least the ``k`` nearest others within ``radius`` of every asked vector: query_id, neighbour_id, distance; a pair may come twice.

    ``df`` has id, vec and asked, of which ``read`` gives a batch's ids, vectors and their places.
    Of two vectors within the radius one half is within radius / sqrt(2), so each half is searched
    with that by itself, and nothing is missed. For each half a vector is written once, to the
    file of its leaf of a k-d tree; a task reads its own file and those of all others that can hold a
    pair, one by one. So the disk taken is in proportion to the vectors, however many leaves a vector
    is near to; only reading and products grow with these.
    """
    spark, dim = df.sparkSession, sample.shape[1]
    cuts = [slice(s, e) for s, e in ((0, dim // 2), (dim // 2, dim)) if s < e]
    limit = radius * radius / len(cuts) * SLACK
    depth = max(0, min(int(np.ceil(np.log2(max(n, 1) / PER_LEAF))), int(np.log2(max(len(sample), SAMPLED) / SAMPLED))))
    trees = spark.sparkContext.broadcast([Tree(sample[:, c], depth) for c in cuts])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x, _ = read(batch)
            at, c = np.unique(np.concatenate([(p << depth) + trees.value[p].leaf(x[:, cut]) for p, cut in enumerate(cuts)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(c, pa.int64())], ["at", "n"])

    got = df.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row a leaf
    counts = np.zeros(len(cuts) << depth, np.int64)
    counts[got["at"].to_numpy()] = got["n"].to_numpy()
    size = int(np.clip(n // UNITS, LEAST_UNIT, MOST_UNIT))
    units = [units_of(c, size) for c in counts.reshape(len(cuts), -1)]
    placing = spark.sparkContext.broadcast(units)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, kept = read(batch)
            asked = batch.column(2).to_numpy(zero_copy_only=False)[kept]
            mix = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
            for p, cut in enumerate(cuts):
                first, times, _ = placing.value[p]
                leaf = trees.value[p].leaf(x[:, cut])
                unit = first[leaf] + mix % times[leaf]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), p, np.int32)), pa.array(unit, pa.int32()), pa.array(leaf, pa.int32()), pa.array(ids), pa.array(asked, pa.bool_()), from_matrix(x)], ["part", "unit", "leaf", "id", "asked", "vec"])

    tasks = max(partitions(spark), -(-int(counts.sum()) * (4 * dim + 32) // TASK_BYTES))
    folder = Scratch(spark, "halves").put(df.mapInArrow(place, PLACED).repartition(tasks, "part", "unit"), "units", "part", "unit")
    work = [(p, u) for p, (_, _, spans) in enumerate(units) for u in range(len(spans))]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (i for batch in batches for i in batch.column(0).to_pylist()):
            p, u = work[number]
            tree, spans, best = trees.value[p], placing.value[p][2], _Best(k, radius)
            load = lambda v: _Unit(folder, p, v, spans[v], cuts[p], tree.middle, dim)  # noqa: B023, E731
            with np.errstate(over="ignore", invalid="ignore"):
                own = load(u)
                near = tree.reach(own.half, limit, 0, (1 << depth) - 1)
                for v, span in enumerate(spans):
                    if v != u and (u < v) != ((u + v) % 2 == 0):  # each pair of units is one of the two's
                        continue
                    if not any(m in near for m in range(span[0], span[1] + 1)):
                        continue
                    other = own if v == u else load(v)
                    _meet(own, near, spans[u], other, near if v == u else tree.reach(other.half, limit, *spans[u]), span, limit, best)
            q, m, d = best.ranked()
            for s in range(0, len(q), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 100_000]) for c in (q, m, d)], ["query_id", "neighbour_id", "distance"])

    return spark.range(0, len(work), 1, len(work)).mapInArrow(search, FOUND)
