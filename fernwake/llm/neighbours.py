"""Nearest neighbours of vectors with an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernwake.functions.arrays import from_matrix, to_matrix
from fernwake.llm import halves
from fernwake.session import partitions

SAMPLE_ROWS = 20_000  # most rows that the centroids are fitted on
PER_CELL = 256  # wanted vectors a cell
PER_GROUP = 32_768  # wanted vectors of the neighbouring cells that travel together
MOST_CENTROIDS = 4096  # for each half: 4 billion vectors at 256 a cell, with tables of 200 MB; larger collections have fuller cells
SALTS = 32  # parts of the copies of one vector
BLOCK = 65_536  # most entries, and most queries, of one piece of work
TASK_BYTES = 16 << 20  # wanted size of a task's share of the travelling vectors
PAIRS = 1 << 22  # distances held at a time
MOST_VISITS = 3  # groups that a query visits on average, for vectors to travel to groups
TRIED = 1000  # sampled queries that this is measured on

FOUND = "query_id long, neighbour_id long, distance double"


class MultiIndex:
    """Two codebooks, one for each half of the vectors; a cell is a pair of centroids."""

    def __init__(self, sample: np.ndarray, centroids: int, seed: int = 11) -> None:
        self.dim, self.cut = sample.shape[1], sample.shape[1] // 2
        lo, hi = np.quantile(sample, [0.01, 0.99], axis=0) if len(sample) else (0, 0)
        body = np.clip(sample, lo, hi)  # a few wild readings must not take centroids
        self.books = [_kmeans(body[:, : self.cut], centroids, seed), _kmeans(body[:, self.cut :], centroids, seed + 1)]
        for i, book in enumerate(self.books):
            if len(book) > 1:  # so that neighbouring numbers are near each other
                middle = book - book.mean(0)
                self.books[i] = book[np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")]
        self.sizes = [len(b) for b in self.books]
        self.apart = [np.sqrt(_sq(b, b)) for b in self.books]

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [_sq(x[:, : self.cut], self.books[0]), _sq(x[:, self.cut :], self.books[1])]

    def grouping(self, counts: np.ndarray) -> np.ndarray:
        """The group of each cell: neighbouring cells, in order of both centroids' places, that hold about ``PER_GROUP`` vectors."""
        flat = (np.cumsum(counts) - counts) // PER_GROUP
        return np.unique(flat, return_inverse=True)[1].astype(np.int32)

    def cells(self, d: list[np.ndarray]) -> np.ndarray:
        return d[0].argmin(1) * self.sizes[1] + d[1].argmin(1)

    def within(self, d: list[np.ndarray], radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of all cells that can hold a vector within ``radius``.

        A vector nearer to centroid c than to a query's own centroid o lies beyond the plane
        between them, which is (|q-c|^2 - |q-o|^2) / (2 |c-o|) away; the two halves' distances add
        up in squares to a lower bound of the distance. Centroid pairs are taken from a heap by
        rising sum of their halves' bounds, and the walk ends at the first sum beyond the radius:
        no later pair can hold such a vector.
        """
        bounds = []
        for x, apart in zip(d, self.apart):
            own = x.argmin(1)
            gap = x - x[np.arange(len(x)), own][:, None]
            bounds.append(np.where(gap > 0, gap / np.maximum(2 * apart[own], 1e-30), 0) ** 2)
        limit = radius * radius
        near = [b <= limit for b in bounds]
        many = np.flatnonzero(near[0].sum(1) * near[1].sum(1) > 1)
        qs, cs = [], []
        for q in many:
            rows, cols = (np.flatnonzero(n[q]) for n in near)
            rows, cols = rows[np.argsort(bounds[0][q, rows], kind="stable")], cols[np.argsort(bounds[1][q, cols], kind="stable")]
            br, bc = bounds[0][q, rows].tolist(), bounds[1][q, cols].tolist()
            for i, j in _by_sum(br, bc):
                if br[i] + bc[j] > limit:
                    break
                qs.append(q)
                cs.append(int(rows[i]) * self.sizes[1] + int(cols[j]))
        one = np.ones(len(d[0]), bool)
        one[many] = False
        alone = np.flatnonzero(one)
        return np.concatenate([alone, np.array(qs, np.int64)]), np.concatenate([self.cells(d)[alone], np.array(cs, np.int64)])

    def nearest(self, d: list[np.ndarray], counts: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of the nearest centroid pairs, until their cells hold ``want`` vectors."""
        order = [np.argsort(x, axis=1, kind="stable") for x in d]
        dist = [np.take_along_axis(x, o, 1).tolist() for x, o in zip(d, order)]
        order = [o.tolist() for o in order]
        qs, cs = [], []
        for q in range(len(d[0])):
            held = 0
            for i, j in _by_sum(dist[0][q], dist[1][q]):
                cell = order[0][q][i] * self.sizes[1] + order[1][q][j]
                if counts[cell]:
                    qs.append(q)
                    cs.append(cell)
                    held += counts[cell]
                    if held >= want:
                        break
        return np.array(qs, np.int64), np.array(cs, np.int64)


def _by_sum(a: list[float], b: list[float]) -> Iterator[tuple[int, int]]:
    """Pairs of places in two rising lists by rising sum; a pair enters the heap once both pairs before it are out."""
    heap, done = [(a[0] + b[0], 0, 0)], [0] * (len(a) + 1)
    while heap:
        _, i, j = heapq.heappop(heap)
        done[i] = j + 1
        yield i, j
        if i + 1 < len(a) and done[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))


def _sq(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x.astype(np.float64), y.astype(np.float64)
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    points = np.unique(x, axis=0)
    if len(points) <= k:
        return points if len(points) else np.zeros((1, x.shape[1]))
    c = points[rng.choice(len(points), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = _sq(x, c).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return np.unique(c, axis=0)


def usable(batch: pa.RecordBatch, dim: int, cosine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and vectors of the batch's comparable rows (id known, all entries finite; for cosine not all zero, at length 1), and their places."""
    m, taken = to_matrix(batch.column(1), dim)
    known = np.asarray(batch.column(0).is_valid())
    rows = np.flatnonzero(taken)
    good = np.isfinite(m).all(1) & known[rows]
    if cosine:
        length = np.sqrt((m.astype(np.float64) ** 2).sum(1))
        good &= (length > 0) & np.isfinite(length)
        m = m / np.where(good, length, 1)[:, None]
    ids = batch.column(0).take(pa.array(rows[good])).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, np.ascontiguousarray(m[good], np.float32), rows[good]


def nearest_vectors(df: DataFrame, row_id: str, vector: str, dim: int, k: int, metric: str = "euclidean", radius: float | None = None, slack: float = 1.0, candidates: int = 4096, queries: Column | None = None, per_cell: int = PER_CELL, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest other vectors of every vector: query_id, neighbour_id, distance, rank.

    ``metric`` is euclidean, or cosine, whose distance is that of the vectors at length 1
    (distance^2 = 2 - 2 cosine). Equal distances are ranked by the smaller id. With ``radius``
    only neighbours within it count, and a query visits the cells that can hold one within
    ``slack`` * radius: at slack 1 none is missed; a smaller one trades recall for cells (a
    neighbour's offset is spread over all dimensions, so little of it crosses a cell's wall).
    Without it, cells are visited until they hold ``candidates`` vectors. ``queries`` restricts the
    queries, never the index.

    The centroids are fitted on at most 20,000 rows picked by a hash of the id; every row is
    indexed. Rows with null or non-finite entries, of another length, without id, or (cosine) all
    zero are no vectors here and come out nowhere. Repeated ids count once. A vector travels once to
    its own group of cells and once to each other group that it visits, with the list of the cells
    there. Groups are sized by the counted entries of their cells, and the work of a group is cut
    into blocks of about ``block`` entries and queries. In a group of several blocks only the
    k + 1 smallest ids of each group of exact copies are indexed, which are all that can be
    anyone's neighbours; the other copies get theirs by a join on the vector.

    Where the radius is so wide for the vectors that sampled queries visit more than 3 groups each,
    copies would grow with the square of the collection. Then nothing travels to groups: pairs come
    from ``halves.close_pairs``, whose files hold each vector twice; there ``slack`` is 1.
    """
    spark, cosine = df.sparkSession, metric == "cosine"
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    asked = F.coalesce(queries, F.lit(False)) if queries is not None else F.lit(True)
    base = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vec"), asked.alias("asked"))
    n = base.count()
    picked = base.where("id is not null").select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow()
    sample = [usable(b, dim, cosine)[1] for b in picked.to_batches()]
    sample = np.concatenate(sample) if sample else np.zeros((0, dim), np.float32)
    index = MultiIndex(sample, int(min(MOST_CENTROIDS, max(1, round((n / per_cell) ** 0.5)))))
    shared = spark.sparkContext.broadcast(index)
    n_cells = index.sizes[0] * index.sizes[1]
    spread = None if radius is None else radius * slack

    def visits(d: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return shared.value.within(d, spread) if spread is not None else shared.value.nearest(d, counts, candidates)

    def tally(visited: bool, counts: np.ndarray | None, group_of: np.ndarray | None, n_groups: int) -> np.ndarray:
        """Entries of each cell, or queries that visit each group."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, x, _ = usable(batch.filter(batch.column(2)) if visited else batch, dim, cosine)
                d = shared.value.halves(x)
                if visited:
                    q, cells = visits(d, counts)
                    at = np.unique(q * n_groups + group_of[cells]) % n_groups
                else:
                    at = shared.value.cells(d)
                at, c = np.unique(at, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(c, pa.int64())], ["at", "n"])

        got = base.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row a cell or group
        out = np.zeros(n_groups if visited else n_cells, np.int64)
        out[got["at"].to_numpy()] = got["n"].to_numpy()
        return out

    counts = tally(False, None, None, 0)
    group_of = index.grouping(counts)
    n_groups = int(group_of.max()) + 1
    wide = False
    if radius is not None and n_groups > MOST_VISITS and len(sample):
        tried = index.halves(sample[:TRIED])
        q, cells = index.within(tried, spread)
        each = len(np.unique(q * n_groups + group_of[cells])) / len(tried[0])
        wide = each * (1 if queries is None else base.where("asked").count() / n) > MOST_VISITS
    eb = np.maximum(1, -(-np.bincount(group_of, counts, n_groups).astype(np.int64) // block))
    visited = np.zeros(n_groups, np.int64) if wide else tally(True, counts, group_of, n_groups)
    qb = np.maximum(1, -(-visited // block))
    tables = spark.sparkContext.broadcast((counts, eb, qb, group_of))
    crowded = bool((eb > 1).any())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, entry_blocks, _, group = tables.value
        for batch in batches:
            ids, x, _ = usable(batch, dim, cosine)
            cell = shared.value.cells(shared.value.halves(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids), from_matrix(x), pa.array(entry_blocks[group[cell]] > 1)], ["id", "vec", "crowded"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entry_blocks, query_blocks, group = tables.value
        for batch in batches:
            ids, x, kept = usable(batch, dim, cosine and not crowded)  # a crowded index is at length 1 already
            wanted = batch.column(2).to_numpy(zero_copy_only=False)[kept]
            d = shared.value.halves(x)
            own = shared.value.cells(d)
            mix = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
            ask = np.flatnonzero(wanted)
            q, cells = visits([m[ask] for m in d], held)
            order = np.lexsort((cells, group[cells], q))
            q, cells = ask[q[order]], cells[order]
            first = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (group[cells[1:]] != group[cells[:-1]])]) if len(q) else np.zeros(0, np.int64)
            lengths = np.diff(np.r_[first, len(q)])  # cells of each (query, group)
            q, qg, eg = q[first], group[cells[first]], group[own]
            # entries go to every block of queries, queries to every block of entries
            e_row, e_at = _spread(np.arange(len(ids)), query_blocks[eg])
            pair, q_at = _spread(np.arange(len(q)), entry_blocks[qg])
            e_key = np.stack([e_row, eg[e_row], e_at, mix[e_row] % entry_blocks[eg[e_row]]], 1)
            q_key = np.stack([q[pair], qg[pair], mix[q[pair]] % query_blocks[qg[pair]], q_at], 1)
            keys, back = np.unique(np.concatenate([e_key, q_key]), axis=0, return_inverse=True)
            entry, asks = np.zeros(len(keys), bool), np.full(len(keys), -1, np.int64)
            entry[back.ravel()[: len(e_key)]] = True
            asks[back.ravel()[len(e_key) :]] = pair
            for s in range(0, len(keys), 20_000):
                ks, en, p = keys[s : s + 20_000], entry[s : s + 20_000], asks[s : s + 20_000]
                n_cells_of = np.where(p >= 0, lengths[p] if len(lengths) else 0, 0)
                source, step = _spread(np.where(p >= 0, first[p] if len(first) else 0, 0), n_cells_of)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_cells_of)].astype(np.int32)), pa.array(cells[source + step].astype(np.int32)))
                row = ks[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ks[:, 1].astype(np.int32)), pa.array(ks[:, 2].astype(np.int32)), pa.array(ks[:, 3].astype(np.int32)), pa.array(ids[row]), pa.array(np.where(en, own[row], -1).astype(np.int32)), lists, from_matrix(x[row])],
                    ["at", "q_block", "e_block", "id", "cell", "asked", "vec"],
                )

    copies = None
    indexed = base
    if crowded:
        placed = base.mapInArrow(assign, "id long, vec array<float>, crowded boolean")
        dense = placed.where("crowded").select("id", "vec").dropDuplicates(["id"])
        ranked = dense.withColumn("nth", F.row_number().over(Window.partitionBy("vec").orderBy("id")))
        lead = ranked.where(F.col("nth") <= k + 1)
        again = base.select("id", "asked").groupBy("id").agg(F.max("asked").alias("asked"))
        indexed = placed.where("not crowded").select("id", "vec").unionByName(lead.select("id", "vec")).join(again, "id").select("id", "vec", "asked")
        # k + 1 ids at most; only a vector of that many leaders has further copies, which may be very many
        leaders = lead.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > k)
        leaders = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rest = dense.join(lead.select("id"), "id", "left_anti").join(again.where("asked"), "id", "left_semi")
        copies = rest.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(leaders, ["vec", "salt"]).select("id", F.explode(F.slice("ids", 1, k)).alias("neighbour_id"))
        copies = copies.select(F.col("id").alias("query_id"), "neighbour_id", F.lit(0.0).alias("distance"))

    def rerank(t: pa.Table) -> pa.Table:
        asked = t["asked"].combine_chunks()
        n_asked = np.diff(asked.offsets.to_numpy())
        return _rerank(t["id"].to_numpy(), t["cell"].to_numpy(), n_asked, asked.flatten().to_numpy(), to_matrix(t["vec"], dim)[0], k, radius)

    if wide:
        found = halves.close_pairs(indexed, sample, n, k, radius, lambda batch: usable(batch, dim, cosine and not crowded))
    else:
        # as many tasks as the counted rows fill, however large the collection
        travelling = int((np.bincount(group_of, counts, n_groups) * qb + visited * eb).sum())
        tasks = max(partitions(spark), -(-travelling * (4 * dim + 64) // TASK_BYTES))
        placed_rows = indexed.mapInArrow(place, "at int, q_block int, e_block int, id long, cell int, asked array<int>, vec array<float>")
        groups = placed_rows.repartition(tasks, "at", "q_block", "e_block").groupBy("at", "q_block", "e_block")
        found = groups.applyInArrow(rerank, FOUND)
    if copies is not None:
        found = found.unionByName(copies)
    best = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _spread(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row as often as said, with the number of its repetition."""
    out = np.repeat(rows, times)
    return out, np.arange(len(out)) - np.repeat(np.cumsum(times) - times, times)


def _rerank(ids: np.ndarray, cell: np.ndarray, n_asked: np.ndarray, asked: np.ndarray, x: np.ndarray, k: int, radius: float | None) -> pa.Table:
    """Exact distances of the queries to the entries of the cells they visit; the k nearest of each query."""
    ask_row = np.repeat(np.arange(len(ids)), n_asked)
    _, first = np.unique(ids, return_index=True)  # repeated deliveries of one id
    once = np.zeros(len(ids), bool)
    once[first] = True
    asked, ask_row = asked[once[ask_row]], ask_row[once[ask_row]]
    entry = np.flatnonzero(once & (cell >= 0))
    entry = entry[np.argsort(cell[entry], kind="stable")]
    by_cell = np.argsort(asked, kind="stable")
    asked, ask_row = asked[by_cell], ask_row[by_cell]
    middle = np.median(x[entry], axis=0) if len(entry) else 0
    y = (x - middle).astype(np.float32)
    norm = np.einsum("ij,ij->i", y, y, dtype=np.float64).astype(np.float32)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c in np.unique(asked):
        e = entry[np.searchsorted(cell[entry], c) : np.searchsorted(cell[entry], c, "right")]
        q = ask_row[np.searchsorted(asked, c) : np.searchsorted(asked, c, "right")]
        if not len(e):
            continue
        ye, ne = np.ascontiguousarray(y[e].T), norm[e]
        step = max(1, PAIRS // len(e))
        for s in range(0, len(q), step):
            rows = q[s : s + step]
            d = y[rows] @ ye
            d *= -2
            d += norm[rows][:, None]
            d += ne[None]
            if radius is not None:  # what single precision can't tell apart is kept for the exact distance
                a, b = np.nonzero(d <= (radius * radius * 1.001 + 4e-6 * norm[rows])[:, None])
            else:  # likewise up to the (k + 1)-th, one of them being the query itself
                last = np.partition(d, k, axis=1)[:, k] if len(e) > k + 1 else np.full(len(rows), np.inf, np.float32)
                a, b = np.nonzero(d <= (np.maximum(last, 0) * 1.001 + 2e-5 * norm[rows])[:, None])
            keep = rows[a] != e[b]
            a, b = rows[a][keep], e[b][keep]
            if radius is None:  # many can tie, so they are ranked before the next ones are looked at
                a, b, _ = _ranked(ids, a, b, x, k, None)
            out_a.append(a)
            out_b.append(b)
    a, b, d = _ranked(ids, np.concatenate(out_a), np.concatenate(out_b), x, k, radius)
    return pa.table([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64()), pa.array(d, pa.float64())], ["query_id", "neighbour_id", "distance"])


def _ranked(ids: np.ndarray, a: np.ndarray, b: np.ndarray, x: np.ndarray, k: int, radius: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest b of each a by exact distance, ties by the smaller id, and their distances."""
    dist = [np.zeros(0)]
    for s in range(0, len(a), 200_000):
        diff = x[a[s : s + 200_000]].astype(np.float64) - x[b[s : s + 200_000]]
        dist.append(np.sqrt(np.einsum("ij,ij->i", diff, diff)))
    d = np.concatenate(dist)
    if radius is not None:
        a, b, d = a[d <= radius], b[d <= radius], d[d <= radius]
    order = np.lexsort((ids[b], d, a))
    a, b, d = a[order], b[order], d[order]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    nth = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
    return a[nth < k], b[nth < k], d[nth < k]
