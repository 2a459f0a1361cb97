"""Exact top-k retrieval in blocks, guarded banks, decision heads and the study of neighbours."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernwake.functions.arrays import to_matrix
from fernwake.functions.vectors import EPS, similarity
from fernwake.operators.folds import fold_leakage, make_folds
from fernwake.session import partitions

QUERY_BLOCK, BANK_BLOCK = 4096, 16_384
MOST_BANK = 4_000_000  # numbers of a bank that may stand on every worker (16 MB)
LEAST_PAIRS = 250_000  # pairs of rows that are worth a task of their own
METRICS = ("cosine", "euclidean", "fidelity", "entangled", "dot")
PLACES = 9  # scores are ranked at this precision, so that the order of summation can't flip ties


def phases(angles: np.ndarray, reps: int, entangled: bool) -> np.ndarray:
    """State of each row after a diagonal feature map: one complex amplitude for each sign pattern.

    After one layer of Hadamards every gate is diagonal, so the amplitude of signs z is
    exp(i reps / 2 (sum x_i z_i + [entangled] sum x_i x_(i+1) z_i z_(i+1))) / sqrt(2^n), and the
    kernel is the squared modulus of the inner product.
    """
    n = angles.shape[1]
    z = np.array(list(itertools.product([1.0, -1.0], repeat=n)))
    phase = angles @ z.T
    if entangled and n > 1:
        phase = phase + (angles[:, :-1] * angles[:, 1:]) @ (z[:, :-1] * z[:, 1:]).T
    return np.exp(0.5j * reps * phase) / 2 ** (n / 2)


def entangled_states(angles: np.ndarray, reps: int, pairs: bool = True) -> np.ndarray:
    """State of each row after ``reps`` layers of Hadamards and phases, the second kind of feature map.

    A layer's phase of a bit pattern is 2 x_i for each set bit and, with ``pairs``, 2 (pi - x_i)
    (pi - x_j) for each two bits that differ; unlike in ``phases`` every layer begins with
    Hadamards, so the state is carried from layer to layer.
    """
    n = angles.shape[1]
    bits = np.array(list(itertools.product([0.0, 1.0], repeat=n)))
    phase = 2 * angles @ bits.T
    for i, j in itertools.combinations(range(n), 2) if pairs else ():
        phase = phase + (2 * (np.pi - angles[:, i]) * (np.pi - angles[:, j]))[:, None] * (bits[:, i] != bits[:, j])
    state = np.zeros((len(angles), 2**n), complex)
    state[:, 0] = 1
    for _ in range(reps):
        state = state.reshape(-1, *[2] * n)
        for axis in range(1, n + 1):
            a, b = np.take(state, 0, axis), np.take(state, 1, axis)
            state = np.stack([a + b, a - b], axis) / np.sqrt(2)
        state = state.reshape(-1, 2**n) * np.exp(1j * phase)
    return state


def kernel_of(enabled: bool, wanted: str = "auto", at_most: int = 10, qubits: int = 6) -> str:
    """The kernel to search by: rbf where none is wanted, else fidelity or entangled; auto takes the first, or rbf above ``at_most`` qubits."""
    if wanted not in ("auto", "fidelity", "entangled", "none"):
        raise ValueError(f"unknown kernel {wanted}")
    if not enabled or wanted == "none" or (wanted == "auto" and qubits > at_most):
        return "rbf"
    return "fidelity" if wanted == "auto" else wanted


def _raw(q: np.ndarray, b: np.ndarray, metric: str, reps: int, entangled: bool) -> np.ndarray:
    q, b = q.astype(np.float64), b.astype(np.float64)
    if metric == "dot":
        return q @ b.T
    if metric == "cosine":
        unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(1)), EPS)[:, None]
        return unit(q) @ unit(b).T
    if metric == "fidelity":
        return np.abs(phases(q, reps, entangled) @ phases(b, reps, entangled).conj().T) ** 2
    if metric == "entangled":
        return np.abs(entangled_states(q, reps, entangled) @ entangled_states(b, reps, entangled).conj().T) ** 2
    return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * q @ b.T, 0))


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` smallest finite scores of each row, in order; ties go to the smaller column."""
    if score.shape[1] > k:
        row, col = np.nonzero(score <= np.partition(score, k - 1, axis=1)[:, k - 1 : k])
    else:
        row, col = np.nonzero(np.ones(score.shape, bool))
    keep = np.isfinite(score[row, col])
    row, col = row[keep], col[keep]
    order = np.lexsort((col, score[row, col], row))
    row, col = row[order], col[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    nth = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    return row[nth < k], col[nth < k]


def blocks_of(nq: int, nb: int, tasks: int) -> tuple[int, int]:
    """Blocks of queries and of the bank: none above its largest size, and about ``tasks`` pairs of blocks where the work is worth them."""
    q, b = max(1, -(-nq // QUERY_BLOCK)), max(1, -(-nb // BANK_BLOCK))
    worth = max(1, min(tasks, nq * nb // LEAST_PAIRS))
    return max(q, min(-(-worth // b), nq)), b


def top_k(queries: DataFrame, bank: DataFrame, k: int, metric: str, dim: int, other_groups: bool = False, other_rows: bool = True, fold: str | None = None, reps: int = 2, entangled: bool = True, strategy: str = "auto") -> DataFrame:
    """The ``k`` best bank rows of each query: query_id, rank, neighbour_id, raw, n_label, n_group, label, group.

    Both sides have id, vec, label, group. ``other_groups`` leaves out bank rows of the query's
    group, ``other_rows`` the row of the query's id (wherever it ranks). With ``fold``, a column of
    both sides, a query meets the bank rows of its own fold only, and the column comes first.
    ``raw`` is the cosine, dot product or fidelity (largest first) or the Euclidean distance
    (smallest first), ranked at nine places, ties by the smaller id.

    ``strategy`` blocked ranks all pairs of blocks of queries and blocks of the bank each in one
    task, and merges the blocks' k best; broadcast sends the bank to the workers, over which
    the queries are spread once, and refuses one of more than ``MOST_BANK`` numbers; auto broadcasts a bank up to
    that size. The results are the same, and a pair of rows is never a row of a table. Rows without id, or whose
    vector is null, of another length or not finite, are left out. Fewer than k candidates give
    fewer rows.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if strategy not in ("auto", "broadcast", "blocked"):
        raise ValueError(f"unknown strategy {strategy}")
    spark = queries.sparkSession
    in_fold = F.col(fold).cast("string") if fold else F.lit("")
    cols = [in_fold.alias("fold"), F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec"), F.col("label").cast("int").alias("label"), F.col("group").cast("string").alias("group")]
    q, b = queries.select(*cols), bank.select(*cols)
    whole = None
    if strategy != "blocked":
        whole = b.limit(MOST_BANK // dim + 1).toArrow()  # a bounded number of rows
        if whole.num_rows * dim > MOST_BANK:
            if strategy == "broadcast":
                raise ValueError(f"the bank has more than {MOST_BANK} numbers")
            whole = None

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = []
        for t in (left, right):
            m, taken = to_matrix(t["vec"], dim)
            rows = np.flatnonzero(taken)
            good = np.isfinite(m).all(1) & np.asarray(t["id"].combine_chunks().is_valid())[rows]
            sides.append((t.take(pa.array(rows[good])), m[good]))
        (lt, lm), (rt, rm) = sides
        out_q, out_b, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(lm) and len(rm):
            lid, rid = lt["id"].to_numpy(), rt["id"].to_numpy()
            by_id = np.argsort(rid, kind="stable")
            rm, rid = rm[by_id], rid[by_id]
            names = {g: i for i, g in enumerate(set(lt["group"].to_pylist()) | set(rt["group"].to_pylist()))}
            lg, rg = np.array([names[g] for g in lt["group"].to_pylist()]), np.array([names[g] for g in rt["group"].to_pylist()])[by_id]
            sign = 1.0 if metric == "euclidean" else -1.0
            for s in range(0, len(lm), 512):
                score = np.round(_raw(lm[s : s + 512], rm, metric, reps, entangled), PLACES) * sign
                if other_groups:
                    score[lg[s : s + 512, None] == rg[None]] = np.inf
                if other_rows:
                    score[lid[s : s + 512, None] == rid[None]] = np.inf
                row, best = _best(score, k)
                out_q.append(row + s)
                out_b.append(by_id[best])
                out_s.append(score[row, best] * sign)
        a, c = np.concatenate(out_q), np.concatenate(out_b)
        pick = lambda t, name, at: t[name].take(pa.array(at))
        return pa.table([pick(lt, "fold", a), pick(lt, "id", a), pick(lt, "label", a), pick(lt, "group", a), pick(rt, "id", c), pick(rt, "label", c), pick(rt, "group", c), pa.array(np.concatenate(out_s))], ["fold", "query_id", "label", "group", "neighbour_id", "n_label", "n_group", "raw"])

    schema = "fold string, query_id long, label int, group string, neighbour_id long, n_label int, n_group string, raw double"
    if whole is not None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, whole.schema) as w:
            w.write_table(whole)
        shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bank = pa.ipc.open_stream(shared.value).read_all()
            parts = {f: bank.filter(pc.equal(bank["fold"], f)) if f is not None else bank.slice(0, 0) for f in pc.unique(bank["fold"]).to_pylist()}
            for batch in batches:
                table = pa.Table.from_batches([batch])
                for f in pc.unique(table["fold"]).to_pylist():
                    if f in parts:
                        got = rank(table.filter(pc.equal(table["fold"], f)), parts[f])
                        yield from got.append_column("rank", pa.array(_places(got["query_id"].to_numpy()), pa.int32())).combine_chunks().to_batches()

        out = q.repartition(partitions(spark)).mapInArrow(run, f"{schema}, rank int")
    else:
        sizes = lambda df: df.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
        (nq, folds), (nb, _) = sizes(q), sizes(b)
        q_blocks, b_blocks = blocks_of(nq, nb, -(-spark.sparkContext.defaultParallelism // max(folds, 1)))
        block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q = q.withColumn("qb", block(q_blocks)).withColumn("bb", every(b_blocks))
        b = b.withColumn("bb", block(b_blocks)).withColumn("qb", every(q_blocks))
        pairs = q.groupBy("fold", "qb", "bb").cogroup(b.groupBy("fold", "qb", "bb")).applyInArrow(rank, schema)
        order = F.asc("raw") if metric == "euclidean" else F.desc("raw")
        best = Window.partitionBy("fold", "query_id").orderBy(order, "neighbour_id")
        out = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.withColumnRenamed("fold", fold) if fold else out.drop("fold")


def _places(query: np.ndarray) -> np.ndarray:
    """Place from 1 of each row among the adjoining rows of its query."""
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    return np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)])) + 1


def first_by_hash(rows: DataFrame, n: int, seed: str, by: list[str]) -> DataFrame:
    """The first ``n`` rows of each group in the order of (md5(id || seed), id), exactly.

    The hashes' first 16 bits are counted, which tells the value at which a group has its ``n``;
    smaller ones are taken as they are, and only the rows of that value are ordered. ``by`` has
    few values: one row of each is broadcast.
    """
    h = F.md5(F.concat(F.col("id").cast("string"), F.lit(seed)))
    hashed = rows.withColumn("_h", h).withColumn("_p", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    upto = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    counts = hashed.groupBy(*by, "_p").count().withColumn("_upto", F.sum("count").over(upto))
    edge = counts.groupBy(*by).agg(F.min(F.when(F.col("_upto") >= n, F.struct("_p", (F.lit(n) - F.col("_upto") + F.col("count")).alias("left")))).alias("_edge"))
    edge = edge.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_edge")
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    met = hashed.join(F.broadcast(edge), cond).drop(*[f"_by_{c}" for c in by])
    sure = met.where(F.col("_edge").isNull() | (F.col("_p") < F.col("_edge._p")))
    order = Window.partitionBy(*by).orderBy("_h", "id")
    at = met.where(F.col("_p") == F.col("_edge._p")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.col("_edge.left")).drop("_n")
    return sure.unionByName(at).drop("_h", "_p", "_edge")


def majority_cap(rows: DataFrame, cap: int | None, seed: str, keep_label: int = 1, by: list[str] | None = None) -> DataFrame:
    """All rows of ``keep_label`` and at most ``cap`` of each other label (in each group of ``by``), in the order of md5(id || seed); no cap keeps all.

    Rows without label are left out where there is a cap.
    """
    if not cap:
        return rows
    kept = rows.where(F.col("label") == keep_label)
    return kept.unionByName(first_by_hash(rows.where(F.col("label") != keep_label), cap, seed, [*(by or []), "label"]))


def build_banks(rows: DataFrame, cap: int | None, seed: str) -> DataFrame:
    """The bank of every leave-one-group-out fold: fold, id, vec, label, group of the rows of other groups, capped (``majority_cap``).

    A fold's bank is chosen from training rows only, so that no row of its test group can be in it;
    ``guard`` checks a bank however it was made. Rows without group are in no bank.
    """
    keys = rows.select("id", "label", "group").where("group is not null")
    folds = keys.select(F.col("group").alias("fold")).distinct()  # one row a group
    picked = majority_cap(keys.crossJoin(F.broadcast(folds)).where("group <> fold"), cap, seed, by=["fold"])
    return picked.select("fold", "id").join(rows.select("id", "vec", "label", "group"), "id").select("fold", "id", "vec", "label", "group")


def guard(bank: DataFrame, members: DataFrame) -> None:
    """ValueError if a fold's ``bank`` (fold, id, group) has rows of its test group, or that aren't training rows of it."""
    found = fold_leakage(bank.withColumnRenamed("fold", "test_group"), members, make_folds(members)).where("of_test_group > 0 or not_in_training > 0").first()
    if found:
        raise ValueError(f"leakage into the bank of fold {found['test_group']}: {found.asDict()}")


def vote(neighbours: DataFrame, metric: str, gamma: float = 1.0, weighted: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """(by,) query_id, label, score: the share of label 1 among the neighbours, weighted by similarity (negative as 0)."""
    w = F.greatest(similarity(F.col("raw"), metric, gamma), F.lit(0.0)) if weighted else F.lit(1.0)
    total = F.sum(w) + (EPS if weighted else 0)
    return neighbours.groupBy(*by, "query_id", "label").agg((F.sum(w * F.col("n_label")) / total).alias("score"))


def neighbour_stats(neighbours: DataFrame, k: int | None, predictions: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over queries, in each group of ``by``: of label 1, of the query's own and other groups, of distinct groups / ``k``.

    ``k`` is as asked for; without it, a query's number of neighbours counts. With ``predictions``
    ((by,) query_id, pred) also the share of label 1 of the queries predicted 1 and 0 (null where
    there are none).
    """
    on = [*by, "query_id"]
    each = neighbours.groupBy(*on).agg(
        F.avg(F.col("n_label").cast("double")).alias("positive_ratio"),
        F.avg((F.col("n_group") == F.col("group")).cast("double")).alias("same_group"),
        (F.countDistinct("n_group") / (F.lit(float(k)) if k else F.count(F.lit(1)))).alias("diversity"),
    )
    each = each.join(predictions.select(*[c for c in on if c in predictions.columns], "pred"), [c for c in on if c in predictions.columns], "left") if predictions is not None else each.withColumn("pred", F.lit(None).cast("int"))
    when = lambda p: F.avg(F.when(F.col("pred") == p, F.col("positive_ratio")))
    return each.groupBy(*by).agg(F.avg("positive_ratio").alias("positive_ratio"), F.avg("same_group").alias("same_group"), F.avg(1 - F.col("same_group")).alias("other_group"), F.avg("diversity").alias("diversity"), when(1).alias("support_predicted_1"), when(0).alias("support_predicted_0"), F.count(F.lit(1)).alias("n_queries"))


def neighbour_overlap(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean Jaccard overlap of two results' neighbour sets by query, in each group of ``by``.

    A query that one result lacks has an overlap of 0.
    """
    on = [*by, "query_id"]
    sets = lambda df, name: df.groupBy(*on).agg(F.collect_set("neighbour_id").alias(name))
    none = F.array().cast("array<bigint>")
    both = sets(a, "a").join(sets(b, "b"), on, "full").withColumns({"a": F.coalesce("a", none), "b": F.coalesce("b", none)})
    j = F.coalesce(F.try_divide(F.size(F.array_intersect("a", "b")).cast("double"), F.size(F.array_union("a", "b"))), F.lit(0.0))
    return both.groupBy(*by).agg(F.avg(j).alias("overlap"), F.count(F.lit(1)).alias("n_queries"))
