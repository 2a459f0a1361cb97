"""The retrieval study of all leave-one-group-out folds: banks, heads, thresholds, metrics and neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwake.functions.vectors import scaled_angles, similarity
from fernwake.operators import evaluation, retrieval
from fernwake.operators.preparation import Settings, prepare_folds
from fernwake.session import Scratch

RANKINGS = {"cosine": "cosine", "euclidean": "euclidean", "rbf": "euclidean"}  # what each metric is ranked by
PAIRS = (("cosine", "euclidean"), ("cosine", "rbf"), ("euclidean", "rbf"))


@dataclass(frozen=True)
class Plan:
    """Settings of the study; ``ks`` are the neighbour counts of the sweep."""

    ks: tuple[int, ...] = (1, 3, 5, 10, 20)
    decision_k: int = 10
    metric: str = "cosine"
    gamma: float = 1.0
    alpha: float = 0.5
    cap: int | None = None
    seed: str = "42"
    step_seconds: float = 1.0

    def __post_init__(self) -> None:
        if self.metric not in RANKINGS:
            raise ValueError(f"metric must be one of {tuple(RANKINGS)}")
        if not self.ks or min(*self.ks, self.decision_k) < 1 or not 0 <= self.alpha <= 1:
            raise ValueError("ks and decision_k must be 1 or more, alpha between 0 and 1")


@dataclass(frozen=True)
class Study:
    """Tables of the study, by fold.

    ``bank`` (fold, id, vec, label, group), ``neighbours`` by ranking (fold, query_id, rank, ...),
    ``train`` and ``test`` (head, fold, id, y, score), ``thresholds`` (head, fold, threshold) and
    ``predictions`` (fold, query_id, pred) of the decision head.
    """

    plan: Plan
    bank: DataFrame
    neighbours: dict[str, DataFrame]
    train: DataFrame
    test: DataFrame
    thresholds: DataFrame
    predictions: DataFrame

    def metrics(self) -> DataFrame:
        """The metric panel of each head and fold on the held-out rows, at the threshold tuned on the bank."""
        return evaluation.metric_panel(self.test.join(self.thresholds, ["head", "fold"]), ["head", "fold"], self.plan.step_seconds)

    def slice(self, metric: str, k: int) -> DataFrame:
        """The first ``k`` neighbours by ``metric``, with their similarity; from the one widest search of its ranking."""
        n = self.neighbours[RANKINGS[metric]].where(F.col("rank") <= k)
        return n.withColumn("similarity", similarity(F.col("raw"), metric, self.plan.gamma))

    def neighbour_stats(self) -> DataFrame:
        """fold, metric, k and the neighbour statistics of every metric and k, supported by the decision head's predictions."""
        out = None
        ks = F.explode(F.array(*map(F.lit, self.plan.ks)))
        by_ranking = {}
        for r in set(RANKINGS.values()):
            swept = self.neighbours[r].withColumn("k", ks).where("rank <= k")
            by_ranking[r] = retrieval.neighbour_stats(swept, None, self.predictions, ("fold", "k"))
        for metric, r in RANKINGS.items():
            part = by_ranking[r].withColumn("metric", F.lit(metric))
            out = part if out is None else out.unionByName(part)
        return out

    def overlaps(self) -> DataFrame:
        """fold, pair, overlap, n_queries of the metrics' neighbour sets at the decision's k."""
        out = None
        for a, b in PAIRS:
            part = retrieval.neighbour_overlap(self.slice(a, self.plan.decision_k), self.slice(b, self.plan.decision_k), ("fold",)).withColumn("pair", F.lit(f"{a}_vs_{b}"))
            out = part if out is None else out.unionByName(part)
        return out

    def bank_sizes(self) -> DataFrame:
        """fold, bank_size, n_pos and n_groups of each bank."""
        return self.bank.groupBy("fold").agg(F.count(F.lit(1)).alias("bank_size"), F.count(F.when(F.col("label") == 1, 1)).alias("n_pos"), F.countDistinct("group").alias("n_groups"))


def run_study(rows: DataFrame, dim: int, plan: Plan = Plan(), linear: DataFrame | None = None) -> Study:
    """The study of ``rows`` (id, vec, label, group), each group held out once.

    Every fold's bank is built from its training rows and guarded. Each ranking is searched once
    with the largest k; all smaller ones, and the RBF kernel, which ranks as the Euclidean distance
    does, are slices of it. The knn head's threshold is tuned on the bank, each of whose rows is scored by the
    others; with ``linear`` (fold, id, p) of the bank and held-out rows, the linear head and the
    hybrid alpha p + (1 - alpha) s are tuned on the same rows. All folds run in one plan.

    A bank of fewer than two rows can't be calibrated on; its threshold is 0.5 or the only score.
    """
    scratch = Scratch(rows.sparkSession, "study")
    known = rows.where("id is not null and label is not null and group is not null")
    bank = scratch.keep(retrieval.build_banks(known, plan.cap, plan.seed), "bank")
    retrieval.guard(bank, known)
    held = known.select(F.col("group").alias("fold"), "id", "vec", "label", "group")
    most = max(*plan.ks, plan.decision_k)
    near = {r: scratch.keep(retrieval.top_k(held, bank, most, r, dim, fold="fold"), r) for r in set(RANKINGS.values())}
    ranking = RANKINGS[plan.metric]
    score = lambda n: retrieval.vote(n.where(F.col("rank") <= plan.decision_k), plan.metric, plan.gamma, by=("fold",)).select("fold", F.col("query_id").alias("id"), F.col("label").alias("y"), "score")
    test = score(near[ranking])
    train = scratch.keep(score(retrieval.top_k(bank, bank, plan.decision_k, ranking, dim, fold="fold")), "calibration")

    def heads(knn: DataFrame) -> DataFrame:
        out = knn.withColumn("head", F.lit("knn"))
        if linear is not None:
            both = knn.join(linear.select("fold", "id", "p"), ["fold", "id"])
            out = out.unionByName(both.select("fold", "id", "y", F.col("p").alias("score")).withColumn("head", F.lit("linear")))
            blend = plan.alpha * F.col("p") + (1 - plan.alpha) * F.col("score")
            out = out.unionByName(both.select("fold", "id", "y", blend.alias("score")).withColumn("head", F.lit("hybrid")))
        return out.select("head", "fold", "id", "y", "score")

    train, test = scratch.keep(heads(train), "train"), scratch.keep(heads(test), "test")
    thresholds = scratch.keep(evaluation.tune_threshold(train, "f1", ["head", "fold"]).select("head", "fold", "threshold"), "thresholds")
    knn = test.where("head = 'knn'").join(thresholds, ["head", "fold"])
    predictions = knn.select("fold", F.col("id").alias("query_id"), (F.col("score") >= F.col("threshold")).cast("int").alias("pred"))
    return Study(plan, bank, near, train, test, thresholds, predictions)


def rollup(stats: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean and sample deviation (null for one value) of each column, and the number of rows, in each group."""
    v = lambda c: F.col(c)
    aggs = [x for c in columns for x in (F.avg(v(c)).alias(f"{c}_mean"), F.stddev_samp(v(c)).alias(f"{c}_std"))]
    return stats.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class KernelPlan:
    """Settings of the kernel study: a kernel of ``retrieval.kernel_of``, on so many components, with capped banks and queries."""

    kernel: str = "fidelity"
    qubits: int = 6
    reps: int = 2
    pairs: bool = True
    cap: int = 256
    queries: int = 512
    k: int = 10
    gamma: float = 1.0
    seed: str = "0"

    def __post_init__(self) -> None:
        if self.kernel not in ("fidelity", "entangled", "rbf") or not 2 <= self.qubits <= 16:
            raise ValueError("kernel must be fidelity, entangled or rbf, and qubits 2 to 16")


def kernel_study(rows: DataFrame, dim: int, plan: KernelPlan = KernelPlan()) -> tuple[DataFrame, DataFrame]:
    """(neighbour statistics, overlaps) of the kernel's search in every fold, against cosine and RBF on the same rows.

    Vectors are projected on components of the fold's training rows. The kernel compares angles
    pi tanh(x) of the projections; the RBF kernel that stands in for it compares these angles too,
    the one it is held against the projections. Statistics are supported by votes of 0.5 or more.
    """
    scratch = Scratch(rows.sparkSession, "kernel")
    known = rows.where("id is not null and label is not null and group is not null").select("id", "group", "label", F.col("vec").alias("x"))
    projected = scratch.keep(prepare_folds(known, dim, Settings("none", components=plan.qubits)), "projected").withColumnsRenamed({"test_group": "fold", "x": "vec"})
    columns = ["fold", "id", "vec", "label", "group"]
    bank = scratch.keep(retrieval.majority_cap(projected.where("role = 'train'"), plan.cap, plan.seed, by=["fold"]).select(columns), "bank")
    retrieval.guard(bank, known)
    held = scratch.keep(retrieval.first_by_hash(projected.where("role = 'test'"), plan.queries, plan.seed, ["fold"]).select(columns), "queries")
    angles = lambda df: df.withColumn("vec", scaled_angles(F.col("vec"), plan.qubits))
    metric = "euclidean" if plan.kernel == "rbf" else plan.kernel
    by_kernel = scratch.keep(retrieval.top_k(angles(held), angles(bank), plan.k, metric, plan.qubits, fold="fold", reps=plan.reps, entangled=plan.pairs), "by_kernel")
    cosine = retrieval.top_k(held, bank, plan.k, "cosine", plan.qubits, fold="fold")
    rbf = scratch.keep(retrieval.top_k(held, bank, plan.k, "euclidean", plan.qubits, fold="fold"), "by_rbf")
    votes = retrieval.vote(by_kernel, "rbf" if plan.kernel == "rbf" else plan.kernel, 1.0, by=("fold",))
    stats = retrieval.neighbour_stats(by_kernel, plan.k, votes.select("fold", "query_id", (F.col("score") >= 0.5).cast("int").alias("pred")), ("fold",)).withColumn("kernel", F.lit(plan.kernel))
    overlaps = None
    for name, a, b in (("kernel_vs_cosine", by_kernel, cosine), ("kernel_vs_rbf", by_kernel, rbf), ("cosine_vs_rbf", cosine, rbf)):
        part = retrieval.neighbour_overlap(a, b, ("fold",)).withColumn("pair", F.lit(name))
        overlaps = part if overlaps is None else overlaps.unionByName(part)
    return stats, overlaps
