"""Classical models behind one interface and search over grids with group-wise folds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwake.functions.arrays import from_matrix, to_matrix
from fernwake.operators.evaluation import average_precision

AT_ONCE = 2  # folds fitted at a time
GRIDS = {"logreg": {"c": [0.01, 0.1, 1.0, 10.0]}, "svm_rbf": {"c": [0.1, 1.0, 10.0, 100.0], "gamma": ["scale", 0.001, 0.01, 0.1], "balanced": [True, False]}, "random_forest": {}, "gbt": {}}


def balanced(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` that have a class, with ``weight``: n / (classes * rows of the class); and n."""
    n = {r["y"]: r["count"] for r in rows.where("y is not null").groupBy("y").count().collect()}  # one row a class
    total = sum(n.values())
    weight = F.lit(None).cast("double")
    for y, count in sorted(n.items()):  # literals, as joins in every fold's fit would fill the driver
        weight = F.when(F.col("y") == y, total / (len(n) * count)).otherwise(weight)
    return rows.where("y is not null").withColumn("weight", weight), total


def fourier(rows: DataFrame, dim: int, gamma: float, features: int = 256, seed: int = 3) -> DataFrame:
    """Random Fourier features of an RBF kernel, in place of ``x``: an approximation, as there is no exact kernel machine."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, math.sqrt(2 * gamma), (dim, features)), rng.uniform(0, 2 * math.pi, features)
    rest = [c for c in rows.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, taken = to_matrix(batch.column(len(rest)), dim)
            kept = batch.filter(pa.array(taken))
            z = math.sqrt(2 / features) * np.cos(np.nan_to_num(m) @ w + b)
            yield pa.RecordBatch.from_arrays([*kept.columns[: len(rest)], from_matrix(z, pa.float64())], [*rest, "x"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*rest).schema)
    return rows.select(*rest, F.col("x").cast("array<float>")).mapInArrow(run, f"{fields}, x array<double>")


def scale_gamma(rows: DataFrame, dim: int) -> float:
    """1 / (dim * variance of all entries), 1 where they don't vary."""
    v = rows.select(F.explode("x").alias("v")).agg(F.var_pop("v")).first()[0]
    return 1 / (dim * v) if v else 1.0


class Classifier:
    """fit on (x, y), then ``score``: the rows with ``score``, the chance of class 1 (a margin's logistic for the SVM)."""

    def __init__(self, name: str, dim: int, **params: float) -> None:
        if name not in GRIDS:
            raise ValueError(f"unknown model {name}")
        self.name, self.dim, self.params = name, dim, params

    def _features(self, rows: DataFrame) -> DataFrame:
        if self.name == "svm_rbf":
            if self.params.get("gamma", "scale") == "scale":
                self.params["gamma"] = scale_gamma(rows, self.dim)  # of the rows that are fitted first
            rows = fourier(rows, self.dim, self.params["gamma"])
        return rows.withColumn("features", array_to_vector(F.col("x").cast("array<double>")))

    def fit(self, rows: DataFrame) -> Classifier:
        data, n = balanced(self._features(rows))
        if not self.params.get("balanced", True):
            data = data.withColumn("weight", F.lit(1.0))
        c = self.params.get("c", 1.0)
        common = {"featuresCol": "features", "labelCol": "y", "weightCol": "weight"}
        weight = max(1.0, n)
        made = {
            "logreg": lambda: LogisticRegression(regParam=1 / (c * weight), maxIter=200, standardization=False, **common),
            "svm_rbf": lambda: LinearSVC(regParam=1 / (c * weight), maxIter=100, standardization=False, **common),
            "random_forest": lambda: RandomForestClassifier(numTrees=int(self.params.get("trees", 100)), maxDepth=int(self.params.get("depth", 10)), seed=5, **common),
            "gbt": lambda: GBTClassifier(maxIter=int(self.params.get("trees", 30)), maxDepth=int(self.params.get("depth", 5)), stepSize=0.1, seed=5, **common),
        }[self.name]()
        self.model = made.fit(data)
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        out = self.model.transform(self._features(rows))
        p = vector_to_array("probability")[1] if self.name != "svm_rbf" else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
        return out.withColumn("score", p).drop("features", "probability", "rawPrediction", "prediction")


def held_out(name: str, rows: DataFrame, dim: int, **params: float) -> DataFrame:
    """``rows`` (x, y, group) with the ``score`` of each by the model fitted on all other groups: one fold for each group.

    Every row of a group comes out once. Where the other groups have fewer than two classes nothing
    can be fitted, and the score is null; rows without group are in no fold.
    """
    spark = rows.sparkSession
    kept = rows.cache()
    sizes = kept.where("group is not null").groupBy("group", "y").count().collect()  # one row a group and class
    classes: dict[str, set] = {r["group"]: set() for r in sizes}
    for r in sizes:
        for g in classes:
            if g != r["group"] and r["y"] is not None:
                classes[g].add(r["y"])

    def fit(g: str) -> Classifier | None:
        return Classifier(name, dim, **params).fit(kept.where((F.col("group") != g) & F.col("y").isNotNull())) if len(classes[g]) > 1 else None

    groups = sorted(classes)
    try:
        with ThreadPool(AT_ONCE) as pool:
            fitted = pool.map(inheritable_thread_target(spark)(fit), groups, 1)
    finally:
        kept.unpersist()
    out = rows.limit(0).withColumn("score", F.lit(None).cast("double"))
    for g, m in zip(groups, fitted):
        test = rows.where(F.col("group") == g)
        scored = m.score(test) if m else test.withColumn("score", F.lit(None).cast("double"))
        out = out.unionByName(scored.select(*out.columns))
    return out


def probe_scores(rows: DataFrame, dim: int, banks: DataFrame, c: float = 1.0) -> DataFrame:
    """fold, id, p: a linear probe's chance of label 1, fitted on each fold's bank, for its bank and its held-out rows.

    ``rows`` has id, vec, label, group, ``banks`` (``retrieval.build_banks``) the capped training
    rows of each fold. A fold whose bank has fewer than two classes comes out nowhere.
    """
    spark = rows.sparkSession
    bank = banks.select("fold", "id", F.col("label").alias("y"), F.col("vec").alias("x")).cache()
    held = rows.select(F.col("group").alias("fold"), "id", F.col("label").alias("y"), F.col("vec").alias("x")).where("fold is not null").cache()
    classes = bank.groupBy("fold").agg(F.countDistinct("y").alias("n")).collect()  # one row a fold

    def fit(fold: str) -> DataFrame:
        own = bank.where(F.col("fold") == fold)
        model = Classifier("logreg", dim, c=c).fit(own)
        return model.score(own.unionByName(held.where(F.col("fold") == fold))).select("fold", "id", F.col("score").alias("p"))

    with ThreadPool(AT_ONCE) as pool:
        parts = pool.map(inheritable_thread_target(spark)(fit), sorted(r["fold"] for r in classes if r["n"] > 1), 1)
    out = rows.limit(0).select(F.col("group").alias("fold"), "id", F.lit(None).cast("double").alias("p"))
    for p in parts:
        out = out.unionByName(p)
    return out


def group_folds(rows: DataFrame, n: int) -> dict[str, int]:
    """Groups over ``n`` folds, the largest first to the smallest fold; one row a group on the driver."""
    sizes = rows.groupBy("group").count().orderBy(F.desc("count"), "group").collect()
    load, out = [0] * n, {}
    for r in sizes:
        f = load.index(min(load))
        out[r["group"]] = f
        load[f] += r["count"]
    return out


def search(name: str, rows: DataFrame, dim: int, folds: int = 3, grid: dict | None = None) -> tuple[Classifier, dict, float]:
    """The grid's first best setting by mean average precision over group-wise folds, fitted on all rows.

    Folds whose training or test rows have one class are skipped; a grid of one setting is not
    searched. Fits run ``AT_ONCE`` at a time; the driver holds a number a setting and fold.
    """
    settings = [dict(zip(g, v)) for g in [grid if grid is not None else GRIDS[name]] for v in product(*g.values())]
    best, best_ap = settings[0], float("nan")
    if len(settings) > 1:
        spark, fold = rows.sparkSession, group_folds(rows, folds)
        pairs = spark.createDataFrame(list(fold.items()), "group string, fold int")
        marked = rows.join(F.broadcast(pairs), "group").cache()  # one row a group
        have = {(r["fold"], r["y"]) for r in marked.where("y is not null").select("fold", "y").distinct().collect()}
        usable = [f for f in range(folds) if len({y for g, y in have if g != f}) > 1 and len({y for g, y in have if g == f}) > 1]

        def precision(job: tuple[int, int]) -> float | None:
            i, f = job
            scored = Classifier(name, dim, **settings[i]).fit(marked.where(F.col("fold") != f)).score(marked.where(F.col("fold") == f))
            found = average_precision(scored.select("y", "score"), []).first()
            return found[0] if found else None

        jobs = [(i, f) for i in range(len(settings)) for f in usable]
        try:
            with ThreadPool(AT_ONCE) as pool:
                got = pool.map(inheritable_thread_target(spark)(precision), jobs, 1)
        finally:
            marked.unpersist()
        for i, s in enumerate(settings):
            own = [v for (j, _), v in zip(jobs, got) if j == i and v is not None]
            mean = float(np.mean(own)) if own else float("nan")
            if mean > best_ap or math.isnan(best_ap) and not math.isnan(mean):
                best, best_ap = s, mean
    return Classifier(name, dim, **best).fit(rows), best, best_ap
