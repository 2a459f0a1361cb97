"""Leave-one-group-out folds and guards against leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def make_folds(rows: DataFrame, group: str = "group", only: list[str] | None = None) -> DataFrame:
    """One fold for each group: fold_index, test_group, n_test, n_train. ``only`` restricts the tests, never the training."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_test")).withColumnRenamed(group, "test_group")
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    # one row a group; the numbering needs their order
    folds = sizes.withColumn("fold_index", F.row_number().over(Window.orderBy("test_group")) - 1).crossJoin(F.broadcast(total))
    folds = folds.select("fold_index", "test_group", "n_test", (F.col("_all") - F.col("n_test")).alias("n_train"))
    return folds.where(F.col("test_group").isin(only)) if only else folds


def leakage(bank: DataFrame, test_group: str, train_ids: DataFrame) -> DataFrame:
    """Number of bank rows of the test group, and of rows that aren't training rows."""
    return bank.agg(F.count(F.when(F.col("group") == test_group, 1)).alias("of_test_group")).crossJoin(bank.join(train_ids, "id", "left_anti").agg(F.count(F.lit(1)).alias("not_in_training")))


def fold_leakage(bank: DataFrame, members: DataFrame, folds: DataFrame) -> DataFrame:
    """``leakage`` of every fold's bank: test_group, of_test_group, not_in_training.

    ``bank`` has (test_group, id, group), ``members`` all rows (id, group), of which a fold trains
    on those of other groups. Folds with an empty bank have zeros.
    """
    # a training row of the fold is a member of a group that isn't the fold's
    own = members.select("id", F.col("group").alias("_own")).dropDuplicates(["id"])
    found = bank.join(own, "id", "left").groupBy("test_group").agg(
        F.count(F.when(F.col("group") == F.col("test_group"), 1)).alias("of_test_group"),
        F.count(F.when(F.col("_own").isNull() | (F.col("_own") == F.col("test_group")), 1)).alias("not_in_training"),
    )
    return folds.select("test_group").join(found, "test_group", "left").na.fill(0, ["of_test_group", "not_in_training"])


def assert_no_leakage(bank: DataFrame, test_group: str, train_ids: DataFrame) -> None:
    found = leakage(bank, test_group, train_ids).first()
    if found["of_test_group"] or found["not_in_training"]:
        raise ValueError(f"leakage into the bank of fold {test_group}: {found.asDict()}")


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct ``keys`` that both tables hold."""
    return a.select(*keys).intersect(b.select(*keys))
