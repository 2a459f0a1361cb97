"""Runs of equal consecutive events, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwake.operators.ordering import link_previous, range_parts
from fernwake.session import Scratch

MAX_ROUNDS = 64  # doubling this often passes 2**64 events


def collapse_runs(df: DataFrame, key: str, start: str, row_id: str, value: str, max_gap: float, min_events: int = 2, end: str | None = None, tolerance: float | None = None) -> DataFrame:
    """One row for each run of equal ``value`` in ``key``, ordered by (``start``, ``row_id``).

    A run goes on while the value stays equal and the start is at most ``max_gap`` after the row
    before. With ``tolerance`` numeric values are near-identical, and a run goes on, while each is
    within it of the one before. Columns: ``key``, ``value`` (the first one), ``first_id``, ``last_id``, ``n_events``, ``start``,
    ``duration`` (to the latest known end, or the last start where no end is known).

    Each row points to the row before it if that row matches, else to itself. In every round the
    pointers of the rows not yet at a run's start are replaced by their targets' pointers (a
    self-join on the row's id); a row is settled when its target is a start, and stays in the table
    of the round in which it settled. Unsettled rows have targets that differ from each other, so
    no join key is hot however long a run is. Pointers unsettled after 64 rounds are an error.

    Rows repeated under one id count once. Rows with a null value are left out before ordering, as
    are rows without key, start or id, which have no place in a sequence. NaN starts count as
    null. Equal starts are ordered by id. An empty input gives an empty result; other columns of
    any name are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "runs")
    ends = F.col(end).cast("double") if end else F.lit(None).cast("double")
    t = F.col(start).cast("double")
    base = df.select(F.col(key).alias("k"), F.when(~F.isnan(t), t).alias("t"), F.col(row_id).alias("id"), F.col(value).alias("v"), ends.alias("e")).dropna(subset=["k", "t", "id", "v"])
    base = base.groupBy("id").agg(F.min("k").alias("k"), F.min("t").alias("t"), F.min("v").alias("v"), F.max("e").alias("e"))
    parts = range_parts(base, "k", ["t", "id"], scratch, "ordered")
    linked = link_previous(parts, "k", ["t", "id"], ["v"])
    same = F.col("prev.v") == F.col("v") if tolerance is None else F.abs(F.col("prev.v").cast("double") - F.col("v").cast("double")) <= tolerance
    goes_on = F.col("prev").isNotNull() & F.coalesce(same & (F.col("t") - F.col("prev.t") <= max_gap), F.lit(False))
    state = scratch.keep(linked.select("id", F.when(goes_on, F.col("prev.id")).otherwise(F.col("id")).alias("ptr"), (~goes_on).alias("settled")), "pointers")
    done = state.where("settled")
    for _ in range(MAX_ROUNDS):
        moving = state.where("not settled")
        if moving.isEmpty():
            break
        target = done.unionByName(moving).select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("settled").alias("at_start"))
        state = scratch.keep(moving.join(target, "ptr").select("id", F.col("next").alias("ptr"), F.col("at_start").alias("settled")), "pointers")
        done = done.unionByName(state.where("settled"))
    else:
        raise RuntimeError(f"pointers have not settled in {MAX_ROUNDS} rounds")
    rows = parts.join(done.select("id", F.col("ptr").alias("first_id")), "id")
    last = F.max_by("id", F.struct("t", "id"))
    runs = rows.groupBy("first_id").agg(F.min("k").alias(key), F.min_by("v", F.struct("t", "id")).alias(value), last.alias("last_id"), F.count(F.lit(1)).alias("n_events"), F.min("t").alias("start"), F.max(F.coalesce(F.greatest("e", "t"), F.col("t"))).alias("_end"))
    runs = runs.where(F.col("n_events") >= min_events)
    return runs.select(key, value, "first_id", "last_id", "n_events", "start", (F.col("_end") - F.col("start")).alias("duration"))
