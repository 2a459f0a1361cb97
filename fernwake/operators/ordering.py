"""Order within keys when one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernwake.session import Scratch, partitions


def range_parts(df: DataFrame, key: str, order: list[str], scratch: Scratch, name: str, n: int | None = None) -> DataFrame:
    """``df`` written in ranges of (key, order) with its range number ``part_no``.

    A range ends inside a key where the key is large, so no task holds a whole hot key. Rows with
    equal key and order stay in one range.
    """
    ranged = df.repartitionByRange(n or partitions(df.sparkSession), key, *order)
    return scratch.keep(ranged.withColumn("part_no", F.spark_partition_id()), name)


def link_previous(parts: DataFrame, key: str, order: list[str], carry: list[str]) -> DataFrame:
    """Each row of a ``range_parts`` table with ``prev``, the ``carry`` fields of the row before it.

    The row before is the next lower one by ``order`` in the same key; ``prev`` is null on a key's
    first row. Within a range it comes from a window over (range, key). For the first row of a
    range it is the last row of the nearest earlier range of the key, found among one row for each
    (key, range). ``key`` and ``order`` must not be null and ``order`` must be unique in its key.
    """
    inside = Window.partitionBy("part_no", key).orderBy(*order)
    packed = F.struct(*order, *[c for c in carry if c not in order])
    own = parts.withColumn("prev", F.lag(packed).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    last = parts.groupBy(key, "part_no").agg(F.max_by(packed, F.struct(*order)).alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(key).orderBy("part_no"))).where("_before is not null")
    before = before.select(key, "part_no", F.lit(True).alias("_first"), "_before")
    joined = own.join(before, [key, "part_no", "_first"], "left")
    return joined.withColumn("prev", F.coalesce("prev", "_before")).drop("_before", "_first")


def positions(parts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each row of a ``range_parts`` table with ``pos``, its place from 0 in its key."""
    inside = Window.partitionBy("part_no", key).orderBy(*order)
    counts = parts.groupBy(key, "part_no").count()
    ahead = Window.partitionBy(key).orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "part_no", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_start"))
    own = parts.withColumn("pos", F.row_number().over(inside).cast("long") - 1)
    return own.join(starts, [key, "part_no"]).withColumn("pos", F.col("pos") + F.col("_start")).drop("_start")


def running_sums(parts: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each row of a ``range_parts`` table with the sum of each column up to and with it in its key, as ``<column>_upto``."""
    inside = Window.partitionBy("part_no", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(key, "part_no").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    starts = totals.select(key, "part_no", *[F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_{c}") for c in columns])
    own = parts.withColumns({f"{c}_upto": F.sum(c).over(inside) for c in columns}).join(starts, [key, "part_no"])
    return own.withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


HEAVY = 1000  # a key of more than 1/1000 of the rows is joined by broadcast; there are fewer than 1,000 such keys


def join_unique(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row for each ``key`` and in ``_n`` the number of its rows in ``left``.

    Keys of more than 1/1000 of all rows, of which there can't be 1,000, are joined by broadcast,
    and so never meet in one task; the others by shuffle. ``right`` is read several times and
    should be a written table. The result is that of a plain join.
    """
    total = right.agg(F.sum("_n")).first()[0] or 0
    heavy = F.broadcast(right.where(F.col("_n") * HEAVY > total))
    rest = left.join(heavy.select(key), key, "left_anti").join(right.where(F.col("_n") * HEAVY <= total), key)
    return left.join(heavy, key).unionByName(rest).drop("_n")
