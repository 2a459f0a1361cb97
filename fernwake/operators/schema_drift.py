"""Changes of column lists over time, and one consistent table of records whose fields drift."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwake.operators.ordering import link_previous, range_parts
from fernwake.operators.schema_match import Column as Field
from fernwake.operators.schema_match import changes
from fernwake.session import Scratch, broadcast_if

MOST_FILES = 20_000  # files whose names may be broadcast, of one entry a column
META = {"windowstartsec": "window_start", "windowendsec": "window_end", "label": "label"}


def bare(c: Column) -> Column:
    """A name's letters a-z and digits, without case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def column_lists(columns: DataFrame) -> DataFrame:
    """One row for each file: ``rig``, ``written_at`` and its ``cols`` in order of position.

    A list sent twice counts once (by file and position). Rows without file or column name are
    left out, as they name no column. A file's list is bounded by the width of its schema.
    """
    c = columns.select("file_name", "rig", "written_at", "col_pos", "field_id", "col_name", "col_type").dropna(subset=["file_name", "col_name"])
    c = c.dropDuplicates(["file_name", "col_pos"])
    packed = F.sort_array(F.collect_list(F.struct("col_pos", F.col("col_name").alias("name"), F.col("col_type").alias("type"), F.col("field_id").cast("long").alias("field_id"))))
    lists = c.groupBy("file_name").agg(F.min("rig").alias("rig"), F.min("written_at").alias("written_at"), packed.alias("p"))
    return lists.withColumn("cols", F.transform("p", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["field_id"].alias("field_id")))).drop("p")


def schema_changes(columns: DataFrame) -> DataFrame:
    """Every change from the file its rig wrote just before: file_name, col_name, change, other_name, score.

    ``change`` is renamed, retyped, added, removed or similar (see ``schema_match``). The file
    before is found by (written_at, file_name) in the rig; a rig's first file, and files without
    rig or time, have none and so no changes. Steps that leave the list as it was are dropped
    before the matching, and equal steps of a batch are matched once.
    """
    scratch = Scratch(columns.sparkSession, "drift")
    lists = column_lists(columns).dropna(subset=["rig", "written_at"])
    parts = range_parts(lists, "rig", ["written_at", "file_name"], scratch, "lists")
    steps = link_previous(parts, "rig", ["written_at", "file_name"], ["cols"]).where("prev is not null and prev.cols != cols")
    pairs = steps.select("file_name", F.col("prev.cols").alias("old"), F.col("cols").alias("new"))
    schema = "file_name string, col_name string, change string, other_name string, score double"

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list] = {}
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                old, new = (tuple(Field(c["name"], c["type"], c["field_id"]) for c in row[k]) for k in ("old", "new"))
                if (old, new) not in known:
                    known[old, new] = changes(list(old), list(new))
                out += [(row["file_name"], *x) for x in known[old, new]]
            known.clear() if len(known) > 2000 else None
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64()))], ["file_name", "col_name", "change", "other_name", "score"])

    return pairs.mapInArrow(match, schema)


def canonical_columns(columns: DataFrame, layout: DataFrame) -> DataFrame:
    """The consistent name of each (file_name, col_name): ``column``.

    A name that is one of the layout's or of the meta columns' once bare takes that. Another one
    takes the name that the columns with its writer's id in its rig have most files of (ties: the
    smaller name), so that a column keeps its identity through renames; without an id it is its
    bare name.
    """
    c = columns.select("file_name", "rig", "field_id", "col_name", "col_pos").dropna(subset=["file_name", "col_name"]).dropDuplicates(["file_name", "col_pos"])
    c = c.withColumn("b", bare(F.col("col_name")))
    wanted = layout.select(bare(F.col("column_name")).alias("b"), F.col("column_name").alias("known")).dropDuplicates(["b"])
    meta = columns.sparkSession.createDataFrame(list(META.items()), "b string, known string")
    c = c.join(wanted.unionByName(meta), "b", "left")
    votes = c.where("field_id is not null").groupBy("rig", "field_id", "b", "known").count()
    best = votes.groupBy("rig", "field_id").agg(F.max_by(F.coalesce("known", "b"), F.struct(F.col("known").isNotNull(), "count", "b")).alias("elected"))
    c = c.join(best, ["rig", "field_id"], "left")
    return c.select("file_name", "col_name", F.coalesce("known", "elected", F.when(F.col("b") != "", F.col("b")), "col_name").alias("column"))


def number(c: Column) -> Column:
    """A number written in any of several ways: blanks, a comma or point as decimal sign, true/false; else null.

    Of a comma and a point the last one is the decimal sign, the other parts thousands. A sign that
    stands alone is the decimal one, unless it is repeated.
    """
    t = F.lower(F.regexp_replace(c, r"[\s\u00a0']", ""))
    comma, point = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))), F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))
    last_comma = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
    no_commas, no_points = F.replace(t, F.lit(","), F.lit("")), F.replace(t, F.lit("."), F.lit(""))
    decimal = F.when((comma > 0) & (point > 0), F.when(last_comma, F.replace(no_points, F.lit(","), F.lit("."))).otherwise(no_commas))
    decimal = decimal.when(comma > 1, no_commas).when(point > 1, no_points).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    value = F.when(t == "true", 1.0).when(t == "false", 0.0).otherwise(decimal.try_cast("double"))
    return F.when(~F.isnan(value), value)


# What writers put where a reading is missing.
MISSING = ("", "nan", "null", "none", "na", "n/a", "-")


def unified(raw: DataFrame, columns: DataFrame, layout: DataFrame) -> DataFrame:
    """``raw`` records of all files as one table.

    Columns: file_name, row_no, window_start, window_end, label, ``features`` (array<double>, the
    layout's columns in its order, null where the file lacks one), ``extra`` (the other columns as
    an array of (column, value, text) by name) and ``n_unread``. Values are cast with ``number``;
    what is no number, or a label other than 0 and 1, is null, ``text`` has it as it was written,
    and ``n_unread`` counts such texts of the record, those that stand for a missing value left out. If several fields of a record are one column,
    the one with a value and the smaller field name is taken. A record sent twice counts once, by
    its longest payload (ties: the larger text). A payload that is no JSON object gives a row of nulls. Keys absent from the file's list are named
    by their bare form.

    A file's names are one map, joined once to its records; everything else is done in the row.
    ``layout`` is a dimension table of one row a position.
    """
    dims = layout.select("pos", "column_name").where("pos is not null and column_name is not null").orderBy("pos").collect()
    width = max((r["pos"] for r in dims), default=-1) + 1
    at = {r["pos"]: r["column_name"] for r in reversed(dims)}
    text_map = lambda d: F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv]) if d else F.create_map().cast("map<string,string>")
    by_bare = text_map({plain_name(n): n for n in reversed([r["column_name"] for r in dims])})
    names = canonical_columns(columns, layout).groupBy("file_name", "col_name").agg(F.min("column").alias("column"))
    names = names.groupBy("file_name").agg(F.map_from_entries(F.collect_list(F.struct("col_name", "column"))).alias("_names"))
    longest = F.max(F.struct(F.length("payload"), "payload"))["payload"]
    r = raw.groupBy("file_name", "row_no").agg(longest.alias("payload"))
    r = r.join(broadcast_if(names, MOST_FILES), "file_name", "left").withColumn("_fields", F.map_entries(F.from_json("payload", "map<string,string>")))
    bare_key = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", "")
    named = lambda k: F.coalesce(F.try_element_at("_names", k), F.try_element_at(by_bare, bare_key(k)), bare_key(k))
    cells = F.transform("_fields", lambda e: F.struct(named(e["key"]).alias("column"), number(e["value"]).isNull().alias("empty"), e["key"].alias("key"), number(e["value"]).alias("value"), e["value"].alias("text")))
    r = r.withColumn("_cells", F.array_sort(F.coalesce(cells, F.array().cast("array<struct<column:string,empty:boolean,key:string,value:double,text:string>>"))))
    first = F.filter("_cells", lambda x, i: (i == 0) | (x["column"] != F.get("_cells", i - 1)["column"]))
    r = r.withColumn("_row", F.map_from_entries(F.transform(first, lambda x: F.struct(x["column"].alias("key"), x["value"].alias("value")))))
    value = lambda c: F.try_element_at("_row", F.lit(c))
    features = F.array(*[value(at[p]) if p in at else F.lit(None).cast("double") for p in range(width)]) if width else F.array().cast("array<double>")
    wanted = F.array(*map(F.lit, [*at.values(), *META.values()]))
    extra = F.transform(F.filter("_cells", lambda x: ~F.array_contains(wanted, x["column"])), lambda x: F.struct(x["column"].alias("column"), x["value"].alias("value"), x["text"].alias("text")))
    no_label = lambda x: (x["column"] == META["label"]) & ~x["value"].isin(0.0, 1.0)
    unread = F.size(F.filter("_cells", lambda x: (x["empty"] & x["text"].isNotNull() & ~F.lower(F.trim(x["text"])).isin(*MISSING)) | F.coalesce(no_label(x), F.lit(False))))
    label = value("label")
    return r.select("file_name", "row_no", *[value(m).alias(m) for m in ("window_start", "window_end")], F.when(label.isin(0.0, 1.0), label.cast("int")).alias("label"), features.alias("features"), extra.alias("extra"), unread.alias("n_unread"))


def plain_name(name: str) -> str:
    """``bare`` of a name on the driver."""
    return re.sub("[^a-z0-9]", "", name.lower())


def change_counts(found: DataFrame) -> DataFrame:
    """Number of files and of changes for each kind of change."""
    return found.groupBy("change").agg(F.count(F.lit(1)).alias("n_changes"), F.countDistinct("file_name").alias("n_files"))
