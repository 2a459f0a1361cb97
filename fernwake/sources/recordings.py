"""Recording files with drifting columns as one table, and sinks."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernwake.session import broadcast_if

MOST_FILES = 200_000  # files whose first row's place may be broadcast


@dataclass(frozen=True)
class ScanConfig:
    folder: str
    pattern: str = "*.parquet"
    subject_regex: str = r"(chb\d+)"
    suffix: str = "_features"
    aliases: dict[str, str] = field(default_factory=dict)  # one physical subject's further ids
    subjects: tuple[str, ...] = ()
    meta: tuple[str, str, str] = ("windowStartSec", "windowEndSec", "label")
    columns: tuple[str, ...] = ()
    missing: str = "error"

    def __post_init__(self) -> None:
        if self.missing not in ("error", "impute"):
            raise ValueError("missing must be error or impute")
        if len(set(self.columns)) != len(self.columns):
            raise ValueError("columns must be unique")


def subject_of(name: str, regex: str) -> str:
    m = re.match(regex, name)
    if not m:
        raise ValueError(f"no subject in {name}")
    return m.group(1)


def recording_of(name: str, suffix: str = "_features") -> str:
    return os.path.splitext(name)[0].removesuffix(suffix)


def _listed(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)] if fs.exists(path) else []


def discover(spark: SparkSession, cfg: ScanConfig) -> list[tuple[str, int, int]]:
    """Path, size and time of the recording files, by name; subjects are chosen here, so other files are never read."""
    found = []
    for path, size, time in sorted(_listed(spark, cfg.folder)):
        name = path.rsplit("/", 1)[-1]
        if fnmatch.fnmatch(name, cfg.pattern) and re.match(cfg.subject_regex, name):
            s = subject_of(name, cfg.subject_regex)
            if not cfg.subjects or cfg.aliases.get(s, s) in cfg.subjects:
                found.append((path, size, time))
    if not found:
        raise FileNotFoundError(f"no recordings in {cfg.folder}")
    return found


def signature(cfg: ScanConfig, files: list[tuple[str, int, int]]) -> str:
    """A key of settings and files that changes when any of them does."""
    text = json.dumps([cfg.folder, cfg.subject_regex, sorted(cfg.aliases.items()), cfg.subjects, cfg.meta, cfg.columns, cfg.missing, files])
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def footers(spark: SparkSession, paths: list[str]) -> dict[str, tuple[tuple[str, str], ...]]:
    """Names and types of each file's columns, read from the footers in tasks; by Spark on the driver where Arrow can't reach the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            found = []
            for p in batch.column(0).to_pylist():
                try:
                    where, path = fs.FileSystem.from_uri(p)
                    found.append(json.dumps([(f.name, str(f.type)) for f in pq.read_schema(path, filesystem=where)]))
                except (OSError, ValueError, NotImplementedError):
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["path", "fields"])

    tasks = max(1, min(len(paths) // 16, 4 * spark.sparkContext.defaultParallelism))
    got = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks).mapInArrow(read, "path string, fields string").collect()  # a row a file, as the listing
    return {r["path"]: tuple(map(tuple, json.loads(r["fields"]))) if r["fields"] else tuple((f.name, f.dataType.simpleString()) for f in spark.read.parquet(r["path"]).schema) for r in got}


def read_recordings(spark: SparkSession, cfg: ScanConfig) -> tuple[DataFrame, list[str]]:
    """All recordings as (row_idx, subject, recording, window_start, window_end, label, features), and the features' names.

    Files of equal columns are scanned together, and the groups united by name. The columns are
    the given ones, else those of the first file in order of (subject, path). A file without one
    of them is an error, or has nulls there with ``missing='impute'``; a file with none of them is
    always an error; further columns are not read. ``row_idx`` orders rows by subject, path and
    place in the file, which the reader of the file tells (``_metadata.row_index``), however the
    file is split.
    """
    files = discover(spark, cfg)
    fields = footers(spark, [p for p, _, _ in files])
    by_schema: dict[tuple, list[str]] = {}
    subject = lambda p: (lambda s: cfg.aliases.get(s, s))(subject_of(p.rsplit("/", 1)[-1], cfg.subject_regex))
    ordered = sorted((p for p, _, _ in files), key=lambda p: (subject(p), p))
    for p in ordered:
        by_schema.setdefault(fields[p], []).append(p)
    columns = list(cfg.columns) or feature_columns([n for n, _ in fields[ordered[0]]], cfg.meta)
    parts = []
    tick = lambda c: F.col("`" + c.replace("`", "``") + "`")
    start, end, label = cfg.meta
    for schema, paths in by_schema.items():
        names = {n for n, _ in schema}
        lacks = [c for c in columns if c not in names]
        if len(lacks) == len(columns) or (lacks and cfg.missing == "error"):
            raise ValueError(f"{paths[0]} lacks {lacks[:5]}")
        feats = F.array(*[tick(c).cast("float") if c in names else F.lit(None).cast("float") for c in columns])
        parts.append(spark.read.parquet(*paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("_at"), tick(start).cast("float").alias("window_start"), tick(end).cast("float").alias("window_end"), tick(label).cast("tinyint").alias("label"), feats.alias("features")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    raw = F.regexp_extract("file", cfg.subject_regex, 1)
    alias = F.create_map(*[F.lit(x) for kv in cfg.aliases.items() for x in kv]) if cfg.aliases else F.create_map(F.lit(""), F.lit(""))
    out = out.withColumn("subject", F.coalesce(F.try_element_at(alias, raw), raw)).withColumn("recording", F.regexp_replace("file", re.escape(cfg.suffix) + r"\.[^.]*$|\.[^.]*$", ""))
    sizes = out.groupBy("subject", "path").count()
    ahead = Window.orderBy("subject", "path").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = sizes.select("path", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_start"))
    out = out.join(broadcast_if(starts, MOST_FILES), "path")
    return out.select((F.col("_start") + F.col("_at")).alias("row_idx"), "subject", "recording", "window_start", "window_end", "label", "features"), columns


def feature_columns(names: list[str], meta: tuple[str, ...]) -> list[str]:
    return [c for c in names if c not in meta]


def cached_recordings(spark: SparkSession, cfg: ScanConfig, cache: str) -> tuple[DataFrame, list[str]]:
    """``read_recordings`` kept as a table in the folder ``cache``, which outlives the session, under the files' signature.

    A changed file or setting gives a new signature. On a hit no recording is read.
    """
    path = f"{cache.rstrip('/')}/bundle-{signature(cfg, discover(spark, cfg))}"
    if any(p.endswith("/_SUCCESS") for p, _, _ in _listed(spark, path)):
        kept = spark.read.parquet(path)
        return kept, json.loads(kept.schema["features"].metadata["columns"])
    df, columns = read_recordings(spark, cfg)
    df = df.withColumn("features", F.col("features").alias("features", metadata={"columns": json.dumps(columns)}))
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), columns


def of_subjects(rows: DataFrame, subjects: list[str]) -> DataFrame:
    """The rows of the given subjects, in no order; none of them is an empty result."""
    return rows.where(F.col("subject").isin(subjects))


def summary(rows: DataFrame, group: str = "subject") -> DataFrame:
    """Windows, positives and their percentage of each subject."""
    pos = F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), pos.alias("n_pos"), (100.0 * pos / F.count(F.lit(1))).alias("percent"))


def write_recordings(df: DataFrame, folder: str, file: str, order: list[str]) -> None:
    """One parquet file a recording, ``<file>.parquet``, its rows in ``order``; the column ``file`` itself is not written."""
    spark = df.sparkSession
    staged = f"{folder.rstrip('/')}/_staged"
    df.repartition(F.col(file)).sortWithinPartitions(file, *order).write.mode("overwrite").option("maxRecordsPerFile", 0).partitionBy(file).parquet(staged)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for d, _, _ in _listed(spark, staged):
        parts = [p for p, _, _ in _listed(spark, d) if p.endswith(".parquet")]
        if parts:
            fs.rename(fs_path(parts[0]), fs_path(f"{folder.rstrip('/')}/{d.rsplit('=', 1)[-1]}.parquet"))
    fs.delete(fs_path(staged), True)


def class_balance(rows: DataFrame) -> DataFrame:
    n, pos = F.count(F.lit(1)), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0))
    return rows.agg(n.alias("n"), pos.alias("n_pos"), (n - pos).alias("n_neg"), (pos / F.greatest(n, F.lit(1))).alias("pos_rate"))


def write_table(df: DataFrame, path: str) -> None:
    """A table as .parquet, .csv or .json by the path's ending."""
    kind = path.rsplit(".", 1)[-1]
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown format {path}")
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else getattr(w, kind)(path)


def read_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV, JSON or parquet tables united by column name; what one lacks is null."""
    out = None
    for p in paths:
        kind = p.rsplit(".", 1)[-1]
        df = spark.read.option("header", True).option("inferSchema", True).csv(p) if kind == "csv" else getattr(spark.read, kind)(p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def flatten_stats(df: DataFrame, column: str) -> DataFrame:
    """Entries of a map column keyed "metric@k" as rows: metric, k, value."""
    x = df.select(*[c for c in df.columns if c != column], F.explode(column).alias("_key", "value"))
    return x.withColumn("metric", F.split_part("_key", F.lit("@"), F.lit(1))).withColumn("k", F.split_part("_key", F.lit("@"), F.lit(2)).try_cast("int")).drop("_key")


STUDY = "fold string, seed int, metrics map<string,map<string,double>>, thresholds map<string,double>, neighbor_stats map<string,map<string,double>>, overlaps map<string,double>, bank_size long, bank_n_pos long, bank_n_groups long"


def write_study(found, folder: str, seed: int) -> None:
    """A study's tables: ``metrics`` as one JSON object a fold, ``predictions`` and ``neighbors`` as tables, by fold and seed."""
    nested = lambda df, name, key, values: df.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct(key, F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in values])).alias("m")))).alias(name))
    flat = lambda df, name, key, value: df.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct(key, F.col(value).cast("double").alias("v")))).alias(name))
    panel, stats = found.metrics(), found.neighbour_stats()
    sizes = found.bank_sizes().withColumnsRenamed({"n_pos": "bank_n_pos", "n_groups": "bank_n_groups"})
    at = F.concat("metric", F.lit("@"), F.col("k").cast("string")).alias("at")
    out = nested(panel, "metrics", F.col("head"), [c for c in panel.columns if c not in ("head", "fold")])
    out = out.join(flat(found.thresholds, "thresholds", F.col("head"), "threshold"), "fold")
    out = out.join(nested(stats, "neighbor_stats", at, [c for c in stats.columns if c not in ("fold", "metric", "k")]), "fold")
    out = out.join(flat(found.overlaps(), "overlaps", F.col("pair"), "overlap"), "fold").join(sizes, "fold").withColumn("seed", F.lit(seed))
    out.write.mode("overwrite").json(f"{folder}/metrics")
    archive(found.test.withColumn("seed", F.lit(seed)), f"{folder}/predictions", ["fold", "seed"])
    n = found.slice(found.plan.metric, found.plan.decision_k).select("fold", "query_id", "rank", "neighbour_id", "n_label", "n_group", "similarity")
    archive(n.withColumn("seed", F.lit(seed)), f"{folder}/neighbors", ["fold", "seed"])


def read_studies(spark: SparkSession, folder: str) -> DataFrame:
    """The fold objects of a study folder, or of a folder of single JSON files; objects without neighbour statistics are left out."""
    return spark.read.schema(STUDY).json(f"{folder}/metrics").where("neighbor_stats is not null")


def study_stats(studies: DataFrame) -> DataFrame:
    """The neighbour statistics of ``read_studies`` as rows: fold, seed, metric, k and one column a statistic."""
    names = ["positive_ratio", "same_group", "other_group", "diversity", "support_predicted_1", "support_predicted_0", "n_queries"]
    x = flatten_stats(studies.select("fold", "seed", "neighbor_stats"), "neighbor_stats")
    return x.select("fold", "seed", "metric", "k", *[F.try_element_at("value", F.lit(n)).alias(n) for n in names])


def archive(df: DataFrame, path: str, keys: list[str]) -> None:
    """A table of arrays and labels in parts by ``keys`` (subject and seed, say), so that reading one of them reads no other."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def read_archive(spark: SparkSession, path: str, **keys: str | int) -> DataFrame:
    """The archive, or its part of the given keys; an absent part is empty."""
    df = spark.read.parquet(path)
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return df


def save_json(obj: object, path: str) -> None:
    """A small object of settings or results as a local JSON file; NumPy numbers and arrays as plain ones."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(obj, f, indent=1, sort_keys=True, default=lambda x: x.tolist() if hasattr(x, "tolist") else str(x))


def load_json(path: str) -> object:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
