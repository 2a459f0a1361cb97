"""Queries that write and read back: scans, sinks, archives, streams; encoders, training, signals, budgets."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernwake.functions.layout import Layout
from fernwake.operators import accounting, contrastive, encoders, folds, retrieval, sequences, study, training
from fernwake.plans import reference as R
from fernwake.session import Scratch, table
from fernwake.sources import recordings
from fernwake.streaming import scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
query = functools.partial(R.register, QUERIES, ORACLES)

LAYOUT = Layout([f"c{c}{t}" for c in range(16) for t in ("Mean", "Std", "AlphaPower", "BetaPower")])  # roles of the embeddings' 64 entries


def _folder(spark: SparkSession, name: str) -> str:
    return Scratch(spark, name).root


# ---- scans and sinks -----------------------------------------------------------------------------

SUBJECT = "CASE WHEN l_suppkey % 16 = 15 THEN 'chb21' ELSE 'chb' || lpad(CAST(l_suppkey % 16 + 1 AS VARCHAR), 2, '0') END"
RECORDED = f"""f AS (SELECT *, {SUBJECT} AS filed, {SUBJECT} || '_' || CASE l_linestatus WHEN 'O' THEN '01' ELSE '02' END AS recording FROM lineitem),
    o AS (SELECT *, CASE filed WHEN 'chb21' THEN 'chb01' ELSE filed END AS subject, row_number() OVER (PARTITION BY recording ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity, l_shipdate) - 1 AS place FROM f),
    n AS (SELECT subject, recording, count(*) AS n FROM o GROUP BY ALL), s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY subject, recording ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM n)"""


def _recorded(spark, sf) -> str:
    """Recording files of two kinds, of which the second lacks a column."""
    folder = _folder(spark, "recorded")
    l = table(spark, sf, "lineitem")
    number = F.col("l_suppkey") % 16
    filed = F.when(number == 15, "chb21").otherwise(F.concat(F.lit("chb"), F.lpad((number + 1).cast("string"), 2, "0")))
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate"]
    for status, nth in (("O", "01"), ("F", "02")):
        rows = l.where(F.col("l_linestatus") == status) if status == "O" else l.where(F.col("l_linestatus") != "O")
        features = {"AMean": F.col("l_quantity"), "A.Std": F.col("l_extendedprice"), "BMean": F.col("l_discount")}
        if status == "O":
            features["B Std"] = F.col("l_tax")
        df = rows.select(F.concat(filed, F.lit(f"_{nth}_features")).alias("file"), F.col("l_linenumber").cast("double").alias("windowStartSec"), F.lit(2.0).alias("windowEndSec"), (F.col("l_returnflag") == "R").cast("int").alias("label"), *[v.alias(k) for k, v in features.items()], *order)
        recordings.write_recordings(df, folder, "file", order)
    return folder


def _scan(folder: str) -> recordings.ScanConfig:
    return recordings.ScanConfig(folder, aliases={"chb21": "chb01"}, columns=("AMean", "A.Std", "BMean", "B Std"), missing="impute")


@query(f"""WITH {RECORDED} SELECT s.subject, s.recording, any_value(s.n) AS n, any_value(s.start) AS first_row, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS n_pos, sum((start + place) * l_linenumber)::BIGINT AS placed, round(sum(l_quantity), 2) AS a_mean, count(CASE WHEN l_linestatus = 'O' THEN l_tax END) AS b_std_known
    FROM o JOIN s USING (subject, recording) GROUP BY s.subject, s.recording""")
def scan_recordings(spark, sf):
    """Files written one a recording, scanned with an alias, a drifting column, and every row's place."""
    df, _ = recordings.read_recordings(spark, _scan(_recorded(spark, sf)))
    x = lambda i: F.get("features", F.lit(i))
    out = df.groupBy("subject", "recording").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_row"), F.sum(F.col("label").cast("long")).alias("n_pos"), F.sum(F.col("row_idx") * F.col("window_start").cast("long")).alias("placed"), F.round(F.sum(x(0).cast("double")), 2).alias("a_mean"), F.count(x(3)).alias("b_std_known"))
    return out


@query(f"WITH {RECORDED} SELECT subject, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS n_pos, round(100.0 * sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*), 6) AS percent FROM o WHERE subject IN ('chb01', 'chb02', 'chb07') GROUP BY subject")
def scan_cached(spark, sf):
    """The cache's second reading, and some subjects of it."""
    folder = _recorded(spark, sf)
    cache = f"{folder}-cache"
    recordings.cached_recordings(spark, _scan(folder), cache)
    rows, columns = recordings.cached_recordings(spark, _scan(folder), cache)
    assert columns == ["AMean", "A.Std", "BMean", "B Std"]
    return R.rounded(recordings.summary(recordings.of_subjects(rows, ["chb01", "chb02", "chb07"])), "percent")


@query("""SELECT o_orderstatus AS status, count(*) AS n, count(price) AS n_price, round(sum(price), 2) AS price, count(day) AS n_day, count(priority) AS n_priority FROM
    (SELECT o_orderstatus, o_totalprice AS price, NULL AS day, NULL AS priority FROM orders UNION ALL SELECT o_orderstatus, NULL, o_orderdate, NULL FROM orders UNION ALL SELECT o_orderstatus, NULL, NULL, o_orderpriority FROM orders) GROUP BY ALL""")
def union_by_name(spark, sf):
    """A CSV, a JSON and a parquet table of different columns, written, read back and united."""
    folder, o = _folder(spark, "tables"), table(spark, sf, "orders")
    parts = {"a.csv": o.select("o_orderstatus", F.col("o_totalprice").alias("price")), "b.parquet": o.select("o_orderstatus", F.col("o_orderdate").alias("day")), "c.json": o.select("o_orderstatus", F.col("o_orderpriority").alias("priority"))}
    for name, df in parts.items():
        recordings.write_table(df, f"{folder}/{name}")
    both = recordings.read_tables(spark, [f"{folder}/{n}" for n in parts])
    return both.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("n_price"), F.round(F.sum("price"), 2).alias("price"), F.count("day").alias("n_day"), F.count("priority").alias("n_priority"))


@query(f"WITH {R.SWEEP} SELECT CAST(f AS VARCHAR) AS fold, metric, k, CAST(n_queries AS DOUBLE) AS n_queries, {', '.join(f'round({c}, 6) AS {c}' for c in R.STATS)} FROM stats")
def study_from_files(spark, sf):
    """The neighbour sweep out of the study's JSON files."""
    folder = _folder(spark, "study")
    recordings.write_study(R._study(spark, sf), folder, 42)
    return R.rounded(recordings.study_stats(recordings.read_studies(spark, folder)).drop("seed"), *R.STATS)


@query(f"WITH {R.BANK}, {R._of_bank('cosine', 10, 'c')} SELECT CAST(f AS VARCHAR) AS fold, q AS query_id, n AS neighbour_id, rank::INT AS rank, ny AS n_label, round(raw, 6) AS similarity FROM c")
def neighbors_from_files(spark, sf):
    folder = _folder(spark, "study")
    recordings.write_study(R._study(spark, sf), folder, 42)
    n = recordings.read_archive(spark, f"{folder}/neighbors", seed=42)
    return n.select(F.col("fold").cast("string").alias("fold"), "query_id", "neighbour_id", "rank", "n_label", F.round("similarity", 6).alias("similarity"))


@query("SELECT vec_id % 8 AS subject, count(*) AS n, sum(label)::BIGINT AS labels, round(sum(embedding[1]::DOUBLE), 4) AS first FROM embeddings GROUP BY 1")
def embedding_archive(spark, sf):
    """Embeddings archived by subject and seed, and each subject's part read back."""
    folder = _folder(spark, "archive")
    e = table(spark, sf, "embeddings").withColumn("subject", F.col("vec_id") % 8).withColumn("seed", F.lit(0))
    recordings.archive(e, folder, ["subject", "seed"])
    back = recordings.read_archive(spark, folder, seed=0)
    return back.groupBy(F.col("subject").cast("long").alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("labels"), F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 4).alias("first"))


# ---- streams -------------------------------------------------------------------------------------


def _drained(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """What a stream writes until its source is at its end."""
    folder = _folder(spark, name)
    df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query(f"WITH {R.E}, {R.UNIT}, {R.near('cosine', 'true')} SELECT q AS id, round(sum(greatest(raw, 0) * ny) / (sum(greatest(raw, 0)) + 1e-12), 5) AS score FROM n GROUP BY q")
def stream_scores(spark, sf):
    """New rows of a stream against a static bank."""
    bank = R.emb(spark, sf).select("id", "vec", "label")
    new = _stream(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return R.rounded(_drained(scoring.score_stream(new, bank, R.K, R.DIM), spark, "scores"), "score", places=5)


@query("""WITH t AS (SELECT user_id, value, epoch_us(ts) // 3600000000 - k AS h FROM events, range(2) r(k))
    SELECT user_id, h AS window_hour, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 5) AS std FROM t WHERE (h + 2) * 3600000000 <= (SELECT epoch_us(max(ts)) - 600000000 FROM events) GROUP BY ALL""")
def stream_windows(spark, sf):
    """Sliding windows of a stream, as far as the watermark has closed them."""
    w = scoring.window_stream(_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "value", "2 hours", "1 hour", "10 minutes")
    g = _drained(w, spark, "windows")
    return g.select("user_id", F.floor(F.unix_micros(F.col("window_start").cast("timestamp")) / 3600000000).alias("window_hour"), "n", F.round("mean", 6).alias("mean"), F.round("std", 5).alias("std"))


# ---- signals, sequences, layout ------------------------------------------------------------------


@query("""WITH t AS (SELECT event_type, value, epoch_us(ts) // 3600000000 - k AS h FROM events, range(4) r(k)), s AS (SELECT event_type, h, min(value) AS lo, max(value) AS hi, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM t GROUP BY ALL),
    b AS (SELECT event_type, h, CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 64), 63) ELSE 0 END AS bin, any_value(n) AS n, count(*) AS c FROM t JOIN s USING (event_type, h) GROUP BY ALL)
    SELECT event_type, h AS window_hour, any_value(s.n) AS n, round(any_value(mean), 6) AS mean, round(any_value(std), 5) AS std, round(-sum(c / b.n * log2(c / b.n)), 5) + 0 AS entropy FROM b JOIN s USING (event_type, h) GROUP BY event_type, h""")
def signal_features(spark, sf):
    """Moments and the entropy of 64 bins of each four-hour window, every hour."""
    e = table(spark, sf, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value")
    g = sequences.signal_features(e, "event_type", "t", "value", 14_400.0, 3_600.0, rate=1.0)
    g = g.select("event_type", F.floor(F.col("window_start") / 3600 + 0.5).alias("window_hour"), "n", "mean", "std", "entropy")
    return R.rounded(R.rounded(g, "mean"), "std", "entropy", places=5)


@query()
def band_powers(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    placed = e.withColumn("t", (F.row_number().over(Window.partitionBy("event_type").orderBy("us")) - 1) / 64.0)
    return sequences.signal_features(placed, "event_type", "t", "value", 2.0, 1.0, rate=64.0).drop("entropy")


@query("""WITH w AS (SELECT event_id, user_id, count(*) OVER f AS n, list(round(value, 4)) OVER f AS v FROM events WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
    SELECT event_id, user_id, v AS "values" FROM w WHERE n = 4""")
def sequence_values(spark, sf):
    e = table(spark, sf, "events").withColumn("value", F.round("value", 4))
    return sequences.gather(e, "user_id", ["ts", "event_id"], 4, "value").select("event_id", "user_id", "values")


@query("SELECT vec_id AS id, list_transform(range(16), lambda c: list_transform(range(4), lambda t: round(embedding[c * 4 + t + 1]::DOUBLE, 5))) AS grid FROM embeddings")
def grid_reshape(spark, sf):
    """Each row's entries as channels x types."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform(LAYOUT.grid(F.col("embedding")), lambda r: F.transform(r, lambda v: F.round(v.cast("double"), 5))).alias("grid"))


@query("WITH k AS (SELECT channel, count(*) AS n FROM feature_layout GROUP BY channel), t AS (SELECT feature_type AS t, count(*) AS n, list(pos ORDER BY pos)::INT[] AS places FROM feature_layout GROUP BY 1) SELECT t AS feature_type, n, places, t LIKE '%Power' AS band, (SELECT count(*) FROM k) * (SELECT count(*) FROM t) = (SELECT count(*) FROM feature_layout) AS regular FROM t")
def layout_types(spark, sf):
    """The groups of columns by type, and whether the layout is regular; one row a column on the driver."""
    names = [r[0] for r in table(spark, sf, "feature_layout").orderBy("pos").select("column_name").collect()]
    l = Layout(names)
    groups = {t: [i for i, (_, x) in enumerate(l.pairs) if x == t] for t in l.types}
    bands = {tuple(g) for g in l.band_groups()}
    return spark.createDataFrame([(t, len(g), g, tuple(g) in bands, l.regular) for t, g in groups.items()], "feature_type string, n long, places array<int>, band boolean, regular boolean")


# ---- views, batches, encoders, training ----------------------------------------------------------


@query()
def augment_views(spark, sf):
    return contrastive.augmented(R.emb(spark, sf).select("id", "vec"), LAYOUT)


def chance_sql(parts: str) -> str:
    return f"CAST('0x' || substr(md5({parts}), 1, 13) AS BIGINT) / CAST(16 AS DOUBLE) ** 13"


@query(f"""WITH {R.E}, p AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY id) - 1 AS at, count(*) OVER (PARTITION BY y) AS n FROM e), d AS (SELECT i, CASE WHEN {chance_sql("i || '|11|class'")} < 0.5 THEN 1 ELSE 0 END AS y, {chance_sql("i || '|11|row'")} AS u FROM range(512) r(i))
    SELECT i AS draw, p.id, p.y AS label FROM d JOIN p ON p.y = d.y AND p.at = floor(u * p.n)""")
def balanced_batch(spark, sf):
    return contrastive.balanced_batch(R.emb(spark, sf), 512, 0.5, 11)


def _embedded(spark, sf, arch: str, projected: bool = False, **sizes) -> DataFrame:
    s = encoders.Shape(arch, embedding=32, projection=16, **sizes)
    return encoders.embed(R.emb(spark, sf), encoders.new_weights(s, LAYOUT, 1), s, LAYOUT, projected=projected)


@query()
def mlp_embed(spark, sf):
    return _embedded(spark, sf, "mlp", hidden=(64, 64))


@query()
def cnn_embed(spark, sf):
    return _embedded(spark, sf, "cnn1d", channels=(16, 32))


@query()
def tcn_embed(spark, sf):
    return _embedded(spark, sf, "tcn", channels=(32, 32))


@query()
def transformer_embed(spark, sf):
    return _embedded(spark, sf, "cnn1d_transformer", channels=(16, 32))


@query()
def projected_embed(spark, sf):
    return _embedded(spark, sf, "mlp", True, hidden=(64, 64))


@query()
def trained_embed(spark, sf):
    """Embeddings by an encoder trained on the rows of all subjects but one, with the loss of its epochs."""
    e = R.emb(spark, sf)
    s = encoders.Shape("mlp", embedding=32, hidden=(64,), projection=16)
    w, losses = training.train_on(e.where("group <> '0'"), LAYOUT, s, training.Training(epochs=4, batch=128, steps=8))
    return encoders.embed(e, w, s, LAYOUT).withColumn("losses", F.array(*map(F.lit, losses)))


@query("""SELECT * FROM (VALUES ('mlp', 64 * 64 + 64 + 128 + 64 * 32 + 32, 2 * (64 * 64 + 64 * 32)), ('cnn1d', 16 * 4 * 3 + 16 + 32 + 16 * 32 + 32, 2 * (16 * 4 * 3 * 16 + 16 * 32)), ('tcn', 2 * (64 * 64 * 3 + 64) + 64 * 32 + 32, 2 * (2 * 64 * 64 * 3 + 64 * 32))) t(arch, encoder_parameters, flops)""")
def encoder_sizes(spark, sf):
    """Parameters of the encoders without their heads and operations a sample, from the layers' sizes."""
    rows = []
    for arch, sizes in (("mlp", {"hidden": (64,)}), ("cnn1d", {"channels": (16,)}), ("tcn", {"channels": (64,)})):
        s = encoders.Shape(arch, embedding=32, **sizes)
        found = encoders.model_stats({k: v for k, v in encoders.new_weights(s, LAYOUT, 1).items() if not k.startswith("head")}, s, LAYOUT)
        rows.append((arch, found["n_params"], found["flops"]))
    return spark.createDataFrame(rows, "arch string, encoder_parameters int, flops int")


@query()
def kernel_study(spark, sf):
    """Neighbour statistics of the fidelity kernel on six components in every fold."""
    return study.kernel_study(R.emb(spark, sf), R.DIM)[0]


@query()
def kernel_overlaps(spark, sf):
    return study.kernel_study(R.emb(spark, sf), R.DIM)[1]


REPORTS = "SELECT CAST(l_suppkey % 16 AS VARCHAR) AS report, avg(l_discount) AS step, avg(l_quantity) AS post, 23.0 AS folds, CASE WHEN l_suppkey % 16 = 3 THEN NULL ELSE 1.0 END AS seeds, 3.0 AS losses, CASE WHEN l_suppkey % 16 = 5 THEN 1500 ELSE 15 END AS epochs, 256.0 AS most, max(l_tax) * 100 AS prep FROM lineitem GROUP BY l_suppkey % 16"


@query(f"""WITH r AS ({REPORTS}), c AS (SELECT *, folds * seeds * losses AS runs, (prep + post + 15) * folds * seeds * losses AS fixed FROM r), s AS (SELECT *, least(floor(most), floor((8.5 * 3600 / 1.35 - fixed) / (runs * epochs * step))) AS steps FROM c),
    d AS (SELECT *, CASE WHEN seeds IS NULL THEN 'incomplete' WHEN steps < 32 THEN 'too little time' END AS refusal FROM s)
    SELECT report, refusal, CASE WHEN refusal IS NULL THEN steps::BIGINT END AS steps_per_epoch, CASE WHEN refusal IS NULL THEN runs::BIGINT END AS runs, CASE WHEN refusal IS NULL THEN round(runs * epochs * steps * step / 3600, 5) END AS training_hours, CASE WHEN refusal IS NULL THEN round(fixed / 3600, 5) END AS overhead_hours FROM d""")
def budget_plan(spark, sf):
    """What the measured report of each of sixteen runs affords."""
    n = F.col("l_suppkey") % 16
    r = table(spark, sf, "lineitem").groupBy(n.alias("k")).agg(F.avg("l_discount").alias("seconds_per_step"), F.avg("l_quantity").alias("post_training_seconds_first_fold"), (F.max("l_tax") * 100).alias("preprocessing_seconds_first_fold"))
    r = r.select(F.col("k").cast("string").alias("report"), "seconds_per_step", "post_training_seconds_first_fold", "preprocessing_seconds_first_fold", F.lit(23.0).alias("n_test_folds"), F.when(F.col("k") != 3, 1.0).alias("seeds"), F.lit(3.0).alias("losses"), F.when(F.col("k") == 5, 1500.0).otherwise(15.0).alias("epochs"), F.lit(256.0).alias("configured_steps_per_epoch"))
    return R.rounded(accounting.plan_budget(r).select("report", "refusal", "steps_per_epoch", "runs", "training_hours", "overhead_hours"), "training_hours", "overhead_hours", places=5)


@query("SELECT 'fold' AS stage, CAST(g AS VARCHAR) AS fold, 1::BIGINT AS n FROM range(8) t(g)")
def stage_costs(spark, sf):
    """Measured stages put twice into a keyed log: one row a stage and fold stays."""
    e, logs = R.emb(spark, sf), []
    groups = [r[0] for r in e.select("group").distinct().collect()]  # one row a group
    for _ in range(2):
        t = accounting.Tracker()
        for g in groups:
            with t.stage("fold", "count", g):
                pass
        logs.append(t.table(spark))
    log = sequences.upsert(*logs, ["stage", "method", "fold", "seed"], "version")
    return log.where("seconds >= 0 and peak_mb > 0").groupBy("stage", "fold").agg(F.count(F.lit(1)).alias("n"))


# ---- the second kernel, capped queries -----------------------------------------------------------


@query(f"WITH {R.E}, d AS (SELECT id, g, row_number() OVER (PARTITION BY g ORDER BY md5(CAST(id AS VARCHAR) || '7'), id) AS r FROM e) SELECT id, CAST(g AS VARCHAR) AS \"group\" FROM d WHERE r <= 20")
def query_cap(spark, sf):
    """Twenty queries of each group in the order of their hashes."""
    return retrieval.first_by_hash(R.emb(spark, sf).select("id", "group"), 20, "7", ["group"])


@query()
def entangled_kernel_topk(spark, sf):
    a = R._angles(spark, sf)
    return retrieval.top_k(a, a, 5, "entangled", 4, other_groups=True).select("query_id", "rank", F.round("raw", 5).alias("kernel"))


@query(f"WITH {R.E}, d AS (SELECT DISTINCT g FROM e) SELECT CAST(x.g AS VARCHAR) AS fold, count(*) AS shared FROM d x JOIN e ON e.g = x.g WHERE e.id IN (SELECT id FROM e b WHERE b.g = (x.g + 1) % 8 OR b.id % 5 = 0) GROUP BY x.g")
def shared_rows(spark, sf):
    """Rows of each fold's test side that a leaky training side, every fifth row, also holds."""
    e = R.emb(spark, sf).select("id", "group")
    test = e.withColumnRenamed("group", "fold")
    leaky = test.select("fold").distinct().crossJoin(F.broadcast(e.where("id % 5 = 0").select("id")))  # one row a fold
    return folds.intersection(test, leaky, ["fold", "id"]).groupBy("fold").agg(F.count(F.lit(1)).alias("shared"))
