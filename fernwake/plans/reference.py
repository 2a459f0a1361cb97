"""Queries over the driver's tables for every operator family, with the SQL they are checked against."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwake.functions import vectors as V
from fernwake.functions.layout import channel_of, type_of
from fernwake.operators import contrastive, evaluation, folds, models, preparation, retrieval, sequences, significance, study
from fernwake.session import table
from fernwake.sources.recordings import class_balance, summary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

K, DIM = 10, 64
COLUMNS = ["quantity", "extendedprice", "discount", "tax"]


def register(queries: dict, oracles: dict, sql: str | None = None):
    """Puts a query, and the SQL it is checked against, under its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        queries[f.__name__] = f
        if sql:
            oracles[f.__name__] = sql
        return f

    return add


query = functools.partial(register, QUERIES, ORACLES)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


# ---- the tables in their roles -------------------------------------------------------------------


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("label") == 0).cast("int").alias("label"), (F.col("vec_id") % 8).cast("string").alias("group"))


E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y, vec_id % 8 AS g FROM embeddings)"
UNIT = "u AS (SELECT id, y, g, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM e)"


def near(metric: str, cond: str, k: int = K) -> str:
    s, order = {"cosine": ("list_dot_product(a.v, b.v)", "DESC"), "euclidean": ("list_distance(a.v, b.v)", "ASC")}[metric]
    src = "u" if metric == "cosine" else "e"
    return f"""n AS (SELECT * FROM (SELECT a.id AS q, a.y AS qy, a.g AS qg, b.id AS n, b.y AS ny, b.g AS ng, round({s}, 9) AS raw FROM {src} a JOIN {src} b ON {cond})
        QUALIFY row_number() OVER (PARTITION BY q ORDER BY raw {order}, n) <= {k})"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    miss = lambda c: F.when(F.col("l_linenumber") % 7 != 0, F.col(c))
    return l.select((F.col("l_suppkey") % 16).cast("string").alias("group"), (F.col("l_returnflag") == "R").cast("int").alias("label"), miss("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"), F.col("l_discount").alias("discount"), miss("l_tax").alias("tax"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_linestatus")


L = """l AS (SELECT CAST(l_suppkey % 16 AS VARCHAR) AS g, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CASE WHEN l_linenumber % 7 <> 0 THEN l_quantity END AS quantity,
    l_extendedprice AS extendedprice, l_discount AS discount, CASE WHEN l_linenumber % 7 <> 0 THEN l_tax END AS tax, * FROM lineitem),
    w AS (SELECT g, y, unnest(['quantity', 'extendedprice', 'discount', 'tax']) AS c, unnest([quantity, extendedprice, discount, tax]) AS v FROM l)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50 + F.col("l_tax")).alias("score"), F.col("l_linestatus").alias("model"))


S = "s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity / 50 + l_tax AS score, l_linestatus AS model FROM lineitem)"


def grid(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return significance.matched(o, "c_nationkey", "o_orderpriority", "o_totalprice")


G = """o AS (SELECT c_nationkey AS block, o_orderpriority AS model, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    m AS (SELECT * FROM o WHERE block IN (SELECT block FROM o GROUP BY block HAVING count(*) = (SELECT count(DISTINCT model) FROM o))),
    r AS (SELECT *, rank() OVER (PARTITION BY block ORDER BY value DESC) + (count(*) OVER (PARTITION BY block, value) - 1) / 2.0 AS rank FROM m)"""


# ---- retrieval -----------------------------------------------------------------------------------


def _others(spark: SparkSession, sf: str, metric: str = "cosine", k: int = K) -> DataFrame:
    e = emb(spark, sf)
    return retrieval.top_k(e, e, k, metric, DIM, other_groups=True)


def _loo(spark: SparkSession, sf: str, metric: str = "cosine", k: int = K) -> DataFrame:
    e = emb(spark, sf)
    return retrieval.top_k(e, e, k, metric, DIM)


@query(f"WITH {E}, {UNIT}, {near('cosine', 'a.g <> b.g')} SELECT q AS id, qy AS label, round(sum(greatest(raw, 0) * ny) / (sum(greatest(raw, 0)) + 1e-12), 6) AS score FROM n GROUP BY q, qy")
def knn_vote_loso(spark, sf):
    return rounded(retrieval.vote(_others(spark, sf), "cosine"), "score").withColumnRenamed("query_id", "id")


def _topk_sql(metric: str, value: str) -> str:
    return f"WITH {E}, {UNIT}, {near(metric, 'a.g <> b.g', 5)} SELECT q AS query_id, n AS neighbour_id, row_number() OVER (PARTITION BY q ORDER BY raw {'DESC' if metric == 'cosine' else ''}, n) AS rank, round({value}, 6) AS similarity FROM n"


def _topk(spark, sf, metric: str, as_metric: str) -> DataFrame:
    n = _others(spark, sf, metric, 5)
    return n.select("query_id", "neighbour_id", "rank", F.round(V.similarity(F.col("raw"), as_metric, 0.5), 6).alias("similarity"))


@query(_topk_sql("cosine", "raw"))
def cosine_topk(spark, sf):
    return _topk(spark, sf, "cosine", "cosine")


@query(_topk_sql("euclidean", "1 / (1 + raw)"))
def euclidean_topk(spark, sf):
    return _topk(spark, sf, "euclidean", "euclidean")


@query(_topk_sql("euclidean", "exp(-0.5 * raw * raw)"))
def rbf_topk(spark, sf):
    return _topk(spark, sf, "euclidean", "rbf")


@query(f"WITH {E}, {UNIT}, {near('cosine', 'a.id <> b.id', 5)} SELECT q AS id, qy AS label, round(avg(ny), 6) AS score FROM n GROUP BY q, qy")
def leave_self_out_scores(spark, sf):
    return rounded(retrieval.vote(_loo(spark, sf, k=5), "cosine", weighted=False), "score").withColumnRenamed("query_id", "id")


@query(f"""WITH {E}, {UNIT}, {near('cosine', 'a.id <> b.id')}, x AS (SELECT q, avg(ny) AS p, avg(CASE WHEN ng = qg THEN 1.0 ELSE 0 END) AS s, count(DISTINCT ng) / {K}.0 AS d FROM n GROUP BY q)
    SELECT round(avg(p), 6) AS positive_ratio, round(avg(s), 6) AS same_group, round(avg(d), 6) AS diversity, count(*) AS n_queries FROM x""")
def neighbor_analysis(spark, sf):
    return rounded(retrieval.neighbour_stats(_loo(spark, sf), K), "positive_ratio", "same_group", "diversity").select("positive_ratio", "same_group", "diversity", "n_queries")


@query(f"""WITH {E}, {UNIT}, {near('cosine', 'a.g <> b.g')}, x AS (SELECT q, avg(ny) AS p, sum(greatest(raw, 0) * ny) / (sum(greatest(raw, 0)) + 1e-12) >= 0.15 AS pred FROM n GROUP BY q)
    SELECT round(avg(p), 6) AS positive_ratio, round(avg(p) FILTER (WHERE pred), 6) AS support_predicted_1, round(avg(p) FILTER (WHERE NOT pred), 6) AS support_predicted_0, count(*) AS n_queries FROM x""")
def neighbor_support(spark, sf):
    n = _others(spark, sf)
    pred = retrieval.vote(n, "cosine").select("query_id", (F.col("score") >= 0.15).cast("int").alias("pred"))
    return rounded(retrieval.neighbour_stats(n, K, pred), "positive_ratio", "support_predicted_1", "support_predicted_0").select("positive_ratio", "support_predicted_1", "support_predicted_0", "n_queries")


@query(f"WITH {E} SELECT id, y AS label FROM e WHERE y = 1 UNION ALL SELECT id, y FROM (SELECT id, y, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '42'), id) AS r FROM e WHERE y <> 1) WHERE r <= 200")
def majority_cap(spark, sf):
    return retrieval.majority_cap(emb(spark, sf), 200, "42").select("id", "label")


@query(f"WITH {E} SELECT id, list_transform(v, lambda x: round(x / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6)) AS unit FROM e")
def l2_normalize(spark, sf):
    return emb(spark, sf).select("id", F.transform(V.l2_normalize(F.col("vec")), lambda x: F.round(x, 6)).alias("unit"))


A4 = "a4 AS (SELECT id, y, g, list_transform(v[1:4], lambda x: pi() * (exp(2 * x) - 1) / (exp(2 * x) + 1)) AS x FROM e)"


def _angles(spark, sf) -> DataFrame:
    return emb(spark, sf).withColumn("vec", V.scaled_angles(F.col("vec"), 4).cast("array<float>"))


@query(f"""WITH {E}, {A4}, z AS (SELECT x.i AS a, y.i AS b, z.i AS c, w.i AS d FROM (VALUES (1), (-1)) x(i), (VALUES (1), (-1)) y(i), (VALUES (1), (-1)) z(i), (VALUES (1), (-1)) w(i)),
    f AS (SELECT id, g, list_transform(x, lambda v: CAST(CAST(v AS FLOAT) AS DOUBLE)) AS x FROM a4),
    p AS (SELECT id, g, a, b, c, d, x[1]*a + x[2]*b + x[3]*c + x[4]*d + x[1]*x[2]*a*b + x[2]*x[3]*b*c + x[3]*x[4]*c*d AS t FROM f, z),
    v AS (SELECT id, g, list(cos(t) ORDER BY a, b, c, d) AS co, list(sin(t) ORDER BY a, b, c, d) AS si FROM p GROUP BY id, g),
    k AS (SELECT q.id AS q, b.id AS n, round((power(list_dot_product(q.co, b.co) + list_dot_product(q.si, b.si), 2) + power(list_dot_product(q.si, b.co) - list_dot_product(q.co, b.si), 2)) / 256, 9) AS raw FROM v q JOIN v b ON q.g <> b.g)
    SELECT q AS query_id, row_number() OVER (PARTITION BY q ORDER BY raw DESC, n) AS rank, round(raw, 5) AS kernel FROM k QUALIFY row_number() OVER (PARTITION BY q ORDER BY raw DESC, n) <= 5""")
def fidelity_kernel_topk(spark, sf):
    a = _angles(spark, sf)
    return retrieval.top_k(a, a, 5, "fidelity", 4, other_groups=True).select("query_id", "rank", F.round("raw", 5).alias("kernel"))


@query(f"""WITH {E}, {A4}, k AS (SELECT a.id AS q, b.id AS n, round(list_distance(a.x, b.x), 9) AS raw FROM a4 a JOIN a4 b ON a.g <> b.g)
    SELECT q AS query_id, row_number() OVER (PARTITION BY q ORDER BY raw, n) AS rank, round(exp(-raw * raw), 4) AS kernel FROM k QUALIFY row_number() OVER (PARTITION BY q ORDER BY raw, n) <= 5""")
def rbf_fallback_topk(spark, sf):
    a = _angles(spark, sf)
    return retrieval.top_k(a, a, 5, "euclidean", 4, other_groups=True).select("query_id", "rank", F.round(V.rbf(F.col("raw"), 1.0), 4).alias("kernel"))


# ---- scans, layout, folds ------------------------------------------------------------------------


@query(f"WITH {L} SELECT count(*) AS n, sum(y)::BIGINT AS n_pos, count(*) - sum(y)::BIGINT AS n_neg, round(sum(y) / count(*), 6) AS pos_rate FROM l")
def scan_class_balance(spark, sf):
    return rounded(class_balance(lines(spark, sf)), "pos_rate")


@query(f'WITH {L} SELECT g AS "group", count(*) AS n, sum(y)::BIGINT AS n_pos, round(100.0 * sum(y) / count(*), 6) AS percent FROM l GROUP BY g')
def subject_summary(spark, sf):
    return rounded(summary(lines(spark, sf), "group"), "percent")


@query("SELECT channel, count(*) AS n_types, count(*) FILTER (WHERE feature_type LIKE '%Power') AS n_bands, min(pos) AS first_pos FROM feature_layout GROUP BY channel")
def layout_channels(spark, sf):
    c = table(spark, sf, "feature_layout").select("pos", channel_of(F.col("column_name")).alias("channel"), type_of(F.col("column_name")).alias("t"))
    return c.groupBy("channel").agg(F.count(F.lit(1)).alias("n_types"), F.count(F.when(F.col("t").endswith("Power"), 1)).alias("n_bands"), F.min("pos").alias("first_pos"))


@query(f"WITH {L}, c AS (SELECT g, count(*) AS n FROM l GROUP BY g) SELECT row_number() OVER (ORDER BY g) - 1 AS fold_index, g AS test_group, n AS n_test, (SELECT count(*) FROM l) - n AS n_train FROM c")
def loso_fold_sizes(spark, sf):
    return folds.make_folds(lines(spark, sf))


# ---- the study of all folds ----------------------------------------------------------------------

CAP = 150
PLAN = study.Plan(ks=(1, 3, 5, 10), decision_k=10, gamma=0.5, cap=CAP)


def _study(spark, sf, linear: bool = False) -> study.Study:
    e = emb(spark, sf)
    p = models.probe_scores(e, DIM, retrieval.build_banks(e, CAP, "42")) if linear else None
    return study.run_study(e, DIM, PLAN, p)


BANK = f"""{E}, {UNIT}, h AS (SELECT f.g AS f, e.id, e.y, e.g, row_number() OVER (PARTITION BY f.g, e.y ORDER BY md5(CAST(e.id AS VARCHAR) || '42'), e.id) AS r FROM e, (SELECT DISTINCT g FROM e) f WHERE e.g <> f.g),
    bank AS (SELECT f, id, y, g FROM h WHERE y = 1 OR r <= {CAP})"""


def _of_bank(metric: str, k: int, name: str) -> str:
    """The ``k`` nearest bank rows of each fold's test rows."""
    s, order = {"cosine": ("list_dot_product(a.v, b.v)", "DESC"), "euclidean": ("list_distance(a.v, b.v)", "ASC")}[metric]
    v = "u" if metric == "cosine" else "e"
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY f, q ORDER BY raw {order}, n) AS rank FROM (SELECT k.f, a.id AS q, a.y AS qy, b.id AS n, k.y AS ny, k.g AS ng, round({s}, 9) AS raw
        FROM {v} a JOIN bank k ON k.f = a.g JOIN {v} b ON b.id = k.id) QUALIFY rank <= {k})"""


VOTE = "sum(greatest(raw, 0) * ny) / (sum(greatest(raw, 0)) + 1e-12)"
TUNED = f"""{BANK}, {_of_bank('cosine', 10, 'c')}, {_of_bank('euclidean', 10, 'l')}, test AS (SELECT f, q AS id, qy AS y, {VOTE} AS s FROM c GROUP BY f, q, qy),
    o AS (SELECT * FROM (SELECT k.f, k.id AS q, k.y AS qy, j.y AS ny, j.id AS n, round(list_dot_product(a.v, b.v), 9) AS raw FROM bank k JOIN u a ON a.id = k.id JOIN bank j ON j.f = k.f AND j.id <> k.id JOIN u b ON b.id = j.id)
        QUALIFY row_number() OVER (PARTITION BY f, q ORDER BY raw DESC, n) <= 10),
    train AS (SELECT f, q AS id, qy AS y, {VOTE} AS s FROM o GROUP BY f, q, qy), span AS (SELECT f, min(s) AS lo, max(s) AS hi, sum(y) AS p FROM train GROUP BY f),
    grid AS (SELECT f, i, p, CASE WHEN i = 255 THEN hi ELSE lo + i * ((hi - lo) / 255) END AS t FROM span, range(256) r(i)),
    f1 AS (SELECT g.f, i, t, round(2 * sum(y) / (count(*) + any_value(p)), 12) AS v FROM grid g JOIN train ON train.f = g.f AND s >= t GROUP BY g.f, i, t),
    best AS (SELECT f, t FROM f1 QUALIFY row_number() OVER (PARTITION BY f ORDER BY v DESC, t) = 1)"""


@query(f"WITH {BANK} SELECT CAST(f AS VARCHAR) AS fold, count(*) AS bank_size, count(*) FILTER (WHERE y = 1) AS n_pos, count(DISTINCT g) AS n_groups FROM bank GROUP BY f")
def bank_sizes(spark, sf):
    return _study(spark, sf).bank_sizes()


@query(f"""WITH {BANK}, t AS (SELECT DISTINCT g FROM e) SELECT CAST(t.g AS VARCHAR) AS test_group, count(*) FILTER (WHERE bank.g = t.g) AS of_test_group,
    count(*) FILTER (WHERE id NOT IN (SELECT id FROM e WHERE e.g <> t.g)) AS not_in_training FROM t LEFT JOIN bank ON f = (t.g + 1) % 8 GROUP BY t.g""")
def leakage_counts(spark, sf):
    """What the guard finds if each fold's bank were taken for its neighbour fold."""
    e = emb(spark, sf)
    wrong = retrieval.build_banks(e, CAP, "42").select(F.pmod(F.col("fold").cast("int") - 1, F.lit(8)).cast("string").alias("test_group"), "id", "group")
    return folds.fold_leakage(wrong, e, folds.make_folds(e))


@query(f"WITH {BANK}, {_of_bank('cosine', 10, 'c')} SELECT CAST(f AS VARCHAR) AS fold, q AS id, qy AS y, round({VOTE}, 6) AS score FROM c GROUP BY f, q, qy")
def retrieval_scores_loso(spark, sf):
    return rounded(_study(spark, sf).test.where("head = 'knn'").select("fold", "id", "y", "score"), "score")


@query(f"WITH {TUNED} SELECT CAST(f AS VARCHAR) AS fold, round(t, 6) AS threshold FROM best")
def threshold_leave_self_out(spark, sf):
    return rounded(_study(spark, sf).thresholds.select("fold", "threshold"), "threshold")


SWEEP = f"""{TUNED}, pred AS (SELECT f, id AS q, s >= t AS pos FROM test JOIN best USING (f)), m AS (SELECT 'cosine' AS metric, * FROM c UNION ALL SELECT 'euclidean', * FROM l UNION ALL SELECT 'rbf', * FROM l),
    x AS (SELECT f, metric, k, q, avg(ny) AS p, avg(CASE WHEN ng = f THEN 1.0 ELSE 0 END) AS own, count(DISTINCT ng) / count(*) AS d FROM m, (VALUES (1), (3), (5), (10)) ks(k) WHERE rank <= k GROUP BY ALL),
    stats AS (SELECT f, metric, k, avg(p) AS positive_ratio, avg(own)::DOUBLE AS same_group, avg(1 - own)::DOUBLE AS other_group, avg(d) AS diversity, avg(p) FILTER (WHERE pos) AS support_predicted_1,
        avg(p) FILTER (WHERE NOT pos) AS support_predicted_0, count(*) AS n_queries FROM x JOIN pred USING (f, q) GROUP BY ALL)"""
STATS = ["positive_ratio", "same_group", "other_group", "diversity", "support_predicted_1", "support_predicted_0"]


@query(f"WITH {SWEEP} SELECT CAST(f AS VARCHAR) AS fold, metric, k, n_queries, {', '.join(f'round({c}, 6) AS {c}' for c in STATS)} FROM stats")
def neighbor_sweep(spark, sf):
    return rounded(_study(spark, sf).neighbour_stats(), *STATS)


@query(f"WITH {SWEEP} SELECT metric, k, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std' for c in STATS)} FROM stats GROUP BY metric, k")
def neighbor_rollup(spark, sf):
    r = study.rollup(_study(spark, sf).neighbour_stats(), ["metric", "k"], STATS)
    return rounded(r, *[f"{c}_{x}" for c in STATS for x in ("mean", "std")])


JACCARD = f"""WITH {BANK}, {_of_bank('cosine', 10, 'c')}, {_of_bank('euclidean', 10, 'l')}, a AS (SELECT f, q, list(n) AS x FROM c GROUP BY f, q), b AS (SELECT f, q, list(n) AS x FROM l GROUP BY f, q),
    j AS (SELECT f, len(list_intersect(a.x, b.x)) / CAST(len(list_distinct(list_concat(a.x, b.x))) AS DOUBLE) AS o FROM a JOIN b USING (f, q)),
    o AS (SELECT f, 'cosine_vs_euclidean' AS pair, avg(o) AS overlap, count(*) AS n_queries FROM j GROUP BY f UNION ALL SELECT f, 'cosine_vs_rbf', avg(o), count(*) FROM j GROUP BY f UNION ALL SELECT f, 'euclidean_vs_rbf', 1.0, count(*) FROM j GROUP BY f)"""


@query(f"{JACCARD} SELECT CAST(f AS VARCHAR) AS fold, pair, round(overlap, 6) AS overlap, n_queries FROM o")
def neighbor_overlap(spark, sf):
    return rounded(_study(spark, sf).overlaps(), "overlap")


@query(f"{JACCARD} SELECT pair, round(avg(overlap), 6) AS overlap_mean, round(stddev_samp(overlap), 6) AS overlap_std, count(*) AS n FROM o GROUP BY pair")
def overlap_rollup(spark, sf):
    return rounded(study.rollup(_study(spark, sf).overlaps(), ["pair"], ["overlap"]), "overlap_mean", "overlap_std")


PANEL_LOSO = f"""{TUNED}, z AS (SELECT f, y, round(s, 12) AS s, t FROM test JOIN best USING (f)),
    n AS (SELECT f, any_value(t) AS threshold, count(*) FILTER (WHERE y=1 AND s>=t) AS tp, count(*) FILTER (WHERE y=0 AND s>=t) AS fp, count(*) FILTER (WHERE y=1 AND s<t) AS fn, count(*) FILTER (WHERE y=0 AND s<t) AS tn FROM z GROUP BY f),
    d AS (SELECT f, s, sum(y) AS p, sum(1 - y) AS n FROM z GROUP BY f, s), w AS (SELECT *, sum(p) OVER (PARTITION BY f ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY f ORDER BY s DESC) AS fp FROM d),
    a AS (SELECT f, sum(p * tp / (tp + fp)) / sum(p) AS ap, sum(n * (tp - p / 2)) / (sum(p) * sum(n)) AS auc FROM w GROUP BY f),
    panel AS (SELECT f, ap AS auc_pr, tp / (tp + fn) AS sensitivity, coalesce(tp / nullif(tp + fp, 0), 0) AS precision_seizure, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_seizure, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f1_nonseizure,
        (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS f1_macro, tn / (tn + fp) AS specificity, fp / ((tp + fp + fn + tn) / 3600) AS fp_per_hour,
        (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy, (tp + tn) / (tp + fp + fn + tn) AS accuracy, auc AS roc_auc, tp + fp + fn + tn AS n, tp + fn AS n_pos, threshold FROM n JOIN a USING (f))"""
RATES = [k for k in evaluation.METRIC_KEYS if k not in ("n", "n_pos")]


@query(f"WITH {PANEL_LOSO} SELECT CAST(f AS VARCHAR) AS fold, n, n_pos, {', '.join(f'round({k}, 4) AS {k}' for k in RATES)} FROM panel")
def metric_panel_loso(spark, sf):
    """The fourteen metrics of the knn head in every fold."""
    return rounded(_study(spark, sf).metrics().drop("head"), *RATES, places=4)


@query(f"""WITH {PANEL_LOSO}, v AS (UNPIVOT (SELECT * EXCLUDE (f) REPLACE (n::DOUBLE AS n, n_pos::DOUBLE AS n_pos) FROM panel) ON COLUMNS(*) INTO NAME key VALUE v), k AS (SELECT key, avg(v) AS m, coalesce(stddev_samp(v), 0) AS s, count(v) AS n FROM v GROUP BY key)
    SELECT key, round(m, 5) AS mean, round(s, 5) AS std, n, printf('%.3f +/- %.3f', m, s) AS text FROM k""")
def fold_summary(spark, sf):
    s = evaluation.summarize(_study(spark, sf).metrics().drop("head"), [])
    return rounded(s.withColumn("text", evaluation.as_text(F.col("mean"), F.col("std"))), "mean", "std", places=5)


@query()
def three_heads_panel(spark, sf):
    """The metrics of the knn, linear and hybrid heads in every fold, with a probe fitted on each fold's bank."""
    return _study(spark, sf, linear=True).metrics()


@query(f"WITH {TUNED}, p AS (SELECT id, 1 / (1 + exp(-5 * v[1])) AS p FROM e) SELECT CAST(f AS VARCHAR) AS fold, id, y, round(0.5 * p + 0.5 * s, 6) AS score FROM test JOIN p USING (id)")
def hybrid_given(spark, sf):
    """The hybrid head over probabilities given for every row, where SQL can follow it; ``hybrid_scores`` has fitted ones."""
    e = emb(spark, sf)
    folds_of = F.broadcast(e.select(F.col("group").alias("fold")).distinct())  # one row a fold
    given = e.select("id", (1 / (1 + F.exp(-5 * F.col("vec")[0].cast("double")))).alias("p")).crossJoin(folds_of)
    return rounded(study.run_study(e, DIM, PLAN, given).test.where("head = 'hybrid'").select("fold", "id", "y", "score"), "score")


@query()
def hybrid_scores(spark, sf):
    return _study(spark, sf, linear=True).test.where("head = 'hybrid'").select("fold", "id", "y", "score")


# ---- preprocessing -------------------------------------------------------------------------------


def _fits(spark, sf, **settings) -> preparation.Fits:
    return preparation.fit_folds(line_rows(spark, sf), len(COLUMNS), preparation.Settings(**settings))


def line_rows(spark, sf) -> DataFrame:
    return lines(spark, sf).select(F.col("l_orderkey").alias("id"), "group", "label", F.array(*[F.col(c).cast("double") for c in COLUMNS]).alias("x"))


Z = f"""{L}, f AS (SELECT DISTINCT g AS t FROM l), med AS (SELECT t, c, coalesce(median(v), 0) AS med FROM f JOIN w ON g <> t GROUP BY t, c), i AS (SELECT t, g, y, c, coalesce(v, med) AS v FROM w JOIN med USING (c)),
    fit AS (SELECT t, c, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.25::DOUBLE) AS q1, quantile_cont(v, 0.5::DOUBLE) AS q2, quantile_cont(v, 0.75::DOUBLE) AS q3 FROM i WHERE g <> t GROUP BY t, c)"""


@query(f'WITH {L}, f AS (SELECT DISTINCT g AS t FROM l) SELECT t AS test_group, c AS "column", round(coalesce(median(v), 0), 6) AS median FROM f JOIN w ON g <> t GROUP BY t, c')
def impute_median_loso(spark, sf):
    return rounded(_fits(spark, sf, scaler="none").table(spark, COLUMNS).select("test_group", "column", "median"), "median")


@query(f'WITH {Z} SELECT t AS test_group, c AS "column", round(mean, 5) AS mean, round(std, 5) AS std FROM fit')
def standard_scale_stats(spark, sf):
    fit = _fits(spark, sf).table(spark, COLUMNS)
    return rounded(fit.select("test_group", "column", F.col("center").alias("mean"), F.col("scale").alias("std")), "mean", "std", places=5)


@query(f'WITH {Z} SELECT t AS test_group, c AS "column", round(q2, 6) AS center, round(q3 - q1, 6) AS scale FROM fit')
def robust_scale_stats(spark, sf):
    return rounded(_fits(spark, sf, scaler="robust").table(spark, COLUMNS).select("test_group", "column", "center", "scale"), "center", "scale")


ANOVA = f"""{Z}, o AS (SELECT t, c, y, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM i WHERE g <> t GROUP BY t, c, y), k AS (SELECT t, c, (sum(n * (m - mean) * (m - mean)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))) AS f FROM o JOIN fit USING (t, c) GROUP BY t, c),
    p AS (SELECT * FROM (VALUES ('quantity', 0), ('extendedprice', 1), ('discount', 2), ('tax', 3)) x(c, place)), best AS (SELECT t, c, f, place FROM k JOIN p USING (c) QUALIFY row_number() OVER (PARTITION BY t ORDER BY f DESC, place) <= 3)"""


@query(f'WITH {ANOVA} SELECT t AS test_group, c AS "column", round(f, 4) AS f FROM best')
def anova_f_topk(spark, sf):
    return rounded(_fits(spark, sf, select=3).table(spark, COLUMNS).where("selected").select("test_group", "column", "f"), "f", places=4)


def _sides(prepared: DataFrame) -> DataFrame:
    """Each entry of the prepared rows by fold and side: number, mean, least and largest."""
    long = prepared.select("test_group", "role", F.posexplode("x").alias("place", "v"))
    return long.groupBy("test_group", "role", "place").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.min("v"), 4).alias("least"), F.round(F.max("v"), 4).alias("most"))


SIDES = "count(*) AS n, round(avg(v), 4) AS mean, round(min(v), 4) AS least, round(max(v), 4) AS most"


@query(f"""WITH {ANOVA}, s AS (SELECT t, c, row_number() OVER (PARTITION BY t ORDER BY place) - 1 AS place FROM best), x AS (SELECT t, CASE WHEN g = t THEN 'test' ELSE 'train' END AS role, place, CAST((v - mean) / std AS FLOAT) AS v FROM i JOIN fit USING (t, c) JOIN s USING (t, c))
    SELECT t AS test_group, role, place, {SIDES} FROM x GROUP BY ALL""")
def fold_prep_apply(spark, sf):
    """Imputed, scaled and selected rows of both sides of every fold."""
    return _sides(preparation.prepare_folds(line_rows(spark, sf), len(COLUMNS), preparation.Settings(select=3)))


@query(f"""WITH {Z}, p AS (SELECT * FROM (VALUES ('quantity', 0), ('extendedprice', 1), ('discount', 2), ('tax', 3)) x(c, place)), x AS (SELECT t, CASE WHEN g = t THEN 'test' ELSE 'train' END AS role, place, CAST((v - q2) / (q3 - q1) AS FLOAT) AS v FROM i JOIN fit USING (t, c) JOIN p USING (c))
    SELECT t AS test_group, role, place, {SIDES} FROM x GROUP BY ALL""")
def robust_prep_apply(spark, sf):
    return _sides(preparation.prepare_folds(line_rows(spark, sf), len(COLUMNS), preparation.Settings("robust")))


@query(f"""WITH {Z}, x AS (SELECT t, CASE WHEN g = t THEN 'test' ELSE 'train' END AS role, power((v - mean) / std, 2) AS v FROM i JOIN fit USING (t, c))
    SELECT t AS test_group, role, count(*) / 4 AS n, round(sum(v) / (count(*) / 4), 4) AS mean_square FROM x GROUP BY ALL""")
def pca_project_loso(spark, sf):
    """Projections on all components keep a row's length: its mean square by fold and side."""
    out = preparation.prepare_folds(line_rows(spark, sf), len(COLUMNS), preparation.Settings(components=4))
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return out.groupBy("test_group", "role").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg(square), 4).alias("mean_square"))


PAIR_SQL = "unnest(['quantity','quantity','quantity','quantity','extendedprice','extendedprice','extendedprice','discount','discount','tax']) AS a, unnest(['quantity','extendedprice','discount','tax','extendedprice','discount','tax','discount','tax','tax']) AS b"


@query(f"""WITH {L}, f AS (SELECT DISTINCT g AS t FROM l), k AS (SELECT t, median(quantity) AS mq, median(tax) AS mt FROM f JOIN l ON g <> t GROUP BY t), n AS (SELECT t, coalesce(quantity, mq) AS quantity, extendedprice, discount, coalesce(tax, mt) AS tax FROM k JOIN l ON g <> t),
    x AS (SELECT t, {PAIR_SQL}, unnest([quantity,quantity,quantity,quantity,extendedprice,extendedprice,extendedprice,discount,discount,tax]) AS p, unnest([quantity,extendedprice,discount,tax,extendedprice,discount,tax,discount,tax,tax]) AS q FROM n)
    SELECT t AS test_group, a, b, round(covar_samp(p, q) / (stddev_pop(p) * stddev_pop(q)), 5) AS cov FROM x GROUP BY t, a, b""")
def pca_gram(spark, sf):
    """The covariance of the imputed and scaled training columns, of which the components are taken."""
    fits = _fits(spark, sf, components=4)
    rows = [(g, a, b, float(c[i, j])) for g, c in zip(fits.groups, fits.covariance) for i, a in enumerate(COLUMNS) for j, b in enumerate(COLUMNS) if i <= j]
    return rounded(spark.createDataFrame(rows, "test_group string, a string, b string, cov double"), "cov", places=5)


@query()
def pca_loadings(spark, sf):
    fits = _fits(spark, sf, components=0.95)
    rows = [(g, k, c, float(v[k, j]), float(s[k])) for g, v, s in zip(fits.groups, fits.components, fits.share) for k in range(len(v)) for j, c in enumerate(COLUMNS)]
    return spark.createDataFrame(rows, "test_group string, component int, column string, loading double, variance_share double")


# ---- metrics and thresholds ----------------------------------------------------------------------


PANEL = f"""WITH {S}, c AS (SELECT model, count(*) FILTER (WHERE y=1 AND score>=0.5) AS tp, count(*) FILTER (WHERE y=0 AND score>=0.5) AS fp, count(*) FILTER (WHERE y=1 AND score<0.5) AS fn, count(*) FILTER (WHERE y=0 AND score<0.5) AS tn FROM s GROUP BY model)"""


@query(PANEL + """ SELECT model, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
    round(coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0), 6) AS f1_negative, round(tn / nullif(tn + fp, 0), 6) AS specificity, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
    round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / (CASE WHEN tn + fp = 0 THEN 1 ELSE 2 END), 6) AS balanced_accuracy FROM c""")
def confusion_panel(spark, sf):
    p = evaluation.confusion_panel(scored(spark, sf), 0.5, by=["model"]).drop("fp_per_hour")
    return rounded(p, "precision", "recall", "f1", "f1_negative", "specificity", "accuracy", "balanced_accuracy")


@query(PANEL + " SELECT model, round(fp / ((tp + fp + fn + tn) * 1.0 / 3600), 6) AS fp_per_hour FROM c")
def fp_per_hour(spark, sf):
    return rounded(evaluation.confusion_panel(scored(spark, sf), 0.5, by=["model"]).select("model", "fp_per_hour"), "fp_per_hour")


CURVE = f"WITH {S}, d AS (SELECT model, score, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY model, score)"


@query(CURVE + ", c AS (SELECT model, p, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM d WINDOW w AS (PARTITION BY model ORDER BY score DESC)) SELECT model, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS average_precision FROM c GROUP BY model")
def average_precision(spark, sf):
    return rounded(evaluation.average_precision(scored(spark, sf), ["model"]), "average_precision")


@query(CURVE + ", c AS (SELECT model, p, n, coalesce(sum(n) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM d) SELECT model, round(sum(p * (b + n / 2.0)) / (sum(p) * sum(n)), 6) AS roc_auc FROM c GROUP BY model")
def roc_auc(spark, sf):
    return rounded(evaluation.roc_auc(scored(spark, sf), ["model"]), "roc_auc")


def _tune_sql(criterion: str) -> str:
    value = {"f1": "coalesce(2 * tp / nullif(tp + fp + p, 0), 0)", "youden": "tp / p - fp / n", "sensitivity": "tp / p"}[criterion]
    pick = "WHERE value >= 0.8 QUALIFY row_number() OVER (PARTITION BY model ORDER BY t DESC) = 1" if criterion == "sensitivity" else "QUALIFY row_number() OVER (PARTITION BY model ORDER BY value DESC, t) = 1"
    return f"""{CURVE}, x AS (SELECT model, min(score) AS lo, max(score) AS hi, sum(p) AS p, sum(n) AS n FROM d GROUP BY model),
        t AS (SELECT model, CASE WHEN i = 255 THEN hi ELSE lo + i * ((hi - lo) / 255) END AS t, x.p, x.n FROM x, range(256) r(i)),
        v AS (SELECT t.model, t, any_value(t.p) AS p, any_value(t.n) AS n, coalesce(sum(d.p), 0) AS tp, coalesce(sum(d.n), 0) AS fp FROM t JOIN d ON d.model = t.model AND d.score >= t GROUP BY t.model, t),
        b AS (SELECT model, t, round({value}, 12) AS value FROM v) SELECT model, round(t, 6) AS threshold, round(value, 6) AS value FROM b {pick}"""


def _tuned(spark, sf, criterion: str) -> DataFrame:
    return rounded(evaluation.tune_threshold(scored(spark, sf), criterion, ["model"]), "threshold", "value")


@query(_tune_sql("f1"))
def tune_threshold_f1(spark, sf):
    return _tuned(spark, sf, "f1")


@query(_tune_sql("youden"))
def tune_threshold_youden(spark, sf):
    return _tuned(spark, sf, "youden")


@query(_tune_sql("sensitivity"))
def tune_threshold_sensitivity(spark, sf):
    return _tuned(spark, sf, "sensitivity")


@query(f"WITH {G} SELECT model, round(avg(value), 4) AS mean, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(value) END, 4) AS std, count(*) AS n FROM m GROUP BY model")
def fold_mean_std(spark, sf):
    return rounded(evaluation.mean_std(grid(spark, sf), ["model"], "value"), "mean", "std", places=4)


# ---- significance --------------------------------------------------------------------------------


@query(f"WITH {G} SELECT block, model, round(value, 4) AS value FROM m")
def pivot_matched_blocks(spark, sf):
    return rounded(grid(spark, sf), "value", places=4)


@query(f"WITH {G} SELECT block, model, CAST(rank AS DOUBLE) AS rank FROM r")
def block_ranks(spark, sf):
    return significance.block_ranks(grid(spark, sf)).select("block", "model", F.col("rank").cast("double").alias("rank"))


@query(f"""WITH {G}, t AS (SELECT coalesce(sum(c * c * c - c), 0) AS ties FROM (SELECT count(*) AS c FROM m GROUP BY block, value)), s AS (SELECT model, sum(rank) AS s, count(*) AS n FROM r GROUP BY model),
    a AS (SELECT sum(s * s)::DOUBLE AS ss, max(n)::DOUBLE AS n, count(*)::DOUBLE AS k FROM s) SELECT round((12 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))), 6) AS chi2, n::BIGINT AS n_blocks, k::BIGINT AS n_models FROM a, t""")
def friedman_chi2(spark, sf):
    return rounded(significance.friedman(grid(spark, sf)).drop("p"), "chi2")


FRIEDMAN = f"""{G}, t AS (SELECT coalesce(sum(c * c * c - c), 0) AS ties FROM (SELECT count(*) AS c FROM m GROUP BY block, value)), s AS (SELECT model, sum(rank) AS s, avg(rank)::DOUBLE AS r, count(*) AS n FROM r GROUP BY model),
    a AS (SELECT sum(s * s)::DOUBLE AS ss, max(n)::DOUBLE AS n, count(*)::DOUBLE AS k FROM s), chi AS (SELECT (12 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS x, n, k FROM a, t)"""
# upper tail of the normal distribution: Simpson's rule over twelve deviations
NORMAL_TAIL = "(SELECT sum(CASE WHEN i IN (0, 2400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power({z} + i * 0.005, 2) / 2)) * 0.005 / 3 / sqrt(2 * pi()) FROM range(2401) r(i))"


@query(f"WITH {FRIEDMAN} SELECT round(x, 6) AS chi2, round(exp(-x / 2) * (1 + x / 2), 8) AS p, n::BIGINT AS n_blocks, k::BIGINT AS n_models FROM chi")
def friedman_test(spark, sf):
    """With five models the tail of four degrees of freedom has a closed form."""
    return rounded(significance.friedman(grid(spark, sf)), "chi2").withColumn("p", F.round("p", 8))


@query(f"WITH {G}, s AS (SELECT model, avg(rank)::DOUBLE AS r, count(*) AS n FROM r GROUP BY model), k AS (SELECT count(*) AS k FROM s) SELECT x.model AS a, y.model AS b, round(abs(x.r - y.r), 6) AS rank_diff, round(abs(x.r - y.r) / sqrt(k * (k + 1) / (6.0 * x.n)), 6) AS q FROM s x JOIN s y ON x.model < y.model, k")
def nemenyi_pairs(spark, sf):
    return rounded(significance.nemenyi(grid(spark, sf)).select("a", "b", "rank_diff", "q"), "rank_diff", "q")


# tail of the range of k normal variables by nested quadrature, with the distribution function summed up on a grid of 0.01
RANGE_TAIL = """g AS (SELECT i, -9 + i * 0.01 AS z, exp(-power(-9 + i * 0.01, 2) / 2) / sqrt(2 * pi()) AS f FROM range(1801) t(i)), c AS (SELECT i, z, f, (sum(f) OVER (ORDER BY i) - f / 2) * 0.01 + f * 0 AS cdf FROM g)"""


@query(f"""WITH {FRIEDMAN}, {RANGE_TAIL}, w AS (SELECT x.model AS a, y.model AS b, abs(x.r - y.r) / sqrt(k * (k + 1) / (6 * x.n)) * sqrt(2) AS q, k FROM s x JOIN s y ON x.model < y.model, chi),
    j AS (SELECT a, b, k, f, cdf, q, z, (z - q + 9) / 0.01 AS at FROM w, c), h AS (SELECT j.a, j.b, j.k, j.f, j.cdf - coalesce(lo.cdf + (j.at - floor(j.at)) * (hi.cdf - lo.cdf), 0) AS d FROM j LEFT JOIN c lo ON lo.i = floor(j.at) LEFT JOIN c hi ON hi.i = floor(j.at) + 1)
    SELECT a, b, round(greatest(1 - k * sum(f * power(d, k - 1)) * 0.01, 0), 3) + 0 AS p FROM h GROUP BY a, b, k""")
def nemenyi_test(spark, sf):
    return significance.nemenyi(grid(spark, sf)).select("a", "b", F.round("p", 3).alias("p"))


@query(f"""WITH {G}, d AS (SELECT x.value - y.value AS d, abs(x.value - y.value) AS m FROM m x JOIN m y USING (block) WHERE x.model = '1-URGENT' AND y.model = '5-LOW' AND x.value <> y.value),
    k AS (SELECT d, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS r FROM d), t AS (SELECT coalesce(sum(c * c * c - c), 0) AS t FROM (SELECT count(*) AS c FROM d GROUP BY m)),
    s AS (SELECT coalesce(sum(r) FILTER (WHERE d > 0), 0)::DOUBLE AS w, count(*)::DOUBLE AS n FROM k) SELECT w, n::BIGINT AS n, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48.0), 6) AS z, round(abs((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48.0)) / sqrt(n), 6) AS effect FROM s, t""")
def wilcoxon_z(spark, sf):
    return rounded(significance.wilcoxon(grid(spark, sf), "1-URGENT", "5-LOW").drop("p"), "z", "effect")


def _pairs(spark, sf) -> list[tuple[str, str]]:
    models = sorted(r[0] for r in grid(spark, sf).select("model").distinct().collect())  # one row a model
    return [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]


WILCOXON = f"""{G}, d AS (SELECT x.model AS a, y.model AS b, x.value - y.value AS d, abs(x.value - y.value) AS m FROM m x JOIN m y USING (block) WHERE x.model < y.model AND x.value <> y.value),
    k AS (SELECT a, b, d, rank() OVER (PARTITION BY a, b ORDER BY m) + (count(*) OVER (PARTITION BY a, b, m) - 1) / 2.0 AS r FROM d), t AS (SELECT a, b, sum(c * c * c - c) AS t FROM (SELECT a, b, count(*) AS c FROM d GROUP BY a, b, m) GROUP BY a, b),
    s AS (SELECT a, b, coalesce(sum(r) FILTER (WHERE d > 0), 0)::DOUBLE AS w, count(*)::DOUBLE AS n FROM k GROUP BY a, b), z AS (SELECT a, b, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48.0) AS z, n FROM s JOIN t USING (a, b))"""


@query(f"WITH {WILCOXON} SELECT a, b, n::BIGINT AS n, round(z, 6) AS z, round(least(2 * {NORMAL_TAIL.format(z='abs(z)')}, 1), 6) AS p, round({NORMAL_TAIL.format(z='z')}, 6) AS p_greater FROM z")
def wilcoxon_test(spark, sf):
    """Two-sided and one-sided tests of every pair of models."""
    out, m = None, grid(spark, sf)
    for a, b in _pairs(spark, sf):
        two, one = significance.wilcoxon(m, a, b), significance.wilcoxon(m, a, b, "greater").select(F.col("p").alias("p_greater"))
        row = two.crossJoin(one).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "z", "p", "p_greater")
        out = row if out is None else out.unionByName(row)
    return rounded(out, "z", "p", "p_greater")


@query()
def significance_protocol(spark, sf):
    return significance.protocol(grid(spark, sf))


@query()
def paired_comparison(spark, sf):
    out, m = None, grid(spark, sf)
    for a, b in _pairs(spark, sf):
        row = significance.paired(m, a, b)
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {G} SELECT x.model AS a, y.model AS b, round(avg(x.value - y.value), 4) AS mean_difference, true AS inside FROM m x JOIN m y USING (block) WHERE x.model < y.model GROUP BY x.model, y.model")
def bootstrap_ci(spark, sf):
    """The mean difference of every pair of models, and whether its bootstrap interval holds it."""
    p = paired_comparison(spark, sf)
    return p.select("a", "b", F.round("mean_difference", 4).alias("mean_difference"), ((F.col("low") <= F.col("mean_difference")) & (F.col("mean_difference") <= F.col("high"))).alias("inside"))


# ---- losses, weights, views ----------------------------------------------------------------------


def _batches(spark, sf, two_views: bool = False) -> DataFrame:
    e = emb(spark, sf)
    vec = F.concat("vec", F.reverse("vec")) if two_views else F.col("vec")
    return e.select("id", F.floor(F.col("id") / 128).alias("batch"), "label", vec.alias("vec"))


B = f"""{E}, f AS (SELECT id, id // 128 AS b, y, v FROM e), l AS (SELECT p.b, p.id AS i, p.y AS yi, q.id AS j, q.y = p.y AS same, list_dot_product(p.v, q.v) / 0.1 AS s FROM f p JOIN f q ON p.b = q.b AND p.id <> q.id),
    z AS (SELECT b, i, ln(sum(exp(s - 10))) + 10 AS lse FROM l GROUP BY b, i), a AS (SELECT l.b, i, any_value(yi) AS y, avg(s - lse) FILTER (WHERE same) AS m FROM l JOIN z USING (b, i) GROUP BY l.b, i),
    c AS (SELECT b, y, count(*) AS n FROM f GROUP BY b, y), cw AS (SELECT b, y, (1.0 / n) / avg(1.0 / n) OVER (PARTITION BY b) AS w FROM c), n AS (SELECT b, count(*) AS n FROM f GROUP BY b)"""


def _loss(spark, sf, name: str) -> DataFrame:
    return rounded(contrastive.losses(_batches(spark, sf), name, DIM), "loss", places=4)


@query(f"WITH {B} SELECT b AS batch, any_value(n) AS n, round(-avg(m), 4) AS loss FROM a JOIN n USING (b) WHERE m IS NOT NULL GROUP BY b")
def supcon_loss(spark, sf):
    return _loss(spark, sf, "supcon")


@query(f"WITH {B}, k AS (SELECT b, y, -avg(m) AS x FROM a WHERE m IS NOT NULL GROUP BY b, y) SELECT b AS batch, any_value(n) AS n, round(avg(x), 4) AS loss FROM k JOIN n USING (b) GROUP BY b")
def balanced_supcon_loss(spark, sf):
    return _loss(spark, sf, "balanced")


@query(f"WITH {B} SELECT a.b AS batch, any_value(n) AS n, round(avg(-m * w), 4) AS loss FROM a JOIN n USING (b) JOIN cw ON cw.b = a.b AND cw.y = a.y WHERE m IS NOT NULL GROUP BY a.b")
def imbalance_supcon_loss(spark, sf):
    return _loss(spark, sf, "imbalance")


@query(f"WITH {B} SELECT a.b AS batch, any_value(n) AS n, round(avg(-m * w * power(1 - exp(m), 2)), 4) AS loss FROM a JOIN n USING (b) JOIN cw ON cw.b = a.b AND cw.y = a.y WHERE m IS NOT NULL GROUP BY a.b")
def focal_supcon_loss(spark, sf):
    return _loss(spark, sf, "focal")


@query(f"""WITH {E}, f AS (SELECT id, id // 128 AS b, 0 AS k, v FROM e UNION ALL SELECT id, id // 128, 1, list_reverse(v) FROM e),
    l AS (SELECT p.b, p.id AS i, p.k, p.id = q.id AS same, list_dot_product(p.v, q.v) / 0.1 AS s FROM f p JOIN f q ON p.b = q.b AND NOT (p.id = q.id AND p.k = q.k)),
    z AS (SELECT b, i, k, ln(sum(exp(s - 10))) + 10 AS lse, sum(s) FILTER (WHERE same) AS s FROM l GROUP BY b, i, k) SELECT b AS batch, count(DISTINCT i) AS n, round(avg(lse - s), 4) AS loss FROM z GROUP BY b""")
def simclr_loss(spark, sf):
    return rounded(contrastive.losses(_batches(spark, sf, True), "simclr", DIM, views=2), "loss", places=4)


@query(f"WITH {L}, c AS (SELECT y, 1.0 / count(*) AS w FROM l GROUP BY y) SELECT y AS label, round(w / (SELECT avg(w) FROM c), 6) AS weight FROM c")
def imbalance_class_weights(spark, sf):
    return rounded(contrastive.class_weights(lines(spark, sf)), "weight")


@query(f"WITH {L}, c AS (SELECT y, count(*) AS n, (CASE WHEN y = 1 THEN 4.0 ELSE 1.0 END) / count(*) AS w FROM l GROUP BY y) SELECT y AS label, n, round(w / (SELECT sum(w * n) FROM c), 10) AS weight FROM c")
def sampler_weights(spark, sf):
    return rounded(contrastive.sampler_weights(lines(spark, sf), 4.0), "weight", places=10)


# ---- sequences, events, logs ---------------------------------------------------------------------


@query("""WITH w AS (SELECT event_id, user_id, count(*) OVER f AS n, max(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER f AS window_label FROM events WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
    SELECT event_id, user_id, window_label FROM w WHERE n = 4""")
def sequence_windows(spark, sf):
    return sequences.sequence_windows(table(spark, sf, "events"), "user_id", ["ts", "event_id"], 4, (F.col("value") > 50).cast("int")).select("event_id", "user_id", "window_label")


@query("""WITH t AS (SELECT user_id, value, epoch_us(ts) // 3600000000 - k AS h FROM events, range(2) r(k))
    SELECT user_id, h AS window_hour, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 5) AS std FROM t GROUP BY ALL""")
def sliding_event_features(spark, sf):
    g = sequences.sliding_features(table(spark, sf, "events"), "user_id", "ts", "value", "2 hours", "1 hour")
    return g.select("user_id", F.floor(F.unix_micros(F.col("window_start").cast("timestamp")) / 3600000000).alias("window_hour"), "n", F.round("mean", 6).alias("mean"), F.round("std", 5).alias("std"))


@query("""WITH o AS (SELECT event_type, user_id % 4 AS shard, 1 AS version, sum(value) AS total FROM events GROUP BY ALL), n AS (SELECT event_type, user_id % 4 AS shard, 2 AS version, sum(2 * value) AS total FROM events WHERE user_id % 4 < 2 GROUP BY ALL)
    SELECT event_type, shard, version, round(total, 3) AS total FROM (SELECT * FROM o UNION ALL SELECT * FROM n) QUALIFY row_number() OVER (PARTITION BY event_type, shard ORDER BY version DESC) = 1""")
def cost_log_upsert(spark, sf):
    e = table(spark, sf, "events").withColumn("shard", F.col("user_id") % 4)
    log = lambda df, v, f: df.groupBy("event_type", "shard").agg(F.sum(f * F.col("value")).alias("total")).withColumn("version", F.lit(v))
    return rounded(sequences.upsert(log(e, 1, 1), log(e.where("shard < 2"), 2, 2), ["event_type", "shard"], "version"), "total", places=3)


@query("SELECT event_type, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def cost_log_totals(spark, sf):
    return rounded(sequences.totals_by(table(spark, sf, "events"), "event_type", "value"), "total", places=3)


@query(f"WITH {L}, f AS (SELECT g, min(l_orderkey) AS o FROM l GROUP BY g) SELECT g AS \"group\", row_number() OVER (ORDER BY o, g) - 1 AS code FROM f")
def subject_codes(spark, sf):
    return sequences.group_codes(lines(spark, sf), "group", "l_orderkey")


# ---- models --------------------------------------------------------------------------------------


def _examples(spark, sf) -> DataFrame:
    return emb(spark, sf).select("id", F.col("label").alias("y"), "group", F.col("vec").alias("x"))


def _held_out(spark, sf, name: str, **params) -> DataFrame:
    return models.held_out(name, _examples(spark, sf), DIM, **params).select("id", "y", F.round("score", 6).alias("score"))


@query()
def logreg_probe(spark, sf):
    return _held_out(spark, sf, "logreg")


@query()
def svm_rbf_approx(spark, sf):
    return _held_out(spark, sf, "svm_rbf", c=10.0, gamma=0.5)


@query()
def random_forest(spark, sf):
    return _held_out(spark, sf, "random_forest")


@query()
def gbt(spark, sf):
    return _held_out(spark, sf, "gbt")


@query()
def grid_search(spark, sf):
    _, best, ap = models.search("logreg", _examples(spark, sf), DIM, 3)
    return spark.createDataFrame([(float(best["c"]), float(ap))], "c double, average_precision double")
