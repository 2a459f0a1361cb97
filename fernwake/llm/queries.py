"""Queries pN_ of this subpackage and the SQL they are checked against."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwake.llm import areas, leaks, mixing, neighbours, runs, splits
from fernwake.session import Scratch, table

TOKENIZERS = os.environ.get("FERNWAKE_TOKENIZERS", "/opt/tokenizers")
SHARES = {"train": 0.7, "validation": 0.15, "test": 0.15}


RADIUS_X_TRAIN = (2 - 2 * 0.95) ** 0.5  # of a cosine of 0.95, at length 1


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = neighbours.nearest_vectors(table(spark, sf_dir, "windows"), "row_idx", "features", 40, 5, radius=0.5)
    b = neighbours.nearest_vectors(table(spark, sf_dir, "fold_train"), "train_id", "x_train", 40, 5, "cosine", radius=RADIUS_X_TRAIN, per_cell=1024)
    both = a.withColumn("field", F.lit("features")).unionByName(b.withColumn("field", F.lit("x_train")))
    return both.select("field", F.least("query_id", "neighbour_id").alias("id_a"), F.greatest("query_id", "neighbour_id").alias("id_b")).distinct()


def p3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse_runs(table(spark, sf_dir, "windows"), "recording", "window_start", "row_idx", "label", 2.5, 1, "window_end")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse_runs(table(spark, sf_dir, "windows"), "recording", "window_start", "row_idx", "label", 2.5, 2)
    return found.select("recording", F.col("first_id").alias("first_row_idx"), F.col("last_id").alias("last_row_idx"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.recording_groups(table(spark, sf_dir, "recordings"), table(spark, sf_dir, "subject_aliases"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).where("n_subjects > 1").select("recording", "group_no")


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording's group and split; the shares are of delivered windows."""
    w = table(spark, sf_dir, "windows").groupBy("recording").agg(F.countDistinct("row_idx").alias("n_windows"))
    groups = _groups(spark, sf_dir).join(w, "recording", "left").na.fill(0, ["n_windows"])
    return splits.assign_splits(groups, SHARES, weight="n_windows").select("recording", "group_no", "n_windows", "split")


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each split, whether its share is kept within two points (or the heaviest group's share), and how many groups it shares with another."""
    s = Scratch(spark, "kept").keep(p4_splits(spark, sf_dir).withColumn("unit", F.coalesce(F.col("group_no").cast("string"), "recording")), "splits")
    total = s.agg(F.sum("n_windows")).first()[0] or 1
    heaviest = s.groupBy("unit").agg(F.sum("n_windows").alias("n")).agg(F.max("n")).first()[0] or 0
    want = spark.createDataFrame(list(SHARES.items()), "split string, wanted double")
    torn = s.groupBy("unit").agg(F.collect_set("split").alias("in")).where(F.size("in") > 1).select(F.explode("in").alias("split")).groupBy("split").count()
    got = want.join(s.groupBy("split").agg(F.sum("n_windows").alias("n")), "split", "left").join(torn, "split", "left")
    off = F.abs(F.coalesce("n", F.lit(0)) / F.lit(total) - F.col("wanted"))
    return got.select("split", (off <= max(0.02, heaviest / total)).alias("kept"), F.coalesce("count", F.lit(0)).alias("torn"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "item_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("phrase >= 12").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity matches that are no exact leak."""
    return _leaks(spark, sf_dir).where("phrase < 12").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "phrase", "near")


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "text", "source", f"{TOKENIZERS}/{mixing.TOKENIZER}")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).withColumnRenamed("doc", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source, whether its share is met within half a point (or that of the two longest documents, which the landing may be off by) and its documents are repeated no oftener than allowed."""
    m = Scratch(spark, "kept").keep(_mixture(spark, sf_dir), "mixture")
    total, longest = m.agg(F.sum(F.col("tokens") * F.col("copies")), F.max("tokens")).first()
    s = mixing.shares(m, table(spark, sf_dir, "mix_targets"))
    there = F.when(F.col("n_docs") > 0, F.col("target_share"))  # a source without documents gets nothing, and the others keep their proportions
    whole = s.agg(F.sum(there)).first()[0] or 1.0
    near = max(0.005, 2 * (longest or 0) / (total or 1))
    return s.select("source", (F.abs(F.col("actual_share") - F.coalesce(there / F.lit(whole), F.lit(0.0))) <= near).alias("kept"), (F.col("most_copies") <= F.col("max_repeats")).alias("capped"))


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas.document_areas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "area_labels"), table(spark, sf_dir, "areas"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _areas(spark, sf_dir).select(F.col("doc").alias("doc_id"), "area")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas.composition(_areas(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_runs, p4_found, p4_splits, p4_kept, p6_found, p6_near, p7_mixture, p7_shares, p7_kept, p8_found, p8_composition)}

# words as in functions.text: without markup, case, accents and typographic variants
_PLAIN = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ħ": "h", "ı": "i", "\u00ad": "", "\u200b": " ", "\u200c": "", "\u200d": "", "\ufeff": ""}


def _words_sql(column: str) -> str:
    t = f"lower(regexp_replace({column}, '</?[A-Za-z][^<>]*>', ' ', 'g'))"
    for a, b in _PLAIN.items():
        t = f"replace({t}, '{a}', '{b}')"
    return f"list_filter(string_split_regex(strip_accents({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


_FINITE = "len(list_filter({v}, lambda x: isfinite(x))) = 40"

ORACLES = {
    "p2_found": f"""
        WITH f AS (SELECT row_idx AS id, CAST(any_value(features) AS DOUBLE[40]) AS v FROM windows WHERE len(features) = 40 AND {_FINITE.format(v='features')} GROUP BY row_idx),
        x AS (SELECT train_id AS id, CAST(any_value(x_train) AS DOUBLE[]) AS v FROM fold_train WHERE len(x_train) = 40 AND {_FINITE.format(v='x_train')} AND list_dot_product(x_train, x_train) > 0 GROUP BY train_id),
        u AS (SELECT id, CAST(list_transform(v, lambda c: c / sqrt(list_dot_product(v, v))) AS DOUBLE[40]) AS v FROM x),
        p AS (SELECT 'features' AS field, a.id AS q, b.id AS n, array_distance(a.v, b.v) AS d FROM f a JOIN f b ON b.v[1] BETWEEN a.v[1] - 0.5 AND a.v[1] + 0.5 WHERE a.id <> b.id AND array_distance(a.v, b.v) <= 0.5
              UNION ALL SELECT 'x_train', a.id, b.id, round(array_distance(a.v, b.v), 6) FROM u a JOIN u b ON a.id <> b.id WHERE array_inner_product(a.v, b.v) >= 0.95)
        SELECT DISTINCT field, least(q, n) AS id_a, greatest(q, n) AS id_b FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY field, q ORDER BY d, n) <= 5)""",
    "p4_kept": "SELECT * FROM (VALUES ('train', true, 0::BIGINT), ('validation', true, 0), ('test', true, 0)) t(split, kept, torn)",
    "p7_kept": "SELECT source, true AS kept, true AS capped FROM mix_targets",
    "p6_near": f"""
        WITH d AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS place FROM (SELECT doc_id, {_words_sql('text')} AS w FROM documents WHERE text IS NOT NULL)),
        i AS (SELECT item_id, unnest(w) AS w, unnest(range(len(w))) AS place FROM (SELECT item_id, {_words_sql('text')} AS w FROM eval_items)),
        m AS (SELECT doc_id, item_id, d.place - i.place + s.k AS shift, i.place AS place, bool_or(s.k = 0) AS exact FROM d JOIN i USING (w), range(-2, 3) s(k) GROUP BY ALL),
        k AS (SELECT doc_id, item_id, shift FROM m GROUP BY ALL HAVING count(*) >= 12), r AS (SELECT m.* FROM m JOIN k USING (doc_id, item_id, shift)),
        a AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY place) AS run, place - row_number() OVER (PARTITION BY doc_id, item_id, shift, exact ORDER BY place) AS same FROM r),
        n AS (SELECT doc_id, item_id, shift, max(c) AS near FROM (SELECT doc_id, item_id, shift, run, count(*) AS c FROM a GROUP BY ALL) GROUP BY ALL HAVING max(c) >= 12),
        e AS (SELECT doc_id, item_id, shift, max(c) AS phrase FROM (SELECT doc_id, item_id, shift, same, count(*) AS c FROM a WHERE exact GROUP BY ALL) GROUP BY ALL)
        SELECT doc_id, item_id, max(coalesce(phrase, 0))::INT AS phrase, max(near)::INT AS near FROM n LEFT JOIN e USING (doc_id, item_id, shift) GROUP BY doc_id, item_id HAVING max(coalesce(phrase, 0)) < 12""",
    "p6_found": f"""
        WITH d AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_words_sql('text')} AS w FROM eval_items),
        dw AS (SELECT doc_id, array_to_string(w[k : k + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
        iw AS (SELECT item_id, array_to_string(w[k : k + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s)""",
    "p4_found": r"""
        WITH RECURSIVE r AS (SELECT DISTINCT recording, subject, source_signature AS sig,
            CAST(nullif(regexp_extract(lower(regexp_replace(subject, '\s', '', 'g')), '^chb0*([0-9]+)[a-z]?$', 1), '') AS BIGINT) AS num,
            upper(regexp_replace(patient_ref, '[^0-9A-Za-z]', '', 'g')) AS px FROM recordings),
        al AS (SELECT CAST(nullif(regexp_extract(lower(regexp_replace(alias, '\s', '', 'g')), '^chb0*([0-9]+)[a-z]?$', 1), '') AS BIGINT) AS a,
            CAST(nullif(regexp_extract(lower(regexp_replace(subject, '\s', '', 'g')), '^chb0*([0-9]+)[a-z]?$', 1), '') AS BIGINT) AS b FROM subject_aliases),
        e AS (SELECT DISTINCT x.num AS a, y.num AS b FROM r x JOIN r y ON x.sig = y.sig OR (x.px = y.px AND x.px LIKE 'PX%')
            UNION SELECT a, b FROM al WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM al WHERE a IS NOT NULL AND b IS NOT NULL),
        reach AS (SELECT num AS a, num AS b FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
        g AS (SELECT reach.a AS num, min(reach.b) FILTER (WHERE reach.b IN (SELECT num FROM r)) AS group_no FROM reach GROUP BY reach.a),
        m AS (SELECT recording, subject, group_no FROM r JOIN g USING (num))
        SELECT recording, group_no FROM m WHERE group_no IN (SELECT group_no FROM m GROUP BY group_no HAVING count(DISTINCT subject) > 1)""",
    "p3_found": """
        WITH d AS (SELECT DISTINCT recording, CAST(window_start AS DOUBLE) t, row_idx, label FROM windows WHERE label IS NOT NULL),
        g AS (SELECT *, lag(label) OVER w = label AND t - lag(t) OVER w <= 2.5 AS goes_on FROM d WINDOW w AS (PARTITION BY recording ORDER BY t, row_idx)),
        r AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY recording ORDER BY t, row_idx) AS run FROM g)
        SELECT recording, arg_min(row_idx, (t, row_idx)) AS first_row_idx, arg_max(row_idx, (t, row_idx)) AS last_row_idx
        FROM r GROUP BY recording, run HAVING count(*) >= 2""",
    "p3_runs": """
        WITH d AS (SELECT recording, CAST(window_start AS DOUBLE) t, row_idx, label, max(CAST(window_end AS DOUBLE)) e FROM windows WHERE label IS NOT NULL GROUP BY ALL),
        g AS (SELECT *, lag(label) OVER w = label AND t - lag(t) OVER w <= 2.5 AS goes_on FROM d WINDOW w AS (PARTITION BY recording ORDER BY t, row_idx)),
        r AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY recording ORDER BY t, row_idx) AS run FROM g)
        SELECT recording, any_value(label) AS label, arg_min(row_idx, (t, row_idx)) AS first_id, arg_max(row_idx, (t, row_idx)) AS last_id,
               count(*) AS n_events, min(t) AS start, max(greatest(e, t)) - min(t) AS duration
        FROM r GROUP BY recording, run""",
}
