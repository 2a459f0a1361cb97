"""Queries pN_ of the core's training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwake.operators import schema_drift, spikes
from fernwake.session import broadcast_if, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = schema_drift.schema_changes(table(spark, sf_dir, "file_columns"))
    return found.where("change != 'similar'").select("file_name", "col_name", "change")


def p1_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = schema_drift.schema_changes(table(spark, sf_dir, "file_columns"))
    return found.where("change = 'similar'").select("file_name", "col_name", "other_name", "score")


def p1_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one table, its further columns as a text of name=text."""
    u = schema_drift.unified(table(spark, sf_dir, "raw_windows"), table(spark, sf_dir, "file_columns"), table(spark, sf_dir, "feature_layout"))
    pairs = F.transform("extra", lambda x: F.concat(x["column"], F.lit("="), F.coalesce(x["text"], F.lit("?"))))
    return u.withColumn("extra", F.array_join(F.array_sort(pairs), "|"))


def _implausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = spikes.limits(table(spark, sf_dir, "feature_layout"))
    filed = table(spark, sf_dir, "recordings").groupBy("recording").agg(F.min("subject").alias("filed_as"))
    w = table(spark, sf_dir, "windows").select("row_idx", "recording", "window_start", "features")
    w = w.join(broadcast_if(filed, 200_000), "recording", "left")
    return spikes.implausible(w, "row_idx", "filed_as", "recording", "window_start", "features", 40, spikes.Tests(low=low, high=high))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _implausible(spark, sf_dir).where("far or kind in ('stuck', 'limit')")
    return found.select(F.col("row_id").alias("row_idx"), "pos").distinct()


def p5_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _implausible(spark, sf_dir)


QUERIES = {f.__name__: f for f in (p1_found, p1_similar, p1_unified, p5_found, p5_flags)}
ORACLES: dict[str, str] = {
    "p1_found": """
        WITH c AS (SELECT file_name, any_value(rig) AS rig, any_value(written_at) AS written_at, any_value(field_id) AS fid, any_value(col_name) AS name, any_value(col_type) AS type
                   FROM file_columns GROUP BY file_name, col_pos),
        f AS (SELECT file_name, min(rig) AS rig, min(written_at) AS w FROM c GROUP BY file_name),
        p AS (SELECT file_name AS new, lag(file_name) OVER (PARTITION BY rig ORDER BY w, file_name) AS old FROM f),
        n AS (SELECT p.new, p.old, c.* FROM p JOIN c ON c.file_name = p.new WHERE p.old IS NOT NULL),
        o AS (SELECT p.new, p.old, c.* FROM p JOIN c ON c.file_name = p.old),
        kept AS (SELECT n.new, n.name, n.type <> o.type AS retyped FROM n JOIN o ON n.new = o.new AND n.name = o.name),
        gained AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.new = n.new AND o.name = n.name)),
        lost AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.new = n.new AND o.name = n.name)),
        pairs AS (SELECT g.new, g.name, l.name AS was, g.type <> l.type AS retyped FROM gained g JOIN lost l ON g.new = l.new
                  AND CASE WHEN g.fid IS NOT NULL AND l.fid IS NOT NULL THEN g.fid = l.fid
                      ELSE regexp_replace(lower(g.name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(l.name), '[^a-z0-9]', '', 'g') END)
        SELECT new AS file_name, name AS col_name, 'renamed' AS change FROM pairs
        UNION ALL SELECT new, name, 'retyped' FROM pairs WHERE retyped
        UNION ALL SELECT new, name, 'retyped' FROM kept WHERE retyped
        UNION ALL SELECT new, name, 'added' FROM gained g WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.new = g.new AND p.name = g.name)
        UNION ALL SELECT new, name, 'removed' FROM lost l WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.new = l.new AND p.was = l.name)""",
    "p1_unified": r"""
        WITH c AS (SELECT file_name, any_value(rig) AS rig, any_value(field_id) AS fid, any_value(col_name) AS name, regexp_replace(lower(any_value(col_name)), '[^a-z0-9]', '', 'g') AS b
                   FROM file_columns WHERE file_name IS NOT NULL AND col_name IS NOT NULL GROUP BY file_name, col_pos),
        k AS (SELECT regexp_replace(lower(column_name), '[^a-z0-9]', '', 'g') AS b, min(column_name) AS known FROM feature_layout GROUP BY 1
              UNION ALL VALUES ('windowstartsec', 'window_start'), ('windowendsec', 'window_end'), ('label', 'label')),
        d AS (SELECT c.*, known FROM c LEFT JOIN k USING (b)),
        v AS (SELECT rig, fid, coalesce(known, b) AS elected FROM (SELECT rig, fid, b, known, count(*) AS n FROM d WHERE fid IS NOT NULL GROUP BY ALL)
              QUALIFY row_number() OVER (PARTITION BY rig, fid ORDER BY known IS NOT NULL DESC, n DESC, b DESC) = 1),
        m AS (SELECT file_name, name, min(coalesce(known, elected, nullif(b, ''), name)) AS col FROM d LEFT JOIN v USING (rig, fid) GROUP BY ALL),
        r AS (SELECT file_name, row_no, arg_max(payload, (length(payload), payload)) AS payload FROM raw_windows GROUP BY file_name, row_no),
        e AS (SELECT file_name, row_no, key, payload ->> ('$."' || key || '"') AS text FROM (SELECT file_name, row_no, payload, unnest(json_keys(payload)) AS key FROM r)),
        t AS (SELECT e.*, coalesce(m.col, k.known, regexp_replace(lower(key), '[^a-z0-9]', '', 'g')) AS col, replace(lower(regexp_replace(text, '[\s\x{00a0}'']', '', 'g')), ',', '.') AS s
              FROM e LEFT JOIN m ON m.file_name = e.file_name AND m.name = e.key LEFT JOIN k ON k.b = regexp_replace(lower(key), '[^a-z0-9]', '', 'g')),
        x AS (SELECT *, CASE s WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE nullif(try_cast(s AS DOUBLE), 'nan'::DOUBLE) END AS v FROM t),
        o AS (SELECT file_name, row_no, col, arg_min(v, key) AS v FROM (SELECT *, row_number() OVER (PARTITION BY file_name, row_no, col ORDER BY v IS NULL, key) AS nth FROM x) WHERE nth = 1 AND v IS NOT NULL GROUP BY ALL),
        p AS (SELECT r.file_name, r.row_no, max(v) FILTER (WHERE col = 'window_start') AS window_start, max(v) FILTER (WHERE col = 'window_end') AS window_end,
              CAST(max(v) FILTER (WHERE col = 'label' AND v IN (0, 1)) AS INT) AS label FROM r LEFT JOIN o USING (file_name, row_no) GROUP BY ALL),
        f AS (SELECT r.file_name, r.row_no, list(o.v ORDER BY l.pos) AS features FROM r CROSS JOIN feature_layout l LEFT JOIN o ON o.file_name = r.file_name AND o.row_no = r.row_no AND o.col = l.column_name GROUP BY ALL),
        g AS (SELECT r.file_name, r.row_no, coalesce(string_agg(x.col || '=' || coalesce(text, '?'), '|' ORDER BY x.col || '=' || coalesce(text, '?')) FILTER (WHERE x.col IS NOT NULL AND x.col NOT IN ('window_start', 'window_end', 'label') AND x.col NOT IN (SELECT column_name FROM feature_layout)), '') AS extra,
              count(*) FILTER (WHERE v IS NULL AND text IS NOT NULL AND lower(trim(text)) NOT IN ('', 'nan', 'null', 'none', 'na', 'n/a', '-') OR x.col = 'label' AND v NOT IN (0, 1))::INT AS n_unread FROM r LEFT JOIN x USING (file_name, row_no) GROUP BY ALL)
        SELECT * FROM p JOIN f USING (file_name, row_no) JOIN g USING (file_name, row_no)""",
    "p5_found": """
        WITH f AS (SELECT recording, min(subject) AS src FROM recordings GROUP BY recording),
        d AS (SELECT row_idx, any_value(recording) AS recording, any_value(window_start) AS t, any_value(features) AS x FROM windows GROUP BY row_idx),
        l AS (SELECT d.row_idx, d.recording, d.t, p.pos, CAST(d.x[p.pos + 1] AS DOUBLE) AS v, p.feature_type AS kind FROM d, feature_layout p),
        r AS (SELECT l.*, src, CASE WHEN isfinite(v) THEN v END AS g FROM l LEFT JOIN f USING (recording)),
        m AS (SELECT src, pos, median(g) AS mid FROM r WHERE src IS NOT NULL GROUP BY ALL),
        s AS (SELECT src, pos, mid, median(abs(g - mid)) AS mad FROM r JOIN m USING (src, pos) GROUP BY ALL),
        h AS (SELECT row_idx, pos, recording, t, CASE WHEN count(g) OVER w = 8 THEN max(g) OVER w - min(g) OVER w <= 0.002 ELSE false END AS ends
              FROM r WINDOW w AS (PARTITION BY recording, pos ORDER BY t, row_idx ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
        k AS (SELECT row_idx, pos, bool_or(ends) OVER (PARTITION BY recording, pos ORDER BY t, row_idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS held FROM h)
        SELECT row_idx, pos FROM r LEFT JOIN s USING (src, pos) JOIN k USING (row_idx, pos)
        WHERE g IS NOT NULL AND (coalesce(abs(g - mid) > 6.5 * 1.4826 * mad, false) OR held
              OR ((kind IN ('Std', 'Variance') OR kind LIKE '%Power') AND g < 0) OR (kind = 'Entropy' AND (g < 0 OR g > 6)))""",
}
