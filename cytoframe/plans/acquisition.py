"""Registered queries of acquisition tables and sample trajectories, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import acquisition as A
from ..operators import images, linkage
from .queries import GRID, cells, grid, rounded, table

#: Orders as images of 20 sessions, with the noted afternoon time of two in three.
IMAGES = """
SELECT o_orderkey AS image_id, concat('s', CAST(o_custkey % 20 AS VARCHAR(2))) AS session_id, o_orderdate AS day, 60 + o_orderkey % 300 AS minute,
  CASE WHEN o_orderkey % 3 <> 0 THEN 60 + o_orderkey % 300 + o_custkey % 5 + CASE WHEN o_orderkey % 41 = 0 THEN 60 ELSE 0 END END AS noted
FROM orders
"""
LOG = """
SELECT o_orderkey AS row, concat('s', CAST(o_custkey % 4 AS VARCHAR(2))) AS section, concat('t', CAST(o_custkey % 30 AS VARCHAR(2))) AS tp_label, CAST(o_orderkey % 5 * 50 AS VARCHAR(4)) AS dose_uM,
  CAST(o_orderkey % 3 AS VARCHAR(2)) AS rep, 'images' AS folder, CASE WHEN o_orderkey % 7 = 0 THEN 'starred' ELSE '' END AS flags
FROM orders
"""
#: Hand-filled cells: shifts, yes and no words, and numbers as people write them.
FILLED = """
SELECT o_orderkey AS row, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN ' 2.5 ' WHEN 2 THEN '-3' WHEN 3 THEN 'left' WHEN 4 THEN NULL ELSE CAST(o_custkey AS VARCHAR(12)) END AS shift,
  CASE o_orderkey % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no ' WHEN 2 THEN '' WHEN 3 THEN 'FALSE' WHEN 4 THEN 'maybe' WHEN 5 THEN NULL ELSE '1' END AS expect_cells,
  CASE o_orderkey % 4 WHEN 0 THEN '12.5' WHEN 1 THEN 'none' WHEN 2 THEN NULL ELSE CAST(o_custkey AS VARCHAR(12)) END AS lamp
FROM orders
"""
#: Every order as a trajectory of six times, calibrated with its session's coefficient, with faults.
SAMPLES = """
SELECT concat('s', CAST(o_orderkey % 7 AS VARCHAR(2))) AS session_id, CASE WHEN o_orderkey % 53 = 0 THEN ' ' ELSE concat('o', CAST(o_orderkey AS VARCHAR(12))) END AS sample_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'c' END AS condition_id, k * 0.5e0 AS measurement_time_hours,
  0.2e0 + o_orderkey % 12 * 0.08e0 + k * 0.05e0 + (o_orderkey * 7 + k * 13) % 11 * 0.01e0 - 0.05e0 AS calibrated_ratio_red_green_median,
  CASE WHEN o_orderkey % 19 = 0 AND k = 3 THEN 9e0 WHEN o_orderkey % 37 = 0 AND k = 1 THEN NULL ELSE (0.2e0 + o_orderkey % 12 * 0.08e0 + k * 0.05e0 + (o_orderkey * 7 + k * 13) % 11 * 0.01e0 - 0.05e0) * (1 + o_orderkey % 7 * 0.5e0) END AS ratio_red_green_median,
  CASE WHEN o_orderkey % 13 = 0 AND k = 2 THEN 1 ELSE 5 END AS n_cells_used, 1 + o_orderkey % 7 * 0.5e0 AS c_session,
  CASE WHEN o_orderkey % 17 = 0 THEN 'other' ELSE 'r' END AS calibration_reference_id, 'synthetic' AS calibration_source_kind, 'made' AS calibration_source,
  CASE WHEN o_orderkey % 23 = 0 THEN 'experimental' ELSE 'synthetic' END AS data_kind
FROM orders CROSS JOIN (SELECT explode(sequence(1, 6)) AS k)
"""


def derived(spark, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def q_notes_match(spark, sf_dir):
    i = derived(spark, sf_dir, IMAGES)
    at = lambda minutes: F.timestamp_micros(F.unix_micros(F.col("day").cast("timestamp")) + (12 * 60 + minutes).cast("long") * 60_000_000).cast("timestamp_ntz")
    text = F.concat(F.floor(F.col("noted") / 60).cast("string"), F.lit(":"), F.lpad((F.col("noted") % 60).cast("string"), 2, "0"))
    notes = i.where("noted IS NOT NULL").select("image_id", A.afternoon(text, F.col("day")).alias("note_time"))
    images = A.one_to_one(i.select("image_id", "session_id", at(F.col("minute")).alias("red_time")), notes, ["image_id"], "in_notes")
    return rounded(A.clock_offsets(images, ["session_id"], "red_time", "note_time", 30.0).select("image_id", "in_notes", "clock_offset_min", "median_offset_min", "notes_time_disagrees"))


def q_session_cutoff(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_quantity") != 7, F.col("l_quantity")).alias("focus"))
    return A.session_cutoff(li, ["l_suppkey"], "focus", 25.0).groupBy("l_suppkey").agg(F.count_if("in_focus").alias("n_in_focus"), F.count("*").alias("n"))


def q_filled_cells(spark, sf_dir):
    f = derived(spark, sf_dir, FILLED)
    return f.select("row", A.optional_shift(F.col("shift")).alias("shift_px"), A.bad_shift(F.col("shift")).alias("bad_shift"), A.expects_cells(F.col("expect_cells")).alias("expects"), A.recorded(F.col("lamp")).alias("lamp_hours"))


def q_known_issues(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    overrides = r.select(F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("section"), (F.col("r_regionkey") * 50).cast("string").alias("dose_uM"), F.lower("r_name").alias("folder"), F.concat(F.lit("region_"), "r_name").alias("flag"))
    rows = A.flag_issues(derived(spark, sf_dir, LOG), ["section", "tp_label", "dose_uM", "rep"], ["row"], overrides, F.col("section") == "s3")
    return rows.select("row", "folder", "flags")


def q_batches(spark, sf_dir):
    return A.batches(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 100)


def q_codes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 50).alias("customer"))
    return A.codes(o, ["o_orderpriority"], "customer")


def q_status_counts(spark, sf_dir):
    return A.status_counts(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderstatus"])


def q_session_overview(spark, sf_dir):
    return rounded(A.session_overview(cells(spark, sf_dir)))


def q_scenario_means(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 10).alias("node"), "l_quantity")
    return rounded(A.means(li, ["node"], ["l_suppkey"], ["l_quantity"])[1])


def q_ranked(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("score"))
    return A.ranked(e, ["user_id"], "score", "event_id", 3)


def q_crosstab(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("customer"), "o_orderstatus", F.floor("o_totalprice").cast("double").alias("price"))
    return rounded(A.crosstab(o, "customer", "o_orderstatus", ["F", "O", "P"], "price"))


def q_sample_decode(spark, sf_dir):
    calibrations = spark.sql("SELECT concat('s', CAST(id AS STRING)) AS session_id, 'r' AS reference_id, 1 + id * 0.5D AS c_session, IF(id = 5, 'experimental_reference', 'synthetic') AS source_kind, 'made' AS source FROM range(6)")
    d = linkage.decode_samples(grid(spark), derived(spark, sf_dir, SAMPLES), calibrations, artifact_id="m", mode="discrete", tolerance=0.0601, data_kind="synthetic", min_cells=3)
    return rounded(d.select("session_id", "sample_id", "condition_id", "n_points", "reason", "status", "dose_estimate_uM"))


def q_session_crosstalk(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    px = li.where("l_suppkey % 3 <> 0").select((F.col("l_suppkey") % 20).alias("session_id"), F.col("l_quantity").cast("double").alias("green"), F.floor(F.col("l_quantity") * 3 + F.col("l_linenumber") * 5).cast("double").alias("red"))
    return rounded(images.session_crosstalk(px, px, bins=10, low=0.25)[0])


QUERIES = (q_session_crosstalk, q_notes_match, q_session_cutoff, q_filled_cells, q_known_issues, q_batches, q_codes, q_status_counts, q_session_overview, q_scenario_means, q_ranked, q_crosstab, q_sample_decode)


def oracle_sql() -> dict[str, str]:
    from .queries import CELLS

    samples = SAMPLES.replace("(SELECT explode(sequence(1, 6)) AS k)", "range(1, 7) x(k)")
    reasons = [
        ("session or sample is blank", "bool_or(trim(sample_id) = '')"), ("no calibration of the session", "session_id = 's6'"), ("calibration is of another kind", "session_id = 's5'"), ("rows name another reference", "bool_or(calibration_reference_id <> 'r')"),
        ("rows are of another kind of data", "bool_or(data_kind <> 'synthetic')"), ("too few cells", "min(n_cells_used) < 3"), ("ratios are missing", "bool_or(ratio_red_green_median IS NULL)"),
        ("calibrated ratio is not the ratio over the coefficient", "bool_or(abs(calibrated_ratio_red_green_median - ratio_red_green_median / c_session) > 1e-6)"), ("a time occurs twice", "count(DISTINCT measurement_time_hours) < count(*)"),
    ]
    case = " ".join(f"WHEN {cond} THEN '{name}'" for name, cond in reasons)
    return {
        "q_session_crosstalk": """
WITH px AS (SELECT l_suppkey % 20 AS session_id, CAST(l_quantity AS DOUBLE) AS green, floor(l_quantity * 3 + l_linenumber * 5) AS red FROM lineitem WHERE l_suppkey % 3 <> 0),
s AS (SELECT session_id, min(green) AS a, max(green) AS b FROM px GROUP BY 1), b AS (SELECT px.*, least(floor((green - a) / greatest(b - a, 1e-12) * 10), 9) AS bin FROM px JOIN s USING (session_id)),
t AS (SELECT session_id, bin, quantile_cont(green, 0.5) AS g, quantile_cont(red, 0.25) AS r FROM b GROUP BY 1, 2 HAVING count(*) >= 20),
p AS (SELECT x.session_id, (y.r - x.r) / (y.g - x.g) AS s FROM t x JOIN t y ON x.session_id = y.session_id AND x.bin < y.bin AND x.g <> y.g)
SELECT session_id, round(greatest(quantile_cont(s, 0.5), 0), 6) AS bleed, (SELECT count(*) FROM t WHERE t.session_id = p.session_id) AS n_bins FROM p GROUP BY session_id""",
        "q_notes_match": f"""
WITH i AS ({IMAGES}), o AS (SELECT *, CAST(minute - noted AS DOUBLE) AS off FROM i), m AS (SELECT *, quantile_cont(off, 0.5) OVER (PARTITION BY session_id) AS med FROM o)
SELECT image_id, noted IS NOT NULL AS in_notes, round(off, 6) AS clock_offset_min, round(med, 6) AS median_offset_min, coalesce(abs(off - med) > 30, false) AS notes_time_disagrees FROM m""",
        "q_session_cutoff": """
WITH f AS (SELECT l_suppkey, CASE WHEN l_quantity <> 7 THEN l_quantity END AS focus FROM lineitem), c AS (SELECT l_suppkey, quantile_cont(focus, 0.25) AS cut FROM f GROUP BY 1)
SELECT l_suppkey, count(*) FILTER (cut IS NULL OR focus >= cut) AS n_in_focus, count(*) AS n FROM f JOIN c USING (l_suppkey) GROUP BY l_suppkey""",
        "q_filled_cells": f"""
WITH f AS ({FILLED}), s AS (SELECT *, CASE WHEN coalesce(trim(shift), '') = '' THEN 0 ELSE TRY_CAST(trim(shift) AS DOUBLE) END AS shift_px, coalesce(lower(trim(expect_cells)), '') AS w FROM f)
SELECT row, shift_px, shift_px IS NULL AS bad_shift, CASE WHEN w IN ('', '1', 'true', 'yes', 'y') THEN true WHEN w IN ('0', 'false', 'no', 'n') THEN false END AS expects, TRY_CAST(lamp AS DOUBLE) AS lamp_hours FROM s""",
        "q_known_issues": f"""
WITH l AS ({LOG}), g AS (SELECT *, section <> 's3' AND row_number() OVER (PARTITION BY section, tp_label, dose_uM, rep ORDER BY row) > 1 AS again FROM l)
SELECT row, coalesce(lower(r_name), folder) AS folder, concat_ws(';', nullif(flags, ''), CASE WHEN again THEN 'duplicate_row_in_log' END, 'region_' || r_name) AS flags
FROM g LEFT JOIN region ON section = concat('s', CAST(r_regionkey AS VARCHAR)) AND dose_uM = CAST(r_regionkey * 50 AS VARCHAR)""",
        "q_batches": "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS batch FROM orders",
        "q_codes": "SELECT o_orderkey, o_orderpriority, o_custkey % 50 AS customer, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey % 50) - 1 AS code FROM orders",
        "q_status_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS place FROM orders GROUP BY 1, 2",
        "q_session_overview": f"""
WITH c AS ({CELLS}) SELECT session_id, count(*) AS n_cells, count(DISTINCT condition_id || '|' || sample_id) AS n_fields, count(DISTINCT condition_id) AS n_conditions,
  round(min(measurement_time_hours), 6) AS first_h, round(max(measurement_time_hours), 6) AS last_h, count(DISTINCT exposure_ms_green) AS n_exposures FROM c GROUP BY 1""",
        "q_scenario_means": "WITH n AS (SELECT l_suppkey, l_partkey % 10 AS node, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, round(avg(q), 6) AS l_quantity, count(*) AS n_nodes FROM n GROUP BY 1",
        "q_ranked": "WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS score FROM events) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, event_id) AS place FROM e QUALIFY place <= 3",
        "q_crosstab": "WITH o AS (SELECT o_custkey % 100 AS customer, o_orderstatus AS s, floor(o_totalprice) AS p FROM orders) SELECT customer, " + ", ".join(f"round(avg(p) FILTER (s = '{x}'), 6) AS \"{x}\"" for x in "FOP") + " FROM o GROUP BY 1",
        "q_sample_decode": f"""
WITH s AS ({samples}), t AS (SELECT session_id, sample_id, condition_id, count(*) AS n_points, CASE {case} END AS reason FROM s GROUP BY session_id, sample_id, condition_id),
g AS ({GRID} FROM range(9) d(i) CROSS JOIN range(1, 7) t(i)),
j AS (SELECT s.*, g.dose_uM, abs(g.ratio - s.calibrated_ratio_red_green_median) <= 0.0601e0 AS fits, s.calibrated_ratio_red_green_median AS v, min(g.ratio) OVER w AS lo, max(g.ratio) OVER w AS hi
  FROM s JOIN g ON abs(g.time_h - s.measurement_time_hours) < 1e-9 WINDOW w AS (PARTITION BY s.session_id, s.sample_id, s.condition_id, s.measurement_time_hours)),
d AS (SELECT session_id, sample_id, condition_id, dose_uM, bool_and(fits) AS ok, bool_or(v < lo - 0.0601e0 OR v > hi + 0.0601e0) AS outside FROM j GROUP BY ALL),
r AS (SELECT session_id, sample_id, condition_id, count(*) FILTER (ok) AS n, max(dose_uM) FILTER (ok) AS dose, bool_or(outside) AS outside FROM d GROUP BY ALL)
SELECT t.session_id, t.sample_id, t.condition_id, n_points, reason,
  CASE WHEN reason IS NOT NULL THEN 'refused' WHEN n = 1 THEN 'unique_grid_match' WHEN n > 1 THEN 'ambiguous' WHEN outside THEN 'out_of_response_domain' ELSE 'no_grid_match' END AS status,
  CASE WHEN reason IS NULL AND n = 1 THEN round(dose, 6) END AS "dose_estimate_uM"
FROM t JOIN r ON t.session_id = r.session_id AND t.sample_id = r.sample_id AND t.condition_id IS NOT DISTINCT FROM r.condition_id""",
    }
