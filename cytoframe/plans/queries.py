"""Registered queries: each operator bound to the driver's tables, with its DuckDB twin where SQL can express it.

The cell operators run on a cell table derived from ``lineitem`` by one projection (``CELLS``), the same text in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import classify, grids, interpolation, matching, model, resampling, signals, stats, summary
from ..sources.work import staged

Query = Callable[[SparkSession, str], DataFrame]

#: Every line item as a cell: day, stressor, strain, dose, time and field from its keys, intensities from its price.
CELLS = """
SELECT ((l_orderkey * 1000000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber + CAST(l_quantity AS BIGINT) * 100000000000000000 AS cell_id,
  concat(CAST(20260101 + l_orderkey % 4 AS VARCHAR(8)), CASE WHEN l_partkey % 2 = 0 THEN '_h2o2_' ELSE '_dtt_' END, CASE WHEN l_suppkey % 5 = 0 THEN 'nt' ELSE 'tr' END) AS session_id,
  concat(CASE WHEN l_partkey % 2 = 0 THEN 'h2o2_' ELSE 'dtt_' END, CASE l_partkey % 8 WHEN 0 THEN '0' WHEN 1 THEN '0' WHEN 2 THEN '50' WHEN 3 THEN '50' WHEN 4 THEN '100' WHEN 5 THEN '100' ELSE '200' END, 'uM_t', CAST(l_linenumber AS VARCHAR(2))) AS condition_id,
  concat('R', CAST(l_orderkey % 3 AS VARCHAR(1))) AS sample_id,
  CAST(l_linenumber AS BIGINT) AS timepoint, CAST(l_orderkey % 3 AS BIGINT) AS acquisition_order,
  l_linenumber + (l_orderkey % 3) * 0.05e0 AS measurement_time_hours,
  l_returnflag <> 'R' AS qc_pass, l_quantity >= 48 AS edge_flag, l_tax > 0.07 AS sat_flag, l_discount > 0.08 AS sat_flag_legacy,
  l_extendedprice / 1000 AS corrected_mean_green, l_extendedprice * (1 + l_discount) / 1200 AS corrected_mean_red,
  l_extendedprice * l_quantity / 1000 AS integrated_green, l_extendedprice * l_quantity / 1200 AS integrated_red,
  400e0 AS exposure_ms_green, 400e0 AS exposure_ms_red
FROM lineitem
"""
LABELS = f"""
cells AS ({CELLS}),
annotated AS (
  SELECT *, regexp_extract(session_id, '^([0-9]{{8}})_([a-z0-9]+)_(tr|nt)$', 1) AS day, regexp_extract(session_id, '^([0-9]{{8}})_([a-z0-9]+)_(tr|nt)$', 2) AS stressor,
    regexp_extract(session_id, '^([0-9]{{8}})_([a-z0-9]+)_(tr|nt)$', 3) AS strain, CAST(regexp_extract(condition_id, '^([a-z0-9]+)_([0-9]+)uM', 2) AS DOUBLE) AS dose_uM,
    corrected_mean_green / 0.4 AS g, corrected_mean_red / 0.4 AS r, qc_pass AND NOT edge_flag AS ok
  FROM cells
),
base AS (
  SELECT stressor, count(*) AS n_cells, count(DISTINCT sample_id) AS n_fields, string_agg(DISTINCT day, ',' ORDER BY day) AS days,
    quantile_cont(g, 0.5) AS bg, quantile_cont(g, 0.25) AS bg25, quantile_cont(g, 0.75) AS bg75, quantile_cont(r, 0.5) AS br, quantile_cont(r, 0.25) AS br25, quantile_cont(r, 0.75) AS br75
  FROM annotated WHERE strain = 'nt' AND ok GROUP BY stressor
),
af AS (SELECT a.*, g - bg AS green_af, r - br AS red_af FROM annotated a JOIN base USING (stressor)),
lim AS (SELECT stressor, quantile_cont(g, 0.9) AS gl, quantile_cont(r, 0.9) AS rl FROM annotated WHERE strain = 'nt' AND ok GROUP BY stressor),
pos AS (SELECT af.*, g > gl AND r > rl AS pos FROM af JOIN lim USING (stressor)),
feat AS (
  SELECT session_id, condition_id, sample_id, min(day) AS day, min(stressor) AS stressor, min(dose_uM) AS dose_uM, quantile_cont(measurement_time_hours, 0.5) AS time_h,
    count(*) AS n_cells, count(*) FILTER (pos) AS n_positive, quantile_cont(green_af, 0.5) AS green, quantile_cont(red_af, 0.5) AS red, avg(CAST(pos AS INT)) AS positive,
    CASE WHEN count(*) FILTER (pos) >= 5 THEN quantile_cont(green_af, 0.5) FILTER (pos) END AS green_pos,
    CASE WHEN count(*) FILTER (pos) >= 5 THEN quantile_cont(red_af, 0.5) FILTER (pos) END AS red_pos
  FROM pos WHERE ok AND strain = 'tr' GROUP BY session_id, condition_id, sample_id HAVING count(*) >= 20
),
fields AS (
  SELECT session_id, day, stressor, strain, dose_uM, condition_id, sample_id, count(*) AS n_cells, quantile_cont(measurement_time_hours, 0.5) AS time_h,
    quantile_cont(green_af, 0.5) AS green_af, quantile_cont(red_af, 0.5) AS red_af FROM af WHERE ok GROUP BY ALL
),
course AS (
  SELECT session_id, day, stressor, strain, dose_uM, condition_id, quantile_cont(time_h, 0.5) AS time_h, count(*) AS n_fields, CAST(sum(n_cells) AS BIGINT) AS n_cells,
    quantile_cont(green_af, 0.5) AS green, quantile_cont(red_af, 0.5) AS red FROM fields GROUP BY session_id, day, stressor, strain, dose_uM, condition_id
),
pts AS (
  SELECT session_id, day, stressor, dose_uM, condition_id, quantile_cont(gm, 0.5) AS green, quantile_cont(rm, 0.5) AS red, avg(pm) AS positive FROM (
    SELECT session_id, day, stressor, dose_uM, condition_id, sample_id, quantile_cont(green_af, 0.5) AS gm, quantile_cont(red_af, 0.5) AS rm, avg(CAST(pos AS INT)) AS pm
    FROM pos WHERE ok AND strain = 'tr' GROUP BY ALL) GROUP BY session_id, day, stressor, dose_uM, condition_id
),
ptimes AS (SELECT session_id, condition_id, quantile_cont(measurement_time_hours, 0.5) AS time_h FROM pos WHERE ok AND strain = 'tr' GROUP BY session_id, condition_id),
points AS (
  SELECT session_id, day, stressor, dose_uM, condition_id, time_h, u.readout, CASE u.readout WHEN 'green' THEN green WHEN 'red' THEN red ELSE positive END AS value
  FROM pts JOIN ptimes USING (session_id, condition_id) CROSS JOIN (VALUES ('green'), ('red'), ('positive')) u(readout)
),
knots AS (SELECT *, lead(time_h) OVER w AS t1, lead(value) OVER w AS v1, count(*) OVER (PARTITION BY session_id, readout) AS nk, avg(value) OVER (PARTITION BY session_id, readout) AS control_level FROM points WHERE dose_uM = 0 WINDOW w AS (PARTITION BY session_id, readout ORDER BY time_h)),
eff AS (
  SELECT p.session_id, p.readout, p.dose_uM, avg(p.value - (CASE WHEN k.time_h = p.time_h THEN k.value ELSE k.value + (k.v1 - k.value) * (p.time_h - k.time_h) / (k.t1 - k.time_h) END)) AS effect, count(*) AS n_timepoints, min(k.control_level) AS control_level
  FROM points p JOIN knots k ON p.session_id = k.session_id AND p.readout = k.readout AND k.nk >= 2 AND p.time_h >= k.time_h AND (p.time_h < k.t1 OR (k.t1 IS NULL AND p.time_h = k.time_h))
  WHERE p.dose_uM > 0 GROUP BY p.session_id, p.readout, p.dose_uM
)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles to 6 decimals, for comparison with another engine."""
    return df.select(*(F.round(c, 6).alias(c) if k == "double" and c not in keep else F.col(c) for c, k in df.dtypes))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived cell table; Catalyst reads from Parquet only the columns that a query uses."""
    return spark.sql(CELLS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.lit(0.4)
    c = signals.with_labels(cells(spark, sf_dir))
    return c.withColumns({f"corrected_mean_{ch}_per_s": F.col(f"corrected_mean_{ch}") / s for ch in ("green", "red")})


def corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = per_second(spark, sf_dir)
    return signals.subtract_baseline(c, signals.baseline(c))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.field_features(corrected(spark, sf_dir))


def q_annotate(spark, sf_dir):
    return signals.annotate(cells(spark, sf_dir)).select("cell_id", "day", "stressor", "strain", "dose_uM")


def q_usable(spark, sf_dir):
    return cells(spark, sf_dir).where(E.usable()).select("cell_id", "session_id")


def q_per_second(spark, sf_dir):
    return rounded(signals.add_per_second(cells(spark, sf_dir)).select("cell_id", "corrected_mean_green_per_s", "corrected_mean_red_per_s", "integrated_green_per_s"))


def q_baseline(spark, sf_dir):
    return rounded(signals.baseline(per_second(spark, sf_dir)))


def q_baseline_diagnostics(spark, sf_dir):
    return rounded(signals.baseline_diagnostics(per_second(spark, sf_dir)))


def q_subtract_baseline(spark, sf_dir):
    return rounded(corrected(spark, sf_dir).select("cell_id", "green_af", "red_af"))


def q_field_summaries(spark, sf_dir):
    return rounded(signals.field_summaries(corrected(spark, sf_dir)))


def q_timecourse(spark, sf_dir):
    return rounded(signals.timecourse(signals.field_summaries(corrected(spark, sf_dir))))


def q_thresholds(spark, sf_dir):
    return rounded(signals.positive_thresholds(per_second(spark, sf_dir)))


def q_reporter_positive(spark, sf_dir):
    return signals.reporter_positive(per_second(spark, sf_dir)).select("cell_id", "strain")


def q_field_features(spark, sf_dir):
    return rounded(features(spark, sf_dir))


def q_sample_points(spark, sf_dir):
    return rounded(signals.sample_points(per_second(spark, sf_dir)).withColumn("samples", F.array_join("samples", ",")))


def q_imaging_times(spark, sf_dir):
    t = signals.imaging_times(per_second(spark, sf_dir))
    return t.select("session_id", "dose_uM", F.explode("times_h").alias("time_h"))


def population_cells(spark, sf_dir):
    c = cells(spark, sf_dir)
    none = {k: F.lit(None).cast("double") for k in ("sampling_time_hours", "nd_filter_green", "nd_filter_red")}
    c = c.withColumn("ratio_red_green", E.ratio(F.col("corrected_mean_red"), F.col("corrected_mean_green"))).withColumn("objective", F.lit("40X"))
    return c.withColumns(none).withColumn("measurement_time_hours", F.col("timepoint").cast("double"))


def q_population_summary(spark, sf_dir):
    s = summary.summarize_cells(population_cells(spark, sf_dir), data_kind="synthetic", min_cells=3, green_floor=1.0)
    return rounded(s.select(*summary.GROUP, "n_cells_total", "n_cells_qc_pass", "n_cells_used", "n_images", "summary_status", "ratio_red_green_median", "ratio_red_green_q25", "ratio_red_green_q75", "corrected_green_median"))


def q_manual_review(spark, sf_dir):
    c = population_cells(spark, sf_dir)
    flagged = c.where("cell_id % 7 = 0").select(*summary.IDENTITY, F.lit("debris").alias("review_reason"))
    _, _, comparison, _ = summary.review_summaries(c, flagged, data_kind="synthetic")
    return rounded(comparison.select(*summary.GROUP, "n_cells_used_baseline", "n_cells_used_without_flagged", "ratio_red_green_median_change_percent"))


def q_saturation_impact(spark, sf_dir):
    c = population_cells(spark, sf_dir).withColumn("qc_pass_legacy_saturation", F.col("qc_pass") & ~F.col("sat_flag_legacy"))
    return rounded(summary.saturation_impact(c))


def q_reason_counts(spark, sf_dir):
    c = cells(spark, sf_dir).withColumns({"lamp_flag": F.col("timepoint") == 7, "registration_ok": F.col("acquisition_order") < 2})
    return summary.reason_counts(summary.quality_fold(c))


def event_values(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)).alias("t")
    return e.where("value is not null").select("event_id", "event_type", t, F.col("value").alias("v"))


def knots_of_one_type(spark, sf_dir):
    e = event_values(spark, sf_dir)
    first = e.agg(F.min("event_type").alias("k"))
    k = e.join(F.broadcast(first), F.col("event_type") == F.col("k")).groupBy((F.floor("t")).alias("h")).agg(F.avg("v").alias("v"))  # one row: a global aggregate
    return e.join(F.broadcast(first), F.col("event_type") != F.col("k")).drop("k").withColumn("key", F.lit(1)), k.select(F.lit(1).alias("key"), F.col("h").cast("double").alias("t"), "v")


def q_interp_inside(spark, sf_dir):
    points, knots = knots_of_one_type(spark, sf_dir)
    return rounded(interpolation.interpolate_join(points, knots, ["key"]).select("event_id", "interpolated"))


def q_interp_flat(spark, sf_dir):
    points, knots = knots_of_one_type(spark, sf_dir)
    return rounded(interpolation.interpolate_join(points, knots, ["key"], flat=True).select("event_id", "interpolated"))


def q_paired_features(spark, sf_dir):
    return rounded(interpolation.add_paired(features(spark, sf_dir)).select("session_id", "condition_id", "sample_id", "d_green", "d_red", "d_positive", "log_fold_green_pos"))


def q_effects(spark, sf_dir):
    return rounded(interpolation.effects(resampling.point_values(corrected(spark, sf_dir))))


def hourly(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.groupBy("event_type", F.hour("ts").cast("double").alias("t")).agg(F.avg("value").alias("v"))


def q_peaks(spark, sf_dir):
    return rounded(stats.peaks(hourly(spark, sf_dir), ["event_type"], "t", "v"))


def q_excess(spark, sf_dir):
    # A row per sample and time, which the peaks and both sides of the excess read.
    curve = staged(signals.timecourse(signals.field_summaries(corrected(spark, sf_dir))).where("strain = 'tr'"), "curve")
    p = stats.peaks(curve, ["session_id", "dose_uM"], "time_h", "green").select("session_id", "dose_uM", "t_max_sampled")
    return rounded(stats.excess_over_control(p, curve, "green"))


def q_bh(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.pmod(F.sum("o_orderkey"), F.lit(9973)) / 9973.0).alias("p"))
    return rounded(stats.benjamini_hochberg(o, "p"))


def masses(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    return li.select("l_linestatus", "l_returnflag", "l_linenumber", (F.col("q") / F.sum("q").over(Window.partitionBy("l_linestatus", "l_returnflag"))).alias("p"))


def q_credible_set(spark, sf_dir):
    return rounded(stats.credible_set(masses(spark, sf_dir), ["l_linestatus", "l_returnflag"], "l_linenumber", "p"))


def q_mass_region(spark, sf_dir):
    return rounded(stats.highest_mass_region(masses(spark, sf_dir), ["l_linestatus", "l_returnflag"], "p", 0.8))


def q_intervals(spark, sf_dir):
    d = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01")).cast("double")
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", d.alias("lo"), (d + F.col("l_quantity")).alias("hi"))
    return stats.merge_intervals(li, ["l_suppkey"], "lo", "hi")


def q_cell_widths(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 7).alias("k"), F.col("p_partkey").cast("double").alias("x"))
    return rounded(stats.cell_widths(p, ["k"], "x", 0.0, 1e9))


def q_not_increasing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return stats.not_increasing(o, ["o_custkey"], "o_orderkey", "o_totalprice")


def q_late_drift(spark, sf_dir):
    return rounded(stats.late_drift(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", "o_totalprice"))


def q_linear_fit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return rounded(stats.line_fits(li, "l_returnflag", "x", "y").drop("x_values"))


def q_session_scale(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 1000).alias("i"), "l_quantity")
    return rounded(stats.session_scale(li, ["l_suppkey"], "i", "l_quantity"))


def q_pooled_covariance(spark, sf_dir):
    return rounded(stats.pooled_covariance(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_discount"))


def q_class_fits(spark, sf_dir):
    f = classify.class_fits(features(spark, sf_dir), ["green", "red"])
    r = f.select("stressor", F.get("within", F.lit(0)).alias("w00"), F.get("within", F.lit(1)).alias("w01"), F.get("within", F.lit(3)).alias("w11"), F.get("between", F.lit(0)).alias("b00"), F.get("between", F.lit(3)).alias("b11"), F.explode("classes").alias("c"))
    return rounded(r.select("stressor", "w00", "w01", "w11", "b00", "b11", F.col("c.item").alias("dose_uM"), F.get("c.mean", F.lit(0)).alias("green"), F.get("c.mean", F.lit(1)).alias("red")))


def q_lodo(spark, sf_dir):
    p, _ = classify.leave_one_day_out(interpolation.add_paired(features(spark, sf_dir)), "absolute")
    return rounded(p.drop("doses", "p"))


def q_lodo_scores(spark, sf_dir):
    p, _ = classify.leave_one_day_out(interpolation.add_paired(features(spark, sf_dir)), "paired")
    return rounded(classify.score(p))


def q_time_windows(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", ((F.hour("ts") * 60 + F.minute("ts")) / 60.0).alias("h"))
    return t.select("event_id", E.time_window(F.col("h"), [0.0, 2.0, 4.0, 6.0, 8.0]).alias("time_window"))


GRID = "SELECT 'm' AS artifact_id, CAST(d.i * 25 AS DOUBLE) AS dose_uM, CAST(t.i AS DOUBLE) * 0.5e0 AS time_h, 0.2e0 + d.i * 0.08e0 + t.i * 0.05e0 AS ratio, 0.1e0 + d.i * 0.03e0 + t.i * 0.2e0 AS green"


def grid(spark):
    return spark.sql(f"{GRID} FROM range(9) d(i) CROSS JOIN range(1, 7) t(i)")  # a stated grid of 54 nodes


def snapshots(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("obs_id"), F.lit("m").alias("artifact_id"), (0.2 + F.col("o_orderkey") % 100 * 0.01).alias("ratio_obs"), (0.1 + F.col("o_custkey") % 50 * 0.02).alias("green_obs"), F.lit(0.1).alias("model_low"), F.lit(1.1).alias("model_high"), (F.col("o_orderkey") % 97 == 0).alias("low"))


def q_snapshot_grid(spark, sf_dir):
    s = grids.decode_snapshot(grid(spark), snapshots(spark, sf_dir), 0.0401, 0.1001)
    return s.select("obs_id", "status", F.size("candidate_pairs").cast("long").alias("n"), "ratio_only", "green_only", "dose_estimate_uM", "elapsed_time_hours")


def q_grid_posterior(spark, sf_dir):
    p = grids.posteriors(grids.prior_masses(grid(spark), "uniform_grid"), snapshots(spark, sf_dir), (0.04, 0.005, 0.09))
    mean = lambda axis: F.aggregate("nodes", F.lit(0.0), lambda s, n: s + n["mass"] * n[axis])
    n_region = F.size(F.filter("nodes", lambda n: n["in_region"])).cast("long")
    return rounded(p.select("obs_id", F.array_max(F.col("nodes")["mass"]).alias("top"), mean("dose_uM").alias("mean_dose"), mean("time_h").alias("mean_time"), n_region.alias("n_region")))


def dose_observations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id"), F.lit("m").alias("artifact_id"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4, 5, 6)))).alias("k"))
    noise = (F.col("obs_id") * 7 + F.col("k") * 13) % 11 * 0.01
    return o.select("obs_id", "artifact_id", (F.col("k") * 0.5).alias("time_h"), (0.2 + F.col("obs_id") % 12 * 0.08 + F.col("k") * 0.05 + noise - 0.05).alias("ratio"), F.lit(0.0601).alias("tolerance"), F.lit(1.0).alias("green"))


def q_dose_grid(spark, sf_dir):
    d = grids.decode_dose(grid(spark), dose_observations(spark, sf_dir))
    return rounded(d.select("obs_id", "status", F.size("candidate_doses_uM").cast("long").alias("n"), "dose_estimate_uM", "smallest_residual"))


def q_continuous_dose(spark, sf_dir):
    d = grids.decode_continuous(grid(spark), dose_observations(spark, sf_dir))
    return rounded(d.select("obs_id", "status", "dose_estimate_uM"))


def q_joint_dose_time(spark, sf_dir):
    o = dose_observations(spark, sf_dir).where("time_h <= 1.5").select("obs_id", "artifact_id", (F.col("time_h") - 0.5).alias("relative_h"), "ratio", "tolerance")
    offsets = spark.sql("SELECT 'm' AS artifact_id, CAST(i AS DOUBLE) * 0.5 AS elapsed_h FROM range(1, 5) t(i)")
    j = grids.decode_joint(grid(spark), o, offsets)
    return j.select("obs_id", "status", F.size("candidate_pairs").cast("long").alias("n"), "dose_estimate_uM", "elapsed_time_hours")


def q_rejected(spark, sf_dir):
    return summary.rejected_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


def q_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


def q_nearest_frame(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    targets = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("target_id"), F.col("ts").alias("target_time"))
    frames = e.where("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("path"), F.col("ts").alias("frame_time"))
    return rounded(matching.nearest_frames(targets, frames, ["user_id"], tolerance=720.0).select("target_id", "path", "distance_min"))


def q_acquisition_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("tp_label"), F.struct("ts", "event_id").alias("red_time"))
    return matching.acquisition_order(e, "user_id").select("event_id", F.col("acquisition_order").cast("long").alias("acquisition_order"), F.col("timepoint").cast("long").alias("timepoint"))


def q_induction_bootstrap(spark, sf_dir):
    effects, _ = resampling.induction_table(corrected(spark, sf_dir))
    return effects


def q_peak_bootstrap(spark, sf_dir):
    return resampling.bootstrap_peaks(corrected(spark, sf_dir).where("strain = 'tr'"))


def q_assignment(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    a = e.where("event_type = 'click'").select("d", F.col("user_id").alias("u"), F.col("event_id").alias("left_id"), F.col("ts").alias("a"))
    b = e.where("event_type = 'view'").select("d", F.col("user_id").alias("u"), F.col("event_id").alias("right_id"), F.col("ts").alias("b"))
    pairs = a.join(b, ["d", "u"]).withColumn("cost", F.abs(matching.minutes(F.col("a"), F.col("b"))))
    return matching.assign_groups(pairs, ["d", "u"], "left_id", "right_id", "cost", 600.0)


def q_dose_response(spark, sf_dir):
    return model.response_table(spark, "er", [0.0, 100.0, 500.0, 1000.0], [1.0, 4.0, 12.0])


def q_decode_culture(spark, sf_dir):
    # All positions of a condition are one field here, and 5 usable cells make a field, so that the smallest tables have fields too.
    c = per_second(spark, sf_dir).withColumn("sample_id", F.lit("all"))
    trained = classify.train(c.drop("day", "stressor", "strain", "dose_uM"), "h2o2", "absolute", min_cells=5)
    new = c.where("strain = 'tr' and stressor = 'h2o2' and day = '20260101'").drop("day", "stressor", "strain", "dose_uM")
    return classify.decode(new, trained).drop("p", "doses", "time_p")


def q_scale_diagnostics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 1000).alias("i"), "l_quantity")
    return rounded(stats.scale_diagnostics(li, ["l_suppkey"], "i", "l_quantity"))


def q_prior_density(spark, sf_dir):
    return rounded(grids.prior_masses(grid(spark), "uniform_density", dose_bounds=(0.0, 200.0), time_bounds=(0.0, 4.0)).select("dose_uM", "time_h", "prior"))


def q_sessions(spark, sf_dir):
    from ..sources.tables import sessions

    return sessions(cells(spark, sf_dir))


def q_quality_fold(spark, sf_dir):
    c = cells(spark, sf_dir).withColumns({"lamp_flag": F.col("timepoint") == 7, "registration_ok": F.col("acquisition_order") < 2})
    return summary.quality_fold(c).select("cell_id", "qc_pass", "qc_reasons")


def q_event_windows(spark, sf_dir):
    from ..streaming.windows import event_windows

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = event_windows(e, "ts", ["event_type"], "value", length="6 hours")
    return rounded(w.select(F.unix_seconds("window_start").alias("start_s"), "event_type", "n", "total"))


def q_event_sessions(spark, sf_dir):
    from ..streaming.windows import sessions

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "ts", ["user_id"], gap="6 hours").select("user_id", F.unix_micros("session_start").alias("start_us"), "n")


def q_field_counts(spark, sf_dir):
    from ..streaming.windows import field_counts

    return rounded(field_counts(cells(spark, sf_dir)))


def q_model_robustness(spark, sf_dir):
    from . import robustness

    g = grids.prior_masses(grid(spark).withColumn("green", F.col("green") - 0.1), "uniform_grid")
    truths = g.select(F.monotonically_increasing_id().alias("truth_id"), "artifact_id", "dose_uM", "time_h", "ratio", F.col("green").alias("green_norm"))
    o = robustness.trials(truths, 4, 0.1, 0.1)
    return robustness.evaluate(g, o, (0.01, 0.0, 0.01))


QUERIES: tuple[Query, ...] = (
    q_annotate, q_usable, q_per_second, q_baseline, q_baseline_diagnostics, q_subtract_baseline, q_field_summaries, q_timecourse, q_thresholds, q_reporter_positive, q_field_features,
    q_sample_points, q_imaging_times, q_population_summary, q_manual_review, q_saturation_impact, q_reason_counts, q_interp_inside, q_interp_flat, q_paired_features, q_effects, q_peaks, q_excess,
    q_bh, q_credible_set, q_mass_region, q_intervals, q_cell_widths, q_not_increasing, q_late_drift, q_linear_fit, q_session_scale, q_pooled_covariance, q_class_fits, q_lodo, q_lodo_scores,
    q_time_windows, q_snapshot_grid, q_grid_posterior, q_dose_grid, q_continuous_dose, q_joint_dose_time, q_rejected, q_semi, q_nearest_frame, q_acquisition_order,
    q_scale_diagnostics, q_prior_density, q_sessions, q_quality_fold, q_event_windows, q_event_sessions, q_field_counts, q_model_robustness,
    q_induction_bootstrap, q_peak_bootstrap, q_assignment, q_dose_response, q_decode_culture,
)


def queries() -> dict[str, Query]:
    from . import acquisition, illumination, imaging

    return {f.__name__: f for f in (*QUERIES, *imaging.QUERIES, *illumination.QUERIES, *acquisition.QUERIES)}
