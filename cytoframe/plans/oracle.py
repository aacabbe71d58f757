"""DuckDB twins of the registered queries."""

from __future__ import annotations

from .queries import GRID, LABELS


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _from_cells(select: str) -> str:
    return f"WITH {LABELS} {select}"


_EVENTS = """
WITH e AS (SELECT event_id, event_type, epoch_us(ts) / 3.6e9 AS t, value AS v FROM events WHERE value IS NOT NULL),
p AS (SELECT * FROM e WHERE event_type <> (SELECT min(event_type) FROM e)),
k0 AS (SELECT CAST(floor(t) AS DOUBLE) AS t, avg(v) AS v FROM e WHERE event_type = (SELECT min(event_type) FROM e) GROUP BY 1),
k AS (SELECT t AS t0, v AS v0, lead(t) OVER (ORDER BY t) AS t1, lead(v) OVER (ORDER BY t) AS v1, min(t) OVER () AS first_t, max(t) OVER () AS last_t FROM k0)
"""
_LINE = "CASE WHEN v0 = v1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END"
_MASSES = "m AS (SELECT l_linestatus, l_returnflag, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3), p AS (SELECT l_linestatus, l_returnflag, l_linenumber, q / sum(q) OVER (PARTITION BY l_linestatus, l_returnflag) AS p FROM m)"
_GRID = f"g AS ({GRID} FROM range(9) d(i) CROSS JOIN range(1, 7) t(i))"
_SNAP = "s AS (SELECT o_orderkey AS obs_id, 0.2e0 + o_orderkey % 100 * 0.01e0 AS ratio_obs, 0.1e0 + o_custkey % 50 * 0.02e0 AS green_obs, o_orderkey % 97 = 0 AS low FROM orders), j AS (SELECT s.*, dose_uM, time_h, ratio, (green - 0.1e0) / (1.1e0 - 0.1e0) AS gn FROM s CROSS JOIN g)"
_DOSE_OBS = "o AS (SELECT o_orderkey AS obs_id, k, k * 0.5e0 AS time_h, 0.2e0 + o_orderkey % 12 * 0.08e0 + k * 0.05e0 + (o_orderkey * 7 + k * 13) % 11 * 0.01e0 - 0.05e0 AS observed FROM orders CROSS JOIN range(1, 7) x(k))"

def _lodo(features: list[str], src: str, score: bool) -> str:
    """Leave-one-day-out with three features, closed-form 3 x 3 Cholesky, plain joins."""
    ij = [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    f = features
    means = ", ".join(f"avg({x}) AS m{i}" for i, x in enumerate(f))
    scatter = ", ".join(f"covar_pop({f[i]}, {f[j]}) * count(*) AS w{i}{j}" for i, j in ij)
    have = " AND ".join(f"{x} IS NOT NULL" for x in f)
    sql = f"""
, src AS ({src}),
days AS (SELECT stressor, session_id, dose_uM, count(*) AS n, {means}, {scatter} FROM src WHERE {have} GROUP BY 1, 2, 3),
held AS (SELECT DISTINCT stressor, session_id AS held_out FROM src),
tr AS (SELECT h.stressor, h.held_out, d.* EXCLUDE (stressor) FROM held h JOIN days d ON d.stressor = h.stressor AND d.session_id <> h.held_out),
cls AS (SELECT stressor, held_out, dose_uM, count(*) AS nd, {", ".join(f"avg(m{i}) AS c{i}" for i in range(3))} FROM tr GROUP BY 1, 2, 3),
bet AS (SELECT t.stressor, t.held_out, count(*) AS nd, count(DISTINCT t.dose_uM) AS k, sum(t.n) AS n,
  {", ".join(f"sum((m{i} - c{i}) * (m{j} - c{j})) AS b{i}{j}, sum(w{i}{j}) AS w{i}{j}" for i, j in ij)}
  FROM tr t JOIN cls c ON t.stressor = c.stressor AND t.held_out = c.held_out AND t.dose_uM = c.dose_uM GROUP BY 1, 2),
cov AS (SELECT stressor, held_out, {", ".join(f"CASE WHEN nd > k THEN b{i}{j} / (nd - k) ELSE 0 END AS b{i}{j}, CASE WHEN n > nd THEN w{i}{j} / (n - nd) ELSE 0 END AS w{i}{j}" for i, j in ij)} FROM bet),
units AS (
  SELECT stressor, session_id AS held_out, 'field' AS unit, condition_id, sample_id, time_h, 1 AS n_fields, dose_uM AS truth, {", ".join(f"{x} AS x{i}" for i, x in enumerate(f))} FROM src WHERE {have}
  UNION ALL SELECT stressor, session_id, 'sample', condition_id, string_agg(sample_id, ',' ORDER BY sample_id), avg(time_h), count(*), min(dose_uM), {", ".join(f"avg({x})" for x in f)} FROM src WHERE {have} GROUP BY stressor, session_id, condition_id
),
s0 AS (SELECT u.*, {", ".join(f"b{i}{j} + w{i}{j} / n_fields AS s{i}{j}" for i, j in ij)} FROM units u JOIN cov v USING (stressor, held_out)),
s1 AS (SELECT *, 1e-9 * greatest(1.0, s00 + s11 + s22) AS rg FROM s0),
l1 AS (SELECT *, sqrt(s00 + rg) AS l00 FROM s1), l2 AS (SELECT *, s10 / l00 AS l10, s20 / l00 AS l20 FROM l1), l3 AS (SELECT *, sqrt(s11 + rg - l10 * l10) AS l11 FROM l2),
l4 AS (SELECT *, (s21 - l20 * l10) / l11 AS l21 FROM l3), l5 AS (SELECT *, sqrt(s22 + rg - l20 * l20 - l21 * l21) AS l22 FROM l4),
z1 AS (SELECT l5.*, c.dose_uM, (x0 - c0) / l00 AS z0, x1 - c1 AS y1, x2 - c2 AS y2 FROM l5 JOIN cls c USING (stressor, held_out)),
z2 AS (SELECT *, (y1 - l10 * z0) / l11 AS z1 FROM z1), z3 AS (SELECT *, (y2 - l20 * z0 - l21 * z1) / l22 AS z2 FROM z2),
d2 AS (SELECT stressor, held_out, unit, condition_id, sample_id, time_h, n_fields, truth, dose_uM, z0 * z0 + z1 * z1 + z2 * z2 AS d2 FROM z3),
e AS (SELECT *, exp(-0.5 * d2 + 0.5 * min(d2) OVER u) AS e FROM d2 WINDOW u AS (PARTITION BY stressor, held_out, unit, condition_id, sample_id)),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY stressor, held_out, unit, condition_id, sample_id) AS p FROM e),
q AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY stressor, held_out, unit, condition_id, sample_id ORDER BY p DESC, dose_uM DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.8 - 1e-12 AS inside FROM p),
pred AS (
  SELECT stressor, held_out, unit, condition_id, sample_id, time_h, n_fields, truth AS true_dose_uM, arg_max(dose_uM, p) AS map_dose_uM, sum(p) FILTER (dose_uM = truth) AS p_true,
    -sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) AS entropy_bits, count(*) AS n_doses, string_agg(CAST(CAST(dose_uM AS BIGINT) AS VARCHAR), ' ' ORDER BY dose_uM) FILTER (inside) AS credible_set_uM,
    coalesce(bool_or(inside AND dose_uM = truth), FALSE) AS credible_covers_truth, count(*) FILTER (inside) AS credible_size, min(d2) AS min_mahalanobis2, min(d2) > 11.344866730144373 AS outside_training
  FROM q GROUP BY ALL
)"""
    if not score:
        return f"WITH {LABELS} {sql} SELECT stressor, held_out, 'absolute' AS decoder, unit, condition_id, sample_id, {_r('time_h')}, n_fields, true_dose_uM, map_dose_uM, {_r('p_true', 'entropy_bits')}, n_doses, credible_set_uM, credible_covers_truth, credible_size, {_r('min_mahalanobis2')}, outside_training FROM pred"
    return f"""WITH {LABELS} {sql}, t AS (
  SELECT stressor, unit, held_out, CAST(count(*) AS DOUBLE) AS n, avg(CAST(map_dose_uM = true_dose_uM AS INT)) AS accuracy, 1 / min(n_doses) AS chance, avg(p_true) AS mean_p_true, avg(log2(greatest(p_true, 1e-300)) + log2(n_doses)) AS info_gain_bits,
    avg(entropy_bits / log2(n_doses)) AS entropy_vs_prior, avg(CAST(credible_covers_truth AS INT)) AS credible80_coverage, avg(credible_size) AS credible80_size, avg(CAST(outside_training AS INT)) AS outside_training, CAST(min(n_doses) AS DOUBLE) AS n_doses
  FROM pred GROUP BY 1, 2, 3
), a AS (SELECT * FROM t UNION ALL SELECT stressor, unit, 'mean over days', avg(n), avg(accuracy), avg(chance), avg(mean_p_true), avg(info_gain_bits), avg(entropy_vs_prior), avg(credible80_coverage), avg(credible80_size), avg(outside_training), avg(n_doses) FROM t GROUP BY 1, 2)
SELECT stressor, 'paired' AS decoder, unit, held_out, {_r('n', 'accuracy', 'chance', 'mean_p_true', 'info_gain_bits', 'entropy_vs_prior', 'credible80_coverage', 'credible80_size', 'outside_training', 'n_doses')} FROM a"""


def _paired() -> str:
    """Each field against the interpolated 0 µM of its session, from other conditions; flat outside."""
    cols = ["green", "red", "positive", "green_pos", "red_pos"]
    parts, names = "", []
    for c in cols:
        parts += f""",
ctl_{c} AS (SELECT session_id, condition_id, avg(time_h) AS t, avg({c}) AS v FROM feat WHERE dose_uM = 0 AND {c} IS NOT NULL GROUP BY 1, 2),
oth_{c} AS (SELECT f.session_id, f.condition_id, f.sample_id, f.time_h, c.t, c.v FROM feat f JOIN ctl_{c} c ON f.session_id = c.session_id AND f.condition_id <> c.condition_id),
ref_{c} AS (
  SELECT session_id, condition_id, sample_id, any_value(time_h) AS time_h, max(t) FILTER (t <= time_h) AS t0, arg_max(v, t) FILTER (t <= time_h) AS v0, min(t) FILTER (t > time_h) AS t1, arg_min(v, t) FILTER (t > time_h) AS v1
  FROM oth_{c} GROUP BY 1, 2, 3
)"""
        names.append(f"(SELECT session_id, condition_id, sample_id, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (time_h - t0) / (t1 - t0) END AS r_{c} FROM ref_{c}) USING (session_id, condition_id, sample_id)")
    joins = " LEFT JOIN ".join(["feat", *names])
    return f"""{parts},
paired AS (SELECT feat.*, green - r_green AS d_green, red - r_red AS d_red, positive - r_positive AS d_positive,
  CASE WHEN green_pos > 0 AND r_green_pos > 0 THEN ln(green_pos / r_green_pos) END AS log_fold_green_pos, CASE WHEN red_pos > 0 AND r_red_pos > 0 THEN ln(red_pos / r_red_pos) END AS log_fold_red_pos FROM {joins})"""


def _continuous() -> str:
    """Every linear segment between neighbouring doses keeps the part that fits all times; the best point of each is where a parabola is lowest."""
    tol = "0.0601e0"
    return f"""WITH {_GRID}, {_DOSE_OBS},
seg AS (SELECT * FROM (SELECT time_h, dose_uM AS l, lead(dose_uM) OVER w AS r, ratio AS start, lead(ratio) OVER w - ratio AS slope FROM g WINDOW w AS (PARTITION BY time_h ORDER BY dose_uM)) WHERE r IS NOT NULL),
j AS (SELECT obs_id, k, l, r, start, slope, observed, (observed - {tol} - start) / slope AS e1, (observed + {tol} - start) / slope AS e2 FROM o JOIN seg ON o.time_h = seg.time_h),
s AS (SELECT obs_id, l, r, greatest(0, max(least(e1, e2))) AS lo, least(1, min(greatest(e1, e2))) AS hi, sum(pow(slope / {tol}, 2)) AS den, sum(slope * (observed - start) / pow({tol}, 2)) AS num, sum(pow((start - observed) / {tol}, 2)) AS c0 FROM j GROUP BY obs_id, l, r),
a AS (SELECT *, least(greatest(num / den, lo), hi) AS alpha FROM s WHERE lo <= hi),
b AS (SELECT obs_id, l + lo * (r - l) AS low, l + hi * (r - l) AS high, l + alpha * (r - l) AS est, c0 - 2 * alpha * num + alpha * alpha * den AS score FROM a),
m AS (SELECT *, CASE WHEN low <= max(high) OVER (PARTITION BY obs_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-12 * greatest(1, abs(low)) THEN 0 ELSE 1 END AS new, min(score) OVER (PARTITION BY obs_id) AS best FROM b),
n AS (SELECT obs_id, sum(new) AS regions FROM m GROUP BY 1),
t AS (SELECT obs_id, est, lag(est) OVER (PARTITION BY obs_id ORDER BY est) AS before FROM m WHERE abs(score - best) <= 1e-12 + 1e-9 * abs(best)),
u AS (SELECT obs_id, count(*) FILTER (before IS NULL OR abs(est - before) > 1e-10 + 1e-10 * abs(before)) AS minima, min(est) AS est FROM t GROUP BY 1),
d AS (SELECT obs_id, bool_or(observed < lo - {tol} OR observed > hi + {tol}) AS outside FROM (SELECT obs_id, k, observed, min(least(start, start + slope)) AS lo, max(greatest(start, start + slope)) AS hi FROM j GROUP BY 1, 2, 3) GROUP BY 1),
x AS (SELECT obs_id, est, CASE WHEN regions IS NULL THEN CASE WHEN outside THEN 'out_of_response_domain' ELSE 'no_continuous_match' END WHEN regions > 1 OR minima > 1 THEN 'ambiguous' ELSE 'single_compatible_region' END AS status FROM d LEFT JOIN n USING (obs_id) LEFT JOIN u USING (obs_id))
SELECT obs_id, status, CASE WHEN status = 'single_compatible_region' THEN round(est, 6) END AS "dose_estimate_uM" FROM x"""


def oracle_sql() -> dict[str, str]:
    """Queries that resample, solve assignments or integrate have none; tests hold those against plain computations."""
    peak = """
c AS (SELECT event_type AS k, CAST(hour(ts) AS DOUBLE) AS t, avg(value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
n AS (SELECT *, lag(t) OVER w AS t0, lag(v) OVER w AS v0, lead(t) OVER w AS t2, lead(v) OVER w AS v2, count(*) OVER (PARTITION BY k) AS n_points, row_number() OVER (PARTITION BY k ORDER BY v DESC, t) AS r FROM c WINDOW w AS (PARTITION BY k ORDER BY t)),
s AS (SELECT *, (v - v0) / (t - t0) AS s1, (v2 - v) / (t2 - t) AS s2 FROM n WHERE r = 1), a AS (SELECT *, (s2 - s1) / (t2 - t0) AS a FROM s)
"""
    excess = """
, cur AS (SELECT session_id, dose_uM, time_h, green FROM course WHERE strain = 'tr'),
pk AS (SELECT session_id, dose_uM, time_h AS t_max_sampled FROM (SELECT *, row_number() OVER (PARTITION BY session_id, dose_uM ORDER BY green DESC, time_h) AS r FROM cur) WHERE r = 1),
kn AS (SELECT session_id, time_h AS t0, green AS v0, lead(time_h) OVER w AS t1, lead(green) OVER w AS v1 FROM cur WHERE dose_uM = 0 WINDOW w AS (PARTITION BY session_id ORDER BY time_h))
SELECT p.session_id, p.dose_uM, round(p.t_max_sampled, 6) AS t_max_sampled, CASE WHEN p.dose_uM <> 0 THEN round(c.green - (CASE WHEN k.t0 = p.t_max_sampled THEN k.v0 ELSE k.v0 + (k.v1 - k.v0) * (p.t_max_sampled - k.t0) / (k.t1 - k.t0) END), 6) END AS excess
FROM pk p LEFT JOIN cur c ON p.session_id = c.session_id AND p.dose_uM = c.dose_uM AND p.t_max_sampled = c.time_h
LEFT JOIN kn k ON p.session_id = k.session_id AND p.t_max_sampled >= k.t0 AND (p.t_max_sampled < k.t1 OR (k.t1 IS NULL AND p.t_max_sampled = k.t0))
"""
    pop = """, c AS (SELECT *, corrected_mean_red / corrected_mean_green AS ratio, qc_pass AND corrected_mean_green > {floor} AS el FROM cells)"""
    from . import acquisition, illumination, imaging

    return {
        **imaging.oracle_sql(),
        **illumination.oracle_sql(),
        **acquisition.oracle_sql(),
        "q_continuous_dose": _continuous(),
        "q_annotate": _from_cells("SELECT cell_id, day, stressor, strain, dose_uM FROM annotated"),
        "q_usable": f"WITH cells AS (SELECT * FROM ({_cells()})) SELECT cell_id, session_id FROM cells WHERE qc_pass AND NOT edge_flag",
        "q_per_second": _from_cells("SELECT cell_id, round(corrected_mean_green / 0.4, 6) AS corrected_mean_green_per_s, round(corrected_mean_red / 0.4, 6) AS corrected_mean_red_per_s, round(integrated_green / 0.4, 6) AS integrated_green_per_s FROM cells"),
        "q_baseline": _from_cells("SELECT stressor, n_cells, n_fields, days, round(bg, 6) AS baseline_green, round(bg25, 6) AS baseline_green_q25, round(bg75, 6) AS baseline_green_q75, round(br, 6) AS baseline_red, round(br25, 6) AS baseline_red_q25, round(br75, 6) AS baseline_red_q75 FROM base"),
        "q_baseline_diagnostics": _from_cells("SELECT stressor, dose_uM, condition_id, count(*) AS n_cells, round(quantile_cont(measurement_time_hours, 0.5), 6) AS time_h, round(quantile_cont(g, 0.5), 6) AS median_green, round(quantile_cont(r, 0.5), 6) AS median_red FROM annotated WHERE strain = 'nt' AND ok GROUP BY 1, 2, 3"),
        "q_subtract_baseline": _from_cells(f"SELECT cell_id, {_r('green_af', 'red_af')} FROM af"),
        "q_field_summaries": _from_cells(f"SELECT session_id, day, stressor, strain, dose_uM, condition_id, sample_id, n_cells, {_r('time_h', 'green_af', 'red_af')} FROM fields"),
        "q_timecourse": _from_cells(f"SELECT session_id, day, stressor, strain, dose_uM, condition_id, n_fields, n_cells, {_r('time_h', 'green', 'red')}, CASE WHEN green > 0 AND red > 0 THEN round(red / green, 6) END AS ratio FROM course"),
        "q_thresholds": _from_cells("SELECT stressor, round(gl, 6) AS green_limit, round(rl, 6) AS red_limit FROM lim"),
        "q_reporter_positive": _from_cells("SELECT cell_id, strain FROM pos WHERE strain = 'nt' OR pos"),
        "q_field_features": _from_cells(f"SELECT session_id, condition_id, sample_id, day, stressor, dose_uM, n_cells, n_positive, {_r('time_h', 'green', 'red', 'positive', 'green_pos', 'red_pos')} FROM feat"),
        "q_sample_points": _from_cells("SELECT session_id, day, stressor, dose_uM, condition_id, round(quantile_cont(measurement_time_hours, 0.5), 6) AS time_h, string_agg(DISTINCT sample_id, ',' ORDER BY sample_id) AS samples FROM annotated WHERE ok AND strain = 'tr' GROUP BY 1, 2, 3, 4, 5"),
        "q_imaging_times": _from_cells(", t AS (SELECT session_id, dose_uM, condition_id, quantile_cont(measurement_time_hours, 0.5) AS t FROM annotated WHERE ok AND strain = 'tr' GROUP BY 1, 2, 3), k AS (SELECT session_id, min(t) AS lo, max(t) AS hi FROM t WHERE dose_uM = 0 GROUP BY 1 HAVING count(*) >= 2) SELECT DISTINCT session_id, dose_uM, round_even(t, 3) AS time_h FROM t JOIN k USING (session_id) WHERE dose_uM > 0 AND t BETWEEN lo AND hi"),
        "q_population_summary": _from_cells(pop.format(floor="1") + " SELECT session_id, sample_id, condition_id, timepoint, count(*) AS n_cells_total, count(*) FILTER (qc_pass) AS n_cells_qc_pass, count(*) FILTER (el) AS n_cells_used, count(DISTINCT acquisition_order) AS n_images, CASE WHEN count(*) FILTER (el) >= 3 THEN 'ready' ELSE 'insufficient_cells' END AS summary_status, " + ", ".join(f"CASE WHEN count(*) FILTER (el) >= 3 THEN round(quantile_cont({x}, {q}) FILTER (el), 6) END AS {n}" for x, q, n in (("ratio", 0.5, "ratio_red_green_median"), ("ratio", 0.25, "ratio_red_green_q25"), ("ratio", 0.75, "ratio_red_green_q75"), ("corrected_mean_green", 0.5, "corrected_green_median"))) + " FROM c GROUP BY 1, 2, 3, 4"),
        "q_manual_review": _from_cells(pop.format(floor="0") + ", s AS (SELECT session_id, sample_id, condition_id, timepoint, count(*) FILTER (el) AS a, count(*) FILTER (el AND cell_id % 7 <> 0) AS b, quantile_cont(ratio, 0.5) FILTER (el) AS ma, quantile_cont(ratio, 0.5) FILTER (el AND cell_id % 7 <> 0) AS mb FROM c GROUP BY 1, 2, 3, 4) SELECT session_id, sample_id, condition_id, timepoint, a AS n_cells_used_baseline, b AS n_cells_used_without_flagged, CASE WHEN a >= 3 AND b >= 3 THEN round(100 * (mb - ma) / ma, 6) END AS ratio_red_green_median_change_percent FROM s"),
        "q_saturation_impact": _from_cells(", c AS (SELECT *, corrected_mean_red / corrected_mean_green AS ratio, qc_pass AND NOT sat_flag_legacy AS old FROM cells) SELECT session_id, sample_id, timepoint, count(*) AS n_cells, count(*) FILTER (sat_flag AND NOT sat_flag_legacy) AS newly_saturated, count(*) FILTER (NOT sat_flag AND sat_flag_legacy) AS no_longer_saturated, count(*) FILTER (old) AS n_qc_before, count(*) FILTER (qc_pass) AS n_qc_after, round(quantile_cont(ratio, 0.5) FILTER (old), 6) AS median_ratio_before, round(quantile_cont(ratio, 0.5) FILTER (qc_pass), 6) AS median_ratio_after FROM c GROUP BY 1, 2, 3"),
        "q_reason_counts": _from_cells(", r AS (SELECT unnest([CASE WHEN sat_flag THEN 'saturation' END, CASE WHEN edge_flag THEN 'border' END, CASE WHEN timepoint = 7 THEN 'lamp_warmup' END, CASE WHEN acquisition_order >= 2 THEN 'registration' END]) AS reason FROM cells) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1"),
        "q_interp_inside": f"{_EVENTS} SELECT event_id, round(CASE WHEN t = t0 THEN v0 ELSE {_LINE} END, 6) AS interpolated FROM p LEFT JOIN k ON t >= t0 AND (t < t1 OR (t1 IS NULL AND t = t0))",
        "q_interp_flat": f"{_EVENTS}, x AS (SELECT t0, v0, coalesce(t1, 'infinity'::DOUBLE) AS t1, coalesce(v1, v0) AS v1 FROM k UNION ALL SELECT '-infinity'::DOUBLE, v0, t0, v0 FROM k WHERE t0 = first_t) SELECT event_id, round({_LINE}, 6) AS interpolated FROM p LEFT JOIN x ON t >= t0 AND t < t1",
        "q_paired_features": _from_cells(_paired() + f" SELECT session_id, condition_id, sample_id, {_r('d_green', 'd_red', 'd_positive', 'log_fold_green_pos')} FROM paired"),
        "q_effects": _from_cells(f"SELECT session_id, readout, dose_uM, n_timepoints, {_r('effect', 'control_level')} FROM eff"),
        "q_peaks": f"WITH {peak} SELECT k AS event_type, round(t, 6) AS t_max_sampled, round(v, 6) AS v_max, round(CASE WHEN t0 IS NOT NULL AND t2 IS NOT NULL AND a < 0 THEN least(greatest((t0 + t) / 2 - s1 / (2 * a), t0), t2) ELSE t END, 6) AS t_peak, t0 IS NOT NULL AND t2 IS NOT NULL AS bracketed, CASE WHEN t0 IS NULL THEN 'first_sample' WHEN t2 IS NULL THEN 'last_sample' ELSE 'bracketed' END AS position, n_points FROM a",
        "q_excess": _from_cells(excess),
        "q_bh": "WITH t AS (SELECT o_custkey, CAST(sum(o_orderkey) % 9973 AS DOUBLE) / 9973 AS p FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM t) SELECT o_custkey, round(p, 6) AS p, round(least(1.0, min(p * n / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_bh FROM r",
        "q_credible_set": f"WITH {_MASSES}, b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY l_linestatus, l_returnflag ORDER BY p DESC, l_linenumber DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p) SELECT l_linestatus, l_returnflag, l_linenumber, round(p, 6) AS p FROM b WHERE s < 0.8 - 1e-12",
        "q_mass_region": f"WITH {_MASSES}, b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY l_linestatus, l_returnflag ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p), c AS (SELECT *, min(p) FILTER (s < 0.8) OVER (PARTITION BY l_linestatus, l_returnflag) AS cut FROM b) SELECT l_linestatus, l_returnflag, l_linenumber, round(p, 6) AS p FROM c WHERE p >= cut OR abs(p - cut) <= 1e-12 * abs(cut)",
        "q_intervals": "WITH i AS (SELECT l_suppkey, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS lo, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) + l_quantity AS hi FROM lineitem), n AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-12 * greatest(1, abs(lo)) THEN 0 ELSE 1 END AS new FROM i), r AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM n) SELECT l_suppkey, min(lo) AS lo, max(hi) AS hi FROM r GROUP BY l_suppkey, run",
        "q_cell_widths": "WITH p AS (SELECT p_partkey % 7 AS k, CAST(p_partkey AS DOUBLE) AS x FROM part) SELECT k, x, round(coalesce((lead(x) OVER w + x) / 2, 1e9) - coalesce((lag(x) OVER w + x) / 2, 0), 6) AS width FROM p WINDOW w AS (PARTITION BY k ORDER BY x)",
        "q_not_increasing": "WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS x FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM b WHERE o_totalprice <= x",
        "q_late_drift": "WITH d AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n, last_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders) SELECT o_custkey, round(max(abs(o_totalprice - l) / greatest(abs(l), 1e-12)), 6) AS drift FROM d WHERE i > n - greatest(1, ceil(n * 0.1)) GROUP BY 1",
        "q_linear_fit": "WITH g AS (SELECT coalesce(l_returnflag, 'all') AS l_returnflag, count(*) AS n_fields, regr_intercept(l_extendedprice, l_quantity) AS o, regr_slope(l_extendedprice, l_quantity) AS s, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())) SELECT l_returnflag, n_fields, 'linear' AS fit, CAST(NULL AS DOUBLE) AS mean, round(o, 6) AS \"offset\", round(s, 6) AS rate, round(1 - greatest(syy - s * sxy, 0) / syy, 6) AS r2, round(sqrt(greatest(syy - s * sxy, 0) / n_fields), 6) AS rmse FROM g",
        "q_session_scale": "WITH s AS (SELECT l_suppkey, count(*) AS n, sum(l_extendedprice / 1000 * l_quantity) AS xy, sum(l_quantity * l_quantity) AS xx, sum(l_extendedprice / 1000 * (l_extendedprice / 1000)) AS yy FROM lineitem GROUP BY 1) SELECT l_suppkey, CASE WHEN n >= 3 THEN round(xy / xx, 6) END AS c_session, CASE WHEN n >= 3 THEN round(sqrt(greatest(yy - 2 * xy / xx * xy + xy / xx * (xy / xx) * xx, 0) / n), 6) END AS rmse, n AS n_pairs FROM s",
        "q_pooled_covariance": "WITH m AS (SELECT l_suppkey, count(*) AS n, covar_samp(l_quantity, l_quantity) AS xx, covar_samp(l_quantity, l_discount) AS xy, covar_samp(l_discount, l_discount) AS yy FROM lineitem GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS dof, round(sum(coalesce(xx, 0) * (n - 1)) / sum(n - 1), 6) AS xx, round(sum(coalesce(xy, 0) * (n - 1)) / sum(n - 1), 6) AS xy, round(sum(coalesce(yy, 0) * (n - 1)) / sum(n - 1), 6) AS yy FROM m",
        "q_class_fits": _from_cells(
            ", d AS (SELECT stressor, session_id, dose_uM, count(*) AS n, avg(green) AS g, avg(red) AS r, covar_pop(green, green) * count(*) AS w00, covar_pop(green, red) * count(*) AS w01, covar_pop(red, red) * count(*) AS w11 FROM feat GROUP BY 1, 2, 3), c AS (SELECT stressor, dose_uM, avg(g) AS cg, avg(r) AS cr FROM d GROUP BY 1, 2), "
            "t AS (SELECT d.stressor, sum(n) AS n, count(*) AS nd, count(DISTINCT d.dose_uM) AS k, sum(w00) AS w00, sum(w01) AS w01, sum(w11) AS w11, sum((g - cg) * (g - cg)) AS b00, sum((r - cr) * (r - cr)) AS b11 FROM d JOIN c ON d.stressor = c.stressor AND d.dose_uM = c.dose_uM GROUP BY 1) "
            "SELECT t.stressor, " + ", ".join(f"round(CASE WHEN n > nd THEN {w} / (n - nd) ELSE 0 END, 6) AS {w}" for w in ("w00", "w01", "w11")) + ", " + ", ".join(f"round(CASE WHEN nd > k THEN {b} / (nd - k) ELSE 0 END, 6) AS {b}" for b in ("b00", "b11")) + ", dose_uM, round(cg, 6) AS green, round(cr, 6) AS red FROM t JOIN c USING (stressor)"
        ),
        "q_lodo": _lodo(["green", "red", "positive"], "SELECT * FROM feat", False),
        "q_lodo_scores": _lodo(["d_green", "d_red", "d_positive"], "SELECT * FROM paired", True).replace(", src AS", _paired() + ", src AS", 1),
        "q_time_windows": "WITH t AS (SELECT event_id, (hour(ts) * 60 + minute(ts)) / 60.0 AS h FROM events) SELECT event_id, CASE WHEN h < 2 THEN 0 WHEN h < 4 THEN 1 WHEN h < 6 THEN 2 WHEN h <= 8 THEN 3 ELSE -1 END AS time_window FROM t",
        "q_snapshot_grid": f"WITH {_GRID}, {_SNAP}, c AS (SELECT *, abs(ratio - ratio_obs) <= 0.0401 AS a, abs(gn - green_obs) <= 0.1001 AS b FROM j), x AS (SELECT obs_id, bool_or(low) AS low, count(*) FILTER (a) AS ro, count(*) FILTER (b) AS go, count(*) FILTER (a AND b) AS n, min(dose_uM) FILTER (a AND b) AS d, min(time_h) FILTER (a AND b) AS t, min(ratio_obs) < min(ratio) - 0.0401 OR max(ratio_obs) > max(ratio) + 0.0401 OR min(green_obs) < min(gn) - 0.1001 OR max(green_obs) > max(gn) + 0.1001 AS outside FROM c GROUP BY 1) SELECT obs_id, CASE WHEN low THEN 'below_detection_floor' WHEN n = 1 THEN 'unique_grid_pair' WHEN n > 1 THEN 'ambiguous' WHEN outside THEN 'out_of_response_domain' ELSE 'no_grid_pair_match' END AS status, CASE WHEN NOT low THEN n END AS n, CASE WHEN NOT low THEN ro END AS ratio_only, CASE WHEN NOT low THEN go END AS green_only, CASE WHEN NOT low AND n = 1 THEN d END AS dose_estimate_uM, CASE WHEN NOT low AND n = 1 THEN t END AS elapsed_time_hours FROM x",
        "q_grid_posterior": f"WITH {_GRID}, {_SNAP}, a AS (SELECT *, ln(ratio_obs) - ln(ratio) AS a, green_obs - gn AS b FROM j WHERE NOT low), d AS (SELECT *, (0.09e0 * a * a - 2 * 0.005e0 * a * b + 0.04e0 * b * b) / (0.04e0 * 0.09e0 - 0.005e0 * 0.005e0) AS d2 FROM a), l AS (SELECT *, exp(-0.5 * d2 + 0.5 * min(d2) OVER (PARTITION BY obs_id)) AS e FROM d), m AS (SELECT *, e / sum(e) OVER (PARTITION BY obs_id) AS mass FROM l), b AS (SELECT *, coalesce(sum(mass) OVER (PARTITION BY obs_id ORDER BY mass DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM m), c AS (SELECT *, min(mass) FILTER (s < 0.95) OVER (PARTITION BY obs_id) AS cut FROM b) SELECT obs_id, round(max(mass), 6) AS top, round(sum(mass * dose_uM), 6) AS mean_dose, round(sum(mass * time_h), 6) AS mean_time, count(*) FILTER (mass >= cut OR abs(mass - cut) <= 1e-12 * cut) AS n_region FROM c GROUP BY 1",
        "q_dose_grid": f"WITH {_GRID}, {_DOSE_OBS}, j AS (SELECT o.*, dose_uM, ratio, min(ratio) OVER w AS lo, max(ratio) OVER w AS hi FROM o JOIN g ON o.time_h = g.time_h WINDOW w AS (PARTITION BY obs_id, o.time_h)), d AS (SELECT obs_id, dose_uM, bool_and(abs(ratio - observed) <= 0.0601) AS ok, bool_or(observed < lo - 0.0601 OR observed > hi + 0.0601) AS outside, max(abs(ratio - observed)) AS res FROM j GROUP BY 1, 2), s AS (SELECT obs_id, count(*) FILTER (ok) AS n, min(dose_uM) FILTER (ok) AS d, bool_or(outside) AS outside, min(res) AS r FROM d GROUP BY 1) SELECT obs_id, CASE WHEN n = 1 THEN 'unique_grid_match' WHEN n > 1 THEN 'ambiguous' WHEN outside THEN 'out_of_response_domain' ELSE 'no_grid_match' END AS status, n, CASE WHEN n = 1 THEN d END AS dose_estimate_uM, round(r, 6) AS smallest_residual FROM s",
        "q_joint_dose_time": f"WITH {_GRID}, {_DOSE_OBS}, j AS (SELECT o.obs_id, x.i * 0.5e0 AS elapsed, o.k, observed, dose_uM, ratio, min(ratio) OVER w AS lo, max(ratio) OVER w AS hi FROM o CROSS JOIN range(1, 5) x(i) JOIN g ON g.time_h = o.time_h - 0.5e0 + x.i * 0.5e0 WHERE o.k <= 3 WINDOW w AS (PARTITION BY o.obs_id, o.k)), p AS (SELECT obs_id, dose_uM, elapsed, bool_and(abs(ratio - observed) <= 0.0601) AS ok, bool_or(observed < lo - 0.0601 OR observed > hi + 0.0601) AS outside FROM j GROUP BY 1, 2, 3), s AS (SELECT obs_id, count(*) FILTER (ok) AS n, min(dose_uM) FILTER (ok) AS d, min(elapsed) FILTER (ok) AS e, bool_or(outside) AS outside FROM p GROUP BY 1) SELECT obs_id, CASE WHEN n = 1 THEN 'unique_grid_pair' WHEN n > 1 THEN 'ambiguous' WHEN outside THEN 'out_of_response_domain' ELSE 'no_grid_pair_match' END AS status, n, CASE WHEN n = 1 THEN d END AS dose_estimate_uM, CASE WHEN n = 1 THEN e END AS elapsed_time_hours FROM s",
        "q_rejected": "SELECT DISTINCT doc_id, 'rejected' AS status, 'no segmented cells' AS reason FROM documents ANTI JOIN labels USING (doc_id)",
        "q_semi": "SELECT doc_id, lang FROM documents SEMI JOIN labels USING (doc_id)",
        "q_nearest_frame": "WITH t AS (SELECT * FROM events WHERE event_type = 'purchase'), f AS (SELECT * FROM events WHERE event_type <> 'purchase'), j AS (SELECT t.event_id AS target_id, f.event_id AS path, abs(epoch_us(f.ts) - epoch_us(t.ts)) / 60e6 AS d FROM t LEFT JOIN f ON t.user_id = f.user_id), r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY d NULLS LAST, path) AS n FROM j) SELECT target_id, CASE WHEN d <= 720 THEN path END AS path, CASE WHEN d <= 720 THEN round(d, 6) END AS distance_min FROM r WHERE n = 1",
        "q_acquisition_order": "WITH o AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS acquisition_order FROM events), f AS (SELECT *, min(acquisition_order) OVER (PARTITION BY user_id, event_type) AS first FROM o) SELECT event_id, acquisition_order, dense_rank() OVER (PARTITION BY user_id ORDER BY first) - 1 AS timepoint FROM f",
        "q_scale_diagnostics": "WITH p AS (SELECT l_suppkey, l_extendedprice / 1000 AS i, l_quantity AS m FROM lineitem), f AS (SELECT l_suppkey, count(*) AS n, sum(i * m) / sum(m * m) AS scale, regr_slope(i, m) AS slope, regr_intercept(i, m) AS intercept FROM p GROUP BY 1) SELECT l_suppkey, n, round(scale, 6) AS scale, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(sqrt(avg((i - scale * m) * (i - scale * m))), 6) AS rmse_origin, round(sqrt(avg((i - slope * m - intercept) * (i - slope * m - intercept))), 6) AS rmse_affine FROM p JOIN f USING (l_suppkey) GROUP BY l_suppkey, n, scale, slope, intercept",
        "q_prior_density": f"WITH {_GRID}, d AS (SELECT dose_uM, coalesce((lead(dose_uM) OVER (ORDER BY dose_uM) + dose_uM) / 2, 200) - coalesce((lag(dose_uM) OVER (ORDER BY dose_uM) + dose_uM) / 2, 0) AS w FROM (SELECT DISTINCT dose_uM FROM g)), t AS (SELECT time_h, coalesce((lead(time_h) OVER (ORDER BY time_h) + time_h) / 2, 4) - coalesce((lag(time_h) OVER (ORDER BY time_h) + time_h) / 2, 0) AS v FROM (SELECT DISTINCT time_h FROM g)) SELECT dose_uM, time_h, round(w * v / sum(w * v) OVER (), 6) AS prior FROM d CROSS JOIN t",
        "q_sessions": _from_cells("SELECT DISTINCT session_id, day, stressor, strain FROM annotated"),
        "q_quality_fold": _from_cells("SELECT cell_id, NOT (sat_flag OR edge_flag OR timepoint = 7 OR acquisition_order >= 2) AS qc_pass, concat_ws(';', CASE WHEN sat_flag THEN 'saturation' END, CASE WHEN edge_flag THEN 'border' END, CASE WHEN timepoint = 7 THEN 'lamp_warmup' END, CASE WHEN acquisition_order >= 2 THEN 'registration' END) AS qc_reasons FROM cells"),
        "q_event_windows": "SELECT CAST(epoch_us(ts) // 21600000000 AS BIGINT) * 21600 AS start_s, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
        "q_event_sessions": "WITH b AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM b) SELECT user_id, min(t) AS start_us, count(*) AS n FROM r GROUP BY user_id, run",
        "q_field_counts": _from_cells("SELECT session_id, condition_id, sample_id, count(*) AS n_cells, count(*) FILTER (ok) AS n_usable, round(sum(corrected_mean_green) FILTER (ok), 6) AS sum_green, round(sum(corrected_mean_red) FILTER (ok), 6) AS sum_red FROM annotated GROUP BY 1, 2, 3"),
    }


def _cells() -> str:
    from .queries import CELLS

    return CELLS
