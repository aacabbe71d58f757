"""Acquisition tables and sample trajectories: odd cells, refusals and modes."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cytoframe.operators import acquisition as A
from cytoframe.operators import checks, linkage


def test_one_to_one(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, l string")
    right = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "k long, r string")
    got = {r.l: (r.r, r.both) for r in A.one_to_one(left, right, ["k"], "both").collect()}
    assert got == {"a": ("x", True), "b": (None, False), "c": (None, False)}
    assert A.one_to_one(left, right, ["k"]).columns == ["k", "l", "r"]
    with pytest.raises(ValueError, match="left"):
        A.one_to_one(left.union(left), right, ["k"])
    with pytest.raises(ValueError, match="right"):
        A.one_to_one(left, right.union(right), ["k"])


def test_notes_and_hand_filled_cells(spark):
    day = dt.datetime(2026, 10, 5, 9)
    df = spark.createDataFrame([(t, day) for t in ("3:05", " 11:59 ", "12", "", None, "3:75")], "t string, d timestamp_ntz")
    assert [str(r[0])[11:16] if r[0] else None for r in df.select(A.afternoon(F.col("t"), F.col("d"))).collect()] == ["15:05", "23:59", None, None, None, None]
    s = spark.createDataFrame([("",), (None,), (" 4 ",), ("x",), ("inf",), ("NaN",)], "s string")
    assert [r[0] for r in s.select(A.optional_shift(F.col("s"))).collect()] == [0.0, 0.0, 4.0, None, None, None]
    assert [r[0] for r in s.select(A.recorded(F.col("s"))).collect()] == [None, None, 4.0, None, None, None]


def test_numbers_cover_all_rows_once(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = A.numbered(rows, ["x"]).orderBy("x").collect()
    assert [r.number for r in got] == list(range(1000))
    b = {r.batch: r["count"] for r in A.batches(rows, ["x"], 300).groupBy("batch").count().collect()}
    assert b == {0: 300, 1: 300, 2: 300, 3: 100} and A.batches(rows.limit(0), ["x"], 3).collect() == []


def test_cutoffs_codes_and_ranks(spark):
    df = spark.createDataFrame([("s", 1.0), ("s", 2.0), ("s", 3.0), ("s", None), ("t", None)], "s string, v double")
    got = sorted(((r.s, r.v, r.in_focus) for r in A.session_cutoff(df, ["s"], "v", 50).collect()), key=str)
    assert got == sorted([("s", 1.0, False), ("s", 2.0, True), ("s", 3.0, True), ("s", None, False), ("t", None, True)], key=str)
    assert {(r.s, r.v, r.code) for r in A.codes(df, ["s"], "v").collect()} == {("s", 1.0, 0), ("s", 2.0, 1), ("s", 3.0, 2), ("s", None, -1), ("t", None, -1)}
    nan = spark.createDataFrame([("s", float("nan"), 1), ("s", -5.0, 2), ("s", None, 0)], "s string, v double, i int")
    assert [r.i for r in A.ranked(nan, ["s"], "v", "i", 3).orderBy("place").collect()] == [2, 0, 1]


def test_rules_and_tallies(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else float(i)) for i in range(100)] + [(None, None)], "k long, v double")
    rules = checks.rules_from([{"level": "error", "column": "v", "rule": "missing", "broken": "v IS NULL"}, {"level": "warning", "column": "v", "rule": "large", "broken": "v > 90"}])
    j = checks.judge(df, rules)
    t = {r.rule: (r.level, r.n, r["first"]) for r in checks.tally(j, "k", 3).collect()}
    assert t == {"missing": ("error", 35, [None, "0", "3"]), "large": ("warning", 6, ["91", "92", "94"])}
    assert j.where(checks.refused()).count() == 35
    again = checks.mark_repeats(j.unionByName(j.where("k = 1")), ["k"], "k", "twice")
    assert again.where(F.exists("issues", lambda x: x["rule"] == "twice")).select("k").collect() == [(1,), (1,)]
    assert checks.judge(df, []).where(checks.refused()).count() == 0
    with pytest.raises(ValueError, match="levels"):
        checks.rules_from([{"level": "bad", "column": "v", "rule": "x", "broken": "true"}])
    assert ("error", "objective", "missing") in checks.missing_columns(["session_id"])


GRID = [("m", float(d), t / 2, 0.1 + d / 100 + t / 20) for d in range(0, 90, 10) for t in range(1, 7)]


def sample(session, name, dose, **kw):
    rows = []
    for t in (1, 2, 3):
        r = 0.1 + dose / 100 + t / 20
        rows.append({"session_id": session, "sample_id": name, "condition_id": None, "measurement_time_hours": t / 2, "calibrated_ratio_red_green_median": r, "ratio_red_green_median": r * 2, "n_cells_used": 5, "c_session": 2.0, "calibration_reference_id": "r", "calibration_source_kind": "synthetic", "calibration_source": "x", "data_kind": "synthetic"} | kw)
    return rows


def test_modes_of_sample_decoding(spark):
    schema = "session_id string, sample_id string, condition_id string, measurement_time_hours double, calibrated_ratio_red_green_median double, ratio_red_green_median double, n_cells_used int, c_session double, calibration_reference_id string, calibration_source_kind string, calibration_source string, data_kind string"
    rows = sample("s", "a", 20) + sample("s", "b", 50) + sample("s", "few", 20, n_cells_used=2) + sample("s", "other", 20, calibration_reference_id=None) + sample("u", "none", 20) + sample("s", "twice", 30, measurement_time_hours=1.0)
    samples = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    calibrations = spark.createDataFrame([("s", "r", 2.0, "synthetic", "x")], "session_id string, reference_id string, c_session double, source_kind string, source string")
    grid = spark.createDataFrame(GRID, "artifact_id string, dose_uM double, time_h double, ratio double")
    go = lambda mode, **kw: {r.sample_id: r for r in linkage.decode_samples(grid, samples, calibrations, artifact_id="m", mode=mode, tolerance=0.01, data_kind="synthetic", min_cells=3, **kw).collect()}
    d = go("discrete")
    assert {k: r.reason for k, r in d.items()} == {"a": None, "b": None, "few": "too few cells", "other": "rows name another reference", "none": "no calibration of the session", "twice": "a time occurs twice"}
    assert (d["a"].status, d["a"].dose_estimate_uM, d["b"].dose_estimate_uM, d["few"].status) == ("unique_grid_match", 20.0, 50.0, "refused")
    c = go("continuous")
    assert abs(c["a"].dose_estimate_uM - 20) < 1e-6 and c["b"].status == "single_compatible_region" and c["few"].status == "refused"
    offsets = spark.createDataFrame([("m", 0.5), ("m", 1.0)], "artifact_id string, elapsed_h double")
    j = go("joint", offsets=offsets)
    assert j["a"].n_points == 3 and j["a"].status in ("unique_grid_pair", "ambiguous") and j["twice"].status == "refused"
    for bad in ({"mode": "best"}, {"mode": "joint"}, {"mode": "discrete", "offsets": offsets}, {"mode": "discrete", "allowance": offsets}):
        with pytest.raises(ValueError):
            go(**bad)


def test_snapshots_need_ready_summaries(spark):
    settings = {"objective": "40X", "exposure_ms_green": 400.0, "exposure_ms_red": 400.0, "nd_filter_green": None, "nd_filter_red": None}
    told = json.dumps(settings)
    base = ("s", "p", "b", "R1", 1, 0.5, 3.0, "ready", "median", "40X", 400.0, 400.0, None, None, told)
    rows = [base, base[:7] + ("few",) + base[8:], base[:8] + ("mean",) + base[9:], base[:2] + (" ",) + base[3:], base[:14] + (None,), base[:10] + (300.0,) + base[11:], base[:5] + (0.0,) + base[6:], base[:14] + (json.dumps({k: v for k, v in settings.items() if k != "nd_filter_red"}),)]
    df = spark.createDataFrame(rows, "session_id string, specimen_id string, biological_replicate_id string, sample_id string, timepoint long, ratio_red_green_median double, corrected_green_median double, summary_status string, summary_method string, objective string, exposure_ms_green double, exposure_ms_red double, nd_filter_green double, nd_filter_red double, acquisition_json string")
    got = [r.reason for r in linkage.snapshots_from_summary(df, method="median", source="here").collect()]
    assert got == [None, "summary is not ready", "summary has another method", "an identity is missing", "no acquisition settings", "acquisition settings disagree", "ratio or green out of range", "acquisition settings disagree"]


def test_trajectories_are_dealt_once(spark):
    from cytoframe.operators import linkage

    columns = "session_id string, sample_id string, condition_id string, measurement_time_hours double, ratio_red_green_median double, calibrated_ratio_red_green_median double, n_cells_used int, calibration_reference_id string, calibration_source_kind string, calibration_source string, data_kind string, c_session double"
    rows = [("s", "a", None, float(t), 0.4, 0.4, 5, "r", "synthetic", "made", "synthetic", 1.0) for t in (1, 2)]
    calibrations = spark.createDataFrame([("s", "r", 1.0, "synthetic", "made")], "session_id string, reference_id string, c_session double, source_kind string, source string")
    checked = linkage.check_trajectories(spark.createDataFrame(rows, columns), calibrations.hint("broadcast"), data_kind="synthetic", min_cells=3, time="measurement_time_hours")
    assert checked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(obs_id") == 1
    assert [(r.n_points, r.reason) for r in checked.collect()] == [(2, None)]
