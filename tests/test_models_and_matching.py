import datetime
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoframe.operators import grids, images, matching, model, summary
from cytoframe.sources import logs, tables
from cytoframe.streaming import windows


def test_golden_model_values():
    s = model.simulate("er", np.array([0.0, 100.0, 500.0, 1000.0, 2345.0, 5000.0, 10000.0]), np.array([12.0]))
    assert s["green"][:, 0] == pytest.approx([2.3570, 2.3626, 2.6000, 3.2200, 5.5234, 6.6161, 6.7040], abs=2e-4)
    cleared = model.simulate("er", np.array([75.0]), np.array([1.0, 2.0]), clearance=0.5, step=5e-3)
    assert cleared["stress"][0] == pytest.approx(75 * np.exp([-0.5, -1.0]), rel=1e-6)
    with pytest.raises(ValueError, match="increasing"):
        model.simulate("er", np.array([1.0]), np.array([2.0, 1.0]))
    with pytest.raises(ValueError, match="unknown parameters"):
        model.parameters("er", nope=1.0)


def test_response_table(spark):
    t = model.response_table(spark, "er", [0.0, 500.0], [1.0, 12.0], step=5e-3)
    assert t.count() == 4 and t.where("dose_uM = 500 and time_h = 12").first().green == pytest.approx(2.6, abs=1e-3)


def test_model_fold_takes_any_simulator(spark):
    times = spark.createDataFrame([("s", 100.0, [1.0, 2.0]), ("t", 5.0, [1.0])], "session_id string, dose_uM double, times_h array<double>")
    stressors = spark.createDataFrame([("s", "h2o2"), ("t", "heat")], "session_id string, stressor string")
    fake = lambda v, d, t, c: {ch: np.array([[4.0 if c is None else 2.0] * len(t), [1.0] * len(t)]) for ch in ("green", "red")}
    out = model.model_fold(times, stressors, (None, 2.0), fake).collect()
    assert sorted((r.readout, r.clearance_per_h is None, r.model_fold) for r in out) == [("green", False, 2.0), ("green", True, 4.0), ("red", False, 2.0), ("red", True, 4.0)]


def long(spark, doses, times, ratios, green=None):
    return spark.createDataFrame([("m", float(d), float(t), float(ratios[i][j]), float(green[i][j]) if green else None) for i, d in enumerate(doses) for j, t in enumerate(times)], "artifact_id string, dose_uM double, time_h double, ratio double, green double")


def observed(spark, rows, tolerance):
    return spark.createDataFrame([(i, "m", float(t), float(r), tolerance, 1.0) for i, o in enumerate(rows) for t, r in o], "obs_id int, artifact_id string, time_h double, ratio double, tolerance double, green double")


def test_discrete_doses(spark):
    g = long(spark, (0, 25, 75), (0.5, 1), ((0.1, 0.2), (0.4, 0.5), (0.7, 0.8)))
    o = observed(spark, [((0.5, 0.4), (1, 0.5)), ((0.5, 0.55), (1, 0.65)), ((0.5, 5), (1, 5))], 0.01)
    out = grids.decode_dose(g, o).orderBy("obs_id").collect()
    assert [(r.status, r.dose_estimate_uM) for r in out] == [("unique_grid_match", 25.0), ("no_grid_match", None), ("out_of_response_domain", None)]
    assert grids.decode_dose(g, o.withColumn("tolerance", F.lit(0.31))).where("obs_id = 0").first().status == "ambiguous"
    assert grids.decode_dose(g, o, green_floor=1.0).where("obs_id = 0").first().status == "below_detection_floor"


def test_continuous_doses(spark):
    line = long(spark, (0, 50, 100), (0.5, 1), ((0.2, 0.4), (0.5, 1), (0.8, 1.6)))
    r = grids.decode_continuous(line, observed(spark, [((0.5, 0.425), (1, 0.85))], 0.01)).first()
    assert r.status == "single_compatible_region" and r.dose_estimate_uM == pytest.approx(37.5)
    tent = long(spark, (0, 50, 100), (0.5, 1), ((0.2, 0.4), (0.8, 1.6), (0.2, 0.4)))
    r = grids.decode_continuous(tent, observed(spark, [((0.5, 0.5), (1, 1))], 0.01)).first()
    assert r.status == "ambiguous" and len(r.regions) == 2
    r = grids.decode_continuous(tent, observed(spark, [((0.5, 0.5), (1, 1))], 2.0)).first()
    assert r.status == "ambiguous" and r.minima == pytest.approx([25, 75])
    flat = long(spark, (0, 100), (0.5,), ((0.3,), (0.3,)))
    r = grids.decode_continuous(flat, observed(spark, [((0.5, 0.3),)], 0.01)).first()
    assert r.status == "flat_response" and [tuple(x) for x in r.regions] == [(0.0, 100.0)]
    out = grids.decode_continuous(tent, observed(spark, [((0.5, 2), (1, 4)), ((0.5, 0.2), (1, 1.6))], 0.01)).orderBy("obs_id").collect()
    assert [r.status for r in out] == ["out_of_response_domain", "no_continuous_match"]


def test_joint_dose_and_time(spark):
    g = long(spark, (0, 25), (0.5, 1, 1.5), ((0.1, 0.1, 0.1), (0.4, 0.8, 1.2)))
    o = spark.createDataFrame([(0, "m", 0.0, 0.8, 0.01), (0, "m", 0.5, 1.2, 0.01), (1, "m", 0.0, 0.1, 0.01), (1, "m", 0.5, 1.2, 0.01)], "obs_id int, artifact_id string, relative_h double, ratio double, tolerance double")
    offsets = spark.createDataFrame([("m", 0.5), ("m", 1.0)], "artifact_id string, elapsed_h double")
    out = grids.decode_joint(g, o, offsets).orderBy("obs_id").collect()
    assert (out[0].status, out[0].dose_estimate_uM, out[0].elapsed_time_hours) == ("unique_grid_pair", 25.0, 1.0) and out[1].status == "no_grid_pair_match"
    with pytest.raises(ValueError, match="exactly one"):
        grids.decode_joint(g, o, offsets.union(spark.createDataFrame([("m", 1.3)], offsets.schema)))


def test_prior_of_cell_areas(spark):
    g = long(spark, (0, 25, 75), (0.5, 1, 8), np.ones((3, 3)))
    p = grids.prior_masses(g, "uniform_density", dose_bounds=(0, 75), time_bounds=(0, 8))
    got = np.array([[p.where(f"dose_uM = {d} and time_h = {t}").first().prior for t in (0.5, 1, 8)] for d in (0, 25, 75)])
    assert got == pytest.approx(np.outer([12.5, 37.5, 25], [0.75, 3.75, 3.5]) / 600)


def test_grid_posterior_equals_direct_gaussian(spark):
    r = np.random.default_rng(0)
    ratios, green = r.uniform(0.2, 2, (4, 3)), r.uniform(0, 1, (4, 3))
    g = grids.prior_masses(long(spark, range(4), range(3), ratios, green.tolist()), "uniform_grid")
    prepared = spark.createDataFrame([(0, "m", 0.7, 0.4, 0.0, 1.0, False), (1, "m", 20.0, 0.4, 0.0, 1.0, False), (2, "m", 1.0, 0.1, 0.0, 1.0, True)], "obs_id int, artifact_id string, ratio_obs double, green_obs double, model_low double, model_high double, low boolean")
    cov = np.array([[0.04, 0.01], [0.01, 0.09]])
    m, s = grids.grid_posterior(g, prepared, (0.04, 0.01, 0.09), max_distance=20.0)
    z = np.stack([np.log(0.7) - np.log(ratios), 0.4 - green], -1)
    want = np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", z, np.linalg.inv(cov), z))
    want /= want.sum()
    for x in m.where("obs_id = 0").collect():
        assert x.mass == pytest.approx(want[int(x.dose_uM), int(x.time_h)], rel=1e-9)
    assert {x.obs_id: x.status for x in s.collect()} == {0: "posterior_available", 1: "poor_model_fit", 2: "below_detection_floor"}
    assert grids.marginals(m.where("obs_id = 0"), "dose_uM").agg(F.sum("mass")).first()[0] == pytest.approx(1)


def test_assignment_is_least():
    r = np.random.default_rng(1)
    for _ in range(60):
        n, m = r.integers(1, 6, 2)
        c = r.integers(0, 12, (n, m)).astype(float)
        i, j = matching.assign(c)
        small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
        cost = c if n <= m else c.T
        best = min(sum(cost[a, b] for a, b in zip(small, p, strict=True)) for p in itertools.permutations(large, len(small)))
        assert len(set(i)) == len(set(j)) == min(n, m) and c[i, j].sum() == pytest.approx(best)


def test_images_against_log(spark):
    t = lambda h, m: datetime.datetime(2026, 1, 1, h, m, 10)
    images_ = spark.createDataFrame(
        [("a", "R", "top/A", t(10, 50), t(10, 51)), ("b", "R", "top/B", t(11, 0), t(11, 1)), ("c", "R", "top/A", t(11, 10), t(11, 11)), ("d", "R", "top/Z", t(15, 0), t(15, 1)), ("e", "R", "top/A", None, None)],
        "image_id string, root string, folder string, red_time timestamp_ntz, green_time timestamp_ntz",
    )
    rows = spark.createDataFrame(
        [(1, "2026-01-01", "R", "A", "10:00", "10:01"), (2, "2026-01-01", "R", "B", "10:10", "10:11"), (3, "2026-01-01", "R", "A", "10:20", "10:21"), (4, "2026-01-01", "R", "C", "20:00", "20:01")],
        "row_id int, date string, root string, folder string, red string, green string",
    )
    off = matching.clock_offsets(matching.candidates(images_, rows)).first().offset_min
    assert off == pytest.approx(50 - 20 / 60)
    out = {(r.image_id, r.row_id): r.status for r in matching.match_images(images_, rows).collect()}
    assert out == {("a", 1): "matched", ("b", 2): "matched", ("c", 3): "matched", ("d", None): "no_log_row", ("e", None): "no_timestamp", (None, 4): "log_row_without_image"}


LOG = "Title\nSeries one\nadded 12:00\n0h   5   14:28   400   14:32*   14:33\n3h   300   17:15   450   17:13   17:14\n     (cluster)\n\f6h   600   18:09   300   18:07   18:07\nNotes\nSeries two\n0  R1  17:34  17:31  17:34\n0  R1  17:34  17:31  17:34\n"


def test_log_rows(spark):
    c = logs.CLOCK
    sections = [
        logs.Section("one", "Series one", rf"(?P<tp_label>\d+h) (?P<dose_uM>\d+) (?P<bf>{c}) (?P<exp>\d+) (?P<red>{c})(?P<red_star>\*?) (?P<green>{c})", {"added": "12:00", "folder": "F/{dose_uM}"}, ("cluster",)),
        logs.Section("two", "Series two", rf"(?P<dose_uM>\d+) (?P<rep>R\d) (?P<bf>{c}) (?P<red>{c}) (?P<green>{c})", {"exp": "200", "added": "16:00", "plating": "16:30"}),
        logs.Section("three", "Series three", "x"),
    ]
    texts = spark.createDataFrame([("p", LOG)], "path string, value string")
    columns = ["section", "tp_label", "dose_uM", "rep", "added", "plating", "bf", "red", "green", "exp", "folder", "flags"]
    out = logs.finish_log(logs.read_log(texts, sections, columns)).orderBy("place").collect()
    by = {(r.section, r.tp_label): r for r in out}
    assert by["one", "0h"].measurement_time_hours == "2.533" and by["one", "0h"].flags == "starred_in_log:red" and by["one", "0h"].exposure_acq_ms == "1600"
    assert by["one", "3h"].rep == "cluster" and by["one", "3h"].flags == "acq_derived_4x" and by["one", "6h"].folder == "F/600"
    two = [r for r in out if r.section == "two"]
    assert [r.flags for r in two] == ["exp_from_section_note;acq_derived_4x", "exp_from_section_note;acq_derived_4x;duplicate_row_in_log"] and two[0].sampling_time_hours == "0.500"
    assert [r.flags for r in out if r.section == "three"] == ["heading_not_found"]


def population(spark, **changes):
    base = {"session_id": "s1", "sample_id": "a", "condition_id": "d", "timepoint": 1, "acquisition_order": 1, "sampling_time_hours": 0.5, "measurement_time_hours": 0.75, "exposure_ms_green": 100.0, "exposure_ms_red": 200.0, "nd_filter_green": 0.0, "nd_filter_red": 0.0, "objective": "40X"}
    cells = [(1, True, 100.0, 60.0, 0.6), (2, True, 200.0, 180.0, 0.9), (3, True, 50.0, 60.0, 1.2), (4, False, 10.0, 1000.0, 100.0)]
    rows = [base | {"cell_id": i, "qc_pass": q, "corrected_mean_green": g, "corrected_mean_red": r, "ratio_red_green": x} | changes for i, q, g, r, x in cells]
    kinds = {"session_id": "string", "sample_id": "string", "condition_id": "string", "objective": "string", "timepoint": "long", "acquisition_order": "long", "cell_id": "long", "qc_pass": "boolean"}
    names = list(rows[0])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names))


def test_population_summary(spark):
    calibration = spark.createDataFrame([("s1", "ref", 1.5, "synthetic", "here")], "session_id string, reference_id string, c_session double, source_kind string, source string")
    r = summary.summarize_cells(population(spark), data_kind="synthetic", calibrations=calibration).first()
    assert (r.n_cells_used, r.n_cells_total, r.n_cells_qc_pass) == (3, 4, 3) and r.ratio_red_green_median == pytest.approx(0.9) and r.ratio_red_green_q25 == pytest.approx(0.75)
    assert r.calibrated_ratio_red_green_median == pytest.approx(0.6) and r.calibrated_ratio_red_green_q25 == pytest.approx(0.5)
    few = summary.summarize_cells(population(spark), data_kind="synthetic", min_cells=4).first()
    assert few.summary_status == "insufficient_cells" and few.ratio_red_green_median is None and few.n_cells_used == 3
    null_group = summary.summarize_cells(population(spark, condition_id=None), data_kind="synthetic").first()
    assert null_group.condition_id is None and null_group.n_cells_used == 3
    with pytest.raises(ValueError, match="duplicate"):
        summary.summarize_cells(population(spark, cell_id=1), data_kind="synthetic")
    with pytest.raises(ValueError, match="ratio_red_green differs"):
        summary.summarize_cells(population(spark, ratio_red_green=5.0), data_kind="synthetic")
    with pytest.raises(ValueError, match="sample_id"):
        summary.summarize_cells(population(spark, sample_id=" "), data_kind="synthetic")
    with pytest.raises(ValueError, match="missing calibration"):
        summary.summarize_cells(population(spark, session_id="s2"), data_kind="synthetic", calibrations=calibration)
    with pytest.raises(ValueError, match="source_kind"):
        summary.summarize_cells(population(spark), data_kind="experimental", calibrations=calibration)


def test_review(spark):
    flagged = population(spark).where("cell_id = 1").select(*summary.IDENTITY, F.lit("debris").alias("review_reason"))
    _, _, c, marked = summary.review_summaries(population(spark), flagged, data_kind="synthetic", min_cells=1)
    r = c.first()
    assert (r.n_cells_used_baseline, r.n_cells_used_without_flagged) == (3, 2) and r.ratio_red_green_median_change_percent == pytest.approx(100 * (1.05 - 0.9) / 0.9) and marked.count() == 4
    with pytest.raises(ValueError, match="absent"):
        summary.review_summaries(population(spark), flagged.withColumn("cell_id", F.lit(99).cast("long")), data_kind="synthetic")


def test_summaries_keep_arrays_of_values_and_no_copies_of_rows(spark):
    cells = population(spark).drop("cell_id").crossJoin(spark.range(25).selectExpr("id AS k")).withColumn("cell_id", F.monotonically_increasing_id())
    cells = cells.withColumn("corrected_mean_green", F.col("corrected_mean_green") + F.col("k") * 7 % 5).withColumn("ratio_red_green", F.col("corrected_mean_red") / F.col("corrected_mean_green"))
    before, after, comparison, _ = summary.review_summaries(cells, cells.where("k < 3").select(*summary.IDENTITY, F.lit("debris").alias("review_reason")), data_kind="synthetic")
    # Distinct counts of settings copied every cell a dozen times, and percentile maps each value to its count.
    plan = comparison._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "percentile(" not in plan
    for t, kept in ((before, "qc_pass"), (after, "qc_pass and k >= 3")):
        r, want = t.first(), cells.where(kept).agg(*(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for c in ("ratio_red_green", "corrected_mean_green"))).first()
        assert [r.ratio_red_green_q25, r.ratio_red_green_median, r.ratio_red_green_q75] == want[0] and r.corrected_green_median == want[1][1] and r.n_images == 1
    mixed = lambda x: cells.withColumn("objective", F.when(F.col("k") == 1, F.lit(x)).otherwise(F.col("objective")))
    for x in (None, "20X"):
        with pytest.raises(ValueError, match="inconsistent objective"):
            summary.summarize_cells(mixed(x), data_kind="synthetic")
    assert summary.summarize_cells(cells.withColumn("objective", F.lit(None).cast("string")), data_kind="synthetic").first().n_cells_total == 100


def test_cell_csv(spark, tmp_path):
    p = tmp_path / "cells.csv"
    p.write_text("session_id,cell_id,qc_pass,ratio_red_green,sample_id\n001,7,True,nan,05\n002,8,0,1.5,06\n")
    rows = tables.read_cells(spark, str(p)).orderBy("session_id").collect()
    assert [(r.session_id, r.cell_id, r.qc_pass, r.ratio_red_green, r.sample_id, r.mask_source) for r in rows] == [("001", 7, True, None, "05", "unknown"), ("002", 8, False, 1.5, "06", "unknown")]
    out = str(tmp_path / "out")
    tables.write_new(spark.range(3), out)
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_new(spark.range(3), out)


def test_images(spark):
    lab = np.zeros((6, 6))
    lab[0:2, 0:2], lab[3:5, 3:5] = 1, 2
    green, red = lab * 10.0, lab * 5.0
    df = spark.createDataFrame([("i", 6, 6, green.tobytes(), red.tobytes(), lab.tobytes())], "image_id string, height int, width int, green binary, red binary, labels binary")
    out = {r.cell_id: r for r in images.cell_rows(df).collect()}
    assert out[1].edge_flag and not out[2].edge_flag and out[2].raw_mean_green == 20.0 and out[2].ratio_red_green == 0.5
    assert images.shift_labels(lab, 1, -1)[4:6, 2:4].tolist() == [[2, 2], [2, 2]] and images.shift_labels(lab, 9, 0).sum() == 0
    a = np.random.default_rng(0).random((32, 32))
    assert images.phase_shift(a, np.roll(a, (-3, 5), (0, 1))) == (3, -5)
    px = images.pixels(df.select("image_id", "height", "width", F.col("green").alias("pixels")))
    assert px.count() == 36 and images.flat_field(px.where("v > 0")).count() == 8


def test_segmentation_score(spark):
    marks = spark.createDataFrame([("c", 1.2, 1.1), ("c", 5.5, 5.5), ("c", 5.9, 5.1), ("c", 9.0, 9.0)], "crop string, x double, y double")
    px = spark.createDataFrame([("c", 1, 1, 1), ("c", 5, 5, 2), ("c", 7, 7, 3)], "crop string, r long, c long, label int")
    r = images.segmentation_score(marks, px, px).first()
    assert (r.n_points, r.detected, r.separated, r.merged, r.false_objects) == (4, 3, 1, 1, 1) and (r.recall, r.precision) == pytest.approx((1 / 4, 1 / 3))


def test_streams(spark, tmp_path):
    rows = [(datetime.datetime(2026, 1, 1, h, m), "k", 1.0) for h in range(4) for m in (0, 10, 50)]
    spark.createDataFrame(rows, "ts timestamp, k string, v double").repartition(3).write.parquet(str(tmp_path / "in"))
    s = windows.stream_parts(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    for name, df in (("win", windows.event_windows(s, "ts", ["k"], "v")), ("ses", windows.sessions(s, "ts", ["k"]))):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).start() if name == "win" else df.writeStream.outputMode("append").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.n for r in spark.table("win").collect()) == [3, 3, 3, 3]
    for _ in range(2):  # a second run from the checkpoint adds nothing
        windows.append_new(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def exchanges(df):
    """Shuffles of an adaptive plan, before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(obs_id")


def test_observations_are_dealt_once_and_never_with_their_grid(spark):
    g = grids.prior_masses(long(spark, range(4), (0.5, 1), np.linspace(0.2, 0.9, 8).reshape(4, 2), np.full((4, 2), 0.4).tolist()), "uniform_grid")
    prepared = spark.range(20).selectExpr("id AS obs_id", "'m' AS artifact_id", "0.3D + id % 3 * 0.1D AS ratio_obs", "0.4D AS green_obs", "0D AS model_low", "1D AS model_high", "id = 7 AS low")
    p = grids.posteriors(g, prepared, (0.04, 0.01, 0.09))
    assert exchanges(p) == 0 and p.count() == 19
    o = observed(spark, [((0.5, 0.2), (1, 0.3))] * 3, 0.01)
    assert exchanges(grids.decode_dose(g, o)) == 1
    offsets = spark.createDataFrame([("m", 0.5)], "artifact_id string, elapsed_h double")
    assert exchanges(grids.decode_joint(g, o.selectExpr("obs_id", "artifact_id", "time_h - 0.5 AS relative_h", "ratio", "tolerance"), offsets)) == 1


def test_doses_of_an_uneven_grid(spark):
    g = spark.createDataFrame([("m", 0.0, 0.5, 0.1), ("m", 25.0, 0.5, 0.4), ("m", 25.0, 1.0, 0.5), ("m", 75.0, 1.0, 0.5)], "artifact_id string, dose_uM double, time_h double, ratio double")
    o = observed(spark, [((0.5, 0.4), (1, 0.5)), ((1, 0.5),), ((9, 0.4),)], 0.01)
    out = {r.obs_id: (r.status, r.candidate_doses_uM) for r in grids.decode_dose(g, o).collect()}
    # A dose that the grid lacks at a time is not tested there; an observation of other times alone has no row.
    assert out == {0: ("ambiguous", [25.0, 75.0]), 1: ("ambiguous", [25.0, 75.0])}
