import datetime
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoframe.functions import exprs as E
from cytoframe.operators import classify, interpolation, resampling, signals, stats
from cytoframe.plans import runner

SCHEMA = "session_id string, condition_id string, sample_id string, cell_id long, qc_pass boolean, edge_flag boolean, measurement_time_hours double, corrected_mean_green_per_s double, corrected_mean_red_per_s double"


def cell_rows(slope=2.0, days=3, doses=(0, 100, 1000), times=(1.0, 2.0, 3.0), fields=3, cells=40, offset=(0.0, 0.5, 1.0, 4.0), noise=1.0, seed=0):
    """Days that differ by an offset, a red response per log10 dose, and non-transfected cells at 5."""
    r = np.random.default_rng(seed)
    rows, n = [], 0
    for d in range(days):
        for dose in doses:
            for t in times:
                for f in range(fields):
                    for _ in range(cells):
                        n += 1
                        red = 20 + offset[d] + (slope * math.log10(dose) if dose else 0.0) + r.normal(0, noise)
                        rows.append((f"2026010{d + 1}_h2o2_tr", f"h2o2_{dose}uM_{t:g}h", f"R{f}", n, True, False, t + 0.01 * f, 25 + offset[d] + r.normal(0, noise), red))
        for _ in range(60):
            n += 1
            rows.append((f"2026010{d + 1}_h2o2_nt", "h2o2_0uM_nt", "N1", n, True, False, 1.0, 5 + r.normal(0, 0.5), 5 + r.normal(0, 0.5)))
    rows.append(("20260101_h2o2_tr", "h2o2_0uM_1h", "R0", n + 1, False, False, 1.0, 1e4, 1e4))
    rows.append(("20260101_h2o2_tr", "h2o2_0uM_1h", "R0", n + 2, True, True, 1.0, 1e4, 1e4))
    return rows


def table(spark, **options):
    return spark.createDataFrame(cell_rows(**options), SCHEMA)


@pytest.fixture(scope="module")
def prepared(spark):
    c = signals.annotate(table(spark))
    return signals.subtract_baseline(c, signals.baseline(c)).cache()


def test_annotate_refuses_other_ids(spark):
    df = spark.createDataFrame([("x", "h2o2_5uM", 1)], "session_id string, condition_id string, cell_id long")
    with pytest.raises(ValueError, match=r"session_id .*\['x'\]"):
        signals.annotate(df)
    df = spark.createDataFrame([("20260101_h2o2_tr", "dtt_5uM_a", 1)], df.schema)
    with pytest.raises(ValueError, match="dtt_5uM_a"):
        signals.annotate(df)
    df = spark.createDataFrame([("20260101_none_tr", "medium", 1), ("20260101_dtt_nt", "dtt_2.5uM", 2)], df.schema)
    assert [(r.stressor, r.strain, r.dose_uM) for r in signals.annotate(df).orderBy("cell_id").collect()] == [("none", "tr", None), ("dtt", "nt", 2.5)]


def test_usable_vocabulary(spark):
    df = spark.createDataFrame([("True", "false"), ("1", "0"), ("1.0", "false"), ("true", "TRUE"), (None, None)], "qc_pass string, edge_flag string")
    assert [r[0] for r in df.select(E.usable()).collect()] == [True, True, False, False, False]


def test_labels_are_read_once_for_each_pair_of_ids(spark):
    rows = [(1, "20260101_h2o2_tr", "h2o2_50uM_t1"), (2, "20260101_h2o2_tr", None), (3, None, "h2o2_50uM_t1"), (4, "20260101_none_nt", "h2o2_50uM_t1"), (5, "other", "h2o2_1.5uM"), (6, "20260101_h2o2_tr", "h2o2_50uM_t1")]
    out = signals.with_labels(spark.createDataFrame(rows, "cell_id int, session_id string, condition_id string"))
    got = [(r.cell_id, r.day, r.stressor, r.strain, r.dose_uM) for r in out.orderBy("cell_id").collect()]
    day = "20260101"
    assert got == [(1, day, "h2o2", "tr", 50.0), (2, day, "h2o2", "tr", None), (3, None, None, None, None), (4, day, "none", "nt", None), (5, None, None, None, None), (6, day, "h2o2", "tr", 50.0)]
    # No pattern is matched again where cells are filtered or grouped by a label.
    used = out.where("strain = 'tr'").na.drop(subset=["day", "dose_uM"]).groupBy("stressor", "dose_uM").count()
    assert "rlike" not in used._jdf.queryExecution().optimizedPlan().toString().lower()


def test_per_second(spark):
    schema = "exposure_ms_green double, exposure_ms_red double, corrected_mean_green double, corrected_mean_red double, integrated_green double, integrated_red double"
    out = signals.add_per_second(spark.createDataFrame([(800.0, 800.0, 4.0, 4.0, 8.0, 8.0), (1600.0, 1600.0, 8.0, 8.0, 8.0, 8.0)], schema)).collect()
    assert [r.corrected_mean_green_per_s for r in out] == [5.0, 5.0]
    for bad in ((800.0, 801.0), (None, 800.0), (0.0, 0.0)):
        with pytest.raises(ValueError, match="exposure"):
            signals.add_per_second(spark.createDataFrame([(*bad, 1.0, 1.0, 1.0, 1.0)], schema))


def test_outliers_of_bad_cells_do_not_count(prepared):
    f = signals.field_summaries(prepared)
    assert f.agg(F.max("green_af")).first()[0] < 30
    assert signals.timecourse(f).where("strain = 'tr'").count() == 3 * 9


def test_time_windows(spark):
    values = [0.0, 1.99, 2.0, 7.5, 8.0, 9.0, None, -1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t double")
    assert [r[0] for r in df.orderBy("i").select(E.time_window(F.col("t"), [0.0, 2.0, 4.0, 6.0, 8.0])).collect()] == [0, 0, 1, 3, 3, -1, -1, -1]


def test_interpolation_equals_numpy(spark):
    r = np.random.default_rng(0)
    knots = [(k, float(t), float(r.normal())) for k in "ab" for t in sorted(r.choice(50, 9, replace=False))]
    points = [(k, i, float(t)) for i, (k, t) in enumerate((k, t) for k in "ab" for t in np.linspace(-3, 55, 40))] + [("c", 99, 1.0)]
    points += [(k, 100 + i, t) for i, (k, t, _) in enumerate(knots)]
    kd, pd_ = spark.createDataFrame(knots, "k string, t double, v double"), spark.createDataFrame(points, "k string, i int, t double")
    for flat in (True, False):
        for row in interpolation.interpolate_join(pd_, kd, ["k"], flat=flat).collect():
            t, v = [x[1] for x in knots if x[0] == row.k], [x[2] for x in knots if x[0] == row.k]
            if row.k == "c" or (not flat and not t[0] <= row.t <= t[-1]):
                assert row.interpolated is None
            else:
                assert row.interpolated == pytest.approx(np.interp(row.t, t, v))


def test_paired_reference(spark):
    schema = "session_id string, condition_id string, sample_id string, dose_uM double, time_h double, green double, red double, positive double, green_pos double, red_pos double"
    rows = [("s", "a", "1", 0.0, 1.0, 1.0, 0.0, 0.0, 2.0, None), ("s", "b", "1", 0.0, 3.0, 3.0, 0.0, 0.0, 2.0, None), ("s", "x", "1", 5.0, 2.0, 10.0, 0.0, 0.0, 4.0, 1.0)]
    out = {r.condition_id: r for r in interpolation.add_paired(spark.createDataFrame(rows, schema)).collect()}
    assert out["x"].d_green == 8.0 and out["a"].d_green == -2.0 and out["x"].log_fold_green_pos == pytest.approx(math.log(2)) and out["x"].log_fold_red_pos is None
    timeless = [(*r[:4], None, *r[5:]) for r in rows]
    out = {r.condition_id: r for r in interpolation.add_paired(spark.createDataFrame(timeless, schema)).collect()}
    assert out["x"].d_green == 8.0


def test_peaks(spark):
    for v0 in (2.2, 2.9, 3.4):
        p = stats.peaks(spark.createDataFrame([("a", float(t), 10 - (t - v0) ** 2) for t in range(1, 6)], "k string, t double, v double"), ["k"], "t", "v").first()
        assert p.t_peak == pytest.approx(v0) and p.bracketed
    ends = spark.createDataFrame([("up", t, float(t)) for t in (1.0, 2.0, 3.0)] + [("down", t, -t) for t in (1.0, 2.0, 3.0)] + [("one", 1.0, 1.0)], "k string, t double, v double")
    assert {r.k: r.position for r in stats.peaks(ends, ["k"], "t", "v").collect()} == {"up": "last_sample", "down": "first_sample", "one": "too_few_points"}


def test_false_discovery_rate(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.20, None))], "i int, p double")
    q = [r.q_bh for r in stats.benjamini_hochberg(df, "p").orderBy("i").collect()]
    assert q[:4] == pytest.approx([0.04, 0.0533333, 0.0533333, 0.2], rel=1e-5) and q[4] is None


def test_credible_sets(spark):
    for p, want in (((0.1, 0.6, 0.3), {1, 2}), ((0.05, 0.9, 0.05), {1})):
        df = spark.createDataFrame([("k", i, x) for i, x in enumerate(p)], "k string, i int, p double")
        assert {r.i for r in stats.credible_set(df, ["k"], "i", "p").collect()} == want
    tied = spark.createDataFrame([("k", i, x) for i, x in enumerate((0.4, 0.3, 0.3))], "k string, i int, p double")
    assert stats.highest_mass_region(tied, ["k"], "p", 0.6).count() == 3


def test_lines(spark):
    df = spark.createDataFrame([("a", x, 10 + 20 * x) for x in (1.0, 2.0, 3.0)] + [("b", 1.0, 21.0)], "g string, x double, y double")
    out = {r.g: r for r in stats.line_fits(df, "g", "x", "y").collect()}
    assert (out["a"].offset, out["a"].rate, out["a"].r2) == pytest.approx((10, 20, 1)) and out["b"].fit == "single_exposure" and out["b"].mean == 21.0 and out["all"].n_fields == 4


def test_planted_induction_is_found(prepared):
    effects, trend = resampling.induction_table(prepared, n_boot=100)
    e = {(r.dose_uM, r.readout): r for r in effects.where("day = '20260102'").collect()}
    assert e[1000.0, "red"].effect == pytest.approx(6.0, abs=0.5) and e[1000.0, "red"].detected_bh and e[1000.0, "red"].ci_low < 6.0 < e[1000.0, "red"].ci_high + 0.6
    assert abs(e[1000.0, "green"].effect) < 0.6 and not e[1000.0, "green"].detected_bh
    assert e[1000.0, "red"].mde == pytest.approx(2.8 * e[1000.0, "red"].se)
    assert trend.count() == 0  # two doses above zero are too few
    again, _ = resampling.induction_table(prepared.repartition(3), n_boot=100)
    a, b = (sorted(map(tuple, x.select("day", "dose_uM", "readout", "se").collect())) for x in (effects, again))
    assert [x[:3] for x in a] == [x[:3] for x in b] and [x[3] for x in a] == pytest.approx([x[3] for x in b])


def test_trend_and_flat_days(spark):
    c = signals.annotate(table(spark, doses=(0, 10, 100, 1000), slope=2.0, fields=2, cells=30))
    _, t = resampling.induction_table(signals.subtract_baseline(c, signals.baseline(c)), n_boot=60)
    r = {x.readout: x for x in t.where("day = '20260101'").collect()}
    assert r["red"].slope_per_log10_dose == pytest.approx(2.0, abs=0.3) and r["red"].q_bh < 0.05 and abs(r["green"].slope_per_log10_dose) < 0.3


def test_held_out_days(spark):
    c = signals.annotate(table(spark, slope=3.0, noise=2.0))
    fields = interpolation.add_paired(signals.field_features(signals.subtract_baseline(c, signals.baseline(c))))
    p, folds = classify.leave_one_day_out(fields, "paired")
    s = classify.score(p).where("held_out = 'mean over days' and unit = 'field'").first()
    assert s.accuracy > 0.9 and s.info_gain_bits > 1 and folds.count() == 3 and folds.where("skipped <> ''").count() == 0
    rows = p.collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in rows) and {r.unit for r in rows} == {"field", "sample"}
    assert "p_100uM" in classify.wide_posterior(p, [0.0, 100.0, 1000.0]).columns
    one_day = fields.where("session_id like '20260101%'")
    assert classify.leave_one_day_out(one_day, "paired")[0].count() == 0
    lacking = fields.where("not (dose_uM = 1000 and session_id not like '20260101%')")
    skipped = {r.held_out: r.skipped for r in classify.leave_one_day_out(lacking, "paired")[1].collect()}
    assert "1000" in skipped["20260101_h2o2_tr"] and skipped["20260102_h2o2_tr"] == ""


def numpy_posterior(train, x, n_fields, features):
    """The same fit written with plain loops."""
    doses = sorted({r["dose_uM"] for r in train})
    days = {}
    for r in train:
        days.setdefault((r["session_id"], r["dose_uM"]), []).append([r[f] for f in features])
    dm = {k: np.mean(v, axis=0) for k, v in days.items()}
    means = np.array([np.mean([m for k, m in dm.items() if k[1] == d], axis=0) for d in doses])
    within = sum((np.array(v) - dm[k]).T @ (np.array(v) - dm[k]) for k, v in days.items()) / (len(train) - len(dm))
    b = np.array([m - means[doses.index(k[1])] for k, m in dm.items()])
    cov = b.T @ b / (len(dm) - len(doses)) + within / n_fields
    cov = cov + 1e-9 * max(1.0, np.trace(cov)) * np.eye(len(features))
    d2 = np.array([(x - m) @ np.linalg.solve(cov, x - m) for m in means])
    e = np.exp(-0.5 * (d2 - d2.min()))
    return e / e.sum(), d2.min()


def test_posteriors_equal_plain_linear_algebra(spark):
    c = signals.annotate(table(spark, slope=1.0, noise=3.0, seed=5))
    fields = interpolation.add_paired(signals.field_features(signals.subtract_baseline(c, signals.baseline(c))))
    rows = [r.asDict() for r in fields.collect()]
    p, _ = classify.leave_one_day_out(fields, "absolute")
    for r in p.where("unit = 'field'").limit(20).collect():
        x = next(f for f in rows if (f["session_id"], f["condition_id"], f["sample_id"]) == (r.held_out, r.condition_id, r.sample_id))
        f = classify.FEATURES["absolute"]
        want, d2 = numpy_posterior([t for t in rows if t["session_id"] != r.held_out], np.array([x[k] for k in f]), 1, f)
        assert r.p == pytest.approx(want.tolist(), rel=1e-6, abs=1e-9) and r.min_mahalanobis2 == pytest.approx(d2, rel=1e-6)


def test_decode_culture_verdicts(spark):
    reference = table(spark, slope=4.0, cells=30)
    trained = classify.train(reference, "h2o2")
    assert trained.gain_bits > 0 and trained.doses == [0.0, 100.0, 1000.0]
    r = np.random.default_rng(7)

    def culture(condition, sample, red, n=40):
        return [("new", condition, sample, i, True, False, 2.0, 25 + r.normal(), red + r.normal()) for i in range(n)]

    cells = culture("h2o2_0uM_ctrl", "C", 20) + culture("mystery", "A", 32) + culture("mystery", "B", 32) + culture("odd", "O", 90) + culture("few", "F", 32, 5)
    out = {(x.condition_id, x.sample_id): x for x in classify.decode(spark.createDataFrame(cells, SCHEMA), trained).collect()}
    assert out["mystery", "A"].map_dose_uM == 1000.0 and out["mystery", "A"].verdict == "dose estimate" and out["mystery", "A,B"].n_fields == 2
    assert out["odd", "O"].verdict == "unlike reference" and out["few", "F"].verdict == "too few cells" and out["h2o2_0uM_ctrl", "C"].time_verdict == "unstressed control"
    alone = classify.decode(spark.createDataFrame(culture("mystery", "A", 32), SCHEMA), trained).first()
    assert alone.verdict == "needs a 0 µM image"


def test_runner_writes_all_tables_and_refuses_old_paths(spark, tmp_path):
    out = str(tmp_path / "run")
    took = runner.run_analysis(spark, {"cells": table(spark, cells=25, fields=2), "out": out, "n_boot": 20, "steps": ["timecourse", "induction", "decoder"]})
    assert list(took) == ["timecourse", "induction", "decoder"] and spark.read.parquet(f"{out}/effects").count() == 18
    with pytest.raises(Exception, match="(?i)exist"):
        runner.run_analysis(spark, {"cells": table(spark, cells=25, fields=2), "out": out, "steps": ["timecourse"], "n_boot": 5})
    with pytest.raises(ValueError, match="unknown keys"):
        runner.run_analysis(spark, {"sells": 1})


def test_clock(spark):
    df = spark.createDataFrame([("13:41", "14:32"), ("23:50", "00:10"), ("", "1:00")], "a string, b string")
    assert [r[0] for r in df.select(E.clock_hours(F.col("a"), F.col("b"))).collect()] == [0.85, -23.667, None]
    t = spark.createDataFrame([("2026:01:02 03:04:05",), ("2026-01-02 03:04:05",), ("x",)], "s string")
    assert [r[0] for r in t.select(E.tiff_time(F.col("s"))).collect()] == [datetime.datetime(2026, 1, 2, 3, 4, 5)] * 2 + [None]


def test_redrawn_fields_have_the_distribution_of_redrawn_cells():
    import itertools
    from collections import Counter

    rng, count = np.random.default_rng(1), 100_000
    for values, missing in (([1.0], 0), ([1.0, 5.0], 0), ([1.0, 2.0, 2.0], 0), ([1.0, 2.0, 4.0, 9.0], 0), ([1.0, 2.0, 4.0, 9.0, 11.0], 0), ([1.0, 3.0, 4.0], 1)):
        n = len(values) + missing
        draws = np.array(list(itertools.product([*values, *[np.nan] * missing], repeat=n)))
        want = Counter(np.nan_to_num(np.median(draws, axis=1), nan=-1).tolist())
        got = Counter(np.nan_to_num(resampling.redrawn_medians(np.array(values), n, count, rng), nan=-1).tolist())
        assert set(got) <= set(want) and all(abs(got[v] / count - k / len(draws)) < 0.01 for v, k in want.items())
    assert np.isnan(resampling.redrawn_medians(np.array([]), 3, 4, rng)).all()
    # A field's draws cost the same however many cells it has; redrawing these 20 million cells one by one took 10^10 draws.
    field = {"green": np.arange(20_000_000.0), "red": np.arange(20_000_000.0), "positive": 5_000_000, "n": 20_000_000}
    began = time.process_time()
    v = resampling.redraw([field, field], ("green", "red", "positive"), 500, rng)
    assert time.process_time() - began < 5 and v.shape == (500, 2, 3)
    assert v.mean((0, 1)) == pytest.approx([1e7, 1e7, 0.25], rel=1e-3) and 500 < v[:, :, 0].std() < 5000
