import pytest
from pyspark.sql import functions as F

from cytoframe.operators import artifacts, grids
from cytoframe.plans import queries, robustness


def test_session_calibration():
    c = artifacts.session_calibration("s", "r", [0.3, 0.6, 0.9], [0.2, 0.4, 0.6], "synthetic", "here")
    assert c["c_session"] == pytest.approx(1.5) and c["rmse"] == pytest.approx(0, abs=1e-12) and artifacts.open_session_calibration(c) == c
    with pytest.raises(ValueError, match="modified"):
        artifacts.open_session_calibration({**c, "c_session": 2.0})
    with pytest.raises(ValueError, match="follow"):
        artifacts.open_session_calibration(artifacts.seal({**c, "c_session": 2.0}))
    for bad in ([0.3, 0.6], [0.3, 0.6, True], [0.3, 0.6, float("nan")], [0.3, 0.6, 0.0]):
        with pytest.raises(ValueError):
            artifacts.session_calibration("s", "r", bad, [0.2, 0.4, 0.6], "synthetic", "here")


def test_digest_does_not_depend_on_order():
    assert artifacts.digest({"a": 1, "b": [1.5, "é"]}) == artifacts.digest({"b": [1.5, "é"], "a": 1, "artifact_id": "x"})
    with pytest.raises(ValueError):
        artifacts.digest({"a": float("nan")})


def test_snapshot_calibrations(spark):
    grid = queries.grid(spark)
    row = ("s", "m", 1.2, 0.0, 0.5, 10.0, 200.0, 3.0, 90.0)
    schema = "session_id string, artifact_id string, c_session double, low_dose double, low_time double, image_low double, high_dose double, high_time double, image_high double"
    r = artifacts.snapshot_calibrations(spark.createDataFrame([row], schema), grid).first()
    assert (r.model_low, r.model_high) == pytest.approx((0.3, 1.54))
    obs = spark.createDataFrame([(1, "s", 1.2 * 0.25, 10.0), (2, "s", 1.0, 120.0)], "obs_id int, session_id string, image_ratio double, image_green double")
    n = {x.obs_id: x for x in grids.normalise_snapshot(obs, artifacts.snapshot_calibrations(spark.createDataFrame([row], schema), grid), 5.0).collect()}
    assert n[1].green_obs == 0.0 and n[1].ratio_obs == pytest.approx(0.25) and n[2].green_obs > 1 and n[2].green_outside_reference
    for i, v in ((4, 0.6), (8, 5.0)):
        with pytest.raises(ValueError, match="anchor"):
            artifacts.snapshot_calibrations(spark.createDataFrame([row[:i] + (v,) + row[i + 1 :]], schema), grid)


def test_replicate_noise(spark):
    import numpy as np

    r = np.random.default_rng(0)
    rows = [(c, f"{c}{i}", f"s{c}{i}", float(r.normal()), float(r.normal())) for c in "ab" for i in range(6)]
    df = spark.createDataFrame(rows, "condition_id string, biological_replicate_id string, specimen_id string, log_ratio double, green_norm double")
    want = sum(np.cov(np.array([x[3:] for x in rows if x[0] == c]).T, ddof=1) for c in "ab") / 2
    assert artifacts.replicate_noise(df) == pytest.approx((want[0, 0], want[0, 1], want[1, 1]))
    for bad, match in ((df.where("condition_id = 'a'").limit(2), "three"), (df.union(df.limit(1)), "twice"), (df.withColumn("green_norm", F.col("log_ratio")), "definite")):
        with pytest.raises(ValueError, match=match):
            artifacts.replicate_noise(bad)


def test_robustness(spark):
    out = {r.scenario: r for r in queries.q_model_robustness(spark, "").collect()}
    assert len(out) == len(robustness.SCENARIOS) and out["matched"].inclusion > 0.85 and out["matched"].dose_error <= min(r.dose_error for r in out.values()) + 5


def test_inputs_must_stay_as_they_were(tmp_path):
    p = tmp_path / "a"
    p.write_text("x")
    before = artifacts.fingerprints([str(p)])
    artifacts.unchanged(before)
    p.write_text("y")
    with pytest.raises(ValueError, match="changed"):
        artifacts.unchanged(before)
    with pytest.raises(ValueError, match="differ in"):
        artifacts.check_compatible({"variant": "ox"}, {"variant": "er"})
