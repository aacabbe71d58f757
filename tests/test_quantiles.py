"""Quantiles from sorted ranges, nearest frames without pairs, and adjusted p-values without gathering, against plain computations."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from cytoframe.operators import images, matching, quantiles, stats


def test_group_quantiles_equal_numpy(spark):
    r = np.random.default_rng(1)
    rows = [("big", float(x), float(x // 3)) for x in r.integers(0, 50, 3000)] + [("one", 4.0, None), ("two", 1.0, 2.0), ("two", 2.0, float("nan")), ("none", None, None), (None, 7.0, 8.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    qs = (0.5, 0.25, 0.9, 0.0, 1.0)
    got = {(x.k, x.column): x for x in quantiles.group_quantiles(df, ["k"], ["a", "b"], qs).collect()}
    for k in ("big", "one", "two", None):
        for i, c in enumerate("ab", 1):
            v = [x[i] for x in rows if x[0] == k and x[i] is not None and x[i] == x[i]]
            if v:
                assert got[k, c].n == len(v) and np.allclose(got[k, c].q, np.quantile(v, qs), atol=1e-12)
            else:
                assert (k, c) not in got
    assert ("none", "a") not in got
    w = {x.k: x for x in quantiles.wide(quantiles.group_quantiles(df, ["k"], ["a", "b"], (0.5,)), ["k"], {"a": ["ma"], "b": ["mb"]}).collect()}
    assert w["two"].ma == 1.5 and w["two"].mb == 2.0 and w["one"].mb is None
    assert quantiles.group_quantiles(df.limit(0), ["k"], ["a"], (0.5,)).collect() == []


def test_nearest_frames_equal_all_pairs(spark):
    r = np.random.default_rng(2)
    day = dt.datetime(2026, 1, 1)
    at = lambda m: day + dt.timedelta(minutes=int(m))
    targets = [(k, i, at(m)) for i, (k, m) in enumerate(zip(r.choice(["a", "b", "c"], 200).tolist(), r.integers(0, 900, 200)))] + [("a", 900, None), (None, 901, at(3)), ("z", 902, at(3))]
    frames = [(k, f"p{i:03d}", at(m)) for i, (k, m) in enumerate(zip(r.choice(["a", "b"], 60).tolist(), r.integers(0, 900, 60)))] + [("a", "q", None), (None, "r", at(3)), ("a", "p000x", frames_time := at(100)), ("a", "p000w", frames_time)]
    t = spark.createDataFrame(targets, "k string, target_id long, target_time timestamp_ntz")
    f = spark.createDataFrame(frames, "k string, path string, frame_time timestamp_ntz")
    for tolerance in (3.0, 45.0):
        got = {x.target_id: (x.path, x.distance_min) for x in matching.nearest_frames(t, f, ["k"], tolerance).collect()}
        assert len(got) == len(targets)
        for k, i, when in targets:
            near = sorted((abs((w - when).total_seconds()) / 60, p) for kk, p, w in frames if k is not None and kk == k and w is not None and when is not None)
            want = (near[0][1], near[0][0]) if near and near[0][0] <= tolerance else (None, None)
            assert got[i] == want, (i, got[i], want)


def test_adjusted_p_values(spark):
    r = np.random.default_rng(3)
    p = [float(x) for x in r.choice(np.linspace(0.001, 1, 40), 500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(1000, None)], "i long, p double")
    order = np.argsort(p, kind="stable")
    raw = np.minimum(1, np.array(p)[order] * len(p) / (np.arange(len(p)) + 1))
    want = np.empty(len(p))
    want[order] = np.minimum.accumulate(raw[::-1])[::-1]
    got = {x.i: x.q_bh for x in stats.benjamini_hochberg(df, "p").collect()}
    assert got.pop(1000) is None and all(abs(got[i] - want[i]) < 1e-12 for i in range(len(p)))
    keyed = {x.i: x.q_bh for x in stats.benjamini_hochberg(df.withColumn("k", F.lit(1)), "p", ["k"]).collect()}
    assert all(abs(keyed[i] - want[i]) < 1e-12 for i in range(len(p)))
    assert stats.benjamini_hochberg(df.limit(0), "p").collect() == []


def test_crosstalk_by_session(spark):
    r = np.random.default_rng(4)
    rows = [(s, float(g), float(slope * g + 5 + e)) for s, slope in (("a", 0.2), ("b", 0.05), ("down", -0.3)) for g, e in zip(r.integers(0, 200, 2000).astype(float), r.random(2000))]
    rows += [("few", 1.0, 1.0), ("flat", None, 1.0)]
    px = spark.createDataFrame(rows, "session_id string, green double, red double")
    coefficients, missing = images.session_crosstalk(px, spark.createDataFrame([(s,) for s in ("a", "b", "down", "few", "flat", "gone")], "session_id string"))
    got = {x.session_id: x.bleed for x in coefficients.collect()}
    assert abs(got["a"] - 0.2) < 0.01 and abs(got["b"] - 0.05) < 0.01 and got["down"] == 0
    one = images.crosstalk_coefficient(px.where("session_id = 'a'").select("green", "red")).first().slope
    assert abs(one - got["a"]) < 1e-12
    assert {x.session_id for x in missing.collect()} == {"few", "flat", "gone"}
