"""Backgrounds, flat fields and alignment on pixel tables against arrays and planted displacements."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoframe.operators import alignment as A
from cytoframe.operators import illumination as L
from cytoframe.operators import segment as S


def tables(spark, images):
    px = [(i, r, c, float(v)) for i, a in images.items() for r, row in enumerate(a) for c, v in enumerate(row)]
    return spark.createDataFrame(px, "image_id string, r long, c long, v double"), spark.createDataFrame([(i, *a.shape) for i, a in images.items()], "image_id string, height long, width long")


def arrays(df, column="v"):
    out = {}
    for r in df.orderBy("image_id", "r", "c").collect():
        out.setdefault(r.image_id, []).append(r[column])
    return out


def test_levels_against_arrays(spark):
    r = np.random.default_rng(1)
    dark = r.normal(20, 3, (30, 40)).round(2)
    dark[5:9, 5:9] = 200
    full = np.where(r.random((30, 40)) < 0.9, r.normal(150, 2, (30, 40)), 10).round(2)
    images = {"dark": dark, "full": full, "flat": np.full((3, 3), 7.0)}
    px, _ = tables(spark, images)
    odd = spark.createDataFrame([("dark", 99, 0, None), ("dark", 99, 1, float("nan")), ("none", 0, 0, None)], "image_id string, r long, c long, v double")
    got = {x.image_id: x for x in L.background_levels(px.union(odd)).collect()}
    assert set(got) == set(images)
    w = np.array(L.whole_taps(2.0))
    for name in ("dark", "full"):
        a = images[name]
        n, edges = np.histogram(a, 256)
        i = int(np.argmax(np.convolve(np.pad(n, 8, mode="symmetric"), w, "valid")))
        assert got[name].mode == pytest.approx((edges[i] + edges[i + 1]) / 2) and got[name].low == pytest.approx(np.percentile(a, 5))
    # Cells that fill the frame are no background.
    assert got["full"].method == "percentile" and got["full"].level == got["full"].low
    assert got["flat"].level == 7.0
    level = L.background_levels(px).where("image_id = 'dark'")
    rest = arrays(L.without_level(px, level))
    assert list(rest) == ["dark"] and rest["dark"] == pytest.approx(np.maximum(dark - got["dark"].level, 0).ravel())


def test_rolling_ball(spark):
    r = np.random.default_rng(2)
    a = r.integers(0, 50, (12, 17)).astype(float)
    slope = np.add.outer(np.zeros(30), np.arange(40.0))
    cell = slope.copy()
    cell[14:17, 18:21] += 80
    for radius in (3, 4.5, 40):
        b = L.ball_background(a, radius)
        for y, x in itertools.product(range(12), range(17)):
            least = min(a[p, q] + radius - np.sqrt(radius**2 - (p - y) ** 2 - (q - x) ** 2) for p in range(12) for q in range(17) if (p - y) ** 2 + (q - x) ** 2 <= radius**2)
            assert b[y, x] == pytest.approx(least)
    px, shapes = tables(spark, {"cell": cell, "a": a})
    broken = shapes.union(spark.createDataFrame([("lacking", 2, 2), ("a2", 1, 1)], shapes.schema))
    rows = L.frame_rows(px.union(spark.createDataFrame([("lacking", 0, 0, 1.0), ("a2", 0, 0, 1.0), ("a2", 0, 0, 1.0)], px.schema)), broken)
    assert {x.image_id for x in rows.where("values is null").collect()} == {"lacking", "a2"}
    out = L.rolling_ball(rows, 10)
    got = arrays(out)
    assert set(got) == {"cell", "a"}
    above = np.array(got["cell"]).reshape(cell.shape)
    assert above[15, 19] > 60 and np.median(above) < 5
    assert arrays(out, "background")["a"] == pytest.approx(L.ball_background(a, 10).ravel())


def test_flat_fields(spark):
    r = np.random.default_rng(3)
    y, x = np.indices((20, 30))
    light = 1 + 0.5 * np.cos((x - 15) / 20) * np.cos((y - 10) / 15)
    images = {}
    for k in range(7):
        a = np.full((20, 30), 100.0)
        a[r.integers(0, 17) :, r.integers(0, 27) :][:3, :3] += 300
        images[f"s{k}"] = a * light
    images |= {"alone": light, "b1": light, "b2": light[:5]}
    px, shapes = tables(spark, images)
    session = F.when(F.col("image_id").startswith("s"), "s").when(F.col("image_id") == "alone", "one").otherwise("b")
    listed = shapes.withColumn("session_id", session)
    gains, refused = L.flat_fields(px, listed, 1.0)
    assert sorted(tuple(x) for x in refused.collect()) == [("b", 2, "images differ in shape"), ("one", 1, "fewer than two images")]
    got = np.array([x.gain for x in gains.orderBy("r", "c").collect()]).reshape(20, 30)
    want = L.smoothed(np.median([images[f"s{k}"] for k in range(7)], axis=0), 1.0)
    assert got == pytest.approx(want / want.mean()) and np.abs(got / (light / light.mean()) - 1).max() < 0.05
    flat = arrays(L.flattened(px, listed, gains))
    assert np.ptp(np.sort(flat["s0"])[:500]) < 0.1 * np.median(flat["s0"]) and set(flat["alone"]) == {None}


def field(r, shape=(48, 64), n=14):
    a = np.zeros(shape, bool)
    for _ in range(n):
        y, x = r.integers(2, shape[0] - 6), r.integers(2, shape[1] - 6)
        a[y : y + r.integers(3, 6), x : x + r.integers(3, 6)] = True
    return a


def brute_scores(mask, image, reach):
    out = np.full((2 * reach + 1, 2 * reach + 1), np.nan)
    for dy, dx in itertools.product(range(-reach, reach + 1), repeat=2):
        at = A.shift_labels(mask, dy, dx)
        if 2 * at.sum() > mask.sum():
            out[dy + reach, dx + reach] = image[at].sum() / at.sum()
    return out


def test_displacement_scores_by_brute_force():
    r = np.random.default_rng(4)
    for shape in ((24, 32), (15, 21)):
        mask, image = field(r, shape, 5), r.integers(0, 99, shape).astype(float)
        got, top, left = A.displacement_scores(mask, image, 5)
        assert (top, left) == (-5, -5) and got == pytest.approx(brute_scores(mask, image, 5), nan_ok=True)
    placed = A.place_mask(np.zeros((9, 9), bool), np.ones((9, 9)))
    assert placed == {"dy": None, "dx": None, "z": None, "contrast": None, "mask_fraction": 0.0}
    assert A.place_mask(np.eye(9, dtype=bool), np.ones((9, 9)), reach=2, guard=0, sigma=None)["z"] is None


def test_planted_displacements(spark):
    r = np.random.default_rng(5)
    truth = {f"f{k}": (int(r.integers(-6, 7)), int(r.integers(-6, 7))) for k in range(6)}
    images, runs, fields, frames = {}, [], [], []
    light = 30 + np.add.outer(np.linspace(0, 40, 48), np.zeros(64))
    for k, (name, (dy, dx)) in enumerate(truth.items()):
        mask = field(r)
        glow = A.shift_labels(mask, dy, dx) & (r.random(mask.shape) < 0.6)
        images[name] = light + 60.0 * glow + r.normal(0, 4, mask.shape)
        runs += [(f"b{k}", int(y), int(x), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)]
        fields.append(("s", name, 10.0 * k))
        frames.append(("s", f"b{k}", 10.0 * k + 4))
    runs += [("b9", *x[1:]) for x in runs if x[0] == "b0"]
    # A field whose candidates are others' frames, one alone in its session with a frame of its own and a stray one, and one without id and time.
    runs += [("stray", int(y), int(x), int(x)) for y, x in zip(*np.nonzero(field(r)), strict=True)]
    images |= {"lost": light + r.normal(0, 4, light.shape), "alone": images["f0"]}
    fields += [("s", "lost", 50.0), ("t", "alone", 0.0), ("s", None, None)]
    frames += [("t", "stray", 11.0), ("t", "b9", 1.0)]
    px, shapes = tables(spark, images)
    pairs = A.pairs_in_time(spark.createDataFrame(fields, "session string, field_id string, t double"), spark.createDataFrame(frames, "session string, frame_id string, t double"), ["session"], 12.0)
    near = {(s, f, b) for s, f, t in fields for z, b, u in frames if s == z and t is not None and abs(t - u) <= 12}
    assert {tuple(x) for x in pairs.collect()} == near
    masks = spark.createDataFrame(runs, "frame_id string, r long, c0 long, c1 long")
    out = {x.field_id: x for x in A.align_frames(pairs, ["session"], masks, px, shapes, reach=10, guard=3, sigma=8.0).collect()}
    assert set(out) == {*truth, "lost", "alone"}
    for k, (name, shift) in enumerate(truth.items()):
        x = out[name]
        assert (x.frame_id, x.dy, x.dx) == (f"b{k}", *shift) and x.matched and x.contrast > 1 and not x.at_search_limit and x.z_best_candidate == x.z_matched
    assert out["lost"].frame_id is None and out["lost"].note and out["lost"].n_candidates == 2 and not out["lost"].matched
    assert out["alone"].frame_id == "b9" and out["alone"].z_runner_up < out["alone"].z_matched and not out["alone"].matched and out["alone"].cut is None
    nulls = sorted(x.z_unrelated for x in out.values() if x.z_unrelated is not None)
    assert out["f0"].cut == pytest.approx(np.percentile(nulls, 95)) and len(nulls) >= 6


def test_assignment_by_components(spark):
    r = np.random.default_rng(6)
    scored = [(f"g{g}f{i}", f"g{g}b{j}", None if r.random() < 0.1 else float(r.integers(0, 90))) for g in range(4) for i in range(4) for j in range(3) if r.random() < 0.8]
    got = A.assign_frames(spark.createDataFrame(scored, "field_id string, frame_id string, z double")).collect()
    gain = {(f, b): -1e3 if z is None else z for f, b, z in scored}
    assert len({x.field_id for x in got}) == len({x.frame_id for x in got}) == len(got)
    best = 0.0
    for g in range(4):
        own = {k: v for k, v in gain.items() if k[0].startswith(f"g{g}")}
        fs, bs = sorted({f for f, _ in own}), sorted({b for _, b in own})
        options = [[(f, b) for f, b in zip(p, bs, strict=False) if (f, b) in own] for p in itertools.permutations([*fs, *([None] * len(bs))], len(bs))]
        most = max(map(len, options))
        best += max(sum(own[k] for k in o) for o in options if len(o) == most)
    assert sum(gain[x.field_id, x.frame_id] for x in got) == best


def test_unrelated_fields_ring(spark):
    given = spark.createDataFrame([("s", f"f{i}", f"b{i}") for i in range(3)] + [("t", "x", "y")] + [("u", f"u{i}", f"v{i}") for i in range(30)], "session string, field_id string, frame_id string")
    got = A.unrelated_pairs(given, ["session"]).collect()
    assert all(x.own_field != x.field_id for x in got) and len(set(got)) == len(got)
    per = {s: [x for x in got if x.session == s] for s in "stu"}
    assert len(per["s"]) == 6 and not per["t"] and len(per["u"]) == 30 and len({x.field_id for x in per["u"]}) == 30
    assert sorted(map(str, got)) == sorted(map(str, A.unrelated_pairs(given.repartition(5), ["session"]).collect()))


def test_masks_and_fields_that_do_not_fit_keep_their_rows(spark):
    px, shapes = tables(spark, {"f": np.arange(80.0).reshape(8, 10)})
    shapes = shapes.union(spark.createDataFrame([("half", 8, 10)], shapes.schema))
    masks = S.runs_of(spark.createDataFrame([("b", 2, 3), ("b", 2, 4), ("out", 9, 1)], "image_id string, r long, c long")).withColumnRenamed("image_id", "frame_id")
    pairs = spark.createDataFrame([("f", "b", 1), ("f", "out", 2), ("f", "empty", 3), ("half", "b", 4), ("unknown", "b", 5)], "field_id string, frame_id string, n long")
    got = {x.n: x for x in A.place_pairs(pairs, masks, px, shapes, reach=2, guard=0, sigma=None).collect()}
    assert len(got) == 5 and (got[1].dy, got[1].dx) == (2, 2) and [got[n].dy for n in (2, 3, 4, 5)] == [None] * 4 and got[3].mask_fraction == 0


def test_registered_alignment_finds_the_known_displacements(spark):
    from cytoframe.plans.illumination import q_frame_alignment

    rows = [(int(x.field_id[1:]), x) for x in q_frame_alignment(spark, "/root/testdata/sf0.001").collect()]
    assert len(rows) == 10
    own = [(n, x) for n, x in rows if x.frame_id == f"b{n}"]
    assert len(own) == len({x.frame_id for _, x in rows}) == 10
    assert all((x.dy, x.dx) == (2 - n % 5, 3 - n % 7) and x.matched for n, x in own)


def test_runs_reach_the_kernel_as_arrays_of_numbers(spark):
    px, shapes = tables(spark, {"f": np.eye(6)})
    masks = spark.createDataFrame([("b", 1, 1, 2)], "frame_id string, r long, c0 long, c1 long")
    placed = A.place_pairs(spark.createDataFrame([("f", "b")], "field_id string, frame_id string"), masks, px, shapes, reach=1, guard=0, sigma=None)
    sent = placed._jdf.queryExecution().analyzed().children().head().schema().simpleString()
    assert "_c0:array<bigint>" in sent and "struct<r" not in sent
