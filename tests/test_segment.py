"""Segmentation and extraction on pixel tables against flood fill and arrays."""

import numpy as np
import pytest

from cytoframe.operators import segment as S
from cytoframe.operators.components import connected


def frames(seed, shape, n, density=0.45):
    r = np.random.default_rng(seed)
    return {f"i{k}": np.where(r.random(shape) < density, r.integers(100, 200, shape), r.integers(0, 40, shape)).astype(float) for k in range(n)}


def tables(spark, images):
    px = [(i, r, c, float(v)) for i, a in images.items() for r, row in enumerate(a) for c, v in enumerate(row)]
    return spark.createDataFrame(px, "image_id string, r long, c long, v double"), spark.createDataFrame([(i, *a.shape) for i, a in images.items()], "image_id string, height long, width long")


def flood(mask):
    """Components by flood fill: label of each pixel, the smallest pixel number of its component."""
    h, w = mask.shape
    out = np.full(mask.shape, -1)
    for start in range(h * w):
        if mask.flat[start] and out.flat[start] < 0:
            todo = [divmod(start, w)]
            out.flat[start] = start
            while todo:
                r, c = todo.pop()
                for a, b in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                    if 0 <= a < h and 0 <= b < w and mask[a, b] and out[a, b] < 0:
                        out[a, b] = start
                        todo.append((a, b))
    return out


def filled(mask):
    back = flood(~mask)
    edge = set(np.concatenate([back[0], back[-1], back[:, 0], back[:, -1]]).tolist())
    return mask | ((back >= 0) & ~np.isin(back, list(edge)))


def otsu(a, bins=256):
    n, edges = np.histogram(a, bins)
    i = np.arange(bins)
    below, s = np.cumsum(n), np.cumsum(n * i)
    with np.errstate(all="ignore"):
        between = np.where((below > 0) & (below < a.size), (a.size * s - below * s[-1]) ** 2.0 / (below * (a.size - below)), 0)
    k = int(np.argmax(between))
    return a.min() + (k + 0.5) * np.ptp(a) / bins


def as_array(rows, images):
    out = {i: np.full(a.shape, -1) for i, a in images.items()}
    for x in rows:
        assert (out[x.image_id][x.r, x.c0 : x.c1 + 1] == -1).all()
        out[x.image_id][x.r, x.c0 : x.c1 + 1] = x.label
    return out


@pytest.mark.parametrize("fill, least", [(False, 1), (True, 4)])
def test_segment_equals_flood_fill(spark, fill, least):
    images = frames(1, (23, 600), 2, 0.55) | frames(2, (17, 9), 1) | {"flat": np.full((5, 5), 7.0), "ring": np.pad(np.pad(np.zeros((3, 3)), 1, constant_values=150.0), 2)}
    px, shapes = tables(spark, images)
    got = as_array(S.segment(px, shapes, S.otsu_cuts(px), min_size=least, fill=fill).collect(), images)
    for i, a in images.items():
        mask = a > otsu(a) if np.ptp(a) else np.zeros(a.shape, bool)
        want = flood(filled(mask) if fill else mask)
        small = [k for k, n in zip(*np.unique(want, return_counts=True)) if n < least]
        want[np.isin(want, small)] = -1
        assert (got[i] == want).all()
    assert not fill or (got["ring"] >= 0).sum() == 25


def test_sizes_borders_and_fractions(spark):
    images = {"a": np.zeros((6, 8))}
    images["a"][2:4, 2:5] = 9
    images["a"][5, 7] = 9
    px, shapes = tables(spark, images)
    lab = S.segment(px, shapes, S.noise_cuts(px.where("v > 100").unionByName(px)), min_size=1)
    assert lab.collect() == []  # no noise: nothing rises above it
    lab = S.segment(px, shapes, S.otsu_cuts(px), min_size=1)
    assert {tuple(x) for x in S.sizes(lab, shapes).collect()} == {("a", 18, 6, False), ("a", 47, 1, True)}
    assert S.foreground_fraction(lab, shapes).first().fraction == 7 / 48
    noisy = {"b": np.random.default_rng(3).normal(10, 1, (40, 40))}
    noisy["b"][10:15, 10:15] = 100
    px, shapes = tables(spark, noisy)
    cut = S.noise_cuts(px).first().cut
    v = noisy["b"].ravel()
    assert abs(cut - (np.median(v) + 3 * 1.4826 * np.median(np.abs(v - np.median(v))))) < 1e-9
    assert S.segment(px, shapes, S.noise_cuts(px), min_size=20).select("label").distinct().count() == 1


def test_long_chains_and_empty_tables(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(1000, 1001), (5, 5)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(n), 1000, 1001, 2000]], "node long")
    assert {r.node: r.label for r in connected(nodes, links).collect()} == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000, 2000: 2000}
    px, shapes = tables(spark, {"a": np.zeros((2, 2))})
    assert S.segment(px.limit(0), shapes, S.otsu_cuts(px.limit(0))).collect() == []
    assert connected(nodes.limit(0), links.limit(0)).collect() == []


def brute_cells(lab, green, red, raw_green, raw_red, erosion, ring, saturation=255.0):
    h, w = lab.shape
    near = lambda m, k: np.array([[any(m[a, b] for a in range(max(r - k, 0), min(r + k + 1, h)) for b in range(max(c - k, 0), min(c + k + 1, w)) if (a - r) ** 2 + (b - c) ** 2 <= k * k) for c in range(w)] for r in range(h)])
    out = {}
    for k in set(lab.ravel().tolist()) - {-1}:
        m = lab == k
        inner = m & ~near(~m, erosion) if erosion else m
        inner = inner if inner.any() else m
        annulus = near(m, erosion + ring) & ~near(m, erosion) & (lab < 0)
        bg, br = (float(np.median(x[annulus])) if annulus.any() else 0.0 for x in (green, red))
        g, r = ((np.clip(x[inner] - b, 0, None) if annulus.any() else x[inner]) for x, b in ((green, bg), (red, br)))
        out[k] = (int(m.sum()), raw_green[inner].mean(), raw_red[inner].mean(), g.mean(), r.mean(), g.sum(), r.sum(), bool((raw_green[m] >= saturation).any() or (raw_red[m] >= saturation).any()), bg, br)
    return out


@pytest.mark.parametrize("erosion, ring", [(1, 3), (0, 2), (2, 1)])
def test_extraction_equals_arrays(spark, erosion, ring):
    r = np.random.default_rng(7)
    a = np.zeros((26, 30))
    a[0:6, 0:7], a[9:18, 10:20], a[9:12, 22:29], a[20, 3], a[22:26, 24:30] = 9, 9, 9, 9, 9
    images = {"a": a, "b": np.full((4, 4), 9.0)}
    images["b"][0, 0] = 0
    px, shapes = tables(spark, images)
    values = {i: [r.integers(0, 200, x.shape).astype(float) for _ in range(4)] for i, x in images.items()}
    values["a"][2][10, 12] = 255
    ch = [(i, rr, c, *(float(v[rr, c]) for v in vs)) for i, vs in values.items() for rr in range(images[i].shape[0]) for c in range(images[i].shape[1])]
    channels = spark.createDataFrame(ch, "image_id string, r long, c long, green double, red double, raw_green double, raw_red double")
    lab = S.segment(px, shapes, S.otsu_cuts(px), min_size=1)
    arrays = as_array(lab.collect(), images)
    got = S.extract_cells(lab, shapes, channels, erosion_px=erosion, annulus_px=ring).collect()
    want = {(i, k): v for i in images for k, v in brute_cells(arrays[i], *values[i], erosion, ring).items()}
    assert len(got) == len(want) == 6
    for x in got:
        w = want[x.image_id, x.cell_id]
        mine = (x.area_px, x.raw_mean_green, x.raw_mean_red, x.corrected_mean_green, x.corrected_mean_red, x.integrated_green, x.integrated_red, x.sat_flag, x.local_background_green, x.local_background_red)
        assert all(abs(p - q) < 1e-9 for p, q in zip(mine, w, strict=True)), (x, w)


def test_components_of_a_frame_take_no_rounds(spark):
    # A snake through 60 rows: its ends are 59 links apart; a second frame and a loose run keep labels of their own.
    runs = [("a", 2 * k, 0, 9) for k in range(30)] + [("a", 2 * k + 1, 9 * (k % 2), 9 * (k % 2)) for k in range(29)] + [("a", 60, 0, 3), ("b", 0, 2, 4), ("b", 1, 5, 6), ("b", 1, 0, 2)]
    table = spark.createDataFrame(runs, "image_id string, r long, c0 long, c1 long")
    shapes = spark.createDataFrame([("a", 70, 10), ("b", 2, 10)], "image_id string, height long, width long")
    context = spark.sparkContext
    context.setJobGroup("components", "components")
    try:
        out = S.components(table, shapes)
        assert not list(context.statusTracker().getJobIdsForGroup("components"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    got = {(x.image_id, x.r, x.c0): x.label for x in out.collect()}
    assert len(got) == len(runs) and {v for (i, r, _), v in got.items() if i == "a" and r < 60} == {0}
    assert got["a", 60, 0] == 600 and got["b", 0, 2] == got["b", 1, 0] == 2 and got["b", 1, 5] == 15


def test_merged_runs(spark):
    runs = [("a", 0, 0, 2), ("a", 0, 3, 4), ("a", 0, 6, 9), ("a", 0, 7, 8), ("a", 0, 9, 11), ("a", 1, 5, 5)]
    out = S.merged(spark.createDataFrame(runs, "image_id string, r long, c0 long, c1 long"))
    assert sorted(map(tuple, out.select("r", "c0", "c1").collect())) == [(0, 0, 4), (0, 6, 11), (1, 5, 5)]


def test_cuts_take_one_array_an_image(spark):
    rng = np.random.default_rng(3)
    images = {"none": [], "one": [4.0], "flat": [2.0] * 5, "two": [1.0, 9.0], "odd": [1.0, 2.0, 40.0], "many": np.floor(rng.normal(30, 9, 400)).tolist() + np.floor(rng.normal(90, 5, 60)).tolist()}
    rows = [(k, 0, i, v) for k, vs in images.items() for i, v in enumerate([*vs, None])]
    px = spark.createDataFrame(rows, "image_id string, r long, c long, v double")
    otsu, noise = S.otsu_cuts(px), S.noise_cuts(px, 2.0)
    for t in (otsu, noise):
        # Windows over histograms and percentile buffers held many rows and boxed values of an image.
        plan = t._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "percentile(" not in plan
    cuts, noise = ({r.image_id: r.cut for r in t.collect()} for t in (otsu, noise))
    assert set(cuts) == set(images) - {"none"} and noise["none"] is None
    for k, vs in images.items():
        if not vs:
            continue
        v = np.array(vs)
        mad = np.median(np.abs(v - np.median(v)))
        assert noise[k] == pytest.approx(np.median(v) + 2 * 1.4826 * mad if mad > 0 else v.max())
        lo, hi = v.min(), v.max()
        if lo == hi:
            assert cuts[k] == hi
            continue
        b = np.minimum(np.floor((v - lo) / ((hi - lo) / 256)), 255)
        score = {x: ((len(v) * b[b <= x].sum() - (b <= x).sum() * b.sum()) ** 2 / ((b <= x).sum() * (b > x).sum()) if (b > x).any() else 0.0) for x in sorted(set(b))}
        assert cuts[k] == pytest.approx(lo + (max(score, key=lambda x: (score[x], -x)) + 0.5) * (hi - lo) / 256)


def test_extraction_makes_no_rows_of_dilated_pixels(spark):
    a = np.zeros((12, 14))
    a[2:6, 2:6], a[8:10, 9:13], a[11, 0:3] = 9, 9, 9
    px, shapes = tables(spark, {"a": a})
    lab = S.segment(px, shapes, S.otsu_cuts(px), min_size=1)
    r = np.random.default_rng(8)
    v = [r.integers(0, 200, a.shape).astype(float) for _ in range(4)]
    # The last cell has no pixel in the channels, the row above it is unknown, and some values are missing.
    ch = [("a", i, j, *(None if x is v[0] and (i, j) in ((3, 3), (1, 3)) else float(x[i, j]) for x in v)) for i in range(10) for j in range(14)]
    channels = spark.createDataFrame(ch, "image_id string, r long, c long, green double, red double, raw_green double, raw_red double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = S.extract_cells(lab, shapes, channels)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    # What is dilated or eroded was a row for each cell, pixel and row of the disk.
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {x.cell_id: x for x in out.collect()}
    assert set(got) == {2 * 14 + 2, 8 * 14 + 9}
    mask, inner = a > 0, np.zeros(a.shape, bool)
    inner[3:5, 3:5] = True
    near = lambda k: np.array([[any((i - p) ** 2 + (j - q) ** 2 <= k * k for p in range(2, 6) for q in range(2, 6)) for j in range(14)] for i in range(12)])
    ring = near(4) & ~near(1) & ~mask
    ring[10:] = False
    green = v[0].copy()
    green[3, 3] = green[1, 3] = np.nan
    x = got[2 * 14 + 2]
    bg, br = np.nanmedian(green[ring]), np.median(v[1][ring])
    assert (x.area_px, x.n_annulus, x.local_background_green, x.local_background_red) == (16, ring.sum(), bg, br)
    assert x.integrated_green == pytest.approx(sum(max(g - bg, 0) for g in green[inner] if g == g)) and x.raw_mean_red == pytest.approx(v[3][inner].mean())
    assert x.corrected_mean_green == pytest.approx(x.integrated_green / 4)
