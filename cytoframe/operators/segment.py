"""Cells in pixel tables: cuts from histograms or noise, runs of pixels, their connected components, holes, sizes and borders.

A pixel table is (image_id, r, c, v); pixels that it lacks are background.  ``shapes`` is (image_id, height, width).  A mask is a table of runs
(image_id, r, c0, c1), both ends included; neighbours are the four that share an edge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..sources.work import staged


def otsu_cuts(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """(image_id, cut): the centre of the histogram bin that best splits an image's pixels in two classes; pixels above it are foreground.

    Histograms are combined before the shuffle, so what moves is ``bins`` rows an image, whatever its size.  The smallest bin wins ties;
    an image of one value is cut there, so nothing of it is foreground.  Null and non-finite values do not count.
    """
    p = pixels.where(F.col("v").isNotNull() & (F.abs("v") < float("inf")))
    span = p.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")
    h = p.join(span, "image_id").groupBy("image_id", "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("n"))
    # An image's histogram is one array of at most ``bins`` entries, walked once with what lies at or below each bin.
    whole = h.groupBy("image_id", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("h"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("bin")).alias("sum_all"))
    far = lambda s, m: (F.col("all") * m - s * F.col("sum_all")).cast("double")
    between = lambda s, m: F.when(s < F.col("all"), far(s, m) * far(s, m) / (s * (F.col("all") - s)).cast("double")).otherwise(F.lit(0.0))

    def step(state: Column, x: Column) -> Column:
        below, moment = state["below"] + x["n"], state["moment"] + x["n"] * x["bin"]
        b = between(below, moment)
        better = b > state["best"]
        return F.struct(below.alias("below"), moment.alias("moment"), F.when(better, b).otherwise(state["best"]).alias("best"), F.when(better, x["bin"]).otherwise(state["bin"]).alias("bin"))

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("below"), zero.alias("moment"), F.lit(-1.0).alias("best"), zero.alias("bin"))
    best = whole.select("image_id", "lo", "hi", F.aggregate("h", start, step)["bin"].alias("bin"))
    return best.select("image_id", F.when(F.col("hi") > F.col("lo"), F.col("lo") + (F.col("bin") + 0.5) * width).otherwise(F.col("hi")).alias("cut"))


def noise_cuts(pixels: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """(image_id, cut): so many robust standard deviations above an image's median; for frames where cells are few.

    The deviation is 1.4826 times the median distance from the median.  An image without any noise is cut at its maximum: it has no foreground.
    """
    v = pixels.groupBy("image_id").agg(F.array_sort(F.collect_list("v")).alias("v"), F.max("v").alias("hi"))
    m = v.withColumn("m", E.array_quantile(F.col("v"), 0.5))
    off = F.array_sort(F.transform("v", lambda x: F.abs(x - F.col("m"))))
    d = m.select("image_id", "m", "hi", off.alias("off")).withColumn("mad", E.array_quantile(F.col("off"), 0.5))
    return d.select("image_id", F.when(F.col("mad") > 0, F.col("m") + sigmas * 1.4826 * F.col("mad")).otherwise(F.col("hi")).alias("cut"))


def foreground(pixels: DataFrame, cuts: DataFrame) -> DataFrame:
    """(image_id, r, c) of the pixels above their image's cut."""
    return pixels.join(cuts, "image_id").where("v > cut").select("image_id", "r", "c")


def runs_of(mask_pixels: DataFrame) -> DataFrame:
    """Runs of a table of pixels; repeated pixels count once."""
    w = Window.partitionBy("image_id", "r").orderBy("c")
    p = mask_pixels.select("image_id", "r", "c").distinct().withColumn("at", F.col("c") - F.row_number().over(w))
    return p.groupBy("image_id", "r", "at").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).drop("at")


def pixels_of(runs: DataFrame) -> DataFrame:
    """The pixels of runs, with the runs' other columns."""
    return runs.withColumn("c", F.explode(F.sequence("c0", "c1"))).drop("c0", "c1")


def merged(runs: DataFrame) -> DataFrame:
    """Runs of all pixels that any of ``runs`` covers: those that overlap or touch become one."""
    w = Window.partitionBy("image_id", "r").orderBy("c0", "c1")
    reach = F.max("c1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = runs.withColumn("new", F.coalesce(F.col("c0") > reach + 1, F.lit(True)).cast("long")).withColumn("at", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return new.groupBy("image_id", "r", "at").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("at")


def gaps_of(runs: DataFrame, shapes: DataFrame) -> DataFrame:
    """Runs of all that the mask leaves out of its frames, rows without runs included."""
    w = Window.partitionBy("image_id", "r").orderBy("c0")
    rows = shapes.select("image_id", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)).alias("r"))
    # A run of length nothing at the end of each row closes its last gap.
    ends = rows.select("image_id", "r", F.col("width").alias("c0"), F.col("width").alias("c1"))
    g = runs.select("image_id", "r", "c0", "c1").unionByName(ends)
    g = g.withColumn("from", F.coalesce(F.lag("c1").over(w) + 1, F.lit(0).cast("long")))
    return g.where(F.col("from") < F.col("c0")).select("image_id", "r", F.col("from").alias("c0"), (F.col("c0") - 1).alias("c1"))


def linked_runs(frame: np.ndarray, r: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """For each run the first run of its component; runs are sorted by frame, row and column, and those of one row do not overlap."""
    height, width = (int(x.max(initial=0)) + 2 for x in (r, c1))
    row = (frame * height + r) * width
    # The runs of the row below that overlap one are neighbours in this order; below a frame's last row there is a row without any.
    lo, hi = np.searchsorted(row + c1, row + width + c0, "left"), np.searchsorted(row + c0, row + width + c1, "right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(r)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    first = np.arange(len(r))
    while (first[a] != first[b]).any():
        least = np.minimum(first[a], first[b])
        np.minimum.at(first, first[a], least)
        np.minimum.at(first, first[b], least)
        while (first != (up := first[first])).any():
            first = up
    return first


def components(runs: DataFrame, shapes: DataFrame) -> DataFrame:
    """``runs`` with ``label``: the smallest pixel number (r * width + c) of the component that a run belongs to.

    Runs of neighbouring rows are linked where they overlap.  Components end at their frame's edge, so a frame's runs are one row of arrays, shuffled once, and a
    batch of frames is labelled at a time; labels never travel from run to run in rounds of joins.
    """
    x = F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in ("r", "c0", "c1")))))
    rows = runs.groupBy("image_id").agg(x.alias("x")).join(shapes.select("image_id", F.col("width").cast("long").alias("width")), "image_id")

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            counts = b["r"].map(len).to_numpy()
            r, c0, c1 = (np.concatenate(b[k].to_list()).astype(np.int64) for k in ("r", "c0", "c1"))
            frame = np.repeat(np.arange(len(b)), counts)
            first = linked_runs(frame, r, c0, c1)
            labels = r[first] * b["width"].to_numpy()[frame] + c0[first]
            yield b[["image_id", "r", "c0", "c1"]].assign(label=np.split(labels, np.cumsum(counts)[:-1]))

    kind = dict(runs.dtypes)["image_id"]
    found = rows.select("image_id", "width", *(F.col("x")[k].alias(k) for k in ("r", "c0", "c1"))).mapInPandas(label, f"image_id {kind}, r array<long>, c0 array<long>, c1 array<long>, label array<long>")
    return found.select("image_id", F.explode(F.arrays_zip("r", "c0", "c1", "label")).alias("x")).select("image_id", "x.r", "x.c0", "x.c1", "x.label")


def sizes(labelled: DataFrame, shapes: DataFrame) -> DataFrame:
    """(image_id, label, area_px, edge_flag): pixels of each component, and whether it touches its frame's edge."""
    s = labelled.join(shapes, "image_id")
    edge = (F.col("r") == 0) | (F.col("r") == F.col("height") - 1) | (F.col("c0") == 0) | (F.col("c1") == F.col("width") - 1)
    return s.groupBy("image_id", "label").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("area_px"), F.max(edge).alias("edge_flag"))


def fill_holes(runs: DataFrame, shapes: DataFrame) -> DataFrame:
    """Runs of the mask and of all background that no edge of the frame reaches."""
    back = staged(components(gaps_of(runs, shapes), shapes), "back")
    holes = back.join(sizes(back, shapes).where("not edge_flag").select("image_id", "label"), ["image_id", "label"], "left_semi")
    return merged(runs.select("image_id", "r", "c0", "c1").unionByName(holes.drop("label")))


def segment(pixels: DataFrame, shapes: DataFrame, cuts: DataFrame, *, min_size: int = 30, fill: bool = True) -> DataFrame:
    """(image_id, r, c0, c1, label): runs of the cells above each image's cut, holes filled, cells of fewer than ``min_size`` pixels left out.

    Images without foreground have no rows; an empty table gives none.  Cells that touch one another are one cell.  The runs are
    written once, as what is done with cells reads them several times.
    """
    mask = staged(runs_of(foreground(pixels, cuts)), "mask")
    labelled = staged(components(staged(fill_holes(mask, shapes), "filled") if fill else mask, shapes), "cells")
    if min_size <= 1:
        return labelled
    large = sizes(labelled, shapes).where(F.col("area_px") >= min_size).select("image_id", "label")
    return staged(labelled.join(large, ["image_id", "label"], "left_semi").select("image_id", "r", "c0", "c1", "label"), "cells")


def foreground_fraction(labelled: DataFrame, shapes: DataFrame) -> DataFrame:
    """(image_id, fraction) of each frame that cells cover; 0 where it has none."""
    n = labelled.groupBy("image_id").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n"))
    return shapes.join(n, "image_id", "left").select("image_id", (F.coalesce("n", F.lit(0)) / (F.col("height") * F.col("width"))).alias("fraction"))


def disk(radius: int) -> list[tuple[int, int]]:
    """(row offset, half width) of a disk's rows."""
    return [(dy, int((radius * radius - dy * dy) ** 0.5)) for dy in range(-radius, radius + 1)]


def dilated(mask: np.ndarray, radius: int) -> np.ndarray:
    """Which pixels lie within ``radius`` of the mask's."""
    h, w = mask.shape
    out = np.zeros((h, w), bool)
    before = np.zeros((h, w + 1), np.int64)
    np.cumsum(mask, axis=1, out=before[:, 1:])
    for dy, half in disk(radius):
        if abs(dy) < h:
            near = before[:, np.minimum(np.arange(w) + half + 1, w)] > before[:, np.maximum(np.arange(w) - half, 0)]
            out[max(dy, 0) : h + min(dy, 0)] |= near[max(-dy, 0) : h - max(dy, 0)]
    return out


def measured_cells(label: np.ndarray, values: np.ndarray, known: np.ndarray, saturation: float, erosion_px: int, annulus_px: int) -> Iterator[tuple]:
    """The cells of one frame, as ``extract_cells`` has them: ``label`` is -1 outside cells, ``values`` the four channels, ``known`` which pixels have a row in them."""
    r, c = np.nonzero(label >= 0)
    order = np.argsort(label[r, c], kind="stable")
    r, c = r[order], c[order]
    names, start = np.unique(label[r, c], return_index=True)
    reach = erosion_px + annulus_px + 1
    for name, at, end in zip(names.tolist(), start.tolist(), np.append(start, len(r))[1:].tolist(), strict=True):
        rows, columns = r[at:end], c[at:end]
        part = np.s_[max(rows.min() - reach, 0) : rows.max() + reach + 1, max(columns.min() - reach, 0) : columns.max() + reach + 1]
        own, there = label[part] == name, known[part]
        green, red, raw_green, raw_red = (x[part] for x in values)
        if not (seen := own & there).any():
            continue
        inner = own & ~dilated(~own, erosion_px) if erosion_px > 0 else own
        used = kept if (kept := inner & there).any() else seen
        ring = dilated(own, erosion_px + annulus_px) & ~dilated(own, erosion_px) & (label[part] < 0) & there
        n = int(ring.sum())
        lifted, background = [], []
        for x in (green, red):
            b = _or_none(np.median, x[ring])
            v = x[used]
            # A pixel without a value is one of no light once a background is taken off.
            lifted.append(v if b is None else np.fmax(v - b, 0.0))
            background.append(b or 0.0)
        over = bool(((raw_green[seen] >= saturation) | (raw_red[seen] >= saturation)).any())
        yield name, *(_or_none(np.mean, x[used]) for x in (raw_green, raw_red)), *(_or_none(np.mean, x) for x in lifted), *(_or_none(np.sum, x) for x in lifted), over, *background, n


def _or_none(of: Callable[[np.ndarray], float], x: np.ndarray) -> float | None:
    x = x[~np.isnan(x)]
    return float(of(x)) if len(x) else None


CHANNELS = ("green", "red", "raw_green", "raw_red")
#: Pixels of frames that Python gets at once, if frames are no larger.
PIXELS = 1 << 20


def extract_cells(labelled: DataFrame, shapes: DataFrame, channels: DataFrame, *, saturation: float = 255.0, erosion_px: int = 1, annulus_px: int = 3) -> DataFrame:
    """One row per cell: (image_id, cell_id, area_px, edge_flag, raw_mean_*, local_background_*, corrected_mean_*, integrated_*, sat_flag, n_annulus).

    ``channels`` is (image_id, r, c, green, red, raw_green, raw_red) over whole frames, a row for each pixel.  Intensities are taken over the cell's eroded pixels, or over all
    where erosion leaves none.  The local background is the median of the ring between the cell dilated by ``erosion_px`` and by
    ``annulus_px`` more, without any cell's pixels; it is taken off and what falls below 0 is 0.  A cell without a ring keeps its
    intensities.  A cell is saturated if any of its pixels is, in either raw channel.

    A frame's pixels and its cells' runs are a row of arrays each, shuffled once and measured frame by frame; dilated and eroded pixels are never rows.
    """
    pixel = F.struct(*(F.col(c).cast("int").alias(c) for c in ("r", "c")), *(F.col(c).cast("double").alias(c) for c in CHANNELS))
    run = F.struct(*(F.col(c).cast("long").alias(c) for c in ("r", "c0", "c1", "label")))
    size = shapes.select("image_id", F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"))
    runs = labelled.groupBy("image_id").agg(F.collect_list(run).alias("x")).join(size, "image_id")
    pixels = channels.groupBy("image_id").agg(F.collect_list(pixel).alias("p"))
    frames = runs.join(pixels, "image_id").select("image_id", "height", "width", "x", "p")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, (h, w) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                x, p = (b.column(k).slice(i, 1).flatten().flatten() for k in (3, 4))
                x, p = [v.to_numpy(zero_copy_only=False) for v in x], [v.to_numpy(zero_copy_only=False) for v in p]
                label, known, values = np.full((h, w), -1), np.zeros((h, w), bool), np.full((len(CHANNELS), h, w), np.nan)
                for r, c0, c1, name in zip(*(v.tolist() for v in x), strict=True):
                    label[r, c0 : c1 + 1] = name
                inside = (p[0] >= 0) & (p[0] < h) & (p[1] >= 0) & (p[1] < w)
                known[p[0][inside], p[1][inside]] = True
                values[:, p[0][inside], p[1][inside]] = [v[inside] for v in p[2:]]
                out += [(i, *cell) for cell in measured_cells(label, values, known, saturation, erosion_px, annulus_px)]
            columns = list(zip(*out, strict=True)) or [()] * (len(fields) + 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(columns[0], pa.int32())), *(pa.array(v, t) for v, (_, t) in zip(columns[1:], fields, strict=True))], names=["image_id", *(k for k, _ in fields)])

    means = ("raw_mean_green", "raw_mean_red", "corrected_mean_green", "corrected_mean_red", "integrated_green", "integrated_red")
    backgrounds = ("local_background_green", "local_background_red")
    fields = [("label", pa.int64()), *((k, pa.float64()) for k in means), ("sat_flag", pa.bool_()), *((k, pa.float64()) for k in backgrounds), ("n_annulus", pa.int64())]
    spark_types = {pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean"}
    schema = ", ".join([f"image_id {dict(labelled.dtypes)['image_id']}", *(f"{k} {spark_types[t]}" for k, t in fields)])
    largest = shapes.agg(F.max(F.col("height") * F.col("width"))).first()[0] or 1
    cells = staged(frames.mapInArrow(measure, schema), "measured", max(1, PIXELS // largest))
    return cells.join(sizes(labelled, shapes), ["image_id", "label"]).withColumnRenamed("label", "cell_id")
