"""Background levels, rolling-ball backgrounds and flat fields of frames.

A pixel table is (image_id, r, c, v) over whole frames.  Levels are aggregates over it; what needs a frame's neighbourhoods takes one frame at a time.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .images import per_image

#: Bins of the histogram, width of its smoothing in bins, percentile that stands in, and the one that a mode may not exceed.
BINS, SMOOTHING, PERCENTILE, SANITY = 256, 2.0, 5.0, 20.0
#: A smoothed count is a sum of whole numbers, so equal histograms have equal peaks wherever they are added up.
SCALE = 1 << 30


def taps(sigma: float) -> list[float]:
    """Weights of a Gaussian at whole distances up to four deviations, adding up to 1."""
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return (w / w.sum()).tolist()


def whole_taps(sigma: float) -> list[int]:
    return [round(x * SCALE) for x in taps(sigma)]


def background_levels(pixels: DataFrame, *, bins: int = BINS, sigma: float = SMOOTHING, percentile: float = PERCENTILE, sanity: float = SANITY) -> DataFrame:
    """(image_id, mode, low, level, method): the background of each image.

    ``mode`` is the centre of the fullest bin of the smoothed histogram (mirrored at its ends; the first of equals), ``low`` the percentile.  The mode is the
    level unless it lies above the image's ``sanity`` percentile, as in frames that cells fill; then it is ``low`` (method 'percentile').
    An image of one value has that level.  Null and non-finite values do not count, and an image without any other has no row.
    Histograms are combined before the shuffle; the exact percentiles of an image are one group, as large as an image.
    """
    p = pixels.where(F.col("v").isNotNull() & (F.abs("v") < float("inf")))
    span = p.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile("v", percentile / 100).alias("low"), F.percentile("v", sanity / 100).alias("bound"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")
    h = p.join(span, "image_id").groupBy("image_id", "lo", "hi", "low", "bound", bin_.alias("bin")).agg(F.count("*").alias("n"))
    weights = whole_taps(sigma)
    reach = len(weights) // 2
    spread = F.array(*(F.struct(F.lit(k - reach).alias("d"), F.lit(w).alias("w")) for k, w in enumerate(weights)))
    places = F.array(F.col("bin"), -1 - F.col("bin"), 2 * bins - 1 - F.col("bin"))
    s = h.withColumn("at", F.explode(places)).where(F.col("at").between(-reach, bins - 1 + reach)).withColumn("t", F.explode(spread))
    s = s.withColumn("bin", F.col("at") + F.col("t.d")).where(F.col("bin").between(0, bins - 1))
    s = s.groupBy("image_id", "lo", "hi", "low", "bound", "bin").agg(F.sum(F.col("n") * F.col("t.w")).alias("full"))
    best = s.groupBy("image_id", "lo", "hi", "low", "bound").agg(F.max_by("bin", F.struct("full", -F.col("bin"))).alias("bin"))
    mode = F.when(F.col("hi") > F.col("lo"), F.col("lo") + (F.col("bin") + 0.5) * width).otherwise(F.col("lo"))
    b = best.withColumn("mode", mode).withColumn("method", F.when(F.col("mode") <= F.col("bound"), "mode").otherwise("percentile"))
    return b.select("image_id", "mode", "low", F.when(F.col("method") == "mode", F.col("mode")).otherwise(F.col("low")).alias("level"), "method")


def without_level(pixels: DataFrame, levels: DataFrame) -> DataFrame:
    """Pixels less their image's level (image_id, level), not below 0."""
    return pixels.join(levels.select("image_id", "level"), "image_id").withColumn("v", F.greatest(F.col("v") - F.col("level"), F.lit(0.0))).drop("level")


def frame_rows(pixels: DataFrame, shapes: DataFrame, *keep: str) -> DataFrame:
    """(image_id, height, width, keep..., values): one row a frame, its values in order of rows and columns.

    Frames that lack a pixel, or have one twice or out of their shape, have null ``values``: they cannot be laid out.
    """
    g = pixels.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("r", "c", F.col("v").cast("double").alias("v")))).alias("p"))
    j = shapes.select("image_id", "height", "width", *keep).join(g, "image_id", "left")
    cells = F.col("height") * F.col("width")
    fits = (F.size("p") == cells) & F.forall(F.transform("p", lambda x, i: (x["r"] == F.floor(i / F.col("width"))) & (x["c"] == i % F.col("width"))), lambda ok: ok)
    return j.select("image_id", "height", "width", *keep, F.when(fits, F.transform("p", lambda x: x["v"])).alias("values"))


def ball_background(image: np.ndarray, radius: float) -> np.ndarray:
    """The height of a ball's top, rolled under the image's surface: what no ball of this radius reaches past is above it."""
    reach = math.ceil(radius)
    h, w = image.shape
    out = np.full(image.shape, np.inf)
    for dy in range(-min(reach, h - 1), min(reach, h - 1) + 1):
        for dx in range(-min(reach, w - 1), min(reach, w - 1) + 1):
            below = radius * radius - dy * dy - dx * dx
            if below < 0:
                continue
            to = (slice(max(-dy, 0), h + min(-dy, 0)), slice(max(-dx, 0), w + min(-dx, 0)))
            of = (slice(max(dy, 0), h + min(dy, 0)), slice(max(dx, 0), w + min(dx, 0)))
            np.minimum(out[to], image[of] + (radius - math.sqrt(below)), out=out[to])
    return out


def rolling_ball(frames: DataFrame, radius: float) -> DataFrame:
    """(image_id, r, c, v, background) of frame rows (image_id, height, width, values): intensities above the rolling ball's background, and that.

    Frames with null values have no rows.  What lies outside a frame does not hold the ball.  A task holds one frame at a time.
    """

    def kernel(row: dict) -> dict | list:
        if row["values"] is None:
            return []
        a = np.asarray(row["values"], np.float64).reshape(int(row["height"]), int(row["width"]))
        b = ball_background(a, radius)
        r, c = np.indices(a.shape)
        return {"image_id": [row["image_id"]] * a.size, "r": r.ravel(), "c": c.ravel(), "v": np.maximum(a - b, 0).ravel(), "background": b.ravel()}

    return per_image(frames.select("image_id", "height", "width", "values"), kernel, "image_id string, r long, c long, v double, background double")


def smoothed(image: np.ndarray, sigma: float, edge: str = "edge") -> np.ndarray:
    """Gaussian smoothing along both axes; ``edge`` as numpy.pad has it ('edge' goes on with the last value, 'symmetric' mirrors)."""
    w = np.array(taps(sigma))
    reach = len(w) // 2
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (reach, reach)
        padded = np.pad(image, pad, mode=edge)
        total = np.zeros(image.shape)
        for k, x in enumerate(w):
            total += x * np.take(padded, np.arange(k, k + image.shape[axis]), axis)
        image = total
    return image


def flat_fields(pixels: DataFrame, images: DataFrame, sigma: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """(gains, refused) from the frames of sessions: images is (image_id, session_id, height, width).

    gains: (session_id, r, c, gain), the median over a session's frames at each pixel, smoothed and divided by its mean.  Cells lie elsewhere in every
    frame, so the median leaves the light that frames share.  refused: (session_id, n_images, reason): fewer than two frames, or frames of different
    shapes.  The medians are exact groups by pixel, as large as a session has frames; pixels without a value do not count.
    """
    shape = images.groupBy("session_id").agg(F.countDistinct("image_id").alias("n_images"), F.countDistinct("height", "width").alias("shapes"), F.max("height").alias("height"), F.max("width").alias("width"))
    reason = F.when(F.col("n_images") < 2, "fewer than two images").when(F.col("shapes") > 1, "images differ in shape")
    shape = shape.withColumn("reason", reason)
    good = shape.where("reason is null").select("session_id", "height", "width")
    px = pixels.join(images.select("image_id", "session_id").join(good.select("session_id"), "session_id"), "image_id")
    medians = px.groupBy("session_id", "r", "c").agg(F.percentile("v", 0.5).alias("v"))
    rows = frame_rows(medians.withColumnRenamed("session_id", "image_id"), good.withColumnRenamed("session_id", "image_id"))

    def kernel(row: dict) -> dict | list:
        if row["values"] is None:
            return []
        a = smoothed(np.asarray(row["values"], np.float64).reshape(int(row["height"]), int(row["width"])), sigma)
        r, c = np.indices(a.shape)
        mean = a.mean()
        return {"session_id": [row["image_id"]] * a.size, "r": r.ravel(), "c": c.ravel(), "gain": (a / mean if mean else np.full(a.shape, np.nan)).ravel()}

    gains = per_image(rows, kernel, "session_id string, r long, c long, gain double")
    return gains.withColumn("gain", F.when(~F.isnan("gain"), F.col("gain"))), shape.where("reason is not null").select("session_id", "n_images", "reason")


def flattened(pixels: DataFrame, images: DataFrame, gains: DataFrame) -> DataFrame:
    """Pixels divided by their session's gain, which counts as 1e-6 where it is less; frames of sessions without one have null values."""
    p = pixels.join(images.select("image_id", "session_id"), "image_id").join(gains, ["session_id", "r", "c"], "left")
    return p.withColumn("v", F.when(F.col("gain").isNotNull(), F.col("v") / F.greatest("gain", F.lit(1e-6)))).drop("gain")
