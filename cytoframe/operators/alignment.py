"""Bright-field masks onto the fluorescence fields that they belong to: candidates by time, displacement, evidence, one frame for each field.

A field is a fluorescence image and a frame a bright-field one of the same shape; a frame's cells are a mask, a table of runs
(frame_id, r, c0, c1) with both ends included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import staged
from .components import connected
from .illumination import frame_rows, smoothed
from .images import shift_labels
from .matching import assign_groups

#: The percentile of unrelated scores that a match must exceed, and how many unrelated fields a session asks for in all and at most each.
CUT_PERCENTILE, LEAST_NULLS, MOST_DRAWS = 95, 20, 5
#: What a pair without evidence is worth to the assignment: less than any pair that has some.
NO_EVIDENCE = -1e3

PLACED = "dy long, dx long, z double, contrast double, mask_fraction double"


def pairs_in_time(fields: DataFrame, frames: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(keys, field_id, frame_id) of fields (keys, field_id, t) and frames (keys, frame_id, t) whose times in minutes differ by at most ``tolerance``.

    Time is cut in stretches as long as the tolerance, and a field meets the frames of its own and both neighbouring ones by equal keys; null keys and times meet none.
    """
    cut = F.floor(F.col("t") / max(tolerance, 1e-9))
    a = fields.select(*keys, "field_id", "t", F.explode(F.array(cut - 1, cut, cut + 1)).alias("_cut"))
    b = frames.select(*keys, "frame_id", F.col("t").alias("_t"), cut.alias("_cut"))
    return a.join(b, [*keys, "_cut"]).where(F.abs(F.col("t") - F.col("_t")) <= tolerance).select(*keys, "field_id", "frame_id").distinct()


def unrelated_pairs(given: DataFrame, sessions: list[str]) -> DataFrame:
    """(sessions, frame_id, own_field, field_id): for each field with a frame (sessions, field_id, frame_id) other fields of its session to try the frame on.

    Fields of a session stand in a ring ordered by a digest of their ids, and each takes those that follow: 20 over the number of fields, at least one and at
    most five.  Same fields, same choice; no field meets itself, and no pairs but these are made.
    """
    w = Window.partitionBy(*sessions)
    order = F.md5(F.col("field_id").cast("string").cast("binary"))
    ring = given.withColumns({"_place": F.row_number().over(w.orderBy(order, "field_id")) - 1, "_n": F.count("*").over(w)})
    draws = F.least(F.greatest(F.ceil(F.lit(LEAST_NULLS) / F.col("_n")), F.lit(1)), F.lit(MOST_DRAWS), F.col("_n") - 1).cast("int")
    ask = ring.where("_n > 1").select(*sessions, "frame_id", F.col("field_id").alias("own_field"), "_n", "_place", F.explode(F.sequence(F.lit(1), draws)).alias("_step"))
    ask = ask.withColumn("_place", ((F.col("_place") + F.col("_step")) % F.col("_n")).cast("int"))
    return ask.join(ring.select(*sessions, "_place", "field_id"), [*sessions, "_place"]).select(*sessions, "frame_id", "own_field", "field_id")


def displacement_scores(mask: np.ndarray, image: np.ndarray, reach: int) -> tuple[np.ndarray, int, int]:
    """(scores, least dy, least dx): mean of the image under the mask for each displacement within ``reach``, null where half of the mask has left the frame.

    All displacements come from one product of transforms, in frames of twice the size so that nothing wraps.  Sums are rounded to a millionth, so equal sums are equal.
    """
    h, w = image.shape
    size = 2 * h, 2 * w
    m = np.conj(np.fft.rfft2(mask.astype(float), size))
    sums, covered = (np.fft.irfft2(np.fft.rfft2(x, size) * m, size) for x in (image, np.ones(image.shape)))
    dy = np.arange(-min(reach, h // 2), min(reach, h - 1 - h // 2) + 1)
    dx = np.arange(-min(reach, w // 2), min(reach, w - 1 - w // 2) + 1)
    at = np.ix_(dy % size[0], dx % size[1])
    n = np.rint(covered[at])
    return np.where(2 * n > mask.sum(), np.round(sums[at], 6) / np.maximum(n, 1), np.nan), int(dy[0]), int(dx[0])


def place_mask(mask: np.ndarray, image: np.ndarray, *, reach: int = 200, guard: int = 25, sigma: float | None = 30.0) -> dict:
    """Where the mask lies best on the image (dy, dx), how clearly (z), mean inside over outside there (contrast), and the mask's share of its frame.

    ``z`` is the best score's distance from the median of all others but its ``guard`` neighbours, in robust deviations.  The image's smoothed self is taken off first,
    so uneven light does not count; None leaves the image as it is.  Nulls: an empty mask; z where the others do not vary; contrast where nothing lies outside.
    """
    out = {"dy": None, "dx": None, "z": None, "contrast": None, "mask_fraction": float(mask.mean())}
    if not mask.any():
        return out
    scores, top, left = displacement_scores(mask, image if sigma is None else image - smoothed(image, sigma, "symmetric"), reach)
    if not np.isfinite(scores).any():
        return out
    i, j = np.unravel_index(int(np.nanargmax(scores)), scores.shape)
    others = scores.copy()
    others[max(i - guard, 0) : i + guard + 1, max(j - guard, 0) : j + guard + 1] = np.nan
    others = others[np.isfinite(others)]
    if others.size:
        middle = np.median(others)
        spread = 1.4826 * np.median(np.abs(others - middle))
        out["z"] = float((scores[i, j] - middle) / spread) if spread > 0 else None
    out["dy"], out["dx"] = int(i) + top, int(j) + left
    placed = shift_labels(mask, out["dy"], out["dx"])
    if placed.any() and not placed.all() and (outside := image[~placed].mean()):
        out["contrast"] = float(image[placed].mean() / outside)
    return out


def place_pairs(pairs: DataFrame, masks: DataFrame, fields: DataFrame, shapes: DataFrame, *, reach: int = 200, guard: int = 25, sigma: float | None = 30.0) -> DataFrame:
    """``pairs`` (field_id, frame_id, more) with where each frame's mask lies on its field (``place_mask``).

    ``masks`` is (frame_id, r, c0, c1), ``fields`` pixels (image_id, r, c, v) over whole frames, ``shapes`` (image_id, height, width).  Frames are sent as runs.  Pairs
    whose field cannot be laid out, and masks out of the field's shape, keep their row with nulls: nothing stops the batch.  A task holds one pair at a time.
    """
    # Three arrays of numbers: an array of structs would be a Python object for each run.
    spans = ("_r", "_c0", "_c1")
    runs = masks.groupBy("frame_id").agg(F.collect_list(F.struct("r", "c0", "c1")).alias("_x")).select("frame_id", *(F.col("_x")[k[1:]].alias(k) for k in spans))
    rows = frame_rows(fields, shapes).withColumnRenamed("image_id", "field_id")
    j = pairs.join(runs, "frame_id", "left").join(rows, "field_id", "left")
    names = pairs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for row in b[[*spans, "height", "width", "values"]].itertuples(index=False, name=None):
                *given, height, width, values = row
                out = {"dy": None, "dx": None, "z": None, "contrast": None, "mask_fraction": None}
                if values is not None:
                    mask = np.zeros((int(height), int(width)), bool)
                    r, c0, c1 = (np.asarray([] if x is None else x, int) for x in given)
                    if ((r >= 0) & (r < height) & (c0 >= 0) & (c0 <= c1) & (c1 < width)).all():
                        for y, x0, x1 in zip(r, c0, c1, strict=True):
                            mask[y, x0 : x1 + 1] = True
                        out = place_mask(mask, np.asarray(values, float).reshape(mask.shape), reach=reach, guard=guard, sigma=sigma)
                found.append(out)
            placed = pd.DataFrame(found, columns=["dy", "dx", "z", "contrast", "mask_fraction"], index=b.index)
            placed[["dy", "dx"]] = placed[["dy", "dx"]].astype("Int64")
            placed[["z", "contrast", "mask_fraction"]] = placed[["z", "contrast", "mask_fraction"]].astype("Float64")
            yield pd.concat([b[names], placed], axis=1)

    schema = ", ".join([f"`{c}` {k}" for c, k in pairs.dtypes] + [PLACED])
    return j.select(*names, *spans, "height", "width", "values").mapInPandas(run, schema)


def assign_frames(scored: DataFrame) -> DataFrame:
    """(field_id, frame_id): at most one frame for each field and one field for each frame, of the largest sum of z over as many pairs as can be.

    Fields and frames that share candidates form components, and each is solved by itself: time bounds what a component holds.  Pairs without evidence count as -1000.
    """
    p = scored.select("field_id", "frame_id", (-F.coalesce("z", F.lit(NO_EVIDENCE))).alias("cost"), F.xxhash64(F.lit(0), "field_id").alias("a"), F.xxhash64(F.lit(1), "frame_id").alias("b"))
    p = staged(p, "scored")
    labels = connected(p.select("a").union(p.select("b")).toDF("node"), p.select("a", "b"))
    return assign_groups(p.join(labels.withColumnRenamed("node", "a"), "a"), ["label"], "field_id", "frame_id", "cost").select("field_id", "frame_id")


def align_frames(pairs: DataFrame, sessions: list[str], masks: DataFrame, fields: DataFrame, shapes: DataFrame, *, reach: int = 200, guard: int = 25, sigma: float | None = 30.0) -> DataFrame:
    """One row per field that has candidates (``pairs``: sessions, field_id, frame_id): its frame, displacement and whether it exceeds what unrelated fields reach.

    (sessions, field_id, frame_id, n_candidates, z_matched, z_best_candidate, z_runner_up, z_unrelated, cut, matched, dy, dx, shift_px, at_search_limit, contrast,
    mask_fraction, note).  A field's ``z_unrelated`` is the largest of its frame on other fields of the session, and a session's ``cut`` the 95th percentile of those: z is compared at one
    decimal, as it is reported.  Sessions of one field have no cut and no match.  A field whose candidates all went to others keeps a row with a note.
    """
    place = {"reach": reach, "guard": guard, "sigma": sigma}
    scored = staged(place_pairs(pairs.select(*sessions, "field_id", "frame_id"), masks, fields, shapes, **place), "placed")
    given = staged(assign_frames(scored), "given")
    own = scored.join(given, ["field_id", "frame_id"])
    nulls = place_pairs(unrelated_pairs(own.select(*sessions, "field_id", "frame_id"), sessions), masks, fields, shapes, **place)
    unrelated = nulls.groupBy(F.col("own_field").alias("field_id")).agg(F.round(F.max("z"), 1).alias("z_unrelated"))
    ranked = scored.groupBy(*sessions, "field_id").agg(F.count("*").alias("n_candidates"), F.round(F.max("z"), 1).alias("z_best_candidate"))
    others = scored.join(given, ["field_id", "frame_id"], "left_anti").groupBy("field_id").agg(F.round(F.max("z"), 1).alias("z_runner_up"))
    kept = own.select("field_id", "frame_id", F.round("z", 1).alias("z_matched"), "dy", "dx", F.round(F.hypot("dy", "dx"), 1).alias("shift_px"), (F.greatest(F.abs("dy"), F.abs("dx")) >= reach).alias("at_search_limit"), F.round("contrast", 3).alias("contrast"), F.round("mask_fraction", 4).alias("mask_fraction"))
    rows = staged(ranked.join(kept, "field_id", "left").join(others, "field_id", "left").join(unrelated, "field_id", "left"), "aligned")
    cuts = rows.groupBy(*sessions).agg(F.percentile("z_unrelated", CUT_PERCENTILE / 100).alias("cut"))
    note = F.when(F.col("frame_id").isNull(), "every candidate went to a field that it fits better").otherwise("")
    j = rows.join(cuts, sessions).withColumn("matched", F.coalesce(F.col("z_matched") > F.col("cut"), F.lit(False))).withColumn("note", note)
    runner_up = F.when(F.col("frame_id").isNotNull(), F.col("z_runner_up")).alias("z_runner_up")
    return j.select(*sessions, "field_id", "frame_id", "n_candidates", "z_matched", "z_best_candidate", runner_up, "z_unrelated", "cut", "matched", "dy", "dx", "shift_px", "at_search_limit", "contrast", "mask_fraction", "note")
