"""Image sets to cells in one batch: unusable sets are refused with a reason, and never stop the others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import segment
from ..sources import frames
from ..sources.work import staged


def read_sets(manifest: DataFrame, files: DataFrame, *, keep: Sequence[str] = ("session_id", "condition_id", "sample_id"), method: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, pixels, refused) from a manifest (green_path, red_path and ``keep``) and ``image_files``.

    sets: (image_id, keep, height, width); pixels: (image_id, r, c, green, red); refused: (image_id, keep, reason).  Whether a set can be read is told
    from the files' headers; only the pixels of sets that can are decoded.  A set's number is fixed by writing the manifest once.
    """
    sets = staged(manifest.select(*keep, "green_path", "red_path").withColumn("image_id", F.monotonically_increasing_id().cast("string")), "sets")
    h = staged(frames.readable(frames.headers(files)).select("path", "height", "width", "reason"), "headers")
    tagged = sets
    for ch in ("green", "red"):
        own = h.select(F.col("path").alias(f"{ch}_path"), *(F.col(c).alias(f"{ch}_{c}") for c in ("height", "width", "reason")), F.lit(True).alias(f"{ch}_there"))
        tagged = tagged.join(own, f"{ch}_path", "left")
    why = lambda ch: F.when(F.col(f"{ch}_there").isNull(), f"{ch} file not found").when(F.col(f"{ch}_reason").isNotNull(), F.concat(F.lit(f"{ch}: "), f"{ch}_reason"))
    unlike = (F.col("green_height") != F.col("red_height")) | (F.col("green_width") != F.col("red_width"))
    tagged = staged(tagged.withColumn("reason", F.coalesce(why("green"), why("red"), F.when(unlike, "green and red differ in shape"))), "tagged")
    good = tagged.where("reason IS NULL")
    wanted = good.select(F.explode(F.array("green_path", "red_path")).alias("path")).distinct()
    rows = staged(frames.decode(files.join(wanted, "path", "left_semi")), "rows")
    # A file may pass by its header and still break off: its sets are refused as well.
    broken = rows.where("reason IS NOT NULL").select("path", F.col("reason").alias("why"))
    lost = good.select("image_id", F.explode(F.array("green_path", "red_path")).alias("path")).join(broken, "path").groupBy("image_id").agg(F.min("why").alias("why"))
    good = good.drop("reason").join(lost, "image_id", "left")
    planes = frames.plane(rows, method)
    one = lambda ch: good.where("why IS NULL").select("image_id", F.col(f"{ch}_path").alias("path")).join(planes, "path").select("image_id", "r", F.col("v").alias(ch))
    both = one("green").join(one("red"), ["image_id", "r"]).select("image_id", "r", F.posexplode(F.arrays_zip("green", "red")).alias("c", "x"))
    px = staged(both.select("image_id", "r", F.col("c").cast("long").alias("c"), "x.green", "x.red"), "pixels")
    refused = tagged.where("reason IS NOT NULL").select("image_id", *keep, "reason").unionByName(good.where("why IS NOT NULL").select("image_id", *keep, F.col("why").alias("reason")))
    return good.where("why IS NULL").select("image_id", *keep, F.col("green_height").alias("height"), F.col("green_width").alias("width")), px, refused


def process_sets(
    sets: DataFrame, pixels: DataFrame, *, coefficients: DataFrame | None = None, source: str = "green + red", min_size: int = 30, least: float = 0.001, most: float = 0.2,
    saturation: float = 255.0, erosion_px: int = 1, annulus_px: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """(cells, refused) of image sets (image_id, height, width, ...) with pixels (image_id, r, c, green, red).

    Cells are segmented on ``source``, an expression over green and red.  A set whose cells cover less than ``least`` or more than
    ``most`` of its frame is refused with the fraction, one without cells as well; the others' cells are measured.  ``coefficients``
    (session_id, bleed) takes the green that bleeds into red off the red, with 0 as its floor; a set whose session has none is refused.

    Every set goes to exactly one side: the sets are judged once, written with their reason, and both results read that.  Raises
    where every set is refused, as there is nothing to publish.
    """
    shapes = sets.select("image_id", "height", "width")
    v = pixels.select("image_id", "r", "c", F.expr(source).cast("double").alias("v"))
    labelled = segment.segment(v, shapes, segment.otsu_cuts(v), min_size=min_size)
    judged = sets.join(segment.foreground_fraction(labelled, shapes), "image_id")
    outside = ~F.col("fraction").between(least, most)
    reason = F.when(outside, F.concat(F.lit("foreground fraction "), F.format_string("%.4f", "fraction"), F.lit(f" is outside {least:g} to {most:g}")))
    if coefficients is None:
        judged = judged.withColumn("bleed", F.lit(0.0))
    else:
        judged = judged.join(coefficients.select("session_id", F.col("bleed").cast("double")), "session_id", "left")
        reason = F.coalesce(F.when(F.col("bleed").isNull(), "no crosstalk coefficient for the session"), reason)
    judged = staged(judged.withColumn("reason", reason), "judged")
    good = judged.where("reason IS NULL").select("image_id", "bleed")
    if good.isEmpty() and not judged.isEmpty():
        raise ValueError("every image set was refused; first: " + judged.orderBy("image_id").first()["reason"])
    px = pixels.join(good, "image_id")
    channels = px.select("image_id", "r", "c", "green", F.greatest(F.col("red") - F.col("bleed") * F.col("green"), F.lit(0.0)).alias("red"), F.col("green").alias("raw_green"), F.col("red").alias("raw_red"))
    own = labelled.join(good.select("image_id"), "image_id", "left_semi")
    cells = segment.extract_cells(own, shapes, channels, saturation=saturation, erosion_px=erosion_px, annulus_px=annulus_px)
    return sets.drop("height", "width").join(cells, "image_id"), judged.where("reason IS NOT NULL").select(*(c for c in sets.columns if c not in ("height", "width")), "fraction", "reason")
