"""Images against log rows: folder equality, clock offsets, one-to-one assignment, nearest frames."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def plain_path(s: pd.Series) -> pd.Series:
    """Composed, folded in case, white space as single spaces."""
    return s.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFC", v).split()).casefold())


def minutes(a: Column, b: Column) -> Column:
    """a - b in minutes, to the microsecond."""
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(60e6)


def half_minute(date: Column, clock: Column) -> Column:
    """A log's HH:MM as the middle of its minute."""
    return (F.try_to_timestamp(F.concat_ws(" ", date, clock), F.lit("yyyy-MM-dd HH:mm")) + F.expr("interval 30 seconds")).cast("timestamp_ntz")


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a one-to-one assignment of least total cost, by shortest augmenting paths with potentials."""
    turned = cost.shape[0] > cost.shape[1]
    c = (cost.T if turned else cost).astype(float)
    n, m = c.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        best, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col, shift = start, -1, 0.0
        while True:
            slack = shift + c[row] - row_price[row] - col_price
            closer = ~done & (slack < best)
            best[closer], via[closer] = slack[closer], col
            col = int(np.argmin(np.where(done, np.inf, best)))
            shift = best[col]
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        used = np.flatnonzero(done)
        row_price[start] += shift
        for j in used:
            if row_of[j] >= 0:
                row_price[row_of[j]] += shift - best[j]
            col_price[j] -= shift - best[j]
        while col >= 0:
            before = via[col]
            row_of[col] = row_of[before] if before >= 0 else start
            col = before
    cols = np.flatnonzero(row_of >= 0)
    rows = row_of[cols]
    order = np.argsort(rows)
    return (cols[order], rows[order]) if turned else (rows[order], cols[order])


def assign_groups(pairs: DataFrame, keys: list[str], left: str, right: str, cost: str, most: float | None = None) -> DataFrame:
    """(keys, left, right, cost): per group an assignment of least total cost over the pairs given; others are not allowed.

    A group is what can be matched at all, such as the images of one day and root; pairs beyond ``most`` do not count.
    """
    p = pairs.select(*keys, left, right, cost)
    if most is not None:
        p = p.where(F.col(cost) <= most)
    kinds = dict(p.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pd.factorize(pdf[left], sort=True), pd.factorize(pdf[right], sort=True)
        never = float(pdf[cost].abs().max() * (len(a[1]) + len(b[1]) + 1) + 1e6)
        c = np.full((len(a[1]), len(b[1])), never)
        c[a[0], b[0]] = pdf[cost]
        i, j = assign(c)
        ok = c[i, j] < never
        out = pd.DataFrame({left: a[1][i[ok]], right: b[1][j[ok]], cost: c[i[ok], j[ok]]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, left, right, cost]]

    return p.groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*keys, left, right, cost]))


def candidates(images: DataFrame, rows: DataFrame) -> DataFrame:
    """Image and row pairs of the same day and root, with same_folder.

    images: (image_id, root, folder, red_time, green_time); rows: (row_id, date, root, folder, red, green), clocks as HH:MM.
    """
    i = images.where("red_time is not null").withColumn("day", F.date_format("red_time", "yyyy-MM-dd")).withColumn("_i", plain_path("folder"))
    r = rows.where("coalesce(red, '') <> ''").select(F.col("date").alias("day"), "root", "row_id", plain_path("folder").alias("_r"), half_minute(F.col("date"), F.col("red")).alias("log_red"), half_minute(F.col("date"), F.col("green")).alias("log_green"))
    same = (F.col("_i") == F.col("_r")) | F.col("_i").endswith(F.concat(F.lit("/"), F.col("_r")))
    return i.join(r, ["day", "root"]).withColumn("same_folder", same)


def clock_offsets(pairs: DataFrame) -> DataFrame:
    """(day, offset_min): median camera minus log time, over folders with as many images as rows, paired in order of time."""
    f = pairs.where("same_folder")
    w = Window.partitionBy("day", "root", "_i")
    f = f.withColumns(
        {
            "_a": F.dense_rank().over(w.orderBy("red_time", "image_id")), "_b": F.dense_rank().over(w.orderBy("log_red", "row_id")),
            "_n": F.size(F.collect_set("image_id").over(w)), "_m": F.size(F.collect_set("row_id").over(w)),
        }
    )
    return f.where("_n = _m and _a = _b").groupBy("day").agg(F.percentile(minutes(F.col("red_time"), F.col("log_red")), 0.5).alias("offset_min"))


def residual(offset: Column) -> Column:
    """Mean distance of both channels' times in minutes after the offset; of red alone where green is unknown."""
    red = F.abs(minutes(F.col("red_time"), F.col("log_red")) - offset)
    green = F.abs(minutes(F.col("green_time"), F.col("log_green")) - offset)
    return F.coalesce((red + green) / 2, red)


def match_images(images: DataFrame, rows: DataFrame, *, tolerance: float = 2.5, same_folder_tolerance: float = 5.0) -> DataFrame:
    """(image_id, row_id, status, residual_min): a record per image and per row without one.

    First within the folder that the log names: in order of time where counts agree, by least total distance else.  What is
    left is matched over folders of the same day and root, within a tighter tolerance.
    """
    pairs = candidates(images, rows)
    offsets = clock_offsets(pairs)
    p = pairs.join(offsets, "day").withColumn("residual_min", residual(F.col("offset_min")))
    own = p.where("same_folder")
    w = Window.partitionBy("day", "root", "_i")
    own = own.withColumns(
        {
            "_a": F.dense_rank().over(w.orderBy("red_time", "image_id")), "_b": F.dense_rank().over(w.orderBy("log_red", "row_id")),
            "_n": F.size(F.collect_set("image_id").over(w)), "_m": F.size(F.collect_set("row_id").over(w)),
        }
    )
    ordered = own.where("_n = _m and _a = _b").select("image_id", "row_id", "residual_min")
    solved = assign_groups(own.where("_n <> _m").withColumnRenamed("_i", "f"), ["day", "root", "f"], "image_id", "row_id", "residual_min").select("image_id", "row_id", "residual_min")
    first = ordered.unionByName(solved).where(F.col("residual_min") <= same_folder_tolerance).withColumn("status", F.lit("matched"))
    left = p.join(first.select("image_id"), "image_id", "left_anti").join(first.select("row_id"), "row_id", "left_anti")
    second = assign_groups(left, ["day", "root"], "image_id", "row_id", "residual_min", tolerance).select("image_id", "row_id", "residual_min").withColumn("status", F.lit("matched_other_folder"))
    found = first.unionByName(second)
    none = images.select("image_id", "red_time").join(found.select("image_id"), "image_id", "left_anti")
    none = none.select("image_id", F.lit(None).cast(dict(rows.dtypes)["row_id"]).alias("row_id"), F.lit(None).cast("double").alias("residual_min"), F.when(F.col("red_time").isNull(), "no_timestamp").otherwise("no_log_row").alias("status"))
    free = rows.where("coalesce(red, '') <> ''").select("row_id").join(found.select("row_id"), "row_id", "left_anti")
    free = free.select(F.lit(None).cast(dict(images.dtypes)["image_id"]).alias("image_id"), "row_id", F.lit(None).cast("double").alias("residual_min"), F.lit("log_row_without_image").alias("status"))
    return found.unionByName(none).unionByName(free)


def nearest_frames(targets: DataFrame, frames: DataFrame, keys: list[str], tolerance: float = 3.0) -> DataFrame:
    """Targets (keys, target_id, target_time) with the nearest frame (keys, path, frame_time) in minutes, or none within the tolerance; ties by path.

    Targets and frames of a key are put in one order of time, and each target takes the last frame before and the first one after it: no pairs are
    made.  Time is cut in stretches as long as the tolerance, and a frame stands in its own and both neighbouring ones, so a key with very
    many frames is many groups.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = F.lit(int(max(tolerance, 1.0) * 60e6))
    f = frames.na.drop(subset=[*keys, "frame_time"]).groupBy(*keys, micros("frame_time").alias("_t")).agg(F.min("path").alias("_path"))
    f = f.withColumn("_cut", F.explode(F.array(*(F.floor(F.col("_t") / width) + i for i in (-1, 0, 1))))).withColumn("_frame", F.struct("_t", "_path"))
    t = targets.withColumn("_t", micros("target_time")).withColumn("_cut", F.floor(F.col("_t") / width))
    both = t.withColumn("_is", F.lit(True)).unionByName(f.drop("_path"), allowMissingColumns=True)
    w, upto = Window.partitionBy(*keys, "_cut"), (Window.unboundedPreceding, 0)
    last = F.col("_is").asc_nulls_first()
    both = both.withColumn("_before", F.last("_frame", True).over(w.orderBy("_t", last).rowsBetween(*upto))).withColumn("_after", F.last("_frame", True).over(w.orderBy(F.desc("_t"), last).rowsBetween(*upto)))
    away = lambda c: F.struct((F.abs(F.col(c)["_t"] - F.col("_t")) / F.lit(60e6)).alias("d"), F.col(c)["_path"].alias("p"))
    pick = F.least(F.when(F.col("_before").isNotNull(), away("_before")), F.when(F.col("_after").isNotNull(), away("_after")))
    j = both.where("_is").withColumn("_near", pick)
    near = F.col("_near.d") <= tolerance
    return j.select(*targets.columns, F.when(near, F.col("_near.p")).alias("path"), F.when(near, F.col("_near.d")).alias("distance_min"))


def tolerance_lookup(points: DataFrame, grid: DataFrame, keys: list[str], x: str, atol: float = 1e-12) -> DataFrame:
    """Points with the one grid node at their x; none, or more than one, is refused."""
    from .expect import expect

    g = grid.withColumnRenamed(x, "_x")
    j = points.join(g, keys, "left").withColumn("_hit", F.coalesce(F.abs(F.col(x) - F.col("_x")) <= atol, F.lit(False)))
    n = j.groupBy(*keys, x).agg(F.count_if("_hit").alias("n"))
    expect(n, {f"{x} must match exactly one grid node": F.col("n") != 1})
    return j.where("_hit").drop("_x", "_hit")


def acquisition_order(fields: DataFrame, session: str = "session_id", label: str = "tp_label", time: str = "red_time") -> DataFrame:
    """Order of each field in its session, and of its time label by when that was first seen."""
    w = Window.partitionBy(session)
    f = fields.withColumn("acquisition_order", F.row_number().over(w.orderBy(time)) - 1).withColumn("_first", F.min(time).over(Window.partitionBy(session, label)))
    return f.withColumn("timepoint", F.dense_rank().over(w.orderBy("_first", label)) - 1).drop("_first")
