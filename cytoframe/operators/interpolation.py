"""Interpolating joins: points against ordered knots of the same key, as an equi-join on segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import staged


def segments(knots: DataFrame, keys: list[str], t: str, v: str, flat: bool) -> DataFrame:
    """(keys, t0, v0, t1, v1) between neighbouring knots, closed on the left; the last knot is a segment of its own.

    With ``flat`` two open segments carry the first and the last value outward.
    """
    w = Window.partitionBy(*keys).orderBy("t0")
    k = knots.where(F.col(t).isNotNull() & F.col(v).isNotNull()).select(*keys, F.col(t).cast("double").alias("t0"), F.col(v).cast("double").alias("v0"))
    s = k.withColumn("t1", F.lead("t0").over(w)).withColumn("v1", F.lead("v0").over(w)).withColumn("first", F.lag("t0").over(w).isNull())
    inf = F.lit(float("inf"))
    if not flat:
        # The last knot answers for itself alone.
        return s.withColumn("last", F.col("t1").isNull()).select(*keys, "t0", "v0", F.coalesce("t1", "t0").alias("t1"), F.coalesce("v1", "v0").alias("v1"), "last")
    body = s.select(*keys, "t0", "v0", F.coalesce("t1", inf).alias("t1"), F.coalesce("v1", "v0").alias("v1"), F.lit(False).alias("last"))
    before = s.where("first").select(*keys, (-inf).alias("t0"), "v0", F.col("t0").alias("t1"), F.col("v0").alias("v1"), F.lit(False).alias("last"))
    return body.unionByName(before)


def interpolate_join(points: DataFrame, knots: DataFrame, keys: list[str], *, t: str = "t", v: str = "v", at: str = "t", out: str = "interpolated", flat: bool = False) -> DataFrame:
    """``points`` with the knots' value at column ``at``: linear inside their range; outside null, or with ``flat`` the nearest.

    Points stay whatever they find.  Knots without time or value do not count; knots of one key should differ in time.
    """
    s = segments(knots, keys, t, v, flat).select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(c).alias(f"_{c}") for c in ("t0", "v0", "t1", "v1", "last")))
    x = F.col(at).cast("double")
    held = (x >= F.col("_t0")) & ((x < F.col("_t1")) | (F.col("_last") & (x == F.col("_t0"))))
    on = held
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    # Equal ends are kept apart so that open segments never give inf / inf.
    value = F.when(F.col("_v0") == F.col("_v1"), F.col("_v0")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.try_divide(x - F.col("_t0"), F.col("_t1") - F.col("_t0")))
    return points.join(s, on, "left").withColumn(out, value).drop(*s.columns)


def control_reference(fields: DataFrame, column: str) -> DataFrame:
    """``fields`` with ref_<column>: the session's 0 µM value at each field's time, from other conditions only.

    Conditions are averaged first; between them linear, outside flat; without a time, or without timed controls, their mean.
    A session's controls are few (one per condition), so each row carries them as one sorted array.
    """
    control = fields.where((F.col("dose_uM") == 0) & F.col(column).isNotNull())
    per = control.groupBy("session_id", "condition_id").agg(F.avg("time_h").alias("t"), F.avg(column).alias("v"))
    knots = per.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("t", "v", F.col("condition_id").alias("c")))).alias("_knots"))
    return fields.join(knots, "session_id", "left").withColumn(f"ref_{column}", _reference(F.col("_knots"), F.col("time_h"), F.col("condition_id"))).drop("_knots")


def _reference(knots: Column, time: Column, own: Column) -> Column:
    from ..functions.exprs import interpolate

    others = F.filter(knots, lambda k: k["c"] != own)
    timed = F.filter(others, lambda k: k["t"].isNotNull())
    mean = F.try_divide(F.aggregate(others, F.lit(0.0), lambda s, k: s + k["v"]), F.size(others).cast("double"))
    value = F.when(time.isNull() | (F.size(timed) == 0), mean).otherwise(interpolate(timed, time, flat=True))
    return F.when(F.size(others) > 0, value)


def add_paired(fields: DataFrame) -> DataFrame:
    """Differences from, and log folds over, the same day's 0 µM; all columns' controls are gathered in one pass."""
    from ..functions.exprs import log_ratio

    columns = ("green", "red", "positive", "green_pos", "red_pos")
    # A row per field, made from many cells: written, as both sides of the join read it.
    fields = staged(fields, "fields")
    per = fields.where("dose_uM = 0").groupBy("session_id", "condition_id")
    # A column's own rows decide its times and values, as where it is missing the row does not count for it.
    per = per.agg(*(F.avg(F.when(F.col(c).isNotNull(), F.col("time_h"))).alias(f"t_{c}") for c in columns), *(F.avg(c).alias(f"v_{c}") for c in columns))
    knot = lambda c: F.when(F.col(f"v_{c}").isNotNull(), F.struct(F.col(f"t_{c}").alias("t"), F.col(f"v_{c}").alias("v"), F.col("condition_id").alias("c")))
    knots = per.groupBy("session_id").agg(*(F.array_sort(F.collect_list(knot(c))).alias(f"_k_{c}") for c in columns))
    out = fields.join(knots, "session_id", "left")
    ref = {c: _reference(F.col(f"_k_{c}"), F.col("time_h"), F.col("condition_id")) for c in columns}
    out = out.withColumns({f"_ref_{c}": r for c, r in ref.items()})
    new = {f"d_{c}": F.col(c) - F.col(f"_ref_{c}") for c in ("green", "red", "positive")} | {f"log_fold_{c}": log_ratio(F.col(c), F.col(f"_ref_{c}")) for c in ("green_pos", "red_pos")}
    return out.withColumns(new).select(*fields.columns, *new)


def effects(points: DataFrame, value: str = "value", keys: tuple[str, ...] = ("session_id", "readout")) -> DataFrame:
    """Mean over time points of the value minus the interpolated 0 µM of the same key, for each dose above 0.

    Rows (keys, dose_uM, time_h, value).  Only points inside the control's range count; a control needs two points.
    """
    keys = list(keys)
    control = points.where("dose_uM = 0")
    stats = control.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("control_level")).where("n >= 2").drop("n")
    knots = control.join(stats.select(*keys), keys, "left_semi").select(*keys, "time_h", F.col(value).alias("v"))
    d = interpolate_join(points.where("dose_uM > 0"), knots, keys, t="time_h", v="v", at="time_h", out="c").where("c is not null")
    out = d.groupBy(*keys, "dose_uM").agg(F.avg(F.col(value) - F.col("c")).alias("effect"), F.count("*").alias("n_timepoints"))
    return out.join(stats, keys)
