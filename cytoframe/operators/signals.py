"""From a cell table to fields and time courses: identifiers, exposure, baseline, thresholds, medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..sources.tables import PER_SECOND
from ..sources.work import staged
from . import expect as X
from .quantiles import group_quantiles, wide

FIELD_KEYS = ["session_id", "day", "stressor", "strain", "dose_uM", "condition_id", "sample_id"]
CURVE_KEYS = ["session_id", "day", "stressor", "strain", "dose_uM"]
CHANNELS = ("green", "red")


def per_second_name(channel: str) -> str:
    return f"corrected_mean_{channel}_per_s"


def annotate(cells: DataFrame) -> DataFrame:
    """Day, stressor, strain and dose from the ids; ids of another form are refused with their values.

    Sessions of stressor none have no dose, whatever their conditions are called.
    """
    s, c = F.col("session_id"), F.col("condition_id")
    stressor = E.part(s, E.SESSION_ID, 2)
    X.expect_none(cells.where(~F.coalesce(s.rlike(E.SESSION_ID), F.lit(False))), "session_id", "session_id is not <yyyymmdd>_<stressor>_<tr|nt>")
    dose_ok = F.coalesce(c.rlike(E.CONDITION_ID) & (E.part(c, E.CONDITION_ID, 1) == stressor), F.lit(False))
    X.expect_none(cells.where((stressor != "none") & ~dose_ok), "condition_id", "condition_id does not start with <stressor>_<dose>uM of its session")
    return with_labels(cells)


def with_labels(cells: DataFrame) -> DataFrame:
    """The columns of ``annotate`` without its checks.

    Ids are read once for each distinct pair of them, written, and joined to the cells (null ids too): pairs are few, cells many.  Read off row by row, the
    patterns would be matched again in every filter and aggregate that uses a label.
    """
    s, c = F.col("session_id"), F.col("condition_id")
    pairs = cells.select("session_id", "condition_id").distinct()
    stressor = E.part(s, E.SESSION_ID, 2)
    labels = {"day": E.part(s, E.SESSION_ID, 1), "stressor": stressor, "strain": E.part(s, E.SESSION_ID, 3), "dose_uM": F.when(stressor != "none", E.part(c, E.CONDITION_ID, 2).cast("double"))}
    read = staged(pairs.select(s.alias("_session"), c.alias("_condition"), *(v.alias(k) for k, v in labels.items())), "labels")
    joined = cells.drop(*labels).join(read, s.eqNullSafe(F.col("_session")) & c.eqNullSafe(F.col("_condition")), "left")
    return joined.drop("_session", "_condition")


def add_per_second(cells: DataFrame) -> DataFrame:
    """Intensities per second of exposure; both exposures must be positive and equal on every row."""
    g, r = F.col("exposure_ms_green"), F.col("exposure_ms_red")
    X.expect(
        cells,
        {
            "green exposure is not above 0": ~F.coalesce(g > 0, F.lit(False)),
            "red exposure is not above 0": ~F.coalesce(r > 0, F.lit(False)),
            "the two channels differ in their exposure": ~E.close(g, r, 1e-5, 1e-8),
        },
    )
    return cells.withColumns({f"{c}_per_s": F.col(c) / (g / 1000.0) for c in PER_SECOND})


def baseline(cells: DataFrame) -> DataFrame:
    """Autofluorescence by stressor from usable non-transfected cells: medians, quartiles, counts and days.

    Stressors are few and their cells many, so quantiles are picked from sorted ranges; the result, a row for each stressor, is written once.
    """
    nt = cells.where((F.col("strain") == "nt") & E.usable())
    told = nt.groupBy("stressor").agg(F.count("*").alias("n_cells"), F.countDistinct("sample_id").alias("n_fields"), F.array_join(F.array_sort(F.collect_set("day")), ",").alias("days"))
    names = {per_second_name(ch): (f"baseline_{ch}", f"baseline_{ch}_q25", f"baseline_{ch}_q75") for ch in CHANNELS}
    q = wide(group_quantiles(nt, ["stressor"], list(names), (0.5, 0.25, 0.75)), ["stressor"], names)
    out = staged(told.join(q.withColumnRenamed("stressor", "_s"), F.col("stressor").eqNullSafe(F.col("_s")), "left").drop("_s"), "baseline")
    if out.isEmpty():
        raise ValueError("no usable non-transfected cells to take the baseline from")
    return out


def baseline_diagnostics(cells: DataFrame) -> DataFrame:
    """Non-transfected medians per dose and condition, rows without a dose left out."""
    nt = cells.where((F.col("strain") == "nt") & E.usable()).na.drop(subset=["stressor", "dose_uM", "condition_id"])
    return (
        nt.groupBy("stressor", "dose_uM", "condition_id")
        .agg(F.count("*").alias("n_cells"), E.median("measurement_time_hours").alias("time_h"), *(E.median(per_second_name(ch)).alias(f"median_{ch}") for ch in CHANNELS))
        .orderBy("stressor", "dose_uM", "time_h")
    )


def subtract_baseline(cells: DataFrame, base: DataFrame) -> DataFrame:
    """green_af and red_af: per-second intensity minus the stressor's baseline; a stressor without one is refused.

    The baseline has one row per stressor; Spark broadcasts it while it is below its threshold and joins it otherwise.
    """
    b = base.select("stressor", *(f"baseline_{ch}" for ch in CHANNELS))
    X.expect_none(cells.where("stressor <> 'none'").select("stressor").distinct().join(b, "stressor", "left_anti"), "stressor", "no baseline for stressors")
    out = cells.join(b, "stressor", "left").withColumns({f"{ch}_af": F.col(per_second_name(ch)) - F.col(f"baseline_{ch}") for ch in CHANNELS})
    return out.select(*cells.columns, *(f"{ch}_af" for ch in CHANNELS))


def field_summaries(cells: DataFrame) -> DataFrame:
    """Medians of usable cells per field."""
    use = cells.where(E.usable() & (F.col("stressor") != "none"))
    return use.groupBy(*FIELD_KEYS).agg(F.count("*").alias("n_cells"), E.median("measurement_time_hours").alias("time_h"), *(E.median(f"{ch}_af").alias(f"{ch}_af") for ch in CHANNELS))


def timecourse(fields: DataFrame, ratio_floor: float = 0.0) -> DataFrame:
    """One point per sample and time: the median of its fields' medians, and the ratio where both channels pass the floor."""
    t = fields.groupBy(*CURVE_KEYS, "condition_id").agg(
        E.median("time_h").alias("time_h"), F.count("*").alias("n_fields"), F.sum("n_cells").alias("n_cells"), E.median("green_af").alias("green"), E.median("red_af").alias("red")
    )
    return t.withColumn("ratio", E.guarded_ratio(F.col("red"), F.col("green"), ratio_floor)).orderBy(*CURVE_KEYS, "time_h")


def positive_thresholds(cells: DataFrame, q: float = 0.9) -> DataFrame:
    """(stressor, green_limit, red_limit): quantiles of usable non-transfected cells."""
    nt = cells.where((F.col("strain") == "nt") & E.usable())
    names = {per_second_name(ch): (f"{ch}_limit",) for ch in CHANNELS}
    return staged(wide(group_quantiles(nt, ["stressor"], list(names), (q,)), ["stressor"], names), "limits")


def _positive() -> Column:
    return F.coalesce((F.col(per_second_name("green")) > F.col("green_limit")) & (F.col(per_second_name("red")) > F.col("red_limit")), F.lit(False))


def reporter_positive(cells: DataFrame, q: float = 0.9, limits: DataFrame | None = None) -> DataFrame:
    """Transfected cells above both thresholds, and all non-transfected ones."""
    joined = cells.join(limits if limits is not None else positive_thresholds(cells, q), "stressor", "left")
    return joined.where(~F.coalesce(F.col("strain") == "tr", F.lit(False)) | _positive()).select(cells.columns)


def field_features(cells: DataFrame, q: float = 0.9, min_cells: int = 20, min_positive: int = 5, limits: DataFrame | None = None) -> DataFrame:
    """Decoder input: one row per transfected field with enough usable cells."""
    limits = limits if limits is not None else positive_thresholds(cells, q)
    use = cells.where(E.usable() & (F.col("strain") == "tr")).join(limits, "stressor").withColumn("pos", _positive())
    use = use.na.drop(subset=["session_id", "condition_id", "sample_id"])
    enough = F.count_if("pos") >= min_positive
    first = lambda c: F.min(c).alias(c)  # noqa: E731  one value per field
    return (
        use.groupBy("session_id", "condition_id", "sample_id")
        .agg(
            first("day"), first("stressor"), first("dose_uM"),
            E.median("measurement_time_hours").alias("time_h"),
            F.count("*").alias("n_cells"), F.count_if("pos").alias("n_positive"),
            E.median("green_af").alias("green"), E.median("red_af").alias("red"),
            F.avg(F.col("pos").cast("double")).alias("positive"),
            F.when(enough, E.median(F.when(F.col("pos"), F.col("green_af")))).alias("green_pos"),
            F.when(enough, E.median(F.when(F.col("pos"), F.col("red_af")))).alias("red_pos"),
        )
        .where(F.col("n_cells") >= min_cells)
    )


def sample_points(cells: DataFrame) -> DataFrame:
    """Transfected samples per condition with their time and their sorted distinct fields."""
    use = cells.where(E.usable() & (F.col("strain") == "tr")).na.drop(subset=["session_id", "day", "stressor", "dose_uM", "condition_id"])
    return use.groupBy("session_id", "day", "stressor", "dose_uM", "condition_id").agg(E.median("measurement_time_hours").alias("time_h"), F.array_sort(F.collect_set("sample_id")).alias("samples"))


def imaging_times(cells: DataFrame) -> DataFrame:
    """(session_id, dose_uM, times_h): distinct times to 3 decimals inside the range of the session's 0 µM times, of which there must be two."""
    use = cells.where(E.usable() & (F.col("strain") == "tr") & (F.col("stressor") != "none"))
    p = use.groupBy("session_id", "dose_uM", "condition_id").agg(E.median("measurement_time_hours").alias("t"))
    control = p.where("dose_uM = 0").groupBy("session_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("t").alias("n")).where("n >= 2")
    inside = p.where("dose_uM > 0").join(control, "session_id").where("t between lo and hi")
    return inside.groupBy("session_id", "dose_uM").agg(F.array_sort(F.collect_set(F.bround("t", 3))).alias("times_h"))


def mark_unknown_culture(cells: DataFrame, stressor: str, base: DataFrame) -> DataFrame:
    """Labels for a new culture: the given stressor, transfected, a dose only where the condition's name has one."""
    pattern = rf"^{stressor}_(\d+(?:\.\d+)?)uM(?:_|$)"
    out = cells.withColumns({"stressor": F.lit(stressor), "strain": F.lit("tr"), "day": F.col("session_id"), "dose_uM": E.part(F.col("condition_id"), pattern, 1).cast("double")})
    return subtract_baseline(out, base)


def hide_doses(cells: DataFrame, session: str, hide_time: bool = False) -> DataFrame:
    """One session under codes: conditions become unknown_1, unknown_2, ... in order of dose and name; 0 µM keeps its name."""
    from pyspark.sql import Window

    one = cells.where(F.col("session_id") == session)
    conditions = one.select("condition_id").distinct().withColumn("dose", E.part(F.col("condition_id"), E.CONDITION_ID, 2).cast("double"))
    code = F.dense_rank().over(Window.orderBy(F.col("dose").asc_nulls_last(), "condition_id"))
    codes = conditions.where(~F.coalesce(F.col("dose") == 0, F.lit(False))).withColumn("code", F.concat(F.lit("unknown_"), code.cast("string"))).select("condition_id", "code")
    out = one.join(codes, "condition_id", "left").withColumn("condition_id", F.coalesce("code", "condition_id"))
    if hide_time:
        out = out.withColumn("measurement_time_hours", F.lit(None).cast("double"))
    return out.select(cells.columns)
