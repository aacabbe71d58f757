"""Bootstrap operators.

Replicates are spread over tasks by point (a day's condition); each point draws from a generator seeded by the seed and the point's
keys, so results do not depend on how the data is partitioned.  A point's fields are a few sorted arrays.  What a replicate takes
from a field, its redrawn cells' median or share, is drawn from that value's own distribution, so a draw costs the same however many cells a field has.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..sources.work import staged
from . import interpolation as I
from . import signals as S
from . import stats

READOUTS = ("green", "red", "positive")
#: Fixed value: smallest effect found with 80 % power at 5 %, in standard errors.
Z_MDE = 1.96 + 0.84


def sorted_cells(c: str) -> Column:
    """A column's values in order, nulls and NaN left out."""
    return F.array_sort(F.collect_list(E.clean(F.col(c))))


def field_arrays(cells: DataFrame, q: float = 0.9) -> DataFrame:
    """Transfected fields with their cells' values: green and red as sorted arrays, and the numbers of positive ones and of all."""
    limits = S.positive_thresholds(cells, q)
    keys = ["session_id", "day", "stressor", "dose_uM", "condition_id", "sample_id"]
    use = cells.where(E.usable() & (F.col("strain") == "tr")).join(limits, "stressor").na.drop(subset=keys)
    return use.groupBy(*keys).agg(sorted_cells("green_af").alias("green"), sorted_cells("red_af").alias("red"), F.count_if(S._positive()).alias("positive"), F.count("*").alias("n"))


def point_values(cells: DataFrame, q: float = 0.9) -> DataFrame:
    """(session_id, day, stressor, dose_uM, condition_id, time_h, readout, value): medians of field medians, and means of field shares.

    A value that is not a number makes its field's and its point's median null, as the resampled ones would be.
    """
    limits = S.positive_thresholds(cells, q)
    keys = ["session_id", "day", "stressor", "dose_uM", "condition_id"]
    use = cells.where(E.usable() & (F.col("strain") == "tr")).join(limits, "stressor").na.drop(subset=[*keys, "sample_id"]).withColumn("pos", S._positive().cast("double"))
    whole = lambda c: F.when(F.count_if(F.col(c).isNull()) == 0, E.median(c))
    fields = use.groupBy(*keys, "sample_id").agg(whole("green_af").alias("green"), whole("red_af").alias("red"), F.avg("pos").alias("positive"))
    times = use.groupBy(*keys).agg(E.median("measurement_time_hours").alias("time_h"))
    points = fields.groupBy(*keys).agg(whole("green").alias("green"), whole("red").alias("red"), F.avg("positive").alias("positive")).join(times, keys)
    # A row for each condition and readout, which what follows reads several times.
    return staged(points.unpivot([*keys, "time_h"], list(READOUTS), "readout", "value"), "points")


def _seed(seed: int, *names: object) -> np.random.Generator:
    return np.random.default_rng([seed, *(crc32(str(n).encode()) for n in names)])


def redrawn_medians(values: np.ndarray, n: int, count: int, rng: np.random.Generator) -> np.ndarray:
    """Medians of ``count`` redraws of n cells, of which ``values`` (sorted) are known; NaN where a redraw holds a missing one.

    A redrawn cell's place is floor(m * u), u uniform, which keeps order; so the k-th smallest of n redrawn cells is the value at the place of
    the k-th smallest of n uniform numbers, a beta variable, and the one after it lies a beta share of the rest above.
    """
    m = len(values)
    if not m:
        return np.full(count, np.nan)
    k = (n + 1) // 2
    u = rng.beta(k, n - k + 1, count)
    at = lambda u: values[np.minimum((m * u).astype(np.int64), m - 1)]
    out = at(u)
    if n % 2 == 0:
        out = (out + at(u + (1 - u) * rng.beta(1, n - k, count))) / 2
    if n > m:
        out[rng.binomial(n, (n - m) / n, count) > 0] = np.nan
    return out


def redraw(fields: list[dict], readouts: tuple[str, ...], count: int, rng: np.random.Generator) -> np.ndarray:
    """(count, fields, readouts): per replicate as many fields as there are, drawn with replacement, each with its cells redrawn.

    Green and red get medians, positive a share.  Readouts share a replicate's fields; within a field each is drawn by itself, as no
    result compares readouts.
    """
    m = len(fields)
    picks = rng.integers(0, m, (count, m))
    out = np.empty((count, m, len(readouts)))
    for j, f in enumerate(fields):
        where = picks == j
        size, n = int(where.sum()), int(f["n"])
        for k, name in enumerate(readouts):
            out[where, k] = rng.binomial(n, f[name] / n, size) / n if name == "positive" else redrawn_medians(np.asarray(f[name], float), n, size, rng)
    return out


def point_replicates(fields: DataFrame, times: DataFrame, n_boot: int, seed: int, readouts: tuple[str, ...] = READOUTS) -> DataFrame:
    """(session_id, dose_uM, condition_id, time_h, replicate, readout, value): fields redrawn within points, cells within fields.

    All doses of a session share a replicate's draws of a point, so that its effects have one control.
    """
    rows = fields.join(times, ["session_id", "condition_id"])

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        point = pdf.sort_values("sample_id").to_dict("records")
        session, dose, condition, t = (point[0][c] for c in ("session_id", "dose_uM", "condition_id", "time_h"))
        v = redraw(point, readouts, n_boot, _seed(seed, session, dose, condition))
        values = [v[:, :, k].mean(1) if name == "positive" else np.median(v[:, :, k], axis=1) for k, name in enumerate(readouts)]
        return pd.DataFrame({"session_id": session, "dose_uM": dose, "condition_id": condition, "time_h": t, "replicate": np.tile(np.arange(n_boot), len(readouts)), "readout": np.repeat(readouts, n_boot), "value": np.concatenate(values)})

    return rows.groupBy("session_id", "dose_uM", "condition_id").applyInPandas(draw, "session_id string, dose_uM double, condition_id string, time_h double, replicate long, readout string, value double")


def induction_table(cells: DataFrame, n_boot: int = 500, seed: int = 0, q: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(effects, trend) of each dose against the same day's 0 µM, with intervals, smallest detectable effects and false discovery rates."""
    points = point_values(cells, q)
    observed = I.effects(points)
    times = points.select("session_id", "condition_id", "time_h").distinct()
    # Replicates are drawn once: controls, knots and stressed points are all read from what is written.
    reps = staged(E_clean(point_replicates(field_arrays(cells, q), times, n_boot, seed)), "replicates")
    rep_effects = staged(I.effects(reps, keys=("session_id", "readout", "replicate")).select("session_id", "readout", "replicate", "dose_uM", "effect"), "effects")
    keys = ["session_id", "readout", "dose_uM"]
    spread = rep_effects.groupBy(*keys).agg(*interval("effect"), F.stddev_samp("effect").alias("se"))
    meta = points.groupBy("session_id").agg(F.min("day").alias("day"), F.min("stressor").alias("stressor"))
    t = observed.join(spread, keys, "left").join(meta, "session_id")
    t = t.withColumn("mde", Z_MDE * F.col("se")).withColumn("ci_excludes_0", F.coalesce((F.col("ci_low") > 0) | (F.col("ci_high") < 0), F.lit(False)))
    t = stats.benjamini_hochberg(t, "p_two_sided").withColumn("detected_bh", F.coalesce(F.col("q_bh") < 0.05, F.lit(False)))
    columns = ["session_id", "day", "stressor", "dose_uM", "readout", "n_timepoints", "control_level", "effect", "ci_low", "ci_high", "se", "mde", "ci_excludes_0", "p_two_sided", "q_bh", "detected_bh"]
    effects = t.select(columns).orderBy("stressor", "day", "readout", "dose_uM")
    return effects, trend(observed, rep_effects, meta)


def E_clean(df: DataFrame) -> DataFrame:
    from ..sources.tables import nan_to_null

    return nan_to_null(df)


def interval(c: str) -> list:
    """2.5 and 97.5 % points and the two-sided p of a column of replicates."""
    p = F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    low, high = F.avg((F.col(c) <= 0).cast("double")), F.avg((F.col(c) >= 0).cast("double"))
    return [p[0].alias("ci_low"), p[1].alias("ci_high"), stats.bootstrap_p(low, high, F.count(c)).alias("p_two_sided")]


def trend(observed: DataFrame, rep_effects: DataFrame, meta: DataFrame) -> DataFrame:
    """Slope of the effect on log10 dose per day and readout with at least three doses; empty where no day has so many."""
    x = F.log10("dose_uM")
    o = observed.groupBy("session_id", "readout").agg(F.count("*").alias("n_doses"), F.regr_slope("effect", x).alias("slope_per_log10_dose")).where("n_doses >= 3")
    r = rep_effects.join(o.select("session_id", "readout", "n_doses"), ["session_id", "readout"])
    r = r.groupBy("session_id", "readout", "replicate", "n_doses").agg(F.count("effect").alias("n"), F.regr_slope("effect", x).alias("slope")).where("n = n_doses")
    s = r.groupBy("session_id", "readout").agg(*interval("slope"))
    t = stats.benjamini_hochberg(o.join(s, ["session_id", "readout"], "left").join(meta, "session_id"), "p_two_sided")
    return t.select("session_id", "day", "stressor", "readout", "n_doses", "slope_per_log10_dose", "ci_low", "ci_high", "p_two_sided", "q_bh").orderBy("stressor", "day", "readout")


def data_fold(cells: DataFrame, n_boot: int = 1000, seed: int = 0, q: float = 0.9) -> DataFrame:
    """Fold of reporter-positive cells over the same day's 0 µM; a control level that is not positive is refused."""
    from .expect import expect

    effects, _ = induction_table(S.reporter_positive(cells, q), n_boot, seed, q)
    e = effects.where(F.col("readout").isin("green", "red"))
    expect(e, {"reporter-positive cells without stress do not exceed the baseline": F.col("control_level") <= 0})
    level = F.col("control_level")
    return e.select(
        "session_id", "day", "stressor", "dose_uM", "readout", "n_timepoints", "control_level", (1 + F.col("effect") / level).alias("fold"),
        (1 + F.col("ci_low") / level).alias("fold_ci_low"), (1 + F.col("ci_high") / level).alias("fold_ci_high"), (F.col("mde") / level).alias("fold_mde"), "q_bh",
    )


def compare_folds(data: DataFrame, model: DataFrame) -> DataFrame:
    """Measured and modelled folds of the same day, dose and readout; whether the model lies in the measured interval."""
    t = data.join(model.drop("stressor"), ["session_id", "dose_uM", "readout"])
    inside = (F.col("model_fold") >= F.col("fold_ci_low")) & (F.col("model_fold") <= F.col("fold_ci_high"))
    t = t.withColumn("model_inside_ci", F.coalesce(inside, F.lit(False))).withColumn("model_over_data", F.try_divide("model_fold", "fold"))
    return t.orderBy("stressor", "day", "readout", F.col("clearance_per_h").asc_nulls_first(), "dose_uM")


def bootstrap_peaks(cells: DataFrame, n_boot: int = 500, seed: int = 0) -> DataFrame:
    """(session_id, dose_uM, channel, replicate share and interval of the peak time) per curve, fields and cells redrawn."""
    use = cells.where(E.usable() & (F.col("stressor") != "none"))
    curve = S.timecourse(S.field_summaries(cells))
    fields = use.groupBy("session_id", "dose_uM", "condition_id", "sample_id").agg(sorted_cells("green_af").alias("green"), sorted_cells("red_af").alias("red"), F.count("*").alias("n"))
    reps = E_clean(point_replicates(fields, curve.select("session_id", "condition_id", "time_h"), n_boot, seed, ("green", "red"))).withColumnRenamed("readout", "channel")
    long = curve.unpivot(["session_id", "dose_uM", "time_h"], ["green", "red"], "channel", "value")
    observed = stats.peaks(long, ["session_id", "dose_uM", "channel"], "time_h", "value")
    p = stats.peaks(reps, ["session_id", "dose_uM", "channel", "replicate"], "time_h", "value")
    p = p.select("session_id", "dose_uM", "channel", F.col("t_peak").alias("rt"), F.col("t_max_sampled").alias("rs"))
    joined = p.join(observed.select("session_id", "dose_uM", "channel", "t_max_sampled"), ["session_id", "dose_uM", "channel"])
    spread = joined.groupBy("session_id", "dose_uM", "channel").agg(
        F.percentile("rt", 0.05).alias("t_peak_p05"), F.percentile("rt", 0.95).alias("t_peak_p95"), F.avg((F.col("rs") == F.col("t_max_sampled")).cast("double")).alias("share_at_sampled_max")
    )
    ends = long.where("value is not null").groupBy("session_id", "dose_uM", "channel").agg((F.max("value") - F.min_by("value", "time_h")).alias("rise_from_first"), F.min("time_h").alias("t_first"), F.max("time_h").alias("t_last"))
    return observed.join(spread, ["session_id", "dose_uM", "channel"], "left").join(ends, ["session_id", "dose_uM", "channel"])


def bootstrap_median(df: DataFrame, keys: list[str], value: str, n: int = 2000, seed: int = 0, least: int = 5) -> DataFrame:
    """(keys, n_values, median, ci_low, ci_high): simple bootstrap of a median; intervals are null below ``least`` values."""
    names = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(pdf[value].dropna().to_numpy(float))
        row = {k: pdf[k].iloc[0] for k in keys} | {"n_values": len(v), "median": float(np.median(v)) if len(v) else None, "ci_low": None, "ci_high": None}
        if len(v) >= least:
            rng = _seed(seed, *(row[k] for k in keys))
            m = np.concatenate([np.median(v[rng.integers(0, len(v), (min(100, n - i), len(v)))], axis=1) for i in range(0, n, 100)])
            row["ci_low"], row["ci_high"] = map(float, np.percentile(m, [2.5, 97.5]))
        return pd.DataFrame([row])

    return df.select(*keys, value).groupBy(*keys).applyInPandas(draw, f"{names}, n_values long, median double, ci_low double, ci_high double")
