"""Decoding of sample trajectories that must belong to their calibration: checks by trajectory, then one of three decoders in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from . import grids

MODES = ("discrete", "continuous", "joint")
KEYS = ("session_id", "sample_id", "condition_id")
#: The settings of an acquisition that its summary repeats.
SETTINGS = ("objective", "exposure_ms_green", "exposure_ms_red", "nd_filter_green", "nd_filter_red")


def trajectories(samples: DataFrame) -> DataFrame:
    """``samples`` with obs_id, one for each session, sample and condition; a null condition is a condition of its own."""
    return samples.withColumn("obs_id", F.sha2(F.to_json(F.struct(*(F.col(k).alias(k) for k in KEYS)), {"ignoreNullFields": "false"}), 256))


def check_trajectories(samples: DataFrame, calibrations: DataFrame, *, data_kind: str, min_cells: int, time: str) -> DataFrame:
    """(obs_id, KEYS, n_points, reason): one row per trajectory, and why it must not be decoded (null: it may).

    samples: rows of a population summary with reference ids and coefficients; calibrations: (session_id, reference_id, c_session, source_kind, source).
    All checks are one aggregate over the rows of a trajectory beside its session's calibration; the first that fails, in this order, is the reason.
    """
    c = calibrations.select("session_id", *(F.col(x).alias(f"_{x}") for x in ("reference_id", "c_session", "source_kind", "source")), F.lit(True).alias("_there"))
    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = trajectories(samples).repartition(n, "obs_id").join(c, "session_id", "left")
    raw, corrected, used = F.col("ratio_red_green_median"), F.col("calibrated_ratio_red_green_median"), F.col("n_cells_used")
    finite = lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))
    expected = "synthetic" if data_kind == "synthetic" else "experimental_reference"
    differs = lambda a, b: ~F.coalesce(a.eqNullSafe(b), F.lit(False))
    checks = [
        ("session or sample is blank", (F.coalesce(F.trim("session_id"), F.lit("")) == "") | (F.coalesce(F.trim("sample_id"), F.lit("")) == "")),
        ("no calibration of the session", F.col("_there").isNull()),
        ("calibration is of another kind", F.col("_source_kind") != expected),
        ("rows name another reference", differs(F.col("calibration_reference_id"), F.col("_reference_id"))),
        ("rows name another source", differs(F.col("calibration_source_kind"), F.col("_source_kind")) | differs(F.col("calibration_source"), F.col("_source"))),
        ("rows are of another kind of data", differs(F.col("data_kind"), F.lit(data_kind))),
        ("rows carry another coefficient", ~F.coalesce(E.close(F.col("c_session"), F.col("_c_session"), 1e-12, 0.0), F.lit(False))),
        ("too few cells", ~finite(used) | ~F.coalesce((used >= min_cells) & (used == F.floor(used)), F.lit(False))),
        ("ratios are missing", ~finite(raw) | ~finite(corrected)),
        ("calibrated ratio is not the ratio over the coefficient", ~F.coalesce(E.close(corrected, raw / F.col("_c_session"), 1e-8, 1e-12), F.lit(False))),
        ("times are missing", F.col(time).isNull()),
    ]
    g = j.groupBy("obs_id", *KEYS).agg(F.count("*").alias("n_points"), F.countDistinct(time).alias("_times"), *(F.bool_or(F.coalesce(cond, F.lit(False))).alias(f"_f{i}") for i, (_, cond) in enumerate(checks)))
    reason = F.coalesce(*(F.when(F.col(f"_f{i}"), F.lit(name)) for i, (name, _) in enumerate(checks)), F.when(F.col("_times") < F.col("n_points"), "a time occurs twice"))
    return g.select("obs_id", *KEYS, "n_points", reason.alias("reason"))


def decode_samples(grid: DataFrame, samples: DataFrame, calibrations: DataFrame, *, artifact_id: str, mode: str, tolerance: float, data_kind: str, min_cells: int, time: str = "measurement_time_hours", offsets: DataFrame | None = None, allowance: DataFrame | None = None) -> DataFrame:
    """(KEYS, n_points, reason, status, dose_estimate_uM, elapsed_time_hours): every trajectory, decoded where its checks allow.

    ``mode`` picks the decoder: discrete doses at the grid's times, continuous segments between them, or dose and elapsed time together, for which only
    the spacing of the recorded times counts and ``offsets`` (artifact_id, elapsed_h) is needed.  Ratios are taken as calibrated; nothing
    is calibrated again.  A refused trajectory keeps its reason and has the status ``refused``.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}, not {mode!r}")
    if (mode == "joint") != (offsets is not None):
        raise ValueError("offsets are for the joint mode, and needed there")
    if mode != "continuous" and allowance is not None:
        raise ValueError("an allowance is for the continuous mode")
    checked = check_trajectories(samples, calibrations, data_kind=data_kind, min_cells=min_cells, time=time)
    rows = trajectories(samples).select("obs_id", time, "calibrated_ratio_red_green_median").join(checked.where("reason IS NULL").select("obs_id"), "obs_id", "left_semi")
    o = rows.select("obs_id", F.lit(artifact_id).alias("artifact_id"), F.col(time).cast("double").alias("time_h"), F.col("calibrated_ratio_red_green_median").alias("ratio"), F.lit(tolerance).alias("tolerance"))
    if mode == "joint":
        first = o.groupBy("obs_id").agg(F.min("time_h").alias("_first"))
        o = o.join(first, "obs_id").withColumn("relative_h", F.col("time_h") - F.col("_first")).drop("_first", "time_h")
        found = grids.decode_joint(grid, o, offsets).select("obs_id", "status", "dose_estimate_uM", "elapsed_time_hours")
    else:
        found = grids.decode_dose(grid, o.withColumn("green", F.lit(None).cast("double"))) if mode == "discrete" else grids.decode_continuous(grid, o, allowance)
        found = found.select("obs_id", "status", "dose_estimate_uM", F.lit(None).cast("double").alias("elapsed_time_hours"))
    status = F.when(F.col("reason").isNotNull(), "refused").otherwise(F.coalesce("status", F.lit("no_grid_times")))
    return checked.join(found, "obs_id", "left").select(*KEYS, "n_points", "reason", status.alias("status"), "dose_estimate_uM", "elapsed_time_hours")


def snapshots_from_summary(summaries: DataFrame, *, method: str, source: str) -> DataFrame:
    """(session_id, specimen_id, biological_replicate_id, sample_id, timepoint, ratio, green, source, reason) of population summaries for the snapshot decoder.

    ``acquisition_json`` is read as it stands and must agree with the summary's own settings; a summary that is not ready, has another method, lacks an
    identity or has a ratio that is not above 0 has a reason, and must not be decoded.
    """
    if not source.strip():
        raise ValueError("a source must be named")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    said = F.col("acquisition_json")
    text = lambda c: F.get_json_object(said, f"$.{c}")
    agrees = F.lit(True)
    for c in SETTINGS:
        own, told = F.col(c), text(c)
        same = told.eqNullSafe(own) if c == "objective" else told.try_cast("double").eqNullSafe(own.cast("double"))
        # A setting must be there even where it is null.
        agrees = agrees & same & F.coalesce(F.array_contains(F.json_object_keys(said), c), F.lit(False))
    ratio, green = F.col("ratio_red_green_median"), F.col("corrected_green_median")
    reason = (
        F.when(~F.coalesce(F.col("summary_status") == "ready", F.lit(False)), "summary is not ready")
        .when(~F.coalesce(F.col("summary_method") == method, F.lit(False)), "summary has another method")
        .when(blank("session_id") | blank("specimen_id") | blank("biological_replicate_id"), "an identity is missing")
        .when(said.isNull(), "no acquisition settings")
        .when(~F.coalesce(agrees, F.lit(False)), "acquisition settings disagree")
        .when(~F.coalesce((ratio > 0) & (ratio < float("inf")) & (green >= 0) & (green < float("inf")), F.lit(False)), "ratio or green out of range")
    )
    return summaries.select("session_id", "specimen_id", "biological_replicate_id", "sample_id", "timepoint", ratio.alias("ratio"), green.alias("green"), F.lit(source).alias("source"), reason.alias("reason"))
