"""Small checked artifacts: digests, session and snapshot calibrations, provenance; all on the driver."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
from collections.abc import Iterable
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import matching

REFERENCE_KEYS = ("variant", "profile", "model_sha256", "solver", "initial_state", "f", "eps")


def canonical(value: object) -> str:
    """Compact JSON with sorted keys; numbers that are not finite are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value: dict) -> str:
    """SHA-256 of the artifact without its own id."""
    return hashlib.sha256(canonical({k: v for k, v in value.items() if k != "artifact_id"}).encode()).hexdigest()


def seal(value: dict) -> dict:
    return {**value, "artifact_id": digest(value)}


def opened(value: dict, kind: str) -> dict:
    """The artifact, if it is of the kind and unchanged since it was sealed."""
    if value.get("kind") != kind:
        raise ValueError(f"not a {kind} artifact")
    if value.get("artifact_id") != digest(value):
        raise ValueError(f"modified {kind} artifact")
    return value


def numbers(values: Iterable[object], name: str, *, positive: bool = False) -> list[float]:
    """A non-empty list of finite numbers that are not negative, or positive; booleans are no numbers."""
    values = list(values)
    bad = [v for v in values if isinstance(v, bool) or not isinstance(v, (int, float)) or not v - v == 0 or v < 0 or positive and v == 0]
    if not values or bad:
        raise ValueError(f"{name} must be finite and {'positive' if positive else 'not negative'} numbers")
    return [float(v) for v in values]


def reference_id(metadata: dict) -> str:
    """Identity of the model that a calibration refers to."""
    if missing := [k for k in REFERENCE_KEYS if k not in metadata]:
        raise ValueError(f"missing metadata: {missing}")
    return hashlib.sha256(canonical({k: metadata[k] for k in REFERENCE_KEYS}).encode()).hexdigest()


def check_compatible(table: dict, reference: dict) -> None:
    """Refuse a table and a calibration that come from different models or settings; the error names what differs."""
    if differs := [k for k in REFERENCE_KEYS if table.get(k) != reference.get(k)]:
        raise ValueError(f"table and reference differ in {differs}")


def session_calibration(session_id: str, reference: str, image: Iterable[float], model: Iterable[float], source_kind: str, source: str) -> dict:
    """Scale of image to model ratios: least squares through the origin over at least three pairs."""
    if source_kind not in ("synthetic", "experimental_reference"):
        raise ValueError("source_kind is neither synthetic nor experimental_reference")
    y, x = numbers(image, "image ratios", positive=True), numbers(model, "model ratios", positive=True)
    if len(x) != len(y) or len(x) < 3:
        raise ValueError("at least three pairs are needed")
    c = sum(a * b for a, b in zip(x, y, strict=True)) / sum(a * a for a in x)
    rmse = (sum((b - c * a) ** 2 for a, b in zip(x, y, strict=True)) / len(x)) ** 0.5
    return seal({"kind": "session_calibration", "session_id": session_id, "reference_id": reference, "image_ratios": y, "model_ratios": x, "c_session": c, "rmse": rmse, "source_kind": source_kind, "source": source})


def open_session_calibration(value: dict) -> dict:
    """Checked by its digest and by fitting it again from its own pairs."""
    v = opened(value, "session_calibration")
    again = session_calibration(v["session_id"], v["reference_id"], v["image_ratios"], v["model_ratios"], v["source_kind"], v["source"])
    if abs(again["c_session"] - v["c_session"]) > 1e-12 * abs(again["c_session"]):
        raise ValueError("calibration does not follow from its pairs")
    return v


def calibration_table(spark, calibrations: Iterable[dict]) -> DataFrame:
    """Calibrations as the table that ``summarize_cells`` joins, one row per session."""
    rows = [(c["session_id"], c["reference_id"], float(c["c_session"]), c["source_kind"], c["source"]) for c in map(open_session_calibration, calibrations)]
    return spark.createDataFrame(rows, "session_id string, reference_id string, c_session double, source_kind string, source string")


def snapshot_calibrations(sessions: DataFrame, grid: DataFrame) -> DataFrame:
    """Sessions (session_id, artifact_id, c_session, low_dose, low_time, image_low, high_dose, high_time, image_high) with the model's green at both anchors.

    Each anchor must be one node of the grid, and the high ones lie above the low ones in image and model alike.
    """
    from .expect import expect

    g = grid.select("artifact_id", "dose_uM", "time_h", "green")
    out = sessions
    for end in ("low", "high"):
        p = out.select("session_id", "artifact_id", F.col(f"{end}_dose").alias("dose_uM"), F.col(f"{end}_time").alias("at"))
        hit = p.join(g, ["artifact_id", "dose_uM"], "left").withColumn("hit", F.coalesce(F.abs(F.col("time_h") - F.col("at")) <= 1e-12, F.lit(False)))
        n = hit.groupBy("session_id").agg(F.count_if("hit").alias("n"), F.max(F.when(F.col("hit"), F.col("green"))).alias(f"model_{end}"))
        expect(n, {f"{end} anchor must be one grid node": F.col("n") != 1})
        out = out.join(n.drop("n"), "session_id")
    expect(out, {"image anchors must increase": ~(F.col("image_high") > F.col("image_low")), "model anchors must increase": ~(F.col("model_high") > F.col("model_low")), "c_session must be positive": ~(F.col("c_session") > 0)})
    return out.select("session_id", "artifact_id", "c_session", "image_low", "image_high", "model_low", "model_high")


def replicate_noise(replicates: DataFrame) -> tuple[float, float, float]:
    """(xx, xy, yy): covariance of log ratio and normalised green within conditions, pooled.

    Rows (condition_id, biological_replicate_id, specimen_id, log_ratio, green_norm): at least three different cultures per
    condition, no culture twice; the result must be positive definite and well conditioned.
    """
    from .expect import expect, expect_unique
    from .stats import pooled_covariance

    expect_unique(replicates, ["biological_replicate_id"], "a culture occurs twice")
    expect_unique(replicates, ["specimen_id"], "a specimen occurs twice")
    expect(replicates.groupBy("condition_id").count(), {"a condition has fewer than three cultures": F.col("count") < 3})
    r = pooled_covariance(replicates, ["condition_id"], "log_ratio", "green_norm").first()
    half, det = (r.xx + r.yy) / 2, r.xx * r.yy - r.xy * r.xy
    root = max(half * half - det, 0.0) ** 0.5
    if not (det > 0 and half - root > 0 and (half + root) / (half - root) <= 1e12):
        raise ValueError("the covariance is not positive definite or is badly conditioned")
    return r.xx, r.xy, r.yy


def at_anchor(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Points (artifact_id, dose_uM, time_h) with the grid's values at exactly one node each."""
    return matching.tolerance_lookup(points, grid, ["artifact_id", "dose_uM"], "time_h")


def provenance(folder: str) -> dict[str, object]:
    """Versions, and the state of the code's repository where there is one."""
    git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True).stdout.strip()
    return {"python": platform.python_version(), "spark": pyspark.__version__, "commit": git("rev-parse", "HEAD") or None, "changed": bool(git("status", "--porcelain"))}


def fingerprints(paths: Iterable[str]) -> dict[str, str]:
    """SHA-256 of small files on the driver; ``sources.tables.file_fingerprints`` hashes many where they lie."""
    return {p: hashlib.sha256(Path(p).read_bytes()).hexdigest() for p in paths}


def unchanged(before: dict[str, str]) -> None:
    """Refuse inputs that changed during a run."""
    if changed := [p for p, h in fingerprints(before).items() if before[p] != h]:
        raise ValueError(f"inputs changed during the run: {changed}")
