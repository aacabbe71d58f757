"""Forward model of the stress reporter: ordinary differential equations per dose, as a long response table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parameters common to both variants, and those of each.
COMMON = {"b": 4.0, "delta_w": 0.12, "a_TetR": 50.0, "k_deg_TetR": 0.12, "K_R": 0.44, "n": 4.0, "P_min": 0.0056, "mu": 0.35, "Kd": 0.25, "k_deg_TIP": 1.0, "a_Rep": 50.0, "m": 7.39, "m1": 2.46, "m2": 1.37, "k_deg_Rep": 0.01, "E": 0.173, "f": 1.0, "eps": 1e-9}
VARIANTS = {
    "ox": {"K_act": 208.0, "nh": 2.75, "beta_basal": 5.0, "beta_max": 118.0, "k_on": 50.0, "k_off": 160.0, "k_x": 1.0, "d_x": 0.5},
    "er": {"K_act": 2345.3, "nh": 3.97, "beta_basal": 0.77, "beta_max": 25.0, "k_on": 7.2, "k_off": 11.09, "k_x": 1.0, "d_x": 0.0},
}
VARIANT_OF = {"h2o2": "ox", "dtt": "er"}
STATES = ("T", "I", "C", "A", "X", "dg", "g", "dr", "im", "r", "S")
STEP, EQUILIBRATION = 1e-3, 50.0


def parameters(variant: str, **changes: float) -> dict[str, float]:
    """A complete parameter set; unknown names, and values that are no finite numbers, are refused."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant}")
    p = COMMON | VARIANTS[variant]
    if unknown := sorted(set(changes) - set(p)):
        raise ValueError(f"unknown parameters: {unknown}")
    p = p | {k: float(v) for k, v in changes.items()}
    if bad := sorted(k for k, v in p.items() if not np.isfinite(v)):
        raise ValueError(f"parameters must be finite: {bad}")
    return p


def slopes(y: np.ndarray, p: dict[str, float], clearance: float) -> np.ndarray:
    """Time derivatives; one column per run."""
    t, i, c, a, x, dg, g, dr, im, r, s = y
    free = p["P_min"] + (1 - p["P_min"]) / (1 + (np.maximum(t, 0) / p["K_R"]) ** p["n"])
    bind = p["b"] * i * t - p["Kd"] * p["b"] * c
    sn = np.maximum(s, 0) ** p["nh"]
    k = p["k_deg_Rep"] + p["mu"]
    made = p["a_Rep"] * free
    return np.stack([
        p["a_TetR"] * free - (p["mu"] + p["k_deg_TetR"]) * t - bind,
        p["beta_basal"] + (p["beta_max"] - p["beta_basal"]) * a - (p["k_deg_TIP"] + p["mu"]) * i - bind,
        bind - (p["delta_w"] + p["mu"]) * c,
        p["k_on"] * sn / (p["K_act"] ** p["nh"] + sn) * (1 - a) - p["k_off"] * a * x,
        p["k_x"] * a - p["d_x"] * x,
        made - (p["m"] + k) * dg, p["m"] * dg - k * g,
        made - (p["m1"] + k) * dr, p["m1"] * dr - (p["m2"] + k) * im, p["m2"] * im - k * r,
        -clearance * s,
    ])


def integrate(y: np.ndarray, p: dict[str, float], start: float, end: float, clearance: float, step: float) -> np.ndarray:
    """Fourth-order Runge-Kutta with equal steps of at most ``step``."""
    n = max(1, int(np.ceil((end - start) / step - 1e-9))) if end > start else 0
    h = (end - start) / n if n else 0.0
    for _ in range(n):
        k1 = slopes(y, p, clearance)
        k2 = slopes(y + h / 2 * k1, p, clearance)
        k3 = slopes(y + h / 2 * k2, p, clearance)
        y = y + h / 6 * (k1 + 2 * k2 + 2 * k3 + slopes(y + h * k3, p, clearance))
    return y


@lru_cache(32)
def resting_state(variant: str, changes: tuple[tuple[str, float], ...], hours: float, step: float, tolerance: float) -> tuple[float, ...]:
    """State after so long without stress; refused if it still drifts over the last tenth."""
    p = parameters(variant, **dict(changes))
    early = integrate(np.zeros((len(STATES), 1)), p, 0.0, 0.9 * hours, 0.0, step)
    late = integrate(early, p, 0.9 * hours, hours, 0.0, step)
    drift = np.abs(late - early) / np.maximum(np.abs(late), 1e-12)
    if drift[:-1][np.abs(late[:-1]) > 1e-9].max(initial=0.0) > tolerance:
        raise ValueError("equilibration is too short")
    return tuple(late[:, 0])


def simulate(variant: str, doses: np.ndarray, times: np.ndarray, clearance: float | None = None, step: float = STEP, equilibration: float = EQUILIBRATION, tolerance: float = 1e-2, **changes: float) -> dict[str, np.ndarray]:
    """Observables by dose (rows) and time (columns) after stress begins at rest; clearance is a first-order rate per hour."""
    times = np.asarray(times, float)
    if times.ndim != 1 or not len(times) or not np.isfinite(times).all() or (times < 0).any() or (np.diff(times) <= 0).any():
        raise ValueError("times must be finite, not negative and strictly increasing")
    p = parameters(variant, **changes)
    rest = np.array(resting_state(variant, tuple(sorted(changes.items())), equilibration, step, tolerance))
    y = np.repeat(rest[:, None], len(doses), axis=1)
    y[-1] = np.asarray(doses, float)
    out, now = [], 0.0
    for t in times:
        y = integrate(y, p, now, t, clearance or 0.0, step)
        now = t
        out.append(y)
    s = dict(zip(STATES, np.stack(out, axis=2), strict=True))
    total = s["dr"] + s["im"] + s["r"]
    green = s["g"] * (1 - s["r"] / (total + p["eps"]) * p["E"])
    return {"green": green, "red": s["r"], "ratio": p["f"] * s["r"] / (green + p["eps"]), "sensor": s["A"], "stress": s["S"]}


def response_table(spark: SparkSession, variant: str, doses: list[float], times: list[float], *, clearance: float | None = None, **options: float) -> DataFrame:
    """(artifact_id, variant, clearance_per_h, dose_uM, time_h, green, red, ratio, sensor): doses are integrated in tasks of their own."""
    artifact = f"{variant}-{clearance if clearance is not None else 'constant'}"
    rows = spark.createDataFrame([(float(d),) for d in doses], "dose_uM double").repartition(max(1, min(len(doses), int(spark.conf.get("spark.sql.shuffle.partitions")))), "dose_uM")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = b["dose_uM"].to_numpy()
                s = simulate(variant, d, np.asarray(times, float), clearance, **options)
                i, j = np.meshgrid(range(len(d)), range(len(times)), indexing="ij")
                yield pd.DataFrame({"dose_uM": d[i.ravel()], "time_h": np.asarray(times, float)[j.ravel()], **{k: s[k].ravel() for k in ("green", "red", "ratio", "sensor")}})

    t = rows.mapInPandas(run, "dose_uM double, time_h double, green double, red double, ratio double, sensor double")
    return t.select(F.lit(artifact).alias("artifact_id"), F.lit(variant).alias("variant"), F.lit(clearance).cast("double").alias("clearance_per_h"), "*")


def model_fold(times: DataFrame, session_stressors: DataFrame, clearances: tuple[float | None, ...] = (None,), run=simulate) -> DataFrame:
    """(session_id, stressor, variant, dose_uM, readout, clearance_per_h, times_h, model_fold) at each session's imaging times.

    times: (session_id, dose_uM, times_h array); stressors without a variant are left out.  ``run`` is the simulator.
    """
    spark = times.sparkSession
    scen = spark.createDataFrame([(c,) for c in clearances], "clearance_per_h double")
    j = times.join(session_stressors, "session_id").where(F.col("stressor").isin(*VARIANT_OF)).join(F.broadcast(scen))  # a stated list of scenarios

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                t = np.asarray(r["times_h"], float)
                c = None if pd.isna(r["clearance_per_h"]) else float(r["clearance_per_h"])
                v = VARIANT_OF[r["stressor"]]
                s = run(v, np.array([r["dose_uM"], 0.0]), t, c)
                for ch in ("green", "red"):
                    stressed, control = np.asarray(s[ch], float)
                    out.append((r["session_id"], r["stressor"], v, r["dose_uM"], ch, c, " ".join(f"{x:g}" for x in t), 1 + float(np.mean(stressed - control)) / float(np.mean(control))))
            yield pd.DataFrame(out, columns=["session_id", "stressor", "variant", "dose_uM", "readout", "clearance_per_h", "times_h", "model_fold"])

    return j.select("session_id", "stressor", "dose_uM", "clearance_per_h", "times_h").mapInPandas(fold, "session_id string, stressor string, variant string, dose_uM double, readout string, clearance_per_h double, times_h string, model_fold double")


def log_fold_knots(spark: SparkSession, stressor_doses: list[tuple[str, float]], clearance: float | None = None) -> DataFrame:
    """(stressor, dose_uM, t, v_green, v_red): log folds over 0 µM on a grid of 0.5 to 8 hours in quarters."""
    grid = [0.25 * i for i in range(2, 33)]
    rows = spark.createDataFrame(stressor_doses, "stressor string, dose_uM double").where(F.col("stressor").isin(*VARIANT_OF))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for stressor, d in b.groupby("stressor"):
                doses = d["dose_uM"].to_numpy()
                s = simulate(VARIANT_OF[stressor], np.append(doses, 0.0), np.array(grid), clearance)
                lf = {c: np.log(s[c][:-1] / s[c][-1]) for c in ("green", "red")}
                for i, dose in enumerate(doses):
                    yield pd.DataFrame({"stressor": stressor, "dose_uM": dose, "t": grid, "v_green": lf["green"][i], "v_red": lf["red"][i]})

    return rows.mapInPandas(run, "stressor string, dose_uM double, t double, v_green double, v_red double")
