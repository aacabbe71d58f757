"""The four-step analysis of a cell table: time course, induction, model comparison, leave-one-day-out decoding."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, interpolation, model, resampling, signals
from ..sources.tables import read_cells, write_new
from ..sources.work import staged

KEYS = {"cells", "out", "n_boot", "seed", "quantile", "steps"}


def prepare(cells: DataFrame) -> DataFrame:
    """Annotated, baseline-subtracted cells, written once for all steps."""
    c = signals.annotate(cells)
    if "corrected_mean_green_per_s" not in c.columns:
        c = signals.add_per_second(c)
    return staged(signals.subtract_baseline(c, signals.baseline(c)), "cells")


def step_timecourse(cells: DataFrame, n_boot: int, seed: int, q: float) -> dict[str, DataFrame]:
    fields = signals.field_summaries(cells)
    return {"fields": fields, "timecourse": signals.timecourse(fields), "peaks": resampling.bootstrap_peaks(cells.where("strain = 'tr'"), n_boot, seed)}


def step_induction(cells: DataFrame, n_boot: int, seed: int, q: float) -> dict[str, DataFrame]:
    effects, trend = resampling.induction_table(cells, n_boot, seed, q)
    return {"effects": effects, "trend": trend}


def step_model(cells: DataFrame, n_boot: int, seed: int, q: float) -> dict[str, DataFrame]:
    data = resampling.data_fold(cells, n_boot, seed, q)
    stressors = cells.where("strain = 'tr'").groupBy("session_id").agg(F.min("stressor").alias("stressor"))
    folds = model.model_fold(signals.imaging_times(cells), stressors)
    return {"model_folds": folds, "comparison": resampling.compare_folds(data, folds)}


def step_decoder(cells: DataFrame, n_boot: int, seed: int, q: float) -> dict[str, DataFrame]:
    fields = staged(interpolation.add_paired(signals.field_features(cells, q)), "fields")
    out: dict[str, DataFrame] = {}
    for name in ("absolute", "paired"):
        p, folds = classify.leave_one_day_out(fields, name)
        out |= {f"predictions_{name}": p, f"folds_{name}": folds, f"scores_{name}": classify.score(p)}
    return out


STEPS: dict[str, Callable[[DataFrame, int, float, float], dict[str, DataFrame]]] = {"timecourse": step_timecourse, "induction": step_induction, "model": step_model, "decoder": step_decoder}


def run_analysis(spark: SparkSession, config: dict) -> dict[str, float]:
    """Run the steps of a configuration in order and stop at the first that fails; seconds by step.

    Tables go to new folders under ``out``, and a manifest names them last.
    """
    if unknown := sorted(set(config) - KEYS):
        raise ValueError(f"unknown keys: {unknown}")
    cells = config["cells"] if isinstance(config["cells"], DataFrame) else read_cells(spark, config["cells"])
    cells = prepare(cells)
    took: dict[str, float] = {}
    written: list[str] = []
    for name in config.get("steps", list(STEPS)):
        began = time.time()
        for table, df in STEPS[name](cells, config.get("n_boot", 1000), config.get("seed", 0), config.get("quantile", 0.9)).items():
            write_new(df, f"{config['out']}/{table}")
            written.append(table)
        took[name] = time.time() - began
    manifest = spark.createDataFrame([(json.dumps({"tables": written, "seconds": took}, sort_keys=True),)], "manifest string")
    write_new(manifest.coalesce(1), f"{config['out']}/manifest", "text")
    return took


def read_config(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))
