"""Cell tables, manifests and artifacts: schemas, readers and writers.

Readers never infer a schema.  Writers refuse an existing path, and Spark's commit protocol publishes a result as a whole.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as E

#: Columns of the cell table in order, with their kinds.
CELL_COLUMNS = {
    "session_id": "string", "timepoint": "long", "cell_id": "long", "area_px": "long", "edge_flag": "boolean",
    "raw_mean_green": "double", "raw_mean_red": "double", "corrected_mean_green": "double", "corrected_mean_red": "double",
    "integrated_green": "double", "integrated_red": "double", "ratio_red_green": "double", "sat_flag": "boolean",
    "focus_score": "double", "registration_shift_px": "double", "lamp_flag": "boolean", "qc_pass": "boolean",
    "exposure_ms_green": "double", "exposure_ms_red": "double", "nd_filter_green": "double", "nd_filter_red": "double",
    "objective": "string", "burner_hours": "double", "lamp_warmup_minutes": "double", "acquisition_order": "long",
    "sampling_time_hours": "double", "measurement_time_hours": "double", "sample_id": "string", "condition_id": "string",
    "specimen_id": "string", "biological_replicate_id": "string", "acquisition_json": "string",
    "sat_flag_legacy": "boolean", "qc_pass_legacy_saturation": "boolean", "focus_score_green": "double", "focus_score_red": "double",
    "contrast_to_noise_green": "double", "contrast_to_noise_red": "double", "focus_agreement": "double",
    "focus_status": "string", "focus_qc_mode": "string", "mask_source": "string", "qc_reasons": "string",
}
#: What optional trailing columns hold where a table lacks them.
CELL_DEFAULTS = {"focus_status": "not_evaluated", "focus_qc_mode": "report", "mask_source": "unknown", "qc_reasons": ""}
PER_SECOND = ["corrected_mean_green", "corrected_mean_red", "integrated_green", "integrated_red"]

CELL_SCHEMA = T.StructType([T.StructField(n, {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[k]) for n, k in CELL_COLUMNS.items()])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every floating-point column with null for NaN: the one place where missing values take one form."""
    return df.withColumns({c: E.clean(F.col(c)) for c, k in df.dtypes if k in ("double", "float")})


def read_cells(spark: SparkSession, path: str, extra: dict[str, str] | None = None) -> DataFrame:
    """A cell table from CSV, plain or gzip, or Parquet.  CSV is matched by header, so optional columns may be
    missing (they get their defaults); ids stay text, so 001 survives; booleans may be true/True/1."""
    kinds = CELL_COLUMNS | (extra or {})
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        with_header = spark.read.option("header", True).csv(path, enforceSchema=False)
        df = with_header.select([F.col(f"`{c}`") for c in with_header.columns if c in kinds])
    out = {}
    for name, kind in kinds.items():
        if name not in df.columns:
            out[name] = F.lit(CELL_DEFAULTS.get(name)).cast(kind)
        elif dict(df.dtypes)[name] != "string":
            out[name] = F.col(name).cast(kind)
        elif kind == "boolean":
            out[name] = F.when(F.lower(name).isin("true", "1", "1.0"), True).when(F.lower(name).isin("false", "0", "0.0"), False)
        elif kind == "long":
            out[name] = F.col(name).try_cast("double").cast("long")
        else:
            out[name] = F.col(name).try_cast(kind) if kind == "double" else F.col(name)
    return nan_to_null(df.select([c.alias(n) for n, c in out.items()]))


def read_text_table(spark: SparkSession, path: str, required: list[str] = ()) -> DataFrame:
    """A manifest or log: every column as text, header names as they are; missing required columns are an error."""
    df = spark.read.option("header", True).csv(path)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Marked points (x, y): columns X and Y in any case, whatever else the file holds."""
    df = spark.read.option("header", True).csv(path)
    names = {c.strip().lower(): c for c in df.columns}
    if not {"x", "y"} <= names.keys():
        raise ValueError("a point table needs columns X and Y")
    return df.select(E.number(F.col(f"`{names['x']}`")).alias("x"), E.number(F.col(f"`{names['y']}`")).alias("y"))


def read_dose_table(spark: SparkSession, path: str) -> DataFrame:
    """(artifact_id, dose_uM, time_h, ratio, green) from a JSON artifact of axes and matrices; green is null where there is none."""
    doc = spark.read.option("multiLine", True).schema("artifact_id string, doses_uM array<double>, times_hours array<double>, ratios array<array<double>>, green array<array<double>>").json(path)
    rows = doc.select("artifact_id", "times_hours", "green", "ratios", F.posexplode("doses_uM").alias("i", "dose_uM"))
    cells = rows.select("artifact_id", "dose_uM", F.get("ratios", F.col("i")).alias("r"), F.get("green", F.col("i")).alias("g"), F.posexplode("times_hours").alias("j", "time_h"))
    return cells.select("artifact_id", "dose_uM", "time_h", F.get("r", F.col("j")).alias("ratio"), F.get("g", F.col("j")).alias("green"))


def read_config(path: str, allowed: set[str]) -> dict:
    """A JSON configuration; unknown keys are refused."""
    config = json.loads(Path(path).read_text(encoding="utf-8"))
    unknown = sorted(set(config) - allowed)
    if unknown:
        raise ValueError(f"unknown keys: {unknown}")
    return config


def image_pairs(spark: SparkSession, root: str) -> DataFrame:
    """(folder, stem, red_path, green_path, red_time, green_time, red_bytes, green_bytes) of a folder tree.

    Files pair by folder and name up to a trailing channel word or number; contents are not read here.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    channel = F.regexp_extract(F.lower(name), r"[_\-. ](red|green)\.[a-z0-9]+$", 1)
    stem = F.regexp_replace(name, r"(?i)[_\-. ](red|green)\.[a-z0-9]+$", "")
    f = files.select("path", "modificationTime", "length", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), stem.alias("stem"), channel.alias("channel")).where("channel <> ''")
    pick = lambda ch, c: F.max(F.when(F.col("channel") == ch, F.col(c)))
    return f.groupBy("folder", "stem").agg(
        pick("red", "path").alias("red_path"), pick("green", "path").alias("green_path"),
        pick("red", "modificationTime").alias("red_time"), pick("green", "modificationTime").alias("green_time"),
        pick("red", "length").alias("red_bytes"), pick("green", "length").alias("green_bytes"),
    )


def file_fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, sha256) of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))


def sessions(cells: DataFrame) -> DataFrame:
    """Distinct sessions with day, stressor and strain."""
    s = F.col("session_id")
    return cells.select("session_id").distinct().select("session_id", *(E.part(s, E.SESSION_ID, i + 1).alias(n) for i, n in enumerate(("day", "stressor", "strain"))))


def write_new(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] = ()) -> None:
    """Write to a path that must not exist."""
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.option("header", True).format(kind).save(path)


def concatenate(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of several part tables; their headers must be the same."""
    parts = [spark.read.option("header", True).csv(p) for p in paths]
    if any(p.columns != parts[0].columns for p in parts):
        raise ValueError("part files have different headers")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_artifact(path: str, value: dict) -> None:
    """A small JSON artifact; an existing file is refused."""
    with open(path, "x", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, allow_nan=False)
