"""Report the time courses of all cultures: medians by field and sample, excess over the same day's control, and peaks.

    python -m jobs.culture_report --input TABLE --output FOLDER [--config FILE]

``input`` is a Parquet table; the configuration's ``projection`` is the SQL that makes cells of its rows (``FROM {rows}``), by default that
for line items.  Cells that break a rule of level error are left out and counted in ``output/refused``.  ``output/curves`` holds a folder for
each stressor and day; a run overwrites the folders of the days that it reports (``days``; all, where that is null) and no others, so it
can be run again at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.operators import checks, signals, stats
from cytoframe.operators.interpolation import interpolate_join
from cytoframe.plans.queries import CELLS
from cytoframe.sources.work import staged

from .common import command_line, log, read_config

KEYS = {"projection", "days", "min_cells", "rules"}


def fields_of(cells: DataFrame) -> DataFrame:
    """Medians by field of labelled cells, after the stressor's autofluorescence is taken off."""
    c = signals.add_per_second(signals.with_labels(cells))
    return staged(signals.field_summaries(signals.subtract_baseline(c, signals.baseline(c))), "fields")


def curves_of(fields: DataFrame, min_cells: int) -> DataFrame:
    """One row per sample and time: medians, thin fields, excess over the day's interpolated 0 µM culture (null outside its times), and whether it is the peak."""
    curves = signals.timecourse(fields)
    thin = fields.groupBy("session_id", "condition_id").agg(F.count_if(F.col("n_cells") < min_cells).alias("n_thin"))
    curves = curves.join(thin, ["session_id", "condition_id"])
    control = curves.where("dose_uM = 0").groupBy("session_id", "time_h").agg(F.avg("green").alias("green"), F.avg("red").alias("red"))
    for ch in signals.CHANNELS:
        curves = interpolate_join(curves, control, ["session_id"], t="time_h", v=ch, at="time_h", out=f"control_{ch}")
        curves = curves.withColumn(f"excess_{ch}", F.when(F.col("dose_uM") != 0, F.col(ch) - F.col(f"control_{ch}"))).drop(f"control_{ch}")
    top = stats.peaks(curves, ["session_id", "dose_uM"], "time_h", "green").select("session_id", "dose_uM", F.col("t_max_sampled").alias("top"))
    return curves.join(top, ["session_id", "dose_uM"], "left").withColumn("peak", F.coalesce(F.col("time_h") == F.col("top"), F.lit(False))).drop("top")


def run(spark: SparkSession, input: str, output: str, config: str | None = None) -> dict[str, int]:
    """Cells read and refused, and rows written."""
    c = read_config(spark, "culture_report.json", config, KEYS)
    projection = c["projection"] or CELLS.replace("FROM lineitem", "FROM {rows}")
    judged = checks.judge(spark.sql(projection, rows=spark.read.parquet(input)), checks.rules_from(c["rules"]))
    issues = checks.tally(judged, "cell_id")
    issues.write.mode("overwrite").partitionBy("level").parquet(f"{output}/refused")
    curves = curves_of(fields_of(judged.where(~checks.refused()).drop("issues")), c["min_cells"])
    if c["days"]:
        curves = curves.where(F.col("day").isin(*c["days"]))
    folder = f"{output}/curves"
    curves.repartition("stressor", "day").sortWithinPartitions("session_id", "dose_uM", "time_h").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stressor", "day").parquet(folder)
    n, bad = judged.agg(F.count("*"), F.count_if(checks.refused())).first()
    log.info("read %d cells from %s, refused %d", n, input, bad)
    wrote = spark.read.parquet(folder)
    if c["days"]:
        wrote = wrote.where(F.col("day").cast("string").isin(*c["days"]))
    rows = 0
    for r in wrote.groupBy("stressor").agg(F.count("*").alias("n"), F.countDistinct("day").alias("days")).orderBy("stressor").collect():
        log.info("wrote %d rows of %s over %d days to %s", r["n"], r["stressor"], r["days"], folder)
        rows += r["n"]
    return {"read": n, "refused": bad, "wrote": rows}


if __name__ == "__main__":
    command_line(__doc__.split("\n")[0], run, "input", "output")
