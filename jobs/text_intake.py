"""Take text records in as they arrive: check each against the rules, refuse with reasons, recognise texts taken before.

    python -m jobs.text_intake --input FOLDER --output FOLDER --checkpoint FOLDER [--config FILE]

``input`` holds the table's Parquet files, and more may be added.  A file stream with a checkpoint takes only files that no earlier run took,
and ends when there are none left.  Records go to ``output/records`` in folders by batch and status (accepted, refused, repeat); a batch that
is run again after a failure overwrites its own folders.  ``output/issues`` then tells for every rule how many records break it, and the first of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.operators import checks

from .common import command_line, log, read_config

KEYS = {"table", "id", "text", "keep", "listed", "max_files", "rules"}
WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"
#: The rest of a line of a table from its first bar on; nothing before a bar is tried, so a long line without bars is passed once.
TABLE_LINE = r"\|[^\n|]*\|[^\n]*"
ISSUES = "array<struct<level:string,column:string,rule:string>>"


def describe(records: DataFrame, config: dict) -> DataFrame:
    """Records with their counts, digest and issues, without the text: a null text has no words; a record delivered several times is one.

    Deliveries that agree in id and text but in no other column give the one that sorts first.
    """
    text = F.coalesce(F.col(config["text"]), F.lit(""))
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    counted = records.withColumns({"n_words": count(WORD), "n_symbols": count(SYMBOL), "n_table_lines": count(TABLE_LINE)})
    judged = checks.judge(counted, checks.rules_from(config["rules"]))
    light = judged.select(F.col(config["id"]).alias("id"), F.sha2(text.cast("binary"), 256).alias("digest"), *config["keep"], "n_words", "n_symbols", "n_table_lines", "issues")
    rest = [c for c in light.columns if c not in ("id", "digest")]
    once = light.groupBy("id", "digest").agg(F.count("*").alias("deliveries"), F.min(F.struct(*rest)).alias("r"))
    return once.select("id", "digest", "deliveries", "r.*")


def with_status(described: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """Refused with an error; else a repeat if its text was accepted earlier or under a smaller id now; else accepted."""
    bad = checks.refused()
    first = described.where(~bad).groupBy("digest").agg(F.min("id").alias("first_id"))
    if earlier is None:
        first = first.withColumn("taken_as", F.lit(None).cast(dict(described.dtypes)["id"]))
    else:
        first = first.join(earlier.where("status = 'accepted'").select("digest", F.col("id").alias("taken_as")), "digest", "left")
    joined = described.join(first, "digest", "left")
    status = F.when(bad, "refused").when(F.col("taken_as").isNotNull() | (F.col("id") != F.col("first_id")), "repeat").otherwise("accepted")
    same_as = F.when(status == "repeat", F.coalesce("taken_as", "first_id"))
    return joined.withColumns({"same_as": same_as, "status": status}).drop("first_id", "taken_as")


def run(spark: SparkSession, input: str, output: str, checkpoint: str, config: str | None = None) -> dict[str, int]:
    """Take what is new; counts by status of this run."""
    c = read_config(spark, "text_intake.json", config, KEYS)
    schema = spark.read.parquet(input).schema
    taken: dict[str, int] = {}

    def take(batch: DataFrame, number: int) -> None:
        records = f"{output}/records"
        earlier = None
        if number:
            earlier = spark.read.parquet(records).where(F.col("batch") < number)
        out = with_status(describe(batch, c), earlier).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "status").parquet(records)
        wrote = spark.read.schema("deliveries long, batch int, status string").parquet(records).where(F.col("batch") == number)
        for r in wrote.groupBy("status").agg(F.count("*").alias("n"), F.sum("deliveries").alias("rows")).orderBy("status").collect():
            log.info("batch %d: read %d rows, wrote %d records as %s", number, r["rows"], r["n"], r["status"])
            taken[r["status"]] = taken.get(r["status"], 0) + r["n"]

    # As a pattern a path may be a folder that grows or a single file.
    path = input.rstrip("/")
    files = f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", c["max_files"]).parquet(files)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if taken:
        issues = checks.tally(spark.read.parquet(f"{output}/records"), "id", c["listed"])
        issues.write.mode("overwrite").partitionBy("level").parquet(f"{output}/issues")
    log.info("took %s from %s into %s", taken or "nothing new", input, output)
    return taken


if __name__ == "__main__":
    command_line(__doc__.split("\n")[0], run, "input", "output", "checkpoint")
