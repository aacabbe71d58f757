"""Contracts: all rules of a table in one aggregate job, then an error that names what broke them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column]) -> dict[str, int]:
    """Rows that break each rule; a rule is a condition that holds where it is broken."""
    if not rules:
        return {}
    row = df.agg(*(F.coalesce(F.sum(F.when(F.coalesce(c, F.lit(False)), 1)), F.lit(0)).alias(f"r{i}") for i, c in enumerate(rules.values()))).first()
    return {name: row[f"r{i}"] for i, name in enumerate(rules)}


def expect(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` itself, or a ValueError with the counts of all broken rules."""
    broken = {k: v for k, v in violations(df, rules).items() if v}
    if broken:
        raise ValueError("; ".join(f"{k} ({v} rows)" for k, v in broken.items()))
    return df


def expect_none(df: DataFrame, column: str, message: str, show: int = 20) -> None:
    """Refuse if ``df`` has rows; the error lists the first distinct values in order."""
    bad = [r[0] for r in df.select(F.col(column).cast("string")).distinct().orderBy(column).limit(show).collect()]
    if bad:
        raise ValueError(f"{message}: {bad}")


def expect_unique(df: DataFrame, keys: list[str], message: str) -> DataFrame:
    """Refuse keys that occur twice."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(message)
    return df


def cell_rules() -> dict[str, Column]:
    """Structural rules of a cell record."""
    rules = {
        "area_px must be positive": F.coalesce(F.col("area_px") <= 0, F.lit(True)),
        "raw intensities must not be negative": (F.col("raw_mean_green") < 0) | (F.col("raw_mean_red") < 0),
    }
    for c in ("sample_id", "condition_id", "specimen_id", "biological_replicate_id"):
        rules[f"{c} must be null or text"] = F.trim(c) == ""
    for c in ("sampling_time_hours", "measurement_time_hours"):
        rules[f"{c} must be null or finite and not negative"] = (F.col(c) < 0) | (F.abs(F.col(c)) == float("inf"))
    return rules


def manifest_issues(rows: DataFrame, required: list[str], numeric: list[str], identity: list[str], limit: int = 20) -> DataFrame:
    """(row, level, rule, column) for a text manifest with a column ``row``: empty required cells, texts that are no
    numbers, negative numbers and repeated identities (each of their rows), at most ``limit`` per rule and column."""
    number = lambda c: F.col(c).try_cast("double")
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    checks = [("error", "missing", c, empty(c)) for c in required]
    checks += [("error", "not a number", c, ~empty(c) & number(c).isNull()) for c in numeric]
    checks += [("error", "negative", c, number(c) < 0) for c in numeric]
    found = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"), F.lit(c).alias("column"))) for level, rule, c, cond in checks)))
    from pyspark.sql import Window

    again = rows.withColumn("n", F.count("*").over(Window.partitionBy(*identity))).where("n > 1")
    issues = rows.select("row", F.explode(found).alias("x")).select("row", "x.*")
    issues = issues.unionByName(again.select("row", F.lit("error").alias("level"), F.lit("repeated identity").alias("rule"), F.lit(",".join(identity)).alias("column")))
    place = F.row_number().over(Window.partitionBy("rule", "column").orderBy("row"))
    return issues.withColumn("place", place).where(F.col("place") <= limit).drop("place")
