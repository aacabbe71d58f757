"""Exact quantiles of few large groups: order statistics picked from sorted ranges, so that no group's values meet in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..sources.work import staged


def group_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """(keys, column, n, q): for each group and named column an array of its quantiles in the order of ``qs``, linear between neighbours.

    The same values as ``percentile``, which keeps a group's distinct values in one buffer.  Here values are dealt by ranges of (keys, column, value),
    with a last key that tells equal values apart, sorted and written; a value's rank is its place in its range and the group's counts in the
    ranges before, and of each group at most two values for each quantile are kept.  Null and NaN values do not count; a group without
    values has no row.
    """
    spark = df.sparkSession
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), E.clean(F.col(c)).alias("v")) for c in columns)))
    long = df.select(*keys, pairs.alias("_x")).select(*keys, "_x.column", "_x.v").where("v IS NOT NULL").withColumn("_tie", F.monotonically_increasing_id())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, "column"]
    order = [*by, "v", "_tie"]
    placed = staged(long.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    # A row for each group and range that it lies in.
    parts = placed.groupBy(*by, "_part").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_c").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = staged(parts.withColumn("_before", before).withColumn("n", F.sum("_c").over(w)), "parts")
    at = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    wanted = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(at(q)), F.ceil(at(q))) for q in qs))))
    # Which places of which range hold wanted ranks: few rows, joined to the written ranges.
    picks = parts.withColumn("_rank", F.explode(wanted)).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
    picks = picks.select("_rank", (F.col("_first") + F.col("_rank") - F.col("_before")).alias("_at"), "n")
    kept = placed.join(picks, "_at").groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "v"))).alias("_v"))
    lo = lambda q: F.element_at(F.col("_v"), F.floor(at(q)))
    hi = lambda q: F.element_at(F.col("_v"), F.ceil(at(q)))
    each = [lo(q) + (hi(q) - lo(q)) * (at(q) - F.floor(at(q))) for q in qs]
    return kept.select(*by, "n", F.array(*each).alias("q"))


def wide(quantiles: DataFrame, keys: Sequence[str], names: dict[str, Sequence[str]]) -> DataFrame:
    """(keys, names...): the quantiles of each column of ``group_quantiles`` under the names given for them."""
    return quantiles.groupBy(*keys).agg(*(F.max(F.when(F.col("column") == c, F.get("q", F.lit(i)))).alias(n) for c, ns in names.items() for i, n in enumerate(ns)))
