"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, with_rank

SEED = "cytoframe-mix"
#: Weights dealt to the sources in order, again and again.
WEIGHTS = (5, 2, 1)
#: A source is repeated at most so often.
MAX_REPEATS = 3


def word_count(text: Column) -> Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Targets share the total by weight; none exceeds ``max_repeats`` times its source's size, and what that cuts
    off is shared again by weight among the others until none is above.  That fixed point is a water level:
    with sources in ascending order of cap / weight, level k = (total - caps before k) / (weights from k on),
    and the first k whose own cap reaches its level marks where capped sources end.

    There is one row for each source, and the windows run over these rows alone.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * max_repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    s = (
        s.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left_w", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("left_w"))
    )
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("before"), F.col("level"))))
    s = s.withColumn("water", level.over(Window.partitionBy())["level"])
    target = F.when(F.col("water") * F.col("w") < F.col("cap"), F.col("water") * F.col("w")).otherwise(F.col("cap").cast("double"))
    return s.select("source", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """The source's random start in [0, 1): fixed by the seed and the source, so reruns agree."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, row_col: str | None = None, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """One row per input row: (doc_id, source, size, source_size, target, copies, taken), and ``row`` where ``row_col`` names a key to carry along.

    Systematic sampling: within a source every document expects rate = target / source_size copies.  The
    documents stand in order of size, id and row key; the prefix sum of expected copies up to document k is
    rate * k, and a document is emitted once for each integer that rate * k plus the source's one random offset
    passes.  So each gets the rate rounded down or up, neighbours in size share the rounding, and the words taken
    differ from the target by no more than the source's longest document.  The offset is drawn per source from the seed.

    Null texts and texts without words have size 0 and follow the same rule; a null source is a source of its
    own, last; null ids come first among equals; repeated rows count each on its own.  A source
    without any words takes nothing.  Very long texts are counted whole.  An empty table gives no rows.  Other columns are not read.
    """
    row = [] if row_col is None else [F.col(row_col).alias("row")]
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *row)
    names = ["row"] if row else []
    ranked = with_rank(docs, "source", "size", "doc_id", *names)
    per_source = ranked.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("rank").alias("first"))
    # One row per source; Spark broadcasts it only while it is below its threshold.
    targets = source_targets(per_source.select("source", "source_size"), weights, max_repeats)
    t = targets.join(per_source.select(F.col("source").alias("s2"), "first"), F.col("source").eqNullSafe(F.col("s2")), "inner").drop("s2")
    t = t.select(F.col("source").alias("s2"), "source_size", "target", "first")
    j = ranked.join(t, F.col("source").eqNullSafe(F.col("s2")), "inner").drop("s2")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    j = j.withColumn("rate", rate).withColumn("k", F.col("rank") - F.col("first")).withColumn("u", offset(F.col("source"), seed))
    copies = F.least(F.floor(F.col("rate") * (F.col("k") + 1) + F.col("u")) - F.floor(F.col("rate") * F.col("k") + F.col("u")), F.ceil("rate")).cast("long")
    j = j.withColumn("copies", copies)
    return j.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *names)
