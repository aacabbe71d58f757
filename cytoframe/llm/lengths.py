"""Token counts: an exact histogram of encoded lengths whose suffix sums answer questions about every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import materialise

#: Lengths in one bucket of the two-level suffix sums.
BUCKET = 1024


def token_lengths(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) per input row; null and empty texts have 0, repeated rows count each, very long texts are encoded whole,
    null ids stay null, an empty table gives no rows; columns other than the two named are not read, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = tokens.encoder(vocabulary or tokens.default_vocabulary())
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n = e.count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs: (n_tokens, n_docs, docs_at_least, tokens_at_least, docs_total, tokens_total, truncated_total).

    docs_at_least and tokens_at_least are suffix sums over documents of this length or longer; truncated_total is
    the tokens that are left of all documents when each is cut at this length.  An empty table gives no rows; a null length
    counts as no document; other columns of ``lengths`` are not read.

    Documents are counted by length before the shuffle.  Suffix sums run in two levels, over the lengths of a bucket and
    over the buckets, so no task gets all lengths.
    """
    # One row per length, read twice below, so it is written: nothing encodes the texts again.
    hist = materialise(lengths.where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET)), "histogram")
    per = hist.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.select(
        F.col("bucket").alias("b"),
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(everything).alias("docs_total"),
        F.sum("t").over(everything).alias("tokens_total"),
    )
    within = Window.partitionBy("bucket").orderBy(F.col("n_tokens").desc())
    out = hist.withColumn("d_in", F.sum("n_docs").over(within)).withColumn("t_in", F.sum(F.col("n_docs") * F.col("n_tokens")).over(within))
    out = out.join(per, F.col("bucket") == F.col("b"))
    docs, toks = F.col("d_in") + F.col("d_after"), F.col("t_in") + F.col("t_after")
    return out.select("n_tokens", "n_docs", docs.alias("docs_at_least"), toks.alias("tokens_at_least"), "docs_total", "tokens_total", (F.col("tokens_total") - toks + F.col("n_tokens") * docs).alias("truncated_total"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_whole, docs_cut, tokens_left, tokens_lost) for any context limits, whether a document has that length or not."""

    def left(limit: int) -> Column:
        return F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs"))

    # A stated list of limits, answered in one pass over the histogram.
    aggs = [a for x in limits for a in (F.coalesce(left(x), F.lit(0)).alias(f"l{x}"), F.coalesce(F.sum(F.when(F.col("n_tokens") <= x, F.col("n_docs"))), F.lit(0)).alias(f"w{x}"))]
    one = histogram.agg(*aggs, F.coalesce(F.sum("n_docs"), F.lit(0)).alias("d"), F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("t"))
    rows = F.explode(F.array(*(F.struct(F.lit(x).cast("long").alias("context_limit"), F.col(f"w{x}").alias("docs_whole"), (F.col("d") - F.col(f"w{x}")).alias("docs_cut"), F.col(f"l{x}").alias("tokens_left"), (F.col("t") - F.col(f"l{x}")).alias("tokens_lost")) for x in limits)))
    return one.select(rows.alias("r")).select("r.*")


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length such that at least this share of the documents is no longer."""
    at_most = F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")
    aggs = [F.min(F.when(at_most >= F.ceil(F.lit(s) * F.col("docs_total")), F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]
    rows = F.explode(F.array(*(F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares))))
    return histogram.agg(*aggs).select(rows.alias("r")).select("r.*")
