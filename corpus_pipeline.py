"""From raw documents to token ids: quality rules, near-duplicate removal, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and is the
next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytoframe.llm import bpe, jaccard, mixing, quality
from cytoframe.llm.common import discard_path, free_name, row_key, work_root

#: Words per shingle and percent of Jaccard similarity from which documents are near copies.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, with entropy floors fitted on a bounded sample of the labelled good ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, floors=quality.fit_floors(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id (rows without an id come last, then a hash of the row decides).

    Rows are told apart by all of their columns, so rows with a null id or a repeated one take part like any other; of rows
    that agree in every column one stays.  Documents without words link with nothing and stay.  An empty table gives
    no rows; columns of any name travel unchanged.
    """
    key, place = free_name(docs, "row_key"), free_name(docs, "place")
    keyed = docs.withColumn(key, row_key(docs))
    found = jaccard.jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), n=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    # One row for each key on either side: k rows that agree in every column must not meet k times k.
    found = found.select(F.col("doc_id").alias("row"), "component_id").dropDuplicates(["row"])
    ids = keyed.select(F.col(key).alias("row"), F.col("doc_id").alias("id")).dropDuplicates(["row"])
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    first = found.join(ids, "row").groupBy("component_id").agg(F.min(order)["row"].alias(key))
    one = Window.partitionBy(key).orderBy(key)
    return keyed.join(first.select(key), key).withColumn(place, F.row_number().over(one)).where(F.col(place) == 1).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Rows are told apart by all of their columns, so null and repeated ids multiply nothing; rows that agree in every column
    come out as often as the mix takes all of them together.  An empty table gives no rows; columns of any
    name travel unchanged.
    """
    key, place, copies = (free_name(docs, x) for x in ("row_key", "place", "copies"))
    keyed = docs.withColumn(key, row_key(docs))
    mixed = mixing.mix(keyed.select("doc_id", "text", "source", F.col(key).alias("row")), row_col="row")
    taken = mixed.groupBy(F.col("row").alias(key)).agg(F.sum("copies").alias(copies)).where(F.col(copies) > 0)
    one = Window.partitionBy(key).orderBy(key)
    joined = keyed.join(taken, key).withColumn(place, F.row_number().over(one)).where(F.col(place) == 1)
    return joined.withColumn(place, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(docs.columns)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of ids and decoded text; null and empty texts have no ids, null ids stay null, repeated rows come out each."""
    e = bpe.encoded_and_decoded(docs)
    return e.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe_encode),
]

#: The tokeniser stages cannot be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table is deleted once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{work_root(spark)}/cytoframe/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            discard_path(spark, f"{folder}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
