from helpers import empty_table, odd_table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cytoframe.llm import bpe, jaccard, mixing, quality

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, second, third, last = (f for _, f in corpus_pipeline.STAGES)
    floors = quality.fit_floors(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.quality(docs, floors=floors).where("kept").collect()}
    a = first(spark, docs, SF)
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == good
    keep = {r.component_id for r in jaccard.jaccard_components(a, n=5, percent=80).collect()}
    b = second(spark, a, SF)
    assert b.columns == docs.columns and sorted(r.doc_id for r in b.collect()) == sorted(keep)
    want = sorted(r.doc_id for r in mixing.mix(b).collect() for _ in range(r.copies))
    c = third(spark, b, SF)
    assert c.columns == docs.columns and sorted(r.doc_id for r in c.collect()) == want
    library = Tokenizer.from_file(bpe.default_vocabulary())
    n = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in b.collect()}
    d = last(spark, c, SF).collect()
    assert sorted(r.doc_id for r in d) == want and all(r.n_tokens == n[r.doc_id] for r in d)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, d))


def test_odd_and_empty_tables(spark):
    for df in (odd_table(spark, ["the quick brown fox jumps over the lazy dog and runs far away into the dark green wood near our old house today"] * 3), empty_table(spark)):
        for df in (df, df.withColumnsRenamed({"node": "copies", "key": "row_key"}).withColumns({"_id": F.lit(1), "_first": F.lit(2), "place": F.lit(3), "component_id": F.lit(4)})):
            for _, stage in corpus_pipeline.STAGES[:3]:
                out = stage(spark, df, SF)
                assert out.columns == df.columns
                rows = {repr(r) for r in df.collect()}
                assert all(repr(r) in rows for r in out.collect())
            assert corpus_pipeline.bpe_encode(spark, df, SF).count() == df.count()


def test_null_and_repeated_ids_multiply_nothing(spark):
    text = "some plain words of one document "
    for ids in ([None] * 10 + [1], [7] * 10 + [1]):
        rows = [(d, text * (1 + i), "a") for i, d in enumerate(ids)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        want = sum(r.copies for r in mixing.mix(df).collect())
        assert corpus_pipeline.mix_sources(spark, df, SF).count() == want and abs(want - 11) <= 1
        same = spark.createDataFrame([(d, text, "a") for d in ids], df.schema)
        assert corpus_pipeline.mix_sources(spark, same, SF).count() == 11


def test_one_row_of_repeated_documents_stays(spark):
    t = "some words " + " ".join(f"w{i}" for i in range(60))
    rows = [(1, t), (1, t), (2, t), (3, t + " tail"), (4, "other words entirely"), (None, t), (5, None), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.near_duplicates(spark, df, SF).collect()
    # The row without an id is a copy of document 1 and goes with the others.
    assert sorted(r.doc_id for r in out) == [1, 4, 5]
    alone = spark.createDataFrame([(None, t), (None, t + " tail"), (None, "other words entirely")], df.schema)
    assert corpus_pipeline.near_duplicates(spark, alone, SF).count() == 2


def test_many_identical_rows(spark):
    """Rows that agree in every column do not multiply each other."""
    import time

    text = "the quick brown fox jumps over the lazy dog and runs far away into the dark green wood near our old house today"
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit("s").alias("source"))
    docs = docs.unionByName(docs.limit(3).withColumns({"doc_id": F.lit(8).cast("long"), "text": F.lit("another text of its own that shares nothing with it")}))
    began = time.time()
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).orderBy("doc_id").collect()] == [7, 8]
    assert time.time() - began < 90
