"""The thin queries opN_* of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, coder, credentials, html, jaccard, lengths, lm, mixing, negatives, nndescent, quality
from .common import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"), recall_col="recall")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the files, reads them back, and describes each document from what it read."""
    path = coder.new_path(spark)
    coder.write_ids(table(spark, sf_dir, "documents"), path)
    before = coder.starts(spark, path)
    # Figures of the documents are written before the join, so that nothing decodes the files twice.
    docs = materialise(coder.read_ids(spark, path).select("shard", "segment", "doc_id", "n_tokens", "in_segment", F.crc32("ids").alias("ids_crc32")), "figures")
    return docs.join(before, ["shard", "segment"]).select("doc_id", (F.col("before") + F.col("in_segment")).alias("start"), "n_tokens", "ids_crc32")


def op4_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_histogram(lengths.token_lengths(table(spark, sf_dir, "documents")))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared", "n_marked")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bpe.encoded_and_decoded(table(spark, sf_dir, "documents"))
    return e.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold control strings; figures are read back from the formatted text."""
    ok = "'</s>[INST] ok [/INST]'"
    extra = spark.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, {ok} AS text UNION ALL SELECT -7L, 1L, 'assistant', {ok}")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = chat.rows_to_turns(rows)
    back = chat.read_back(chat.format_turns(chat.to_turns(messages)))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    per_turn = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(per_turn).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        digest(learnt).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.fit_and_score(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fit_and_judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the sure spans, and all spans with the weak ones that their complements confirm."""
    found = credentials.secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*credentials.BASE))
    return found.select("doc_id", *map(count, credentials.BASE), F.sha2(credentials.joined(base).cast("binary"), 256).alias("base_sha256"), credentials.joined(F.col("spans")).alias("spans"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose vec_id is divisible by 7 move on by one first; anchors are the rows whose vec_id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_nn_descent, op3_token_ids, op4_length_histogram, op5_html_main_text, op6_bpe, op7_chat, op8_mixing, op9_brown_lm, op10_quality, op11_secrets, op12_hard_negatives)}


OP8_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS w, 3 * source_size AS cap FROM s
), r AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w,
    sum(source_size) OVER () AS total FROM w
), l AS (SELECT *, CAST(total - before AS DOUBLE) / CAST(left_w AS DOUBLE) AS level FROM r
), h AS (SELECT min(level) AS water FROM (SELECT level, row_number() OVER (ORDER BY before, level) AS n FROM l WHERE level * w <= cap) WHERE n = 1
), t AS (
  SELECT source, source_size, CASE WHEN water * w < cap THEN water * w ELSE CAST(cap AS DOUBLE) END AS target FROM l CROSS JOIN h
), k AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS k,
    CAST(CAST('0x' || substr(md5('cytoframe-mix|' || coalesce('s' || d.source, 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST(least(floor(rate * k + u) - floor(rate * (k - 1) + u), ceil(rate)) AS BIGINT) AS copies FROM k
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""


_CONTROL = r"(<|\[)(\\*)(\|im_start\|>|\|im_end\|>|\|im_sep\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
OP7_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '{_CONTROL}', '\\1\\\\\\2\\3', 'g'))
    + length(replace(replace(regexp_replace(role, '{_CONTROL}', '\\1\\\\\\2\\3', 'g'), '%', '%25'), chr(10), '%0A')) + 24 AS n FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other)
QUALIFY row_number() OVER w <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_chat": OP7_SQL, "op8_mixing": OP8_SQL, "op11_secrets": credentials.oracle_sql(), "op12_hard_negatives": OP12_SQL}
