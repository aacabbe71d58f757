"""The jobs as registered queries: each runs its job twice into one new folder and returns what stands there, with DuckDB twins."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.operators import checks
from cytoframe.plans.queries import LABELS
from cytoframe.sources.work import work_root

from . import culture_report, text_intake


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_text_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records after two runs: the second finds nothing new."""
    folder = new_folder(spark, "text_intake")
    for _ in range(2):
        text_intake.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint")
    r = spark.read.parquet(f"{folder}/out/records")
    return r.select(
        F.col("id").alias("doc_id"), "digest", "deliveries", "source", "lang", "n_chars", "n_words", "n_symbols", "n_table_lines",
        checks.named("error").alias("errors"), checks.named("warning").alias("warnings"), "status", "same_as",
    )


def job2_culture_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curves after two runs: the second overwrites what the first wrote."""
    folder = new_folder(spark, "culture_report")
    for _ in range(2):
        culture_report.run(spark, f"{sf_dir}/lineitem.parquet", folder)
    c = spark.read.parquet(f"{folder}/curves").withColumns({"stressor": F.col("stressor").cast("string"), "day": F.col("day").cast("string")})
    return c.select(*(F.round(x, 6).alias(x) if k == "double" else F.col(x) for x, k in c.dtypes))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_text_intake, job2_culture_report)}


def _intake_sql() -> str:
    rules = json.loads((Path(__file__).parent / "text_intake.json").read_text(encoding="utf-8"))["rules"]
    broken = lambda level: [r for r in rules if r["level"] == level]
    listed = lambda level: ", ".join(f"CASE WHEN coalesce({r['broken']}, false) THEN '{r['column']}: {r['rule']}' END" for r in broken(level))
    count = lambda p: f"CAST(len(regexp_extract_all(coalesce(text, ''), '{p}')) AS BIGINT)"
    return f"""
WITH d AS (
  SELECT doc_id, sha256(coalesce(text, '')) AS digest, source, lang, n_chars, text, {count(text_intake.WORD)} AS n_words, {count(text_intake.SYMBOL)} AS n_symbols, {count(text_intake.TABLE_LINE)} AS n_table_lines
  FROM documents
), j AS (SELECT *, concat_ws('; ', {listed('error')}) AS errors, concat_ws('; ', {listed('warning')}) AS warnings FROM d
), o AS (
  SELECT doc_id, digest, count(*) AS deliveries,
    min(row(source, lang, n_chars, n_words, n_symbols, n_table_lines, errors, warnings)) AS r FROM j GROUP BY doc_id, digest
), k AS (SELECT doc_id, digest, deliveries, r[1] AS source, r[2] AS lang, r[3] AS n_chars, r[4] AS n_words, r[5] AS n_symbols, r[6] AS n_table_lines, r[7] AS errors, r[8] AS warnings FROM o
), f AS (SELECT digest, min(doc_id) AS first_id FROM k WHERE errors = '' GROUP BY digest)
SELECT k.*, CASE WHEN errors <> '' THEN 'refused' WHEN doc_id <> first_id THEN 'repeat' ELSE 'accepted' END AS status, CASE WHEN errors = '' AND doc_id <> first_id THEN first_id END AS same_as
FROM k LEFT JOIN f USING (digest)
"""


_LINE = "CASE WHEN {c}0 = {c}1 OR c.time_h = t0 THEN {c}0 ELSE {c}0 + ({c}1 - {c}0) * (c.time_h - t0) / (t1 - t0) END"
JOB2_SQL = f"""
WITH {LABELS},
thin AS (SELECT session_id, condition_id, count(*) FILTER (n_cells < 5) AS n_thin FROM fields GROUP BY session_id, condition_id),
control AS (SELECT session_id, time_h AS t0, avg(green) AS green0, avg(red) AS red0 FROM course WHERE dose_uM = 0 GROUP BY session_id, time_h),
held AS (SELECT *, lead(t0) OVER w AS t1, lead(green0) OVER w AS green1, lead(red0) OVER w AS red1 FROM control WINDOW w AS (PARTITION BY session_id ORDER BY t0)),
top AS (SELECT session_id, dose_uM, max_by(time_h, row(green, -time_h)) AS top, count(*) AS n FROM course GROUP BY session_id, dose_uM)
SELECT c.session_id, c.condition_id, c.day, c.stressor, c.strain, c.dose_uM, round(c.time_h, 6) AS time_h, c.n_fields, c.n_cells, round(c.green, 6) AS green, round(c.red, 6) AS red,
  round(CASE WHEN c.green > 0 AND c.red > 0 THEN c.red / c.green END, 6) AS ratio, n_thin,
  round(CASE WHEN c.dose_uM <> 0 THEN c.green - ({_LINE.format(c='green')}) END, 6) AS excess_green, round(CASE WHEN c.dose_uM <> 0 THEN c.red - ({_LINE.format(c='red')}) END, 6) AS excess_red,
  n >= 2 AND c.time_h = top AS peak
FROM course c JOIN thin USING (session_id, condition_id) JOIN top USING (session_id, dose_uM)
LEFT JOIN held h ON c.session_id = h.session_id AND c.time_h >= t0 AND (c.time_h < t1 OR (t1 IS NULL AND c.time_h = t0))
"""


def oracle_sql() -> dict[str, str]:
    return {"job1_text_intake": _intake_sql(), "job2_culture_report": JOB2_SQL}
