"""Registered queries on frames and manifests that SQL derives from the given tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, segment
from ..sources.work import staged

HEIGHT, WIDTH, LEAST = 24, 32, 3
#: A frame for each supplier: its line items light single pixels to whole numbers, and all others are dark.
LIT = f"""
SELECT concat('f', CAST(l_suppkey AS VARCHAR(12))) AS image_id, CAST(l_partkey % {HEIGHT} AS BIGINT) AS r, CAST(l_orderkey % {WIDTH} AS BIGINT) AS c,
  CAST(floor(max(l_extendedprice)) AS DOUBLE) AS green, CAST(floor(max(l_extendedprice * (1 + l_discount))) AS DOUBLE) AS red, CAST(max(l_quantity) AS DOUBLE) AS raw_green, CAST(max(l_linenumber * 7) AS DOUBLE) AS raw_red
FROM lineitem GROUP BY 1, 2, 3
"""
#: Every supplier's line items of a day and part as a row of an image manifest, with the faults that such lists have.
MANIFEST = """
SELECT o_orderkey AS row,
  concat(CAST(20260101 + o_custkey % 7 AS VARCHAR(8)), CASE o_orderkey % 5 WHEN 0 THEN '_h2o2_nt' WHEN 4 THEN '-bad' ELSE '_h2o2_tr' END) AS session_id,
  concat(CASE WHEN o_orderkey % 11 = 0 THEN 'dtt' ELSE 'h2o2' END, '_', CAST(o_orderkey % 4 * 50 AS VARCHAR(4)), 'uM_t', CAST(o_custkey % 9 AS VARCHAR(4))) AS condition_id,
  concat('R', CAST(o_orderkey % 6 AS VARCHAR(2))) AS sample_id,
  CASE WHEN o_orderkey % 13 = 0 THEN '-1' WHEN o_orderkey % 17 = 0 THEN '' ELSE CAST(o_custkey % 9 AS VARCHAR(4)) END AS measurement_time_hours,
  CASE WHEN o_orderkey % 19 = 0 THEN 'auto' ELSE '400' END AS exposure_ms_green, CASE WHEN o_orderkey % 23 = 0 THEN '0' ELSE ' 400 ' END AS exposure_ms_red,
  CASE WHEN o_orderkey % 29 = 0 THEN '50X' ELSE '40x ' END AS objective,
  CASE WHEN o_orderkey % 31 = 0 THEN ' ' ELSE concat('g', CAST(o_custkey AS VARCHAR(12))) END AS green_path, 'r' AS red_path
FROM orders
"""
OBJECTIVES = ("10X", "20X", "40X", "100X")


def frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pixels of all channels over whole frames, shapes)."""
    lit = spark.sql(LIT.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    inside = F.col("r").between(0, HEIGHT - 1) & F.col("c").between(0, WIDTH - 1)
    pixel = F.struct((F.col("r") * WIDTH + F.col("c")).cast("int").alias("at"), *(F.coalesce(n, F.lit(0.0)).alias(n) for n in segment.CHANNELS))
    # A frame is a row of its lit pixels, which are laid out over all of its places where they are.
    rows = lit.groupBy("image_id").agg(F.collect_list(F.when(inside, pixel)).alias("x"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, c = (x.ravel() for x in np.indices((HEIGHT, WIDTH)))
        for b in batches:
            for i in range(b.num_rows):
                at, *lights = (v.to_numpy(zero_copy_only=False) for v in b.column(1).slice(i, 1).flatten().flatten())
                values = np.zeros((len(segment.CHANNELS), HEIGHT * WIDTH))
                values[:, at] = lights
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(HEIGHT * WIDTH, i))), pa.array(r), pa.array(c), *map(pa.array, values)], names=["image_id", "r", "c", *segment.CHANNELS])

    px = staged(rows.mapInArrow(whole, "image_id string, r long, c long, " + ", ".join(f"{n} double" for n in segment.CHANNELS)), "frames")
    shapes = px.where("r = 0 and c = 0").select("image_id", F.lit(HEIGHT).cast("long").alias("height"), F.lit(WIDTH).cast("long").alias("width"))
    return px, staged(shapes, "shapes")


def cells_of(px: DataFrame, shapes: DataFrame) -> DataFrame:
    v = px.select("image_id", "r", "c", F.col("green").alias("v"))
    return segment.segment(v, shapes, segment.otsu_cuts(v), min_size=LEAST)


def q_segment_cells(spark, sf_dir):
    px, shapes = frames(spark, sf_dir)
    return segment.sizes(cells_of(px, shapes), shapes).withColumnRenamed("label", "cell_id")


def q_foreground_fraction(spark, sf_dir):
    px, shapes = frames(spark, sf_dir)
    return segment.foreground_fraction(cells_of(px, shapes), shapes).select("image_id", F.round("fraction", 6).alias("fraction"))


def q_frame_cuts(spark, sf_dir):
    px, _ = frames(spark, sf_dir)
    v = px.select("image_id", "r", "c", F.col("green").alias("v"))
    noise = segment.noise_cuts(v.where("v > 0"), 2.0).withColumnRenamed("cut", "noise_cut")
    return segment.otsu_cuts(v).join(noise, "image_id").select("image_id", F.round("cut", 6).alias("otsu_cut"), F.round("noise_cut", 6).alias("noise_cut"))


def q_cell_extraction(spark, sf_dir):
    px, shapes = frames(spark, sf_dir)
    c = segment.extract_cells(cells_of(px, shapes), shapes, px, saturation=50.0)
    return c.select(*(F.round(n, 6).alias(n) if k == "double" else F.col(n) for n, k in c.dtypes))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MANIFEST.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def q_manifest_issues(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 10 <> 3")
    files = customers.select(F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("path")).unionByName(spark.range(1).select(F.lit("r").alias("path")))
    t = checks.tally(checks.judge_manifest(manifest(spark, sf_dir), OBJECTIVES, files), "row", 20)
    return t.select("level", "column", "rule", "n", F.array_join("first", ",").alias("first"))


def q_manifest_sessions(spark, sf_dir):
    r = checks.session_report(manifest(spark, sf_dir))
    return r.withColumn("doses", F.array_join(F.transform("doses", lambda d: d.cast("long").cast("string")), ","))


QUERIES = (q_segment_cells, q_foreground_fraction, q_frame_cuts, q_cell_extraction, q_manifest_issues, q_manifest_sessions)

_FRAMES = f"""
lit AS ({LIT}),
ids AS (SELECT DISTINCT image_id FROM lit),
px AS (
  SELECT ids.image_id, r.i AS r, c.i AS c, r.i * {WIDTH} + c.i AS p, coalesce(green, 0) AS green, coalesce(red, 0) AS red, coalesce(raw_green, 0) AS raw_green, coalesce(raw_red, 0) AS raw_red
  FROM ids CROSS JOIN range({HEIGHT}) r(i) CROSS JOIN range({WIDTH}) c(i) LEFT JOIN lit ON lit.image_id = ids.image_id AND lit.r = r.i AND lit.c = c.i
),
span AS (SELECT image_id, min(green) AS lo, max(green) AS hi, (max(green) - min(green)) / 256 AS w FROM px GROUP BY image_id),
hist AS (SELECT image_id, lo, hi, w, CASE WHEN hi > lo THEN CAST(least(floor((green - lo) / w), 255) AS BIGINT) ELSE 0 END AS bin, count(*) AS n FROM px JOIN span USING (image_id) GROUP BY ALL),
cum AS (
  SELECT *, sum(n) OVER u AS below, sum(n * bin) OVER u AS s, sum(n) OVER (PARTITION BY image_id) AS a, sum(n * bin) OVER (PARTITION BY image_id) AS sa
  FROM hist WINDOW u AS (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING)
),
between_ AS (SELECT *, CASE WHEN below < a THEN CAST(a * s - below * sa AS DOUBLE) * CAST(a * s - below * sa AS DOUBLE) / CAST(below * (a - below) AS DOUBLE) ELSE 0 END AS b FROM cum),
cut AS (SELECT image_id, CASE WHEN hi > lo THEN lo + (bin + 0.5e0) * w ELSE hi END AS cut FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY b DESC, bin) AS k FROM between_) WHERE k = 1),
mask AS (SELECT image_id, p FROM px JOIN cut USING (image_id) WHERE green > cut)
"""
#: The four neighbours as rows, so that the recursion joins on equal keys.
_NEIGHBOURS = f"nb AS (SELECT p, q FROM (SELECT r.i * {WIDTH} + c.i AS p, unnest([CASE WHEN r.i > 0 THEN r.i * {WIDTH} + c.i - {WIDTH} END, CASE WHEN r.i < {HEIGHT - 1} THEN r.i * {WIDTH} + c.i + {WIDTH} END, CASE WHEN c.i > 0 THEN r.i * {WIDTH} + c.i - 1 END, CASE WHEN c.i < {WIDTH - 1} THEN r.i * {WIDTH} + c.i + 1 END]) AS q FROM range({HEIGHT}) r(i) CROSS JOIN range({WIDTH}) c(i)) WHERE q IS NOT NULL)"
_ON_EDGE = f"(p < {WIDTH} OR p >= {(HEIGHT - 1) * WIDTH} OR p % {WIDTH} = 0 OR p % {WIDTH} = {WIDTH - 1})"
_CELLS = f"""
WITH RECURSIVE {_FRAMES}, {_NEIGHBOURS},
back AS (SELECT image_id, p FROM px ANTI JOIN mask USING (image_id, p)),
open_ AS (SELECT image_id, p FROM back WHERE {_ON_EDGE} UNION SELECT b.image_id, b.p FROM open_ o JOIN nb ON nb.p = o.p JOIN back b ON b.image_id = o.image_id AND b.p = nb.q),
solid AS (SELECT image_id, p FROM px ANTI JOIN open_ USING (image_id, p)),
reach AS (SELECT image_id, p, p AS root FROM solid UNION SELECT s.image_id, s.p, x.root FROM reach x JOIN nb ON nb.p = x.p JOIN solid s ON s.image_id = x.image_id AND s.p = nb.q),
label AS (SELECT image_id, p, min(root) AS cell_id FROM reach GROUP BY image_id, p),
sizes AS (SELECT image_id, cell_id, count(*) AS area_px, bool_or({_ON_EDGE}) AS edge_flag FROM label GROUP BY image_id, cell_id HAVING count(*) >= {LEAST}),
cell AS (SELECT l.* FROM label l JOIN sizes USING (image_id, cell_id))
"""
_EXTRACTION = f"""
, own AS (SELECT image_id, cell_id, p, p // {WIDTH} AS r, p % {WIDTH} AS c FROM cell),
around AS (SELECT dy.i AS dy, dx.i AS dx FROM range(-4, 5) dy(i) CROSS JOIN range(-4, 5) dx(i) WHERE dy.i * dy.i + dx.i * dx.i <= 16),
wide AS (
  SELECT image_id, cell_id, (r + dy) * {WIDTH} + c + dx AS p, min(dy * dy + dx * dx) AS d2 FROM own CROSS JOIN around
  WHERE r + dy BETWEEN 0 AND {HEIGHT - 1} AND c + dx BETWEEN 0 AND {WIDTH - 1} GROUP BY ALL
),
bg AS (
  SELECT image_id, cell_id, quantile_cont(green, 0.5) AS bg, quantile_cont(red, 0.5) AS br, count(*) AS n_annulus
  FROM (SELECT * FROM wide WHERE d2 > 1) w ANTI JOIN cell USING (image_id, p) JOIN px USING (image_id, p) GROUP BY image_id, cell_id
),
lost AS (SELECT DISTINCT o.image_id, o.cell_id, o.p FROM own o JOIN nb ON nb.p = o.p LEFT JOIN own q ON q.image_id = o.image_id AND q.cell_id = o.cell_id AND q.p = nb.q WHERE q.p IS NULL),
m AS (
  SELECT o.image_id, o.cell_id, px.* EXCLUDE (image_id), bg, br, n_annulus, lost.p IS NULL AS kept, bool_or(lost.p IS NULL) OVER (PARTITION BY o.image_id, o.cell_id) AS any_kept
  FROM own o JOIN px USING (image_id, p) LEFT JOIN bg USING (image_id, cell_id) LEFT JOIN lost ON lost.image_id = o.image_id AND lost.cell_id = o.cell_id AND lost.p = o.p
), v AS (SELECT *, kept OR NOT any_kept AS used, CASE WHEN bg IS NULL THEN green ELSE greatest(green - bg, 0) END AS cg, CASE WHEN br IS NULL THEN red ELSE greatest(red - br, 0) END AS cr FROM m)
SELECT image_id, cell_id, round(avg(raw_green) FILTER (used), 6) AS raw_mean_green, round(avg(raw_red) FILTER (used), 6) AS raw_mean_red, round(avg(cg) FILTER (used), 6) AS corrected_mean_green, round(avg(cr) FILTER (used), 6) AS corrected_mean_red,
  round(sum(cg) FILTER (used), 6) AS integrated_green, round(sum(cr) FILTER (used), 6) AS integrated_red, bool_or(raw_green >= 50 OR raw_red >= 50) AS sat_flag,
  round(coalesce(max(bg), 0), 6) AS local_background_green, round(coalesce(max(br), 0), 6) AS local_background_red, coalesce(max(n_annulus), 0) AS n_annulus, max(area_px) AS area_px, bool_or(edge_flag) AS edge_flag
FROM v JOIN sizes USING (image_id, cell_id) GROUP BY image_id, cell_id
"""
_NOISE = "noise AS (SELECT image_id, CASE WHEN mad > 0 THEN m + 2 * 1.4826e0 * mad ELSE hi END AS noise_cut FROM (SELECT image_id, m, hi, quantile_cont(abs(green - m), 0.5) AS mad FROM px JOIN (SELECT image_id, quantile_cont(green, 0.5) AS m, max(green) AS hi FROM px WHERE green > 0 GROUP BY 1) USING (image_id) WHERE green > 0 GROUP BY 1, 2, 3))"
_SESSION, _CONDITION = "^([0-9]{8})_([a-z0-9]+)_(tr|nt)$", "^([a-z0-9]+)_([0-9]+)uM(_|$)"


def oracle_sql() -> dict[str, str]:
    listed = ", ".join(f"'{o}'" for o in OBJECTIVES)
    number = lambda c: f"TRY_CAST(trim({c}) AS DOUBLE)"
    rules = [("error", c, "not a positive number", f"NOT coalesce({number(c)} > 0, false)") for c in ("exposure_ms_green", "exposure_ms_red")]
    t = "measurement_time_hours"
    rules += [("error", t, "not a number of hours from 0 on", f"trim({t}) <> '' AND NOT coalesce({number(t)} >= 0, false)"), ("warning", t, "blank", f"trim({t}) = ''")]
    rules += [("error", "objective", "unknown", f"upper(trim(objective)) NOT IN ({listed})"), ("error", "green_path", "empty", "trim(green_path) = ''"), ("error", "red_path", "empty", "trim(red_path) = ''")]
    rules += [("warning", "session_id", "not <yyyymmdd>_<stressor>_<tr|nt>", f"NOT regexp_matches(session_id, '{_SESSION}')")]
    rules += [("error", "green_path", "file not found", "trim(green_path) <> '' AND green_path NOT IN (SELECT 'g' || c_custkey FROM customer WHERE c_custkey % 10 <> 3)")]
    rules += [("error", "sample_id", "same session, condition and sample as another row", "copies > 1")]
    each = " UNION ALL ".join(f"SELECT row, '{lv}' AS level, '{c}' AS \"column\", '{n}' AS rule FROM m WHERE {cond}" for lv, c, n, cond in rules)
    issues = f"""
WITH m0 AS ({MANIFEST}), m AS (SELECT *, count(*) OVER (PARTITION BY session_id, condition_id, sample_id) AS copies FROM m0), i AS ({each}),
k AS (SELECT *, row_number() OVER (PARTITION BY level, "column", rule ORDER BY row) AS place FROM i)
SELECT level, "column", rule, count(*) AS n, string_agg(CAST(row AS VARCHAR), ',' ORDER BY place) FILTER (place <= 20) AS first FROM k GROUP BY level, "column", rule"""
    sessions = f"""
WITH m AS ({MANIFEST}), s AS (
  SELECT session_id, regexp_extract(session_id, '{_SESSION}', 1) AS day, regexp_extract(session_id, '{_SESSION}', 2) AS stressor, regexp_extract(session_id, '{_SESSION}', 3) AS strain,
    CASE WHEN regexp_matches(condition_id, '{_CONDITION}') AND regexp_extract(condition_id, '{_CONDITION}', 1) = regexp_extract(session_id, '{_SESSION}', 2) THEN CAST(regexp_extract(condition_id, '{_CONDITION}', 2) AS BIGINT) END AS dose
  FROM m WHERE regexp_matches(session_id, '{_SESSION}')
)
SELECT session_id, day, stressor, strain, count(*) AS fields, coalesce(array_to_string(list_sort(list(DISTINCT dose) FILTER (dose IS NOT NULL)), ','), '') AS doses, count(*) FILTER (dose IS NULL) AS unknown_doses,
  strain = 'tr' AND coalesce(count(*) FILTER (dose = 0), 0) = 0 AS no_control, stressor NOT IN (SELECT stressor FROM s WHERE strain = 'nt') AS no_baseline
FROM s GROUP BY session_id, day, stressor, strain"""
    return {
        "q_segment_cells": f"{_CELLS} SELECT image_id, cell_id, area_px, edge_flag FROM sizes",
        "q_foreground_fraction": f"{_CELLS} SELECT image_id, round(coalesce(sum(area_px), 0) / {HEIGHT * WIDTH}, 6) AS fraction FROM ids LEFT JOIN sizes USING (image_id) GROUP BY image_id",
        "q_frame_cuts": f"WITH {_FRAMES}, {_NOISE} SELECT image_id, round(cut, 6) AS otsu_cut, round(noise_cut, 6) AS noise_cut FROM cut JOIN noise USING (image_id)",
        "q_cell_extraction": _CELLS + _EXTRACTION,
        "q_manifest_issues": issues,
        "q_manifest_sessions": sessions,
    }
