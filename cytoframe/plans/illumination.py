"""Registered queries on backgrounds, flat fields and alignment of frames derived from the given tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment, segment
from ..operators import illumination as light
from ..sources.work import staged
from .imaging import _FRAMES, HEIGHT, WIDTH, frames

SIGMA, RADIUS, CUT, REACH, GUARD = 2.0, 3, 60, 4, 1
#: Fields of a session, and minutes within which a bright-field frame may belong to one; a field is taken each minute.
SESSION, MINUTES = 50, 1.5


def lit_pixels(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pixels, shapes): frames in whole numbers on a pattern of dark ones; session_id and number go with the shapes."""
    px, shapes = frames(spark, sf_dir)
    v = F.floor(F.col("green") / 1000) + (F.col("r") * 7 + F.col("c") * 3) % 11
    number = F.substring("image_id", 2, 12).cast("long")
    return px.select("image_id", "r", "c", v.cast("double").alias("v")), shapes.withColumn("number", number).withColumn("session_id", F.floor(F.col("number") / SESSION).cast("string"))


def q_background_levels(spark, sf_dir):
    levels = light.background_levels(lit_pixels(spark, sf_dir)[0])
    return levels.select("image_id", *(F.round(c, 6).alias(c) for c in ("mode", "low", "level")), "method")


def q_flat_field(spark, sf_dir):
    px, shapes = lit_pixels(spark, sf_dir)
    gains, _ = light.flat_fields(px, shapes, SIGMA)
    return gains.select("session_id", "r", "c", F.round("gain", 6).alias("gain"))


def q_rolling_ball(spark, sf_dir):
    px, shapes = lit_pixels(spark, sf_dir)
    rows = light.rolling_ball(light.frame_rows(px, shapes), RADIUS)
    return rows.groupBy("image_id", "r").agg(F.round(F.sum("v"), 4).alias("above"), F.round(F.sum("background"), 4).alias("background"))


def bright_fields(px: DataFrame, shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(masks, pairs): each field's bright pixels, displaced by a known way, as its bright-field frame; frames of the field's minute and its neighbours are candidates."""
    n = shapes.select("image_id", "number")
    moved = px.where(F.col("v") > CUT).join(n, "image_id").withColumns({"r": F.col("r") + F.col("number") % 5 - 2, "c": F.col("c") + F.col("number") % 7 - 3})
    inside = F.col("r").between(0, HEIGHT - 1) & F.col("c").between(0, WIDTH - 1)
    masks = segment.runs_of(moved.where(inside).withColumn("image_id", F.concat(F.lit("b"), F.col("number").cast("string")))).withColumnRenamed("image_id", "frame_id")
    fields = shapes.select("session_id", F.col("image_id").alias("field_id"), F.col("number").cast("double").alias("t"))
    own = shapes.select("session_id", F.concat(F.lit("b"), F.col("number").cast("string")).alias("frame_id"), F.col("number").cast("double").alias("t"))
    return staged(masks, "masks"), alignment.pairs_in_time(fields, own, ["session_id"], MINUTES)


def q_mask_placement(spark, sf_dir):
    px, shapes = lit_pixels(spark, sf_dir)
    masks, pairs = bright_fields(px, shapes)
    p = alignment.place_pairs(pairs.select("field_id", "frame_id"), masks, px, shapes, reach=REACH, guard=GUARD, sigma=None)
    return p.select("field_id", "frame_id", "dy", "dx", *(F.round(c, 4).alias(c) for c in ("z", "contrast", "mask_fraction")))


def q_frame_alignment(spark, sf_dir):
    px, shapes = lit_pixels(spark, sf_dir)
    masks, pairs = bright_fields(px, shapes)
    return alignment.align_frames(pairs, ["session_id"], masks, px, shapes, reach=REACH, guard=GUARD, sigma=None)


QUERIES = (q_background_levels, q_flat_field, q_rolling_ball, q_mask_placement, q_frame_alignment)

_LIT = f"""WITH {_FRAMES},
lp AS (SELECT image_id, CAST(substr(image_id, 2) AS BIGINT) AS s, r, c, floor(green / 1000) + (r * 7 + c * 3) % 11 AS v FROM px)
"""


def listed(weights: list) -> str:
    reach = len(weights) // 2
    return ", ".join(f"({k - reach}, {w!r})" for k, w in enumerate(weights))


def oracle_sql() -> dict[str, str]:
    levels = f"""{_LIT},
t(d, w) AS (VALUES {listed(light.whole_taps(light.SMOOTHING))}),
sp AS (SELECT image_id, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.05) AS low, quantile_cont(v, 0.2) AS bound, (max(v) - min(v)) / 256 AS w FROM lp GROUP BY 1),
hi_ AS (SELECT image_id, CASE WHEN hi > lo THEN CAST(least(floor((v - lo) / w), 255) AS BIGINT) ELSE 0 END AS bin, count(*) AS n FROM lp JOIN sp USING (image_id) GROUP BY 1, 2),
ext AS (SELECT image_id, unnest([bin, -1 - bin, 511 - bin]) AS pos, n FROM hi_),
sm AS (SELECT image_id, pos + d AS bin, sum(n * t.w) AS full_ FROM ext CROSS JOIN t WHERE pos BETWEEN -8 AND 263 AND pos + d BETWEEN 0 AND 255 GROUP BY 1, 2),
top AS (SELECT image_id, bin FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY full_ DESC, bin) AS k FROM sm) WHERE k = 1),
m AS (SELECT image_id, CASE WHEN hi > lo THEN lo + (bin + 0.5e0) * w ELSE lo END AS mode, low, bound FROM top JOIN sp USING (image_id))
SELECT image_id, round(mode, 6) AS mode, round(low, 6) AS low, round(CASE WHEN mode <= bound THEN mode ELSE low END, 6) AS level, CASE WHEN mode <= bound THEN 'mode' ELSE 'percentile' END AS method FROM m"""
    flat = f"""{_LIT},
t(d, w) AS (VALUES {listed(light.taps(SIGMA))}),
m AS (SELECT CAST(s // {SESSION} AS VARCHAR) AS session_id, r, c, quantile_cont(v, 0.5) AS v FROM lp GROUP BY 1, 2, 3 HAVING count(*) > 1),
a AS (SELECT y.session_id, o.i AS r, y.c, sum(t.w * y.v) AS v FROM range({HEIGHT}) o(i) CROSS JOIN t JOIN m y ON y.r = greatest(0, least({HEIGHT - 1}, o.i + d)) GROUP BY 1, 2, 3),
b AS (SELECT x.session_id, x.r, o.i AS c, sum(t.w * x.v) AS v FROM range({WIDTH}) o(i) CROSS JOIN t JOIN a x ON x.c = greatest(0, least({WIDTH - 1}, o.i + d)) GROUP BY 1, 2, 3)
SELECT session_id, r, c, round(v / avg(v) OVER (PARTITION BY session_id), 6) AS gain FROM b"""
    ball = f"""{_LIT},
o AS (SELECT dy.i AS dy, dx.i AS dx, {RADIUS} - sqrt({RADIUS * RADIUS} - dy.i * dy.i - dx.i * dx.i) AS up FROM range(-{RADIUS}, {RADIUS + 1}) dy(i) CROSS JOIN range(-{RADIUS}, {RADIUS + 1}) dx(i) WHERE dy.i * dy.i + dx.i * dx.i <= {RADIUS * RADIUS}),
b AS (SELECT image_id, r - dy AS r, c - dx AS c, min(v + up) AS b FROM lp CROSS JOIN o GROUP BY 1, 2, 3)
SELECT image_id, r, round(sum(greatest(v - b, 0)), 4) AS above, round(sum(b), 4) AS background FROM lp JOIN b USING (image_id, r, c) GROUP BY image_id, r"""
    place = f"""{_LIT},
s AS (SELECT DISTINCT s FROM lp),
pairs AS (SELECT a.s AS f, b.s AS b FROM s a JOIN s b ON a.s // {SESSION} = b.s // {SESSION} WHERE abs(a.s - b.s) <= {MINUTES}),
mk AS (SELECT s, r + s % 5 - 2 AS r, c + s % 7 - 3 AS c FROM lp WHERE v > {CUT} AND r + s % 5 - 2 BETWEEN 0 AND {HEIGHT - 1} AND c + s % 7 - 3 BETWEEN 0 AND {WIDTH - 1}),
area AS (SELECT s AS b, count(*) AS n FROM mk GROUP BY 1),
d AS (SELECT dy.i AS dy, dx.i AS dx FROM range(-{REACH}, {REACH + 1}) dy(i) CROSS JOIN range(-{REACH}, {REACH + 1}) dx(i)),
sc AS (SELECT f, b, dy, dx, sum(v) AS total, count(*) AS n, sum(v) / count(*) AS score FROM pairs JOIN mk ON mk.s = b CROSS JOIN d JOIN lp ON lp.s = f AND lp.r = mk.r + dy AND lp.c = mk.c + dx GROUP BY 1, 2, 3, 4),
ok AS (SELECT sc.* FROM sc JOIN area USING (b) WHERE 2 * sc.n > area.n),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY f, b ORDER BY score DESC, dy, dx) AS k FROM ok) WHERE k = 1),
ot AS (SELECT ok.f, ok.b, ok.score FROM ok JOIN pk USING (f, b) WHERE abs(ok.dy - pk.dy) > {GUARD} OR abs(ok.dx - pk.dx) > {GUARD}),
md AS (SELECT f, b, quantile_cont(score, 0.5) AS m FROM ot GROUP BY 1, 2),
sd AS (SELECT f, b, m, 1.4826e0 * quantile_cont(abs(score - m), 0.5) AS sd FROM ot JOIN md USING (f, b) GROUP BY 1, 2, 3),
whole AS (SELECT s AS f, sum(v) AS v, count(*) AS n FROM lp GROUP BY 1)
SELECT 'f' || f AS field_id, 'b' || b AS frame_id, dy, dx, round(CASE WHEN sd > 0 THEN (score - m) / sd END, 4) AS z,
  round(CASE WHEN pk.n < whole.n AND whole.v > pk.total THEN pk.total / pk.n / ((whole.v - pk.total) / (whole.n - pk.n)) END, 4) AS contrast, round(coalesce(area.n, 0) / {HEIGHT * WIDTH}, 4) AS mask_fraction
FROM pairs JOIN whole USING (f) LEFT JOIN area USING (b) LEFT JOIN pk USING (f, b) LEFT JOIN sd USING (f, b)"""
    return {"q_background_levels": levels, "q_flat_field": flat, "q_rolling_ball": ball, "q_mask_placement": place}
