"""Ordered-group statistics: peaks, credible sets, false discovery rates, interval merging, lines and scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E


def peaks(curve: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    """(keys, t_max_sampled, v_max, t_peak, bracketed, position, n_points): the first highest sample, refined by a parabola through its neighbours."""
    w = Window.partitionBy(*keys).orderBy("t")
    c = curve.where(F.col(t).isNotNull() & F.col(v).isNotNull()).select(*keys, F.col(t).cast("double").alias("t"), F.col(v).cast("double").alias("v"))
    for name, f in (("before", F.lag), ("after", F.lead)):
        c = c.withColumn(f"t_{name}", f("t").over(w)).withColumn(f"v_{name}", f("v").over(w))
    top = F.max_by(F.struct("t", "v", "t_before", "v_before", "t_after", "v_after"), F.struct("v", (-F.col("t")).alias("early")))
    p = c.groupBy(*keys).agg(top.alias("m"), F.count("*").alias("n_points")).select(*keys, "n_points", "m.*")
    # Divided differences of the parabola through three points.
    s1 = F.try_divide(F.col("v") - F.col("v_before"), F.col("t") - F.col("t_before"))
    s2 = F.try_divide(F.col("v_after") - F.col("v"), F.col("t_after") - F.col("t"))
    a = F.try_divide(s2 - s1, F.col("t_after") - F.col("t_before"))
    vertex = (F.col("t_before") + F.col("t")) / 2 - F.try_divide(s1, 2 * a)
    inside = F.col("t_before").isNotNull() & F.col("t_after").isNotNull()
    few = F.col("n_points") < 2
    position = F.when(few, "too_few_points").when(F.col("t_before").isNull(), "first_sample").when(F.col("t_after").isNull(), "last_sample").otherwise("bracketed")
    refined = F.when(inside & (a < 0), F.least(F.greatest(vertex, F.col("t_before")), F.col("t_after"))).otherwise(F.col("t"))
    return p.select(*keys, F.when(~few, F.col("t")).alias("t_max_sampled"), F.when(~few, F.col("v")).alias("v_max"), F.when(~few, refined).alias("t_peak"), (inside & ~few).alias("bracketed"), position.alias("position"), "n_points")


def excess_over_control(peak_rows: DataFrame, curves: DataFrame, value: str) -> DataFrame:
    """Peaks (session_id, dose_uM, t_max_sampled) with the curve's value there minus the interpolated 0 µM; null for 0 µM and outside its range."""
    from .interpolation import interpolate_join

    own = curves.select("session_id", "dose_uM", F.col("time_h").alias("t_max_sampled"), F.col(value).alias("_own"))
    p = peak_rows.join(own, ["session_id", "dose_uM", "t_max_sampled"], "left")
    p = interpolate_join(p, curves.where("dose_uM = 0"), ["session_id"], t="time_h", v=value, at="t_max_sampled", out="_control")
    return p.withColumn("excess", F.when(F.col("dose_uM") != 0, F.col("_own") - F.col("_control"))).drop("_own", "_control")


def credible_set(masses: DataFrame, keys: list[str], item: str, mass: str, level: float = 0.8) -> DataFrame:
    """Rows of the most probable items until their mass reaches the level; equal masses go in order of item, last first."""
    w = Window.partitionBy(*keys).orderBy(F.col(mass).desc(), F.col(item).desc())
    before = F.coalesce(F.sum(mass).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return masses.withColumn("mass_before", before).where(F.col("mass_before") < level - 1e-12).drop("mass_before")


def highest_mass_region(masses: DataFrame, keys: list[str], mass: str, level: float = 0.95) -> DataFrame:
    """Rows in the smallest set of highest masses that reaches the level; masses that tie with the last one all stay."""
    w = Window.partitionBy(*keys).orderBy(F.col(mass).desc()).rowsBetween(Window.unboundedPreceding, -1)
    m = masses.withColumn("_before", F.coalesce(F.sum(mass).over(w), F.lit(0.0)))
    whole = Window.partitionBy(*keys)
    m = m.withColumn("_cut", F.min(F.when(F.col("_before") < level, F.col(mass))).over(whole))
    return m.where((F.col(mass) >= F.col("_cut")) | E.close(F.col(mass), F.col("_cut"), 1e-12, 0.0)).drop("_before", "_cut")


def _adjusted(df: DataFrame, p: str, out: str) -> DataFrame:
    from .acquisition import numbered

    tests = numbered(df.where(F.col(p).isNotNull()), [p], "_rank")
    n = tests.count()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    raw = F.least(F.lit(1.0), F.col(p) * n / (F.col("_rank") + 1))
    t = tests.withColumn("_raw", raw).withColumn("_part", F.floor(F.col("_rank") / max(1, -(-n // parts))))
    # A row for each stretch, of which there are as many as shuffle partitions.
    later = t.groupBy("_part").agg(F.min("_raw").alias("_least")).withColumn("_later", F.min("_least").over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))).drop("_least")
    tail = Window.partitionBy("_part").orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_own", F.min("_raw").over(tail)).join(F.broadcast(later), "_part")
    done = t.select(*df.columns, F.least("_own", "_later").alias(out))
    return done.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def benjamini_hochberg(df: DataFrame, p: str, keys: list[str] = (), out: str = "q_bh") -> DataFrame:
    """False-discovery-rate adjusted p-values within each key; null p-values stay null and do not count.

    With keys each is a group of its own.  Without, the tests are numbered in the order of p by ranges, and the minimum from each on is that of its
    stretch of numbers and of the stretches after, so nothing gathers the table.
    """
    here = list(keys)
    if not here:
        return _adjusted(df, p, out)
    by = Window.partitionBy(*here)
    up = by.orderBy(F.col(p).asc_nulls_last())
    d = df.withColumn("_rank", F.row_number().over(up)).withColumn("_n", F.count(p).over(by))
    raw = F.col(p) * F.col("_n") / F.col("_rank")
    tail = by.orderBy("_rank").rowsBetween(0, Window.unboundedFollowing)
    return d.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(raw).over(tail)))).drop("_rank", "_n")


def merge_intervals(df: DataFrame, keys: list[str], lower: str, upper: str, tolerance: float = 1e-12) -> DataFrame:
    """(keys, lower, upper) with overlapping or touching intervals joined; touching allows for the tolerance, relative above 1."""
    w = Window.partitionBy(*keys).orderBy(lower, upper)
    reach = F.max(upper).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(lower) <= reach + tolerance * F.greatest(F.lit(1.0), F.abs(F.col(lower))), 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min(lower).alias(lower), F.max(upper).alias(upper)).drop("_run")


def cell_widths(axis: DataFrame, keys: list[str], x: str, low: float, high: float) -> DataFrame:
    """``axis`` with the width of each node's cell: borders midway between neighbours, ``low`` and ``high`` at the ends."""
    w = Window.partitionBy(*keys).orderBy(x)
    left = F.coalesce((F.lag(x).over(w) + F.col(x)) / 2, F.lit(float(low)))
    right = F.coalesce((F.lead(x).over(w) + F.col(x)) / 2, F.lit(float(high)))
    return axis.withColumn("width", right - left)


def not_increasing(df: DataFrame, keys: list[str], order: str, x: str) -> DataFrame:
    """Rows whose value is not above the one before."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_before", F.lag(x).over(w)).where(F.col(x) <= F.col("_before")).drop("_before")


def late_drift(df: DataFrame, keys: list[str], t: str, v: str, share: float = 0.1) -> DataFrame:
    """(keys, drift): largest distance from the last value over the last share of the points, relative to that value."""
    w = Window.partitionBy(*keys).orderBy(t)
    whole = Window.partitionBy(*keys)
    d = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(whole)).withColumn("_last", F.max_by(v, t).over(whole))
    tail = d.where(F.col("_i") > F.col("_n") - F.greatest(F.lit(1), F.ceil(F.col("_n") * share)))
    return tail.groupBy(*keys).agg(F.max(F.abs(F.col(v) - F.col("_last")) / F.greatest(F.abs(F.col("_last")), F.lit(1e-12))).alias("drift"))


def line_fits(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Least-squares lines per group and over all rows (group 'all'); a group with one x is reported with its mean."""
    t = df.groupingSets([[group], []], group).agg(
        F.grouping(group).alias("pooled"), F.count("*").alias("n_fields"), F.countDistinct(x).alias("n_x"), F.avg(y).alias("mean_y"),
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2_raw"),
        F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.array_join(F.array_sort(F.collect_set(F.col(x).cast("string"))), " ").alias("x_values"),
    )
    one = F.col("n_x") < 2
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    return t.select(
        F.when(F.col("pooled") == 1, F.lit("all")).otherwise(F.col(group).cast("string")).alias(group),
        "n_fields", "x_values", F.when(one, "single_exposure").otherwise("linear").alias("fit"),
        F.when(one, F.col("mean_y")).alias("mean"), F.when(~one, F.col("intercept")).alias("offset"), F.when(~one, F.col("slope")).alias("rate"),
        F.when(~one & (F.col("syy") > 0), 1 - rest / F.col("syy")).alias("r2"), F.when(~one, F.sqrt(rest / F.col("n_fields"))).alias("rmse"),
    )


def session_scale(pairs: DataFrame, keys: list[str], image: str, model: str, min_pairs: int = 3) -> DataFrame:
    """(keys, c_session, rmse, n_pairs): least squares through the origin of image on model ratios; fewer pairs give nulls."""
    c = F.try_divide(F.sum(F.col(image) * F.col(model)), F.sum(F.col(model) * F.col(model)))
    s = pairs.groupBy(*keys).agg(F.count("*").alias("n_pairs"), c.alias("c"), F.sum(F.col(image) * F.col(image)).alias("yy"), F.sum(F.col(image) * F.col(model)).alias("xy"), F.sum(F.col(model) * F.col(model)).alias("xx"))
    ok = F.col("n_pairs") >= min_pairs
    rss = F.greatest(F.col("yy") - 2 * F.col("c") * F.col("xy") + F.col("c") * F.col("c") * F.col("xx"), F.lit(0.0))
    return s.select(*keys, F.when(ok, F.col("c")).alias("c_session"), F.when(ok, F.sqrt(rss / F.col("n_pairs"))).alias("rmse"), "n_pairs")


def scale_diagnostics(pairs: DataFrame, keys: list[str], image: str, model: str) -> DataFrame:
    """Root mean square errors of a line through the origin and of a free line."""
    c = F.try_divide(F.sum(F.col(image) * F.col(model)), F.sum(F.col(model) * F.col(model)))
    s = pairs.groupBy(*keys).agg(F.count("*").alias("n"), c.alias("scale"), F.regr_slope(image, model).alias("slope"), F.regr_intercept(image, model).alias("intercept"))
    j = pairs.join(s, keys)
    e0, e1 = F.col(image) - F.col("scale") * F.col(model), F.col(image) - F.col("slope") * F.col(model) - F.col("intercept")
    return j.groupBy(*keys, "n", "scale", "slope", "intercept").agg(F.sqrt(F.avg(e0 * e0)).alias("rmse_origin"), F.sqrt(F.avg(e1 * e1)).alias("rmse_affine"))


def bootstrap_p(share_low: Column, share_high: Column, n: Column) -> Column:
    """Two-sided p from the shares of replicates at or beyond zero on either side; at least 1 / (n + 1)."""
    return F.least(F.lit(1.0), F.greatest(2 * F.least(share_low, share_high), 1.0 / (n + 1)))


def pooled_covariance(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(n, groups, dof, xx, xy, yy): within-group covariance pooled over the groups."""
    m = df.groupBy(*group).agg(F.count("*").alias("n"), F.covar_samp(x, x).alias("xx"), F.covar_samp(x, y).alias("xy"), F.covar_samp(y, y).alias("yy"))
    dof = F.sum(F.col("n") - 1)
    w = lambda c: F.try_divide(F.sum(F.coalesce(F.col(c), F.lit(0.0)) * (F.col("n") - 1)), dof).alias(c)
    return m.agg(F.sum("n").alias("n"), F.count("*").alias("groups"), dof.alias("dof"), w("xx"), w("xy"), w("yy"))
