"""Decoders on model grids: compatibility of doses, of doses and times, and grid posteriors.

A grid is a long table (artifact_id, dose_uM, time_h, ratio, green); observations are long tables with an obs_id, each of one artifact.
Grids are small next to the observations: a whole grid is one row of arrays, which Spark broadcasts while it is below its threshold and joins
on its id otherwise.  So an observation is one row too and meets its grid there: its rows are shuffled once, their products with the grid never.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from . import stats

_SAME = 1e-12


def _status(n: Column, outside: Column, one: str, none: str) -> Column:
    return F.when(n == 1, one).when(n > 1, "ambiguous").when(outside, "out_of_response_domain").otherwise(none)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once for each row, however often a lambda in it asks."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _by_observation(observations: DataFrame, *columns: Column) -> DataFrame:
    """(obs_id, artifact_id, rows): the rows of each observation as an array, after one shuffle by obs_id."""
    n = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = observations.select("obs_id", "artifact_id", *columns).repartition(n, "obs_id")
    return dealt.groupBy("obs_id", "artifact_id").agg(F.collect_list(F.struct(*(F.col(c) for c in dealt.columns[2:]))).alias("rows"))


def _matrices(grid: DataFrame) -> DataFrame:
    """(artifact_id, doses, times): one row for each grid; ``times`` has t, the ratios there in the order of ``doses`` (null: no such node), and their range."""
    doses = grid.groupBy("artifact_id").agg(F.array_sort(F.collect_set("dose_uM")).alias("doses"))
    nodes = grid.groupBy("artifact_id", F.col("time_h").alias("t")).agg(F.collect_list(F.struct("dose_uM", "ratio")).alias("n"), F.min("ratio").alias("lo"), F.max("ratio").alias("hi"))
    at = lambda d: F.get(F.filter("n", lambda x: x["dose_uM"] == d), F.lit(0))["ratio"]
    row = F.struct("t", F.transform("doses", at).alias("ratios"), "lo", "hi")
    return nodes.join(doses, "artifact_id").select("artifact_id", "doses", row.alias("_r")).groupBy("artifact_id", "doses").agg(F.array_sort(F.collect_list("_r")).alias("times"))


def _and(held: Column, more: Column) -> Column:
    """Conjunction that nulls do not count in, as in ``bool_and``."""
    return F.when(held.isNull(), more).when(more.isNull(), held).otherwise(held & more)


def _no(kind: str) -> Column:
    return F.transform("doses", lambda d: F.lit(None).cast(kind))


def decode_dose(grid: DataFrame, observations: DataFrame, green_floor: float | None = None) -> DataFrame:
    """(obs_id, status, candidate_doses_uM, dose_estimate_uM) for observations (obs_id, artifact_id, time_h, ratio, tolerance[, green]).

    A dose stays if all its ratios lie within the tolerance at all observed times, which must be the grid's times.
    With a green floor, an observation with any green at or below it has status below_detection_floor.
    """
    low = F.coalesce(F.col("green") <= green_floor, F.lit(False)) if green_floor is not None else F.lit(False)
    o = _by_observation(observations, F.col("time_h").alias("t"), F.col("ratio").alias("observed"), "tolerance", low.alias("low"))
    # Rows at times that the grid lacks do not count, and an observation of such rows alone has no result.
    met = lambda r: F.transform(F.filter("times", lambda g: E.close(g["t"], r["t"], 0.0, _SAME)), lambda g: F.struct(r.alias("r"), g.alias("g")))
    j = o.join(_matrices(grid), "artifact_id").select("obs_id", "doses", F.flatten(F.transform("rows", met)).alias("_m")).where(F.size("_m") > 0)
    residual = lambda m: F.transform(m["g"]["ratios"], lambda x: F.abs(x - m["r"]["observed"]))
    within = lambda m: F.transform(residual(m), lambda x: x <= m["r"]["tolerance"])
    worst = F.aggregate("_m", _no("double"), lambda a, m: F.zip_with(a, residual(m), lambda x, y: F.greatest(x, y)))
    fits = F.aggregate("_m", _no("boolean"), lambda a, m: F.zip_with(a, within(m), _and))
    beyond = lambda m: (m["r"]["observed"] < m["g"]["lo"] - m["r"]["tolerance"]) | (m["r"]["observed"] > m["g"]["hi"] + m["r"]["tolerance"])
    kept = F.transform(F.filter(F.arrays_zip(F.col("doses").alias("dose"), fits.alias("ok")), lambda x: F.coalesce(x["ok"], F.lit(False))), lambda x: x["dose"])
    any_ = lambda f: F.coalesce(F.exists("_m", lambda m: F.coalesce(f(m), F.lit(False))), F.lit(False))
    found = F.struct(kept.alias("c"), any_(beyond).alias("outside"), any_(lambda m: m["r"]["low"]).alias("low"), F.array_min(worst).alias("smallest_residual"))

    def result(x: Column) -> Column:
        n = F.size(x["c"])
        c = F.when(x["low"], F.array().cast("array<double>")).otherwise(x["c"])
        status = F.when(x["low"], "below_detection_floor").otherwise(_status(n, x["outside"], "unique_grid_match", "no_grid_match"))
        return F.struct(status.alias("status"), c.alias("candidate_doses_uM"), F.when(~x["low"] & (n == 1), F.get(x["c"], F.lit(0))).alias("dose_estimate_uM"), x["smallest_residual"].alias("smallest_residual"))

    return j.select("obs_id", F.inline(F.array(_let(found, result))))


def decode_joint(grid: DataFrame, observations: DataFrame, offsets: DataFrame) -> DataFrame:
    """(obs_id, status, candidate_pairs, dose_estimate_uM, elapsed_time_hours) for observations (obs_id, artifact_id, relative_h, ratio, tolerance).

    Every offset (artifact_id, elapsed_h) shifts the known spacing; each shifted time must be one time of the grid.
    """
    g = grid.select("artifact_id", F.col("time_h").alias("_t")).distinct()
    # Spacings are few next to observations, and one that is refused is so for all that have it.
    spacings = observations.select("artifact_id", "relative_h").distinct().join(offsets, "artifact_id")
    at = F.col("relative_h") + F.col("elapsed_h")
    times = spacings.join(g, "artifact_id", "left").groupBy("artifact_id", "elapsed_h", "relative_h").agg(F.count_if(E.close(F.col("_t"), at, 0.0, _SAME)).alias("n"))
    from .expect import expect

    expect(times, {"a shifted time is not exactly one of the grid's": F.col("n") != 1})
    shifts = offsets.groupBy("artifact_id").agg(F.array_sort(F.collect_set("elapsed_h")).alias("shifts"))
    o = _by_observation(observations, F.col("relative_h").alias("t"), F.col("ratio").alias("observed"), "tolerance")
    j = o.join(_matrices(grid).join(shifts, "artifact_id"), "artifact_id")
    # By row, the grid's entry at each shifted time, in the order of the shifts.
    entry = lambda r, e: F.get(F.filter("times", lambda g: E.close(g["t"], r["t"] + e, 0.0, _SAME)), F.lit(0))
    j = j.select("obs_id", "doses", "shifts", F.transform("rows", lambda r: F.struct(r.alias("r"), F.transform("shifts", lambda e: entry(r, e)).alias("g"))).alias("_m"))
    beyond = lambda m: (m["r"]["observed"] < F.array_min(m["g"]["lo"]) - m["r"]["tolerance"]) | (m["r"]["observed"] > F.array_max(m["g"]["hi"]) + m["r"]["tolerance"])
    within = lambda m, i: F.transform(F.get(m["g"], i)["ratios"], lambda x: F.abs(x - m["r"]["observed"]) <= m["r"]["tolerance"])
    fits = lambda i: F.aggregate("_m", _no("boolean"), lambda a, m: F.zip_with(a, within(m, i), _and))
    pair = lambda d, e, ok: F.when(ok, F.struct(d.alias("dose_uM"), e.alias("elapsed_h")))
    pairs = F.flatten(F.transform("shifts", lambda e, i: F.zip_with("doses", fits(i), lambda d, ok: pair(d, e, ok))))
    outside = F.exists("_m", lambda m: F.coalesce(beyond(m), F.lit(False)))
    found = F.struct(F.array_sort(F.filter(pairs, lambda p: p.isNotNull())).alias("c"), outside.alias("outside"))

    def result(x: Column) -> Column:
        n, first = F.size(x["c"]), F.get(x["c"], F.lit(0))
        status = _status(n, x["outside"], "unique_grid_pair", "no_grid_pair_match")
        return F.struct(status.alias("status"), x["c"].alias("candidate_pairs"), F.when(n == 1, first["dose_uM"]).alias("dose_estimate_uM"), F.when(n == 1, first["elapsed_h"]).alias("elapsed_time_hours"))

    return j.select("obs_id", F.inline(F.array(_let(found, result))))


def normalise_snapshot(observations: DataFrame, calibrations: DataFrame, green_floor: float) -> DataFrame:
    """Observations (obs_id, session_id, image_ratio, image_green) in model units by their session's calibration; nothing is clipped.

    Calibrations: (session_id, artifact_id, c_session, image_low, image_high, model_low, model_high).
    """
    o = observations.join(calibrations, "session_id")
    green = F.try_divide(F.col("image_green") - F.col("image_low"), F.col("image_high") - F.col("image_low"))
    return o.select("obs_id", "artifact_id", F.try_divide("image_ratio", "c_session").alias("ratio_obs"), green.alias("green_obs"), ((green < 0) | (green > 1)).alias("green_outside_reference"), "model_low", "model_high", (F.col("image_green") <= green_floor).alias("low"))


def _against(grid: DataFrame, prepared: DataFrame) -> DataFrame:
    norm = F.try_divide(F.col("green") - F.col("model_low"), F.col("model_high") - F.col("model_low"))
    return prepared.join(grid, "artifact_id").withColumn("green_norm", norm)


def decode_snapshot(grid: DataFrame, prepared: DataFrame, ratio_tolerance: float, green_tolerance: float) -> DataFrame:
    """Two-observable compatibility of prepared observations: candidates, counts by one observable alone, status."""
    j = _against(grid, prepared)
    r, g = F.abs(F.col("ratio") - F.col("ratio_obs")) <= ratio_tolerance, F.abs(F.col("green_norm") - F.col("green_obs")) <= green_tolerance
    beyond = lambda c, o, t: (F.min(o) < F.min(c) - t) | (F.max(o) > F.max(c) + t)
    s = j.groupBy("obs_id").agg(
        F.count_if(r).alias("ratio_only"), F.count_if(g).alias("green_only"), F.array_sort(F.collect_list(F.when(r & g, F.struct("dose_uM", "time_h")))).alias("c"),
        (beyond("ratio", "ratio_obs", ratio_tolerance) | beyond("green_norm", "green_obs", green_tolerance)).alias("outside"), F.bool_or("low").alias("low"),
    )
    n, first = F.size("c"), F.get("c", F.lit(0))
    ok = ~F.col("low")
    status = F.when(F.col("low"), "below_detection_floor").otherwise(_status(n, F.col("outside"), "unique_grid_pair", "no_grid_pair_match"))
    return s.select("obs_id", status.alias("status"), F.when(ok, F.col("c")).alias("candidate_pairs"), F.when(ok, F.col("ratio_only")).alias("ratio_only"), F.when(ok, F.col("green_only")).alias("green_only"), F.when(ok & (n == 1), first["dose_uM"]).alias("dose_estimate_uM"), F.when(ok & (n == 1), first["time_h"]).alias("elapsed_time_hours"))


def prior_masses(grid: DataFrame, kind: str, *, dose_bounds: tuple[float, float] | None = None, time_bounds: tuple[float, float] | None = None, masses: DataFrame | None = None) -> DataFrame:
    """The grid with a prior that sums to one per artifact: uniform_grid, uniform_density (cell areas within bounds) or explicit_mass."""
    if kind == "uniform_grid":
        g = grid.withColumn("_m", F.lit(1.0))
    elif kind == "uniform_density":
        if dose_bounds is None or time_bounds is None:
            raise ValueError("uniform_density needs bounds")
        d = stats.cell_widths(grid.select("artifact_id", "dose_uM").distinct(), ["artifact_id"], "dose_uM", *dose_bounds).withColumnRenamed("width", "_d")
        t = stats.cell_widths(grid.select("artifact_id", "time_h").distinct(), ["artifact_id"], "time_h", *time_bounds).withColumnRenamed("width", "_w")
        from .expect import expect

        expect(d, {"dose bounds must enclose the grid": F.col("_d") <= 0})
        expect(t, {"time bounds must enclose the grid": F.col("_w") <= 0})
        g = grid.join(d, ["artifact_id", "dose_uM"]).join(t, ["artifact_id", "time_h"]).withColumn("_m", F.col("_d") * F.col("_w")).drop("_d", "_w")
    elif kind == "explicit_mass":
        g = grid.join(masses.withColumnRenamed("mass", "_m"), ["artifact_id", "dose_uM", "time_h"])
    else:
        raise ValueError("unknown kind of prior; there are uniform_grid, uniform_density and explicit_mass")
    return g.withColumn("prior", F.col("_m") / F.sum("_m").over(Window.partitionBy("artifact_id"))).drop("_m")


def posteriors(grid: DataFrame, prepared: DataFrame, covariance: tuple[float, float, float], *, credible_mass: float = 0.95) -> DataFrame:
    """(obs_id, nodes, minimum_distance, maximum_distance, mass_achieved): one row per observation that is not low, without a shuffle.

    Gaussian in (log ratio, normalised green) with covariance (xx, xy, yy), over a grid with a prior.  ``nodes`` has (dose_uM, time_h, mass,
    in_region, is_map); the region is the smallest set of highest masses that reaches the credible mass, with what ties with its last one.
    """
    xx, xy, yy = covariance
    det = xx * yy - xy * xy
    if not (xx > 0 and det > 0):
        raise ValueError("the covariance must be positive definite")
    node = F.struct("dose_uM", "time_h", F.when(F.col("ratio") > 0, F.log("ratio")).alias("x"), F.col("green").cast("double").alias("green"), F.when(F.col("prior") > 0, F.log("prior")).alias("lp"))
    nodes = grid.groupBy("artifact_id").agg(F.collect_list(node).alias("_nodes"), F.min("ratio").alias("_least"))
    grids = nodes.select("artifact_id", "_least", *(F.col("_nodes")[c].alias(f"_{c}") for c in ("dose_uM", "time_h", "x", "green", "lp")))
    j = prepared.where("not low").join(grids, "artifact_id")
    from .expect import expect

    expect(j, {"log ratios need positive observed and model ratios": (F.col("_least") <= 0) | (F.col("ratio_obs") <= 0)})
    # Plain arrays, one for each quantity, in the order of the nodes: lambdas on them are evaluated for every node of every observation.
    own = F.struct(F.log("ratio_obs").alias("x"), F.col("green_obs").alias("green"), F.col("model_low").alias("low"), (F.col("model_high") - F.col("model_low")).alias("width"))

    def distances(o: Column) -> Column:
        a, b = F.transform("_x", lambda x: o["x"] - x), F.transform("_green", lambda g: o["green"] - F.try_divide(g - o["low"], o["width"]))
        return F.zip_with(a, b, lambda a, b: a * (yy / det * a - 2 * xy / det * b) + xx / det * b * b)

    def masses(d2: Column) -> Column:
        e = lambda l: _let(F.array_max(l), lambda top: F.transform(l, lambda v: F.coalesce(F.exp(v - top), F.lit(0.0))))
        mass = lambda e: _let(total(e), lambda t: F.transform(e, lambda v: v / t))
        return F.struct(d2.alias("d2"), _let(_let(F.zip_with(d2, "_lp", lambda d, lp: lp - 0.5 * d), e), mass).alias("mass"))

    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    # From the highest mass down, the last one before which the level is not reached.
    start = F.struct(F.lit(0.0).alias("before"), F.lit(None).cast("double").alias("cut"))
    reach = lambda a, x: F.struct((a["before"] + x).alias("before"), F.when(a["before"] < credible_mass, x).otherwise(a["cut"]).alias("cut"))
    cut = lambda mass: F.aggregate(F.sort_array(mass, asc=False), start, reach)["cut"]

    def ends(m: Column) -> Column:
        possible = F.zip_with(m["d2"], "_lp", lambda d, lp: F.when(lp.isNotNull(), d))
        return F.struct(m["mass"].alias("mass"), possible.alias("d2"), (cut(m["mass"]) * (1 - 1e-12)).alias("cut"), (F.array_max(m["mass"]) * (1 - 1e-12)).alias("top"))

    def told(z: Column) -> Column:
        node = lambda p: F.struct(p["_dose_uM"].alias("dose_uM"), p["_time_h"].alias("time_h"), p["mass"].alias("mass"), F.coalesce(p["mass"] >= z["cut"], F.lit(False)).alias("in_region"), (p["mass"] >= z["top"]).alias("is_map"))
        nodes = F.transform(F.arrays_zip("_dose_uM", "_time_h", z["mass"].alias("mass")), node)
        reached = F.aggregate(z["mass"], F.lit(0.0), lambda a, x: F.when(x >= z["cut"], a + x).otherwise(a))
        return F.struct(nodes.alias("nodes"), F.array_min(z["d2"]).alias("minimum_distance"), F.array_max(z["d2"]).alias("maximum_distance"), reached.alias("mass_achieved"))

    return j.select("obs_id", F.inline(F.array(_let(_let(_let(_let(own, distances), masses), ends), told))))


def grid_posterior(grid: DataFrame, prepared: DataFrame, covariance: tuple[float, float, float], *, max_distance: float, credible_mass: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(masses, status) of ``posteriors``, a row for each node.

    masses: (obs_id, dose_uM, time_h, mass, in_region, is_map), status: (obs_id, status, minimum_distance, mass_achieved).
    """
    p = posteriors(grid, prepared, covariance, credible_mass=credible_mass)
    flat = 0.5 * (F.col("maximum_distance") - F.col("minimum_distance")) <= 1e-10
    verdict = F.when(F.col("minimum_distance") > max_distance, "poor_model_fit").when(flat, "prior_only").otherwise("posterior_available")
    done = p.select("obs_id", verdict.alias("status"), "minimum_distance", "mass_achieved")
    below = prepared.where("low").select("obs_id", F.lit("below_detection_floor").alias("status"), F.lit(None).cast("double").alias("minimum_distance"), F.lit(None).cast("double").alias("mass_achieved"))
    return p.select("obs_id", F.inline("nodes")), done.unionByName(below)


def marginals(masses: DataFrame, axis: str) -> DataFrame:
    return masses.groupBy("obs_id", axis).agg(F.sum("mass").alias("mass"))


def decode_continuous(grid: DataFrame, observations: DataFrame, allowance: DataFrame | None = None) -> DataFrame:
    """(obs_id, status, regions, dose_estimate_uM): every linear segment between neighbouring doses keeps the part that fits all times.

    observations: (obs_id, artifact_id, time_h, ratio, tolerance); allowance: (artifact_id, segment, time_h, allowed) adds to the tolerance.
    """
    w = Window.partitionBy("artifact_id", "time_h").orderBy("dose_uM")
    seg = grid.select("artifact_id", "time_h", F.col("dose_uM").alias("left"), F.lead("dose_uM").over(w).alias("right"), F.col("ratio").alias("start"), (F.lead("ratio").over(w) - F.col("ratio")).alias("slope"), F.row_number().over(w).alias("segment")).where("right is not null")
    # Observations are dealt once by their id; every step after that groups, orders and joins by it where the rows lie.
    n = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    o = observations.select("obs_id", "artifact_id", F.col("time_h").alias("_t"), F.col("ratio").alias("observed"), "tolerance").repartition(n, "obs_id")
    j = o.join(F.broadcast(seg), "artifact_id").where(E.close(F.col("time_h"), F.col("_t"), 0.0, _SAME))
    if allowance is not None:
        j = j.join(allowance, ["artifact_id", "segment", "time_h"], "left").withColumn("tolerance", F.col("tolerance") + F.coalesce("allowed", F.lit(0.0)))
    e1 = F.try_divide(F.col("observed") - F.col("tolerance") - F.col("start"), F.col("slope"))
    e2 = F.try_divide(F.col("observed") + F.col("tolerance") - F.col("start"), F.col("slope"))
    flat = F.col("slope") == 0
    misses = flat & (F.abs(F.col("start") - F.col("observed")) > F.col("tolerance"))
    s = j.groupBy("obs_id", "segment", "left", "right").agg(
        F.greatest(F.lit(0.0), F.max(F.when(~flat, F.least(e1, e2)))).alias("lo"), F.least(F.lit(1.0), F.min(F.when(~flat, F.greatest(e1, e2)))).alias("hi"), F.bool_or(misses).alias("miss"),
        F.sum(F.pow(F.col("slope") / F.col("tolerance"), 2)).alias("den"), F.sum(F.col("slope") * (F.col("observed") - F.col("start")) / F.pow("tolerance", F.lit(2))).alias("num"),
        F.sum(F.pow((F.col("start") - F.col("observed")) / F.col("tolerance"), 2)).alias("c0"),
    ).where("not miss and lo <= hi")
    alpha = F.least(F.greatest(F.when(F.col("den") > 0, F.try_divide("num", "den")).otherwise((F.col("lo") + F.col("hi")) / 2), F.col("lo")), F.col("hi"))
    s = s.withColumn("alpha", alpha)
    # The sum of squares along a segment is a parabola in alpha.
    s = s.withColumn("score", F.col("c0") - 2 * F.col("alpha") * F.col("num") + F.col("alpha") * F.col("alpha") * F.col("den"))
    at = lambda a: F.col("left") + a * (F.col("right") - F.col("left"))
    s = s.select("obs_id", at(F.col("lo")).alias("lower"), at(F.col("hi")).alias("upper"), at(F.col("alpha")).alias("estimate"), "score", (F.col("den") == 0).alias("flat"))
    regions = stats.merge_intervals(s, ["obs_id"], "lower", "upper").groupBy("obs_id").agg(F.array_sort(F.collect_list(F.struct("lower", "upper"))).alias("regions"))
    best = s.withColumn("_best", F.min("score").over(Window.partitionBy("obs_id")))
    best = best.where(E.close(F.col("score"), F.col("_best"), 1e-9, 1e-12))
    place = Window.partitionBy("obs_id").orderBy("estimate")
    best = best.withColumn("_new", ~F.coalesce(E.close(F.col("estimate"), F.lag("estimate").over(place), 1e-10, 1e-10), F.lit(False)))
    best = best.groupBy("obs_id").agg(F.array_sort(F.collect_list(F.when(F.col("_new"), F.col("estimate")))).alias("minima"))
    flats = s.groupBy("obs_id").agg(F.bool_or("flat").alias("flat"))
    span = j.groupBy("obs_id", "time_h", "observed", "tolerance").agg(F.min(F.least(F.col("start"), F.col("start") + F.col("slope"))).alias("lo"), F.max(F.greatest(F.col("start"), F.col("start") + F.col("slope"))).alias("hi"))
    domain = span.groupBy("obs_id").agg(F.bool_or((F.col("observed") < F.col("lo") - F.col("tolerance")) | (F.col("observed") > F.col("hi") + F.col("tolerance"))).alias("outside"))
    a = domain.join(regions, "obs_id", "left").join(best, "obs_id", "left").join(flats, "obs_id", "left")
    found = F.coalesce(F.size("regions"), F.lit(0))
    status = (
        F.when(F.col("regions").isNull(), F.when(F.col("outside"), "out_of_response_domain").otherwise("no_continuous_match"))
        .when(found > 1, "ambiguous").when(F.col("flat"), "flat_response").when(F.size("minima") > 1, "ambiguous").otherwise("single_compatible_region")
    )
    return a.select("obs_id", status.alias("status"), "regions", "minima", F.when(status == "single_compatible_region", F.get("minima", F.lit(0))).alias("dose_estimate_uM"))


def interpolation_check(grid: DataFrame, simulated: DataFrame, allowed: float) -> DataFrame:
    """(artifact_id, segment, time_h, max_abs_error, passed): linear interpolation against simulation between the grid's doses.

    simulated: (artifact_id, dose_uM, time_h, ratio) at doses a quarter, half and three quarters along each segment.
    """
    w = Window.partitionBy("artifact_id", "time_h").orderBy("dose_uM")
    seg = grid.select("artifact_id", "time_h", F.col("dose_uM").alias("left"), F.lead("dose_uM").over(w).alias("right"), F.col("ratio").alias("r0"), F.lead("ratio").over(w).alias("r1"), F.row_number().over(w).alias("segment")).where("right is not null")
    j = simulated.join(seg, ["artifact_id", "time_h"]).where((F.col("dose_uM") > F.col("left")) & (F.col("dose_uM") < F.col("right")))
    line = F.col("r0") + (F.col("r1") - F.col("r0")) * (F.col("dose_uM") - F.col("left")) / (F.col("right") - F.col("left"))
    e = j.groupBy("artifact_id", "segment", "time_h").agg(F.max(F.abs(line - F.col("ratio"))).alias("max_abs_error"))
    return e.withColumn("passed", F.col("max_abs_error") <= allowed)
