"""Pure column functions shared by the operators.

Tables hold null, never NaN, where a value is missing (``sources.tables.nan_to_null``), so that comparisons and
aggregates treat it as missing.  Divisions that may meet a zero use ``try_divide``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 0.99 quantiles of chi-square by degrees of freedom.
CHI2_99 = {1: 6.6348966010212145, 2: 9.210340371976184, 3: 11.344866730144373, 4: 13.276704135987622}
#: Forms of session and condition ids.
SESSION_ID = r"^(\d{8})_([a-z0-9]+)_(tr|nt)$"
CONDITION_ID = r"^([a-z0-9]+)_(\d+(?:\.\d+)?)uM(?:_|$)"


def part(column: Column, pattern: str, group: int) -> Column:
    """A group of a pattern, or null where it does not match."""
    return F.when(column.rlike(pattern), F.regexp_extract(column, pattern, group))


def truthy(column: Column) -> Column:
    """True for booleans and the texts true and 1 in any case; all else, and null, is false."""
    return F.coalesce(F.lower(column.cast("string")).isin("true", "1"), F.lit(False))


def usable(qc: Column | str = "qc_pass", edge: Column | str = "edge_flag") -> Column:
    """Cells that pass quality control and do not touch the frame's edge."""
    qc, edge = (F.col(c) if isinstance(c, str) else c for c in (qc, edge))
    return truthy(qc) & ~truthy(edge)


def ratio(red: Column, green: Column) -> Column:
    """red / green, null where green is not positive."""
    return F.when(green > 0, F.try_divide(red, green))


def guarded_ratio(red: Column, green: Column, floor: float = 0.0) -> Column:
    """red / green, null unless both are above the floor."""
    return F.when((green > floor) & (red > floor), F.try_divide(red, green))


def log_ratio(red: Column, green: Column) -> Column:
    """log(red / green), null unless both are positive."""
    return F.when((red > 0) & (green > 0), F.log(F.try_divide(red, green)))


def finite(column: Column) -> Column:
    """Neither null, NaN nor infinite."""
    c = column.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def clean(column: Column) -> Column:
    """Null for NaN."""
    c = column.cast("double")
    return F.when(~F.isnan(c), c)


def number(column: Column) -> Column:
    """A text as a double, null where it is none."""
    return clean(column.try_cast("double"))


def close(a: Column, b: Column, rtol: float = 0.0, atol: float = 1e-12) -> Column:
    """|a - b| <= atol + rtol * |b|."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def quantile(column: Column | str, q: float) -> Column:
    """Exact quantile with linear interpolation, over non-null values."""
    return F.percentile(column, q)


def median(column: Column | str) -> Column:
    return F.percentile(column, 0.5)


def array_quantile(values: Column, q: float) -> Column:
    """The same quantile of a sorted array without nulls; null where it is empty."""
    at = F.lit(float(q)) * (F.size(values) - 1)
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def time_window(hours: Column, edges: list[float]) -> Column:
    """Index of the window that holds each time: right-open, the last one closed; -1 outside or unknown."""
    n = len(edges) - 1
    cases = F.when(~finite(hours), -1)
    for i in range(n):
        upper = (hours <= edges[i + 1]) | close(hours, F.lit(float(edges[i + 1])), 1e-5, 1e-8) if i == n - 1 else hours < edges[i + 1]
        cases = cases.when((hours >= edges[i]) & upper, i)
    return cases.otherwise(-1)


def window_labels(edges: list[float]) -> list[str]:
    return [f"{a:g}–{b:g} h" for a, b in zip(edges, edges[1:])]  # noqa: B905


def entropy_bits(masses: Column) -> Column:
    """Entropy of an array of masses in bits; zero masses add nothing."""
    return -F.aggregate(masses, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def log_sum_exp(values: Column) -> Column:
    """log of the sum of exponentials of an array."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def slug(column: Column) -> Column:
    """Lower-case words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(column), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def spaces(column: Column) -> Column:
    """Trimmed, runs of white space as one space."""
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def clock_hours(start: Column, end: Column) -> Column:
    """Hours from one HH:MM to another with 3 decimals; across midnight the result is negative and left so."""
    minutes = lambda c: F.split(c, ":")[0].cast("int") * 60 + F.split(c, ":")[1].cast("int")
    ok = start.rlike(r"^\d{1,2}:\d{2}$") & end.rlike(r"^\d{1,2}:\d{2}$")
    return F.when(ok, F.bround((minutes(end) - minutes(start)) / F.lit(60.0), 3))


def tiff_time(text: Column) -> Column:
    """A TIFF DateTime text in any of its three forms, else null."""
    forms = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in forms))


def interpolate(knots: Column, t: Column, flat: bool) -> Column:
    """Linear interpolation at ``t`` in an array of (t, v) structs sorted by t; outside the range the nearest value, or null.

    For knot sets that fit in a row; ``operators.interpolation`` joins larger ones.
    """
    below = F.filter(knots, lambda k: k["t"] <= t)
    above = F.filter(knots, lambda k: k["t"] > t)
    lo, hi = F.element_at(below, -1), F.get(above, 0)
    inner = lo["v"] + (hi["v"] - lo["v"]) * F.try_divide(t - lo["t"], hi["t"] - lo["t"])
    has_lo, has_hi = F.size(below) > 0, F.size(above) > 0
    at_end = F.when(has_lo & (lo["t"] == t), lo["v"])
    outside = F.when(has_lo, lo["v"]).otherwise(hi["v"]) if flat else at_end
    return F.when(t.isNull() | (F.size(knots) == 0), None).when(has_lo & has_hi, inner).otherwise(outside)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def reasons(pairs: dict[str, Column]) -> Column:
    """Names of the conditions that hold, joined by semicolons."""
    return F.concat_ws(";", *(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in pairs.items()))
