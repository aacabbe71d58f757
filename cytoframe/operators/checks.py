"""Many rules over a table in one scan: rows judged, routed, and their issues tallied with the first few listed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E

LEVELS = ("error", "warning")


@dataclass(frozen=True)
class Rule:
    """``broken`` holds where a row breaks the rule; null counts as not broken."""

    level: str
    column: str
    name: str
    broken: Column


def rules_from(config: Sequence[dict[str, str]]) -> list[Rule]:
    """Rules of a configuration: level, column, rule, and the SQL condition under which it is broken."""
    out = [Rule(r["level"], r["column"], r["rule"], F.expr(r["broken"])) for r in config]
    if unknown := sorted({r.level for r in out} - set(LEVELS)):
        raise ValueError(f"levels are {LEVELS}, not {unknown}")
    if len({(r.column, r.name) for r in out}) < len(out):
        raise ValueError("two rules have the same column and name")
    return out


def judge(df: DataFrame, rules: Sequence[Rule], into: str = "issues") -> DataFrame:
    """``df`` with a column of its broken rules in their order: (level, column, rule).  All rules are one projection, so the table is read once."""
    kind = "array<struct<level:string,column:string,rule:string>>"
    each = [F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.level).alias("level"), F.lit(r.column).alias("column"), F.lit(r.name).alias("rule"))) for r in rules]
    return df.withColumn(into, F.array_compact(F.array(*each)).cast(kind) if each else F.array().cast(kind))


def refused(issues: str = "issues") -> Column:
    """Whether a judged row has an error; warnings refuse nothing."""
    return F.exists(issues, lambda x: x["level"] == "error")


def named(level: str, issues: str = "issues") -> Column:
    """The issues of one level as text: column and rule, joined by semicolons."""
    return F.array_join(F.transform(F.filter(issues, lambda x: x["level"] == level), lambda x: F.concat_ws(": ", x["column"], x["rule"])), "; ")


def mark_repeats(judged: DataFrame, keys: Sequence[str], column: str, name: str, issues: str = "issues") -> DataFrame:
    """An error on every row whose keys another row has too; rows with a null key repeat nothing.

    Keys are counted before they meet the rows again, so a key with very many rows is one row on the counted side.
    """
    again = judged.na.drop(subset=list(keys)).groupBy(*keys).count().where("count > 1").select(*keys, F.lit(True).alias("_again"))
    one = F.array(F.struct(F.lit("error").alias("level"), F.lit(column).alias("column"), F.lit(name).alias("rule")))
    joined = judged.join(again, list(keys), "left")
    return joined.withColumn(issues, F.when(F.col("_again"), F.concat(issues, one)).otherwise(F.col(issues))).select(*judged.columns)


def tally(judged: DataFrame, key: str, limit: int = 20, issues: str = "issues") -> DataFrame:
    """(level, column, rule, n, first): how many rows break each rule, exactly, and the ``limit`` smallest keys of them in order.

    Counts are combined before the shuffle, and the lists are cut to ``limit`` before it as well, whatever share of
    the rows breaks one rule.  Rules that nothing breaks have no row; null keys come first.
    """
    x = judged.select(F.col(key).alias("key"), F.explode(issues).alias("x")).select("key", "x.*")
    by = ["level", "column", "rule"]
    counted = x.groupBy(*by).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("key").asc_nulls_first()))
    listed = x.withColumn("place", place).where(F.col("place") <= limit)
    # collect_list drops nulls, so keys travel in structs.
    first = listed.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("place", "key"))).alias("f"))
    return counted.join(first, by).select(*by, "n", F.transform("f", lambda s: s["key"].cast("string")).alias("first"))


# --- image manifests -----------------------------------------------------------------------------------

#: Columns of an image manifest that must be there, and those that only the analysis needs.
REQUIRED = (
    "session_id", "timepoint", "acquisition_order", "green_path", "red_path", "bright_field_path", "exposure_ms_green", "exposure_ms_red",
    "nd_filter_green", "nd_filter_red", "objective", "burner_hours", "lamp_warmup_minutes",
)
FOR_ANALYSIS = ("sample_id", "condition_id", "measurement_time_hours")


def manifest_rules(columns: Sequence[str], objectives: Sequence[str]) -> list[Rule]:
    """Row rules of a text manifest with these columns: exposures, times, objectives, paths and identifiers."""
    have = set(columns)
    number, text = (lambda c: F.trim(c).try_cast("double")), (lambda c: F.coalesce(F.trim(c), F.lit("")))
    rules = [Rule("error", c, "not a positive number", ~F.coalesce(number(c) > 0, F.lit(False)) | F.isnan(number(c))) for c in ("exposure_ms_green", "exposure_ms_red") if c in have]
    if "measurement_time_hours" in have:
        t = "measurement_time_hours"
        rules.append(Rule("error", t, "not a number of hours from 0 on", (text(t) != "") & (~F.coalesce(number(t) >= 0, F.lit(False)) | F.isnan(number(t)))))
        rules.append(Rule("warning", t, "blank", text(t) == ""))
    if "objective" in have:
        rules.append(Rule("error", "objective", "unknown", ~F.upper(text("objective")).isin(*objectives)))
    rules += [Rule("error", c, "empty", text(c) == "") for c in ("green_path", "red_path") if c in have]
    if "session_id" in have:
        rules.append(Rule("warning", "session_id", "not <yyyymmdd>_<stressor>_<tr|nt>", ~text("session_id").rlike(E.SESSION_ID)))
    return rules


def judge_manifest(rows: DataFrame, objectives: Sequence[str], files: DataFrame | None = None) -> DataFrame:
    """A text manifest with its issues; ``files`` is a table (path) of what exists, against which all named paths are looked up.

    Null cells count as blank.  Missing columns are not row issues: ``missing_columns`` names them.
    """
    judged = judge(rows, manifest_rules(rows.columns, objectives))
    for c in [c for c in ("green_path", "red_path", "bright_field_path") if files is not None and c in rows.columns]:
        there = files.select(F.col("path").alias(c), F.lit(True).alias("_there")).distinct()
        one = F.array(F.struct(F.lit("error").alias("level"), F.lit(c).alias("column"), F.lit("file not found").alias("rule")))
        lost = F.col("_there").isNull() & (F.coalesce(F.trim(c), F.lit("")) != "")
        judged = judged.join(there, c, "left").withColumn("issues", F.when(lost, F.concat("issues", one)).otherwise(F.col("issues"))).select(*judged.columns)
    keys = ("session_id", "condition_id", "sample_id")
    return mark_repeats(judged, keys, "sample_id", "same session, condition and sample as another row") if set(keys) <= set(rows.columns) else judged


def missing_columns(columns: Sequence[str]) -> list[tuple[str, str, str]]:
    """(level, column, rule) of a manifest's missing columns."""
    return [("error", c, "missing") for c in REQUIRED if c not in columns] + [("warning", c, "missing: no analysis") for c in FOR_ANALYSIS if c not in columns]


def session_report(rows: DataFrame) -> DataFrame:
    """(session_id, day, stressor, strain, fields, doses, unknown_doses, no_control, no_baseline): one row per well-named session.

    ``unknown_doses`` counts fields whose condition names no dose of the session's stressor; ``no_control`` marks a transfected session
    without a 0 µM condition, ``no_baseline`` a stressor without any non-transfected session.
    """
    s, c = F.col("session_id"), F.col("condition_id")
    part = lambda i: E.part(s, E.SESSION_ID, i)
    named_rows = rows.where(F.coalesce(s.rlike(E.SESSION_ID), F.lit(False))).select("session_id", c, part(1).alias("day"), part(2).alias("stressor"), part(3).alias("strain"))
    dose = F.when(E.part(c, E.CONDITION_ID, 1) == F.col("stressor"), E.part(c, E.CONDITION_ID, 2).cast("double"))
    per = named_rows.withColumn("dose", dose).groupBy("session_id", "day", "stressor", "strain")
    r = per.agg(F.count("*").alias("fields"), F.sort_array(F.collect_set("dose")).alias("doses"), F.count_if(F.col("dose").isNull()).alias("unknown_doses"))
    based = r.where("strain = 'nt'").select("stressor", F.lit(True).alias("_based")).distinct()
    r = r.withColumn("no_control", (F.col("strain") == "tr") & ~F.array_contains("doses", 0.0)).join(based, "stressor", "left")
    return r.select("session_id", "day", "stressor", "strain", "fields", "doses", "unknown_doses", "no_control", F.col("_based").isNull().alias("no_baseline"))
