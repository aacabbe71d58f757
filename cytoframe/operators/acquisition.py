"""Acquisition tables: one-to-one joins with notes, clocks, hand-filled cells, known issues, numbering and overviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..sources.work import staged
from . import expect as X

#: Words for yes and no in hand-filled cells.
YES, NO = ("1", "true", "yes", "y"), ("0", "false", "no", "n")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], indicator: str | None = None) -> DataFrame:
    """Every row of ``left`` with its row of ``right``, or nulls; keys that occur twice on either side are refused.

    ``indicator`` names a boolean column that tells whether there was one.  Null keys find nothing.
    """
    for side, t in (("left", left), ("right", right)):
        X.expect_unique(t.na.drop(subset=list(keys)), list(keys), f"keys repeat on the {side} of a one-to-one join")
    mark = indicator or "_found"
    out = left.join(right.withColumn(mark, F.lit(True)), list(keys), "left").withColumn(mark, F.coalesce(mark, F.lit(False)))
    return out if indicator else out.drop(mark)


def afternoon(text: Column, day: Column) -> Column:
    """The time of a note such as 3:05, which is after noon of ``day``; null where the text is none."""
    t = F.trim(text)
    ok = t.rlike(r"^\d{1,2}:[0-5]\d$")
    minutes = (F.split(t, ":")[0].cast("int") + 12) * 60 + F.split(t, ":")[1].cast("int")
    return F.when(ok, F.timestamp_micros(F.unix_micros(F.date_trunc("day", day.cast("timestamp"))) + minutes.cast("long") * 60_000_000)).cast("timestamp_ntz")


def clock_offsets(images: DataFrame, keys: Sequence[str], image_time: str, note_time: str, tolerance_min: float) -> DataFrame:
    """``images`` with clock_offset_min (image minus note), the group's median offset, and whether an offset is further from it than the tolerance.

    Images without a note have no offset and do not disagree.
    """
    minutes = (F.unix_micros(F.col(image_time).cast("timestamp")) - F.unix_micros(F.col(note_time).cast("timestamp"))) / 60_000_000.0
    i = images.withColumn("clock_offset_min", minutes)
    m = i.groupBy(*keys).agg(E.median("clock_offset_min").alias("median_offset_min"))
    j = i.join(m, list(keys), "left")
    return j.withColumn("notes_time_disagrees", F.coalesce(F.abs(F.col("clock_offset_min") - F.col("median_offset_min")) > tolerance_min, F.lit(False)))


def session_cutoff(cells: DataFrame, keys: Sequence[str], score: str, percent: float) -> DataFrame:
    """``cells`` with in_focus: whether ``score`` reaches the session's own percentile; a cell without a score does not, unless no cell of the session has one."""
    cut = cells.groupBy(*keys).agg(E.quantile(score, percent / 100).alias("_cut"))
    j = cells.join(cut, list(keys), "left")
    return j.withColumn("in_focus", F.when(F.col("_cut").isNull(), True).otherwise(F.coalesce(F.col(score) >= F.col("_cut"), F.lit(False)))).drop("_cut")


def optional_shift(text: Column) -> Column:
    """Pixels of an optional shift: blank is 0; null where the text is no finite number (``bad_shift`` tells)."""
    n = F.trim(text).try_cast("double")
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", 0.0).when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def bad_shift(text: Column) -> Column:
    return optional_shift(text).isNull()


def expects_cells(text: Column) -> Column:
    """Whether a set should show cells: blank means yes; null where the word is neither a yes nor a no."""
    t = F.lower(F.trim(text))
    return F.when(F.coalesce(t, F.lit("")) == "", True).when(t.isin(*YES), True).when(t.isin(*NO), False)


def recorded(value: Column) -> Column:
    """A measured number, or null where it is missing or not finite; nothing takes its place."""
    v = value.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def flag_issues(rows: DataFrame, keys: Sequence[str], order: Sequence[str], overrides: DataFrame, exempt: Column | None = None) -> DataFrame:
    """Log rows with ``folder`` and ``flags``: repeats of a key after its first row, and the folder and flag that ``overrides`` (section, dose_uM, folder, flag) gives.

    Rows for which ``exempt`` holds are no repeats.  Null keys count as equal.
    """
    again = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1
    if exempt is not None:
        again = again & ~F.coalesce(exempt, F.lit(False))
    marked = rows.withColumn("_again", again)
    o = overrides.select("section", "dose_uM", F.col("folder").alias("_folder"), F.col("flag").alias("_flag"))
    j = marked.join(o, ["section", "dose_uM"], "left")
    flags = F.concat_ws(";", F.when(F.col("flags") != "", F.col("flags")), F.when(F.col("_again"), "duplicate_row_in_log"), F.col("_flag"))
    return j.withColumns({"folder": F.coalesce("_folder", "folder"), "flags": flags}).select(*rows.columns)


def numbered(rows: DataFrame, order: Sequence[str], name: str = "number") -> DataFrame:
    """Rows numbered 0, 1, ... in the order of columns that tell them apart, without gathering them.

    Rows are dealt by ranges of the order, sorted and written; a row's number is its place in its part and the sizes of the parts
    before, of which there are as many as shuffle partitions.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    j = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")  # a row for each shuffle partition
    return j.withColumn(name, F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)).select(*rows.columns, name)


def batches(rows: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """``rows`` with ``batch``: so many rows each in the given order, from 0."""
    return numbered(rows, order, "_number").withColumn("batch", F.floor(F.col("_number") / size).cast("long")).drop("_number")


def codes(rows: DataFrame, keys: Sequence[str], column: str, name: str = "code") -> DataFrame:
    """``rows`` with a code of ``column`` within each group: 0, 1, ... in order of its distinct values, -1 for null.

    Only the groups' distinct values are put in order, so a value with very many rows counts once.
    """
    distinct = rows.where(F.col(column).isNotNull()).select(*keys, column).distinct()
    coded = distinct.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(column)) - 1)
    return rows.join(coded, [*keys, column], "left").withColumn(name, F.coalesce(name, F.lit(-1)).cast("long"))


def status_counts(rows: DataFrame, status: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, status, n) with the most frequent first in ``place``; null is a status of its own."""
    n = rows.groupBy(*keys, status).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()  # a row for each status
    return n.withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), F.col(status).asc_nulls_last())).cast("long"))


def session_overview(cells: DataFrame) -> DataFrame:
    """(session_id, n_cells, n_fields, n_conditions, first_h, last_h, n_exposures): one row per session."""
    return cells.groupBy("session_id").agg(
        F.count("*").alias("n_cells"), F.countDistinct("condition_id", "sample_id").alias("n_fields"), F.countDistinct("condition_id").alias("n_conditions"),
        F.min("measurement_time_hours").alias("first_h"), F.max("measurement_time_hours").alias("last_h"), F.countDistinct("exposure_ms_green").alias("n_exposures"),
    )


def means(rows: DataFrame, node: Sequence[str], scenario: Sequence[str], values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(per node, per scenario) means of ``values``: first over a node's trials, then over a scenario's nodes, each node counting once."""
    per = rows.groupBy(*scenario, *node).agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("n_trials"))
    return per, per.groupBy(*scenario).agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("n_nodes"))


def ranked(candidates: DataFrame, keys: Sequence[str], score: str, tie: str, most: int) -> DataFrame:
    """The first ``most`` candidates of each group by score, then ``tie``; null and NaN scores come last, and ``place`` counts from 1."""
    s = E.clean(F.col(score).cast("double"))
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(s.desc_nulls_last(), tie)).cast("long")).where(F.col("place") <= most)


def crosstab(rows: DataFrame, index: str, column: str, values: Sequence, value: str) -> DataFrame:
    """One row per ``index`` with the mean of ``value`` in a column for each of ``values``: they are named, so no job looks for them."""
    return rows.groupBy(index).pivot(column, list(values)).agg(F.avg(value))
