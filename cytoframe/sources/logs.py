"""Semi-structured log text as rows: sections found by their headings, row patterns with named parts, stated defaults."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E

#: Acquisition time in ms by exposure code; others are four times their code, and flagged.
ACQUISITION_MS = {300: 1200, 350: 1400, 375: 1500, 400: 1600, 500: 2000, 600: 2400}
CLOCK = r"\d{1,2}:\d{2}"


@dataclass(frozen=True)
class Section:
    """One table of a log.  ``heading`` matches a whole line, ``row`` a whole row with named groups (a group ``x_star`` marks a starred x);
    ``defaults`` fill what a row does not say, and may use {name} of its groups; ``tags`` may follow on the next line in brackets."""

    name: str
    heading: str
    row: str
    defaults: dict[str, str] = field(default_factory=dict)
    tags: tuple[str, ...] = ()


def _squeeze(line: str) -> str:
    return " ".join(line.split())


def parse_log(text: str, sections: list[Section]) -> Iterator[dict[str, str]]:
    """Rows of all sections in order; a section runs to the next heading.  Lines split at newlines only, so page feeds do not cut rows."""
    lines = [_squeeze(x) for x in text.split("\n")]
    starts, at = [], 0
    for s in sections:
        hit = next((i for i in range(at, len(lines)) if re.fullmatch(s.heading, lines[i])), None)
        if hit is None:
            yield {"section": s.name, "flags": "heading_not_found"}
        else:
            starts.append((hit, s))
            at = hit + 1
    for k, (start, s) in enumerate(starts):
        end = starts[k + 1][0] if k + 1 < len(starts) else len(lines)
        for i in range(start + 1, end):
            after = lines[i + 1] if i + 1 < end else ""
            tag = next((t for t in s.tags if f"({t})" in lines[i] or after == f"({t})"), "")
            line = _squeeze(lines[i].replace(f"({tag})", "")) if tag else lines[i]
            m = re.fullmatch(s.row, line)
            if not m:
                continue
            got = {n: v for n, v in m.groupdict().items() if v is not None and not n.endswith("_star")}
            stars = [n[:-5] for n, v in m.groupdict().items() if n.endswith("_star") and v]
            row = {**{n: v.format(**got) for n, v in s.defaults.items()}, **got, "section": s.name}
            if tag:
                row["rep"] = tag
            flags = [f"{n}_from_section_note" for n in ("exp",) if n in s.defaults and n not in got]
            if stars:
                flags.append("starred_in_log:" + ",".join(stars))
            row["flags"] = ";".join(flags)
            yield row


def read_log(texts: DataFrame, sections: list[Section], columns: list[str]) -> DataFrame:
    """One row per log row from texts (path, value), every column as text and empty where the log says nothing."""
    names = ["path", "place", *columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"path": p, "place": str(i), **r} for p, t in zip(b["path"], b["value"], strict=True) for i, r in enumerate(parse_log(t, sections))]
            yield pd.DataFrame(rows, columns=names).fillna("").astype(str)

    kinds = ", ".join(f"{c} string" for c in names)
    return texts.select("path", "value").mapInPandas(run, kinds).withColumn("place", F.col("place").cast("int"))


def finish_log(rows: DataFrame) -> DataFrame:
    """Acquisition times, elapsed hours and flags of derived values and of rows that repeat."""
    from pyspark.sql import Window

    exp = F.col("exp").try_cast("int")
    table = F.create_map(*(F.lit(x) for kv in ACQUISITION_MS.items() for x in kv))
    known = table[exp]
    again = F.row_number().over(Window.partitionBy("section", "tp_label", "dose_uM", "rep").orderBy("path", "place")) > 1
    text = lambda c: F.coalesce(F.format_string("%.3f", c), F.lit(""))
    flags = F.concat_ws(";", F.when(F.col("flags") != "", F.col("flags")), F.when(exp.isNotNull() & known.isNull(), "acq_derived_4x"), F.when(again, "duplicate_row_in_log"))
    return rows.withColumns(
        {
            "exposure_acq_ms": F.coalesce(F.coalesce(known, 4 * exp).cast("string"), F.lit("")),
            "sampling_time_hours": text(E.clock_hours(F.col("added"), F.col("plating"))),
            "measurement_time_hours": text(E.clock_hours(F.col("added"), F.col("red"))),
            "flags": flags,
        }
    )
