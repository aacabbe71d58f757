"""The jobs: growing input, reruns, refusals, and the registered queries against their DuckDB twins."""

import json
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import culture_report, queries, text_intake

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def doc(i, text, lang="en", source="s", n=None):
    return (i, text, lang, source, len(text or "") if n is None else n)


def plain(v):
    return "null" if v is None else f"{float(v) + 0.0:.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name, table", [("job1_text_intake", "documents"), ("job2_culture_report", "lineitem")])
def test_same_rows_as_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(map(plain, r)) for r in cur.fetchall())
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(map(plain, r)) for r in got.select(names).collect()) == want and want


def statuses(spark, folder):
    return {(r.id, r.status, r.same_as) for r in spark.read.parquet(f"{folder}/out/records").collect()}


def test_intake_takes_only_what_is_new(spark, tmp_path):
    source, out = f"{tmp_path}/docs", f"file://{tmp_path}"
    run = lambda: text_intake.run(spark, source, f"{out}/out", f"{out}/checkpoint")
    spark.createDataFrame([doc(1, WORDS), doc(2, WORDS), doc(3, WORDS + " more"), doc(3, WORDS + " more"), doc(4, None), doc(None, "no id here")], DOCS).write.parquet(source)
    assert run() == {"accepted": 2, "refused": 2, "repeat": 1}
    first = statuses(spark, out)
    assert first == {(1, "accepted", None), (2, "repeat", 1), (3, "accepted", None), (4, "refused", None), (None, "refused", None)}
    assert run() == {} and statuses(spark, out) == first
    # Smaller ids that come later are repeats all the same: what is taken stays taken.
    spark.createDataFrame([doc(0, WORDS), doc(5, "a new text"), doc(6, "x", lang="xx", n=9)], DOCS).write.mode("append").parquet(source)
    assert run() == {"accepted": 1, "refused": 1, "repeat": 1}
    assert statuses(spark, out) - first == {(0, "repeat", 1), (5, "accepted", None), (6, "refused", None)} and first < statuses(spark, out)
    assert run() == {}
    twice = spark.read.parquet(f"{out}/out/records").where("id = 3").first()
    assert twice.deliveries == 2
    issues = {(r.level, r.column, r.rule): (r.n, r["first"]) for r in spark.read.parquet(f"{out}/out/issues").collect()}
    assert issues["error", "lang", "unknown language"] == (1, ["6"]) and issues["error", "text", "no words"] == (1, ["4"])
    assert issues["warning", "text", "under 20 words"] == (3, [None, "5", "6"])


def test_intake_runs_a_failed_batch_again(spark, tmp_path, monkeypatch):
    source, out = f"{tmp_path}/docs", f"file://{tmp_path}"
    spark.createDataFrame([doc(1, WORDS), doc(2, "two words")], DOCS).write.parquet(source)
    whole, calls = text_intake.with_status, []

    def failing(*args):
        calls.append(1)
        if len(calls) == 1:
            # The batch is on disk already when the run dies.
            whole(*args).withColumn("batch", F.lit(0)).write.partitionBy("batch", "status").parquet(f"{out}/out/records")
            raise RuntimeError("lost")
        return whole(*args)

    monkeypatch.setattr(text_intake, "with_status", failing)
    with pytest.raises(Exception, match="lost"):
        text_intake.run(spark, source, f"{out}/out", f"{out}/checkpoint")
    assert text_intake.run(spark, source, f"{out}/out", f"{out}/checkpoint") == {"accepted": 2}
    assert statuses(spark, out) == {(1, "accepted", None), (2, "accepted", None)}


def test_intake_of_odd_tables(spark, tmp_path):
    out = f"file://{tmp_path}"
    rows = [doc(1, "", n=0), doc(2, " \n\t", n=3), doc(3, "w " * 200_000), doc(4, "| a | b |\n" * 5), doc(5, "# # # #"), (6, "x y", None, None, None), (6, "x z", "en", "  ", 3)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"digest": F.lit("mine"), "issues": F.lit(1), "status": F.lit("mine"), "id": F.lit(9), "batch": F.lit(3)})
    df.write.parquet(f"{tmp_path}/docs")
    assert text_intake.run(spark, f"{tmp_path}/docs", f"{out}/out", f"{out}/checkpoint") == {"accepted": 3, "refused": 4}
    by = {(r.id, r.digest[:4]): r for r in spark.read.parquet(f"{out}/out/records").collect()}
    assert sorted(r.status for r in by.values()) == ["accepted"] * 3 + ["refused"] * 4
    assert {r.n_table_lines for r in by.values() if r.id == 4} == {5} and {r.n_words for r in by.values() if r.id == 3} == {200_000}
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none")
    assert text_intake.run(spark, f"{tmp_path}/none", f"{out}/out2", f"{out}/checkpoint2") == {}


def test_unknown_configuration_keys_are_refused(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"ruels": []}))
    with pytest.raises(ValueError, match="ruels"):
        text_intake.run(spark, SF, "x", "y", f"{tmp_path}/c.json")


CELL = "cell_id long, session_id string, condition_id string, sample_id string, measurement_time_hours double, qc_pass boolean, edge_flag boolean, sat_flag boolean, corrected_mean_green double, corrected_mean_red double, integrated_green double, integrated_red double, exposure_ms_green double, exposure_ms_red double"


def cells(day, shift=0.0):
    out = []
    for strain in ("tr", "nt"):
        for dose in (0, 100):
            for t in (1, 2, 4):
                level = 10.0 if strain == "nt" else 10.0 + t + dose / 10 * (t == 2) + shift
                out += [(len(out), f"{day}_h2o2_{strain}", f"h2o2_{dose}uM_t{t}", "R1", float(t), True, False, False, level, 2 * level, level, level, 1000.0, 1000.0)] * 6
    return out


def test_report_overwrites_only_its_days(spark, tmp_path):
    rows, out = f"{tmp_path}/rows", f"{tmp_path}/out"
    config = lambda **x: [(tmp_path / "c.json").write_text(json.dumps({"projection": "SELECT * FROM {rows}", **x})), f"{tmp_path}/c.json"][1]
    spark.createDataFrame(cells("20260101") + cells("20260102"), CELL).write.parquet(rows)
    assert culture_report.run(spark, rows, out, config()) == {"read": 144, "refused": 0, "wrote": 24}
    read = lambda: sorted(map(tuple, spark.read.parquet(f"{out}/curves").drop("n_fields").collect()), key=str)
    before = read()
    assert culture_report.run(spark, rows, out, config()) == {"read": 144, "refused": 0, "wrote": 24} and read() == before
    r = spark.read.parquet(f"{out}/curves").where("strain = 'tr' and dose_uM = 100 and day = 20260101").orderBy("time_h").collect()
    assert [round(x.excess_green, 6) for x in r] == [0, 10, 0] and [x.peak for x in r] == [False, True, False] and [round(x.green, 6) for x in r] == [1, 12, 4]
    # Another day's data change, and a bad row comes; only the day asked for is reported anew.
    bad = (9, "no session", "h2o2_0uM", "R1", -1.0, True, False, True, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0)
    spark.createDataFrame(cells("20260101", 5.0) + cells("20260102", 5.0) + [bad], CELL).write.mode("overwrite").parquet(rows)
    assert culture_report.run(spark, rows, out, config(days=["20260102"])) == {"read": 145, "refused": 1, "wrote": 12}
    green = {r.day: r.g for r in spark.read.parquet(f"{out}/curves").where("strain = 'tr' and dose_uM = 0 and time_h = 1").groupBy("day").agg(F.max("green").alias("g")).collect()}
    assert {d: round(g, 6) for d, g in green.items()} == {20260101: 1, 20260102: 6}
    refused = {(r.level, r.column): r.n for r in spark.read.parquet(f"{out}/refused").collect()}
    assert refused == {("error", "session_id"): 1, ("error", "measurement_time_hours"): 1, ("error", "exposure_ms_green"): 1, ("warning", "sat_flag"): 1}


def test_command_line(tmp_path):
    args = [sys.executable, "-m", "jobs.text_intake", "--input", f"{SF}/documents.parquet", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/checkpoint"]
    done = subprocess.run(args, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "wrote" in done.stderr, done.stderr[-2000:]
