"""Registered analysis queries against their DuckDB twins on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from cytoframe.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{float(v) + 0.0:.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    want = duck.execute(oracle.oracle_sql()[name]).fetchall()
    names = [d[0] for d in duck.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    a, b = (sorted(tuple(map(plain, r)) for r in rows) for rows in (want, map(tuple, got.select(names).collect())))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or abs(float(p) - float(q)) <= 2e-4 * max(1.0, abs(float(p))) for p, q in zip(x, y, strict=True) if p != q), (x, y)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracle.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name, operator", [("q_induction_bootstrap", "induction_table"), ("q_peak_bootstrap", "bootstrap_peaks")])
def test_bootstraps_draw_500_replicates(spark, monkeypatch, name, operator):
    import inspect

    signature, used = inspect.signature(getattr(queries.resampling, operator)), []

    def record(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        used.append(bound.arguments["n_boot"])
        return None, None

    monkeypatch.setattr(queries.resampling, operator, record)
    queries.queries()[name](spark, SF)
    assert used == [500]
