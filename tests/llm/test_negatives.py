import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from helpers import SF

from cytoframe.llm import negatives, queries
from cytoframe.llm.negatives import F

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, is_anchor, positives=5, negatives=3, lo=50, hi=95, scale=256):
    """Every anchor against every row."""
    ok = [r for r in rows if None not in (r[0], r[1], r[2]) and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = list({(i, tuple(math.floor(scale * x) for x in v), lab) for i, v, lab in ok})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, lab in whole:
        if not is_anchor(i):
            continue
        scored = sorted((-dot(v, w), j, m) for j, w, m in whole if (j, w, m) != (i, v, lab))
        pos = [(j, -s) for s, j, m in scored if m == lab][:positives]
        for j, p in pos:
            neg = [(k, -s) for s, k, m in scored if m != lab and lo * p <= -100 * s <= hi * p][:negatives]
            out += [(i, j, r + 1, k, p, s) for r, (k, s) in enumerate(neg)]
    return sorted(out)


def vectors(n, dims, seed, groups=1):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    return [(i, [c + r.gauss(0, 0.4) for c in centres[i % groups]], r.randrange(4)) for i in range(n)]


def run(spark, rows, step=5, **kw):
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % step == 0, **kw).collect()
    return sorted(map(tuple, got))


@pytest.mark.parametrize("dims, groups, seed", [(3, 1, 1), (8, 6, 2), (2, 3, 3)])
def test_equals_brute_force(spark, monkeypatch, dims, groups, seed):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "SAMPLE", 64)
    rows = vectors(400, dims, seed, groups)
    want = brute(rows, lambda i: i % 5 == 0)
    assert run(spark, rows) == want and len(want) > 100


def test_scans_leave_far_rings_out(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    made, kept = negatives._ask, []
    monkeypatch.setattr(negatives, "_ask", lambda index: kept.append(index) or made(index))
    rows = [(i, [math.cos(i % 8) * 9 + v[0] * 0.1, math.sin(i % 8) * 9 + v[1] * 0.1], lab) for i, v, lab in vectors(800, 2, 5)]
    assert run(spark, rows, 50) == brute(rows, lambda i: i % 50 == 0)
    index, v = kept[0], [math.floor(256 * x) for x in rows[0][1]]
    square = float(sum(x * x for x in v))
    one = {"query": 0, "label": 0, "vector": v, "bands": [{"band": 0, "floor": 0, "ceil": 1 << 40}], "inner": 0.0, "from": -1.0}

    def rings(score):
        return sum(len(out) for out in made(index)(iter([pd.DataFrame([{**one, "to": float(index.pivots.reach(np.array(square), np.array(score)))}])])))

    assert 0 < rings(0.98 * square) < index.rings.sum() / 2 and rings(-square) == index.rings.sum()


def test_copies_ties_and_odd_rows(spark):
    r = random.Random(9)
    rows = [(i, [float(r.randrange(-1, 2)), float(r.randrange(-1, 2))], r.randrange(3)) for i in range(300)]
    rows += [(1000 + i, [1.0, 1.0], 1) for i in range(60)]  # more copies than any answer holds
    odd = [(2000, None, 1), (2005, [1.0, None], 1), (2010, [float("nan"), 1.0], 1), (2015, [float("inf"), 1.0], 1), (2020, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (2025, [0.0, 0.0], 2), rows[5], rows[5], (10, [1.0, -1.0], 2)]
    rows += odd
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0)
    assert run(spark, []) == [] and run(spark, [(0, [1.0], 1)]) == [] and run(spark, [(0, [1.0], 1), (1, [2.0], 1)]) == []


def test_short_vectors_and_other_columns(spark):
    rows = [(i, [0.5 * (i % 5), 0.25 * i][: 1 + i % 2], i % 3) for i in range(60)]
    padded = [(i, [*v, 0.0][:2], lab) for i, v, lab in rows]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "anchor", "query", "vector", "ids", "place", "band")})
    got = sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 5 == 0).collect()))
    assert got == brute(padded, lambda i: i % 5 == 0)


def test_too_long_vectors_are_refused(spark):
    with pytest.raises(ValueError, match="too long"):
        run(spark, [(0, [1e9], 1), (5, [1e9], 2)])


def test_op12(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(queries.oracle_sql()["op12_hard_negatives"]).fetchall()
    names = [d[0] for d in con.description]
    got = queries.op12_hard_negatives(spark, SF)
    assert sorted(got.columns) == sorted(names) and sorted(map(tuple, got.select(names).collect())) == sorted(want) and want
