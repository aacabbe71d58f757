import random

import numpy as np
import pytest
from helpers import SF, components
from pyspark.sql import functions as F

from cytoframe.llm import nndescent, queries

SCHEMA = "vec_id long, embedding array<float>, label int, node long"


def brute(ids, vecs, threshold=0.95):
    v = [None if x is None or not len(x) or any(c is None or not np.isfinite(c) for c in x) or not np.any(np.array(x, float)) else np.array(x, float) for x in vecs]
    n, links = len(v), []
    for i in range(n):
        for j in range(i):
            if v[i] is not None and v[j] is not None and len(v[i]) == len(v[j]) and v[i] @ v[j] >= threshold * np.linalg.norm(v[i]) * np.linalg.norm(v[j]):
                links.append((i, j))
    comp = components(n, links)
    least = {}
    for i, c in enumerate(comp):
        least[c] = min(least.get(c, 1 << 60), ids[i])
    count = [0] * n
    for i, j in links:
        count[i] += 1
        count[j] += 1
    return sorted((ids[i], count[i], least[comp[i]], ids[i] == least[comp[i]]) for i in range(n))


def planted(r, n, d=24):
    base = r.standard_normal((n, d))
    rows = [x for x in base]
    for size in (2, 2, 3, 40, 90):
        c = r.standard_normal(d)
        rows += [c + r.standard_normal(d) * np.linalg.norm(c) * 0.03 for _ in range(size)]
    rows += [base[0]] * 30 + [base[1] * 3]
    return [x.astype(np.float32).tolist() for x in rows]


def test_links_of_planted_groups(spark):
    vecs = planted(np.random.default_rng(0), 700)
    df = spark.createDataFrame([(i, v, 1, i) for i, v in enumerate(vecs)], SCHEMA)
    assert sorted(map(tuple, nndescent.near_duplicates(df).collect())) == brute(list(range(len(vecs))), vecs)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vecs = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 0.0], [1.0, 0.0], [2.0, 0.001], [1.0, 0.0, 0.0], [-1.0, 0.0], [1e-30, 0.0], [3e38, 0.0]]
    rows = [(i, v, None, i) for i, v in enumerate(vecs)]
    got = nndescent.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(list(range(13)), [v if v is None or len(v) != 2 or None in v else np.array(v, float) for v in vecs])
    assert sorted(map(tuple, got)) == want
    again = nndescent.near_duplicates(spark.createDataFrame([*rows, rows[6], (None, [1.0, 0.0], 1, 1)], SCHEMA)).collect()
    assert sorted((r.n_links, r.kept) for r in again if r.vec_id == 6) == [(6, True), (6, True)] and [r.component_id for r in again if r.vec_id is None] == [6]
    assert nndescent.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert nndescent.near_duplicates(spark.createDataFrame(rows[:6], SCHEMA)).where("kept and n_links = 0").count() == 6


def test_search_alone_reaches_the_recall(spark):
    vecs = planted(np.random.default_rng(1), 1500)
    rows = nndescent.vectors(spark.createDataFrame([(i, v, 1, i) for i, v in enumerate(vecs)], SCHEMA), "vec_id", "embedding")
    nodes = nndescent.materialise(rows.groupBy("node").agg(nndescent.F.first("vec").alias("vec")))
    _, recall = nndescent.find_links(nodes, 0.95)
    assert recall >= 0.9


def test_rounds_raise_the_recall_of_a_weak_start(spark, monkeypatch):
    for name, value in (("ORDERS", 2), ("BLOCK", 32)):
        monkeypatch.setattr(nndescent, name, value)
    r, d, vecs = np.random.default_rng(6), 48, []
    for c in r.standard_normal((250, d)):
        for _ in range(7):
            x = c + 0.45 * r.standard_normal(d)
            vecs += [x + 0.04 * np.linalg.norm(x) / np.sqrt(d) * r.standard_normal(d) * k for k in (0, 3, 4)]
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist(), 1, i) for i, v in enumerate(vecs)], SCHEMA)
    rows = nndescent.vectors(df, "vec_id", "embedding")
    nodes = nndescent.materialise(rows.groupBy("node").agg(nndescent.F.first("vec").alias("vec")))
    assert nodes.count() > 5000
    recalls = [nndescent.find_links(nodes, 0.95, max_rounds=k, max_searches=1)[1] for k in (0, 1, 3)]
    assert recalls[0] < recalls[1] <= recalls[2] and recalls[2] > recalls[0] + 0.03


def test_a_hot_family_is_counted_by_angles(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "CHUNK", 32)
    r, d = np.random.default_rng(8), 16
    base = r.standard_normal(d)
    u = base / np.linalg.norm(base)
    other = r.standard_normal(d)
    v = other - (other @ u) * u
    v /= np.linalg.norm(v)
    vecs = [np.cos(t) * u + np.sin(t) * v + 0.002 * r.standard_normal(d) for t in np.concatenate((np.full(300, 0.0), np.linspace(0, 0.9, 200)))]
    vecs = [x.astype(np.float32).tolist() for x in vecs]
    df = spark.createDataFrame([(i, x, 1, i) for i, x in enumerate(vecs)], SCHEMA)
    assert sorted(map(tuple, nndescent.near_duplicates(df).collect())) == brute(list(range(len(vecs))), vecs)


def test_the_audit_adds_no_links(spark, monkeypatch):
    vecs = planted(np.random.default_rng(3), 200)
    df = spark.createDataFrame([(i, v, 1, i) for i, v in enumerate(vecs)], SCHEMA)
    a, b = (r.node for r in nndescent.vectors(df.where("vec_id in (5, 6)"), "vec_id", "embedding").collect())
    audit = nndescent.audit_links
    monkeypatch.setattr(nndescent, "audit_links", lambda *x: audit(*x).union(spark.createDataFrame([(a, b)], "a long, b long")))
    assert sorted(map(tuple, nndescent.near_duplicates(df).collect())) == brute(list(range(len(vecs))), vecs)


def test_search_alone_finds_all_links(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "AUDIT", 50)
    vecs = planted(np.random.default_rng(4), 1000)
    df = spark.createDataFrame([(i, v, 1, i) for i, v in enumerate(vecs)], SCHEMA)
    assert sorted(map(tuple, nndescent.near_duplicates(df).collect())) == brute(list(range(len(vecs))), vecs)


def test_a_bridge_between_dense_families(spark, monkeypatch):
    # Every list could be filled with members of the own family; one pair alone links the two.
    for name, value in (("K", 3), ("GROWTH", 2), ("ORDERS", 1), ("BLOCK", 8)):
        monkeypatch.setattr(nndescent, name, value)
    r, d = np.random.default_rng(5), 16
    at = lambda degrees: np.cos(np.radians(degrees)) * np.eye(d)[0] + np.sin(np.radians(degrees)) * np.eye(d)[1]
    family = lambda degrees: [at(degrees) + 0.01 * r.standard_normal(d) for _ in range(60)]
    vecs = [x.astype(np.float32).tolist() for x in [*family(0), at(6), *family(29), at(23)]]
    df = spark.createDataFrame([(i, v, 1, i) for i, v in enumerate(vecs)], SCHEMA)
    got = sorted(map(tuple, nndescent.near_duplicates(df).collect()))
    assert got == brute(list(range(len(vecs))), vecs) and {g[2] for g in got} == {0}


def test_a_search_that_finds_too_little_fails(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "QUIET", 1)
    monkeypatch.setattr(nndescent, "forest", lambda linked: (np.empty(0, np.int64), np.empty(0, np.int64)))
    df = spark.createDataFrame([(i, [1.0, i * 0.01], 1, i) for i in range(10)], SCHEMA)
    with pytest.raises(RuntimeError, match="0 of 10"):
        nndescent.near_duplicates(df)


def test_exact_count_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "CHUNK", 16)
    vecs = planted(np.random.default_rng(2), 100)
    df = spark.createDataFrame([(i, v, 1, i) for i, v in enumerate(vecs)], SCHEMA)
    assert sorted(map(tuple, nndescent.near_duplicates(df).collect())) == brute(list(range(len(vecs))), vecs)


def test_op2(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    assert sorted(tuple(r)[:4] for r in queries.op2_nn_descent(spark, SF).collect()) == brute([r.vec_id for r in t], [r.embedding for r in t])


def test_recall_weighs_nodes_that_were_left_alone(spark, monkeypatch):
    """Lost links between nodes that both stayed alone lower the estimate, though half of the sample was found by the search."""
    r = random.Random(8)
    base = [[r.gauss(0, 1) for _ in range(24)] for _ in range(300)]
    rows = [(2 * i + j, [x + r.gauss(0, 0.01) for x in v]) for i, v in enumerate(base) for j in range(2)]
    nodes = nndescent.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").select("node", "vec", "vec_id")
    # As if the search had found the first 60 pairs alone.
    labelled = nodes.withColumn("label", F.when((F.col("vec_id") < 120) & (F.col("vec_id") % 2 == 1), F.lit(-1) - F.floor(F.col("vec_id") / 2)).otherwise(F.when(F.col("vec_id") < 120, F.lit(-1) - F.floor(F.col("vec_id") / 2)).otherwise(F.col("node"))))
    labelled = labelled.select("node", "vec", F.col("label").cast("long").alias("label"))
    monkeypatch.setattr(nndescent, "AUDIT", 100)
    w = nndescent.audit_weights(labelled)
    assert w == {True: 120 / 50, False: 480 / 50}
    truth = nndescent.audit_links(labelled, 0.95)
    sampled = truth.join(labelled.select(F.col("node").alias("a"), "label"), "a").groupBy("a").agg(F.max((F.col("label") < 0) & (F.col("label") > -1000)).alias("found")).collect()
    found = sum(w[True] for x in sampled if x.found)
    estimate = found / (found + sum(w[False] for x in sampled if not x.found))
    assert len(sampled) == 100 and abs(estimate - 120 / 600) < 1e-9
    told = {}
    links, recall = nndescent.find_links(nodes.select("node", "vec"), 0.95, told=told)
    assert recall >= 0.99 and told["sampled"] == 50  # none is left alone, so half of the sample is all
