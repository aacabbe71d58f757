import random

import numpy as np
import pyarrow as pa
from helpers import components, empty_table, odd_table, shingles

from cytoframe.llm import jaccard
from cytoframe.llm.common import components as graph_components
from cytoframe.llm.common import shingle_hashes


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    comp = components(len(rows), links)
    least = {}
    for i, c in enumerate(comp):
        least[c] = min(least.get(c, 1 << 60), rows[i][0])
    return {(rows[i][0], len(sets[i]), least[c]) for i, c in enumerate(comp)}


def corpus(r, groups, size):
    rows = []
    for g in range(groups):
        base = [f"w{r.randrange(3000)}" for _ in range(size())]
        for _ in range(r.choice((1, 1, 2, 5, 9))):
            w = list(base)
            for _ in range(r.randrange(1 + len(w) // 15)):
                w[r.randrange(len(w))] = f"c{r.randrange(10**6)}"
            rows.append(" ".join(w))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [passage + " " + " ".join(f"q{r.randrange(10**6)}" for _ in range(150)) for _ in range(25)]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_same_links_as_all_pairs(spark):
    r = random.Random(3)
    for n, percent in ((4, 85), (5, 80)):
        rows = corpus(r, 60, lambda: r.choice((3, 12, 40, 150, 400)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {tuple(x) for x in jaccard.jaccard_components(df, n=n, percent=percent).collect()}
        assert got == brute(rows, n, percent)


def test_large_blocks_are_cut_in_chunks(spark):
    r = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randrange(1, 9)):
            w[r.randrange(200)] = f"c{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(x) for x in jaccard.jaccard_components(df, n=4, percent=80, chunk=16).collect()}
    assert got == brute(rows, 4, 80)


def test_odd_rows(spark):
    df = odd_table(spark)
    out = jaccard.jaccard_components(df, n=4, percent=85).collect()
    assert len(out) == df.count()
    rows = [(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None]
    want = brute(rows, 4, 85)
    assert {tuple(r) for r in out if r.doc_id is not None} == want
    none = sorted((r.n_shingles, r.component_id is None) for r in out if r.doc_id is None)
    assert none[0] == (0, True) and none[1][0] > 0 and not none[1][1]  # the null text; the copy of document 8
    assert jaccard.jaccard_components(empty_table(spark)).collect() == []


def test_trees_prune_but_lose_nothing():
    r = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        base = r.integers(0, 1 << 62, r.integers(1, 300), dtype=np.uint64)
        for _ in range(r.integers(1, 5)):
            s = base.copy()
            s[r.integers(0, len(s), max(1, len(s) // 25))] = r.integers(0, 1 << 62, max(1, len(s) // 25), dtype=np.uint64)
            sets.append(np.unique(s))
    py = [set(s.tolist()) for s in sets]
    for left, right in ((np.arange(len(sets)),) * 2, (np.arange(0, len(sets), 2), np.arange(1, len(sets), 2))):
        same = left is right
        links = jaccard.tree_links(sets, left, left if same else right, 80)
        want = [(i, j) for i in left for j in right if i != j and 100 * len(py[i] & py[j]) >= 80 * len(py[i] | py[j])]
        assert components(len(sets), links) == components(len(sets), want)


def test_every_near_pair_shares_a_segment():
    r = random.Random(9)
    for _ in range(300):
        n = r.choice((1, 2, 5, 20, 90, 400))
        a = sorted(r.sample(range(1 << 62), n))
        b = set(a)
        while True:
            c = set(b)
            if r.random() < 0.5 and len(c) > 1:
                c.discard(r.choice(sorted(c)))
            else:
                c.add(r.randrange(1 << 62))
            if 100 * len(c & set(a)) < 85 * len(c | set(a)):
                break
            b = c
        x, y = (jaccard.segment_keys(np.array(sorted(s), np.uint64), 0.85) for s in (a, b))
        assert set(x.tolist()) & set(y.tolist())


def test_shingles():
    h = np.arange(1, 7, dtype=np.uint64)
    assert len(shingle_hashes(h, 4)) == 3 and len(shingle_hashes(h[:2], 4)) == 1 and len(shingle_hashes(h[:0], 4)) == 0
    assert len(shingle_hashes(np.ones(50, np.uint64), 4)) == 1


def test_graph_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    got = {x.node: x.label for x in graph_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components(300, edges)
    groups = {}
    for node, label in got.items():
        groups.setdefault(want[node], set()).add(label)
    assert all(len(v) == 1 for v in groups.values()) and len({next(iter(v)) for v in groups.values()}) == len(groups)
    assert graph_components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_sets_of_odd_texts():
    texts = [None, "", " \n", "a", "b\x00", "A b\x00 c", "x" * 300, "y " + "x" * 299, "éa \x0b b", "a b c d e f a b c d", "w " * 400, *(" ".join(f"q{i * j % 97}" for j in range(i)) for i in range(1, 300, 7))]
    for n in (1, 4, 5):
        want = [shingles(t, n) for t in texts]
        got = []
        for s, sizes in jaccard.sets_of(pa.array(texts, pa.string()), n):
            got += np.split(s, np.cumsum(sizes)[:-1])
        assert [len(x) for x in got] == [len(x) for x in want] and all((np.diff(x.astype(object)) > 0).all() for x in got)
        for i in range(len(texts)):
            assert all(len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j]) for j in range(i))


def test_linked_sets_are_plausible():
    r = np.random.default_rng(5)
    fresh = lambda k: r.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, k, dtype=np.uint64)
    far = 0
    for size in (1, 2, 5, 20, 90, 400, 600, 601, 1195, 1210, 5000):
        for _ in range(20):
            base = fresh(size)
            # As different as linked sets may be: of one size, or one with all of the other.
            lost = r.choice((0, size * 20 // 180))
            more = r.integers(0, size // 4 + 1) if not lost else lost
            x, y, z = np.unique(base), np.unique(np.concatenate((base[lost:], fresh(more)))), np.unique(np.concatenate((base[: size // 3], fresh(size - size // 3))))
            sizes = np.array([len(v) for v in (x, y, z)])
            drawn = jaccard.sketches(np.concatenate((x, y, z)), sizes).reshape(3, 2, -1).view(np.uint64)
            a, b = np.array([0, 0]), np.array([1, 2])
            near, other = jaccard.plausible(drawn[a], drawn[b], sizes[a], sizes[b], 80)
            both = len(np.intersect1d(x, y))
            assert near and 100 * both >= 80 * (len(x) + len(y) - both)
            far += int(other and size >= 20)
    assert far < 10


def test_a_common_passage_joins_no_blocks(spark):
    r = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = []
    for i in range(300):
        own = [f"q{r.randrange(10**7)}" for _ in range(60)]
        rows += [(4 * i + k, " ".join([*own[: 30 + k], passage, *own[30 + k :]])) for k in range(r.choice((1, 1, 2)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = jaccard.document_nodes(docs, 4)
    known = nodes.select("node", nodes.n_shingles.alias("size"), "sketch").dropDuplicates(["node"])
    groups = jaccard.key_groups(jaccard.key_rows(docs, 4, 0.8)).distinct()
    label = {x.node: x.label for x in graph_components(jaccard.block_edges(groups.join(known, "node"), 80)).collect()}
    # Segments within the passage put most texts in groups; only pairs that may link make blocks.
    assert groups.select("node").distinct().count() > 200
    sizes = sorted(list(label.values()).count(v) for v in set(label.values()))
    assert sizes and sizes[-1] <= 4
    got = {tuple(x) for x in jaccard.jaccard_components(docs, n=4, percent=80).collect()}
    assert got == brute(rows, 4, 80)


def test_keys_travel_in_few_rows(spark):
    r = random.Random(13)
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(300))) for i in range(400)], "doc_id long, text string").coalesce(1)
    # A row for each bucket, not for each of some 30,000 keys.
    assert jaccard.key_rows(docs, 4, 0.85).count() <= jaccard.BUCKETS * 4


def test_marked_documents(spark):
    docs = spark.range(-3000, 3000).selectExpr("id AS doc_id", "'t' AS text").union(spark.createDataFrame([(None, "x")], "doc_id long, text string"))
    ids = spark.range(-2990, 3000, 50).selectExpr("id AS doc_id")
    got = [r.doc_id for r in jaccard.among(docs, ids).collect()]
    assert len(got) == len(set(got)) and {r.doc_id for r in ids.collect()} <= set(got) and len(got) < 130
