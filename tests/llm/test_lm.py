import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF, empty_table, odd_table, odd_texts

from cytoframe.llm import lm, queries


def brute(rows):
    """Counts and base scores as the definition says."""
    toks = [[*[w.lower() for w in (t or "").encode().split()], b"\x00end"] for _, t in rows]
    held = [d is None or zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    c = Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for (d, _), t, h in zip(rows, toks, held, strict=True)]


def same(out, rows):
    got = sorted(((r.doc_id if r.doc_id is not None else -9, r.n_tokens, r) for r in out), key=lambda x: x[:2])
    want = sorted(((w[0] if w[0] is not None else -9, w[2], w) for w in brute(rows)), key=lambda x: x[:2])
    assert len(got) == len(want)
    for (_, _, r), (_, _, w) in zip(got, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5] and r.base_score == pytest.approx(w[5], rel=1e-9)


def test_base_and_counts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries.op9_brown_lm(spark, SF).collect()
    same(out, rows)
    held = [r for r in out if r.held_out]
    # The classes must beat the words alone on texts that were not learnt from.
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_small_lexicon_joins_the_rest(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(lm.fit_and_score(df, classes=4, clustered=50, lexicon_size=200, rounds=2).collect(), rows)


def test_the_model_is_a_distribution(spark):
    rows = [(i, " ".join("abcdefg"[(i * k * 7 + k) % 7] for k in range(1, 30))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m, outside = lm.fit(spark, df, classes=3, clustered=4, lexicon_size=5, rounds=3)
    step = 10**m.log_step
    assert np.allclose(step.sum(1), 1)
    lex = m.lexicon
    for c in set(m.class_of[lex.symbol].tolist()):
        assert sum(10 ** m.log_emit[i] for i in range(len(lex.hashes)) if m.class_of[lex.symbol[i]] == c) == pytest.approx(1)
    rest = [r.n for r in outside.collect()]
    assert (sum(rest) + m.outside_unseen) / m.outside_total == pytest.approx(1)


def test_exchange_finds_planted_classes(spark):
    r = np.random.default_rng(0)
    left, right = [f"n{i}" for i in range(12)], [f"v{i}" for i in range(12)]
    rows = [(i, " ".join(x for _ in range(40) for x in (left[r.integers(12)], right[r.integers(12)]))) for i in range(80)]
    m, _ = lm.fit(spark, spark.createDataFrame(rows, "doc_id long, text string"), classes=2, clustered=24, lexicon_size=30, rounds=8)
    of = {h: m.class_of[s] for h, s in zip(m.lexicon.hashes.tolist(), m.lexicon.symbol.tolist(), strict=True)}
    a, b = ({of[h] for h in lm.words_in(pa.array(ws))[0].tolist()} for ws in (left, right))
    assert len(a) == len(b) == 1 and a != b


def test_words_are_told_apart():
    long = "y" * 300
    texts = [*odd_texts(), long + "a", long + "b", " " + long + "a ", "\x0b".join("pqr"), "x" * 8 + " " + "x" * 9, "\x1c a\x85b"]
    h, lengths = lm.words_in(pa.array(texts))
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    assert lengths.tolist() == [len((t or "").encode().split()) for t in texts] and len(h) == len(words)
    of = {}
    assert all(of.setdefault(w, x) == x for w, x in zip(words, h.tolist(), strict=True)) and len(set(of.values())) == len(of)
    places = lm.Places(np.unique(h)[::2])
    assert (places.find(np.unique(h)) == [i // 2 if i % 2 == 0 else -1 for i in range(len(of))]).all()


def test_the_best_class_raises_the_likelihood_most():
    r = np.random.default_rng(1)
    words, classes, total = 12, 4, 6
    line = r.integers(0, words + 2, 400)
    of = np.concatenate((r.integers(0, classes, words), [4, 5]))

    def matrix(of):
        out = np.zeros((total, total))
        np.add.at(out, (of[line[:-1]], of[line[1:]]), 1)
        return out

    m, own, right, left, twice, want = matrix(of), of[:words], [], [], [], []
    for w in range(words):
        after, before = line[1:][line[:-1] == w], line[:-1][line[1:] == w]
        right.append(np.bincount(of[after[after != w]], minlength=total))
        left.append(np.bincount(of[before[before != w]], minlength=total))
        twice.append(float((after == w).sum()))
        scores = []
        for c in range(classes):
            moved = of.copy()
            moved[w] = c
            scores.append(lm.likelihood(matrix(moved)))
        want.append(scores)
    got = lm.best_classes(own, np.array(right), np.array(left), np.array(twice), lm.Known(m, classes))
    for w in range(words):
        assert want[w][got[w]] == pytest.approx(max(want[w]))
    # The same from contexts, words in their order.
    pairs = Counter(zip(line[:-1].tolist(), line[1:].tolist(), strict=True))
    entries = sorted([(a, 0, b, n) for (a, b), n in pairs.items() if a < words] + [(b, 1, a, n) for (a, b), n in pairs.items() if b < words])
    w, side, o, n = (np.array(x) for x in zip(*entries, strict=True))
    movers, to = lm.moves_of(w, side, o, n, of, lm.Known(m, classes))
    assert dict(zip(movers.tolist(), to.tolist(), strict=True)) == {i: c for i, c in enumerate(got.tolist()) if c != own[i]}


def test_the_class_matrix_follows_moves(spark):
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{int(x)}" for x in r.zipf(1.3, 200) % 40) for _ in range(120)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = lm.count_words(docs)
    lex, _ = lm.lexicon(counts, None, None)
    shared, total = spark.sparkContext.broadcast(lex), 4 + lm.BANDS + 2
    old = lm.BUCKET
    lm.BUCKET = 500
    try:
        pairs, table = lm.bigrams(docs, shared, 120 * 201)
    finally:
        lm.BUCKET = old
    assert lex.m > 20
    a = np.concatenate((r.integers(0, 4, lex.m), 4 + np.arange(lm.BANDS + 2)))
    b = a.copy()
    go = np.arange(lex.m) % lm.PARTS == 1
    b[:lex.m][go] = r.integers(0, 4, go.sum())
    at = {h: s for h, s in zip(lex.hashes.tolist(), lex.symbol.tolist(), strict=True)}
    want = np.zeros((total, total))
    for t in texts:
        h = lm.words_in(pa.array([t]))[0].tolist()
        line = [lex.m + lm.BANDS + 1, *(at.get(x, lex.m + lm.BANDS) for x in h), lex.m + lm.BANDS + 1]
        np.add.at(want, (a[line[:-1]], a[line[1:]]), 1)
    first = lm.class_matrix(pairs, a, total)
    assert (first == want).all()
    assert (first + lm.matrix_change(table.where("part = 1"), a, b, total) == lm.class_matrix(pairs, b, total)).all()


def test_odd_rows(spark):
    df = odd_table(spark)
    same(lm.fit_and_score(df).collect(), [(r.doc_id, r.text) for r in df.collect()])
    assert lm.fit_and_score(empty_table(spark)).collect() == []
    only_held = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    same(lm.fit_and_score(only_held).collect(), [(None, "a b"), (None, None)])


def test_all_frequent_words_are_clustered(spark):
    n = 17_000
    rows = [(i, " ".join(f"w{(i * 500 + k) % n}" for k in range(500))) for i in range(n * 20 // 500)]
    counts = lm.count_words(spark.createDataFrame(rows, "doc_id long, text string").where("text is not null"))
    lex, _ = lm.lexicon(counts, None, None)
    assert lex.m == n
