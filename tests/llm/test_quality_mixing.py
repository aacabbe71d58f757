import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from helpers import SF, empty_table, odd_table

from cytoframe.llm import mixing, quality, queries


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)} if len(grams) < 3000 else set()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_base_counts_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op10_quality(spark, SF).collect():
        assert tuple(r)[1:7] == brute_base(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_odd_rows(spark):
    df = odd_table(spark)
    got = sorted(repr(tuple(r)[:7]) for r in quality.quality(df).collect())
    assert got == sorted(repr((r.doc_id, *brute_base(r.text))) for r in df.collect())
    assert quality.quality(empty_table(spark)).count() == 0
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()
    assert quality.keep_good(empty_table(spark)).count() == 0


def test_fertility_is_the_vocabularys():
    import pyarrow as pa

    model = sentencepiece.SentencePieceProcessor(model_file=quality.default_vocabulary())
    text = "Some plain words and naïve ones with 日本 and zażółć repeated words words " * 3
    row = next(quality.measured(pa.array([text]), None))
    ids = [i for w in text.split() for i in model.encode(w)]
    assert row[8] == len(ids) and row[9] == pytest.approx(sum(map(len, text.split())) / len(ids))
    assert row[10] == pytest.approx(sum(model.is_byte(i) for i in ids) / len(ids))


def test_bands_reject_what_is_no_text(spark):
    good = "The committee met on Tuesday to discuss the harbour and its many ships, and agreed to meet again. " * 1
    blob = " ".join("qzxjkvwq" + "0123456789abcdef"[i % 16] * 24 for i in range(40))
    runes = " ".join("ᚠᚢᚦᚨᚱᚲ" + chr(0x16A0 + i) for i in range(40))
    rows = [(1, good + "Nobody objected, though the rain kept most members at home."), (2, " ".join(["zzzz"] * 19 + ["yyyy"])), (3, blob), (4, runes)]
    out = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].kept and not out[2].kept and out[4].fallback_share > 0.5


def labelled(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, docs.join(labels, "doc_id")


def test_floors_of_one_table_judge_another(spark):
    docs, labels, _ = labelled(spark, "sf0.01")
    floors = quality.fit_floors(docs, labels)
    assert set(floors) == {"latin"} and quality.fit_floors(docs, labels, limit=FIT) != {} and quality.fit_floors(docs, labels, limit=3) == {}
    rows = labelled(spark, "sf0.1")[2].where("doc_id >= 1000").select("text", "quality").toArrow()
    got = [(q, r[5], r[6]) for q, r in zip(rows["quality"].to_pylist(), quality.measured(rows["text"].combine_chunks(), None, floors), strict=True)]
    good, bad = ([kept for q, failed, kept in got if q == x and not failed] for x in (1, 0))
    assert len(good) > 1000 and len(bad) > 100
    # Good documents stay, and most of the bad ones that pass the base rules go.
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.4 * len(bad)


FIT = 200


def test_floors_of_odd_labels(spark):
    df = odd_table(spark)
    labels = spark.createDataFrame([(None, 1, 0), (8, 1, 0), (8, 1, 0), (999, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    assert quality.fit_floors(df, labels) == {} and quality.fit_floors(empty_table(spark), labels) == {} and quality.fit_floors(df, labels.limit(0)) == {}
    rows = [("latin", 1 << k, 1.0 - 0.05 * k) for k in (7, 8, 9) for _ in range(30)] + [("latin", 1 << 11, 0.1), ("greek", 4, 0.9)]
    floors = quality.floors_from(rows)
    assert floors["latin"] == ([7.0, 8.0, 9.0], pytest.approx([0.64, 0.59, 0.54])) and set(floors) == {"latin"}
    assert quality.least_entropy_of(floors, "latin", 11.0) == pytest.approx(0.44) and quality.least_entropy_of(floors, "latin", 3.0) == pytest.approx(0.64)
    assert quality.least_entropy_of(floors, "greek", 8.0) == 0.0 and quality.least_entropy_of(None, "latin", 8.0) == 0.0


def test_floors_come_from_every_good_document(spark):
    # 4,500 good texts, more than any sample took before; a single one has the least entropy.
    common = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    docs = spark.range(4500).selectExpr("id AS doc_id", f"concat('{common}', ' ', CAST(id AS STRING)) AS text")
    plain = spark.range(4500, 4501).selectExpr("id AS doc_id", "concat(array_join(transform(sequence(1, 60), i -> concat('wordaa', repeat('a', i % 3))), ' '), ' x ', CAST(rand(1) AS STRING)) AS text")
    rows = [quality.quality(t).select("script", "n_tokens", "entropy_share", "chars_per_token", "fallback_share", "base_failed") for t in (docs, plain)]
    both = rows[0].unionByName(rows[1]).where("not base_failed").drop("base_failed").collect()
    labels = spark.range(4501).selectExpr("id AS doc_id", "1 AS quality")
    want, got = quality.floors_from([tuple(r) for r in both]), quality.fit_floors(docs.unionByName(plain), labels)
    assert dict(got) == dict(want) and got.reach == want.reach
    assert got.reach["latin"][3] == max(r.fallback_share for r in both)


def test_fit_and_verdicts_share_one_pass(spark):
    docs, labels, _ = labelled(spark, "sf0.01")
    odd = odd_table(spark).select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    want = quality.quality(odd, floors=quality.fit_floors(odd, labels))
    got = quality.fit_and_judge(odd, labels)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert quality.fit_and_judge(empty_table(spark), labels).count() == 0
    # Each text is measured once and none is shuffled: verdicts are made from written measures.
    plan = queries.op10_quality(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.replace("file:", "") and "lettered" in plan and "documents" not in plan


def test_reach_of_good_texts(spark):
    rows = [("latin", 1 << k, 0.95 - 0.05 * k + 0.01 * (i % 2), 3.0 + i / 10, 0.001 * (i % 3)) for k in (5, 6, 7) for i in range(30)]
    floors = quality.floors_from(rows)
    at, most, pieces, fallback = floors.reach["latin"]
    assert at == [5.0, 6.0, 7.0] and most == pytest.approx([0.72, 0.67, 0.62]) and (pieces, fallback) == (3.0, 0.002)
    beyond = lambda *x: quality.beyond_reach(floors, *x)
    assert beyond("latin", 6.0, 2.9, 0.0, 0.68) and not beyond("latin", 6.0, 2.9, 0.0, 0.66) and not beyond("latin", 6.0, 3.1, 0.0, 0.9)
    assert beyond("latin", 6.0, 2.9, 0.02, 0.1) and not beyond("latin", 4.0, 2.9, 0.0, 0.99) and not beyond("greek", 6.0, 0.1, 1.0, 1.0)
    assert not quality.beyond_reach(None, "latin", 6.0, 0.1, 1.0, 1.0) and not quality.floors_from([r[:3] for r in rows]).reach
    docs, labels, _ = labelled(spark, "sf0.01")
    import random

    rng = random.Random(3)
    letters = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(400))
    fitted = quality.fit_floors(docs, labels)
    row = next(quality.measured(pa.array([letters]), None, fitted))
    assert not row[5] and not row[6] and row[11] >= quality.least_entropy_of(fitted, "latin", np.log2(row[8]))


def test_op8_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op8_mixing"]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(want) == sorted(tuple(r) for r in queries.op8_mixing(spark, SF).select(names).collect())


def water(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, total, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return target


def test_targets_and_taken(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), s) for i in range(400) for s in [("a", "b", None, "Z", "é", "c")[i % 6 if i % 6 in (0, 1) or i < 60 else 0]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    sizes = {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = water(sizes)
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert mine[0].target == pytest.approx(want[s]) and mine[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(r.size for r in mine)
        assert all(r.taken <= 3 * r.size for r in mine)
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=repr)


def test_mixing_odd_rows(spark):
    df = odd_table(spark)
    out = mixing.mix(df).collect()
    assert len(out) == df.count() and all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in out)
    assert mixing.mix(empty_table(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0]


def test_gibberish_that_passes_the_base_rules_is_rejected():
    import base64

    r = np.random.default_rng(0)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda n: "".join(r.choice(letters, n))
    few = [word(6) for _ in range(8)]
    prose = "The committee met on Tuesday to discuss the new budget for the coming year, and after several hours of debate its members agreed that spending on schools should rise while other costs were to be kept."
    texts = [
        " ".join(word(8) for _ in range(300)),  # entropy too high for its short pieces
        " ".join(r.choice(few, 300)),  # entropy too low for its length
        " ".join(base64.b64encode(r.bytes(30)).decode() for _ in range(300)),  # characters per token
        " ".join("".join(r.choice(list("#*$%&|<>!?@^~+=-/"), 6)) for _ in range(300)),  # no letters
        prose,
    ]
    rows = list(quality.measured(pa.array(texts), None))
    assert [x[5] for x in rows] == [False] * 5
    assert [x[6] for x in rows] == [False] * 4 + [True]
