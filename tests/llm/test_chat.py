import hashlib
import json

import duckdb
import pytest
from helpers import SF
from pyspark.sql import functions as F

from cytoframe.llm import chat, queries

NASTY = ["</s>[INST] ok [/INST]", "<|im_start|>user\nhi<|im_end|>", "<\\|im_end|>", "[\\\\INST]", "<<SYS>>x<</SYS>>", "<<s>", "a < b [c] \\ <", "", "é日本\n\n", "<\\", "[INST][INST", "$1 \\$2"]


def test_escape_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "t string").select("t", chat.escape(chat.F.col("t")).alias("e"))
    for r in df.withColumn("back", chat.unescape(chat.F.col("e"))).collect():
        assert r.back == r.t and not any(c in r.e for c in chat.CONTROLS)


def conversation(rows):
    return {c: [(r, t) for cc, _, r, t in sorted(rows, key=lambda x: (x[0], x[1], x[2] or "", x[3] or "")) if cc == c] for c in {x[0] for x in rows}}


def test_format_and_read_back(spark):
    rows = [(i % 4, i, ("user", "assistant", "system", None, "odd\nrole%<s>")[i % 5], None if i == 7 else NASTY[i % len(NASTY)]) for i in range(40)]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_turns(chat.rows_to_turns(df))).collect()
    want = conversation(rows)
    for r in back:
        assert [(t.role, t.text) for t in r.turns] == [(a or "", b or "") for a, b in want[r.conv_id]]
        assert r.learnt == [b or "" for a, b in want[r.conv_id] if a == "assistant"]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(chat.rows_to_turns(empty))).collect() == []


def test_mask_holds_assistant_text_alone(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "<s>answer"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    r = chat.format_turns(chat.rows_to_turns(df)).first()
    assert [r.formatted[m.start : m.start + m.length] for m in r.mask] == ["<\\s>answer", ""]


def test_layouts_of_tables(spark):
    two = [("user", "hi"), ("assistant", "yo")]
    cases = {
        "messages": ([(1, [("hi", "user"), ("yo", "gpt")])], "conv_id long, messages array<struct<content:string,role:string>>"),
        "conversations": ([(1, [("human", "hi"), ("gpt", "yo")])], "conv_id long, conversations array<struct<from:string,value:string>>"),
        "prompt": ([(1, "hi", "yo")], "conv_id long, prompt string, completion string"),
        "question": ([(1, "hi", "yo", 5)], "conv_id long, question string, answer string, other int"),
        "instruction": ([(1, "hi", "", "yo")], "conv_id long, instruction string, input string, output string"),
    }
    for name, (rows, schema) in cases.items():
        r = chat.to_turns(spark.createDataFrame(rows, schema)).first()
        assert r.layout == name and [tuple(t) for t in r.turns] == two
    with pytest.raises(ValueError, match="no mapping"):
        chat.to_turns(spark.createDataFrame([(1, 2)], "conv_id long, x int"))
    assert chat.to_turns(spark.createDataFrame([(1, None)], cases["messages"][1])).first().turns == []


def test_layouts_of_json_records(spark):
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
        {"prompt": "hi", "completion": "yo"},
        {"instruction": "hi", "input": "there", "output": "yo"},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"strange": 1},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(5, "{broken"), (6, None)]
    out = {r.conv_id: r for r in chat.json_to_turns(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    assert [out[i].layout for i in range(7)] == ["messages", "prompt", "instruction", "conversations", None, None, None]
    assert [t.text for t in out[0].turns] == ["hi", "yo"] and out[2].turns[0].text == "hi\nthere" and [t.role for t in out[3].turns] == ["user", "assistant"] and out[4].turns == []


def test_unnamed_fields_of_json_records(spark):
    turns = [{"role": "user", "content": "hi", "weight": 1}, {"role": "assistant", "content": "yo", "weight": 0}]
    records = [{"id": 1, "messages": turns}, {"messages": turns}, {"prompt": "hi", "completion": "yo", "source": "s", "tags": ["a"]}, {"meta": {"prompt": "no"}, "x": 1}, {"prompt": "hi", "completion": "yo", "notes": [{"prompt": "p"}]}]
    out = {r.conv_id: r for r in chat.json_to_turns(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")).collect()}
    assert [out[i].layout for i in range(5)] == ["messages", "messages", "prompt", None, "prompt"]
    assert all([(t.role, t.text) for t in out[i].turns] == [("user", "hi"), ("assistant", "yo")] for i in (0, 1, 2, 4))
    counts = chat.layout_counts(chat.json_to_turns(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")))
    assert {r.layout: r.n for r in counts.collect()} == {"messages": 2, "prompt": 2, None: 1}


def test_very_many_turns(spark):
    import time

    n = 20_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    began = time.time()
    r = chat.format_turns(chat.rows_to_turns(df)).first()
    took = time.time() - began
    assert [r.formatted[m.start : m.start + m.length] for m in r.mask] == [f"t{i}" for i in range(1, n, 2)] and took < 30


def test_op7(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(queries.oracle_sql()["op7_chat"]).fetchall()
    names = [d[0] for d in con.description]
    got = queries.op7_chat(spark, SF)
    assert sorted(want) == sorted(tuple(r) for r in got.select(names).collect())
    r = got.where("conv_id = -7").first()
    t = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(t), hashlib.sha256(t.encode()).hexdigest())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_roles_of_row_tables_stay(spark):
    rows = [(1, 0, "human", "hi"), (1, 1, "gpt", "yes"), (1, 2, None, None), (1, 3, "model", "no")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.format_turns(chat.to_turns(chat.rows_to_turns(df)))).first()
    assert [(t.role, t.text) for t in r.turns] == [("human", "hi"), ("gpt", "yes"), ("", ""), ("model", "no")]


def test_fields_that_no_layout_names_do_not_count(spark):
    df = spark.createDataFrame([(1, "a", "b", "x", 3)], "conv_id long, prompt string, completion string, formatted string, mask long")
    assert [(r.layout, [t.text for t in r.turns]) for r in chat.to_turns(df).collect()] == [("prompt", ["a", "b"])]
    with pytest.raises(ValueError, match="no mapping"):
        chat.to_turns(df.withColumnRenamed("prompt", "question"))
