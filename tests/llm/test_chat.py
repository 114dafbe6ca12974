"""Chat formatting: layouts, marks and masks against plain reading."""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tideframe.llm import chat, queries

DATA = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn long, role string, text string"
ODD = [None, "", " ", "\\", "\\\\", "#", "##", "###", "####", "#######", "\\#", "</", "</turn>", "<</turn>\n</", "### User: a</turn>\n", "<\\/turn>", "\n\n", "a: b: ", "日本語 é́", "x" * 200_000, "\\### Assistant: </turn> ok", "<", "$1 \\$1"]
ROLES = ["user", "assistant", "system", "tool: </turn>\n### User", "", None, "=user", "User", "日 本"]


def plain(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = set()
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out.add((conv, len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss)))
    return out


def test_texts_and_roles_come_back(spark):
    rows = [(i, j, role, text) for i, role in enumerate(ROLES) for j, text in enumerate(ODD)]
    made = chat.format_turns(spark.createDataFrame(rows, TURNS))
    got = made.withColumn("back", chat.read_back(F.col("formatted"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["back"]["role"], r["back"]["text"]) == (r["role"] or "", r["text"] or "")
        body = r["formatted"].removeprefix("### ").removesuffix("</turn>\n")
        assert "### " not in body and "</turn>" not in body[:-1].replace("<</turn>", "")
        if r["role"] == "assistant":
            assert r["formatted"][r["loss_start"] : r["loss_end"]].replace("\\", "") == (r["text"] or "").replace("\\", "")
        else:
            assert r["loss_start"] is None and r["loss_end"] is None
    # one text of all turns parts into the same turns
    whole = "".join(r["formatted"] for r in got)
    back = spark.createDataFrame([(whole,)], "t string").select(F.explode(chat.read_text(F.col("t"))).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in back] == [(r["role"] or "", r["text"] or "") for r in got]


@pytest.mark.parametrize("clash", [False, True])
def test_digests(spark, clash):
    rows = [(i % 3 if i % 3 < 2 else None, j % 9 or None, role, text) for i, role in enumerate(ROLES) for j, text in enumerate(ODD)]
    rows += rows[:5]
    table = spark.createDataFrame(rows, TURNS)
    if clash:
        for name in ("prompt", "messages", "formatted", "loss_start", "loss", "layout", "_turns"):
            table = table.withColumn(name, F.lit("z"))
    got = chat.digest(chat.format_turns(chat.turns_of_table(table)))
    assert {tuple(r)[:5] for r in got.collect()} == plain(rows)
    assert chat.digest(chat.format_turns(chat.turns_of_table(table.limit(0)))).count() == 0


def test_a_long_conversation_crosses_batches(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(25_000)] + [(2, 0, "user", "x")]
    got = chat.digest(chat.format_turns(spark.createDataFrame(rows, TURNS).repartition(7)))
    assert {tuple(r)[:5] for r in got.collect()} == plain(rows)


def test_registered_query_against_plain_reading_and_sql(spark):
    got = Counter(tuple(r) for r in queries.queries()["op12_chat"](spark, DATA).collect())
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, i, r, "\\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant"))]
    assert {r[:5] for r in got} == plain(rows)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    assert got == Counter(db.execute(chat.ORACLE_SQL).fetchall())


RECORDS = {
    "messages": ({"system": "be", "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}], "id": 3}, [("system", "be"), ("user", "hi"), ("assistant", "")]),
    "messages of parts": ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, [("user", "ab")]),
    "conversations": ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]}, [("user", "q"), ("assistant", "a"), ("tool", "t")]),
    "instruction": ({"instruction": "do", "input": "", "output": "done", "meta": {"prompt": "no"}}, [("user", "do"), ("assistant", "done")]),
    "prompt and response": ({"prompt": "p", "response": "r", "system": ""}, [("user", "p"), ("assistant", "r")]),
    "prompt and completion": ({"completion": 7, "prompt": "p"}, [("user", "p"), ("assistant", "7")]),
    "question and answer": ({"question": "q", "context": "c", "answer": "a"}, [("user", "q\n\nc"), ("assistant", "a")]),
    "turn rows": ({"turn": 4, "role": "user", "text": "x"}, [("user", "x")]),
}


def test_records_of_all_layouts(spark):
    names = list(RECORDS)
    bad = [None, "", "{", "[]", "3", "null", '{"a": 1}', '{"messages": []}', '{"messages": "x"}', '{"prompt": {"response": 1}}', "[" * 3000]
    lines = [(i, json.dumps(RECORDS[n][0])) for i, n in enumerate(names)] + [(100 + i, x) for i, x in enumerate(bad)]
    table = spark.createDataFrame(lines, "conv_id long, record string")
    told = {r["conv_id"]: r["layout"] for r in chat.with_layouts(table, "record").collect()}
    assert [told[i] for i in range(len(names))] == names and not any(told[100 + i] for i in range(len(bad)))
    got = {}
    for r in chat.turns_of_json(table, "record").orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    for i, n in enumerate(names):
        first = 4 if n == "turn rows" else 0
        assert got.pop(i) == [(first + j, *t) for j, t in enumerate(RECORDS[n][1])], n
    assert not got
    # the same records as typed tables, told by their schema
    for n in names:
        typed = spark.read.json(spark.sparkContext.parallelize([json.dumps(RECORDS[n][0] | {"conv_id": 1, "notes": "z"})]))
        turns = [(r["role"], r["text"]) for r in chat.turns_of_table(typed).orderBy("turn").collect()]
        assert turns == RECORDS[n][1], n
    with pytest.raises(ValueError):
        chat.turns_of_table(spark.createDataFrame([(1, "x")], "conv_id long, words string"))


def test_order_for_writing_spreads_a_conversation(spark):
    rows = [(1, i, "user", f"t{i}") for i in range(4000)]
    out = chat.in_order(chat.format_turns(spark.createDataFrame(rows, TURNS)))
    parts = out.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.min("turn").alias("a"), F.max("turn").alias("b")).orderBy("a").collect()
    assert all(x["b"] < y["a"] for x, y in zip(parts, parts[1:], strict=False))
