"""Phrase collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tideframe.llm import collocations
from tideframe.llm.scratch import Scratch

from .fixtures import docs, odd_rows

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain(rows, least, top=2000, longest=5, inside=100):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f.update((lang, *w[i : i + size]) for i in range(len(w) - size + 1))
    some = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    out = []
    for (lang, *w), a in some.items():
        words = tuple(w)
        if any(x[0] == lang and len(x) > len(w) + 1 and 100 * b >= inside * a and any(x[1 + i : 1 + i + len(w)] == words for i in range(len(x) - len(w))) for x, b in some.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.append((lang, score, a, " ".join(w), f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang]))
    want, place = [], Counter()
    for lang, score, a, phrase, left, right, total in sorted(out, key=lambda x: (x[0], -x[1], -x[2], x[3].encode())):
        place[lang] += 1
        if place[lang] <= top:
            want.append((lang, place[lang], phrase, a, left, right, total, score))
    return sorted(want)


def made(spark, rows, clash=False, **given):
    got = collocations.mine_phrases(docs(spark, rows, clash), **given)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def random_rows(n=120):
    rng = random.Random(3)
    out = []
    for i in range(n):
        text = " ".join(rng.choice(["the", "The", "of", "a", "a a", "ñu", "b.c", "x,", "\t d", "e\n", "日本"]) for _ in range(rng.randrange(40)))
        out.append((i, text, rng.choice(["en", "fr", None, "und"]), "s", 1))
    return out


@pytest.mark.parametrize("least,top,longest,inside", [(2, 2000, 5, 100), (10, 7, 5, 100), (10, 2000, 2, 100), (5, 2000, 3, 90), (4, 2000, 7, 60)])
def test_against_plain_counting(spark, least, top, longest, inside):
    rows = random_rows()
    want = plain(rows, least, top, longest, inside)
    assert want and made(spark, rows, least=least, top=top, longest=longest, inside=inside) == want


def test_odd_rows(spark):
    rows = odd_rows()
    assert made(spark, rows, least=2) == made(spark, rows, True, least=2) == plain(rows, 2)
    assert made(spark, [], least=2) == [] == made(spark, [(1, None, None, None, None), (2, "", "en", None, None)], least=1)
    # one piece of equal words, much longer than a block of a hundred words
    assert made(spark, [(1, "ha " * 3000, "en", None, None)], least=2) == plain([(1, "ha " * 3000, "en")], 2)


def test_dictionaries_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BROADCAST_WORDS", 3)
    rows = random_rows()
    assert made(spark, rows, least=3) == plain(rows, 3)


def test_blocks_do_not_cut_phrases(spark, monkeypatch):
    rows = random_rows()
    whole = made(spark, rows, least=3)
    batches = list(spark.createDataFrame([(r[1], r[2] or "und") for r in rows], "text string, lang string").toArrow().to_batches())
    for size in (1, 1 << 20):
        monkeypatch.setattr(collocations, "BLOCK_WORDS", size)
        monkeypatch.setattr(collocations, "HELD_WORDS", size)
        counts = Counter()
        for batch in collocations._word_counts(0)(iter(batches)):
            for r in batch.to_pylist():
                counts[r["lang"], r["word"]] += r["a"]
        assert counts == Counter((r[2] or "und", w) for r in rows for w in re.findall(r"[^\x20\x09.,;:!?\x0a-\x0d]+", r[1].translate(LOWER)))
    assert whole == plain(rows, 3)


def test_codes_that_clash_take_another_seed(spark, monkeypatch):
    right = collocations.seeds
    monkeypatch.setattr(collocations, "mix", lambda x: x & np.uint64(1))
    table = spark.createDataFrame([("a b c d", "en")], "text string, lang string")
    rows = [r for batch in collocations._word_counts(0)(iter(table.toArrow().to_batches())) for r in batch.to_pylist()]
    assert sorted(r["word"] for r in rows) == ["a", "b", "c", "d"] and right is collocations.seeds
    monkeypatch.undo()
    counts, seed = collocations.dictionary(Scratch(spark), table)
    assert seed == 0 and counts.count() == 4


def test_equal_mixed_values_are_told_apart():
    import pyarrow as pa

    rows = pa.record_batch({"h": pa.array([1, 1, 1, 2, 2], pa.int64()), "key": pa.array([b"aaaa", b"bbbb", b"aaaa", b"cccccccc", b"cccccccc"]), "a": pa.array([1, 2, 3, 4, 5], pa.int64())})
    for cut in range(6):
        got = [r for b in collocations._run_lengths(1, 4)(iter([rows.slice(0, cut), rows.slice(cut)])) for r in b.to_pylist()]
        assert sorted((r["key"], r["a"]) for r in got) == [(b"aaaa", 4), (b"bbbb", 2), (b"cccccccc", 9)]


def test_table_against_sql(spark):
    table = f"{DATA}/documents.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{table}'")
    sql = collocations.ORACLE_SQL.replace(">= 100),", ">= 20),")
    want = sorted(db.execute(sql).fetchall())
    assert want and sorted(tuple(r) for r in collocations.mine_phrases(spark.read.parquet(table), least=20).collect()) == want
