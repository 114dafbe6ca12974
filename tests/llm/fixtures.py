"""Small odd tables."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: The same with columns whose names the operators' outputs have.
CLASHING = DOCS + ", score string, shard string, ids string, component_id string, predicted string, held_out string, size string, part string, key string, features string"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}x" for _ in range(n))


def odd_texts():
    rng = random.Random(5)
    base = words(rng, 60)
    near = base.split()
    near[30] = "changed"
    long_ = words(rng, 9000, 3000)
    return [None, "", "   \n\t ", "one", "One two", base, base, base.upper(), " ".join(near), long_, long_ + " tail", "émigré ñandú 日本語 テスト", "1234 5678 !!!", "a" * 3000, words(rng, 30), words(rng, 5), "don't 's 'S we've\t\tx"]


def odd_rows():
    rows = [(i, t, [None, "en", "fr", ""][i % 4], None if i % 3 else "s", None) for i, t in enumerate(odd_texts())]
    return [*rows, (None, "a text without an id and five words", "en", "s", 1), (None, None, None, None, None), rows[5], rows[5]]


def docs(spark, rows=None, clash=False):
    rows = odd_rows() if rows is None else rows
    if clash:
        return spark.createDataFrame([(*r, *["z"] * 10) for r in rows], CLASHING)
    return spark.createDataFrame(rows, DOCS)
