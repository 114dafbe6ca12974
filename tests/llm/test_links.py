"""Near duplicates and vector links against brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.llm import minhash_join, near_vectors
from tideframe.llm.components import components
from tideframe.llm.idfilter import id_filter
from tideframe.llm.scratch import Scratch

from .fixtures import docs, odd_rows, words

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(ids, linked):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(ids), 2):
        if linked(a, b):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def check_documents(spark, rows):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    want = groups(sets, lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    got = minhash_join.link_documents(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"]), r


def test_odd_documents(spark):
    check_documents(spark, odd_rows())
    assert minhash_join.link_documents(docs(spark, clash=True)).count() == len(odd_rows())
    assert minhash_join.link_documents(docs(spark, [])).count() == 0


def test_chains_and_large_groups(spark, monkeypatch):
    """Near copies in a long chain, and a group of many blocks whose members partly link to no leader."""
    monkeypatch.setattr(minhash_join, "BLOCK", 8)
    rng, rows = random.Random(2), []
    base = words(rng, 120).split()
    for i in range(90):
        near = list(base)
        for _ in range(rng.randrange(5)):
            near[rng.randrange(120)] = f"n{rng.randrange(99)}"
        rows.append((i, " ".join(near), None, None, None))
    chain = words(rng, 100).split()
    for i in range(100, 115):
        chain = [*chain[2:], f"c{i}", f"d{i}"]
        rows.append((i, " ".join(chain), None, None, None))
    rows += [(200 + i, words(rng, 40, 5000), None, None, None) for i in range(40)]
    check_documents(spark, rows)


def test_long_posting_lists(spark, monkeypatch):
    """Lists of many blocks: near copies in them link as by brute force, and keys of many rows join by broadcast."""
    from tideframe.llm import skew

    for name, value in (("BLOCK", 8), ("SIGNATURES", 16)):
        monkeypatch.setattr(minhash_join, name, value)
    monkeypatch.setattr(skew, "FEW_ROWS", 20)
    rng, rows = random.Random(4), []
    passage = words(rng, 70)
    for i in range(120):  # one passage makes two thirds of unlike documents
        rows.append((i, f"{words(rng, 18, 9000)} {passage} {words(rng, 17, 9000)}", None, None, None))
    base = words(rng, 90).split()
    for i in range(200, 290):
        near = list(base)
        near[rng.randrange(90)] = f"n{i}"
        rows.append((i, " ".join(near), None, None, None))
    rows += [(400 + i, rows[0][1], None, None, None) for i in range(60)]
    check_documents(spark, rows)


def test_a_common_passage_compares_few_texts(spark, monkeypatch):
    """5,000 unlike documents of one common passage each: signatures part them, so few texts are compared."""
    rng = random.Random(14)
    passage = words(rng, 60, 50_000)
    rows = [(i, f"{words(rng, 30, 50_000)} {passage} {words(rng, 30, 50_000)}", None, None, None) for i in range(5000)]
    compared = []
    real = minhash_join._confirm

    def counting(table, percent):
        compared.append(table.count())
        return real(table, percent)

    monkeypatch.setattr(minhash_join, "_confirm", counting)
    got = minhash_join.link_documents(docs(spark, rows)).collect()
    assert len(got) == 5000 and all(r["kept"] for r in got)
    assert sum(compared) <= 500


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame([*path, *star, (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges, Scratch(spark)).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1300), 1000)}
    assert components(edges.limit(0), Scratch(spark)).count() == 0


def test_id_filter_never_drops(spark):
    ids = spark.range(0, 4000, 2)
    rows = spark.range(4001).union(spark.createDataFrame([(None,)], "id long"))
    kept = rows.where(id_filter(ids, "id").may_hold("id"))
    assert kept.where("id % 2 = 0 and id < 4000").count() == 2000
    assert kept.count() < 2600


def check_vectors(spark, rows, kind="array<float>", label="int"):
    """Brute force over all rows (vec_id, vector, label): links between distinct (vec_id, label, vector)."""
    frame = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label {label}").withColumn("links", F.lit("x"))
    good = lambda r: r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])
    nodes = sorted({(i, lab, tuple(v)) for i, v, lab in rows if good((i, v, lab))}, key=str)

    def near(a, b):
        x, y = np.array(a[2], float), np.array(b[2], float)
        return a[1] == b[1] and len(x) == len(y) and x @ y / np.sqrt(x @ x * (y @ y)) >= 0.98

    links = [[near(a, b) for b in nodes] for a in nodes]
    n = {a: sum(links[i]) - 1 for i, a in enumerate(nodes)}
    pairs = {frozenset((a[0], b[0])) for i, a in enumerate(nodes) for j, b in enumerate(nodes) if links[i][j]}
    want = groups({a[0] for a in nodes}, lambda a, b: frozenset((a, b)) in pairs)
    expected = sorted(((i, n[i, lab, tuple(v)], want[i], want[i] == i) if good((i, v, lab)) else (i, 0, i, True) for i, v, lab in rows), key=str)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.link_vectors(frame).collect()), key=str)
    assert got == expected
    return n


def odd_vectors(rng, width=24):
    centre, rows = rng.normal(size=width), []
    for i in range(400):
        v = centre + rng.normal(size=width) * 0.18 * rng.random() if i < 120 else centre * 3 if i < 130 else rng.normal(size=width)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2 if i < 120 or i > 140 else None if i == 135 else 0))
    return rows + [(500, None, 0), (501, [0.0] * width, 0), (502, [float("nan")] + [1.0] * (width - 1), 0), (503, [None] + [1.0] * (width - 1), 0), (504, [1.0], 0), (505, [], 0), (506, [float("inf")] * width, 1), (None, rows[0][1], 0), rows[1], (507, rows[0][1], None)]


@pytest.mark.parametrize(("whole", "first"), [(8192, 1024), (30, 1024), (30, 2)])
def test_vectors_against_brute_force(spark, monkeypatch, whole, first):
    """One list a label; lists of one level; lists of two levels."""
    for name, value in (("BLOCK", 16), ("PER_LIST", 40), ("WHOLE", whole), ("FIRST_LISTS", first)):
        monkeypatch.setattr(near_vectors, name, value)
    rows = odd_vectors(np.random.default_rng(3))
    assert max(check_vectors(spark, rows).values()) > 20


def test_vectors_that_share_ids_or_widths(spark):
    """A vec_id of several vectors has the links of each; other widths link among their own; labels of any type."""
    rng = np.random.default_rng(5)
    a, b, c = (rng.normal(size=8).tolist() for _ in range(3))
    close = lambda v: [x * 1.001 for x in v[:-1]] + [v[-1]]
    rows = [(1, a, 2**40), (1, b, 2**40), (2, close(a), 2**40), (3, close(b), 2**40), (4, c, 2**40), (5, a[:3], 2**40), (6, close(a[:3]), 2**40), (6, a[:3], 7), (7, [5.0], 7), (8, [2.0], 7), (9, [-2.0], 7), (4, c, 2**40)]
    check_vectors(spark, rows, "array<double>", "long")
    check_vectors(spark, [(i, v, f"label {lab}") for i, v, lab in rows], "array<double>", "string")
    check_vectors(spark, [(i % 3, v, lab) for i, v, lab in odd_vectors(rng, 4)[:60]])
    check_vectors(spark, [(i, [1.0, 2.0] if i % 3 else [float(i), 1.0], 0) for i in range(60)])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_vectors.link_vectors(empty).count() == 0
    assert near_vectors.link_vectors(spark.createDataFrame([(1, None, 0)], empty.schema)).collect()[0]["kept"]


def test_registered_links_against_brute_force(spark, tmp_path):
    """The registered queries over whole tables of a folder."""
    from tideframe.llm import queries

    rows = odd_vectors(np.random.default_rng(9))[:300]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    good = {i: (np.array(v), lab) for i, v, lab in rows if lab is not None}
    linked = lambda a, b: good[a][1] == good[b][1] and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.98
    want = groups(good, linked)
    for r in queries.op1_quantised_links(spark, str(tmp_path)).collect():
        assert r["component_id"] == want.get(r["vec_id"], r["vec_id"])
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    sets = {r["doc_id"]: shingles(r["text"]) for r in table}
    want = groups(sets, lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op9_minhash_links(spark, folder).collect()}
    assert got == {i: (len(sets[i]), c, c == i) for i, c in want.items()}


@pytest.mark.parametrize("least", [0.9, 0.98])
@pytest.mark.parametrize("first", [8, 1024])
def test_probes_are_sufficient(least, first, monkeypatch):
    monkeypatch.setattr(near_vectors, "FIRST_LISTS", first)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = near_vectors.fit(x[:200], 100_000, least)
    assert len(index.second.centres) == (3 if first == 8 else 1)
    at, codes, error = index.encode(x)
    probes = index.probes(x)
    assert len(probes) == len(x)
    for i, j in zip(*np.nonzero(x @ x.T >= least), strict=True):
        assert at[j] in probes[i]
        assert index.distances(x[i : i + 1], at[j : j + 1], codes[j : j + 1])[0, 0] <= (index.reach + error[j] + 1e-4) ** 2
