"""Language model, quality, language: exact parts against plain code, the rest by held-out accuracy."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from tideframe.llm import language, markov, quality

from .fixtures import docs, odd_rows

DATA = "/root/testdata/sf0.01"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def test_base_scores_and_counts(spark):
    rows = odd_rows()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        t = tokens(r[1])
        want[r[0], held(r[0]), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)] += 1
    for clash in (False, True):
        got = markov.score_documents(docs(spark, clash=clash)).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert markov.score_documents(docs(spark, [])).count() == 0


def test_forward_and_counts_against_all_paths():
    rng = np.random.default_rng(0)
    s, m = 3, 5
    chain = markov.Chain(*(rng.dirichlet(np.ones(s)) for _ in range(2)), rng.dirichlet(np.ones(s), s), rng.dirichlet(np.ones(m), s).T)
    sequences = [np.array(x) for x in ([0, 1, 4, 2], [3], [2, 2, 2])]
    start, move, emit = np.zeros(s), np.zeros((s, s)), np.zeros((m, s))
    want = []
    for seq in sequences:
        total, parts = 0.0, []
        for path in np.ndindex(*[s] * len(seq)):
            p = chain.start[path[0]] * chain.emit[seq[0], path[0]]
            for t in range(1, len(seq)):
                p *= chain.move[path[t - 1], path[t]] * chain.emit[seq[t], path[t]]
            total += p
            parts.append((path, p))
        want.append(math.log10(total))
        for path, p in parts:
            start[path[0]] += p / total
            for t, state in enumerate(path):
                emit[seq[t], state] += p / total
                if t:
                    move[path[t - 1], state] += p / total
    cut = np.concatenate([[0], np.cumsum([len(x) for x in sequences])])
    assert markov.log10_probabilities(chain, np.concatenate(sequences), cut) == pytest.approx(want)
    got = markov.expected_counts(chain, sequences, np.ones(3, bool))
    for a, b in zip(got, (start, move, emit), strict=True):
        assert a == pytest.approx(b)


def test_model_beats_the_base(spark):
    rows = markov.score_documents(spark.read.parquet(f"{DATA}/documents.parquet")).where("held_out").toPandas()
    assert rows["score"].sum() > rows["base_score"].sum() + 0.2 * rows["n_tokens"].sum()


def test_quality(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.fit(table, labels)
    got = quality.score_documents(table, model).join(labels, "doc_id").where(quality.held_out()).toPandas()
    assert ((got["score"] >= 0.7) == (got["quality"] == 1)).mean() > 0.95
    odd = quality.score_documents(docs(spark, clash=True), model)
    rows = odd.collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert dict(odd.dtypes)["score"] == "double"
    empty = quality.fit(docs(spark, []), labels.limit(0))
    assert {r["score"] for r in quality.score_documents(docs(spark), empty).collect()} == {0.5}
    null_labels = spark.createDataFrame([(5, None, 0), (None, 1, 0), (6, 1, 0), (6, 0, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score_documents(docs(spark), quality.fit(docs(spark), null_labels)).count() == len(odd_rows())


def test_language(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(table)
    got = language.predict(table, model).where(language.held_out()).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    assert got["accepted"].mean() > 0.95
    rows = language.predict(docs(spark, clash=True), model).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        if r["text"] is None or not any(map(str.isalpha, r["text"])):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
        else:
            assert r["lang_pred"] in model.languages and 0 <= float(r["score"]) <= 1
    assert language.fit(docs(spark, [])) is None
    assert {r["lang_pred"] for r in language.predict(docs(spark), None).collect()} == {"und"}
    assert language.predict(docs(spark), language.fit(docs(spark))).count() == len(odd_rows())


@pytest.mark.parametrize("kind", ["one id", "null ids", "copies"])
def test_samples_stay_bounded(spark, kind):
    """Thousands of rows of one id, of none, or of one text give the driver no more than the stated number."""
    rows = [(None if kind == "null ids" else 3 if kind == "one id" else i, "ein text" if kind == "copies" else f"text {i} mot", "de" if i % 2 else "fr", "s", 1) for i in range(5000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 5000)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs(spark, rows), labels, labelled=200)
    assert len(model.vectors) <= (1 if kind == "one id" else 0 if kind == "null ids" else 560)
    seen = []
    real, language.train = language.train, lambda rows: seen.append(len(rows))
    try:
        assert language.fit(docs(spark, rows), sampled=100) is None
    finally:
        language.train = real
    assert not seen if kind == "null ids" else seen[0] <= 320


def test_every_language_is_learned(spark):
    """No language is left out for being rare, nor for there being many: each is told on a text of its own."""
    rows = [(i, f"lang{i % 300}word other{i % 300} " * 3, f"l{i % 300}", "s", 1) for i in range(3000)]
    rows += [(10_000 + i, f"rare{i}thing single{i} " * 3, f"r{i}", "s", 1) for i in range(40) if zlib.crc32(str(10_000 + i).encode()) % 5]
    wanted = {r[2] for r in rows}
    for most in (160_000, 1700, 10):
        model = language.fit(docs(spark, rows), most=most)
        assert set(model.languages) == wanted
    for n in (1, 4, 30):
        sample = [(f"l{i * i % n}", i) for i in range(100)] + [("alone", 0)]
        for turn in range(5):
            learned, held = language.split(sample[turn:] + sample[:turn])
            assert {r[0] for r in learned} == {r[0] for r in sample} and sorted(learned + held) == sorted(sample) and len(held) > 8


def test_language_scores_against_a_plain_pass(spark):
    """Scores are the softmax of the mean of embeddings of byte triples and words, text by text."""
    rows = odd_rows()
    model = language.fit(docs(spark, rows))
    got = {(r["doc_id"], r["text"]): r for r in language.predict(docs(spark, rows), model).collect()}
    from tideframe.llm.features import subwords

    for (_, text), r in got.items():
        data = (text or "").encode()
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        share = subwords(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
        mean = sum((share[i] * model.embedding[i].astype(float) for i in np.flatnonzero(share)), np.zeros(language.WIDTH))
        logits = (mean @ model.output.astype(float) + model.bias) / model.temperature
        p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        assert r["score"] == pytest.approx(p.max(), abs=1e-4) and p[model.languages.index(r["lang_pred"])] == pytest.approx(p.max(), abs=1e-4)


def test_votes_against_all_neighbours():
    """The blocked vote is that of every vector in turn, ties by place."""
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(60, 5))
    vectors[30:] = vectors[:30]  # every vector twice: ties everywhere
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = rng.integers(0, 2, 60).astype(float)
    model = quality.Model(np.ones(5, np.float32), np.eye(5), vectors, labels, 0.4)
    model.weighted = lambda x: x
    x = np.vstack([rng.normal(size=(700, 5)), np.zeros((1, 5)), -vectors.sum(axis=0)[None]])
    got = model.score(x)
    for row, score in zip(x, got, strict=True):
        size = np.linalg.norm(row)
        cosines = [float(row @ v) / size if size > 1e-9 else 0.0 for v in vectors]
        # equal vectors may differ in a cosine's last digit, and so may their order
        near = sorted(range(60), key=lambda i: (-round(cosines[i], 9), i))[: quality.NEIGHBOURS]
        weight = [max(0.0, cosines[i]) ** quality.SHARPNESS for i in near]
        assert score == pytest.approx(sum(w * labels[i] for w, i in zip(weight, near, strict=True)) / sum(weight) if sum(weight) > 1e-9 else 0.4, abs=1e-6)
    tied = quality.nearest(np.array([[1.0, 0.5, 0.5, 0.5, 0.2]]), 2)
    assert sorted(tied[0]) == [0, 1]


def test_short_texts_take_bounded_memory():
    import pyarrow as pa

    from tideframe.llm.features import DENSE_ROWS, batched, quality_features, subwords

    column = pa.array([f"text {i}" for i in range(3000)])
    for make in (subwords, quality_features):
        sizes = [len(x) for x in batched(column, make)]
        assert sum(sizes) == 3000 and max(sizes) <= DENSE_ROWS


def test_forty_documents_in_many_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"{'ab'[j % 2]}{rng.integers(0, 6)}word" for j in range(60)), "en", "s", 1) for i in range(40)]
    table = docs(spark, rows)
    one, many = (markov.score_documents(table.repartition(n)).toPandas() for n in (1, 8))
    assert many["score"].sum() > many["base_score"].sum()
    assert many["score"].sum() == pytest.approx(one["score"].sum())


def test_registered_queries(spark):
    """held_out, digests and casts of the registered queries themselves."""
    from tideframe.llm import queries

    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    crc = lambda i, of: zlib.crc32(str(i).encode()) % of
    for name, of, fold in (("op5_hidden_markov", 7, 2), ("op6_neighbour_quality", 4, 2), ("op7_subword_language", 5, 0)):
        rows = queries.queries()[name](spark, folder).collect()
        assert len(rows) == n
        assert all(r["held_out"] == (crc(r["doc_id"], of) == fold) for r in rows)
        if of == 4:
            assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    langs = {r[0] for r in spark.read.parquet(f"{folder}/documents.parquet").select("lang").distinct().collect()}
    assert {r["lang_pred"] for r in rows} <= langs | {"und"}
    shards = queries.op3_splitter_shards(spark, folder).collect()
    assert len(shards) == n and {r["law"] for r in shards} == {"bytes"}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]])) for r in shards)
    pieces = queries.op4_curve_packing(spark, folder).toPandas()
    ends = pieces.sort_values("start").groupby("doc_id").agg({"length": "sum", "doc_tokens": "first"})
    assert len(ends) == n and (ends["length"] == ends["doc_tokens"]).all()


def test_training_of_few_short_texts(spark):
    """Every pass sees every segment, however few lie in a partition: the chain is that of a plain loop."""
    rng = np.random.default_rng(5)
    v = SimpleNamespace(size=12, unigram=np.ones(12))
    texts = [rng.integers(0, 12, 9).astype("<u2") for _ in range(6)]
    want, back = markov.first_chain(v), np.full(12, 1 / 12)
    for _ in range(markov.PASSES):
        start, move, emit = markov.expected_counts(want, texts, np.ones(6, bool))
        start, move, use = start + 1, move + 0.5, emit.sum(axis=0)
        emit = (emit + markov.SMOOTHING * back[:, None]) / (use + markov.SMOOTHING)
        want = markov.Chain(start / start.sum(), (use + 1) / (use + 1).sum(), move / move.sum(axis=1, keepdims=True), emit)
    frame = spark.createDataFrame([(False, bytearray(t.tobytes())) for t in texts], "held_out boolean, symbols binary")
    for n in (1, 6):
        got = markov.train(frame.repartition(n), v)
        assert got.emit == pytest.approx(want.emit) and got.move == pytest.approx(want.move) and got.start == pytest.approx(want.start)
