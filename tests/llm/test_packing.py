"""Token ids, both packings and the shards: exact round trips on odd texts."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tideframe.llm import curve_packing, fit_packing, sharding
from tideframe.llm.arrays import text_slices
from tideframe.llm.tokens import default_path, encoder

from .fixtures import docs, odd_rows


@pytest.fixture(scope="module")
def whole():
    made = Tokenizer.from_file(default_path())
    made.encode_special_tokens = True
    return lambda t: made.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é'sdtmrelvn 12\n\t  　日.!<|>"), max_size=30), min_size=1, max_size=6))
def test_ids_are_the_tokenizers(texts):
    import pyarrow as pa

    made = Tokenizer.from_file(default_path())
    made.encode_special_tokens = True
    for lo, hi, data, offsets in text_slices(pa.array(texts)):
        ids, counts = encoder(default_path()).encode(data, offsets)
        at = 0
        for text, n in zip(texts[lo:hi], counts.tolist(), strict=True):
            assert ids[at : at + n].tolist() == made.encode(text, add_special_tokens=False).ids
            at += n


@pytest.mark.parametrize("clash", [False, True])
def test_curve_pieces_hold_every_id_once(spark, whole, clash):
    got = curve_packing.pack_along_curve(docs(spark, clash=clash), sequence=256, range_bytes=4096).collect()
    want = sorted(zlib.crc32(np.array([*whole(r[1]), 1], "<u4").tobytes()) for r in odd_rows())
    by = defaultdict(list)
    for p in got:
        by[p["doc_id"], p["doc_tokens"]].append((p["start"], np.frombuffer(p["ids"], "<u4")))
        assert len(p["ids"]) == 4 * p["length"]
    seen = []
    for (_, total), pieces in by.items():
        pieces.sort(key=lambda x: x[0])
        rows = []  # repeated rows give the same pieces several times
        for start, ids in pieces:
            if start == 0:
                rows.append([])
            row = next(r for r in rows[::-1] if len(r) == start)
            row.extend(ids.tolist())
        assert all(len(r) == total for r in rows)
        seen += [zlib.crc32(np.array(r, "<u4").tobytes()) for r in rows]
    if not clash:
        assert sorted(seen) == want
    spans = defaultdict(list)
    for p in got:
        spans[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(1 for p in spans.values() if sum(x for _, x in p) < 256) <= 1


def test_hilbert_neighbours_touch():
    side = np.array([[x, y] for x in range(16) for y in range(16)])
    order = side[np.argsort(curve_packing.hilbert_keys(side, 4))]
    assert len(set(curve_packing.hilbert_keys(side, 4).tolist())) == 256
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("clash", [False, True])
def test_best_fit_rows(spark, whole, clash):
    got = fit_packing.pack_best_fit(docs(spark, clash=clash), sequence=256).collect()
    total, pieces = 0, defaultdict(list)
    for r in got:
        ids, place, cuts = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4"), r["cu_seqlens"]
        assert len(ids) == len(place) == 256 and cuts[0] == 0 and cuts[-1] == r["n_tokens"] <= 256
        for a, b, n in zip(cuts, cuts[1:], r["lengths"], strict=False):
            assert b - a == n and place[a:b].tolist() == list(range(n))
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], cuts, cuts[1:], strict=False):
            pieces[doc].append((start, ids[a:b].tolist()))
        total += r["n_tokens"]
    assert total == sum(len(whole(x[1])) + 1 for x in odd_rows())
    want = defaultdict(list)
    for x in odd_rows():
        want[x[0]].append([*whole(x[1]), 1])
    for doc, found in pieces.items():  # a document's pieces, joined by their starts, are its ids
        rows = []
        for start, ids in sorted(found, key=lambda x: x[0]):
            if start == 0:
                rows.append([])
            next(r for r in reversed(rows) if len(r) == start).extend(ids)
        assert sorted(rows) == sorted(want[doc])
    assert set(pieces) == set(want)


def test_padding_does_not_grow_with_tasks(spark):
    """Short documents over many partitions take as few rows as in one, but for the last of each final task."""
    rows = [(i, f"text {i} " * (1 + i % 9), None, None, None) for i in range(400)]
    one, many = (fit_packing.pack_best_fit(docs(spark, rows).repartition(n), sequence=256) for n in (1, 40))
    tokens = one.agg({"n_tokens": "sum"}).first()[0]
    assert many.agg({"n_tokens": "sum"}).first()[0] == tokens
    assert one.count() <= many.count() <= -(-tokens // 256) + 2
    assert many.select("sequence_id").distinct().count() == many.count()


def test_best_fit_chooses_the_least_room():
    rows = fit_packing.best_fit(np.array([6, 5, 4, 4, 3, 2]), 10)
    assert sorted(sum(rows, [])) == list(range(6))
    assert [sum([6, 5, 4, 4, 3, 2][i] for i in r) for r in rows] == [10, 9, 5] or len(rows) == 3


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_best_fit_against_plain_search(lengths):
    rooms = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in range(len(rooms)) if rooms[r] >= lengths[i]]
        if fits:
            rooms[min(fits, key=lambda r: rooms[r])] -= lengths[i]
        else:
            rooms.append(64 - lengths[i])
    got = fit_packing.best_fit(np.array(lengths), 64)
    assert sorted(64 - sum(lengths[i] for i in r) for r in got) == sorted(rooms)


def test_shards(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i} " * (i % 7), None, None, None) for i in range(3000)]
    got = sharding.shard_documents(docs(spark, rows)).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        text = rows[r["doc_id"]][1].encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text)
    assert len(got) == 3000 and set(sizes) == set(range(16))
    assert max(sizes.values()) - min(sizes.values()) < 0.03 * sum(sizes.values()) / 16 + 200
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("n", [1, 100, 4000])
@pytest.mark.parametrize("kind", ["null ids", "one id", "equal rows", "null texts"])
def test_samples_of_rows_without_own_ids(spark, n, kind):
    """Shards and curve pieces of tables whose ids do not tell rows apart: whole results, and a bounded sample."""
    rows = [(None if kind == "null ids" else 7 if kind in ("one id", "equal rows") else i, None if kind == "null texts" else "same text" if kind == "equal rows" else f"text {i * 7919 % n} " * (1 + i % 5), "en", "s", 1) for i in range(n)]
    got = sharding.shard_documents(docs(spark, rows)).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == n and all(sorted(s) == list(range(len(s))) for s in slots.values())
    if n == 4000:
        assert len(slots) == 16
    frame = sharding.document_rows(docs(spark, rows))
    total = frame.agg({"size": "sum"}).first()[0]
    assert len(sharding.weighted_splitters(frame, "key", "order_id", "size", 8, total)) <= 8
    pieces = curve_packing.pack_along_curve(docs(spark, rows), sequence=256, range_bytes=2048).select("length", "start", "doc_tokens").collect()
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)
    assert sum(p["start"] == 0 for p in pieces) == n


def test_neighbours_on_the_curve_are_alike(spark):
    """Documents that follow each other in the pieces share their topic far more often than chance."""
    rng = random.Random(8)
    topics = [[f"t{k}w{j}" for j in range(12)] for k in range(12)]
    rows = [(i, " ".join(rng.choice(topics[i % 12]) for _ in range(80)), "en", "s", 1) for i in range(600)]
    got = curve_packing.pack_along_curve(docs(spark, rows), range_bytes=8192).where("start = 0").orderBy("sequence_id", "offset").collect()
    order = [r["doc_id"] % 12 for r in got]
    assert len(order) == 600
    assert sum(a == b for a, b in zip(order, order[1:], strict=False)) > 4 * 600 / 12


def test_odd_shards(spark):
    got = sharding.shard_documents(docs(spark, clash=True)).collect()
    assert len(got) == len(odd_rows())
    assert {r["size"] for r in got if r["doc_id"] == 0} == {1}


def test_empty_tables(spark):
    none = docs(spark, [])
    assert sharding.shard_documents(none).count() == 0
    assert curve_packing.pack_along_curve(none).count() == 0
    assert fit_packing.pack_best_fit(none).count() == 0


def test_written_files(spark, tmp_path):
    rows = [(i, f"text {i}", "en", "s", 1) for i in range(50)]
    for clash in (False, True):  # rows without id and repeated ones are written too
        sharding.write_shards(docs(spark, rows + odd_rows(), clash=clash), str(tmp_path / f"s{clash}"))
        written = spark.read.parquet(str(tmp_path / f"s{clash}"))
        assert written.count() == 50 + len(odd_rows())
        assert written.where("doc_id is null").count() == 2
    fit_packing.write_packed(fit_packing.pack_best_fit(docs(spark, rows).coalesce(1)), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
