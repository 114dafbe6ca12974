"""Whitening against a plain eigen decomposition in exact sums."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from tideframe.llm import queries, whitening

DATA = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, components=4):
    """{vec_id: [(component, n, deviation, whitened, explained)]}, of one width."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, x in kept:
        gap = [n * c - s for c, s in zip(x, sums, strict=True)]
        z = np.array([g / n for g in gap]) @ u
        out.setdefault(i, []).append([(k + 1, n, sum(g * g for g in gap), z[k] / math.sqrt(e[k]), e[k] / e.sum()) for k in range(min(components, len(x)))])
    return out


def close(got, want):
    flipped = {}
    for r in got:
        k = r["component"]
        a = want[r["vec_id"]][0][k - 1]
        assert (r["n"], r["deviation"]) == (a[1], a[2]) and r["explained"] == pytest.approx(a[4], rel=1e-9) and r["identity_error"] < 1e-8
        if abs(a[3]) > 1e-3:
            flipped.setdefault(k, set()).add(bool(r["whitened"] * a[3] < 0))
        assert abs(r["whitened"]) == pytest.approx(abs(a[3]), abs=1e-7)
    assert all(len(x) == 1 for x in flipped.values())


def test_registered_query(spark):
    got = queries.queries()["op13_whitening"](spark, DATA).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert len(got) == 4 * len(rows)
    close(got, plain(rows))


@pytest.mark.parametrize("parts", [1, 3, 70])
def test_skewed_repeated_and_broken_vectors(spark, parts):
    rng = np.random.default_rng(parts)
    scale = np.geomspace(1, 1e-2, 7)
    rows = [(i, (rng.normal(size=7) * scale + 3).tolist(), 0) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(200)]
    rows += [(5000, None, 1), (5001, [], 1), (5002, [1.0] * 6 + [None], 1), (5003, [float("nan")] * 7, 1), (5004, [float("inf")] + [0.0] * 6, 1), (5005, [-float("inf")] * 7, None)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    for name in ("x", "n", "component", "whitened"):
        table = table.withColumn(name, table["label"])
    got = whitening.whiten(table).collect()
    assert len(got) == 4 * 500
    close(got, plain(rows))


def test_merged_summaries_equal_the_whole():
    rng = np.random.default_rng(1)
    x = rng.integers(-1000, 1000, (500, 12)) * np.arange(1, 13) + 10**6
    whole = whitening.summarise(x)
    parts = [whitening.summarise(x[a:b]) for a, b in ((0, 1), (1, 4), (4, 5), (5, 300), (300, 500))]
    left = parts[0]
    for p in parts[1:]:
        left = whitening.merge(left, p)
    pairs = whitening.merge(whitening.merge(parts[0], parts[1]), whitening.merge(parts[2], whitening.merge(parts[3], parts[4])))
    for made in (left, pairs):
        assert made.n == 500 and made.sums == whole.sums
        assert made.values == pytest.approx(whole.values, rel=1e-10)
        assert np.abs((made.vectors * made.values[:, None] ** 2).T @ made.vectors / ((whole.vectors * whole.values[:, None] ** 2).T @ whole.vectors) - 1).max() < 1e-6
    assert len(whole.values) == 12


def test_no_variance_other_widths_and_large_entries(spark):
    one = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], SCHEMA)).collect()
    assert sorted((r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one) == [(k, 1, 0, None, None, 0.0) for k in (1, 1, 2, 2)]
    # a line in three dimensions: one component varies
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], 1) for i in range(9)], SCHEMA)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) and r["explained"] == pytest.approx(float(r["component"] == 1)) and r["identity_error"] < 1e-9 for r in line)
    mixed = [(i, [float(i), float(i * i)], 1) for i in range(9)] + [(100 + i, [float(i), float(i * i % 7), float(i % 3)], 1) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(mixed, SCHEMA)).collect()
    close([r for r in got if r["vec_id"] < 100], plain(mixed[:9]))
    close([r for r in got if r["vec_id"] >= 100], plain(mixed[9:]))
    large = [(0, [2.0**40], 1), (1, [0.0], 1), (2, [-(2.0**40)], 1)]
    got = {r["vec_id"]: r for r in whitening.whiten(spark.createDataFrame(large, SCHEMA)).collect()}
    assert got[1]["deviation"] == 0 and got[0]["deviation"] is None and got[0]["whitened"] == pytest.approx(-got[2]["whitened"])
    exact = [(0, [2.0**22], 1), (1, [0.0], 1)]
    assert {r["deviation"] for r in whitening.whiten(spark.createDataFrame(exact, SCHEMA)).collect()} == {2**60}
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
