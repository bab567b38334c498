"""Exact scatters against Python's whole numbers, and whitened rows against numpy on the same fit list."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from odlake.llm import queries as registered
from odlake.llm import whitening

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("high, n", [(300, 1000), (1, 65), (2**40, 130), (2**63 - 1, 70), (0, 10)])
def test_products_are_exact(high, n):
    rng = random.Random(high)
    x = np.array([[rng.randint(-high - (high > 2**62), high), rng.randint(0, high), 7, rng.randint(-high, 0)] for _ in range(n)], np.int64)
    rows = x.tolist()
    sums, cross = whitening.products(x)
    assert sums.tolist() == [sum(r[d] for r in rows) for d in range(4)]
    assert cross.tolist() == [[sum(r[a] * r[b] for r in rows) for b in range(4)] for a in range(4)]
    for v in [*cross.ravel().tolist(), -1, 0, -(2**32), 2**32, 2**95, -(2**120) + 5]:
        assert sum(p << (32 * k) for _, _, k, p in whitening.limbs(np.array([0]), np.array([0]), [v])) == v


def test_packed_rows_come_back():
    x = np.array([[1, -128], [127, 128], [-(2**31), 5], [2**31, 0], [-(2**63), 2**63 - 1], [0, 0]], np.int64)
    made = whitening.packed(x)
    assert [len(m) for m in made] == [2, 4, 8, 16, 16, 2]
    assert (whitening.unpacked(made, 2) == x).all()


def check(got, vectors, components=4):
    """vectors: (id, list of finite numbers), all of one length."""
    x = {i: tuple(min(max(math.floor(256 * float(c)), -(2**63)), 2**63 - 1) for c in v) for i, v in vectors}
    fit = np.array(sorted(set(x.values())), float)
    n, d = fit.shape
    v = np.cov(fit.T, bias=True).reshape(d, d)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    sums = [sum(r[k] for r in set(x.values())) for k in range(d)]
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((i, k + 1) for i, _ in vectors for k in range(min(components, d)))
    for r in got:
        own, k = x[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(own, sums))
        assert r["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
        assert abs(r["whitened"]) == pytest.approx(abs((np.array(own, float) - fit.mean(axis=0)) @ axes[:, k] / math.sqrt(e[k])), abs=1e-7)


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in vectors], "vec_id long, embedding array<double>, n int, id string, vector double")


def test_whitened_rows(spark):
    rng = np.random.default_rng(3)
    made = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    vectors = [(k, row.tolist()) for k, row in enumerate(made)] + [(1000 + k, made[5].tolist()) for k in range(400)]
    bad = [(1, None), (2, [None] * 6), (3, [float("nan")] * 6), (4, [float("inf")] * 6), (5, [1.0] * 5), (6, [])]
    check(whitening.whiten(rows_of(spark, vectors + bad).repartition(5)).collect(), vectors)


def test_signs_are_one_for_all_rows(spark):
    rng = np.random.default_rng(4)
    vectors = [(k, row.tolist()) for k, row in enumerate(rng.normal(size=(200, 3)) * [3, 2, 1])]
    w = {}
    for r in whitening.whiten(rows_of(spark, vectors).repartition(4)).collect():
        w.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    m = np.array([[w[k][c] for c in (1, 2, 3)] for k in range(200)])
    assert np.allclose(m.T @ m / 200, np.eye(3), atol=1e-9)


def test_cases_without_spread(spark):
    assert whitening.whiten(rows_of(spark, [])).collect() == []
    assert whitening.whiten(rows_of(spark, [(1, None), (2, [])])).collect() == []
    rows = whitening.whiten(rows_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(rows) == 4 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, None, None) for r in rows)
    rows = whitening.whiten(rows_of(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert sorted((r["component"], r["whitened"] is None) for r in rows) == [(1, False), (1, False), (2, True), (2, True)]


def test_entries_beyond_a_long_are_held(spark):
    vectors = [(1, [1e300, -1e300]), (2, [0.5, -0.001953125 * 3]), (3, [-0.0, 5e-324]), (4, [2.0**54, 1.0])]
    rows = whitening.whiten(rows_of(spark, vectors)).collect()
    top, x = 2**63 - 1, [(2**63 - 1, -(2**63)), (128, -2), (0, 0), (2**62, 256)]
    assert whitening.whole(rows_of(spark, vectors).toArrow()["embedding"].combine_chunks(), 2).tolist() == [list(r) for r in x] and top > 0
    sums = [sum(r[k] for r in x) for k in range(2)]
    exact = {k + 1: sum((4 * a - s) ** 2 for a, s in zip(r, sums)) for k, r in enumerate(x)}
    assert all(r["deviation"] == (exact[r["vec_id"]] if exact[r["vec_id"]] < 10**38 else None) for r in rows)


def test_the_query_on_the_given_table(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = registered.op13_whitening(spark, SF)
    assert dict(rows.dtypes)["deviation"] == "bigint"
    check(rows.collect(), [(r["vec_id"], list(r["embedding"])) for r in given])
