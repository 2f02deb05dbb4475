import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.llm import whitening
from veritab.llm.queries import op12_embedding_whitening

DATA = "/root/testdata/sf0.001"


def expected(vectors, weights, components=4):
    """Values by vector, shares and deviations, by numpy and exact integers."""
    x = np.array(vectors, float)
    w = np.array(weights, float)
    n = int(sum(weights))
    y = x - (x * w[:, None]).sum(0) / n
    cov = (y * w[:, None]).T @ y / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    sums = [sum(int(w) * a[k] for a, w in zip(vectors, weights)) for k in range(len(vectors[0]))]
    off = [sum((n * c - s) ** 2 for c, s in zip(a, sums)) for a in vectors]
    return y @ v / np.sqrt(e), e / np.trace(cov), off


def integers(vector):
    return tuple(math.floor(Fraction(c) * 256) for c in vector)


def test_query_against_numpy(spark):
    rows = op12_embedding_whitening(spark, DATA).collect()
    given = {r["vec_id"]: integers(r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    fit = sorted(set(given.values()))
    values, shares, off = expected(fit, [1] * len(fit))
    place = {x: k for k, x in enumerate(fit)}
    assert len(rows) == 4 * len(given)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    for c in range(1, 5):
        column = np.array([got[i, c]["whitened"] for i in given])
        want = np.array([values[place[x], c - 1] for x in given.values()])
        assert min(np.abs(column - want).max(), np.abs(column + want).max()) < 1e-8
        assert all(abs(got[i, c]["explained"] / shares[c - 1] - 1) < 1e-9 for i in given)
    assert all(r["n"] == len(fit) and r["deviation"] == off[place[given[r["vec_id"]]]] for r in rows)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


@pytest.fixture(scope="module")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.1, 0.2, -0.3], 1),
        (2, [0.1, 0.2, -0.3], 1),
        (2, [0.1, 0.2, -0.3], 1),
        (3, [-0.0, 0.5, 0.25], 1),
        (None, [0.7, -0.2, 0.9], None),
        (4, [0.001, -0.4, 0.0], 1),
        (5, [0.3, 0.3, -0.9], 1),
        (6, None, 1),
        (7, [], 1),
        (8, [nan, 0.1, 0.1], 1),
        (9, [inf, 0.1, 0.1], 1),
        (10, [-inf, 0.1, 0.1], 1),
        (11, [None, 0.1, 0.1], 1),
        (12, [0.5, 0.5], 1),
    ]
    return spark.createDataFrame(rows, "vec_id int, embedding array<double>, n int")


@pytest.mark.parametrize("weights", ["one", "counts"])
@pytest.mark.parametrize("heavy", [1, 3, 1000])
def test_odd_rows(odd_vectors, weights, heavy):
    rows = whitening.whiten(odd_vectors, weights=weights, heavy=heavy).collect()
    assert sorted(r["vec_id"] or 0 for r in rows) == [0, 1, 2, 2, 3, 4, 5]
    assert all(r["n"] == (None if r["vec_id"] is None else 1) for r in rows)  # the given column
    given = [integers(r["embedding"]) for r in rows]
    fit = sorted(set(given))
    values, shares, off = expected(fit, [1 if weights == "one" else given.count(x) for x in fit])
    for r, x in zip(rows, given):
        assert r["n_"] == (5 if weights == "one" else 7)
        assert np.allclose(np.abs(r["whitened"]), np.abs(values[fit.index(x)]), atol=1e-9)
        assert r["deviation"] == off[fit.index(x)] and np.allclose(r["explained"], shares)
        assert r["identity_error"] < 1e-9


def test_without_variance(spark):
    flat = spark.createDataFrame([(k, [float(k), 1.0, -1.0, 2.0, 3.0]) for k in range(6)], "vec_id int, embedding array<float>")
    for r in whitening.whiten(flat).collect():
        assert r["whitened"][0] is not None and r["whitened"][1:] == [None] * 3
        assert r["explained"][0] == pytest.approx(1) and r["identity_error"] < 1e-9
    one = whitening.whiten(flat.where("vec_id = 2")).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [
        (1, 0, [None] * 4, [None] * 4, None)
    ]


def test_large_entries_are_exact(spark):
    rows = [(1, [1e15, 1.0]), (2, [1e15 + 64, -3.0]), (3, [-1e15, 2.0]), (4, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    some = whitening.whiten(df.where("vec_id < 3")).collect()
    assert {r["vec_id"]: r["deviation"] for r in some} == dict.fromkeys((1, 2), (256 * 64) ** 2 + (256 * 4) ** 2)
    assert all(r["identity_error"] < 1e-6 for r in some)
    assert [r["deviation"] for r in whitening.whiten(df).collect()] == [None] * 4


def test_empty(odd_vectors):
    for none in (odd_vectors.where("vec_id = -1"), odd_vectors.where("vec_id = 6")):
        out = whitening.whiten(none)
        assert out.collect() == [] and {"whitened", "n_", "deviation"} <= set(out.columns)
    with pytest.raises(ValueError):
        whitening.fit_list(odd_vectors, weights="none")


def test_fit_list_counts(odd_vectors):
    counted = {tuple(r["x"]): r["copies"] for r in whitening.fit_list(odd_vectors).select("x", "copies").collect()}
    assert counted[integers([0.1, 0.2, -0.3])] == 3 and counted[(0, 128, 64)] == 1 and len(counted) == 6
