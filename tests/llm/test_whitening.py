"""Whitening against a dense eigensolver."""

import numpy as np
import pytest

from tabloom.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def check(rows, vectors, components=32):
    """Rows of the operator against exact sums and a dense solver."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in vectors], dtype=object)
    n, sums = len(x), x.sum(0)
    exact = {}
    for (vec_id, _), row in zip(vectors, x):
        exact.setdefault(vec_id, set()).add(int(((n * row - sums) ** 2).sum()))
    centred = ((n * x - sums) / n).astype(float)
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    k = min(components, len(cov))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    white = centred @ axes / np.sqrt(values)
    assert len(rows) == n * k
    assert {r.n for r in rows} == {n} and {r.identity_error < 1e-4 for r in rows} == {True}
    want = {}
    for (vec_id, _), w in zip(vectors, white):
        want[vec_id] = w
    signs = {}
    for r in rows:
        assert r.deviation in exact[r.vec_id]
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-9)
        target = want[r.vec_id][r.component - 1]
        if abs(target) > 1e-3:
            assert signs.setdefault(r.component, np.sign(target * r.whitened)) == np.sign(target * r.whitened)
        assert abs(r.whitened) == pytest.approx(abs(target), abs=1e-8)


def test_query_on_a_table(spark):
    vectors = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(queries.QUERIES["op13_embedding_whitening"](spark, SF).collect(), vectors)


def test_unusable_rows_clashing_names_and_repeats(spark):
    rng = np.random.default_rng(5)
    good = [(k, [float(x) for x in rng.normal(0, 1 + np.arange(6))]) for k in range(40)]
    good += [good[3], good[3], (None, good[7][1])]
    bad = [(100, None), (101, [1.0, None] + [0.0] * 4), (102, [float("nan")] + [0.0] * 5), (103, [float("inf")] * 6), (104, [])]
    rows = [(i, v, 5, "x") for i, v in good + bad]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, whitened string").repartition(3)
    check(whitening.whiten(table).collect(), good)
    assert len(whitening.whiten(table, components=2).collect()) == 2 * len(good)
    assert whitening.whiten(table.limit(0)).collect() == []
    assert whitening.whiten(table.filter("vec_id >= 100")).collect() == []


def test_components_without_variance(spark):
    rows = [(k, [float(k), 2.0 * k, 7.0]) for k in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in got if r.whitened is not None} == {1} and len(got) == 27
    assert {r.explained for r in got if r.component > 1} == {0.0} and got[0].identity_error < 1e-12
    one = whitening.whiten(spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>")).collect()
    assert [(r.whitened, r.explained, r.deviation) for r in one] == [(None, 0.0, 0)] * 3


def test_lengths_that_differ_and_huge_entries(spark):
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>").coalesce(1)).collect()
    got = whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert [r.deviation for r in sorted(got, key=lambda r: r.vec_id)] == [None, None, 0]


@pytest.mark.parametrize("name", ["flat", "decay", "ties", "low rank", "wide"])
def test_filter_finds_leading_vectors(name):
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    spectra = {
        "flat": np.linspace(60, 40, 120), "decay": 0.8 ** np.arange(120.0) * 1e6, "ties": np.repeat([5.0, 3.0, 1.0], 40),
        "low rank": np.r_[np.arange(20.0, 0, -1), np.zeros(100)], "wide": np.r_[1e9, np.linspace(2, 1, 119)],
    }
    matrix = turn @ np.diag(spectra[name]) @ turn.T
    values, vectors, passes = whitening.leading(lambda q: matrix @ q, 120, 10)
    assert np.allclose(values, spectra[name][:10], rtol=0, atol=1e-11 * spectra[name][0])
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() <= 1e-11 * spectra[name][0]
    assert np.allclose(vectors.T @ vectors, np.eye(10), atol=1e-12) and passes < 200
