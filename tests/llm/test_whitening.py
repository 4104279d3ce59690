"""Whitening against a plain eigendecomposition of the whole covariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, whitening
from tidemark.llm.whitening import Spectrum

VECTORS = "vec_id long, embedding array<float>, component int, x string, n long"


def scatter(x):
    return (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))


def fed(x):
    s = Spectrum(x.shape[1])
    for row in x:
        s.add(row)
    return s


def close(s, x, tolerance=1e-11):
    want = scatter(x)
    scale = max(np.abs(want).max(), 1e-300)
    assert s.n == len(x) and np.allclose(s.mean, x.mean(axis=0), rtol=1e-13, atol=1e-12)
    assert np.abs(s.vectors.T @ s.vectors - np.eye(x.shape[1])).max() < tolerance
    assert np.abs(s.vectors * s.values @ s.vectors.T - want).max() / scale < tolerance
    assert (np.diff(s.values) >= 0).all() and np.abs(s.values - np.linalg.eigvalsh(want)).max() / scale < tolerance


RNG = np.random.default_rng(4)
CLOUDS = {
    "shifted": RNG.normal(size=(300, 20)) * 100 + 1e5,
    "repeated": np.repeat(RNG.normal(size=(4, 12)), 30, axis=0),
    "constant": np.full((20, 6), 3.0),
    "binary": RNG.integers(0, 2, (150, 9)).astype(float),
    "axes": np.concatenate([np.eye(8), -np.eye(8)] * 5),
    "scales": RNG.normal(size=(200, 8)) * 10.0 ** -np.arange(8),
    "single": RNG.normal(size=(1, 5)),
    "narrow": RNG.normal(size=(50, 1)),
}


@pytest.mark.parametrize("name", CLOUDS)
def test_rank_one_updates_match_the_whole_scatter(name):
    close(fed(CLOUDS[name]), CLOUDS[name])


@pytest.mark.parametrize("name", CLOUDS)
def test_spectra_are_combined_by_rank_one_updates(name):
    x = CLOUDS[name]
    whole = Spectrum(x.shape[1])
    for at in range(0, len(x), 37):
        whole.merge(fed(x[at:at + 37]))
    whole.merge(Spectrum(x.shape[1]))
    close(whole, x)


def test_secular_roots_interlace_and_solve():
    d = np.sort(RNG.normal(size=30))
    d[10] = d[9] + 1e-13
    weights = RNG.random(30) ** 6 + 1e-14
    roots, differences = whitening.secular_roots(d, weights)
    assert (roots >= d).all() and (roots[:-1] <= d[1:]).all()
    assert np.allclose(np.sort(roots), np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(weights), np.sqrt(weights))), atol=1e-13)
    assert np.allclose(np.diagonal(differences), roots - d, atol=1e-15)


def brute(vectors, components=8):
    """Rows of the contract from one covariance of integers."""
    kept = [(i, [int(np.floor(float(c) * 1024)) + 100_000 for c in v]) for i, v in vectors
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, x = len(kept), np.array([v for _, v in kept], object)
    away = n * x - x.sum(axis=0)
    y = (away / n).astype(float)
    e, u = np.linalg.eigh(y.T @ y / n)
    top = np.argsort(e)[::-1][:components]
    return n, [i for i, _ in kept], [int((a * a).sum()) for a in away], y @ u[:, top], e[top], e[top] / e.sum()


def compare(got, vectors, tolerance=1e-9):
    n, ids, deviations, projected, e, explained = brute(vectors)
    k = len(e)
    rows = got.toPandas()
    assert len(rows) == len(ids) * k and (rows["n"] == n).all() and rows["identity_error"].nunique() == 1
    assert rows["identity_error"].iloc[0] < 1e-9
    found = rows.sort_values(["vec_id", "component"])
    order = np.argsort(ids, kind="stable")
    assert found["deviation"].tolist() == [deviations[i] for i in order for _ in range(k)]
    assert found["vec_id"].tolist() == [ids[i] for i in order for _ in range(k)]
    assert np.allclose(found["explained"].to_numpy().reshape(-1, k), explained, rtol=tolerance)
    white = found["whitened"].to_numpy().reshape(-1, k)
    signs = np.sign((white * (projected / np.sqrt(e))[order]).sum(axis=0))
    assert np.abs(white * signs - (projected / np.sqrt(e))[order]).max() < 1e-7


def test_whitening_matches_one_covariance(spark):
    cloud = RNG.normal(size=(400, 12)) * np.linspace(0.05, 0.3, 12)
    vectors = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(cloud)]
    vectors += [(1000, None), (1001, [None] + [0.1] * 11), (1002, [float("nan")] * 12), (1003, [float("inf")] + [0.0] * 11), *vectors[:40]]
    vectors = [(i if j < 400 else i + 5000, v) for j, (i, v) in enumerate(vectors)]
    df = spark.createDataFrame([(i, v, 7, "q", None) for i, v in vectors], VECTORS).repartition(23)
    points = whitening.fixed_point(df)
    compare(whitening.whiten(points, whitening.fit(points)), vectors)


def test_query_matches_one_covariance_of_the_given_table(spark, sf):
    given = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    compare(queries.op11_whitening(spark, sf), [(r.vec_id, r.embedding) for r in given])


def test_edges_have_defined_results(spark):
    def result(rows):
        points = whitening.fixed_point(spark.createDataFrame([(i, v, 1, "x", 1) for i, v in rows], VECTORS))
        return [tuple(r) for r in whitening.whiten(points, whitening.fit(points)).orderBy("vec_id", "component").collect()]

    assert result([]) == [] and result([(1, None), (2, [])]) == []
    assert result([(5, [0.5, 0.25])]) == [(5, k, 1, 0, None, 0.0, None, 0) for k in (1, 2)]
    # One direction only: its variance is whitened, the other is not. A missing id and shared ids stay rows of their own.
    line = result([(None, [0.0, 0.0]), (3, [1.0, 1.0]), (3, [2.0, 2.0]), (4, [3.0, 3.0])])
    assert [r[:4] for r in line if r[1] == 1] == [(None, 1, 4, 75497472), (3, 1, 4, 8388608), (3, 1, 4, 8388608), (4, 1, 4, 75497472)]
    assert all(r[4] is None and r[5] == 0.0 for r in line if r[1] == 2) and all(r[6] < 1e-9 for r in line)
    assert np.allclose(sorted(abs(r[4]) for r in line if r[1] == 1), sorted(np.abs([-1.5, -0.5, 0.5, 1.5]) / np.sqrt(1.25)))
    # Each length is a fit by itself.
    mixed = result([(1, [0.0]), (2, [1.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, [1.0, 1.0])])
    assert [(r[0], r[1], r[2]) for r in mixed] == [(1, 1, 2), (2, 1, 2), *[(i, k, 3) for i in (3, 4, 5) for k in (1, 2)]]


def test_huge_entries_stay_exact(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [2.0**40, 0.5])]
    points = whitening.fixed_point(spark.createDataFrame([(i, v, 1, "x", 1) for i, v in rows], VECTORS))
    got = whitening.whiten(points, whitening.fit(points)).where("component = 1").orderBy("vec_id").collect()
    x = np.array([[2**60 + 100_000, 100_000], [-2**60 + 100_000, 101_024], [2**50 + 100_000, 100_512]], object)
    want = [int((a * a).sum()) for a in 3 * x - x.sum(axis=0)]
    assert [int(r.deviation_exact) for r in got] == want and got[0].deviation is None


def test_order_of_rows_and_parts_changes_only_rounding(spark, sf):
    points = whitening.fixed_point(spark.read.parquet(f"{sf}/embeddings.parquet"))
    a, b = whitening.fit(points.repartition(3)), whitening.fit(points.repartition(17).sortWithinPartitions(F.desc("vec_id")))
    assert a.keys() == b.keys()
    for size in a:
        assert a[size].sums == b[size].sums and np.allclose(a[size].variances, b[size].variances, rtol=1e-11)
