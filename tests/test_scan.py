import numpy as np
import pytest

from tidemark.operators import scan as S


def affine():
    """Affine maps of a number, the first one first: composition that does not commute."""
    def matrices(a, b):
        return np.stack([b[:, 0] * a[:, 0], b[:, 0] * a[:, 1] + b[:, 1]], axis=1)

    return S.Monoid(np.array([1.0, 0.0]), matrices)


AFFINE = affine()


@pytest.fixture(scope="module")
def elements(spark):
    rng = np.random.default_rng(2)
    rows = [(s, c, rng.normal(size=2).tolist()) for s, n in (("a", 40), ("b", 1), ("c", 17)) for c in range(n) if c % 5 != 3]
    return spark.createDataFrame(rows, "series_id string, chunk long, element array<double>").repartition(4).cache(), rows


def plain(rows, series, keep):
    out = AFFINE.identity[None]
    for s, c, e in sorted(rows):
        if s == series and keep(c):
            out = AFFINE.compose(out, np.array([e]))
    return out[0]


@pytest.mark.parametrize("fan", [3, 8, 4096])
def test_scan_matches_a_plain_loop(elements, fan):
    df, rows = elements
    found = S.scan(df, ["series_id"], AFFINE, after=True, fan=fan).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["before"] == pytest.approx(plain(rows, r["series_id"], lambda c: c < r["chunk"]), rel=1e-9, abs=1e-12)
        assert r["after"] == pytest.approx(plain(rows, r["series_id"], lambda c: c > r["chunk"]), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("fan", [2, 6, 100])
def test_fold_matches_a_plain_loop(elements, fan):
    df, rows = elements
    found = {r["series_id"]: r["element"] for r in S.fold(df, ["series_id"], AFFINE, 40, fan).collect()}
    assert found.keys() == {"a", "b", "c"}
    for s, e in found.items():
        assert e == pytest.approx(plain(rows, s, lambda c: True), rel=1e-9, abs=1e-12)


def test_last_values_are_carried_over_empty_chunks(spark):
    nan = float("nan")
    rows = [(0, [nan, 1.0]), (1, [nan, nan]), (2, [2.0, 3.0]), (7, [nan, 4.0]), (8, [nan, nan])]
    df = spark.createDataFrame([("a", c, e) for c, e in rows], "series_id string, chunk long, element array<double>")
    found = S.scan(df, ["series_id"], S.carry_last(2), fan=2).orderBy("chunk").collect()
    got = np.array([r["before"] for r in found])
    assert np.array_equal(got, [[nan, nan], [nan, 1], [nan, 1], [2, 3], [3, 4]], equal_nan=True)


def test_slices_are_bounded_and_complete():
    lengths = np.array([5, 0, 3, 100, 2, 2])
    found = list(S.slices(lengths, width=2, cells=20))
    assert sorted(np.concatenate(found).tolist()) == list(range(6))
    assert all(len(f) == 1 or len(f) * lengths[f].max() * 2 <= 20 for f in found)
