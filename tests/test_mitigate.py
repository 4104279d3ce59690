import random

import numpy as np
import pytest
from helpers import frame, long_panel, values_of
from pyspark.sql import functions as F

from tidemark.config import strengths
from tidemark.operators import mitigate as M

KEYS = ["series_id", "col"]


def test_smoother_golden(spark):
    panel = long_panel(spark, {"a": [10, 12, 11, 13, 12]}, name="value")
    want = [10.94784959, 11.25116146, 11.43465916, 11.68770233, 11.73077787]
    assert values_of(M.mitigate_kalman(panel, KEYS), "value", "pos") == pytest.approx(want, abs=1e-8)


def test_smoother_minimises_the_penalised_squares(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(0, 1, 60).cumsum()
    found = values_of(M.mitigate_kalman(long_panel(spark, {"a": y}, name="value"), KEYS), "value", "pos")
    # Prior on the first level plus observations (variance .25) and level steps (variance .04).
    a = np.eye(60) / 0.25
    a[0, 0] += 1 / 0.25
    step = np.diff(np.eye(60), axis=0)
    a += step.T @ step / 0.04
    b = y / 0.25
    b[0] += y[0] / 0.25
    assert found == pytest.approx(list(np.linalg.solve(a, b)), abs=1e-9)


def test_smoother_keeps_rows_without_a_value(spark):
    panel = long_panel(spark, {"a": [10, None, 12, 11, 13, 12, None], "b": [None, None]}, name="value")
    found = frame(M.mitigate_kalman(panel, KEYS), "series_id", "pos")
    assert found["value"].isna().tolist() == [False, True, False, False, False, False, True, True, True]
    assert found["value"].dropna().tolist() == pytest.approx(
        [10.94784959, 11.25116146, 11.43465916, 11.68770233, 11.73077787], abs=1e-8)


def test_smoother_chunks_equal_whole(spark):
    rng = np.random.default_rng(5)
    series = {"a": rng.normal(0, 1, 900).cumsum() + 100, "b": rng.normal(0, 1, 130).cumsum() + 50}
    panel = long_panel(spark, series, name="value")
    whole = frame(M.mitigate_kalman(panel, KEYS), "series_id", "pos")
    parts = frame(M.mitigate_kalman(panel, KEYS, size=110), "series_id", "pos")
    assert len(parts) == 1030 and np.abs(whole["value"] - parts["value"]).max() < 1e-12


@pytest.mark.parametrize("size", [7, 64, 200])
def test_smoother_does_not_depend_on_chunks_beside_gaps(spark, size):
    rng = np.random.default_rng(6)
    y = list(rng.normal(0, 1, 600).cumsum() + 1000)
    y[180:305] = [None] * 125
    late = [None] * 230 + list(rng.normal(0, 1, 90)) + [None] * 300
    panel = long_panel(spark, {"a": y, "late": late, "none": [None] * 450}, name="value")
    whole = frame(M.mitigate_kalman(panel, KEYS, size=1000), "series_id", "pos")
    parts = frame(M.mitigate_kalman(panel, KEYS, size=size), "series_id", "pos")
    assert len(parts) == 1670 and (whole["value"].isna() == parts["value"].isna()).all()
    assert np.abs(whole["value"] - parts["value"]).max() < 1e-9


@pytest.mark.parametrize("values, want", [
    ([None, 4, 9, 16, 25, None], [1, 4, 9, 16, 25, 36]),
    ([1, 2, None, 5, 3, 4], [1, 2, 4.28571429, 5, 3, 4]),
    ([1, 2, None, 5, 3, 4, 7, None], [1, 2, 4.36448598, 5, 3, 4, 7, 8.79439252]),
])
def test_spline_goldens(spark, values, want):
    panel = long_panel(spark, {"a": values}, name="value")
    assert values_of(M.mitigate_spline(panel, KEYS), "value", "pos") == pytest.approx(want, abs=1e-8)


def test_spline_needs_four_values(spark):
    found = frame(M.mitigate_spline(long_panel(spark, {"a": [1, None, 3, None, 5]}, name="value"), KEYS), "pos")
    assert found["value"].isna().tolist() == [False, True, False, True, False]
    assert found["error"].notna().tolist() == [False, True, False, True, False]


def test_spline_reproduces_a_cubic_with_long_gaps(spark):
    t = np.arange(400) / 400
    y = 3 + 2 * t - 5 * t**2 + 4 * t**3
    rng = random.Random(2)
    holes = [None if (rng.random() < 0.4 or 120 <= i < 230 or i < 2 or i > 397) else v for i, v in enumerate(y)]
    for size in (4096, 50):
        found = values_of(M.mitigate_spline(long_panel(spark, {"a": holes}, name="value"), KEYS, size), "value", "pos")
        assert found == pytest.approx(list(y), abs=1e-8)


def test_spline_chunks_equal_whole(spark):
    rng = np.random.default_rng(8)
    walk = rng.normal(0, 1, 1000).cumsum() + 100
    holes = [None if rng.random() < 0.3 else v for v in walk]
    panel = long_panel(spark, {"a": holes, "b": holes[:333]}, name="value")
    whole = frame(M.mitigate_spline(panel, KEYS), "series_id", "pos")
    parts = frame(M.mitigate_spline(panel, KEYS, size=41), "series_id", "pos")
    assert len(parts) == 1333 and np.abs(whole["value"] - parts["value"]).max() < 1e-9


def test_partial_repair_takes_real_values_of_undamaged_columns(spark):
    repaired = spark.sql("""select 'a' series_id, 'close' col, 'highly' scale, 0 pos, 1.0D real, 10.0D value
                            union all select 'a', 'high', 'highly', 0, 2.0D, 20.0D""")
    assert values_of(M.mitigated_partial(repaired, strengths("noise", "partially")), "value", "col") == [10.0, 2.0]


def test_repair_time_is_positive(spark):
    panel = long_panel(spark, {"a": range(50), "b": range(60)}, name="value")
    for source in ("noise", "incompleteness"):
        found = M.mitigation_time(panel, source, KEYS).collect()
        assert len(found) == 2 and all(r["elapsed_ms"] > 0 for r in found)


def test_spline_does_not_depend_on_chunks_beside_long_gaps(spark):
    rng = np.random.default_rng(7)
    y = list(rng.normal(0, 1, 700).cumsum() + 100)
    y[150:420] = [None] * 270
    late = [None] * 260 + list(rng.normal(0, 1, 60)) + [None] * 200
    panel = long_panel(spark, {"a": y, "late": late, "none": [None] * 90, "three": [1, None, 2, None, 3]}, name="value")
    whole = frame(M.mitigate_spline(panel, KEYS, size=2000), "series_id", "pos")
    parts = frame(M.mitigate_spline(panel, KEYS, size=50), "series_id", "pos")
    assert (whole["error"].isna() == parts["error"].isna()).all() and parts["error"].notna().sum() == 90 + 2
    both = whole["value"].notna()
    assert (both == parts["value"].notna()).all()
    # Extrapolations over hundreds of rows grow with the third power, so they are held relatively.
    assert np.allclose(whole["value"][both], parts["value"][both], rtol=1e-7, atol=1e-7)


def test_rows_of_one_gap_are_spread_over_tasks(spark):
    """A gap of most rows: the tasks that fill it hold about equal numbers of them."""
    panel = spark.range(200_000).select(
        F.lit("a").alias("series_id"), F.lit("close").alias("col"), F.col("id").cast("int").alias("pos"),
        F.when((F.col("id") < 500) | (F.col("id") >= 199_500), F.sin(F.col("id") / 50.0)).alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        filled = M.mitigate_spline(panel, KEYS, size=1000)
        counts = [r["n"] for r in filled.groupBy(F.spark_partition_id().alias("part")).agg(F.count("value").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(counts) == 200_000 and len(counts) == 4 and max(counts) < 1.5 * np.median(counts)
