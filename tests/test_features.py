import math

import numpy as np
import pytest
from helpers import frame, long_panel, values_of
from pyspark.sql import functions as F

from tidemark.operators import features as X

KEYS = ["series_id", "col"]


def test_acf_and_pacf_goldens(spark):
    panel = long_panel(spark, {"a": [1, 3, 2, 5, 4, 6]})
    assert values_of(X.acf(panel, KEYS, "real", 3), "acf", "lag") == pytest.approx([1, 0.1, 0.34285714, -0.44285714], abs=1e-8)
    assert values_of(X.pacf(panel, KEYS, "real", 3), "pacf", "lag") == pytest.approx([0.1, 0.33621934, -0.56855104], abs=1e-8)


def test_acf_of_a_constant_is_null(spark):
    assert values_of(X.acf(long_panel(spark, {"a": [2, 2, 2, 2]}), KEYS, "real", 2), "acf", "lag") == [None] * 3


def test_acf_chunks_equal_whole(spark):
    y = np.random.default_rng(1).normal(size=400).cumsum()
    panel = long_panel(spark, {"a": y})
    whole = values_of(X.acf(panel, KEYS, "real", 6), "acf", "lag")
    assert values_of(X.acf(panel, KEYS, "real", 6, size=37), "acf", "lag") == pytest.approx(whole, abs=1e-12)
    c = y - y.mean()
    assert whole == pytest.approx([(c[k:] * c[: len(c) - k]).sum() / (c * c).sum() for k in range(7)], abs=1e-12)


def test_lags_across_chunks(spark):
    found = frame(X.with_lags(long_panel(spark, {"a": range(100)}), KEYS, [1, 7, 14], size=15), "pos")
    assert len(found) == 100
    for k in (1, 7, 14):
        assert found[f"lag_{k}"].isna().sum() == k
        assert (found[f"lag_{k}"].dropna() == found["pos"][k:] - k).all()


def test_features(spark):
    panel = long_panel(spark, {"a": range(20)}).withColumn("dt", F.date_add(F.lit("2024-01-01").cast("date"), F.col("pos")))
    found = frame(X.lag_features(panel, KEYS), "pos")
    assert found["weekday"].iloc[0] == 0 and found["weekday"].iloc[6] == 6 and found["month"].iloc[0] == 1
    assert found["rolling_mean"].isna().sum() == 7
    assert found["rolling_mean"].iloc[7] == 3.0 and found["rolling_max"].iloc[7] == 6.0 and found["rolling_min"].iloc[10] == 3.0


def test_returns_guard_zero(spark):
    panel = long_panel(spark, {"a": [2, 4, 0, 3, 6]})
    logs = values_of(X.log_returns(panel, KEYS), "log_return", "pos")
    assert logs == [None, pytest.approx(math.log(2)), None, None, pytest.approx(math.log(2))]
    assert values_of(X.pct_change(panel, KEYS), "pct_change", "pos") == pytest.approx([1.0, -1.0, 1.0])
