"""Lagged values, returns, rolling and calendar features, auto- and partial autocorrelation.

Windows run over (series, chunk) with a halo as long as the look-back, never over a whole series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import CHUNK_ROWS
from tidemark.functions.types import DOUBLES
from tidemark.operators.panel import attach, chunk_of, with_halo

# Lags and rolling width of the tree features.
TREE_LAGS = [1, 7, 14]
ROLLING_WIDTH = 7


def with_lags(panel: DataFrame, keys: list[str], lags: list[int], value: str = "real", name: str = "lag",
              size: int = CHUNK_ROWS, extra=None) -> DataFrame:
    """Add ``<name>_<k>`` for every lag; ``extra`` maps further columns to functions of (window ordered by pos)."""
    halo = with_halo(panel, max(lags), 0, size)
    w = Window.partitionBy(*keys, "chunk").orderBy("pos")
    added = {f"{name}_{k}": F.lag(value, k).over(w) for k in lags}
    added.update({n: make(w) for n, make in (extra or {}).items()})
    return halo.withColumns(added).filter("core").drop("core")


def log_returns(panel: DataFrame, keys: list[str], value: str = "real") -> DataFrame:
    """``ln(y / previous y)``; null on the first row and where the ratio is not positive."""
    lagged = with_lags(panel, keys, [1], value)
    ratio = F.try_divide(value, "lag_1")
    return lagged.withColumn("log_return", F.when(ratio > 0, F.log(ratio))).drop("lag_1", "chunk")


def pct_change(panel: DataFrame, keys: list[str], value: str = "real") -> DataFrame:
    """``y / previous y - 1``, rows without a previous value left out."""
    lagged = with_lags(panel, keys, [1], value)
    change = F.try_divide(value, "lag_1") - F.lit(1.0)
    return lagged.withColumn("pct_change", change).drop("lag_1", "chunk").filter(F.col("pct_change").isNotNull())


def lag_features(panel: DataFrame, keys: list[str], value: str = "real", dt: str = "dt") -> DataFrame:
    """Lags 1, 7, 14, rolling mean/max/min of the seven values before a row, weekday (Monday = 0) and month."""

    def rolling(fn):
        def make(w):
            span = w.rowsBetween(-ROLLING_WIDTH, -1)
            return F.when(F.count(value).over(span) == ROLLING_WIDTH, fn(value).over(span))
        return make

    extra = {"rolling_mean": rolling(F.avg), "rolling_max": rolling(F.max), "rolling_min": rolling(F.min)}
    return (
        with_lags(panel, keys, TREE_LAGS, value, extra=extra)
        .drop("chunk")
        .withColumn("weekday", F.weekday(dt))
        .withColumn("month", F.month(dt))
    )


def acf(panel: DataFrame, keys: list[str], value: str, nlags: int, size: int = CHUNK_ROWS) -> DataFrame:
    """Autocorrelation at lags 0 .. ``nlags`` per series: ``keys, lag, acf``; null for a constant series.

    ``panel`` carries ``pos``; rows with a null value have to be numbered out beforehand.
    """
    stats = panel.groupBy(*keys).agg(F.avg(value).alias("_mean"), (F.max("pos") + 1).alias("rows"))
    chunked = panel.select(*keys, "pos", value).withColumn("chunk", chunk_of("pos", size))
    centred = attach(chunked, stats, keys, size).select(*keys, "pos", (F.col(value) - F.col("_mean")).alias("_c"))
    lagged = with_lags(centred, keys, list(range(1, nlags + 1)), "_c", size=size)
    sums = [F.sum(F.col("_c") * F.col("_c")).alias("s0")]
    sums += [F.sum(F.col("_c") * F.col(f"lag_{k}")).alias(f"s{k}") for k in range(1, nlags + 1)]
    total = lagged.groupBy(*keys).agg(*sums)
    pairs = F.array(*[
        F.struct(F.lit(k).alias("lag"), F.coalesce(F.col(f"s{k}"), F.lit(0.0)).alias("_s")) for k in range(nlags + 1)
    ])
    ratio = F.try_divide("_s", F.nullif("s0", F.lit(0.0)))
    return total.select(*keys, "s0", F.inline(pairs)).select(*keys, "lag", ratio.alias("acf"))


def partial_from_acf(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations at lags 1 .. K of each row of autocorrelations at lags 0 .. K (Durbin-Levinson)."""
    rows, n = r.shape
    out = np.full((rows, n - 1), np.nan)
    phi = np.zeros((rows, n - 1))
    left = np.ones(rows)
    for k in range(1, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            new = (r[:, k] - (phi[:, : k - 1] * r[:, k - 1 : 0 : -1]).sum(axis=1)) / left
        phi[:, : k - 1] = phi[:, : k - 1] - new[:, None] * phi[:, : k - 1][:, ::-1]
        phi[:, k - 1] = new
        left = left * (1.0 - new * new)
        out[:, k - 1] = new
    return out


@F.pandas_udf(DOUBLES)
def _partials(r: pd.Series) -> pd.Series:
    found = partial_from_acf(np.array([np.asarray(a, dtype=float) for a in r]))
    return pd.Series([[v if np.isfinite(v) else None for v in row] for row in found])


def pacf(panel: DataFrame, keys: list[str], value: str, nlags: int) -> DataFrame:
    """Partial autocorrelation at lags 1 .. ``nlags`` per series: ``keys, lag, pacf``."""
    lists = acf(panel, keys, value, nlags).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda s: s["acf"]).alias("r")
    )
    solved = lists.select(*keys, F.posexplode(_partials("r")).alias("_k", "pacf"))
    return solved.select(*keys, (F.col("_k") + 1).alias("lag"), "pacf")
