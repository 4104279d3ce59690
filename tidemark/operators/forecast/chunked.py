"""What the forecast methods over chunks share: statistics of series, parameters on their way to chunks, the common result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import Monoid, fold


def series_stats(chunks: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """``keys, rows, last_chunk, last_train_pos`` and ``more`` aggregates of every series."""
    return chunks.groupBy(*keys).agg(F.sum(F.size("x")).alias("rows"), F.max("chunk").alias("last_chunk"),
                                     F.max("last_pos").alias("last_train_pos"), *more)


def _first(width: int) -> Monoid:
    def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = np.concatenate([a, b], axis=1)
        order = np.argsort(np.isnan(both), axis=1, kind="stable")
        return np.take_along_axis(both, order, axis=1)[:, :width]

    return Monoid(np.full(width, np.nan), compose)


def first_values(chunks: DataFrame, keys: list[str], n: int, longest: int) -> DataFrame:
    """``keys, first_values``: the first ``n`` values of every series, over as many chunks as they lie in."""
    missing = F.array_repeat(F.lit(float("nan")), n)
    element = F.slice(F.concat(F.slice("x", 1, n), missing), 1, n)
    found = fold(chunks.select(*keys, "chunk", element.alias("element")), keys, _first(n), longest)
    return found.select(*keys, F.filter("element", lambda v: ~F.isnan(v)).alias("first_values"))


def to_chunks(chunks: DataFrame, per_series: DataFrame, keys: list[str]) -> DataFrame:
    """``chunks`` with the columns of ``per_series`` (``keys, last_chunk, ...``).

    A row per series and chunk is made of the small side, so that a series of many chunks is joined in many tasks.
    """
    rows = per_series.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), "last_chunk"))).drop("last_chunk")
    return chunks.join(rows, [*keys, "chunk"])


def failures(yhat: Column, reasons: list[tuple[Column, str]]) -> Column:
    """The first reason that holds, or that the forecast is not finite."""
    out = F.when(F.lit(False), "")
    for holds, text in reasons:
        out = out.when(holds, text)
    bad = yhat.isNull() | F.exists(yhat, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return out.when(bad, "forecast is not finite")


def fit_columns(fitted: DataFrame, keys: list[str], error: Column, yhat: Column, p: int | None, q: int | None, fit_ms: Column) -> DataFrame:
    """The common result of a forecast method.

    ``fit_ms`` adds up what the chunks of a series took in all passes; nothing is prepared, and forecasting is an expression of Spark's.
    """
    told = fitted.withColumn("error", error)
    return told.select(*keys, F.when(F.col("error").isNull(), yhat).alias("yhat"), F.lit(p).cast("int").alias("p"), F.lit(q).cast("int").alias("q"),
                       F.lit(0.0).alias("prepare_ms"), F.coalesce(fit_ms, F.lit(0.0)).alias("fit_ms"), F.lit(0.0).alias("predict_ms"),
                       "error", "last_train_pos")
