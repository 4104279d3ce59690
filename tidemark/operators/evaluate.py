"""Alignment of forecasts with real values, forecast errors, timing, repeated runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import WEIGHTS
from tidemark.functions import scoring


def forecast_align(rows: DataFrame, n_valid: int, delay="delay") -> DataFrame:
    """Drop the steps that bridge the delay of a stale copy, keep ``n_valid`` and number them from 1."""
    d = F.col(delay) if isinstance(delay, str) else delay
    kept = rows.filter((F.col("step") > d) & (F.col("step") <= d + n_valid))
    return kept.withColumn("step", (F.col("step") - d).cast("int"))


def errors(aligned: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """RMSE, MAE and MAPE per group with at least one forecast; ``actual`` holds ``series_id, col, step, real``.

    ``n`` and ``n_expected`` tell whether every real value met a forecast. Real zeros are left out of the MAPE and
    ``mape_n`` counts what remains.
    """
    real = actual.select("series_id", "col", "step", "real")
    joined = aligned.join(real, ["series_id", "col", "step"])
    expected = real.groupBy("series_id", "col").agg(F.count(F.lit(1)).alias("n_expected"))
    gap = F.col("yhat") - F.col("real")
    share = F.try_divide(F.abs(gap), F.nullif(F.abs("real"), F.lit(0.0)))
    found = joined.groupBy(*keys).agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(F.abs(gap)).alias("mae"),
        (F.lit(100.0) * F.avg(share)).alias("mape"),
        F.count(F.lit(1)).alias("n"),
        F.count(share).alias("mape_n"),
    )
    return found.join(expected, ["series_id", "col"])


def weighted_errors(per_column: DataFrame, keys: list[str], columns, weights: dict = WEIGHTS) -> DataFrame:
    """Errors of the columns of a series added up by their normalised weights; null when a column is missing or has no error."""
    weight = scoring.by_key(F.col("col"), scoring.normalized(weights, columns))
    by = [k for k in keys if k != "col"]
    chosen = per_column.filter(F.col("col").isin(list(columns)))
    return chosen.groupBy(*by).agg(
        *[F.when(F.count(e) == len(columns), F.sum(weight * F.col(e))).alias(e) for e in ("rmse", "mae", "mape")]
    )


def fit_times(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Preparation, model and prediction time of a scenario in ms: sums over its columns."""
    by = [k for k in keys if k not in ("col", "delay")]
    return fits.groupBy(*by).agg(
        *[F.sum(t).alias(t) for t in ("prepare_ms", "fit_ms", "predict_ms")],
        F.count("error").alias("failed"),
        F.min(F.when(F.col("p").isNotNull(), F.struct("p", "q"))).alias("_order"),
    ).select("*", "_order.p", "_order.q").drop("_order")


def repeat_rows(train: DataFrame, iterations: int) -> DataFrame:
    """Training rows once per run: iteration 0 warms up and is left out of all statistics later."""
    return train.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations))))


def repeat_stats(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Means over the runs of a scenario and the sample deviation of their total time (null for one run).

    ``runs`` has one row per (keys, iteration) with the three times and errors. Failed runs do not count; a
    scenario without a good run is kept with ``iterations = 0``.
    """
    good = (F.col("failed") == 0) & (F.col("iteration") > 0)
    total = F.col("prepare_ms") + F.col("fit_ms") + F.col("predict_ms")
    means = ["prepare_ms", "fit_ms", "predict_ms", "mitigation_ms", "rmse", "mae", "mape"]
    return runs.groupBy(*keys).agg(
        F.sum(good.cast("int")).alias("iterations"),
        *[F.avg(F.when(good, F.col(m))).alias(m) for m in means],
        F.stddev_samp(F.when(good, total)).alias("time_sd"),
        F.min(F.when(F.col("p").isNotNull(), F.struct("p", "q"))).alias("_order"),
    ).select("*", "_order.p", "_order.q").drop("_order")


def avg_predictions(rows: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Mean forecast over iterations per step next to the real value."""
    mean = rows.groupBy(*keys, "step").agg(F.avg("yhat").alias("yhat"))
    real = actual.select("series_id", "col", "step", "real")
    return mean.join(real, ["series_id", "col", "step"], "left")


def forecast_overlay(panel: DataFrame, train: DataFrame, rows: DataFrame, keys: list[str], graph_start: int) -> DataFrame:
    """Actual values, training values and forecasts on one position axis that starts at ``graph_start``, columns in order of their names.

    Forecast step 1 sits at the position after the border, where validation begins. ``train_end`` is the earliest
    end of training over the columns of a series.
    """
    actual = panel.filter(F.col("pos") >= graph_start).select(
        *keys, "pos", F.col("real").alias("value"), F.lit("actual").alias("role"))
    learned = train.filter(F.col("pos") >= graph_start).select(
        *keys, "pos", "value", F.lit("training").alias("role"))
    guessed = rows.select(*keys, F.col("pos"), F.col("yhat").alias("value"), F.lit("forecast").alias("role"))
    drawn = actual.unionByName(learned).unionByName(guessed)
    by = [k for k in keys if k != "col"]
    ends = train.groupBy(*keys).agg(F.max("pos").alias("_end")).groupBy(*by).agg(F.min("_end").alias("train_end"))
    placed = drawn.join(ends, by, "left").withColumn("x", F.col("pos") - graph_start).drop("pos")
    return placed.orderBy(*by, "col", "role", "x")
