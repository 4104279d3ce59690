"""Boosted trees on lag features: one model over all series of a scenario, recursive multi-step forecasts.

Fitting is Spark ML on the distributed feature table. Forecasting keeps one row per series with its last fourteen
values; each step predicts the next value of every series and pushes it into that state.
"""

from __future__ import annotations

import time

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.features import ROLLING_WIDTH, TREE_LAGS, lag_features
from tidemark.operators.forecast.replay import longest_horizon
from tidemark.operators.panel import renumber
from tidemark.session import materialize

FEATURES = ["lag_1", "lag_7", "lag_14", "rolling_mean", "rolling_max", "rolling_min", "weekday", "month"]
STATE = max(TREE_LAGS)

# Boosting settings.
TREES = 100
DEPTH = 6
STEP = 0.3
TREE_SEED = 0

# Keys that tell training sets apart: what one of their values holds must not train the model of another.
MODEL_KEYS = ["source", "range", "scale", "improve", "shift"]


def training_features(train: DataFrame, keys: list[str]) -> DataFrame:
    """Feature rows of every training position that has its full look-back."""
    rows = lag_features(train, keys, "value")
    return rows.filter(F.col(f"lag_{STATE}").isNotNull())


def last_states(train: DataFrame, keys: list[str]) -> DataFrame:
    """Last values (oldest first) and last date of every series; the limit is applied before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.col("pos").desc())
    tail = train.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= STATE)
    return tail.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("state"),
        F.max("dt").alias("last_dt"),
        F.max("pos").alias("last_train_pos"),
    )


def state_features(states: DataFrame, step: int) -> DataFrame:
    """Features of the next step from the state array; dates advance by calendar day."""
    recent = F.slice("state", -ROLLING_WIDTH, ROLLING_WIDTH)
    mean = F.aggregate(recent, F.lit(0.0), lambda s, v: s + v) / F.lit(float(ROLLING_WIDTH))
    at = F.date_add("last_dt", step)
    return states.withColumns({
        **{f"lag_{k}": F.element_at("state", -k) for k in TREE_LAGS},
        "rolling_mean": mean, "rolling_max": F.array_max(recent), "rolling_min": F.array_min(recent),
        "weekday": F.weekday(at), "month": F.month(at),
    })


def forecast_gbt(train: DataFrame, keys: list[str], horizon, longest: int | None = None, **params) -> DataFrame:
    """Forecast as many steps as the ``horizon`` of each series.

    ``train`` carries ``dt``. Every combination of the keys in `MODEL_KEYS` has a model of its own, so neither damaged or
    repaired copies nor later windows train the model of another one. The loop is bounded by the scenario grid and the
    shifts, not by data. ``longest``, the largest horizon, is read from ``horizon`` if not given.
    """
    by = [k for k in MODEL_KEYS if k in keys]
    if longest is None:
        longest = longest_horizon(train, horizon)
    if not by:
        return _one_model(train, keys, horizon, longest, **params)
    done = None
    for row in train.select(*by).distinct().orderBy(*by).toLocalIterator():
        own = train
        for k in by:
            own = own.filter(F.col(k).eqNullSafe(F.lit(row[k])))
        fits = _one_model(own, keys, horizon, longest, **params)
        done = fits if done is None else done.unionByName(fits)
    return _one_model(train, keys, horizon, longest, **params) if done is None else done


def _one_model(train: DataFrame, keys: list[str], horizon, longest: int, trees: int = TREES, depth: int = DEPTH,
               cut_every: int = 15) -> DataFrame:
    """Forecast ``longest`` steps for all series with one model, cut to the ``horizon`` of each.

    The step loop runs over the forecast horizon, not over data; the plan of the state
    table is cut every ``cut_every`` steps by writing it to the shared checkpoint folder.
    """
    began = time.perf_counter_ns()
    dense = renumber(train.select(*keys, "pos", "dt", "value"), keys)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    table = materialize(assembler.transform(training_features(dense, keys)).select("features", "value"), "features")
    ready = time.perf_counter_ns()
    model = GBTRegressor(featuresCol="features", labelCol="value", predictionCol="_next", maxIter=trees,
                         maxDepth=depth, stepSize=STEP, seed=TREE_SEED).fit(table)
    fitted = time.perf_counter_ns()
    states = last_states(dense, keys)
    enough = F.size("state") == STATE
    short = states.filter(~enough).select(*keys, F.lit("fewer than 14 training rows").alias("error"), "last_train_pos")
    states = states.filter(enough).withColumn("yhat", F.array().cast("array<double>"))
    kept = [*keys, "state", "last_dt", "last_train_pos", "yhat"]
    for step in range(1, longest + 1):
        guess = model.transform(assembler.transform(state_features(states, step)))
        states = guess.withColumns({
            "yhat": F.array_append("yhat", F.col("_next")),
            "state": F.array_append(F.slice("state", 2, STATE - 1), F.col("_next")),
        }).select(*kept)
        if step % cut_every == 0 and step < longest:
            states = materialize(states, "states")
    ms = lambda a, b: F.lit((b - a) / 1e6)
    done = states.select(
        *keys, F.slice("yhat", F.lit(1), horizon).alias("yhat"), F.lit(None).cast("int").alias("p"),
        F.lit(None).cast("int").alias("q"), ms(began, ready).alias("prepare_ms"), ms(ready, fitted).alias("fit_ms"),
        ms(fitted, time.perf_counter_ns()).alias("predict_ms"), F.lit(None).cast("string").alias("error"),
        "last_train_pos",
    )
    return done.unionByName(short, allowMissingColumns=True)
