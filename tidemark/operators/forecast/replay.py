"""Replay of the last training values, the base that return forecasts are scaled by."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def longest_horizon(train: DataFrame, horizon) -> int:
    """Largest value of the column ``horizon`` over ``train``; 0 without rows."""
    return train.agg(F.max(horizon).alias("h")).first()["h"] or 0


def tail_replay(train: DataFrame, keys: list[str], horizon, longest: int | None = None) -> DataFrame:
    """Step i repeats training value ``n - h + i`` of the ``h = horizon`` last ones.

    Only as many rows per group as the ``longest`` horizon pass the shuffle; it is read from ``horizon`` if not given.
    """
    if longest is None:
        longest = longest_horizon(train, horizon)
    last_first = Window.partitionBy(*keys).orderBy(F.col("pos").desc())
    ranked = train.select(*keys, "pos", "value").withColumn("_rank", F.row_number().over(last_first))
    tail = ranked.filter(F.col("_rank") <= longest).withColumn("_h", horizon).filter(F.col("_rank") <= F.col("_h"))
    found = tail.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_tail"),
        F.first("_h").alias("_h"),
        F.max("pos").alias("last_train_pos"),
    )
    whole = F.size("_tail") == F.col("_h")
    none = F.lit(None)
    return found.select(
        *keys,
        F.when(whole, F.transform("_tail", lambda s: s["value"])).alias("yhat"),
        none.cast("int").alias("p"),
        none.cast("int").alias("q"),
        F.lit(0.0).alias("prepare_ms"),
        F.lit(0.0).alias("fit_ms"),
        F.lit(0.0).alias("predict_ms"),
        F.when(~whole, F.lit("fewer training rows than forecast steps")).alias("error"),
        "last_train_pos",
    )
