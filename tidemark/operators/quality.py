"""Correctness, completeness and timeliness of values, tuples and whole relations.

Wide rows carry damaged columns next to ``real_<column>``, so value and tuple scores are projections. Relation
scores are means, reduced before the shuffle; a weighted mean of tuples is taken column by column, which is the
same number with one pass less.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import ALPHA, COLUMNS, DECLINES, MEASUREMENT_DAYS, WEIGHTS
from tidemark.functions import scoring
from tidemark.operators.deviate import row_ages, strengths


def correctness_values(wide: DataFrame, column: str, alpha: dict = ALPHA) -> DataFrame:
    """Score of each value of one column."""
    score = scoring.correctness(F.col(column), F.col(f"real_{column}"), alpha[column])
    return wide.select("series_id", "pos", "scale", score.alias("score"))


def correctness_tuples(wide: DataFrame, columns=None, alpha: dict = ALPHA, weights: dict = WEIGHTS) -> DataFrame:
    """Weighted mean score of each row over the chosen columns."""
    columns = columns or COLUMNS
    parts = {c: scoring.correctness(F.col(c), F.col(f"real_{c}"), alpha[c]) for c in columns}
    score = scoring.weighted_sum(parts, scoring.normalized(weights, columns))
    return wide.select("series_id", "pos", "scale", score.alias("score"))


def correctness_relation(wide: DataFrame, columns=None, alpha: dict = ALPHA, weights: dict = WEIGHTS) -> DataFrame:
    """Mean score per series and scale; null when any score of the relation is null."""
    columns = columns or COLUMNS
    means = {
        c: scoring.average_whole(scoring.correctness(F.col(c), F.col(f"real_{c}"), alpha[c])) for c in columns
    }
    score = scoring.weighted_sum(means, scoring.normalized(weights, columns))
    return wide.groupBy("series_id", "scale").agg(score.alias("score"))


def correctness_relation_long(panel: DataFrame, columns=None, alpha: dict = ALPHA,
                              weights: dict = WEIGHTS) -> DataFrame:
    """As :func:`correctness_relation` from long rows ``series_id, col, scale, value, real``."""
    columns = columns or COLUMNS
    per_column = (
        panel.filter(F.col("col").isin(list(columns)))
        .groupBy("series_id", "scale", "col")
        .agg(scoring.average_whole(
            scoring.correctness(F.col("value"), F.col("real"), scoring.by_key(F.col("col"), alpha))
        ).alias("q"))
    )
    weight = scoring.by_key(F.col("col"), scoring.normalized(weights, columns))
    whole = F.count("q") == len(columns)
    return per_column.groupBy("series_id", "scale").agg(F.when(whole, F.sum(weight * F.col("q"))).alias("score"))


def completeness_values(wide: DataFrame, column: str) -> DataFrame:
    """1 for each present value of one column, 0 for each missing one."""
    return wide.select("series_id", "pos", "scale", scoring.completeness(F.col(column)).alias("score"))


def is_complete(columns=None) -> F.Column:
    """True when no chosen column of a wide row is missing."""
    whole = F.lit(True)
    for c in columns or COLUMNS:
        whole = whole & F.col(c).isNotNull()
    return whole


def completeness_tuples(wide: DataFrame, columns=None) -> DataFrame:
    """Whether each row has all chosen columns."""
    return wide.select("series_id", "pos", "scale", is_complete(columns).alias("complete"))


def completeness_relation(wide: DataFrame, columns=None) -> DataFrame:
    """Share of complete rows per series and scale."""
    return wide.groupBy("series_id", "scale").agg(F.avg(is_complete(columns).cast("double")).alias("score"))


def completeness_relation_long(panel: DataFrame, columns=None) -> DataFrame:
    """As :func:`completeness_relation` from long rows ``series_id, col, pos, scale, value``."""
    chosen = panel.filter(F.col("col").isin(list(columns or COLUMNS)))
    rows = chosen.groupBy("series_id", "scale", "pos").agg(F.bool_and(F.col("value").isNotNull()).alias("complete"))
    return rows.groupBy("series_id", "scale").agg(F.avg(F.col("complete").cast("double")).alias("score"))


def timeliness_values(ages: DataFrame, column: str, declines: dict = DECLINES) -> DataFrame:
    """Decay of each value of one column at each measurement time."""
    score = scoring.timeliness(declines[column], F.col("age_years"))
    return ages.select("series_id", "pos", "scale", "time_diff", score.alias("score"))


def tuple_timeliness(declines: dict = DECLINES, weights: dict = WEIGHTS):
    """Weighted decay of a row over all columns, as an expression on ``age_years``."""
    parts = {c: scoring.timeliness(declines[c], F.col("age_years")) for c in COLUMNS}
    return scoring.weighted_sum(parts, scoring.normalized(weights, COLUMNS))


def timeliness_tuples(ages: DataFrame, declines: dict = DECLINES, weights: dict = WEIGHTS) -> DataFrame:
    return ages.select("series_id", "pos", "scale", "time_diff", tuple_timeliness(declines, weights).alias("score"))


def timeliness_relation(bars: DataFrame, columns=None, declines: dict = DECLINES, weights: dict = WEIGHTS,
                        days: dict = MEASUREMENT_DAYS) -> DataFrame:
    """Mean decay per series and scale when every column is stale. Columns cannot be chosen here."""
    if columns:
        raise ValueError("columns can be chosen only when part of them is stale")
    ages = row_ages(bars, days)
    return ages.groupBy("series_id", "scale").agg(F.avg(tuple_timeliness(declines, weights)).alias("score"))


def timeliness_relation_partial(bars: DataFrame, columns=None, declines: dict = DECLINES, weights: dict = WEIGHTS,
                                days: dict = MEASUREMENT_DAYS, grid: dict | None = None) -> DataFrame:
    """Mean decay when only some columns are stale: the others are measured on the last date.

    Every column contributes the decay of the whole tuple at the age of that column, weighted by the column. So
    two means per series suffice: at zero days and at the days of the scale.
    """
    columns = columns or COLUMNS
    grid = grid or strengths("timeliness", "partially")
    share = scoring.normalized(weights, columns)
    stale = sum(share[c] for c in columns if any(grid[s][c] != 0 for s in days))
    fresh_now = "at last date"
    ages = row_ages(bars, {fresh_now: 0, **days})
    means = ages.groupBy("series_id", "scale").agg(F.avg(tuple_timeliness(declines, weights)).alias("mean"))
    fresh = means.filter(F.col("scale") == fresh_now).select("series_id", F.col("mean").alias("fresh"))
    aged = means.filter(F.col("scale") != fresh_now)
    score = F.lit(1.0 - stale) * F.col("fresh") + F.lit(float(stale)) * F.col("mean")
    return aged.join(fresh, "series_id").select("series_id", "scale", score.alias("score"))


def weights_normalized(panel: DataFrame, weights: dict = WEIGHTS) -> DataFrame:
    """Weight of each column of a series, scaled over the columns that hold data, with the rows they hold."""
    present = panel.groupBy("series_id", "col").agg(F.count("real").alias("rows")).filter(F.col("rows") > 0)
    weighted = present.withColumn("weight", scoring.by_key(F.col("col"), weights))
    total = weighted.groupBy("series_id").agg(F.sum("weight").alias("total"))
    return weighted.join(total, "series_id").select(
        "series_id", "col", "rows", (F.col("weight") / F.col("total")).alias("weight")
    )
