"""Damaged copies of a panel: Gaussian noise, random gaps, staleness.

Damage is a column expression over (value, strength, key), so scenarios stay expressions inside one scan and cost
no shuffle. The only aggregate is the value range of a series, which sets the spread of its noise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import COLUMNS, DAYS_IN_YEAR, MEASUREMENT_DAYS, SCALES, seed_for, strengths
from tidemark.functions import rng
from tidemark.functions.scoring import by_key
from tidemark.operators.panel import attach, chunk_of

# A deviation turns (value, strength, random bits, low, high) into the damaged value.
Deviation = Callable[[Column, Column, Column, Column, Column], Column]


def add_noise(value: Column, strength: Column, drawn: Column, low: Column, high: Column) -> Column:
    """Value plus normal noise whose deviation is ``strength`` percent of the range of the series."""
    noisy = value + F.lit(0.01) * strength * (high - low) * rng.normal(drawn)
    return F.when(strength == 0, value).otherwise(noisy)


def add_gaps(value: Column, strength: Column, drawn: Column, low: Column, high: Column) -> Column:
    """Value dropped with probability ``strength``."""
    return F.when((strength == 0) | (rng.uniform(drawn) >= strength), value)


def keep(value: Column, strength: Column, drawn: Column, low: Column, high: Column) -> Column:
    """Stale copies keep their values; their strength is a delay in rows."""
    return value


DEVIATIONS: dict[str, Deviation] = {"noise": add_noise, "incompleteness": add_gaps, "timeliness": keep}


def scale_rows(df: DataFrame) -> DataFrame:
    """Repeat each row for every scale; a generator, no join."""
    return df.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in SCALES])))


def strength_of(grid: dict, col: Column, scale: Column) -> Column:
    """Strength of a (column, scale) as one CASE expression over the fixed grid."""
    expr = F.lit(0.0)
    for s in reversed(SCALES):
        values = set(grid[s].values())
        inner = F.lit(float(values.pop())) if len(values) == 1 else F.coalesce(by_key(col, grid[s]), F.lit(0.0))
        expr = F.when(scale == s, inner).otherwise(expr)
    return expr


def bounds_long(panel: DataFrame, keys: list[str], value: str = "real") -> DataFrame:
    """Value range and row count per series, reduced before the shuffle."""
    return panel.groupBy(*keys).agg(
        F.min(value).alias("low_bound"), F.max(value).alias("high_bound"), (F.max("pos") + 1).alias("rows")
    )


def with_bounds(panel: DataFrame, keys: list[str], value: str = "real") -> DataFrame:
    chunked = panel.withColumn("chunk", chunk_of("pos"))
    return attach(chunked, bounds_long(panel, keys, value), keys).drop("chunk", "rows")


def deviate(panel: DataFrame, source: str, range_: str = "all", grid: dict | None = None, shift: int = 0,
            method: Deviation | None = None, columns=None) -> DataFrame:
    """Damage a long panel ``series_id, col, pos, real`` at every scale: adds ``scale, strength, value``.

    ``grid`` is ``{scale: {column: strength}}``; columns without a strength stay as they are. ``method`` replaces
    the built-in deviation of the source.
    """
    grid = grid or strengths(source, range_, columns)
    if source == "noise" or method is not None:
        ranged = with_bounds(panel, ["series_id", "col"])
    else:
        unused = F.lit(None).cast("double")
        ranged = panel.withColumn("low_bound", unused).withColumn("high_bound", unused)
    method = method or DEVIATIONS[source]
    scaled = scale_rows(ranged).withColumn("strength", strength_of(grid, F.col("col"), F.col("scale")))
    key = rng.draw_key(seed_for(range_, shift), source, F.col("scale"), F.col("col"), F.col("series_id"), F.col("pos"))
    drawn = scaled.withColumn("_bits", F.when(F.col("strength") != 0, rng.bits(key)))
    value = method(F.col("real"), F.col("strength"), F.col("_bits"), F.col("low_bound"), F.col("high_bound"))
    return drawn.withColumn("value", value).drop("low_bound", "high_bound", "_bits")


def deviate_wide(bars: DataFrame, source: str, range_: str = "all", grid: dict | None = None, shift: int = 0,
                 columns=None) -> DataFrame:
    """Damage wide bars at every scale, one row per (series, position, scale).

    Real values stay in the row as ``real_<column>``, so scoring a tuple needs no join.
    """
    columns = columns or COLUMNS
    grid = grid or strengths(source, range_, columns)
    method = DEVIATIONS[source]
    ranged = bars
    if source == "noise":
        limits = bars.groupBy("series_id").agg(
            *[F.min(c).alias(f"_lo_{c}") for c in columns],
            *[F.max(c).alias(f"_hi_{c}") for c in columns],
            (F.max("pos") + 1).alias("rows"),
        )
        ranged = attach(bars.withColumn("chunk", chunk_of("pos")), limits, ["series_id"])
    ids = [c for c in bars.columns if c not in COLUMNS]
    seed = seed_for(range_, shift)
    none = F.lit(None).cast("double")
    damaged = [c for c in columns if any(grid[s][c] != 0 for s in SCALES)]
    per_scale = [F.struct(F.lit(s).alias("scale"), *[F.lit(float(grid[s][c])).alias(f"_s_{c}") for c in damaged])
                 for s in SCALES]
    scaled = ranged.select("*", F.inline(F.array(*per_scale)))
    if source != "timeliness":
        keys = {c: rng.draw_key(seed, source, F.col("scale"), c, F.col("series_id"), F.col("pos")) for c in damaged}
        scaled = scaled.withColumns({f"_b_{c}": rng.bits(k) for c, k in keys.items()})
    out = []
    for c in columns:
        if c not in damaged:
            value = F.col(c)
        else:
            lo, hi = (F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) if source == "noise" else (none, none)
            drawn = F.lit(None).cast("bigint") if source == "timeliness" else F.col(f"_b_{c}")
            value = method(F.col(c), F.col(f"_s_{c}"), drawn, lo, hi)
        out.append(value.alias(c))
    return scaled.select(*ids, "scale", *[F.col(c).alias(f"real_{c}") for c in columns], *out)


def delays(panel: DataFrame, range_: str = "all", grid: dict | None = None) -> DataFrame:
    """Stale copies as ``scale, delay`` on the panel rows; values are untouched."""
    grid = grid or strengths("timeliness", range_)
    delay = strength_of(grid, F.col("col"), F.col("scale")).cast("int")
    return scale_rows(panel).withColumn("delay", delay)


def row_ages(bars: DataFrame, days: dict | None = None) -> DataFrame:
    """Age of every row at the measurement time of each scale: ``days`` after the last date of its series.

    ``age_years`` counts calendar days / 365, ``time_diff`` counts rows. A scale whose days are None is measured
    today and has no row count.
    """
    days = MEASUREMENT_DAYS if days is None else days
    last = bars.groupBy("series_id").agg(F.max("dt").alias("last_dt"), (F.max("pos") + 1).alias("rows"))
    counted = attach(bars.withColumn("chunk", chunk_of("pos")),
                     last.withColumn("n_rows", F.col("rows")), ["series_id"]).drop("chunk", "rows")
    scales = F.array(*[F.struct(F.lit(s).alias("scale"), F.lit(d).cast("int").alias("days")) for s, d in days.items()])
    aged = counted.select("*", F.inline(scales))
    today = F.coalesce(F.date_add("last_dt", F.col("days")), F.current_date())
    return (
        aged.withColumn("age_years", F.datediff(today, "dt") / F.lit(DAYS_IN_YEAR))
        .withColumn("time_diff", (F.col("days") + F.col("n_rows") - F.col("pos")).cast("bigint"))
        .drop("last_dt", "n_rows")
    )


def display_offsets(ages: DataFrame) -> DataFrame:
    """Per series and scale, the shift that lines the measurement times of all scales up on one axis."""
    first = ages.groupBy("series_id", "scale").agg(F.max("time_diff").alias("first_diff"))
    return first.withColumn("offset", F.max("first_diff").over(Window.partitionBy("series_id")) - F.col("first_diff"))
