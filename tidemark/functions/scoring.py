"""Column expressions: value-level quality scores, weighted means, report labels and text formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import SCALE_SHORT, SOURCE_SHORT


def correctness(value: Column, real: Column, alpha) -> Column:
    """One minus the relative distance of two values, raised to a sensitivity; 1 when they are equal."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    gap = F.abs(value - real) / F.greatest(F.abs(value), F.abs(real))
    return F.when(value == real, F.lit(1.0)).when(value.isNotNull() & real.isNotNull(), F.lit(1.0) - F.pow(gap, alpha))


def completeness(value: Column) -> Column:
    """1 for a present value, 0 for a missing one."""
    return value.isNotNull().cast("double")


def timeliness(decline, age_years: Column) -> Column:
    """Exponential decay of a value with its age in years."""
    decline = decline if isinstance(decline, Column) else F.lit(float(decline))
    return F.exp(-decline * age_years)


def normalized(weights: dict, columns=None) -> dict:
    """Weights of the chosen columns scaled to sum to one."""
    chosen = {c: weights[c] for c in (columns or weights)}
    total = sum(chosen.values())
    return {c: w / total for c, w in chosen.items()}


def weighted_sum(parts: dict, weights: dict) -> Column:
    """``sum(weight * part)`` over columns as one expression; null as soon as one part is null."""
    total = F.lit(0.0)
    for name, part in parts.items():
        total = total + F.lit(float(weights[name])) * part
    return total


def by_key(key: Column, mapping: dict, cast: str = "double") -> Column:
    """Look a fixed mapping up by key, as one CASE expression; null for unknown keys."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v).cast(cast)) if expr is None else expr.when(key == k, F.lit(v).cast(cast))
    return expr if expr is not None else F.lit(None).cast(cast)


def source_label(source: Column) -> Column:
    return by_key(source, SOURCE_SHORT, "string")


def scale_label(scale: Column) -> Column:
    return by_key(scale, SCALE_SHORT, "string")


def average_whole(q: Column) -> Column:
    """Mean that is null when any input is null, instead of skipping it."""
    return F.when(F.count(F.lit(1)) == F.count(q), F.avg(q))


def time_text(prepare: Column, model: Column, prediction: Column) -> Column:
    """``a + b + c`` text of the three time parts, two digits each."""
    return F.format_string("%.2f + %.2f + %.2f", prepare, model, prediction)


def time_part(text: Column, index: int) -> Column:
    """One number of an ``a + b + c`` text."""
    return F.split(text, r" \+ ")[index].cast("double")
