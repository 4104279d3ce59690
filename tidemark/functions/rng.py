"""Counter-based random draws: a value depends on its key only, never on partitioning or retries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: each draw uses two words of 32 hash bits.
WORD_SPAN = 4294967296.0
WORD_MASK = 0xFFFFFFFF


def draw_key(seed: str, source: str, scale, col, series_id, pos) -> Column:
    """Text key ``seed|source|scale|col|series|pos`` of one draw."""
    parts = [p if isinstance(p, Column) else F.lit(p) for p in (scale, col, series_id, pos)]
    return F.concat_ws("|", F.lit(f"{seed}|{source}"), *[p.cast("string") for p in parts])


def bits(key: Column) -> Column:
    """First 64 bits of the hash of a key as a signed number.

    Select this as a column of its own before using :func:`normal`, which reads it twice.
    """
    return F.conv(F.substring(F.md5(key), 1, 16), 16, -10).cast("bigint")


def uniform(drawn: Column) -> Column:
    """Uniform draw in (0, 1) from the upper word of :func:`bits`."""
    return (F.shiftrightunsigned(drawn, 32) + F.lit(0.5)) / F.lit(WORD_SPAN)


def normal(drawn: Column) -> Column:
    """Standard normal draw from both words of :func:`bits`, by the Box-Muller transform."""
    angle = drawn.bitwiseAND(F.lit(WORD_MASK)) / F.lit(WORD_SPAN)
    return F.sqrt(F.lit(-2.0) * F.log(uniform(drawn))) * F.cos(F.lit(2.0 * math.pi) * angle)
