"""Repairs of damaged series: local-level smoothing of noise, cubic-spline filling of gaps.

The smoother is an associative scan: every (series, chunk) group is one small element, elements compose across chunks, and a
second pass over the groups fills in, exactly. The spline looks only a bounded distance back and ahead before its influence falls
below double precision, so its groups have a halo. A group reaches Python as one row of bounded arrays; a Pandas UDF then
handles many groups at once with numpy. Spline values are evaluated by Spark from the polynomial of each interval.
"""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import CHUNK_ROWS, LEVEL_VARIANCE, OBSERVATION_VARIANCE, SPLINE_HALO
from tidemark.functions.types import DOUBLES, record
from tidemark.operators.deviate import strength_of
from tidemark.operators.panel import chunk_arrays, chunk_of, renumber, with_halo
from tidemark.operators.scan import Monoid, scan
from tidemark.session import materialize


def padded(arrays: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of different lengths as one matrix padded with NaN, and their lengths."""
    lengths = np.array([len(a) for a in arrays], dtype=np.int64)
    out = np.full((len(lengths), max(1, lengths.max(initial=1))), np.nan)
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    return out, lengths


# Series handled at once inside a Python batch; bounds the padded matrices.
ROWS_AT_ONCE = 256


def in_slices(solve, *columns: pd.Series) -> pd.DataFrame:
    """Apply ``solve`` to slices of a batch and stack the results; adds the time share of every row by its length."""
    parts = []
    for at in range(0, len(columns[0]), ROWS_AT_ONCE):
        piece = [c.iloc[at : at + ROWS_AT_ONCE] for c in columns]
        start = time.perf_counter_ns()
        found = solve(*piece)
        elapsed = (time.perf_counter_ns() - start) / 1e6
        lengths = piece[0].map(len)
        found["elapsed_ms"] = (elapsed * lengths / max(1, lengths.sum())).to_numpy()
        parts.append(found)
    return pd.concat(parts, ignore_index=True)


def _compose_levels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Elements of the local level, ``a`` first (Sarkka and Garcia-Fernandez 2021).

    Columns: given the level before, the level behind has mean ``A x + b`` and variance ``C``; what the values in between say about the
    level before is a Gaussian in information form, ``eta`` and ``J``; and the first of these values.
    """
    a1, b1, c1, e1, j1, first = a.T
    a2, b2, c2, e2, j2, then = b.T
    d = 1.0 / (1.0 + c1 * j2)
    return np.stack([a2 * d * a1, a2 * d * (b1 + c1 * e2) + b2, a2 * d * c1 * a2 + c2, a1 * d * (e2 - j2 * b1) + e1,
                     a1 * d * j2 * a1 + j1, np.where(np.isnan(first), then, first)], axis=1)


LEVEL = Monoid(np.array([1.0, 0.0, 0.0, 0.0, 0.0, np.nan]), _compose_levels)


def level_elements(y: np.ndarray, lengths: np.ndarray, r: float = OBSERVATION_VARIANCE, q: float = LEVEL_VARIANCE) -> np.ndarray:
    """Composition of the steps over each row of ``y``, of ``lengths[i]`` values each."""
    s = q + r
    gain = q / s
    out = np.tile(LEVEL.identity, (len(y), 1))
    step = np.empty_like(out)
    for t in range(y.shape[1]):
        live = t < lengths
        v = np.where(live, y[:, t], 0.0)
        step[:] = np.stack([np.full(len(v), 1.0 - gain), gain * v, np.full(len(v), (1.0 - gain) * q), v / s, np.full(len(v), 1.0 / s), v], axis=1)
        out = np.where(live[:, None], _compose_levels(out, step), out)
    return out


def smooth_level(y: np.ndarray, lengths: np.ndarray, before: np.ndarray, after: np.ndarray, r: float = OBSERVATION_VARIANCE,
                 q: float = LEVEL_VARIANCE) -> np.ndarray:
    """Smoothed level of every value of ``y``, given the elements of all values before and after each row.

    The prior of the first value of a series is that value with variance ``r``. The filter runs forward from the state before; backward
    runs what later values say about the level, and both meet at each value.
    """
    a, b, c, eta, j, first = before.T
    start = np.where(np.isnan(first), y[:, 0], first)
    prior = r - q
    d = 1.0 / (1.0 + prior * j)
    mean, var = a * d * (start + prior * eta) + b, a * d * prior * a + c
    means, variances = np.empty_like(y), np.empty_like(y)
    for t in range(y.shape[1]):
        ahead = var + q
        gain = ahead / (ahead + r)
        mean = mean + gain * (y[:, t] - mean)
        var = ahead * (1.0 - gain)
        means[:, t], variances[:, t] = mean, var
    smooth = np.empty_like(y)
    eta, j = after[:, 3].copy(), after[:, 4].copy()
    for t in range(y.shape[1] - 1, -1, -1):
        live = t < lengths
        m, p = means[:, t], variances[:, t]
        smooth[:, t] = m + p * (eta - j * m) / (1.0 + p * j)
        j2 = j + 1.0 / r
        d = 1.0 + q * j2
        eta, j = np.where(live, (eta + y[:, t] / r) / d, eta), np.where(live, j2 / d, j)
    return smooth


def spline_intervals(x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Not-a-knot cubic splines through the first ``lengths[i] >= 4`` knots of every row.

    Returns ``b, c, d`` per knot, so that from knot i on the curve is ``y + b*t + c*t^2 + d*t^3``. The last knot
    continues the polynomial before it. Padded knots solve trivial equations.
    """
    rows, n = x.shape
    real = np.arange(n)[None, :] < lengths[:, None]
    pad = np.maximum(np.arange(n)[None, :] - lengths[:, None] + 1, 0)
    last = np.take_along_axis(x, (lengths - 1)[:, None], 1)
    x = np.where(real, x, last + pad)
    y = np.where(real, y, 0.0)
    h = np.diff(x, axis=1)
    slope = np.diff(y, axis=1) / h
    # Second derivatives m: interior continuity, with the two end equations eliminated by the not-a-knot rule.
    low, diag, up, rhs = (np.zeros((rows, n)) for _ in range(4))
    diag[:] = 1.0
    at = np.arange(1, n - 1)
    inner = at[None, :] <= lengths[:, None] - 2
    low[:, 1:-1] = np.where(inner, h[:, :-1], 0.0)
    diag[:, 1:-1] = np.where(inner, 2.0 * (h[:, :-1] + h[:, 1:]), 1.0)
    up[:, 1:-1] = np.where(inner, h[:, 1:], 0.0)
    rhs[:, 1:-1] = np.where(inner, 6.0 * (slope[:, 1:] - slope[:, :-1]), 0.0)
    h0, h1 = h[:, 0], h[:, 1]
    diag[:, 1] += h0 * (h0 + h1) / h1
    up[:, 1] -= h0 * h0 / h1
    low[:, 1] = 0.0
    i = np.arange(rows)
    e = lengths - 2
    ha, hb = h[i, e - 1], h[i, e]
    diag[i, e] += hb * (ha + hb) / ha
    low[i, e] -= hb * hb / ha
    up[i, e] = 0.0
    for t in range(2, n - 1):
        w = low[:, t] / diag[:, t - 1]
        diag[:, t] -= w * up[:, t - 1]
        rhs[:, t] -= w * rhs[:, t - 1]
    m = np.zeros((rows, n))
    m[:, n - 2] = rhs[:, n - 2] / diag[:, n - 2]
    for t in range(n - 3, 0, -1):
        m[:, t] = (rhs[:, t] - up[:, t] * m[:, t + 1]) / diag[:, t]
    m[:, 0] = ((h0 + h1) * m[:, 1] - h0 * m[:, 2]) / h1
    m[i, lengths - 1] = ((ha + hb) * m[i, e] - hb * m[i, e - 1]) / ha
    b, c, d = (np.zeros((rows, n)) for _ in range(3))
    b[:, :-1] = slope - h * (2.0 * m[:, :-1] + m[:, 1:]) / 6.0
    c[:, :-1] = m[:, :-1] / 2.0
    d[:, :-1] = (m[:, 1:] - m[:, :-1]) / (6.0 * h)
    b[i, lengths - 1] = b[i, e] + 2.0 * c[i, e] * hb + 3.0 * d[i, e] * hb * hb
    c[i, lengths - 1] = c[i, e] + 3.0 * d[i, e] * hb
    d[i, lengths - 1] = d[i, e]
    return b, c, d


def _present(values: pd.Series) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    present = [~np.isnan(v) for v in values]
    return present, *padded(pd.Series([v[p] for v, p in zip(values, present)]))


def _element_slice(values: pd.Series) -> pd.DataFrame:
    _, y, lengths = _present(values)
    return pd.DataFrame({"element": list(level_elements(y, lengths))})


def _smooth_slice(values: pd.Series, before: pd.Series, after: pd.Series) -> pd.DataFrame:
    present, y, lengths = _present(values)
    smooth = smooth_level(y, lengths, np.stack(before.to_list()), np.stack(after.to_list()))
    out = [np.full(len(p), np.nan) for p in present]
    for i, p in enumerate(present):
        out[i][p] = smooth[i, : lengths[i]]
    return pd.DataFrame({"smooth": out})


def _spline_slice(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    x, lengths = padded(xs)
    y, _ = padded(ys)
    found = spline_intervals(x - x[:, :1], y, lengths)
    return pd.DataFrame({k: [m[i, :n] for i, n in enumerate(lengths)] for k, m in zip("bcd", found)})


@F.pandas_udf(record(element=DOUBLES, elapsed_ms=T.DoubleType()))
def _level_elements(values: pd.Series) -> pd.DataFrame:
    return in_slices(_element_slice, values)


@F.pandas_udf(record(smooth=DOUBLES, elapsed_ms=T.DoubleType()))
def _smooth_arrays(values: pd.Series, before: pd.Series, after: pd.Series) -> pd.DataFrame:
    return in_slices(_smooth_slice, values, before, after)


@F.pandas_udf(record(b=DOUBLES, c=DOUBLES, d=DOUBLES, elapsed_ms=T.DoubleType()))
def _spline_arrays(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    return in_slices(_spline_slice, xs, ys)


def smooth_groups(panel: DataFrame, keys: list[str], size: int = CHUNK_ROWS, carry=()) -> DataFrame:
    """Smoothed arrays per (keys, chunk): ``a`` (pos, value, carry), ``first`` (element, elapsed_ms), ``fit`` (smooth, elapsed_ms).

    Each chunk is one element; the elements before and after a chunk stand for all other values of the series.
    """
    rows = panel.select(*keys, "pos", "value", *carry).withColumn("chunk", chunk_of("pos", size))
    values = F.transform("a", lambda s: s["value"])
    chunks = chunk_arrays(rows, keys, ["pos", "value", *carry]).withColumn("first", _level_elements(values))
    around = scan(chunks.select(*keys, "chunk", F.col("first.element").alias("element")), keys, LEVEL, after=True)
    return chunks.join(around, [*keys, "chunk"]).withColumn("fit", _smooth_arrays(values, "before", "after"))


def mitigate_kalman(panel: DataFrame, keys: list[str], size: int = CHUNK_ROWS, carry=()) -> DataFrame:
    """Smooth ``value`` per series: ``keys, pos, value`` and the ``carry`` columns of the row.

    ``damaged`` is the value before. Rows without a value are stepped over and stay without one. The result does not depend on
    ``size``, wherever gaps lie.
    """
    fitted = smooth_groups(panel, keys, size, carry)
    rows = fitted.select(*keys, F.inline(F.arrays_zip("a", F.col("fit.smooth").alias("smooth"))))
    damaged = F.col("a.value")
    kept = [F.col(f"a.{c}").alias(c) for c in carry]
    return rows.select(*keys, F.col("a.pos").alias("pos"), F.when(damaged.isNotNull(), F.col("smooth")).alias("value"),
                       damaged.alias("damaged"), *kept)


def knots_of(panel: DataFrame, keys: list[str], size: int = CHUNK_ROWS) -> DataFrame:
    """Present values as knots, numbered without gaps: ``keys, knot, pos, value``."""
    present = panel.filter(F.col("value").isNotNull()).select(*keys, "pos", "value", F.col("pos").alias("_at"))
    return renumber(present, keys, size).select(*keys, F.col("pos").alias("knot"), F.col("_at").alias("pos"), "value")


def _compose_ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Last and first piece of neighbouring stretches, NaN where a stretch has none."""
    half = a.shape[1] // 2
    last = np.where(np.isnan(b[:, :half]), a[:, :half], b[:, :half])
    return np.concatenate([last, np.where(np.isnan(a[:, half:]), b[:, half:], a[:, half:])], axis=1)


PIECE = ["x", "y", "b", "c", "d"]
ENDS = Monoid(np.full(2 * len(PIECE), np.nan), _compose_ends)


def with_pieces(panel: DataFrame, curve: DataFrame, keys: list[str], size: int = CHUNK_ROWS) -> DataFrame:
    """Rows of ``panel`` with ``piece``, the polynomial of the last knot at or before a row, or of the first knot if there is none.

    Pieces are carried forward inside a chunk and across chunks by a scan over one row per chunk. Nothing is joined on the knot, so
    the rows of a gap of any length stay spread over their chunks.
    """
    piece = F.struct(*[F.col(c).cast("double").alias(c) for c in PIECE])
    curve = curve.select(*keys, F.col("x").alias("pos"), piece.alias("piece"), F.lit(False).alias("_row"))
    both = panel.withColumn("_row", F.lit(True)).unionByName(curve, allowMissingColumns=True).withColumn("chunk", chunk_of("pos", size))
    at = F.when(F.col("piece").isNotNull(), F.col("pos"))
    nan = F.array_repeat(F.lit(float("nan")), len(PIECE))

    def numbers(found):
        return F.coalesce(F.when(found.isNotNull(), F.array(*[found[c] for c in PIECE])), nan)
    ends = both.groupBy(*keys, "chunk").agg(F.max_by("piece", at).alias("_last"), F.min_by("piece", at).alias("_first"))
    around = scan(ends.select(*keys, "chunk", F.concat(numbers(F.col("_last")), numbers(F.col("_first"))).alias("element")), keys, ENDS, after=True)

    def carried(name, start):
        return F.when(~F.isnan(F.get(name, F.lit(start))), F.struct(*[F.get(name, F.lit(start + i)).alias(c) for i, c in enumerate(PIECE)]))
    # A row before all knots of its chunk takes the first of them, if no earlier chunk has one: a frame to the end would be quadratic.
    mine = Window.partitionBy(*keys, "chunk")
    so_far = mine.orderBy("pos", "_row").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumns({"_known": F.last("piece", ignorenulls=True).over(so_far), "_next": F.min_by("piece", at).over(mine)}).filter("_row")
    joined = inside.join(around, [*keys, "chunk"])
    found = F.coalesce("_known", carried("before", 0), "_next", carried("after", len(PIECE)))
    return joined.withColumn("piece", found).drop("_known", "_next", "_row", "before", "after", "chunk")


def spline_coefficients(knots: DataFrame, keys: list[str], size: int = CHUNK_ROWS) -> DataFrame:
    """Polynomial of every knot interval: ``keys, knot, x, y, b, c, d, elapsed_ms``, from ``keys, knot, pos, value``.

    Chunks and halo count knots. A series needs at least four knots, shorter ones have no rows here.
    """
    halo = with_halo(knots, SPLINE_HALO, SPLINE_HALO, size, pos="knot")
    grouped = chunk_arrays(halo.select(*keys, "chunk", "knot", "pos", "value", "core"), keys,
                           ["knot", "pos", "value", "core"])
    # With a halo of forty knots, fewer than four knots with a core row can only mean a short series.
    usable = grouped.filter((F.size("a") >= 4) & F.exists("a", lambda s: s["core"]))
    fit = _spline_arrays(
        F.transform("a", lambda s: s["pos"].cast("double")), F.transform("a", lambda s: s["value"])
    )
    solved = usable.withColumn("fit", fit)
    zipped = F.arrays_zip("a", F.col("fit.b").alias("b"), F.col("fit.c").alias("c"), F.col("fit.d").alias("d"))
    share = F.col("fit.elapsed_ms") / F.size("a")
    rows = solved.select(*keys, share.alias("elapsed_ms"), F.inline(zipped)).filter("a.core")
    return rows.select(*keys, F.col("a.knot").alias("knot"), F.col("a.pos").alias("x"), F.col("a.value").alias("y"),
                       "b", "c", "d", "elapsed_ms")


def mitigate_spline(panel: DataFrame, keys: list[str], size: int = CHUNK_ROWS, carry=()) -> DataFrame:
    """Fill missing ``value`` rows by a cubic spline over positions: ``keys, pos, value, error`` and ``carry``.

    Present values stay as they are, ``damaged`` is the value before. Both ends are extrapolated. With fewer than
    four present values the gaps stay null and ``error`` says why.
    """
    rows = panel.select(*keys, "pos", "value", *carry)
    # Read twice below, by rows and by chunks: written once.
    curve = materialize(spline_coefficients(knots_of(rows, keys, size), keys, size).drop("elapsed_ms"), "curve")
    joined = with_pieces(rows, curve, keys, size)
    piece = F.col("piece")
    t = F.col("pos").cast("double") - piece["x"]
    filled = piece["y"] + t * (piece["b"] + t * (piece["c"] + t * piece["d"]))
    value = F.coalesce(F.col("value"), filled)
    error = F.when(value.isNull(), F.lit("fewer than 4 present values"))
    return joined.select(*keys, "pos", value.alias("value"), F.col("value").alias("damaged"), error.alias("error"),
                         *carry)


# A repair turns (panel, keys, chunk size, carried columns) into ``keys, pos, value, damaged`` and the carried columns.
MITIGATIONS = {"noise": mitigate_kalman, "incompleteness": mitigate_spline}


def mitigation_time(panel: DataFrame, source: str, keys: list[str], size: int = CHUNK_ROWS) -> DataFrame:
    """Time spent repairing each series, in ms: the shares of its chunks added up."""
    if source == "noise":
        both = F.col("first.elapsed_ms") + F.col("fit.elapsed_ms")
        fits = smooth_groups(panel, keys, size).select(*keys, both.alias("elapsed_ms"))
    else:
        fits = spline_coefficients(knots_of(panel, keys, size), keys, size).select(*keys, "elapsed_ms")
    return fits.groupBy(*keys).agg(F.sum("elapsed_ms").alias("elapsed_ms"))


def mitigated_partial(repaired: DataFrame, grid: dict) -> DataFrame:
    """Repaired set of partial damage: the repaired value where the column was damaged, else the real value.

    ``repaired`` is the repaired set of full damage with ``real`` carried along. Which column is damaged at which
    scale is a fixed grid, so this is a projection.
    """
    damaged = strength_of(grid, F.col("col"), F.col("scale")) != 0
    return repaired.withColumn("value", F.when(damaged, F.col("value")).otherwise(F.col("real")))
