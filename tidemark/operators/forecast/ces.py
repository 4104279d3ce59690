"""Complex exponential smoothing, non-seasonal (Svetunkov, Kourentzes and Ord 2022), over chunks of a series.

For one pair of parameters the state is affine in the state before, and the sum of squared one-step errors is quadratic in it. A chunk is
therefore twelve numbers per pair, which compose in order. Each round of the grid is one pass over the chunks, whatever the
length of the series; what a group holds is bounded.
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import CHUNK_ROWS
from tidemark.functions.types import DOUBLES, record
from tidemark.operators.forecast.chunked import failures, fit_columns, first_values, series_stats, to_chunks
from tidemark.operators.scan import Monoid, chunk_values, fold, lists, padded, ragged, slices
from tidemark.session import materialize

#: Elements per group of a fold: a group of the first round holds some megabytes.
FAN = 256
LEAST_ROWS = 4
FIRST_ROWS = 10
STEP = 0.15
WIDTH = 12
# Ends of the grid of both parameters.
LOW, HIGH = (0.05, 0.05), (1.85, 1.95)
BOUNDS = (0.01, 1.8), (0.01, 1.9)
ROUNDS = 4
BEST = record(error=T.DoubleType(), a0=T.DoubleType(), a1=T.DoubleType(), level=T.DoubleType(), info=T.DoubleType(),
              elapsed=T.DoubleType())


def first_grid() -> np.ndarray:
    a0, a1 = np.meshgrid(np.arange(LOW[0], HIGH[0], STEP), np.arange(LOW[1], HIGH[1], STEP))
    return np.stack([a0.ravel(), a1.ravel()], axis=1)


def steps(a0: np.ndarray, a1: np.ndarray):
    """State transition and gains: ``l' = l - (1 - a1) c + (a0 - a1) e`` and ``c' = l + (1 - a0) c + (a0 + a1) e`` with ``e = y - l``."""
    return (1.0 - a0 + a1, a1 - 1.0, 1.0 - a0 - a1, 1.0 - a0), (a0 - a1, a0 + a1)


def elements(y: np.ndarray, lengths: np.ndarray, a0: np.ndarray, a1: np.ndarray) -> np.ndarray:
    """Twelve numbers for each row of ``y`` and each pair; ``lengths`` rise. Pairs have one row, or one for each row of ``y``.

    Transition (4), state from zero (2), and the error sum as ``s' Q s + 2 w s + k`` of the state ``s`` before: Q (3), w (2), k.
    """
    rows, pairs = len(y), a0.shape[1]
    own = len(a0) > 1 or rows == 1
    (m11, m12, m21, m22), (g1, g2) = steps(a0, a1)
    level, info, w1, w2, k = (np.zeros((rows, pairs)) for _ in range(5))
    p1, s2 = np.ones_like(a0), np.ones_like(a0)
    p2, s1, q11, q12, q22 = (np.zeros_like(a0) for _ in range(5))
    out = np.empty((rows, pairs, WIDTH))
    low = 0
    for t in range(int(lengths[-1]) + 1):
        ready = int(np.searchsorted(lengths, t, side="right"))
        if ready > low:
            done = slice(low, ready)
            mine = done if own else slice(None)
            for i, part in enumerate((p1, p2, s1, s2, None, None, q11, q12, q22)):
                if part is not None:
                    out[done, :, i] = part[mine]
            for i, part in ((4, level), (5, info), (9, w1), (10, w2), (11, k)):
                out[done, :, i] = part[done]
            low = ready
            if low == rows:
                break
        now = slice(low, None)
        c = now if own else slice(None)
        value = y[now, t, None]
        error = value - level[now]
        w1[now] -= p1[c] * error
        w2[now] -= p2[c] * error
        k[now] += error * error
        level[now], info[now] = (m11[c] * level[now] + m12[c] * info[now] + g1[c] * value,
                                 m21[c] * level[now] + m22[c] * info[now] + g2[c] * value)
        q11[c] += p1[c] * p1[c]
        q12[c] += p1[c] * p2[c]
        q22[c] += p2[c] * p2[c]
        p1[c], p2[c] = p1[c] * m11[c] + p2[c] * m21[c], p1[c] * m12[c] + p2[c] * m22[c]
        s1[c], s2[c] = s1[c] * m11[c] + s2[c] * m21[c], s1[c] * m12[c] + s2[c] * m22[c]
    return out


def composition(pairs: int) -> Monoid:
    """Elements of ``pairs`` pairs side by side, and the time spent on them at the end."""
    def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        f = a[:, :-1].reshape(-1, WIDTH).T
        g = b[:, :-1].reshape(-1, WIDTH).T
        ma, va, qa, wa = f[:4].reshape(2, 2, -1), f[4:6], f[6:9], f[9:11]
        mb, vb, qb, wb = g[:4].reshape(2, 2, -1), g[4:6], g[6:9], g[9:11]
        q = np.stack([np.stack([qb[0], qb[1]]), np.stack([qb[1], qb[2]])])
        turned = np.einsum("jin,jkn,kln->iln", ma, q, ma)
        hit = np.einsum("ijn,jn->in", q, va)
        out = np.concatenate([
            np.einsum("ijn,jkn->ikn", mb, ma).reshape(4, -1), np.einsum("ijn,jn->in", mb, va) + vb,
            qa + np.stack([turned[0, 0], turned[0, 1], turned[1, 1]]), wa + np.einsum("jin,jn->in", ma, hit + wb),
            (f[11] + (va * hit).sum(axis=0) + 2.0 * (wb * va).sum(axis=0) + g[11])[None]])
        return np.column_stack([out.T.reshape(len(a), -1), a[:, -1] + b[:, -1]])

    one = np.zeros(WIDTH)
    one[[0, 3]] = 1.0
    return Monoid(np.append(np.tile(one, pairs), 0.0), compose)


@F.arrow_udf(DOUBLES)
def _elements(values: pa.Array, grids: pa.Array) -> pa.Array:
    y, offsets = ragged(values)
    grid, _ = ragged(grids)
    grid = grid.reshape(len(values), -1, 2)
    out = np.empty((len(values), grid.shape[1] * WIDTH + 1))
    lengths = np.diff(offsets)
    with np.errstate(all="ignore"):
        for rows in slices(np.maximum(lengths, grid.shape[1] * WIDTH)):
            rows = rows[np.argsort(lengths[rows], kind="stable")]
            start = time.perf_counter_ns()
            mine = grid[rows]
            if (mine == mine[:1]).all():
                mine = mine[:1]
            found = elements(padded(y, offsets, rows, 0.0), lengths[rows], mine[:, :, 0], mine[:, :, 1])
            out[rows, :-1] = found.reshape(len(rows), -1)
            spent = (time.perf_counter_ns() - start) / 1e6
            out[rows, -1] = spent * lengths[rows] / max(1, lengths[rows].sum())
    return lists(out, np.arange(len(out) + 1) * out.shape[1])


@F.arrow_udf(BEST)
def _best(totals: pa.Array, grids: pa.Array, firsts: pa.Array) -> pa.Array:
    """Best pair of a round with its error sum and last state; infinite error where no pair has a finite one."""
    first, offsets = ragged(firsts)
    out = np.empty((len(totals), 6))
    if len(totals):
        total = ragged(totals)[0].reshape(len(totals), -1)
        grid = ragged(grids)[0].reshape(len(totals), -1, 2)
        level = np.array([first[a:b].mean() if b > a else np.nan for a, b in zip(offsets, offsets[1:])])[:, None]
        info = level / 1.1
        m11, m12, m21, m22, v1, v2, q11, q12, q22, w1, w2, k = np.moveaxis(total[:, :-1].reshape(len(totals), -1, WIDTH), 2, 0)
        with np.errstate(all="ignore"):
            error = q11 * level * level + 2 * q12 * level * info + q22 * info * info + 2 * (w1 * level + w2 * info) + k
            error = np.where(np.isfinite(error), error, np.inf)
            i = np.argmin(error, axis=1)[:, None]
            states = m11 * level + m12 * info + v1, m21 * level + m22 * info + v2
        for c, part in enumerate((error, grid[:, :, 0], grid[:, :, 1], *states)):
            out[:, c] = np.take_along_axis(part, i, axis=1)[:, 0]
        out[:, 5] = total[:, -1]
    return pa.StructArray.from_arrays([pa.array(c) for c in out.T], BEST.names)


def _predict(level: Column, info: Column, a0: Column, a1: Column, horizon: Column) -> Column:
    """Levels of the steps ahead, each from the state without an error."""
    def step(state, _):
        return F.struct((state["l"] - (1.0 - a1) * state["c"]).alias("l"), (state["l"] + (1.0 - a0) * state["c"]).alias("c"),
                        F.concat(state["out"], F.array(state["l"])).alias("out"))
    start = F.struct(level.alias("l"), info.alias("c"), F.expr("cast(array() as array<double>)").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), horizon), start, step, lambda s: s["out"])


def forecast_ces(train: DataFrame, keys: list[str], horizon, size: int = CHUNK_ROWS) -> DataFrame:
    """Best pair on a grid over both parameters, then on three finer grids around the best one, and its levels ahead.

    Series of any length: ``size`` affects neither result nor memory by more than rounding.
    """
    chunks, longest = chunk_values(train, keys, size, "ces-chunks")
    stats = materialize(series_stats(chunks, keys).join(first_values(chunks, keys, FIRST_ROWS, longest), keys), "ces-series")
    grid = F.array(*[F.lit(float(v)) for v in first_grid().ravel()])
    usable = stats.where(F.col("rows") >= LEAST_ROWS).select(*keys, "last_chunk", "first_values")
    best, step, given = None, STEP, chunks.withColumn("grid", grid)
    for _ in range(ROUNDS):
        pairs = len(first_grid()) if best is None else 25
        summed = fold(given.select(*keys, "chunk", _elements("x", "grid").alias("element")), keys, composition(pairs), longest, FAN)
        asked = usable.withColumn("grid", grid) if best is None else best
        scored = summed.join(asked, keys).withColumn("now", _best("element", "grid", "first_values"))
        if best is not None:
            better = F.col("now.error") < F.col("best.error")
            kept = F.struct(*[F.when(better, F.col(f"now.{c}")).otherwise(F.col(f"best.{c}")).alias(c) for c in BEST.names[:-1]],
                            (F.col("now.elapsed") + F.col("best.elapsed")).alias("elapsed"))
            scored = scored.withColumn("now", kept)
        step /= 3.0
        around = [F.struct(*[F.greatest(F.lit(low), F.least(F.lit(high), F.col(f"best.a{i}") + d * step)).alias(f"a{i}")
                             for i, (d, (low, high)) in enumerate(zip(ds, BOUNDS))]) for ds in ((x, y) for y in range(-2, 3) for x in range(-2, 3))]
        # A row per series, written: both uses of it in the next round read it instead of running this one again.
        best = materialize(scored.select(*keys, "last_chunk", "first_values", F.col("now").alias("best")).withColumn(
            "grid", F.flatten(F.transform(F.array(*around), lambda s: F.array(s["a0"], s["a1"])))), "ces-round")
        given = to_chunks(chunks, best.select(*keys, "last_chunk", "grid"), keys)
    fitted = stats.join(best.select(*keys, "best"), keys, "left")
    finite = F.col("best.error") < float("inf")
    yhat = F.when(finite, _predict(F.col("best.level"), F.col("best.info"), F.col("best.a0"), F.col("best.a1"), horizon))
    return fit_columns(fitted, keys, failures(yhat, [(F.col("rows") < LEAST_ROWS, f"fewer than {LEAST_ROWS} training rows"),
                                                    (~F.coalesce(finite, F.lit(False)), "no stable smoothing parameters")]),
                       yhat, None, None, F.col("best.elapsed"))
