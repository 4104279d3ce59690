"""GARCH(p, q) on log returns with variance targeting over chunks of a series, rescaled by the last training values.

For one set of coefficients the variances are affine in those before: a chunk is a small affine map per candidate. Composed across chunks
the maps give every chunk its exact incoming variances, a second pass adds up the likelihoods, whatever the length of the series.
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import CHUNK_ROWS, SEED
from tidemark.functions import rng
from tidemark.functions.types import DOUBLES, record
from tidemark.operators.forecast.chunked import failures, fit_columns, series_stats, to_chunks
from tidemark.operators.forecast.replay import tail_replay
from tidemark.operators.scan import Monoid, carry_last, chunk_values, fold, lists, padded, ragged, scan, slices
from tidemark.session import materialize

FAN = 256
LEAST_ROWS = 5
# Persistence, share of the shock terms and weight of the first lag on the first grid; widths of the two finer ones.
PERSISTENCE = (0.3, 0.6, 0.8, 0.9, 0.96, 0.99)
SHARE = (0.03, 0.08, 0.2, 0.4, 0.7)
TILT = (0.25, 0.5, 0.75, 1.0)
WIDTHS = (0.3, 0.1)
MOST_PERSISTENT = 0.999
RETURNS = record(r2=DOUBLES, total=T.DoubleType())
BEST = record(loss=T.DoubleType(), coefficients=DOUBLES)


def candidates(p: int, q: int) -> np.ndarray:
    """Coefficients ``a_1 .. a_p, b_1 .. b_q`` of the first grid, one row each."""
    def shares(k, tilt):
        return [1.0] if k == 1 else [tilt] + [(1.0 - tilt) / (k - 1)] * (k - 1)
    tilts = [TILT if k > 1 else (1.0,) for k in (p, q)]
    return np.array([[total * shock * w for w in shares(p, ta)] + [total * (1.0 - shock) * w for w in shares(q, tb)]
                     for shock in SHARE for total in PERSISTENCE for ta in tilts[0] for tb in tilts[1]])


def around(best: Column, p: int, q: int, width: float) -> Column:
    """``best`` and its coefficients times ``1 - width``, 1 and ``1 + width`` in all combinations; what persists too long is NaN."""
    factors = np.stack([g.ravel() for g in np.meshgrid(*[[1.0 - width, 1.0, 1.0 + width]] * (p + q))], axis=1)
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in factors])
    moved = F.transform(table, lambda f: F.transform(f, lambda x, i: x * F.get(best, i)))
    nan = F.array_repeat(F.lit(float("nan")), p + q)

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return F.concat(best, F.flatten(F.transform(moved, lambda c: F.when(total(c) < MOST_PERSISTENT, c).otherwise(nan))))


def affine(n: int, q: int) -> Monoid:
    """Maps ``x -> B x + v`` of ``q`` variances, ``n`` side by side, and the time spent on them at the end."""
    width = q * q + q

    def compose(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        f, g = (m[:, :-1].reshape(-1, width) for m in (first, second))
        bf, bg = f[:, :q * q].reshape(-1, q, q), g[:, :q * q].reshape(-1, q, q)
        out = np.concatenate([np.einsum("nij,njk->nik", bg, bf).reshape(len(f), -1), np.einsum("nij,nj->ni", bg, f[:, q * q:]) + g[:, q * q:]], axis=1)
        return np.column_stack([out.reshape(len(first), -1), first[:, -1] + second[:, -1]])

    return Monoid(np.append(np.tile(np.append(np.eye(q).ravel(), np.zeros(q)), n), 0.0), compose)


def added(n: int) -> Monoid:
    return Monoid(np.zeros(n), lambda a, b: a + b)


@F.arrow_udf(RETURNS)
def _returns(before: pa.Array, values: pa.Array) -> pa.Array:
    """Squared log returns of a chunk behind those of the values ``before`` it, NaN where there are none, and the sum of its own."""
    flat, offsets = ragged(values)
    earlier = ragged(before)[0].reshape(len(values), -1)
    p, out, total = earlier.shape[1] - 1 if len(values) else 0, [], np.empty(len(values))
    with np.errstate(all="ignore"):
        for i, past in enumerate(earlier):
            r2 = np.diff(np.log(np.append(past, flat[offsets[i]:offsets[i + 1]]))) ** 2
            own = r2[p:] if not np.isnan(past[-1]) else r2[p + 1:]
            out.append(np.append(r2[:p], own))
            total[i] = own.sum()
    return pa.StructArray.from_arrays([pa.array(out, pa.list_(pa.float64())), pa.array(total)], RETURNS.names)


def _variances(r2: np.ndarray, lengths: np.ndarray, c: np.ndarray, target: np.ndarray, p: int, state: list[np.ndarray], visit):
    """Run the recursion over each row of ``r2``, of which the first ``p`` are past; ``lengths`` rise and count the others.

    ``c`` holds candidates, for all rows or for each. ``visit(done, now, s, t)`` sees the rows that are done before a step, those that take it and their variances.
    """
    own = len(c) > 1 or len(r2) == 1
    q = c.shape[2] - p
    omega = target[:, None] * (1.0 - c.sum(axis=2))
    low = 0
    for t in range(int(lengths[-1]) + 1):
        ready = int(np.searchsorted(lengths, t, side="right"))
        now, mine = slice(ready, None), slice(ready, None) if own else slice(None)
        if ready > low:
            visit(slice(low, ready), None, None, t)
            low = ready
        if low == len(r2):
            return
        s = omega[now].copy()
        for i in range(p):
            s += c[mine, :, i] * r2[now, p + t - 1 - i, None]
        for j in range(q):
            s += c[mine, :, p + j] * state[j][now]
        visit(None, now, s, t)
        for j in range(q - 1, 0, -1):
            state[j][now] = state[j - 1][now]
        state[0][now] = s


def _batches(r2: pa.Array, grids: pa.Array, targets: pa.Array, p: int, order: int):
    """Rows of a batch that are handled at once: places, matrix with the past filled in, lengths, candidates and targets."""
    flat, offsets = ragged(r2)
    grid = ragged(grids)[0].reshape(len(r2), -1, order)
    target = targets.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for rows in slices(np.maximum(lengths, grid.shape[1] * 8)):
        rows = rows[np.argsort(lengths[rows], kind="stable")]
        matrix = padded(flat, offsets, rows, 0.0)
        matrix[:, :p] = np.where(np.isnan(matrix[:, :p]), target[rows, None], matrix[:, :p])
        mine = grid[rows]
        yield rows, matrix, lengths[rows] - p, mine[:1] if np.array_equal(mine, np.broadcast_to(mine[:1], mine.shape), equal_nan=True) else mine, target[rows]


def maps(p: int, q: int):
    """Arrow function: the affine maps of a chunk for all candidates."""
    @F.arrow_udf(DOUBLES)
    def run(r2: pa.Array, grids: pa.Array, targets: pa.Array) -> pa.Array:
        out = np.empty((0, 1))
        with np.errstate(all="ignore"):
            for rows, matrix, lengths, c, target in _batches(r2, grids, targets, p, p + q):
                start = time.perf_counter_ns()
                n = c.shape[1]
                out = out if len(out) else np.empty((len(r2), n * (q * q + q) + 1))
                found = np.empty((len(rows), n, q * q + q))
                state = [np.zeros((len(rows), n)) for _ in range(q)]
                power = [np.broadcast_to(np.eye(q)[j], (len(c), n, q)) for j in range(q)]

                def visit(done, now, s, t):
                    nonlocal power
                    if done is not None:
                        mine = done if len(c) > 1 or len(rows) == 1 else slice(None)
                        found[done, :, :q * q] = np.concatenate([m[mine] for m in power], axis=2)
                        found[done, :, q * q:] = np.stack([v[done] for v in state], axis=2)
                    else:
                        power = [sum(c[:, :, p + j, None] * power[j] for j in range(q))] + power[:-1]

                _variances(matrix, lengths, c, target, p, state, visit)
                out[rows, :-1] = found.reshape(len(rows), -1)
                spent = (time.perf_counter_ns() - start) / 1e6
                out[rows, -1] = spent * lengths / max(1, lengths.sum())
        return lists(out, np.arange(len(out) + 1) * out.shape[1])

    return run


def losses(p: int, q: int):
    """Arrow function: what a chunk adds to the negative log-likelihood of all candidates, given the maps before it; the time spent at the end."""
    @F.arrow_udf(DOUBLES)
    def run(r2: pa.Array, grids: pa.Array, targets: pa.Array, before: pa.Array) -> pa.Array:
        out = np.empty((0, 1))
        width = q * q + q
        with np.errstate(all="ignore"):
            for rows, matrix, lengths, c, target in _batches(r2, grids, targets, p, p + q):
                start = time.perf_counter_ns()
                n = c.shape[1]
                out = out if len(out) else np.empty((len(r2), n + 1))
                map_ = ragged(before.take(pa.array(rows)))[0].reshape(len(rows), -1)
                map_ = map_[:, :-1].reshape(len(rows), -1, width)
                entered = target[:, None, None] * map_[:, :, :q * q].reshape(len(rows), -1, q, q).sum(axis=3) + map_[:, :, q * q:]
                state = [np.broadcast_to(entered[:, :, j], (len(rows), n)).copy() for j in range(q)]
                loss = np.zeros((len(rows), n))

                def visit(done, now, s, t):
                    if now is not None:
                        loss[now] += np.log(s) + matrix[now, p + t, None] / s

                _variances(matrix, lengths, c, target, p, state, visit)
                out[rows, :-1] = loss
                spent = (time.perf_counter_ns() - start) / 1e6
                out[rows, -1] = spent * lengths / max(1, lengths.sum())
        return lists(out, np.arange(len(out) + 1) * out.shape[1])

    return run


def _best(order: int):
    @F.arrow_udf(BEST)
    def run(totals: pa.Array, grids: pa.Array) -> pa.Array:
        if not len(totals):
            return pa.StructArray.from_arrays([pa.array([], pa.float64()), pa.array([], pa.list_(pa.float64()))], BEST.names)
        loss = ragged(totals)[0].reshape(len(totals), -1)[:, :-1]
        grid = ragged(grids)[0].reshape(len(totals), -1, order)
        i = np.argmin(np.where(np.isfinite(loss), loss, np.inf), axis=1)
        rows = np.arange(len(i))
        return pa.StructArray.from_arrays([pa.array(loss[rows, i]), lists(grid[rows, i], np.arange(len(i) + 1) * order)], BEST.names)

    return run


def _simulate(horizon: Column, p: int, q: int, shock) -> Column:
    """Returns ahead: ``shock(k) * sigma`` of the last squared returns ``past`` and variances ``state``, both latest first."""
    c = F.col("best.coefficients")
    omega = F.col("target") * (1.0 - F.aggregate(c, F.lit(0.0), lambda s, x: s + x))

    def step(state, k):
        s = omega
        for i in range(p):
            s = s + F.get(c, F.lit(i)) * F.get(state["r2"], F.lit(i))
        for j in range(q):
            s = s + F.get(c, F.lit(p + j)) * F.get(state["s2"], F.lit(j))
        r = shock(k) * F.sqrt(s)
        return F.struct(F.slice(F.concat(F.array(r * r), state["r2"]), 1, p).alias("r2"), F.slice(F.concat(F.array(s), state["s2"]), 1, q).alias("s2"),
                        F.concat(state["out"], F.array(r)).alias("out"))
    start = F.struct(F.reverse("past").alias("r2"), F.col("state").alias("s2"), F.expr("cast(array() as array<double>)").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), horizon), start, step, lambda s: s["out"])


def forecast_garch(train: DataFrame, keys: list[str], horizon, p: int = 2, q: int = 2, cumulative: bool = False,
                   simulate: bool = True, seed: str = SEED, size: int = CHUNK_ROWS) -> DataFrame:
    """Coefficients of the best Gaussian likelihood on a grid and two finer ones around the best; simulated returns scale the last values.

    ``simulate=False`` forecasts the mean return, which is zero, so the last training values are replayed. Series may have any
    length; ``size`` affects neither result nor memory by more than rounding.
    """
    values, longest = chunk_values(train, keys, size, "garch-values")
    last = F.slice(F.concat(F.array_repeat(F.lit(float("nan")), p + 1), "x"), -(p + 1), p + 1)
    before = scan(values.select(*keys, "chunk", last.alias("element")), keys, carry_last(p + 1))
    stats = series_stats(values, keys, F.min(F.array_min("x")).alias("lowest"))
    joined = values.join(before, [*keys, "chunk"]).withColumn("r", _returns("before", "x"))
    chunks = materialize(joined.select(*keys, "chunk", "r.r2", "r.total"), "garch-chunks")
    sums = chunks.groupBy(*keys).agg((F.sum("total") / F.sum(F.size("r2") - p)).alias("target"))
    stats = materialize(stats.join(sums, keys), "garch-series")
    sound = (F.col("rows") >= LEAST_ROWS) & (F.col("lowest") > 0) & (F.col("target") > 0)
    usable = stats.where(sound).select(*keys, "last_chunk", "target")
    first = candidates(p, q)
    asked = usable.withColumn("grid", F.array(*[F.lit(float(v)) for v in first.ravel()]))
    n, spent = len(first), False
    for width in (*WIDTHS, None):
        given = to_chunks(chunks, asked, keys)
        if longest > 1:
            mapped = given.select(*keys, "chunk", maps(p, q)("r2", "grid", "target").alias("element"))
            given = given.join(scan(mapped, keys, affine(n, q), fan=FAN), [*keys, "chunk"])
        else:
            given = given.withColumn("before", F.array(*[F.lit(float(v)) for v in np.append(affine(1, q).identity[:-1], 0.0)]))
        added_up = given.select(*keys, "chunk", losses(p, q)("r2", "grid", "target", "before").alias("element"))
        total = fold(added_up, keys, added(n + 1), longest, FAN)
        scored = total.join(asked, keys).withColumn("best", _best(p + q)("element", "grid"))
        took = F.element_at("element", -1) + (F.col("spent") if spent else F.lit(0.0))
        spent = True
        grid = F.col("best.coefficients") if width is None else around(F.col("best.coefficients"), p, q, width)
        asked = materialize(scored.select(*keys, "last_chunk", "target", took.alias("spent"), "best", grid.alias("grid")), "garch-round")
        n = 3 ** (p + q) + 1
    ends = fold(to_chunks(chunks, asked.select(*keys, "last_chunk", "target", "grid"), keys).select(
        *keys, "chunk", maps(p, q)("r2", "grid", "target").alias("element")), keys, affine(1, q), longest, FAN)
    latest = chunks.join(asked.select(*keys, F.col("last_chunk").alias("chunk")), [*keys, "chunk"]).select(
        *keys, F.slice("r2", -p, p).alias("past"))
    state = F.array(*[sum((F.get("element", F.lit(j * q + k)) for k in range(q)), F.lit(0.0)) * F.col("target") + F.get("element", F.lit(q * q + j))
                      for j in range(q)])
    found = asked.select(*keys, "target", "best", "spent").join(ends, keys).join(latest, keys).withColumn("state", state)
    tail = tail_replay(train.where(F.col("value").isNotNull()), keys, horizon).select(*keys, F.col("yhat").alias("tail"), F.col("error").alias("short"))
    group = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])

    def shock(k):
        return rng.normal(rng.bits(rng.draw_key(seed, "garch", "-", "-", group, k))) if simulate else F.lit(0.0)
    fitted = stats.drop("target").join(found, keys, "left").join(tail, keys, "left").withColumn("returns", _simulate(horizon, p, q, shock))
    if cumulative:
        sums = F.aggregate("returns", F.expr("cast(array() as array<double>)"), lambda a, r: F.concat(
            a, F.array(r + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)))))
        yhat = F.transform(sums, lambda r: F.element_at("tail", -1) * F.exp(r))
    else:
        yhat = F.zip_with("returns", "tail", lambda r, y: F.exp(r) * y)
    reasons = [((F.col("rows") < LEAST_ROWS) | (F.col("lowest") <= 0), f"log returns need at least {LEAST_ROWS} positive training values"),
               (F.col("best").isNull(), "constant series has no returns"), (F.col("short").isNotNull(), "fewer training rows than forecast steps")]
    return fit_columns(fitted, keys, failures(yhat, reasons), yhat, p, q, F.col("spent"))
