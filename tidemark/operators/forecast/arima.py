"""Autoregressive models by regression on lags.

Spark cuts the series into chunks with a look-back, and numpy reduces each chunk to sums: means, parts of the
stationarity statistic, cross products of lags. Spark adds the sums up per series, so no task holds a whole series,
and the remaining systems of at most a dozen unknowns are solved for many series at a time.

Order search follows Hannan and Rissanen (1982): residuals of a long autoregression stand in for the unknown
shocks, then every (p, q) is one least-squares problem inside the same cross-product matrix.
"""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import CHUNK_ROWS
from tidemark.functions.types import DOUBLES, record
from tidemark.operators.features import with_lags
from tidemark.operators.forecast.arrays import FIT, finite_or_error, fit_frame, to_fit
from tidemark.operators.panel import attach, chunk_arrays, renumber, running_before, with_halo
from tidemark.session import materialize

# Search bounds of the order, and the 5 % point of the level-stationarity test
# (Kwiatkowski, Phillips, Schmidt and Shin 1992).
MAX_P = 5
MAX_Q = 5
MAX_ORDER = 8
MAX_D = 2
KPSS_CRITICAL = 0.463

LONG_LAGS = 12
KPSS_LAGS = 12

# Series that are solved at once inside a task, whatever the size of the batches that Spark hands over.
SERIES = 512

# Rows a chunk needs from the one before it: second differences, the long autoregression and lags of its residuals.
LOOK_BACK = MAX_D + LONG_LAGS + max(MAX_P, MAX_Q)


def forecast_ar1(train: DataFrame, keys: list[str], horizon) -> DataFrame:
    """First-order autoregression: slope and intercept of a value on the one before, iterated ``horizon`` steps."""
    dense = renumber(train.select(*keys, "pos", "value"), keys).withColumn("dense", F.col("pos"))
    lagged = with_lags(dense, keys, [1], "value")
    fit = lagged.groupBy(*keys).agg(
        F.regr_slope("value", "lag_1").alias("phi"),
        F.regr_intercept("value", "lag_1").alias("c"),
        F.max_by("value", "dense").alias("last"),
        F.max("dense").alias("last_train_pos"),
    )
    phi, c, last = F.col("phi"), F.col("c"), F.col("last")

    def ahead(h):
        power = F.pow(phi, h.cast("double"))
        geometric = c * F.try_divide(F.lit(1.0) - power, F.nullif(F.lit(1.0) - phi, F.lit(0.0)))
        return F.when(phi == 1.0, c * h + last).otherwise(geometric + power * last)

    steps = F.transform(F.sequence(F.lit(1), horizon), ahead)
    usable = phi.isNotNull()
    return fit.select(
        *keys, F.when(usable, steps).alias("yhat"), F.lit(1).alias("p"), F.lit(0).alias("q"),
        F.lit(0.0).alias("prepare_ms"), F.lit(0.0).alias("fit_ms"), F.lit(0.0).alias("predict_ms"),
        F.when(~usable, F.lit("training values do not vary")).alias("error"), "last_train_pos",
    )


def value_chunks(train: DataFrame, keys: list[str], size: int = CHUNK_ROWS) -> DataFrame:
    """One row per (keys, chunk): ``v``, the values of the chunk after ``skip`` rows of the chunk before it."""
    dense = renumber(train.select(*keys, "pos", "value"), keys, size)
    grouped = chunk_arrays(with_halo(dense, LOOK_BACK, 0, size), keys, ["pos", "value", "core"])
    return grouped.filter(F.exists("a", lambda s: s["core"])).select(
        *keys, "chunk",
        F.transform("a", lambda s: s["value"]).alias("v"),
        F.size(F.filter("a", lambda s: ~s["core"])).alias("skip"),
    )


def differenced(v, skip: int, d: int) -> tuple[np.ndarray, int]:
    """Differences of order ``d`` of a chunk and the index of the first one that belongs to the chunk itself."""
    return np.diff(np.asarray(v, dtype=float), n=d), max(int(skip) - d, 0)


@F.pandas_udf(DOUBLES)
def _sums(v: pd.Series, skip: pd.Series, max_d: pd.Series) -> pd.Series:
    """Count and sum of the own values of a chunk, for every difference."""
    out = []
    for values, s, top in zip(v, skip, max_d):
        own = [w[at:] for w, at in (differenced(values, s, d) for d in range(top + 1))]
        out.append(np.array([x for w in own for x in (len(w), w.sum())], float))
    return pd.Series(out)


@F.pandas_udf(DOUBLES)
def _level_parts(v: pd.Series, skip: pd.Series, means: pd.Series) -> pd.Series:
    """Parts of the stationarity statistic of a chunk, for every difference.

    Per difference: number, sum, sum of the running sums, sum of their squares, then products at lags 0 .. 12.
    """
    out = []
    for values, s, mean in zip(v, skip, means):
        parts = []
        for d, m in enumerate(mean):
            w, at = differenced(values, s, d)
            e = w - m
            own = e[at:]
            run = np.cumsum(own)
            parts += [len(own), own.sum(), run.sum(), (run * run).sum()]
            for k in range(KPSS_LAGS + 1):
                back = max(at - k, 0)
                parts.append((e[back + k :] * e[back : len(e) - k]).sum() if len(e) > k else 0.0)
        out.append(np.array(parts, float))
    return pd.Series(out)


def sum_arrays(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Element-wise sum of equally long arrays per group."""
    parts = df.select(*keys, F.posexplode(column).alias("_i", "_x"))
    sums = parts.groupBy(*keys, "_i").agg(F.sum("_x").alias("_x"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_x")))
    return sums.groupBy(*keys).agg(F.transform(ordered, lambda s: s["_x"]).alias(column))


def choose_difference(chunks: DataFrame, keys: list[str], max_d: int, fixed: bool,
                      size: int = CHUNK_ROWS) -> DataFrame:
    """Smallest difference that passes the level-stationarity test: ``keys, d, mean, rows``.

    Running sums of a chunk start at zero; with the total ``b`` of all earlier chunks their squares add up to
    ``sum(c^2) + 2 b sum(c) + n b^2``, so chunks need not be visited in order.
    """
    sums = sum_arrays(chunks.select(*keys, _sums("v", "skip", F.lit(max_d)).alias("s")), keys, "s")
    means = F.transform(F.sequence(F.lit(0), F.lit(max_d)),
                        lambda d: F.coalesce(F.try_divide(F.get("s", d * 2 + 1), F.get("s", d * 2)), F.lit(0.0)))
    stats = sums.select(*keys, means.alias("means"), F.col("s")[0].cast("bigint").alias("rows"))
    if fixed:
        return stats.select(*keys, F.lit(max_d).alias("d"), F.col("means")[max_d].alias("mean"), "rows")
    width = 4 + KPSS_LAGS + 1
    parts = attach(chunks, stats, keys, size).select(
        *keys, "chunk", _level_parts("v", "skip", "means").alias("parts"),
    )
    per_d = F.transform(F.sequence(F.lit(0), F.lit(max_d)), lambda d: F.slice("parts", d * width + 1, F.lit(width)))
    rows = parts.select(*keys, "chunk", F.posexplode(per_d).alias("d", "x")).withColumn("_sum", F.col("x")[1])
    by = [*keys, "d"]
    before = running_before(rows.select(*by, "chunk", "_sum"), by, "_sum", "b").drop("_sum")
    x, b = F.col("x"), F.col("b")
    totals = rows.join(before, [*by, "chunk"]).groupBy(*by).agg(
        F.sum(x[0]).alias("n"),
        F.sum(x[3] + F.lit(2.0) * b * x[2] + x[0] * b * b).alias("s"),
        *[F.sum(x[4 + k]).alias(f"g{k}") for k in range(KPSS_LAGS + 1)],
    )
    n = F.col("n")
    bandwidth = F.least(F.lit(KPSS_LAGS), F.floor(F.lit(4.0) * F.pow(n / F.lit(100.0), F.lit(0.25))))
    long_run = F.col("g0")
    for k in range(1, KPSS_LAGS + 1):
        weight = F.lit(2.0) * (F.lit(1.0) - F.lit(float(k)) / (bandwidth + F.lit(1.0)))
        long_run = long_run + F.when(bandwidth >= k, weight * F.col(f"g{k}")).otherwise(F.lit(0.0))
    stat = F.try_divide(F.col("s"), n * F.nullif(long_run, F.lit(0.0)))
    passed = F.coalesce(stat, F.lit(0.0)) < KPSS_CRITICAL
    chosen = totals.groupBy(*keys).agg(F.coalesce(F.min(F.when(passed, F.col("d"))), F.lit(max_d)).alias("d"))
    return chosen.join(stats, keys).select(*keys, "d", F.get("means", F.col("d")).alias("mean"), "rows")


def upper(x: np.ndarray) -> np.ndarray:
    """Upper triangle, row by row, of the cross products of the columns of ``x``; the row count goes first."""
    full = x.T @ x
    return np.concatenate([[float(len(x))], full[np.triu_indices(full.shape[0])]])


def lag_columns(x: np.ndarray, first: int, last: int, lags: int) -> list[np.ndarray]:
    """Columns of ``x`` delayed by 1 .. ``lags`` for the rows ``first <= t < last``."""
    return [x[first - k : last - k] for k in range(1, lags + 1)]


@F.pandas_udf(DOUBLES)
def _long_products(v: pd.Series, skip: pd.Series, d: pd.Series, mean: pd.Series) -> pd.Series:
    """Cross products of the long autoregression over the own rows of a chunk."""
    out = []
    for values, s, order, m in zip(v, skip, d, mean):
        w, at = differenced(values, s, int(order))
        w = w - m
        first, last = min(max(at, LONG_LAGS), len(w)), len(w)
        if first < LONG_LAGS:
            out.append(np.zeros(1 + (LONG_LAGS + 2) * (LONG_LAGS + 3) // 2))
            continue
        out.append(upper(np.column_stack([np.ones(last - first), *lag_columns(w, first, last, LONG_LAGS), w[first:]])))
    return pd.Series(out)


def short_products(max_p: int, max_q: int):
    size = 2 + max_p + max_q
    kept = max(max_p, max_q, 1)

    @F.pandas_udf(record(products=DOUBLES, w=DOUBLES, e=DOUBLES))
    def run(v: pd.Series, skip: pd.Series, d: pd.Series, mean: pd.Series, phi: pd.Series) -> pd.DataFrame:
        """Residuals of the long autoregression and cross products with their lags; also the last values."""
        products, tail_w, tail_e = [], [], []
        for values, s, order, m, b in zip(v, skip, d, mean, phi):
            w, at = differenced(values, s, int(order))
            w = w - m
            e = np.zeros(len(w))
            if len(w) > LONG_LAGS:
                lags = np.column_stack([np.ones(len(w) - LONG_LAGS), *lag_columns(w, LONG_LAGS, len(w), LONG_LAGS)])
                e[LONG_LAGS:] = w[LONG_LAGS:] - lags @ np.asarray(b, dtype=float)
            begin = max(at, LONG_LAGS + max_q if max_q else max_p)
            first, last = min(begin, len(w)), len(w)
            if first < begin:
                products.append(np.zeros(1 + size * (size + 1) // 2))
            else:
                x = [np.ones(last - first), *lag_columns(w, first, last, max_p), *lag_columns(e, first, last, max_q)]
                products.append(upper(np.column_stack([*x, w[first:last]])))
            tail_w.append(w[-kept:])
            tail_e.append(e[-kept:])
        return pd.DataFrame({"products": products, "w": tail_w, "e": tail_e})

    return run


def full_matrices(sums: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric matrices and row counts back from summed :func:`upper` arrays."""
    flat = np.array([np.asarray(m, dtype=float) for m in sums])
    out = np.zeros((len(flat), size, size))
    r, c = np.triu_indices(size)
    out[:, r, c] = flat[:, 1:]
    out[:, c, r] = out[:, r, c]
    return out, flat[:, 0]


def solve_all(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least-squares solutions of many small normal equations; near-singular systems take the shortest solution."""
    return np.einsum("bij,bj->bi", np.linalg.pinv(gram, rcond=1e-12, hermitian=True), right)


@F.pandas_udf(DOUBLES)
def _long_solution(products: pd.Series) -> pd.Series:
    """Intercept and lag coefficients of the long autoregression."""
    out = np.zeros((len(products), LONG_LAGS + 1))
    for lo in range(0, len(products), SERIES):
        full, n = full_matrices(products.iloc[lo : lo + SERIES], LONG_LAGS + 2)
        # A lag needs a few rows to be estimated from: short series use fewer of them.
        usable = np.clip(n // 6, 1, LONG_LAGS).astype(int)
        for m in np.unique(usable):
            of = np.flatnonzero(usable == m)
            out[lo + of, : m + 1] = solve_all(full[of, : m + 1, : m + 1], full[of, : m + 1, -1])
    return pd.Series(list(out))


def explosive(coefficients: np.ndarray) -> np.ndarray:
    """Whether the recursion with these lag coefficients grows without bound."""
    rows, k = coefficients.shape
    if k == 0:
        return np.zeros(rows, dtype=bool)
    companion = np.zeros((rows, k, k))
    companion[:, 0, :] = coefficients
    companion[:, np.arange(1, k), np.arange(k - 1)] = 1.0
    return np.abs(np.linalg.eigvals(companion)).max(axis=1) >= 0.9999


def best_orders(full: np.ndarray, n: np.ndarray, orders, max_p: int, max_q: int):
    """Coefficients, order and criterion of the best (p, q) of every group."""
    rows = len(full)
    best = np.full(rows, np.inf)
    chosen = np.zeros((rows, 2), dtype=int)
    coef = np.zeros((rows, 1 + max_p + max_q))
    total = full[:, -1, -1]
    for p, q in orders:
        pick = [0, *range(1, 1 + p), *range(1 + max_p, 1 + max_p + q)]
        gram, right = full[:, pick][:, :, pick], full[:, pick, -1]
        b = solve_all(gram, right)
        sse = np.maximum(total - (b * right).sum(axis=1), 1e-12 * np.maximum(total, 1e-300))
        k = p + q + 2
        with np.errstate(divide="ignore", invalid="ignore"):
            score = n * np.log(sse / n) + 2.0 * k + 2.0 * k * (k + 1) / (n - k - 1)
        bad = (n - k - 1 <= 0) | ~np.isfinite(score) | explosive(b[:, 1 : 1 + p]) | explosive(-b[:, 1 + p :])
        if len(orders) == 1 or (p, q) == (0, 0):
            bad = ~np.isfinite(b).all(axis=1)
            score = np.where(np.isfinite(score), score, np.finfo(float).max)
        better = ~bad & (score < best)
        best[better], chosen[better] = score[better], (p, q)
        coef[better] = 0.0
        coef[np.ix_(better, pick)] = b[better]
    return best, chosen, coef


def select_and_forecast(orders, max_p: int, max_q: int):
    def solved(products: pd.Series, tail_w: pd.Series, tail_e: pd.Series, mean: pd.Series, d: pd.Series,
               tail_v: pd.Series, horizons: pd.Series) -> pd.DataFrame:
        start = time.perf_counter_ns()
        full, n = full_matrices(products, 2 + max_p + max_q)
        ready = time.perf_counter_ns()
        score, chosen, coef = best_orders(full, n, orders, max_p, max_q)
        fitted = time.perf_counter_ns()
        out = fit_frame(len(n))
        for i in range(len(n)):
            if not np.isfinite(score[i]):
                out["error"][i] = "too few training rows for any order"
                continue
            w, e = list(np.asarray(tail_w[i], dtype=float)), list(np.nan_to_num(np.asarray(tail_e[i], dtype=float)))
            ar, ma = coef[i, 1 : 1 + max_p], coef[i, 1 + max_p :]
            previous, level = ([np.nan, *tail_v[i]])[-2:]
            yhat = np.empty(int(horizons[i]))
            for h in range(len(yhat)):
                step = coef[i, 0] + sum(ar[j] * w[-1 - j] for j in range(min(max_p, len(w))))
                step += sum(ma[j] * e[-1 - j] for j in range(min(max_q, len(e))))
                w.append(step)
                e.append(0.0)
                change = step + mean[i]
                value = (change, level + change, 2.0 * level - previous + change)[int(d[i])]
                level, previous = value, level
                yhat[h] = value
            finite_or_error(out, i, yhat)
            out["p"][i], out["q"][i] = int(chosen[i, 0]), int(chosen[i, 1])
        done = time.perf_counter_ns()
        for name, span in (("prepare_ms", ready - start), ("fit_ms", fitted - ready), ("predict_ms", done - fitted)):
            out[name] = [span / 1e6 / len(n)] * len(n)
        return to_fit(out)

    @F.pandas_udf(FIT)
    def run(products: pd.Series, tail_w: pd.Series, tail_e: pd.Series, mean: pd.Series, d: pd.Series,
            tail_v: pd.Series, horizons: pd.Series) -> pd.DataFrame:
        given = (products, tail_w, tail_e, mean, d, tail_v, horizons)
        parts = [solved(*[x.iloc[lo : lo + SERIES].reset_index(drop=True) for x in given]) for lo in range(0, len(products), SERIES)]
        return pd.concat(parts, ignore_index=True) if parts else to_fit(fit_frame(0))

    return run


def forecast_arima(train: DataFrame, keys: list[str], horizon, order: tuple | None = None, max_p: int = MAX_P,
                   max_q: int = MAX_Q, max_order: int = MAX_ORDER, max_d: int = MAX_D,
                   size: int = CHUNK_ROWS) -> DataFrame:
    """Forecast with the best (p, d, q) per group, or with a fixed ``order``.

    Refitting a pure autoregression on its own predictions does not change its least-squares fit (those rows have zero
    residual), so its rolling forecast is this same recursion. With moving-average terms a refit would change the fit;
    a rolling forecast is then a recursion at fixed coefficients.
    """
    if order is None:
        orders = [(p, q) for p in range(max_p + 1) for q in range(max_q + 1) if p + q <= max_order]
    else:
        max_p, max_d, max_q = order
        orders = [(max_p, max_q)]
    if max_d > MAX_D or max(max_p, max_q) > max(MAX_P, MAX_Q):
        raise ValueError(f"orders are limited to p, q <= {max(MAX_P, MAX_Q)} and d <= {MAX_D}")
    # Read by several passes below: written once, so that no pass repeats the work before it.
    chunks = materialize(value_chunks(train, keys, size), "chunks")
    chosen = choose_difference(chunks, keys, max_d, fixed=order is not None, size=size)
    ready = materialize(attach(chunks, chosen, keys, size), "centred")
    parts = ready.select(*keys, _long_products("v", "skip", "d", "mean").alias("products"))
    # Written, so that a task runs one Python worker and not one for this and one for what reads it.
    phi = materialize(sum_arrays(parts, keys, "products").select(*keys, _long_solution("products").alias("phi")), "long")
    sizes = ready.groupBy(*keys).agg(F.max("rows").alias("rows"))
    with_phi = attach(ready.drop("rows"), phi.join(sizes, keys), keys, size)

    run = short_products(max_p, max_q)
    fits = materialize(with_phi.select(*keys, "chunk", "d", "mean", F.slice("v", -2, 2).alias("tail_v"),
                                       run("v", "skip", "d", "mean", "phi").alias("x")), "products")
    last = fits.groupBy(*keys).agg(
        F.max_by(F.struct("d", "mean", "tail_v", F.col("x.w").alias("w"), F.col("x.e").alias("e")), "chunk").alias("end")
    )
    sums = sum_arrays(fits.select(*keys, F.col("x.products").alias("products")), keys, "products")
    fit = select_and_forecast(orders, max_p, max_q)(
        "products", "end.w", "end.e", "end.mean", "end.d", "end.tail_v", horizon)
    positions = train.groupBy(*keys).agg(F.max("pos").alias("last_train_pos"))
    return sums.join(last, keys).withColumn("fit", fit).join(positions, keys).select(
        *keys, "fit.yhat", "fit.p", "fit.q", "fit.prepare_ms", "fit.fit_ms", "fit.predict_ms", "fit.error",
        "last_train_pos", F.col("end.d").alias("d"),
    )
