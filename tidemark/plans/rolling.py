"""Rolling windows under all scenarios: first-order autoregressions from prefix sums of cross products.

A regression on the row before needs five sums over the pairs of neighbours inside its training rows. Running sums over a series
give them for any window as the difference of two rows, less the one pair that crosses the start. Noise is linear in the value range of
its window, so the sums of a noised window follow from those of values and draws, whatever the range: no row is repeated per
window. Only repairs, which depend on where a window ends, are made of the rows of each window.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ALL_STRENGTHS, CHUNK_ROWS, N_VALID, SCALES, SEED
from tidemark.functions import rng
from tidemark.operators.deviate import add_gaps, add_noise
from tidemark.operators.forecast.arima import forecast_ar1
from tidemark.operators.mitigate import MITIGATIONS
from tidemark.operators.panel import chunk_of
from tidemark.operators.scan import Monoid, scan
from tidemark.session import materialize

KEYS = ["series_id", "col"]
WINDOW_KEYS = [*KEYS, "shift"]
PAIR = ["n", "u", "y", "uy", "uu"]
CROSSED = ["zu", "zy", "zuy", "zz", "uzu", "zzu"]


def sliding_bounds(panel: DataFrame, keys: list[str], n: int, value: str = "real") -> DataFrame:
    """``keys, shift, low_bound, high_bound``: the value range of the ``n`` rows from each position on, for all full windows.

    Blocks of ``n`` rows carry running ranges from their start and from their end; a window is the end of one block and the start of
    the next, so it costs two look-ups whatever ``n`` is.
    """
    blocked = panel.select(*keys, "pos", value).withColumn("_block", chunk_of("pos", n))
    # Both frames grow by one row at a time, the second one from the end: a frame from a row to the end would be quadratic.
    up = Window.partitionBy(*keys, "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "_block").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranged = blocked.select(*keys, F.col("pos").cast("bigint").alias("pos"), *[f(value).over(w).alias(f"_{f.__name__}_{name}") for f in (F.min, F.max) for name, w in (("up", up), ("down", down))])
    ends = ranged.select(*keys, (F.col("pos") - (n - 1)).alias("shift"), F.col("_min_up").alias("_lo"), F.col("_max_up").alias("_hi"))
    starts = ranged.select(*keys, F.col("pos").alias("shift"), "_min_down", "_max_down")
    return starts.join(ends.where("shift >= 0"), [*keys, "shift"]).select(
        *keys, "shift", F.least("_lo", "_min_down").alias("low_bound"), F.greatest("_hi", "_max_down").alias("high_bound"))


def draws(source: str, scale) -> Column:
    """Random bits of a row: the same in every window that holds it."""
    return rng.bits(rng.draw_key(SEED, source, scale, F.col("col"), F.col("series_id"), F.col("pos")))


def _latest(width: int) -> Monoid:
    return Monoid(np.full(width, np.nan), lambda a, b: np.where(np.isnan(b), a, b))


def _sums(width: int) -> Monoid:
    return Monoid(np.zeros(width), lambda a, b: a + b)


def _products(u: Column, y: Column) -> list[Column]:
    return [F.lit(1.0), u, y, u * y, u * u]


def neighbours(panel: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Rows of ``panel(series_id, col, pos, real)`` with ``centre``, value less centre ``x``, draws ``z_k`` of every scale, whether a
    row is there under every scale of gaps (``here_k``), and position, value and draws of the row before: ``prev``, and ``prev_k`` of the last row there.
    """
    centred = panel.join(panel.groupBy(*KEYS).agg(F.avg("real").alias("centre")), KEYS).withColumn("x", F.col("real") - F.col("centre"))
    drawn = centred.withColumns({f"_n{k}": draws("noise", F.lit(s)) for k, s in enumerate(SCALES)} | {f"_g{k}": draws("incompleteness", F.lit(s)) for k, s in enumerate(SCALES)})
    gaps = ALL_STRENGTHS["incompleteness"]
    rows = drawn.select(*KEYS, F.col("pos").cast("bigint").alias("pos"), "real", "centre", "x", chunk_of("pos", size).alias("chunk"),
                        *[rng.normal(F.col(f"_n{k}")).alias(f"z_{k}") for k in range(len(SCALES))],
                        *[(rng.uniform(F.col(f"_g{k}")) >= gaps[s]).alias(f"here_{k}") for k, s in enumerate(SCALES)])
    kinds = {"": F.col("real").isNotNull()} | {f"_{k}": F.col(f"here_{k}") & F.col("real").isNotNull() for k in range(len(SCALES))}
    fields = {kind: ["pos", "x"] + [f"z_{k}" for k in range(len(SCALES))] * (kind == "") for kind in kinds}
    packed = {kind: F.when(there, F.array(*[F.col(f).cast("double") for f in fields[kind]])) for kind, there in kinds.items()}
    earlier = Window.partitionBy(*KEYS, "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns({f"_p{kind}": F.last(v, ignorenulls=True).over(earlier) for kind, v in packed.items()})
    last = rows.groupBy(*KEYS, "chunk").agg(*[F.max_by(v, F.when(v.isNotNull(), F.col("pos"))).alias(f"_l{kind}") for kind, v in packed.items()])
    nan = {kind: F.array_repeat(F.lit(float("nan")), len(f)) for kind, f in fields.items()}
    elements = last.select(*KEYS, "chunk", F.concat(*[F.coalesce(f"_l{kind}", nan[kind]) for kind in kinds]).alias("element"))
    carried = scan(elements, KEYS, _latest(sum(map(len, fields.values()))))
    joined, at, found, out = inside.join(carried, [*KEYS, "chunk"]), 1, {}, {}
    for kind, names in fields.items():
        carried_in = F.when(~F.isnan(F.get("before", F.lit(at - 1))), F.slice("before", at, len(names)))
        found[f"_q{kind}"] = F.coalesce(F.col(f"_p{kind}"), carried_in)
        prev = F.col(f"_q{kind}")
        out[f"prev{kind}"] = F.when(prev.isNotNull(), F.struct(F.get(prev, F.lit(0)).cast("bigint").alias("pos"), *[
            F.get(prev, F.lit(i)).alias(f) for i, f in enumerate(names) if i]))
        at += len(names)
    return joined.withColumns(found).withColumns(out).drop("before", *[f"_p{kind}" for kind in kinds], *found)


def pair_sums() -> dict[str, list[Column]]:
    """Products of a row and the one before it, nought where there is no pair: of the values, with draws, and under gaps."""
    u, y, pair = F.col("prev.x"), F.col("x"), F.col("prev").isNotNull() & F.col("x").isNotNull()
    out = {"real": [F.when(pair, c).otherwise(0.0) for c in _products(u, y)]}
    for k in range(len(SCALES)):
        zu, zy = F.col(f"prev.z_{k}"), F.col(f"z_{k}")
        out[f"noise_{k}"] = [F.when(pair, c).otherwise(0.0) for c in (zu, zy, u * zy + zu * y, zu * zy, u * zu, zu * zu)]
        there = F.col(f"prev_{k}").isNotNull() & F.col(f"here_{k}") & F.col("x").isNotNull()
        out[f"gaps_{k}"] = [F.when(there, c).otherwise(0.0) for c in _products(F.col(f"prev_{k}.x"), y)]
    return out


def prefix_table(rows: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """``rows`` with ``pair``, the products of a row, and ``prefix``, their sums over all rows before it, as arrays in order of `pair_sums`.

    Sums run inside a chunk and are lifted by those of all earlier chunks.
    """
    columns = [c for part in pair_sums().values() for c in part]
    names = [f"_s{i}" for i in range(len(columns))]
    flat = rows.withColumns(dict(zip(names, columns)))
    before = Window.partitionBy(*KEYS, "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    totals = flat.groupBy(*KEYS, "chunk").agg(F.array(*[F.sum(n) for n in names]).alias("element"))
    lifted = scan(totals, KEYS, _sums(len(names)))
    running = flat.withColumns({f"_r{n}": F.coalesce(F.sum(n).over(before), F.lit(0.0)) for n in names})
    prefix = F.array(*[F.col(f"_r{n}") + F.get("before", F.lit(i)) for i, n in enumerate(names)])
    return running.join(lifted, [*KEYS, "chunk"]).withColumns({"pair": F.array(*names), "prefix": prefix}).drop("before", *names, *[f"_r{n}" for n in names])


def _positions() -> dict[str, int]:
    at, out = 0, {}
    for name, part in pair_sums().items():
        out[name] = at
        at += len(part)
    return out


def autoregressions(rows: DataFrame, n_valid: int) -> DataFrame:
    """``yhat``, steps ``delay + 1 .. delay + n_valid`` ahead of ``last`` by slope and intercept of the pair sums; null where values do not vary."""
    n, u, y, uy, uu = (F.col(c) for c in PAIR)
    sloped = rows.withColumn("_phi", F.try_divide(uy - F.try_divide(u * y, n), F.nullif(uu - F.try_divide(u * u, n), F.lit(0.0))))
    phi, c, last = F.col("_phi"), F.col("_c"), F.col("last")

    def ahead(h):
        power = F.pow(phi, h.cast("double"))
        return F.when(phi == 1.0, c * h + last).otherwise(c * F.try_divide(1.0 - power, F.nullif(1.0 - phi, F.lit(0.0))) + power * last)
    steps = F.transform(F.sequence(F.col("delay") + 1, F.col("delay") + n_valid), ahead)
    fitted = sloped.withColumn("_c", F.try_divide(y - phi * u, n))
    return fitted.withColumn("yhat", F.when(phi.isNotNull(), steps)).drop("_phi", "_c", "last", *PAIR)


def _errors(yhat: Column, actual: Column) -> list[Column]:
    gaps = F.zip_with(yhat, actual, lambda a, b: a - b)
    shares = F.filter(F.zip_with(yhat, actual, lambda a, b: F.try_divide(F.abs(a - b), F.nullif(F.abs(b), F.lit(0.0)))), lambda s: s.isNotNull())

    def mean(xs):
        return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), F.size(xs).cast("double"))
    return [F.sqrt(mean(F.transform(gaps, lambda g: g * g))).alias("rmse"), mean(F.transform(gaps, lambda g: F.abs(g))).alias("mae"),
            (100.0 * mean(shares)).alias("mape"), F.size(shares).cast("bigint").alias("mape_n")]


def _window_edges(panel: DataFrame, shifts: list[int], n: int, n_valid: int, size: int) -> DataFrame:
    """One row per series, column and full window: sums and last rows of its training parts, its validation values, its range."""
    border = n - n_valid
    delays = [0, *ALL_STRENGTHS["timeliness"].values()]
    rows = prefix_table(neighbours(panel, size), size)
    wanted = F.array(*[F.lit(int(s)).cast("bigint") for s in shifts])
    ends = {f"end_{d}": border - int(d) for d in delays}
    labels = F.array(F.struct(F.lit("start").alias("role"), F.lit(0).cast("bigint").alias("at")), *[
        F.struct(F.lit(name).alias("role"), F.lit(at).cast("bigint").alias("at")) for name, at in ends.items()])
    edges = F.flatten(F.transform(labels, lambda e: F.transform(F.filter(wanted, lambda s: s + e["at"] == F.col("pos")), lambda s: F.struct(
        e["role"].alias("role"), s.alias("shift")))))
    # Under gaps the pair that crosses a start may end some rows behind it.
    crossings = F.flatten(F.array(*[F.when(F.col(f"here_{k}"), F.transform(F.filter(
        wanted, lambda s: (F.col(f"prev_{k}.pos") < s) & (s <= F.col("pos"))), lambda s: F.struct(F.lit(f"cross_{k}").alias("role"), s.alias("shift")))).otherwise(
            F.expr("cast(array() as array<struct<role: string, shift: bigint>>)")) for k in range(len(SCALES))]))
    crossings = F.coalesce(crossings, F.expr("cast(array() as array<struct<role: string, shift: bigint>>)"))
    values = F.transform(F.filter(wanted, lambda s: (F.col("pos") >= s + border) & (F.col("pos") < s + n)), lambda s: F.struct(
        F.lit("valid").alias("role"), s.alias("shift")))
    marked = rows.select(*KEYS, "pos", "real", "centre", "pair", "prefix", "prev", *[f"prev_{k}" for k in range(len(SCALES))],
                         F.inline(F.concat(edges, crossings, values)))
    role = F.col("role")

    def one(name, column):
        return F.first(F.when(role == name, column), ignorenulls=True)
    end_row = F.struct("prefix", "prev", *[f"prev_{k}" for k in range(len(SCALES))])
    listed = F.array_sort(F.collect_list(F.when(role == "valid", F.struct("pos", "real"))))
    per_window = marked.groupBy(*WINDOW_KEYS).agg(
        F.first("centre").alias("centre"), one("start", F.col("prefix")).alias("start"), one("start", F.col("pair")).alias("first_pair"),
        *[one(name, end_row).alias(name) for name in ends], *[one(f"cross_{k}", F.col("pair")).alias(f"cross_{k}") for k in range(len(SCALES))],
        F.transform(listed, lambda v: v["real"]).alias("actual"))
    return per_window.where(F.size("actual") == n_valid).join(sliding_bounds(panel, KEYS, n), WINDOW_KEYS)


def _window_sums(end: str, kind: str, crossing: Column) -> list[Column]:
    at, size = _positions()[kind], len(pair_sums()[kind])
    return [F.get(F.col(f"{end}.prefix"), F.lit(i)) - F.get("start", F.lit(i)) - F.coalesce(F.get(crossing, F.lit(i)), F.lit(0.0)) for i in range(at, at + size)]


def unrepaired(windows: DataFrame, n_valid: int) -> DataFrame:
    """Forecasts of the ten scenarios without a repair, each from the sums of a window."""
    ends = sorted({0, *map(int, ALL_STRENGTHS["timeliness"].values())})
    sums = {f"_real_{d}": _window_sums(f"end_{d}", "real", F.col("first_pair")) for d in ends}
    sums |= {f"_noise_{k}": _window_sums("end_0", f"noise_{k}", F.col("first_pair")) for k in range(len(SCALES))}
    sums |= {f"_gaps_{k}": _window_sums("end_0", f"gaps_{k}", F.col(f"cross_{k}")) for k in range(len(SCALES))}
    spread = {f"_c_{k}": F.lit(0.01 * ALL_STRENGTHS["noise"][s]) * (F.col("high_bound") - F.col("low_bound")) for k, s in enumerate(SCALES)}
    rows = windows.withColumns({name: F.array(*parts) for name, parts in sums.items()} | spread)

    def of(name):
        return [F.get(name, F.lit(i)) for i in range(len(sums[name]))]

    def kind(source, scale, delay, pair, last):
        return F.struct(F.lit(source).alias("source"), F.lit(scale).alias("scale"), F.lit("N").alias("improve"), F.lit(delay).alias("delay"),
                        *[x.alias(name) for name, x in zip(PAIR, pair)], last.alias("last"))
    n, u, y, uy, uu = of("_real_0")
    found = [kind("none", "-", 0, (n, u, y, uy, uu), F.col("end_0.prev.x"))]
    for k, scale in enumerate(SCALES):
        c, d = F.col(f"_c_{k}"), int(ALL_STRENGTHS["timeliness"][scale])
        zu, zy, zuy, zz, uzu, zzu = of(f"_noise_{k}")
        noised = (n, u + c * zu, y + c * zy, uy + c * zuy + c * c * zz, uu + 2.0 * c * uzu + c * c * zzu)
        found.append(kind("noise", scale, 0, noised, F.col("end_0.prev.x") + c * F.col(f"end_0.prev.z_{k}")))
        last = F.when(F.col(f"end_0.prev_{k}.pos") >= F.col("shift"), F.col(f"end_0.prev_{k}.x"))
        found.append(kind("incompleteness", scale, 0, of(f"_gaps_{k}"), last))
        found.append(kind("timeliness", scale, d, of(f"_real_{d}"), F.col(f"end_{d}.prev.x")))
    fitted = autoregressions(rows.select(*WINDOW_KEYS, "centre", "actual", F.inline(F.array(*found))), n_valid)
    moved = F.transform("yhat", lambda y: y + F.col("centre"))
    return fitted.select(*WINDOW_KEYS, "source", "scale", "improve", moved.alias("yhat"), "actual")


def repaired(panel: DataFrame, windows: DataFrame, shifts: list[int], n: int, n_valid: int, size: int) -> DataFrame:
    """Forecasts of the six repaired scenarios, from the rows of each window."""
    wanted = F.array(*[F.lit(int(s)).cast("bigint") for s in shifts])
    held = F.filter(wanted, lambda s: (s <= F.col("pos")) & (F.col("pos") < s + n))
    rows = panel.withColumn("pos", F.col("pos").cast("bigint")).select(*KEYS, "pos", "real", F.explode(held).alias("shift"))
    ranged = rows.join(windows.select(*WINDOW_KEYS, "low_bound", "high_bound"), WINDOW_KEYS).withColumn("scale", F.explode(F.array(*map(F.lit, SCALES))))
    out = None
    for source, method in (("noise", add_noise), ("incompleteness", add_gaps)):
        strength = F.lit(0.0)
        for s in SCALES:
            strength = F.when(F.col("scale") == s, ALL_STRENGTHS[source][s]).otherwise(strength)
        drawn = ranged.withColumns({"_bits": draws(source, F.col("scale")), "strength": strength})
        value = method(F.col("real"), F.col("strength"), F.col("_bits"), F.col("low_bound"), F.col("high_bound"))
        damaged = drawn.select(*WINDOW_KEYS, "scale", (F.col("pos") - F.col("shift")).alias("pos"), value.alias("value"))
        fixed = MITIGATIONS[source](damaged, [*WINDOW_KEYS, "scale"], size)
        train = fixed.where((F.col("pos") < n - n_valid) & F.col("value").isNotNull())
        fits = forecast_ar1(train, [*WINDOW_KEYS, "scale"], F.lit(n_valid)).select(
            *WINDOW_KEYS, F.lit(source).alias("source"), "scale", F.lit("Y").alias("improve"), "yhat")
        out = fits if out is None else out.unionByName(fits)
    return out.join(windows.select(*WINDOW_KEYS, "actual"), WINDOW_KEYS)


def rolling_scenarios(panel: DataFrame, shifts: list[int], n: int, n_valid: int = N_VALID, size: int = CHUNK_ROWS) -> DataFrame:
    """Errors of first-order autoregressions over windows of ``n`` rows at every shift, under all sixteen scenarios.

    ``series_id, col, shift, source, scale, improve, n, rmse, mae, mape, mape_n, reason``; ``panel`` is ``series_id, col, pos, real``, without holes
    in ``pos``. Noise is spread over the range of each window; a row's draws are the same in all windows. A window that the series does not
    fill is one row without a scenario, with a reason.
    """
    panel = panel.select(*KEYS, "pos", "real")
    # A row per window: written, as all that follows reads it.
    windows = materialize(_window_edges(panel, shifts, n, n_valid, size), "rolling-windows")
    made = unrepaired(windows, n_valid).unionByName(repaired(panel, windows, shifts, n, n_valid, size))
    scored = made.select(*WINDOW_KEYS, "source", "scale", "improve", F.size("actual").cast("bigint").alias("n"), *_errors(F.col("yhat"), F.col("actual")),
                         F.when(F.col("yhat").isNull(), F.lit("training values do not vary")).alias("reason"))
    sizes = panel.groupBy(*KEYS).agg((F.max("pos") + 1).alias("rows"))
    asked = sizes.withColumn("shift", F.explode(F.array(*[F.lit(int(s)).cast("bigint") for s in shifts])))
    short = asked.where(F.col("shift") + n > F.col("rows")).select(
        *WINDOW_KEYS, *[F.lit(None).cast("string").alias(c) for c in ("source", "scale", "improve")], F.lit(0).cast("bigint").alias("n"),
        *[F.lit(None).cast("double").alias(c) for c in ("rmse", "mae", "mape")], F.lit(0).cast("bigint").alias("mape_n"),
        F.format_string(f"window of {n} rows, series has %d from there on", F.greatest(F.col("rows") - F.col("shift"), F.lit(0))).alias("reason"))
    return scored.unionByName(short)
