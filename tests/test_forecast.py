import numpy as np
import pandas as pd
import pytest
from helpers import frame, long_panel, values_of
from pyspark.sql import functions as F

from tidemark.operators.forecast import METHODS, forecast_panel, forecast_rows

KEYS = ["series_id", "col"]


def ar1(n, phi, c, seed):
    rng = np.random.default_rng(seed)
    y = [c / (1 - phi)]
    for _ in range(n - 1):
        y.append(c + phi * y[-1] + rng.normal())
    return np.array(y)


@pytest.fixture(scope="module")
def panel(spark):
    series = {"a": ar1(300, 0.7, 30, 1), "b": 50 + ar1(250, 0.3, 1, 2).cumsum() * 0.1, "c": 80 + np.sin(np.arange(200) / 5)}
    return long_panel(spark, series, name="value").withColumn("dt", F.date_add(F.lit("2020-01-01").cast("date"), F.col("pos"))).cache()


def test_every_method_returns_the_horizon(spark, panel):
    for method in METHODS:
        params = {"longest": 6, "trees": 5} if method == "gbt" else {}
        rows = frame(forecast_rows(forecast_panel(panel, method, 6, KEYS, **params), KEYS), "series_id", "step")
        assert list(rows.groupby("series_id").size()) == [6, 6, 6], method
        assert np.isfinite(rows["yhat"]).all(), method
        assert list(rows["step"][:6]) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        forecast_panel(panel, "nothing", 6, KEYS)


def test_ar1_by_hand(spark, panel):
    y = np.array(values_of(panel.filter("series_id = 'a'"), "value", "pos"))
    phi, c = np.polyfit(y[:-1], y[1:], 1)
    want, last = [], y[-1]
    for _ in range(4):
        last = c + phi * last
        want.append(last)
    found = forecast_rows(forecast_panel(panel.filter("series_id = 'a'"), "ar1", 4, KEYS), KEYS)
    assert values_of(found, "yhat", "step") == pytest.approx(want, abs=1e-8)
    fixed = forecast_rows(forecast_panel(panel.filter("series_id = 'a'"), "arima", 4, KEYS, order=(1, 0, 0)), KEYS)
    assert values_of(fixed, "yhat", "step") == pytest.approx(want, abs=1e-8)


def rolling_ar(y, p, steps):
    """Refit by least squares after every step on the own predictions."""
    y = list(y)
    for _ in range(steps):
        v = np.array(y)
        x = np.column_stack([np.ones(len(v) - p)] + [v[p - k : len(v) - k] for k in range(1, p + 1)])
        b = np.linalg.lstsq(x, v[p:], rcond=None)[0]
        y.append(b[0] + sum(b[k] * v[-k] for k in range(1, p + 1)))
    return y[-steps:]


def test_rolling_refit_equals_one_recursion(spark, panel):
    one = panel.filter("series_id = 'a'")
    want = rolling_ar(values_of(one, "value", "pos"), 5, 8)
    found = forecast_rows(forecast_panel(one, "arima", 8, KEYS, order=(5, 0, 0)), KEYS)
    assert values_of(found, "yhat", "step") == pytest.approx(want, abs=1e-6)


def hannan_rissanen(y, p, q, steps):
    """Reference: long autoregression of twelve lags, then regression on lags and its residuals."""
    w = y - y.mean()
    m = 12
    x = np.column_stack([np.ones(len(w) - m)] + [w[m - k : len(w) - k] for k in range(1, m + 1)])
    e = np.zeros(len(w))
    e[m:] = w[m:] - x @ np.linalg.lstsq(x, w[m:], rcond=None)[0]
    s = m + q
    x = np.column_stack([np.ones(len(w) - s)] + [w[s - k : len(w) - k] for k in range(1, p + 1)]
                        + [e[s - k : len(w) - k] for k in range(1, q + 1)])
    b = np.linalg.lstsq(x, w[s:], rcond=None)[0]
    w, e = list(w), list(e)
    for _ in range(steps):
        w.append(b[0] + sum(b[k] * w[-k] for k in range(1, p + 1)) + sum(b[p + k] * e[-k] for k in range(1, q + 1)))
        e.append(0.0)
    return np.array(w[-steps:]) + y.mean()


def test_fixed_order_equals_plain_regression(spark, panel):
    one = panel.filter("series_id = 'a'")
    want = hannan_rissanen(np.array(values_of(one, "value", "pos")), 2, 1, 5)
    # Orders below the allowed five restart lags at the same rows, so the reference uses the same rows.
    found = forecast_rows(forecast_panel(one, "arima", 5, KEYS, order=(2, 0, 1)), KEYS)
    assert values_of(found, "yhat", "step") == pytest.approx(list(want), abs=1e-6)


def test_order_search_is_independent_of_chunks(spark, panel):
    whole = frame(forecast_panel(panel, "arima", 5, KEYS), "series_id")
    parts = frame(forecast_panel(panel, "arima", 5, KEYS, size=40), "series_id")
    assert list(whole["p"]) == list(parts["p"]) and list(whole["q"]) == list(parts["q"]) and list(whole["d"]) == list(parts["d"])
    for a, b in zip(whole["yhat"], parts["yhat"]):
        assert list(a) == pytest.approx(list(b), abs=1e-6)


def test_random_walk_is_differenced(spark):
    walk = np.random.default_rng(11).normal(size=600).cumsum() + 100
    fit = forecast_panel(long_panel(spark, {"w": walk, "s": ar1(600, 0.5, 10, 4)}, name="value"), "arima", 3, KEYS)
    d = {r["series_id"]: r["d"] for r in fit.collect()}
    assert d == {"w": 1, "s": 0}


def test_missing_rows_are_closed_up(spark, panel):
    holed = panel.filter("series_id = 'a' and pos % 4 != 2")
    y = np.array(values_of(holed, "value", "pos"))
    phi, c = np.polyfit(y[:-1], y[1:], 1)
    found = forecast_rows(forecast_panel(holed, "ar1", 1, KEYS), KEYS).first()["yhat"]
    assert found == pytest.approx(c + phi * y[-1], abs=1e-8)


def test_smoothing_tracks_level_and_walk(spark):
    rng = np.random.default_rng(3)
    noise, walk = 100 + rng.normal(0, 0.5, 400), rng.normal(size=400).cumsum() + 100
    found = forecast_panel(long_panel(spark, {"noise": noise, "walk": walk}, name="value"), "ces", 3, KEYS)
    first = {r["series_id"]: r["yhat"][0] for r in found.collect()}
    assert first["noise"] == pytest.approx(100, abs=0.5) and first["walk"] == pytest.approx(walk[-1], abs=1.5)


def plain_smoothing(y, horizon):
    """The same grids by a loop over all rows."""
    a0, a1 = (g.ravel() for g in np.meshgrid(0.05 + 0.15 * np.arange(12), 0.05 + 0.15 * np.arange(13)))
    best, step = None, 0.15
    for _ in range(4):
        level = np.full(a0.shape, np.mean(y[:10]))
        info, error = level / 1.1, np.zeros(a0.shape)
        with np.errstate(all="ignore"):
            for v in y:
                e = v - level
                error += e * e
                level, info = level - (1 - a1) * info + (a0 - a1) * e, level + (1 - a0) * info + (a0 + a1) * e
        i = int(np.argmin(np.where(np.isfinite(error), error, np.inf)))
        if best is None or error[i] < best[0]:
            best = (error[i], a0[i], a1[i], level[i], info[i])
        step /= 3
        near = np.arange(-2, 3) * step
        a0, a1 = (g.ravel() for g in np.meshgrid(np.clip(best[1] + near, 0.01, 1.8), np.clip(best[2] + near, 0.01, 1.9)))
    _, a0, a1, level, info = best
    out = []
    for _ in range(horizon):
        out.append(level)
        level, info = level - (1 - a1) * info, level + (1 - a0) * info
    return out


def plain_garch(y, p, q, horizon):
    """Likelihoods of the same candidates by a loop over all rows; last squared returns and variances of the best."""
    from tidemark.operators.forecast.garch import candidates
    r2 = np.diff(np.log(y)) ** 2
    target = r2.mean()
    c = candidates(p, q)
    for width in (0.3, 0.1, None):
        past, var = [np.full(len(c), target)] * p, [np.full(len(c), target)] * q
        loss = np.zeros(len(c))
        for r in r2:
            s = target * (1 - c.sum(axis=1)) + sum(c[:, i] * past[i] for i in range(p)) + sum(c[:, p + j] * var[j] for j in range(q))
            loss += np.log(s) + r / s
            past, var = [np.full(len(c), r)] + past[:-1], [s] + var[:-1]
        i = int(np.argmin(loss))
        best, state = c[i], ([x[i] for x in past], [v[i] for v in var])
        if width:
            grid = np.stack([g.ravel() for g in np.meshgrid(*[[1 - width, 1, 1 + width]] * (p + q))], axis=1)
            c = best * grid
            c = np.vstack([best[None], c[c.sum(axis=1) < 0.999]])
    return best, target, state


@pytest.fixture(scope="module")
def long_series(spark):
    rng = np.random.default_rng(14)
    prices = 100 * np.exp((rng.standard_t(5, 100_000) * 0.002 + 0).cumsum())
    short = 50 * np.exp((rng.normal(size=900) * 0.01).cumsum())
    gap = short[:400]
    rows = [("long", i, float(v)) for i, v in enumerate(prices)] + [("short", i + 333, float(v)) for i, v in enumerate(short)]
    rows += [("gap", i + (20_000 if i > 100 else 0), float(v)) for i, v in enumerate(gap)] + [("gap", 150, None)]
    return spark.createDataFrame(rows, "series_id string, pos int, value double").cache(), {"long": prices, "short": short, "gap": gap}


def test_smoothing_over_chunks_equals_a_plain_loop(spark, long_series):
    df, series = long_series
    plain = {s: plain_smoothing(y, 5) for s, y in series.items()}
    for size in (4096,):
        found = {r["series_id"]: r for r in forecast_panel(df, "ces", 5, ["series_id"], size=size).collect()}
        for s, y in series.items():
            assert found[s]["error"] is None and found[s]["yhat"] == pytest.approx(plain[s], rel=1e-9)
        assert found["long"]["last_train_pos"] == 99_999 and found["gap"]["last_train_pos"] == 20_399


def test_variances_over_chunks_equal_a_plain_loop(spark, long_series):
    df, series = long_series
    df, series = df.filter("series_id <> 'long' or pos < 15000"), series | {"long": series["long"][:15_000]}
    plain = {(s, p, q): plain_garch(y, p, q, 3) for s, y in series.items() for p, q in ((2, 2), (1, 1))}
    for p, q, size, cumulative in ((2, 2, 4096, False), (1, 1, 700, True), (1, 1, 200_000, False)):
        found = {r["series_id"]: r for r in forecast_panel(
            df, "garch", 3, ["series_id"], p=p, q=q, size=size, cumulative=cumulative).collect()}
        for s, y in series.items():
            best, target, (past, var) = plain[s, p, q]
            base = np.full(3, y[-1]) if cumulative else y[-3:]
            got = np.log(np.array(found[s]["yhat"]) / base)
            got = np.diff(got, prepend=0) if cumulative else got
            for k, z in enumerate(draws_of(spark, s)):
                s2 = target * (1 - best.sum()) + np.dot(best[:p], past) + np.dot(best[p:], var)
                assert got[k] / np.sqrt(s2) == pytest.approx(z, rel=1e-7)
                past, var = [got[k] ** 2] + past[:-1], [s2] + var[:-1]


def draws_of(spark, series):
    from tidemark.functions import rng
    from pyspark.sql import functions as F
    steps = spark.range(1, 4).orderBy("id")
    return [r[0] for r in steps.select(rng.normal(rng.bits(rng.draw_key("42", "garch", "-", "-", F.lit(series), F.col("id"))))).collect()]


def test_garch_prefers_the_persistence_of_the_data(spark):
    rng = np.random.default_rng(9)
    s, r = 1.0, []
    for _ in range(3000):
        r.append(rng.normal() * np.sqrt(s))
        s = 0.05 + 0.1 * r[-1] ** 2 + 0.85 * s
    (a, b), *_ = plain_garch(100 * np.exp(np.cumsum(np.array(r) * 0.01)), 1, 1, 1)
    assert a + b == pytest.approx(0.95, abs=0.06) and a == pytest.approx(0.1, abs=0.07)


def test_garch_without_shocks_replays_the_tail(spark):
    train = long_panel(spark, {"a": [1, 2, 3, 4, 5, 6]}, name="value")
    for method, params in (("garch", {"simulate": False}), ("tail_replay", {})):
        found = forecast_rows(forecast_panel(train, method, 2, KEYS, **params), KEYS)
        assert values_of(found, "yhat", "step") == [5.0, 6.0]


def test_failures_are_rows(spark):
    train = long_panel(spark, {"short": [1, 2], "flat": [3] * 40}, name="value")
    garch = {r["series_id"]: r["error"] for r in forecast_panel(train, "garch", 2, KEYS).collect()}
    assert "5 positive" in garch["short"] and "constant" in garch["flat"]
    ces = {r["series_id"]: r["error"] for r in forecast_panel(train, "ces", 2, KEYS).collect()}
    assert "fewer than 4" in ces["short"] and ces["flat"] is None
    long = forecast_panel(train, "esn", 2, KEYS, max_rows=10)
    assert "slice" in {r["series_id"]: r["error"] for r in long.collect()}["flat"]
    replay = {r["series_id"]: r["error"] for r in forecast_panel(train, "tail_replay", 3, KEYS).collect()}
    assert replay == {"short": "fewer training rows than forecast steps", "flat": None}


def test_trees_follow_a_repeating_week(spark):
    y = [10, 20, 30, 40, 50, 60, 70] * 12
    train = long_panel(spark, {"a": y, "b": [v + 1 for v in y]}, name="value").withColumn(
        "dt", F.date_add(F.lit("2024-01-01").cast("date"), F.col("pos")))
    fits = forecast_panel(train, "gbt", 7, KEYS, longest=7, trees=20, cut_every=3)
    for r in fits.collect():
        assert r["yhat"] == pytest.approx(y[:7], abs=4)


def test_array_methods_count_rows_not_positions(spark):
    """A hole at any place, a late start and a long series: fitted whole or refused, never cut."""
    from pyspark.sql import functions as F
    from tidemark.operators.forecast import arrays
    rows = [("hole", i, float(i)) for i in range(41) if i != 20] + [("late", 500 + i, float(i)) for i in range(12)]
    rows += [("spread", 5 * i, float(i)) for i in range(12)]
    train = spark.createDataFrame(rows, "series_id string, pos int, value double")

    def size_only(given, horizon, shocks):
        return F.struct(F.array(F.size(given).cast("double")).alias("yhat"), *[F.lit(None).cast("int").alias(c) for c in "pq"],
                        *[F.lit(None).cast("double").alias(c) for c in ("prepare_ms", "fit_ms", "predict_ms")], F.lit(None).cast("string").alias("error"))
    got = {r["series_id"]: r for r in arrays.fit_arrays(train, ["series_id"], F.lit(1), size_only, max_rows=20).collect()}
    assert got["late"]["yhat"] == [12.0] and got["spread"]["yhat"] == [12.0] and "more than 20" in got["hole"]["error"]
    assert arrays.fit_arrays(train, ["series_id"], F.lit(1), size_only, max_rows=40).filter("series_id = 'hole'").first()["yhat"] == [40.0]


def test_replay_takes_its_bound_from_the_horizon(spark):
    from pyspark.sql import functions as F
    from tidemark.operators.forecast.replay import tail_replay
    train = spark.range(2000).selectExpr("'a' as series_id", "cast(id as int) as pos", "double(id) as value")
    row = tail_replay(train, ["series_id"], F.lit(600)).first()
    assert row["error"] is None and row["yhat"] == [float(x) for x in range(1400, 2000)]


def test_trees_of_a_scenario_ignore_the_others(spark):
    from pyspark.sql import functions as F
    from tidemark.operators.forecast.gbt import forecast_gbt
    rows = [(s, "a", i, float(50 + i % 7 + k * (i * 37 % 11))) for k, s in enumerate(["none", "noise"]) for i in range(60)]
    train = spark.createDataFrame(rows, "source string, series_id string, pos int, value double").withColumn("dt", F.date_add(F.lit("2020-01-01").cast("date"), F.col("pos")))
    keys = ["source", "series_id"]
    both = forecast_gbt(train, keys, F.lit(3), trees=3, depth=2).filter("source = 'none'").first()["yhat"]
    assert len(both) == 3 and both == forecast_gbt(train.filter("source = 'none'"), keys, F.lit(3), trees=3, depth=2).first()["yhat"]


def test_many_series_are_solved_in_parts(monkeypatch):
    from tidemark.operators.forecast import arima

    sizes, whole = [], arima.full_matrices
    monkeypatch.setattr(arima, "full_matrices", lambda sums, size: sizes.append(len(sums)) or whole(sums, size))
    rng = np.random.default_rng(41)
    products = pd.Series([arima.upper(rng.normal(size=(120, 14))) for _ in range(1300)])
    found = arima._long_solution.func(products)
    for i in (0, 600, 1299):
        assert np.allclose(found[i], arima._long_solution.func(products.iloc[i : i + 1])[0])
    given = [pd.Series([arima.upper(rng.normal(size=(120, 4))) for _ in range(1300)]), *[pd.Series([[0.5, 0.1]] * 1300)] * 2,
             pd.Series([1.0] * 1300), pd.Series([0] * 1300), pd.Series([[1.0, 2.0]] * 1300), pd.Series([3] * 1300)]
    run = arima.select_and_forecast([(0, 0), (1, 1)], 1, 1).func
    fits = run(*given)
    for i in (0, 600, 1299):
        assert np.allclose(fits.yhat[i], run(*[x.iloc[i : i + 1] for x in given]).yhat[0])
    assert max(sizes) <= 512 and len(found) == len(fits) == 1300
    assert len(run(*[x.iloc[:0] for x in given])) == 0
