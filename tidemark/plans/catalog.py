"""Queries over the given tables, one per operator. Each takes (spark, folder of the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import COLUMNS, N_VALID, PARTIAL_STRENGTHS, SCALES, SEED, SOURCE_LABELS, strengths
from tidemark.functions import rng, scoring
from tidemark.operators import deviate as D
from tidemark.operators import evaluate as E
from tidemark.operators import features as X
from tidemark.operators import mitigate as M
from tidemark.operators import panel as P
from tidemark.operators import quality as Q
from tidemark.operators import report as R
from tidemark.operators.forecast import forecast_panel, forecast_rows
from tidemark.plans import jobs as J
from tidemark.plans import rolling
from tidemark.plans import scenarios as S
from tidemark.session import materialize
from tidemark.sources import bars as B

# Event types take the places of price columns in the typed tick panel: which are damaged in part, and how much.
TYPE_COLUMNS = ["click", "error", "purchase", "signup", "view"]
TYPE_PARTIAL = {
    source: {s: {"click": grid["close"][s], "view": grid["open"][s]} for s in SCALES}
    for source, grid in PARTIAL_STRENGTHS.items()
}
TICK_VALID = 5
TICK_HORIZON = 5
ROLLING_STEPS = 10


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.number_daily(B.bars_from_lineitem(B.table(spark, sf_dir, "lineitem")))


def bars_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars for queries with several passes: reduced from the line items once and written."""
    return materialize(bars(spark, sf_dir), "bars")


def long_bars(spark, sf_dir, columns=None, once: bool = False) -> DataFrame:
    return P.unpivot((bars_once if once else bars)(spark, sf_dir), columns)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks per user, numbered by time."""
    rows = B.ticks_from_events(B.table(spark, sf_dir, "events"))
    return P.number_rows(rows, ["series_id", "col"], ["ts", "event_id"]).withColumn("dt", F.col("ts").cast("date"))


def typed_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks per user and event type, numbered by time."""
    rows = B.typed_ticks_from_events(B.table(spark, sf_dir, "events"))
    return P.number_rows(rows, ["series_id", "col"], ["ts", "event_id"]).withColumn("dt", F.col("ts").cast("date"))


def pos64() -> F.Column:
    return F.col("pos").cast("bigint").alias("pos")


def rounded(*names: str, digits: int):
    return [F.round(n, digits).alias(n) for n in names]


def monthly(b: DataFrame) -> DataFrame:
    """Monthly means of the bars, months of a series numbered from 0."""
    month = b.groupBy("series_id", F.trunc("dt", "month").alias("month")).agg(*[F.avg(c).alias(c) for c in COLUMNS])
    order = Window.partitionBy("series_id").orderBy("month")
    return month.withColumn("row", (F.row_number().over(order) - 1).cast("bigint"))


COMPARED = ["close", "adj_close", "high", "low", "volume"]


def lag_reports(spark, sf_dir) -> DataFrame:
    """Sixteen-row prediction reports of a naive forecast, one file per user and event type.

    Row k takes the value k ticks ago as the forecast. Series with at most sixteen ticks give incomplete files.
    """
    keys = ["series_id", "col"]
    lagged = X.with_lags(typed_ticks(spark, sf_dir), keys, list(range(1, R.REPORT_ROWS + 1)))
    sums = []
    for n, *_ in S.scenarios():
        gap = F.col("real") - F.col(f"lag_{n}")
        share = F.try_divide(F.abs(gap), F.nullif(F.abs("real"), F.lit(0.0)))
        sums += [F.sqrt(F.avg(gap * gap)).alias(f"rmse_{n}"), F.avg(F.abs(gap)).alias(f"mae_{n}"),
                 (F.lit(100.0) * F.avg(share)).alias(f"mape_{n}")]
    per_file = lagged.groupBy(*keys).agg(
        F.min("real").alias("lo"), F.max("real").alias("hi"), F.stddev_samp("real").alias("time_sd"), *sums)
    rows = F.array(*[
        F.struct(F.lit(n).alias("num"), F.lit(s).alias("source"), F.lit(c).alias("scale_name"),
                 F.lit(i).alias("improve"),
                 *[F.col(f"{e}_{n}").alias(e) for e in ("rmse", "mae", "mape")])
        for n, s, c, i in S.scenarios()
    ])
    text = scoring.time_text(F.col("lo"), F.col("hi"), F.col("hi") - F.col("lo"))
    flat = per_file.select(*keys, "lo", "hi", "time_sd", F.inline(rows))
    return flat.select(
        F.concat_ws("_", "series_id", "col", F.lit("TailReplay"), F.lit(str(N_VALID))).alias("file_name"), "num",
        scoring.source_label(F.col("source")).alias("dev"), scoring.scale_label(F.col("scale_name")).alias("scale"),
        "improve", text.alias("time_text"), "time_sd",
        F.when(F.col("improve") == "Y", F.col("hi")).otherwise(F.lit(0.0)).alias("mitigation_ms"),
        "rmse", "mae", "mape",
    )


def noise_reports(spark, sf_dir) -> DataFrame:
    """Correctness reports as files: one per series, rows (range, scale, improve, score)."""
    b = bars_once(spark, sf_dir)
    out = None
    for range_ in ("all", "partially"):
        part = Q.correctness_relation(D.deviate_wide(b, "noise", range_)).withColumn("range", F.lit(range_))
        out = part if out is None else out.unionByName(part)
    name = F.concat_ws("_", "series_id", F.lit("all-columns"), F.lit(SOURCE_LABELS["noise"]))
    return out.select(name.alias("file_name"), "range", "scale", F.lit("N").alias("improve"), "score")


def replay_setup(spark, sf_dir):
    """Real, damaged and repaired series, their tail-replay forecasts and the real validation values."""
    panel = S.with_border(long_bars(spark, sf_dir, once=True), N_VALID)
    scen = materialize(S.scenario_panel(panel), "scenarios")
    train = S.training(scen).select(*S.GROUP, "pos", "value")
    fits = forecast_panel(train, "tail_replay", F.col("delay") + N_VALID, S.GROUP)
    actual = S.validation(panel).select("series_id", "col", "step", "pos", "real")
    return panel, train, forecast_rows(fits, S.GROUP), actual


# ---- panels ---------------------------------------------------------------------------------------------------

def scan_bars(spark, sf_dir):
    return B.bars_from_lineitem(B.table(spark, sf_dir, "lineitem"))


def slice_window(spark, sf_dir):
    b = bars_once(spark, sf_dir)
    cut = P.slice_window(b.drop("pos"), P.start_positions(b, [0, 100, 250, 1200]), 1515)
    return cut.select("series_id", F.col("shift").cast("bigint").alias("shift"), pos64(), "dt", "close", "complete", "found")


def panel_unpivot(spark, sf_dir):
    return long_bars(spark, sf_dir).select("series_id", "dt", pos64(), "col", "real")


def panel_pivot(spark, sf_dir):
    return P.pivot(long_bars(spark, sf_dir)).select("series_id", pos64(), "dt", *COLUMNS)


def series_tail(spark, sf_dir):
    tail = P.series_tail(ticks(spark, sf_dir), ["series_id", "col"], 10)
    return tail.select("series_id", pos64(), "event_id", "real")


def train_split(spark, sf_dir):
    panel = S.with_border(long_bars(spark, sf_dir, once=True), N_VALID)
    split = S.train_split(S.scenario_panel(panel))
    return split.select("series_id", "col", "source", "scale", "improve", "delay", pos64(), "role",
                        *rounded("value", digits=4))


def scenario_grid(spark, sf_dir):
    sizes = bars(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))
    return S.scenario_grid(sizes)


def column_split(spark, sf_dir):
    return S.column_split(long_bars(spark, sf_dir))


# ---- deviations -----------------------------------------------------------------------------------------------

def _wide(spark, sf_dir, source, range_):
    wide = D.deviate_wide(bars_once(spark, sf_dir) if source == "noise" else bars(spark, sf_dir), source, range_)
    return wide.select("series_id", pos64(), "scale", *rounded(*COLUMNS, digits=4))


def deviate_noise(spark, sf_dir):
    return _wide(spark, sf_dir, "noise", "all")


def deviate_noise_partial(spark, sf_dir):
    return _wide(spark, sf_dir, "noise", "partially")


def deviate_missing(spark, sf_dir):
    return _wide(spark, sf_dir, "incompleteness", "all")


def deviate_missing_partial(spark, sf_dir):
    return _wide(spark, sf_dir, "incompleteness", "partially")


def deviate_obsolete(spark, sf_dir):
    """What a stale copy still shows: rows and last date per series, column and scale, for both ranges."""
    panel = S.with_border(long_bars(spark, sf_dir, once=True), 0)
    out = None
    for range_ in ("all", "partially"):
        stale = D.delays(panel, range_).filter(F.col("pos") < F.col("border") - F.col("delay"))
        part = stale.groupBy("series_id", "col", "scale", "delay").agg(
            F.count(F.lit(1)).alias("rows"), F.max("dt").alias("last_dt")).withColumn("range", F.lit(range_))
        out = part if out is None else out.unionByName(part)
    return out


def scenario_panel(spark, sf_dir):
    scen = S.scenario_panel(long_bars(spark, sf_dir, once=True))
    return scen.select("series_id", "col", pos64(), "dt", "source", "scale", "improve", "delay",
                       *rounded("real", "value", digits=4))


# ---- quality --------------------------------------------------------------------------------------------------

def row_ages(spark, sf_dir):
    ages = D.row_ages(bars_once(spark, sf_dir))
    return ages.select("series_id", pos64(), "scale", "time_diff", *rounded("age_years", digits=9))


def timeliness_values(spark, sf_dir):
    scores = Q.timeliness_values(D.row_ages(bars_once(spark, sf_dir)), "close")
    return scores.select("series_id", pos64(), "scale", "time_diff", *rounded("score", digits=9))


def timeliness_tuples(spark, sf_dir):
    """Tuple scores with the offset that lines the measurement times up."""
    ages = D.row_ages(bars_once(spark, sf_dir))
    scores = Q.timeliness_tuples(ages).join(D.display_offsets(ages), ["series_id", "scale"])
    return scores.select("series_id", pos64(), "scale", "offset", *rounded("score", digits=9))


def timeliness_relation(spark, sf_dir):
    return Q.timeliness_relation(bars_once(spark, sf_dir)).select("series_id", "scale", *rounded("score", digits=9))


def timeliness_relation_partial(spark, sf_dir):
    scores = Q.timeliness_relation_partial(bars_once(spark, sf_dir))
    return scores.select("series_id", "scale", *rounded("score", digits=9))


def correctness_values(spark, sf_dir):
    scores = Q.correctness_values(D.deviate_wide(bars_once(spark, sf_dir), "noise"), "close")
    return scores.select("series_id", pos64(), "scale", *rounded("score", digits=6))


def correctness_tuples(spark, sf_dir):
    scores = Q.correctness_tuples(D.deviate_wide(bars_once(spark, sf_dir), "noise", "partially"))
    return scores.select("series_id", pos64(), "scale", *rounded("score", digits=6))


def correctness_relation(spark, sf_dir):
    scores = Q.correctness_relation(D.deviate_wide(bars_once(spark, sf_dir), "noise"))
    return scores.select("series_id", "scale", *rounded("score", digits=6))


def completeness_values(spark, sf_dir):
    scores = Q.completeness_values(D.deviate_wide(bars(spark, sf_dir), "incompleteness"), "close")
    return scores.select("series_id", pos64(), "scale", "score")


def completeness_tuples(spark, sf_dir):
    scores = Q.completeness_tuples(D.deviate_wide(bars(spark, sf_dir), "incompleteness", "partially"))
    return scores.select("series_id", pos64(), "scale", "complete")


def completeness_relation(spark, sf_dir):
    scores = Q.completeness_relation(D.deviate_wide(bars(spark, sf_dir), "incompleteness"))
    return scores.select("series_id", "scale", *rounded("score", digits=9))


def weights_normalized(spark, sf_dir):
    weights = Q.weights_normalized(long_bars(spark, sf_dir))
    return weights.select("series_id", "col", "rows", *rounded("weight", digits=9))


def deviated_quality(spark, sf_dir):
    scores = J.deviated_quality(bars_once(spark, sf_dir))
    return scores.select("series_id", "source", "range", "scale", "improve", *rounded("score", digits=6))


REPORT_COLUMNS = ["series_id", "source", "metric", "range", "scale", "improve"]


def quality_report(spark, sf_dir):
    return J.quality_report(bars_once(spark, sf_dir)).select(*REPORT_COLUMNS, *rounded("score", digits=6))


def quality_report_close(spark, sf_dir):
    report = J.quality_report(bars_once(spark, sf_dir), ["close"])
    return report.select(*REPORT_COLUMNS, *rounded("score", digits=6))


# ---- repairs --------------------------------------------------------------------------------------------------

REPAIR_KEYS = ["series_id", "col", "scale"]


def mitigate_kalman(spark, sf_dir):
    noised = D.deviate(ticks(spark, sf_dir), "noise", columns=["value"])
    smooth = M.mitigate_kalman(noised, REPAIR_KEYS)
    return smooth.select("series_id", "scale", pos64(), *rounded("value", digits=6))


def mitigated_partial(spark, sf_dir):
    full = D.deviate(typed_ticks(spark, sf_dir), "noise", columns=TYPE_COLUMNS)
    fixed = M.mitigated_partial(M.mitigate_kalman(full, REPAIR_KEYS, carry=["real"]), TYPE_PARTIAL["noise"])
    return fixed.select("series_id", "col", "scale", pos64(), *rounded("value", digits=6))


OUTAGE = (300, 700)


def mitigate_noise_gaps(spark, sf_dir):
    """Smoothed prices of all columns with noise, random gaps and one long outage, in chunks much shorter than the outage."""
    noised = D.deviate(long_bars(spark, sf_dir), "noise")
    lost = D.strength_of(strengths("incompleteness"), F.col("col"), F.col("scale"))
    drawn = rng.bits(rng.draw_key(SEED, "incompleteness", F.col("scale"), F.col("col"), F.col("series_id"), F.col("pos")))
    kept = F.when(~F.col("pos").between(*OUTAGE), F.col("value"))
    gappy = noised.select("series_id", "col", "scale", "pos", D.add_gaps(kept, lost, drawn, None, None).alias("value"))
    smooth = M.mitigate_kalman(gappy, REPAIR_KEYS, size=256)
    return smooth.select(*REPAIR_KEYS, pos64(), *rounded("value", digits=4))


def mitigate_spline(spark, sf_dir):
    """Prices of all columns with random gaps filled, in chunks of 256 knots."""
    gappy = D.deviate(long_bars(spark, sf_dir), "incompleteness")
    filled = M.mitigate_spline(gappy, REPAIR_KEYS, size=256)
    return filled.select(*REPAIR_KEYS, pos64(), *rounded("value", digits=4), "error")


def mitigation_time(spark, sf_dir):
    panel = long_bars(spark, sf_dir, once=True)
    out = None
    for source in ("noise", "incompleteness"):
        part = M.mitigation_time(D.deviate(panel, source), source, REPAIR_KEYS).withColumn("source", F.lit(source))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("series_id", "source", "scale").agg(F.sum("elapsed_ms").alias("elapsed_ms"))


# ---- features -------------------------------------------------------------------------------------------------

def log_returns(spark, sf_dir):
    rows = X.log_returns(long_bars(spark, sf_dir), ["series_id", "col"])
    return rows.select("series_id", "col", pos64(), *rounded("log_return", digits=9))


def pct_change(spark, sf_dir):
    rows = X.pct_change(ticks(spark, sf_dir), ["series_id", "col"])
    return rows.select("series_id", pos64(), *rounded("pct_change", digits=6))


def lag_features(spark, sf_dir):
    rows = X.lag_features(long_bars(spark, sf_dir), ["series_id", "col"])
    return rows.select("series_id", "col", pos64(), "real", "lag_1", "lag_7", "lag_14", "rolling_max", "rolling_min",
                       *rounded("rolling_mean", digits=6), "weekday", "month")


def acf(spark, sf_dir):
    return X.acf(ticks(spark, sf_dir), ["series_id", "col"], "real", 10).select(
        "series_id", "lag", *rounded("acf", digits=6))


def pacf(spark, sf_dir):
    return X.pacf(ticks(spark, sf_dir), ["series_id", "col"], "real", 3).select(
        "series_id", F.col("lag").cast("int").alias("lag"), *rounded("pacf", digits=6))


# ---- forecasts ------------------------------------------------------------------------------------------------

def real_training(panel: DataFrame, n_valid: int) -> DataFrame:
    bordered = S.with_border(panel, n_valid)
    return bordered.filter((F.col("pos") < F.col("border")) & F.col("real").isNotNull()).select(
        "series_id", "col", "pos", "dt", F.col("real").alias("value"))


FIT_KEYS = ["series_id", "col"]


def forecast_ar1(spark, sf_dir):
    fits = forecast_panel(real_training(ticks(spark, sf_dir), TICK_VALID), "ar1", TICK_HORIZON, FIT_KEYS)
    return forecast_rows(fits, FIT_KEYS).select("series_id", "step", *rounded("yhat", digits=6))


def tail_replay(spark, sf_dir):
    _, _, rows, _ = replay_setup(spark, sf_dir)
    return rows.select(*S.GROUP, "step", *rounded("yhat", digits=4))


def forecast_align(spark, sf_dir):
    _, _, rows, _ = replay_setup(spark, sf_dir)
    return E.forecast_align(rows, N_VALID).select(*S.GROUP, "step", *rounded("yhat", digits=4))


def forecast_eval(spark, sf_dir):
    _, _, rows, actual = replay_setup(spark, sf_dir)
    found = E.errors(E.forecast_align(rows, N_VALID), actual, S.GROUP)
    return found.select(*S.GROUP, "n", "n_expected", "mape_n", *rounded("rmse", "mae", "mape", digits=4))


def forecast_eval_weighted(spark, sf_dir):
    _, _, rows, actual = replay_setup(spark, sf_dir)
    per_column = E.errors(E.forecast_align(rows, N_VALID), actual, S.GROUP)
    keys = ["series_id", "source", "scale", "improve"]
    return E.weighted_errors(per_column, keys, COLUMNS).select(*keys, *rounded("rmse", "mae", "mape", digits=4))


def forecast_overlay(spark, sf_dir):
    panel, train, rows, _ = replay_setup(spark, sf_dir)
    keys = ["series_id", "col", "source", "scale", "improve"]
    stale = lambda df: df.filter((F.col("source") == "timeliness") & (F.col("scale") == "moderately"))
    edge = panel.groupBy("series_id").agg(F.max("border").alias("border"))
    placed = E.forecast_align(stale(rows), N_VALID).join(edge, "series_id").withColumn("pos", F.col("border") + F.col("step") - 1)
    labels = {"source": F.lit("timeliness"), "scale": F.lit("moderately"), "improve": F.lit("N")}
    drawn = E.forecast_overlay(panel.withColumns(labels), stale(train), placed, keys, 1300)
    return drawn.select("series_id", "col", "role", F.col("x").cast("bigint").alias("x"),
                        F.col("train_end").cast("bigint").alias("train_end"), *rounded("value", digits=4))


def avg_predictions(spark, sf_dir):
    """Mean over repeated runs of the replay forecast next to the real values, for every scenario."""
    found = J.averaged_predictions(long_bars(spark, sf_dir, once=True), "tail_replay", iterations=3)
    return found.select("series_id", "col", "source", "scale", "improve", F.col("step").cast("bigint").alias("step"), *rounded("yhat", "real", digits=4))


def rolling_origin(spark, sf_dir):
    found = J.rolling_origin(bars_once(spark, sf_dir), "tail_replay", 50, 1515)
    return found.select("series_id", F.col("shift").cast("bigint").alias("shift"), "n", *rounded("rmse", "mae", "mape", digits=4), "reason")


ROLLING = {"shifts": (0, 25, 50, 400, 1500), "n": 1000}


def rolling_scenarios(spark, sf_dir):
    """All columns of all series over windows at several shifts, under all sixteen scenarios."""
    found = rolling.rolling_scenarios(long_bars(spark, sf_dir, once=True), **ROLLING)
    return found.select("series_id", "col", "shift", "source", "scale", "improve", "n", *rounded("rmse", "mae", "mape", digits=3), "mape_n", "reason")


def forecast_method(method: str, **params):
    """All columns of all series with one method, real data, fifteen steps."""
    def query(spark, sf_dir):
        train = real_training(long_bars(spark, sf_dir, once=True), N_VALID)
        rows = forecast_rows(forecast_panel(train, method, N_VALID, FIT_KEYS, **params), FIT_KEYS)
        return rows.select(*FIT_KEYS, "step", *rounded("yhat", digits=4))
    return query


def forecast_panel_fits(spark, sf_dir):
    """Fit results of every user series with the default order search."""
    return forecast_panel(real_training(ticks(spark, sf_dir), TICK_VALID), "arima", TICK_HORIZON, FIT_KEYS)


def forecast_gbt(spark, sf_dir):
    train = real_training(ticks(spark, sf_dir), TICK_VALID)
    return forecast_rows(forecast_panel(train, "gbt", TICK_HORIZON, FIT_KEYS, longest=TICK_HORIZON), FIT_KEYS)


def _returns(spark, sf_dir) -> DataFrame:
    """Training part of the close returns of all series."""
    returns = X.pct_change(long_bars(spark, sf_dir, ["close"], once=True), FIT_KEYS).drop("real")
    return real_training(returns.withColumnRenamed("pct_change", "real"), ROLLING_STEPS)


def forecast_rolling_ar1(spark, sf_dir):
    """Rolling one-step forecasts of returns at order (1, 0, 0)."""
    fits = forecast_panel(_returns(spark, sf_dir), "arima", ROLLING_STEPS, FIT_KEYS, order=(1, 0, 0))
    return forecast_rows(fits, FIT_KEYS).select("series_id", "step", *rounded("yhat", digits=6))


def forecast_rolling(spark, sf_dir):
    """Rolling one-step forecasts of returns at three fixed orders."""
    train = materialize(_returns(spark, sf_dir), "returns")
    out = None
    for order in ((1, 0, 0), (5, 0, 0), (5, 0, 5)):
        rows = forecast_rows(forecast_panel(train, "arima", ROLLING_STEPS, FIT_KEYS, order=order), FIT_KEYS)
        part = rows.withColumn("order", F.lit("({},{},{})".format(*order)))
        out = part if out is None else out.unionByName(part)
    return out


def scenario_forecast(spark, sf_dir):
    """Errors of exponential smoothing on the close of every series under all sixteen scenarios."""
    panel = long_bars(spark, sf_dir, ["close"], once=True)
    fits, actual = J.scenario_forecast(panel, "ces", columns=["close"])
    return J.scenario_errors(fits, actual, S.GROUP)


def scenario_forecast_replay(spark, sf_dir):
    """The same sweep with the replay forecast on all columns."""
    panel = long_bars(spark, sf_dir, once=True)
    fits, actual = J.scenario_forecast(panel, "tail_replay")
    found = J.scenario_errors(fits, actual, S.GROUP)
    return found.select(*S.GROUP, "n", "n_expected", "mape_n", *rounded("rmse", "mae", "mape", digits=4))


def prediction_report(spark, sf_dir):
    return J.prediction_report(long_bars(spark, sf_dir, ["close"], once=True), "ces", iterations=3)


def _repeated(spark, sf_dir):
    """Repeated volatility fits of all series: fits, errors and run keys."""
    panel = long_bars(spark, sf_dir, ["close"], once=True)
    fits, actual = J.scenario_forecast(panel, "garch", columns=["close"], sources=["timeliness"], iterations=3)
    return materialize(fits, "fits"), actual, [*S.GROUP, "iteration"]


def repeat_stats(spark, sf_dir):
    fits, actual, keys = _repeated(spark, sf_dir)
    by = [k for k in keys if k not in ("col", "delay")]
    errors = E.weighted_errors(J.scenario_errors(fits, actual, keys), by, ["close"])
    runs = E.fit_times(fits, keys).join(errors, by, "left").withColumn("mitigation_ms", F.lit(0.0))
    return E.repeat_stats(runs, [k for k in by if k != "iteration"])


def forecast_timing(spark, sf_dir):
    fits, _, keys = _repeated(spark, sf_dir)
    return E.fit_times(fits, keys)


# ---- reports --------------------------------------------------------------------------------------------------

def first_dates(spark, sf_dir):
    return R.first_dates(bars(spark, sf_dir))


def series_stats(spark, sf_dir):
    return R.series_stats(bars(spark, sf_dir)).select(
        "name", "min", "max", *rounded("avg", "std_dev", digits=4), *rounded("cv", digits=6))


def relative_change(spark, sf_dir):
    found = R.relative_change(monthly(bars(spark, sf_dir)), ["series_id", "row"], "open", COMPARED)
    return found.select("series_id", "row", *rounded(*COMPARED, digits=6))


def relative_change_summary(spark, sf_dir):
    found = R.relative_change(monthly(bars(spark, sf_dir)), ["series_id", "row"], "open", COMPARED)
    return R.relative_change_summary(found, ["series_id"], "row", COMPARED)


def report_scan(spark, sf_dir):
    return lag_reports(spark, sf_dir).select(
        "file_name", "num", "dev", "scale", "improve", "time_text", "mitigation_ms",
        *rounded("time_sd", "rmse", "mae", "mape", digits=6))


def split_times(spark, sf_dir):
    return R.split_times(lag_reports(spark, sf_dir)).select("file_name", "num", "prepare_ms", "fit_ms", "predict_ms")


def avg_quality_report(spark, sf_dir):
    return R.avg_quality_report(noise_reports(spark, sf_dir)).select(
        "range", "scale", "improve", "files", *rounded("score", digits=6))


def avg_prediction_report(spark, sf_dir):
    found = R.avg_prediction_report(lag_reports(spark, sf_dir))
    return found.select("num", "dev", "scale", "improve", "files", "time_text",
                        *rounded("time_sd", "mitigation_ms", "rmse", "mae", "mape", digits=4))


def common_labels(spark, sf_dir):
    return R.common_labels(lag_reports(spark, sf_dir), ["company", "column", "method", "size"])


QUERIES = {
    f.__name__: f
    for f in (
        scan_bars, slice_window, panel_unpivot, panel_pivot, series_tail, train_split, scenario_grid, column_split,
        deviate_noise, deviate_noise_partial, deviate_missing, deviate_missing_partial, deviate_obsolete,
        scenario_panel, row_ages, timeliness_values, timeliness_tuples, timeliness_relation,
        timeliness_relation_partial, correctness_values, correctness_tuples, correctness_relation,
        completeness_values, completeness_tuples, completeness_relation, weights_normalized, deviated_quality,
        quality_report, quality_report_close, mitigate_kalman, mitigate_noise_gaps, mitigated_partial, mitigate_spline, mitigation_time,
        log_returns, pct_change, lag_features, acf, pacf, forecast_ar1, tail_replay, forecast_align, forecast_eval,
        forecast_eval_weighted, forecast_overlay, avg_predictions, rolling_origin, rolling_scenarios, forecast_gbt, forecast_rolling, forecast_rolling_ar1,
        scenario_forecast, scenario_forecast_replay, prediction_report, repeat_stats, forecast_timing, first_dates, series_stats,
        relative_change, relative_change_summary, report_scan, split_times, avg_quality_report,
        avg_prediction_report, common_labels,
    )
}
QUERIES["forecast_panel"] = forecast_panel_fits
for _method in ("arima", "ces", "garch", "esn"):
    QUERIES[f"forecast_{_method}"] = forecast_method(_method)
QUERIES["forecast_garch11"] = forecast_method("garch", p=1, q=1)
QUERIES["forecast_garch_mean"] = forecast_method("garch", simulate=False)
