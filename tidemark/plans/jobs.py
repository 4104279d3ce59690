"""Whole jobs over many series at once: quality report, forecast sweep, rolling origins, prediction report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import ALPHA, COLUMNS, N_VALID, SCALES, SOURCE_LABELS, WEIGHTS, strengths
from tidemark.functions import scoring
from tidemark.operators import evaluate as E
from tidemark.operators import quality as Q
from tidemark.operators.deviate import deviate, deviate_wide
from tidemark.operators.forecast import forecast_panel, forecast_rows
from tidemark.operators.mitigate import MITIGATIONS, mitigated_partial, mitigation_time
from tidemark.operators.panel import rolling_windows, unpivot
from tidemark.operators.report import AVERAGES, COMPARISONS, named
from tidemark.plans.scenarios import GROUP, scenario_panel, scenarios, training, validation, with_border
from tidemark.session import materialize
from tidemark.sources.bars import require_rows, write_report, write_scenarios

REPORT = ["series_id", "source", "range", "scale", "improve", "score"]


def _labelled(scores: DataFrame, source: str, range_: str, improve: str) -> DataFrame:
    return scores.select("series_id", F.lit(source).alias("source"), F.lit(range_).alias("range"), "scale",
                         F.lit(improve).alias("improve"), "score")


def deviated_quality(bars: DataFrame, columns=None, alpha: dict = ALPHA) -> DataFrame:
    """Relation scores of the damaged sets, for full and partial damage. No repairs, so no grouped passes."""
    out = None
    for range_ in ("all", "partially"):
        noised = Q.correctness_relation(deviate_wide(bars, "noise", range_), columns, alpha)
        gappy = Q.completeness_relation(deviate_wide(bars, "incompleteness", range_), columns)
        if range_ == "all" and not columns:
            stale = Q.timeliness_relation(bars)
        else:
            stale = Q.timeliness_relation_partial(bars, columns)
        found = {"noise": noised, "incompleteness": gappy, "timeliness": stale}
        if columns and range_ == "all":
            # Timeliness of chosen columns exists for partial damage only.
            del found["timeliness"]
        for source, scores in found.items():
            part = _labelled(scores, source, range_, "N")
            out = part if out is None else out.unionByName(part)
    return out


def mitigated_quality(bars: DataFrame, columns=None, alpha: dict = ALPHA) -> DataFrame:
    """Relation scores of the repaired sets. Partial repairs take the fully repaired values of damaged columns."""
    columns = columns or COLUMNS
    panel = materialize(unpivot(bars, columns), "panel")
    keys = ["series_id", "col", "scale"]
    out = None
    for source in ("noise", "incompleteness"):
        damaged = deviate(panel, source, "all", strengths(source, "all"))
        repaired = materialize(MITIGATIONS[source](damaged, keys, carry=["real"]).drop("damaged"), "repaired")
        for range_ in ("all", "partially"):
            fixed = repaired if range_ == "all" else mitigated_partial(repaired, strengths(source, "partially"))
            if source == "noise":
                scores = Q.correctness_relation_long(fixed, columns, alpha)
            else:
                scores = Q.completeness_relation_long(fixed, columns)
            part = _labelled(scores, source, range_, "Y")
            out = part if out is None else out.unionByName(part)
    return out


def quality_report(bars: DataFrame, columns=None, alpha: dict = ALPHA) -> DataFrame:
    """All relation scores, damaged and repaired, labelled and numbered in report order."""
    scores = deviated_quality(bars, columns, alpha).unionByName(mitigated_quality(bars, columns, alpha))
    order = {s: i for i, s in enumerate(SCALES)}
    rank = scoring.by_key(F.col("scale"), order, "int")
    label = scoring.by_key(F.col("source"), SOURCE_LABELS, "string")
    return scores.select(*REPORT, label.alias("metric")).orderBy("series_id", "source", "range", rank, "improve")


def scenario_forecast(panel: DataFrame, method: str, n_valid: int = N_VALID, range_: str = "all", columns=None,
                      sources=None, scales=None, iterations: int = 0, **params):
    """Train and forecast every series, column and scenario in one job.

    Returns ``(fits, actual)``: one fit per group (and iteration), and the real validation values by step.
    """
    columns = columns or COLUMNS
    chosen = panel.filter(F.col("col").isin(list(columns)))
    chosen = with_border(chosen, n_valid)
    train = training(scenario_panel(chosen, range_, sources, scales, columns=columns))
    keys = list(GROUP)
    if iterations:
        train = E.repeat_rows(train, iterations)
        keys.append("iteration")
    kept = [*keys, "pos", "value", *(["dt"] if method == "gbt" else [])]
    # A stale column makes every column of its scenario forecast as far as the longest delay.
    longest = _longest_delay(range_, columns)
    fits = forecast_panel(train.select(*kept), method, longest + n_valid, keys, **params)
    return fits, validation(chosen).select("series_id", "col", "step", "pos", "real")


def _longest_delay(range_: str, columns):
    """Longest delay of the scenario of a group, as a column."""
    grid = strengths("timeliness", range_, columns)
    per_scale = {s: int(max(d.values())) for s, d in grid.items()}
    found = scoring.by_key(F.col("scale"), per_scale, "int")
    return F.when(F.col("source") == "timeliness", found).otherwise(F.lit(0))


def scenario_errors(fits: DataFrame, actual: DataFrame, keys: list[str], n_valid: int = N_VALID) -> DataFrame:
    """Errors of every group of a forecast job. A group without a forecast keeps its row: no errors, ``n`` of 0, and the ``reason``."""
    aligned = E.forecast_align(forecast_rows(fits, keys), n_valid)
    found = E.errors(aligned, actual, keys).drop("n_expected")
    expected = actual.groupBy("series_id", "col").agg(F.count(F.lit(1)).alias("n_expected"))
    told = fits.select(*keys, F.col("error").alias("reason")).join(found, keys, "left").join(expected, ["series_id", "col"])
    return told.fillna(0, ["n", "mape_n"])


def averaged_predictions(panel: DataFrame, method: str, iterations: int = 3, n_valid: int = N_VALID, columns=None, range_: str = "all",
                         **params) -> DataFrame:
    """Mean over the runs of every scenario per step next to the real value; the first run warms up and does not count."""
    fits, actual = scenario_forecast(panel, method, n_valid, range_, columns, iterations=iterations, **params)
    keys = [*GROUP, "iteration"]
    rows = E.forecast_align(forecast_rows(fits, keys), n_valid).filter(F.col("iteration") > 0)
    return E.avg_predictions(rows, actual, GROUP)


def save_predictions(panel: DataFrame, method: str, folder: str, columns=("close",), n_valid: int = N_VALID, **params) -> None:
    """Averaged predictions as CSV, one directory per series and scenario: a column of forecasts and one of real values per attribute."""
    found = averaged_predictions(panel, method, n_valid=n_valid, columns=list(columns), **params)
    picked = [F.max(F.when(F.col("col") == c, F.col(v))).alias(name)
              for c in sorted(columns) for v, name in (("yhat", c), ("real", f"{c} - real"))]
    wide = found.groupBy("series_id", "source", "scale", "improve", "step").agg(*picked)
    scale = F.when(F.col("scale") != "-", F.col("scale"))
    repair = F.when(F.col("improve") == "Y", F.lit("repaired"))
    stored = named(wide, F.col("series_id"), list(columns), F.lit(method), F.col("source"), scale, repair, F.lit(str(n_valid)))
    ordered = stored.select("file_name", "step", *[name for c in sorted(columns) for name in (c, f"{c} - real")])
    write_report(ordered.repartition("file_name").sortWithinPartitions("file_name", "step"), folder)


def save_quality_reports(bars: DataFrame, folder: str, columns=None) -> None:
    """Quality reports of all series as CSV, one directory per series and metric, rows in report order."""
    report = quality_report(bars, columns)
    stored = named(report, F.col("series_id"), [] if columns is None else list(columns), F.col("source"))
    write_report(stored.select("file_name", "range", "scale", "improve", "score"), folder)


def save_comparisons(spark, source: str, folder: str, names=COMPARISONS) -> None:
    """Smallest, largest and mean relative change of every comparison table ``source/<name>.csv`` against its first column."""
    for name in names:
        table = spark.read.option("header", True).option("inferSchema", True).csv(f"{source}/{name}.csv")
        write_report(AVERAGES["comparison"](require_rows(table, f"{source}/{name}.csv")).withColumn("file_name", F.lit(name)), f"{folder}/{name}")


def prediction_report(panel: DataFrame, method: str, iterations: int = 3, n_valid: int = N_VALID, columns=None,
                      range_: str = "all", weights: dict = WEIGHTS, **params) -> DataFrame:
    """The sixteen-row statistics report of every series: times, their deviation, repair time, errors, order."""
    columns = columns or ["close"]
    chosen = panel.filter(F.col("col").isin(list(columns)))
    fits, actual = scenario_forecast(chosen, method, n_valid, range_, columns, iterations=iterations, **params)
    fits = materialize(fits, "fits")
    keys = [*GROUP, "iteration"]
    by = [k for k in keys if k not in ("col", "delay")]
    per_column = scenario_errors(fits, actual, keys, n_valid)
    weighted = E.weighted_errors(per_column.drop("delay"), [k for k in keys if k != "delay"], columns, weights)
    runs = E.fit_times(fits, keys).join(weighted, by, "left")
    repair = None
    for source in ("noise", "incompleteness"):
        damaged = deviate(chosen, source, "all", strengths(source, "all", columns)).select(
            "series_id", "col", "scale", "pos", "value")
        part = mitigation_time(damaged, source, ["series_id", "col", "scale"]).withColumn("source", F.lit(source))
        repair = part if repair is None else repair.unionByName(part)
    repair = repair.groupBy("series_id", "source", "scale").agg(F.sum("elapsed_ms").alias("mitigation_ms"))
    repair = repair.withColumn("improve", F.lit("Y"))
    timed = runs.join(repair, ["series_id", "source", "scale", "improve"], "left").fillna({"mitigation_ms": 0.0})
    stats = E.repeat_stats(timed, ["series_id", "source", "scale", "improve"])
    num = None
    for n, source, scale, improve in scenarios():
        hit = (F.col("source") == source) & (F.col("scale") == scale) & (F.col("improve") == improve)
        num = F.when(hit, F.lit(n)) if num is None else num.when(hit, F.lit(n))
    order = F.when(F.col("p").isNotNull(), F.format_string("(%d,%d)", "p", "q"))
    return stats.select(
        "series_id", num.alias("num"), scoring.source_label(F.col("source")).alias("dev"),
        scoring.scale_label(F.col("scale")).alias("scale"), "improve",
        scoring.time_text(F.col("prepare_ms"), F.col("fit_ms"), F.col("predict_ms")).alias("time_text"),
        "time_sd", "mitigation_ms", "rmse", "mae", "mape", order.alias("order"), "iterations",
    ).orderBy("series_id", "num")


def prepare_data(panel: DataFrame, folder: str, **choice) -> None:
    """Store real, damaged and repaired series of all companies, and beside them the time each repair took."""
    write_scenarios(scenario_panel(panel, **choice), f"{folder}/series")
    times = None
    for source in MITIGATIONS:
        damaged = deviate(panel, source, "all", strengths(source, "all"))
        part = mitigation_time(damaged, source, ["series_id", "col", "scale"]).withColumn("source", F.lit(source))
        times = part if times is None else times.unionByName(part)
    times.write.mode("overwrite").parquet(f"{folder}/mitigation_time")


def save_prediction_reports(panel: DataFrame, method: str, folder: str, companies=None, columns=("close",),
                            n_valid: int = N_VALID, unique: bool = False, **params) -> None:
    """Prediction reports of all or some companies as CSV, one directory each.

    ``unique`` keeps earlier runs: every run is added under an id of its own.
    """
    chosen = panel if companies is None else panel.filter(F.col("series_id").isin(list(companies)))
    report = prediction_report(chosen, method, n_valid=n_valid, columns=list(columns), **params)
    stored = named(report, F.col("series_id"), list(columns), F.lit(method), F.lit(str(n_valid)))
    write_report(stored, folder, run_id=str(uuid.uuid4()) if unique else None)


def rolling_origin(bars: DataFrame, method: str, shifts: int, n: int, n_valid: int = N_VALID, column: str = "close",
                   **params) -> DataFrame:
    """Errors of one method on real values over windows that start at positions 0 .. ``shifts``; one that is not full is a row with a reason."""
    windows = rolling_windows(bars.select("series_id", "dt", "pos", F.col(column).alias("real")), shifts, n)
    sizes = bars.groupBy("series_id").agg((F.max("pos") + 1).alias("rows"))
    asked = sizes.withColumn("shift", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shifts).cast("long"))))
    full = F.col("shift") + n <= F.col("rows")
    complete = windows.join(asked.filter(full).select("series_id", "shift"), ["series_id", "shift"], "left_semi")
    border = n - n_valid
    keys = ["series_id", "shift"]
    train = complete.filter(F.col("pos") < border).select(*keys, "pos", "dt", F.col("real").alias("value"))
    if method != "gbt":
        train = train.drop("dt")
    rows = forecast_rows(forecast_panel(train, method, n_valid, keys, **params), keys)
    actual = complete.filter(F.col("pos") >= border).select(*keys, (F.col("pos") - border + 1).alias("step"), "real")
    gap = F.col("yhat") - F.col("real")
    share = F.try_divide(F.abs(gap), F.nullif(F.abs("real"), F.lit(0.0)))
    found = rows.join(actual, [*keys, "step"]).groupBy(*keys).agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"),
        (F.lit(100.0) * F.avg(share)).alias("mape"), F.count(F.lit(1)).alias("n"))
    left = F.greatest(F.col("rows") - F.col("shift"), F.lit(0).cast("long"))
    reason = F.when(~full, F.format_string(f"window of {n} rows, series has %d from there on", left)).when(F.col("n").isNull(), "no forecast")
    return asked.join(found, keys, "left").select(*keys, "rmse", "mae", "mape", F.coalesce("n", F.lit(0).cast("long")).alias("n"), reason.alias("reason"))
