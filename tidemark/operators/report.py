"""Series statistics, report averages over many runs, relative change against a reference column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring

# Fixed value: rows of a complete prediction report.
REPORT_ROWS = 16


def series_stats(bars: DataFrame, column: str = "close") -> DataFrame:
    """Smallest, largest and mean value, population deviation and coefficient of variation per series."""
    c = F.col(column)
    stats = bars.groupBy(F.col("series_id").alias("name")).agg(
        F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("avg"), F.stddev_pop(c).alias("std_dev")
    )
    return stats.withColumn("cv", F.try_divide(F.col("std_dev"), F.nullif("avg", F.lit(0.0))) * F.lit(100.0))


def first_dates(bars: DataFrame) -> DataFrame:
    """First date of every series, earliest first."""
    return bars.groupBy("series_id").agg(F.min("dt").alias("first_date")).orderBy("first_date", "series_id")


def named(report: DataFrame, *parts) -> DataFrame:
    """Add ``file_name``, the ``_``-joined parts a report is stored under; a list of columns is joined with ``-``."""
    flat = [F.lit("-".join(p)) if isinstance(p, (list, tuple)) else p for p in parts]
    return report.withColumn("file_name", F.concat_ws("_", *flat))


def avg_quality_report(reports: DataFrame) -> DataFrame:
    """Mean score over report files per (Range, Scale, Improve).

    Rows are matched by their labels, so files of different length cannot be mixed up by position.
    """
    return reports.groupBy("range", "scale", "improve").agg(
        F.avg("score").alias("score"), F.countDistinct("file_name").alias("files")
    )


REPORT_VALUES = ["prepare_ms", "fit_ms", "predict_ms", "time_sd", "mitigation_ms", "rmse", "mae", "mape"]


def split_times(reports: DataFrame, text: str = "time_text") -> DataFrame:
    """The three numbers of an ``a + b + c`` time text as columns."""
    names = ["prepare_ms", "fit_ms", "predict_ms"]
    return reports.withColumns({n: scoring.time_part(F.col(text), i) for i, n in enumerate(names)})


def complete_files(reports: DataFrame) -> DataFrame:
    """Files in which every value column holds exactly sixteen values."""
    counts = reports.groupBy("file_name").agg(*[F.count(c).alias(f"_{c}") for c in REPORT_VALUES])
    whole = F.lit(True)
    for c in REPORT_VALUES:
        whole = whole & (F.col(f"_{c}") == REPORT_ROWS)
    return counts.filter(whole).select("file_name")


def avg_prediction_report(reports: DataFrame) -> DataFrame:
    """Mean of every value per report row over the complete files; incomplete files are skipped."""
    parts = split_times(reports)
    kept = parts.join(complete_files(parts), "file_name", "left_semi")
    averaged = kept.groupBy("num", "dev", "scale", "improve").agg(
        *[F.avg(c).alias(c) for c in REPORT_VALUES], F.count(F.lit(1)).alias("files")
    )
    text = scoring.time_text(*[F.round(F.col(c), 2) for c in ("prepare_ms", "fit_ms", "predict_ms")])
    return averaged.withColumn("time_text", text).drop("prepare_ms", "fit_ms", "predict_ms")


def skipped_files(reports: DataFrame) -> DataFrame:
    """Names of the files that :func:`avg_prediction_report` leaves out."""
    parts = split_times(reports)
    return parts.select("file_name").distinct().join(complete_files(parts), "file_name", "left_anti")


def common_labels(names: DataFrame, parts: list[str], column: str = "file_name") -> DataFrame:
    """Name of an average: ``average`` plus every ``_``-separated part that all file names share."""
    pieces = F.split(F.regexp_replace(F.col(column), r"\.csv$", ""), "_")
    shared = names.agg(*[F.min(F.get(pieces, F.lit(i))).alias(f"_lo{i}") for i in range(len(parts))],
                       *[F.max(F.get(pieces, F.lit(i))).alias(f"_hi{i}") for i in range(len(parts))],
                       *[F.count(F.get(pieces, F.lit(i))).alias(f"_n{i}") for i in range(len(parts))],
                       F.count(F.lit(1)).alias("files"))
    # A part that some name lacks is not shared, whatever the others hold there.
    same = {p: F.when((F.col(f"_lo{i}") == F.col(f"_hi{i}")) & (F.col(f"_n{i}") == F.col("files")), F.col(f"_lo{i}"))
            for i, p in enumerate(parts)}
    named = shared.select("files", *[v.alias(p) for p, v in same.items()])
    return named.withColumn("name", F.concat_ws("_", F.lit("average"), *[F.col(p) for p in parts]))


def relative_change(table: DataFrame, ids: list[str], reference: str, compared: list[str]) -> DataFrame:
    """``(x - reference) / reference`` of every compared column."""
    change = lambda c: F.try_divide(F.col(c) - F.col(reference), F.nullif(reference, F.lit(0.0)))
    return table.select(*ids, *[change(c).alias(c) for c in compared])


def relative_change_summary(changes: DataFrame, keys: list[str], row: str, compared: list[str]) -> DataFrame:
    """Smallest and largest change with their row and the mean, in percent with one digit, per compared column."""
    long = changes.unpivot([*keys, row], compared, "compared", "change").filter(F.col("change").isNotNull())
    first = lambda sign: F.struct((F.lit(float(sign)) * F.col("change")).alias("v"), F.col(row).alias("row"))
    percent = lambda c: F.concat(F.format_string("%.1f", F.round(c * F.lit(100.0), 1)), F.lit("%"))
    found = long.groupBy(*keys, "compared").agg(
        F.min(first(1)).alias("lo"), F.min(first(-1)).alias("hi"), F.avg("change").alias("mean")
    )
    return found.select(
        *keys, "compared",
        F.concat_ws(": ", F.col("lo.row").cast("string"), percent(F.col("lo.v"))).alias("min"),
        F.concat_ws(": ", F.col("hi.row").cast("string"), percent(-F.col("hi.v"))).alias("max"),
        percent(F.col("mean")).alias("avg"),
    )


# Names of the comparison tables.
COMPARISONS = ["multiple_data_preparation_times", "multiple_prediction_times", "partial_data_preparation_times", "partial_prediction_times",
               "partial_mape", "performance_data_preparation_times", "performance_model_training_times", "performance_mape"]


def comparison_report(table: DataFrame) -> DataFrame:
    """Smallest, largest and mean relative change of every column of ``table`` against its first one, rows counted from 0 in their order.

    Comparison tables hold a few rows, one per case, so numbering them is one small sort.
    """
    reference, *compared = table.columns
    row = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.monotonically_increasing_id())) - 1
    numbered = table.withColumn("_row", row)
    return relative_change_summary(relative_change(numbered, ["_row"], reference, compared), [], "_row", compared)


# Averages by the kind of report.
AVERAGES = {"metric": avg_quality_report, "prediction": avg_prediction_report, "comparison": comparison_report}
