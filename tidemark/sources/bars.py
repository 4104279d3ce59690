"""Readers and writers: price CSV folders, scenario tables, report folders, and panels of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import COLUMNS

BARS_CSV = T.StructType(
    [T.StructField("Date", T.DateType())] + [T.StructField(c, T.DoubleType()) for c in COLUMNS]
)

# Header of a price CSV and names used by downloaded files.
CSV_HEADER = ["Date", "open", "high", "low", "close", "adj_close", "volume"]
DOWNLOAD_NAMES = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close",
                  "Volume": "volume"}


def _file_stem():
    return F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"\.csv$", "")


def _name_of(key: str):
    """Name of the data in a file: its ``<key>=`` directory when written here, else the file name."""
    in_path = F.url_decode(F.regexp_extract("_metadata.file_path", rf"{key}=([^/]+)/", 1))
    return F.when(in_path != "", in_path).otherwise(_file_stem())


def read_bars_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of price CSVs, one file or ``series_id=`` directory per series -> ``series_id, dt, open .. volume``."""
    schema = T.StructType([BARS_CSV[c] for c in CSV_HEADER])
    reader = spark.read.schema(schema).option("header", True).option("dateFormat", "yyyy-MM-dd")
    raw = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder)
    return raw.select(_name_of("series_id").alias("series_id"), F.col("Date").alias("dt"), *COLUMNS)


def rename_downloaded(df: DataFrame) -> DataFrame:
    """Bring the headers of a downloaded price table to the names used here."""
    return df.withColumnsRenamed(DOWNLOAD_NAMES)


def write_bars_csv(bars: DataFrame, folder: str) -> None:
    """Write bars as CSV, one directory per series."""
    ordered = ["series_id", F.date_format("dt", "yyyy-MM-dd").alias("Date")] + CSV_HEADER[1:]
    bars.select(*ordered).write.mode("overwrite").partitionBy("series_id").option("header", True).csv(folder)


def write_scenarios(panel: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """Write real, damaged and repaired series as one table whose folders can be pruned by scenario."""
    panel.write.mode("overwrite").partitionBy("source", "scale", "improve").format(fmt).save(folder)


def write_report(df: DataFrame, folder: str, by=("file_name",), run_id: str | None = None) -> None:
    """Write a report as CSV with a header, one directory per value of ``by``; runs add up under their ids."""
    if run_id is not None:
        df, by = df.withColumn("run_id", F.lit(run_id)), (*by, "run_id")
    mode = "overwrite" if run_id is None else "append"
    df.write.mode(mode).partitionBy(*by).option("header", True).csv(folder)


def read_reports(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All report CSVs of a folder in one scan, each row with the name of its file."""
    reader = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True)
    raw = reader.option("pathGlobFilter", "*.csv").csv(folder)
    return require_rows(raw.select(_name_of("file_name").alias("file_name"), "*"), folder)


def require_rows(df: DataFrame, name: str) -> DataFrame:
    """Fail early and clearly when an input holds nothing."""
    if df.isEmpty():
        raise ValueError(f"no rows found in {name}")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Daily bars per return flag; rows without a flag or date belong to no bar.

    The first and last trade of a day are the ends of a six-column row order. Comparing whole rows takes a sorting
    aggregate, so a first pass finds the ends of the leading order key and the other measures with plain hash
    aggregates, and only the few rows on those keys enter the full comparison. Both passes reduce a day before the
    shuffle, so a flag that holds most rows costs no more than others. The joined side has one row per flag and
    calendar day.
    """
    px = F.col("l_extendedprice")
    trades = lineitem.withColumns({"series_id": F.col("l_returnflag"), "dt": F.col("l_shipdate").cast("date")})
    days = trades.groupBy("series_id", "dt").agg(
        F.min("l_orderkey").alias("_first"), F.max("l_orderkey").alias("_last"), F.max(px).alias("high"),
        F.min(px).alias("low"), F.sum("l_quantity").alias("volume"),
    )
    ends = trades.join(days, ["series_id", "dt"]).filter(F.col("l_orderkey").isin(F.col("_first"), F.col("_last")))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
    last = F.max(order)
    return ends.groupBy("series_id", "dt").agg(
        F.min(order)["l_extendedprice"].alias("open"),
        last["l_extendedprice"].alias("close"),
        (last["l_extendedprice"] * (F.lit(1.0) - last["l_discount"])).alias("adj_close"),
        *[F.first(c).alias(c) for c in ("high", "low", "volume")],
    )


def ticks_from_events(events: DataFrame) -> DataFrame:
    """Irregular series per user: ``series_id, col, ts, event_id, real``."""
    return events.select(
        F.col("user_id").cast("string").alias("series_id"),
        F.lit("value").alias("col"),
        "ts",
        "event_id",
        F.col("value").alias("real"),
    )


def typed_ticks_from_events(events: DataFrame) -> DataFrame:
    """As :func:`ticks_from_events` with one column of the panel per event type."""
    return events.select(
        F.col("user_id").cast("string").alias("series_id"),
        F.col("event_type").alias("col"),
        "ts",
        "event_id",
        F.col("value").alias("real"),
    )
