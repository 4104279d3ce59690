"""Small helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column, folds: int) -> Column:
    """Whether crc32 of the id as text leaves 1; a missing id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 1, F.lit(False))


def spread(df: DataFrame, *keys) -> DataFrame:
    """Deal rows to the configured number of shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def row_key() -> Column:
    """Hash of id and text: repeated rows share it; rows without an id, or with the same id, and different texts don't."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), F.col("text").cast("string"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
