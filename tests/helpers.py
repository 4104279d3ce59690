import pandas as pd


def long_panel(spark, series: dict, col: str = "close", name: str = "real"):
    """Panel ``series_id, col, pos, <name>`` from lists; None stays missing."""
    rows = [(s, col, i, None if v is None else float(v)) for s, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, f"series_id string, col string, pos int, {name} double")


def values_of(df, value: str, *order: str) -> list:
    return [r[value] for r in df.orderBy(*order).collect()]


def frame(df, *order: str) -> pd.DataFrame:
    return df.orderBy(*order).toPandas()
