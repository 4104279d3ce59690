"""Common result shape of the forecast methods, and the methods that take one training series as an array."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.types import DOUBLES, record

# Rows of one training series that the sequential methods take; they carry a state from row to row, so a group is
# one array. Training sets here are fixed windows of about 1,500 rows. Longer groups are reported, not cut.
MAX_TRAINING_ROWS = 65536

FIT = record(yhat=DOUBLES, p=T.IntegerType(), q=T.IntegerType(), prepare_ms=T.DoubleType(),
             fit_ms=T.DoubleType(), predict_ms=T.DoubleType(), error=T.StringType())


def fit_frame(n: int) -> dict:
    """Empty columns of a fit result for ``n`` groups."""
    return {"yhat": [None] * n, "p": [None] * n, "q": [None] * n, "prepare_ms": [0.0] * n, "fit_ms": [0.0] * n,
            "predict_ms": [0.0] * n, "error": [None] * n}


def finite_or_error(out: dict, i: int, yhat: np.ndarray) -> None:
    """Store a forecast, or the reason why there is none."""
    if len(yhat) and np.all(np.isfinite(yhat)):
        out["yhat"][i] = yhat
    else:
        out["error"][i] = "forecast is not finite"


def to_fit(out: dict) -> pd.DataFrame:
    frame = pd.DataFrame(out)
    for name in ("p", "q"):
        frame[name] = frame[name].astype("Int32")
    return frame


def array_method(fit_predict):
    """Pandas UDF over (training arrays, horizons) from ``fit_predict(values, horizon) -> (fit(), predict(), min)``."""

    @F.pandas_udf(FIT)
    def run(values: pd.Series, horizons: pd.Series, shocks: pd.Series) -> pd.DataFrame:
        out = fit_frame(len(values))
        for i, (v, h, z) in enumerate(zip(values, horizons, shocks)):
            start = time.perf_counter_ns()
            try:
                y = np.asarray(v, dtype=float)
                ready = time.perf_counter_ns()
                model = fit_predict.fit(y)
                fitted = time.perf_counter_ns()
                yhat = fit_predict.predict(model, int(h), np.asarray(z, dtype=float))
                done = time.perf_counter_ns()
                finite_or_error(out, i, yhat)
                out["p"][i], out["q"][i] = fit_predict.order
                out["prepare_ms"][i] = (ready - start) / 1e6
                out["fit_ms"][i] = (fitted - ready) / 1e6
                out["predict_ms"][i] = (done - fitted) / 1e6
            except (ValueError, FloatingPointError, np.linalg.LinAlgError) as reason:
                out["error"][i] = str(reason)
        return to_fit(out)

    return run


def fit_arrays(train: DataFrame, keys: list[str], horizon, method, shocks=None,
               max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Run an array method on every group of ``train`` (``keys, pos, value``).

    Fitting costs far more than its bytes suggest, so the groups are spread over all shuffle partitions instead of
    being merged by size. Of a group longer than ``max_rows`` one row more is read, which is how it is noticed; rows are
    counted, so holes and late starts don't matter.
    """
    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    oldest = Window.partitionBy(*keys).orderBy("pos")
    numbered = train.select(*keys, "pos", "value").withColumn("_rank", F.row_number().over(oldest))
    spread = numbered.filter(F.col("_rank") <= max_rows + 1).drop("_rank").repartition(parts, *keys)
    grouped = spread.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_rows"))
    last = F.element_at("_rows", -1)["pos"]
    too_long = F.size("_rows") > max_rows
    given = F.when(~too_long, F.transform("_rows", lambda s: s["value"])).otherwise(F.array().cast("array<double>"))
    z = F.array(F.lit(0.0)) if shocks is None else shocks
    fitted = grouped.withColumn("fit", method(given, horizon, z))
    reason = F.when(too_long, F.lit(f"more than {max_rows} training rows, slice the series first"))
    return fitted.select(
        *keys, "fit.yhat", "fit.p", "fit.q", "fit.prepare_ms", "fit.fit_ms", "fit.predict_ms",
        F.coalesce(reason, "fit.error").alias("error"), F.when(~too_long, last).alias("last_train_pos"),
    )
