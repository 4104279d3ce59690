import datetime as dt
import random

import pandas as pd
import pytest
from helpers import frame, long_panel, values_of
from pyspark.sql import functions as F

from tidemark.operators import panel as P


def test_number_rows_with_one_hot_series(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"s{rng.randrange(20)}", rng.random(), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, ts double, id long").repartition(7)
    found = frame(P.number_rows(df, ["k"], ["ts", "id"]), "id")
    want = pd.DataFrame(rows, columns=["k", "ts", "id"]).sort_values(["k", "ts", "id"])
    want["pos"] = want.groupby("k").cumcount()
    assert list(found["pos"]) == list(want.sort_values("id")["pos"])


def test_renumber_closes_gaps_across_chunks(spark):
    df = long_panel(spark, {"a": range(500), "b": range(37)}).filter("pos % 3 != 1")
    found = frame(P.renumber(df, ["series_id"], size=16), "series_id", "real")
    want = found.groupby("series_id").cumcount()
    assert list(found["pos"]) == list(want)


@pytest.mark.parametrize("fan", [2, 5, 4096])
def test_running_before_equals_cumulative_sum(spark, fan):
    rows = [("a", c, float(c * c)) for c in range(60)] + [("b", c, 1.0) for c in range(7)]
    df = spark.createDataFrame(rows, "k string, chunk long, v double")
    found = frame(P.running_before(df, ["k"], "v", "before", fan=fan), "k", "chunk")
    want = found.groupby("k")["v"].cumsum() - found["v"]
    assert list(found["before"]) == list(want)


def test_halo_repeats_border_rows_only(spark):
    df = long_panel(spark, {"a": range(100)})
    halo = P.with_halo(df, 3, 2, size=10)
    assert halo.filter("core").count() == 100
    own = frame(halo.filter("chunk = 4"), "pos")
    assert list(own["pos"]) == list(range(37, 52))
    assert list(own["core"]) == [False] * 3 + [True] * 10 + [False] * 2
    with pytest.raises(ValueError):
        P.with_halo(df, 11, 0, size=10)


def test_attach_reaches_every_chunk(spark):
    df = long_panel(spark, {"a": range(95), "b": range(3)}).withColumn("chunk", P.chunk_of("pos", 10))
    stats = df.groupBy("series_id").agg(F.sum("real").alias("total"), (F.max("pos") + 1).alias("rows"))
    found = P.attach(df, stats, ["series_id"], 10)
    assert found.count() == 98
    assert found.filter("total is null").count() == 0


def bars_of(spark, lengths: dict):
    start = dt.date(2020, 1, 1)
    rows = [(s, start + dt.timedelta(days=i), float(i)) for s, n in lengths.items() for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, dt date, close double")


def test_slice_from_one_date_reports_short_and_missing_series(spark):
    bars = bars_of(spark, {"full": 30, "short": 12, "early": 5})
    cut = P.slice_window(bars, "2020-01-08", 10)
    full = frame(cut.filter("series_id = 'full'"), "pos")
    assert list(full["pos"]) == list(range(10)) and full["close"].iloc[0] == 7.0
    assert full["complete"].all() and full["found"].all()
    assert set(values_of(cut.filter("series_id = 'short'"), "complete", "pos")) == {False}
    early = cut.filter("series_id = 'early'").collect()
    assert len(early) == 1 and early[0]["found"] is False and early[0]["dt"] is None


def test_rolling_windows_match_slices(spark):
    bars = bars_of(spark, {"a": 40}).withColumn("pos", F.datediff("dt", F.lit("2020-01-01")))
    found = frame(P.rolling_windows(bars, 5, 20), "shift", "pos")
    assert list(found.groupby("shift").size()) == [20] * 6
    assert (found["close"] == found["shift"] + found["pos"]).all()


def test_pivot_inverts_unpivot(spark, sf):
    from tidemark.plans import catalog as C
    bars = C.bars(spark, sf)
    back = P.pivot(P.unpivot(bars)).select(*bars.columns)
    assert back.exceptAll(bars).count() == 0 and bars.exceptAll(back).count() == 0


def test_windows_from_any_table_of_dates(spark):
    from datetime import date, timedelta

    import numpy as np
    from pyspark.sql import functions as F
    rng = np.random.default_rng(4)
    day = date(2020, 1, 1)
    rows = {s: sorted({day + timedelta(int(d)) for d in rng.integers(0, span, count)}) for s, span, count in (("a", 900, 200), ("b", 90, 40), ("c", 3000, 12))}
    bars = spark.createDataFrame([(s, d, float(i)) for s, ds in rows.items() for i, d in enumerate(ds)], "series_id string, dt date, close double")
    asked = [(s, k, day + timedelta(int(x))) for s in (*rows, "none") for k, x in enumerate(rng.integers(-300, 1100, 25))] + [("a", 99, rows["a"][5])]
    starts = spark.createDataFrame(asked, "series_id string, shift int, start_dt date")
    cut = P.slice_window(bars, starts, 30)
    got = {}
    for r in cut.collect():
        got.setdefault((r["series_id"], r["shift"]), []).append(r)
    assert len(got) == len(asked)
    for s, k, start in asked:
        want = [d for d in rows.get(s, []) if d >= start][:30]
        found = sorted(got[s, k], key=lambda r: -1 if r["pos"] is None else r["pos"])
        if not want:
            assert len(found) == 1 and found[0]["dt"] is None and not found[0]["complete"] and not found[0]["found"]
            continue
        assert [r["dt"] for r in found] == want and [r["pos"] for r in found] == list(range(len(want)))
        assert {r["complete"] for r in found} == {len(want) == 30} and {r["found"] for r in found} == {start in want}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = P._rows_from(bars, starts, 30)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert len(joins) == 2 and all("_bin" in line for line in joins)


def test_limit_of_a_slice_holds_before_the_shuffle(spark):
    bars = spark.range(100).selectExpr("cast(id % 3 as string) as series_id", "date_add(date '2020-01-01', cast(id as int)) as dt", "double(id) as close")
    plan = P.slice_window(bars, "2020-01-05", 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
