import math

import pytest
from helpers import frame, long_panel, values_of
from pyspark.sql import functions as F

from tidemark.config import SCALES
from tidemark.functions import rng
from tidemark.operators import deviate as D


def test_golden_draw(spark):
    key = rng.draw_key("42", "noise", "slightly", "close", "A", 0)
    row = spark.range(1).select(rng.bits(key).alias("b")).select(
        rng.uniform(F.col("b")).alias("u"), rng.normal(F.col("b")).alias("z")).first()
    assert row["u"] == pytest.approx(0.8746298692421988, abs=1e-15)
    assert row["z"] == pytest.approx(-0.2895183242646621, abs=1e-14)


def test_noise_spread_follows_the_range(spark):
    panel = long_panel(spark, {"a": [10, 12, 11, 13, 12]})
    grid = {s: {"close": 4.0} for s in SCALES}
    found = D.deviate(panel, "noise", grid=grid)
    z = rng.normal(rng.bits(rng.draw_key("42", "noise", F.col("scale"), "close", F.col("series_id"), F.col("pos"))))
    gap = found.withColumn("gap", F.abs(F.col("value") - F.col("real") - F.lit(0.12) * z)).agg(F.max("gap")).first()[0]
    assert gap < 1e-12


def test_noise_has_the_wanted_deviation(spark):
    panel = long_panel(spark, {"a": [i % 101 for i in range(20000)]})
    found = frame(D.deviate(panel, "noise").groupBy("scale").agg(
        F.stddev(F.col("value") - F.col("real")).alias("sd"), F.avg(F.col("value") - F.col("real")).alias("mean")), "scale")
    want = {"slightly": 0.7, "moderately": 1.7, "highly": 4.0}
    for _, row in found.iterrows():
        assert row["sd"] == pytest.approx(want[row["scale"]], rel=0.03)
        assert abs(row["mean"]) < 4 * row["sd"] / math.sqrt(20000)


def test_gap_share_and_independence_of_partial_draws(spark):
    panel = long_panel(spark, {"a": range(20000)})
    full = D.deviate(panel, "incompleteness")
    part = D.deviate(panel, "incompleteness", "partially")
    share = {r["scale"]: r["p"] for r in full.groupBy("scale").agg(F.avg(F.col("value").isNull().cast("int")).alias("p")).collect()}
    assert share["slightly"] == pytest.approx(0.05, abs=0.01)
    assert share["highly"] == pytest.approx(0.3, abs=0.015)
    both = full.filter("scale = 'highly'").select("pos", F.col("value").alias("f")).join(
        part.filter("scale = 'highly'").select("pos", F.col("value").alias("p")), "pos")
    joint = both.agg(F.avg((F.col("f").isNull() & F.col("p").isNull()).cast("int"))).first()[0]
    assert joint == pytest.approx(0.09, abs=0.015)


def test_undamaged_columns_stay(spark):
    panel = long_panel(spark, {"a": range(50)}, col="high")
    for source in ("noise", "incompleteness"):
        found = D.deviate(panel, source, "partially")
        assert found.filter("value is null or value != real or strength != 0").count() == 0


def test_result_does_not_depend_on_partitioning(spark):
    panel = long_panel(spark, {"a": range(300), "b": range(100)})
    one = frame(D.deviate(panel.coalesce(1), "noise"), "series_id", "scale", "pos")
    many = frame(D.deviate(panel.repartition(9), "noise"), "series_id", "scale", "pos")
    assert (one["value"] == many["value"]).all()


def test_custom_deviation(spark):
    panel = long_panel(spark, {"a": [1, 2, 3]})
    shifted = D.deviate(panel, "noise", method=lambda v, strength, drawn, lo, hi: v + strength * (hi - lo))
    assert values_of(shifted.filter("scale = 'highly'"), "value", "pos") == [9.0, 10.0, 11.0]


def test_wide_and_long_agree(spark, sf):
    from tidemark.operators.panel import unpivot
    from tidemark.plans import catalog as C
    bars = C.bars_once(spark, sf)
    for source in ("noise", "incompleteness"):
        for range_ in ("all", "partially"):
            wide = D.deviate_wide(bars, source, range_).select("series_id", "pos", "scale", "close", "open", "volume")
            long = D.deviate(unpivot(bars), source, range_).groupBy("series_id", "pos", "scale").agg(
                *[F.max(F.when(F.col("col") == c, F.col("value"))).alias(c) for c in ("close", "open", "volume")])
            both = wide.join(long.withColumnsRenamed({c: f"l_{c}" for c in ("close", "open", "volume")}), ["series_id", "pos", "scale"])
            bad = both.filter(" or ".join(f"not ({c} <=> l_{c})" for c in ("close", "open", "volume")))
            assert both.count() == bars.count() * 3 and bad.count() == 0


def test_row_ages(spark):
    bars = spark.sql("""select 'a' series_id, date'2020-01-01' dt, 0 pos union all select 'a', date'2020-01-03', 1
                        union all select 'a', date'2020-01-10', 2""")
    ages = D.row_ages(bars, {"slightly": 5})
    assert values_of(ages, "time_diff", "pos") == [8, 7, 6]
    assert values_of(ages, "age_years", "pos") == pytest.approx([14 / 365, 12 / 365, 5 / 365])
    today = D.row_ages(bars, {"slightly": None}).filter("pos = 0").first()
    assert today["time_diff"] is None and today["age_years"] > 6


def test_delays_leave_values_alone(spark):
    panel = long_panel(spark, {"a": range(5)})
    found = D.delays(panel, "partially")
    assert [(r["scale"], r["delay"]) for r in found.filter("pos = 0").collect()] == [
        ("slightly", 5), ("moderately", 20), ("highly", 50)]
