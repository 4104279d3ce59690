import math

import pytest
from helpers import long_panel, values_of
from pyspark.sql import functions as F

from tidemark.config import COLUMNS, DECLINES, WEIGHTS
from tidemark.functions import scoring
from tidemark.operators import quality as Q
from tidemark.operators.deviate import deviate_wide
from tidemark.plans import catalog as C
from tidemark.plans import jobs as J


@pytest.mark.parametrize("noised, real, alpha, want", [
    (110.0, 100.0, 0.5, 0.6984886554), (110.0, 100.0, 1.0, 0.9090909091), (80.0, 100.0, 0.5, 0.5527864045),
    (7.0, 7.0, 0.5, 1.0), (0.0, 0.0, 0.5, 1.0),
])
def test_correctness_goldens(spark, noised, real, alpha, want):
    score = spark.range(1).select(scoring.correctness(F.lit(noised), F.lit(real), alpha)).first()[0]
    assert score == pytest.approx(want, abs=1e-10)


def test_correctness_of_a_missing_value_is_missing(spark):
    none = F.lit(None).cast("double")
    assert spark.range(1).select(scoring.correctness(none, F.lit(1.0), 0.5)).first()[0] is None


@pytest.mark.parametrize("decline, days, want", [(0.4, 5, 0.9945355328), (2.0, 400, 0.1117176222)])
def test_timeliness_goldens(spark, decline, days, want):
    score = spark.range(1).select(scoring.timeliness(decline, F.lit(days / 365.0))).first()[0]
    assert score == pytest.approx(want, abs=1e-10)


def test_tuple_timeliness_golden(spark):
    row = spark.range(1).select(F.lit(100 / 365.0).alias("age_years")).select(Q.tuple_timeliness()).first()
    assert row[0] == pytest.approx(0.8334891866, abs=1e-10)


def test_completeness_golden(spark):
    wide = spark.createDataFrame([("a", i, "highly", o, c) for i, (o, c) in enumerate(
        [(1.0, 1.0), (1.0, None), (None, None), (2.0, 2.0)])], "series_id string, pos int, scale string, open double, close double")
    assert values_of(Q.completeness_tuples(wide, ["open", "close"]), "complete", "pos") == [True, False, False, True]
    assert Q.completeness_relation(wide, ["open", "close"]).first()["score"] == 0.5


def test_weights(spark):
    assert scoring.normalized(WEIGHTS, ["open", "close"]) == {"open": 0.5, "close": 0.5}
    panel = long_panel(spark, {"a": [1]}, "open").union(long_panel(spark, {"a": [1]}, "close"))
    assert values_of(Q.weights_normalized(panel), "weight", "col") == [0.5, 0.5]


def test_relation_is_null_with_a_missing_value(spark):
    bars = spark.sql(f"select 'a' series_id, id pos, {', '.join(f'cast(id + 1 as double) {c}' for c in COLUMNS)} from range(5)")
    holed = bars.withColumn("close", F.when(F.col("pos") != 2, F.col("close")))
    scores = {r["scale"]: r["score"] for r in Q.correctness_relation(deviate_wide(holed, "noise")).collect()}
    assert set(scores.values()) == {None}
    kept = Q.correctness_relation(deviate_wide(holed, "noise"), ["open", "high"]).collect()
    assert all(0 < r["score"] <= 1 for r in kept)


def test_long_and_wide_relations_agree(spark, sf):
    from tidemark.operators.deviate import deviate
    from tidemark.operators.panel import unpivot
    bars = C.bars_once(spark, sf)
    wide = Q.correctness_relation(deviate_wide(bars, "noise")).withColumnRenamed("score", "w")
    long = Q.correctness_relation_long(deviate(unpivot(bars), "noise"))
    assert all(r["w"] == pytest.approx(r["score"], abs=1e-12) for r in wide.join(long, ["series_id", "scale"]).collect())
    wide = Q.completeness_relation(deviate_wide(bars, "incompleteness")).withColumnRenamed("score", "w")
    long = Q.completeness_relation_long(deviate(unpivot(bars), "incompleteness"))
    rows = wide.join(long, ["series_id", "scale"]).collect()
    assert len(rows) == 9 and all(r["w"] == pytest.approx(r["score"], abs=1e-12) for r in rows)


def test_timeliness_rejects_columns_for_full_damage(spark, sf):
    with pytest.raises(ValueError):
        Q.timeliness_relation(C.bars(spark, sf), ["close"])


def test_partial_timeliness_by_hand(spark):
    bars = spark.sql("select 'a' series_id, date_add(date'2020-01-01', cast(id as int)) dt, cast(id as int) pos from range(4)")

    def tuple_score(days):
        return sum(WEIGHTS[c] * math.exp(-DECLINES[c] * days / 365) for c in COLUMNS) / sum(WEIGHTS.values())

    def mean(extra):
        return sum(tuple_score(3 - i + extra) for i in range(4)) / 4

    found = {r["scale"]: r["score"] for r in Q.timeliness_relation_partial(bars).collect()}
    assert found["highly"] == pytest.approx(0.6 * mean(0) + 0.4 * mean(400), abs=1e-12)
    only = {r["scale"]: r["score"] for r in Q.timeliness_relation_partial(bars, ["close"]).collect()}
    assert only["highly"] == pytest.approx(mean(400), abs=1e-12)


def test_quality_report_rows(spark, sf):
    report = J.quality_report(C.bars_once(spark, sf)).toPandas()
    counts = report.groupby(["series_id", "source"]).size().unstack()
    assert (counts["noise"] == 12).all() and (counts["incompleteness"] == 12).all() and (counts["timeliness"] == 6).all()
    fixed = report[(report.source == "incompleteness") & (report.improve == "Y")]
    assert (fixed.score == 1.0).all()
    assert report.score.between(0, 1).all()


def test_quality_report_of_one_column(spark, sf):
    report = J.quality_report(C.bars_once(spark, sf), ["close"]).toPandas()
    stale = report[report.source == "timeliness"]
    assert set(stale["range"]) == {"partially"} and len(stale) == 9
