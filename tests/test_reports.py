import pytest
from helpers import frame, long_panel, values_of
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import evaluate as E
from tidemark.operators import report as R
from tidemark.plans import catalog as C
from tidemark.plans import jobs as J
from tidemark.plans import scenarios as S
from tidemark.sources import bars as B


def test_error_goldens(spark):
    rows = spark.createDataFrame([("a", "close", i + 1, v) for i, v in enumerate([12.0, 18.0, 44.0])], "series_id string, col string, step int, yhat double")
    actual = spark.createDataFrame([("a", "close", i + 1, v) for i, v in enumerate([10.0, 20.0, 40.0])], "series_id string, col string, step int, real double")
    found = E.errors(rows, actual, ["series_id", "col"]).first()
    assert found["rmse"] == pytest.approx(2.8284271247) and found["mae"] == pytest.approx(2.6666666667)
    assert found["mape"] == pytest.approx(13.3333333333) and found["n"] == 3
    zero = actual.withColumn("real", F.when(F.col("step") != 2, F.col("real")).otherwise(0.0))
    found = E.errors(rows, zero, ["series_id", "col"]).first()
    assert found["mape_n"] == 2 and found["mape"] == pytest.approx(15.0)


def test_align_drops_the_delay(spark):
    rows = spark.range(1, 21).select(F.lit("a").alias("series_id"), F.col("id").cast("int").alias("step"), F.lit(5).alias("delay"), F.col("id").alias("yhat"))
    kept = frame(E.forecast_align(rows, 15), "step")
    assert list(kept["step"]) == list(range(1, 16)) and list(kept["yhat"]) == list(range(6, 21))


def test_scenario_order(spark):
    grid = S.scenarios()
    assert [r[0] for r in grid] == list(range(1, 17))
    assert "".join(r[3] for r in grid) == "N" + "NYNYNY" * 2 + "NNN"
    assert [r[1] for r in grid] == ["none"] + ["noise"] * 6 + ["incompleteness"] * 6 + ["timeliness"] * 3
    assert len(S.scenarios(mitigated=False)) == 10 and len(S.scenarios(["noise"], ["highly"])) == 3


def test_scenario_panel_counts(spark):
    panel = long_panel(spark, {"a": range(60)})
    found = S.scenario_panel(panel, columns=["close"]).groupBy("source", "scale", "improve").count().collect()
    assert len(found) == 16 and {r["count"] for r in found} == {60}


def test_train_split_takes_the_delay_off(spark):
    panel = S.with_border(long_panel(spark, {"a": range(100)}), 15)
    scen = S.scenario_panel(panel, mitigated=False, columns=["close"])
    found = S.train_split(scen).filter("source = 'timeliness' and scale = 'highly'").groupBy("role").agg(
        F.min("pos"), F.max("pos"), F.count("*")).orderBy("role").collect()
    assert [tuple(r) for r in found] == [("train", 0, 34, 35), ("validate", 85, 99, 15)]
    assert S.max_delay() == 50 and S.max_delay("partially", scale="slightly") == 5


def test_repeat_stats_skip_warm_up_and_failures(spark):
    runs = spark.createDataFrame([
        ("a", 0, 0, 100.0, 9.0), ("a", 1, 0, 1.0, 2.0), ("a", 2, 0, 3.0, 4.0), ("a", 3, 1, None, None), ("b", 1, 0, 5.0, 1.0)],
        "series_id string, iteration int, failed int, fit_ms double, rmse double")
    zeros = {c: F.lit(0.0) for c in ("prepare_ms", "predict_ms", "mitigation_ms", "mae", "mape")}
    full = runs.withColumns({**zeros, "p": F.lit(None).cast("int"), "q": F.lit(None).cast("int")})
    a, b = E.repeat_stats(full, ["series_id"]).orderBy("series_id").collect()
    assert (a["iterations"], a["fit_ms"], a["rmse"]) == (2, 2.0, 3.0) and a["time_sd"] == pytest.approx(2 ** 0.5)
    assert b["iterations"] == 1 and b["time_sd"] is None


def test_weighted_errors_need_every_column(spark):
    rows = spark.createDataFrame([("a", "open", 2.0), ("a", "close", 4.0), ("b", "open", 1.0)], "series_id string, col string, rmse double")
    rows = rows.withColumns({"mae": F.col("rmse"), "mape": F.col("rmse")})
    assert values_of(E.weighted_errors(rows, ["series_id", "col"], ["open", "close"]), "rmse", "series_id") == [3.0, None]


def test_time_text(spark):
    row = spark.range(1).select(scoring.time_text(F.lit(1.5), F.lit(2.25), F.lit(0.75)).alias("time_text"))
    assert row.first()[0] == "1.50 + 2.25 + 0.75"
    assert tuple(R.split_times(row).first())[1:] == (1.5, 2.25, 0.75)


def test_relative_change_golden(spark):
    table = spark.createDataFrame([(0, 10.0, 12.0), (1, 20.0, 30.0)], "row long, ref double, x double").withColumn("t", F.lit("t"))
    change = R.relative_change(table, ["t", "row"], "ref", ["x"])
    assert values_of(change, "x", "row") == pytest.approx([0.2, 0.5])
    assert tuple(R.relative_change_summary(change, ["t"], "row", ["x"]).first())[2:] == ("0: 20.0%", "1: 50.0%", "35.0%")


def test_incomplete_report_files_are_skipped(spark):
    rows = [(f, n, "-", "-", "N", "1.00 + 2.00 + 3.00", 0.1, 0.0, None if f == "bad" and n == 7 else 1.0, 2.0, 3.0)
            for f in ("good", "bad", "fine") for n in range(1, 17)]
    reports = spark.createDataFrame(rows, "file_name string, num int, dev string, scale string, improve string, time_text string, "
                                          "time_sd double, mitigation_ms double, rmse double, mae double, mape double")
    found = R.avg_prediction_report(reports)
    assert found.count() == 16 and {r["files"] for r in found.collect()} == {2}
    assert [r["file_name"] for r in R.skipped_files(reports).collect()] == ["bad"]


def test_common_labels(spark):
    names = spark.createDataFrame([("x_close_Ces_15.csv",), ("y_close_Ces_15.csv",)], "file_name string")
    row = R.common_labels(names, ["company", "column", "method", "size"]).first()
    assert row["name"] == "average_close_Ces_15" and row["company"] is None


def test_prediction_report_has_sixteen_rows(spark):
    panel = long_panel(spark, {"a": [100 + (i * 7) % 13 for i in range(140)], "b": [50 + (i * 5) % 11 for i in range(150)]})
    for method in ("ces", "arima"):
        found = frame(J.prediction_report(panel, method, iterations=2), "series_id", "num")
        assert list(found["num"]) == list(range(1, 17)) * 2
        assert found[["rmse", "mae", "mape", "time_sd"]].notna().all().all()
        assert (found["iterations"] == 2).all()
        assert (found["mitigation_ms"] > 0).tolist() == (found["improve"] == "Y").tolist()
        assert found["order"].notna().all() == (method == "arima")


def test_csv_round_trips(spark, sf, tmp_path):
    bars = C.bars(spark, sf).drop("pos")
    B.write_bars_csv(bars, str(tmp_path / "bars"))
    back = B.read_bars_csv(spark, str(tmp_path / "bars")).select(*bars.columns)
    assert back.exceptAll(bars).count() == 0 and back.count() == bars.count()
    one = tmp_path / "plain"
    one.mkdir()
    (one / "A B.csv").write_text("Date,open,high,low,close,adj_close,volume\n2020-01-02,1,3,0.5,2,1.9,10\n")
    row = B.read_bars_csv(spark, str(one)).first()
    assert (row["series_id"], str(row["dt"]), row["high"], row["adj_close"]) == ("A B", "2020-01-02", 3.0, 1.9)


SCORES = "range string, scale string, improve string, score double"


def test_report_round_trip_and_empty_input(spark, tmp_path):
    df = spark.createDataFrame([("IBM", "all", "highly", "N", 0.5), ("HP", "all", "highly", "N", 0.7)], "c string, " + SCORES)
    B.write_report(R.named(df, F.col("c"), ["open", "close"], F.lit("noised")).drop("c"), str(tmp_path / "r"))
    back = B.read_reports(spark, str(tmp_path / "r"), SCORES)
    assert values_of(back, "file_name", "file_name") == ["HP_open-close_noised", "IBM_open-close_noised"]
    row = R.AVERAGES["metric"](back).first()
    assert row["score"] == pytest.approx(0.6) and row["files"] == 2
    with pytest.raises(ValueError):
        B.require_rows(df.filter("score > 1"), "nowhere")


def test_saved_runs_add_up_and_average(spark, tmp_path):
    panel = long_panel(spark, {"a": [100 + (i * 7) % 13 for i in range(140)], "b": range(1, 141)})
    for _ in range(2):
        J.save_prediction_reports(panel, "ces", str(tmp_path / "p"), ["a"], unique=True, iterations=2)
    schema = ("series_id string, num int, dev string, scale string, improve string, time_text string, time_sd double, "
              "mitigation_ms double, rmse double, mae double, mape double, order string, iterations int")
    back = B.read_reports(spark, str(tmp_path / "p"), schema)
    assert back.count() == 32 and {r["file_name"] for r in back.collect()} == {"a_close_ces_15"}


def test_prepared_data(spark, tmp_path):
    J.prepare_data(long_panel(spark, {"a": range(40)}), str(tmp_path), columns=["close"])
    assert spark.read.parquet(str(tmp_path / "series")).count() == 640
    assert spark.read.parquet(str(tmp_path / "mitigation_time")).filter("elapsed_ms > 0").count() == 6


def test_scenario_table_prunes_by_folder(spark, tmp_path):
    panel = long_panel(spark, {"a": range(40)})
    B.write_scenarios(S.scenario_panel(panel, columns=["close"]), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 640
    plan = back.filter("source = 'noise' and improve = 'Y'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(source" in plan


def test_download_names(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "`Adj Close` double, Open double")
    assert B.rename_downloaded(df).columns == ["adj_close", "open"]
