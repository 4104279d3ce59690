import csv
import os

import numpy as np
import pytest
from helpers import long_panel

from tidemark.operators import evaluate as E
from tidemark.plans import jobs as J
from tidemark.plans import rolling


@pytest.fixture(scope="module")
def prices():
    rng = np.random.default_rng(12)
    return {s: (rng.normal(size=n).cumsum() * 3 + 500).round(3) for s, n in (("a", 230), ("b", 140))}


def test_sliding_bounds_match_every_window(spark, prices):
    panel = long_panel(spark, prices)
    for n in (1, 7, 60, 140):
        found = {(r["series_id"], r["shift"]): (r["low_bound"], r["high_bound"]) for r in rolling.sliding_bounds(panel, ["series_id", "col"], n).collect()}
        want = {(s, i): (min(v[i:i + n]), max(v[i:i + n])) for s, v in prices.items() for i in range(len(v) - n + 1)}
        assert found == want


def test_sums_of_neighbours_reach_over_chunks(spark, prices):
    """The prefix sums of chunks of any size are those of one chunk."""
    panel = long_panel(spark, prices)
    tables = [{(r["series_id"], r["pos"]): r["prefix"] for r in rolling.prefix_table(rolling.neighbours(panel, size), size).collect()} for size in (16, 1000)]
    assert tables[0].keys() == tables[1].keys()
    for at, sums in tables[0].items():
        assert sums == pytest.approx(tables[1][at], rel=1e-9, abs=1e-6)


def test_windows_do_not_depend_on_chunks_and_short_ones_are_rows(spark, prices):
    panel = long_panel(spark, prices)
    found = [{(r["series_id"], r["shift"], r["source"], r["scale"], r["improve"]): r for r in rolling.rolling_scenarios(
        panel, [0, 5, 60], 100, 10, size=size).collect()} for size in (100, 1000)]
    assert len(found[0]) == 5 * 16 + 1 and found[0].keys() == found[1].keys()
    for at, r in found[0].items():
        if at[2] is None:
            assert at[:2] == ("b", 60) and r["reason"] == "window of 100 rows, series has 80 from there on" and r["rmse"] is None
        else:
            assert r["n"] == 10 and r["rmse"] == pytest.approx(found[1][at]["rmse"], rel=1e-7)
    y = prices["a"][5:95]
    phi, c = np.polyfit(y[:-1], y[1:], 1)
    yhat, last = [], y[-1]
    for _ in range(10):
        last = c + phi * last
        yhat.append(last)
    want = np.sqrt(np.mean((np.array(yhat) - prices["a"][95:105]) ** 2))
    assert found[0]["a", 5, "none", "-", "N"]["rmse"] == pytest.approx(want, rel=1e-8)


def test_missing_steps_are_counted(spark):
    rows = spark.createDataFrame([("a", "close", k, 1.0) for k in (1, 2)], "series_id string, col string, step int, yhat double")
    actual = spark.createDataFrame([("a", "close", k, 2.0) for k in (1, 2, 3)], "series_id string, col string, step int, real double")
    r = E.errors(rows, actual, ["series_id", "col"]).first()
    assert (r["n"], r["n_expected"]) == (2, 3)


def test_failed_groups_keep_their_rows(spark):
    series = {"ok": np.arange(1.0, 60.0), "short": [5.0] * 20}
    fits, actual = J.scenario_forecast(long_panel(spark, series), "tail_replay", 10, columns=["close"], sources=["timeliness"])
    found = {(r["series_id"], r["scale"]): r for r in J.scenario_errors(fits, actual, J.GROUP, 10).collect()}
    assert found["ok", "-"]["n"] == 10 and found["ok", "-"]["reason"] is None
    assert found["short", "-"]["n"] == 10
    assert all(found[k]["n"] == 0 and found[k]["rmse"] is None and "fewer training rows" in found[k]["reason"] for k in found if found[k]["n"] == 0)
    assert any(r["n"] == 0 and r["n_expected"] == 10 for r in found.values())


def test_short_windows_of_rolling_origins_are_rows(spark):
    from pyspark.sql import functions as F
    bars = long_panel(spark, {"a": np.arange(1.0, 31.0), "b": np.arange(1.0, 11.0)}).withColumnRenamed("real", "close").withColumn(
        "dt", F.date_add(F.lit("2024-01-01").cast("date"), F.col("pos"))).drop("col")
    found = {(r["series_id"], r["shift"]): r for r in J.rolling_origin(bars, "tail_replay", 2, 29, 5).collect()}
    assert len(found) == 6 and [found["a", s]["n"] for s in (0, 1, 2)] == [5, 5, 0]
    assert found["b", 0]["reason"] == "window of 29 rows, series has 10 from there on"


def _files(folder):
    out = {}
    for place, _, names in os.walk(folder):
        for name in names:
            if name.endswith(".csv"):
                with open(os.path.join(place, name)) as text:
                    out.setdefault(os.path.basename(place).split("=")[1], []).extend(csv.DictReader(text))
    return out


def test_averaged_predictions_are_stored_per_scenario(spark, tmp_path):
    panel = long_panel(spark, {"a": np.arange(1.0, 121.0)})
    J.save_predictions(panel, "tail_replay", str(tmp_path), n_valid=5, iterations=2)
    found = _files(tmp_path)
    assert len(found) == 16 and "a_close_tail_replay_none_5" in found
    assert [(r["step"], float(r["close"]), float(r["close - real"])) for r in found["a_close_tail_replay_none_5"]] == [
        (str(k), 110.0 + k, 115.0 + k) for k in range(1, 6)]


def test_comparisons_of_a_folder(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name in ("x", "y"):
        (source / f"{name}.csv").write_text("base,one,two\n10,11,5\n20,10,40\n")
    J.save_comparisons(spark, str(source), str(tmp_path / "out"), names=["x", "y"])
    found = _files(tmp_path / "out")
    assert {r["compared"]: (r["min"], r["max"], r["avg"]) for r in found["x"]} == {
        "one": ("1: -50.0%", "0: 10.0%", "-20.0%"), "two": ("0: -50.0%", "1: 100.0%", "25.0%")}
    with pytest.raises(Exception):
        J.save_comparisons(spark, str(source), str(tmp_path / "out"), names=["missing"])
