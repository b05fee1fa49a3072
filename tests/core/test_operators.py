"""Operators on small panels: edge cases, properties, stores, adapters, streaming."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import adapters, evaluate, forecast, hierarchy, panel, weights
from tidegrid.plans import registry, store
from tidegrid.sources import panels
from tidegrid.streaming.live_panel import daily_panel

DAY = datetime.date(2020, 1, 1)
KEYS = ("item_id", "dept_id", "cat_id", "store_id", "state_id")


def frame(spark, series, price=1.0):
    rows = []
    for name, values in series.items():
        item, shop = name.split("_")
        for i, v in enumerate(values):
            if v is not None:
                rows.append((name, DAY + datetime.timedelta(i), float(v), price, item, "D" + item[0], "C", shop, "S" + shop[0]))
    return spark.createDataFrame(rows, "id string, date date, sales_quantity double, sell_price double, item_id string, dept_id string, cat_id string, store_id string, state_id string")


def scale_dense(x):
    x = np.array(x, float)
    at = np.flatnonzero(x)
    if len(at) < 2:
        return 1e-8
    return max(np.mean(np.diff(x[at[0] :]) ** 2), 1e-8)


@pytest.mark.parametrize("row,default,inclusive", [([0, 0, 5, 3], 4, 14.5), ([0, 0, 5, 0], 1e-8, 25), ([5, 0, 0], 1e-8, 12.5), ([0, 0, 0], 1e-8, 1e-8)])
def test_scale_variants(spark, row, default, inclusive):
    rows = forecast.indexed(frame(spark, {"a_x": row}))
    assert weights.scales_of(rows, ["id"], "y").first()["scale"] == pytest.approx(default)
    assert weights.scales_of(rows, ["id"], "y", "inclusive").first()["scale"] == pytest.approx(inclusive)


def test_sparse_scale_equals_dense(spark):
    rng = random.Random(3)
    series = {f"i{k}_s": [rng.choice([0, 0, 0, 1, 2, 5]) for _ in range(14)] for k in range(60)}
    rows = frame(spark, series)
    got = {r["id"]: r["scale"] for r in weights.scales_of(forecast.indexed(rows), ["id"], "y").collect()}
    assert all(got[k] == pytest.approx(scale_dense(v)) for k, v in series.items())


def test_weights_sum_to_one_and_are_uniform_without_revenue(spark):
    rows = frame(spark, {"a_x": [1, 2, 3, 4], "b_x": [0, 0, 4, 1], "a_y": [0, 0, 0, 0]})
    sums = weights.weights_scales(rows).groupBy("level").agg(F.sum("weight").alias("w")).collect()
    assert len(sums) == 12 and all(r["w"] == pytest.approx(1) for r in sums)
    none = weights.weights_scales(frame(spark, {"a_x": [0, 0, 0], "b_x": [0, 0, 0]})).where("level = 12").collect()
    assert [r["weight"] for r in none] == [0.5, 0.5]


def test_levels_add_up(spark):
    f = frame(spark, {"a_x": [1, 2], "b_x": [3, 4], "a_y": [5, 6]})
    got = hierarchy.bottom_up(f.select("id", "date", "sales_quantity"), panel.static_columns(f), 3)
    sums = {r["level"]: r["s"] for r in got.groupBy("level").agg(F.sum("sales_quantity").alias("s")).collect()}
    assert len(sums) == 12 and set(sums.values()) == {21.0}
    with pytest.raises(ValueError):
        hierarchy.bottom_up(f.select("id", "date", "sales_quantity"), panel.static_columns(f), 4)


def test_null_keys_count_in_the_total_only(spark):
    f = frame(spark, {"a_x": [1], "b_x": [3]})
    static = panel.static_columns(f).where("id = 'a_x'")
    sums = {r["level"]: r["s"] for r in hierarchy.bottom_up(f.select("id", "date", "sales_quantity"), static).groupBy("level").agg(F.sum("sales_quantity").alias("s")).collect()}
    assert sums[1] == 4 and sums[3] == 1 and sums[12] == 4


def test_perfect_forecast_scores_zero(spark):
    f = frame(spark, {"a_x": [1, 2, 3], "b_x": [3, 4, 0]})
    got = evaluate.evaluate(f, f, weights.weights_scales(f), panel.static_columns(f))
    assert got["WRMSSE"] == 0 and got["WAPE_L12"] == 0 and len(got["level_scores"]) == 12


def test_alignment(spark):
    known = frame(spark, {"a_x": [1, 2, 3], "b_x": [3, 4, 0]})
    static, ws = panel.static_columns(known), weights.weights_scales(known)
    partial = known.where("id = 'a_x' and date < '2020-01-03'")
    with pytest.warns(UserWarning):
        got = evaluate.evaluate(partial, known, ws, static)
    assert got["MAE_L12"] == pytest.approx((3 + 4) / 4)  # two dates in common, two series
    assert [r["id"] for r in evaluate.missing_series(static, partial).collect()] == ["b_x"]
    extra = frame(spark, {"a_x": [1, 2, 3], "b_x": [3, 4, 0], "z_z": [9, 9, 9]})
    assert evaluate.point_metrics(extra, known, static).first()["mae"] == 0
    with pytest.raises(ValueError):
        evaluate.check(partial.withColumn("date", F.lit(datetime.date(1999, 1, 1))), known, static)
    with pytest.raises(ValueError):
        evaluate.check(known.unionByName(known), known, static)
    assert panel.duplicates(known.unionByName(known)).count() == 6


def test_trim_modes(spark):
    f = frame(spark, {"a_x": [0, 0, 2, 0], "b_x": [0, 0, 0, 0]})
    assert [panel.trim(f, m).count() for m in panel.TRIM_MODES] == [6, 6, 2]
    with pytest.raises(ValueError):
        panel.trim(f, "other")


def test_price_fill_modes(spark):
    f = frame(spark, {"a_x": [1, 1, 1, 1], "b_x": [1, 1, 1, 1]})
    day = F.datediff("date", F.lit(DAY))
    f = f.withColumn("sell_price", F.when((F.col("id") == "a_x") & day.isin(0), 5.0).when((F.col("id") == "a_x") & day.isin(3), 7.0))
    at = lambda mode: {(r["id"], (r["date"] - DAY).days): r["price"] for r in panel.price_fill(f, mode, 2).collect()}
    assert at("history") == {("a_x", 2): 5, ("a_x", 3): 7, ("b_x", 2): 1, ("b_x", 3): 1}
    assert at("window")[("a_x", 2)] == 7


def test_future_dates_and_gaps(spark):
    f = frame(spark, {"a_x": [1, None, 1, None, 1, None, 1]})
    assert [(r["date"] - DAY).days for r in panel.future_dates(f, 2).collect()] == [8, 10]
    f = frame(spark, {"a_x": [1, None, 1, 1, 1]})
    assert [(r["date"] - DAY).days for r in panel.future_dates(f, 2).collect()] == [5, 6]


def test_plan_forecasts_equal_kernels(spark):
    from tidegrid.functions import kernels

    rng = random.Random(5)
    series = {f"i{k}_s": [rng.choice([0, 0, 1, 2, 5]) for _ in range(rng.choice([4, 9, 20, 20]))] for k in range(25)} | {"z_s": [0] * 20, "o_s": [0] * 19 + [3]}
    f = frame(spark, series)
    n = max(map(len, series.values()))
    for method, plan in (("naive", forecast.naive), ("snaive", forecast.seasonal_naive), ("ma", forecast.moving_average), ("croston", forecast.croston), ("sba", forecast.sba)):
        got: dict = {}
        for r in plan(f, 9).orderBy("date").collect():
            got.setdefault(r["id"], []).append(r["sales_quantity"])
        for k, v in series.items():
            assert got[k] == pytest.approx(kernels.forecast(np.array(v + [0] * (n - len(v)), float), 9, method).tolist()), (method, k)


def test_unknown_methods(spark):
    f = frame(spark, {"a_x": [1, 2, 3]})
    with pytest.raises(ValueError):
        forecast.local(f, ("nothing",))
    with pytest.raises(adapters.MissingBackend):
        adapters.run(("tft",), f)
    assert adapters.run(("naive", "es_bu"), f, horizon=2).count() == 4


def test_hyperparameters():
    assert adapters.hyperparameters("chronos2", {"device": "gpu"}) == {"model_path": "autogluon/chronos-2", "context_length": 2, "device": "cpu", "batch_size": 32}
    assert adapters.hyperparameters("chronos2", {"fine_tune_steps": 5, "device": "cuda:1"})["fine_tune_lr"] == 1e-4
    assert adapters.hyperparameters("tft", {"lr": 0.1})["lr"] == 0.1
    with pytest.raises(ValueError):
        adapters.hyperparameters("other")


def test_store(spark, tmp_path):
    raw = frame(spark, {"a_x": [0, 1, 2, 3], "b_x": [1, 0, 2, 2]}).withColumnRenamed("sales_quantity", "sold").withColumn("event_name_1", F.lit(None).cast("string"))
    raw.write.parquet(f"{tmp_path}/raw")
    args = (spark, f"{tmp_path}/raw", f"{tmp_path}/store_hist", "tag", "2020-01-03")
    made = store.prepared(*args)
    assert made["hist"].count() == 6 and made["future"].count() == 2 and made["hist_trimmed"].count() == 5 and made["static"].count() == 2
    assert made["hist"].select("event_name_1").distinct().first()[0] == "none"
    again = store.prepared(*args)
    assert again["weights_scales"].where("level = 12").count() == 2
    total = store.prepared(*args, level=1)
    assert total["hist"].count() == 3
    calls = []
    make = lambda: calls.append(1) or forecast.naive(made["hist"], 2)
    for _ in range(2):
        assert store.forecast(spark, make, f"{tmp_path}/store_hist", "tag", "2020-01-03", "naive").count() == 4
    assert len(calls) == 1
    assert store.leaderboard(spark, f"{tmp_path}/store_hist", "tag", "2020-01-03").count() == 0
    for name, v in (("m1", 2.0), ("m2", 1.0)):
        store.save_metrics(spark, {"WRMSSE": np.float64(v), "level_scores": {"RMSSE_L1": v}}, f"{tmp_path}/store_hist", "tag", "2020-01-03", name)
    assert [r["exp_tag"] for r in store.leaderboard(spark, f"{tmp_path}/store_hist", "tag", "2020-01-03").collect()] == ["m2", "m1"]


def test_read_panel_and_truth(spark, tmp_path):
    frame(spark, {"a_x": [1]}).drop("sales_quantity").write.parquet(f"{tmp_path}/none")
    with pytest.raises(ValueError):
        panels.read_panel(spark, f"{tmp_path}/none")
    (tmp_path / "cal.csv").write_text("d,date\nd_1,2020-01-01\n")
    (tmp_path / "truth.csv").write_text("item_id,store_id,d_1,d_2\ni,s,3,4\n")
    got = panels.melt_truth(panels.read_wide_truth(spark, f"{tmp_path}/truth.csv"), panels.read_calendar(spark, f"{tmp_path}/cal.csv"))
    rows = {(r["id"], str(r["date"]), r["sales_quantity"]) for r in got.withColumn("id", panels.strip_suffix(F.col("id"))).collect()}
    assert rows == {("i_s", "2020-01-01", 3.0), ("i_s", "None", 4.0)}


def test_stream_equals_batch(spark, tmp_path):
    events = panels.table(spark, "/root/testdata/sf0.001", "events")
    (events.coalesce(1).write.parquet(f"{tmp_path}/in"))
    stream = daily_panel(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "event_type")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("live").start()
    run.processAllAvailable()
    run.stop()
    key = lambda df: sorted((r["id"], str(r["date"]), r["sales_quantity"]) for r in df.collect())
    assert key(spark.table("live")) == key(panels.event_panel(spark, "/root/testdata/sf0.001"))


def test_scan_is_pruned(spark):
    text = registry.history(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_discount" not in text and "PushedFilters" in text
