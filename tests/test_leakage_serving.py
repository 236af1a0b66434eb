from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixture_values import CFG
from hourloom.config import DEFAULTS, FEATURES
from hourloom.functions.quantiles import exact_quantiles
from hourloom.operators import audit as A
from hourloom.operators import explore as X
from hourloom.operators import features as FE
from hourloom.operators import forecasters as FC
from hourloom.operators import metrics as M
from hourloom.operators import serving as S
from hourloom.operators import trees as TR
from hourloom.plans import pipeline
from hourloom.sources import readers


@pytest.fixture(scope="module")
def last(fold_table):
    return fold_table.where("fold = 12")


def changed(clean, features, last, column):
    rows = A.leakage_replay(clean, features, last, column).collect()
    assert len(rows) == 2 * len(FEATURES)
    return {r["feature"] for r in rows if r["changed_hours"]}


def test_future_load_reaches_no_feature(clean, features, last):
    assert changed(clean, features, last, "load") == set()


def test_future_temperature_reaches_exactly_the_forecast_inputs(clean, features, last):
    assert changed(clean, features, last, "temp_c") == {"temp", "hdd", "cdd"}


def test_past_load_does_reach_features(clean, features, last):
    early = last.withColumn("cutoff", F.col("cutoff") - F.expr("INTERVAL 30 HOURS"))
    rebuilt = FE.build_features(A.corrupt_after(clean, early, "load"))
    day = rebuilt.join(last.withColumnRenamed("target_date", "op_date"), ["series", "op_date"])
    old = features.select("series", "ts", F.col("lag_24").alias("old"))
    assert day.join(old, ["series", "ts"]).where("lag_24 <> old").count() > 0


def test_permuted_target_keeps_values_over_the_whole_history(features):
    shuffled = A.shuffle_target(features).select("series", "ts", F.col("y").alias("z"))
    got = features.join(shuffled, ["series", "ts"]).toPandas()
    assert len(got) == features.count()
    for _, p in got.groupby("series"):
        assert sorted(p.y) == sorted(p.z)
        assert abs(np.corrcoef(p.y, p.z)[0, 1]) < 0.05
        order = p.sort_values("ts")
        months = order.ts.dt.to_period("Q").nunique()
        where = {v: k for k, v in enumerate(order.y)}
        moved = np.array([where[v] for v in order.z]) - np.arange(len(order))
        assert np.abs(moved).mean() > len(order) / 4 and months > 4  # values travel over quarters


def test_whole_rows_are_shuffled_once_to_permute_a_target(features):
    """they went through a shuffle for every place and join of the permutation, and all its files stayed."""
    plan = A.shuffle_target(features)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange " in line]  # from the result down
    assert "REPARTITION_BY_COL" in exchanges[0] and len(exchanges) > 1


def test_a_permuted_target_is_paired_row_by_row(spark):
    """also where an hour comes twice; times without a value are left out."""
    rows = [("a", datetime(2016, 1, 1) + timedelta(days=d // 2), d // 2, float(d), d) for d in range(40)] + [("b", datetime(2016, 5, 1), 0, None, 99)]
    table = spark.createDataFrame(rows, "series string, ts timestamp_ntz, day int, y double, n int").withColumn("op_date", F.to_date("ts"))
    got = A.shuffle_target(table)
    assert got.columns == table.columns and got.drop("y").exceptAll(table.drop("y")).isEmpty() and got.count() == 41
    got = got.orderBy("series", "n").toPandas()
    assert sorted(got.y[:40]) == [float(d) for d in range(40)] and (got.y[:40] != got.n[:40]).sum() > 30 and np.isnan(got.y[40])
    early = table.where("day < 5").select("series", "ts", "y")
    some = A._with_values(table, early, ["series"], "y", DEFAULTS).orderBy("n").toPandas()
    assert len(some) == 11 and np.isnan(some.y[10]) and all(sorted(some.y[k : k + 2]) == [k, k + 1] for k in range(0, 10, 2))


def test_permuted_target_ruins_accuracy(features, last):
    got = A.shuffled_target_check(features, last, {m: FC.REGISTRY[m] for m in ("prophet", "lgbm")}).toPandas()
    assert len(got) == 4 and (got.mape_shuffled > 2 * got.mape).all()


def test_forecasts_do_not_move_with_the_future(clean, features, last):
    models = {m: FC.REGISTRY[m] for m in ("naive", "snaive", "prophet", "lgbm")}
    got = A.forecast_replay(clean, features, last, models).toPandas()
    assert len(got) == 8 and (got.n_hours == 24).all() and (got.moved_hours == 0).all()
    early = last.withColumn("cutoff", F.col("cutoff") - F.expr("INTERVAL 30 HOURS"))
    leaky = A.corrupt_after(clean, early, "load")
    assert A.forecast_replay(leaky, features, last, {"naive": FC.naive}).where("moved_hours > 0").count() == 2


def requests(spark, *dates):
    return spark.createDataFrame([("a", d) for d in dates], "series string, date string")


def test_forecast_answers(spark, clean, features, last):
    day = str(last.first()["target_date"])
    asked = requests(spark, day, "1999-01-01", "not-a-date", "2018-13-45", "2016-01-02")
    got = {r["date"]: r for r in S.forecast_dates(asked, features, FC.naive, "naive").collect()}
    good = got[day]
    assert good["status"] == 200 and len(good["predictions"]) == 24
    stamps = pd.to_datetime([p["ts"] for p in good["predictions"]], utc=True)
    assert stamps[0].hour == 5 and (np.diff(stamps) == np.timedelta64(1, "h")).all()
    assert good["predictions"][0]["mw"] == round(good["predictions"][0]["mw"], 1)
    for d in ("1999-01-01", "2016-01-02"):
        assert got[d]["status"] == 422 and "days with all inputs lie between" in got[d]["detail"]
    for d in ("not-a-date", "2018-13-45"):
        assert got[d]["status"] == 422 and "not a date" in got[d]["detail"]


def test_quarantined_days_stay_servable(features):
    days = {str(r["op_date"]) for r in S.servable_dates(features).where("series = 'a'").collect()}
    assert "2016-09-14" in days
    cover = S.coverage(features, None, "naive").where("series = 'a'").first()
    assert str(cover["first_date"]) == min(days) and cover["status"] == "ok"


@pytest.fixture(scope="module")
def artifact(clean, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("artifact") / "lgbm")
    S.build_artifact(clean, path)
    return path


def test_artifact_round_trip(spark, clean, features, last, artifact):
    facts, stored, models = S.load_artifact(spark, artifact)
    assert models.count() == 48 and stored.count() == clean.count()
    assert facts.where("artifact_version = 2 AND model = 'lgbm' AND n_models = 24").count() == 2
    again = FE.build_features(stored)
    a = S.artifact_forecaster(models)(features, last).orderBy("series", "ts").toPandas()
    b = S.artifact_forecaster(models)(again, last).orderBy("series", "ts").toPandas()
    pd.testing.assert_frame_equal(a, b)
    facts.withColumn("artifact_version", F.lit(1)).write.parquet(f"{artifact}-old/metadata")
    for part, df in (("clean", stored), ("models", models)):
        df.limit(1).write.parquet(f"{artifact}-old/{part}")
    with pytest.raises(ValueError, match="version 1"):
        S.load_artifact(spark, f"{artifact}-old")


def test_importance_is_a_share_per_series(spark, artifact):
    got = TR.feature_importance(S.load_artifact(spark, artifact)[2]).toPandas()
    assert len(got) == 2 * len(FEATURES) and np.allclose(got.groupby("series").gain.sum(), 1) and (got.gain >= 0).all()


def test_a_day_with_a_missing_input_is_forecast(spark, features, last, artifact):
    """One weather hour is missing: the day stays servable, and its 24 hours are forecast."""
    day = str(last.first()["target_date"])
    gone = (F.col("op_date") == F.lit(day).cast("date")) & (F.col("lead") == 7)
    holed = features.withColumns({c: F.when(~gone, F.col(c)) for c in ("temp", "hdd", "cdd")})
    forecaster = S.artifact_forecaster(S.load_artifact(spark, artifact)[2])
    whole, answer = (S.forecast_dates(requests(spark, day), t, forecaster, "lgbm").first() for t in (features, holed))
    assert answer["status"] == 200 and len(answer["predictions"]) == 24
    pairs = list(zip(whole["predictions"], answer["predictions"]))
    assert all(b["mw"] is not None for _, b in pairs)
    assert [i for i, (a, b) in enumerate(pairs) if a != b] in ([6], [])
    assert abs(pairs[6][0]["mw"] - pairs[6][1]["mw"]) < 0.3 * pairs[6][0]["mw"]


@pytest.mark.parametrize("limit", [3, 50, 10_000])
def test_quantiles_equal_numpy(spark, limit):
    rng = np.random.default_rng(4)
    groups = {"ties": np.repeat([1.0, 5.0, 5.0, 9.0], 60), "wide": rng.lognormal(0, 8, 700), "one": np.array([2.5]), None: rng.normal(size=33),
              "same": np.full(90, -3.0), "minus": -np.abs(rng.normal(size=101)), "two": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0], limit=limit, buckets=7).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        np.testing.assert_allclose([got[g][f"q{i}"] for i in range(5)], np.quantile(vs, [0.0, 0.25, 0.5, 0.9, 1.0]), rtol=1e-12)


# ------------------------------------------------------------------ sources, sinks, exploration
def test_weather_json_first_payload_wins(spark):
    rows = [
        (1, '{"hourly": {"time": ["2016-01-01T00:00", "2016-01-01T01:00"], "temperature_2m": [1.0, null]}}'),
        (2, '{"hourly": {"time": ["2016-01-01T01:00", "2016-01-01T02:00"], "temperature_2m": [9.0, 3.0]}}'),
    ]
    got = readers.flatten_weather_json(spark.createDataFrame(rows, "chunk int, payload string"))
    assert [r["temp_c"] for r in got.orderBy("datetime_utc").collect()] == [1.0, None, 3.0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("2016-03-13 02:30:00", "2016-03-13 02:30:00"),
        ("2016-03-13T02:30:00Z", "2016-03-13 02:30:00"),
        ("2016-03-13 02:30:00+00:00", "2016-03-13 02:30:00"),
        ("2016-03-13T02:30:00-05:00", "2016-03-13 07:30:00"),
        ("2016-03-13T02:30+0530", "2016-03-12 21:00:00"),
        ("2016-03-13", "2016-03-13 00:00:00"),
    ],
)
def test_stamps_with_and_without_zone(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(readers.utc_stamp(F.col("t")).cast("string"))
    assert df.first()[0] == want


def test_request_chunks_cover_the_window(spark):
    w = spark.sql("SELECT DATE '2001-12-31' AS start_date, DATE '2018-08-04' AS end_date")
    got = [(str(r[0]), str(r[1])) for r in readers.weather_request_chunks(w).orderBy("chunk_start").collect()]
    assert got == [
        ("2001-12-31", "2005-12-31"), ("2006-01-01", "2010-12-31"),
        ("2011-01-01", "2015-12-31"), ("2016-01-01", "2018-08-04"),
    ]


def test_csv_to_clean_table(spark, raw, weather, clean_pdf, tmp_path):
    load, temp = str(tmp_path / "load"), str(tmp_path / "weather")
    one = raw.where("series = 'a'").select(F.col("wall").alias("Datetime"), "load")
    readers.write_csv(one, load)
    readers.write_csv(weather, temp)
    got, log = pipeline.clean(readers.read_load_csv(spark, load, series="a"), readers.read_weather_csv(spark, temp))
    got = got.toPandas().sort_values("ts").reset_index(drop=True)
    want = clean_pdf[clean_pdf.series == "a"].reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)
    assert log.count() == 9


def test_result_store_skips_absent_models(spark, features, fold_table, tmp_path):
    path = str(tmp_path / "results")
    results = FC.run_backtest(["naive", "snaive"], features, fold_table, cfg=CFG)
    readers.write_results(results, path)
    readers.write_results(results.where("model = 'naive'"), path)  # a second run replaces the first
    assert readers.read_results(spark, path).count() == results.count()
    got = M.summarize(readers.read_results(spark, path, ["naive", "snaive", "lgbm"]))
    assert {r["model"] for r in got.collect()} == {"naive", "snaive"}
    assert M.summarize(readers.read_results(spark, path, ["lgbm"])).count() == 0


def test_acf_and_pacf_by_hand(clean, clean_pdf):
    x = clean_pdf[clean_pdf.series == "a"].load.to_numpy()
    x = x - x.mean()
    got = X.acf(clean).where("series = 'a'").orderBy("lag").toPandas().acf.to_numpy()
    want = [np.dot(x[k:], x[: len(x) - k]) / np.dot(x, x) for k in range(201)]
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)
    tail = X.pacf(clean, 30, 5000).where("series = 'a'").orderBy("lag").toPandas().pacf.to_numpy()
    y = clean_pdf[clean_pdf.series == "a"].load.to_numpy()[-5000:]
    y = y - y.mean()
    c = np.array([np.dot(y[k:], y[: len(y) - k]) / (len(y) - k) for k in range(31)])
    for k in (1, 2, 7, 30):
        toeplitz = c[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
        assert tail[k] == pytest.approx(np.linalg.solve(toeplitz, c[1 : k + 1])[-1], rel=1e-6)


def test_acf_beyond_a_block(clean, clean_pdf):
    x = clean_pdf[clean_pdf.series == "a"].load.to_numpy()
    x = x - x.mean()
    got = X.lag_products(clean, 5000).where("series = 'a' AND lag % 700 = 0").orderBy("lag").toPandas().s.to_numpy()
    np.testing.assert_allclose(got, [np.dot(x[k:], x[: len(x) - k]) for k in range(0, 5001, 700)], rtol=1e-7, atol=1e-6)


def test_decomposition_adds_up(clean):
    d = X.decompose(X.daily_mean(clean)).toPandas()
    full = d.dropna()
    np.testing.assert_allclose(full.observed, full.trend + full.seasonal + full.residual)
    assert full.groupby("series").size().min() == 732 - 364


def test_monthly_peak_breaks_ties_by_time(spark):
    rows = [("a", f"2016-07-01 1{h}:00:00", 5.0, 0) for h in (4, 2, 3)] + [("a", "2016-07-02 12:00:00", 99.0, 1)]
    df = spark.createDataFrame(rows, "series string, t string, load double, bad_day int").select(
        "series", F.to_timestamp_ntz("t").alias("ts"), "load", "bad_day"
    )
    got = X.monthly_peak(df).first()
    assert str(got["peak_at_local"]) == "2016-07-01 08:00:00" and got["peak_hour"] == 8


def test_hexagons_and_bins_count_every_hour(clean, clean_pdf):
    assert X.hexagon_density(clean).agg(F.sum("n")).first()[0] == len(clean_pdf)
    bins = X.temperature_bins(clean).where("series = 'a'").toPandas().set_index("mid_c")
    p = clean_pdf[clean_pdf.series == "a"]
    want = p.groupby(pd.cut(p.temp_c, np.arange(-20, 41, 2)), observed=True).load.median()
    want.index = [float(i.mid) for i in want.index]
    np.testing.assert_allclose(bins.median_load.sort_index(), want.sort_index())
