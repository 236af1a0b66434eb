from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixture_values import TZ
from hourloom.config import FEATURES
from hourloom.functions import timeline as tl
from hourloom.operators import features as FE


@pytest.fixture(scope="module")
def brute(clean_pdf):
    """Features by plain pandas over the whole series."""
    out = []
    for _, p in clean_pdf.groupby("series"):
        p = p.set_index("ts")
        f = pd.DataFrame({"series": p.series, "y": p.load})
        for k in (24, 48, 168):
            f[f"lag_{k}"] = p.load.shift(k)
        cut = (p.index - pd.Timedelta("5h")).floor("D") + pd.Timedelta("4h")
        for name, n, how in (("roll24_mean", 24, "mean"), ("roll24_std", 24, "std"), ("roll168_mean", 168, "mean"), ("roll168_max", 168, "max")):
            f[name] = getattr(p.load.rolling(n), how)().reindex(cut).to_numpy()
        local = p.index.tz_localize("UTC").tz_convert(TZ)
        for name, v, per in (("hour", local.hour, 24), ("dow", local.dayofweek, 7), ("month", local.month, 12)):
            f[f"{name}_sin"], f[f"{name}_cos"] = np.sin(2 * np.pi * v / per), np.cos(2 * np.pi * v / per)
        f["is_weekend"] = (local.dayofweek >= 5).astype(int)
        f["temp"], f["temp_lag24"] = p.temp_c, p.temp_c.shift(24)
        f["hdd"], f["cdd"] = (18 - p.temp_c).clip(lower=0), (p.temp_c - 24).clip(lower=0)
        f["cutoff_ts"], f["lead"] = cut, ((p.index - cut) / pd.Timedelta("1h")).astype(int)
        out.append(f.reset_index())
    return pd.concat(out, ignore_index=True)


def test_every_feature_equals_the_whole_series_computation(brute, features_pdf):
    assert set(FEATURES) <= set(features_pdf.columns)
    for c in brute.columns:
        if c in ("series", "ts", "cutoff_ts"):
            assert (brute[c].to_numpy() == features_pdf[c].to_numpy()).all(), c
        else:
            np.testing.assert_allclose(features_pdf[c].astype(float), brute[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_leads_are_one_to_twenty_four(features_pdf):
    inner = features_pdf.groupby(["series", "op_date"]).lead.agg(["min", "max", "size"]).iloc[1:-1]
    assert features_pdf.lead.between(1, 24).all()
    assert (inner["size"] <= 24).all()


def test_rolling_is_shared_by_a_day(features_pdf):
    day = features_pdf[features_pdf.op_date == dt.date(2017, 6, 15)]
    for c in ("roll24_mean", "roll24_std", "roll168_mean", "roll168_max"):
        assert day.groupby("series")[c].nunique().eq(1).all()


@pytest.mark.parametrize(
    "day, holiday",
    [
        ("2017-07-04", 1), ("2017-07-05", 0), ("2015-07-03", 1), ("2016-12-26", 1), ("2010-12-31", 1),
        ("2016-01-18", 1), ("2016-02-15", 1), ("2016-05-30", 1), ("2016-09-05", 1), ("2016-10-10", 1),
        ("2016-11-11", 1), ("2016-11-24", 1), ("2016-11-25", 0), ("2020-06-19", 0), ("2021-06-18", 1), ("1985-01-21", 0),
    ],
)
def test_holiday_rules(spark, day, holiday):
    got = spark.sql(f"SELECT DATE '{day}' AS d").select(tl.is_us_holiday(F.col("d")).cast("int")).first()[0]
    assert got == holiday


def test_usable_rows_exclude_warm_up_and_bad_days(features, features_pdf):
    kept = FE.usable(features).toPandas()
    assert (kept.bad_day == 0).all() and kept[list(FEATURES)].notna().all().all()
    want = ((features_pdf.bad_day == 0) & features_pdf[list(FEATURES)].notna().all(axis=1)).sum()
    assert len(kept) == want


def test_contract_has_no_violation_and_lag24_is_tight(fold_table):
    report = FE.leakage_contract(fold_table)
    assert report.where("violation").count() == 0
    tight = report.join(fold_table, ["series", "fold"]).where("feature = 'lag_24' AND last_read = cutoff")
    assert tight.count() == fold_table.count()
    assert {r["feature"] for r in report.where("exempt").select("feature").distinct().collect()} == {"temp", "hdd", "cdd"}


def test_sequence_windows_equal_a_plain_loop(features, features_pdf):
    got = {(r["series"], r["op_date"]): r for r in FE.sequence_windows(features).collect()}
    cols = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "temp", "is_holiday"]
    want = 0
    for series, p in features_pdf.groupby("series"):
        p = p.reset_index(drop=True)
        for day, rows in p.groupby("op_date"):
            first = rows.index[0]
            if len(rows) != 24 or rows.bad_day.max() or first < 168:
                continue
            want += 1
            r = got[(series, day)]
            np.testing.assert_allclose(r["sequence"], p.y[first - 168 : first])
            np.testing.assert_allclose(r["target"], rows.y)
            np.testing.assert_allclose(r["exog"], rows[cols].to_numpy(dtype=float).ravel())
    assert want == len(got) > 500


def test_fourier_terms_have_their_periods(spark):
    rows = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ '2016-02-28 00:00:00', TIMESTAMP_NTZ '2016-03-14 00:00:00', INTERVAL 1 HOUR)) AS ts")
    pdf = rows.select("ts", *tl.fourier(F.col("ts"))).orderBy("ts").toPandas()
    assert list(pdf.columns[1:]) == tl.fourier_names() and len(tl.fourier_names()) == 12
    h = ((pdf.ts - pd.Timestamp("2000-01-01")) / pd.Timedelta("1h")).to_numpy()
    np.testing.assert_allclose(pdf.sin_168_2, np.sin(2 * np.pi * 2 * h / 168), atol=1e-9)
    np.testing.assert_allclose(pdf.cos_24_3, np.cos(2 * np.pi * 3 * h / 24), atol=1e-9)
