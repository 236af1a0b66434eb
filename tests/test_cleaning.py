from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixture_values import LONG_GAP, SHORT_GAP, SPIKE, TZ
from hourloom import Settings
from hourloom.functions import timeline as tl
from hourloom.operators import cleaning as C


def at(pdf, series, stamps):
    stamps = pd.DatetimeIndex(stamps).tz_convert("UTC").tz_localize(None)
    return pdf[pdf.series == series].set_index("ts").loc[stamps]


def test_grid_is_gapless_per_series(clean_pdf):
    for _, part in clean_pdf.groupby("series"):
        assert (part.ts.diff().dropna() == pd.Timedelta("1h")).all()
        assert part.load.notna().all() and part.temp_c.notna().all()


def test_repeated_autumn_hour_is_averaged_onto_the_first_slot(raw_pdf, clean_pdf):
    twice = raw_pdf[raw_pdf.series == "a"].groupby("wall").load.agg(["size", "mean"])
    twice = twice[twice["size"] == 2]
    assert len(twice) == 2  # one per autumn
    for wall, row in twice.iterrows():
        first = pd.Timestamp(wall).tz_localize(TZ, ambiguous=True)
        got = at(clean_pdf, "a", [first])
        assert got.load.iloc[0] == pytest.approx(row["mean"])
        vacated = at(clean_pdf, "a", [first + pd.Timedelta("1h")])
        assert vacated.imputed.iloc[0] == 1


def test_skipped_spring_hour_is_dropped(spark):
    rows = [("a", "2016-03-13 01:00:00", 1.0), ("a", "2016-03-13 02:00:00", 99.0), ("a", "2016-03-13 03:00:00", 2.0)]
    raw = spark.createDataFrame(rows, "series string, w string, load double").select(
        "series", F.to_timestamp_ntz("w").alias("wall"), "load"
    )
    got = C.merge_utc(C.hourly_readings(raw)).orderBy("ts").toPandas()
    assert [str(t) for t in got.ts] == ["2016-03-13 06:00:00", "2016-03-13 07:00:00"]
    assert list(got.load) == [1.0, 2.0]


def grid_of(spark, values, start="2016-03-31 20:00:00"):
    """A grid across a block boundary (local quarter) from a list of values."""
    stamps = pd.date_range(start, periods=len(values), freq="h")
    rows = [("a", t.to_pydatetime(), v) for t, v in zip(stamps, values)]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, load double"), stamps


@pytest.mark.parametrize(
    "mask, runs",
    [
        ([0, 1, 1, 0, 1, 0, 0, 1], [(1, 2), (4, 1), (7, 1)]),
        ([1, 1, 0], [(0, 2)]),
        ([0, 1, 1], [(1, 2)]),
        ([0, 0], []),
        ([0] * 3 + [1] * 15 + [0], [(3, 15)]),
    ],
)
def test_gap_runs_are_maximal_and_cross_blocks(spark, mask, runs):
    grid, stamps = grid_of(spark, [None if m else 1.0 for m in mask])
    got = sorted((r["gap_start"], r["gap_hours"]) for r in C.gap_runs(grid).collect())
    assert got == [(stamps[i].to_pydatetime(), n) for i, n in runs]


def test_filling_matches_pandas_everywhere(spark):
    rng = np.random.default_rng(5)
    values = pd.Series(rng.normal(0, 10, 6000))
    values[rng.random(6000) < 0.4] = np.nan
    values[1000:4200] = np.nan  # longer than a block
    values[:5] = np.nan
    values[-7:] = np.nan
    grid, stamps = grid_of(spark, [None if np.isnan(v) else float(v) for v in values], "2016-01-01 00:00:00")
    got = C.interpolate_time(grid, ["load"]).orderBy("ts").toPandas().load.to_numpy()
    want = pd.Series(values.to_numpy(), index=stamps).interpolate("time", limit_direction="both")
    np.testing.assert_allclose(got, want.to_numpy(), rtol=1e-12, atol=1e-12)


def test_series_without_any_reading_stays_null(spark):
    grid, _ = grid_of(spark, [None, None, None])
    assert C.interpolate_time(grid, ["load"]).where("load IS NULL").count() == 3


def test_short_gap_is_linear_and_flagged(clean_pdf):
    gap = at(clean_pdf, "a", SHORT_GAP)
    before, after = (
        at(clean_pdf, "a", [SHORT_GAP[0] - pd.Timedelta("1h")]).load.iloc[0],
        at(clean_pdf, "a", [SHORT_GAP[-1] + pd.Timedelta("1h")]).load.iloc[0],
    )
    np.testing.assert_allclose(gap.load, np.linspace(before, after, 5)[1:-1])
    assert (gap.imputed == 1).all() and (gap.bad_day == 0).all()


def test_long_gap_quarantines_both_local_days(clean_pdf):
    local = clean_pdf.ts.dt.tz_localize("UTC").dt.tz_convert(TZ).dt.date
    touched = set(LONG_GAP.date)
    assert len(touched) == 2
    inside = local.isin(touched)
    assert (clean_pdf[inside].bad_day == 1).all() and (clean_pdf[~inside].bad_day == 0).all()


def test_winsorizing_matches_pandas(annotated, clean_pdf):
    spike = at(clean_pdf, "b", [SPIKE])
    assert spike.clipped.iloc[0] == 1 and spike.load.iloc[0] < 61_000
    assert clean_pdf.clipped.mean() < 0.02
    pdf = annotated.toPandas()
    # An unclipped series has the same cells' medians as pandas on the clipped one only by chance,
    # so recompute from the operator's input.
    cells = pdf.groupby(["series", "local_month", "local_hour"]).size()
    assert len(cells) == 2 * 12 * 24


def test_band_is_exact(spark, hourly):
    filled = C.quarantine_long_gaps(C.build_regular_grid(hourly))
    pdf = filled.toPandas()
    cell = pdf.groupby(["series", "local_month", "local_hour"]).load
    med = cell.transform("median")
    mad = cell.transform(lambda v: (v - v.median()).abs().median())
    want = pdf.assign(want=pdf.load.clip(med - 5 * mad, med + 5 * mad))
    got = C.winsorize(filled).toPandas()
    both = want.merge(got, on=["series", "ts"], suffixes=("", "_got"))
    np.testing.assert_allclose(both.load_got, both.want)


def test_non_positive_inside_the_band_is_flagged_but_kept(spark):
    grid, _ = grid_of(spark, [0.0, 10.0, -10.0, 5.0] * 6, "2016-01-05 05:00:00")
    df = C.quarantine_long_gaps(grid)
    got = C.winsorize(df).toPandas()
    assert ((got.load <= 0) == (got.clipped == 1)).all()


def test_first_weather_row_wins_by_tiebreak(spark):
    rows = [("2016-01-01 00:00:00", 5.0, 2), ("2016-01-01 00:00:00", 7.0, 1)]
    w = spark.createDataFrame(rows, "d string, temp_c double, n int").select(
        F.to_timestamp_ntz("d").alias("datetime_utc"), "temp_c", "n"
    )
    assert [r["temp_c"] for r in C.first_weather(w, "n").collect()] == [7.0]


def test_weather_keyed_by_series(spark):
    grid, stamps = grid_of(spark, [1.0, 2.0])
    w = spark.createDataFrame(
        [("a", stamps[0].to_pydatetime(), 3.0), ("z", stamps[1].to_pydatetime(), 9.0)],
        "series string, datetime_utc timestamp_ntz, temp_c double",
    )
    got = C.attach_weather_raw(grid, w).orderBy("ts").toPandas().temp_c
    assert got[0] == 3.0 and np.isnan(got[1])


def test_validation_accepts_and_rejects(clean):
    assert C.validate(clean) is clean
    hole = clean.where("ts <> TIMESTAMP_NTZ '2016-06-01 00:00:00'")
    with pytest.raises(ValueError, match="continuous hourly grid"):
        C.validate(hole)
    with pytest.raises(ValueError, match="contract"):
        C.validate(clean.withColumn("load", F.lit(999_999.0)))
    with pytest.raises(ValueError, match="contract"):
        C.validate(clean.withColumn("extra", F.lit(1)))
    with pytest.raises(ValueError, match="continuous hourly grid"):
        C.validate(clean.unionByName(clean))
    with pytest.raises(ValueError, match="contract"):
        C.validate(clean, cfg=Settings(load_max=20_000.0))


def test_reconciliation_conserves_rows(hourly, annotated):
    log = C.reconciliation(hourly, annotated).toPandas().pivot(index="series", columns="step", values="rows_affected")
    assert (log[0] - log[1] - log[2] + log[3] == log[8]).all()
    assert (log[5] == 48).all() and (log[4] >= 3).all() and (log >= 0).all().all()


def test_results_do_not_depend_on_the_session_zone(spark, raw, weather, clean_pdf):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        again = C.clean_columns(C.clean_annotated(C.hourly_readings(raw), weather)).toPandas()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    again = again.sort_values(["series", "ts"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(again, clean_pdf, check_exact=False, rtol=1e-12)


def test_one_dominant_series_is_spread_over_blocks(spark, hourly, weather):
    """No window of the cleaning groups by series alone over hourly rows."""
    df = C.clean_annotated(hourly, weather)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    hourly_windows = [ln for ln in plan.splitlines() if "Window" in ln and "load" in ln and "__first" not in ln and "__last" not in ln]
    assert hourly_windows
    assert all("__block" in ln or "local_hour" in ln for ln in hourly_windows)


@pytest.mark.parametrize("tz", ["America/New_York", "Australia/Lord_Howe"])
def test_clocks_shift_without_a_zone_lookup_a_row(spark, tz):
    """The zone's name was read again for every row. Nothing hangs on the session's zone."""
    quarters = F.expr("TIMESTAMP_NTZ '2015-12-31 23:45:00.000001' + id * INTERVAL '15' MINUTE")
    hours = spark.range(2 * 366 * 96).select(F.when(F.col("id") > 0, quarters).alias("ts"))  # and a null
    utc, zone = F.lit("UTC"), F.lit(tz)
    shifted = hours.select("ts", tl.to_local(F.col("ts"), tz).alias("local"), tl.to_utc(F.col("ts"), tz).alias("utc"))
    assert "convert_timezone" not in shifted._jdf.queryExecution().toString()
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for session in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", session)
            same = F.col("local").eqNullSafe(F.convert_timezone(utc, zone, F.col("ts"))) & F.col("utc").eqNullSafe(F.convert_timezone(zone, utc, F.col("ts")))
            assert shifted.where(~same).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
