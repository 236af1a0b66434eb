from __future__ import annotations

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixture_values import CFG
from hourloom import Settings, materialize
from hourloom.config import FEATURES
from hourloom.functions import timeline as tl
from hourloom.operators import boosting as B
from hourloom.operators import folds as FO
from hourloom.operators import forecasters as FC
from hourloom.operators import metrics as M
from hourloom.operators import regression as R
from hourloom.operators import reports as RP
from hourloom.operators import trees as TR


@pytest.fixture(scope="module")
def results(features, fold_table):
    return materialize(
        FC.run_backtest(["naive", "snaive", "sarima", "prophet"], features, fold_table, cfg=CFG), "t-results"
    )


@pytest.fixture(scope="module")
def results_pdf(results):
    return results.toPandas()


# ------------------------------------------------------------------ folds
def test_fold_geometry(features, fold_table):
    pdf = fold_table.toPandas().sort_values(["series", "fold"])
    for _, p in pdf.groupby("series"):
        assert list(p.fold) == list(range(1, 13))
        assert set(np.diff(p.target_date)) == {dt.timedelta(days=7)}
    bad = FO.fold_violations(features, fold_table, cfg=CFG).drop("series", "n_folds").toPandas()
    assert (bad == 0).all().all()


def test_violations_are_counted(features, fold_table):
    overlapping = fold_table.withColumn("target_date", F.lit("2017-06-01").cast("date"))
    got = FO.fold_violations(features, overlapping, cfg=CFG).first()
    assert got["overlap"] == 11 and got["wrong_growth"] == 0
    late = fold_table.withColumn("cutoff", F.col("cutoff") + tl.hours(1))
    assert FO.fold_violations(features, late, cfg=CFG).first()["not_after_cutoff"] == 12


def test_eligible_days(features, features_pdf):
    got = {(r["series"], r["op_date"]) for r in FO.eligible_op_dates(features).collect()}
    g = features_pdf.assign(ok=features_pdf[list(FEATURES)].notna().all(axis=1)).groupby(["series", "op_date"])
    want = (g.size() == 24) & (g.bad_day.max() == 0) & g.ok.all()
    assert got == set(want[want].index)


def test_skipped_candidates_are_not_replaced(features):
    kept = FO.make_folds(features, 600, 1)
    skipped = FO.skipped_dates(features, 600, 1)
    assert kept.count() + skipped.count() == 2 * 600
    assert skipped.count() > 0
    cover = FO.weekday_coverage(kept, 1).first()
    assert cover["n_weekdays"] == 7 and not cover["single_weekday"]


def test_no_eligible_day_is_an_error(features):
    with pytest.raises(ValueError, match="eligibility"):
        FO.make_folds(features.withColumn("bad_day", F.lit(1).cast("bigint")))


def test_capped_window_equals_a_slice(features, fold_table):
    got = FO.capped_training_stats(features, fold_table, 0.5).toPandas()
    hist = FO.training_slice(features, fold_table).where(F.col("ts") >= F.col("cutoff") - tl.hours(4383))
    want = hist.groupBy("series", "fold").agg(F.count("*").alias("n"), F.sum(1 - F.col("bad_day")).alias("k")).toPandas()
    both = got.merge(want, on=["series", "fold"])
    assert len(both) == 24 and (both.n_train == both.n).all() and (both.n_known == both.k).all()


# ------------------------------------------------------------------ forecasters
def test_design_vectors_are_made_after_the_join(features, fold_table):
    """rows meet their series' cuts as plain columns; no vector is shuffled but the sums."""
    segments = R.fold_segments(fold_table, 3.0)
    plan = R.segment_moments(
        features.select("series", "ts", "y"), F.array("y"), segments, [[0]])._jdf.queryExecution().optimizedPlan().toString()
    join, vector = plan.index("Join"), plan.index("AS z")
    assert vector < join  # nearer to the top


def test_rows_of_other_dates_are_left_out_before_the_join(features, fold_table):
    """Only the folds' dates are shuffled."""
    plan = FO.target_rows(features, fold_table)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    got = FO.target_rows(features, fold_table)
    picked = fold_table.withColumnRenamed("target_date", "op_date")
    plain = features.join(picked, ["series", "op_date"])
    assert got.columns == plain.columns and got.count() == plain.count() and got.exceptAll(plain).isEmpty()


def test_lag_baselines_repeat_history(results_pdf, features_pdf):
    y = features_pdf.set_index(["series", "ts"]).y
    for model, back in (("naive", 24), ("snaive", 168)):
        p = results_pdf[results_pdf.model == model]
        source = pd.MultiIndex.from_arrays([p.series, p.ts - pd.Timedelta(hours=back)])
        np.testing.assert_allclose(p.y_pred, y.loc[source])


def test_results_line_up_with_the_truth(results_pdf, features_pdf):
    y = features_pdf.set_index(["series", "ts"]).y
    assert (results_pdf.groupby(["series", "model", "fold"]).size() == 24).all()
    np.testing.assert_allclose(results_pdf.y_true, y.loc[pd.MultiIndex.from_frame(results_pdf[["series", "ts"]])])


def test_missing_history_is_refused(features, fold_table):
    first = fold_table.withColumn("target_date", F.lit("2016-01-03").cast("date"))
    made = FC.seasonal_naive(features, first.where("fold = 1"))
    assert FC.missing_history(made).first()["n_missing"] == 24
    with pytest.raises(ValueError, match="history"):
        FC.require_history(made)


def test_unknown_model(features, fold_table):
    with pytest.raises(KeyError, match="unknown model"):
        FC.run_backtest(["oracle"], features, fold_table)


def test_guards(features, fold_table):
    good = FC.naive(features, fold_table)
    assert FC.guard_forecasts(good, features, fold_table) is good
    with pytest.raises(ValueError, match="diverged"):
        FC.guard_forecasts(good.withColumn("y_pred", F.col("y_pred") * 1e6), features, fold_table)
    with pytest.raises(ValueError, match="non-finite"):
        FC.guard_forecasts(good.withColumn("y_pred", F.lit(float("nan"))), features, fold_table)
    with pytest.raises(ValueError, match="wrong number"):
        FC.guard_forecasts(good.where("hour(ts) <> 7"), features, fold_table)


def harmonic_by_hand(y: pd.Series, start, cutoff, target):
    """Least squares and AR(2) on the sliced window with plain numpy."""
    def x(ts):
        h = ((ts - pd.Timestamp("2000-01-01")) / pd.Timedelta("1h")).to_numpy()
        cols = [np.ones(len(h))]
        for p in (24, 168):
            for k in (1, 2, 3):
                cols += [np.sin(2 * np.pi * k * h / p), np.cos(2 * np.pi * k * h / p)]
        return np.column_stack(cols)

    w = y[(y.index >= start) & (y.index <= cutoff)]
    ok = w.notna().to_numpy()
    beta = np.linalg.lstsq(x(w.index[ok]), w[ok], rcond=None)[0]
    full = y[y.index <= cutoff] - x(y[y.index <= cutoff].index) @ beta
    lag = pd.DataFrame({"r": full, "a": full.shift(1), "b": full.shift(2)})
    lag = lag[lag.index >= start].dropna()
    phi = np.linalg.lstsq(lag[["a", "b"]].to_numpy(), lag.r.to_numpy(), rcond=None)[0]
    e = [full.iloc[-1], full.iloc[-2]]
    out = []
    for _ in range(len(target)):
        nxt = phi[0] * e[0] + phi[1] * e[1]
        out.append(nxt)
        e = [nxt, e[0]]
    return x(target) @ beta + np.array(out)


def test_harmonic_forecast_equals_a_direct_fit_per_fold(features, features_pdf, fold_table):
    cfg = Settings(sarima_years=0.75)
    got = R.harmonic_forecast(features, fold_table, cfg=cfg).toPandas()
    for (series, fold), p in got.sort_values("ts").groupby(["series", "fold"]):
        if fold not in (1, 7, 12):
            continue
        s = features_pdf[features_pdf.series == series].set_index("ts")
        y = s.y.where(s.bad_day == 0)
        cutoff = p.ts.min() - pd.Timedelta("1h")
        start = cutoff - pd.Timedelta(days=365.25 * 0.75)
        want = harmonic_by_hand(y, start, cutoff, pd.DatetimeIndex(p.ts))
        np.testing.assert_allclose(p.y_pred, want, rtol=1e-5)


def test_unstable_recursion_is_pulled_inside_the_unit_circle():
    rng = np.random.default_rng(0)
    n = 400
    y = np.cumsum(np.cumsum(rng.normal(size=n))) * 1e-3 * np.arange(n)
    rows = np.column_stack([np.ones((n, 1)), rng.normal(size=(n, 12)), y, np.roll(y, 1), np.roll(y, 2)])[2:]
    coef = R.solve_harmonic(rows[:, :14].T @ rows[:, :14], rows.T @ rows)
    roots = np.roots([1, -coef[-2], -coef[-1]])
    assert np.abs(roots).max() < 1


def additive_by_hand(design, start, cutoff, hinges):
    """Ridge on the rows of one window with the bends strictly inside it; the trend counts from the cutoff."""
    origin = pd.Timestamp("2000-01-01")
    begin, end = ((t - origin).total_seconds() / (86400 * 365.25) for t in (start, cutoff))
    w = design[(design.ts >= start) & (design.ts <= cutoff) & (design.bad_day == 0)]
    keep = [0, 1, *(2 + i for i, k in enumerate(hinges) if begin < k < end), *range(2 + len(hinges), len(design.x.iloc[0]))]

    def x(frame):
        out = np.stack(frame.x.to_numpy())[:, keep]
        out[:, 1] -= end
        return out

    penalty = np.array([4.0 if 2 <= c < 2 + len(hinges) else 1e-3 for c in keep])
    a, y = x(w), w.y.to_numpy()
    beta = np.linalg.solve(a.T @ a + np.diag(penalty), a.T @ y)
    return lambda frame: x(frame) @ beta


def test_additive_forecast_equals_a_direct_ridge(spark, features, fold_table):
    cfg = Settings(prophet_years=0.75)
    got = R.additive_forecast(features, fold_table, cfg=cfg)
    hinges = R.calendar_hinges(fold_table, 0.75)
    design = features.where("series = 'a'").select(
        "ts", "y", "bad_day", R.additive_regressors(F.col("ts"), hinges).alias("x")
    ).toPandas().sort_values("ts")
    for fold in fold_table.where("fold IN (1, 5, 12) AND series = 'a'").collect():
        start = fold["cutoff"] - pd.Timedelta(days=365.25 * 0.75)
        p = got.where(f"fold = {fold['fold']} AND series = 'a'").toPandas().merge(design, on="ts")
        np.testing.assert_allclose(p.y_pred, additive_by_hand(design, start, fold["cutoff"], hinges)(p), rtol=1e-6)


@pytest.mark.parametrize("model", ["sarima", "prophet"])
def test_a_fold_alone_equals_the_fold_among_others(features, fold_table, model):
    cfg = Settings(prophet_years=0.75, sarima_years=0.75)
    alone = FC.REGISTRY[model](features, fold_table.where("fold = 3"), ("series",), cfg).toPandas()
    among = FC.REGISTRY[model](features, fold_table, ("series",), cfg).where("fold = 3").toPandas()
    both = alone.merge(among, on=["series", "fold", "ts"])
    assert len(both) == 48
    np.testing.assert_allclose(both.y_pred_x, both.y_pred_y, rtol=1e-9)


def test_regressions_follow_the_seasonal_shape(results):
    """The fixture's noise is near 2 % of load; a fit that missed a cycle would be off by over 10 %."""
    pdf = M.summarize(results).toPandas().set_index(["series", "model"]).mape
    for series in ("a", "b"):
        assert pdf[series, "sarima"] < 0.05 and pdf[series, "prophet"] < 0.05


def test_tree_holdout_and_forecast(features, features_pdf, fold_table):
    last = fold_table.where("fold = 12")
    split = TR.holdout_split(features.where("lead = 3")).groupBy("series").agg(
        F.count_if("is_validation").alias("v"), F.max(F.when(~F.col("is_validation"), F.col("ts"))).alias("t"),
        F.min(F.when(F.col("is_validation"), F.col("ts"))).alias("s"),
    ).toPandas()
    assert (split.v == 90).all() and (split.t < split.s).all()
    small = {"maxIter": 8, "maxDepth": 4, "stepSize": 0.3}
    made = TR.tree_forecast(features, last, params=small, leads=[1, 24])
    rows = FC.results_frame(made, features, last, "lgbm").where("lead IN (1, 24)").toPandas()
    assert len(rows) == 4 and rows.y_pred.notna().all()
    assert (abs(rows.y_pred - rows.y_true) / rows.y_true < 0.2).all()


def test_every_fold_is_fit_on_its_own_past(features, features_pdf, fold_table):
    some = fold_table.where("fold IN (1, 6, 7)")
    got = TR.fold_fits(features, some, leads=[5], params={"maxIter": 60}).toPandas()
    assert sorted(zip(got.series, got.fold)) == [(s, f) for s in "ab" for f in (1, 6, 7)]
    settings = {**TR.PARAMS, "maxIter": 60, "seed": 42}
    x = list(FEATURES)
    for row in got.itertuples():
        own = features_pdf[(features_pdf.series == row.series) & (features_pdf.lead == 5)].sort_values("ts")
        past = own[(own.ts < row.ts) & (own.bad_day == 0) & own[x].notna().all(axis=1)]
        held = TR.n_validation(len(past))
        assert (row.n_train, row.n_valid) == (len(past) - held, held)
        model = B.fit(past[x].to_numpy(float), past.y.to_numpy(float), held, settings)
        assert row.rounds == model.rounds
        assert row.y_pred == pytest.approx(model.predict(own[own.ts == row.ts][x].to_numpy(float))[0])


def test_the_shipped_settings_beat_both_baselines(features, fold_table, results):
    """All 24 leads of a fold, 600 rounds at most, as they stand."""
    last = fold_table.where("fold = 12")
    assert TR.PARAMS["maxIter"] == 600 and TR.PARAMS["patience"] == 50
    fits = TR.tree_forecast(features, last)
    made = FC.results_frame(FC.guard_forecasts(fits, features, last), features, last, "lgbm")
    base = results.where("fold = 12 AND model IN ('naive', 'snaive')")
    mape = made.unionByName(base.select(*made.columns)).groupBy("model").agg(M.mape().alias("m")).toPandas().set_index("model").m
    assert made.count() == 48 and mape["lgbm"] < mape["naive"] and mape["lgbm"] < mape["snaive"]


def series_of_rows(seed=0, n=300, p=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    return x, 3 * x[:, 0] + np.abs(x[:, 1]) + rng.normal(size=n) * 0.5


@pytest.mark.parametrize("patience", [1, 5, 50])
def test_rounds_kept_equal_a_plain_loop(patience):
    """A fit of all rounds has the same first trees; the best round before `patience` rounds without gain is kept."""
    x, y = series_of_rows()
    settings = {**TR.PARAMS, "maxIter": 150, "stepSize": 0.3, "seed": 1}
    full = B.fit(x[:240], y[:240], 0, settings)
    assert full.rounds == 150
    errors = []
    for k in range(1, 151):
        first = B.Ensemble(full.base, full.feature[:k], full.threshold[:k], full.missing_left[:k], full.value[:k], full.gain)
        errors.append(np.abs(first.predict(x[240:]) - y[240:]).mean())
    best = 0
    for k, e in enumerate(errors):
        if e < errors[best]:
            best = k
        elif k - best >= patience:
            break
    got = B.fit(x, y, 60, {**settings, "patience": patience})
    assert got.rounds == best + 1
    np.testing.assert_allclose(got.value, full.value[: best + 1])


def test_fits_side_by_side_are_the_fits_alone(monkeypatch):
    """Trees of many fits grow together, with the same bits as alone, whoever ends first."""
    settings = {**TR.PARAMS, "maxIter": 120, "stepSize": 0.2, "patience": 15, "seed": 3}
    tables = [(*series_of_rows(seed, n), held) for seed, (n, held) in enumerate([(300, 60), (30, 0), (120, 24), (300, 60), (45, 0), (250, 50)])]
    tables[3][0][::7, 2] = np.nan
    alone = [B.fit(*t, settings) for t in tables]
    for rows in (1, 400, 10_000):
        monkeypatch.setattr(B, "AT_A_TIME", rows)
        for a, b in zip(alone, B.fit_many(tables, settings), strict=True):
            for c in ("base", "feature", "threshold", "missing_left", "value", "gain"):
                np.testing.assert_array_equal(getattr(a, c), getattr(b, c))


def test_a_round_of_many_fits_takes_the_calls_of_one(monkeypatch):
    """Sums are made once a level for all fits of a batch, not once for each."""
    calls = []
    sums = B._sums
    monkeypatch.setattr(B, "_sums", lambda *a: calls.append(1) or sums(*a))
    settings = {**TR.PARAMS, "maxIter": 20, "seed": 3}
    B.fit_many([(*series_of_rows(k), 0) for k in range(10)], settings)
    assert len(calls) <= 20 * TR.PARAMS["maxDepth"]


def test_fits_inside_spark_are_those_in_python(monkeypatch, features, fold_table):
    """Fits and predictions took Python workers several times the time; without them, the bits are the same."""
    gone = F.when(F.col("local_date") < "2016-09-01", F.lit(float("nan"))).otherwise(F.col("temp"))  # missing to the fit, but usable
    table = materialize(features.withColumn("temp", gone), "t-gone")
    folds, params = fold_table.where("fold IN (1, 12)"), {"maxIter": 40, "patience": 10}
    hours = FO.target_rows(table, fold_table).where("lead IN (1, 9, 20)").withColumn("roll24_std", F.when(F.col("fold") % 5 > 0, F.col("roll24_std")))

    def made():
        models = materialize(TR.fit_models(table, params, [1, 20], cfg=CFG), "t-models")
        return TR.fold_fits(table, folds, params=params, leads=[1, 20]), models, materialize(TR.predict_models(models, hours), "t-hours")

    with monkeypatch.context() as m:
        m.setattr(TR, "_fold_fits_in_python", None)
        inside = made()
    monkeypatch.setattr(TR, "_function", lambda *a: None)
    for a, b in zip(inside, made(), strict=True):
        assert a.dtypes == b.dtypes and a.count() == b.count() > 0
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_without_the_functions_trees_are_fit_in_python(monkeypatch, features, fold_table):
    """The fits tell that they are slow, and are made."""
    def fails(*a):
        raise OSError("no compiler")

    monkeypatch.setattr(TR.jvm, "function", fails)
    with pytest.warns(UserWarning, match="no compiler"):
        got = TR.fold_fits(features, fold_table.where("fold = 12"), leads=[3], params={"maxIter": 5})
    assert got.count() == 2


def test_fits_are_dealt_in_many_small_tasks(spark):
    """With few tasks a core, a task that got many groups kept the others waiting."""
    cores = spark.sparkContext.defaultParallelism
    dealt = TR._spread(spark.range(1000).withColumn("series", F.col("id") % 100), ["series"])
    assert dealt.rdd.getNumPartitions() >= 16 * cores


def test_inputs_of_few_values_have_few_cells():
    """A level scanned 65 cells of every input, also of flags and weekdays."""
    few = [2, 7, 1, 12]
    layout = B._Layout(np.array([64, *few, 40]), 64)
    assert layout.cells <= 2 * 65 + len(few) * 13
    places = [set(range(layout.start[k], layout.last[k] + 1)) for k in range(6)]
    assert sum(map(len, places)) == len(set().union(*places)) == layout.cells
    at = layout.place(np.array([[63, 1, 6, 0, 11, 39], [64] * 6]))  # greatest bins, and missing values
    assert (at[0] < layout.last).all() and (at[1] == layout.last).all()
    assert all(layout.missing[c] == layout.last[k] for k in range(6) for c in places[k])


def test_many_series_have_their_leads_fit_together(spark):
    """With two folds and six leads a group, a round's calls were shared by twelve fits at most."""
    cores = spark.sparkContext.defaultParallelism
    leads = spark.range(1, 25).withColumnRenamed("id", "lead")
    few, many = (leads.select(TR._lead_group(spark.range(n))).distinct().count() for n in (1, TR.GROUPS_A_CORE * cores))
    assert (few, many) == (24 // TR.LEADS_TOGETHER, 1)


def test_stored_models_predict_a_group_of_leads(spark, features, fold_table):
    """a call took one series and lead; now it takes the leads of a series, each with its own model, and none without one."""
    params = {"maxIter": 5, "patience": 5}
    models = materialize(TR.fit_models(features, params, [2, 9], cfg=CFG), "t-two-leads")
    hours = FO.target_rows(features, fold_table).where("lead IN (2, 3, 9)")
    got = TR.predict_models(models, hours).join(hours.select("series", "fold", "ts", "lead", *FEATURES), ["series", "fold", "ts"]).toPandas()
    assert len(got) == hours.count() and got[got.lead == 3].y_pred.isna().all()
    stored = {(m["series"], m["lead"]): TR._stored(m) for m in models.collect()}
    for (series, lead), rows in got[got.lead != 3].groupby(["series", "lead"]):
        np.testing.assert_allclose(rows.y_pred, stored[series, lead].predict(rows[list(FEATURES)].to_numpy(dtype=float)), rtol=1e-12)


def walked(model, x):
    """A prediction row by row and tree by tree."""
    out = []
    for row in x:
        leaves = []
        for t in range(model.rounds):
            k = 0
            while (f := model.feature[t, k]) >= 0:
                left = model.missing_left[t, k] if np.isnan(row[f]) else row[f] <= model.threshold[t, k]
                k = 2 * k + (1 if left else 2)
            leaves.append(model.value[t, k])
        out.append(model.base + sum(leaves))
    return np.array(out)


def test_predictions_walk_every_tree():
    """the places of all trees are one axis; rows with missing inputs go where their node learnt."""
    x, y = series_of_rows(5, 200)
    x[::6, 1] = np.nan
    model = B.fit(x, y, 0, {**TR.PARAMS, "maxIter": 30, "seed": 1})
    np.testing.assert_allclose(model.predict(x), walked(model, x), rtol=1e-12)


def best_split_by_hand(x, y, least):
    """(gain, input, threshold) over all inputs and all cuts between neighbouring values."""
    top = (0.0, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            left = x[:, f] <= (a + b) / 2
            if min(left.sum(), (~left).sum()) < least:
                continue
            gain = sum(y[m].sum() ** 2 / m.sum() for m in (left, ~left)) - y.sum() ** 2 / len(y)
            top = max(top, (gain, f, (a + b) / 2), key=lambda t: t[0])
    return top


def test_a_tree_takes_the_best_split():
    x, y = series_of_rows(n=60)
    whole = {**TR.PARAMS, "maxIter": 1, "maxDepth": 1, "subsamplingRate": 1.0, "featureSubsetStrategy": "1.0", "stepSize": 1.0, "seed": 1}
    tree = B.fit(x, y, 0, whole)
    gain, f, cut = best_split_by_hand(x, y - y.mean(), 20)
    assert tree.feature[0, 0] == f and tree.threshold[0, 0] == pytest.approx(cut) and tree.gain[f] == pytest.approx(gain)
    left = x[:, f] <= cut
    np.testing.assert_allclose(tree.predict(x), np.where(left, y[left].mean(), y[~left].mean()))


def test_missing_values_go_where_training_sent_them():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    y = np.where(x[:, 0] > 0, 10.0, 0.0) + rng.normal(size=400) * 0.1
    gone = rng.random(400) < 0.3
    y[gone] = 10.0  # missing rows behave like the right side
    x[gone, 0] = np.nan
    settings = {**TR.PARAMS, "maxIter": 40, "stepSize": 0.5, "seed": 1, "featureSubsetStrategy": "1.0"}
    model = B.fit(x, y, 0, settings)
    assert model.predict(np.array([[np.nan, 0.0]]))[0] == pytest.approx(10, abs=0.3)
    assert not model.missing_left[0, 0]
    x[gone, 0], y[gone] = 5.0, 10.0  # none missing in training: with the larger side
    model = B.fit(x, y, 0, settings)
    assert model.predict(np.array([[np.nan, 0.0]]))[0] == pytest.approx(10, abs=0.3)


# ------------------------------------------------------------------ metrics
def test_summary_by_hand(results, results_pdf):
    got = M.summarize(results).toPandas().set_index(["series", "model"])
    for (series, model), p in results_pdf.groupby(["series", "model"]):
        e = (p.y_true - p.y_pred).abs()
        ref = results_pdf[(results_pdf.series == series) & (results_pdf.model == "snaive")]
        ref_mae = (ref.y_true - ref.y_pred).abs().groupby(ref.fold).mean().sum()
        row = got.loc[series, model]
        assert row["mape"] == pytest.approx((e / p.y_true).mean())
        assert row["rmse"] == pytest.approx(np.sqrt((e**2).mean()))
        assert row["mase"] == pytest.approx(e.groupby(p.fold).mean().sum() / ref_mae)
        assert row["n_folds"] == 12 and row["n_points"] == 288


def test_lost_predictions_leave_no_score(results):
    lost = results.withColumn("y_pred", F.when((F.col("model") == "naive") & (F.col("fold") == 2) & (F.col("hour") == 5), None).otherwise(F.col("y_pred")))
    rows = {r["model"]: r for r in M.summarize(lost).where("series = 'a'").collect()}
    assert rows["naive"]["mase"] is None and rows["naive"]["n_points"] == 287
    assert rows["sarima"]["mase"] is not None and rows["sarima"]["n_points"] == 288
    with pytest.raises(ValueError, match="different folds"):
        M.require_aligned(lost)
    assert RP.significance_table(lost).where("model = 'naive' AND beats_baseline_p IS NOT NULL").count() == 0


def test_mase_needs_an_aligned_reference(results):
    assert M.mase(results.where("model <> 'snaive'")).where("mase IS NOT NULL").count() == 0
    broken = results.where("NOT (model = 'naive' AND fold = 1)")
    with pytest.raises(ValueError, match="different folds"):
        M.require_aligned(broken)
    nulls = {r["model"] for r in M.mase(broken).where("mase IS NULL").collect()}
    assert nulls == {"naive"}


def test_zero_truth_gives_infinite_mape(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "y_true double, y_pred double")
    assert math.isinf(df.agg(M.mape()).first()[0])


def signed_rank_exact(d):
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    total = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product([0, 1], repeat=len(d))]
    return w, min(1.0, 2 * np.mean(np.array(total) <= w + 1e-9))


def test_signed_rank_exact_branch(results, results_pdf):
    got = M.compare_models(results, "naive", "sarima").toPandas().set_index("series")
    for series, p in results_pdf.groupby("series"):
        m = p.assign(e=(p.y_true - p.y_pred).abs()).groupby(["model", "fold"]).e.mean()
        d = (m["naive"] - m["sarima"]).to_numpy()
        w, prob = signed_rank_exact(d)
        row = got.loc[series]
        assert row["exact"] and row["wilcoxon_stat"] == w
        assert row["p_value"] == pytest.approx(prob)
        assert row["mean_diff"] == pytest.approx(d.mean()) and row["a_wins_folds"] == (d < 0).sum()


def test_signed_rank_ties_and_zeros_use_the_normal_branch(spark):
    d = [0.0, 1.0, 1.0, -1.0, 2.0, 3.0, -2.0, 4.0, 5.0, 6.0]
    rows = [("s", m, i, v) for i, x in enumerate(d) for m, v in (("x", 10.0 + x), ("y", 10.0))]
    maes = spark.createDataFrame(rows, "series string, model string, fold int, fold_mae double")
    pairs = spark.createDataFrame([("x", "y")], "model_a string, model_b string")
    got = M.compare_pairs(maes, pairs).first()
    nz = np.array([v for v in d if v])
    ranks = pd.Series(np.abs(nz)).rank()
    w = min(ranks[nz > 0].sum(), ranks[nz < 0].sum())
    n = len(nz)
    t = ranks.value_counts()
    se = math.sqrt((n * (n + 1) * (2 * n + 1) - 0.5 * (t**3 - t).sum()) / 24)
    z = (w - n * (n + 1) / 4) / se
    assert not got["exact"] and got["wilcoxon_stat"] == w and got["z"] == pytest.approx(z)
    assert got["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_self_comparison_finds_nothing(results):
    got = M.compare_models(results, "snaive", "snaive").first()
    assert got["p_value"] == 1.0 and got["mean_diff"] == 0 and not got["significant_at_05"]


def test_comparison_refuses_different_folds(results):
    with pytest.raises(ValueError, match="different folds"):
        M.compare_models(results.where("NOT (model = 'naive' AND fold = 1)"), "naive", "snaive")


# ------------------------------------------------------------------ reports
def test_significance_table(results):
    t = RP.significance_table(results).toPandas().sort_values(["series", "place"])
    for _, p in t.groupby("series"):
        assert p.mae.is_monotonic_increasing and len(p) == 4
        best = p.iloc[0]
        assert (p.shipped == best["model"]).all() and not best["differs_from_shipped"]
        assert not p.set_index("model").loc["snaive", "beats_baseline"]


def test_diagnostic_prefers_the_dense_run(results):
    dense = results.where("model = 'naive' AND series = 'a'").withColumn("protocol", F.lit("dense"))
    got = RP.diagnostic_results(results.unionByName(dense), "naive").groupBy("series").agg(F.first("protocol").alias("p"))
    assert {r["series"]: r["p"] for r in got.collect()} == {"a": "dense", "b": "weekly"}


def test_error_tables_and_findings(results, results_pdf):
    tables = RP.error_tables(results.where("model = 'naive'"))
    pdf = tables.toPandas()
    by_hour = pdf[(pdf.table == "by_hour") & (pdf.series == "a")].set_index("hour").mape
    p = results_pdf[(results_pdf.model == "naive") & (results_pdf.series == "a")]
    want = ((p.y_true - p.y_pred).abs() / p.y_true).groupby(p.hour).mean()
    np.testing.assert_allclose(by_hour.sort_index(), want.sort_index())
    found = RP.findings(tables).where("series = 'a'").first()
    assert found["worst_hour"] == want.idxmax() and found["best_hour"] == want.idxmin()
    assert RP.findings(tables, "weekly").first()["day_type_verdict"] == "not measured"


def test_best_and_worst_fold(results, results_pdf):
    got = RP.best_worst_folds(results).toPandas()
    m = results_pdf.assign(e=(results_pdf.y_true - results_pdf.y_pred).abs()).groupby(["series", "model", "fold"]).e.mean()
    for (series, model, kind), p in got.groupby(["series", "model", "kind"]):
        s = m[series, model]
        assert set(p.fold) == {s.idxmin() if kind == "best" else s.idxmax()} and len(p) == 24


def test_model_order(spark):
    rows = [("s", m, 0.1, 1.0) for m in ("zeta", "lgbm", "naive", "alpha", "prophet")]
    t = RP.model_table(spark.createDataFrame(rows, "series string, model string, mape double, mase double"))
    assert [r["model"] for r in t.orderBy("place").collect()] == ["naive", "prophet", "lgbm", "alpha", "zeta"]
