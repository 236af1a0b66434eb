"""Direct multi-horizon boosted trees: one model per series and lead, refit for every fold.

A lead of a series has one row per operating day, so a fit needs no more than the days up to its cutoff: Spark deals
(series, lead) groups over the cluster, a group lists its days in order, and each fold takes those up to its cutoff. The fits are
functions of BoostedTrees.java, inside Spark's tasks. Where those can't be loaded, boosting.py grows the trees of
(series, leads, fold part) groups side by side in Python, with the same bits.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourloom.config import DEFAULTS, FEATURES, KEYS, Settings
from hourloom.functions import timeline as tl
from hourloom.operators import boosting, jvm
from hourloom.operators import folds as fo
from hourloom.operators.features import usable
from hourloom.session import materialize

# Boosting parameters (depth 6 gives the 63-leaf trees' size), and how long to wait for a better round.
PARAMS = {
    "maxIter": 600,
    "stepSize": 0.05,
    "maxDepth": 6,
    "minInstancesPerNode": 20,
    "subsamplingRate": 0.9,
    "featureSubsetStrategy": "0.9",
    "patience": 50,
    "bins": 64,
}
MIN_VALIDATION = 10
WEATHER_INPUTS = ("temp", "hdd", "cdd", "temp_lag24")
#: In Python, folds of one series and lead are fit in so many groups; so many leads are fit together where series are few, and all
#: where they make so many groups a core: a round costs less a fit, the more fits share it.
FOLD_PARTS, LEADS_TOGETHER, GROUPS_A_CORE = 4, 6, 3
#: Tasks that the groups are dealt to, for each core.
TASKS_A_CORE = 16

_FIT = "rounds int, n_train int, n_valid int"
_MODEL = (
    f"{_FIT}, base double, slots int, node array<int>, feature array<int>, threshold array<double>, missing_left array<boolean>, "
    "value array<double>, gain array<double>"
)
#: What predict_models() needs of a model, as Predict in BoostedTrees.java takes it.
_NEEDED = ("rounds", "base", "slots", "node", "feature", "threshold", "missing_left", "value")


def holdout_split(train: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS) -> DataFrame:
    """Mark the last rows of each lead as validation: 90 or a fifth, and none below ten.

    A group is one lead of one series: one row per day.
    """
    group = [c for c in (*keys, "fold", "lead") if c in train.columns]
    latest = Window.partitionBy(*group).orderBy(F.desc("ts"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    n_val = F.least(F.lit(cfg.val_days), F.floor(n / 5)).cast("int")
    marked = train.withColumns({"__n": n_val, "__r": F.row_number().over(latest)})
    held = (F.col("__n") >= MIN_VALIDATION) & (F.col("__r") <= F.col("__n"))
    return marked.withColumn("is_validation", held).drop("__n", "__r")


def n_validation(n: int, cfg: Settings = DEFAULTS) -> int:
    """How many of a lead's n rows holdout_split marks."""
    held = min(cfg.val_days, n // 5)
    return held if held >= MIN_VALIDATION else 0


def training_store(features: DataFrame, keys=KEYS, x=FEATURES) -> DataFrame:
    """training_rows() written once, a folder per lead, for callers that fit more than once."""
    return _stored_rows(training_rows(features, keys, x))


def _stored_rows(rows: DataFrame) -> DataFrame:
    return materialize(rows.hint("rebalance", "lead"), "tree-store", ["lead"])


def training_rows(features: DataFrame, keys=KEYS, x=FEATURES) -> DataFrame:
    """What models may learn from: usable rows."""
    return usable(features).select(*keys, "ts", "lead", F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in x])


def _function(df: DataFrame, name: str, returns: str):
    """A function of BoostedTrees.java, or None where it can't be loaded."""
    try:
        return jvm.function(df.sparkSession, name, returns)
    except (Py4JError, OSError, AttributeError) as e:
        warnings.warn(f"trees are fit in Python, which takes several times as long: {e}", stacklevel=3)
        return None


def _listed(rows: DataFrame, keys: list[str], **values) -> DataFrame:
    """A row per (keys, lead), with the lists of the rows' structs `values`, null ones left out."""
    group = [*keys, "lead"]
    dealt = _spread(rows.select(*group, *[v.alias(c) for c, v in values.items()]), group)
    return dealt.groupBy(*group).agg(*[F.collect_list(c).alias(c) for c in values])


def _inputs(x):
    return F.array(*[F.col(c).cast("double") for c in x]).alias("x")


def _days(x):
    """A training row as a struct that sorts by time."""
    return F.struct("ts", "y", _inputs(x))


def _field(column: str, name: str):
    return F.transform(column, lambda r: r[name])


def _spread(df: DataFrame, by: list[str]) -> DataFrame:
    """Groups dealt over every core; a stated number, for the groups' bytes say nothing about the time of a fit.

    Many small tasks, so that cores that got few groups, or short ones, take more tasks.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *by)


def _lead_group(groups: DataFrame, cfg: Settings = DEFAULTS):
    """Which leads are fit together: all of them, if `groups` (series, or series and parts of their folds) are enough for the cores."""
    enough = groups.count() >= GROUPS_A_CORE * groups.sparkSession.sparkContext.defaultParallelism
    return F.floor((F.col("lead") - 1) / (cfg.horizon if enough else LEADS_TOGETHER)).alias("leads")


def _table(pdf: pd.DataFrame, x, cfg: Settings) -> tuple[np.ndarray, np.ndarray, int]:
    """Inputs, targets and number of held-out rows of a fit on rows in time order."""
    return pdf[list(x)].to_numpy(dtype=float), pdf["y"].to_numpy(dtype=float), n_validation(len(pdf), cfg)


def _reached(feature: np.ndarray) -> np.ndarray:
    """Places, tree by tree, of the slots that are in use: roots and children of splits."""
    used = np.zeros(feature.shape, dtype=bool)
    used[:, 0] = True
    trees, inner = np.nonzero(feature >= 0)
    used[trees, 2 * inner + 1] = used[trees, 2 * inner + 2] = True
    return np.flatnonzero(used)


def _stored(model) -> boosting.Ensemble:
    """The trees of a row of fit_models()."""
    shape, node, whole = (int(model["rounds"]), int(model["slots"])), np.asarray(model["node"], dtype=np.int64), []
    for c, none in {"feature": -1, "threshold": 0.0, "missing_left": False, "value": 0.0}.items():
        a = np.full(shape, none)
        a.ravel()[node] = np.asarray(model[c])
        whole.append(a)
    return boosting.Ensemble(float(model["base"]), *whole, np.asarray(model["gain"]))


def fit_models(
    features: DataFrame, params: dict | None = None, leads=None, keys=KEYS, cfg: Settings = DEFAULTS, x=FEATURES,
) -> DataFrame:
    """One row per series and lead: rounds kept, rows learnt from and held out, and the trees as arrays."""
    keys, settings = list(keys), {**PARAMS, "seed": cfg.seed, **(params or {})}
    store = training_rows(features, keys, x)
    if leads:
        store = store.where(F.col("lead").isin(list(leads)))
    if fitted := _function(store, "FitModel", f"struct<{_MODEL}>"):
        days = _listed(store, keys, days=_days(x)).withColumn("days", F.array_sort("days"))
        model = fitted(jvm.settings(settings, cfg, MIN_VALIDATION), _field("days", "y"), F.flatten(_field("days", "x")))
        return days.select(*keys, "lead", model.alias("model")).select(*keys, "lead", "model.*")

    store = _stored_rows(store)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [part.sort_values("ts") for _, part in pdf.groupby("lead")]
        tables = [_table(part, x, cfg) for part in parts]
        made = []
        for part, (_, y, held), model in zip(parts, tables, boosting.fit_many(tables, settings)):
            node = _reached(model.feature)
            row = {c: part[c].iloc[0] for c in (*keys, "lead")}
            row |= {"rounds": model.rounds, "n_train": len(y) - held, "n_valid": held, "base": model.base, "slots": model.feature.shape[1], "node": node, "gain": model.gain}
            row |= {c: getattr(model, c).ravel()[node] for c in ("feature", "threshold", "missing_left", "value")}
            made.append(row)
        return pd.DataFrame(made)[[f.split()[0] for f in schema.split(", ")]]

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in store.select(*keys, "lead").schema)
    schema, group = f"{types}, {_MODEL}", [*keys, "leads"]
    return _spread(store.withColumn("leads", _lead_group(store.select(*keys).distinct(), cfg)), group).groupBy(*group).applyInPandas(fit, schema)


def predict_models(models: DataFrame, hours: DataFrame, keys=KEYS, x=FEATURES) -> DataFrame:
    """(keys, fold, ts, y_pred) of rows with a fold: each by the model of its series and lead.

    A missing input goes the way that its node learnt; without a model the prediction is null.
    """
    keys = list(keys)
    if predicted := _function(hours, "Predict", "array<double>"):
        hour, model = F.struct("fold", "ts", _inputs(x)), F.struct(*_NEEDED)
        none = [F.lit(None).cast(t).alias(c) for c, t in (("hour", hours.select(hour.alias("h")).schema["h"].dataType), ("model", models.select(model.alias("m")).schema["m"].dataType))]
        both = hours.select(*keys, "lead", hour.alias("hour"), none[1]).unionByName(models.select(*keys, "lead", none[0], model.alias("model")))
        listed = _listed(both, keys, hour=F.col("hour"), model=F.col("model")).where(F.size("hour") > 0)
        made = predicted(F.try_element_at("model", F.lit(1)), F.lit(len(x)), F.flatten(_field("hour", "x")))
        rows = listed.select(*keys, "hour", made.alias("made")).select(*keys, "made", F.posexplode("hour").alias("at", "hour"))
        return rows.select(*keys, "hour.fold", "hour.ts", F.nanvl(F.get("made", "at"), F.lit(None).cast("double")).alias("y_pred"))

    leads = F.floor((F.col("lead") - 1) / LEADS_TOGETHER).alias("leads")
    rows = hours.select(*keys, "lead", leads, "fold", "ts", *[F.col(c).cast("double").alias(c) for c in x])

    def predict(rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        inputs, made = rows[list(x)].to_numpy(dtype=float), np.full(len(rows), np.nan)
        first = {model["lead"]: model for model in reversed(models.to_dict("records"))}
        for lead, at in rows.reset_index(drop=True).groupby("lead").groups.items():
            if lead in first:
                made[at] = _stored(first[lead]).predict(inputs[at])
        return rows[[*keys, "fold", "ts"]].assign(y_pred=made)

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys, "fold", "ts").schema)
    group = [*keys, "leads"]
    made = rows.groupBy(*group).cogroup(models.withColumn("leads", leads).groupBy(*group)).applyInPandas(predict, f"{types}, y_pred double")
    return made.withColumn("y_pred", F.nanvl("y_pred", F.lit(None).cast("double")))


def fold_fits(
    features: DataFrame, folds: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS,
    params: dict | None = None, leads=None, x=FEATURES, store: DataFrame | None = None,
) -> DataFrame:
    """(keys, fold, lead, ts, y_pred, rounds, n_train, n_valid): every lead of every fold, fit on what lies at or before the
    fold's cutoff in its own series. Without a usable row there the prediction is null.

    History is shuffled once, whatever the number of folds.
    """
    keys, settings = list(keys), {**PARAMS, "seed": cfg.seed, **(params or {})}
    store = training_rows(features, keys, x) if store is None else store
    targets = fo.target_rows(features, folds, keys)
    if leads:
        store, targets = (t.where(F.col("lead").isin(list(leads))) for t in (store, targets))
    if fitted := _function(store, "FoldFits", "array<double>"):
        made = _fold_fits(store, targets, folds, fitted, jvm.settings(settings, cfg, MIN_VALIDATION), keys, x)
    else:
        made = _fold_fits_in_python(_stored_rows(store), targets, folds, settings, keys, cfg, x)
    return materialize(made, "tree-fits").withColumn("y_pred", F.nanvl("y_pred", F.lit(None).cast("double")))


def _fold_fits(store, targets, folds, fitted, settings, keys, x) -> DataFrame:
    last = F.broadcast(folds.agg(F.max("cutoff").alias("__last")))  # one row
    history = store.join(last, F.col("ts") <= F.col("__last")).select(*keys, "lead", _days(x).alias("day"))
    wanted = targets.select(*keys, "lead", F.struct("fold", "ts", "cutoff", _inputs(x)).alias("hour"))
    none = [F.lit(None).cast(t.schema[c].dataType).alias(c) for t, c in ((history, "day"), (wanted, "hour"))]
    both = history.select("*", none[1]).unionByName(wanted.select("*", none[0]))
    listed = _listed(both, keys, day=F.col("day"), hour=F.col("hour")).where(F.size("hour") > 0).withColumn("day", F.array_sort("day"))
    listed = listed.withColumn("stamps", _field("day", "ts"))
    sizes = F.transform("hour", lambda h: F.size(F.filter("stamps", lambda ts: ts <= h["cutoff"])))
    made = fitted(settings, _field("day", "y"), F.flatten(_field("day", "x")), sizes, F.flatten(_field("hour", "x")))
    rows = listed.select(*keys, "lead", "hour", made.alias("made")).select(*keys, "lead", "made", F.posexplode("hour").alias("at", "hour"))
    numbers = [F.get("made", F.col("at") * 4 + k) for k in range(4)]
    return rows.select(
        *keys, "hour.fold", "lead", "hour.ts", numbers[0].alias("y_pred"),
        *[v.cast("int").alias(c) for v, c in zip(numbers[1:], ("rounds", "n_train", "n_valid"))])


def _fold_fits_in_python(store, targets, folds, settings, keys, cfg, x) -> DataFrame:
    """History is copied to FOLD_PARTS groups per series and lead at most, whatever the number of folds."""
    part = F.col("fold") % FOLD_PARTS
    together = _lead_group(folds.select(*keys, part).distinct(), cfg)
    wanted = targets.select(
        *keys, "lead", together, part.alias("part"), "fold", "cutoff", "ts", *[F.col(c).cast("double").alias(c) for c in x])
    last = folds.groupBy(*keys).agg(F.max("cutoff").alias("last_cutoff"), F.collect_set(part).alias("parts"))  # FOLD_PARTS at most
    history = tl.join_series(store, last, keys, cfg).where("ts <= last_cutoff").drop("last_cutoff").withColumns(
        {"part": F.explode("parts"), "leads": together}).drop("parts")

    def fit(history: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        of_lead = {}
        for lead, rows in history.groupby("lead"):
            rows = rows.sort_values("ts")
            of_lead[lead] = rows["ts"], *_table(rows, x, cfg)[:2]
        made, tables, places = [], [], []
        for _, row in targets.sort_values(["lead", "fold"]).iterrows():
            out = {c: row[c] for c in (*keys, "fold", "lead", "ts")} | {"y_pred": None, "rounds": 0, "n_train": 0, "n_valid": 0}
            if row["lead"] in of_lead:
                ts, inputs, y = of_lead[row["lead"]]
                n = int((ts <= row["cutoff"]).sum())  # the first ones; folds share the lead's arrays
                if n:
                    places.append((out, row[list(x)].to_numpy(dtype=float)[None, :]))
                    tables.append((inputs[:n], y[:n], n_validation(n, cfg)))
            made.append(out)
        for (out, hour), (_, y, held), model in zip(places, tables, boosting.fit_many(tables, settings)):
            out |= {"y_pred": float(model.predict(hour)[0]), "rounds": model.rounds, "n_train": len(y) - held, "n_valid": held}
        columns = [*keys, "fold", "lead", "ts", "y_pred", "rounds", "n_train", "n_valid"]
        return pd.DataFrame(made, columns=columns).astype({"y_pred": float})

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in targets.select(*keys, "fold", "lead", "ts").schema)
    group = [*keys, "leads", "part"]
    fits = _spread(history, group).groupBy(*group).cogroup(_spread(wanted, group).groupBy(*group))
    return fits.applyInPandas(fit, f"{types}, y_pred double, {_FIT}")


def tree_forecast(features: DataFrame, folds: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS, **options) -> DataFrame:
    """fold_fits() as a forecaster."""
    return fold_fits(features, folds, keys, cfg, **options).select(*keys, "fold", "ts", "y_pred")


def feature_importance(models: DataFrame, keys=KEYS, x=FEATURES) -> DataFrame:
    """Per series: each input's share of the split gain, averaged over the lead models."""
    gains = models.select(*keys, F.posexplode("gain").alias("at", "gain")).groupBy(*keys, "at").agg(F.avg("gain").alias("gain"))
    total = F.sum("gain").over(Window.partitionBy(*keys))  # one row per input
    names = F.element_at(F.array(*map(F.lit, x)), F.col("at") + 1)
    return gains.select(*keys, names.alias("feature"), F.coalesce(F.try_divide("gain", total), F.lit(0.0)).alias("gain"))


def weather_ablation(
    features: DataFrame, n_folds: int = 8, keys=KEYS, cfg: Settings = DEFAULTS,
    forecaster=tree_forecast, **options,
) -> DataFrame:
    """MAPE per fold with the weather inputs and with them zeroed in training and target."""
    from hourloom.operators import metrics as M
    from hourloom.operators.forecasters import results_frame

    keys = list(keys)
    folds = materialize(fo.make_folds(features, n_folds, None, keys, cfg), "ablation-folds")
    zero = {c: F.lit(0.0) for c in WEATHER_INPUTS}

    def scored(table, name):
        made = forecaster(table, folds, keys, cfg, **options)
        rows = results_frame(made, features, folds, name, keys=keys)
        return rows.groupBy(*keys, "fold", "target_date").agg(M.mape().alias(name))

    return scored(features, "mape_with_weather").join(
        scored(features.withColumns(zero), "mape_without_weather"), [*keys, "fold", "target_date"]
    )


def ablation_gap(ablation: DataFrame, keys=KEYS) -> DataFrame:
    """Per series: mean MAPE over the folds with and without weather, and what the weather is worth, also relative."""
    with_w, without = F.avg("mape_with_weather"), F.avg("mape_without_weather")
    return ablation.groupBy(*keys).agg(
        F.count("*").alias("n_folds"), with_w.alias("mape_with_weather"), without.alias("mape_without_weather"),
        (without - with_w).alias("gap"), F.try_divide(without, with_w).alias("ratio"),
    ).withColumn("relative_gap", F.col("ratio") - 1).drop("ratio")
