"""Leakage checks that rerun the real operators on altered data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourloom.config import DEFAULTS, FEATURES, KEYS, Settings
from hourloom.functions import timeline as tl
from hourloom.operators import folds as fo
from hourloom.operators import metrics as M
from hourloom.operators.features import build_features
from hourloom.operators.forecasters import results_frame
from hourloom.session import materialize


def corrupt_after(clean: DataFrame, cutoffs: DataFrame, column: str, keys=KEYS) -> DataFrame:
    """Overwrite a column strictly after each series' cutoff with values made from the hour."""
    hour = tl.hours_between(F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'"), F.col("ts"))
    noise = F.pmod(hour * 7919, F.lit(45_000)) + F.lit(15_000.5)
    late = F.col("ts") > F.col("__cutoff")
    return (
        tl.join_series(clean, cutoffs.select(*keys, F.col("cutoff").alias("__cutoff")), keys)
        .withColumn(column, F.when(late, noise).otherwise(F.col(column)))
        .drop("__cutoff")
    )


def leakage_replay(
    clean: DataFrame, features: DataFrame, fold: DataFrame, column: str, keys=KEYS,
    cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Per feature: target hours whose value changed when `column` was corrupted past the cutoff.

    `fold` holds one fold per series.
    """
    keys = list(keys)
    rebuilt = build_features(corrupt_after(clean, fold, column, keys), keys, cfg)
    before = fo.target_rows(features, fold, keys).select(*keys, "ts", *FEATURES)
    after = rebuilt.select(*keys, "ts", *[F.col(c).alias(f"__{c}") for c in FEATURES])

    def changed(c):
        a, b = F.col(c).cast("double"), F.col(f"__{c}").cast("double")
        near = F.abs(a - b) <= F.lit(1e-9) * F.greatest(F.abs(a), F.lit(1.0))
        return F.count_if(~(a.eqNullSafe(b) | F.coalesce(near, F.lit(False))))

    wide = before.join(after, [*keys, "ts"]).groupBy(*keys).agg(
        *[changed(c).alias(c) for c in FEATURES]
    )
    pairs = [
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("changed_hours")) for c in FEATURES
    ]
    return wide.select(*keys, F.inline(F.array(*pairs)))


def forecast_replay(
    clean: DataFrame, features: DataFrame, fold: DataFrame, forecasters: dict, column: str = "load", keys=KEYS,
    cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Per series and model: target hours whose forecast moved when `column` was corrupted past the cutoff.

    Features are rebuilt from the corrupted table and every model is refit on them. `fold` holds one fold per series.
    """
    keys = list(keys)
    rebuilt = materialize(build_features(corrupt_after(clean, fold, column, keys), keys, cfg), "replay-features")
    rows = []
    for name, forecaster in forecasters.items():
        before = forecaster(features, fold, keys, cfg).select(*keys, "ts", "y_pred")
        after = forecaster(rebuilt, fold, keys, cfg).select(*keys, "ts", F.col("y_pred").alias("__again"))
        a, b = F.col("y_pred"), F.col("__again")
        same = a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= F.lit(1e-6) * F.greatest(F.abs(a), F.lit(1.0)), F.lit(False))
        rows.append(
            before.join(after, [*keys, "ts"], "full").groupBy(*keys)
            .agg(F.count("y_pred").alias("n_hours"), F.count_if(~same).alias("moved_hours"))
            .select(*keys, F.lit(name).alias("model"), "n_hours", "moved_hours")
        )
    return reduce(DataFrame.unionByName, rows)


def shuffle_target(features: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS, value: str = "y") -> DataFrame:
    """Permute a column over each series' whole history, breaking its tie to the inputs.

    Every row has a place in time order and one in the order of a hash; the value at a place in hash order goes to the row
    at that place in time order. Places are counted within blocks, of time and of hashes, and added up over the blocks.
    Only times and values are moved for that; whole rows are joined with their new values once.
    """
    return _with_values(features, _permuted(features, keys, cfg, value), list(keys), value, cfg)


def _with_values(features: DataFrame, values: DataFrame, keys, value: str, cfg: Settings) -> DataFrame:
    """Rows that have one in `values` of the same time, with its value. Rows of the same time are paired in any order.

    Whole rows are shuffled once, by (keys, block): a join on times would do so again for its own keys.
    """
    at = [*keys, "__at", "ts"]
    block = tl.block_of(F.to_date("ts"), cfg).alias("__at")
    rows = features.select(*keys, block, "ts", F.struct(*[c for c in features.columns if c not in (*keys, "ts", value)]).alias("row"))
    others = values.select(*keys, block, "ts", F.struct(value).alias("new"))
    none = [F.lit(None).cast(t.schema[c].dataType).alias(c) for t, c in ((rows, "row"), (others, "new"))]
    both = rows.select("*", none[1]).unionByName(others.select("*", none[0])).repartition(*keys, "__at")
    pairs = both.groupBy(*at).agg(F.arrays_zip(F.collect_list("row").alias("row"), F.collect_list("new").alias("new")).alias("pairs"))
    made = pairs.select(*keys, "ts", F.explode("pairs").alias("pair")).where("pair.row IS NOT NULL AND pair.new IS NOT NULL")
    return made.select(*keys, "ts", "pair.row.*", f"pair.new.{value}").select(*features.columns)


def _permuted(features: DataFrame, keys, cfg: Settings, value: str) -> DataFrame:
    """(keys, ts, value) after shuffle_target()."""
    keys = list(keys)
    rows = features.select(*keys, "ts", "op_date", value).withColumns({"__block": tl.block_of(F.col("op_date"), cfg), "__hash": F.xxhash64("ts")})
    sizes = rows.groupBy(*keys, "__block").count()
    n_blocks = sizes.groupBy(*keys).agg(F.count("*").alias("__blocks"))
    rows = tl.join_series(rows, n_blocks, keys, cfg).withColumn("__bucket", F.pmod(F.shiftright("__hash", 16), F.col("__blocks")))

    def places(part: str, order: list[str], name: str) -> DataFrame:
        """The rows with their place, 1 to n."""
        counts = rows.groupBy(*keys, part).agg(F.count("*").alias("__n"))  # a row per block
        earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*keys, part, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
        rank = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order))
        return rows.withColumn("__rank", rank).join(offsets, [*keys, part]).withColumn(name, F.col("__rank") + F.col("__before"))

    in_time = places("__block", ["ts"], "__place").select(*keys, "__place", "ts")
    donors = places("__bucket", ["__hash", "ts"], "__place").select(*keys, "__place", value)
    return in_time.join(donors, [*keys, "__place"]).select(*keys, "ts", value)


def shuffled_target_check(
    features: DataFrame, fold: DataFrame, forecasters: dict, keys=KEYS, cfg: Settings = DEFAULTS
) -> DataFrame:
    """Per series and model: MAPE when trained on the true history and on a permuted one.

    `fold` holds one fold per series; what lies past its cutoff is left alone.
    """
    keys = list(keys)
    cut = tl.join_series(features.select(*keys, "ts", "op_date", "y"), fold.select(*keys, F.col("cutoff").alias("__cutoff")), keys, cfg)
    past, future = (cut.where(c).drop("__cutoff") for c in ("ts <= __cutoff", "ts > __cutoff"))
    values = _permuted(past, keys, cfg, "y").unionByName(future.select(*keys, "ts", "y"))
    shuffled = materialize(_with_values(features, values, keys, "y", cfg), "shuffled-features")

    def scored(table, forecaster, name):
        rows = results_frame(forecaster(table, fold, keys, cfg), features, fold, name, keys=keys)
        return rows.groupBy(*keys).agg(M.mape().alias(name))

    return reduce(DataFrame.unionByName, [
        scored(features, f, "mape").join(scored(shuffled, f, "mape_shuffled"), keys).withColumn("model", F.lit(name))
        for name, f in forecasters.items()
    ])
