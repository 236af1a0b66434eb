"""Grouped error reports, findings and rankings over backtest results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourloom.config import BASELINE_MODEL, KEYS, MODEL_ORDER, SHIPPED_MODEL
from hourloom.operators import metrics as M


def diagnostic_results(results: DataFrame, model: str, keys=KEYS) -> DataFrame:
    """Rows of the dense run of a model where a series has one, else of its weekly run."""
    rows = results.where(F.col("model") == model)
    best = rows.groupBy(*keys).agg(F.min("protocol").alias("chosen"))  # 'dense' < 'weekly'
    return rows.join(best, list(keys)).where("protocol = chosen").drop("chosen")


def error_tables(results: DataFrame, keys=KEYS) -> DataFrame:
    """Errors by hour, by day type and by month from one pass."""
    keys = list(keys)
    typed = results.withColumn(
        "day_type", F.when(F.col("is_weekend") == 1, "weekend").otherwise("weekday")
    )
    groups = ["hour", "day_type", "month"]
    sets = [[*keys, g] for g in groups]
    out = typed.groupingSets(sets, *keys, *groups).agg(
        *M.errors(), *[F.grouping(g).alias(f"__{g}") for g in groups]
    )
    table = F.coalesce(*[F.when(F.col(f"__{g}") == 0, F.lit(f"by_{g}")) for g in groups])
    return out.select(*keys, table.alias("table"), *groups, "mape", "rmse", "mae", "n")


def findings(tables: DataFrame, protocol: str = "dense", keys=KEYS) -> DataFrame:
    """Hardest and easiest hour and month, and whether day type matters, per series.

    Ties go to the lowest hour or month. A weekday/weekend gap is judged on dense runs only,
    and below 5 % relative it is no finding.
    """

    def extreme(pick, kind, col, sign):
        here = F.when(F.col("table") == kind, F.struct(F.col("mape"), (F.col(col) * sign).alias("i")))
        return pick(col, here)

    def level(kind):
        return F.max(F.when(F.col("day_type") == kind, F.col("mape")))

    agg = tables.groupBy(*keys).agg(
        extreme(F.max_by, "by_hour", "hour", -1).alias("worst_hour"),
        extreme(F.min_by, "by_hour", "hour", 1).alias("best_hour"),
        F.max(F.when(F.col("table") == "by_hour", F.col("mape"))).alias("worst_hour_mape"),
        F.min(F.when(F.col("table") == "by_hour", F.col("mape"))).alias("best_hour_mape"),
        extreme(F.max_by, "by_month", "month", -1).alias("worst_month"),
        extreme(F.min_by, "by_month", "month", 1).alias("best_month"),
        F.max(F.when(F.col("table") == "by_month", F.col("mape"))).alias("worst_month_mape"),
        F.min(F.when(F.col("table") == "by_month", F.col("mape"))).alias("best_month_mape"),
        level("weekday").alias("weekday_mape"),
        level("weekend").alias("weekend_mape"),
    )
    wd, we = F.col("weekday_mape"), F.col("weekend_mape")
    gap = F.try_divide(F.abs(we - wd), F.least(wd, we))
    dense = protocol == "dense"
    verdict = (
        F.when(F.lit(not dense) | gap.isNull(), "not measured")
        .when(gap < 0.05, "day type barely matters")
        .when(we > wd, "weekends are harder")
        .otherwise("weekdays are harder")
    )
    return agg.withColumns(
        {
            "hour_ratio": F.try_divide("worst_hour_mape", "best_hour_mape"),
            "day_type_gap": F.when(F.lit(dense), gap),
            "day_type_verdict": verdict,
        }
    )


def significance_table(
    results: DataFrame, keys=KEYS, baseline: str = BASELINE_MODEL, shipped: str = SHIPPED_MODEL
) -> DataFrame:
    """Every model against the baseline and against the shipped model (the best one if the
    named one was not run), ranked by MAE."""
    keys = list(keys)
    maes = M.fold_maes(results, keys)
    overall = results.groupBy(*keys, "model").agg(M.mae().alias("mae"))
    reference = overall.groupBy(*keys).agg(
        F.coalesce(
            F.max(F.when(F.col("model") == shipped, F.col("model"))),
            F.min_by("model", F.struct("mae", "model")),
        ).alias("shipped"),
        F.max(F.when(F.col("model") == baseline, F.col("model"))).alias("baseline"),
    )
    models = overall.join(reference, keys)
    pairs = (
        models.where("model <> baseline")
        .select(*keys, F.col("model").alias("model_a"), F.col("baseline").alias("model_b"))
        .unionByName(
            models.where("model <> shipped").select(
                *keys, F.col("shipped").alias("model_a"), F.col("model").alias("model_b")
            )
        )
        .distinct()
    )
    # Models with other folds than their partner's, or lost predictions, are not tested.
    same = F.col("unmatched_folds") == 0
    tests = M.compare_pairs(maes, pairs, keys).select(
        *keys, "model_a", "model_b", *[F.when(same, F.col(c)).alias(c) for c in ("mean_diff", "p_value", "significant_at_05")]
    )
    versus_base = tests.select(
        *keys,
        F.col("model_a").alias("model"),
        F.col("model_b").alias("baseline"),
        F.col("p_value").alias("beats_baseline_p"),
        (F.col("significant_at_05") & (F.col("mean_diff") < 0)).alias("__beats"),
    )
    versus_shipped = tests.select(
        *keys,
        F.col("model_a").alias("shipped"),
        F.col("model_b").alias("model"),
        F.col("p_value").alias("vs_shipped_p"),
        F.col("significant_at_05").alias("__differs"),
        F.col("mean_diff").alias("shipped_minus_model"),
    )
    order = Window.partitionBy(*keys).orderBy("mae", "model")
    return (
        models.join(versus_base, [*keys, "model", "baseline"], "left")
        .join(versus_shipped, [*keys, "model", "shipped"], "left")
        .select(
            *keys,
            F.row_number().over(order).alias("place"),
            "model",
            "shipped",
            "mae",
            "beats_baseline_p",
            F.coalesce("__beats", F.lit(False)).alias("beats_baseline"),
            "vs_shipped_p",
            F.coalesce("__differs", F.lit(False)).alias("differs_from_shipped"),
            "shipped_minus_model",
        )
    )


def best_worst_folds(results: DataFrame, keys=KEYS) -> DataFrame:
    """The hours of each model's easiest and hardest fold, with that fold's MAPE; ties go to the
    lowest fold."""
    keys = list(keys)
    group = [*keys, "model"]
    per_fold = results.groupBy(*group, "fold").agg(M.mae().alias("mae"), M.mape().alias("fold_mape"))
    ends = per_fold.groupBy(*group).agg(
        F.min_by("fold", F.struct("mae", "fold")).alias("best"),
        F.max_by("fold", F.struct(F.col("mae"), -F.col("fold"))).alias("worst"),
    )
    picked = ends.select(
        *group,
        F.inline(
            F.array(
                F.struct(F.lit("best").alias("kind"), F.col("best").alias("fold")),
                F.struct(F.lit("worst").alias("kind"), F.col("worst").alias("fold")),
            )
        ),
    ).join(per_fold.drop("mae"), [*group, "fold"])
    return picked.join(results, [*group, "fold"]).select(
        *group, "kind", "fold", "target_date", "lead", "y_true", "y_pred", "fold_mape"
    )


def model_table(summary: DataFrame, keys=KEYS) -> DataFrame:
    """MAPE and MASE in the fixed weak-to-strong order; unknown names follow alphabetically."""
    known = F.array(*[F.lit(m) for m in MODEL_ORDER])
    at = F.array_position(known, F.col("model"))
    order = Window.partitionBy(*keys).orderBy(F.when(at > 0, at).otherwise(len(MODEL_ORDER) + 1), "model")
    return summary.select(*keys, F.row_number().over(order).alias("place"), "model", "mape", "mase")


def hour_month_surface(results: DataFrame, keys=KEYS) -> DataFrame:
    """Mean APE by local hour (rows) and month (columns m1..m12)."""
    wide = results.groupBy(*keys, "hour").pivot("month", list(range(1, 13))).agg(M.mape())
    return wide.select(*keys, "hour", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])


def hour_by_model(results: DataFrame, keys=KEYS) -> DataFrame:
    return results.groupBy(*keys, "model", "hour").agg(M.mape().alias("mape"))
