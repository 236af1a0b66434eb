"""Error metrics, MASE and paired comparisons over backtest results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.config import BASELINE_MODEL, KEYS



def abs_error():
    return F.abs(F.col("y_true") - F.col("y_pred"))


def ape():
    """Absolute error over the true value; a zero truth gives infinity, as in floating point."""
    y, e = F.col("y_true"), abs_error()
    zero = F.when(e > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(y == 0, zero).otherwise(e / y)


def mape():
    return F.avg(ape())


def rmse():
    return F.sqrt(F.avg((F.col("y_true") - F.col("y_pred")) ** 2))


def mae():
    return F.avg(abs_error())


def errors():
    """The three error columns and the row count, as aggregate expressions."""
    return [
        mape().alias("mape"),
        rmse().alias("rmse"),
        mae().alias("mae"),
        F.count("y_pred").alias("n"),
    ]


def grouped_errors(results: DataFrame, by, keys=KEYS) -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    return results.groupBy(*keys, *by).agg(*errors())


def fold_maes(results: DataFrame, keys=KEYS) -> DataFrame:
    """Each fold's MAE and number of predictions; a fold that lost predictions has no MAE."""
    whole = F.count("y_pred") == F.count(F.lit(1))
    return results.groupBy(*keys, "model", "fold").agg(
        F.when(whole, mae()).alias("fold_mae"), F.count("y_pred").alias("n_rows")
    )


def fold_alignment(maes: DataFrame, reference: str = BASELINE_MODEL, keys=KEYS) -> DataFrame:
    """Per model: folds and rows that do not line up with the reference's."""
    keys = list(keys)
    models = maes.select(*keys, "model").distinct()
    ref = maes.where(F.col("model") == reference).select(
        *keys, "fold", F.col("fold_mae").alias("ref_mae"), F.col("n_rows").alias("ref_rows")
    )
    wanted = models.join(ref, keys)
    both = maes.join(wanted, [*keys, "model", "fold"], "full_outer")
    off = F.col("fold_mae").isNull() | F.col("ref_mae").isNull()
    return both.groupBy(*keys, "model").agg(
        F.count_if(off).alias("unmatched_folds"),
        (F.coalesce(F.sum("n_rows"), F.lit(0)) - F.coalesce(F.sum("ref_rows"), F.lit(0))).alias(
            "row_gap"
        ),
    )


def require_aligned(results: DataFrame, reference: str = BASELINE_MODEL, keys=KEYS) -> DataFrame:
    bad = (
        fold_alignment(fold_maes(results, keys), reference, keys)
        .where("unmatched_folds > 0 OR row_gap <> 0")
        .first()
    )
    if bad is not None:
        raise ValueError(f"{bad['model']} and {reference} cover different folds or target points")
    return results


def mase(results: DataFrame, reference: str = BASELINE_MODEL, keys=KEYS) -> DataFrame:
    """Summed fold MAEs over the reference's; null where the two do not line up."""
    keys = list(keys)
    maes = fold_maes(results, keys)
    totals = maes.groupBy(*keys, "model").agg(F.sum("fold_mae").alias("total"))
    ref = totals.where(F.col("model") == reference).select(*keys, F.col("total").alias("ref_total"))
    aligned = fold_alignment(maes, reference, keys)
    ok = (F.col("unmatched_folds") == 0) & (F.col("row_gap") == 0)
    return (
        totals.join(ref, keys, "left")
        .join(aligned, [*keys, "model"], "left")
        .select(*keys, "model", F.when(ok, F.try_divide("total", "ref_total")).alias("mase"))
    )


def summarize(results: DataFrame, reference: str = BASELINE_MODEL, keys=KEYS) -> DataFrame:
    """Headline metrics per model; MASE is null where the reference is absent."""
    keys = list(keys)
    base = results.groupBy(*keys, "model").agg(
        mape().alias("mape"),
        rmse().alias("rmse"),
        mae().alias("mae"),
        F.countDistinct("fold").alias("n_folds"),
        F.count("y_pred").alias("n_points"),
    )
    return base.join(mase(results, reference, keys), [*keys, "model"], "left").select(
        *keys, "model", "mape", "rmse", "mase", "mae", "n_folds", "n_points"
    )


# ------------------------------------------------------------------ paired signed-rank test

@F.pandas_udf(T.DoubleType())
def _signed_rank_p(stat: pd.Series, z: pd.Series, n: pd.Series, exact: pd.Series) -> pd.Series:
    """Two-sided p of the signed-rank statistic: exact null distribution or normal tail."""
    tables: dict[int, np.ndarray] = {}

    def one(w, zi, k, ex):
        if k == 0:
            return 1.0
        if not ex:
            return math.erfc(abs(zi) / math.sqrt(2.0))
        k = int(k)
        if k not in tables:
            ways = np.zeros(k * (k + 1) // 2 + 1)
            ways[0] = 1.0
            for rank in range(1, k + 1):
                ways[rank:] = ways[rank:] + ways[:-rank].copy()
            tables[k] = np.cumsum(ways) / 2.0**k
        return min(1.0, 2.0 * tables[k][int(round(w))])

    return pd.Series([one(*row) for row in zip(stat, z, n, exact)])


def compare_pairs(maes: DataFrame, pairs: DataFrame, keys=KEYS, exact_up_to: int = 50) -> DataFrame:
    """Paired two-sided Wilcoxon signed-rank test on fold MAEs for every (model_a, model_b) row.

    Zero differences are dropped, ties share their average rank; the exact distribution serves up
    to `exact_up_to` folds without ties or zeros, the tie-corrected normal approximation everything else.
    `unmatched_folds` counts folds that one of the two lacks or has no MAE for.
    """
    keys = list(keys)
    a = maes.select(*keys, F.col("model").alias("model_a"), "fold", F.col("fold_mae").alias("a"))
    b = maes.select(*keys, F.col("model").alias("model_b"), "fold", F.col("fold_mae").alias("b"))
    shared = [k for k in keys if k in pairs.columns]
    # Pairs without series keys are a handful of model names: bounded by models squared.
    side = pairs if shared else F.broadcast(pairs)
    left = a.join(side, [*shared, "model_a"])
    right = b.join(side, [*shared, "model_b"])
    both = left.join(right, [*keys, "model_a", "model_b", "fold"], "full_outer").withColumn(
        "d", F.col("a") - F.col("b")
    )
    pair = [*keys, "model_a", "model_b"]
    # Ranks run over folds of one pair: a group holds at most n_folds rows.
    size = F.when(F.col("d") != 0, F.abs("d"))
    ordered = Window.partitionBy(*pair).orderBy(size.asc_nulls_last())
    tied = Window.partitionBy(*pair, size)
    ranked = both.withColumns(
        {
            "ties": F.when(size.isNotNull(), F.count(F.lit(1)).over(tied)),
            "place": F.when(size.isNotNull(), F.rank().over(ordered)),
        }
    ).withColumn("rank", F.col("place") + (F.col("ties") - 1) / 2)
    t = F.col("ties").cast("double")
    totals = ranked.groupBy(*pair).agg(
        F.avg("a").alias("mae_a"),
        F.avg("b").alias("mae_b"),
        F.avg("d").alias("mean_diff"),
        F.count_if(F.col("d") < 0).alias("a_wins_folds"),
        F.count("d").alias("n_folds"),
        F.count_if(F.col("d").isNull()).alias("unmatched_folds"),
        F.count("rank").alias("n"),
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("rank"))), F.lit(0.0)).alias("w_minus"),
        # Each member of a tie of size t adds t^2-1, so a tie adds t^3-t.
        F.coalesce(F.sum(t * t - 1), F.lit(0.0)).alias("tie_term"),
    )
    n = F.col("n").cast("double")
    stat = F.least("w_plus", "w_minus")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("tie_term") / 2) / 24)
    exact = (F.col("n_folds") <= exact_up_to) & (F.col("tie_term") == 0) & (F.col("n") == F.col("n_folds"))
    tested = totals.withColumns(
        {
            "wilcoxon_stat": stat,
            "z": F.when(F.col("n") > 0, F.try_divide(stat - n * (n + 1) / 4, spread)).otherwise(0.0),
            "exact": exact,
        }
    )
    p = _signed_rank_p("wilcoxon_stat", "z", "n", "exact")
    return tested.withColumn("p_value", p).select(
        *pair,
        "mae_a",
        "mae_b",
        "mean_diff",
        "a_wins_folds",
        "n_folds",
        "unmatched_folds",
        "wilcoxon_stat",
        "z",
        "exact",
        "p_value",
        (F.col("p_value") < 0.05).alias("significant_at_05"),
    )


def compare_models(results: DataFrame, model_a: str, model_b: str, keys=KEYS) -> DataFrame:
    """One comparison row per series; raises if the two models' folds differ."""
    maes = fold_maes(results.where(F.col("model").isin(model_a, model_b)), keys)
    pairs = results.sparkSession.range(1).select(
        F.lit(model_a).alias("model_a"), F.lit(model_b).alias("model_b")
    )
    out = compare_pairs(maes, pairs, keys)
    if not out.where("unmatched_folds > 0").isEmpty():
        raise ValueError(f"{model_a} and {model_b} have different folds or lost predictions")
    return out
