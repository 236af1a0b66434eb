"""Exploratory statistics and the two analytical queries over the clean table."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourloom.config import DEFAULTS, FLAGS, KEYS, Settings
from hourloom.functions import timeline as tl
from hourloom.functions.quantiles import exact_quantiles
from hourloom.operators.features import with_halo
from hourloom.operators.regression import key_ddl


def day_type_profile(clean: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS) -> DataFrame:
    """Mean load by local hour for weekdays and weekends."""
    local = tl.with_local(clean, cfg)
    weekend = (F.weekday("local_date") >= 5).cast("int")
    return local.groupBy(*keys, weekend.alias("is_weekend"), "local_hour").agg(
        F.avg("load").alias("mean_load")
    )


def weekday_hour_surface(clean: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS) -> DataFrame:
    """Mean load by weekday (rows, Monday = 0) and local hour (columns h0..h23)."""
    local = tl.with_local(clean, cfg).withColumn("dow", F.weekday("local_date"))
    wide = local.groupBy(*keys, "dow").pivot("local_hour", list(range(24))).agg(F.avg("load"))
    return wide.select(*keys, "dow", *[F.col(str(h)).alias(f"h{h}") for h in range(24)])


def daily_mean(clean: DataFrame, keys=KEYS) -> DataFrame:
    """Mean load per UTC day; days without a reading are left out."""
    return (
        clean.groupBy(*keys, F.to_date("ts").alias("day"))
        .agg(F.avg("load").alias("load"))
        .where(F.col("load").isNotNull())
    )


def decompose(daily: DataFrame, period: int = 365, keys=KEYS) -> DataFrame:
    """Classical additive decomposition of the daily means: centred moving-average trend,
    mean of the detrended values by phase (adjusted to mean zero), remainder.

    Works on one row per series and day, a 24th of the hours.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("day")
    half = period // 2
    frame = order.rowsBetween(-half, half)
    trended = daily.withColumns(
        {
            "phase": (F.row_number().over(order) - 1) % period,
            "trend": F.when(F.count("load").over(frame) == 2 * half + 1, F.avg("load").over(frame)),
        }
    )
    phase = Window.partitionBy(*keys, "phase")
    raw = trended.withColumn("__s", F.avg(F.col("load") - F.col("trend")).over(phase))
    # Mean over phases = mean over one row per phase.
    per_phase = raw.groupBy(*keys, "phase").agg(F.first("__s").alias("__s"))
    level = per_phase.groupBy(*keys).agg(F.avg("__s").alias("__level"))
    out = raw.join(level, keys)
    seasonal = F.col("__s") - F.col("__level")
    return out.select(
        *keys,
        "day",
        F.col("load").alias("observed"),
        "trend",
        seasonal.alias("seasonal"),
        (F.col("load") - F.col("trend") - seasonal).alias("residual"),
    )


def hexagon_density(clean: DataFrame, gridsize: int = 55, keys=KEYS) -> DataFrame:
    """Counts of hours per hexagonal (temperature, load) cell: the nearer centre of two
    interleaved lattices. Cells come with lattice and indices."""
    keys = list(keys)
    ny = int(gridsize / math.sqrt(3))
    box = clean.groupBy(*keys).agg(
        F.min("temp_c").alias("x0"), F.max("temp_c").alias("x1"),
        F.min("load").alias("y0"), F.max("load").alias("y1"),
    )
    pad = F.lit(1e-9)
    x0, x1 = F.col("x0"), F.col("x1")

    def scaled(offset, step):
        return F.coalesce(F.try_divide(offset, step), F.lit(0.0))  # a constant column has no step

    boxed = tl.join_series(clean, box, keys).withColumns(
        {
            "x": scaled(
                F.col("temp_c") - (x0 - pad * (x1 - x0)),
                (x1 - x0) * (F.lit(1.0) + pad * 2) / gridsize,
            ),
            "y": scaled(F.col("load") - F.col("y0"), (F.col("y1") - F.col("y0")) / ny),
        }
    )
    x, y = F.col("x"), F.col("y")
    near = (x - F.rint(x)) ** 2 + (y - F.rint(y)) ** 2 * 3
    mid = (x - F.floor(x) - 0.5) ** 2 + (y - F.floor(y) - 0.5) ** 2 * 3
    return (
        boxed.select(
            *keys,
            F.when(near < mid, 1).otherwise(2).alias("lattice"),
            F.when(near < mid, F.rint(x)).otherwise(F.floor(x)).cast("int").alias("ix"),
            F.when(near < mid, F.rint(y)).otherwise(F.floor(y)).cast("int").alias("iy"),
        )
        .groupBy(*keys, "lattice", "ix", "iy")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def temperature_bins(clean: DataFrame, keys=KEYS, **options) -> DataFrame:
    """Median load per 2-degree bin over (-20, 40], closed on the right; empty bins are absent."""
    keys = list(keys)
    cell = F.ceil((F.col("temp_c") + 20) / 2).cast("int")
    inside = clean.where((F.col("temp_c") > -20) & (F.col("temp_c") <= 40)).select(
        *keys, (cell * 2 - 21).cast("double").alias("mid_c"), "load")
    medians = exact_quantiles(inside, [*keys, "mid_c"], "load", [0.5], **options).withColumnRenamed("q0", "median_load")
    return inside.groupBy(*keys, "mid_c").agg(F.count(F.lit(1)).alias("n")).join(medians, [*keys, "mid_c"], "left")


# ------------------------------------------------------------------------ autocorrelation

def lag_products(series: DataFrame, lags: int, keys=KEYS, cfg: Settings = DEFAULTS) -> DataFrame:
    """Sum over hours of centred x(t) x(t-k), k = 0..lags, from a gapless (keys, ts, load) table.

    Products are formed inside (keys, block) groups holding a halo of the block before, and added
    up after: no hour is paired with `lags` others through a shuffle.
    """
    keys = list(keys)
    mean = series.groupBy(*keys).agg(
        F.avg("load").alias("__mean"), F.count(F.lit(1)).alias("n_obs")
    )
    halo = with_halo(series.select(*keys, "ts", "load"), -(-lags // 24) + 1, cfg)
    rows = tl.join_series(halo, mean, keys, cfg).select(
        *keys, "__block", "ts", "__own", (F.col("load") - F.col("__mean")).alias("x"), "n_obs"
    )
    key_type = key_ddl(series, keys)

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        x, own = pdf["x"].to_numpy(), pdf["__own"].to_numpy()
        out = pd.DataFrame({"lag": np.arange(lags + 1, dtype="int32")})
        out["s"] = [
            float(np.dot((x * own)[k:], x[: len(x) - k])) if k < len(x) else 0.0
            for k in range(lags + 1)
        ]
        for c in keys:
            out[c] = pdf[c].iloc[0]
        out["n_obs"] = pdf["n_obs"].iloc[0]
        return out[[*keys, "n_obs", "lag", "s"]]

    return (
        rows.groupBy(*keys, "__block")
        .applyInPandas(products, f"{key_type}, n_obs bigint, lag int, s double")
        .groupBy(*keys, "n_obs", "lag")
        .agg(F.sum("s").alias("s"))
    )


def acf(clean: DataFrame, lags: int = 200, keys=KEYS, cfg: Settings = DEFAULTS) -> DataFrame:
    """Autocorrelation with the biased (divide by n) autocovariance."""
    keys = list(keys)
    sums = lag_products(clean, lags, keys, cfg)
    zero = sums.where("lag = 0").select(*keys, F.col("s").alias("s0"))
    return sums.join(zero, keys).select(*keys, "lag", F.try_divide("s", "s0").alias("acf"))


def pacf(
    clean: DataFrame, lags: int = 100, last_hours: int | None = None, keys=KEYS, cfg: Settings = DEFAULTS
) -> DataFrame:
    """Partial autocorrelation of the last hours (None: all) by the Durbin-Levinson recursion on
    autocovariances divided by n - k."""
    keys = list(keys)
    recent = clean
    if last_hours is not None:
        end = clean.groupBy(*keys).agg(F.max("ts").alias("__end"))
        recent = tl.join_series(clean, end, keys, cfg).where(F.col("ts") > F.col("__end") - tl.hours(last_hours))
    sums = lag_products(recent, lags, keys, cfg)
    cov = sums.withColumn("c", F.try_divide(F.col("s"), F.col("n_obs") - F.col("lag")))
    key_type = key_ddl(clean, keys)

    def recursion(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        c = pdf["c"].to_numpy(dtype=float)
        out, phi, v = [1.0], np.zeros(0), c[0]
        for k in range(1, len(c)):
            a = (c[k] - np.dot(phi, c[k - 1 : 0 : -1])) / v
            phi = np.append(phi - a * phi[::-1], a)
            v *= 1.0 - a * a
            out.append(a)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "lag": pdf["lag"].to_numpy(), "pacf": out})

    # lags + 1 rows per series, whatever its length
    return cov.select(*keys, "lag", "c").groupBy(*keys).applyInPandas(
        recursion, f"{key_type}, lag int, pacf double"
    )


# ------------------------------------------------------------------------ summaries

def describe(clean: DataFrame, keys=KEYS, **options) -> DataFrame:
    """Count, mean, standard deviation, exact quartiles and range of load and temperature."""
    keys = list(keys)
    long = clean.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.lit("load").alias("variable"), F.col("load").alias("v")),
                F.struct(F.lit("temp_c").alias("variable"), F.col("temp_c").alias("v")),
            )
        ),
    )
    group = [*keys, "variable"]
    moments = long.groupBy(*group).agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    quartiles = exact_quantiles(long, group, "v", [0.25, 0.5, 0.75], **options)
    return moments.join(quartiles, group, "left").select(
        *group, "count", "mean", "std", "min", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"), "max")


def flag_shares(clean: DataFrame, keys=KEYS) -> DataFrame:
    """Share of rows carrying each cleaning flag, in percent."""
    return clean.groupBy(*keys).agg(*[F.round(F.avg(c) * 100, 3).alias(c) for c in FLAGS])


def series_span(clean: DataFrame, keys=KEYS) -> DataFrame:
    """Whole days between first and last hour, in years."""
    days = F.floor(tl.hours_between(F.min("ts"), F.max("ts")) / 24)
    return clean.groupBy(*keys).agg((days / 365.25).alias("years"))


# ------------------------------------------------------------------------ analytical queries

def monthly_peak(clean: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS) -> DataFrame:
    """Highest unquarantined hour of each local month; ties go to the earliest instant.

    An argmax aggregate combines map-side, so no month is sorted.
    """
    local = tl.to_local(F.col("ts"), cfg.local_tz)
    month = F.trunc(F.to_date(local), "MONTH")
    rank = F.struct(F.col("load"), (F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") - F.col("ts")))
    top = (
        clean.where("bad_day = 0")
        .groupBy(*keys, month.alias("local_month"))
        .agg(F.max_by(F.struct("load", "ts"), rank).alias("top"))
    )
    at = tl.to_local(F.col("top.ts"), cfg.local_tz)
    return top.select(
        *keys,
        "local_month",
        F.round("top.load", 0).alias("peak_mw"),
        at.alias("peak_at_local"),
        F.hour(at).alias("peak_hour"),
    )


def yearly_change(clean: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS) -> DataFrame:
    """Monthly mean against the same month of the previous year that has data."""
    local = tl.to_local(F.col("ts"), cfg.local_tz)
    monthly = (
        clean.where("bad_day = 0")
        .groupBy(*keys, F.year(local).alias("yr"), F.month(local).alias("mo"))
        .agg(F.avg("load").alias("m"))
    )
    prev = F.lag("m").over(Window.partitionBy(*keys, "mo").orderBy("yr"))
    return monthly.withColumn("prev", prev).select(
        *keys,
        "yr",
        "mo",
        F.round("m", 0).alias("avg_mw"),
        F.round("prev", 0).alias("avg_mw_prev_year"),
        F.round(F.try_divide(F.col("m") - F.col("prev"), F.col("prev")) * 100, 2).alias("yoy_pct"),
    )
