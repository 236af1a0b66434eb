"""The audited cleaning rules: duplicates and zone, grid, gaps, outliers, weather, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.config import DEFAULTS, KEYS, Settings
from hourloom.functions import filling
from hourloom.functions import timeline as tl


def average_duplicate_stamps(raw: DataFrame, keys=KEYS) -> DataFrame:
    """One row per wall clock: mean reading and number of raw rows (combined map-side)."""
    return raw.groupBy(*keys, "wall").agg(
        F.avg("load").alias("load"), F.count(F.lit(1)).alias("n_rows")
    )


def localize_to_utc(by_wall: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Add `ts`, the UTC instant; null where the wall clock does not exist."""
    return by_wall.withColumn("ts", tl.existing_utc(F.col("wall"), cfg.local_tz))


def merge_utc(df: DataFrame, keys=KEYS) -> DataFrame:
    """Mean per UTC instant. Distinct existing wall clocks never collide, so this guards
    inputs that did not pass through the two steps above."""
    return df.where(F.col("ts").isNotNull()).groupBy(*keys, "ts").agg(F.avg("load").alias("load"))


def hourly_readings(raw: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS) -> DataFrame:
    """Raw readings to at most one row per series and wall clock, with its instant."""
    return localize_to_utc(average_duplicate_stamps(raw, keys), cfg)


def build_regular_grid(hourly: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS) -> DataFrame:
    """Every hour between the first and last instant of a series; hours without a row are null."""
    keys = list(keys)
    seen = hourly.where(F.col("ts").isNotNull()).select(*keys, "ts", "load")
    spans = seen.groupBy(*keys).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    # Days first, then their hours: no generated array grows past the days of a span.
    last = F.floor(tl.hours_between(F.col("lo"), F.col("hi")) / 24).cast("int")
    days = spans.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), last)).alias("d"))
    slots = (
        days.select(
            *keys,
            "hi",
            F.explode(F.sequence(F.col("d") * 24, F.col("d") * 24 + 23)).alias("h"),
            "lo",
        )
        .select(*keys, tl.add_hours(F.col("lo"), F.col("h")).alias("ts"), "hi")
        .where("ts <= hi")
        .drop("hi")
    )
    return slots.join(seen, [*keys, "ts"], "left")


def _block(cfg: Settings):
    return tl.block_of(F.to_date(tl.to_local(F.col("ts"), cfg.local_tz)), cfg)


def gap_runs(grid: DataFrame, keys=KEYS, value: str = "load", cfg: Settings = DEFAULTS) -> DataFrame:
    """Maximal runs of missing hours: first hour and length."""
    looked = filling.nearest_known(grid.select(*keys, "ts", value), keys, [value], _block(cfg))
    start, length = filling.run_bounds(value)
    return (
        looked.where(F.col(value).isNull())
        .select(*keys, "ts", start.alias("gap_start"), length.alias("gap_hours"))
        .where("ts = gap_start")
        .drop("ts")
    )


def interpolate_time(
    grid: DataFrame, values, keys=KEYS, cfg: Settings = DEFAULTS
) -> DataFrame:
    """Fill the value columns linearly in time, all of them in one pass."""
    looked = filling.nearest_known(grid, keys, list(values), _block(cfg))
    return filling.drop_lookups(looked.withColumns({v: filling.filled(v) for v in values}))


def attach_weather_raw(grid: DataFrame, weather: DataFrame, keys=KEYS) -> DataFrame:
    """Left-join temperature on the UTC hour; `weather` may or may not carry the series keys."""
    shared = [k for k in keys if k in weather.columns]
    temps = weather.withColumnRenamed("datetime_utc", "ts").select(*shared, "ts", "temp_c")
    return grid.join(temps, [*shared, "ts"], "left")


def first_weather(weather: DataFrame, tiebreak: str, keys=KEYS) -> DataFrame:
    """First row per stamp in the order of an explicit tiebreak column."""
    shared = [k for k in keys if k in weather.columns]
    return weather.groupBy(*shared, "datetime_utc").agg(F.min_by("temp_c", tiebreak).alias("temp_c"))


def fill_and_quarantine(joined: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS) -> DataFrame:
    """Fill load and temperature, flag what was filled, quarantine local days of long gaps.

    Adds `gap_hours` (length of the gap an imputed hour belongs to, else 0), which the audit reads.
    """
    keys = list(keys)
    values = [c for c in ("load", "temp_c") if c in joined.columns]
    looked = filling.nearest_known(joined, keys, values, _block(cfg))
    _, run = filling.run_bounds("load")
    missing = F.col("load").isNull()
    new = {
        "imputed": missing.cast("bigint"),
        "gap_hours": F.when(missing, run).otherwise(0),
        "load": filling.filled("load"),
    }
    if "temp_c" in values:
        new["temp_imputed"] = F.col("temp_c").isNull().cast("bigint")
        new["temp_c"] = filling.filled("temp_c")
    out = tl.with_local(looked.withColumns(new), cfg)
    # A local day lies inside one block, so this window reuses the block partitioning.
    day = Window.partitionBy(*keys, "__block", "local_date")
    long_gap = F.col("gap_hours") > cfg.max_interpolate_gap_h
    out = out.withColumn("bad_day", F.max(long_gap.cast("bigint")).over(day))
    return filling.drop_lookups(out)


def quarantine_long_gaps(grid: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS) -> DataFrame:
    """Gap handling alone, for a grid without weather."""
    return fill_and_quarantine(grid, keys, cfg)


def month_hour_mad(df: DataFrame, keys=KEYS) -> DataFrame:
    """Exact median and unscaled MAD of load per (local month, local hour)."""
    cell = [*keys, "local_month", "local_hour"]
    return _with_band(df, keys).groupBy(*cell).agg(
        F.first("median").alias("median"),
        F.first("mad").alias("mad"),
        F.count(F.lit(1)).alias("n"),
    )


def _with_band(df: DataFrame, keys=KEYS) -> DataFrame:
    # Both medians are windows over the same cells: one shuffle, and no join back.
    cell = Window.partitionBy(*keys, "local_month", "local_hour")
    return df.withColumn("median", F.median("load").over(cell)).withColumn(
        "mad", F.median(F.abs(F.col("load") - F.col("median"))).over(cell)
    )


def winsorize(df: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS) -> DataFrame:
    """Clip load to median +/- k MAD of its cell; flag values outside it or not positive."""
    reach = F.lit(cfg.mad_threshold) * F.col("mad")
    lower, upper = F.col("median") - reach, F.col("median") + reach
    load = F.col("load")
    return (
        _with_band(df, keys)
        .withColumns(
            {
                "clipped": ((load < lower) | (load > upper) | (load <= 0)).cast("bigint"),
                "load": F.greatest(F.least(load, upper), lower),
            }
        )
        .drop("median", "mad")
    )


def clean_columns(df: DataFrame, keys=KEYS) -> DataFrame:
    """The clean table's contract columns, typed."""
    return df.select(
        *keys,
        "ts",
        F.col("load").cast("double"),
        F.col("temp_c").cast("double"),
        *[F.col(c).cast("bigint") for c in ("imputed", "clipped", "bad_day", "temp_imputed")],
    )


def clean_annotated(
    hourly: DataFrame, weather: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS
) -> DataFrame:
    """All rules over hourly readings; keeps the local clock and gap columns for the audit."""
    return (
        build_regular_grid(hourly, keys, cfg)
        .transform(attach_weather_raw, weather, keys)
        .transform(fill_and_quarantine, keys, cfg)
        .transform(winsorize, keys, cfg)
    )


# ---------------------------------------------------------------- validation and audit

CONTRACT = {
    "ts": T.TimestampNTZType(),
    "load": T.DoubleType(),
    "temp_c": T.DoubleType(),
    "imputed": T.LongType(),
    "clipped": T.LongType(),
    "bad_day": T.LongType(),
    "temp_imputed": T.LongType(),
}


def validation_report(df: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS) -> DataFrame:
    """Violation counts of the clean-table contract, one row per series."""
    n = F.count(F.lit(1))
    span = tl.hours_between(F.min("ts"), F.max("ts")) + 1
    bad_flag = F.lit(False)
    for c in ("imputed", "clipped", "bad_day", "temp_imputed"):
        bad_flag = bad_flag | F.coalesce(~F.col(c).isin(0, 1), F.lit(True))
    return (
        df.groupBy(*keys).agg(
            n.alias("n_rows"),
            F.count_if(F.col("load").isNull() | F.isnan("load")).alias("load_null"),
            F.count_if(~F.col("load").between(cfg.load_min, cfg.load_max)).alias("load_range"),
            F.count_if(F.col("temp_c").isNull() | F.isnan("temp_c")).alias("temp_null"),
            F.count_if(~F.col("temp_c").between(cfg.temp_min, cfg.temp_max)).alias("temp_range"),
            F.count_if(bad_flag).alias("flag_domain"),
            (n - F.countDistinct("ts")).alias("duplicate_ts"),
            (span - F.countDistinct("ts")).alias("grid_holes"),
        )
    )


def validate(df: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS) -> DataFrame:
    """Return `df` unchanged or raise ValueError naming the broken parts of the contract."""
    actual = {f.name: f.dataType for f in df.schema if f.name not in keys}
    if actual != CONTRACT:
        raise ValueError(f"columns differ from the contract: {sorted(actual)}")
    checks = [c for c in validation_report(df, keys, cfg).columns if c not in (*keys, "n_rows")]
    worst = validation_report(df, keys, cfg).agg(*[F.sum(c).alias(c) for c in checks]).first()
    broken = {c: worst[c] for c in checks if worst[c]}
    if "grid_holes" in broken or "duplicate_ts" in broken:
        raise ValueError(f"not a continuous hourly grid: {broken}")
    if broken:
        raise ValueError(f"values break the contract: {broken}")
    return df


# Rule names of the reconciliation log, in order; h is the longest gap that is interpolated.
RULES = (
    "0. Raw rows read",
    "1. DST fall-back / duplicate stamps",
    "1. DST spring-forward stamps",
    "2. Reindex to full hourly grid",
    "3. Short gaps (<={h}h) interpolated",
    "3. Long gaps (>{h}h) -> bad_day",
    "4. Outliers winsorized",
    "5. Weather joined",
    "5. Validation",
)


def reconciliation(
    hourly: DataFrame, annotated: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS
) -> DataFrame:
    """Ordered log of the rows each rule touched, per series. Holds the invariant
    raw - merged - dropped + created = final."""
    keys = list(keys)
    long_gap = F.col("gap_hours") > cfg.max_interpolate_gap_h
    short_gap = F.col("gap_hours").between(1, cfg.max_interpolate_gap_h)
    before = hourly.groupBy(*keys).agg(
        F.sum("n_rows").alias("raw"),
        F.count(F.lit(1)).alias("walls"),
        F.count_if(F.col("ts").isNull()).alias("skipped"),
    )
    after = annotated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("final"),
        F.sum("imputed").alias("created"),
        F.count_if(short_gap).alias("short_hours"),
        F.count_if(long_gap).alias("long_hours"),
        F.max(F.when(short_gap, F.col("gap_hours"))).alias("short_max"),
        F.sum("bad_day").alias("bad_rows"),
        F.countDistinct(F.when(F.col("bad_day") == 1, F.col("local_date"))).alias("bad_dates"),
        F.sum("clipped").alias("clipped"),
        (F.count(F.lit(1)) - F.sum("temp_imputed")).alias("matched"),
    )

    def n(c):
        return F.format_number(F.col(c), 0)

    notes = (
        F.lit("raw load"),
        F.concat(F.lit("averaged; "), n("raw"), F.lit(" -> "), n("walls"), F.lit(" rows")),
        F.lit("non-existent local time, dropped"),
        F.concat(n("final"), F.lit(" slots, missing hours created as null")),
        F.concat(F.lit("max "), F.coalesce("short_max", F.lit(0)).cast("string"), F.lit("h")),
        F.concat(
            F.col("long_hours").cast("string"),
            F.lit("h missing, "),
            F.col("bad_dates").cast("string"),
            F.lit(" local days quarantined"),
        ),
        F.lit("outside the band or not positive"),
        F.concat((F.col("final") - F.col("matched")).cast("string"), F.lit(" hours interpolated")),
        F.lit("passed"),
    )
    counts = (
        F.col("raw"),
        F.col("raw") - F.col("walls"),
        F.col("skipped"),
        F.col("created"),
        F.col("short_hours"),
        F.col("bad_rows"),
        F.col("clipped"),
        F.col("matched"),
        F.col("final"),
    )
    entries = [
        F.struct(
            F.lit(i).alias("step"),
            F.lit(rule).alias("rule"),
            c.cast("bigint").alias("rows_affected"),
            note.alias("note"),
        )
        for i, (rule, c, note) in enumerate(zip((r.format(h=cfg.max_interpolate_gap_h) for r in RULES), counts, notes))
    ]
    return before.join(after, keys).select(*keys, F.inline(F.array(*entries)))


def clean_profile(df: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS) -> DataFrame:
    """Size, spans, value ranges and flag totals of a clean table, per series."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("bad_day") == 0).alias("usable_rows"),
        F.min("ts").alias("first_utc"),
        F.max("ts").alias("last_utc"),
        tl.to_local(F.min("ts"), cfg.local_tz).alias("first_local"),
        tl.to_local(F.max("ts"), cfg.local_tz).alias("last_local"),
        *[
            fn(c).alias(f"{c}_{fn.__name__}")
            for c in ("load", "temp_c")
            for fn in (F.mean, F.min, F.max)
        ],
        *[F.sum(c).alias(c) for c in ("imputed", "clipped", "bad_day")],
    )
