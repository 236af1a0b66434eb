"""Fixed values of the hourly pipeline, in one place."""

from __future__ import annotations

from dataclasses import dataclass

# Column groups of the feature table, in output order.
LAG_HOURS = {"lag_24": 24, "lag_48": 48, "lag_168": 168}
ROLLING = {
    "roll24_mean": (24, "mean"),
    "roll24_std": (24, "std"),
    "roll168_mean": (168, "mean"),
    "roll168_max": (168, "max"),
}
CALENDAR = (
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos",
    "is_weekend", "is_holiday",
)
WEATHER = ("temp", "temp_lag24", "hdd", "cdd")
FEATURES = (*LAG_HOURS, *ROLLING, *CALENDAR, *WEATHER)
BOOKKEEPING = (
    "y", "cutoff_ts", "lead", "op_date", "bad_day", "local_hour", "local_month", "local_date",
)
FORECAST_WEATHER = ("temp", "hdd", "cdd")  # read the target hour on purpose
FLAGS = ("imputed", "clipped", "bad_day", "temp_imputed")

# Model names from weakest to strongest, and the two reference models.
MODEL_ORDER = ("naive", "snaive", "sarima", "prophet", "lstm", "lgbm")
BASELINE_MODEL = "snaive"
SHIPPED_MODEL = "lgbm"


@dataclass(frozen=True)
class Settings:
    """Every threshold an operator reads; pass a changed copy to override one."""

    local_tz: str = "America/New_York"
    max_interpolate_gap_h: int = 6
    mad_threshold: float = 5.0
    load_min: float = 10_000.0
    load_max: float = 65_000.0
    temp_min: float = -40.0
    temp_max: float = 50.0
    hdd_base_c: float = 18.0
    cdd_base_c: float = 24.0
    op_day_offset_h: int = 5
    horizon: int = 24
    n_folds: int = 52
    fold_step_days: int = 7
    dense_folds: int = 182
    dense_step_days: int = 2
    plausible_low: float = 0.25
    plausible_high: float = 4.0
    seed: int = 42
    val_days: int = 90
    sarima_years: float = 2.0
    prophet_years: float = 3.0
    lstm_years: float = 6.0
    # Longest stretch of one series that a single window group may hold.
    block: str = "QUARTER"


DEFAULTS = Settings()
KEYS = ("series",)
