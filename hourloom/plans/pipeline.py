"""Stages of the pipeline. Each hands over a written table, so a lost executor or a
repeated read never recomputes the stages before it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hourloom.config import DEFAULTS, KEYS, Settings
from hourloom.operators import cleaning
from hourloom.operators.features import build_features
from hourloom.session import materialize


def clean(
    raw: DataFrame, weather: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS, check: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Clean table and its reconciliation log, from raw readings and one weather row per stamp."""
    hourly = materialize(cleaning.hourly_readings(raw, keys, cfg), "hourly")
    annotated = materialize(cleaning.clean_annotated(hourly, weather, keys, cfg), "annotated")
    table = cleaning.clean_columns(annotated, keys)
    if check:
        cleaning.validate(table, keys, cfg)
    return table, cleaning.reconciliation(hourly, annotated, keys, cfg)


def features(clean_table: DataFrame, keys=KEYS, cfg: Settings = DEFAULTS) -> DataFrame:
    return materialize(build_features(clean_table, keys, cfg), "features")
