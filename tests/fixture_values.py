"""Values that the fixtures are made with and the tests look for."""

from __future__ import annotations

import pandas as pd

from hourloom import Settings

TZ = "America/New_York"
CFG = Settings(n_folds=12)
SHORT_GAP = pd.date_range("2016-05-10 03:00", periods=3, freq="h", tz=TZ)
LONG_GAP = pd.date_range("2016-09-14 00:00", periods=30, freq="h", tz=TZ)
SPIKE = pd.Timestamp("2017-03-15 14:00", tz=TZ)
