"""Hourly time-series cleaning, features, backtests and reports as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from hourloom.config import DEFAULTS, FEATURES, KEYS, Settings
from hourloom.session import build_session, materialize

# Ship the few Python helpers with the tasks, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DEFAULTS", "FEATURES", "KEYS", "Settings", "build_session", "materialize"]
