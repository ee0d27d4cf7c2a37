"""Price-bar research on Spark: indicators, signals, ledgers, metrics and experiments
over every instrument and parameter set in one job."""

from barloom.functions.series import Series
from barloom.session import build_session

__all__ = ["Series", "build_session"]
