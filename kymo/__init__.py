"""kymo: wearable and per-subject time-series analytics as Spark DataFrame operators."""

from kymo.core import SUBJECT, Keys
from kymo.session import build_session

__all__ = ["SUBJECT", "Keys", "build_session"]
