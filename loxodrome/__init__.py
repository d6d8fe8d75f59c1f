"""loxodrome: a Spark-native engine for tabular, statistical and geospatial transformations."""

from loxodrome.session import build_session

__all__ = ["build_session"]
