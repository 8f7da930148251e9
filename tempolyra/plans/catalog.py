"""Registered queries of the library over the driver's tables, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

from . import service_queries, song_queries, text_queries  # noqa: E402,F401  fills the tables above
from . import layer_queries, more_queries  # noqa: E402,F401
