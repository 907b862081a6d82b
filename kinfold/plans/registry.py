"""Every registered query of the engine's own operators, and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinfold.plans import screen_queries, set_queries, survey_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**screen_queries.QUERIES, **set_queries.QUERIES, **survey_queries.QUERIES}
ORACLES: dict[str, str] = {**screen_queries.ORACLES, **set_queries.ORACLES, **survey_queries.ORACLES}
