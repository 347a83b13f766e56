"""All registered queries: name -> function(spark, sf_dir), and the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoquarry.plans import colocation, corpus, listing, places, published

_PLANS = (places, colocation, listing, corpus, published)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: run for plan in _PLANS for name, run in plan.QUERIES.items()}
ORACLES: dict[str, str] = {name: text for plan in _PLANS for name, text in plan.ORACLES.items()}
