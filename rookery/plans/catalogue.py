"""All queries of the core package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rookery.plans.core_queries import QUERIES as _PROBLEMS
from rookery.plans.graph_queries import QUERIES as _GRAPH
from rookery.plans.graph_queries import gr_top_nodes
from rookery.plans.model_queries import QUERIES as _MODELS
from rookery.plans.text_queries import QUERIES as _TEXT

QUERIES = {**_PROBLEMS, **_TEXT, **_GRAPH, **_MODELS}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return gr_top_nodes(spark, d)
