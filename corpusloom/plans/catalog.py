"""All queries of the library and the SQL that they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import filter_queries, model_queries, relational_queries, text_queries
from .registry import Query

MODULES = (text_queries, filter_queries, relational_queries, model_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pairs of concepts that are not linked yet, with labels, degrees and distance."""
    return queries()["mod8_prospective_pairs"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.q.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.q.sql.items()}
