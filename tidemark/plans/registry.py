"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import kernels as k
from tidemark.operators import research
from tidemark.plans import factor_queries, rates_queries, table_queries
from tidemark.sources import synthetic
from tidemark.sources.bars import densify


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, long-short return of the quintiles of 26-week momentum over the next week, on weekly bars."""
    grid = densify(synthetic.daily_bars(spark, sf_dir, weekly=True))
    w = k.series()
    grid = grid.withColumn("close", k.ffill("close", w))
    rows = grid.select("date", "symbol", (k.div(k.shift("close", 4, w), k.shift("close", 26, w)) - 1).alias("value"), (k.div(k.shift("close", -1, w), "close") - 1).alias("fwd"))
    return research.long_short(research.quantile_returns(k.zscore(rows, ["value"]))).select("date", F.round("ls", 6).alias("ls"))


QUERIES = table_queries.QUERIES | rates_queries.QUERIES | factor_queries.QUERIES
ORACLE_SQL = table_queries.ORACLE_SQL | rates_queries.ORACLE_SQL | factor_queries.ORACLE_SQL
