"""Registered queries against their SQL on the smallest tables."""

import inspect
import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import trees
from tidemark.plans import registry, table_queries
from tidemark.sources import synthetic

NAMES = [
    "panel_densify", "zscore_mad", "qcut_buckets", "resample_wfri", "asof_backward", "rank_ic", "quantile_backtest", "turnover", "hht_signal", "advisor", "equity_metrics", "fifo_pnl",
    "otr_report", "cashflows", "bond_price", "z_spread", "black_scholes", "condor_legs", "trade_log_summary", "bar_quality", "tick_bars", "user_sessions",
    "factor_rsi_16w", "factor_team_coin", "factor_roe", "factor_eps_score", "factor_vol_battle_ret", "factor_weekly_jump",
]


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v))
    try:
        return str(pd.Timestamp(v))
    except (ValueError, TypeError):
        return str(v)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(con.sql(registry.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 100


def test_walk_forward_queries_predict_every_date(spark, monkeypatch):
    assert inspect.signature(trees.forest).parameters["trees"].default == 100
    rows = [(i, f"s{j}", float(j % 5), float((i + j) % 7), float(i * j % 3), float(j % 4)) for i in range(13) for j in range(25)]
    panel = spark.createDataFrame(rows, "date int, symbol string, mom double, range double, rev double, fwd double").selectExpr("date_add(date'2024-01-01', 7 * date) date", "symbol", "mom", "range", "rev", "fwd").coalesce(1)
    monkeypatch.setattr(table_queries, "_panel", lambda spark, sf_dir: panel)
    dates = sorted(r.date for r in panel.select("date").distinct().collect())
    for name, purge in (("walk_forward_ridge", 0), ("walk_forward_forest", 1)):
        got = registry.QUERIES[name](spark, "").groupBy("date").count().collect()
        assert {r.date: r["count"] for r in got} == dict.fromkeys(dates[8 + purge :], 25)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_daily_bars_hold_no_lines_and_order_ties(spark, tmp_path):
    big = 2**56
    lines = [(big, 1, 1, 10.0, 2.0), (big, 1, 1, 30.0, 2.0), (big, 1, 1, None, 2.0), (big, 2, 1, 70.0, 2.0), (big + 1, 1, 1, 20.0, 2.0), (big + 1, 1, 1, 90.0, 2.0), (5, 1, 2, 8.0, 0.0), (6, 1, 2, 8.0, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double").withColumn("l_shipdate", F.lit("1995-01-02").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a"), (2, "b")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    bars = synthetic.daily_bars(spark, str(tmp_path))
    plan = bars._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("HashAggregate(") == 2 and "SortAggregate" not in plan and "SortMergeJoin" not in plan  # (symbol, date) before and after the exchange
    got = {r.symbol: tuple(r)[2:] for r in bars.collect()}
    assert got == {"a": (5.0, 45.0, 5.0, 45.0, 12.0), "b": (None, 8.0, 8.0, 8.0, 1.0)}


def test_grid_reads_lines_through_kept_bars_only(spark, sf):
    plan = table_queries.grid_of(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") >= 3 and "Relation [l_" not in plan  # dates, symbols and cells
