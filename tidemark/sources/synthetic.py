"""Market tables derived from the star-schema test tables, and the same in SQL for checks.

daily_bars: lineitem by part brand and ship date, price per unit. intraday_bars: events, 3 symbols, 30 minutes.
statements: orders by nation of the customer and quarter, as filed statements of the brand of the same number.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.kernels import clip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ohlc(rows: DataFrame, keys: list[str], order: list[str], volume) -> DataFrame:
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"), volume.alias("volume")
    )


#: Half the width of a place, for the lines of one place: prices up to 49 million either side of 0, to 11 digits.
_TIES = 4_900_000_000_000_000_000


def _place(at: str, px: str, missing: int) -> Column:
    """One number that orders lines by a whole number and then by price, a missing one counting as `missing`.

    A decimal, unlike a struct, is aggregated by hashing.
    """
    tie = F.coalesce(clip(F.col(px) * 1e11, F.lit(float(-_TIES)), F.lit(float(_TIES))).cast("long"), F.lit(missing))
    return F.col(at).cast("decimal(19,0)") * F.lit(Decimal(10**19)) + tie.cast("decimal(19,0)")


def daily_bars(spark: SparkSession, sf_dir: str, weekly: bool = False) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    day = F.col("l_shipdate").cast("date")
    # joined and added up by hashing: a task holds its parts and its (symbol, date) groups, but no lines
    rows = table(spark, sf_dir, "lineitem").join(part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey")).select(
        "symbol", (F.next_day(F.date_sub(day, 1), "FRI") if weekly else day).alias("date"),
        (F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0))).alias("px"), (F.col("l_orderkey") * 64 + F.col("l_linenumber")).alias("at"), "l_quantity",
    )
    first, last = _place("at", "px", _TIES), _place("at", "px", -_TIES)
    bars = rows.groupBy("symbol", "date").agg(
        F.min_by("px", first).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", last).alias("close"), F.sum("l_quantity").alias("volume"),
    )
    return bars.cache()  # a row a symbol and date, read several times by the grid alone


def minute_bars(spark: SparkSession, sf_dir: str, days: int = 120) -> DataFrame:
    """symbol, date, ts and fields: the lines of `daily_bars` spread by a hash over the session minutes of the last `days` dates."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    lines = table(spark, sf_dir, "lineitem")
    order = Window.orderBy(F.desc("date"))  # one row a date
    dates = lines.select(F.col("l_shipdate").cast("date").alias("date")).distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= days)
    spread = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey")
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "symbol", (F.pmod(spread, F.lit(days)) + 1).cast("int").alias("place"), F.pmod(F.shiftright(spread, 20), F.lit(383)).alias("minute"),
        (F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0))).alias("px"), "l_quantity", "l_orderkey",
    ).join(dates, "place")
    ts = F.col("date").cast("timestamp") + F.make_dt_interval(hours=F.lit(9), mins=F.lit(35) + F.col("minute").cast("int"))
    return rows.groupBy("symbol", "date", ts.alias("ts")).agg(
        F.min_by("px", "l_orderkey").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "l_orderkey").alias("close"), F.sum("l_quantity").alias("volume"),
    )


def intraday_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("S"), F.col("user_id") % 3).alias("symbol"), F.window(ts, "30 minutes").start.alias("ts"), ts.alias("at"), "event_id", F.col("value").alias("px"),
    )
    return _ohlc(rows, ["symbol", "ts"], ["at", "event_id"], F.count("*").cast("double")).withColumn("date", F.to_date("ts"))


STATEMENT_FIELDS = (
    "revenues", "net_income", "operating_income", "income_tax", "pretax_income", "diluted_eps", "operating_cash_flow", "investing_cash_flow",
    "assets", "current_assets", "liabilities", "current_liabilities", "equity", "shares",
)
FLOWS = STATEMENT_FIELDS[:8]


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, timeframe, fiscal_year, fiscal_period, end_date, filing_date (missing for fourth quarters) and 14 fields."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct()
    brands = brands.withColumn("nation", F.row_number().over(Window.orderBy("symbol")) - 1)  # 25 brands
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    rows = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("nation"), F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")).cast("date").alias("q"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("price"), F.round(F.col("c_acctbal") * 100).cast("long").alias("balance"), (F.col("o_orderstatus") == "F").alias("done"),
    )
    cells = rows.groupBy("nation", "q").agg(
        F.sum("price").alias("p"), F.coalesce(F.sum(F.when(F.col("done"), F.col("price"))), F.lit(0)).alias("d"), F.sum("balance").alias("b"), F.count("*").alias("n"),
    )
    p, d, b, n = F.col("p") / 100.0, F.col("d") / 100.0, F.col("b") / 100.0, F.col("n")
    end = F.date_sub(F.add_months("q", 3), 1)
    quarter = F.quarter("q")
    return cells.join(brands, "nation").select(
        "symbol", F.lit("quarterly").alias("timeframe"), F.year("q").alias("fiscal_year"), F.concat(F.lit("Q"), quarter).alias("fiscal_period"), end.alias("end_date"),
        F.when(quarter != 4, F.date_add(end, 45)).alias("filing_date"), p.alias("revenues"), (d * 0.1 + b).alias("net_income"), (d * 0.15).alias("operating_income"),
        (d * 0.02).alias("income_tax"), (d * 0.12).alias("pretax_income"), ((d * 0.1 + b) / n).alias("diluted_eps"), (p * 0.2).alias("operating_cash_flow"),
        (-(d * 0.05)).alias("investing_cash_flow"), (p * 3).alias("assets"), (p * 1.2).alias("current_assets"), (p * 1.5 - b).alias("liabilities"), (p * 0.7).alias("current_liabilities"),
        (p * 1.5 + b).alias("equity"), (n * 10.0).alias("shares"),
    )


DAILY_SQL = """bars AS (
  SELECT symbol, date, first(px ORDER BY l_orderkey, l_linenumber, px) AS open, max(px) AS high, min(px) AS low,
         last(px ORDER BY l_orderkey, l_linenumber, px) AS close, sum(l_quantity) AS volume
  FROM (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / nullif(l_quantity, 0) AS px, l_orderkey, l_linenumber, l_quantity
        FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY symbol, date),
days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM bars)),
grid AS (SELECT d.date, d.t, s.symbol, b.open, b.high, b.low, b.close, b.volume
         FROM days d CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN bars b ON b.date = d.date AND b.symbol = s.symbol)"""

INTRADAY_SQL = """ibars AS (
  SELECT symbol, ts, CAST(ts AS DATE) AS date, first(px ORDER BY tick, event_id) AS open, max(px) AS high, min(px) AS low,
         last(px ORDER BY tick, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM (SELECT 'S' || (user_id % 3) AS symbol, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, ts AS tick, event_id, value AS px FROM events) GROUP BY symbol, ts),
mins AS (SELECT date, ts, row_number() OVER (PARTITION BY date ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY date) AS n_day FROM (SELECT DISTINCT date, ts FROM ibars)),
ig AS (SELECT m.date, m.ts, m.i, m.n_day, s.symbol, b.open, b.high, b.low, b.close, b.volume
       FROM mins m CROSS JOIN (SELECT DISTINCT symbol FROM ibars) s LEFT JOIN ibars b ON b.ts = m.ts AND b.symbol = s.symbol),
iday AS (SELECT date, t, symbol FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM ibars))
         CROSS JOIN (SELECT DISTINCT symbol FROM ibars)),
ibar_day AS (SELECT symbol, date, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume FROM ibars GROUP BY symbol, date)"""

STATEMENTS_SQL = """brands AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS nation FROM (SELECT DISTINCT p_brand AS symbol FROM part)),
cells AS (SELECT c_nationkey AS nation, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS p,
          CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE o_orderstatus = 'F'), 0) AS DOUBLE) / 100 AS d,
          CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / 100 AS b, count(*) AS n
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
statements AS (SELECT symbol, 'quarterly' AS timeframe, year(q) AS fiscal_year, 'Q' || quarter(q) AS fiscal_period, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS end_date,
          CASE WHEN quarter(q) <> 4 THEN CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) + 45 END AS filing_date,
          p AS revenues, d * 0.1 + b AS net_income, d * 0.15 AS operating_income, d * 0.02 AS income_tax, d * 0.12 AS pretax_income, (d * 0.1 + b) / n AS diluted_eps,
          p * 0.2 AS operating_cash_flow, -(d * 0.05) AS investing_cash_flow, p * 3 AS assets, p * 1.2 AS current_assets, p * 1.5 - b AS liabilities, p * 0.7 AS current_liabilities,
          p * 1.5 + b AS equity, n * 10.0 AS shares FROM cells JOIN brands USING (nation))"""
