"""Queries of sources, kernels, research, signals and portfolios, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import kernels as k
from tidemark.operators import backtest, ml, quality, research, signals
from tidemark.plans import weekly
from tidemark.plans.sql import DAILY_SQL, INTRADAY_SQL, S, WEEK, div, lag, rank_average, roll, z
from tidemark.sources import bars as bar_sources, synthetic, tables
from tidemark.streaming import flows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r(x, digits: int = 6):
    """Rounded, without a negative zero."""
    return F.round(x, digits) + 0.0


def rd(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def grid_of(spark, sf_dir) -> DataFrame:
    return bar_sources.densify(synthetic.daily_bars(spark, sf_dir))


def factor_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(grid with prices carried forward, long rows of three factors): six-month momentum, range position and daily reversal."""
    w = k.series()
    grid = grid_of(spark, sf_dir).select("date", "t", "symbol", *(k.ffill(c, w).alias(c) for c in ("close", "high", "low")))
    low, high = k.rolling(F.min, "low", 252, 126, w), k.rolling(F.max, "high", 252, 126, w)
    wide = grid.select("date", "symbol", (k.div(k.shift("close", 21, w), k.shift("close", 126, w)) - 1).alias("mom"), k.div(F.col("close") - low, high - low).alias("range"), (k.div("close", k.shift("close", 1, w)) - 1).alias("rev"))
    return grid, wide.unpivot(["date", "symbol"], ["mom", "range", "rev"], "factor", "value").where("value is not null")


_ff = ", ".join(f"last_value({c} IGNORE NULLS) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in ("close", "high", "low"))
W = f"""WITH {DAILY_SQL}, fgrid AS (SELECT date, t, symbol, {_ff} FROM grid), wide AS (SELECT date, symbol, t, close, {div(lag('close', 21), lag('close', 126))} - 1 AS mom,
 {div(f"close - {roll('min', 'low', 252, 126)}", f"{roll('max', 'high', 252, 126)} - {roll('min', 'low', 252, 126)}")} AS range, {div('close', lag('close', 1))} - 1 AS rev FROM fgrid),
factors AS (SELECT date, symbol, 'mom' AS factor, mom AS value FROM wide WHERE mom IS NOT NULL UNION ALL SELECT date, symbol, 'range', range FROM wide WHERE range IS NOT NULL UNION ALL SELECT date, symbol, 'rev', rev FROM wide WHERE rev IS NOT NULL),
f21 AS (SELECT date, symbol, {div(lag('close', -21), 'close')} - 1 AS fwd FROM fgrid), f5 AS (SELECT date, symbol, {div(lag('close', -6), lag('close', -1))} - 1 AS fwd FROM fgrid),
weeks AS (SELECT max(date) AS date FROM (SELECT DISTINCT date FROM grid) GROUP BY {WEEK})"""
REB = f"{W}, reb AS (SELECT f.date, f.symbol, f.factor, f.value, g.fwd FROM factors f JOIN weeks USING (date) JOIN f5 g USING (date, symbol)), mrow AS (SELECT * FROM reb WHERE factor = 'mom' AND value IS NOT NULL AND fwd IS NOT NULL)"
IC = f"""{REB}, ranked AS (SELECT factor, date, {rank_average('value', 'factor, date')} AS a, {rank_average('fwd', 'factor, date')} AS b FROM reb WHERE value IS NOT NULL AND fwd IS NOT NULL),
ics AS (SELECT factor, date, count(*) AS n, corr(a, b) AS ic FROM ranked GROUP BY factor, date HAVING count(*) >= 10 AND corr(a, b) IS NOT NULL AND NOT isnan(corr(a, b)))"""
SUMMARY = f"{IC}, summary AS (SELECT factor, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, count(*) AS periods, avg(ic) / nullif(stddev_samp(ic), 0) AS icir FROM ics GROUP BY factor HAVING count(*) >= 3)"
QUANT = f"""{REB}, q0 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY value, symbol) AS rn, count(*) OVER (PARTITION BY date) AS n FROM mrow),
member AS (SELECT *, CAST(greatest(1, ceil((rn - 1) * 5 / nullif(n - 1, 0)::DOUBLE)) AS INTEGER) AS quantile FROM q0 WHERE n >= 10),
quant AS (SELECT date, quantile, count(*) AS names, avg(fwd) AS ret FROM member WHERE quantile IS NOT NULL GROUP BY date, quantile),
ls AS (SELECT date, max(ret) FILTER (WHERE quantile = 5) - max(ret) FILTER (WHERE quantile = 1) AS ls FROM quant GROUP BY date HAVING max(ret) FILTER (WHERE quantile = 5) - max(ret) FILTER (WHERE quantile = 1) IS NOT NULL)"""


# sources and kernels


@query(f"WITH {DAILY_SQL} SELECT date, symbol, CAST(t AS INTEGER) AS t, {rd('close', 8)} AS close, volume FROM grid")
def panel_densify(spark, sf_dir):
    return grid_of(spark, sf_dir).select("date", "symbol", "t", r("close", 8).alias("close"), "volume")


@query(f"WITH {DAILY_SQL}, {z('grid', 'f', ['close'])} SELECT date, symbol, {rd('close', 5)} AS z FROM f")
def zscore_mad(spark, sf_dir):
    return k.zscore(grid_of(spark, sf_dir).select("date", "symbol", "close"), ["close"]).select("date", "symbol", r("close", 5).alias("z"))


@query(f"WITH {DAILY_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY close, symbol) AS rn, count(*) OVER (PARTITION BY date) AS n FROM grid WHERE close IS NOT NULL) SELECT date, symbol, CAST(greatest(1, ceil((rn - 1) * 5 / nullif(n - 1, 0)::DOUBLE)) AS INTEGER) AS bucket FROM a WHERE n >= 10")
def qcut_buckets(spark, sf_dir):
    return grid_of(spark, sf_dir).select("date", "symbol", k.quantile_bucket("close", 5, least=10).alias("bucket")).where("bucket is not null")


@query(f"WITH {DAILY_SQL} SELECT date, symbol, CASE WHEN volume IS NOT NULL THEN {rank_average('volume', 'date')} END::DOUBLE AS rank, {rd(f'CASE WHEN volume IS NOT NULL THEN {rank_average("volume", "date")} END / count(volume) OVER (PARTITION BY date)')} AS pct FROM grid")
def rank_average_percent(spark, sf_dir):
    return grid_of(spark, sf_dir).select("date", "symbol", k.rank_average("volume", "date").cast("double").alias("rank"), r(k.rank_percent("volume", "date")).alias("pct"))


@query(f"WITH {DAILY_SQL} SELECT symbol, {WEEK} AS period, {rd('last(close ORDER BY date) FILTER (WHERE close IS NOT NULL)', 8)} AS close FROM grid GROUP BY symbol, {WEEK}")
def resample_wfri(spark, sf_dir):
    return k.resample_last(grid_of(spark, sf_dir), "close", k.week_end("date")).select("symbol", "period", r("close", 8).alias("close"))


@query(f"WITH {DAILY_SQL} SELECT date, symbol, {rd(f'last_value(close IGNORE NULLS) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 8)} AS close FROM grid")
def forward_fill(spark, sf_dir):
    return grid_of(spark, sf_dir).select("date", "symbol", r(k.ffill("close", k.series()), 8).alias("close"))


@query(f"WITH {DAILY_SQL}, m AS (SELECT symbol, date, close AS monthly FROM bars WHERE day(date) <= 3) SELECT g.date, g.symbol, {rd('m.monthly', 8)} AS monthly FROM grid g ASOF LEFT JOIN m ON g.symbol = m.symbol AND g.date >= m.date")
def asof_backward(spark, sf_dir):
    bars = synthetic.daily_bars(spark, sf_dir)
    right = bars.where(F.dayofmonth("date") <= 3).select("symbol", F.col("date").alias("at"), F.col("close").alias("monthly"))
    return k.asof_backward(bar_sources.densify(bars).select("date", "symbol"), right, "date", "at", "symbol", ["monthly"]).select("date", "symbol", r("monthly", 8).alias("monthly"))


@query(f"WITH {DAILY_SQL} SELECT date, symbol, {rd(roll('avg', 'close', 20, 15))} AS mean, {rd(roll('stddev_samp', 'close', 20, 15))} AS std, {rd(roll('max', 'high', 20, 15), 8)} AS high, {rd(roll('sum', 'volume', 20, 15))} AS volume FROM grid")
def rolling_statistics(spark, sf_dir):
    w = k.series()
    return grid_of(spark, sf_dir).select("date", "symbol", *(r(k.rolling(f, c, 20, 15, w), 8 if n == "high" else 6).alias(n) for f, c, n in ((F.avg, "close", "mean"), (F.stddev_samp, "close", "std"), (F.max, "high", "high"), (F.sum, "volume", "volume"))))


@query(f"WITH {DAILY_SQL}, x AS (SELECT *, 0 AS seq FROM bars UNION ALL SELECT symbol, date, open, high, low, close + 1, volume, 1 FROM bars WHERE year(date) = 1996) SELECT symbol, date, {rd('last(close ORDER BY seq)', 8)} AS close FROM x GROUP BY symbol, date")
def upsert_dedup(spark, sf_dir):
    bars = synthetic.daily_bars(spark, sf_dir)
    new = bars.where(F.year("date") == 1996).withColumns({"close": F.col("close") + 1, "seq": F.lit(1)})
    return bar_sources.upsert(bars.withColumn("seq", F.lit(0)).unionByName(new), ("date", "symbol"), "seq").select("symbol", "date", r("close", 8).alias("close"))


@query(f"WITH {DAILY_SQL} SELECT symbol, date, {rd('close', 8)} AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM bars WHERE date <= DATE '2000-06-30') WHERE n <= 60")
def history_last_n(spark, sf_dir):
    return bar_sources.history(synthetic.daily_bars(spark, sf_dir), 60, "2000-06-30").select("symbol", "date", r("close", 8).alias("close"))


@query(f"WITH {INTRADAY_SQL} SELECT symbol, ts, {rd('close')} AS close, volume FROM ibars WHERE strftime(ts - INTERVAL 5 HOUR, '%H:%M:%S') BETWEEN '09:35:00' AND '15:57:00'")
def session_filter(spark, sf_dir):
    bars = bar_sources.session_only(synthetic.intraday_bars(spark, sf_dir))
    return bars.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), r("close").alias("close"), "volume")


@query(f"WITH {INTRADAY_SQL} SELECT symbol, time_bucket(INTERVAL 2 HOUR, ts) AS ts, {rd('first(open ORDER BY ts)')} AS open, {rd('max(high)')} AS high, {rd('min(low)')} AS low, {rd('last(close ORDER BY ts)')} AS close, sum(volume) AS volume FROM ibars GROUP BY ALL")
def resample_bars(spark, sf_dir):
    bars = bar_sources.resample(synthetic.intraday_bars(spark, sf_dir), "2 hours")
    return bars.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *(r(c).alias(c) for c in ("open", "high", "low", "close")), "volume")


@query(f"WITH {DAILY_SQL} SELECT symbol, count(*) AS bars, max(date) AS latest FROM bars WHERE high >= greatest(open, close, low) AND low <= least(open, close) GROUP BY symbol")
def valid_bars_by_symbol(spark, sf_dir):
    return bar_sources.valid_bars(synthetic.daily_bars(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("bars"), F.max("date").alias("latest"))


@query("SELECT column_name, nulls, distinct_values FROM (SELECT 'user_id' AS column_name, count(*) FILTER (WHERE user_id IS NULL) AS nulls, count(DISTINCT user_id) AS distinct_values FROM events UNION ALL SELECT 'event_type', count(*) FILTER (WHERE event_type IS NULL), count(DISTINCT event_type) FROM events UNION ALL SELECT 'value', count(*) FILTER (WHERE value IS NULL), count(DISTINCT value) FROM events)")
def profile_table(spark, sf_dir):
    return tables.profile(synthetic.table(spark, sf_dir, "events").select("user_id", "event_type", "value"))


@query("SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS day, nullif(CASE WHEN o_orderkey % 5 = 0 THEN -99 ELSE o_totalprice END, -99) AS price, nullif(trim(o_orderpriority), '') AS priority FROM orders")
def normalize_types(spark, sf_dir):
    key = F.col("o_orderkey")
    raw = synthetic.table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 7 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), F.when(key % 5 == 0, "-99").otherwise(F.col("o_totalprice").cast("string")).alias("price"), F.col("o_orderpriority").alias("priority"))
    return tables.normalize_types(raw, dates=["day"], numbers=["price"], strings=["priority"], sentinels=[-99])


@query("SELECT * FROM (VALUES ('AAPL', 100::BIGINT), ('NVDA', 50::BIGINT)) t(symbol, quantity)")
def parse_positions(spark, sf_dir):
    return tables.parse_positions(spark, "AAPL:100, nvda:50")


# research


@query(f"{W} SELECT date, symbol, {rd('f21.fwd')} AS fwd21, {rd('f5.fwd')} AS fwd5 FROM f21 JOIN f5 USING (date, symbol)")
def forward_returns(spark, sf_dir):
    grid, _ = factor_rows(spark, sf_dir)
    a, b = research.forward_returns(grid), research.next_day_returns(grid, 5)
    return a.select("date", "symbol", r("fwd").alias("fwd21")).join(b.select("date", "symbol", r("fwd").alias("fwd5")), ["date", "symbol"])


@query(f"WITH {DAILY_SQL}, d AS (SELECT DISTINCT date FROM grid) SELECT 'W' AS frequency, max(date) AS date FROM d GROUP BY {WEEK} UNION ALL SELECT 'M', max(date) FROM d GROUP BY date_trunc('month', date) UNION ALL SELECT 'Q', max(date) FROM d GROUP BY date_trunc('quarter', date)")
def rebalance_dates(spark, sf_dir):
    grid = grid_of(spark, sf_dir)
    parts = [research.rebalance_dates(grid, f).select(F.lit(f).alias("frequency"), "date") for f in "WMQ"]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _ics(spark, sf_dir):
    grid, rows = factor_rows(spark, sf_dir)
    return research.rank_ic(research.rebalance(rows, grid, "W"), 10)


@query(f"{IC} SELECT factor, date, n, {rd('ic')} AS ic FROM ics")
def rank_ic(spark, sf_dir):
    return _ics(spark, sf_dir).select("factor", "date", "n", r("ic").alias("ic"))


@query(f"{SUMMARY} SELECT factor, {rd('ic_mean')} AS ic_mean, {rd('ic_std')} AS ic_std, periods, {rd('icir')} AS icir FROM summary")
def ic_summary(spark, sf_dir):
    return research.ic_summary(_ics(spark, sf_dir)).select("factor", r("ic_mean").alias("ic_mean"), r("ic_std").alias("ic_std"), "periods", r("icir").alias("icir"))


@query(f"{SUMMARY} SELECT factor, {rd('ic_mean')} AS ic_mean FROM summary WHERE abs(ic_mean) >= 0.005")
def ic_filter(spark, sf_dir):
    return research.ic_filter(research.ic_summary(_ics(spark, sf_dir))).select("factor", r("ic_mean").alias("ic_mean"))


@query(f"{SUMMARY} SELECT report, last(factor ORDER BY abs(icir)) AS factor, {rd('max(abs(icir))')} AS abs_icir FROM summary JOIN (VALUES ('mom', 'trend'), ('range', 'trend'), ('rev', 'reversal')) g(factor, report) USING (factor) GROUP BY report")
def best_per_group(spark, sf_dir):
    groups = spark.createDataFrame([("mom", "trend"), ("range", "trend"), ("rev", "reversal")], "factor string, report string")
    return research.best_per_group(research.ic_summary(_ics(spark, sf_dir)), groups).select("report", "factor", r("abs_icir").alias("abs_icir"))


@query(f"{W}, c AS (SELECT * FROM wide WHERE mom IS NOT NULL AND range IS NOT NULL AND rev IS NOT NULL) SELECT 'mom' AS a, 'range' AS b, {rd('corr(mom, range)')} AS corr FROM c UNION ALL SELECT 'mom', 'rev', {rd('corr(mom, rev)')} FROM c UNION ALL SELECT 'range', 'rev', {rd('corr(range, rev)')} FROM c")
def factor_correlations(spark, sf_dir):
    _, rows = factor_rows(spark, sf_dir)
    wide = rows.groupBy("date", "symbol").pivot("factor", ["mom", "range", "rev"]).agg(F.first("value"))
    return research.factor_correlations(wide, ["mom", "range", "rev"]).select("a", "b", r("corr").alias("corr"))


_SCREEN = f"""{SUMMARY}, pass_ AS (SELECT factor, icir, row_number() OVER (ORDER BY icir DESC NULLS LAST, factor) AS i FROM summary WHERE abs(ic_mean) >= 0.005), wd AS (SELECT date, symbol, max(value) FILTER (WHERE factor = 'mom') AS mom, max(value) FILTER (WHERE factor = 'range') AS range, max(value) FILTER (WHERE factor = 'rev') AS rev FROM reb GROUP BY date, symbol),
wc AS (SELECT * FROM wd WHERE (mom IS NOT NULL OR NOT EXISTS (SELECT 1 FROM pass_ WHERE factor = 'mom')) AND (range IS NOT NULL OR NOT EXISTS (SELECT 1 FROM pass_ WHERE factor = 'range')) AND (rev IS NOT NULL OR NOT EXISTS (SELECT 1 FROM pass_ WHERE factor = 'rev'))),
co AS (SELECT 'mom' AS a, 'range' AS b, abs(corr(mom, range)) > 0.7 AS close FROM wc UNION ALL SELECT 'mom', 'rev', abs(corr(mom, rev)) > 0.7 FROM wc UNION ALL SELECT 'range', 'rev', abs(corr(range, rev)) > 0.7 FROM wc),
near_ AS (SELECT a, b, close FROM co UNION ALL SELECT b, a, close FROM co), pr AS (SELECT p.i, q.i AS j, coalesce(n.close, false) AS close, abs(p.icir) >= abs(q.icir) AS first_stays FROM pass_ p JOIN pass_ q ON p.i < q.i JOIN near_ n ON n.a = p.factor AND n.b = q.factor),
g1 AS (SELECT CASE WHEN close THEN CASE WHEN first_stays THEN 2 ELSE 1 END END AS gone FROM pr WHERE i = 1 AND j = 2), g2 AS (SELECT CASE WHEN close THEN CASE WHEN first_stays THEN 3 ELSE 1 END END AS gone FROM pr WHERE i = 1 AND j = 3),
g3 AS (SELECT CASE WHEN close AND 2 NOT IN (SELECT gone FROM g1 WHERE gone IS NOT NULL) AND 3 NOT IN (SELECT gone FROM g2 WHERE gone IS NOT NULL) THEN CASE WHEN first_stays THEN 3 ELSE 2 END END AS gone FROM pr WHERE i = 2 AND j = 3),
lost AS (SELECT gone FROM g1 UNION ALL SELECT gone FROM g2 UNION ALL SELECT gone FROM g3)"""


@query(f"{_SCREEN} SELECT factor FROM pass_ WHERE i NOT IN (SELECT gone FROM lost WHERE gone IS NOT NULL)")
def screen_factors(spark, sf_dir):
    grid, rows = factor_rows(spark, sf_dir)
    names, _ = research.screen(research.rebalance(rows, grid, "W").drop("fwd"), research.next_day_returns(grid, 5).drop("t"), ["mom", "range", "rev"], least=10)
    return spark.createDataFrame([(n,) for n in names], "factor string")


def _quantiles(spark, sf_dir):
    grid, rows = factor_rows(spark, sf_dir)
    return research.rebalance(rows.where("factor = 'mom'"), grid, "W")


@query(f"{QUANT} SELECT date, quantile, names, {rd('ret')} AS ret FROM quant")
def quantile_backtest(spark, sf_dir):
    return research.quantile_returns(_quantiles(spark, sf_dir)).select("date", "quantile", "names", r("ret").alias("ret"))


@query(f"{QUANT} SELECT date, {rd('ls')} AS ls FROM ls")
def long_short(spark, sf_dir):
    return research.long_short(research.quantile_returns(_quantiles(spark, sf_dir))).select("date", r("ls").alias("ls"))


PERF = """w0 AS (SELECT date, ls, date - lag(date) OVER (ORDER BY date) AS gap, product(1 + ls) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS wealth FROM ls),
w1 AS (SELECT *, wealth / greatest(1.0, max(wealth) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS down FROM w0),
w2 AS (SELECT median(gap) AS gap, count(*) AS periods, avg(ls) AS m, stddev_samp(ls) AS s, avg(CAST(ls > 0 AS INTEGER)) AS win_rate, min(down) AS max_drawdown, last(wealth ORDER BY date) AS wealth FROM w1),
w3 AS (SELECT *, CASE WHEN gap <= 2 THEN 252 WHEN gap <= 8 THEN 52 ELSE 12 END AS y FROM w2)"""


@query(f"{QUANT}, {PERF} SELECT periods, {rd('ln(pow(wealth, y / periods::DOUBLE))', 5)} AS log_annual_return, {rd('s * sqrt(y)')} AS annual_vol, {rd('m / nullif(s, 0) * sqrt(y)', 5)} AS sharpe, {rd('win_rate')} AS win_rate, {rd('max_drawdown')} AS max_drawdown FROM w3")
def factor_metrics(spark, sf_dir):
    p = research.performance(research.long_short(research.quantile_returns(_quantiles(spark, sf_dir))))
    return p.select("periods", r(F.log1p("annual_return"), 5).alias("log_annual_return"), r("annual_vol").alias("annual_vol"), r("sharpe", 5).alias("sharpe"), r("win_rate").alias("win_rate"), r("max_drawdown").alias("max_drawdown"))


@query(f"{QUANT}, mm AS (SELECT quantile, avg(ret) AS ret FROM quant GROUP BY quantile), rr AS (SELECT rank() OVER (ORDER BY quantile) AS a, rank() OVER (ORDER BY ret) AS b FROM mm) SELECT {rd('corr(a, b)')} AS monotonicity FROM rr")
def monotonicity(spark, sf_dir):
    return research.monotonicity(research.quantile_returns(_quantiles(spark, sf_dir))).select(r("monotonicity").alias("monotonicity"))


@query(f"""{QUANT}, top AS (SELECT date, symbol FROM member WHERE quantile = 5), dd AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM top)),
was AS (SELECT nxt AS date, symbol FROM top JOIN dd USING (date) WHERE nxt IS NOT NULL), bo AS (SELECT coalesce(a.date, b.date) AS date, a.symbol IS NOT NULL AS now, b.symbol IS NOT NULL AS bef FROM top a FULL JOIN was b ON a.date = b.date AND a.symbol = b.symbol)
SELECT date, {rd('count(*) FILTER (WHERE now <> bef) / 2.0 / nullif(count(*) FILTER (WHERE now), 0)')} AS turnover FROM bo WHERE date IN (SELECT date FROM was) GROUP BY date""")
def turnover(spark, sf_dir):
    return research.turnover(_quantiles(spark, sf_dir)).select("date", r("turnover").alias("turnover"))


@query(f"{W}, {z('factors', 'f', ['value'], 'date, symbol, factor', 'factor, date')} SELECT date, symbol, {rd('sum(value * w) / nullif(sum(abs(w)) FILTER (WHERE value IS NOT NULL), 0)', 5)} AS value FROM f JOIN (VALUES ('mom', 0.5), ('range', 0.3), ('rev', -0.2)) v(factor, w) USING (factor) GROUP BY date, symbol HAVING count(value) >= 1")
def composite_weighted(spark, sf_dir):
    _, rows = factor_rows(spark, sf_dir)
    return research.weighted_composite(rows, {"mom": 0.5, "range": 0.3, "rev": -0.2}).where("value is not null").select("date", "symbol", r("value", 5).alias("value"))


_OK = "CASE WHEN mom IS NOT NULL AND range IS NOT NULL THEN {} END"


@query(f"""{W}, o AS (SELECT date, symbol, mom, range, {_OK.format('mom')} AS y, {_OK.format('range')} AS x FROM wide), p AS (SELECT *, count(y) OVER d AS n, regr_slope(y, x) OVER d AS b, avg(y) OVER d AS my, avg(x) OVER d AS mx FROM o WINDOW d AS (PARTITION BY date))
SELECT date, symbol, {rd('CASE WHEN n >= 10 THEN y - my - coalesce(b, 0) * (x - mx) ELSE mom END')} AS value FROM p""")
def orthogonalize_one(spark, sf_dir):
    _, rows = factor_rows(spark, sf_dir)
    wide = grid_of(spark, sf_dir).select("date", "symbol").join(rows.groupBy("date", "symbol").pivot("factor", ["mom", "range"]).agg(F.first("value")), ["date", "symbol"], "left")
    return research.orthogonalize_one(wide, "mom", "range").select("date", "symbol", r("value").alias("value"))


_two = "CASE WHEN mom IS NOT NULL AND range IS NOT NULL AND rev IS NOT NULL THEN {} END"


@query(f"""{W}, o AS (SELECT date, symbol, rev, {_two.format('rev')} AS y, {_two.format('mom')} AS x1, {_two.format('range')} AS x2 FROM (SELECT date, symbol, max(value) FILTER (WHERE factor = 'mom') AS mom, max(value) FILTER (WHERE factor = 'range') AS range, max(value) FILTER (WHERE factor = 'rev') AS rev FROM factors GROUP BY date, symbol)),
p AS (SELECT *, count(y) OVER d AS n, y - avg(y) OVER d AS yc, x1 - avg(x1) OVER d AS u, x2 - avg(x2) OVER d AS v, covar_pop(x1, x1) OVER d AS c11, covar_pop(x2, x2) OVER d AS c22, covar_pop(x1, x2) OVER d AS c12, covar_pop(x1, y) OVER d AS c1y, covar_pop(x2, y) OVER d AS c2y FROM o WINDOW d AS (PARTITION BY date))
SELECT date, symbol, {rd('CASE WHEN n >= 10 THEN yc - (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) * u - (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) * v ELSE rev END')} AS value FROM p""")
def orthogonalize_many(spark, sf_dir):
    _, rows = factor_rows(spark, sf_dir)
    found = research.orthogonalize(rows.groupBy("date", "symbol").pivot("factor", ["mom", "range", "rev"]).agg(F.first("value")), "rev", ["mom", "range"])
    return found.withColumn("value", r("value"))


@query()
def orthogonalize_sequence(spark, sf_dir):
    _, rows = factor_rows(spark, sf_dir)
    return research.orthogonalize_sequence(research.rebalance(rows, grid_of(spark, sf_dir), "M").groupBy("date", "symbol").pivot("factor", NAMES3).agg(F.first("value")), NAMES3)


@query(f"""{W}, wk AS (SELECT factor, symbol, {WEEK} AS week, last(value ORDER BY date) AS value FROM factors GROUP BY ALL), cl AS (SELECT symbol, {WEEK} AS week, last(close ORDER BY date) AS close FROM fgrid WHERE close IS NOT NULL GROUP BY ALL),
sy AS (SELECT DISTINCT symbol FROM cl), wt AS (SELECT week, row_number() OVER (ORDER BY week) AS t FROM (SELECT DISTINCT week FROM cl)), full_ AS (SELECT wt.week, wt.t, sy.symbol, cl.close FROM wt CROSS JOIN sy LEFT JOIN cl USING (week, symbol)),
fw AS (SELECT week, symbol, lead(close) OVER (PARTITION BY symbol ORDER BY t) / nullif(close, 0) - 1 AS fwd FROM full_)
SELECT factor, symbol, week AS date, {rd('value')} AS value, {rd('fwd')} AS fwd FROM wk LEFT JOIN fw USING (week, symbol)""")
def weekly_panel(spark, sf_dir):
    grid, rows = factor_rows(spark, sf_dir)
    return research.prepare_weekly(rows, grid).select("factor", "symbol", "date", r("value").alias("value"), r("fwd").alias("fwd"))


@query(f"""{REB}, e AS (SELECT *, {rank_average('value', 'date')} / count(*) OVER (PARTITION BY date) AS pct, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY value DESC, symbol) AS kk FROM mrow)
SELECT date, {rd('avg(fwd) FILTER (WHERE pct > 0.8) - avg(fwd) FILTER (WHERE pct <= 0.2)')} AS ls, {rd('avg(fwd) FILTER (WHERE kk <= 10)')} AS lo FROM e WHERE n >= 10 GROUP BY date""")
def prediction_backtest(spark, sf_dir):
    rows = _quantiles(spark, sf_dir)
    return research.evaluate_predictions(rows, top=10, least=10).select("date", r("ls").alias("ls"), r("lo").alias("lo"))


@query(f"""{W}, s AS (SELECT *, CASE factor WHEN 'rev' THEN -1.0 ELSE 1.0 END AS sg FROM factors), w1 AS (SELECT date, symbol FROM s GROUP BY ALL HAVING count(*) = 3), w2 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM w1) WHERE n >= 10),
x AS (SELECT s.* FROM s JOIN w2 USING (date, symbol)), y AS (SELECT date, symbol, sg, (value - min(value) OVER p) / nullif(max(value) OVER p - min(value) OVER p, 0) AS v FROM x WINDOW p AS (PARTITION BY factor, date)) SELECT date, symbol, {rd('avg(v * sg)')} AS score FROM y GROUP BY date, symbol""")
def scores_minmax(spark, sf_dir):
    _, rows = factor_rows(spark, sf_dir)
    return research.normalized_scores(rows, {"mom": 1.0, "range": 1.0, "rev": -1.0}, "minmax", 10).select("date", "symbol", r("score").alias("score"))


@query(f"""{W}, s AS (SELECT * FROM factors), w1 AS (SELECT date, symbol FROM s GROUP BY ALL HAVING count(*) = 3), w2 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM w1) WHERE n >= 10),
x AS (SELECT s.* FROM s JOIN w2 USING (date, symbol)), {z('x', 'y', ['value'], 'date, symbol, factor', 'factor, date')} SELECT date, symbol, {rd("avg(value * CASE factor WHEN 'rev' THEN -1.0 ELSE 1.0 END)", 5)} AS score FROM y GROUP BY date, symbol""")
def scores_zscore(spark, sf_dir):
    _, rows = factor_rows(spark, sf_dir)
    return research.normalized_scores(rows, {"mom": 1.0, "range": 1.0, "rev": -1.0}, "zscore", 10).select("date", "symbol", r("score", 5).alias("score"))


@query(f"""{W}, l AS (SELECT * FROM factors WHERE date = (SELECT max(date) FROM factors)), {z('l', 'y', ['value'], 'date, symbol, factor', 'factor, date')},
v AS (SELECT symbol FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM bars) WHERE n <= 5 GROUP BY symbol HAVING avg(volume) >= 20)
SELECT symbol, {rd("sum(coalesce(value * CASE factor WHEN 'rev' THEN -1.0 ELSE 1.0 END, 0)) / 3", 5)} AS score FROM y JOIN v USING (symbol) GROUP BY symbol ORDER BY sum(coalesce(value * CASE factor WHEN 'rev' THEN -1.0 ELSE 1.0 END, 0)) DESC NULLS LAST, symbol LIMIT 10""")
def pick_stocks(spark, sf_dir):
    _, rows = factor_rows(spark, sf_dir)
    return research.pick(rows, synthetic.daily_bars(spark, sf_dir), {"mom": 1.0, "range": 1.0, "rev": -1.0}, 10, 20).select("symbol", r("score", 5).alias("score"))


# learning

NAMES3 = ["mom", "range", "rev"]


def _panel(spark, sf_dir):
    grid, rows = factor_rows(spark, sf_dir)
    rows = research.rebalance(rows, grid, "W")
    return ml.panel(rows.drop("fwd"), rows.select("date", "symbol", "fwd").distinct(), NAMES3)


PANEL = f"""{REB}, p0 AS (SELECT date, symbol, {', '.join(f"max(value) FILTER (WHERE factor = '{c}') AS {c}" for c in NAMES3)} FROM reb GROUP BY date, symbol),
p1 AS (SELECT *, {', '.join(f'{c} AS raw_{c}' for c in NAMES3)} FROM p0), {z('p1', 'p2', NAMES3, 'date, symbol, raw_mom, raw_range, raw_rev')},
p3 AS (SELECT date, symbol, {', '.join(f'mad({c}) OVER (PARTITION BY date) AS mad_{c}' for c in NAMES3)} FROM p0),
mlp AS (SELECT date, symbol, {', '.join(f'coalesce(CASE WHEN mad_{c} = 0 THEN raw_{c} ELSE {c} END, 0.0) AS {c}' for c in NAMES3)}, fwd FROM p2 JOIN p3 USING (date, symbol) JOIN (SELECT DISTINCT date, symbol, fwd FROM reb WHERE fwd IS NOT NULL) USING (date, symbol))"""


@query(f"{PANEL} SELECT date, symbol, {', '.join(f'{rd(c, 5)} AS {c}' for c in NAMES3)}, {rd('fwd')} AS fwd FROM mlp")
def ml_panel(spark, sf_dir):
    return _panel(spark, sf_dir).select("date", "symbol", *(r(c, 5).alias(c) for c in NAMES3), r("fwd").alias("fwd"))


# normal equations of three scaled features by Cramer's rule
_pairs = [(a, b) for a in range(4) for b in range(a, 4)]
_x = [*NAMES3, "fwd"]
_c = lambda a, b: f"(q{min(a, b)}{max(a, b)} - s{a} * s{b} / n)"
_g = lambda a, b: f"({_c(a, b)} / d{a} / d{b}" + (" + 1)" if a == b else ")")
_det = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
_gram = [[_g(a, b) for b in range(3)] for a in range(3)]
_with = lambda k: [[f"({_c(a, 3)} / d{a})" if b == k else _gram[a][b] for b in range(3)] for a in range(3)]
RIDGE = f"""{PANEL}, r0 AS (SELECT date, count(*) AS size, {', '.join(f'sum({c}) AS s{i}' for i, c in enumerate(_x))}, {', '.join(f'sum({_x[a]} * {_x[b]}) AS q{a}{b}' for a, b in _pairs)} FROM mlp GROUP BY date),
r1 AS (SELECT date, size, row_number() OVER (ORDER BY date) - 1 AS t, sum(size) OVER w AS n, {', '.join(f'sum(s{i}) OVER w AS s{i}' for i in range(4))}, {', '.join(f'sum(q{a}{b}) OVER w AS q{a}{b}' for a, b in _pairs)}
 FROM r0 WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r2 AS (SELECT *, {', '.join(f'CASE WHEN {_c(i, i)} / n > 1e-24 THEN sqrt(greatest({_c(i, i)}, 0) / n) ELSE 1.0 END AS d{i}' for i in range(3))} FROM r1 WHERE n >= 100 AND t >= 8 AND size >= 20),
r3 AS (SELECT *, {', '.join(f'{_det(_with(k))} / {_det(_gram)} / d{k} AS b{k}' for k in range(3))} FROM r2),
r4 AS (SELECT *, s3 / n - b0 * s0 / n - b1 * s1 / n - b2 * s2 / n AS a FROM r3)"""


@query(f"{RIDGE} SELECT date, symbol, {rd('fwd')} AS fwd, {rd('a + b0 * mom + b1 * range + b2 * rev')} AS value FROM mlp JOIN r4 USING (date)")
def walk_forward_ridge(spark, sf_dir):
    return ml.walk_forward(_panel(spark, sf_dir), NAMES3, "ridge").select("date", "symbol", r("fwd").alias("fwd"), r("value").alias("value"))


@query()
def walk_forward_forest(spark, sf_dir):
    """Every week after the first nine, with 100 trees."""
    return ml.walk_forward(_panel(spark, sf_dir), NAMES3, "forest", purge=1)


@query()
def walk_forward_boosting(spark, sf_dir):
    return ml.walk_forward(_panel(spark, sf_dir), NAMES3, "boosting")


@query()
def walk_forward_svr(spark, sf_dir):
    return ml.walk_forward(_panel(spark, sf_dir), NAMES3, "svr")


@query()
def walk_forward_pca_ridge(spark, sf_dir):
    return ml.walk_forward(_panel(spark, sf_dir), NAMES3, "pca_ridge", components=2)


_EQUAL = f"{PANEL}, eqw AS (SELECT date, symbol, fwd, (mom + range + rev) / 3 AS value FROM mlp)"


@query(f"""{_EQUAL}, er AS (SELECT date, {rank_average('round(value, 9)', 'date')} AS a, {rank_average('fwd', 'date')} AS b FROM eqw), ei AS (SELECT date, corr(a, b) AS ic FROM er GROUP BY date HAVING count(*) >= 10 AND corr(a, b) IS NOT NULL AND NOT isnan(corr(a, b))),
ep AS (SELECT *, {rank_average('round(value, 9)', 'date')} / count(*) OVER (PARTITION BY date) AS pct, count(*) OVER (PARTITION BY date) AS n FROM eqw), el AS (SELECT date, avg(fwd) FILTER (WHERE pct > 0.8) - avg(fwd) FILTER (WHERE pct <= 0.2) AS ls FROM ep WHERE n >= 10 GROUP BY date),
ev AS (SELECT ls FROM (SELECT ls, row_number() OVER (ORDER BY date) - 1 AS k FROM el) WHERE k % 5 = 0)
SELECT dates, ic_mean, icir, periods, annual_return, annual_vol, sharpe, win_rate FROM (SELECT count(*) AS dates, {rd('avg(ic)')} AS ic_mean, {rd('avg(ic) / nullif(stddev_samp(ic), 0)')} AS icir FROM ei)
CROSS JOIN (SELECT count(ls) AS periods, {rd('avg(ls) * 50.4')} AS annual_return, {rd('stddev_samp(ls) * sqrt(50.4)')} AS annual_vol, {rd('avg(ls) / nullif(stddev_samp(ls), 0) * sqrt(50.4)')} AS sharpe, {rd('avg(CAST(ls > 0 AS INTEGER))')} AS win_rate FROM ev)""")
def daily_evaluation(spark, sf_dir):
    rows = ml.equal_weight(_panel(spark, sf_dir), NAMES3).withColumn("value", F.round("value", 9))
    found = ml.daily_evaluation(rows, least=10)
    return found.select(*(F.col(c) if c in ("dates", "periods") else r(c).alias(c) for c in found.columns))


@query()
def ensemble_predictions(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    return ml.ensemble(ml.walk_forward(panel, NAMES3, "ridge"), ml.equal_weight(panel, NAMES3), ml.walk_forward(panel, NAMES3, "pca_ridge", components=2))


@query()
def feature_importance(spark, sf_dir):
    return ml.feature_importance(_panel(spark, sf_dir), NAMES3)


@query()
def live_signal(spark, sf_dir):
    panel = _panel(spark, sf_dir).cache()
    last = panel.agg(F.max("date")).first()[0]
    return ml.live_signal(panel.where(F.col("date") < last), panel.where(F.col("date") == last), NAMES3)


@query()
def daily_panel(spark, sf_dir):
    grid, rows = factor_rows(spark, sf_dir)
    return ml.daily_panel(rows, grid, research.forward_returns(grid), {"mom": 1.0, "range": 1.0, "rev": -1.0}, 20, 10)


@query()
def weekly_pipeline(spark, sf_dir):
    grid, rows = factor_rows(spark, sf_dir)
    return weekly.run(rows, grid, "equal_weight", least=10, top=10).returns


@query(f"{IC} SELECT factor, date, {rd('ic')} AS ic, {rd('CASE WHEN count(ic) OVER w >= 12 THEN avg(ic) OVER w END')} AS rolling_ic FROM ics WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def rolling_ic(spark, sf_dir):
    return research.rolling_ic(_ics(spark, sf_dir)).select("factor", "date", r("ic").alias("ic"), r("rolling_ic").alias("rolling_ic"))


@query()
def strategy_comparison(spark, sf_dir):
    return backtest.compare(synthetic.daily_bars(spark, sf_dir), capital=1e6)


# signals

B = f"WITH {DAILY_SQL}"
OWN = "PARTITION BY symbol ORDER BY date"
_hil = " + ".join(f"{lag('d', m, OWN)} * {2 / 30 / math.tan(math.pi * m / 30)!r}" for m in range(1, 30, 2))
HHT = f"""{B}, h0 AS (SELECT symbol, date, row_number() OVER ({OWN}) AS n, {roll('avg', 'close', 60, 60, OWN)} AS ma FROM bars), h1 AS (SELECT *, ma - {lag('ma', 1, OWN)} AS d FROM h0),
h2 AS (SELECT *, atan2(0.0 + {_hil}, d) AS ph, n >= 90 AND {lag('d', 29, OWN)} IS NOT NULL AS ok FROM h1), hht AS (SELECT symbol, date, CASE WHEN ok THEN ph END AS phase, CASE WHEN ok AND d >= 0 THEN 'BUY' WHEN ok AND d < 0 THEN 'FLAT' END AS signal FROM h2)"""
_w18 = f"OVER ({OWN} ROWS BETWEEN 17 PRECEDING AND CURRENT ROW)"
_w250 = f"OVER ({OWN} ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)"
QRS = f"""q0 AS (SELECT symbol, date, CASE WHEN count(high) {_w18} >= 18 THEN regr_slope(high, low) {_w18} END AS beta, CASE WHEN count(high) {_w18} >= 18 THEN regr_r2(high, low) {_w18} END AS r2 FROM bars),
q1 AS (SELECT *, CASE WHEN count(beta) {_w250} >= 250 THEN (beta - avg(beta) {_w250}) / nullif(stddev_pop(beta) {_w250}, 0) * r2 END AS score FROM q0), q2 AS (SELECT *, {lag('score', 1, OWN)} AS prev FROM q1),
qrs AS (SELECT *, CASE WHEN score > 0.7 THEN 'BUY' WHEN score < -0.7 THEN 'SELL' WHEN score IS NOT NULL THEN 'HOLD' END AS level, CASE WHEN prev <= 0.7 AND score > 0.7 THEN 'BUY' WHEN prev >= -0.7 AND score < -0.7 THEN 'SELL' END AS crossing FROM q2)"""


@query(f"{HHT} SELECT symbol, date, {rd('phase', 5)} AS phase, signal FROM hht WHERE signal IS NOT NULL")
def hht_signal(spark, sf_dir):
    return signals.hht(synthetic.daily_bars(spark, sf_dir)).where("signal is not null").select("symbol", "date", r("phase", 5).alias("phase"), "signal")


@query(f"{B}, {QRS} SELECT symbol, date, {rd('beta', 5)} AS beta, {rd('r2', 5)} AS r2, {rd('score', 4)} AS score, level, crossing FROM qrs WHERE score IS NOT NULL")
def qrs_signal(spark, sf_dir):
    return signals.qrs(synthetic.daily_bars(spark, sf_dir)).where("score is not null").select("symbol", "date", r("beta", 5).alias("beta"), r("r2", 5).alias("r2"), r("score", 4).alias("score"), "level", "crossing")


_DECIDE = """SELECT * FROM (VALUES ('N/A','N/A',true,'N/A','insufficient data'),('N/A','N/A',false,'N/A','insufficient data'),('BUY','BUY',true,'HOLD','both bullish, keep position'),('BUY','BUY',false,'BUY','both bullish'),
('BUY','SELL',true,'REVIEW','conflicting signals'),('BUY','SELL',false,'REVIEW','conflicting signals'),('BUY','HOLD',true,'HOLD','HHT bullish'),('BUY','HOLD',false,'CONSIDER BUY','HHT bullish'),('BUY','N/A',true,'HOLD','HHT bullish'),('BUY','N/A',false,'CONSIDER BUY','HHT bullish'),
('FLAT','BUY',true,'REVIEW','conflicting signals'),('FLAT','BUY',false,'CONSIDER BUY','QRS bullish'),('FLAT','SELL',true,'SELL','both bearish'),('FLAT','SELL',false,'-','no position, no signal'),('FLAT','HOLD',true,'CONSIDER SELL','HHT bearish'),('FLAT','HOLD',false,'-','no buy signal'),
('FLAT','N/A',true,'CONSIDER SELL','HHT bearish'),('FLAT','N/A',false,'-','no buy signal'),('N/A','BUY',true,'HOLD','QRS bullish'),('N/A','BUY',false,'CONSIDER BUY','QRS bullish'),('N/A','SELL',true,'CONSIDER SELL','QRS bearish'),('N/A','SELL',false,'-','no position'),
('N/A','HOLD',true,'-','HHT insufficient data'),('N/A','HOLD',false,'-','HHT insufficient data')) t(hht, qrs, held, action, reason)"""


@query(_DECIDE)
def decision_matrix(spark, sf_dir):
    col = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} {'boolean' if name == 'held' else 'string'}")
    rows = col("hht", ["BUY", "FLAT", "N/A"]).crossJoin(col("qrs", ["BUY", "HOLD", "SELL", "N/A"])).crossJoin(col("held", [True, False]))
    action, reason = signals.decide(F.col("hht"), F.col("qrs"), F.col("held"))
    return rows.select("hht", "qrs", "held", action.alias("action"), reason.alias("reason"))


@query(f"""{HHT}, {QRS}, lh AS (SELECT symbol, coalesce(last(signal ORDER BY date), 'N/A') AS hht FROM hht GROUP BY symbol), lq AS (SELECT symbol, coalesce(last(level ORDER BY date), 'N/A') AS qrs FROM qrs GROUP BY symbol),
pos AS (SELECT * FROM (VALUES ('Brand#11', 100::BIGINT), ('Brand#23', 50::BIGINT), ('ZZZ', 5::BIGINT)) v(symbol, quantity)), decide AS ({_DECIDE}),
al AS (SELECT symbol, coalesce(hht, 'N/A') AS hht, coalesce(qrs, 'N/A') AS qrs, coalesce(quantity, 0) AS quantity FROM lh FULL JOIN lq USING (symbol) FULL JOIN pos USING (symbol))
SELECT symbol, hht, qrs, quantity, action, reason FROM al JOIN decide d USING (hht, qrs) WHERE d.held = (quantity > 0)""")
def advisor(spark, sf_dir):
    positions = spark.createDataFrame([("Brand#11", 100), ("Brand#23", 50), ("ZZZ", 5)], "symbol string, quantity long")
    return signals.recommend(signals.latest_signals(synthetic.daily_bars(spark, sf_dir)), positions)


@query(f"{B} SELECT symbol, date, {rd('a')} AS sma_short, {rd('b')} AS sma_long, CASE WHEN a > b THEN 'LONG' WHEN b IS NOT NULL THEN 'OUT' END AS signal FROM (SELECT symbol, date, {roll('avg', 'close', 50, 50, OWN)} AS a, {roll('avg', 'close', 200, 200, OWN)} AS b FROM bars)")
def sma_cross(spark, sf_dir):
    return signals.sma_level(synthetic.daily_bars(spark, sf_dir)).select("symbol", "date", r("sma_short").alias("sma_short"), r("sma_long").alias("sma_long"), "signal")


_w14 = f"OVER ({OWN} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"


@query(f"""{B}, a AS (SELECT symbol, date, close - {lag('close', 1, OWN)} AS d FROM bars), b AS (SELECT symbol, date, count(d) {_w14} AS n, sum(CASE WHEN d > 0 THEN d ELSE 0.0 END) {_w14} / 14 AS g, sum(CASE WHEN d < 0 THEN -d ELSE 0.0 END) {_w14} / 14 AS l FROM a),
c AS (SELECT symbol, date, CASE WHEN n < 14 THEN 50.0 WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END AS rsi FROM b) SELECT symbol, date, {rd('rsi')} AS rsi, CASE WHEN rsi < 30 THEN 'BUY' WHEN rsi > 70 THEN 'SELL' ELSE 'HOLD' END AS signal FROM c""")
def rsi_simple(spark, sf_dir):
    return signals.rsi_simple(synthetic.daily_bars(spark, sf_dir)).select("symbol", "date", r("rsi").alias("rsi"), "signal")


_w59 = f"OVER ({OWN} ROWS BETWEEN 58 PRECEDING AND CURRENT ROW)"
_LOGS = f"l0 AS (SELECT symbol, date, close, row_number() OVER ({OWN}) AS n, ln(close / nullif({lag('close', 1, OWN)}, 0)) AS r FROM bars)"


@query(f"""{B}, {_LOGS}, l1 AS (SELECT *, close / nullif({lag('close', 19, OWN)}, 0) - 1 AS mom, CASE WHEN count(r) {_w59} >= 59 THEN greatest(stddev_pop(r) {_w59}, 1e-6) END AS vol FROM l0)
SELECT symbol, date, {rd('mom')} AS mom, {rd('vol')} AS vol, {rd('1 / vol / sum(1 / vol) OVER (PARTITION BY date)')} AS weight FROM l1 WHERE n % 20 = 0 AND mom > 0 AND vol IS NOT NULL""")
def momentum_weights(spark, sf_dir):
    return signals.momentum_weights(synthetic.daily_bars(spark, sf_dir)).select("symbol", "date", r("mom").alias("mom"), r("vol").alias("vol"), r("weight").alias("weight"))


@query(f"""{B}, {_LOGS}, l1 AS (SELECT symbol, date, close / nullif({lag('close', 59, OWN)}, 0) - 1 AS mom, CASE WHEN count(r) {_w59} >= 59 THEN 1 / greatest(stddev_pop(r) {_w59}, 1e-6) END AS inv FROM l0), wk AS (SELECT max(date) AS date FROM bars GROUP BY {WEEK}),
l2 AS (SELECT l1.* FROM l1 JOIN wk USING (date) WHERE mom IS NOT NULL AND inv IS NOT NULL), {z('l2', 'l3', ['mom', 'inv'], 'date, symbol', clip=False)}, l4 AS (SELECT date, symbol, round(mom + inv, 9) AS score, row_number() OVER (PARTITION BY date ORDER BY round(mom + inv, 9) DESC NULLS LAST, symbol) AS place FROM l3)
SELECT date, symbol, {rd('score', 5)} AS score, CAST(place AS INTEGER) AS place FROM l4 WHERE place <= 5""")
def weekly_top(spark, sf_dir):
    return signals.weekly_top(synthetic.daily_bars(spark, sf_dir)).select("date", "symbol", r("score", 5).alias("score"), "place")


# portfolios

_SIG = f"""{B}, s0 AS (SELECT symbol, date, {roll('avg', 'close', 50, 50, OWN)} AS a, {roll('avg', 'close', 200, 200, OWN)} AS b FROM bars), s1 AS (SELECT symbol, date, CASE WHEN a > b THEN 1 WHEN b IS NOT NULL THEN 0 END AS tg FROM s0),
s2 AS (SELECT symbol, date, coalesce(last_value(tg IGNORE NULLS) OVER ({OWN} ROWS UNBOUNDED PRECEDING), 0) AS tg FROM s1), s3 AS (SELECT symbol, date, (tg - coalesce({lag('tg', 1, OWN)}, 0)) * 100 AS quantity FROM s2), nb AS (SELECT symbol, date, lead(date) OVER ({OWN}) AS fd, lead(close) OVER ({OWN}) AS price FROM bars),
fills AS (SELECT s3.symbol || '-' || s3.date AS order_id, symbol, fd AS date, quantity, price, abs(quantity * price) * 0.001 AS commission FROM s3 JOIN nb USING (symbol, date) WHERE quantity <> 0 AND fd IS NOT NULL AND price IS NOT NULL)"""
_CURVE = f"""{_SIG}, moves AS (SELECT symbol, date, sum(quantity) AS q FROM fills GROUP BY ALL), gd AS (SELECT d.date, n.symbol, b.close, m.q FROM days d CROSS JOIN (SELECT DISTINCT symbol FROM fills) n LEFT JOIN bars b ON b.date = d.date AND b.symbol = n.symbol LEFT JOIN moves m ON m.date = d.date AND m.symbol = n.symbol),
held AS (SELECT date, sum(coalesce(q, 0)) OVER ({OWN} ROWS UNBOUNDED PRECEDING) AS q, last_value(close IGNORE NULLS) OVER ({OWN} ROWS UNBOUNDED PRECEDING) AS close FROM gd), hold AS (SELECT date, sum(coalesce(q * close, 0)) AS holdings FROM held GROUP BY date),
spent AS (SELECT date, sum(quantity * price + commission) AS spent FROM fills GROUP BY date), curve AS (SELECT d.date, 1e8 - coalesce(sum(spent) OVER (ORDER BY d.date ROWS UNBOUNDED PRECEDING), 0) AS cash, coalesce(holdings, 0) AS holdings FROM days d LEFT JOIN hold USING (date) LEFT JOIN spent USING (date)),
dd AS (SELECT date, cash + holdings AS total, max(cash + holdings) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM curve), dd2 AS (SELECT date, total, (total - peak) / nullif(peak, 0) AS drawdown FROM dd),
dd3 AS (SELECT *, sum(CAST(drawdown >= 0 AS INTEGER)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS spell FROM dd2)"""


def _fills(spark, sf_dir):
    bars = synthetic.daily_bars(spark, sf_dir)
    return bars, backtest.fills(backtest.level_orders(signals.sma_level(bars)), bars, 0.001)


@query(f"{_SIG} SELECT order_id, symbol, date, CAST(quantity AS INTEGER) AS quantity, {rd('price', 8)} AS price, {rd('commission', 8)} AS commission FROM fills")
def next_bar_fills(spark, sf_dir):
    return _fills(spark, sf_dir)[1].select("order_id", "symbol", "date", F.col("quantity").cast("int").alias("quantity"), r("price", 8).alias("price"), r("commission", 8).alias("commission"))


@query(f"{_CURVE} SELECT date, {rd('cash', 2)} AS cash, {rd('holdings', 2)} AS holdings, {rd('cash + holdings', 2)} AS total FROM curve")
def equity_curve(spark, sf_dir):
    bars, filled = _fills(spark, sf_dir)
    return backtest.equity_curve(filled, bars, 1e8).select("date", *(r(c, 2).alias(c) for c in ("cash", "holdings", "total")))


@query(f"{_CURVE} SELECT date, {rd('drawdown')} AS drawdown, CAST(spell AS BIGINT) AS spell FROM dd3")
def drawdowns(spark, sf_dir):
    bars, filled = _fills(spark, sf_dir)
    return backtest.drawdowns(backtest.equity_curve(filled, bars, 1e8)).select("date", r("drawdown").alias("drawdown"), "spell")


@query(f"""{_CURVE}, rr AS (SELECT *, total / nullif(lag(total) OVER (ORDER BY date), 0) - 1 AS r FROM dd3), du AS (SELECT max(n) AS max_dd_duration FROM (SELECT CAST(sum(CAST(drawdown < 0 AS INTEGER)) AS BIGINT) AS n FROM dd3 GROUP BY spell)),
oo AS (SELECT last(total ORDER BY date) AS fv, count(*) AS n, avg(r) AS m, stddev_samp(r) AS s, stddev_samp(r) FILTER (WHERE r < 0) AS d, min(drawdown) AS max_drawdown FROM rr), o2 AS (SELECT *, fv / 1e8 - 1 AS tr, pow(fv / 1e8, 252.0 / n) - 1 AS ar FROM oo)
SELECT {rd('tr')} AS total_return, {rd('ar')} AS annual_return, {rd('coalesce(m / nullif(s, 0) * sqrt(252), 0)', 4)} AS sharpe_ratio, {rd('coalesce(m / nullif(d, 0) * sqrt(252), 0)', 4)} AS sortino_ratio, {rd('max_drawdown')} AS max_drawdown, max_dd_duration, {rd('coalesce(ar / nullif(abs(max_drawdown), 0), 0)', 4)} AS calmar_ratio, {rd('fv', 2)} AS final_value FROM o2 CROSS JOIN du""")
def equity_metrics(spark, sf_dir):
    bars, filled = _fills(spark, sf_dir)
    m = backtest.metrics(backtest.equity_curve(filled, bars, 1e8), 1e8)
    digits = {"sharpe_ratio": 4, "sortino_ratio": 4, "calmar_ratio": 4, "final_value": 2}
    return m.select(*(F.col(c).cast("long").alias(c) if c == "max_dd_duration" else r(c, digits.get(c, 6)).alias(c) for c in m.columns))


_TRADES = f"""{B}, tr AS (SELECT symbol, date, row_number() OVER ({OWN}) AS order_id, CAST(CASE WHEN row_number() OVER ({OWN}) % 3 = 0 THEN -7 ELSE 5 END AS BIGINT) AS quantity, close AS price FROM bars),
cu AS (SELECT *, sum(greatest(quantity, 0)) OVER ({OWN} ROWS UNBOUNDED PRECEDING) AS bq, sum(quantity) OVER ({OWN} ROWS UNBOUNDED PRECEDING) AS fl FROM tr), ov AS (SELECT *, least(min(fl) OVER ({OWN} ROWS UNBOUNDED PRECEDING), 0) AS o FROM cu),
cl AS (SELECT *, bq - (fl - o) AS closed FROM ov), cb AS (SELECT *, coalesce(lag(closed) OVER ({OWN}), 0) AS cbef FROM cl),
mt AS (SELECT a.symbol, a.order_id AS buy_id, s.order_id AS sell_id, least(a.bq, s.closed) - greatest(a.bq - a.quantity, s.cbef) AS quantity, a.price AS e, s.price AS x FROM cb a JOIN cb s ON a.symbol = s.symbol AND a.quantity > 0 AND s.quantity < 0 AND least(a.bq, s.closed) > greatest(a.bq - a.quantity, s.cbef))"""


def _matches(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("date"))
    rows = synthetic.daily_bars(spark, sf_dir).select("symbol", "date", n.alias("order_id"), F.when(n % 3 == 0, -7).otherwise(5).cast("long").alias("quantity"), F.col("close").alias("price"))
    return backtest.fifo_matches(rows)


@query(f"{_TRADES} SELECT symbol, CAST(buy_id AS INTEGER) AS buy_id, CAST(sell_id AS INTEGER) AS sell_id, CAST(quantity AS BIGINT) AS quantity, {rd('(x - e) * quantity', 8)} AS pnl FROM mt")
def fifo_pnl(spark, sf_dir):
    return _matches(spark, sf_dir).select("symbol", "buy_id", "sell_id", "quantity", r("pnl", 8).alias("pnl"))


@query(f"{_TRADES}, pp AS (SELECT (x - e) * quantity AS p FROM mt) SELECT count(*) AS trades, {rd('avg(CAST(p > 0 AS INTEGER))')} AS win_rate, {rd('avg(p) FILTER (WHERE p > 0)', 3)} AS avg_win, {rd('avg(p) FILTER (WHERE p <= 0)', 3)} AS avg_loss, {rd('sum(p) FILTER (WHERE p > 0) / nullif(abs(sum(p) FILTER (WHERE p <= 0)), 0)', 5)} AS profit_factor FROM pp")
def trade_statistics(spark, sf_dir):
    digits = {"win_rate": 6, "avg_win": 3, "avg_loss": 3, "profit_factor": 5}
    s = backtest.trade_statistics(_matches(spark, sf_dir))
    return s.select("trades", *(r(c, d).alias(c) for c, d in digits.items()))


@query(f"{B}, n AS (SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM days) SELECT date, nx IS NULL OR date_trunc('week', date) <> date_trunc('week', nx) AS week_end, nx IS NULL OR date_trunc('month', date) <> date_trunc('month', nx) AS month_end FROM n")
def period_ends(spark, sf_dir):
    return backtest.period_ends(synthetic.daily_bars(spark, sf_dir))


def _equal(prices):
    best = sorted(prices)[:5]
    return {s: 1 / len(best) for s in best}


@query()
def simulate_equal_weight(spark, sf_dir):
    return backtest.simulate(synthetic.daily_bars(spark, sf_dir), _equal, "month", 1e6)


# data quality

_Q = f"WITH {INTRADAY_SQL}, q AS (SELECT symbol, date, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (WHERE volume = 0) AS zero_volume FROM ibars GROUP BY symbol, date), dq AS (SELECT *, bars / 48.0 AS coverage, bars / 48.0 <= 0.6 AS half_day, bars >= 48 AS complete FROM q)"


@query(f"{_Q} SELECT symbol, date, bars, first_ts, last_ts, zero_volume, {rd('coverage')} AS coverage, half_day, complete FROM dq")
def bar_quality(spark, sf_dir):
    days = quality.bars_per_day(synthetic.intraday_bars(spark, sf_dir), 48)
    return days.withColumns({"first_ts": F.col("first_ts").cast("timestamp_ntz"), "last_ts": F.col("last_ts").cast("timestamp_ntz"), "coverage": r("coverage")})


@query(f"{_Q} SELECT symbol, count(*) AS days, {rd('avg(bars)')} AS mean_bars, median(bars)::DOUBLE AS median_bars, min(bars) AS min_bars, max(bars) AS max_bars, count(*) FILTER (WHERE complete) AS complete_days, count(*) FILTER (WHERE half_day) AS half_days FROM dq GROUP BY symbol")
def symbol_quality(spark, sf_dir):
    return quality.symbol_summary(quality.bars_per_day(synthetic.intraday_bars(spark, sf_dir), 48)).withColumn("mean_bars", r("mean_bars"))


@query(f"{_Q}, e AS (SELECT * FROM (VALUES (0, 10), (10, 20), (20, 30), (30, 40), (40, 48), (48, NULL)) v(lo, hi)) SELECT CAST(lo AS INTEGER) AS lo, count(*) AS n FROM dq JOIN e ON bars >= lo AND (hi IS NULL OR bars < hi) GROUP BY lo")
def bar_histogram(spark, sf_dir):
    return quality.histogram(quality.bars_per_day(synthetic.intraday_bars(spark, sf_dir), 48)).select("lo", "n")


@query(f"{_Q} SELECT q.symbol, q.date, m.ts FROM q JOIN mins m USING (date) WHERE m.ts BETWEEN first_ts AND last_ts EXCEPT SELECT symbol, date, ts FROM ibars")
def missing_minutes(spark, sf_dir):
    return quality.missing_minutes(synthetic.intraday_bars(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"WITH {INTRADAY_SQL} SELECT strftime(ts, '%H:%M') AS time, count(*) AS n, {rd('count(*) / (SELECT count(DISTINCT (symbol, date)) FROM ibars)::DOUBLE')} AS share FROM ibars GROUP BY 1")
def minute_coverage(spark, sf_dir):
    return quality.coverage_by_time(synthetic.intraday_bars(spark, sf_dir)).select("time", "n", r("share").alias("share"))


@query(f"WITH {INTRADAY_SQL}, g AS (SELECT symbol, date, date_diff('minute', lag(ts) OVER (PARTITION BY symbol, date ORDER BY ts), ts)::DOUBLE AS gap FROM ibars) SELECT symbol, date, count(*) FILTER (WHERE gap > 30) AS gaps, max(gap) AS longest FROM g GROUP BY symbol, date")
def bar_gaps(spark, sf_dir):
    return quality.gaps(synthetic.intraday_bars(spark, sf_dir))


# streaming operators, over the same rows as a batch


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, event_type AS symbol, round(first(value ORDER BY ts, value), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(last(value ORDER BY ts, value), 6) AS close, count(*) AS volume FROM events GROUP BY ALL")
def tick_bars(spark, sf_dir):
    ticks = synthetic.table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.lit(1).alias("size"))
    return flows.bars(ticks).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "symbol", *(F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")), "volume")


@query("WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS events FROM b GROUP BY user_id, s")
def user_sessions(spark, sf_dir):
    rows = flows.sessions(synthetic.table(spark, sf_dir, "events"))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
