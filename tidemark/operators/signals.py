"""Timing signals from daily bars and the decisions drawn from them. Windows count a symbol's own rows; bars carry `date`."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.kernels import div, ols_score, rolling, zscore


def _own() -> Window:
    return Window.partitionBy("symbol").orderBy("date")


def hht(bars: DataFrame, average: int = 60, window: int = 30) -> DataFrame:
    """Phase of the analytic signal of the change of a moving average, and BUY within a quarter turn of zero, else FLAT.

    The Hilbert transform at a window's last point is a fixed dot product with lagged values, so no transform is run;
    NULL with fewer than average + window bars.
    """
    w = _own()
    rows = bars.select("symbol", "date", "close", F.row_number().over(w).alias("n"), rolling(F.avg, "close", average, average, w).alias("ma"))
    rows = rows.withColumn("d", F.col("ma") - F.lag("ma").over(w))
    imaginary: Column = F.lit(0.0)
    for m in range(1, window, 2):
        imaginary = imaginary + F.lag("d", m).over(w) * (2 / window / math.tan(math.pi * m / window))
    enough = (F.col("n") >= average + window) & F.lag("d", window - 1).over(w).isNotNull()
    rows = rows.select("symbol", "date", F.when(enough, F.atan2(imaginary, F.col("d"))).alias("phase"), F.when(enough, F.col("d")).alias("d"))
    return rows.select("symbol", "date", "phase", F.when(F.col("d") >= 0, "BUY").when(F.col("d") < 0, "FLAT").alias("signal"))


def qrs(bars: DataFrame, n: int = 18, window: int = 250, upper: float = 0.7, lower: float = -0.7) -> DataFrame:
    """Slope of high on low over n bars as a z-score of the last `window` slopes (population deviation), times the fit.

    level: above upper BUY, below lower SELL, else HOLD. crossing: the bar on which it goes over or under.
    """
    w = _own()
    slope, fit = ols_score("high", "low", w, n)
    rows = bars.select("symbol", "date", slope.alias("beta"), fit.alias("r2"))
    frame = w.rowsBetween(1 - window, 0)
    full = F.count("beta").over(frame) >= window
    score = F.when(full, div(F.col("beta") - F.avg("beta").over(frame), F.stddev_pop("beta").over(frame)) * F.col("r2"))
    rows = rows.withColumn("score", score)
    before = F.lag("score").over(w)
    return rows.select(
        "symbol", "date", "beta", "r2", "score", F.when(F.col("score") > upper, "BUY").when(F.col("score") < lower, "SELL").when(F.col("score").isNotNull(), "HOLD").alias("level"),
        F.when((before <= upper) & (F.col("score") > upper), "BUY").when((before >= lower) & (F.col("score") < lower), "SELL").alias("crossing"),
    )


def sma_level(bars: DataFrame, short: int = 50, long: int = 200) -> DataFrame:
    w = _own()
    rows = bars.select("symbol", "date", rolling(F.avg, "close", short, short, w).alias("sma_short"), rolling(F.avg, "close", long, long, w).alias("sma_long"))
    return rows.withColumn("signal", F.when(F.col("sma_short") > F.col("sma_long"), "LONG").when(F.col("sma_long").isNotNull(), "OUT"))


def rsi_simple(bars: DataFrame, n: int = 14, low: float = 30, high: float = 70) -> DataFrame:
    """Relative strength of plain means of gains and losses: 50 with too few bars, 100 without a loss."""
    w = _own()
    change = F.col("close") - F.lag("close").over(w)
    rows = bars.select("symbol", "date", change.alias("d"))
    frame = w.rowsBetween(1 - n, 0)
    gain, loss = F.sum(F.when(F.col("d") > 0, F.col("d")).otherwise(0.0)).over(frame) / n, F.sum(F.when(F.col("d") < 0, -F.col("d")).otherwise(0.0)).over(frame) / n
    value = F.when(F.count("d").over(frame) < n, 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + div(gain, loss)))
    return rows.select("symbol", "date", value.alias("rsi")).withColumn("signal", F.when(F.col("rsi") < low, "BUY").when(F.col("rsi") > high, "SELL").otherwise("HOLD"))


def momentum_weights(bars: DataFrame, momentum: int = 20, volatility: int = 60, every: int = 20) -> DataFrame:
    """Every `every` bars: names with positive momentum (a lag of momentum - 1 bars) weighted by inverse volatility of log returns."""
    w = _own()
    rows = bars.select("symbol", "date", "close", F.row_number().over(w).alias("n"), F.log(div("close", F.lag("close").over(w))).alias("r"))
    frame = w.rowsBetween(2 - volatility, 0)
    rows = rows.withColumns({
        "mom": div("close", F.lag("close", momentum - 1).over(w)) - 1,
        "vol": F.when(F.count("r").over(frame) >= volatility - 1, F.greatest(F.stddev_pop("r").over(frame), F.lit(1e-6))),
    }).where((F.col("n") % every == 0) & (F.col("mom") > 0) & F.col("vol").isNotNull())
    inverse = 1 / F.col("vol")
    return rows.select("symbol", "date", "mom", "vol", (inverse / F.sum(inverse).over(Window.partitionBy("date"))).alias("weight"))


def weekly_top(bars: DataFrame, n: int = 60, top: int = 5) -> DataFrame:
    """On the last bar of each week: the names with the highest sum of z-scores of momentum and inverse volatility."""
    from tidemark.functions.kernels import week_end

    w = _own()
    rows = bars.select("symbol", "date", "close", F.log(div("close", F.lag("close").over(w))).alias("r"))
    frame = w.rowsBetween(2 - n, 0)
    rows = rows.withColumns({
        "mom": div("close", F.lag("close", n - 1).over(w)) - 1, "inv": F.when(F.count("r").over(frame) >= n - 1, 1 / F.greatest(F.stddev_pop("r").over(frame), F.lit(1e-6))),
    }).where("mom is not null and inv is not null")
    last = bars.groupBy(week_end("date").alias("w")).agg(F.max("date").alias("date")).select("date")
    z = zscore(rows.join(last, "date", "left_semi"), ["mom", "inv"], sigma=None)
    z = z.withColumn("score", F.round(F.col("mom") + F.col("inv"), 9))  # what rounding leaves of equal sums is no order
    return z.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.desc_nulls_last("score"), "symbol"))).where(F.col("place") <= top).select("date", "symbol", "score", "place")


def buy_and_hold(bars: DataFrame) -> DataFrame:
    """LONG from a symbol's first bar on."""
    return bars.where("close is not null").select("symbol", "date", F.lit("LONG").alias("signal"))


def latest_signals(bars: DataFrame) -> DataFrame:
    """symbol, hht and qrs of each symbol's last bar; N/A where there are too few bars."""
    last = lambda rows, c, name: rows.groupBy("symbol").agg(F.coalesce(F.max_by(c, "date"), F.lit("N/A")).alias(name))
    return last(hht(bars), "signal", "hht").join(last(qrs(bars), "level", "qrs"), "symbol", "full")


def decide(hht_signal: Column, qrs_signal: Column, held: Column) -> tuple[Column, Column]:
    """Action and reason for a pair of signals and whether there is a position."""
    rules = [  # hht, qrs, held (None: either), action, reason
        ("N/A", "N/A", None, "N/A", "insufficient data"),
        ("BUY", "BUY", True, "HOLD", "both bullish, keep position"), ("BUY", "BUY", False, "BUY", "both bullish"),
        ("BUY", "SELL", None, "REVIEW", "conflicting signals"), ("BUY", None, True, "HOLD", "HHT bullish"), ("BUY", None, False, "CONSIDER BUY", "HHT bullish"),
        ("FLAT", "BUY", True, "REVIEW", "conflicting signals"), ("FLAT", "BUY", False, "CONSIDER BUY", "QRS bullish"),
        ("FLAT", "SELL", True, "SELL", "both bearish"), ("FLAT", "SELL", False, "-", "no position, no signal"),
        ("FLAT", None, True, "CONSIDER SELL", "HHT bearish"), ("FLAT", None, False, "-", "no buy signal"),
        ("N/A", "BUY", True, "HOLD", "QRS bullish"), ("N/A", "BUY", False, "CONSIDER BUY", "QRS bullish"),
        ("N/A", "SELL", True, "CONSIDER SELL", "QRS bearish"), ("N/A", "SELL", False, "-", "no position"), ("N/A", None, None, "-", "HHT insufficient data"),
    ]
    action = reason = None
    for h, q, p, a, why in rules:
        test = hht_signal == h
        test = test if q is None else test & (qrs_signal == q)
        test = test if p is None else test & (held == F.lit(p))
        action = F.when(test, a) if action is None else action.when(test, a)
        reason = F.when(test, why) if reason is None else reason.when(test, why)
    return action.otherwise("-"), reason.otherwise("")


def recommend(signals: DataFrame, positions: DataFrame) -> DataFrame:
    """Decisions for all symbols that have a signal or a position (symbol, quantity)."""
    both = signals.join(positions.groupBy("symbol").agg(F.sum("quantity").alias("quantity")), "symbol", "full").fillna("N/A", ["hht", "qrs"]).fillna(0, ["quantity"])
    action, reason = decide(F.col("hht"), F.col("qrs"), F.col("quantity") > 0)
    return both.select("symbol", "hht", "qrs", "quantity", action.alias("action"), reason.alias("reason"))
