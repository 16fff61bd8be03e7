"""Portfolio simulation by joins: orders fill at the symbol's next bar, positions and cash are running sums.

Strategies whose size depends on the portfolio's own value run in `simulate`, one task a run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.kernels import div, week_end


def fills(orders: DataFrame, bars: DataFrame, cost_rate: float = 0.0) -> DataFrame:
    """Orders (order_id, symbol, date, quantity; negative sells) filled at the close of the symbol's next bar; the last bar's never."""
    nxt = bars.select("symbol", "date", F.lead("date").over(Window.partitionBy("symbol").orderBy("date")).alias("fill_date"), F.lead("close").over(Window.partitionBy("symbol").orderBy("date")).alias("price"))
    out = orders.join(nxt, ["symbol", "date"]).where("fill_date is not null and price is not null")
    return out.select("order_id", "symbol", F.col("fill_date").alias("date"), "quantity", "price", (F.abs(F.col("quantity") * F.col("price")) * cost_rate).alias("commission"))


def level_orders(signals: DataFrame, lots: int = 100) -> DataFrame:
    """Orders that enter on LONG or BUY and leave on OUT, FLAT or SELL: the changes of a 0 or 1 target."""
    w = Window.partitionBy("symbol").orderBy("date")
    target = F.when(F.col("signal").isin("LONG", "BUY"), 1).when(F.col("signal").isin("OUT", "FLAT", "SELL"), 0)
    rows = signals.select("symbol", "date", F.coalesce(F.last(target, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("target"))
    rows = rows.withColumn("quantity", (F.col("target") - F.coalesce(F.lag("target").over(w), F.lit(0))) * lots)
    return rows.where("quantity != 0").select(F.concat_ws("-", "symbol", "date").alias("order_id"), "symbol", "date", "quantity")


def equity_curve(filled: DataFrame, bars: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """date, cash, holdings and total after each date: quantities at the last close seen, cash less costs."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    days = bars.select("date").distinct()
    names = filled.select("symbol").distinct()
    moves = filled.groupBy("symbol", "date").agg(F.sum("quantity").alias("q"))
    grid = days.crossJoin(names).join(bars.select("symbol", "date", "close"), ["symbol", "date"], "left").join(moves, ["symbol", "date"], "left")
    held = grid.select("date", F.sum(F.coalesce("q", F.lit(0))).over(w).alias("q"), F.last("close", True).over(w).alias("close"))
    holdings = held.groupBy("date").agg(F.sum(F.coalesce(F.col("q") * F.col("close"), F.lit(0.0))).alias("holdings"))
    spent = filled.groupBy("date").agg(F.sum(F.col("quantity") * F.col("price") + F.col("commission")).alias("spent"))
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    out = days.join(holdings, "date", "left").join(spent, "date", "left").select("date", (F.lit(capital) - F.coalesce(F.sum("spent").over(run), F.lit(0.0))).alias("cash"), F.coalesce("holdings", F.lit(0.0)).alias("holdings"))
    return out.withColumn("total", F.col("cash") + F.col("holdings"))


def drawdowns(curve: DataFrame) -> DataFrame:
    """date, drawdown from the running maximum, and the number of the spell under water (spells are told by the peaks before them)."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    rows = curve.select("date", "total", F.max("total").over(w).alias("peak")).withColumn("drawdown", div(F.col("total") - F.col("peak"), "peak"))
    return rows.select("date", "total", "drawdown", F.sum((F.col("drawdown") >= 0).cast("int")).over(w).alias("spell"))


def metrics(curve: DataFrame, capital: float = 100_000.0, risk_free: float = 0.0, year: int = 252) -> DataFrame:
    """One row of return and risk figures of an equity curve."""
    w = Window.orderBy("date")  # one row a date
    free = (1 + risk_free) ** (1 / year) - 1
    rows = drawdowns(curve).withColumn("r", div("total", F.lag("total").over(w)) - 1 - free)
    longest = rows.groupBy("spell").agg(F.sum((F.col("drawdown") < 0).cast("int")).alias("n")).agg(F.max("n").alias("max_dd_duration"))
    one = rows.agg(F.max_by("total", "date").alias("final_value"), F.count("*").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("d"), F.min("drawdown").alias("max_drawdown"))
    total = F.col("final_value") / capital - 1
    one = one.withColumn("total_return", total).withColumn("annual_return", F.pow(1 + F.col("total_return"), year / F.col("n")) - 1)
    return one.crossJoin(longest).select(
        "total_return", "annual_return", F.coalesce(div("m", "s") * year**0.5, F.lit(0.0)).alias("sharpe_ratio"), F.coalesce(div("m", "d") * year**0.5, F.lit(0.0)).alias("sortino_ratio"),
        "max_drawdown", "max_dd_duration", F.coalesce(div("annual_return", F.abs("max_drawdown")), F.lit(0.0)).alias("calmar_ratio"), "final_value",
    )


def fifo_matches(filled: DataFrame) -> DataFrame:
    """Closed lots, first in first out: buys and sells of a symbol are intervals of cumulated quantity, matches their overlaps.

    filled: symbol, date, order_id, quantity (negative sells), price. A sale of more than is held is short of matches; shares
    sold before they are bought don't match later purchases, as the closed quantity is capped by what was bought so far.
    """
    w = Window.partitionBy("symbol").orderBy("date", "order_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = filled.withColumns({"buy": F.sum(F.greatest("quantity", F.lit(0))).over(w), "flow": F.sum("quantity").over(w)})
    # sales beyond the holding are void: the lowest running balance so far is what was oversold
    rows = rows.withColumn("over", F.least(F.min("flow").over(w), F.lit(0)))
    sold = F.col("buy") - (F.col("flow") - F.col("over"))
    rows = rows.withColumn("closed", sold).withColumn("closed_before", F.coalesce(F.lag("closed").over(Window.partitionBy("symbol").orderBy("date", "order_id")), F.lit(0)))
    # the ends of all intervals in one sort: between two of them one purchase meets one sale
    buy = F.when(F.col("quantity") > 0, F.struct(F.col("buy").alias("end"), F.col("price"), F.col("order_id").alias("id")))
    sell = F.when((F.col("quantity") < 0) & (F.col("closed") > F.col("closed_before")), F.struct(F.col("closed").alias("end"), F.col("price"), F.col("order_id").alias("id")))
    at = F.when(buy.isNotNull(), F.col("buy") - F.col("quantity")).otherwise(F.col("closed_before"))
    points = rows.select("symbol", at.alias("at"), buy.alias("b"), sell.alias("s")).where("b is not null or s is not null")
    order = Window.partitionBy("symbol").orderBy("at")
    seen = order.rangeBetween(Window.unboundedPreceding, 0)
    points = points.withColumns({"b": F.last("b", True).over(seen), "s": F.last("s", True).over(seen), "next": F.min("at").over(order.rangeBetween(1, Window.unboundedFollowing))})
    points = points.groupBy("symbol", "at").agg(F.first("b").alias("b"), F.first("s").alias("s"), F.first("next").alias("next"))
    size = F.least("b.end", "s.end", F.coalesce("next", "b.end")) - F.col("at")
    matched = points.where("b is not null and s is not null").withColumn("quantity", size).where("quantity > 0")
    return matched.select("symbol", F.col("b.id").alias("buy_id"), F.col("s.id").alias("sell_id"), "quantity", ((F.col("s.price") - F.col("b.price")) * F.col("quantity")).alias("pnl"))


def trade_statistics(matches: DataFrame) -> DataFrame:
    win, loss = F.col("pnl") > 0, F.col("pnl") <= 0
    wins, losses = F.sum(F.when(win, F.col("pnl"))), F.sum(F.when(loss, F.col("pnl")))
    return matches.agg(
        F.count("*").alias("trades"), F.coalesce(F.avg(win.cast("int")), F.lit(0.0)).alias("win_rate"), F.coalesce(F.avg(F.when(win, F.col("pnl"))), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(loss, F.col("pnl"))), F.lit(0.0)).alias("avg_loss"), div(wins, F.abs(losses)).alias("profit_factor"),
    )


def period_ends(bars: DataFrame) -> DataFrame:
    """date, week_end, month_end: whether the next trading date is in another ISO week or month, or there is none."""
    w = Window.orderBy("date")  # one row a date
    days = bars.select("date").distinct().withColumn("next", F.lead("date").over(w))
    other = lambda part: F.col("next").isNull() | (F.date_trunc(part, "date") != F.date_trunc(part, "next"))
    return days.select("date", other("week").alias("week_end"), other("month").alias("month_end"))


def simulate(bars: DataFrame, strategy: Callable[[dict], dict[str, float] | None], schedule: str = "week", capital: float = 100_000.0, run: str = "run_id") -> DataFrame:
    """Rebalancing to target weights of the portfolio's own value: run_id, date, cash, holdings, total.

    strategy gets {symbol: close} of a date and gives target weights, or None to keep. Names not among the targets are
    sold, the rest gets int(value * weight / close) shares; orders fill at each symbol's next close. The path depends on
    itself, so a run is one task; many runs (a column `run_id` in bars) go in parallel.
    """

    def one(key, pdf):
        wide = pdf.pivot_table(index="date", columns="symbol", values="close").sort_index()
        dates = list(wide.index)
        period = {"day": list(range(len(dates))), "week": [pd.Timestamp(d).isocalendar()[:2] for d in dates], "month": [(pd.Timestamp(d).year, pd.Timestamp(d).month) for d in dates]}[schedule]
        cash, held, pending, last, out = capital, {}, {}, {}, []
        for i, day in enumerate(dates):
            now = wide.loc[day].dropna().to_dict()
            last |= now
            for s in [s for s in pending if s in now]:
                q = pending.pop(s)
                cash -= q * now[s]
                held[s] = held.get(s, 0) + q
            value = cash + sum(q * last[s] for s, q in held.items())
            out.append((key[0], day, cash, value - cash, value))
            if i + 1 == len(dates) or period[i + 1] != period[i]:
                weights = strategy(now)
                if weights is not None:
                    pending = {s: -q for s, q in held.items() if q and s not in weights}
                    for s, x in weights.items():
                        if now.get(s):
                            change = int(value * x / now[s]) - held.get(s, 0)
                            if change:
                                pending[s] = change
        return pd.DataFrame(out, columns=["run_id", "date", "cash", "holdings", "total"])

    rows = bars if run in bars.columns else bars.withColumn(run, F.lit("0"))
    return rows.select(F.col(run).cast("string").alias("run_id"), "date", "symbol", "close").groupBy("run_id").applyInPandas(one, "run_id string, date date, cash double, holdings double, total double")


def compare(bars: DataFrame, strategies: dict[str, Callable[[DataFrame], DataFrame]] | None = None, capital: float = 100_000.0, cost_rate: float = 0.001) -> DataFrame:
    """Every strategy on every symbol alone: strategy, symbol, total_return, max_drawdown, volatility and fills, in one plan.

    strategies: from bars to signals (symbol, date, signal). All the capital is in the symbol or in cash; a change of the signal is filled
    at the next close, at a cost of the traded value.
    """
    from tidemark.operators import signals

    strategies = strategies or {
        "buy_and_hold": signals.buy_and_hold, "sma_cross": signals.sma_level, "rsi": signals.rsi_simple, "hht": signals.hht,
        "qrs": lambda b: signals.qrs(b).withColumnRenamed("level", "signal"),
    }
    parts = [f(bars).select(F.lit(n).alias("strategy"), "symbol", "date", "signal") for n, f in strategies.items()]
    rows = reduce(DataFrame.unionByName, parts).join(bars.select("symbol", "date", "close"), ["symbol", "date"])
    w = Window.partitionBy("strategy", "symbol").orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    target = F.when(F.col("signal").isin("LONG", "BUY"), 1).when(F.col("signal").isin("OUT", "FLAT", "SELL"), 0)
    rows = rows.withColumn("target", F.coalesce(F.last(target, True).over(run), F.lit(0)))
    # held from the close after the signal on: its return is the next one's
    rows = rows.withColumns({"held": F.coalesce(F.lag("target", 2).over(w), F.lit(0)), "now": F.coalesce(F.lag("target", 1).over(w), F.lit(0)), "r": F.coalesce(div("close", F.lag("close").over(w)) - 1, F.lit(0.0))})
    rows = rows.withColumn("gain", F.col("held") * F.col("r") - F.abs(F.col("now") - F.col("held")) * cost_rate)
    rows = rows.withColumn("wealth", F.exp(F.sum(F.log(F.greatest(1 + F.col("gain"), F.lit(1e-12)))).over(run)))
    rows = rows.withColumn("down", F.col("wealth") / F.greatest(F.max("wealth").over(run), F.lit(1.0)) - 1)
    return rows.groupBy("strategy", "symbol").agg(
        (F.max_by("wealth", "date") - 1).alias("total_return"), F.min("down").alias("max_drawdown"), (F.stddev_samp("gain") * 252**0.5).alias("volatility"),
        F.sum(F.abs(F.col("now") - F.col("held"))).alias("fills"), (F.lit(capital) * F.max_by("wealth", "date")).alias("final_value"),
    )


def weekly_orders(weights: DataFrame, lots_value: float = 10_000.0) -> DataFrame:
    """Orders of a fixed amount of money for weights by (date, symbol, price), no feedback from the portfolio."""
    return weights.select(F.concat_ws("-", "symbol", "date").alias("order_id"), "symbol", "date", F.floor(F.lit(lots_value) * F.col("weight") / F.nullif("price", F.lit(0))).cast("long").alias("quantity"), week_end("date").alias("week"))
