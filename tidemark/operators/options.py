"""Option pricing, surfaces, iron-condor selection, risk rules and the trade log.

Chains: symbol, expiration, type (call, put), strike, bid, ask, last, iv, spot, years (time to expiry).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.kernels import div


#: Numerator and denominator of a rational form of the normal tail over its density, good to 15 digits up to 7.07 (Hart, 1968).
_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _tail(size, exp, where, low):
    """The probability beyond `size` >= 0, of columns or arrays alike. Above 7.07 a continued fraction."""
    def horner(terms):
        total = terms[0]
        for c in terms[1:]:
            total = total * size + c
        return total

    far = size + 0.65
    for n in (4, 3, 2, 1):
        far = size + n / far
    density = exp(-size * size / 2)
    return where(size < 7.07106781186547, density * horner(_TOP) / horner(_BOTTOM), where(size < 37.0, density / (far * math.sqrt(2 * math.pi)), low))


def normal_cdf(x) -> Column:
    """Standard normal distribution."""
    x = F.col(x) if isinstance(x, str) else x
    tail = _tail(F.abs(x), F.exp, lambda c, a, b: F.when(c, a).otherwise(b), F.lit(0.0))
    return F.when(x.isNotNull(), F.when(x > 0, 1 - tail).otherwise(tail))


def normal_cdf_array(x):
    """The same of a NumPy array."""
    import numpy as np

    tail = _tail(np.abs(x), np.exp, np.where, 0.0)
    return np.where(x > 0, 1 - tail, tail)


def black_scholes(kind, spot, strike, years, rate, dividend, sigma) -> Column:
    """Price of a European option with a dividend yield."""
    kind, spot, strike, years, sigma = (F.col(x) if isinstance(x, str) else x for x in (kind, spot, strike, years, sigma))
    root = sigma * F.sqrt(years)
    d1 = (F.log(spot / F.nullif(strike, F.lit(0.0))) + (rate - dividend + sigma * sigma / 2) * years) / F.nullif(root, F.lit(0.0))
    d2 = d1 - root
    s, k = spot * F.exp(-dividend * years), strike * F.exp(-rate * years)
    call = s * normal_cdf(d1) - k * normal_cdf(d2)
    return call + F.when(kind == "call", 0.0).otherwise(k - s)  # parity


def vega(spot, strike, years, rate, dividend, sigma) -> Column:
    spot, strike, years, sigma = (F.col(x) if isinstance(x, str) else x for x in (spot, strike, years, sigma))
    d1 = (F.log(spot / F.nullif(strike, F.lit(0.0))) + (rate - dividend + sigma * sigma / 2) * years) / F.nullif(sigma * F.sqrt(years), F.lit(0.0))
    return spot * F.exp(-dividend * years) * F.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi) * F.sqrt(years)


def implied_volatility(rate: float = 0.045, dividend: float = 0.013, start: float = 0.4, rounds: int = 50, tolerance: float = 1e-5):
    """Vectorised function of (kind, price, spot, strike, years): Newton's method from `start`; NULL where vega vanishes or it doesn't converge."""
    import numpy as np

    @F.pandas_udf("double")
    def solve(kind: pd.Series, price: pd.Series, spot: pd.Series, strike: pd.Series, years: pd.Series) -> pd.Series:
        cdf = normal_cdf_array
        call = (kind == "call").to_numpy()
        p, s, k, t = (x.to_numpy(float) for x in (price, spot, strike, years))
        sigma = np.full(len(p), start)
        done, dead = np.zeros(len(p), bool), ~(np.isfinite(p) & (s > 0) & (k > 0) & (t > 0))
        for _ in range(rounds):
            i = np.flatnonzero(~done & ~dead)
            if not len(i):
                break
            v, root = sigma[i], np.sqrt(t[i])
            d1 = (np.log(s[i] / k[i]) + (rate - dividend + v * v / 2) * t[i]) / (v * root)
            d2 = d1 - v * root
            a, b = s[i] * np.exp(-dividend * t[i]), k[i] * np.exp(-rate * t[i])
            value = np.where(call[i], a * cdf(d1) - b * cdf(d2), b * cdf(-d2) - a * cdf(-d1))
            slope = a * np.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi) * root
            off = value - p[i]
            done[i] = np.abs(off) < tolerance
            dead[i] |= ~done[i] & (slope < 1e-8)
            move = ~done[i] & (slope >= 1e-8)
            sigma[i[move]] -= off[move] / slope[move]
            dead[i] |= (sigma[i] <= 0) | ~np.isfinite(sigma[i])
        return pd.Series(np.where(done & ~dead, sigma, np.nan)).replace({np.nan: None}).astype(float)

    return solve


def out_of_the_money(chain: DataFrame) -> DataFrame:
    return chain.where(((F.col("type") == "call") & (F.col("strike") > F.col("spot"))) | ((F.col("type") == "put") & (F.col("strike") < F.col("spot"))))


def surface(chain: DataFrame, min_years: float = 0.015, min_price: float = 0.05, low: float = 0.05, high: float = 1.5) -> DataFrame:
    """Usable out-of-the-money points: expiration, strike, moneyness, years, iv."""
    mid = (F.col("bid") + F.col("ask")) / 2
    rows = out_of_the_money(chain).withColumn("mid", mid).where((F.col("years") > min_years) & (F.col("mid") > min_price) & F.col("iv").between(low, high))
    return rows.select("symbol", "expiration", "type", "strike", div("strike", "spot").alias("moneyness"), "years", "mid", "iv")


def term_structure(points: DataFrame) -> DataFrame:
    """The point nearest to the money of each expiration."""
    return points.groupBy("symbol", "expiration").agg(F.min_by(F.struct("strike", "years", "iv"), F.struct(F.abs(F.col("moneyness") - 1), "strike", "type")).alias("p")).select("symbol", "expiration", "p.strike", "p.years", "p.iv")


def nearest_expiries(chain: DataFrame, as_of, targets: tuple[int, ...] = (7, 30, 60, 90, 180, 365)) -> DataFrame:
    """The expiration nearest to each target number of days, each once."""
    days = F.broadcast(chain.sparkSession.createDataFrame([(t,) for t in targets], "target int"))  # a row a target
    each = chain.select("symbol", "expiration").distinct().crossJoin(days).withColumn("dte", F.datediff("expiration", F.lit(as_of).cast("date"))).where("dte > 0")
    return each.groupBy("symbol", "target").agg(F.min_by("expiration", F.struct(F.abs(F.col("dte") - F.col("target")), "expiration")).alias("expiration")).select("symbol", "expiration").distinct()


def entry_allowed(market: DataFrame, vix_low: float = 12, vix_high: float = 30, spike: float = 0.15, start: str = "09:45:00", end: str = "11:30:00") -> DataFrame:
    """Adds `enter`: VIX within its band and not up by more than `spike` since the close before, at a time within the window."""
    up = div(F.col("vix") - F.col("vix_before"), "vix_before")
    ok = F.col("vix").between(vix_low, vix_high) & (F.coalesce(up, F.lit(0.0)) <= spike) & F.date_format("ts", "HH:mm:ss").between(start, end)
    return market.withColumn("enter", F.coalesce(ok, F.lit(False)))


def strike_grid(spots: DataFrame, width: float = 0.05, step: int = 5, coarse: int | None = None) -> DataFrame:
    """symbol and strikes in steps within +-width of the spot; with `coarse` (say 25) only its multiples."""
    step = coarse or step
    low, high = (F.floor(F.col("spot") * (1 - width) / step) * step).cast("int"), (F.ceil(F.col("spot") * (1 + width) / step) * step).cast("int")
    return spots.select("symbol", "spot", F.explode(F.sequence(low, high, F.lit(step))).alias("strike"))


def condor_legs(quotes: DataFrame, max_delta: float = 0.2, target_delta: float = 0.15, distance: float = 0.01, width: float = 10.0) -> DataFrame:
    """symbol, expiration and the four strikes: short legs nearest to the target delta among those far enough out, wings `width` away.

    quotes: symbol, expiration, type, strike, spot, delta. Of equal distances the lower strike; without either side no row.
    """
    far = F.when(F.col("type") == "put", F.col("strike") <= F.col("spot") * (1 - distance)).otherwise(F.col("strike") >= F.col("spot") * (1 + distance))
    ok = quotes.where(far & (F.abs("delta") <= max_delta))
    best = lambda kind: F.min_by("strike", F.when(F.col("type") == kind, F.struct(F.abs(F.abs("delta") - target_delta), "strike")))
    legs = ok.groupBy("symbol", "expiration").agg(best("put").alias("short_put"), best("call").alias("short_call")).where("short_put is not null and short_call is not null")
    return legs.select("symbol", "expiration", (F.col("short_put") - width).alias("long_put"), "short_put", "short_call", (F.col("short_call") + width).alias("long_call"))


def reward_gate(condors: DataFrame, least: float = 0.10, credit: str = "credit") -> DataFrame:
    """Adds reward_risk, credit over the rest of the wider wing, and `accepted`."""
    wing = F.greatest(F.col("short_put") - F.col("long_put"), F.col("long_call") - F.col("short_call"))
    rows = condors.withColumn("reward_risk", div(F.col(credit) * 100, wing * 100 - F.col(credit) * 100))
    return rows.withColumn("accepted", F.coalesce(F.col("reward_risk") >= least, F.lit(False)))


def risk_actions(snapshots: DataFrame, proximity: float = 0.005, red_delta: float = 30.0, delta_multiplier: float = 1.0, take_profit: float = 0.5, stop: float = 2.0, min_days: int | None = None, close_at: str | None = "15:45:00") -> DataFrame:
    """Adds `action` by priority: end of day, proximity or delta, profit or loss, time.

    snapshots: ts, spot, short_put, short_call, put_delta, call_delta, credit, combo_mid, dte.
    Price limits are rounded to 8 digits: 4010 * (1 + 0.005) would be a little below 4030.05 and miss a spot right at it.
    """
    limit = lambda price, factor: F.round(F.col(price) * factor, 8)
    near = (F.col("spot") <= limit("short_put", 1 + proximity)) | (F.col("spot") >= limit("short_call", 1 - proximity))
    delta = F.abs(F.col("put_delta") + F.col("call_delta")) * delta_multiplier >= red_delta
    action = F.when(F.date_format("ts", "HH:mm:ss") >= close_at, "CLOSE_EOD") if close_at else F.when(F.lit(False), "")
    action = action.when(near, "CLOSE_PROXIMITY").when(delta, "CLOSE_DELTA").when(F.col("combo_mid") <= limit("credit", 1 - take_profit), "TAKE_PROFIT").when(F.col("combo_mid") >= limit("credit", stop), "STOP_LOSS")
    if min_days is not None:
        action = action.when(F.col("dte") <= min_days, "TIME_EXIT")
    return snapshots.withColumn("action", action.otherwise("HOLD"))


def combo_mid(legs: DataFrame) -> DataFrame:
    """symbol, expiration and the middle price of a condor sold: short legs less long ones. legs: side (short, long), bid, ask."""
    mid = (F.col("bid") + F.col("ask")) / 2
    return legs.groupBy("symbol", "expiration").agg(F.sum(F.when(F.col("side") == "short", mid).otherwise(-mid)).alias("combo_mid"))


def round_trips(log: DataFrame) -> DataFrame:
    """Closed trades: each closing fill takes the earliest opening fill left of its expiry, as many as both have; the rest of either is void.

    log: seq, event (ORDER, FILL), order_id, action, expiry, reason, fill_price, qty, commission.
    A closing fill before its opening one pairs with nothing, so pairs are those at equal depth once voids are skipped.
    """
    orders = log.where("event = 'ORDER'").groupBy("order_id").agg(F.min("seq").alias("o_seq"), F.first("action").alias("action"), F.first("expiry").alias("expiry"), F.first("reason").alias("reason"))
    filled = log.where("event = 'FILL'").select("order_id", "seq", "fill_price", "qty", "commission").join(orders, "order_id")
    w = Window.partitionBy("expiry").orderBy("o_seq", "seq").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("action") == "open", 1).when(F.col("action") == "close", -1).otherwise(0)
    rows = filled.withColumn("level", F.sum(step).over(w)).withColumn("void", F.least(F.min("level").over(w), F.lit(0)))
    rows = rows.withColumn("opens", F.sum((F.col("action") == "open").cast("int")).over(w))
    before = F.coalesce(F.lag("void").over(Window.partitionBy("expiry").orderBy("o_seq", "seq")), F.lit(0))
    rows = rows.withColumn("ok", F.col("void") == before)
    rows = rows.withColumn("closes", F.sum(F.when((F.col("action") == "close") & F.col("ok"), 1).otherwise(0)).over(w))
    a = rows.where("action = 'open'").select("expiry", F.col("opens").alias("k"), F.col("fill_price").alias("credit"), F.col("qty").alias("q1"), F.col("commission").alias("c1"))
    b = rows.where("action = 'close' and ok").select("expiry", F.col("closes").alias("k"), "reason", F.col("fill_price").alias("debit"), F.col("qty").alias("q2"), F.col("commission").alias("c2"))
    both = a.join(b, ["expiry", "k"])
    gross = (F.col("credit") - F.col("debit")) * 100 * F.least("q1", "q2")
    return both.select("expiry", "k", "reason", "credit", "debit", F.least("q1", "q2").alias("qty"), gross.alias("gross_pnl"), (F.col("c1") + F.col("c2")).alias("commission"), (gross - F.col("c1") - F.col("c2")).alias("net_pnl"))


def legacy_trips(log: DataFrame) -> DataFrame:
    """Closed trades of logs of the older form, whose CLOSE rows carry their result: expiry, k (their order) and net_pnl. log: seq, event, expiry, pnl."""
    place = F.row_number().over(Window.partitionBy("expiry").orderBy("seq"))
    return log.where("event = 'CLOSE' and pnl is not null").select("expiry", place.alias("k"), F.col("pnl").alias("net_pnl"))


def all_trips(log: DataFrame) -> DataFrame:
    """Closed trades of a log in either form, or both one after the other."""
    new = round_trips(log).select("expiry", "k", "net_pnl")
    return new.unionByName(legacy_trips(log).withColumn("k", F.col("k") + 1_000_000)) if "pnl" in log.columns else new


def trade_summary(trips: DataFrame, tail: float = -500.0) -> DataFrame:
    """One row: trades, net result, win rate, averages, largest loss from a peak, and how many losses are below `tail`."""
    w = Window.orderBy("expiry", "k").rowsBetween(Window.unboundedPreceding, 0)  # one row a closed trade
    rows = trips.withColumn("total", F.sum("net_pnl").over(w)).withColumn("peak", F.greatest(F.max("total").over(w), F.lit(0.0)))
    win = F.col("net_pnl") > 0
    return rows.agg(
        F.count("*").alias("total_trades"), F.coalesce(F.sum("net_pnl"), F.lit(0.0)).alias("net_pnl"), F.avg(win.cast("int")).alias("win_rate"), F.avg(F.when(win, F.col("net_pnl"))).alias("avg_win"),
        F.avg(F.when(~win, F.col("net_pnl"))).alias("avg_loss"), F.coalesce(F.max(F.col("peak") - F.col("total")), F.lit(0.0)).alias("max_drawdown"), F.count_if(F.col("net_pnl") < tail).alias("tail_losses"),
    )
