"""The factor library: 46 factors in 11 groups, each (date, symbol, value) at daily frequency.

Daily groups take the dense grid of daily bars (`sources.bars.densify`), intraday ones the dense grid by day. A group
function computes all its factors with the shuffles of one; selecting one factor prunes the work of the others.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.kernels import (
    asof_backward, clip, composite, corr, div, ewm_mean, mean_distance, mean_std_composite, moderate, ols_score, rolling, rolling_mean_zscore, series, shift, volatility_flip, zscore,
)
from tidemark.sources.bars import densify

DAY = ["date", "symbol"]


# daily bars


def technical(grid: DataFrame) -> DataFrame:
    w = series()
    gain, loss = F.col("diff"), -F.col("diff")
    low, high = rolling(F.min, "low", 252, 126, w), rolling(F.max, "high", 252, 126, w)
    out = grid.withColumn("diff", F.col("close") - F.lag("close").over(w)).withColumns({
        "gain": F.when(gain.isNotNull(), F.greatest(gain, F.lit(0.0))), "loss": F.when(loss.isNotNull(), F.greatest(loss, F.lit(0.0))),
    })

    def rsi(n):
        ratio = div(ewm_mean("gain", n, n, w), ewm_mean("loss", n, n, w))
        return 100 - 100 / (1 + ratio)

    return out.select(*DAY, *(x.alias(n) for n, x in {
        "RS_12M": div(shift("close", 21, w), shift("close", 252, w)) - 1, "RS_6M": div(shift("close", 21, w), shift("close", 126, w)) - 1,
        "Range_52W": div(F.col("close") - low, high - low), "RSI_28W": rsi(140), "RSI_16W": rsi(80),
    }.items()))


def reversal(grid: DataFrame) -> DataFrame:
    w = series()
    before = F.lag("close").over(w)
    out = grid.select(*DAY, "t", (div("close", before) - 1).alias("interday_rev_volflip"), (div("close", "open") - 1).alias("intraday_rev_volflip"), (div("open", before) - 1).alias("overnight"))
    out = out.withColumn("overnight_rev_volflip", moderate("overnight"))
    names = ["interday_rev_volflip", "intraday_rev_volflip", "overnight_rev_volflip"]
    out = volatility_flip(out, names)
    out = zscore(out.withColumns({f"z{i}": F.col(n) for i, n in enumerate(names)}), ["z0", "z1", "z2"])
    return out.select(*DAY, *names, composite(["z0", "z1", "z2"]).alias("team_coin"))


# statements


def repair_filing_dates(statements: DataFrame) -> DataFrame:
    """A missing filing date of a fourth quarter is that of the year's annual row, else 90 days after the end."""
    annual = F.max(F.when(F.col("fiscal_period") == "FY", F.col("filing_date"))).over(Window.partitionBy("symbol", "fiscal_year"))
    return statements.withColumn("filing_date", F.coalesce("filing_date", F.when(F.col("fiscal_period") == "Q4", annual), F.date_add("end_date", 90)))


def quarterly(statements: DataFrame) -> DataFrame:
    """One row a quarter, the last filed; filing dates repaired first."""
    rows = repair_filing_dates(statements).where("timeframe = 'quarterly'")
    w = Window.partitionBy("symbol", "fiscal_year", "fiscal_period").orderBy(F.desc("filing_date"), F.desc("end_date"))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def point_in_time(statements: DataFrame, flows: tuple[str, ...], stocks: tuple[str, ...], dates: DataFrame, drop_q4: tuple[str, ...] = ()) -> DataFrame:
    """For each (date, symbol) of dates the statement known then: flows summed over four quarters, stocks as filed.

    A date sees the last filing not after it, even one whose value is missing.
    """
    w = Window.partitionBy("symbol").orderBy("filing_date", "end_date")
    rows = quarterly(statements).withColumns({c: rolling(F.sum, c, 4, 4, w) for c in flows})
    if drop_q4:
        rows = rows.withColumns({c: F.when(F.col("fiscal_period") != "Q4", F.col(c)) for c in drop_q4})
    last = Window.partitionBy("symbol", "filing_date").orderBy(F.desc("end_date"))
    rows = rows.withColumn("__n", F.row_number().over(last)).where("__n = 1")
    return asof_backward(dates, rows, "date", "filing_date", "symbol", [*flows, *stocks])


def quarter_scores(statements: DataFrame, n: int = 8) -> DataFrame:
    """symbol, filing_date, EPS_Score (slope times fit of n quarters of earnings per share) and Growth_Stability (fit of n yearly growths)."""
    w = Window.partitionBy("symbol").orderBy("end_date")
    rows = quarterly(statements).withColumn("k", F.row_number().over(w).cast("double"))
    before = F.lag("revenues", 4).over(w)
    rows = rows.withColumn("yoy", div(F.col("revenues") - before, F.abs(before)))
    slope, fit = ols_score("diluted_eps", "k", w, n)
    _, growth = ols_score("yoy", "k", w, n)
    return rows.select("symbol", "filing_date", (slope * fit).alias("EPS_Score"), growth.alias("Growth_Stability"))


def fundamental(grid: DataFrame, statements: DataFrame) -> DataFrame:
    from tidemark.sources.synthetic import FLOWS, STATEMENT_FIELDS

    stocks = tuple(c for c in STATEMENT_FIELDS if c not in FLOWS)
    flows = tuple(c for c in FLOWS if c != "diluted_eps")
    known = point_in_time(statements, flows, stocks, grid.select("date", "symbol", "t", "close"))
    known = asof_backward(known, quarter_scores(statements), "date", "filing_date", "symbol", ["EPS_Score", "Growth_Stability"])
    c = F.col
    worth = c("close") * c("shares")
    cash = c("operating_cash_flow") + c("investing_cash_flow")
    rate = clip(div("income_tax", "pretax_income"), F.lit(0.0), F.lit(0.5))
    extra = F.when(c("operating_cash_flow").isNotNull() & c("net_income").isNotNull(), F.greatest(c("operating_cash_flow") - c("net_income"), F.lit(0.0)))
    known = known.withColumn("fcf", cash)
    old = F.lag("fcf", 252).over(series())
    return known.select(*DAY, *(x.alias(n) for n, x in {
        "ROE": div("net_income", "equity"), "ROIC": div(c("operating_income") * (1 - rate), c("assets") - c("current_liabilities")),
        "EV_EBITDA": -div(worth + c("liabilities") - c("current_assets"), c("operating_income") + extra), "FCF_Yield": div(cash, worth), "PS": -div(worth, "revenues"),
        "FCF_Growth": div(c("fcf") - old, F.abs(old)), "EPS_Score": c("EPS_Score"), "Growth_Stability": c("Growth_Stability"),
    }.items()))


# intraday bars


def day_grid(intraday: DataFrame) -> DataFrame:
    """The dense grid by day: i is the position of the minute within its day, n_day their number."""
    grid = densify(intraday.select("date", "ts", "symbol", "open", "high", "low", "close", "volume"), ("date",), "ts").withColumnRenamed("t", "i")
    days = intraday.select("date", "ts").distinct().groupBy("date").agg(F.count("*").alias("n_day"))
    names = intraday.where("close is not null").select("symbol").distinct()
    full = grid.select("date", "ts", "i").distinct().crossJoin(names)
    return full.join(grid.drop("i"), ["date", "ts", "symbol"], "left").join(days, "date")


def _on_days(metrics: DataFrame, days: DataFrame) -> DataFrame:
    """Daily values on the dense grid of days and symbols, with t."""
    dates = days.select("date").distinct()
    dates = dates.withColumn("t", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))  # one row a day
    return dates.crossJoin(days.select("symbol").distinct()).join(metrics, DAY, "left")


def _minutes() -> Window:
    return Window.partitionBy("date", "symbol").orderBy("i")


def battle_daily(bars: DataFrame, min_bars: int = 30, min_valid: int = 20) -> DataFrame:
    """Sums of values weighted by rank: twice cumulating in ascending less descending order of a key, in closed form."""
    w = Window.partitionBy("date", "symbol").orderBy("ts")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("date", "symbol")
    high, low = F.max("close").over(run), F.min("close").over(run)
    rows = bars.select(*DAY, "ts", F.col("volume").cast("double").alias("volume"), F.count("*").over(whole).alias("n"), (div("close", F.lag("close", 5).over(w)) - 1).alias("ret5"),
                       ((div(F.col("close") - high, high) + div(F.col("close") - low, low)) / 2).alias("pos"), div(F.col("high") - F.col("low"), "close").alias("amp")).where(F.col("n") >= min_bars)

    def signed(value, key):
        ok = F.col(value).isNotNull() & F.col(key).isNotNull()
        rank = F.row_number().over(Window.partitionBy("date", "symbol", ok).orderBy(key, "ts"))
        size = F.sum(ok.cast("int")).over(whole)
        return F.when(ok & (size >= min_valid), F.col(value) * (size + 1 - 2 * rank))

    rows = rows.withColumns({"a": signed("volume", "ret5"), "b": signed("volume", "pos"), "c": signed("amp", "ret5")})
    return rows.groupBy(*DAY).agg(F.sum("a").alias("vol_battle_ret"), F.sum("b").alias("vol_battle_pos"), F.sum("c").alias("amp_battle"))


def battle(bars: DataFrame, min_bars: int = 30, min_valid: int = 20, window: int = 20, weekly: bool = False) -> DataFrame:
    names = ["vol_battle_ret", "vol_battle_pos", "amp_battle"]
    out = _on_days(battle_daily(bars, min_bars, min_valid), bars)
    out = out.withColumns({c: mean_distance(c) for c in names})
    w = series()
    out = out.withColumns({c: (rolling(F.avg, c, window, window // 2, w) + rolling(F.stddev_samp, c, window, window // 2, w)) / 2 for c in names})
    if weekly:
        from tidemark.functions.kernels import week_end

        out = out.groupBy("symbol", week_end("date").alias("date")).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in names))
    out = out.withColumns({f"d_{c}": mean_distance(c) for c in names}).withColumn("vol_battle", composite(["d_vol_battle_ret", "d_vol_battle_pos"]))
    out = out.withColumns({"d_vol": mean_distance("vol_battle")}).withColumn("bull_bear_battle", composite(["d_vol", "d_amp_battle"]))
    return out.select(*DAY, *names, "vol_battle", "bull_bear_battle")


def surge_daily(grid: DataFrame, min_bars: int = 30, min_valid: int = 10) -> DataFrame:
    w = _minutes()
    rows = grid.where(F.col("n_day") >= min_bars).withColumns({"ret": div("close", F.lag("close").over(w)) - 1, "dv": F.col("volume") - F.lag("volume").over(w)}).where("i >= 1")
    ahead = w.rowsBetween(0, 4)
    whole = Window.partitionBy("date", "symbol")
    rows = rows.withColumns({
        "sd5": F.when(F.count("ret").over(ahead) >= 2, F.stddev_samp("ret").over(ahead)), "n": F.count("dv").over(whole),
        "m": F.avg("dv").over(whole), "s": F.stddev_samp("dv").over(whole),
    }).where((F.col("n") >= min_valid) & (F.col("s") != 0) & (F.col("dv") > F.col("m") + F.col("s")))
    return rows.groupBy(*DAY).agg(F.avg("sd5").alias("weekly_dazzling_vol"), F.avg("ret").alias("weekly_dazzling_ret"))


def surge(grid: DataFrame, min_bars: int = 30, min_valid: int = 10) -> DataFrame:
    out = _on_days(surge_daily(grid, min_bars, min_valid), grid)
    names = ["weekly_dazzling_vol", "weekly_dazzling_ret"]
    out = mean_std_composite(out.withColumns({c: moderate(c) for c in names}), names)
    out = out.withColumn("weekly_dazzling_vol", -F.col("weekly_dazzling_vol"))
    out = zscore(out.withColumns({f"z_{c}": F.col(c) for c in names}), [f"z_{c}" for c in names])
    return out.select(*DAY, *names, composite([f"z_{c}" for c in names]).alias("moderate_risk"))


def fuzzy_daily(grid: DataFrame, min_bars: int = 30, min_valid: int = 20, min_foggy: int = 5) -> DataFrame:
    w = _minutes()
    rows = grid.where(F.col("n_day") >= min_bars).withColumn("ret", div("close", F.lag("close").over(w)) - 1)
    rows = rows.withColumn("vola", rolling(F.stddev_samp, "ret", 5, 5, w)).withColumn("a", rolling(F.stddev_samp, "vola", 5, 5, w))
    rows = rows.withColumn("to", F.col("close") * F.col("volume")).where("i >= 9 and a is not null and volume is not null and to is not null")
    whole = Window.partitionBy("date", "symbol")
    rows = rows.withColumns({"n": F.count("*").over(whole), "m": F.avg("a").over(whole)}).where(F.col("n") >= min_valid)
    fog = F.col("a") > F.col("m")
    enough = F.sum(fog.cast("int")) >= min_foggy
    ratio = lambda x: F.when(enough & (F.avg(x) > 0), F.avg(F.when(fog, F.col(x))) / F.nullif(F.avg(x), F.lit(0)))
    return rows.groupBy(*DAY).agg(
        corr("a", "to").alias("fuzzy_corr"), ratio("to").alias("fuzzy_amount_ratio"), ratio("volume").alias("fuzzy_volume_ratio"),
    )


def fuzzy(grid: DataFrame, min_bars: int = 30, min_valid: int = 20, min_foggy: int = 5) -> DataFrame:
    names = ["fuzzy_corr", "fuzzy_amount_ratio", "fuzzy_volume_ratio"]
    out = mean_std_composite(_on_days(fuzzy_daily(grid, min_bars, min_valid, min_foggy), grid), names, negate=True)
    return out.select(*DAY, *names)


def rebuild_daily(grid: DataFrame, min_bars: int = 15, min_valid: int = 20, min_high: int = 5) -> DataFrame:
    """Better volatility: squared coefficient of variation of the 20 prices of five minutes, from means and squares within minutes."""
    w = _minutes()
    frame = w.rowsBetween(-4, 0)
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    mean = (prices[0] + prices[1] + prices[2] + prices[3]) / 4
    rows = grid.where(F.col("n_day") >= min_bars).withColumn("m", mean)
    rows = rows.withColumn("ss", sum((p - F.col("m")) * (p - F.col("m")) for p in prices))
    full = F.count("m").over(frame) >= 5
    rows = rows.withColumns({"mu": F.when(full, F.avg("m").over(frame)), "var": F.when(full, (F.sum("ss").over(frame) + 20 * F.var_pop("m").over(frame)) / 19), "ret": div("close", F.lag("close").over(w)) - 1})
    rows = rows.withColumn("bv", F.when(F.col("mu") > 0, F.col("var") / F.nullif(F.col("mu") * F.col("mu"), F.lit(0))))
    rows = rows.where("bv > 0 and ret is not null").withColumn("rvr", F.col("ret") / F.nullif("bv", F.lit(0)))
    whole = Window.partitionBy("date", "symbol")
    rows = rows.withColumns({"n": F.count("*").over(whole), "cut": F.avg("bv").over(whole) + F.stddev_samp("bv").over(whole)}).where(F.col("n") >= min_valid)
    top = F.col("bv") >= F.col("cut")
    return rows.groupBy(*DAY).agg(
        F.covar_samp("rvr", "bv").alias("disaster_rebuild"),
        F.when(F.sum(top.cast("int")) >= min_high, F.covar_samp(F.when(top, F.col("rvr")), F.when(top, F.col("bv")))).alias("peak_climbing"),
    )


def rebuild(grid: DataFrame, min_bars: int = 15, min_valid: int = 20, min_high: int = 5) -> DataFrame:
    out = mean_std_composite(_on_days(rebuild_daily(grid, min_bars, min_valid, min_high), grid), ["disaster_rebuild", "peak_climbing"])
    return out.select(*DAY, (-F.col("disaster_rebuild")).alias("disaster_rebuild"), "peak_climbing")


def tidal_daily(grid: DataFrame) -> DataFrame:
    w = _minutes()
    whole = Window.partitionBy("date", "symbol")
    n, i = F.col("n_day"), F.col("i")
    rows = grid.where("n_day >= 29").withColumns({"some_c": F.count("close").over(whole), "some_v": F.count("volume").over(whole)}).where("some_c > 0 and some_v > 0")
    near = F.when((i >= 4) & (i <= n - 5), F.sum(F.coalesce("volume", F.lit(0.0))).over(w.rowsBetween(-4, 4)))
    rows = rows.withColumn("near", near)
    middle = (i >= 14) & (i <= n - 15)
    rows = rows.withColumns({"peak": F.max_by("i", F.when(middle, F.struct("near", -i))).over(whole), "top": F.max(F.when(middle, F.col("near"))).over(whole)}).where("top != 0 and near is not null")
    before, after = i < F.col("peak"), i > F.col("peak")
    point = F.struct("i", "close", "near")
    ends = rows.groupBy(*DAY).agg(
        F.min_by(point, F.when(before, F.struct("near", "i"))).alias("m"), F.min_by(point, F.when(after, F.struct("near", "i"))).alias("n"), F.min_by(point, F.when(i == F.col("peak"), i)).alias("p"),
    ).where("m.close is not null and n.close is not null and p.close is not null and m.close != 0 and n.i != m.i")
    rise = div((F.col("p.close") - F.col("m.close")) / F.nullif("m.close", F.lit(0)), F.col("p.i") - F.col("m.i"))
    ebb = div(div(F.col("n.close") - F.col("p.close"), "p.close"), F.col("n.i") - F.col("p.i"))
    rising = F.col("m.near") < F.col("n.near")
    return ends.select(*DAY, (div(F.col("n.close") - F.col("m.close"), "m.close") / F.nullif(F.col("n.i") - F.col("m.i"), F.lit(0))).alias("full_tidal"),
                       F.when(rising, rise).otherwise(ebb).alias("strong_half_tidal"), F.when(rising, ebb).otherwise(rise).alias("aggressive_weak_half"))


def tidal(grid: DataFrame) -> DataFrame:
    names = ["full_tidal", "strong_half_tidal", "aggressive_weak_half"]
    out = _on_days(tidal_daily(grid), grid).withColumn("stable_weak_half", rolling(F.stddev_samp, "aggressive_weak_half", 5, 4, series()))
    out = out.withColumns({c: rolling(F.avg, c, 5, 4, series()) for c in names})
    out = zscore(out, [*names, "stable_weak_half"])
    return out.select(*DAY, *names, (-F.col("stable_weak_half")).alias("stable_weak_half"))


def _taylor(r):
    """2 (r - ln(1 + r)) - ln(1 + r) squared, of a price ratio 1 + r."""
    log = F.when(r > 0, F.log(r))
    return 2 * (r - 1 - log) - log * log


def jump_daily(grid: DataFrame, min_bars: int = 20) -> DataFrame:
    rows = grid.where(F.col("n_day") >= min_bars).withColumn("x", _taylor(div("close", F.lag("close").over(_minutes()))))
    return rows.groupBy(*DAY).agg(F.avg("x").alias("jump"))


def jump(grid: DataFrame, daily: DataFrame, min_bars: int = 20) -> DataFrame:
    out = _on_days(daily.select(*DAY, "high", "low", "close"), grid).join(jump_daily(grid, min_bars), DAY, "left")
    w, day = series(), Window.partitionBy("date")
    out = out.withColumns({"amp": div(F.col("high") - F.col("low"), F.lag("close").over(w)), "taylor": _taylor(div("high", F.lag("low").over(w)))})
    flip = lambda c: F.when(F.col(c) < F.avg(c).over(day), -F.col("amp")).otherwise(F.col("amp"))
    out = out.withColumns({"modified_amplitude_1": flip("jump"), "modified_amplitude_2": flip("taylor"), "weekly_jump": F.col("jump")})
    out = mean_std_composite(out, ["weekly_jump"], negate=True)
    out = rolling_mean_zscore(out, ["modified_amplitude_1", "modified_amplitude_2"])
    out = zscore(out.withColumns({"a": F.col("modified_amplitude_1"), "b": F.col("modified_amplitude_2"), "c": F.col("weekly_jump")}), ["a", "b", "c"])
    out = out.withColumn("modified_amplitude", composite(["a", "b"])).withColumn("d", F.col("modified_amplitude"))
    out = zscore(out, ["d"])
    return out.select(*DAY, "weekly_jump", "modified_amplitude_1", "modified_amplitude_2", "modified_amplitude", composite(["c", "d"]).alias("moth_to_flame"))


LAGS = 6


def regression_daily(grid: DataFrame, min_bars: int = 30) -> DataFrame:
    """t statistics and F of return on a constant and volume change at lags 0 to 5, from dense minutes 1 on.

    The moments are sums of a row a minute; the small systems of all days and symbols are solved together.
    """
    w, k = _minutes(), LAGS + 1
    change = F.col("volume") - F.lag("volume").over(w)
    rows = grid.where(F.col("n_day") >= min_bars).select(*DAY, "i", (div("close", F.lag("close").over(w)) - 1).alias("y"), change.alias("x0")).where("i >= 1")
    rows = rows.withColumns({f"x{n}": F.lag("x0", n).over(w) for n in range(1, LAGS)}).withColumn("minutes", F.count("*").over(Window.partitionBy(*DAY)))
    names = [f"x{n}" for n in range(LAGS)] + ["y"]
    rows = rows.where(F.col("minutes") >= 12).dropna(subset=names)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    sums = rows.groupBy(*DAY).agg(F.array(F.count("*").cast("double"), *(F.sum(c) for c in names), *(F.sum(F.col(names[a]) * F.col(names[b])) for a, b in pairs)).alias("m")).where(F.col("m")[0] > k + 2)

    def solve(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            m = np.stack(pdf["m"].to_numpy())
            n, mean = m[:, 0], m[:, 1 : k + 1] / m[:, :1]
            inner = np.zeros((len(m), k, k))
            for (a, b), column in zip(pairs, m[:, k + 1 :].T):
                inner[:, a, b] = inner[:, b, a] = column
            inner -= n[:, None, None] * mean[:, :, None] * mean[:, None, :]  # about the means, so that the constant drops out
            size = np.sqrt(np.maximum(inner[:, range(LAGS), range(LAGS)], 0))
            ok = (size > 0).all(1)
            size = np.where(size > 0, size, 1.0)
            gram = inner[:, :LAGS, :LAGS] / size[:, :, None] / size[:, None, :]
            ok &= np.linalg.cond(np.where(ok[:, None, None], gram, np.eye(LAGS))) < 1e12
            inverse = np.linalg.inv(np.where(ok[:, None, None], gram, np.eye(LAGS))) / size[:, :, None] / size[:, None, :]
            slope = (inverse @ inner[:, :LAGS, LAGS, None])[:, :, 0]
            tss = inner[:, LAGS, LAGS]
            rss = np.maximum(tss - (slope * inner[:, :LAGS, LAGS]).sum(1), 0)
            s2 = rss / (n - k)
            t = slope / np.sqrt(np.maximum(inverse[:, range(LAGS), range(LAGS)] * s2[:, None], 1e-30))
            x = mean[:, :LAGS]
            spread = (1 / n + (x[:, None, :] @ inverse @ x[:, :, None])[:, 0, 0]) * s2
            t0 = (mean[:, LAGS] - (slope * x).sum(1)) / np.sqrt(np.maximum(spread, 1e-30))
            f = np.maximum((tss - rss) / 6 / np.maximum(s2, 1e-30), 0)
            yield pd.DataFrame({"date": pdf["date"], "symbol": pdf["symbol"], "mist": t[:, 1:].std(1, ddof=1), "shade": np.abs(t0), "f": f, "t0": t0})[ok]

    return sums.mapInPandas(solve, "date date, symbol string, mist double, shade double, f double, t0 double")


def pairwise_mean_corr(panel: DataFrame, value: str, window: int, min_obs: int, min_symbols: int, spearman: bool = False, keep_nan: bool = False) -> DataFrame:
    """date, symbol, value: mean absolute correlation of a symbol's last `window` days with all others', per window one task.

    The diagonal counts as one even where the correlation is undefined and taken for 0.
    """
    days = panel.agg(F.max("t")).first()[0]
    spread = panel.withColumn("at", F.explode(F.sequence("t", F.col("t") + window - 1))).where((F.col("at") >= window - 1) & (F.col("at") <= F.lit(days)))
    dates = panel.select(F.col("t").alias("at"), F.col("date").alias("day")).distinct()

    def run(key, pdf):
        wide = pdf.pivot(index="t", columns="symbol", values=value)
        wide = wide.loc[:, wide.notna().sum() >= min_obs]
        n = wide.shape[1]
        if n < min_symbols:
            return pd.DataFrame([], columns=["at", "symbol", "value"])
        if spearman:
            return pd.DataFrame({"at": key[0], "symbol": wide.columns, "value": mean_abs_spearman(wide.to_numpy(float))})
        found = wide.corr()
        found = found if keep_nan else found.fillna(0)
        return pd.DataFrame({"at": key[0], "symbol": wide.columns, "value": ((found.abs().sum() - 1) / (n - 1)).to_numpy()})

    found = spread.select("at", "t", "symbol", value).groupBy("at").applyInPandas(run, "at int, symbol string, value double")
    return found.join(dates, "at").select(F.col("day").alias("date"), "symbol", F.nanvl("value", F.lit(None).cast("double")).alias("value"))


def mean_abs_spearman(x: np.ndarray, block: int = 64) -> np.ndarray:
    """Of each column the mean absolute rank correlation with all others, of each pair over the rows that both have; the diagonal counts as one.

    Ranks within the rows of a pair are sums of signs of differences, so that a block of columns is two matrix products.
    """
    there = ~np.isnan(x)
    m, n = x.shape
    filled = np.where(there, x, 0.0)
    signs = np.sign(filled[:, None, :] - filled[None, :, :]) * (there[:, None, :] & there[None, :, :])  # row, row, column
    mask = there.astype(float)
    total = np.zeros(n)
    for a in range(0, n, block):
        own = slice(a, min(a + block, n))
        width = own.stop - a
        mine = (signs.transpose(2, 0, 1).reshape(n * m, m) @ mask[:, own]).reshape(n, m, width) * mask[None, :, own]  # rank of n among rows that block has
        theirs = (signs[:, :, own].transpose(2, 0, 1).reshape(width * m, m) @ mask).reshape(width, m, n).transpose(2, 1, 0) * mask.T[:, :, None]
        both = (mine * theirs).sum(1)
        scale = (mine**2).sum(1) * (theirs**2).sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            r = np.abs(np.where(scale > 0, both / np.sqrt(scale), np.nan))
        total += np.nansum(r, 1)
    return (total - 1) / (n - 1)


def regression(grid: DataFrame, min_bars: int = 30, min_symbols: int = 20) -> DataFrame:
    out = _on_days(regression_daily(grid, min_bars), grid)
    low = F.col("f") < F.avg("f").over(Window.partitionBy("date"))
    frost = pairwise_mean_corr(out, "t0", 5, 4, min_symbols).withColumnRenamed("value", "night_frost")
    out = rolling_mean_zscore(out.select(*DAY, "t", F.col("mist").alias("morning_mist"), F.when(low, -F.col("shade")).otherwise(F.col("shade")).alias("noon_shade")), ["morning_mist", "noon_shade"])
    out = out.join(frost, DAY, "left")
    names = ["morning_mist", "noon_shade", "night_frost"]
    out = zscore(out.withColumns({f"z_{c}": F.col(c) for c in names}), [f"z_{c}" for c in names])
    return out.select(*DAY, *names, composite([f"z_{c}" for c in names]).alias("flower_hidden"))


def high_low_diff(grid: DataFrame, daily: DataFrame, window: int = 20, least: int = 15) -> DataFrame:
    """Share of turnover at prices above a usual return since the open, less the rest; comparisons with NULL count as low."""
    base = _on_days(daily.select(*DAY, F.col("open").alias("o"), F.col("close").alias("c")), grid)
    base = base.withColumn("usual", rolling(F.avg, div("c", "o") - 1, window, least, series()))
    rows = grid.join(base.select(*DAY, "o", "usual"), DAY)
    high = F.coalesce(div("close", "o") - 1 > F.col("usual"), F.lit(False))
    to = F.col("close") * F.col("volume")
    up, down = F.sum(F.when(high, to).otherwise(0.0)), F.sum(F.when(~high, F.coalesce(to, F.lit(0.0))).otherwise(0.0))
    return rows.groupBy(*DAY).agg(up.alias("up"), down.alias("down")).select(*DAY, div(F.col("up") - F.col("down"), F.col("up") + F.col("down")).alias("diff"))


def lone_goose_daily(grid: DataFrame, min_bars: int = 30, min_calm: int = 10, min_symbols: int = 20) -> DataFrame:
    """Mean absolute correlation of turnover over minutes in which returns diverge less than usual that day."""
    rows = grid.where(F.col("n_day") >= min_bars).withColumns({"ret": div("close", F.lag("close").over(_minutes())) - 1, "to": F.col("close") * F.col("volume")})
    minutes = rows.where("i >= 1").groupBy("date", "i").agg(F.stddev_samp("ret").alias("div"))
    day = Window.partitionBy("date")
    calm = minutes.withColumn("m", F.avg("div").over(day)).where("div < m").withColumn("n", F.count("*").over(day)).where(F.col("n") >= min_calm)

    def run(key, pdf):
        wide = pdf.pivot(index="i", columns="symbol", values="to")
        wide = wide.loc[:, (wide != 0).any() & (wide.std() > 0)]
        n = wide.shape[1]
        if n < min_symbols:
            return pd.DataFrame([], columns=["date", "symbol", "value"])
        return pd.DataFrame({"date": key[0], "symbol": wide.columns, "value": ((wide.corr().fillna(0).abs().sum() - 1) / (n - 1)).to_numpy()})

    return rows.join(calm.select("date", "i"), ["date", "i"]).select("date", "i", "symbol", "to").groupBy("date").applyInPandas(run, "date date, symbol string, value double")


def microstructure(grid: DataFrame, daily: DataFrame, window: int = 20, least: int = 15, min_bars: int = 30, min_calm: int = 10, min_symbols: int = 20) -> DataFrame:
    diff = _on_days(high_low_diff(grid, daily, window, least), grid)
    flow = pairwise_mean_corr(diff, "diff", window, window // 2, min_symbols, spearman=True, keep_nan=True).withColumnRenamed("value", "go_with_flow")
    goose = _on_days(lone_goose_daily(grid, min_bars, min_calm, min_symbols), grid).withColumnRenamed("value", "lone_goose")
    w = series()
    goose = zscore(goose.withColumns({"m": rolling(F.avg, "lone_goose", window, least, w), "s": rolling(F.stddev_samp, "lone_goose", window, least, w)}), ["m", "s"])
    out = goose.select(*DAY, (-(F.col("m") + F.col("s")) / 2).alias("lone_goose")).join(flow, DAY, "left")
    out = zscore(out.withColumns({"a": F.col("go_with_flow"), "b": F.col("lone_goose")}), ["a", "b"])
    return out.select(*DAY, "go_with_flow", "lone_goose", composite(["a", "b"]).alias("sailing"))


GROUPS = {
    "technical": ("RS_12M", "RS_6M", "Range_52W", "RSI_28W", "RSI_16W"),
    "reversal": ("interday_rev_volflip", "intraday_rev_volflip", "overnight_rev_volflip", "team_coin"),
    "fundamental": ("ROE", "ROIC", "EV_EBITDA", "FCF_Yield", "PS", "FCF_Growth", "EPS_Score", "Growth_Stability"),
    "microstructure": ("go_with_flow", "lone_goose", "sailing"),
    "battle": ("vol_battle_ret", "vol_battle_pos", "amp_battle", "vol_battle", "bull_bear_battle"),
    "surge": ("weekly_dazzling_vol", "weekly_dazzling_ret", "moderate_risk"),
    "regression": ("morning_mist", "noon_shade", "night_frost", "flower_hidden"),
    "fuzzy": ("fuzzy_corr", "fuzzy_amount_ratio", "fuzzy_volume_ratio"),
    "rebuild": ("disaster_rebuild", "peak_climbing"),
    "tidal": ("full_tidal", "strong_half_tidal", "aggressive_weak_half", "stable_weak_half"),
    "jump": ("weekly_jump", "modified_amplitude_1", "modified_amplitude_2", "modified_amplitude", "moth_to_flame"),
}
FACTORS = {name: group for group, names in GROUPS.items() for name in names}


def to_long(wide: DataFrame, names: list[str]) -> DataFrame:
    """(date, symbol, factor, value) without NULL values."""
    return wide.unpivot(DAY, names, "factor", "value").where("value is not null")
