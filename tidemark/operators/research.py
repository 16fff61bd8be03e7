"""Cross-sectional research: information coefficients, screening, composites, rebalancing and quantile backtests.

Factors come in long form: (date, symbol, factor, value).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.kernels import corr, div, quantile_bucket, rank_average, rank_percent, series, week_end, zscore

KEYS = ["date", "symbol"]


def forward_returns(grid: DataFrame, horizon: int = 21) -> DataFrame:
    """close[t + horizon] / close[t] - 1."""
    return grid.select(*KEYS, (div(F.lead("close", horizon).over(series()), "close") - 1).alias("fwd"))


def next_day_returns(grid: DataFrame, horizon: int) -> DataFrame:
    """Bought a day after the signal: close[t + horizon + 1] / close[t + 1] - 1."""
    w = series()
    return grid.select(*KEYS, "t", (div(F.lead("close", horizon + 1).over(w), F.lead("close", 1).over(w)) - 1).alias("fwd"))


HOLD = {"W": 5, "M": 21, "Q": 63}


def period(frequency: str) -> Column:
    return {"W": lambda: week_end("date"), "M": lambda: F.trunc("date", "month"), "Q": lambda: F.trunc("date", "quarter")}[frequency]()


def rebalance_dates(grid: DataFrame, frequency: str = "W") -> DataFrame:
    """The last date of each week, month or quarter."""
    return grid.select("date").distinct().groupBy(period(frequency).alias("period")).agg(F.max("date").alias("date")).select("date")


def rebalance(factors: DataFrame, grid: DataFrame, frequency: str = "W", hold: int | None = None) -> DataFrame:
    """Factor values on rebalance dates with the return over the holding period from the next day."""
    dates = rebalance_dates(grid, frequency)
    forward = next_day_returns(grid, hold or HOLD[frequency]).drop("t")
    return factors.join(dates, "date", "left_semi").join(forward, KEYS)


def rank_ic(rows: DataFrame, least: int = 20, by: tuple[str, ...] = ("factor",)) -> DataFrame:
    """by, date, n and ic: Spearman correlation of value and fwd over the rows of a date that have both."""
    rows = rows.where("value is not null and fwd is not null")
    keys = [*by, "date"]
    rows = rows.withColumns({"__a": rank_average("value", *keys), "__b": rank_average("fwd", *keys)})
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), corr("__a", "__b").alias("ic")).where((F.col("n") >= least) & F.col("ic").isNotNull())


def ic_summary(ics: DataFrame, least: int = 3) -> DataFrame:
    """Mean, deviation, ratio and number of a factor's coefficients; highest ratio first."""
    return (
        ics.groupBy("factor").agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.count("*").alias("periods")).where(F.col("periods") >= least)
        .withColumn("icir", div("ic_mean", "ic_std")).orderBy(F.desc_nulls_last("icir"), "factor")
    )


def rolling_ic(ics: DataFrame, n: int = 12) -> DataFrame:
    """The coefficients with the mean of the last n of each factor, NULL before there are n: what the reports plot."""
    w = Window.partitionBy("factor").orderBy("date").rowsBetween(1 - n, 0)
    return ics.withColumn("rolling_ic", F.when(F.count("ic").over(w) >= n, F.avg("ic").over(w)))


def ic_filter(summary: DataFrame, threshold: float = 0.005) -> DataFrame:
    return summary.where(F.abs("ic_mean") >= threshold)


def factor_correlations(wide: DataFrame, names: list[str]) -> DataFrame:
    """a, b, corr over the rows on which all factors are present; NULL where either is constant.

    Every Arrow batch gives one row of moments, about the first row's values, which one task adds up.
    """
    k = len(names)

    def moments(frames):
        for pdf in frames:
            if len(pdf):
                x = pdf.to_numpy(float)
                z = np.column_stack([np.ones(len(x)), x - x[0]])
                yield pd.DataFrame({"first": [x[0]], "m": [(z.T @ z).ravel()]})

    def combine(frames):
        n, mean, second = 0.0, np.zeros(k), np.zeros((k, k))
        for pdf in frames:
            for first, m in zip(pdf["first"], pdf["m"]):
                m = np.asarray(m).reshape(k + 1, k + 1)
                size, off = m[0, 0], m[0, 1:] / m[0, 0]
                inner, delta = m[1:, 1:] - size * np.outer(off, off), np.asarray(first) + off - mean
                second += inner + np.outer(delta, delta) * n * size / (n + size)
                mean, n = mean + delta * size / (n + size), n + size
        spread = np.sqrt(np.diag(second))
        rows = [(a, b, second[i, j] / (spread[i] * spread[j]) if spread[i] * spread[j] > 0 else None) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
        yield pd.DataFrame(rows, columns=["a", "b", "corr"]).astype({"corr": float})

    parts = wide.dropna(subset=names).select(*(F.col(n).cast("double") for n in names)).mapInPandas(moments, "first array<double>, m array<double>")
    found = parts.repartition(1).mapInPandas(combine, "a string, b string, corr double")
    return found.select("a", "b", F.nanvl("corr", F.lit(None).cast("double")).alias("corr"))


def correlation_dedup(order: list[str], icir: dict[str, float], correlations: dict[tuple[str, str], float], threshold: float = 0.7) -> list[str]:
    """Of each pair that is too close, in order, the one with the smaller absolute ratio goes; a factor that
    goes while it is being compared still meets the rest."""
    gone: set[str] = set()
    for i, a in enumerate(order):
        if a in gone:
            continue
        for b in order[i + 1 :]:
            r = correlations.get((a, b), correlations.get((b, a)))
            if b not in gone and r is not None and abs(r) > threshold:
                gone.add(b if abs(icir[a]) >= abs(icir[b]) else a)
    return [f for f in order if f not in gone]


def screen(factors: DataFrame, forward: DataFrame, names: list[str], ic_threshold: float = 0.005, corr_threshold: float = 0.7, least: int = 20) -> tuple[list[str], DataFrame]:
    """Names that pass the coefficient and correlation filters, and the summary of all."""
    summary = ic_summary(rank_ic(factors.join(forward, KEYS), least))
    ratio = {r.factor: r.icir or 0.0 for r in ic_filter(summary, ic_threshold).collect()}  # a row a factor
    order = list(ratio)
    if len(order) < 2:
        return order, summary
    wide = factors.where(F.col("factor").isin(order)).groupBy(*KEYS).pivot("factor", order).agg(F.first("value"))
    found = {(r.a, r.b): r["corr"] for r in factor_correlations(wide, order).collect()}
    return correlation_dedup(order, ratio, found, corr_threshold), summary


def best_per_group(summary: DataFrame, groups: DataFrame) -> DataFrame:
    """The factor of each report group with the largest absolute ratio."""
    return summary.join(groups, "factor").groupBy("report").agg(F.max_by("factor", F.abs("icir")).alias("factor"), F.max(F.abs("icir")).alias("abs_icir"))


def weighted_composite(factors: DataFrame, weights: dict[str, float], share: float = 0.5) -> DataFrame:
    """Weighted mean of z-scores over the factors present; NULL with fewer than int(share * number)."""
    spark = factors.sparkSession
    table = spark.createDataFrame(pd.DataFrame(list(weights.items()), columns=["factor", "weight"]))  # a row a factor
    z = zscore(factors.join(table, "factor").withColumn("__by", F.struct("factor", "date")), ["value"], by="__by")
    least = int(len(weights) * share)
    return z.groupBy(*KEYS).agg(F.when(F.count("value") >= max(least, 1), div(F.sum(F.col("value") * F.col("weight")), F.sum(F.when(F.col("value").isNotNull(), F.abs("weight"))))).alias("value"))


def quantile_returns(rows: DataFrame, n: int = 5, least: int = 10) -> DataFrame:
    """date, quantile, names and mean forward return."""
    rows = rows.where("value is not null and fwd is not null")
    rows = rows.withColumn("quantile", quantile_bucket("value", n, least=least)).where("quantile is not null")
    return rows.groupBy("date", "quantile").agg(F.count("*").alias("names"), F.avg("fwd").alias("ret"))


def long_short(quantiles: DataFrame, n: int = 5) -> DataFrame:
    """date and the return of the top bucket less that of the bottom, under the true dates."""
    top, bottom = (F.max(F.when(F.col("quantile") == q, F.col("ret"))) for q in (n, 1))
    return quantiles.groupBy("date").agg((top - bottom).alias("ls")).where("ls is not null")


def performance(returns: DataFrame, value: str = "ls") -> DataFrame:
    """One row: periods, yearly return, volatility and Sharpe ratio, win rate, largest drawdown. The year's periods follow from the median gap."""
    w = Window.orderBy("date")  # one row a rebalance date
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumns({"gap": F.datediff("date", F.lag("date").over(w)), "wealth": F.product(1 + F.col(value)).over(run)})
    rows = rows.withColumn("down", F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(run)) - 1)
    one = rows.agg(F.median("gap").alias("gap"), F.count("*").alias("periods"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.avg((F.col(value) > 0).cast("int")).alias("win_rate"), F.min("down").alias("max_drawdown"), F.max_by("wealth", "date").alias("wealth"))
    year = F.when(F.col("gap") <= 2, 252).when(F.col("gap") <= 8, 52).otherwise(12)
    return one.select("periods", (F.pow("wealth", year / F.col("periods")) - 1).alias("annual_return"), (F.col("s") * F.sqrt(year)).alias("annual_vol"),
                      (div("m", "s") * F.sqrt(year)).alias("sharpe"), "win_rate", "max_drawdown")


def monotonicity(quantiles: DataFrame) -> DataFrame:
    """Rank correlation of bucket and mean return."""
    means = quantiles.groupBy("quantile").agg(F.avg("ret").alias("ret")).withColumn("__one", F.lit(1))
    means = means.withColumns({"a": rank_average("quantile", "__one"), "b": rank_average("ret", "__one")})
    return means.agg(corr("a", "b").alias("monotonicity"))


def turnover(rows: DataFrame, n: int = 5, least: int = 10) -> DataFrame:
    """date and share of the top bucket that is new: half the changes of membership over its size."""
    members = rows.where("value is not null and fwd is not null").withColumn("quantile", quantile_bucket("value", n, least=least)).where(F.col("quantile") == n)
    dates = members.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date")))  # one row a rebalance date
    now = members.select("date", "symbol", F.lit(1).alias("now"))
    was = now.join(dates, "date").where("next is not null").select(F.col("next").alias("date"), "symbol", F.lit(1).alias("was"))
    both = now.join(was, KEYS, "full").fillna(0, ["now", "was"])
    changed = both.groupBy("date").agg(F.sum(F.abs(F.col("now") - F.col("was"))).alias("changes"), F.sum("now").alias("size"))
    return changed.join(was.select("date").distinct(), "date", "left_semi").select("date", (F.col("changes") / 2 / F.nullif("size", F.lit(0))).alias("turnover"))


def orthogonalize(rows: DataFrame, new: str, existing: list[str]) -> DataFrame:
    """Residual of `new` on a constant and the existing factors, by date; the raw value with fewer than max(10, k + 2) complete rows."""
    least = max(10, len(existing) + 2)

    def run(pdf):
        x, y = pdf[existing].to_numpy(float), pdf[new].to_numpy(float)
        ok = ~np.isnan(y) & ~np.isnan(x).any(1)
        out = y.copy()
        if ok.sum() >= least:
            design = np.column_stack([np.ones(int(ok.sum())), x[ok]])
            out[:] = np.nan
            out[ok] = y[ok] - design @ np.linalg.lstsq(design, y[ok], rcond=None)[0]
        return pd.DataFrame({"date": pdf["date"], "symbol": pdf["symbol"], "value": out})

    found = rows.select(*KEYS, new, *existing).groupBy("date").applyInPandas(run, "date date, symbol string, value double")
    return found.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def orthogonalize_one(rows: DataFrame, new: str, existing: str, least: int = 10) -> DataFrame:
    """The same for one existing factor, in closed form."""
    day = Window.partitionBy("date")
    ok = F.col(new).isNotNull() & F.col(existing).isNotNull()
    y, x = F.when(ok, F.col(new)), F.when(ok, F.col(existing))
    rows = rows.withColumns({"__n": F.sum(ok.cast("int")).over(day), "__b": F.regr_slope(y, x).over(day), "__y": F.avg(y).over(day), "__x": F.avg(x).over(day)})
    residual = y - F.col("__y") - F.coalesce("__b", F.lit(0.0)) * (x - F.col("__x"))
    return rows.select(*KEYS, F.when(F.col("__n") >= least, residual).otherwise(F.col(new)).alias("value"))


def orthogonalize_sequence(rows: DataFrame, names: list[str]) -> DataFrame:
    """Each factor made orthogonal to those before it, on the rows of a date that have all of them so far: one task a date for all factors.

    A factor keeps its values on dates with fewer than max(10, k + 2) such rows.
    """

    def run(pdf):
        out = pdf.copy()
        for i in range(1, len(names)):
            x, y = out[names[:i]].to_numpy(float), out[names[i]].to_numpy(float)
            ok = ~np.isnan(y) & ~np.isnan(x).any(1)
            if ok.sum() >= max(10, i + 2):
                design = np.column_stack([np.ones(int(ok.sum())), x[ok]])
                rest = np.full(len(y), np.nan)
                rest[ok] = y[ok] - design @ np.linalg.lstsq(design, y[ok], rcond=None)[0]
                out[names[i]] = rest
        return out

    schema = "date date, symbol string, " + ", ".join(f"`{n}` double" for n in names)
    found = rows.select(*KEYS, *names).groupBy("date").applyInPandas(run, schema)
    return found.select(*KEYS, *(F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in names))


def prepare_weekly(factors: DataFrame, grid: DataFrame, least: int = 5) -> DataFrame:
    """Last values of each week with the return to the next week there is; factors with fewer weeks are left out."""
    week = factors.groupBy("factor", "symbol", week_end("date").alias("week")).agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("date"))).alias("value"))
    close = grid.groupBy("symbol", week_end("date").alias("week")).agg(F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("close"))
    weeks = close.where("close is not null").select("week").distinct().withColumn("t", F.row_number().over(Window.orderBy("week")))  # one row a week
    close = close.join(weeks, "week").withColumn("fwd", div(F.lead("close").over(series()), "close") - 1)
    rows = week.where("value is not null").join(close.select("week", "symbol", "fwd"), ["week", "symbol"], "left").withColumnRenamed("week", "date")
    enough = rows.groupBy("factor").agg(F.countDistinct("date").alias("n")).where(F.col("n") >= least).select("factor")
    return rows.join(enough, "factor", "left_semi")


def evaluate_predictions(rows: DataFrame, n: int = 5, top: int = 30, least: int | None = None) -> DataFrame:
    """date, quintile spread by percentile rank and mean of the `top` names, of predictions (value) and outcomes (fwd).

    Dates with fewer names than `least`, 5 n if not given, are left out.
    """
    rows = rows.where("value is not null and fwd is not null")
    day = Window.partitionBy("date")
    rows = rows.withColumns({"pct": rank_percent("value", "date"), "n": F.count("*").over(day), "k": F.row_number().over(day.orderBy(F.desc("value"), "symbol"))}).where(F.col("n") >= (least or 5 * n))
    return rows.groupBy("date").agg((F.avg(F.when(F.col("pct") > 1 - 1 / n, F.col("fwd"))) - F.avg(F.when(F.col("pct") <= 1 / n, F.col("fwd")))).alias("ls"), F.avg(F.when(F.col("k") <= top, F.col("fwd"))).alias("lo"))


def normalized_scores(factors: DataFrame, directions: dict[str, float], method: str = "zscore", least: int = 30) -> DataFrame:
    """Mean directed score of names that have all factors: z-scores clipped at 3 MADs, or min-max within the date."""
    spark = factors.sparkSession
    signs = spark.createDataFrame(pd.DataFrame(list(directions.items()), columns=["factor", "sign"]))  # a row a factor
    rows = factors.where("value is not null").join(signs, "factor")
    whole = rows.groupBy(*KEYS).agg(F.count("*").alias("k")).where(F.col("k") == len(directions)).withColumn("n", F.count("*").over(Window.partitionBy("date"))).where(F.col("n") >= least)
    rows = rows.join(whole.select(*KEYS), KEYS)
    if method == "zscore":
        rows = zscore(rows.withColumn("__by", F.struct("factor", "date")), ["value"], by="__by")
    else:
        w = Window.partitionBy("factor", "date")
        rows = rows.withColumn("value", div(F.col("value") - F.min("value").over(w), F.max("value").over(w) - F.min("value").over(w)))
    return rows.groupBy(*KEYS).agg(F.avg(F.col("value") * F.col("sign")).alias("score"))


def pick(factors: DataFrame, bars: DataFrame, directions: dict[str, float], top: int = 10, min_volume: float = 5e6, missing_as_zero: bool = True) -> DataFrame:
    """The best liquid names of the last date: directed z-scores averaged, a missing one counting 0 or not at all."""
    spark = factors.sparkSession
    signs = spark.createDataFrame(pd.DataFrame(list(directions.items()), columns=["factor", "sign"]))  # a row a factor
    last = factors.join(factors.agg(F.max("date").alias("date")), "date", "left_semi").join(signs, "factor")
    z = zscore(last.withColumn("__by", F.struct("factor", "date")), ["value"], by="__by")
    total = F.sum(F.coalesce(F.col("value") * F.col("sign"), F.lit(0.0)))
    scores = z.groupBy("symbol").agg((total / len(directions) if missing_as_zero else div(total, F.count("value"))).alias("score"))
    recent = bars.withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("__n <= 5")
    liquid = recent.groupBy("symbol").agg(F.avg("volume").alias("v")).where(F.col("v") >= min_volume)
    return scores.join(liquid, "symbol", "left_semi").orderBy(F.desc_nulls_last("score"), "symbol").limit(top)
