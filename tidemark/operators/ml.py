"""Walk-forward prediction of next-period returns from factor panels.

Panels: date, symbol, feature columns without NULLs, fwd. Each test date is predicted by a model fitted on earlier dates
only, in an expanding window. Ridge regression needs no more than running sums of moments, a row a date, so that all dates
are one plan over one scan. Other models need the rows themselves: a date with its training rows is one task, and all dates
run at once. Nothing loops on the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.kernels import ffill, series, zscore
from tidemark.operators import trees as tree_models


def panel(factors: DataFrame, forward: DataFrame, names: list[str], raw_without_spread: bool = True) -> DataFrame:
    """Z-scores by date of all factors with the forward return; missing ones 0, rows without a return left out.

    raw_without_spread: a factor whose MAD is 0 on a date keeps its raw values, unscaled, else it is scaled unclipped.
    """
    rows = factors.where(F.col("factor").isin(names)).groupBy("date", "symbol", "factor").agg(F.first("value").alias("value")).withColumn("__by", F.struct("factor", "date"))
    if raw_without_spread:
        w = Window.partitionBy("__by")
        rows = rows.withColumns({"__raw": F.col("value"), "__med": F.median("value").over(w)}).withColumn("__mad", F.median(F.abs(F.col("value") - F.col("__med"))).over(w))
    z = zscore(rows, ["value"], by="__by")  # in long form: one column of windows for any number of factors
    if raw_without_spread:
        z = z.withColumn("value", F.when(F.col("__mad") == 0, F.col("__raw")).otherwise(F.col("value")))
    wide = z.groupBy("date", "symbol").pivot("factor", names).agg(F.first("value"))
    return wide.join(forward.select("date", "symbol", "fwd"), ["date", "symbol"]).where("fwd is not null").fillna(0.0, names)


def daily_panel(factors: DataFrame, grid: DataFrame, forward: DataFrame, directions: dict[str, float], min_names: int = 50, min_rows: int = 30) -> DataFrame:
    """Factors carried forward to every day, those with too few names on a day left out, complete rows only, directed z-scores."""
    names = list(directions)
    wide = factors.groupBy("date", "symbol").pivot("factor", names).agg(F.first("value"))
    rows = grid.select("date", "symbol", "t").join(wide, ["date", "symbol"], "left").withColumns({n: ffill(n, series()) for n in names})
    day = Window.partitionBy("date")
    rows = rows.withColumns({f"__n_{n}": F.count(n).over(day) for n in names})
    usable = reduce(lambda a, n: a & (F.col(n).isNotNull() | (F.col(f"__n_{n}") < min_names)), names, F.lit(True))
    rows = rows.withColumns({n: F.when(F.col(f"__n_{n}") >= min_names, F.col(n)) for n in names}).where(usable).withColumn("__rows", F.count("*").over(day)).where(F.col("__rows") >= min_rows)
    z = zscore(rows.select("date", "symbol", *names), names).withColumns({n: F.coalesce(F.col(n) * directions[n], F.lit(0.0)) for n in names})
    return z.join(forward.select("date", "symbol", "fwd"), ["date", "symbol"]).where("fwd is not null")


def models(names: list[str], rows: int, seed: int = 42, trees: int = 100) -> dict[str, Pipeline]:
    """Distributed fits by name, for one fit over all rows. A ridge penalty of 1 on the sum of squares is regParam 1 / rows on their mean."""
    gather = VectorAssembler(inputCols=names, outputCol="raw")
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    ridge = LinearRegression(labelCol="fwd", regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False)
    return {
        "ridge": Pipeline(stages=[gather, scale, ridge]),
        "forest": Pipeline(stages=[gather, scale, RandomForestRegressor(labelCol="fwd", numTrees=trees, maxDepth=5, minInstancesPerNode=20, seed=seed)]),
    }


def equal_weight(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select("date", "symbol", "fwd", (reduce(lambda a, b: a + b, [F.col(n) for n in names]) / len(names)).alias("value"))


def _ordered(rows: DataFrame) -> DataFrame:
    """date, t (its position from 0) and size (its rows): a row a date."""
    dates = rows.groupBy("date").agg(F.count("*").alias("size"))
    return dates.withColumn("t", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))


def _ridge(rows: DataFrame, names: list[str], dates: DataFrame, purge: int, min_train: int, alpha: float) -> DataFrame:
    """Predictions of a ridge regression on features scaled to deviation 1 (population), from running sums of moments.

    A date's moments are made where its rows are; the running sums and the small systems take a row a date.
    """
    k = len(names)
    x = [*names, "fwd"]

    def moments(key, pdf):
        z = np.column_stack([np.ones(len(pdf)), pdf[x].to_numpy(float)])
        return pd.DataFrame({"date": [key[0]], "m": [(z.T @ z).ravel()]})

    def solve(frames):
        pdf = pd.concat(list(frames)).sort_values("date", ignore_index=True)
        if not len(pdf):
            return
        m = np.cumsum(np.stack(pdf["m"].to_numpy()).reshape(-1, k + 2, k + 2), axis=0)
        m = np.concatenate([np.zeros_like(m[:1])] * (1 + purge) + [m])[: len(m)]  # of the dates before
        ok = m[:, 0, 0] >= min_train
        m = m[ok]
        n, mean = m[:, 0, 0], m[:, 0, 1:] / m[:, :1, 0]
        second = m[:, 1:, 1:] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
        spread = np.sqrt(np.maximum(second[:, range(k), range(k)] / n[:, None], 0))
        spread = np.where(spread > 1e-12, spread, 1.0)
        gram = second[:, :k, :k] / spread[:, :, None] / spread[:, None, :] + alpha * np.eye(k)
        slope = np.linalg.solve(gram, (second[:, :k, k] / spread)[:, :, None])[:, :, 0] / spread
        yield pd.DataFrame({"date": pdf["date"][ok], "b": list(slope), "a": mean[:, k] - (slope * mean[:, :k]).sum(1)})

    sums = rows.select("date", *x).groupBy("date").applyInPandas(moments, "date date, m array<double>")
    fitted = sums.repartition(1).mapInPandas(solve, "date date, b array<double>, a double")  # a row a date
    value = F.aggregate(F.arrays_zip("b", F.array(*names).alias("x")), F.col("a"), lambda s, p: s + p["b"] * p["x"])
    return rows.join(fitted, "date").select("date", "symbol", "fwd", value.alias("value"))


def walk_forward(rows: DataFrame, names: list[str], model: str = "ridge", min_periods: int = 8, min_test: int = 20, min_train: int = 100, purge: int = 0, alpha: float = 1.0, **options) -> DataFrame:
    """date, symbol, fwd and value predicted from the dates more than `purge` periods before; expanding window.

    model: ridge, or one of trees.MODELS (forest, boosting, svr, pca_ridge, with its options). Dates with fewer than min_periods + purge
    dates before them, min_test names or min_train rows to learn from have no prediction.
    """
    dates = _ordered(rows)
    tested = dates.where((F.col("t") >= min_periods + purge) & (F.col("size") >= min_test)).select("date")
    if model == "ridge":
        return _ridge(rows, names, dates, purge, min_train, alpha).join(tested, "date", "left_semi")
    fit = tree_models.MODELS[model]
    last = dates.agg(F.max("t").alias("last"))
    features: Column = F.array(*(F.col(n).cast("double") for n in names))
    placed = rows.join(dates.select("date", "t"), "date").crossJoin(last).select("date", "symbol", "fwd", "t", features.alias("x"), "last")
    # a row teaches every date after it, and is predicted at its own
    first = F.greatest(F.col("t") + purge + 1, F.lit(min_periods + purge))
    at = F.concat(F.array("t"), F.when(first <= F.col("last"), F.sequence(first, F.col("last"))).otherwise(F.array().cast("array<int>")))
    spread = placed.withColumn("at", F.explode(at)).join(dates.where((F.col("t") >= min_periods + purge) & (F.col("size") >= min_test)).select(F.col("t").alias("at")), "at", "left_semi")

    def one(key, pdf):
        test, train = pdf[pdf["t"] == key[0]], pdf[pdf["t"] != key[0]].sort_values(["t", "symbol"])
        if len(train) < min_train:
            return pd.DataFrame([], columns=["date", "symbol", "fwd", "value"])
        x = np.stack(train["x"].to_numpy())
        mean, spread_ = x.mean(0), x.std(0)
        spread_ = np.where(spread_ > 1e-12, spread_, 1.0)
        predict = fit((x - mean) / spread_, train["fwd"].to_numpy(float), **options)
        return test[["date", "symbol", "fwd"]].assign(value=predict((np.stack(test["x"].to_numpy()) - mean) / spread_))

    return spread.groupBy("at").applyInPandas(one, "date date, symbol string, fwd double, value double")


def daily_evaluation(predictions: DataFrame, horizon: int = 5, n: int = 5, top: int = 30, least: int | None = None, ic_least: int = 10) -> DataFrame:
    """One row: mean rank coefficient, its ratio, and of the spread of every horizon-th date the yearly return, volatility, Sharpe ratio and share of gains.

    A year has 252 / horizon periods, so that holding periods don't overlap.
    """
    from tidemark.operators import research

    ics = research.rank_ic(predictions.withColumn("factor", F.lit("model")), ic_least)
    quality = ics.agg(F.avg("ic").alias("ic_mean"), (F.avg("ic") / F.nullif(F.stddev_samp("ic"), F.lit(0.0))).alias("icir"), F.count("*").alias("dates"))
    returns = research.evaluate_predictions(predictions, n, top, least)
    every = returns.withColumn("k", F.row_number().over(Window.orderBy("date")) - 1).where(F.col("k") % horizon == 0)  # one row a date
    year = 252 / horizon
    sums = every.agg(F.avg("ls").alias("m"), F.stddev_samp("ls").alias("s"), F.avg((F.col("ls") > 0).cast("int")).alias("win_rate"), F.count("ls").alias("periods"))
    return quality.crossJoin(sums).select(
        "dates", "ic_mean", "icir", "periods", (F.col("m") * year).alias("annual_return"), (F.col("s") * year**0.5).alias("annual_vol"),
        (F.col("m") / F.nullif(F.col("s"), F.lit(0.0)) * year**0.5).alias("sharpe"), "win_rate",
    )


def ensemble(*predictions: DataFrame) -> DataFrame:
    """The mean of several models' predictions of the same dates and symbols; names that a model doesn't predict take the others'."""
    both = reduce(DataFrame.unionByName, predictions)
    return both.groupBy("date", "symbol").agg(F.first("fwd").alias("fwd"), F.avg("value").alias("value"))


def feature_importance(rows: DataFrame, names: list[str], **options) -> DataFrame:
    fitted = models(names, 1, **options)["forest"].fit(rows)
    found = fitted.stages[-1].featureImportances.toArray().tolist()
    return rows.sparkSession.createDataFrame(list(zip(names, found)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def live_signal(rows: DataFrame, latest: DataFrame, names: list[str], directions: dict[str, float] | None = None, trees: int = 200) -> DataFrame:
    """symbol with the equal-weight score, the predictions of ridge and forest, and their mean, for the latest features."""
    rows = rows.select(*names, "fwd").cache()  # read by every pass of both fits
    n = rows.count()
    signs = directions or dict.fromkeys(names, 1.0)
    out = latest.select("symbol", *names, (reduce(lambda a, b: a + b, [F.col(c) * signs[c] for c in names]) / len(names)).alias("equal_weight"))
    for model in ("ridge", "forest"):  # each adds its column, so that the latest features are read once and nothing is joined
        out = models(names, n, trees=trees)[model].fit(rows).transform(out).drop("raw", "features").withColumnRenamed("prediction", model)
    rows.unpersist()
    return out.withColumn("ensemble", (F.col("ridge") + F.col("forest")) / 2).select("symbol", "equal_weight", "ridge", "forest", "ensemble").orderBy(F.desc("equal_weight"), "symbol")
