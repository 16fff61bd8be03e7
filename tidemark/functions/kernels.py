"""Null-safe column kernels on long tables: one row a (date, symbol), positions counted on a dense grid.

Missing values are NULL, never NaN: `clean` turns one into the other at ingestion. Divisions by zero give NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


NOISE = 1e-13


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x) -> Column:
    return F.nanvl(col(x), F.lit(None).cast("double"))


def div(a, b) -> Column:
    return col(a) / F.nullif(col(b), F.lit(0))


def corr(a, b) -> Column:
    """Pearson correlation of the rows that have both, NULL where either is constant (the built-in one divides by zero)."""
    a, b = col(a), col(b)
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def series(*keys: str, order: str = "t") -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order)


def shift(x, k: int, w: WindowSpec) -> Column:
    return F.lag(col(x), k).over(w) if k >= 0 else F.lead(col(x), -k).over(w)


def rolling(fn, x, n: int, min_periods: int, w: WindowSpec) -> Column:
    """fn over the last n positions, NULL with fewer than min_periods values."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(col(x)).over(frame) >= min_periods, fn(col(x)).over(frame))


def clip(x, low, high) -> Column:
    """x between low and high; greatest and least alone would turn a NULL into a bound."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def ewm_mean(x, span: int, min_periods: int, w: WindowSpec, t: str = "t") -> Column:
    """Exponentially weighted mean with adjusted weights (1 - 2/(span+1)) ** age; age counts positions, NULLs have no weight.

    The ratio of two running sums. Positions count from 0, and (1 - alpha) ** -t must stay finite: t * ln(1/q) < 700.
    """
    rate = -math.log(1 - 2 / (span + 1))
    x = col(x)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    weight = F.when(x.isNotNull(), F.exp(F.col(t) * rate))
    return F.when(F.count(x).over(run) >= min_periods, F.sum(x * weight).over(run) / F.sum(weight).over(run))


def ffill(x, w: WindowSpec) -> Column:
    return F.last(col(x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def rank_average(x, *by: str) -> Column:
    """Ranks from 1, ties averaged; NULL for NULL."""
    x = col(x)
    w = Window.partitionBy(*by, x.isNull())
    first = F.rank().over(w.orderBy(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), first + (ties - 1) / 2)


def rank_percent(x, *by: str) -> Column:
    x = col(x)
    return rank_average(x, *by) / F.count(x).over(Window.partitionBy(*by))


def quantile_bucket(x, n: int, by: str = "date", tie: str = "symbol", least: int = 0) -> Column:
    """Buckets 1 to n of equal size by value, ties in order of `tie`: linear quantile edges of the ranks."""
    x = col(x)
    r = F.row_number().over(Window.partitionBy(by, x.isNull()).orderBy(x, tie))
    size = F.count(x).over(Window.partitionBy(by))
    bucket = F.greatest(F.lit(1), F.ceil((r - 1) * n / F.nullif(size - 1, F.lit(0)))).cast("int")
    return F.when(x.isNotNull() & (size >= least), bucket)


def mean_distance(x, by: str = "date") -> Column:
    w = Window.partitionBy(by)
    return F.abs(div(col(x) - F.avg(x).over(w), F.stddev_samp(x).over(w)))


def zscore(df: DataFrame, names: list[str], by: str = "date", sigma: float | None = 3.0) -> DataFrame:
    """Replaces each column by its cross-sectional z-score, clipped to median +- sigma * 1.4826 MAD where the MAD isn't 0.

    All steps share one partitioning: a single shuffle for any number of columns. Spreads up to NOISE count as 0: they
    are what rounding leaves of equal values.
    """
    w = Window.partitionBy(by)
    if sigma is not None:
        df = df.withColumns({f"__med_{c}": F.median(c).over(w) for c in names})
        df = df.withColumns({f"__mad_{c}": F.median(F.abs(F.col(c) - F.col(f"__med_{c}"))).over(w) for c in names})
        cut = {c: F.col(f"__mad_{c}") * (sigma * 1.4826) for c in names}
        df = df.withColumns({
            c: F.when(F.col(f"__mad_{c}") > NOISE, clip(c, F.col(f"__med_{c}") - cut[c], F.col(f"__med_{c}") + cut[c])).otherwise(F.col(c)) for c in names
        }).drop(*(f"__{k}_{c}" for c in names for k in ("med", "mad")))
    spread = {c: F.when(F.stddev_samp(c).over(w) > NOISE, F.stddev_samp(c).over(w)) for c in names}
    return df.withColumns({c: (F.col(c) - F.avg(c).over(w)) / spread[c] for c in names})


def composite(parts: list[str]) -> Column:
    """Equal-weight mean, NULL if any part is."""
    total = F.col(parts[0])
    for p in parts[1:]:
        total = total + F.col(p)
    return total / len(parts)


def mean_std_composite(df: DataFrame, names: list[str], n: int = 5, negate: bool = False, min_periods: int | None = None) -> DataFrame:
    """Each column becomes half the sum of the z-scores of its rolling mean and rolling standard deviation."""
    w, least = series(), min_periods or max(n - 1, 3)
    df = df.withColumns({f"__{k}_{c}": rolling(f, c, n, least, w) for c in names for k, f in (("m", F.avg), ("s", F.stddev_samp))})
    df = zscore(df, [f"__{k}_{c}" for c in names for k in "ms"])
    sign = -1 if negate else 1
    return df.withColumns({c: sign * (F.col(f"__m_{c}") + F.col(f"__s_{c}")) / 2 for c in names}).drop(*(f"__{k}_{c}" for c in names for k in "ms"))


def rolling_mean_zscore(df: DataFrame, names: list[str], n: int = 5) -> DataFrame:
    df = df.withColumns({c: rolling(F.avg, c, n, max(n - 1, 3), series()) for c in names})
    return zscore(df, names)


def moderate(x, by: str = "date") -> Column:
    return F.abs(col(x) - F.avg(x).over(Window.partitionBy(by)))


def volatility_flip(df: DataFrame, names: list[str], n: int = 20, least: int = 15) -> DataFrame:
    """Rolling mean, its sign turned where the rolling deviation is below its cross-sectional mean."""
    w = series()
    df = df.withColumns({f"__{k}_{c}": rolling(f, c, n, least, w) for c in names for k, f in (("m", F.avg), ("s", F.stddev_samp))})
    day = Window.partitionBy("date")
    flip = lambda c: F.when(F.col(f"__s_{c}") < F.avg(f"__s_{c}").over(day), -F.col(f"__m_{c}")).otherwise(F.col(f"__m_{c}"))
    return df.withColumns({c: flip(c) for c in names}).drop(*(f"__{k}_{c}" for c in names for k in "ms"))


def week_end(d) -> Column:
    """The Friday that closes the week of a date; Saturday and Sunday belong to the next."""
    return F.next_day(F.date_sub(col(d), 1), "FRI")


def resample_last(df: DataFrame, value: str, period: Column, keys: tuple[str, ...] = ("symbol",), date: str = "date") -> DataFrame:
    """The last value that isn't NULL of each period."""
    return df.groupBy(*keys, period.alias("period")).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(date))).alias(value))


def asof_backward(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: str, values: list[str]) -> DataFrame:
    """For each left row the values of the last right row of its key not after it, NULLs in them included.

    A union sorted once by key and time, no range join: the right row is carried forward as a struct.
    """
    a = left.select("*", F.col(left_on).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__row"))
    b = right.select(F.col(by), F.col(right_on).alias("__at"), F.lit(0).alias("__side"), F.struct(*values).alias("__row"))
    w = Window.partitionBy(by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b, allowMissingColumns=True).withColumn("__row", F.last("__row", ignorenulls=True).over(w)).where("__side = 1")
    return out.select(*left.columns, *(F.col(f"__row.{v}").alias(v) for v in values))


def ols_score(y: str, x: str, w: WindowSpec, n: int) -> tuple[Column, Column]:
    """Slope and R squared of y on x over the last n rows, NULL unless all n are there."""
    frame = w.rowsBetween(1 - n, 0)
    full = F.count(F.col(y)).over(frame) >= n
    return F.when(full, F.regr_slope(y, x).over(frame)), F.when(full, F.regr_r2(y, x).over(frame))
