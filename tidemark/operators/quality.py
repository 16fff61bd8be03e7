"""Profile of intraday bars: bars a day, half days, missing minutes, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def bars_per_day(bars: DataFrame, expected: int = 390, half: float = 0.6) -> DataFrame:
    """symbol, date, bars, first and last time, share of the expected, and whether it is a half day or short."""
    rows = bars.groupBy("symbol", "date").agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("volume") == 0).alias("zero_volume"))
    share = F.col("bars") / expected
    return rows.withColumns({"coverage": share, "half_day": share <= half, "complete": F.col("bars") >= expected})


def symbol_summary(days: DataFrame) -> DataFrame:
    return days.groupBy("symbol").agg(
        F.count("*").alias("days"), F.avg("bars").alias("mean_bars"), F.median("bars").cast("double").alias("median_bars"), F.min("bars").alias("min_bars"), F.max("bars").alias("max_bars"),
        F.count_if("complete").alias("complete_days"), F.count_if("half_day").alias("half_days"),
    )


def histogram(days: DataFrame, edges: tuple[int, ...] = (0, 10, 20, 30, 40, 48)) -> DataFrame:
    """lo, hi and the number of symbol days with that many bars; the last range is open."""
    bucket = None
    for lo, hi in zip(edges, [*edges[1:], None]):
        test = (F.col("bars") >= lo) & ((F.col("bars") < hi) if hi is not None else F.lit(True))
        cell = F.struct(F.lit(lo).alias("lo"), F.lit(hi).cast("int").alias("hi"))
        bucket = F.when(test, cell) if bucket is None else bucket.when(test, cell)
    return days.select(bucket.alias("b")).where("b is not null").groupBy("b.lo", "b.hi").agg(F.count("*").alias("n"))


def missing_minutes(bars: DataFrame) -> DataFrame:
    """symbol, date, ts: minutes that other symbols have that day, between the symbol's own first and last bar, and it doesn't."""
    spans = bars.groupBy("symbol", "date").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = bars.select("date", "ts").distinct().join(spans, "date").where("ts between a and b").select("symbol", "date", "ts")
    return grid.join(bars.select("symbol", "date", "ts"), ["symbol", "date", "ts"], "left_anti")


def coverage_by_time(bars: DataFrame) -> DataFrame:
    """time of day, and the share of symbol days that have a bar then."""
    total = bars.select("symbol", "date").distinct().agg(F.count("*").alias("all"))
    return bars.groupBy(F.date_format("ts", "HH:mm").alias("time")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("time", "n", (F.col("n") / F.col("all")).alias("share"))  # one row


def gaps(bars: DataFrame, minutes: int = 30) -> DataFrame:
    """symbol and date with the number of gaps longer than the bar width, and the longest in minutes."""
    from pyspark.sql import Window

    gap = (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(Window.partitionBy("symbol", "date").orderBy("ts")))) / 60
    return bars.select("symbol", "date", gap.alias("gap")).groupBy("symbol", "date").agg(F.count_if(F.col("gap") > minutes).alias("gaps"), F.max("gap").alias("longest"))
