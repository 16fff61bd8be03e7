"""One query a factor."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import factors
from tidemark.plans import sql
from tidemark.sources import synthetic
from tidemark.sources.bars import densify

#: Thresholds for three symbols and 48 bars a day instead of hundreds of symbols and 390 bars.
SMALL = {
    "battle": {"min_bars": 20, "min_valid": 8}, "surge": {"min_bars": 20, "min_valid": 8}, "fuzzy": {"min_bars": 20, "min_valid": 8, "min_foggy": 3},
    "rebuild": {"min_bars": 15, "min_valid": 8, "min_high": 2}, "regression": {"min_bars": 20, "min_symbols": 3}, "microstructure": {"min_bars": 20, "min_calm": 5, "min_symbols": 3},
}
DIGITS = {"technical": 5, "reversal": 6, "fundamental": 5}


def daily_of_intraday(bars):
    return bars.groupBy("symbol", "date").agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))


def group_table(spark, sf_dir, group):
    """All factors of a group over the test tables."""
    options = SMALL.get(group, {})
    if group in ("technical", "reversal", "fundamental"):
        grid = densify(synthetic.daily_bars(spark, sf_dir))
        return factors.fundamental(grid, synthetic.statements(spark, sf_dir)) if group == "fundamental" else getattr(factors, group)(grid)
    bars = synthetic.intraday_bars(spark, sf_dir)
    if group == "battle":
        return factors.battle(bars, **options)
    grid = factors.day_grid(bars)
    if group in ("jump", "microstructure"):
        return getattr(factors, group)(grid, daily_of_intraday(bars), **options)
    return getattr(factors, group)(grid, **options)


def _query(name, group):
    digits = DIGITS.get(group, 5)

    def run(spark, sf_dir):
        table = group_table(spark, sf_dir, group)
        return table.where(F.col(name).isNotNull()).select("date", "symbol", (F.round(name, digits) + 0.0).alias("value"))

    return run


QUERIES = {f"factor_{name.lower()}": _query(name, group) for name, group in factors.FACTORS.items()}
ORACLE_SQL = {f"factor_{name.lower()}": sql.factor(group, name, DIGITS.get(group, 5)) for name, group in factors.FACTORS.items() if group in sql.GROUPS}
