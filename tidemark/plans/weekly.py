"""The weekly pipeline end to end: factors to weeks, screening, panel, walk-forward prediction, evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import factors as library, ml, research
from tidemark.sources import synthetic
from tidemark.sources.bars import densify


@dataclass
class WeeklyResult:
    kept: list[str]
    summary: DataFrame
    predictions: DataFrame
    returns: DataFrame


def run(factors: DataFrame, grid: DataFrame, model: str = "ridge", ic_threshold: float = 0.005, corr_threshold: float = 0.7, least: int = 20, groups: DataFrame | None = None, top: int = 30, **options) -> WeeklyResult:
    """factors: date, symbol, factor, value. grid: the dense grid of daily closes. groups: factor, report; with it only the
    best factor of each report is screened. Greedy pruning and the loop over dates are the only steps on the driver."""
    weekly = research.prepare_weekly(factors, grid).cache()
    if groups is not None:
        best = research.best_per_group(research.ic_summary(research.rank_ic(weekly, least)), groups).select("factor")
        weekly = weekly.join(best, "factor", "left_semi")
    forward = weekly.select("date", "symbol", "fwd").distinct()
    names = [r.factor for r in weekly.select("factor").distinct().orderBy("factor").collect()]  # a row a factor
    kept, summary = research.screen(weekly.select("date", "symbol", "factor", "value"), forward, names, ic_threshold, corr_threshold, least)
    used = kept or names
    panel = ml.panel(weekly.where(F.col("factor").isin(used)), forward, used).cache()
    predictions = ml.equal_weight(panel, used) if model == "equal_weight" else ml.walk_forward(panel, used, model, **options)
    return WeeklyResult(kept, summary, predictions, research.evaluate_predictions(predictions, top=top, least=least))


def all_factors(spark: SparkSession, sf_dir: str, days: int = 120) -> tuple[DataFrame, DataFrame]:
    """(the dense grid of daily closes, long rows of all 46 factors) over the last `days` dates, with the library's own thresholds."""
    daily, minutes = synthetic.daily_bars(spark, sf_dir), synthetic.minute_bars(spark, sf_dir, days)
    grid = densify(daily).cache()
    intraday = library.day_grid(minutes).cache()  # read by eight groups
    begin = minutes.agg(F.min("date").alias("begin"))
    recent = daily.join(begin, F.col("date") >= F.col("begin")).drop("begin")
    made = {
        "technical": lambda: library.technical(grid), "reversal": lambda: library.reversal(grid), "fundamental": lambda: library.fundamental(grid, synthetic.statements(spark, sf_dir)),
        "battle": lambda: library.battle(minutes), "jump": lambda: library.jump(intraday, recent), "microstructure": lambda: library.microstructure(intraday, recent),
    }
    parts = [library.to_long(made[g]() if g in made else getattr(library, g)(intraday), list(names)) for g, names in library.GROUPS.items()]
    rows = reduce(DataFrame.unionByName, parts)
    return grid, rows.join(begin, F.col("date") >= F.col("begin")).drop("begin")
