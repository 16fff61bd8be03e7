"""Registry of option strategies and the life of their streaming queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import options
from tidemark.streaming import flows


@dataclass(frozen=True)
class Strategy:
    """From a stream of quotes of its name to actions. `poll` seconds between batches."""

    name: str
    actions: Callable[[DataFrame], DataFrame]
    poll: int
    about: str = ""


REGISTRY: dict[str, Strategy] = {}


def register(strategy: Strategy) -> Strategy:
    if strategy.name in REGISTRY:
        raise ValueError(f"there is a strategy {strategy.name} already")
    REGISTRY[strategy.name] = strategy
    return strategy


register(Strategy("same-day-condor", lambda quotes: flows.condor_states(quotes), 45, "closed by the end of its day"))
register(Strategy("monthly-condor", lambda quotes: flows.condor_states(quotes, exit_days=30, half_on_risk=True), 300, "half closed on risk, closed 30 days before expiry"))


@dataclass
class Manager:
    """Starts registered strategies on streams of quotes (column `strategy`) and writes their actions as JSON."""

    spark: SparkSession
    root: str
    running: dict[str, StreamingQuery] = field(default_factory=dict)

    def start(self, name: str, quotes: DataFrame, once: bool = False) -> StreamingQuery:
        """once: take what there is and end."""
        strategy = REGISTRY[name]
        if name in self.running and self.running[name].isActive:
            raise ValueError(f"{name} is running")
        writer = strategy.actions(quotes.where(quotes["strategy"] == name)).writeStream.queryName(name).format("json").option("checkpointLocation", f"{self.root}/state/{name}")
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{strategy.poll} seconds")
        self.running[name] = writer.start(f"{self.root}/actions/{name}")
        return self.running[name]

    def stop(self, name: str) -> None:
        self.running.pop(name).stop()

    def status(self) -> dict[str, str]:
        """running, ended or idle of every registered strategy; the error where one failed."""
        out = {}
        for name in REGISTRY:
            query = self.running.get(name)
            out[name] = "idle" if query is None else "running" if query.isActive else f"failed: {query.exception()}" if query.exception() else "ended"
        return out

    def summary(self, log: DataFrame) -> DataFrame:
        """One row of results of a trade log in either form."""
        return options.trade_summary(options.all_trips(log))
