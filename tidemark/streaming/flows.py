"""Streaming counterparts: bars from ticks, sessions, idempotent ingest, orders filled at the next bar, condor states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars(ticks: DataFrame, width: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Bars of ticks (ts, symbol, price, size) by event time; windows close once the watermark has passed."""
    at = F.struct("ts", "price")
    return (
        ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "symbol")
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
        .select(F.col("window.start").alias("ts"), "symbol", "open", "high", "low", "close", "volume")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of events of a user without a pause of `gap`."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
    )


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


FILL = "symbol string, ts timestamp, quantity long, price double, position long"


def next_bar_fills(updates: DataFrame) -> DataFrame:
    """Fills of orders at the next bar of their symbol, and the position after each.

    updates: symbol, ts, kind (bar, order), price (of bars), quantity (of orders). State: the pending quantity with its time, and the position.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        pending, since, position = state.get if state.exists else (0, pd.Timestamp(0), 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "kind"])
        out = []
        for r in rows.itertuples():
            if r.kind == "order":
                pending, since = pending + int(r.quantity), r.ts
            elif pending and r.ts > since:
                position += pending
                out.append((key[0], r.ts, pending, r.price, position))
                pending = 0
        state.update((pending, pd.Timestamp(since).to_pydatetime(), position))
        yield pd.DataFrame(out, columns=["symbol", "ts", "quantity", "price", "position"])

    return updates.groupBy("symbol").applyInPandasWithState(run, FILL, "pending long, since timestamp, position long", "append", GroupStateTimeout.NoTimeout)


ACTION = "strategy string, ts timestamp, action string, quantity long, pnl double"


def condor_states(quotes: DataFrame, take_profit: float = 0.5, stop: float = 2.0, proximity: float = 0.005, exit_days: int = 0, half_on_risk: bool = False) -> DataFrame:
    """Enter and leave a condor by quotes: strategy, ts, enter, quantity, filled, spot, short_put, short_call, combo_mid, dte, end_of_day.

    Order of rules: end of day or days left, risk (half the position with half_on_risk), profit or loss, entry. What isn't `filled`
    stays open and is tried again.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        held, credit, halved = state.get if state.exists else (0, 0.0, False)
        out = []
        for r in pd.concat(list(frames)).sort_values("ts").itertuples():
            action, part = "", held
            if held:
                if r.end_of_day or r.dte <= exit_days:
                    action = "CLOSE_TIME"
                elif (r.spot <= r.short_put * (1 + proximity) or r.spot >= r.short_call * (1 - proximity)) and not halved:
                    action, part = "CLOSE_RISK", -(-held // 2) if half_on_risk and held > 1 else held
                elif r.combo_mid <= credit * (1 - take_profit):
                    action = "TAKE_PROFIT"
                elif r.combo_mid >= credit * stop:
                    action = "STOP_LOSS"
                if action:
                    part = min(part, int(r.filled))
                    held -= part
                    halved = action == "CLOSE_RISK" and held > 0
                    out.append((key[0], r.ts, action, part, (credit - r.combo_mid) * 100 * part))
            elif r.enter and not r.end_of_day:
                held, credit, halved = int(r.quantity), float(r.combo_mid), False
                out.append((key[0], r.ts, "OPEN", held, 0.0))
        state.update((held, credit, halved))
        yield pd.DataFrame(out, columns=["strategy", "ts", "action", "quantity", "pnl"])

    return quotes.groupBy("strategy").applyInPandasWithState(run, ACTION, "held long, credit double, halved boolean", "append", GroupStateTimeout.NoTimeout)


def lagged(rows: DataFrame, value: str, lag: int = 1, window: int = 20, key: str = "symbol") -> DataFrame:
    """Positional lag and rolling mean on a stream: key, ts, value, lagged (the value `lag` rows before) and mean (of the last `window`, NULL before there are as many).

    State: the last max(lag + 1, window) values of a key. Rows of a batch are taken in order of ts; later ones of an earlier time count as they come.
    """
    keep = max(lag + 1, window)

    def run(own, frames: Iterator[pd.DataFrame], state: GroupState):
        (seen,) = state.get if state.exists else ([],)
        seen, out = list(seen), []
        for r in pd.concat(list(frames)).sort_values("ts").itertuples():
            seen = [*seen, float(r.value)][-keep:]
            out.append((own[0], r.ts, r.value, seen[-1 - lag] if len(seen) > lag else None, sum(seen[-window:]) / window if len(seen) >= window else None))
        state.update((seen,))
        found = pd.DataFrame(out, columns=["key", "ts", "value", "lagged", "mean"])
        yield found.astype({"value": float, "lagged": float, "mean": float})

    picked = rows.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))
    return picked.groupBy("key").applyInPandasWithState(run, "key string, ts timestamp, value double, lagged double, mean double", "seen array<double>", "append", GroupStateTimeout.NoTimeout)
