"""Temperature mixing: source token shares to a power, the power bisected to a target entropy or repetition limit.

The weights are realised as budgeted block permutations. Documents of a source fall into hashed blocks; each
epoch visits the blocks of a source in another hashed order, and documents of a block in hashed order, until
the source's token budget is spent. The end of a budget is a pair of hash values, so taking part is decided
row by row against one small row a source: the texts are never shuffled. Places in the permutation are hash values
as well: a source is visited in order of (epoch, block_order, doc_order).

The driver gets one row a source. Sums by block and the search for the ends of budgets stay on the executors; the one
sorted group of a source is the block in which its budget ends, 1 / `blocks` of the source.

Defined results
- Null sources are one source of their own. Null and empty texts have no tokens: they cost nothing and go
  with their block; a source without any token has weight 0 and all its documents are left out.
- Repeated rows of a document have the same hashes and stand or fall together. Documents without an id are told
  apart by their texts.
- The last epoch never exceeds the budget; it may fall short by less than one document (with its repeats).
- An empty table gives an empty table. All columns are kept, whatever their names; one named `epoch` is replaced, and
  with places those named `block_order` and `doc_order`. Columns are found without regard to case.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.shared import checkpointed, plain, small_table

NO_SOURCE = "\ue000none"  # a character for private use: no source is named so
#: Columns by which the mix visits the documents of a source.
PLACES = ["epoch", "block_order", "doc_order"]
BLOCKS = 4096


def n_tokens(text: Column) -> Column:
    """Words separated by white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def source_name(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit(NO_SOURCE))


def identity(doc_id: Column, text: Column) -> Column:
    """What tells documents apart: a hash of the id, without one that of the text."""
    return F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id))


def weights_at(shares: np.ndarray, power: float) -> np.ndarray:
    logs = np.where(shares > 0, power * np.log(np.maximum(shares, 1e-300)), -np.inf)
    w = np.exp(logs - logs.max())
    return w / w.sum()


def entropy(w: np.ndarray) -> float:
    w = w[w > 0]
    return float(-(w * np.log(w)).sum())


def _bisect(low: float, high: float, too_low) -> float:
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if too_low(mid) else (low, mid)
    return high


def solve_power(tokens: np.ndarray, entropy_share: float, max_epochs: float, budget: float) -> float:
    """The exponent whose weights have entropy_share of the largest possible entropy; nearer to 1 if else a
    source would be repeated more than max_epochs times. Raises ValueError if even exponent 1 repeats more."""
    some = tokens > 0
    n = int(some.sum())
    if n < 2:
        return 1.0
    shares = tokens / tokens.sum()
    target = entropy_share * np.log(n)
    high = 1.0
    while entropy(weights_at(shares, high)) > target and high < 64:
        high *= 2
    power = _bisect(0.0, high, lambda a: entropy(weights_at(shares, a)) > target)

    def repeats(a: float) -> float:
        return float((budget * weights_at(shares, a)[some] / tokens[some]).max())

    if repeats(power) > max_epochs:
        if repeats(1.0) > max_epochs * (1 + 1e-12):
            raise ValueError("the budget repeats every source more often than max_epochs")
        if power < 1:
            power = _bisect(power, 1.0, lambda a: repeats(a) > max_epochs)
        else:
            power = 1 + power - _bisect(1.0, power, lambda a: repeats(1 + power - a) > max_epochs)
    return power


@dataclass(frozen=True)
class Mix:
    """The solved mix: one row a source of (source, tokens, weight, budget, full epochs, last block, last document)."""

    power: float
    rows: tuple[tuple, ...]

    def weights(self) -> dict[str, float]:
        return {r[0]: r[2] for r in self.rows}


def block_of(own: Column, blocks: int = BLOCKS, seed: int = 1) -> Column:
    return F.pmod(F.xxhash64(own, F.lit(seed)), F.lit(blocks))


def block_order(source: Column, block: Column, epoch: Column, seed: int = 1) -> Column:
    return F.xxhash64(source, block, epoch, F.lit(seed), F.lit("block"))


def doc_order(own: Column, epoch: Column, seed: int = 1) -> Column:
    return F.xxhash64(own, epoch, F.lit(seed), F.lit("doc"))


def solve(docs: DataFrame, entropy_share: float = 0.97, max_epochs: float = 4.0, budget_tokens: int | None = None, blocks: int = BLOCKS, seed: int = 1) -> Mix:
    """Solve the mix over all documents."""
    spark = docs.sparkSession
    docs, _, (doc_id, source, text) = plain(docs, ("doc_id", "source", "text"))
    own = identity(F.col(doc_id), F.col(text))
    rows = docs.select(source_name(F.col(source)).alias("source"), own.alias("own"), block_of(own, blocks, seed).alias("block"), F.col(text).alias("text"))
    sums = checkpointed(rows.withColumn("n", n_tokens(F.col("text"))).groupBy("source", "block").agg(F.sum("n").alias("n")))
    totals = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy("source").toArrow()  # a row a source
    names, tokens = totals["source"].to_pylist(), np.array(totals["n"].to_pylist(), np.float64)
    if tokens.sum() == 0:
        return Mix(1.0, ())
    budget = float(budget_tokens if budget_tokens is not None else tokens.sum())
    power = solve_power(tokens, entropy_share, max_epochs, budget)
    w = weights_at(tokens / tokens.sum(), power)
    budgets = np.floor(budget * w + 1e-6).astype(np.int64)
    full, rest = np.divmod(budgets, np.maximum(tokens, 1).astype(np.int64))
    # of the last, partial epoch of each source the first block that doesn't fit, in order of their keys
    wanted = small_table(spark, list(zip(names, full.tolist(), rest.tolist())), pa.schema({"source": pa.string(), "full": pa.int64(), "left": pa.int64()}))
    before = Window.partitionBy("source").orderBy("key", "block").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        sums.join(wanted, "source").withColumn("key", block_order(F.col("source"), F.col("block"), F.col("full"), seed))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where("before + n > left")
        .groupBy("source").agg(F.min_by(F.struct("block", "key", "full", (F.col("left") - F.col("before")).alias("left")), F.struct("key", "block")).alias("cut"))
        .select("source", "cut.*").toArrow().to_pylist()
    )
    cut = {r["source"]: r["key"] for r in cuts}
    # within that block, the first document that doesn't fit
    at_end = small_table(spark, [(r["source"], r["block"], r["full"], r["left"]) for r in cuts], pa.schema({"source": pa.string(), "block": pa.int64(), "full": pa.int64(), "left": pa.int64()}))
    within = Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    ended = {r["source"]: r["key"] for r in (
        rows.join(at_end, ["source", "block"])
        .select("source", "left", doc_order(F.col("own"), F.col("full"), seed).alias("key"), n_tokens(F.col("text")).alias("n"))
        .withColumn("sum", F.sum("n").over(within)).where("sum > left")
        .groupBy("source").agg(F.min("key").alias("key")).toArrow().to_pylist()
    )}
    solved = zip(names, tokens.astype(int).tolist(), w.tolist(), budgets.tolist(), full.tolist())
    return Mix(power, tuple((s, t, x, b, f, cut.get(s), ended.get(s)) for s, t, x, b, f in solved if t > 0))


def mix(docs: DataFrame, solved: Mix, blocks: int = BLOCKS, seed: int = 1, places: bool = False) -> DataFrame:
    """The rows of docs, as often as the mix takes them, with the `epoch` of each (0 is the first). No shuffle, unless there
    are so many sources that their table exceeds the planner's limit for broadcasts.

    places: with block_order and doc_order, by which each epoch of a source is ordered.
    """
    spark: SparkSession = docs.sparkSession
    added = PLACES if places else PLACES[:1]
    docs, names, (doc_id, source, text) = plain(docs, ("doc_id", "source", "text"), added)
    own = docs.columns
    ends = small_table(
        spark, [(s, f, kb, kd) for s, _, _, _, f, kb, kd in solved.rows],
        pa.schema({"source": pa.string(), "full": pa.int64(), "cut_block": pa.int64(), "cut_doc": pa.int64()}),
    )
    who = identity(F.col(doc_id), F.col(text))
    key = block_order(F.col("source"), F.col("block"), F.col("full"), seed)
    last = (
        F.col("cut_block").isNull() | (key < F.col("cut_block"))
        | ((key == F.col("cut_block")) & (F.col("cut_doc").isNull() | (doc_order(F.col("own"), F.col("full"), seed) < F.col("cut_doc"))))
    )
    taken = (
        docs.withColumns({"source": source_name(F.col(source)), "own": who, "block": block_of(who, blocks, seed)}).join(ends, "source")
        .withColumn("times", F.col("full") + last.cast("long")).where("times > 0")
        .select(*own, "source", "own", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("epoch"))
    )
    orders = {"block_order": block_order(F.col("source"), F.col("block"), F.col("epoch"), seed), "doc_order": doc_order(F.col("own"), F.col("epoch"), seed)}
    return taken.withColumns(orders).select(*own, *added).toDF(*names, *added)


def number_copies(mixed: DataFrame, same: tuple[str, ...]) -> DataFrame:
    """The epochs again, of a mix in which they were dropped. same: what tells rows apart.

    A row the mix took n times stands in its epochs 0 to n - 1, so that its copies are just numbered. Rows that were
    repeated before the mix count as further copies, in later epochs.
    """
    return mixed.withColumn("epoch", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))).cast("long") - 1)
