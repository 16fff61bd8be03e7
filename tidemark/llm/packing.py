"""Mixture-controlled packing: deficit round-robin over source queues fills windows to target proportions.

As time passes, each source that has tokens left earns deficit at its weight. Whenever some deficit reaches half a token,
these sources, in order, send one token each and their deficit falls by one; windows are cut from the stream so made,
and deficits are carried from window to window. A source that runs dry earns no more, so that its share goes to the
others in proportion.

With a quantum of one token that has a closed form: token j of a source of weight w is sent at time (2j + 1) / 2w, and
its place in the stream is the number of tokens that all sources send up to then. Weights are whole numbers, times are
compared as fractions: places are exact. So any partition starts at any token with the deficits carried over from all
windows before it, without having seen them: nothing is sequential.

A queue is in hashed order of the blocks of a mix and of the documents within them. Its sums run within blocks and over
the blocks of a source, never over all rows of one.

Defined results
- Tokens are words. Queues of a mixed table are in the order of the mix: by epoch, block and document.
- A window has `window` tokens, the last what is left. Its segments stand by source, then in order of the queue.
- The text of a segment goes up to its next token, or to the end of the document, and begins with the document if it
  is its first: segments of a document one after another give its text. Repeated rows are documents of their own.
- Texts without tokens, null or empty ones, are placed nowhere. Null sources are a source of their own.
- Sources without a weight come last, in proportion to their sizes. Weights that are negative or no numbers: ValueError.
- doc_id is NULL where it can't be read as a whole number; such documents are packed as well.
- An empty table gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.arrays import flat, slices, strings, token_starts
from tidemark.llm.mixing import NO_SOURCE, block_of, block_order, doc_order, identity, n_tokens, number_copies, source_name
from tidemark.llm.shared import checkpointed, integer_id, plain

WHOLE = 1 << 30  # the largest weight as a whole number


@dataclass(frozen=True)
class Schedule:
    """The stream of all tokens. Sources of one rank share the stream; those of the next rank come after it."""

    sizes: np.ndarray  # tokens by source
    weights: np.ndarray  # whole numbers from 1 to WHOLE
    ranks: np.ndarray  # 0: with a weight, 1: without
    window: int

    @classmethod
    def build(cls, sizes: np.ndarray, weights: np.ndarray, window: int) -> "Schedule":
        """Weights are taken as multiples of the largest over WHOLE."""
        weights = np.asarray(weights, np.float64)
        if not np.isfinite(weights).all() or (weights < 0).any():
            raise ValueError("weights must be numbers from 0 on")
        if len(sizes) and 2 * int(np.max(sizes)) + 2 >= 1 << 62:
            raise ValueError("a source has too many tokens")
        ranks = (weights == 0).astype(np.int64)
        own = np.where(ranks == 0, weights, sizes)
        largest = np.array([own[ranks == r].max(initial=0) or 1.0 for r in (0, 1)])[ranks]
        return cls(np.asarray(sizes, np.int64), np.maximum(np.round(own / largest * WHOLE), 1).astype(np.int64), ranks, window)

    def position(self, source: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The place in the stream of a token of each source, by its number in the source's queue."""
        # with odd = 2 token + 1 and weight w, the tokens i of a source of weight a that come no later have (2i + 1) w <= odd a
        w = self.weights[source]
        times, rest = np.divmod(2 * token + 1, w)
        out = np.full(len(source), -1, np.int64)
        for t, (a, n, rank) in enumerate(zip(self.weights.tolist(), self.sizes.tolist(), self.ranks.tolist())):
            most = 2 * n + 2
            more = rest * a
            odd = np.minimum(times, most // a + 1) * a + more // w - ((source < t) & (more % w == 0))  # of equal times the first source
            own = self.ranks[source]
            out += np.where(own == rank, np.minimum((odd + 1) // 2, n), np.where(own > rank, n, 0))
        return out

    def pieces(self, source: np.ndarray, start: np.ndarray, size: np.ndarray, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, window, from, to) of the pieces of token ranges that begin at `start` of their queues, by row; of so many ranges at a time that about `chunk` numbers are in hand."""
        last = start + size - 1
        first_window, last_window = (self.position(source, x) // self.window for x in (start, last))
        cuts = last_window - first_window
        dense = cuts * 16 >= size  # rare tokens, nearly each in a window of its own: placed one by one
        work = np.cumsum(np.where(dense, size, cuts + 1))
        at = 0
        while at < len(source):
            to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + chunk)))
            yield self._pieces(source[at:to], start[at:to], size[at:to], first_window[at:to], cuts[at:to], dense[at:to], at)
            at = to

    def _pieces(self, source, start, size, first_window, cuts, dense, offset):
        n = np.where(dense, size - 1, cuts)
        row = np.repeat(np.arange(len(source)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1
        s, own = source[row], dense[row]
        # the end of a window: its first token behind is in (low, high]
        low = np.where(own, start[row] + step - 1, start[row])
        high = np.where(own, start[row] + step, start[row] + size[row] - 1)
        goal = (first_window[row] + step) * self.window
        while len(open_ := np.flatnonzero(high - low > 1)):
            mid = (low[open_] + high[open_]) // 2
            before = self.position(s[open_], mid) < goal[open_]
            low[open_], high[open_] = np.where(before, mid, low[open_]), np.where(before, high[open_], mid)
        # a range begins at its start and at every cut; equal cuts leave nothing between them
        everything = np.concatenate([np.arange(len(source)), row])
        begin = np.concatenate([start, high])
        order = np.lexsort((begin, everything))
        everything, begin = everything[order], begin[order]
        new = np.concatenate([[True], (everything[1:] != everything[:-1]) | (begin[1:] != begin[:-1])]) if len(begin) else np.zeros(0, bool)
        everything, begin = everything[new], begin[new]
        window = self.position(source[everything], begin) // self.window
        new = np.concatenate([[True], (everything[1:] != everything[:-1]) | (window[1:] != window[:-1])]) if len(begin) else np.zeros(0, bool)
        everything, begin, window = everything[new], begin[new], window[new]
        end = np.append(begin[1:], 0)
        final = np.append(everything[1:] != everything[:-1], True)[: len(begin)]
        end[final] = (start + size)[everything[final]]
        return everything + offset, window, begin - start[everything], end - start[everything]


def queues(docs: DataFrame, mixed: bool = False) -> tuple[DataFrame, DataFrame]:
    """The queued documents (source, block, doc_id, epoch, text, n, and within: the tokens of its block before it); and of each
    block of a source, by epoch, the tokens of the source before it and in it.

    Texts are shuffled once, by source and block: copies are numbered and sums run within that partitioning.
    """
    docs, _, (doc_id, source, text) = plain(docs, ("doc_id", "source", "text"))
    who = identity(F.col(doc_id), F.col(text))
    rows = docs.select(
        source_name(F.col(source)).alias("source"), block_of(who).alias("block"), who.alias("own"), integer_id(doc_id).alias("doc_id"),
        F.xxhash64(F.col(text)).alias("hash"), n_tokens(F.col(text)).alias("n"), F.col(text).alias("text"),
    ).where("n > 0")

    def placed(rows: DataFrame) -> DataFrame:
        return number_copies(rows, ("source", "block", "own", "doc_id", "hash", "n")) if mixed else rows.withColumn("epoch", F.lit(0).cast("long"))

    of_source = Window.partitionBy("source").orderBy("epoch", "block_order", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed(rows.drop("text")).groupBy("source", "block", "epoch").agg(F.sum("n").alias("n"))
    blocks = checkpointed(
        blocks.withColumn("block_order", block_order(F.col("source"), F.col("block"), F.col("epoch")))
        .withColumn("base", F.coalesce(F.sum("n").over(of_source), F.lit(0))).select("source", "block", "epoch", "n", "base")
    )
    own = Window.partitionBy("source", "block", "epoch").orderBy(doc_order(F.col("own"), F.col("epoch")), "own", "hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return placed(rows.repartition("source", "block")).withColumn("within", F.coalesce(F.sum("n").over(own), F.lit(0))), blocks


SCHEMA = "window_id long, number int, at long, source string, doc_id long, epoch long, token_start long, token_end long, text string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def pack(docs: DataFrame, window: int = 4096, weights: dict[str | None, float] | None = None, mixed: bool = False) -> DataFrame:
    """One row a window: window_id, n_tokens, doc_ids and segments (source, doc_id, epoch, token_start, token_end, text).

    weights: target proportions by source; None takes those of the table itself, so that all queues end together.
    mixed: docs are what `mixing.mix` took with its defaults, and the queues are in its order.
    """
    queued, blocks = queues(docs, mixed)
    totals = blocks.groupBy("source").agg(F.sum("n").alias("n")).orderBy("source").toArrow().to_pydict()  # a row a source
    names, sizes = totals["source"], np.array(totals["n"], np.int64)
    given = None if weights is None else {NO_SOURCE if k is None else k: v for k, v in weights.items()}
    schedule = Schedule.build(sizes, sizes if given is None else np.array([given.get(n, 0.0) for n in names], np.float64), window)
    number = {n: i for i, n in enumerate(names)}

    def run(batches):
        for batch in batches:
            label = batch.column("source")
            source = np.array([number[s] for s in label.to_pylist()], np.int64)
            n, start = np.asarray(batch.column("n")), np.asarray(batch.column("start"))
            for first, own in slices(strings(batch.column("text"))):
                body, at = flat(own, lower=False)
                tokens, data = token_starts(body), body.tobytes()
                head, to = np.searchsorted(tokens, at), first + len(own)
                for row, k, a, b in schedule.pieces(source[first:to], start[first:to], n[first:to]):
                    begin = np.where(a == 0, at[row], tokens[head[row] + a])
                    end = np.where(b == n[first + row], at[row + 1] - 1, tokens[np.minimum(head[row] + b, len(tokens) - 1)])
                    took = pa.array(first + row)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(k), pa.array(source[first + row].astype(np.int32)), pa.array(start[first + row] + a), label.take(took), batch.column("doc_id").take(took),
                        batch.column("epoch").take(took), pa.array(a), pa.array(b), pa.array([data[x:y] for x, y in zip(begin.tolist(), end.tolist())], pa.string()),
                    ], names=_NAMES)

    bases = blocks.groupBy("source", "block").agg(F.map_from_entries(F.collect_list(F.struct("epoch", "base"))).alias("bases"))
    pieces = (
        queued.join(bases, ["source", "block"])
        .select("source", "doc_id", "epoch", "text", "n", (F.element_at("bases", F.col("epoch")) + F.col("within")).alias("start")).mapInArrow(run, SCHEMA)
    )
    whole = pieces.groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct(*_NAMES[1:]))).alias("s"))
    kept = lambda x: F.struct(F.nullif(x["source"], F.lit(NO_SOURCE)).alias("source"), *(x[c].alias(c) for c in _NAMES[4:]))
    return whole.select(
        "window_id", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["token_end"] - x["token_start"]).alias("n_tokens"),
        F.transform("s", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("s", kept).alias("segments"),
    )
