"""SimHash near-dedup with a Gray-order hierarchical index.

A document's fingerprint has 128 bits: the signs of the sums, over its distinct words, of random signs weighted
by word length, of which 63 bytes count (so that one long blob doesn't decide all signs). Near copies differ in few bits,
and 64 bits would not tell 15 % of edited words from chance.

Fingerprints are spread by `tables` keys of `key_bits` sampled bits each; two of them are compared where a key is the same.
Within a key they are sorted by Gray rank, so that neighbours share bits. Runs of `FANOUT` become a node that holds
the bits on which all below it agree, less those its own parent holds. A search goes down from the top, adds up
the differences on the shared bits, and drops a whole group when the sum exceeds `max_distance`.

Of all pairs within a key only as many are kept as connect the same documents: a union-find takes each block of pairs as
it is found, and a search then also drops nodes whose documents are all connected with its own. So thousands of near
copies cost no pairs each, and memory is bounded by the entries in hand. Equal fingerprints are one entry from the start.

Connected documents form a group; the one with the lowest doc_id (of equal ones that with the lowest hash of its text) stays.

Defined results
- Texts without words (null, empty, punctuation) have no fingerprint and are in no group; nor are rows whose doc_id is
  missing or can't be read as a whole number. All of these stay.
- A document is a doc_id with a text. Rows that repeat both are one document: `deduplicate` keeps one of them, that of the
  lowest hash of all columns. Rows that repeat a doc_id with other texts are decided each by its text; `near_duplicates`
  names a doc_id if one of its texts goes for another doc_id.
- Other columns are kept by `deduplicate`, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.arrays import flat, mix, slices, span_hashes, strings, word_spans
from tidemark.llm.shared import checkpointed, integer_id, plain

U = np.uint64
FANOUT = 8
ALL = U(0xFFFFFFFFFFFFFFFF)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High and low 64 bits of each text's fingerprint, and whether it has one."""
    high, low, some = np.zeros(len(texts), U), np.zeros(len(texts), U), np.zeros(len(texts), bool)
    for first, own in slices(texts):
        body, at = flat(own)
        starts, ends = word_spans(body)
        rows = (np.searchsorted(at, starts, "right") - 1).astype(U)
        # a word once a text: 20 bits of row, 38 of hash and 6 of length in one number
        words = span_hashes(body, starts, ends) >> U(26) << U(6) | np.minimum(ends - starts, 63).astype(U)
        words = np.unique(rows << U(44) | words)
        if not len(words):
            continue
        of = (words >> U(44)).astype(np.int64)
        heads = np.flatnonzero(np.diff(of, prepend=-1))
        there = first + of[heads]
        words &= ALL >> U(20)
        weight = (words & U(63)).astype(np.int32)
        total = np.add.reduceat(weight, heads)
        some[there] = True
        for out, salt in ((high, U(0x6A09E667F3BCC908)), (low, U(0xBB67AE8584CAA73B))):
            code = mix(words ^ salt)
            sign = np.zeros(len(heads), U)
            for b in range(64):
                on = np.add.reduceat(((code >> U(b)) & U(1)).astype(np.int32) * weight, heads)
                sign |= (2 * on > total).astype(U) << U(b)
            out[there] = sign
    return high, low, some


def gray_rank(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The position of 128-bit codes in the reflected Gray sequence."""

    def rank(x):
        for s in (1, 2, 4, 8, 16, 32):
            x = x ^ (x >> U(s))
        return x

    top = rank(high)
    return top, rank(low) ^ np.where(top & U(1), ALL, U(0))


def _popcount(high, low):
    return np.bitwise_count(high).astype(np.int16) + np.bitwise_count(low)


class GrayIndex:
    """The index over entries of one or more keys, sorted by key and Gray rank."""

    def __init__(self, keys: np.ndarray, high: np.ndarray, low: np.ndarray):
        self.order = np.lexsort((*reversed(gray_rank(high, low)), keys))
        keys, high, low = keys[self.order], high[self.order], low[self.order]
        self.keys = keys
        # by level from the leaves: agreed bits (mask), their values, bits held here and not by the parent
        self.values, self.masks = [(high, low)], [(np.full(len(high), ALL), np.full(len(low), ALL))]
        while len(self.values[-1][0]) > FANOUT:
            (h, l), (mh, ml) = self.values[-1], self.masks[-1]
            at = np.arange(0, len(h), FANOUT)
            ones = [np.bitwise_and.reduceat(x & m, at) for x, m in ((h, mh), (l, ml))]
            zeros = [np.bitwise_and.reduceat(~x & m, at) for x, m in ((h, mh), (l, ml))]
            self.values.append(tuple(ones))
            self.masks.append(tuple(a | b for a, b in zip(ones, zeros)))
        self.held = []
        for level, (mh, ml) in enumerate(self.masks):
            if level + 1 < len(self.masks):
                up = np.arange(len(mh)) // FANOUT
                ph, pl = self.masks[level + 1]
                mh, ml = mh & ~ph[up], ml & ~pl[up]
            self.held.append((mh, ml))

    def _differences(self, level: int, q: np.ndarray, node: np.ndarray, masks) -> np.ndarray:
        (h, l), (mh, ml) = self.values[level], masks
        qh, ql = self.values[0]
        return _popcount((h[node] ^ qh[q]) & mh[node], (l[node] ^ ql[q]) & ml[node])

    def pairs(self, limit: int, label: np.ndarray | None = None, chunk: int = 1 << 20):
        """Yields (i, j, distance) of sorted entries of the same key, i before j, no farther apart than the limit.

        label: the component of each entry, which the caller changes in place between blocks; pairs within one are left out.
        About `chunk` numbers are in hand at a time.
        """
        n = len(self.keys)
        starts = np.flatnonzero(np.concatenate([[True], self.keys[1:] != self.keys[:-1]])) if n else np.zeros(0, int)
        ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
        left = ends - np.arange(n) - 1  # entries of the key behind each
        begin = np.zeros(n, np.int64)  # the level at which a search starts: few nodes cover what is behind
        for level in range(1, len(self.values)):
            begin[left > 4 * FANOUT**level] = level
        same = self._joined(label)
        top = len(self.values) - 1
        work = np.cumsum(left // FANOUT**begin + 2)
        at = 0
        while at < n:
            to = min(n, max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + chunk // FANOUT))))
            # searches from the top down; a block that would grow too large is cut, and its halves go down one by one
            stack = [(top, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16), np.arange(at, to))]
            while stack:
                level, q, node, sums, new = stack.pop()
                if level < top and len(q) * FANOUT > chunk and len(q) > 1:
                    half = len(q) // 2
                    stack.append((level, q[half:], node[half:], sums[half:], new[:0]))
                    q, node, sums = q[:half], node[:half], sums[:half]
                    if len(new):
                        stack.append((level, q[:0], node[:0], sums[:0], new))
                        new = new[:0]
                    stack.append((level, q, node, sums, new))
                    continue
                q, node, sums, new = self._step(level, q, node, sums, new, begin, ends, limit, same, label)
                if level and (len(q) or len(new)):
                    stack.append((level - 1, q, node, sums, new))
                elif len(q):
                    yield q, node, sums
                    same = self._joined(label)
            at = to

    def _joined(self, label: np.ndarray | None) -> list[np.ndarray] | None:
        """The component of each node, by level: -1 where its entries are of several."""
        if label is None:
            return None
        out = [label]
        for _ in self.values[1:]:
            at = np.arange(0, len(out[-1]), FANOUT)
            low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(low == high, low, -1))
        return out

    def _step(self, level, q, node, sums, new, begin, ends, limit, same, label):
        """One level down: children of what is left of the level above, and the searches that start here."""
        width = FANOUT**level
        if len(q):
            q, sums = np.repeat(q, FANOUT), np.repeat(sums, FANOUT)
            node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            ok = node < len(self.values[level][0])
            ok &= (node * width < ends[q]) & ((node + 1) * width - 1 > q)
            if same is not None:
                ok[ok] &= same[level][node[ok]] != label[q[ok]]
            q, node, sums = q[ok], node[ok], sums[ok]
            sums = sums + self._differences(level, q, node, self.held[level])
        own = new[(begin[new] == level) & (new + 1 < ends[new])]
        if len(own):
            first, last = (own + 1) // width, (ends[own] - 1) // width
            times = last - first + 1
            nq = np.repeat(own, times)
            nn = np.repeat(first - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))
            if same is not None:
                ok = same[level][nn] != label[nq]
                nq, nn = nq[ok], nn[ok]
            found = self._differences(level, nq, nn, self.masks[level])
            q, node, sums = np.concatenate([q, nq]), np.concatenate([node, nn]), np.concatenate([sums, found])
        ok = sums <= limit
        return q[ok], node[ok], sums[ok], new[begin[new] < level]


def table_bits(tables: int, key_bits: int) -> np.ndarray:
    """The bit positions that make up each table's key. As many bits in all tables as can be, else as seldom twice."""
    rng = np.random.default_rng(128)
    pool = np.concatenate([rng.permutation(128) for _ in range(-(-tables * key_bits // 128) + 1)])
    out, at = [], 0
    for _ in range(tables):
        own = list(dict.fromkeys(pool[at : at + key_bits].tolist()))
        at += key_bits
        own += [b for b in rng.permutation(128).tolist() if b not in own][: key_bits - len(own)]
        out.append(own)
    return np.array(out)


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The lowest member of the component of each of n items."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites the components of i and j in place. label: the lowest member of each item's component."""
    a, b = label[i], label[j]
    apart = a != b
    if apart.any():
        some, back = np.unique(np.concatenate([a[apart], b[apart]]), return_inverse=True)
        to = np.arange(len(label))
        half = len(back) // 2
        to[some] = some[_components(len(some), back[:half], back[half:])]
        label[:] = to[label]


def similar(prints: DataFrame, max_distance: int, tables: int, key_bits: int, chunk_rows: int = 200_000) -> DataFrame:
    """Edges (a, b) with a > b that connect the ids of fingerprints at most max_distance apart, found by a common key.

    prints: id, high, low; distinct fingerprints.
    """
    bits = table_bits(tables, key_bits)

    def spread(batches):
        for batch in batches:
            high, low = (np.asarray(batch.column(c)).view(U) for c in ("high", "low"))
            for t, own in enumerate(bits):
                key = np.full(len(high), t, np.int64)
                for b in own.tolist():
                    key = key << 1 | (((low if b < 64 else high) >> U(b % 64)) & U(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), *(batch.column(c) for c in ("id", "high", "low"))], names=["key", "id", "high", "low"])

    def edges(keys, ids, high, low):
        index = GrayIndex(keys, high.view(U), low.view(U))
        ids = ids[index.order]
        label = np.arange(len(ids))
        for i, j, _ in index.pairs(max_distance, label):
            join(label, i, j)
        at = np.flatnonzero(label != np.arange(len(ids)))
        if len(at):
            a, b = ids[at], ids[label[at]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    def search(batches):
        kept, rows = [], 0
        for batch in batches:
            kept.append([np.asarray(batch.column(c)) for c in ("key", "id", "high", "low")])
            rows += batch.num_rows
            if rows >= chunk_rows:
                columns = [np.concatenate(x) for x in zip(*kept)]
                cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last key may go on
                if cut:
                    yield from edges(*(c[:cut] for c in columns))
                kept, rows = [[c[cut:] for c in columns]], len(columns[0]) - cut
        if rows:
            yield from edges(*(np.concatenate(x) for x in zip(*kept)))

    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        prints.select("id", "high", "low").mapInArrow(spread, "key long, id long, high long, low long")
        .repartition(parts, "key").sortWithinPartitions("key").mapInArrow(search, "a long, b long")
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of all ids in edges (a, b) with a > b: root is the lowest id connected. Alternates large and small stars."""
    edges = checkpointed(edges.distinct())
    before = None
    while True:
        both = edges.unionByName(edges.selectExpr("b a", "a b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").selectExpr("b a", "m b").where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").selectExpr("b a", "m b").unionByName(low.selectExpr("a", "m b")).where("a > b")
        edges = checkpointed(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now


def _fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), high, low: of every document that has a fingerprint."""
    docs, _, (doc_id, text) = plain(docs, ("doc_id", "text"))

    def run(batches):
        for batch in batches:
            high, low, some = fingerprints(strings(batch.column("text")))
            at = np.flatnonzero(some)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in ("doc_id", "hash")), pa.array(high[at].view(np.int64)), pa.array(low[at].view(np.int64))], names=["doc_id", "hash", "high", "low"])

    rows = docs.select(integer_id(doc_id).alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).cast("string").alias("text"))
    return checkpointed(rows.where("doc_id is not null and text is not null").mapInArrow(run, "doc_id long, hash long, high long, low long"))


def _losers(docs: DataFrame, max_distance: int, tables: int, key_bits: int) -> DataFrame:
    """doc_id, hash, kept_id: every document that goes."""
    known = _fingerprinted(docs)
    first = F.min(F.struct("doc_id", "hash")).alias("first")
    # written before they are numbered, so that the numbers are the same whenever they are read
    prints = checkpointed(known.groupBy("high", "low").agg(first)).withColumn("id", F.monotonically_increasing_id())
    roots = components(similar(prints, max_distance, tables, key_bits))
    prints = prints.join(roots, "id", "left").select("high", "low", "first", F.coalesce("root", "id").alias("root"))
    kept = prints.groupBy("root").agg(F.min("first").alias("kept"))
    return (
        known.join(prints.join(kept, "root").select("high", "low", "kept"), ["high", "low"])
        .where("doc_id != kept.doc_id or hash != kept.hash").select("doc_id", "hash", F.col("kept.doc_id").alias("kept_id"))
    )


def near_duplicates(docs: DataFrame, max_distance: int = 22, tables: int = 64, key_bits: int = 16) -> DataFrame:
    """(doc_id, kept_id) of every document that goes because kept_id, the lowest of its group, stays."""
    return _losers(docs, max_distance, tables, key_bits).where("doc_id != kept_id").groupBy("doc_id").agg(F.min("kept_id").alias("kept_id"))


def deduplicate(docs: DataFrame, max_distance: int = 22, tables: int = 64, key_bits: int = 16) -> DataFrame:
    """docs with one document of each group, and one row of each document."""
    gone = _losers(docs, max_distance, tables, key_bits).select("doc_id", "hash").distinct()
    rows, names, (doc_id, text) = plain(docs, ("doc_id", "text"))
    columns = rows.columns
    rows = rows.withColumns({"doc_id": integer_id(doc_id), "hash": F.xxhash64(text)})
    again = checkpointed(rows.where("doc_id is not null").groupBy("doc_id", "hash").count().where("count > 1").select("doc_id", "hash"))
    kept = rows.join(gone, ["doc_id", "hash"], "left_anti")
    if not again.isEmpty():
        one = Window.partitionBy("doc_id", "hash").orderBy(F.xxhash64(F.to_json(F.struct(*columns))))
        single = kept.join(again, ["doc_id", "hash"], "left_semi").withColumn("place", F.row_number().over(one)).where("place = 1").drop("place")
        kept = kept.join(again, ["doc_id", "hash"], "left_anti").unionByName(single)
    return kept.select(*columns).toDF(*names)
