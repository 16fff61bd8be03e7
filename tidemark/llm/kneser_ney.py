"""LM scoring: an interpolated modified Kneser-Ney trigram model, counted in Spark over the whole corpus.

Words get numbers from a counted vocabulary. Trigrams are counted by context, so the counts of a context
come together in one task whatever its last word; each task writes its part of the model as sorted hash arrays:

    tri   hash(w1, w2, w3) -> count                     next to their contexts
    ctx   hash(w1, w2)     -> total, n1, n2, n3+        of the trigrams after it
    bi    hash(w2, w3)     -> words seen before it      by w2
    uni   w                -> total, n1, n2, n3+ of the bigrams after it, words seen before it

There are as many parts as the bytes of all texts ask for, so that what a task sorts doesn't grow with the corpus.

Keys are 48 bits (16 choose a sub-bucket, 32 are stored), counts are exact. Scoring maps the arrays into
memory, so that workers of a machine share them and only touched pages are read; queries of a batch are grouped
by file. The files are written under another name and then renamed: a task that is run again does no harm.

Two words of padding open each text and one closes it; the closing one is predicted too. A word not in the
corpus has number 0 and gets a share of the uniform distribution, as seen words do.

Defined results
- A null text has null scores. A text without words is scored on its end alone.
- Repeated rows count as often as they occur. Other columns are ignored. An empty corpus gives a model in which
  every word has the uniform probability over the unknown word and the end.
- doc_id is NULL where it can't be read as a whole number. A corpus whose words need numbers beyond 32 bits is refused
  with OverflowError.
"""

from __future__ import annotations

import mmap
import os
import pickle
import shutil
import struct
import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.arrays import mix, slices, strings, words
from tidemark.llm.shared import integer_id, plain, shared_path

U = np.uint64
UNKNOWN, START, END, RESERVED = 0, 1, 2, 3
FLUSH = 4_000_000
PART_BYTES = 17 << 20  # of texts to a part of the model
_MAP = {"trackfd": False} if sys.version_info >= (3, 13) else {}  # else the file stays open as long as its map


def _save(path: str, *arrays: np.ndarray) -> None:
    """Arrays in one file, each on a 64-byte boundary."""
    head = [(a.dtype.str, a.shape) for a in arrays]
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        start = pickle.dumps(head)
        f.write(struct.pack("<Q", len(start)) + start)
        for a in arrays:
            f.write(b"\0" * (-f.tell() % 64))
            f.write(np.ascontiguousarray(a).data)
    os.replace(part, path)


@lru_cache(maxsize=8192)
def _load(path: str) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory."""
    with open(path, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **_MAP)
    (n,) = struct.unpack_from("<Q", data)
    at, out = 8 + n, []
    for kind, shape in pickle.loads(data[8:at]):
        at += -at % 64
        size = int(np.prod(shape))
        out.append(np.frombuffer(data, kind, size, min(at, len(data) - size * np.dtype(kind).itemsize)).reshape(shape))
        at += size * np.dtype(kind).itemsize
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays as compressed byte planes, no wider than the largest value needs."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
        data = pa.compress(planes, "zstd", asbytes=True) if planes else b""
        out += [struct.pack("<QIQ", len(a), width, len(data)), data]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<I", blob), 4, []
    for _ in range(n):
        size, width, length = struct.unpack_from("<QIQ", blob, at)
        at += 20
        a = np.zeros((size, 8), np.uint8)
        if size:
            planes = pa.decompress(blob[at : at + length], size * width, "zstd", asbytes=True)
            a[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, size).T
        at += length
        out.append(a.reshape(-1).view("<u8"))
    return out


def _groups(a: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, int), [len(a)]])


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = _groups(keys)[:-1]
    return (keys[at], *(np.add.reduceat(v[order], at) if len(at) else v for v in values))


def key2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.astype(U) + U(0x51ED270B)) ^ (b.astype(U) * U(0x9E3779B97F4A7C15)))


def key3(k: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(k ^ mix(c.astype(U) + U(0x2545F491)))


def _widths(*arrays: np.ndarray) -> list[int]:
    return [int(a.max(initial=0)).bit_length() for a in arrays]


def _trigram_order(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Order of trigrams with contexts a (w1, w2 in 32 bits each) and last words c. Their bits mostly fit into one number."""
    w1, w2 = a >> U(32), a & U(0xFFFFFFFF)
    _, b2, b3 = bits = _widths(w1, w2, c)
    if sum(bits) > 64:
        return np.lexsort((c, a))
    return np.argsort(w1 << U(b2 + b3) | w2 << U(b3) | c.astype(U))


def _sorted_trigrams(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, w2 = a >> U(32), a & U(0xFFFFFFFF)
    _, b2, b3 = bits = _widths(w1, w2, c)
    if sum(bits) > 64:
        order = np.lexsort((c, a))
        return a[order], c[order]
    code = w1 << U(b2 + b3) | w2 << U(b3) | c.astype(U)
    del w1, w2, a, c
    code.sort()
    low = lambda b: U((1 << b) - 1)
    return code >> U(b2 + b3) << U(32) | code >> U(b3) & low(b2), (code & low(b3)).astype(np.uint32)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key & U(0xFFFF)) * U(parts) >> U(16)).astype(np.int64)


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of values, and for each row its number among them. Counts are mostly small, so that few are sorted."""
    if values.ndim == 1:
        top = int(values.max(initial=0))
        if top >= max(1 << 20, 4 * len(values)):
            return np.unique(values, return_inverse=True)
        there = np.zeros(top + 1, bool)
        there[values] = True
        return np.flatnonzero(there), (np.cumsum(there) - 1)[values]
    codes = np.zeros(len(values), np.int64)
    for column in values.T:
        table, own = _coded(column)
        codes = _coded(codes * len(table) + own)[1]
    first = np.zeros(int(codes.max(initial=-1)) + 1, np.int64)
    first[codes] = np.arange(len(codes))
    return values[first], codes


def _write_table(path: str, keys: np.ndarray, values: np.ndarray) -> None:
    """A sorted hash array: offsets of sub-buckets, 32 bits a key, and for each a number of a row of distinct values."""
    order = np.argsort(keys)
    keys = keys[order]
    offsets = np.searchsorted(keys >> U(48), np.arange(65537, dtype=U)).astype(np.uint64 if len(keys) >= 2**32 else np.uint32)
    table, codes = _coded(values)
    codes = codes.astype(np.min_scalar_type(max(len(table) - 1, 0)))[order]
    _save(path, offsets, ((keys >> U(16)) & U(0xFFFFFFFF)).astype(np.uint32), table, codes)


def _lookup(path: str, keys: np.ndarray, width: int) -> np.ndarray:
    """The values of keys, 0 where absent. keys should be sorted, for locality."""
    offsets, stored, table, codes = _load(path)
    out = np.zeros((len(keys), width) if width > 1 else len(keys), np.int64)
    if not len(stored):
        return out
    high = (keys >> U(48)).astype(np.int64)
    want = ((keys >> U(16)) & U(0xFFFFFFFF)).astype(np.uint32)
    low, top = offsets[high].astype(np.int64), offsets[high + 1].astype(np.int64)
    end = top.copy()
    for _ in range(int((top - low).max(initial=0)).bit_length()):
        mid = (low + top) >> 1
        less = stored[np.minimum(mid, len(stored) - 1)] < want
        go = low < top
        low, top = np.where(go & less, mid + 1, low), np.where(go & ~less, mid, top)
    at = np.minimum(low, len(stored) - 1)
    hit = (low < end) & (stored[at] == want)
    out[hit] = table[codes[at[hit]]]
    return out


def _numbers(path: str, parts: int, hashes: np.ndarray) -> np.ndarray:
    """Numbers of words; 0 for unknown ones."""
    found, back = np.unique(hashes, return_inverse=True)
    out = np.zeros(len(found), np.int64)
    cuts = np.searchsorted((found >> U(32)) * U(parts) >> U(32), np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        own = found[cuts[p] : cuts[p + 1]]
        known, number = _load(f"{path}/voc-{p}")
        if len(known):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            out[cuts[p] : cuts[p + 1]] = np.where(known[at] == own, number[at], UNKNOWN)
    return out[back]


def _sequence(numbers: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Padded texts after one another, and where the predicted positions are."""
    counts = np.bincount(rows, minlength=n)
    begin = np.concatenate([[0], np.cumsum(counts + 3)[:-1]])
    out = np.full(int(counts.sum()) + 3 * n, END, np.int64)
    out[begin] = out[begin + 1] = START
    out[np.arange(len(numbers)) + 3 * rows + 2] = numbers
    predicted = np.ones(len(out), bool)
    predicted[begin] = predicted[begin + 1] = False
    return out, np.flatnonzero(predicted)


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and what holds for the whole corpus. discounts: by order 3, 2, 1 for counts 1, 2, 3+."""

    path: str
    parts: int
    words: int
    bigrams: int
    discounts: tuple[tuple[float, float, float], ...]
    uni: tuple[int, int, int]  # words preceded by 1, 2, 3+ different words

    def delete(self) -> None:
        """Removes the arrays from the shared folder. Nothing can be scored any more."""
        shutil.rmtree(self.path)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's estimates from the numbers of items counted 1 to 4 times; 0.5, 1, 1.5 where undefined."""
    n1, n2, n3, n4 = map(float, n)
    if min(n1, n2) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(x if 0 < x <= k else k / 2 for k, x in zip((1, 2, 3), d))


def _spectrum(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _classes(counts: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each run: its sum, and how many are 1, 2 and 3 or more."""
    if len(at) == 0:
        return [np.zeros(0, np.int64)] * 4
    return [np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts >= 3)]


_ROW = "part int, data binary"
_STATS = "part int, n long, n1 long, n2 long, n3 long, n4 long"
_NAMES = ["part", "n", "n1", "n2", "n3", "n4"]


def _rows(found: dict[int, bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.binary())], names=["part", "data"])


def _blobs(batches) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for batch in batches:
        for p, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist()):
            out.setdefault(p, []).append(data)
    return out


def _count_words(texts: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        keys, counts = np.zeros(0, U), np.zeros(0, np.int64)
        for batch in batches:
            found = [keys]
            sums = [counts]
            for _, own in slices(strings(batch.column("text")), 4 << 20):
                k, c = np.unique(words(own)[0], return_counts=True)
                found.append(k)
                sums.append(c)
            keys, counts = _sum_by(np.concatenate(found), np.concatenate(sums))
        cuts = np.searchsorted((keys >> U(32)) * U(parts) >> U(32), np.arange(parts + 1))
        yield _rows({
            p: pack(np.diff(keys[a:b], prepend=U(0)), counts[a:b]) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a
        })

    return texts.mapInArrow(run, _ROW)


def _write_vocabulary(rows: DataFrame, path: str, parts: int) -> DataFrame:
    def run(batches):
        for p, blobs in _blobs(batches).items():
            arrays = [unpack(b) for b in blobs]
            keys, counts = _sum_by(np.concatenate([np.cumsum(a[0], dtype=U) for a in arrays]), np.concatenate([a[1] for a in arrays]).astype(np.int64))
            ranks = np.empty(len(keys), np.int64)
            ranks[np.lexsort((keys, -counts))] = np.arange(len(keys))  # frequent words get small numbers
            _save(f"{path}/voc-{p}", keys, (ranks * parts + p + RESERVED).astype(np.uint32 if len(keys) * parts < 2**31 else np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x], pa.int64()) for x in (len(keys), 0, 0, 0, 0))], names=_NAMES)

    return rows.mapInArrow(run, _STATS)


def _count_trigrams(texts: DataFrame, path: str, parts: int) -> DataFrame:
    def emit(kept):
        a, c = np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept])
        kept.clear()
        a, c = _sorted_trigrams(a, c)
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(a)))
        a, c = a[first], c[first]
        at = _groups(a)
        heads, sizes = a[at[:-1]], np.diff(at)
        part = _part(key2(heads >> U(32), heads & U(0xFFFFFFFF)), parts)
        out = {}
        by = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[by], np.arange(parts + 1))
        for p in range(parts):
            g = by[cuts[p] : cuts[p + 1]]
            if len(g):
                n = sizes[g]
                i = np.repeat(at[:-1][g] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
                out[p] = pack(np.diff(heads[g] >> U(32), prepend=U(0)), heads[g] & U(0xFFFFFFFF), n, c[i], counts[i])
        return _rows(out)

    def run(batches):
        kept, size = [], 0
        for batch in batches:
            for _, own in slices(strings(batch.column("text")), 4 << 20):
                hashes, rows = words(own)
                seq, at = _sequence(_numbers(path, parts, hashes), rows, len(own))
                seq = seq.astype(U)
                kept.append((seq[at - 2] << U(32) | seq[at - 1], seq[at].astype(np.uint32)))
                del hashes, rows, seq
                size += len(at)
                if size >= FLUSH:
                    yield emit(kept)
                    size = 0
        if size:
            yield emit(kept)

    return texts.mapInArrow(run, _ROW)


def _write_trigrams(rows: DataFrame, path: str, parts: int) -> DataFrame:
    """Writes tri and ctx; gives the bigrams (w2, w3) with the number of words before them, and the statistics as part -1 - p."""

    def run(batches):
        for p, blobs in _blobs(batches).items():
            heads, lasts, counts = [], [], []
            for blob in blobs:
                w1, w2, n, c, k = unpack(blob)
                heads.append(np.repeat(np.cumsum(w1, dtype=U) << U(32) | w2, n.astype(np.int64)))
                lasts.append(c.astype(np.uint32))
                counts.append(k.astype(np.uint32) if int(k.max(initial=0)) < 2**32 else k.astype(np.int64))
            a, c, k = (np.concatenate(x) for x in (heads, lasts, counts))
            del heads, lasts, counts
            blobs.clear()
            order = _trigram_order(a, c)
            a, c, k = a[order], c[order], k[order]
            del order
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))
            k = np.add.reduceat(k, first, dtype=np.int64)
            a, c = a[first], c[first]
            at = _groups(a)[:-1]
            k12 = key2(a >> U(32), a & U(0xFFFFFFFF))
            _write_table(f"{path}/tri-{p}", key3(k12, c), k)
            _write_table(f"{path}/ctx-{p}", k12[at], np.column_stack(_classes(k, at)))
            spectrum = _spectrum(k)
            n = len(k)
            # each context is here only, so the words before a bigram can be added up over the parts
            w23 = (a & U(0xFFFFFFFF)) << U(32) | c
            del a, c, k, k12
            w23, before = np.unique(w23, return_counts=True)
            part = ((w23 >> U(32)) % U(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(parts + 1))
            out = {}
            for q in range(parts):
                g = by[cuts[q] : cuts[q + 1]]
                if len(g):
                    w2 = w23[g] >> U(32)
                    to = _groups(w2)
                    out[q] = pack(np.diff(w2[to[:-1]], prepend=U(0)), np.diff(to), w23[g] & U(0xFFFFFFFF), before[g])
            yield _rows(out)
            yield _rows({-1 - p: struct.pack("<5q", n, *spectrum)})

    return rows.mapInArrow(run, _ROW)


def _write_bigrams(rows: DataFrame, path: str, parts: int) -> DataFrame:
    """Writes bi; gives of each word the statistics as a context (kind 1) and the words before it (kind 0)."""

    def run(batches):
        for q, blobs in _blobs(batches).items():
            if q < 0:  # statistics of the trigrams, on their way
                yield _rows({q: b"".join(blobs)})
                continue
            heads, lasts, counts = [], [], []
            for blob in blobs:
                w2, n, c, k = unpack(blob)
                heads.append(np.repeat(np.cumsum(w2, dtype=U), n.astype(np.int64)) << U(32) | c)
                counts.append(k.astype(np.int64))
            a, k = _sum_by(np.concatenate(heads), np.concatenate(counts))
            del heads, counts
            w2, w3 = a >> U(32), a & U(0xFFFFFFFF)
            _write_table(f"{path}/bi-{q}", key2(w2, w3), k)
            at = _groups(w2)[:-1]
            stats = _classes(k, at)
            of = np.column_stack([w2[at] // U(parts), *stats]).astype(np.int64)
            _save(f"{path}/word-{q}", of.astype(np.uint32) if of.max(initial=0) < 2**32 else of)
            seen, before = np.unique(w3, return_counts=True)
            part = (seen % U(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(parts + 1))
            for p in range(parts):
                g = by[cuts[p] : cuts[p + 1]]
                if len(g):
                    yield _rows({p: pack(np.diff(seen[g], prepend=U(0)), before[g])})
            yield _rows({-1 - parts - q: struct.pack("<5q", len(k), *_spectrum(k))})

    return rows.mapInArrow(run, _ROW)


def _save_words(path: str, p: int, index: np.ndarray, before: np.ndarray) -> None:
    """uni of one part: the statistics of words as contexts joined with the words before them."""
    after = _load(f"{path}/word-{p}")[0].astype(np.int64) if os.path.exists(f"{path}/word-{p}") else np.zeros((0, 5), np.int64)
    dense = np.zeros((max(index.max(initial=-1), after[:, 0].max(initial=-1)) + 1, 5), np.int64)
    dense[after[:, 0], :4] = after[:, 1:]
    dense[index, 4] = before
    _save(f"{path}/uni-{p}", dense.astype(np.uint32) if dense.max(initial=0) < 2**32 else dense)


def _write_words(rows: DataFrame, path: str, parts: int) -> DataFrame:
    """Writes uni, dense by number; gives all statistics: of trigrams -1 to -parts, of bigrams after that, of words from 0."""

    def run(batches):
        for p, blobs in _blobs(batches).items():
            if p < 0:
                found = struct.unpack("<5q", blobs[0])
            else:
                arrays = [unpack(b) for b in blobs]
                w, n = _sum_by(np.concatenate([np.cumsum(a[0], dtype=U) for a in arrays]), np.concatenate([a[1] for a in arrays]).astype(np.int64))
                _save_words(path, p, (w // U(parts)).astype(np.int64), n)
                # the numbers of words before 1, 2, 3, and 4 words, and in n how many words there are
                found = (len(w), *_spectrum(n))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x], pa.int64()) for x in found)], names=_NAMES)

    return rows.mapInArrow(run, _STATS)


def train(docs: DataFrame, parts: int | None = None) -> Model:
    """Count the model over all texts of docs. parts: files of each kind; one to PART_BYTES of texts if not given, 8 at least."""
    spark: SparkSession = docs.sparkSession
    docs, _, (text,) = plain(docs, ("text",))
    texts = docs.select(F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    if parts is None:
        size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = max(8, -(-size // PART_BYTES))
    path = shared_path(spark, "kneser-ney")
    os.makedirs(path)

    def by_part(df: DataFrame) -> DataFrame:
        return df.repartitionById(parts, F.pmod("part", F.lit(parts)).cast("int"))

    known = _write_vocabulary(by_part(_count_words(texts, parts)), path, parts).toArrow().to_pydict()
    for p in set(range(parts)) - set(known["part"]):
        _save(f"{path}/voc-{p}", np.zeros(0, U), np.zeros(0, np.uint32))
    if max(known["n"], default=0) * parts + RESERVED >= 1 << 32:
        raise OverflowError("the vocabulary needs word numbers beyond 32 bits")
    bigrams = _write_trigrams(by_part(_count_trigrams(texts, path, parts)), path, parts)
    stats = _write_words(by_part(_write_bigrams(by_part(bigrams), path, parts)), path, parts).toArrow().to_pydict()
    sums = {3: np.zeros(5, np.int64), 2: np.zeros(5, np.int64), 1: np.zeros(5, np.int64)}
    for p, *found in zip(*(stats[n] for n in _NAMES)):
        sums[1 if p >= 0 else 3 if p >= -parts else 2] += np.array(found)
    for p in range(parts):  # parts without an item have no file yet
        for kind, width in (("tri", 1), ("ctx", 4), ("bi", 1)):
            if not os.path.exists(f"{path}/{kind}-{p}"):
                _write_table(f"{path}/{kind}-{p}", np.zeros(0, U), np.zeros((0, width) if width > 1 else 0, np.int64))
        if not os.path.exists(f"{path}/uni-{p}"):
            _save_words(path, p, np.zeros(0, np.int64), np.zeros(0, np.int64))  # words that only come first
        if os.path.exists(f"{path}/word-{p}"):
            os.remove(f"{path}/word-{p}")
    n = sums[1]
    return Model(path, parts, int(n[0]), int(sums[2][0]), tuple(discounts(list(sums[k][1:])) for k in (3, 2, 1)), (int(n[1]), int(n[2]), int(n[0] - n[1] - n[2])))


def _words_of(model: Model, w: np.ndarray) -> np.ndarray:
    out = np.zeros((len(w), 5), np.int64)
    part = w % model.parts
    by = np.argsort(part.astype(np.uint16) if model.parts < 65536 else part, kind="stable")
    cuts = np.searchsorted(part[by], np.arange(model.parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        i = by[cuts[p] : cuts[p + 1]]
        (own,) = _load(f"{model.path}/uni-{p}")
        at = w[i] // model.parts
        ok = at < len(own)
        out[i[ok]] = own[at[ok]]
    return out


def _find(model: Model, kind: str, part: np.ndarray, keys: np.ndarray, width: int = 1) -> np.ndarray:
    out = np.zeros((len(keys), width) if width > 1 else len(keys), np.int64)
    # by part, then as the tables are sorted: by the 48 bits of the keys that these hold
    by = np.argsort(part.astype(U) << U(48) | keys >> U(16)) if model.parts <= 65536 else np.lexsort((keys, part))
    cuts = np.searchsorted(part[by], np.arange(model.parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        i = by[cuts[p] : cuts[p + 1]]
        out[i] = _lookup(f"{model.path}/{kind}-{p}", keys[i], width)
    return out


def _level(count, total, classes, d, lower):
    """(count - D(count)) / total + (what was discounted) / total * lower; lower where the context is new."""
    off = np.array([0.0, *d])[np.minimum(count, 3)]
    left = classes @ np.array(d)
    some = total > 0
    safe = np.where(some, total, 1)
    return np.where(some, (count - off + left * lower) / safe, lower)


def log_probs(model: Model, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log probabilities of the words at the positions, given the two before."""
    w1, w2, w3 = seq[at - 2], seq[at - 1], seq[at]
    uniq, back = np.unique(np.concatenate([w2, w3]), return_inverse=True)
    info = _words_of(model, uniq)
    of2, before = info[back[: len(at)]], info[back[len(at) :], 4]
    n = max(model.bigrams, 1)
    p = _level(before, np.full(len(at), model.bigrams), np.array(model.uni, float), model.discounts[2], 1 / (model.words + 1)) if model.bigrams else np.full(len(at), 1 / (n + 1))
    p = _level(_find(model, "bi", w2 % model.parts, key2(w2, w3)), of2[:, 0], of2[:, 1:4], model.discounts[1], p)
    k12 = key2(w1, w2)
    part = _part(k12, model.parts)
    ctx = _find(model, "ctx", part, k12, 4)
    return np.log(_level(_find(model, "tri", part, key3(k12, w3)), ctx[:, 0], ctx[:, 1:], model.discounts[0], p))


SCHEMA = "doc_id long, n_tokens long, log_prob double, perplexity double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Of every row: doc_id, n_tokens (words and the end), log_prob, perplexity. No shuffle."""

    def run(batches):
        for batch in batches:
            texts = strings(batch.column("text"))
            sums, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
            for _, own in slices(texts, 2 << 20):
                hashes, rows = words(own)
                seq, at = _sequence(_numbers(model.path, model.parts, hashes), rows, len(own))
                n = np.bincount(rows, minlength=len(own)) + 1
                sums.append(np.bincount(np.repeat(np.arange(len(own)), n), log_probs(model, seq, at), minlength=len(own)))
                counts.append(n)
            total, n = np.concatenate(sums), np.concatenate(counts)
            mask = np.asarray(batch.column("text").is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n, mask=mask), pa.array(total, mask=mask), pa.array(np.exp(-total / np.maximum(n, 1)), mask=mask),
            ], names=["doc_id", "n_tokens", "log_prob", "perplexity"])

    docs, _, (doc_id, text) = plain(docs, ("doc_id", "text"))
    return docs.select(integer_id(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
