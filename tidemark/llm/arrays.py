"""Vectorised text handling on Arrow buffers, shared by the operators that work inside Arrow batches.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes of the lower-cased UTF-8 text.
Null texts are treated as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_ODD = 0x9E3779B97F4A7C15 | 1
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=U)
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return (
        np.multiply.accumulate(np.full(n, U(_ODD))),
        np.multiply.accumulate(np.full(n, U(pow(_ODD, -1, 2**64)))),
    )


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def slices(texts: pa.Array, max_bytes: int = 1 << 20, max_rows: int = 1 << 18) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about max_bytes each; a longer text is a slice of its own, never cut."""
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1
        end = min(max(end, start + 1), start + max_rows, len(texts))
        yield start, texts.slice(start, end - start)
        start = end


def flat(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a newline after every text, and where each text starts (one more entry for the end)."""
    if lower:
        texts = pc.utf8_lower(texts)
    joined = pc.binary_join_element_wise(texts, "", "\n")
    joined = joined.combine_chunks() if isinstance(joined, pa.ChunkedArray) else joined
    offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1]
    body = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return body, (offsets - offsets[0]).astype(np.int64)


def word_spans(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(IS_WORD[body].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def token_starts(body: np.ndarray) -> np.ndarray:
    """Where runs of anything but ASCII white space begin."""
    token = ~IS_SPACE[body]
    token[1:] &= IS_SPACE[body[:-1]]
    return np.flatnonzero(token)


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: a polynomial over random byte codes, then a finaliser."""
    size = 1 << 21
    while size < len(body):
        size *= 2
    power, inverse = _powers(size)
    sums = np.zeros(len(body) + 1, U)
    np.cumsum(_BYTE_CODES[body] * power[: len(body)], out=sums[1:])
    if len(starts) == 0:
        return np.zeros(0, U)
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the row of each."""
    body, at = flat(texts)
    starts, ends = word_spans(body)
    return span_hashes(body, starts, ends), np.searchsorted(at, starts, "right") - 1
