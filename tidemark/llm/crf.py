"""Quality rules: a linear-chain conditional random field labels every line as content or boilerplate.

`fit` learns the weights from lines of a bounded number of labelled documents; `label_documents` decodes
whole documents with Viterbi and keeps those whose content share reaches a threshold.

Defined results
- A null or empty text, and one without any word, has no content: share 0, rejected.
- Lines without a word are decoded too, but carry no weight in the share (weights are letters and digits).
- Repeated rows are decided each on its own, so alike; all columns of the input are kept and a column of
  the input named like a result column is replaced.
- An empty table gives an empty table. Columns are found without regard to case and may have any names.
- Without labelled documents of both classes there is nothing to learn: `fit` gives a model that takes every line for content.
- Of rows that repeat a labelled doc_id, that of the lowest text is learnt from; ids are compared as whole numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.arrays import IS_WORD, flat, slices, span_hashes, strings, word_spans
from tidemark.llm.shared import fields, integer_id, plain

CONTENT, BOILERPLATE = 1, 0
SLICE = 1 << 20  # bytes of whole texts handled at a time
FEATURES = (
    "log_words", "upper", "symbols", "pipes", "bangs", "digits", "word_length", "repeats",
    "ends_sentence", "twin", "short", "first", "last", "short_words", "log_lines",
)
_CLASS = {
    "upper": np.array([65 <= b <= 90 for b in range(256)]),
    "lower": np.array([97 <= b <= 122 for b in range(256)]),
    "symbol": np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?!|" for b in range(256)]),
    "digit": np.array([48 <= b <= 57 for b in range(256)]),
    "pipe": np.arange(256) == 124,
    "bang": np.arange(256) == 33,
}
_STOPS = np.array([chr(b) in ".!?:;\"'" for b in range(256)])


@dataclass(frozen=True)
class LineModel:
    """Emission weights of class content (boilerplate has none) on scaled features, transitions [from][to], start."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return np.clip(x, -6, 6) @ self.weights[:-1] + self.weights[-1]


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its letters and digits, and the first line of each text (one more entry)."""
    body, at = flat(texts, lower=False)
    if len(body) == 0:
        return np.zeros((0, len(FEATURES))), np.zeros(0, np.int64), np.zeros(1, np.int64)
    ends = np.flatnonzero(body == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    first = np.concatenate([np.searchsorted(starts, at[:-1]), [len(starts)]])
    rows = np.repeat(np.arange(len(at) - 1), np.diff(first))

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(body) + 1, np.int32)
        np.cumsum(table[body], out=sums[1:])
        return (sums[ends] - sums[starts]).astype(np.float64)

    n = {k: count(t) for k, t in _CLASS.items()}
    letters = count(IS_WORD)
    w0, w1 = word_spans(body)
    codes = span_hashes(body, w0, w1)
    of_line = np.searchsorted(starts, w0, "right") - 1
    n_words = np.bincount(of_line, minlength=len(starts)).astype(np.float64)
    same = np.zeros(len(w0))
    if len(w0) > 1:
        same[1:] = (codes[1:] == codes[:-1]) & (of_line[1:] == of_line[:-1])
    repeats = np.bincount(of_line, same, minlength=len(starts))
    small = np.bincount(of_line, (w1 - w0) <= 3, minlength=len(starts))
    whole = span_hashes(body, starts, ends)
    order = np.lexsort((whole, rows))
    twin = np.zeros(len(starts))
    if len(order) > 1:
        eq = (whole[order[1:]] == whole[order[:-1]]) & (rows[order[1:]] == rows[order[:-1]])
        twin[order[1:]] = eq
        twin[order[:-1]] = np.maximum(twin[order[:-1]], eq)
    some = np.maximum(n_words, 1)
    size = np.maximum(ends - starts, 1)
    n_lines = np.diff(first)
    index = np.arange(len(starts))
    x = np.column_stack([
        np.log1p(n_words), n["upper"] / np.maximum(n["upper"] + n["lower"], 1), n["symbol"] / size,
        n["pipe"] / some, n["bang"] / some, n["digit"] / size, letters / some / 10, repeats / some,
        np.where(ends > starts, _STOPS[body[np.maximum(ends - 1, 0)]], 0), twin, n_words < 3,
        index == first[:-1][rows], index == first[1:][rows] - 1, small / some, np.log1p(n_lines)[rows],
    ])
    return x, letters.astype(np.int64), first.astype(np.int64)


def _steps(first: np.ndarray):
    """For each position t: the texts longer than t. Texts are visited longest first."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    ranked = -lengths[order]
    for t in range(int(lengths.max(initial=0))):
        yield t, order[: np.searchsorted(ranked, -t, "left")]


def viterbi(emit: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The most probable labels of all lines; ties go to boilerplate."""
    n = len(emit)
    score = np.zeros((n, 2))
    back = np.zeros((n, 2), np.uint8)
    for t, rows in _steps(first):
        i = first[:-1][rows] + t
        own = np.stack([np.zeros(len(i)), emit[i]], 1)
        if t == 0:
            score[i] = start + own
            continue
        via = score[i - 1][:, :, None] + transitions
        back[i] = via.argmax(1)
        score[i] = via.max(1) + own
    labels = np.zeros(n, np.int8)
    last = first[1:] - 1
    some = np.diff(first) > 0
    labels[last[some]] = score[last[some]].argmax(1)
    for t, rows in reversed(list(_steps(first))):
        if t:
            i = first[:-1][rows] + t
            labels[i - 1] = back[i, labels[i]]
    return labels


def _marginals(emit, first, transitions, start):
    """Posterior of content by line and the expected transitions, by forward-backward over all texts at once."""
    n = len(emit)
    e = np.stack([np.zeros(n), emit], 1)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    steps = list(_steps(first))
    for t, rows in steps:
        i = first[:-1][rows] + t
        alpha[i] = e[i] + (start if t == 0 else np.logaddexp(*(alpha[i - 1][:, k, None] + transitions[k] for k in (0, 1))))
    for t, rows in reversed(steps):
        if t:
            i = first[:-1][rows] + t
            ahead = e[i] + beta[i]
            beta[i - 1] = np.logaddexp(*(transitions[:, k] + ahead[:, k, None] for k in (0, 1)))
    node = alpha + beta
    total = np.logaddexp(node[:, 0], node[:, 1])
    inner = np.ones(n, bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    i = np.flatnonzero(inner)
    pair = alpha[i - 1][:, :, None] + transitions + (e[i] + beta[i])[:, None, :] - total[i][:, None, None]
    heads = first[:-1][np.diff(first) > 0]
    return np.exp(node - total[:, None]), np.exp(pair).sum(0), np.exp(node[heads] - total[heads, None]).sum(0)


def fit_lines(x: np.ndarray, first: np.ndarray, quality: np.ndarray, rounds: int = 2, steps: int = 150, l2: float = 1e-3) -> LineModel:
    """Maximum likelihood with self-training: lines of bad documents start as boilerplate, then take the
    model's own labels, as a bad document may hold good lines. Lines of good documents stay content."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.column_stack([np.clip((x - mean) / scale, -6, 6), np.ones(len(x))])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    good = quality[doc] == 1
    y = good.astype(np.int8)
    heads = first[:-1][np.diff(first) > 0]
    inner = np.ones(len(x), bool)
    inner[heads] = False
    inner = np.flatnonzero(inner)
    # either class of documents weighs the same
    theta = np.zeros(z.shape[1] + 6)
    for _ in range(rounds):
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner - 1], y[inner]), 1)
        begun = np.bincount(y[heads], minlength=2)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            w, tr, st = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
            node, pair, head = _marginals(z @ w, first, tr, st)
            gradient = np.concatenate([z.T @ (y - node[:, 1]), (seen - pair).ravel(), begun - head]) / len(x) - l2 * theta
            m = 0.9 * m + 0.1 * gradient
            v = 0.999 * v + 0.001 * gradient**2
            theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        emit = z @ theta[:-6]
        y = np.where(good, 1, emit > 0).astype(np.int8)
    return LineModel(mean, scale, theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:])


def all_content() -> LineModel:
    """The model of nothing learnt: every line is content."""
    n = len(FEATURES)
    return LineModel(np.zeros(n), np.ones(n), np.append(np.zeros(n), 1.0), np.zeros((2, 2)), np.zeros(2))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 2000) -> LineModel:
    """Learn from at most `sample_docs` labelled documents of each class, the first by a hash of doc_id.

    docs: doc_id, text. labels: doc_id, quality (1 good, 0 bad; others are ignored).
    """
    labels = fields(labels, "doc_id", "quality").select(integer_id("doc_id").alias("doc_id"), F.col("quality").try_cast("int").alias("quality"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    parts = [
        known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for q in (0, 1)
    ]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 x sample_docs rows
    # the features are made where the texts are; the driver gets a few numbers a line
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
        T.StructField("features", T.BinaryType()), T.StructField("n", T.IntegerType()),
    ])

    def features(batches):
        parts = ((batch.slice(at, len(own)), own) for batch in batches for at, own in slices(strings(batch.column("text")), SLICE))
        for batch, own in parts:
            x, _, first = line_features(own)
            x = x.astype(np.float32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("quality").cast(pa.int32()),
                pa.array([x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()),
                pa.array(np.diff(first).astype(np.int32)),
            ], names=schema.names)

    texts = fields(docs, "doc_id", "text").select(integer_id("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # one text an id, and so no more than 2 x sample_docs
    rows = (
        texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
        .mapInArrow(features, schema).toArrow().sort_by("doc_id")
    )
    quality = np.asarray(rows["quality"])
    if len(set(quality.tolist())) < 2:
        return all_content()
    counts = np.asarray(rows["n"])
    x = np.concatenate([np.frombuffer(b, np.float32) for b in rows["features"].to_pylist()]).reshape(-1, len(FEATURES))
    return fit_lines(x.astype(np.float64), np.concatenate([[0], np.cumsum(counts)]), quality)


def label_batch(texts: pa.Array, model: LineModel, threshold: float):
    """(lines, content lines, content share, keep) of each text."""
    x, letters, first = line_features(texts)
    labels = viterbi(model.emissions(x), first, model.transitions, model.start)

    def total(v):
        sums = np.concatenate([[0], np.cumsum(v)])
        return sums[first[1:]] - sums[first[:-1]]

    size = total(letters)
    share = total(letters * labels) / np.maximum(size, 1)
    return np.diff(first).astype(np.int64), total(labels.astype(np.int64)), share, (size > 0) & (share >= threshold)


RESULT = ("n_lines", "n_content_lines", "content_share", "keep")


def label_documents(docs: DataFrame, model: LineModel, threshold: float = 0.5, drop_text: bool = False) -> DataFrame:
    """All rows of docs with n_lines, n_content_lines, content_share and keep. No shuffle."""
    docs, names, (column,) = plain(docs, ("text",), RESULT)
    text = docs.columns.index(column)
    keep = [i for i in range(len(names)) if i != text or not drop_text]
    kinds = (T.LongType(), T.LongType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*(docs.schema.fields[i] for i in keep), *(T.StructField(n, k) for n, k in zip(RESULT, kinds))])

    def run(batches):
        for batch in batches:
            parts = [label_batch(own, model, threshold) for _, own in slices(strings(batch.column(text)), SLICE)]
            found = [np.concatenate(x) for x in zip(*parts)]
            if not found:
                continue
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *map(pa.array, found)], names=schema.names)

    return docs.mapInArrow(run, schema).toDF(*(names[i] for i in keep), *RESULT)
