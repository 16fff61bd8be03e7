"""Secret scanning with a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over trigrams that each match must contain.
Every Arrow batch is a segment with its own inverted index (trigram to rows, over all texts of the batch);
a rule intersects and unites posting lists to candidate rows, and only those are verified with the expression.
A rule from which no mandatory trigram follows scans all rows. Segments need no shuffle, and building them
where the texts are spares a second read of the corpus for verification.

Trigrams are bytes of UTF-8 after ASCII lower-casing, on both sides; so a query never misses a match.

Defined results
- Null and empty texts have no findings. Repeated rows give repeated findings.
- Matches of one rule don't overlap (leftmost first); matches of different rules may.
- Offsets are in characters, ends exclusive. Other columns are ignored, whatever their names; doc_id is NULL where it
  can't be read as a whole number.
- Not found: quoted values of assignments with fewer than 16 characters or without quotes, and keys in formats without
  a rule. Expressions are taken apart with the parser of Python's `re`, which has no public name (Python 3.11 to 3.13).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.arrays import flat, strings
from tidemark.llm.shared import integer_id, plain

MAX_STRINGS = 64
_C = re._constants


@dataclass(frozen=True)
class SecretRule:
    name: str
    pattern: str
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.A | (re.I if self.ignore_case else 0))


RULES = (
    SecretRule("aws_access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AGPA|AROA)[0-9A-Z]{16}(?![A-Za-z0-9])"),
    SecretRule("github_token", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack_token", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    SecretRule("google_api_key", r"AIza[0-9A-Za-z_\-]{35}"),
    SecretRule("stripe_key", r"(?<![A-Za-z0-9])[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    SecretRule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    SecretRule("json_web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    SecretRule("url_credentials", r"[a-z][a-z0-9+.-]{1,20}://[^/\s:@]+:[^/\s:@]+@", True),
    SecretRule("assignment", r"(?:api[_-]?key|secret|token|passwd|password)[\"']?\s{0,4}[:=]\s{0,4}[\"'][^\s\"']{16,}[\"']", True),
    SecretRule("hex_key", r"(?<![0-9a-z])[0-9a-f]{40}(?![0-9a-z])", True),
)


def _code(b: bytes) -> int:
    return b[0] << 16 | b[1] << 8 | b[2]


def _and(parts):
    parts = [p for p in parts if p is not True]
    flat_ = []
    for p in parts:
        flat_ += p[1] if p[0] == "and" else [p]
    flat_ = list(dict.fromkeys(flat_))
    return True if not flat_ else flat_[0] if len(flat_) == 1 else ("and", tuple(flat_))


def _or(parts):
    parts = list(dict.fromkeys(parts))
    return True if any(p is True for p in parts) or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(found: set[bytes]):
    """Every match holds one of these strings."""
    return _or([_and([("tri", _code(s[i : i + 3])) for i in range(len(s) - 2)]) for s in sorted(found)])


def _lower(c: int) -> bytes:
    return chr(c).encode("utf-8", "surrogatepass").lower()


def _class(items) -> set[bytes] | None:
    out: set[bytes] = set()
    for op, arg in items:
        if op is _C.LITERAL:
            out.add(_lower(arg))
        elif op is _C.RANGE and arg[1] - arg[0] < MAX_STRINGS:
            out |= {_lower(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _analyse(tree) -> tuple[set[bytes] | None, object]:
    """(all strings it can match, or None, query that every match meets)."""
    run, parts, whole = {b""}, [], True

    def flush() -> None:
        nonlocal run, whole
        parts.append(_of_strings(run))
        run, whole = {b""}, False

    def append(found: set[bytes]) -> None:
        nonlocal run
        if len(run) * len(found) > MAX_STRINGS:
            flush()
        run = {a + b for a in run for b in found} if len(found) <= MAX_STRINGS else run

    for op, arg in tree:
        exact, query = None, True
        if op is _C.LITERAL:
            exact = {_lower(arg)}
        elif op is _C.IN:
            exact = _class(arg)
        elif op in (_C.AT, _C.ASSERT, _C.ASSERT_NOT):
            continue  # without width: neighbours stay neighbours
        elif op is _C.SUBPATTERN:
            exact, query = _analyse(arg[3])
        elif op is _C.ATOMIC_GROUP:
            exact, query = _analyse(arg)
        elif op is _C.BRANCH:
            each = [_analyse(x) for x in arg[1]]
            if all(e is not None for e, _ in each) and sum(len(e) for e, _ in each) <= MAX_STRINGS:
                exact = set().union(*(e for e, _ in each))
            query = _or([q for _, q in each])
        elif op in (_C.MAX_REPEAT, _C.MIN_REPEAT, _C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            e, q = _analyse(inner)
            if low == 0:
                exact = e | {b""} if high == 1 and e is not None else None
            elif e is not None and len(e) ** min(low, 8) <= MAX_STRINGS:
                for _ in range(min(low, 8)):
                    append(e)
                if high == low <= 8:
                    continue
                flush()
                continue
            else:
                query = q
        if exact is not None:
            append(exact)
        else:
            flush()
            parts.append(query)
    if whole:
        return run, _of_strings(run)
    flush()
    return None, _and(parts)


def trigram_query(rule: SecretRule):
    """A tree of ("tri", code), ("and", parts), ("or", parts), or True: no mandatory trigram."""
    return _analyse(re._parser.parse(rule.pattern, re.A | (re.I if rule.ignore_case else 0)))[1]


def _codes(query) -> set[int]:
    return set() if query is True else {query[1]} if query[0] == "tri" else set().union(*map(_codes, query[1]))


class Scanner:
    """Compiled rules. `vocabulary` holds the trigrams that some rule asks for."""

    def __init__(self, rules: tuple[SecretRule, ...] = RULES):
        self.rules = [(r.name, r.compiled(), trigram_query(r)) for r in rules]
        self.vocabulary = np.array(sorted(set().union(*(_codes(q) for _, _, q in self.rules))), np.int64)
        self._wanted = None

    def __getstate__(self):
        return self.__dict__ | {"_wanted": None}

    def index(self, texts: pa.Array) -> dict[int, np.ndarray]:
        """The inverted index of a segment: sorted rows by trigram."""
        if self._wanted is None:
            self._wanted = np.zeros(1 << 24, bool)
            self._wanted[self.vocabulary] = True
        body, at = flat(texts, lower=False)
        if len(body) < 3:
            return {}
        body = np.where((body >= 65) & (body <= 90), body + 32, body).astype(np.uint32)
        codes = body[:-2] << 16
        codes |= body[1:-1] << 8
        codes |= body[2:]
        hits = np.flatnonzero(self._wanted[codes])
        rows = np.searchsorted(at, hits, "right") - 1
        pairs = np.unique(codes[hits].astype(np.int64) * len(texts) + rows)
        found, rows = np.divmod(pairs, len(texts))
        bounds = np.flatnonzero(np.diff(found, prepend=-1))
        return {int(found[a]): rows[a:b] for a, b in zip(bounds, [*bounds[1:], len(rows)])}

    @staticmethod
    def candidates(query, index: dict[int, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if query[0] == "tri":
            return index.get(query[1], np.zeros(0, np.int64))
        if query[0] == "or":
            return np.unique(np.concatenate([Scanner.candidates(q, index, n) for q in query[1]]))
        rows = None
        for own in sorted((Scanner.candidates(q, index, n) for q in query[1]), key=len):
            rows = own if rows is None else np.intersect1d(rows, own, assume_unique=True)
            if not len(rows):
                break
        return rows

    def scan(self, texts: pa.Array) -> list[tuple[int, str, int, int, str]]:
        """(row, rule, start, end, match) of a segment."""
        out, index, kept = [], self.index(texts), {}
        for name, pattern, query in self.rules:
            for i in self.candidates(query, index, len(texts)).tolist():
                text = kept.get(i)
                if text is None:
                    text = texts[i].as_py()
                    if query is not True:
                        kept[i] = text
                out += [(i, name, m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
        return out


SCHEMA = "doc_id long, rule string, start int, end int, secret string"


def scan_secrets(docs: DataFrame, scanner: Scanner | None = None, segment_bytes: int = 8 << 20) -> DataFrame:
    """One row a finding: doc_id, rule, start, end, secret. No shuffle."""
    scanner = scanner or Scanner()
    names = ["doc_id", "rule", "start", "end", "secret"]
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())

    def run(batches):
        from tidemark.llm.arrays import slices

        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for first, texts in slices(strings(batch.column("text")), segment_bytes):
                rows += [(ids[first + i].as_py(), *rest) for i, *rest in scanner.scan(texts)]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    docs, _, (doc_id, text) = plain(docs, ("doc_id", "text"))
    return docs.select(integer_id(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
