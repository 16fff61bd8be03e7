"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Defined results
- A null text has no findings and stays null; an empty one stays empty.
- A span that a check refuses is tried again with its shorter ends (of an IBAN the one its country fixes), and the
  search goes on one character after its start. Of overlapping spans of a rule a confirmed one wins, then the longer,
  then the earlier; of those of several rules the one with the higher score, then the longer, then the earlier.
- Offsets are in characters of the original text, ends exclusive.
- Phone numbers have 7 to 15 digits after a plus sign, or the three groups of North America; those separated by spaces only
  count beside a context word.
- Repeated rows give repeated findings. Extra columns, whatever their names, are kept by `redact` and ignored by `find`;
  doc_id is NULL where it can't be read as a whole number.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.arrays import strings
from tidemark.llm.shared import integer_id, plain


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 check of an IBAN without spaces."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _card(s: str) -> bool:
    digits = re.sub(r"\D", "", s)
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits)


def _iban(s: str) -> bool:
    s = re.sub(r"\s", "", s).upper()
    return 15 <= len(s) <= 34 and mod97(s)


#: Characters of an IBAN by country, those that use it without being registered included.
IBAN_LENGTHS = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for country in countries.split()}


def _separated(text: str, start: int, end: int) -> Iterator[int]:
    """end, then the places of the spaces and hyphens before it, from the right."""
    yield end
    for i in range(end - 1, start, -1):
        if text[i] in " -":
            yield i


def _iban_ends(text: str, start: int, end: int) -> Iterator[int]:
    """The end that the country fixes, then the whole span; only that for other countries."""
    n = IBAN_LENGTHS.get(text[start : start + 2].upper(), 0)
    for i in range(start, end):
        n -= text[i] != " "
        if not n:
            if not _WORD_CHARACTER.match(text, i + 1):
                yield i + 1
            break
    yield end


def _ip(s: str) -> bool:
    return all(int(x) <= 255 and (x == "0" or x[0] != "0") for x in s.split("."))


def _ssn(s: str) -> bool:
    area, group, serial = s.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Rule:
    """Score = base, + confirmed or + refuted by the check, + context if one of the words is near."""

    kind: str
    pattern: str
    base: float
    check: object = None
    confirmed: float = 0.0
    refuted: float = 0.0
    words: tuple[str, ...] = ()
    context: float = 0.2
    #: (text, start, end) to the ends to be checked in turn; None: the proposed one only.
    ends: object = None


_PHONE_WORDS = ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone")
RULES = (
    Rule("email", r"(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w-])", 0.9, words=("mail", "email", "contact", "contacto", "courriel")),
    Rule("card", r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])(?!\.\d)", 0.3, _card, 0.5, -0.3, ("card", "visa", "credit", "mastercard", "karte", "carte", "tarjeta"), ends=_separated),
    Rule("iban", r"(?<!\w)[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?!\w)", 0.2, _iban, 0.7, -0.2, ("iban", "account", "konto", "compte", "cuenta"), ends=_iban_ends),
    Rule("phone", r"(?<![\w.+(-])\+[1-9](?:[ .()-]{0,2}\d){6,14}(?![\w-])|(?<![\w.+(-])\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\w-])|(?<![\w.+(-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])", 0.6, words=_PHONE_WORDS),
    Rule("phone", r"(?<![\w.+(-])(?<!\d )\d{3} \d{3} \d{4}(?![\w-])(?! ?\d)", 0.4, words=_PHONE_WORDS),
    Rule("ip", r"(?<![\w.-])\d{1,3}(?:\.\d{1,3}){3}(?![\w-])(?!\.\d)", 0.3, _ip, 0.3, -0.3, ("ip", "address", "server", "host", "login")),
    Rule("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", 0.2, _ssn, 0.3, -0.2, ("ssn", "social", "security"), 0.3),
)
_NEGATIVE = frozenset(("version", "release", "isbn", "order", "part", "sku"))
_WORD = re.compile(r"[^\W\d_]+")
_WORD_CHARACTER = re.compile(r"\w")
WINDOW = 60
PROBE = r"[0-9@]"


def _apart(spans: list[tuple[int, int]]) -> list[int]:
    """Which of the spans, best first, overlap none of the chosen before them."""
    starts: list[int] = []
    ends: list[int] = []
    chosen = []
    for i, (a, b) in enumerate(spans):
        at = bisect_left(starts, a)
        if (not at or ends[at - 1] <= a) and (at == len(starts) or starts[at] >= b):
            starts.insert(at, a)
            ends.insert(at, b)
            chosen.append(i)
    return chosen


def _spans(rule: "Rule", pattern: re.Pattern, text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, confirmed) of a rule, not overlapping. Without a check nothing is refused."""
    if not rule.check:
        yield from ((m.start(), m.end(), False) for m in pattern.finditer(text))
        return
    found, m = [], pattern.search(text)
    while m:
        start, end = m.span()
        ends = rule.ends(text, start, end) if rule.ends else (end,)
        good = next((e for e in ends if rule.check(text[start:e])), None)
        found.append((good is None, start - (good or end), start, good or end))
        m = pattern.search(text, start + 1)
    found.sort()
    for i in _apart([(a, b) for _, _, a, b in found]):
        refused, _, a, b = found[i]
        yield a, b, not refused


class Finder:
    def __init__(self, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, window: int = WINDOW):
        self.rules = [(r, re.compile(r.pattern), frozenset(r.words)) for r in rules]
        self.threshold, self.window = threshold, window

    def __call__(self, text: str) -> list[tuple[str, int, int, float]]:
        """(kind, start, end, score) in order of start, not overlapping."""
        found = []
        for rule, pattern, words in self.rules:
            if rule.kind == "email" and "@" not in text:
                continue
            for a, b, confirmed in _spans(rule, pattern, text):
                score = rule.base
                if rule.check:
                    score += rule.confirmed if confirmed else rule.refuted
                near = {w.lower() for w in _WORD.findall(text[max(0, a - self.window) : a] + " " + text[b : b + self.window])}
                if near & words:
                    score += rule.context
                if near & _NEGATIVE and not near & words - _NEGATIVE:
                    score -= rule.context
                score = round(min(max(score, 0.0), 1.0), 6)
                if score >= self.threshold:
                    found.append((-score, a - b, a, b, rule.kind))
        found.sort()
        chosen = [(found[i][4], found[i][2], found[i][3], -found[i][0]) for i in _apart([f[2:4] for f in found])]
        return sorted(chosen, key=lambda x: x[1])


def _candidates(texts: pa.Array):
    """Rows that may hold personal data: every rule needs a digit or an at sign."""
    return pc.indices_nonzero(pc.match_substring_regex(texts, PROBE)).to_pylist()


FINDINGS = "doc_id long, kind string, start int, end int, value string, score double"


def find(docs: DataFrame, finder: Finder | None = None) -> DataFrame:
    """One row a finding: doc_id, kind, start, end, value, score. No shuffle."""
    finder = finder or Finder()
    names = ["doc_id", "kind", "start", "end", "value", "score"]

    def run(batches):
        for batch in batches:
            texts = strings(batch.column("text"))
            ids = batch.column("doc_id")
            rows = []
            for i in _candidates(texts):
                text = texts[i].as_py()
                rows += [(ids[i].as_py(), kind, a, b, text[a:b], score) for kind, a, b, score in finder(text)]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    docs, _, (doc_id, text) = plain(docs, ("doc_id", "text"))
    return docs.select(integer_id(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, FINDINGS)


def redact(docs: DataFrame, finder: Finder | None = None) -> DataFrame:
    """docs with every finding in text replaced by its kind in angle brackets; all other columns as they were."""
    finder = finder or Finder()
    docs, names, (text,) = plain(docs, ("text",))
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            texts = strings(column)
            done, last = [], 0
            for i in _candidates(texts):
                text = texts[i].as_py()
                if spans := finder(text):
                    parts, end = [], 0
                    for kind, a, b, _ in spans:
                        parts += [text[end:a], f"<{kind.upper()}>"]
                        end = b
                    done += [column.slice(last, i - last), pa.array(["".join(parts) + text[end:]], column.type)]
                    last = i + 1
            if done:
                column = pa.concat_arrays([*done, column.slice(last)])
            yield pa.RecordBatch.from_arrays([column if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

    return docs.mapInArrow(run, T.StructType(docs.schema.fields)).toDF(*names)
