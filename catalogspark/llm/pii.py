"""Personal data by anchor expansion.

An Aho-Corasick automaton walks each whole text once and reports anchors: at-signs, plus signs, digits, URL schemes and words that announce an
account. A deterministic parser starts at each anchor, finds the boundaries of what stands there and validates it. Positions are code points.

Kinds: ``email``, ``ip``, ``card``, ``phone`` (the base kinds), then ``url`` (address behind a scheme) and ``account`` (an account number or
IBAN behind an announcing word; an IBAN must pass its checksum).

Defined cases: a null or empty text has no spans; kinds are found independently, so spans of two kinds may overlap; repeated rows give the same
result each; an empty table gives no rows. Input columns whose names equal an output column are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_arrow, schema_with, without

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+")
_ACCOUNT = re.compile(r"\x20*(?:no\.?|number|nr\.?|#)?\x20*[:=]?\x20*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?|[0-9](?:[\x20-]?[0-9]){6,17})(?![A-Za-z0-9])")

# public scheme names and words that announce an account number
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "ssh://")
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, (0, 1))
    a.add_word("@", (1, 1))
    a.add_word("+", (2, 1))
    for s in SCHEMES:
        for form in {s, s.upper()}:
            a.add_word(form, (3, len(s)))
    for c in CUES:
        for form in {c, c.upper(), c.capitalize()}:
            a.add_word(form, (4, len(c)))
    a.make_automaton()
    return a


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _octet(part: str) -> bool:
    """Whether digits of any number, leading zeros included, are at most 255; int() refuses texts of more than 4,300 digits."""
    p = part.lstrip("0")
    return len(p) <= 3 and int(p or "0") <= 255


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """``(kind number, start, end)`` in order of kind and start."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    email = ip = card = phone = url = account = 0  # where each kind's search goes on
    for last, (what, size) in _automaton().iter(text):
        at = last - size + 1
        if what == 0:
            # a run of digits that fails at its first digit fails at all others, and a match ends with its last run
            if at >= ip and not (at and text[at - 1] in "0123456789") and (m := _IP.match(text, at)):
                ip = m.end()
                if all(map(_octet, m[0].split("."))):
                    found.append((1, at, ip))
            if at >= card and (m := _CARD.match(text, at)):
                card = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    found.append((2, at, card))
        elif what == 1:
            if at >= email and (m := _DOMAIN.match(text, at + 1)):
                start = at
                while start > email and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at:
                    email = m.end()
                    found.append((0, start, email))
        elif what == 2:
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((3, at, phone))
        elif what == 3:
            if at >= url and (m := _URL.match(text, last + 1)):
                url = max(last + 1, m.start() + len(m[0].rstrip(".,;:!?')]")))
                if url > last + 1:
                    found.append((4, at, url))
        elif at >= account and not (at and text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, last + 1)):
            account = m.end()
            if m[1][0].isdigit() or _iban(m[1]):
                found.append((5, m.start(1), account))
    found.sort()
    return found


SPAN_FIELD = "pii array<struct<kind:string,start:int,end:int>>"


def pii_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``pii``: every span, in order of kind and start."""
    keep = without(df, "pii")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in find_spans(t)] for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(spans, kind)], names=[*keep, "pii"])

    return map_arrow(df, run, schema_with(df, keep, SPAN_FIELD))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace every stretch covered by spans by the upper-case name of its first kind in brackets; other columns stay."""
    keep = df.columns

    def clean(text: str | None) -> str | None:
        spans = sorted((s, e, k) for k, s, e in find_spans(text))
        if not spans:
            return text
        out, at = [], 0
        merged: list[list[int]] = []
        for s, e, k in spans:
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e, k])
        for s, e, k in merged:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = e
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [pa.array([clean(t) for t in b.column(c).to_pylist()], pa.string()) if c == text_col else b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(cols, names=keep)

    return map_arrow(df, run, df.schema)


def op7(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document; the digests are built from the operator's spans."""
    found = pii_spans(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
