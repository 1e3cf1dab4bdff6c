"""Splitting texts into runs of letters, single digits and runs of other signs, on arrays of code points.

Texts are joined into one array; all boundaries are found by array operations, so a text is walked once and no object is made per
word. Equal words are recognised by a 64-bit polynomial hash of their code points.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
STEP = 8192  # code points classified at once
PART = 65_536  # values hashed at once, so that what they need in between stays in the cache
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, as the tokenizers library's own patterns tell it (its Unicode version may be newer than Python's)."""
    out = np.full(0x110000, OTHER, np.uint8)
    patterns = [(kind, Split(Regex(pattern), "removed", invert=True)) for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"))]
    # a few thousand at a time: the library's own copies of all code points take 240 MB of every worker
    for low in range(0, 0x110000, STEP):
        place = np.array([k for k in range(low, min(low + STEP, 0x110000)) if not 0xD800 <= k < 0xE000], np.int64)
        joined = "".join(map(chr, place.tolist()))
        for kind, split in patterns if joined else []:
            for _, (a, b) in split.pre_tokenize_str(joined):
                out[place[a:b]] = kind
    out.flags.writeable = False
    return out


@lru_cache(maxsize=1)
def unassigned() -> np.ndarray:
    """Code points that Python's own Unicode version doesn't know, so that it can't fold their case."""
    out = np.fromiter((unicodedata.category(chr(k)) == "Cn" for k in range(0x110000)), bool, 0x110000)
    out.flags.writeable = False
    return out


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mixed(v: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each number."""
    x = v.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values``; equal spans hash equally wherever they lie."""
    n = len(values)
    size = 1 << max(16, int(n + 1).bit_length())
    powers, inverse = _powers(size)
    sums = np.zeros(n + 1, np.uint64)
    for low in range(0, n, PART):
        part = mixed(values[low:low + PART]) * powers[low:min(low + PART, n)]
        part[:1] += sums[low:low + 1]
        np.cumsum(part, out=sums[low + 1:low + 1 + len(part)], dtype=np.uint64)
    return mixed((sums[ends] - sums[starts]) * inverse[starts]) ^ (ends - starts).astype(np.uint64)


@dataclass
class Words:
    """Words of several texts: spans in the joined text, and how many each text has."""

    joined: str
    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


def split_words(texts: list[str], letters_only: bool = False, contractions: bool = True) -> Words:
    """Runs of letters, single numbers, runs of other signs; white space parts them. A sign run of one apostrophe and the
    letters s, t, m, d, re, ve or ll behind it are one word."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = classes()[points]
    n = len(points)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    firsts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1] if len(texts) else np.zeros(0, np.int64)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(joined, points, z, z, np.zeros(len(texts), np.int64))
    begins = np.empty(n, bool)
    begins[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
    begins |= kinds == NUMBER
    at = np.flatnonzero(begins)
    ends = np.append(at[1:], n)
    kind = kinds[at]
    keep = kind == LETTER if letters_only else kind != SPACE
    if contractions and not letters_only:
        apostrophe = np.flatnonzero((points[at] == 39) & (ends - at == 1) & (kind == OTHER))
        apostrophe = apostrophe[apostrophe + 1 < len(at)]
        apostrophe = apostrophe[kind[apostrophe + 1] == LETTER]
        if len(apostrophe):
            p = np.append(points, [0, 0])
            c, d = p[at[apostrophe] + 1], p[at[apostrophe] + 2]
            long = ends[apostrophe + 1] - at[apostrophe + 1] >= 2
            two = long & (((c == 114) & (d == 101)) | ((c == 118) & (d == 101)) | ((c == 108) & (d == 108)))
            one = np.isin(c, (115, 116, 109, 100))
            take = np.where(one, 1, np.where(two, 2, 0))
            hit = take > 0
            who, take = apostrophe[hit], take[hit]
            ends = ends.copy()
            at = at.copy()
            ends[who] += take
            at[who + 1] += take
            keep &= at < ends
    at, ends = at[keep], ends[keep]
    owner = np.searchsorted(firsts, at, "right") - 1
    return Words(joined, points, at, ends, np.bincount(owner, minlength=len(texts)))
