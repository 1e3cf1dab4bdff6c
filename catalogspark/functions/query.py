"""Search conditions as Columns: dates, amounts, flags, words, and a predicate tree with scores."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import alower, col

# fixed values: how much a hit in each field counts
FIELD_WEIGHTS = {"desc": 1.5, "prompt": 1.2, "name": 1.0, "exif": 0.8}
UNITS = [("gb", 1e9), ("mb", 1e6), ("kb", 1e3), ("mp", 1e6), ("k", 1e3), ("m", 1e6), ("b", 1.0)]
RAW_EXTENSIONS = ["dng", "cr2", "cr3", "nef", "arw", "raf", "orf", "rw2"]
FUZZY_FIELDS = ("desc", "name", "prompt")
MIN_MATCH = 0.30


def date_overlaps(date, prec, lo: str = "", hi: str = "") -> Column:
    """The asset's period (its whole year or month when coarse) meets the range; open ends allowed, undated never match."""
    if not lo and not hi:
        return F.lit(True)
    d, p = F.left(col(date), F.lit(10)), col(prec)
    start = F.when(p == "year", F.concat(F.left(d, F.lit(4)), F.lit("-01-01"))).when(p == "month", F.concat(F.left(d, F.lit(7)), F.lit("-01"))).otherwise(d)
    stop = F.when(p == "year", F.concat(F.left(d, F.lit(4)), F.lit("-12-31"))).when(p == "month", F.concat(F.left(d, F.lit(7)), F.lit("-31"))).otherwise(d)
    ok = F.length(d) >= 10
    if lo:
        ok = ok & (stop >= lo)
    if hi:
        ok = ok & (start <= hi)
    return F.coalesce(ok, F.lit(False))


def date_bounds(spec: str) -> tuple[str, str]:
    """``2019``, ``2019-05``, ``a..b``, ``>x``, ``>=x``, ``<x``, ``<=x`` as inclusive day strings."""
    year = lambda v, step: str(int(v) + step) if re.fullmatch(r"\d{4}", v) else v
    if ".." in spec:
        lo, hi = spec.split("..", 1)
    elif spec.startswith(">="):
        lo, hi = spec[2:], ""
    elif spec.startswith("<="):
        lo, hi = "", spec[2:]
    elif spec.startswith(">"):
        lo, hi = year(spec[1:], 1), ""
    elif spec.startswith("<"):
        lo, hi = "", year(spec[1:], -1)
    else:
        lo = hi = spec
    low = {4: lo + "-01-01", 7: lo + "-01"}.get(len(lo), lo)
    high = {4: hi + "-12-31", 7: hi + "-31"}.get(len(hi), hi)
    return low, high


def date_filter(date, prec, spec: str) -> Column:
    if spec in ("none", "undated"):
        return col(date).isNull() | (F.length(col(date)) < 4)
    lo, hi = date_bounds(spec)
    return col(date).isNotNull() & date_overlaps(date, prec, lo, hi)


def parse_amount(text: str) -> float:
    """``2mb`` or ``1024`` as a number; units are decimal."""
    t, scale = text.lower(), 1.0
    for suffix, m in UNITS:
        if len(t) > len(suffix) and t.endswith(suffix):
            t, scale = t[:-len(suffix)], m
            break
    lead = re.match(r"\s*[-+]?(\d+\.?\d*|\.\d+)", t)
    return (float(lead.group(0)) if lead else 0.0) * scale


def amount_filter(value, spec: str) -> Column:
    """Comparisons, ranges (the left end takes the right end's unit) and plain numbers (within 10 %)."""
    x = col(value).cast("double")
    if ".." in spec:
        a, b = spec.split("..", 1)
        unit = re.search(r"[A-Za-z]*$", b).group(0)
        lo = F.lit(True) if not a else x >= parse_amount(a if a[-1].isalpha() else a + unit)
        return lo & (F.lit(True) if not b else x <= parse_amount(b))
    for op, test in ((">=", lambda v: x >= v), ("<=", lambda v: x <= v), (">", lambda v: x > v), ("<", lambda v: x < v)):
        if spec.startswith(op):
            return test(parse_amount(spec[len(op):]))
    v = parse_amount(spec)
    return F.abs(x - v) <= 0.1 * v


def dimension_filter(name: str, width, height, spec: str) -> Column:
    """``w``/``width``, ``h``/``height`` or ``mp``; unknown sizes never match."""
    if name == "mp":
        pixels = col(width).cast("double") * col(height)
        return (col(width) > 0) & amount_filter(pixels, spec if re.search("[mk]", spec) else spec + "mp")
    v = col(width if name[0] == "w" else height)
    return (v > 0) & amount_filter(v, spec)


def is_flag(flag: str, d: dict | None = None) -> Column:
    """Yes/no properties; ``d`` maps field names to columns."""
    c = lambda n: col((d or {}).get(n, n))
    w, h = c("width"), c("height")
    tests = {
        ("fav", "favorite", "favourite", "star"): lambda: c("favorite"),
        ("ai", "generated"): lambda: c("prompt").isNotNull() & (c("prompt") != ""),
        ("untagged",): lambda: F.size(c("tags")) == 0,
        ("uncertain", "review"): lambda: c("needs_review"),
        ("undated",): lambda: c("date_value").isNull(),
        ("portrait",): lambda: (h > w) & (w > 0),
        ("landscape",): lambda: (w > h) & (h > 0),
        ("square",): lambda: (w == h) & (w > 0),
    }
    for names, test in tests.items():
        if flag in names:
            return F.coalesce(test(), F.lit(False))
    return F.lit(False)


def has_flag(flag: str, d: dict | None = None) -> Column:
    """Presence of a position, prompt, place, tags or metadata fields; ``exif`` holds lower-case "key = value" lines."""
    c = lambda n: col((d or {}).get(n, n))
    exif = lambda *keys: reduce(lambda a, b: a | b, [F.contains(c("exif"), F.lit(k)) for k in keys])
    tests = {
        ("gps",): lambda: c("has_gps"),
        ("prompt",): lambda: c("prompt").isNotNull() & (c("prompt") != ""),
        ("place", "location"): lambda: c("location").isNotNull() | c("has_gps"),
        ("tags",): lambda: F.size(c("tags")) > 0,
        ("desc", "description"): lambda: exif("xmp.dc.description"),
        ("keywords",): lambda: exif("xmp.dc.subject", "keywords"),
        ("camera",): lambda: exif("exif.image.model"),
        ("date",): lambda: c("date_value").isNotNull(),
    }
    for names, test in tests.items():
        if flag in names:
            return F.coalesce(test(), F.lit(False))
    return F.lit(False)


def ext_filter(ext, wanted: str) -> Column:
    e = alower(ext)
    w = "jpg" if wanted == "jpeg" else wanted
    return e.isin(*({w} | ({"jpeg"} if w == "jpg" else set()) | (set(RAW_EXTENSIONS) if w == "raw" else set())))


def camera_filter(exif, term: str) -> Column:
    """A make, model or lens line contains the term."""
    line = lambda x: (x.startswith("exif.image.make") | x.startswith("exif.image.model") | F.contains(x, F.lit("lensmodel"))) & F.contains(x, F.lit(term))
    return F.coalesce(F.exists(F.split(col(exif), "\n"), line), F.lit(False))


def generator_filter(prompt, term: str) -> Column:
    """The generator line (the last one of the prompt field) contains the term."""
    return F.coalesce(F.contains(col(prompt), F.lit("\n")) & F.contains(F.substring_index(col(prompt), "\n", -1), F.lit(term)), F.lit(False))


def place_filter(location, alts: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(alower(location), F.lit(x)) for x in alts]), F.lit(False))


def tag_filter(tags, alts: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(col(tags), F.array(*[F.lit(x) for x in alts])), F.lit(False))


def term_weight(term: str, fields: dict) -> Column:
    """Summed weights of the fields (name -> lower-case text column) that contain the term."""
    return reduce(lambda a, b: a + b, [F.when(F.contains(col(c), F.lit(term)), FIELD_WEIGHTS[f]).otherwise(0.0) for f, c in fields.items()])


def best_term_weight(alts: list[str], fields: dict) -> Column:
    w = [term_weight(a, fields) for a in alts]
    return w[0] if len(w) == 1 else F.greatest(*w)


def fuzzy_word(text, word: str) -> Column:
    """The first closest word within one (short words) or two byte edits; NULL without one."""
    as_bytes = lambda w: F.decode(F.encode(w, "UTF-8"), "ISO-8859-1")
    limit = 1 if len(word.encode()) <= 4 else 2
    words = F.filter(F.split(col(text), r"[^A-Za-z0-9\x{80}-\x{10FFFF}]+"), lambda w: (w != "") & (F.octet_length(w) + 2 >= len(word.encode())))
    scored = F.transform(words, lambda w, i: F.struct(F.levenshtein(as_bytes(w), as_bytes(F.lit(word)), limit).alias("d"), i.alias("i"), w.alias("w")))
    return F.array_min(F.filter(scored, lambda s: s["d"] >= 0))["w"]


# ---- predicate trees

@dataclass(frozen=True)
class Term:
    text: str
    field: str = ""


@dataclass(frozen=True)
class And:
    kids: tuple


@dataclass(frozen=True)
class Or:
    kids: tuple


@dataclass(frozen=True)
class Not:
    kid: object


@dataclass
class Context:
    """What leaves may use: text fields by name, equivalents of terms, and meaning scores per term."""

    fields: dict
    alts: dict = field(default_factory=dict)
    meaning: dict = field(default_factory=dict)
    similar: dict = field(default_factory=dict)
    columns: dict = field(default_factory=dict)


def _leaf(n: Term, ctx: Context) -> Column:
    t, f = n.text, n.field
    if not t:
        return F.lit(0.01)
    alts = ctx.alts.get(t, [t])
    c = lambda name: col(ctx.columns.get(name, name))
    half = lambda cond: F.when(cond, 0.5).otherwise(0.0)
    one = lambda cond, v=1.0: F.when(cond, v).otherwise(0.0)
    if f == "is":
        return half(is_flag(t, ctx.columns))
    if f == "has":
        return half(has_flag(t, ctx.columns))
    if f in ("date", "year"):
        return half(date_filter(c("date_value"), c("date_prec"), t))
    if f == "size":
        return half(amount_filter(c("size"), t))
    if f in ("w", "width", "h", "height", "mp"):
        return half(dimension_filter(f, c("width"), c("height"), t))
    if f in ("ext", "type"):
        return half(ext_filter(c("ext"), t))
    if f == "camera":
        return one(camera_filter(c("exif"), t))
    if f in ("model", "lora"):
        return one(generator_filter(c("prompt"), t))
    if f == "like":
        return F.coalesce(ctx.similar.get(t, F.lit(0.0)), F.lit(0.0))
    if f == "fuzzy":
        return one(reduce(lambda a, b: a | b, [fuzzy_word(x, t).isNotNull() for k, x in ctx.fields.items() if k in FUZZY_FIELDS]))
    if f in ("place", "loc"):
        return one(place_filter(c("location"), alts))
    if f == "tag":
        return one(tag_filter(c("tags"), alts), 1.5)
    words = best_term_weight(alts, {k: v for k, v in ctx.fields.items() if f in ("", k)} or {"name": F.lit("")})
    if not f and t in ctx.meaning:
        p = ctx.meaning[t]
        return F.when(words > 0, words).when(p >= MIN_MATCH, p * 1.5).otherwise(0.0)
    return words


def tree_score(node, ctx: Context) -> Column:
    """One score expression for a tree: AND adds (0 when a part fails), OR takes the best, NOT turns 0 into 0.01."""
    if isinstance(node, Term):
        return _leaf(node, ctx)
    if isinstance(node, Not):
        return F.when(tree_score(node.kid, ctx) > 0, 0.0).otherwise(0.01)
    parts = [tree_score(k, ctx) for k in node.kids]
    if isinstance(node, Or):
        return parts[0] if len(parts) == 1 else F.greatest(*parts)
    every = reduce(lambda a, b: a & b, [p > 0 for p in parts])
    return F.when(every, reduce(lambda a, b: a + b, parts)).otherwise(0.0)
