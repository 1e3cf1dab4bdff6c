"""Prompts of generated pictures: cleaning, keywords, settings text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import alower, col

# fixed values: segments that only steer quality
BOILERPLATE = ["masterpiece", "best quality", "high quality", "highres", "absurdres", "ultra detailed", "highly detailed", "8k", "4k", "uhd", "hdr",
               "amazing quality", "very aesthetic", "newest", "score 9", "score 8 up", "score 7 up", "score 6 up", "score 5 up", "score 4 up",
               "worst quality", "low quality", "detailed", "intricate details", "sharp focus", "realistic", "photorealistic", "raw photo",
               "official art", "general", "sensitive", "safe"]
# fixed values: words that carry no subject
STOP_WORDS = """the and with from that this into onto over under very high best quality detailed details masterpiece highly ultra realistic
photorealistic style image picture photo photograph background lighting light shot view looking wearing standing sitting their there while without
only should would keep make made like just also more most much some each other than then them they what when which your have been being around
behind front side left right near large small full body resolution sharp focus cinematic professional absolutely text words letters typography logo
watermark""".split()


def clean_prompt(prompt) -> Column:
    """The prompt as a description: markers, embeddings, weights and brackets removed, commas tidied."""
    s = F.replace(F.replace(col(prompt), F.lit("\\("), F.lit("(")), F.lit("\\)"), F.lit(")"))
    for pattern, by in ((r"<[^>]*>", " "), (r"\bembedding:\S+", " "), (r"\bBREAK\b", ","), (r":\s*-?[0-9.]+\s*\)", ")"), (r"[()\[\]{}]", ""),
                        (r"[ \t]+", " "), (r"\s*\n\s*", "\n"), (r"(\s*,\s*)+", ", ")):
        s = F.regexp_replace(s, pattern, by)
    return F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"^[, ]+|[, ]+$", "")


def prompt_keywords(prompt, max_n: int = 20) -> Column:
    """The short phrases of a tag-style prompt; empty for prose."""
    segs = F.transform(F.split(F.regexp_replace(clean_prompt(prompt), "[，、；;\n]", ","), ","), lambda p: alower(F.trim(F.replace(p, F.lit("_"), F.lit(" ")))))
    segs = F.filter(segs, lambda t: t != "")
    spaces = lambda t: F.length(F.regexp_replace(t, "[^ ]", ""))
    short = F.filter(segs, lambda t: spaces(t) <= 3)
    good = F.filter(short, lambda t: ~t.isin(BOILERPLATE) & (F.octet_length(t) <= 40) & ~t.startswith("score ") & ~t.startswith("rating:"))
    return F.when((F.size(segs) >= 3) & (F.size(short) * 10 >= F.size(segs) * 8), F.slice(F.array_distinct(good), F.lit(1), F.lit(max_n))).otherwise(
        F.array().cast("array<string>"))


def prompt_words(prompt) -> Column:
    """Meaningful lower-case ASCII words of four letters or more, in order, repeats included."""
    words = F.regexp_extract_all(alower(clean_prompt(prompt)), F.lit("[a-z]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(STOP_WORDS))


def short_wide_phrases(prompt) -> Column:
    """Runs of 2-6 non-ASCII characters between ASCII or full-width punctuation, distinct."""
    runs = F.regexp_extract_all(clean_prompt(prompt), F.lit(r"[^\x00-\x7F\x{3000}-\x{303F}\x{FF00}-\x{FF3F}]+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda r: F.char_length(r).between(2, 6)))


# ---- settings text ("prompt / Negative prompt: / Steps: ..., key: value")

def settings_parts(text) -> Column:
    """``struct<prompt, negative, params>`` of a settings text; params is the last "Steps:" line and what follows it."""
    lines = F.split(F.regexp_replace(col(text), r"^\s+|\s+$", ""), "\n")
    at = F.array_max(F.transform(lines, lambda line, i: F.when(F.ltrim(line).startswith("Steps: "), i)))
    head = F.when(at.isNull(), lines).otherwise(F.slice(lines, F.lit(1), F.greatest(at, F.lit(0))))
    neg_at = F.array_min(F.transform(head, lambda line, i: F.when(line.startswith("Negative prompt:"), i)))
    n = F.coalesce(neg_at, F.size(head))
    trim = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    neg = F.transform(F.slice(head, n + 1, F.size(head) + 1), lambda line: F.regexp_replace(line, "^Negative prompt:", ""))
    params = F.when(at.isNotNull(), F.array_join(F.slice(lines, F.coalesce(at, F.lit(0)) + 1, F.size(lines)), ", "))
    return F.struct(trim(F.array_join(F.slice(head, F.lit(1), n), "\n")).alias("prompt"), trim(F.array_join(neg, "\n")).alias("negative"), params.alias("params"))


_PAIR = r'([^:]+?): *("(?:[^"\\]|\\.)*"|.*?)(?:, +|,? *$)'


def settings_pairs(params) -> Column:
    """``array<struct<k,v>>`` of "key: value, key: value"; quoted values may hold commas."""
    zipped = F.arrays_zip(F.regexp_extract_all(col(params), F.lit(_PAIR), F.lit(1)).alias("k"), F.regexp_extract_all(col(params), F.lit(_PAIR), F.lit(2)).alias("v"))
    return F.transform(zipped, lambda p: F.struct(F.trim(F.regexp_replace(p["k"], "^[ ,]+", "")).alias("k"), F.nullif(F.trim(F.regexp_replace(p["v"], '^"|"$', "")), F.lit("")).alias("v")))


def pair_value(pairs, key: str) -> Column:
    """The last value of a key."""
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(col(pairs), lambda p: p["k"] == key), lambda p: p["v"])), -1)


def lora_tags(prompt, hashes) -> Column:
    """``array<struct<name,strength>>`` from the hash list (strength 1) and from ``<lora:name:weight>`` marks."""
    t = "array<struct<name:string,strength:double>>"
    listed = F.transform(F.filter(F.transform(F.split(F.coalesce(col(hashes), F.lit("")), ","), lambda p: F.trim(F.substring_index(p, ":", 1))), lambda x: x != ""),
                         lambda x: F.struct(x.alias("name"), F.lit(1.0).alias("strength"))).cast(t)
    p = r"<lora:([^:>]+)(?::([0-9.]+))?[^>]*>"
    marks = F.transform(F.regexp_extract_all(col(prompt), F.lit(p), F.lit(0)), lambda m: F.struct(
        F.regexp_extract(m, p, 1).alias("name"), F.coalesce(F.regexp_extract(m, p, 2).try_cast("double"), F.lit(1.0)).alias("strength"))).cast(t)
    both = F.concat(listed, F.coalesce(marks, F.array().cast(t)))
    names = F.transform(both, lambda x: x["name"])
    return F.filter(both, lambda x, i: F.array_position(names, x["name"]) == i + 1)


def leading_int(c) -> Column:
    return F.regexp_extract(c, r"^\s*(-?\d+)", 1).try_cast("bigint")


def leading_number(c) -> Column:
    return F.regexp_extract(c, r"^\s*(-?\d*\.?\d+)", 1).try_cast("double")


def first_set(*cols) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds)
