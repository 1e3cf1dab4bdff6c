"""Reading file names: prefixes worth keeping, serial numbers and meaningful words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import alower, bound, col, utf8_cut

# fixed values: what is stripped from a name
COPY_MARKER = r"(?i)(\s*\(\d+\)|[ _-]copy( \d+)?|\s*副本.*)$"
DATE_TIME = (r"(^|[^0-9])((19|20)\d\d[-_.]?(0[1-9]|1[0-2])[-_.]?(0[1-9]|[12]\d|3[01]))"
             r"([ _T.-]?([01]\d|2[0-3])[-_.:h]?[0-5]\d([-_.:m]?[0-5]\d)?s?(\d{3})?)?(?=[^0-9]|$)")
TIME_ONLY = r"(^|[^0-9])([01]\d|2[0-3])[.:-][0-5]\d([.:-][0-5]\d)?(?=[^0-9]|$)"
EPOCH = r"(^|[^0-9])1\d{9}(\d{3})?(?=[^0-9]|$)"
MESSENGER = r"(?i)[ _-]?WA\d{4}$"
TRAILING_NUMBER = r"[ _.-]*\d{2,}[ _.-]*$"
SEPARATORS = r"([ _.-])[ _.-]+"
TRAILING_WORD = r"(?i)[ _.-]+(at|on|um|de|from|le|の)$"

# fixed values: words that say nothing about the content
FILLER_WORDS = """img dsc dscn dscf pxl mvimg vid mov image pic picture photo photos file copy final edit edited export exported
untitled new a an the of and with in on at for to by from my our is are 4k 8k hd uhd fhd 1080p 720p 2160p hq hdr masterpiece best
quality high highres resolution jpg jpeg png webp wa ai v1 v2 v3""".split()


def name_prefix(stem) -> Column:
    """The part of a name that is not a date, time, counter or copy marker; '' when no letters remain."""
    s = col(stem)
    for _ in range(3):
        s = F.regexp_replace(s, COPY_MARKER, "")
    for pattern in (DATE_TIME, TIME_ONLY, EPOCH):
        s = F.regexp_replace(s, pattern, "$1")
    s = F.regexp_replace(s, MESSENGER, "")
    for _ in range(3):
        s = F.regexp_replace(s, TRAILING_NUMBER, "")
        s = F.regexp_replace(s, SEPARATORS, "$1")
        s = F.regexp_replace(s, TRAILING_WORD, "")
        s = F.regexp_replace(s, r"^[ _.-]+|[ _.-]+$", "")
    return bound(s, lambda s: F.when(s.rlike(r"[A-Za-z\x{80}-\x{10FFFF}]"), utf8_cut(s, 60)).otherwise(""))


def serial_name(stem, sep: str = "_") -> Column:
    """``struct<day_key, sn>`` of names ending in day, separator, number; NULL otherwise."""
    s = col(stem)
    if sep == "":
        p = r"(?:^|[^0-9])(\d{8})(\d+)$"
    else:
        p = r"(?:^|[^0-9])(\d{8})\Q" + sep + r"\E(\d+)$"
    return F.when(s.rlike(p), F.struct(F.regexp_extract(s, p, 1).alias("day_key"),
                                       F.regexp_extract(s, p, 2).try_cast("bigint").alias("sn")))


def long_name(prefix) -> Column:
    return bound(col(prefix), lambda p: (F.char_length(p) > 30) | (F.length(F.regexp_replace(p, r"[^ _\-]", "")) + 1 > 4))


def name_words(stem) -> Column:
    """Distinct meaningful lower-case words of a name, in order."""
    parts = F.transform(F.split(name_prefix(stem), r"[ _\-.+()\[\],#]"), alower)

    def keep(w):
        wide = w.rlike(r"[\x{80}-\x{10FFFF}]")
        letters = F.length(F.regexp_replace(w, "[^a-z]", ""))
        digits = F.length(F.regexp_replace(w, "[^0-9]", ""))
        identifier = (digits >= 2) & (letters >= 2) & (F.length(w) >= 6)
        noise = (F.length(w) >= 12) & (letters == F.length(w)) & ~w.rlike("[aeiou]")
        return ((w != "") & ~w.isin(FILLER_WORDS) & ~w.rlike("^[0-9]+$")
                & (wide | ((F.length(w) >= 2) & ~identifier & ~noise)))

    return F.array_distinct(F.filter(parts, keep))


def short_prefix(stem, words) -> Column:
    """The prefix, or for a long one its key words joined with '-' until about 28 bytes."""
    joined = F.aggregate(col(words), F.lit(""), lambda acc, w: F.when(F.octet_length(acc) > 28, acc).when(
        acc == "", F.replace(w, F.lit(" "), F.lit("-"))).otherwise(F.concat(acc, F.lit("-"), F.replace(w, F.lit(" "), F.lit("-")))))
    key_words = lambda prefix: bound(joined, lambda j: F.when(j != "", j).otherwise(F.left(prefix, F.lit(30))))
    return bound(name_prefix(stem), lambda prefix: F.when(~long_name(prefix), prefix).otherwise(key_words(prefix)))
