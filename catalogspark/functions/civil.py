"""Zone-less date-times that know their precision: ``struct<secs bigint, prec int>``.

``secs`` counts seconds on the naive clock since 1970-01-01; a NULL struct is "no date".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let

# fixed values: precision codes and their names
NONE, YEAR, MONTH, DAY, MINUTE, SECOND = range(6)
PRECISION_NAMES = ["none", "year", "month", "day", "minute", "second"]
_SHOWN = [0, 4, 7, 10, 16, 19]
CIVIL_TYPE = "struct<secs:bigint,prec:int>"


def precision_name(prec) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in PRECISION_NAMES]), F.coalesce(col(prec), F.lit(0)) + 1)


def precision_code(name) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(n) for n in PRECISION_NAMES]), col(name)), F.lit(1)).cast("int") - 1


def _int(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("int")


def make_civil(y, mo, d, h, mi, s, prec) -> Column:
    """NULL unless every field the precision needs is in range; finer fields are reset."""
    fields = dict(zip(("y", "mo", "d", "h", "mi", "s", "p"), (_int(c) for c in (y, mo, d, h, mi, s, prec))))

    def with_month(f):
        month = F.when(f["p"] >= MONTH, f["mo"]).otherwise(1)
        first = F.make_date(F.greatest(F.lit(1800), F.least(F.lit(2200), f["y"])), F.greatest(F.lit(1), F.least(F.lit(12), month)), F.lit(1))
        return let(F.coalesce(first, F.make_date(F.lit(1800), F.lit(1), F.lit(1))), lambda start: build(f, month, start))

    def build(f, month, first):
        day = F.when(f["p"] >= DAY, f["d"]).otherwise(1)
        ok = (f["y"].between(1800, 2200) & month.between(1, 12) & (day >= 1) & (day <= F.dayofmonth(F.last_day(first)))
              & ((f["p"] < MINUTE) | (f["h"].between(0, 23) & f["mi"].between(0, 59))) & ((f["p"] < SECOND) | f["s"].between(0, 60)))
        secs = ((F.unix_date(first) + day - 1).cast("bigint") * 86400
                + F.when(f["p"] >= MINUTE, f["h"] * 3600 + f["mi"] * 60).otherwise(0)
                + F.when(f["p"] >= SECOND, F.least(f["s"], F.lit(59))).otherwise(0))
        return F.when(ok & (f["p"] > NONE), F.struct(secs.cast("bigint").alias("secs"), f["p"].alias("prec")))

    return let(F.struct(*[c.alias(n) for n, c in fields.items()]), with_month)


def from_epoch(secs, prec: int = SECOND) -> Column:
    c = col(secs).cast("bigint")
    return F.when(c.isNotNull(), F.struct(c.alias("secs"), F.lit(prec).alias("prec")))


def day_number(secs) -> Column:
    return F.floor(col(secs) / 86400).cast("bigint")


def date_of(secs) -> Column:
    return F.date_from_unix_date(day_number(secs).cast("int"))


def civil_str(secs) -> Column:
    return F.date_format(F.timestamp_seconds(col(secs)), "yyyy-MM-dd HH:mm:ss")


def civil_pretty(secs, prec) -> Column:
    """As much of the date-time as the precision supports."""
    n = F.element_at(F.array(*[F.lit(x) for x in _SHOWN]), col(prec) + 1)
    return F.substring(civil_str(secs), F.lit(1), n)


def civil_exif(secs) -> Column:
    return F.date_format(F.timestamp_seconds(col(secs)), "yyyy:MM:dd HH:mm:ss")


def civil_xmp(secs, prec) -> Column:
    t = F.date_format(F.timestamp_seconds(col(secs)), "yyyy-MM-dd'T'HH:mm:ss")
    n = F.element_at(F.array(*[F.lit(x) for x in _SHOWN]), col(prec) + 1)
    return F.substring(t, F.lit(1), n)


# fixed values: the accepted layouts, all fields after the month optional
_META = r"^(\d{1,4})([:\-])\s*(\d{1,2})(?:(\2)\s*(\d{1,2})(?:.\s*(\d{1,2})(?:.\s*(\d{1,2})(?:.\s*(\d{1,2}))?)?)?)?.*$"


def parse_meta_datetime(text) -> Column:
    """``Y:M:D h:m:s`` or ``Y-M-DTh:m:s`` with any zone suffix; shorter forms give a coarser precision."""
    t = F.trim(col(text))
    # rewritten to "y-m-d h:m:s" with gaps where fields are missing; an hour without minutes does not count
    shape = F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-- ::"))).otherwise(F.regexp_replace(t, _META, "$1-$3-$5 $6:$7:$8"))
    shape = F.regexp_replace(shape, r" \d*::$", " ::")
    prec = (F.when(shape.rlike(r"\d$"), SECOND).when(shape.rlike(r"\d:$"), MINUTE).when(shape.rlike(r"-\d+ ::$"), DAY)
            .when(shape.rlike(r"-\d+- ::$"), MONTH).otherwise(YEAR))
    full = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(shape, " ::$", " 0:0:0"), ":$", ":0"), ":60$", ":59"), "-(?=[- ])", "-1")
    secs = F.unix_seconds(F.try_to_timestamp(full, F.lit("y-M-d H:m:s")))
    return F.when(secs.between(-5364662400, 7289654399), F.struct(secs.alias("secs"), prec.alias("prec")))  # years 1800..2200


def parse_stored(value, prec_name) -> Column:
    """A stored ``date_value`` with its precision name."""
    return let(parse_meta_datetime(value), lambda c: F.when(
        c.isNotNull() & (precision_code(prec_name) > 0), F.struct(c["secs"].alias("secs"), precision_code(prec_name).alias("prec"))))


def parse_manual(value) -> Column:
    """``YYYY-MM-DD HH:MM:SS|precision`` as a user's own date is kept."""
    bar = F.substring_index(col(value), "|", 1)
    name = F.when(F.contains(col(value), F.lit("|")), F.substring_index(col(value), "|", -1)).otherwise("second")
    return parse_stored(bar, name)
