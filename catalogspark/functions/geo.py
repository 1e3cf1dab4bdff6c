"""Positions, satellite time and zone offsets from metadata text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .civil import DAY, day_number, parse_meta_datetime
from .text import col, let


def rational(text) -> Column:
    a = F.regexp_extract(text, r"^\s*(-?\d+)/(-?\d+)", 1).try_cast("double")
    b = F.regexp_extract(text, r"^\s*(-?\d+)/(-?\d+)", 2).try_cast("double")
    plain = F.regexp_extract(text, r"^\s*([-+]?\d*\.?\d+)", 1).try_cast("double")
    return F.coalesce(F.when(b != 0, a / b), plain, F.lit(0.0))


def _dms(text) -> Column:
    p = F.split(F.trim(col(text)), " ")
    return F.when(F.size(p) >= 3, rational(p[0]) + rational(F.get(p, F.lit(1))) / 60.0 + rational(F.get(p, F.lit(2))) / 3600.0)


def gps_decimal(lat, lat_ref, lon, lon_ref) -> Column:
    """``struct<lat,lon>`` in degrees; NULL when incomplete, out of range or the (0,0) placeholder."""
    la = _dms(lat) * F.when(F.trim(col(lat_ref)) == "S", -1.0).otherwise(1.0)
    lo = _dms(lon) * F.when(F.trim(col(lon_ref)) == "W", -1.0).otherwise(1.0)
    return let(F.struct(la.alias("lat"), lo.alias("lon")), lambda p: F.when(
        (F.abs(p["lat"]) <= 90) & (F.abs(p["lon"]) <= 180) & ~((F.abs(p["lat"]) < 1e-6) & (F.abs(p["lon"]) < 1e-6)), p))


def gps_time(date_stamp, time_stamp) -> Column:
    """Epoch seconds of the satellite clock; NULL without a full date and a valid time."""
    d, t = parse_meta_datetime(date_stamp), F.split(F.trim(col(time_stamp)), " ")
    h, mi, s = (rational(F.get(t, F.lit(i))).cast("int") for i in range(3))
    ok = (d["prec"] >= DAY) & (F.size(t) >= 3) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 60)
    return F.when(ok, day_number(d["secs"]) * 86400 + h * 3600 + mi * 60 + F.least(s, F.lit(59)))


def utc_offset(*texts) -> Column:
    """Seconds of the first well-formed ``+hh:mm`` among the given values."""
    def one(text):
        t = F.trim(col(text))
        p = r"^([+-])(\d{1,2}):(\d{1,2})"
        secs = F.regexp_extract(t, p, 2).try_cast("int") * 3600 + F.regexp_extract(t, p, 3).try_cast("int") * 60
        return F.when((F.length(t) >= 6) & t.rlike(p), F.when(F.regexp_extract(t, p, 1) == "-", -secs).otherwise(secs))
    return F.coalesce(*[one(t) for t in texts])
