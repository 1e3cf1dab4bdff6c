"""Queries: rankings and run retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..operators import organize
from ..operators.ranking import numbered
from ..sources.views import view
from .registry import query


def serial_sql(day: str) -> str:
    """Serials per day, starting after a given number and skipping taken ones."""
    return f"""WITH RECURSIVE t AS (SELECT id, {day} AS day_key, row_number() OVER (PARTITION BY {day} ORDER BY date_value NULLS LAST, src_path, id) AS rk FROM shelf WHERE dup_of=0),
taken AS (SELECT DISTINCT {day} AS day_key, (10+id%7*2)::bigint AS sn FROM shelf WHERE id%3=0),
free AS (SELECT day_key, sn, row_number() OVER (PARTITION BY day_key ORDER BY sn) AS rk FROM (
 SELECT d.day_key, g.sn FROM (SELECT day_key, count(*)+12 AS n FROM t GROUP BY 1) d, LATERAL (SELECT unnest(range(10, 10+d.n)) AS sn) g) x WHERE NOT EXISTS (SELECT 1 FROM taken k WHERE k.day_key IS NOT DISTINCT FROM x.day_key AND k.sn=x.sn))
SELECT t.id, t.day_key, free.sn FROM t JOIN free ON free.day_key IS NOT DISTINCT FROM t.day_key AND free.rk=t.rk"""


# undated assets have no key at all, the others one for all days of a decade
HOT_DAY = "CASE WHEN day_key<>'00000000' THEN substr(day_key,1,3) END"


def serials(spark, sf, day="day_key"):
    s = view(spark, sf, "shelf").withColumn("day_key", F.expr(day))
    todo = s.where("dup_of = 0").withColumn("first_sn", F.lit(10)).drop("sn")
    taken = s.where("id%3=0").select("day_key", (10 + F.col("id") % 7 * 2).alias("sn")).distinct()
    out = organize.assign_serials(todo, taken, ["day_key"], [F.col("date_value").asc_nulls_last(), F.col("src_path").asc(), F.col("id").asc()])
    return out.select("id", "day_key", F.col("sn").cast("bigint").alias("sn"))


@query("assign_serials", using=("shelf",), oracle=serial_sql("day_key"))
def assign_serials(spark, sf):
    return serials(spark, sf)


@query("assign_serials_hot_day", using=("shelf",), oracle=serial_sql(HOT_DAY))
def assign_serials_hot_day(spark, sf):
    """A few keys hold all rows, and one of them is missing."""
    return serials(spark, sf, HOT_DAY)


@query("numbered", using=("shelf",), oracle="SELECT id, row_number() OVER (ORDER BY size DESC, id)::int AS n FROM shelf")
def numbered_all(spark, sf):
    return numbered(view(spark, sf, "shelf").select("id", "size"), [], [F.desc("size"), F.asc("id")], "n").select("id", "n")


@query("keep_last_runs", using=("journal_fx",), oracle="SELECT id, run FROM journal_fx WHERE run IN (SELECT DISTINCT run FROM journal_fx ORDER BY run DESC LIMIT 10)")
def keep_last_runs(spark, sf):
    return cat.keep_last_runs(view(spark, sf, "journal_fx"), 10).select("id", "run")


@query("older_runs", using=("journal_fx",), oracle="SELECT DISTINCT run FROM journal_fx WHERE run NOT IN (SELECT DISTINCT run FROM journal_fx ORDER BY run DESC LIMIT 10)")
def older_runs(spark, sf):
    return cat.older_runs(view(spark, sf, "journal_fx"), 10)
