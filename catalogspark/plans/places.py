"""Queries: places from folder names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import placenames as pn
from ..functions.text import ancestor_dirs, dirname
from ..operators import places
from ..operators.ranking import stage
from .filters import asset_paths
from .registry import query


def folders(spark, sf):
    """Distinct folders of the event set, some renamed so that plain and trip names compete, with their place phrases."""
    a = asset_paths(spark, sf).select(dirname("src_path").alias("dir"), ancestor_dirs("src_root", "src_path").alias("dirs"), "user_id", "folder")
    a = a.groupBy("dir").agg(F.any_value("dirs").alias("dirs"), F.max("user_id").alias("user_id"), F.any_value("folder").alias("folder"))
    name = F.when(F.col("folder").startswith("user_"), F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("Kyoto "), "folder")).when(F.col("user_id") % 3 == 1, "Birthday"))
    a = a.withColumn("dirs", F.when(name.isNotNull(), F.array(name, F.when(F.col("user_id") % 2 == 0, "Rome trip").otherwise("Lima 2019"), F.lit("lib"))).otherwise(F.col("dirs")))
    return stage(a.select("dir", pn.place_candidates("dirs").alias("candidates")), "places")


# the phrases each folder yields, in order: text, prior, trip word
PHRASES = """f AS (SELECT DISTINCT '/lib/'||folder AS dir, folder, CASE WHEN folder LIKE 'user_%' THEN user_id END AS u FROM assets),
c AS (SELECT dir, u, 0 AS i, 'Paris' AS text, 0.7 AS prior FROM f WHERE folder='2024-01 Paris trip'
 UNION ALL SELECT dir, u, 0, 'lib', 0.30 FROM f WHERE folder IN ('2024-01 Paris trip','backup') UNION ALL SELECT dir, u, 0, 'lib', 0.25 FROM f WHERE folder='DCIM/100CANON'
 UNION ALL SELECT dir, u, 0, CASE u%3 WHEN 0 THEN 'Kyoto user' WHEN 1 THEN 'Birthday' END, 0.35 FROM f WHERE u%3<2
 UNION ALL SELECT dir, u, 1, CASE WHEN u%2=0 THEN 'Rome' ELSE 'Lima' END, CASE WHEN u%2=0 THEN 0.65 ELSE 0.30 END FROM f WHERE u%3<2
 UNION ALL SELECT dir, u, 2, 'lib', 0.25 FROM f WHERE u%3<2 UNION ALL SELECT dir, u, 0, 'lib', 0.30 FROM f WHERE u%3=2)"""


@query("place_candidates", using=("assets",), oracle=f"WITH {PHRASES} SELECT dir, text, prior::double AS prior FROM c")
def place_candidates(spark, sf):
    c = folders(spark, sf).select("dir", F.explode("candidates").alias("c"))
    return c.select("dir", F.col("c.text").alias("text"), F.round("c.prior", 6).alias("prior"))


@query("decide_places", using=("assets",), oracle=f"""
WITH {PHRASES}, b AS (SELECT *, max(prior) OVER (PARTITION BY dir) AS best FROM c),
r AS (SELECT *, CASE WHEN prior>=best THEN prior ELSE prior*(1-best)*0.5 END AS rules, CASE WHEN u%3=0 THEN CASE WHEN text='Kyoto user' THEN 0.9 ELSE 0.0 END WHEN u%3=1 AND u%5=0 THEN 0.0 END AS vision FROM b),
t AS (SELECT *, (0.25*rules+0.60*coalesce(vision,0))/(0.25+CASE WHEN vision IS NULL THEN 0 ELSE 0.60 END) AS score FROM r WHERE rules>=0.5 OR coalesce(vision,0)>=0.5),
m AS (SELECT dir, max_by(text, score) AS place, max(score) AS conf FROM t GROUP BY dir)
SELECT d.dir, CASE WHEN conf>=0.5 THEN place END AS place, round(CASE WHEN conf>=0.5 THEN conf END,6) AS conf FROM (SELECT DISTINCT dir FROM c) d LEFT JOIN m ON m.dir=d.dir""")
def decide_places(spark, sf):
    f = folders(spark, sf)
    u = F.regexp_extract("dir", "user_([0-9]+)$", 1).try_cast("int")
    vision = f.select("dir", F.when(u % 3 == 0, " KYOTO ").when((u % 3 == 1) & (u % 5 == 0), "none").alias("answer"), F.lit(0.9).alias("conf")).where("answer is not null")
    return places.decide_places(f, vision).select("dir", "place", F.round("place_conf", 6).alias("conf"))


@query("decide_places_arbiter", using=("assets",), oracle=f"""
WITH {PHRASES}, b AS (SELECT *, max(prior) OVER (PARTITION BY dir) AS best, row_number() OVER (PARTITION BY dir ORDER BY i) AS pos FROM c),
r AS (SELECT *, CASE WHEN prior>=best THEN prior ELSE prior*(1-best)*0.5 END AS rules, CASE WHEN pos=1 THEN 0.9 ELSE 0.1 END AS arb FROM b),
m AS (SELECT dir, max_by(text, (0.25*rules+0.15*arb)/0.4) AS place, max((0.25*rules+0.15*arb)/0.4) AS conf FROM r WHERE rules>=0.5 GROUP BY dir)
SELECT d.dir, CASE WHEN conf>=0.5 THEN place END AS place, round(CASE WHEN conf>=0.5 THEN conf END,6) AS conf FROM (SELECT DISTINCT dir FROM c WHERE dir<>'/lib/2024-01 Paris trip') d LEFT JOIN m ON m.dir=d.dir""")
def decide_places_arbiter(spark, sf):
    f = folders(spark, sf).where("dir <> '/lib/2024-01 Paris trip'")
    arb = f.select("dir", F.transform("candidates", lambda c, i: F.when(i == 0, 0.9).otherwise(0.1)).alias("probs"))
    return places.decide_places(f, None, arb).select("dir", "place", F.round("place_conf", 6).alias("conf"))


@query("match_answer", using=("assets",), oracle=f"""
WITH {PHRASES}, n AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY i, CASE WHEN text='lib' THEN 1 ELSE 0 END)-1 AS pos FROM c)
SELECT dir, coalesce(min(pos) FILTER (lower(text)='lib'),-1)::int AS same, coalesce(min(pos) FILTER (contains(lower(text),'ro') OR contains('ro',lower(text)) OR (lower(text)='rome')),-1)::int AS part, -1 AS none FROM n GROUP BY dir""")
def match_answer(spark, sf):
    m = lambda a: pn.match_answer("candidates", F.lit(a))
    return folders(spark, sf).select("dir", m(" LIB ").alias("same"), m("ro").alias("part"), m("None").alias("none"))
