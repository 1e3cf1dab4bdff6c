"""Queries: the search modes and what surrounds model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import query as q
from ..functions import text as tx
from ..operators import search
from ..operators.ranking import in_batches, spread
from ..sources.views import view
from .filters import LOW
from .joins import TRANSLATIONS, translations
from .registry import query
from .tags import PHRASE, phrase_scores

HIT = lambda w: f"(contains({LOW},'{w}')::int*1.5+contains(name,'{w}')::int*1.0)"
FIELDS = {"desc": "low", "name": "name"}


def docs(spark, sf):
    return spread(view(spark, sf, "docs")).withColumn("low", tx.alower("body"))


@query("search_words", using=("docs",), oracle=f"""
SELECT id, round(({HIT('the')}+{HIT('ther')})/6.6,6) AS score FROM docs WHERE {HIT('the')}>0 AND {HIT('ther')}>0 AND NOT contains({LOW},'src1') AND NOT contains(name,'src1')""")
def search_words(spark, sf):
    return search.search_words(docs(spark, sf), ["the", "ther"], ["src1"], FIELDS).select("id", F.round("score", 6).alias("score"))


@query("search_meaning", using=("cosines",), oracle=f"WITH {PHRASE} SELECT id, round(p,6) AS score FROM pc WHERE p>=0.30")
def search_meaning(spark, sf):
    return search.search_meaning(phrase_scores(spark, sf)).select("id", F.round("score", 6).alias("score"))


# documents 0..n-1 share their ids with the vectors, so both kinds of evidence meet
@query("search_smart", using=("cosines", "docs"), oracle=f"""
WITH {PHRASE}, k AS (SELECT docs.id, ({HIT('the')}+{HIT('ther')})/6.6 AS kw, {HIT('the')}>0 AND {HIT('ther')}>0 AS words, contains(name,'src1') OR contains({LOW},'src1') AS bad, coalesce(pc.p,0) AS p FROM docs LEFT JOIN pc ON pc.id=docs.id)
SELECT id, round(0.6*p + CASE WHEN words THEN 0.4*greatest(kw,0.5) ELSE 0 END + CASE WHEN words AND p>=0.3 THEN 0.2 ELSE 0 END,6) AS score FROM k WHERE NOT bad AND (words OR p>=0.3)""")
def search_smart(spark, sf):
    kw = search.keyword_scores(docs(spark, sf), ["the", "ther"], ["src1"], FIELDS)
    both = kw.join(phrase_scores(spark, sf).select("id", "p"), "id", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    return search.search_smart(both).select("id", F.round("score", 6).alias("score"))


ASK = f"""cand AS (SELECT docs.id, name, least(1.0, greatest(least(1.0, 2.0*(({HIT('ther')}>0)::int+({HIT('que')}>0)::int+({HIT('der')}>0)::int)/3), greatest(0,least(1,coalesce(pc.p,0)/0.6)))
  + CASE WHEN ({HIT('ther')}>0 OR {HIT('que')}>0 OR {HIT('der')}>0) AND coalesce(pc.p,0)/0.6>0.3 THEN 0.15 ELSE 0 END) AS local FROM docs LEFT JOIN pc ON pc.id=docs.id WHERE NOT {HIT('src1')}>0)"""


def candidates(spark, sf):
    d = docs(spark, sf).join(phrase_scores(spark, sf).select("id", "p"), "id", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    return search.ask_candidates(d, ["ther", "que", "der"], ["src1"], FIELDS, limit=0)


@query("ask_candidates", using=("cosines", "docs"), oracle=f"WITH {PHRASE}, {ASK} SELECT id, round(local,6) AS local FROM cand WHERE local>=0.5")
def ask_candidates(spark, sf):
    return candidates(spark, sf).select("id", F.round("local", 6).alias("local"))


def blended(spark, sf):
    c = candidates(spark, sf)
    d = view(spark, sf, "docs")
    rating = d.where("id%4<>0").select("id", ((F.col("id") * 37) % 101).cast("double").alias("r"))
    arb = d.where("id%3<>0").select("id", ((F.col("id") * 53) % 101).cast("double").alias("q"))
    return search.ask_blend(c, rating, arb)


BLEND = """b AS (SELECT *, CASE WHEN id%4<>0 THEN (id*37)%101 END AS r, CASE WHEN (id%4=0 OR (id*37)%101 BETWEEN 30 AND 70) AND id%3<>0 THEN (id*53)%101 END AS q FROM cand WHERE local>=0.5),
d AS (SELECT *, CASE WHEN q IS NOT NULL AND r IS NOT NULL THEN 0.5*r+0.5*q ELSE coalesce(r,q) END AS decision FROM b)"""


@query("ask_blend", using=("cosines", "docs"), oracle=f"""
WITH {PHRASE}, {ASK}, {BLEND} SELECT id, round(CASE WHEN decision IS NULL THEN local ELSE 0.3*local+0.7*decision/100.0 END,6) AS score, coalesce(q IS NOT NULL AND (r>=50)<>(decision>=50),false) AS changed FROM d WHERE decision IS NULL OR decision>=50""")
def ask_blend(spark, sf):
    return blended(spark, sf).where("kept").select("id", F.round("score", 6).alias("score"), "changed")


@query("ask_decision_log", using=("cosines", "docs"), oracle=f"""
WITH {PHRASE}, {ASK}, {BLEND} SELECT 'search' AS kind, id AS photo_id, name AS question, CASE WHEN r IS NULL THEN '-' WHEN r>=50 THEN 'keep' ELSE 'drop' END AS rules_pick, CASE WHEN q>=50 THEN 'yes' ELSE 'no' END AS arbiter_pick,
 CASE WHEN decision>=50 THEN 'keep' ELSE 'drop' END AS final_pick, coalesce((r>=50)<>(decision>=50),false) AS changed FROM d WHERE q IS NOT NULL""")
def ask_decision_log(spark, sf):
    return search.ask_decision_log(blended(spark, sf), "a question").select("kind", "photo_id", "question", "rules_pick", "arbiter_pick", "final_pick", "changed")


@query("ask_batches", using=("docs",), oracle="""
SELECT (row_number() OVER (ORDER BY n_chars DESC, id)-1)//25 AS batch, id FROM docs WHERE n_chars>500""")
def ask_batches(spark, sf):
    b = in_batches(view(spark, sf, "docs").where("n_chars > 500").select("id", "n_chars"), [F.desc("n_chars"), F.asc("id")], 25)
    return b.select("batch", F.explode("items").alias("x")).select("batch", F.col("x.id").alias("id"))


@query("terms_to_translate", using=("tagrows",), oracle=f"""
WITH {TRANSLATIONS}, t AS (SELECT word1 AS term FROM tagrows UNION SELECT word2 FROM tagrows UNION SELECT id::varchar||'-1' FROM tagrows UNION SELECT left(word1,1) FROM tagrows UNION SELECT left(word2,2) FROM tagrows)
SELECT term FROM t WHERE length(term)>=2 AND NOT regexp_matches(term,'^[0-9_-]*$') AND term NOT IN (SELECT term FROM tr)""")
def terms_to_translate(spark, sf):
    t = view(spark, sf, "tagrows")
    words = F.array("word1", F.upper("word2"), F.concat(F.col("id").cast("string"), F.lit("-1")), F.left("word1", F.lit(1)), F.left("word2", F.lit(2)), F.lit(""))
    return search.terms_to_translate(t.select(F.explode(words).alias("term")), translations(spark, sf))


@query("english_phrase", using=("tagrows",), oracle="""
SELECT id, CASE id%3 WHEN 0 THEN word1 ELSE word1||' '||word2 END AS english FROM tagrows""")
def english_phrase(spark, sf):
    t = view(spark, sf, "tagrows")
    foreign = lambda c: F.concat(F.lit("海"), F.col(c))
    phrase = F.when(F.col("id") % 3 == 0, foreign("word1")).when(F.col("id") % 3 == 1, F.concat_ws(" ", foreign("word1"), F.col("word2"))).otherwise(F.concat_ws(" ", "word1", "word2"))
    tr = t.select("word1").distinct().select(foreign("word1").alias("term"), F.array(F.concat(F.lit("日"), "word1"), F.col("word1")).alias("alts"))
    return search.english_phrase(t.select("id", phrase.alias("phrase")), tr).select("id", "english")


@query("date_listing", using=("shelf",), oracle="""
SELECT id, 0.0::double AS score, substr(date_value,1,10) AS why FROM shelf WHERE CASE date_prec WHEN 'year' THEN substr(date_value,1,4)||'-12-31' WHEN 'month' THEN substr(date_value,1,7)||'-31' ELSE substr(date_value,1,10) END>='2000-06-01'""")
def date_listing(spark, sf):
    return search.date_listing(view(spark, sf, "shelf").where(q.date_overlaps("date_value", "date_prec", "2000-06-01")))

