"""Queries: sorts, top-k and set operations over tags and keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags as tg
from ..functions import text as tx
from ..functions.query import And, Context, Not, Or, Term, tree_score
from ..operators import catalog as cat
from ..operators import dedupe, search
from ..sources.views import view
from .aggregates import clip_tags, tag_flags
from .filters import LOW
from .registry import query


def words_of(text):
    return F.when(F.col(text).isNull(), F.array().cast("array<string>")).otherwise(F.split(text, ","))


def effective():
    """The effective tags of a tag row."""
    one = lambda c, conf: F.when(F.col(c).isNull(), tg.empty_tags()).otherwise(F.array(tg.tag(c, F.lit(conf))))
    user = F.transform(words_of("user_tags"), lambda w: F.struct(w.alias("tag"), F.lit(1.0).alias("conf")).cast(tg.TAG))
    return tg.effective_tags(user, F.array(tg.tag("kind", F.lit(1.0))), clip_tags().cast(tg.TAGS), F.filter(F.array("removed"), lambda x: x.isNotNull()), one("added", 0.8), ["anvil"])


@query("order_browse", using=("shelf",), oracle="SELECT id, date_value, src_path FROM shelf ORDER BY date_value IS NULL, date_value, src_path LIMIT 500")
def order_browse(spark, sf):
    return cat.order_browse(view(spark, sf, "shelf"), 500).select("id", "date_value", "src_path")


@query("order_assets", using=("shelf",), oracle="SELECT id, date_value, size FROM shelf ORDER BY size DESC, id LIMIT 300")
def order_assets(spark, sf):
    return cat.order_assets(view(spark, sf, "shelf"), "size", True, 300).select("id", "date_value", "size")


@query("order_tag_rows", using=("tagrows",), oracle="SELECT id, has_date::int+has_kw::int+has_desc::int+has_place::int AS flags FROM tagrows ORDER BY flags DESC, id LIMIT 200")
def order_tag_rows(spark, sf):
    t = cat.order_by_choice(tag_flags(spark, sf), cat.TAG_ROW_ORDERS, "flags", True, 200)
    return t.select("id", cat.TAG_ROW_ORDERS["flags"]().cast("bigint").alias("flags"))


@query("order_corrections", using=("corrections",), oracle="SELECT id, confidence, source FROM corrections ORDER BY confidence DESC, id LIMIT 200")
def order_corrections(spark, sf):
    return cat.order_by_choice(view(spark, sf, "corrections"), cat.CORRECTION_ORDERS, "confidence", True, 200).select("id", "confidence", "source")


@query("top_hits", using=("docs",), oracle=f"""
SELECT id, score FROM (SELECT id, contains({LOW},'ther')::int*1.5+contains({LOW},'que')::int*1.2 AS score FROM docs) ORDER BY score DESC, id LIMIT 100""")
def top_hits(spark, sf):
    score = F.contains(tx.alower("body"), F.lit("ther")).cast("int") * 1.5 + F.contains(tx.alower("body"), F.lit("que")).cast("int") * 1.2
    return search.top_hits(view(spark, sf, "docs").select("id", score.alias("score")), 100)


@query("order_dup_groups", using=("shelf",), oracle="""
SELECT k.id AS keeper, count(*) AS members, k.size*count(*) AS waste FROM shelf m JOIN shelf k ON m.dup_of=k.id WHERE m.dup_of>0 GROUP BY k.id, k.size""")
def order_dup_groups(spark, sf):
    return dedupe.order_dup_groups(view(spark, sf, "shelf")).select("keeper", "members", "waste")


@query("top_candidates", using=("docs",), oracle=f"""
SELECT id, local FROM (SELECT id, least(1.0, 2.0*(contains({LOW},'ther')::int+contains({LOW},'que')::int+contains({LOW},'der')::int)/3) AS local FROM docs) WHERE local>=0.5 ORDER BY local DESC, id LIMIT 100""")
def top_candidates(spark, sf):
    d = view(spark, sf, "docs").withColumn("p", F.lit(0.0))
    return search.ask_candidates(d, ["ther", "que", "der"], [], {"desc": tx.alower("body")}, limit=100).select("id", "local")


# (ther | que) -src1 lang:fr-or-de style tree with text, tag, flag and amount leaves
TREE = And((Or((Term("ther"), Term("que"), Term("der"))), Not(Term("src1", "name")), Or((Term("fr", "tag"), Term("de", "tag"), Term(">2k", "size")))))


@query("boolean_search", using=("docs",), oracle=f"""
WITH s AS (SELECT id, greatest(contains({LOW},'ther')::int*1.5+contains(name,'ther')::int*1.0, contains({LOW},'que')::int*1.5+contains(name,'que')::int*1.0, contains({LOW},'der')::int*1.5+contains(name,'der')::int*1.0) AS a,
 CASE WHEN contains(name,'src1') THEN 0 ELSE 0.01 END AS b,
 greatest(CASE WHEN lang='fr' THEN 1.5 ELSE 0 END, CASE WHEN lang='de' THEN 1.5 ELSE 0 END, CASE WHEN n_chars>2000 THEN 0.5 ELSE 0 END) AS c FROM docs)
SELECT id, round(a+b+c,3) AS score FROM s WHERE a>0 AND b>0 AND c>0""")
def boolean_search(spark, sf):
    d = view(spark, sf, "docs").withColumn("tags", F.array("lang")).withColumn("size", F.col("n_chars"))
    ctx = Context({"desc": tx.alower("body"), "name": F.col("name")})
    return d.withColumn("score", F.round(tree_score(TREE, ctx), 3)).where("score > 0").select("id", "score")


EFFECTIVE = """eff AS (SELECT id, CASE WHEN user_tags IS NOT NULL THEN 'Grandma|garden' ELSE array_to_string(list_filter([
  CASE WHEN coalesce(removed,'')<>kind THEN kind END,
  CASE WHEN conf1>=0.25 AND coalesce(removed,'')<>word1 AND word1<>kind THEN word1 END,
  CASE WHEN conf2>=0.25 AND word2<>'anvil' AND word2<>kind THEN word2 END,
  CASE WHEN added IS NOT NULL AND lower(added)<>'anvil' AND lower(added)<>kind AND NOT (lower(added)=word2 AND conf2>=0.25 AND word2<>'anvil') THEN added END], lambda x: x IS NOT NULL),'|') END AS tags FROM tagrows)"""


@query("effective_tags", using=("tagrows",), oracle=f"WITH {EFFECTIVE} SELECT id, tags FROM eff")
def effective_tags(spark, sf):
    return view(spark, sf, "tagrows").select("id", F.array_join(tg.tag_names(effective()), "|").alias("tags"))


@query("merge_keywords", using=("tagrows",), oracle="""
WITH k AS (SELECT id, [upper(word1), 'keepme', kind] AS cur, [word1, word2, 'new', upper(word2)] AS want, CASE WHEN id%2=0 THEN [kind, word1] ELSE [] END AS ours, word1 FROM tagrows),
l AS (SELECT *, list_filter(cur, lambda x: NOT list_contains(ours, lower(x)) OR list_contains(list_transform(want, lambda y: lower(y)), lower(x))) AS keep FROM k)
SELECT id, array_to_string(list_concat(keep, list_filter(CASE WHEN word1='new' THEN [want[2]] ELSE [want[2], want[3]] END, lambda x: NOT list_contains(list_transform(keep, lambda y: lower(y)), lower(x)))),'|') AS result,
 array_to_string(list_filter(cur, lambda x: NOT list_contains(keep, x)),'|') AS removed,
 array_to_string(list_filter(CASE WHEN word1='new' THEN [want[1], want[2]] ELSE [want[1], want[2], want[3]] END, lambda x: NOT list_contains(list_transform(list_filter(cur, lambda y: NOT list_contains(ours, lower(y))), lambda y: lower(y)), lower(x))),'|') AS ours_now FROM l""")
def merge_keywords(spark, sf):
    t = view(spark, sf, "tagrows")
    m = tg.merge_keywords(F.array(F.upper("word1"), F.lit("keepme"), "kind"), F.array("word1", "word2", F.lit("new"), F.upper("word2")),
                          F.when(F.col("id") % 2 == 0, F.array("kind", "word1")).otherwise(F.array().cast("array<string>")))
    j = lambda c: F.array_join(f"m.{c}", "|").alias(c)
    return t.select("id", m.alias("m")).select("id", j("result"), j("removed"), j("ours_now"))


@query("suggest", using=("tagrows", "shelf"), oracle="""
WITH tags AS (SELECT DISTINCT word1 AS tag FROM tagrows UNION SELECT DISTINCT word2 FROM tagrows UNION SELECT DISTINCT kind FROM tagrows),
r AS (SELECT * FROM (SELECT 1 AS prio, 'tag' AS kind, tag AS text, 'tag:'||tag AS query FROM tags WHERE contains(tag,'g') AND tag NOT IN (SELECT min(tag) FROM tags WHERE contains(tag,'g')) ORDER BY tag LIMIT 5)
 UNION ALL SELECT * FROM (SELECT DISTINCT 2, 'place', location, 'place:'||lower(location) FROM shelf WHERE contains(lower(location),'g') ORDER BY 3 LIMIT 7)),
n AS (SELECT *, row_number() OVER (ORDER BY prio, text) AS n FROM r)
SELECT kind, text, query FROM n WHERE (prio=1 AND n<=5) OR (prio=2 AND n<=7) UNION ALL SELECT 'filter','generated','is:ai'""")
def suggest(spark, sf):
    t = view(spark, sf, "tagrows").select(F.explode(F.array("word1", "word2", "kind")).alias("tag")).distinct()
    s = view(spark, sf, "shelf")
    first = t.where(F.contains("tag", F.lit("g"))).agg(F.min("tag")).first()[0]
    return cat.suggest("g", t, s.select("location").where("location IS NOT NULL").distinct(), cat.month_histogram(s), blocked=[f" {first.upper()}"])


@query("suggest_dates", using=("tagrows", "shelf"), oracle="""
WITH m AS (SELECT DISTINCT CASE WHEN date_prec='year' THEN substr(date_value,1,4) ELSE substr(date_value,1,7) END AS month FROM shelf WHERE date_value IS NOT NULL),
r AS (SELECT * FROM (SELECT DISTINCT 3 AS prio, 'year' AS kind, substr(month,1,4) AS text FROM m WHERE substr(month,1,4) LIKE '1996-%')
 UNION ALL SELECT 4, 'month', month FROM m WHERE month LIKE '1996-%')
SELECT kind, text, 'date:'||text AS query FROM (SELECT *, row_number() OVER (ORDER BY prio, text) AS n FROM r) WHERE n<=8""")
def suggest_dates(spark, sf):
    t = view(spark, sf, "tagrows").select(F.col("word1").alias("tag")).distinct()
    s = view(spark, sf, "shelf")
    return cat.suggest("1996-", t, s.select("location").where("location IS NOT NULL").distinct(), cat.month_histogram(s))


