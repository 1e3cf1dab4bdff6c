"""Queries: joins of every shape the catalog needs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prompts import clean_prompt
from ..functions.text import dirname
from ..operators import catalog as cat
from ..operators import corrections as corr
from ..operators import dates, dedupe, generation, organize, places, search, similar, tags
from ..sources.views import hashes, label_vocabulary, read, view
from .aggregates import CLEAN
from .filters import asset_paths
from .registry import query


@query("dup_groups", using=("shelf",), oracle="SELECT m.id, k.id AS keeper, k.size AS keeper_size FROM shelf m JOIN shelf k ON m.dup_of=k.id WHERE m.dup_of>0")
def dup_groups(spark, sf):
    return dedupe.dup_groups(view(spark, sf, "shelf")).select("id", "keeper", "keeper_size")


@query("corrections_view", using=("corrections", "tagrows"), oracle="""
SELECT c.id, c.photo_id, c.action, c.confidence, t.src_path FROM corrections c JOIN tagrows t ON t.id=c.photo_id WHERE c.status='pending'""")
def corrections_view(spark, sf):
    return corr.corrections_view(view(spark, sf, "corrections"), view(spark, sf, "tagrows")).select("id", "photo_id", "action", "confidence", "src_path")


@query("drop_decided", using=("corrections",), oracle="""
WITH p AS (SELECT DISTINCT photo_id AS id, field, current, proposed FROM corrections)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM corrections c WHERE c.status IN ('rejected','applied') AND c.photo_id=p.id AND c.field=p.field AND c.current=p.current AND c.proposed=p.proposed)""")
def drop_decided(spark, sf):
    c = view(spark, sf, "corrections").withColumn("id", F.col("photo_id"))
    return corr.drop_decided(c.select("id", "field", "current", "proposed").distinct(), c.where(F.col("status").isin("rejected", "applied")))


@query("hamming_pairs", using=("hashes",), oracle="""
WITH d AS (SELECT h, min(id) AS id, count(*) AS n FROM hashes GROUP BY h)
SELECT a.id AS a, b.id AS b, bit_count(xor(a.h,b.h))::int AS dist, a.n AS n_a, b.n AS n_b FROM d a JOIN d b ON a.id<b.id AND bit_count(xor(a.h,b.h))<=6""")
def hamming_pairs(spark, sf):
    """Pairs of distinct hashes, each named by its first file, with how many files have it: equal hashes are never paired with each other."""
    d = hashes(spark, sf).groupBy("h").agg(F.min("id").alias("node"), F.count("*").alias("n"))
    n = lambda side: d.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"))
    return similar.hamming_pairs(d.select("node", "h"), 6, node="node").join(n("a"), "a").join(n("b"), "b").select("a", "b", "dist", "n_a", "n_b")


# decided assets of numbered sequences, from the event set: the number runs per folder, every third one is certain
SEQ = """seq AS (SELECT id, '/lib/'||CASE WHEN id%4=3 THEN 'backup' ELSE 'f'||(id//400) END AS dir, 'img_' AS prefix, (id*7)%10000 AS num, mtime//86400*86400 AS date_secs, k%3=0 AS strong FROM assets)"""


def sequences(spark, sf):
    a = view(spark, sf, "assets")
    d = F.when(F.col("id") % 4 == 3, "backup").otherwise(F.concat(F.lit("f"), F.floor(F.col("id") / 400).cast("string")))
    return a.select("id", F.concat(F.lit("/lib/"), d, F.lit("/x.jpg")).alias("src_path"), F.concat(F.lit("IMG_"), F.lpad(((F.col("id") * 7) % 10000).cast("string"), 4, "0")).alias("stem"),
                    (F.floor(F.col("mtime") / 86400) * 86400).alias("date_secs"), (F.col("k") % 3 == 0).alias("strong"))


@query("sequence_neighbors", using=("assets",), oracle=f"""
WITH {SEQ}, anchors AS (SELECT dir, num, min_by(date_secs, id) AS secs FROM seq WHERE strong GROUP BY 1, 2),
p AS (SELECT s.id, max(a.num) FILTER (a.num<s.num) AS prev, min(a.num) FILTER (a.num>s.num) AS next FROM seq s JOIN anchors a ON s.dir=a.dir AND abs(a.num-s.num)<=20 AND a.num<>s.num WHERE NOT s.strong GROUP BY s.id)
SELECT p.id, p.prev, p.next, x.secs AS prev_secs, y.secs AS next_secs FROM p JOIN seq s ON s.id=p.id LEFT JOIN anchors x ON x.dir=s.dir AND x.num=p.prev LEFT JOIN anchors y ON y.dir=s.dir AND y.num=p.next""")
def sequence_neighbors(spark, sf):
    n = dates.sequence_neighbors(sequences(spark, sf))
    return n.select("id", F.col("prev.num").alias("prev"), F.col("next.num").alias("next"), F.col("prev.secs").alias("prev_secs"), F.col("next.secs").alias("next_secs"))


@query("nearest_tag", using=("cosines",), oracle="SELECT vec_id AS id, max_by(tag,cos) AS tag, max_by(category,cos) AS category, round(max(cos),6) AS cos FROM cosines GROUP BY 1")
def nearest_tag(spark, sf):
    v = tags.Vocabulary.load(label_vocabulary(spark, sf))
    e = tags.nearest_tag(read(spark, sf, "embeddings"), "embedding", v)
    return e.select(F.col("vec_id").alias("id"), F.col("near.tag").alias("tag"), F.col("near.category").alias("category"), F.round("near.cos", 6).alias("cos"))


@query("score_vocab", using=("cosines",), oracle="SELECT vec_id AS id, tag, round(100*cos,5) AS logit FROM cosines")
def score_vocab(spark, sf):
    v = tags.Vocabulary.load(label_vocabulary(spark, sf))
    e = tags.score_vocab(read(spark, sf, "embeddings"), "embedding", v)
    pairs = F.arrays_zip(F.array(*[F.lit(t) for t in v.tags]).alias("tag"), F.col("logits").alias("l"))
    return e.select(F.col("vec_id").alias("id"), F.explode(pairs).alias("x")).select("id", F.col("x.tag").alias("tag"), F.round("x.l", 5).alias("logit"))


@query("similar_to", oracle="""
WITH t AS (SELECT list_transform(embedding, lambda x: x::double) AS v FROM embeddings WHERE vec_id=7)
SELECT vec_id AS id, round(3*c,6) AS score FROM (SELECT vec_id, list_dot_product(list_transform(embedding, lambda x: x::double), t.v) AS c FROM embeddings, t) WHERE c>=0.3""")
def similar_to(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), "embedding")
    target = tags.find_target(e, "embedding", "#7")
    # vectors of this set are far apart; the usual threshold of 0.8 would only find the target itself
    return tags.similar_to(e, "embedding", target, 0.3).select("id", F.round("score", 6).alias("score"))


TRANSLATIONS = "tr AS (SELECT word1 AS term, [upper(word1)||'_fr', word1||'_de', word1] AS alts FROM (SELECT DISTINCT word1 FROM tagrows WHERE word1<>'old'))"


def translations(spark, sf):
    w = view(spark, sf, "tagrows").select("word1").distinct().where("word1 <> 'old'")
    return w.select(F.col("word1").alias("term"), F.array(F.concat(F.upper("word1"), F.lit("_fr")), F.concat("word1", F.lit("_de")), "word1").alias("alts"))


@query("expand_terms", using=("tagrows",), oracle=f"""
WITH {TRANSLATIONS}, t AS (SELECT DISTINCT word1 AS term FROM tagrows UNION SELECT DISTINCT word2 FROM tagrows)
SELECT t.term, CASE WHEN tr.term IS NULL THEN t.term ELSE t.term||'|'||t.term||'_fr|'||t.term||'_de' END AS alts FROM t LEFT JOIN tr ON t.term=tr.term""")
def expand_terms(spark, sf):
    t = view(spark, sf, "tagrows").select(F.explode(F.array("word1", F.upper("word2"))).alias("term"))
    return search.expand_terms(t, translations(spark, sf)).select("term", F.array_join("alts", "|").alias("alts"))


@query("hits_to_rows", using=("docs",), oracle="SELECT id, name, n_chars, (id%100)/100.0 AS score, 'w'||id%3 AS why FROM docs WHERE id%2=0 AND id%7<>0")
def hits_to_rows(spark, sf):
    d = view(spark, sf, "docs")
    hits = d.where("id%2=0").select("id", ((F.col("id") % 100) / 100.0).alias("score"), F.concat(F.lit("w"), (F.col("id") % 3).cast("string")).alias("why"))
    return search.hits_to_rows(hits, d.where("id%7<>0")).select("id", "name", "n_chars", "score", "why")


@query("decisions_for_folder", using=("decisions", "assets"), oracle="""
SELECT id, kind FROM decisions WHERE subject LIKE '/lib/user_1/%' OR subject LIKE '/lib/user_2/%'
 OR (kind='search' AND photo_id IN (SELECT id FROM assets WHERE folder='user_1' OR folder='user_2'))""")
def decisions_for_folder(spark, sf):
    return cat.decisions_for_folder(view(spark, sf, "decisions"), asset_paths(spark, sf), ["/lib/user_1", "/lib/user_2"]).select("id", "kind")


@query("free_destinations", using=("shelf",), oracle="""
WITH p AS (SELECT id, '/out/'||day_key||'_'||lpad((id%500+1)::varchar,5,'0')||'.jpg' AS dest_path FROM shelf)
SELECT id, dest_path FROM p WHERE dest_path NOT IN (SELECT dest_path FROM shelf WHERE dest_path IS NOT NULL) AND dest_path NOT IN (SELECT '/out/'||day_key||'_00042.jpg' FROM shelf)""")
def free_destinations(spark, sf):
    s = view(spark, sf, "shelf")
    p = s.select("id", F.concat(F.lit("/out/"), "day_key", F.lit("_"), F.lpad((F.col("id") % 500 + 1).cast("string"), 5, "0"), F.lit(".jpg")).alias("dest_path"))
    disk = s.select(F.concat(F.lit("/out/"), "day_key", F.lit("_00042.jpg")).alias("dest_path"))
    return organize.free_destinations(p, s.select("dest_path"), disk).select("id", "dest_path")


@query("apply_dir_place", using=("assets",), oracle="""
SELECT id, CASE WHEN k%10=0 THEN 'Oslo' WHEN id%4=0 THEN 'Paris' WHEN id%8=2 THEN 'Rome' END AS location,
 CASE WHEN k%10=0 THEN 'metadata' WHEN id%4=0 THEN 'folder:2024-01 Paris trip' WHEN id%8=2 THEN 'file-name' WHEN k%3=0 THEN 'gps' END AS location_source,
 CASE WHEN k%10=0 THEN 1.0 WHEN id%4=0 THEN 0.7 WHEN id%8=2 THEN 0.55 ELSE 0.0 END AS location_conf FROM assets""")
def apply_dir_place(spark, sf):
    a = asset_paths(spark, sf).withColumn("dir", dirname("src_path")).withColumn("meta_place", F.when(F.col("k") % 10 == 0, "Oslo")).withColumn("has_gps", F.col("k") % 3 == 0)
    a = a.withColumn("stem", F.when(F.col("id") % 8 == 2, F.concat(F.lit("Rome trip "), "stem")).otherwise(F.col("stem")))
    d = a.where("id%4=0").select("dir").distinct().select("dir", F.lit("Paris").alias("place"), F.lit(0.7).alias("place_conf"), F.lit("folder:2024-01 Paris trip").alias("place_source"))
    out = places.apply_dir_place(a, d)
    return out.select("id", "location", "location_source", F.round("location_conf", 6).alias("location_conf"))


@query("once_per_distinct", oracle=f"""
SELECT conv_id, turn, md5({CLEAN}) AS cleaned FROM conversations""")
def once_per_distinct(spark, sf):
    c = read(spark, sf, "conversations")
    out = generation.once_per_distinct(c, "text", lambda k: k.withColumn("cleaned", F.md5(clean_prompt("text"))))
    return out.select("conv_id", "turn", "cleaned")


