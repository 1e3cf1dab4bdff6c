"""Queries: tagging from embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import tags
from ..sources.views import label_vocabulary, read, view
from .registry import query

SCORES = """l AS (SELECT vec_id AS id, tag, category, pos, exp(100*cos-max(100*cos) OVER (PARTITION BY vec_id)) AS e FROM cosines),
s AS (SELECT *, e/sum(e) OVER (PARTITION BY id, category) AS share, sum(e) OVER (PARTITION BY id, category)/sum(e) OVER (PARTITION BY id) AS mass FROM l),
conf AS (SELECT *, share*least(1.0, mass/0.3) AS conf FROM s),
good AS (SELECT *, row_number() OVER (PARTITION BY id, category ORDER BY e DESC, pos) AS r FROM conf WHERE mass>=0.08 AND share>=0.25 AND conf>=0.12),
picked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY conf DESC, e DESC, pos) AS rank FROM good WHERE r<=2)"""


def scored(spark, sf):
    v = tags.Vocabulary.load(label_vocabulary(spark, sf))
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return tags.tag_scores(tags.log_sum_exp(tags.score_vocab(e, "embedding", v), v), v), v


@query("tag_assets", using=("cosines",), oracle=f"WITH {SCORES} SELECT id, tag, round(conf,6) AS conf FROM picked WHERE rank<=8")
def tag_assets(spark, sf):
    df, _ = scored(spark, sf)
    return tags.pick_tags(df).select("id", F.explode("picked").alias("t")).select("id", F.col("t.tag").alias("tag"), F.round("t.conf", 6).alias("conf"))


@query("pick_tags", using=("cosines",), oracle=f"WITH {SCORES} SELECT id, tag, rank FROM picked WHERE rank<=2")
def pick_tags(spark, sf):
    df, _ = scored(spark, sf)
    return tags.pick_tags(df, 2).select("id", F.posexplode("picked").alias("p", "t")).select("id", F.col("t.tag").alias("tag"), (F.col("p") + 1).alias("rank"))


@query("retag_stale", using=("cosines",), oracle=f"WITH {SCORES} SELECT id, count(*) AS n, round(max(conf),6) AS best FROM picked WHERE rank<=8 AND id%3=0 GROUP BY id")
def retag_stale(spark, sf):
    """Only rows with an old vocabulary or few sure tags are tagged again, from their stored vectors."""
    v = tags.Vocabulary.load(label_vocabulary(spark, sf))
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.when(F.expr("vec_id%3=0"), "old").otherwise("v1").alias("clip_vocab"))
    t = tags.tag_assets(e.where("clip_vocab <> 'v1'"), "embedding", v)
    return t.select("id", F.size("picked").cast("bigint").alias("n"), F.round(F.array_max(F.transform("picked", lambda x: x["conf"])), 6).alias("best")).where("n > 0")


QUERY_VEC = "q AS (SELECT list_transform(embedding, lambda x: x::double) AS v FROM embeddings WHERE vec_id=3)"
PHRASE = f"""{QUERY_VEC}, cat AS (SELECT category AS c FROM cosines WHERE vec_id=3 ORDER BY cos DESC LIMIT 1),
lq AS (SELECT vec_id, 100*list_dot_product(list_transform(embedding, lambda x: x::double), q.v) AS l FROM embeddings, q),
m AS (SELECT c.vec_id, greatest(max(100*cos), any_value(lq.l)) AS mx FROM cosines c JOIN lq ON lq.vec_id=c.vec_id GROUP BY 1),
p AS (SELECT c.vec_id AS id, exp(any_value(lq.l)-any_value(mx)) AS eq, sum(exp(100*cos-mx)) AS ea, sum(exp(100*cos-mx)) FILTER (category=(SELECT c FROM cat)) AS ec
 FROM cosines c JOIN lq ON lq.vec_id=c.vec_id JOIN m ON m.vec_id=c.vec_id GROUP BY 1),
pc AS (SELECT id, greatest(0,least(1, eq/(ec+eq)*least(1.0,((ec+eq)/(ea+eq))/0.3))) AS p FROM p)"""


def phrase_scores(spark, sf):
    """How sure every vector shows what vector 3 shows, as a new phrase next to the vocabulary."""
    df, v = scored(spark, sf)
    q = np.array(read(spark, sf, "embeddings").where("vec_id = 3").first()["embedding"], dtype=np.float64)
    near = v.categories[int(np.argmax(v.vectors @ q))]
    return tags.phrase_confidence(df, "embedding", v, q, near)


@query("phrase_confidence", using=("cosines",), oracle=f"WITH {PHRASE} SELECT id, round(p,6) AS p FROM pc")
def phrase_confidence(spark, sf):
    return phrase_scores(spark, sf).select("id", F.round("p", 6).alias("p"))


@query("known_tag_confidence", using=("cosines",), oracle=f"WITH {SCORES} SELECT id, round(conf,6) AS p FROM conf WHERE tag='label_4'")
def known_tag_confidence(spark, sf):
    df, v = scored(spark, sf)
    i = v.tags.index("label_4")
    return tags.phrase_confidence(df, "embedding", v, v.vectors[i], v.categories[i], same=i).select("id", F.round("p", 6).alias("p"))


@query("smart_update", using=("tagrows",), oracle="""
WITH t AS (SELECT id, CASE WHEN id%7=0 THEN NULL ELSE clip_model END AS model, greatest(conf1,conf2) AS best, (conf1>=0.25)::int+(conf2>=0.25)::int+(id%2)::int AS sure, size<5 AS tiny, id%5=0 AS answered, ((id*37)%101)/100.0 AS p
 FROM tagrows WHERE user_tags IS NULL),
w AS (SELECT *, model IS NOT NULL AND model<>'m1' AND best>=0.5 AND sure>=3 AND NOT tiny AS close FROM t)
SELECT id, CASE WHEN model IS NULL OR model<>'m1' THEN 'reanalyse' ELSE 'retag' END AS action,
 round((CASE WHEN model IS NULL THEN CASE WHEN tiny THEN 0.3 ELSE 1.0 END WHEN close THEN CASE WHEN answered THEN p ELSE 0.5 END WHEN model<>'m1' THEN CASE WHEN tiny THEN 0.3 ELSE 0.85 END ELSE 0.6 END)::double,6) AS worth
FROM w WHERE model IS NULL OR model<>'m1' OR sure<2 OR best<0.25""")
def smart_update(spark, sf):
    t = view(spark, sf, "tagrows").withColumn("model", F.when(F.col("id") % 7 != 0, F.col("clip_model"))).withColumn("best", F.greatest("conf1", "conf2"))
    t = t.withColumn("sure", (F.col("conf1") >= 0.25).cast("int") + (F.col("conf2") >= 0.25).cast("int") + (F.col("id") % 2).cast("int")).withColumn("tiny", F.col("size") < 5)
    ans = t.where("id%5=0").select("id", (((F.col("id") * 37) % 101) / 100.0).alias("p"))
    t = t.withColumn("user_tags", F.col("user_tags").isNotNull())
    return tags.smart_update(t, "m1", ans).select("id", "action", F.round("worth", 6).alias("worth"))
