"""Queries: correction proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tags import TAGS
from ..operators import corrections as corr
from ..sources.views import view
from .registry import query


def checked_rows(spark, sf):
    """Tag rows with two automatic tags each, some of them about screens, some from a camera, some generated."""
    t = view(spark, sf, "tagrows")
    tag = lambda name, c: F.struct(name.alias("tag"), F.col(c).alias("conf"))
    first = F.when(F.col("id") % 5 == 0, "Screenshot").otherwise(F.col("word1"))
    stem = F.when(F.col("id") % 8 == 1, F.concat(F.lit("Screenshot "), F.col("word1"))).otherwise(F.col("word1"))
    long = F.concat(F.lit("a_very_long_file_name_about_"), "word2", F.lit("_and_its_parts_20240102_1234567.jpg"))
    words = F.array(F.struct(F.col("word2").alias("word"), F.lit(0.9).alias("p")), F.struct(F.col("brand").alias("word"), F.col("conf1").alias("p")), F.struct(F.lit("ab").alias("word"), F.lit(0.9).alias("p")),
                    F.struct(F.when(F.col("id") % 16 == 1, "screenshot").otherwise("zz").alias("word"), F.lit(0.98).alias("p")))
    return t.select("id", F.concat(F.lit("/lib/"), stem, F.lit(".jpg")).alias("src_path"), F.when(F.col("id") % 7 == 0, F.concat(F.lit("/out/"), long)).alias("dest_path"),
                    F.array(tag(first, "conf1"), tag(F.col("word2"), "conf2")).cast(TAGS).alias("tags"), (F.col("id") % 11 == 0).alias("user_tags"), (F.col("id") % 3 == 0).alias("camera"),
                    F.when(F.col("id") % 4 == 0, F.concat(F.lit("a picture of a "), F.when(F.col("id") % 8 == 0, "screen").otherwise("lake"))).alias("prompt"), words.alias("name_words"), F.when(F.col("id") % 12 == 8, F.array(F.lit("in.png"))).otherwise(F.array().cast("array<string>")).alias("sources"),
                    (F.col("id") % 2 == 0).alias("name_decided"), "word1", "word2", "brand", "conf1", "conf2")


RULES = """r AS (SELECT id, CASE WHEN id%5=0 THEN 'Screenshot' ELSE word1 END AS t1, word2 AS t2, conf1, conf2, brand, id%11=0 AS own, id%3=0 AND id%4<>0 AS camera, id%4=0 AS made, id%8=0 AS screens, id%40=4 OR id%40=24 AS answered, id%12=8 AS edit FROM tagrows),
p AS (
 SELECT id, 'tag' AS field, 'remove' AS action, t1 AS current, '' AS proposed, round(0.9-0.3*conf1,2) AS confidence, 'camera EXIF' AS source FROM r WHERE NOT own AND camera AND t1='Screenshot'
 UNION ALL SELECT id, 'tag', 'add', '', 'screenshot', 0.85, 'file name' FROM r WHERE NOT own AND NOT camera AND id%8=1 AND t1<>'Screenshot'
 UNION ALL SELECT id, 'tag', 'remove', t1, '', round(0.75-0.2*conf1,2), 'prompt' FROM r WHERE NOT own AND made AND NOT edit AND NOT answered AND NOT screens AND t1='Screenshot'
 UNION ALL SELECT id, 'tag', 'remove', t1, '', round(least(0.95, 0.8*(1-CASE WHEN t1='Screenshot' THEN 0.3 ELSE 0.5 END*conf1)),2), 'prompt + rating' FROM r WHERE NOT own AND made AND NOT edit AND answered
 UNION ALL SELECT id, 'tag', 'add', '', brand, round(0.3+0.6*conf1,2), 'file name + vector' FROM r WHERE NOT own AND NOT made AND conf1>=0.4 AND brand<>'Brand#3'
 UNION ALL SELECT id, 'tag', 'add', '', 'screenshot', 0.89, 'file name + vector' FROM r WHERE NOT own AND NOT made AND id%16=1 AND camera AND t1<>'Screenshot'
 UNION ALL SELECT id, 'name', 'rename', 'a_very_long_file_name_about_'||t2||'_and_its_parts_20240102_1234567.jpg', CASE WHEN id%8=1 THEN 'Screenshot '||x ELSE x END||'_20240102_1234567.jpg', CASE WHEN id%2=0 THEN 0.8 ELSE 0.6 END,
   CASE WHEN id%2=0 THEN 'file name + rating' ELSE 'file name' END FROM (SELECT r.*, t.word1 AS x FROM r JOIN tagrows t USING (id)) WHERE id%7=0)"""


@query("propose_corrections", using=("tagrows",), oracle=f"""
WITH {RULES} SELECT id, field, current, proposed, confidence::double AS confidence, source FROM p WHERE confidence>=0.3 AND NOT (id%13=0 AND proposed='screenshot')""")
def propose_corrections(spark, sf):
    rows = checked_rows(spark, sf)
    first = F.when(F.col("id") % 5 == 0, "SCREENSHOT").otherwise(F.col("word1"))
    answers = rows.where("id%40 in (4, 24)").select("id", F.array(F.struct(first.alias("tag"), F.lit(80.0).alias("confidence")), F.struct(F.lit("unknown").alias("tag"), F.lit(99.0).alias("confidence"))).alias("wrong"))
    decided = rows.where("id%13=0").select("id", F.lit("tag").alias("field"), F.lit("").alias("current"), F.lit("screenshot").alias("proposed"))
    out = corr.propose_corrections(rows, answers, decided, blocked=["brand#3"])
    return out.select("id", "field", "current", "proposed", "confidence", "source")


@query("apply_corrections", using=("corrections",), oracle="""
WITH a AS (SELECT photo_id, id, action, CASE WHEN action='remove' THEN current ELSE proposed END AS tag, confidence FROM corrections WHERE status='applied' OR id%2=0),
l AS (SELECT photo_id, tag, max_by(action,id) AS action, max_by(confidence,id) AS conf, max(id) AS id FROM a GROUP BY 1, 2)
SELECT photo_id, coalesce(string_agg(tag,'|' ORDER BY id) FILTER (action='remove'),'') AS removed, coalesce(string_agg(tag||'='||round(conf,2)::double::varchar,'|' ORDER BY id) FILTER (action<>'remove'),'') AS added FROM l GROUP BY 1""")
def apply_corrections(spark, sf):
    c = view(spark, sf, "corrections").where("status = 'applied' OR id%2 = 0")
    a = corr.apply_corrections(c)
    return a.select("photo_id", F.array_join("removed", "|").alias("removed"), F.array_join(F.transform("added", lambda t: F.concat(t["tag"], F.lit("="), t["conf"].cast("string"))), "|").alias("added"))
