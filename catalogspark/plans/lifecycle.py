"""Queries: user overrides, remaining work and the combined view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..operators import dedupe, search
from ..sources.views import view
from .registry import query


@query("apply_user_overrides", using=("shelf",), oracle="""
SELECT id, CASE WHEN id%10=0 THEN true WHEN id%5=0 THEN false ELSE favorite END AS favorite, CASE WHEN id%8=0 THEN 'b' END AS user_tags, CASE WHEN (id//3)%4=0 THEN id%3=1 AND (id//3)*3+1 IN (SELECT id FROM shelf) ELSE false END AS pinned,
 CASE WHEN id%8=0 AND meta_state='full' THEN 'base' ELSE meta_state END AS meta_state FROM shelf""")
def apply_user_overrides(spark, sf):
    s = view(spark, sf, "shelf").withColumn("group_id", F.expr("id div 3")).withColumn("pinned", F.lit(False)).withColumn("user_tags", F.lit(None).cast("string"))
    fav = s.where("id%5=0").select("id", F.lit(False).alias("on"), F.lit(1).alias("at")).unionByName(s.where("id%10=0").select("id", F.lit(True).alias("on"), F.lit(2).alias("at")))
    lists = s.where("id%8=0").select("id", F.explode(F.array(F.struct(F.lit("a").alias("tags"), F.lit(1).alias("at")), F.struct(F.lit("b").alias("tags"), F.lit(2).alias("at")))).alias("x")).select("id", "x.tags", "x.at")
    pins = s.where("group_id%4=0 and id%3<>2").select("group_id", "id", F.when(F.col("id") % 3 == 1, 9).otherwise(1).alias("at"))
    return cat.apply_user_overrides(s, fav, lists, pins).select("id", "favorite", "user_tags", "pinned", "meta_state")


@query("work_selection", using=("shelf",), oracle="""
SELECT 'undecided' AS stage, id FROM shelf WHERE NOT resolved
UNION ALL SELECT 'unembedded', id FROM shelf WHERE dup_of=0 AND clip_model IS DISTINCT FROM 'm1'
UNION ALL SELECT 'stale_tags', id FROM shelf WHERE dup_of=0 AND clip_model='m1' AND id%3=0
UNION ALL SELECT 'few_tags', id FROM shelf WHERE dup_of=0 AND clip_model='m1' AND id%3<>0 AND id%4<2
UNION ALL SELECT 'no_prompt_keywords', id FROM shelf WHERE gen_tool IS NOT NULL
UNION ALL SELECT 'undescribed', id FROM shelf WHERE dup_of=0 AND vision_status IS NULL
UNION ALL SELECT 'failed', id FROM shelf WHERE dup_of=0 AND vision_status='failed'""")
def work_selection(spark, sf):
    s = view(spark, sf, "shelf").withColumn("clip_vocab", F.when(F.col("id") % 3 == 0, "old").otherwise("v1")).withColumn("gen_keywords", F.lit("")).withColumn("sure", F.col("id") % 4)
    return cat.work_selection(s, {"model": "m1", "vocab": "v1"})


@query("catalog_view", using=("shelf",), oracle="""
SELECT 'row' AS part, id::varchar AS key, size::bigint AS n FROM shelf WHERE favorite AND location='Paris'
UNION ALL SELECT 'month', CASE WHEN date_value IS NULL THEN 'undated' WHEN date_prec='year' THEN substr(date_value,1,4) ELSE substr(date_value,1,7) END, count(*) FROM shelf GROUP BY 2
UNION ALL SELECT 'place', location, count(*) FROM shelf WHERE location IS NOT NULL GROUP BY 2
UNION ALL SELECT 'group', k.id::varchar, k.size*count(*) FROM shelf m JOIN shelf k ON m.dup_of=k.id WHERE m.dup_of>0 GROUP BY k.id, k.size
UNION ALL SELECT 'stat', 'total', count(*) FROM shelf UNION ALL SELECT 'stat', 'dups', count(*) FROM shelf WHERE dup_of>0""")
def catalog_view(spark, sf):
    """One refresh: filtered rows, months, places, duplicate groups and counts over the same catalog."""
    s = view(spark, sf, "shelf").withColumn("search_text", search.search_text("src_path", "location"))
    part = lambda df, name, key, n: df.select(F.lit(name).alias("part"), F.col(key).cast("string").alias("key"), F.col(n).cast("bigint").alias("n"))
    rows = cat.browse(s).where("favorite AND location = 'Paris'")
    stats = cat.catalog_stats(s).select(F.explode(F.create_map(F.lit("total"), F.col("total"), F.lit("dups"), F.col("dups"))).alias("k", "v"))
    return (part(rows, "row", "id", "size").unionByName(part(cat.month_histogram(s), "month", "month", "files"))
            .unionByName(part(cat.place_counts(s, None), "place", "location", "files"))
            .unionByName(part(dedupe.order_dup_groups(s), "group", "keeper", "waste")).unionByName(part(stats, "stat", "k", "v")))
