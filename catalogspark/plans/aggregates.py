"""Queries: catalog analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..operators import catalog as cat
from ..operators import dates, dedupe, generation, organize, tags
from ..sources.views import label_vocabulary, read, view
from .registry import query


@query("catalog_stats", using=("shelf",), oracle="""
SELECT count(*) AS total, sum(resolved::int)::bigint AS resolved, sum((resolved AND needs_review)::int)::bigint AS review,
 sum((resolved AND date_value IS NULL)::int)::bigint AS undated, count(*) FILTER (vision_status='done') AS described,
 count(*) FILTER (vision_status='failed') AS failed, count(dest_path) AS organized, count(*) FILTER (dup_of>0) AS dups, count(location) AS located,
 sum(size)::bigint AS bytes, coalesce(sum(size) FILTER (dup_of>0),0)::bigint AS dup_bytes, count(*) FILTER (similar_to>0) AS similar, count(clip_model) AS tagged FROM shelf""")
def catalog_stats(spark, sf):
    return cat.catalog_stats(view(spark, sf, "shelf"))


MONTH = "CASE WHEN date_value IS NULL THEN 'undated' WHEN date_prec='year' THEN substr(date_value,1,4) ELSE substr(date_value,1,7) END"


@query("month_histogram", using=("shelf",), oracle=f"SELECT {MONTH} AS month, count(*) AS files, sum(size)::bigint AS bytes FROM shelf GROUP BY 1")
def month_histogram(spark, sf):
    return cat.month_histogram(view(spark, sf, "shelf"))


@query("year_rollup", using=("shelf",), oracle=f"""
SELECT coalesce(year,'(all)') AS year, coalesce(month,'(all)') AS month, files, level FROM (
 SELECT year, month, count(*) AS files, grouping(year, month)::bigint AS level FROM (
  SELECT coalesce(substr(date_value,1,4),'undated') AS year, {MONTH} AS month FROM shelf) GROUP BY ROLLUP(year, month))""")
def year_rollup(spark, sf):
    return cat.year_rollup(view(spark, sf, "shelf"))


@query("decision_stats", using=("decisions",), oracle="SELECT coalesce(kind,'(all)') AS kind, count(*) AS asked, sum(changed)::bigint AS changed FROM decisions GROUP BY ROLLUP(kind)")
def decision_stats(spark, sf):
    return cat.decision_stats(view(spark, sf, "decisions"))


@query("embedding_counts", using=("tagrows",), oracle="""
SELECT count(*) AS total, count(*) FILTER (clip_model IS DISTINCT FROM 'm1') AS no_vec,
 count(*) FILTER (clip_model='m1' AND clip_vocab<>'v1') AS stale,
 count(*) FILTER (clip_model='m1' AND (conf1>=0.25)::int+(conf2>=0.25)::int<2) AS few FROM tagrows WHERE id%12<>0""")
def embedding_counts(spark, sf):
    return cat.embedding_counts(view(spark, sf, "tagrows").withColumn("tags", clip_tags()).withColumn("dup_of", F.when(F.col("id") % 12 == 0, F.col("id") + 1)), "m1", "v1")


def clip_tags():
    """The two words of a part's name as automatic tags."""
    t = lambda w, c: F.struct(F.col(w).alias("tag"), F.col(c).alias("conf"))
    return F.array(t("word1", "conf1"), t("word2", "conf2"))


@query("journal_runs", using=("journal_fx",), oracle="""
SELECT run, min("at") AS "at", count(DISTINCT photo_id) AS files, min(undone::int)::int AS undone, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds
FROM journal_fx GROUP BY run ORDER BY run DESC LIMIT 20""")
def journal_runs(spark, sf):
    return cat.journal_runs(view(spark, sf, "journal_fx"), 20)


@query("place_counts", oracle="""
SELECT n_name AS location, count(*) AS files FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
def place_counts(spark, sf):
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return cat.place_counts(c.select(F.col("n_name").alias("location")))


@query("bulk_copy_groups", using=("assets",), oracle=r"""
SELECT dir, minute, files, days, (files>=5 AND days>=2) OR files>=20 AS bulk FROM (
 SELECT '/lib/'||folder AS dir, (mtime//86400)::bigint AS minute, count(*) AS files, count(DISTINCT day_) AS days FROM (
  SELECT *, CASE WHEN kind IN ('click','view','purchase','error') THEN day END AS day_ FROM assets) GROUP BY 1, 2)""")
def bulk_copy_groups(spark, sf):
    a = view(spark, sf, "assets").withColumn("src_path", F.concat_ws("/", F.lit("/lib"), "folder", F.concat("stem", F.lit(".jpg"))))
    a = ev.with_name_dates(a, F.array("stem"), False, "named", 1790000000)
    # the files of this set arrive minutes apart, so a day stands in for the minute
    a = a.withColumn("days", dates.evidence_days(F.col("named"))).withColumn("mtime", F.floor(F.col("mtime") / 86400) * 60)
    return dates.bulk_copy_groups(a)


@query("collision_tiers", oracle="""
WITH one AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY n_chars) AS c FROM documents WHERE n_chars>0) WHERE c>1),
two AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY n_chars, left(text,65536), right(text,65536)) AS c2 FROM one) WHERE c2>1),
three AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY n_chars, md5(text)) AS c3 FROM two) WHERE c3>1)
SELECT 'size' AS tier, count(DISTINCT n_chars) AS groups, count(*) AS files, sum(n_chars)::bigint AS bytes FROM one
UNION ALL SELECT 'quick', count(DISTINCT (n_chars, left(text,65536), right(text,65536))), count(*), sum(n_chars)::bigint FROM two
UNION ALL SELECT 'full', count(DISTINCT (n_chars, md5(text))), count(*), sum(n_chars)::bigint FROM three""")
def collision_tiers(spark, sf):
    return dedupe.collision_tiers(read(spark, sf, "documents"), "n_chars", "text")


@query("dup_summary", using=("shelf",), oracle="""
WITH e AS (SELECT m.size, k.id AS keeper FROM shelf m JOIN shelf k ON m.dup_of=k.id WHERE m.dup_of>0),
s AS (SELECT k.id AS keeper FROM shelf m JOIN shelf k ON m.similar_to=k.id WHERE m.similar_to>0)
SELECT (SELECT count(*) FROM shelf) AS files, (SELECT sum(size)::bigint FROM shelf) AS bytes, (SELECT count(DISTINCT keeper) FROM e) AS exact_groups,
 (SELECT count(*) FROM e) AS extra, (SELECT sum(size)::bigint FROM e) AS reclaimable, (SELECT count(DISTINCT keeper) FROM s) AS similar_groups,
 (SELECT count(*)+count(DISTINCT keeper) FROM s) AS similar_files""")
def dup_summary(spark, sf):
    return dedupe.dup_summary(view(spark, sf, "shelf"))


TAG_FLAGS = """tagflags AS (SELECT *, clip_model IS NOT NULL AS tagged, user_tags IS NOT NULL AS user_edited,
 clip_model IS NOT NULL AND (clip_model<>'m1' OR clip_vocab<>'v1') AS stale, CASE WHEN user_tags IS NOT NULL THEN 1.0 ELSE greatest(conf1, conf2) END AS best FROM tagrows)"""


def tag_flags(spark, sf):
    t = view(spark, sf, "tagrows")
    return (t.withColumn("tagged", F.col("clip_model").isNotNull()).withColumn("user_edited", F.col("user_tags").isNotNull())
            .withColumn("stale", F.col("clip_model").isNotNull() & ((F.col("clip_model") != "m1") | (F.col("clip_vocab") != "v1")))
            .withColumn("best", F.when(F.col("user_tags").isNotNull(), 1.0).otherwise(F.greatest("conf1", "conf2"))))


@query("tag_coverage", using=("tagrows",), oracle=f"""
WITH {TAG_FLAGS} SELECT count(*) AS total, count(*) FILTER (NOT tagged AND NOT user_edited) AS untagged,
 count(*) FILTER ((tagged OR user_edited) AND best<0.25) AS weak, count(*) FILTER (stale AND NOT user_edited) AS stale, count(*) FILTER (user_edited) AS edited,
 count(*) FILTER (NOT has_date) AS no_date, count(*) FILTER (NOT has_kw) AS no_keywords, count(*) FILTER (NOT has_desc) AS no_description,
 count(*) FILTER (NOT has_place) AS no_place, count(gen_tool) AS generated FROM tagflags""")
def tag_coverage(spark, sf):
    return tags.tag_coverage(tag_flags(spark, sf))


KEEPER = r"""row_number() OVER (PARTITION BY lang, n_chars%7 ORDER BY (NOT pinned), dest_path IS NULL, -meta_len,
 (regexp_matches(regexp_extract(src_path,'([^/]*)\.txt$',1), '(\(\d+\)|[ _-]copy( \d+)?)$') OR regexp_matches(src_path,'/backup/')), mtime=0, mtime, strlen(src_path), id)"""


@query("choose_keeper", using=("docs",), oracle=f"""
SELECT lang, n_chars%7 AS bucket, id AS keeper, copies FROM (SELECT *, {KEEPER} AS rn, count(*) OVER (PARTITION BY lang, n_chars%7) AS copies FROM docs) WHERE rn=1""")
def choose_keeper(spark, sf):
    return dedupe.choose_keeper(view(spark, sf, "docs").withColumn("bucket", F.col("n_chars") % 7), ["lang", "bucket"])


@query("next_serial", using=("shelf",), oracle="""
SELECT status AS out_root, day_key, coalesce(max(sn),0)+1 AS next FROM shelf GROUP BY 1, 2""")
def next_serial(spark, sf):
    return organize.next_serial(view(spark, sf, "shelf").withColumn("out_root", F.col("status")))


PLAN = """plan AS (SELECT id, size, needs_review, CASE WHEN dup_of>0 THEN 'duplicate' WHEN id%4=0 THEN 'copy' WHEN id%4=1 THEN 'refile' WHEN id%4=2 THEN 'metadata' ELSE 'rename' END AS action,
 id%9<>0 AND dup_of=0 AS include FROM shelf)"""


def simple_plan(spark, sf):
    s = view(spark, sf, "shelf")
    a = F.when(F.col("dup_of") > 0, "duplicate").when(F.col("id") % 4 == 0, "copy").when(F.col("id") % 4 == 1, "refile").when(F.col("id") % 4 == 2, "metadata").otherwise("rename")
    return s.select("id", "size", "needs_review", a.alias("action"), ((F.col("id") % 9 != 0) & (F.col("dup_of") == 0)).alias("include"))


@query("plan_totals", using=("shelf",), oracle=f"""
WITH {PLAN} SELECT count(*) AS items, sum(size)::bigint AS bytes, round(sum(CASE WHEN action='copy' THEN size/150e6 ELSE 0 END + 0.04),3) AS seconds,
 count(*) FILTER (needs_review) AS review FROM plan WHERE action<>'duplicate' AND include""")
def plan_totals(spark, sf):
    return organize.plan_totals(simple_plan(spark, sf))


@query("plan_action_counts", using=("shelf",), oracle=f"""
WITH {PLAN} SELECT count(*) FILTER (action IN ('copy','move','rename')) AS place, count(*) FILTER (action='refile') AS refile, count(*) FILTER (action='metadata') AS metadata,
 count(*) FILTER (action='duplicate') AS duplicate, count(*) FILTER (needs_review AND action<>'duplicate') AS review FROM plan""")
def plan_action_counts(spark, sf):
    return organize.plan_action_counts(simple_plan(spark, sf))


@query("log_sum_exp", using=("cosines",), oracle="""
WITH l AS (SELECT vec_id, category, 100*cos AS l, max(100*cos) OVER (PARTITION BY vec_id) AS m FROM cosines),
c AS (SELECT vec_id, category, any_value(m) AS m, sum(exp(l-m)) AS s FROM l GROUP BY 1, 2)
SELECT vec_id AS id, round(any_value(m)+ln(sum(s)),6) AS lse, round(max(m+ln(s)) FILTER (category='cat_0'),6) AS lse_0,
 round(max(m+ln(s)) FILTER (category='cat_1'),6) AS lse_1, round(max(m+ln(s)) FILTER (category='cat_2'),6) AS lse_2 FROM c GROUP BY 1""")
def log_sum_exp(spark, sf):
    v = tags.Vocabulary.load(label_vocabulary(spark, sf))
    e = tags.log_sum_exp(tags.score_vocab(read(spark, sf, "embeddings"), "embedding", v), v)
    at = {n: i for i, n in enumerate(v.names)}
    return e.select(F.col("vec_id").alias("id"), F.round("lse", 6).alias("lse"), *[F.round(F.get("cat_lse", F.lit(at[f"cat_{k}"])), 6).alias(f"lse_{k}") for k in range(3)])


@query("prompt_ensemble", using=("vocab",), oracle="SELECT tag, category, d, round(x,6) AS x FROM (SELECT tag, category, unnest(v) AS x, unnest(range(64)) AS d FROM vocab)")
def prompt_ensemble(spark, sf):
    return label_vocabulary(spark, sf).select("tag", "category", F.posexplode("vec").alias("d", "x")).select("tag", "category", F.col("d").cast("bigint").alias("d"), F.round("x", 6).alias("x"))


@query("known_tags", using=("tagrows", "vocab"), oracle="""
SELECT DISTINCT tag FROM (SELECT word1 AS tag FROM tagrows UNION ALL SELECT word2 FROM tagrows UNION ALL SELECT lower(added) FROM tagrows WHERE added IS NOT NULL UNION ALL SELECT tag FROM vocab)""")
def known_tags(spark, sf):
    used = view(spark, sf, "tagrows").select(F.filter(F.array("word1", "word2", "added"), lambda t: t.isNotNull()).alias("tags"))
    return cat.known_tags(used, label_vocabulary(spark, sf))


STOP = "['" + "','".join(generation.pr.STOP_WORDS) + "']"
# the same cleaning, spelled for DuckDB
CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '<[^>]*>',' ','g'),'\bembedding:\S+',' ','g'),'\bBREAK\b',',','g'),':\s*-?[0-9.]+\s*\)',')','g'),'[()\[\]{}]','','g'),'[ \t]+',' ','g'),'\s*\n\s*',chr(10),'g'),
 '(\s*,\s*)+',', ','g'),'^[\s, ]+|[\s, ]+$','','g')"""


@query("word_frequency", oracle=f"""
WITH w AS (SELECT doc_id AS id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM (SELECT doc_id, list_filter(regexp_extract_all(
 translate({CLEAN},'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[a-z]+'), lambda x: length(x)>=4 AND NOT list_contains({STOP}, x)) AS ws FROM documents)),
g AS (SELECT id, word, count(*) AS n, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(p)) AS rank FROM w GROUP BY id, word)
SELECT id, word, n, rank FROM g WHERE rank<=10""")
def word_frequency(spark, sf):
    return generation.word_frequency(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "text")


@query("trash_groups", using=("shelf",), oracle="""
SELECT dense_rank() OVER (ORDER BY k.id) AS "group", k.id AS keeper, m.id, m.size, 0.05::double AS seconds FROM shelf m JOIN shelf k ON m.dup_of=k.id WHERE m.dup_of>0""")
def trash_groups(spark, sf):
    return dedupe.trash_groups(view(spark, sf, "shelf"))


