"""Queries: organize planning, validation, journal and undo."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import organize
from ..sources.views import read, view
from .registry import query

HUMAN = """CASE WHEN size<1024 THEN size||' B' WHEN size<10240 THEN printf('%.1f KB', size/1024.0) WHEN size<1048576 THEN printf('%.0f KB', size/1024.0)
 WHEN size<10485760 THEN printf('%.1f MB', size/1048576.0) WHEN size<1073741824 THEN printf('%.0f MB', size/1048576.0) ELSE printf('%.1f GB', size/1073741824.0) END"""
FOLDER = "CASE WHEN dk='00000000' THEN 'undated' ELSE substr(dk,1,4)||'/'||substr(dk,1,4)||'-'||substr(dk,5,2) END"
# files and sidecars that nobody catalogued: the serials after the next one of every third day and library
LISTED = f"""listed AS (SELECT DISTINCT lib, dk, lib||'/'||{FOLDER}||'/'||dk||'_'||lpad((nxt+k)::varchar,5,'0')||CASE WHEN k=1 THEN '.jpg' ELSE '.jpg.xmp' END AS path, (nxt+k)::bigint AS sn
  FROM (SELECT k.lib, k.dk, coalesce(l.nxt,1) AS nxt FROM (SELECT DISTINCT lib, dk FROM keep WHERE action<>'metadata') k LEFT JOIN lasts l ON l.day_key=k.dk AND l.lib=k.lib), (VALUES (1),(2)) v(k) WHERE dk::bigint%3=0)"""
PLANNED = rf"""base AS (SELECT *, CASE WHEN id%3=1 THEN '/alt' ELSE '/lib' END AS root2, CASE WHEN id%3=1 THEN '/out2' ELSE '/out' END AS lib, CASE WHEN date_value IS NULL THEN '00000000' WHEN date_prec='year' THEN replace(substr(date_value,1,4),'-','')||'0000' WHEN date_prec='month' THEN replace(substr(date_value,1,7),'-','')||'00'
  ELSE replace(substr(date_value,1,10),'-','') END AS dk, id%41=0 AS out FROM shelf WHERE resolved),
act AS (SELECT *, CASE WHEN dest_path IS NOT NULL AND day_key<>dk THEN 'refile' WHEN dest_path IS NULL THEN 'copy' WHEN (vision_status='done' OR clip_model IS NOT NULL) AND meta_state IS DISTINCT FROM 'full' THEN 'metadata' END AS action FROM base WHERE dup_of=0),
keep AS (SELECT *, action='metadata' AND NOT out AND id%2=0 AND id%4=0 AS choice FROM act WHERE action IS NOT NULL AND NOT (action='metadata' AND NOT out AND id%2=0 AND id%4<>0)),
lasts AS (SELECT '/out' AS lib, day_key, max(sn)+1 AS nxt FROM shelf WHERE dest_path LIKE '/out/%' GROUP BY 2),
{LISTED},
ranked AS (SELECT k.*, coalesce(nxt,1) AS nxt, row_number() OVER (PARTITION BY k.lib, dk ORDER BY date_value NULLS LAST, src_path, id) AS rk FROM keep k LEFT JOIN lasts ON lasts.day_key=k.dk AND lasts.lib=k.lib WHERE NOT out AND action<>'metadata'),
free AS (SELECT lib, dk, sn, row_number() OVER (PARTITION BY lib, dk ORDER BY sn) AS rk FROM (SELECT d.lib, d.dk, d.nxt+g.k AS sn FROM (SELECT lib, dk, any_value(nxt) AS nxt, count(*)+3 AS n FROM ranked GROUP BY 1, 2) d, LATERAL (SELECT unnest(range(0, d.n)) AS k) g) x
  WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.lib=x.lib AND l.dk=x.dk AND l.sn=x.sn)),
named AS (SELECT r.*, f.sn AS serial FROM ranked r JOIN free f ON f.lib=r.lib AND f.dk=r.dk AND f.rk=r.rk),
plan AS (SELECT id, action, CASE WHEN action='refile' THEN dest_path END AS old_dest, lib||'/'||{FOLDER}||'/'||dk||'_'||
   CASE WHEN length(serial::varchar)>=5 THEN serial::varchar ELSE lpad(serial::varchar,5,'0') END||'.jpg' AS dest, serial::bigint AS sn, true AS include, CASE WHEN needs_review THEN 'date needs review' END AS note FROM named
 UNION ALL SELECT id, action, CASE WHEN action='refile' THEN dest_path END, CASE WHEN action='metadata' THEN dest_path ELSE '(excluded)' END, NULL, NOT out AND NOT choice,
   nullif(concat_ws('; ', CASE WHEN choice THEN 'description: your choice (keep / append / replace)' WHEN action='metadata' THEN 'tags changed after organizing' END, CASE WHEN needs_review THEN 'date needs review' END),'') FROM keep WHERE out OR action='metadata'
 UNION ALL SELECT id, 'duplicate', NULL, NULL, NULL, false, 'same content as #'||dup_of||', not copied ('||{HUMAN}||')' FROM base WHERE dup_of>0)"""


def plan(spark, sf):
    """Two libraries, names that only a fresh listing knows, and metadata items with nothing new or a pending choice."""
    s = view(spark, sf, "shelf").withColumn("src_root", F.expr("case when id%3=1 then '/alt' else '/lib' end"))
    changes = s.where("id%2=0").select("id", F.lit(0).alias("added"), F.lit(0).alias("removed"), F.expr("case when id%4=0 then 'decide' end").alias("desc_action"))
    changes = changes.unionByName(s.where("id%2=1").select("id", F.lit(1).alias("added"), F.lit(0).alias("removed"), F.lit(None).cast("string").alias("desc_action")))
    day, lib = organize.day_key(), F.expr("case when id%3=1 then '/out2' else '/out' end")
    lasts = s.where("dest_path like '/out/%'").groupBy("day_key").agg((F.max("sn") + 1).alias("nxt"))
    days = s.where("resolved and dup_of = 0").withColumn("dk", day)
    days = days.where("dest_path is null or day_key <> dk").select(lib.alias("lib"), "dk").distinct().where("cast(dk as bigint) % 3 = 0")
    listed = days.join(lasts, (F.col("lib") == "/out") & (F.col("dk") == F.col("day_key")), "left").select("lib", "dk", F.coalesce("nxt", F.lit(1)).alias("nxt"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    folder = F.when(F.col("dk") == "00000000", "undated").otherwise(F.concat(F.left("dk", F.lit(4)), F.lit("/"), F.left("dk", F.lit(4)), F.lit("-"), F.substring("dk", 5, 2)))
    path = F.concat("lib", F.lit("/"), folder, F.lit("/"), "dk", F.lit("_"), F.lpad((F.col("nxt") + F.col("k")).cast("string"), 5, "0"), F.when(F.col("k") == 1, ".jpg").otherwise(".jpg.xmp"))
    return organize.plan_organize(s, file_op="copy", excluded=s.where("id%41=0").select("id"), libraries={"/alt": "/out2"}, listing=listed.select(path.alias("path")), changes=changes)


@query("plan_organize", using=("shelf",), oracle=f"WITH {PLANNED} SELECT id, action, old_dest, dest, sn, include, note FROM plan")
def plan_organize(spark, sf):
    return plan(spark, sf).select("id", "action", "old_dest", "dest", "sn", "include", "note")


@query("plan_rename_in_place", using=("shelf",), oracle=r"""
WITH base AS (SELECT *, CASE WHEN date_value IS NULL THEN '00000000' WHEN date_prec='year' THEN substr(date_value,1,4)||'0000' WHEN date_prec='month' THEN replace(substr(date_value,1,7),'-','')||'00' ELSE replace(substr(date_value,1,10),'-','') END AS dk
 FROM (SELECT * REPLACE (CASE WHEN id%9=4 THEN regexp_extract(src_path,'^(.*)/',1)||'/sub/x.jpg' ELSE dest_path END AS dest_path) FROM shelf) WHERE resolved AND dup_of=0),
n AS (SELECT id, regexp_extract(src_path,'^(.*)/',1) AS dir, dk, row_number() OVER (PARTITION BY regexp_extract(src_path,'^(.*)/',1), dk ORDER BY date_value NULLS LAST, src_path, id) AS sn FROM base WHERE dest_path IS NULL),
u AS (SELECT regexp_extract(src_path,'^(.*)/',1) AS dir, day_key, max(sn) AS top FROM shelf WHERE id%9=4 GROUP BY 1, 2)
SELECT n.id, 'rename' AS action, n.dir||'/IMG_'||n.dk||'_'||lpad((n.sn+coalesce(u.top,0))::varchar,5,'0')||'.jpg' AS dest FROM n LEFT JOIN u ON u.dir=n.dir AND u.day_key=n.dk""")
def plan_rename_in_place(spark, sf):
    s = view(spark, sf, "shelf").withColumn("dest_path", F.when(F.col("id") % 9 == 4, F.concat(F.regexp_extract("src_path", "^(.*)/", 1), F.lit("/sub/x.jpg"))).otherwise(F.col("dest_path")))
    p = organize.plan_organize(s, file_op="rename", prefix=F.lit("IMG"))
    return p.where("action = 'rename'").select("id", "action", "dest")


@query("validate_plan", using=("shelf",), oracle=f"""
WITH {PLANNED}, fresh AS (SELECT src_path AS path, file_size AS size, mtime+CASE WHEN id%29=0 THEN 7 ELSE 0 END AS mtime FROM shelf WHERE id%37<>0 UNION ALL SELECT dest_path, size, mtime FROM shelf WHERE dest_path IS NOT NULL AND id%5<>0
  UNION ALL SELECT '/out/'||substr(day_key,1,4)||'/'||substr(day_key,1,4)||'-'||substr(day_key,5,2)||'/'||day_key||'_00001.jpg', 1, 0 FROM shelf WHERE id%43=0 AND day_key<>'00000000'),
f AS (SELECT path, max(size) AS size, max(mtime) AS mtime FROM fresh GROUP BY 1)
SELECT p.id, CASE WHEN p.action IN ('copy','refile') AND (t.path IS NOT NULL OR p.dest IN (SELECT dest_path FROM shelf WHERE dest_path IS NOT NULL)) THEN 'destination taken' WHEN s.path IS NULL THEN 'source missing'
 WHEN p.action<>'refile' AND (s.size<>shelf.size OR s.mtime<>shelf.mtime) THEN 'source changed' END AS problem
FROM plan p JOIN shelf ON shelf.id=p.id LEFT JOIN f t ON t.path=p.dest LEFT JOIN f s ON s.path=coalesce(p.old_dest, shelf.src_path) WHERE p.include AND p.action<>'duplicate'""")
def validate_plan(spark, sf):
    s = view(spark, sf, "shelf")
    a = s.where("id%37<>0").select("src_path", F.col("file_size").alias("size"), (F.col("mtime") + F.when(F.col("id") % 29 == 0, 7).otherwise(0)).alias("mtime"))
    b = s.where("dest_path is not null and id%5<>0").select(F.col("dest_path").alias("src_path"), "size", "mtime")
    c = s.where("id%43=0 and day_key<>'00000000'").select(F.expr("'/out/'||substr(day_key,1,4)||'/'||substr(day_key,1,4)||'-'||substr(day_key,5,2)||'/'||day_key||'_00001.jpg'").alias("src_path"), F.lit(1).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("mtime"))
    fresh = a.unionByName(b).unionByName(c).groupBy("src_path").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime"))
    return organize.validate_plan(plan(spark, sf), s, fresh).select("id", "problem")


@query("record_run", using=("shelf",), oracle=f"""
WITH {PLANNED} SELECT '2026-01-01' AS run, CASE WHEN p.action='metadata' THEN 'meta' ELSE p.action END AS kind, p.id AS photo_id, coalesce(p.old_dest, s.src_path) AS src, p.dest AS dst, false AS undone FROM plan p JOIN shelf s ON s.id=p.id WHERE p.include AND p.action<>'duplicate'""")
def record_run(spark, sf):
    return organize.record_run(plan(spark, sf), "2026-01-01")


@query("plan_undo", using=("journal_fx",), oracle="""
SELECT j.id, j.kind, j.photo_id, CASE j.kind WHEN 'copy' THEN 'trash' WHEN 'meta' THEN 'restore' ELSE 'move back' END AS undo, j.dst AS from_path, CASE WHEN j.kind IN ('move','rename','refile') THEN j.src END AS to_path,
 j.kind IN ('move','rename','refile') AND j.src IN (SELECT dst FROM journal_fx WHERE id%4=0) AS blocked FROM journal_fx j WHERE NOT undone AND run=(SELECT max(run) FROM journal_fx)""")
def plan_undo(spark, sf):
    j = view(spark, sf, "journal_fx")
    last = j.where(F.col("run") == j.agg(F.max("run")).scalar())
    return organize.plan_undo(last, j.where("id%4=0").select(F.col("dst").alias("path")))


@query("apply_run_results", using=("shelf",), oracle="""
WITH r AS (SELECT id, CASE id%6 WHEN 0 THEN 'moved' WHEN 1 THEN 'placed' WHEN 2 THEN 'refreshed' WHEN 3 THEN 'removed' WHEN 4 THEN 'cleared' END AS o FROM shelf)
SELECT s.id, CASE WHEN o='moved' THEN '/new/'||s.id ELSE src_path END AS src_path, CASE o WHEN 'placed' THEN '/new/'||s.id WHEN 'cleared' THEN NULL ELSE dest_path END AS dest_path, CASE WHEN o='refreshed' THEN file_size ELSE size END AS size,
 CASE WHEN o='cleared' THEN NULL ELSE meta_state END AS meta_state FROM shelf s JOIN r ON r.id=s.id WHERE o IS NULL OR o<>'removed'""")
def apply_run_results(spark, sf):
    s = view(spark, sf, "shelf")
    o = F.expr("case id%6 when 0 then 'moved' when 1 then 'placed' when 2 then 'refreshed' when 3 then 'removed' when 4 then 'cleared' end")
    last = s.where("id%6<5").select("id", F.lit(2).alias("at"), o.alias("outcome"), F.concat(F.lit("/new/"), F.col("id").cast("string")).alias("path"), F.col("file_size").alias("size"))
    early = s.where("id%4=0 and id%6<5").select("id", F.lit(1).alias("at"), F.lit("removed").alias("outcome"), F.lit("/gone").alias("path"), F.col("size"))
    return organize.apply_run_results(s, last.unionByName(early)).select("id", "src_path", "dest_path", "size", "meta_state")


@query("plan_metadata", using=("tagrows",), oracle="""
WITH t AS (SELECT *, id%2=0 AS trusted, CASE WHEN id%6=0 THEN NULL WHEN id%6=1 THEN '2020-05' ELSE '2020-05-06 07:08:09' END AS d FROM tagrows),
k AS (SELECT id, key, value FROM (
 SELECT id, 'Exif.Photo.DateTimeOriginal' AS key, replace(d,'-',':') AS value FROM t WHERE d IS NOT NULL AND trusted AND id%6<>1 AND NOT has_date
 UNION ALL SELECT id, 'Xmp.photoshop.DateCreated', d FROM t WHERE d IS NOT NULL AND trusted
 UNION ALL SELECT id, 'Xmp.iptc.Location', kind FROM t WHERE NOT has_place
 UNION ALL SELECT id, 'Xmp.dc.description', word1||' '||word2 FROM t WHERE NOT has_desc
 UNION ALL SELECT id, 'Xmp.catalog.ResolvedDate', d FROM t WHERE d IS NOT NULL
 UNION ALL SELECT id, 'Xmp.dc.subject', word2 FROM t
 UNION ALL SELECT id, 'Xmp.dc.subject', 'a b' FROM t
 UNION ALL SELECT id, '-Xmp.dc.subject', 'stale' FROM t WHERE has_kw))
SELECT * FROM k""")
def plan_metadata(spark, sf):
    t = view(spark, sf, "tagrows")
    k = lambda c, key: F.when(F.col(c), key)
    date = F.expr("case when id%6=0 then null when id%6=1 then '2020-05' else '2020-05-06 07:08:09' end")
    rows = t.select("id", F.filter(F.array(k("has_date", "Xmp.exif.DateTimeOriginal"), k("has_place", "Xmp.photoshop.City"), k("has_desc", "Xmp.dc.description")), lambda x: x.isNotNull()).alias("keys"),
                    F.array(F.upper("word1"), F.lit("stale")).alias("existing_kw"), F.array("word1", "word2", F.lit("a,b"), F.upper("word2")).alias("wanted_kw"),
                    F.when(F.col("has_kw"), F.array(F.lit("stale"))).otherwise(F.array().cast("array<string>")).alias("ours_kw"), date.alias("date_text"), (F.col("id") % 2 == 0).alias("date_trusted"),
                    (F.col("id") % 6 != 1).alias("date_fine"), F.col("kind").alias("location"), F.concat_ws(" ", "word1", "word2").alias("description"))
    return organize.plan_metadata(rows)


@query("decide_description", oracle=r"""
WITH d AS (SELECT doc_id AS id, text AS body, doc_id%9 AS m, ((doc_id*37)%101)/100.0 AS pj, ((doc_id*53)%101)/100.0 AS pa, CASE (doc_id//9)%3 WHEN 0 THEN 'append' WHEN 1 THEN 'keep' ELSE 'replace' END AS a, (doc_id*7)%101 AS c FROM documents)
SELECT id, CASE m WHEN 0 THEN 'add' WHEN 1 THEN 'replace' WHEN 2 THEN 'keep' WHEN 3 THEN 'update' WHEN 4 THEN NULL WHEN 5 THEN 'decide' WHEN 6 THEN CASE WHEN c>=70 THEN a ELSE 'decide' END
 ELSE CASE WHEN a=CASE WHEN pj>0.5 THEN 'replace' WHEN pa>0.5 THEN 'append' ELSE 'keep' END THEN a ELSE 'decide' END END AS desc_action,
 CASE m WHEN 0 THEN 'rules' WHEN 1 THEN 'rules' WHEN 2 THEN 'same' WHEN 3 THEN 'ours' WHEN 4 THEN NULL WHEN 5 THEN 'you' WHEN 6 THEN CASE WHEN c>=70 THEN 'rating' ELSE 'you' END
 ELSE CASE WHEN a=CASE WHEN pj>0.5 THEN 'replace' WHEN pa>0.5 THEN 'append' ELSE 'keep' END THEN 'rating + arbiter' ELSE 'you' END END AS desc_by FROM d""")
def decide_description(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    m = F.col("id") % 9
    ours = F.when(m == 4, "").otherwise(F.lit("Shows: zebra, quagga."))
    have = (F.when(m == 0, "").when(m == 1, "OLYMPUS DIGITAL CAMERA").when(m == 2, F.concat("body", F.lit(" Shows: zebra, quagga."))).when(m == 3, F.concat("body", F.lit(" — old text"))).otherwise(F.concat("body", F.lit(" x"))))
    rows = d.select("id", have.alias("have"), ours.alias("ours"), F.when(m == 3, "old text").alias("prev"), F.lit("stem").alias("file_stem"))
    ans = d.where("id%9>5").select("id", F.expr("case (id div 9)%3 when 0 then 'append' when 1 then 'keep' else 'replace' end").alias("action"), ((F.col("id") * 7) % 101).alias("conf"),
                                   F.expr("case when id%9>6 then ((id*37)%101)/100.0D end").alias("p_junk"), F.expr("case when id%9>6 then ((id*53)%101)/100.0D end").alias("p_adds"))
    return organize.decide_description(rows, "agree", ans).select("id", "desc_action", "desc_by")


