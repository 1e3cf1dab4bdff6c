"""Queries: scans, vocabulary files, documents and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.tags import drop_blocked as without_blocked
from ..operators import catalog as cat
from ..operators import dedupe, search
from ..sources import files
from ..sources.views import read, view
from .filters import ASSET_PATH, asset_paths
from .ordering import EFFECTIVE, effective
from .registry import query


@query("scan_filter", using=("assets",), oracle=f"""
SELECT id FROM assets WHERE lower(ext) IN ('jpeg','png','jpg','tif') AND folder<>'backup'""")
def scan_filter(spark, sf):
    return asset_paths(spark, sf).where(files.scannable("src_path", ["/lib/backup"])).select("id")


@query("assign_root", using=("assets",), oracle="SELECT id, CASE WHEN folder LIKE 'DCIM/%' THEN '/lib/DCIM' WHEN folder='backup' THEN '/lib/backup' END AS root FROM assets")
def assign_root(spark, sf):
    return files.assign_root(asset_paths(spark, sf), ["/lib/DCIM/100CANON", "/lib/DCIM", "/lib/backup"]).select("id", "root")


@query("skip_unchanged", using=("assets",), oracle=f"""
WITH scan AS (SELECT id, {ASSET_PATH} AS src_path, size + CASE WHEN id%11=0 THEN 1 ELSE 0 END AS size, mtime FROM assets),
old AS (SELECT {ASSET_PATH} AS src_path, size, mtime + CASE WHEN id%13=0 THEN 60 ELSE 0 END AS mtime FROM assets WHERE id%4<>0)
SELECT id FROM scan s WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.src_path=s.src_path AND o.size=s.size AND o.mtime=s.mtime)""")
def skip_unchanged(spark, sf):
    a = asset_paths(spark, sf)
    scan = a.withColumn("size", F.col("size") + F.when(F.col("id") % 11 == 0, 1).otherwise(0))
    old = a.where("id%4<>0").withColumn("mtime", F.col("mtime") + F.when(F.col("id") % 13 == 0, 60).otherwise(0))
    return cat.skip_unchanged(scan, old).select("id")


@query("upsert_scan", using=("shelf",), oracle="""
WITH c AS (SELECT src_path, size, md5(size::varchar) AS quick_hash, CASE WHEN id%4=0 THEN 'g'||id%3 END AS gen_json, CASE WHEN id%4=0 THEN 'old' END AS gen_keywords,
  CASE WHEN id%5=0 THEN '[["x",1.0]]' ELSE '[["x",0.5]]' END AS name_keywords, resolved, md5(src_path) AS content_hash, vision_status FROM shelf WHERE id%10<>7),
s AS (SELECT src_path, file_size AS size, md5(file_size::varchar) AS quick_hash, CASE WHEN id%4=0 THEN 'g'||id%6 END AS gen_json, CASE WHEN id%8=0 THEN 'new' ELSE '' END AS gen_keywords,
  '[["y",0.5]]' AS name_keywords FROM shelf WHERE id%3<>1)
SELECT coalesce(c.src_path,s.src_path) AS src_path, CASE WHEN s.src_path IS NOT NULL THEN s.size ELSE c.size END AS size,
 CASE WHEN s.src_path IS NULL THEN c.gen_keywords WHEN c.src_path IS NOT NULL AND coalesce(c.gen_json,'')=coalesce(s.gen_json,'') AND s.gen_keywords='' THEN c.gen_keywords ELSE s.gen_keywords END AS gen_keywords,
 CASE WHEN s.src_path IS NULL OR coalesce(c.name_keywords LIKE '%1.0]%',false) THEN c.name_keywords ELSE s.name_keywords END AS name_keywords,
 CASE WHEN s.src_path IS NULL THEN c.resolved ELSE false END AS resolved, CASE WHEN s.src_path IS NULL THEN c.content_hash END AS content_hash,
 CASE WHEN s.src_path IS NULL OR (c.quick_hash=s.quick_hash AND c.size=s.size) THEN c.vision_status END AS vision_status
FROM c FULL OUTER JOIN s ON c.src_path=s.src_path""")
def upsert_scan(spark, sf):
    s = view(spark, sf, "shelf")
    g = lambda m: F.when(F.col("id") % 4 == 0, F.concat(F.lit("g"), (F.col("id") % m).cast("string")))
    old = s.where("id%10<>7").select("src_path", "size", "mtime", F.md5(F.col("size").cast("string")).alias("quick_hash"), g(3).alias("gen_json"),
                                     F.when(F.col("id") % 4 == 0, "old").alias("gen_keywords"), F.when(F.col("id") % 5 == 0, '[["x",1.0]]').otherwise('[["x",0.5]]').alias("name_keywords"),
                                     "resolved", F.md5("src_path").alias("content_hash"), "vision_status")
    new = s.where("id%3<>1").select("src_path", F.col("file_size").alias("size"), "mtime", F.md5(F.col("file_size").cast("string")).alias("quick_hash"), g(6).alias("gen_json"),
                                    F.when(F.col("id") % 8 == 0, "new").otherwise("").alias("gen_keywords"), F.lit('[["y",0.5]]').alias("name_keywords"))
    return cat.upsert_scan(old, new).select("src_path", "size", "gen_keywords", "name_keywords", "resolved", "content_hash", "vision_status")


def page_lines(spark, sf):
    """"key type value" lines of every page: its tags with their attributes, and its address."""
    p = read(spark, sf, "pages")
    tags = F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)[ >]"), F.lit(1))
    lines = F.concat(F.array(F.concat(F.lit("Xmp.page.url XmpBag "), F.regexp_replace("url", "[?&#/]", ",")), F.concat(F.lit("Exif.Blob Undefined "), F.translate("html", "\n", " ")),
                             F.lit("malformed")), F.transform(tags, lambda t, i: F.concat(F.lit("Xmp.tag."), t, F.lit("   XmpText  n"), i.cast("string"))))
    return p.select(F.col("page_id").alias("id"), F.posexplode(lines).alias("pos", "line"))


@query("meta_lines_to_map", oracle="""
WITH t AS (SELECT page_id AS id, unnest(ts) AS tag, unnest(range(len(ts))) AS i FROM (SELECT page_id, regexp_extract_all(html,'<([a-z][a-z0-9]*)[ >]',1) AS ts FROM pages))
SELECT id, 'Xmp.tag.'||tag AS key, 'XmpText' AS type, string_agg('n'||i, '|' ORDER BY i) AS vals FROM t GROUP BY 1, 2
UNION ALL SELECT page_id, 'Xmp.page.url', 'XmpBag', regexp_replace(url,'[?&#/]',',','g') FROM pages
UNION ALL SELECT page_id, 'Exif.Blob', 'Undefined', translate(html,chr(10),' ') FROM pages WHERE strlen(html)<=200""")
def meta_lines_to_map(spark, sf):
    m = cat.meta_lines_to_map(page_lines(spark, sf))
    return m.select("id", F.explode("meta").alias("key", "e")).select("id", "key", F.col("e.t").alias("type"), F.array_join("e.v", "|").alias("vals"))


@query("meta_list", oracle="""
SELECT page_id AS id, array_to_string(list_filter(list_transform(string_split(regexp_replace(url,'[?&#/]',',','g'),','), lambda x: trim(x)), lambda x: x<>''),'|') AS items FROM pages""")
def meta_list(spark, sf):
    e = F.struct(F.lit("XmpBag").alias("t"), F.array(F.regexp_replace("url", "[?&#/]", ",")).alias("v"))
    return read(spark, sf, "pages").select(F.col("page_id").alias("id"), F.array_join(cat.meta_list(e), "|").alias("items"))


def vocabulary_text(spark, sf):
    """A vocabulary file as lines: every part opens a category heading now and then and lists its words."""
    t = view(spark, sf, "tagrows")
    head = F.when(F.col("id") % 50 == 0, F.concat(F.lit("# "), "kind")).when(F.col("id") % 50 == 25, "# style").when(F.col("id") % 77 == 0, "# vocabulary-version: 2")
    line = F.array(head, F.when(F.col("id") % 3 == 0, F.upper("word1")).otherwise(F.concat(F.lit(" "), "word1")), F.concat("word2", F.lit("_"), (F.col("id") % 40).cast("string")))
    return t.select("id", F.posexplode(line).alias("p", "text")).where("text IS NOT NULL").select((F.col("id") * 3 + F.col("p")).alias("pos"), "text")


@query("load_vocab", using=("tagrows",), oracle="""
WITH l AS (SELECT id*3 AS pos, CASE WHEN id%50=0 THEN '# '||kind WHEN id%50=25 THEN '# style' WHEN id%77=0 THEN '# vocabulary-version: 2' END AS text FROM tagrows
 UNION ALL SELECT id*3+1, CASE WHEN id%3=0 THEN upper(word1) ELSE ' '||word1 END FROM tagrows UNION ALL SELECT id*3+2, word2||'_'||id%40 FROM tagrows),
c AS (SELECT pos, trim(text) AS text, last_value(CASE WHEN text LIKE '# %' AND text NOT LIKE '%:%' THEN CASE WHEN text='# style' THEN 'composition' ELSE substr(text,3) END END IGNORE NULLS)
 OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cat FROM l WHERE text IS NOT NULL)
SELECT text AS tag, coalesce(cat,'object') AS category, pos FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY pos) AS rn FROM c WHERE text NOT LIKE '#%') WHERE rn=1""")
def load_vocab(spark, sf):
    return files.vocabulary_lines(vocabulary_text(spark, sf))


@query("merge_vocab", using=("tagrows",), oracle="""
WITH b AS (SELECT word1 AS tag, min(id) AS pos FROM tagrows GROUP BY 1), m AS (SELECT upper(word1) AS tag, min(id) AS pos FROM tagrows GROUP BY 1 UNION ALL SELECT word2, min(id) FROM tagrows GROUP BY 1)
SELECT tag, pos, 0 AS own FROM b UNION ALL SELECT tag, pos, 1 FROM m WHERE lower(tag) NOT IN (SELECT tag FROM b) AND lower(tag) NOT IN ('anvil','rod')""")
def merge_vocab(spark, sf):
    t = view(spark, sf, "tagrows")
    b = t.groupBy(F.col("word1").alias("tag")).agg(F.min("id").alias("pos"))
    m = t.groupBy(F.upper("word1").alias("tag")).agg(F.min("id").alias("pos")).unionByName(t.groupBy(F.col("word2").alias("tag")).agg(F.min("id").alias("pos")))
    return files.merge_vocab(m, b, ["anvil", "rod"])


@query("drop_blocked", using=("tagrows",), oracle="""
SELECT id, array_to_string(list_filter([word1, upper(word2), kind], lambda t: lower(t) NOT IN ('red','anvil','promo')),'|') AS tags FROM tagrows""")
def drop_blocked(spark, sf):
    t = view(spark, sf, "tagrows")
    return t.select("id", F.array_join(without_blocked(F.array("word1", F.upper("word2"), "kind"), [" RED ", "anvil", "promo"]), "|").alias("tags"))


@query("dupe_report_csv", using=("shelf",), oracle="""
WITH g AS (SELECT k.id AS keeper, row_number() OVER (ORDER BY k.size*count(*) DESC, k.id) AS grp FROM shelf m JOIN shelf k ON m.dup_of=k.id WHERE m.dup_of>0 GROUP BY k.id, k.size)
SELECT grp AS "group", 'duplicate' AS role, id, size, (600+id%1000)::bigint AS width, (400+id%900)::bigint AS height, coalesce(date_value,'') AS date, src_path AS path FROM shelf JOIN g ON dup_of=keeper WHERE dup_of>0
UNION ALL SELECT grp, 'keep', id, size, 600+id%1000, 400+id%900, coalesce(date_value,''), src_path FROM shelf JOIN g ON id=keeper""")
def dupe_report_csv(spark, sf):
    s = view(spark, sf, "shelf")
    return dedupe.dupe_report(s.withColumn("width", 600 + F.col("id") % 1000).withColumn("height", 400 + F.col("id") % 900))


@query("build_docs", using=("docs",), oracle="""
SELECT id, lower(src_path)||CASE WHEN dest_path IS NULL THEN '' ELSE chr(10)||lower(dest_path) END AS name,
 md5(body||CASE WHEN lang='' OR contains(body,lang) THEN '' ELSE ' | '||lang END||CASE WHEN contains(body||' | '||lang, name) THEN '' ELSE ' | '||name END) AS descr FROM docs WHERE n_chars%9<>0""")
def build_docs(spark, sf):
    d = view(spark, sf, "docs").withColumn("dup_of", F.when(F.col("n_chars") % 9 == 0, 1).otherwise(0)).withColumn("label", F.col("name"))
    out = search.build_docs(d.withColumn("tags", F.array("lang")), caption="body", parts=F.array("lang", F.lit(""), "lang", "label"))
    return out.select("id", "name", F.md5("desc_raw").alias("descr"))


@query("exif_lines", oracle="""
SELECT page_id AS id, 'a.first = '||regexp_extract(url,'://([^/]*)/',1)||chr(10)||'b.list = x'||chr(10)||'b.list = '||page_id||chr(10) AS lines FROM pages""")
def exif_lines(spark, sf):
    e = lambda *v: F.struct(F.lit("XmpText").alias("t"), F.array(*v).alias("v"))
    m = F.create_map(F.lit("b.list"), e(F.lit("x"), F.col("page_id").cast("string")), F.lit("Xmp.catalog.Note"), e("url"), F.lit("a.first"), e(F.regexp_extract("url", "://([^/]*)/", 1)))
    return read(spark, sf, "pages").select(F.col("page_id").alias("id"), search.exif_lines(m).alias("lines"))


@query("build_search_text", using=("tagrows",), oracle=f"""
WITH {EFFECTIVE} SELECT e.id, lower(array_to_string([t.brand, t.kind, replace(e.tags,'|',', '), regexp_extract(t.src_path,'([^/]*)$',1), t.kind], ' | ')) AS txt FROM eff e JOIN tagrows t ON e.id=t.id""")
def build_search_text(spark, sf):
    t = view(spark, sf, "tagrows").withColumn("eff", F.array_join(F.transform(effective(), lambda x: x["tag"]), ", "))
    return t.select("id", search.search_text("brand", "kind", "eff", tx.basename("src_path"), tx.basename(tx.dirname("src_path"))).alias("txt"))
