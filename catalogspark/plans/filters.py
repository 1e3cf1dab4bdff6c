"""Queries: projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import query as q
from ..functions import text as tx
from ..functions.hashes import informative_hash
from ..operators import catalog as cat
from ..operators import search
from ..operators.ranking import spread
from ..operators.tags import TAG_PANEL
from ..sources.views import hashes, read, view
from .aggregates import TAG_FLAGS, tag_flags
from .registry import query

# a file path with an extension, per asset
ASSET_PATH = "src_root||'/'||folder||'/'||stem||'.'||ext"


def asset_paths(spark, sf):
    return view(spark, sf, "assets").withColumn("src_path", F.concat("src_root", F.lit("/"), "folder", F.lit("/"), "stem", F.lit("."), "ext"))


@query("path_parts", oracle=r"""
SELECT page_id AS id, regexp_extract(url,'([^/]*)$',1) AS base, regexp_extract(url,'^(.*)/[^/]*$',1) AS dir,
 regexp_replace(regexp_extract(url,'([^/]*)$',1),'^(.+)\.[^.]*$','\1') AS stem,
 CASE lower(regexp_extract(regexp_extract(url,'([^/]*)$',1),'^.+\.([^.]*)$',1)) WHEN 'jpeg' THEN 'jpg' WHEN 'jpe' THEN 'jpg' WHEN 'tif' THEN 'tiff'
  ELSE lower(regexp_extract(regexp_extract(url,'([^/]*)$',1),'^.+\.([^.]*)$',1)) END AS ext FROM pages""")
def path_parts(spark, sf):
    return read(spark, sf, "pages").select(F.col("page_id").alias("id"), tx.basename("url").alias("base"), tx.dirname("url").alias("dir"), tx.stem("url").alias("stem"),
                                           tx.norm_ext(tx.ext_lower("url")).alias("ext"))


@query("ancestor_dirs", using=("assets",), oracle=f"""
SELECT id, array_to_string(list_reverse(list_concat(['lib'], string_split(folder,'/'))), '|') AS dirs FROM assets""")
def ancestor_dirs(spark, sf):
    return asset_paths(spark, sf).select("id", F.array_join(tx.ancestor_dirs("src_root", "src_path"), "|").alias("dirs"))


@query("under_folders", using=("assets",), oracle=f"""
SELECT id, {ASSET_PATH} AS src_path FROM assets WHERE folder='backup' OR folder='user_1' OR folder LIKE 'DCIM/%'""")
def under_folders(spark, sf):
    return asset_paths(spark, sf).where(tx.path_under("src_path", ["/lib/backup/", "/lib/user_1", "/lib/DCIM"])).select("id", "src_path")


@query("scoped", using=("assets",), oracle="SELECT id FROM assets WHERE pinned AND folder LIKE 'DCIM/%'")
def scoped(spark, sf):
    return asset_paths(spark, sf).where(F.col("pinned") & tx.path_under("src_path", ["/lib/DCIM"])).select("id")


RANGE = """CASE date_prec WHEN 'year' THEN substr(date_value,1,4)||'-01-01' WHEN 'month' THEN substr(date_value,1,7)||'-01' ELSE substr(date_value,1,10) END AS a,
 CASE date_prec WHEN 'year' THEN substr(date_value,1,4)||'-12-31' WHEN 'month' THEN substr(date_value,1,7)||'-31' ELSE substr(date_value,1,10) END AS b"""


@query("date_overlaps", using=("shelf",), oracle=f"""
SELECT id FROM (SELECT id, {RANGE} FROM shelf WHERE date_value IS NOT NULL) WHERE b>='1996-06-15' AND a<='1996-08-20'""")
def date_overlaps(spark, sf):
    return view(spark, sf, "shelf").where(q.date_overlaps("date_value", "date_prec", "1996-06-15", "1996-08-20")).select("id")


@query("date_filter", using=("shelf",), oracle=f"""
WITH r AS (SELECT id, date_value, {RANGE} FROM shelf)
SELECT id, coalesce(b>='1996-01-01' AND a<='1996-12-31',false) AS y, coalesce(b>='1996-05-01' AND a<='1996-05-31',false) AS m, coalesce(b>='1998-01-01',false) AS after,
 coalesce(a<='1995-12-31',false) AS before, coalesce(b>='1996-03-01' AND a<='1997-12-31',false) AS span, date_value IS NULL AS undated FROM r""")
def date_filter(spark, sf):
    f = lambda spec: q.date_filter("date_value", "date_prec", spec)
    return view(spark, sf, "shelf").select("id", f("1996").alias("y"), f("1996-05").alias("m"), f(">1997").alias("after"), f("<1996").alias("before"),
                                           f("1996-03..1997").alias("span"), f("undated").alias("undated"))


@query("amount_filter", oracle="""
SELECT o_orderkey AS id, o_totalprice>2e5 AS big, o_totalprice BETWEEN 1e5 AND 2e5 AS span, abs(o_totalprice-3e5)<=3e4 AS near, o_totalprice<=5e4 AS small FROM orders""")
def amount_filter(spark, sf):
    f = lambda spec: q.amount_filter("o_totalprice", spec)
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), f(">200k").alias("big"), f("100..200k").alias("span"), f("300k").alias("near"), f("<=0.05m").alias("small"))


@query("is_flag", using=("assets",), oracle="""
SELECT id, pinned AS fav, k%2=0 AS ai, k%3=0 AS untagged, k%5=0 AS uncertain, k%7=0 AS undated, height>width AND width>0 AS portrait,
 width>height AND height>0 AS landscape, width=height AND width>0 AS square FROM assets""")
def is_flag(spark, sf):
    cols = {"favorite": F.col("pinned"), "prompt": F.when(F.col("k") % 2 == 0, "x"), "tags": F.when(F.col("k") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("kind")),
            "needs_review": F.col("k") % 5 == 0, "date_value": F.when(F.col("k") % 7 != 0, F.col("day"))}
    names = ["fav", "ai", "untagged", "uncertain", "undated", "portrait", "landscape", "square"]
    return view(spark, sf, "assets").select("id", *[q.is_flag(n, cols).alias(n) for n in names])


EXIF = r"lower(coalesce(array_to_string(regexp_extract_all(html,'<meta [^>]*>'), chr(10)),''))"


@query("has_flag", oracle=f"""
SELECT page_id AS id, page_id%3=0 AS gps, contains({EXIF},'charset') AS meta_charset, page_id%2=0 OR page_id%3=0 AS place, length(regexp_extract(url,'/(fr|de|es)/',1))>0 AS tags,
 contains({EXIF},'xmp.dc.description') AS descr, contains({EXIF},'keywords') AS keywords, contains({EXIF},'exif.image.model') AS camera FROM pages""")
def has_flag(spark, sf):
    lang = F.regexp_extract("url", "/(fr|de|es)/", 1)
    exif = tx.alower(F.array_join(F.regexp_extract_all("html", F.lit("<meta [^>]*>"), F.lit(0)), "\n"))
    cols = {"has_gps": F.col("page_id") % 3 == 0, "location": F.when(F.col("page_id") % 2 == 0, "x"), "exif": exif, "tags": F.filter(F.array(lang), lambda x: x != "")}
    f = lambda n: q.has_flag(n, cols)
    return read(spark, sf, "pages").select(F.col("page_id").alias("id"), f("gps").alias("gps"), F.contains(exif, F.lit("charset")).alias("meta_charset"), f("place").alias("place"),
                                           f("tags").alias("tags"), f("desc").alias("descr"), f("keywords").alias("keywords"), f("camera").alias("camera"))


@query("dimension_filter", oracle="""
SELECT p_partkey AS id, p_size*100>=3000 AS w, abs(p_size*50-1000)<=100 AS h, p_size*100.0*p_size*50>5e6 AS mp FROM part""")
def dimension_filter(spark, sf):
    w, h = F.col("p_size") * 100, F.col("p_size") * 50
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), q.dimension_filter("width", w, h, ">=3000").alias("w"), q.dimension_filter("h", w, h, "1000").alias("h"),
                                          q.dimension_filter("mp", w, h, ">5").alias("mp"))


@query("ext_filter", using=("assets",), oracle="SELECT id, lower(ext) IN ('jpg','jpeg') AS jpg, lower(ext)='png' AS png, lower(ext) IN ('dng','cr2','cr3','nef','arw','raf','orf','rw2','raw') AS raw FROM assets")
def ext_filter(spark, sf):
    return view(spark, sf, "assets").select("id", *[q.ext_filter("ext", w).alias(n) for n, w in (("jpg", "jpeg"), ("png", "png"), ("raw", "raw"))])


# metadata lines of a page: its host plays the camera, its path the lens
PAGE_EXIF = r"'exif.image.make = '||lower(regexp_extract(url,'://([^/]*)/',1))||chr(10)||'exif.photo.lensmodel = '||lower(regexp_extract(url,'://[^/]*(/.*)$',1))||chr(10)||'xmp.note = '||lower(url)"


def page_exif():
    return F.concat(F.lit("exif.image.make = "), tx.alower(F.regexp_extract("url", "://([^/]*)/", 1)), F.lit("\nexif.photo.lensmodel = "),
                    tx.alower(F.regexp_extract("url", "://[^/]*(/.*)$", 1)), F.lit("\nxmp.note = "), tx.alower("url"))


@query("camera_filter", oracle=r"""
SELECT page_id AS id, contains(lower(regexp_extract(url,'://([^/]*)/',1)),'blog') OR contains(lower(regexp_extract(url,'://[^/]*(/.*)$',1)),'blog') AS blog,
 contains(lower(regexp_extract(url,'://([^/]*)/',1)),'html') OR contains(lower(regexp_extract(url,'://[^/]*(/.*)$',1)),'html') AS html,
 contains(lower(regexp_extract(url,'://([^/]*)/',1)),'https') OR contains(lower(regexp_extract(url,'://[^/]*(/.*)$',1)),'https') AS scheme FROM pages""")
def camera_filter(spark, sf):
    return read(spark, sf, "pages").select(F.col("page_id").alias("id"), q.camera_filter(page_exif(), "blog").alias("blog"), q.camera_filter(page_exif(), "html").alias("html"),
                                           q.camera_filter(page_exif(), "https").alias("scheme"))


@query("generator_filter", using=("docs",), oracle="SELECT id, contains(name,'src1') AS hit FROM docs")
def generator_filter(spark, sf):
    return view(spark, sf, "docs").select("id", q.generator_filter(F.concat(F.translate("body", "\n", " "), F.lit("\nA1111 "), "name"), "src1").alias("hit"))


@query("place_filter", using=("shelf",), oracle="SELECT id, coalesce(contains(lower(location),'paris') OR contains(lower(location),'york'), false) AS hit FROM shelf")
def place_filter(spark, sf):
    return view(spark, sf, "shelf").select("id", q.place_filter("location", ["paris", "york"]).alias("hit"))


@query("tag_filter", using=("docs",), oracle="SELECT id, lang IN ('fr','de') AS hit FROM docs")
def tag_filter(spark, sf):
    return view(spark, sf, "docs").select("id", q.tag_filter(F.array("lang"), ["fr", "de"]).alias("hit"))


LOW = "translate(body,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"


@query("term_weight", using=("docs",), oracle=f"""
SELECT id, round((contains({LOW},'the')::int)*1.5 + (contains(name,'src1')::int)*1.0*0 + (contains(lang,'the')::int)*1.2 + (contains(name,'the')::int)*1.0, 3) AS w_the,
 round((contains({LOW},'src1')::int)*1.5 + (contains(lang,'src1')::int)*1.2 + (contains(name,'src1')::int)*1.0, 3) AS w_src FROM docs""")
def term_weight(spark, sf):
    fields = {"desc": tx.alower("body"), "prompt": F.col("lang"), "name": F.col("name")}
    return view(spark, sf, "docs").select("id", F.round(q.term_weight("the", fields), 3).alias("w_the"), F.round(q.term_weight("src1", fields), 3).alias("w_src"))


@query("regex_search", using=("docs",), oracle=r"""
SELECT id, CASE WHEN regexp_matches(name,'src1[0-3]','i') THEN 'name' ELSE 'desc' END AS field,
 hit, CASE WHEN regexp_matches(name,'src1[0-3]','i') THEN 'name: '||hit ELSE 'desc: '||CASE WHEN s>1 THEN '…' ELSE '' END||trim(translate(substr(body,s,e-s),chr(10),' '))||CASE WHEN e<=length(body) THEN '…' ELSE '' END END AS why
FROM (SELECT *, greatest(pos-24,1) AS s, least(pos+length(hit)+24, length(body)+1) AS e FROM (SELECT *, strpos(body, hit) AS pos FROM (SELECT *,
 CASE WHEN regexp_matches(name,'src1[0-3]','i') THEN regexp_extract(name,'src1[0-3]',0,'i') ELSE regexp_extract(body,'(^|[ .])[a-d]{3}ou[a-z]*|src1[0-3]',0,'i') END AS hit FROM docs))) WHERE regexp_matches(name,'src1[0-3]','i') OR regexp_matches(body,'(^|[ .])[a-d]{3}ou[a-z]*|src1[0-3]','i')""")
def regex_search(spark, sf):
    return search.regex_search(spread(view(spark, sf, "docs")), "(^|[ .])[a-d]{3}ou[a-z]*|src1[0-3]", {"name": "name", "desc": "body"}).select("id", "field", "hit", "why")


@query("browse", using=("shelf",), oracle="""
SELECT id FROM shelf WHERE contains(lower(src_path)||' | '||coalesce(lower(location),''), 'york') AND contains(lower(src_path)||' | '||coalesce(lower(location),''), 'urgent')
 AND needs_review AND date_value LIKE '1996%'""")
def browse(spark, sf):
    s = view(spark, sf, "shelf").withColumn("search_text", search.search_text("src_path", "location"))
    return cat.browse(s, ["York", "urgent"], review_only=True, month="1996").select("id")


@query("tag_panel_filter", using=("tagrows",), oracle=f"""
WITH {TAG_FLAGS} SELECT id, grp FROM (
 SELECT id, unnest(list_filter([CASE WHEN NOT tagged AND NOT user_edited THEN 'untagged' END, CASE WHEN (tagged OR user_edited) AND best<0.25 THEN 'weak' END,
  CASE WHEN stale AND NOT user_edited THEN 'stale' END, CASE WHEN user_edited THEN 'edited' END, CASE WHEN NOT has_date THEN 'no_date' END, CASE WHEN NOT has_kw THEN 'no_keywords' END,
  CASE WHEN NOT has_desc THEN 'no_description' END, CASE WHEN NOT has_place THEN 'no_place' END, CASE WHEN gen_tool IS NOT NULL THEN 'generated' END], lambda x: x IS NOT NULL)) AS grp FROM tagflags)""")
def tag_panel_filter(spark, sf):
    groups = F.filter(F.array(*[F.when(test(), name) for name, test in TAG_PANEL.items()]), lambda x: x.isNotNull())
    return tag_flags(spark, sf).select("id", F.explode(groups).alias("grp"))


# metadata keys derived from what a page's markup and address contain
@query("file_carries", oracle="""
SELECT page_id AS id, contains(html,'<time') OR page_id%2=0 AS date, contains(html,'class="ad"') AS keywords, contains(html,'<h1>') AS description, contains(url,'blog') AS place FROM pages""")
def file_carries(spark, sf):
    k = lambda cond, key: F.when(cond, key)
    keys = F.filter(F.array(k(F.contains("html", F.lit("<time")) | (F.col("page_id") % 2 == 0), "Xmp.photoshop.DateCreated"), k(F.contains("html", F.lit('class="ad"')), "Iptc.Application2.Keywords"),
                            k(F.contains("html", F.lit("<h1>")), "Exif.Image.ImageDescription"), k(F.contains("url", F.lit("blog")), "Xmp.photoshop.City")), lambda x: x.isNotNull())
    return read(spark, sf, "pages").select(F.col("page_id").alias("id"), cat.file_carries(keys).alias("c")).select("id", "c.*")


@query("informative_hash", using=("hashes",), oracle="SELECT id, bit_count(h) BETWEEN 4 AND 60 AS informative FROM hashes")
def informative(spark, sf):
    return hashes(spark, sf).select("id", informative_hash("h").alias("informative"))


@query("fuzzy_word", using=("docs",), oracle=rf"""
WITH w AS (SELECT id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT id, regexp_extract_all({LOW}, '[a-z0-9\x80-\x{{10FFFF}}]+') AS ws FROM docs)),
m AS (SELECT id, min_by(w, levenshtein(w,'thaer')*10000000+i) AS word FROM w WHERE strlen(w)+2>=5 AND abs(length(w)-5)<=2 AND levenshtein(w,'thaer')<=2 GROUP BY id)
SELECT docs.id, word FROM docs LEFT JOIN m ON docs.id=m.id""")
def fuzzy_word(spark, sf):
    return spread(view(spark, sf, "docs")).select("id", q.fuzzy_word(tx.alower("body"), "thaer").alias("word"))
