"""Queries: the scalar expressions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import civil, geo, hashes, naming, placenames, prompts
from ..functions import evidence as ev
from ..functions import tags as tg
from ..functions import text as tx
from ..operators import organize, search
from ..operators.ranking import spread
from ..sources import views
from ..sources.views import read, view
from .aggregates import CLEAN
from .filters import asset_paths
from .registry import query

J = "array_to_string"


@query("make_civil", using=("assets",), oracle="""
WITH f AS (SELECT id, 1795+id%410 AS y, id%14 AS mo, id%33 AS d, id%26 AS h, id%62 AS mi, id%63 AS s, (id%5+1)::int AS p FROM assets),
g AS (SELECT *, make_date(greatest(1800,least(2200,y)), CASE WHEN p>=2 THEN greatest(1,least(12,mo)) ELSE 1 END, 1) AS first, CASE WHEN p>=3 THEN d ELSE 1 END AS dd FROM f)
SELECT id, CASE WHEN y BETWEEN 1800 AND 2200 AND (p<2 OR mo BETWEEN 1 AND 12) AND dd>=1 AND dd<=day(last_day(first)) AND (p<4 OR (h<=23 AND mi<=59)) AND (p<5 OR s<=60)
 THEN (date_diff('day', DATE '1970-01-01', first)+dd-1)*86400 + CASE WHEN p>=4 THEN h*3600+mi*60 ELSE 0 END + CASE WHEN p>=5 THEN least(s,59) ELSE 0 END END::bigint AS secs FROM g""")
def make_civil(spark, sf):
    i = F.col("id")
    c = civil.make_civil(1795 + i % 410, i % 14, i % 33, i % 26, i % 62, i % 63, i % 5 + 1)
    return view(spark, sf, "assets").select("id", c["secs"].alias("secs"))


@query("parse_meta_datetime", oracle="""
WITH t AS (SELECT o_orderkey AS id, o_orderdate + to_seconds((o_orderkey*37)%86400) AS ts, o_orderkey%8 AS m FROM orders)
SELECT id, CASE m WHEN 0 THEN strftime(ts,'%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts,'%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts,'%Y-%m-%d') WHEN 3 THEN strftime(ts,'%Y-%m')
 WHEN 4 THEN strftime(ts,'%Y') WHEN 6 THEN strftime(ts,'%Y-%m-%d %H:%M') END AS shown FROM t""")
def parse_meta_datetime(spark, sf):
    o = read(spark, sf, "orders").selectExpr("o_orderkey as id", "timestampadd(SECOND, (o_orderkey*37)%86400, o_orderdate) as ts", "o_orderkey%8 as m")
    fmt = lambda f: F.date_format("ts", f)
    raw = (F.when(F.col("m") == 0, fmt("yyyy:MM:dd HH:mm:ss")).when(F.col("m") == 1, F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))).when(F.col("m") == 2, fmt("yyyy-MM-dd"))
           .when(F.col("m") == 3, fmt("yyyy-MM")).when(F.col("m") == 4, fmt("yyyy")).when(F.col("m") == 5, "0000:00:00 00:00:00").when(F.col("m") == 6, fmt("yyyy:MM:dd HH:mm"))
           .otherwise(fmt("yyyy:'02':'30' HH:mm:ss")))
    return o.withColumn("c", civil.parse_meta_datetime(raw)).select("id", civil.civil_pretty(F.col("c.secs"), F.col("c.prec")).alias("shown"))


@query("civil_strings", using=("shelf",), oracle="""
WITH t AS (SELECT id, date_value::timestamp AS ts, date_prec AS p FROM shelf WHERE date_value IS NOT NULL)
SELECT id, strftime(ts,'%Y-%m-%d %H:%M:%S') AS str, strftime(ts,'%Y:%m:%d %H:%M:%S') AS exif,
 left(strftime(ts,'%Y-%m-%d %H:%M:%S'), CASE p WHEN 'year' THEN 4 WHEN 'month' THEN 7 WHEN 'day' THEN 10 ELSE 19 END) AS pretty,
 left(strftime(ts,'%Y-%m-%dT%H:%M:%S'), CASE p WHEN 'year' THEN 4 WHEN 'month' THEN 7 WHEN 'day' THEN 10 ELSE 19 END) AS xmp FROM t""")
def civil_strings(spark, sf):
    s = view(spark, sf, "shelf").where("date_value is not null").withColumn("c", civil.parse_stored("date_value", "date_prec"))
    secs, prec = F.col("c.secs"), F.col("c.prec")
    return s.select("id", civil.civil_str(secs).alias("str"), civil.civil_exif(secs).alias("exif"), civil.civil_pretty(secs, prec).alias("pretty"), civil.civil_xmp(secs, prec).alias("xmp"))


@query("name_dates", using=("assets",), oracle="""
WITH t AS (SELECT a.*, e.ts FROM assets a JOIN events e ON a.id=e.event_id)
SELECT id, 'file' AS part, CASE kind WHEN 'purchase' THEN 'name-date' WHEN 'error' THEN 'name-unix' ELSE 'name-datetime' END AS src,
 CASE kind WHEN 'purchase' THEN strftime(ts,'%Y-%m-%d') ELSE strftime(ts,'%Y-%m-%d %H:%M:%S') END AS shown FROM t WHERE kind<>'signup'
UNION ALL SELECT id, 'folder', 'dir-month', '2024-01' FROM t WHERE folder='2024-01 Paris trip'""")
def name_dates(spark, sf):
    a = view(spark, sf, "assets")
    a = ev.with_name_dates(ev.with_name_dates(a, F.array("stem"), False, "n", 1790000000), F.array("folder"), True, "d")
    both = a.select("id", F.explode(F.concat(F.transform("n", lambda c: F.struct(F.lit("file").alias("part"), c.alias("c"))), F.transform("d", lambda c: F.struct(F.lit("folder").alias("part"), c.alias("c"))))).alias("x"))
    return both.select("id", F.col("x.part").alias("part"), ev.source_id(F.col("x.c.src")).alias("src"), civil.civil_pretty(F.col("x.c.secs"), F.col("x.c.prec")).alias("shown"))


@query("gps_decimal", using=("assets",), oracle="""
WITH p AS (SELECT id, (CASE WHEN id%2=1 THEN -1 ELSE 1 END)*(id%95 + (id%60)/60.0 + (id%977)/100.0/3600.0) AS lat, (CASE WHEN id%3=1 THEN -1 ELSE 1 END)*(id%190 + (id%60)/60.0 + 0.5/3600.0*(id%7)) AS lon FROM assets)
SELECT id, round(lat,6) AS lat, round(lon,6) AS lon FROM p WHERE abs(lat)<=90 AND abs(lon)<=180 AND NOT (abs(lat)<1e-6 AND abs(lon)<1e-6)""")
def gps_decimal(spark, sf):
    s = lambda e: F.expr(f"cast({e} as string)")
    lat = F.concat(s("id%95"), F.lit("/1 "), s("id%60"), F.lit("/1 "), s("id%977"), F.lit("/100"))
    lon = F.concat(s("id%190"), F.lit("/1 "), s("id%60"), F.lit("/1 "), s("id%7"), F.lit("/2"))
    g = geo.gps_decimal(lat, F.when(F.expr("id%2=1"), "S").otherwise("N"), lon, F.when(F.expr("id%3=1"), "W").otherwise("E"))
    return view(spark, sf, "assets").select("id", g.alias("g")).where("g is not null").select("id", F.round("g.lat", 6).alias("lat"), F.round("g.lon", 6).alias("lon"))


@query("gps_time", oracle="""
SELECT event_id AS id, CASE WHEN event_id%9<>0 THEN cast(floor(epoch(ts)) as bigint) END AS t, CASE WHEN event_id%4=0 THEN NULL ELSE (CASE WHEN event_id%4=1 THEN -1 ELSE 1 END)*((event_id%13)*3600+(event_id%2)*1800) END AS off FROM events""")
def gps_time(spark, sf):
    e = read(spark, sf, "events")
    part = lambda f: F.concat(F.date_format("ts", f), F.lit("/1"))
    t = geo.gps_time(F.date_format("ts", "yyyy:MM:dd"), F.when(F.expr("event_id%9<>0"), F.concat_ws(" ", part("HH"), part("mm"), part("ss"))).otherwise(part("HH")))
    off = F.concat(F.when(F.expr("event_id%4=1"), "-").otherwise("+"), F.format_string("%02d", F.expr("event_id%13")), F.lit(":"), F.when(F.expr("event_id%2=1"), "30").otherwise("00"))
    return e.select(F.col("event_id").alias("id"), t.alias("t"), geo.utc_offset(F.lit("n/a"), F.when(F.expr("event_id%4=0"), "Z").otherwise(off)).cast("bigint").alias("off"))


# two dates per event: the file time, and a shifted one, in every mix of precisions and sources
PAIRS = """p AS (SELECT id, mtime AS x, mtime + (CASE k%6 WHEN 0 THEN 60 WHEN 1 THEN 3600 WHEN 2 THEN -26000 WHEN 3 THEN 86400 WHEN 4 THEN 86400*20 ELSE -86400*400 END) AS y,
 1+id%5 AS px, 1+(id//5)%5 AS py, (id%14)::int AS sx, ((id//14)%14)::int AS sy FROM assets)"""
AGREE = """CASE WHEN least(px,py)>=4 THEN CASE WHEN abs(x-y)<=120 THEN 1.0 WHEN abs(x-y)<=50520 AND (abs(x-y)%900<=120 OR abs(x-y)%900>=780) THEN 0.7
  WHEN abs(x//86400-y//86400)=0 THEN 0.5 WHEN abs(x//86400-y//86400)=1 THEN 0.3 ELSE 0.0 END
 WHEN least(px,py)=3 THEN CASE abs(x//86400-y//86400) WHEN 0 THEN 0.9 WHEN 1 THEN 0.4 ELSE 0.0 END
 WHEN least(px,py)=2 THEN CASE WHEN strftime(to_timestamp(x) AT TIME ZONE 'UTC','%Y%m')=strftime(to_timestamp(y) AT TIME ZONE 'UTC','%Y%m') THEN 0.7 ELSE 0.0 END
 ELSE CASE WHEN strftime(to_timestamp(x) AT TIME ZONE 'UTC','%Y')=strftime(to_timestamp(y) AT TIME ZONE 'UTC','%Y') THEN 0.5 ELSE 0.0 END END"""


@query("date_agree", using=("assets",), oracle=f"""
WITH {PAIRS}, a AS (SELECT *, {AGREE} AS agree FROM p),
f AS (SELECT *, ['e','e','e','g','e','n','n','n','n','d','d','d','f','f'][sx+1]=['e','e','e','g','e','n','n','n','n','d','d','d','f','f'][sy+1] AS same FROM a)
SELECT id, agree::double AS agree, CASE WHEN same THEN 0.35 ELSE 1.0 END::double AS independence, agree<0.3 AND (sy NOT IN (4,12,13) OR y<x-129600) AS contradicts FROM f""")
def date_agree(spark, sf):
    shift = F.expr("case k%6 when 0 then 60 when 1 then 3600 when 2 then -26000 when 3 then 86400 when 4 then 86400*20 else -86400*400 end")
    a = view(spark, sf, "assets")
    c = lambda secs, prec, src: F.struct(src.cast("int").alias("src"), secs.alias("secs"), prec.cast("int").alias("prec"), F.lit(1.0).alias("base"), F.lit(1.0).alias("weight"),
                                         F.lit("").alias("raw"), F.lit("").alias("note"))
    a = a.withColumn("a", c(F.col("mtime"), F.expr("1+id%5"), F.expr("id%14"))).withColumn("b", c(F.col("mtime") + shift, F.expr("1+(id div 5)%5"), F.expr("(id div 14)%14")))
    a = a.withColumn("a", ev.with_facts(F.col("a"))).withColumn("b", ev.with_facts(F.col("b")))
    x, y = F.col("a"), F.col("b")
    return a.select("id", ev.agree(x, y).alias("agree"), ev.independence(x, y).alias("independence"), ev.contradicts(x, y).alias("contradicts"))


@query("name_prefix", using=("assets", "tagrows"), oracle="""
SELECT 'a'||id AS id, CASE kind WHEN 'view' THEN 'Screenshot' WHEN 'error' THEN 'mmexport' ELSE 'IMG' END AS prefix FROM assets
UNION ALL SELECT 't'||id, CASE WHEN id<10 THEN word1||' '||word2||' '||id ELSE word1||' '||word2 END FROM tagrows""")
def name_prefix(spark, sf):
    a = view(spark, sf, "assets").select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("id"), "stem")
    t = view(spark, sf, "tagrows").select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("id"), F.concat(tx.stem("src_path"), F.lit(" (3)")).alias("stem"))
    return a.unionByName(t).select("id", naming.name_prefix("stem").alias("prefix"))


@query("serial_name", using=("shelf",), oracle=r"""
SELECT id, regexp_extract(dest_path,'(\d{8})_(\d+)\.jpg$',1) AS day_key, regexp_extract(dest_path,'(\d{8})_(\d+)\.jpg$',2)::bigint AS sn FROM shelf WHERE dest_path IS NOT NULL""")
def serial_name(spark, sf):
    s = view(spark, sf, "shelf").where("dest_path is not null")
    return s.select("id", naming.serial_name(tx.stem("dest_path")).alias("s")).select("id", "s.day_key", "s.sn")


FILLER = "['" + "','".join(naming.FILLER_WORDS) + "']"


@query("name_words", using=("tagrows",), oracle=f"""
WITH w AS (SELECT id, list_filter(['beautiful', word1, 'over', word2, 'lake', 'of', lower(split_part(brand,'#',1))], lambda x: NOT list_contains({FILLER}, x)) AS ws FROM tagrows)
SELECT id, {J}(ws,'|') AS words, true AS long, {J}(ws,'-')='' AS none FROM w""")
def name_words(spark, sf):
    stem = F.concat(F.lit("a_beautiful_"), "word1", F.lit("_over_the_"), "word2", F.lit("_lake-of+"), F.translate("brand", "#", "_"), F.lit("_4k_8213"))
    t = spread(view(spark, sf, "tagrows").withColumn("stem", stem).select("id", "stem"))
    return t.select("id", F.array_join(naming.name_words("stem"), "|").alias("words"), naming.long_name(naming.name_prefix("stem")).alias("long"),
                    (naming.short_prefix("stem", naming.name_words("stem")) == "").alias("none"))


@query("looks_like_copy", oracle=r"""
SELECT page_id AS id, regexp_matches(regexp_replace(regexp_extract(url,'([^/]*)$',1),'^(.+)\.[^.]*$','\1'),'(\(\d+\)|[ _-]copy( \d+)?|副本.*)$','i')
 OR regexp_matches(regexp_extract(url,'^(.*)/[^/]*$',1),'(^|/)(backups?|copy|copies|duplicates?|old|备份|副本)(/|$)','i') AS copy FROM (
 SELECT page_id, CASE page_id%5 WHEN 0 THEN replace(url,'/en/','/backup/') WHEN 1 THEN url||' copy 2.jpg' WHEN 2 THEN url||' (1)' ELSE url END AS url FROM pages)""")
def looks_like_copy(spark, sf):
    p = read(spark, sf, "pages")
    m = F.col("page_id") % 5
    url = F.when(m == 0, F.replace("url", F.lit("/en/"), F.lit("/backup/"))).when(m == 1, F.concat("url", F.lit(" copy 2.jpg"))).when(m == 2, F.concat("url", F.lit(" (1)"))).otherwise(F.col("url"))
    return p.withColumn("url", url).select(F.col("page_id").alias("id"), tx.looks_like_copy("url").alias("copy"))


@query("dhash72", oracle="""
SELECT vec_id AS id, list_reduce(list_prepend(0::bigint, list_transform(range(64), lambda i: CASE WHEN c[(i//8)*9+i%8+1] > c[(i//8)*9+i%8+2]
 THEN CASE WHEN i=0 THEN (-9223372036854775808)::bigint ELSE 1::bigint << (63-i)::int END ELSE 0::bigint END)), lambda a, b: a | b) AS h
FROM (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS c FROM embeddings)""")
def dhash72(spark, sf):
    e = read(spark, sf, "embeddings").withColumn("cells", F.concat("embedding", F.slice("embedding", 1, 8)))
    return e.select(F.col("vec_id").alias("id"), hashes.dhash72("cells").alias("h"))


@query("hamming_aspect", using=("hashes",), oracle="""
SELECT b.id, bit_count(xor(a.h,b.h))::int AS dist, abs(a.w/a.ht-b.w/b.ht)/greatest(a.w/a.ht,b.w/b.ht)<0.06 OR abs(a.w/a.ht-b.ht/b.w)/greatest(a.w/a.ht,b.ht/b.w)<0.06 AS fits
FROM hashes a JOIN hashes b ON a.id=b.id%100000 WHERE a.id<100000 AND b.id>=100000""")
def hamming_aspect(spark, sf):
    h = views.hashes(spark, sf)
    a, b = h.where("id < 100000").alias("a"), h.where("id >= 100000").alias("b")
    j = a.join(b, F.col("a.id") == F.col("b.id") % 100000)
    return j.select(F.col("b.id"), hashes.hamming64("a.h", "b.h").alias("dist"), hashes.aspect_ok("a.w", "a.ht", "b.w", "b.ht").alias("fits"))


SEP = r"[_\-/\\,;()\[\]{}+&#@!~=|.、，（）【】·]"
PHRASES = rf"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(url,'{placenames.DATE_RUN}','|','g'),'{SEP}','|','g'),'|'), lambda p: regexp_replace(trim(p),' {{2,}}',' ','g')), lambda p: p<>'')"""


@query("phrases", oracle=f"SELECT page_id AS id, {J}({PHRASES},'|') AS phrases FROM pages")
def phrases(spark, sf):
    return read(spark, sf, "pages").select(F.col("page_id").alias("id"), F.array_join(placenames.phrases("url"), "|").alias("phrases"))


STOPS = "['" + "','".join(placenames.STOP_PHRASES) + "']"


@query("strip_trip_words", oracle=f"""
WITH p AS (SELECT page_id AS id, i, CASE i%4 WHEN 0 THEN ph||' trip' WHEN 1 THEN 'Trip to '||ph WHEN 2 THEN ph||' road trip' ELSE ph END AS ph, ph AS bare FROM (
 SELECT page_id, unnest(ps) AS ph, unnest(range(len(ps))) AS i FROM (SELECT page_id, {PHRASES} AS ps FROM pages)))
SELECT id, i, bare AS text, i%4<3 AS cue,
 NOT list_contains({STOPS}, lower(bare)) AND NOT regexp_matches(lower(bare),'{placenames.CAMERA_TOKEN}') AND length(bare) BETWEEN 3 AND 40
 AND strlen(regexp_replace(bare,'[^A-Za-z\\x80-\\x{{10FFFF}}]','','g'))>=3 AS usable FROM p""")
def strip_trip_words(spark, sf):
    p = read(spark, sf, "pages").select(F.col("page_id").alias("id"), F.posexplode(placenames.phrases("url")).alias("i", "ph"))
    m = F.col("i") % 4
    ph = F.when(m == 0, F.concat("ph", F.lit(" trip"))).when(m == 1, F.concat(F.lit("Trip to "), "ph")).when(m == 2, F.concat("ph", F.lit(" road trip"))).otherwise(F.col("ph"))
    s = p.withColumn("s", placenames.strip_trip_words(ph))
    return s.select("id", F.col("i").cast("bigint").alias("i"), F.col("s.text").alias("text"), F.col("s.cue").alias("cue"), placenames.usable_phrase(F.col("s.text")).alias("usable"))


@query("clean_prompt", oracle=f"""
SELECT conv_id, turn, {CLEAN.replace('(text,', '(t,')} AS cleaned FROM (SELECT conv_id, turn, '(('||text||':1.2)), <lora:x:0.5> embedding:bad BREAK [x] ,, '||role AS t FROM conversations)""")
def clean_prompt(spark, sf):
    c = read(spark, sf, "conversations")
    return c.select("conv_id", "turn", prompts.clean_prompt(F.concat(F.lit("(("), "text", F.lit(":1.2)), <lora:x:0.5> embedding:bad BREAK [x] ,, "), "role")).alias("cleaned"))


BOIL = "['" + "','".join(prompts.BOILERPLATE) + "']"


@query("prompt_keywords", oracle=rf"""
WITH t AS (SELECT conv_id, turn, CASE WHEN turn%2=0 THEN 'masterpiece, Score 9, '||array_to_string(string_split(text,' '),', ') ELSE text END AS text FROM conversations),
s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace({CLEAN},'[，、；;\n]',',','g'),','), lambda p: translate(trim(replace(p,'_',' ')),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')), lambda x: x<>'') AS segs FROM t),
g AS (SELECT *, list_filter(segs, lambda x: length(regexp_replace(x,'[^ ]','','g'))<=3) AS short FROM s),
k AS (SELECT conv_id, turn, CASE WHEN len(segs)>=3 AND len(short)*10>=len(segs)*8 THEN list_filter(short, lambda x: NOT list_contains({BOIL},x) AND strlen(x)<=40 AND NOT starts_with(x,'score ') AND NOT starts_with(x,'rating:')) ELSE [] END AS ks FROM g)
SELECT conv_id, turn, array_to_string(list_filter(ks, lambda x, i: list_position(ks,x)=i)[1:20],'|') AS keywords FROM k""")
def prompt_keywords(spark, sf):
    c = read(spark, sf, "conversations")
    tagged = F.concat(F.lit("masterpiece, Score 9, "), F.array_join(F.split("text", " "), ", "))
    return c.select("conv_id", "turn", F.array_join(prompts.prompt_keywords(F.when(F.col("turn") % 2 == 0, tagged).otherwise(F.col("text"))), "|").alias("keywords"))


@query("placeholder_text", using=("tagrows",), oracle="""
SELECT id, id%6 IN (0,1,2,3) AS junk FROM tagrows""")
def placeholder_text(spark, sf):
    m = F.col("id") % 6
    t = (F.when(m == 0, "OLYMPUS DIGITAL CAMERA").when(m == 1, F.concat(F.lit("IMG_"), F.col("id").cast("string"))).when(m == 2, F.concat(F.lit(" "), F.upper("word1"), F.lit(" ")))
         .when(m == 3, "--").when(m == 4, F.concat("word1", F.lit(" at the lake house"))).otherwise(F.concat("word1", F.lit(" "), "word2")))
    return view(spark, sf, "tagrows").select("id", tx.placeholder_text(t, F.col("word1")).alias("junk"))


@query("text_covers", oracle=r"""
WITH b AS (SELECT item_id, list_filter(regexp_extract_all(lower(text),'[a-z0-9\x80-\x{10FFFF}]+'), lambda w: strlen(w)>1 AND NOT list_contains(['shows','a','an','the','of','and','with','in','on','at','photo'], w)) AS ws, lower(text) AS o FROM benchmark),
n AS (SELECT count(*) AS n FROM benchmark)
SELECT doc_id AS id, contains(lower(d.text), o) OR (len(ws)>0 AND len(list_filter(ws, lambda w: contains(lower(d.text), w)))=len(ws)) AS covers FROM documents d, n JOIN b ON b.item_id = d.doc_id % n.n""")
def text_covers(spark, sf):
    b = read(spark, sf, "benchmark")
    n = b.count()
    j = read(spark, sf, "documents").join(b.select("item_id", F.col("text").alias("ours")), F.col("doc_id") % n == F.col("item_id"))
    return j.select(F.col("doc_id").alias("id"), tx.text_covers("text", "ours").alias("covers"))


@query("our_description", using=("docs",), oracle="""
WITH t AS (SELECT id, translate(body, chr(10), ' ') AS p, strlen(body) AS n, name, lang FROM docs),
c AS (SELECT *, CASE WHEN n<=1500 THEN p ELSE left(p, list_max(list_filter(range(370,1501), lambda k: strlen(left(p,k::int))<=1500))::int)||'…' END AS cut FROM t)
SELECT id, md5(cut||CASE WHEN id%3=0 THEN '' ELSE ' — '||name END||' — Shows: '||lang||', '||name||'.') AS d FROM c""")
def our_description(spark, sf):
    d = view(spark, sf, "docs")
    return d.select("id", F.md5(organize.our_description("body", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("name")), F.array("lang", F.lit("Photo"), "name"))).alias("d"))


@query("excerpt", using=("docs",), oracle=r"""
WITH p AS (SELECT id, body, instr(translate(body,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'ther') AS pos FROM docs),
q AS (SELECT id, body, greatest(pos-24,1) AS a, least(pos+28, length(body)+1) AS b FROM p WHERE pos>0)
SELECT id, CASE WHEN a>1 THEN '…' ELSE '' END||trim(translate(substr(body,a,b-a),chr(10),' '))||CASE WHEN b<=length(body) THEN '…' ELSE '' END AS why FROM q""")
def excerpt(spark, sf):
    return view(spark, sf, "docs").select("id", tx.excerpt("body", "ther").alias("why")).where("why is not null")


@query("meta_line", oracle="""
WITH l AS (SELECT page_id AS id, list_filter(['make = '||regexp_extract(url,'://([^/]*)/',1), 'url = '||url||url||url, 'end'], lambda x: contains(x,'/en/'))[1] AS l FROM pages)
SELECT id, CASE WHEN length(l)>80 THEN left(l,80)||'…' ELSE l END AS line FROM l""")
def meta_line(spark, sf):
    lines = F.concat(F.lit("make = "), F.regexp_extract("url", "://([^/]*)/", 1), F.lit("\nurl = "), "url", "url", "url", F.lit("\nend"))
    return read(spark, sf, "pages").select(F.col("page_id").alias("id"), tx.meta_line(lines, "/en/").alias("line"))


@query("first_json_object", oracle="""
SELECT event_id AS id, CASE WHEN event_id%5=0 THEN '' ELSE '{"a": "}", "b": '||props||'}' END AS obj FROM events""")
def first_json_object(spark, sf):
    text = F.when(F.expr("event_id%5=0"), F.concat(F.lit("<think>"), "props", F.lit("</think> nothing"))).otherwise(
        F.concat(F.lit('<think>{x</think> ok {"a": "}", "b": '), "props", F.lit("} tail }")))
    return read(spark, sf, "events").select(F.col("event_id").alias("id"), tx.first_json_object(text).alias("obj"))


@query("content_keys", oracle="""
SELECT doc_id AS id, md5(n_chars||'|'||left(text,64)||'|'||right(text,64)) AS quick, md5(text) AS full FROM documents""")
def content_keys(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), hashes.quick_key("text", "n_chars", 64).alias("quick"), hashes.content_key("text").alias("full"))


@query("human_size", using=("shelf",), oracle="""
WITH s AS (SELECT id, CASE id%3 WHEN 0 THEN size*(1+id%1000) WHEN 1 THEN id%2000 ELSE size%5000000 END AS n, ((id*7)%40000)/10.0 AS t FROM shelf),
u AS (SELECT *, CASE WHEN n<1024 THEN 0 WHEN n<1048576 THEN 1 WHEN n<1073741824 THEN 2 WHEN n<1099511627776 THEN 3 ELSE 4 END AS k, n/pow(1024, CASE WHEN n<1024 THEN 0 WHEN n<1048576 THEN 1 WHEN n<1073741824 THEN 2 WHEN n<1099511627776 THEN 3 ELSE 4 END) AS v, floor(t+0.5)::bigint AS x FROM s)
SELECT id, CASE WHEN k=0 THEN n||' B' WHEN v<10 THEN printf('%.1f %s', v, ['B','KB','MB','GB','TB'][k+1]) ELSE printf('%.0f %s', v, ['B','KB','MB','GB','TB'][k+1]) END AS size,
 CASE WHEN t<1 THEN '< 1 s' WHEN x<60 THEN x||' s' WHEN x<3600 THEN printf('%d min %02d s', x//60, x%60) ELSE printf('%d h %02d min', x//3600, x//60%60) END AS took FROM u""")
def human_size(spark, sf):
    n = F.expr("case id%3 when 0 then size*(1+id%1000) when 1 then id%2000 else size%5000000 end")
    return view(spark, sf, "shelf").select("id", tx.human_size(n).alias("size"), tx.duration_text(F.expr("((id*7)%40000)/10.0D")).alias("took"))


@query("text_shape", using=("docs",), oracle="""
SELECT id, length(body)::bigint AS chars, regexp_matches(body||CASE WHEN id%4=0 THEN '海' ELSE '' END,'[\\x{3000}-\\x{D7FF}]') AS cjk, md5(translate(body,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')) AS low FROM docs""")
def text_shape(spark, sf):
    d = view(spark, sf, "docs")
    return d.select("id", tx.utf8_len("body").cast("bigint").alias("chars"), tx.has_cjk(F.concat("body", F.when(F.col("id") % 4 == 0, "海").otherwise(""))).alias("cjk"), F.md5(tx.alower("body")).alias("low"))


@query("screenshot_name", using=("assets",), oracle="SELECT id, kind='view' AS shot, kind='view' OR lower(ext)='png' AS text_image FROM assets")
def screenshot_name(spark, sf):
    return asset_paths(spark, sf).select("id", tx.screenshot_name(tx.basename("src_path")).alias("shot"), tx.is_text_image("src_path").alias("text_image"))


@query("tag_phrases", using=("tagrows",), oracle="""
WITH t AS (SELECT id, CASE id%3 WHEN 0 THEN word2||'s' WHEN 1 THEN word1 ELSE word2 END AS t, CASE id%3 WHEN 0 THEN 'object' WHEN 1 THEN 'medium' ELSE 'document' END AS c FROM tagrows),
a AS (SELECT id, c, CASE WHEN length(t)>2 AND regexp_matches(t,'[^s]s$') THEN t WHEN left(t,1) IN ('a','e','i','o','u') THEN 'an '||t ELSE 'a '||t END AS a FROM t)
SELECT id, CASE c WHEN 'medium' THEN a||'|an image that is '||a||'|this is '||a||'|'||a||' of something' WHEN 'document' THEN 'a screenshot of '||a||'|an image of '||a||'|'||a||'|a photo of '||a
 ELSE 'a photo of '||a||'|a picture of '||a||'|an image showing '||a||'|an illustration of '||a||'|'||a END AS phrases FROM a""")
def tag_phrases(spark, sf):
    name = F.expr("case id%3 when 0 then word2||'s' when 1 then word1 else word2 end")
    cat = F.expr("case id%3 when 0 then 'object' when 1 then 'medium' else 'document' end")
    return view(spark, sf, "tagrows").select("id", F.array_join(tg.tag_phrases(name, cat), "|").alias("phrases"))


@query("fingerprint", using=("tagrows",), oracle="""
SELECT id, md5(array_to_string([word1, word2, coalesce(user_tags,''), size::varchar], chr(31))) AS key FROM tagrows""")
def fingerprint(spark, sf):
    return view(spark, sf, "tagrows").select("id", hashes.fingerprint("word1", "word2", "user_tags", "size").alias("key"))


@query("parse_tag_list", using=("tagrows",), oracle="""
SELECT id, CASE WHEN id%3=0 THEN word1||'=1.0;'||word2||'=1.0' WHEN id%3=1 THEN word1||'='||conf1||';'||word2||'=1.0' ELSE '' END AS parsed FROM tagrows""")
def parse_tag_list(spark, sf):
    js = F.when(F.expr("id%3=0"), F.format_string('["%s","%s",""]', F.col("word1"), F.col("word2"))).when(
        F.expr("id%3=1"), F.format_string('[["%s",%s],["%s"]]', F.col("word1"), F.col("conf1").cast("string"), F.col("word2"))).otherwise("not a list")
    shown = F.array_join(F.transform(tg.parse_tag_list(js), lambda t: F.concat(t["tag"], F.lit("="), t["conf"].cast("string"))), ";")
    return view(spark, sf, "tagrows").select("id", shown.alias("parsed"))


@query("clean_value", using=("docs",), oracle="""
WITH t AS (SELECT id, trim(translate(body, chr(10)||chr(13)||chr(9), '   ')) AS v FROM docs)
SELECT id, CASE WHEN strlen(v)<=200 THEN v ELSE left(v, list_max(list_filter(range(50,201), lambda k: strlen(left(v,k::int))<=200))::int) END AS v FROM t""")
def clean_value(spark, sf):
    return view(spark, sf, "docs").select("id", tx.clean_value("body", 200).alias("v"))


CUT = lambda n: f"CASE WHEN strlen(body)<={n} THEN body ELSE left(body, list_max(list_filter(range({n // 4},{n + 1}), lambda k: strlen(left(body,k::int))<={n}))::int)"


@query("describe_doc", using=("docs",), oracle=f"""
SELECT id, translate({CUT(220)} END,chr(10),' ')||CASE WHEN id%2=0 THEN ' | prompt: '||translate({CUT(240)}||'…' END,chr(10),' ') ELSE '' END
 ||' | date '||CASE WHEN id%5=0 THEN 'unknown' ELSE left('2018-01-01 00:00:00', CASE id%3 WHEN 0 THEN 10 WHEN 1 THEN 7 ELSE 4 END) END||' | file '||regexp_extract(src_path,'([^/]*)$',1) AS txt FROM docs""")
def describe_doc(spark, sf):
    d = view(spark, sf, "docs")
    prompt = F.when(F.col("id") % 2 == 0, F.concat("body", F.lit("\nNegative: blurry\nA1111 m")))
    date = F.when(F.col("id") % 5 != 0, "2018-01-01 00:00:00")
    prec = F.expr("case id%3 when 0 then 'second' when 1 then 'month' else 'year' end")
    return d.select("id", search.describe_doc("body", prompt, date, prec, "src_path").alias("txt"))
