"""Test views over the driver's tables, rendered from one text into Spark SQL expressions and DuckDB SQL.

The two dialects differ only in the functions named in ``_SPARK`` / ``_DUCK``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPARK = {
    "d8": lambda c: f"date_format({c},'yyyyMMdd')",
    "t6": lambda c: f"date_format({c},'HHmmss')",
    "day": lambda c: f"date_format({c},'yyyy-MM-dd')",
    "dash": lambda c: f"date_format({c},'yyyy-MM-dd-HH-mm-ss')",
    "full": lambda c: f"date_format({c},'yyyy-MM-dd HH:mm:ss')",
    "colon": lambda c: f"date_format({c},'yyyy:MM:dd HH:mm:ss')",
    "hm": lambda c: f"date_format({c},'yyyyMMdd-HHmm')",
    "secs": lambda c: f"unix_seconds(cast({c} as timestamp))",
    "int": lambda c: f"cast({c} as bigint)",
    "str": lambda c: f"cast({c} as string)",
    "idiv": lambda c: "(({}) div ({}))".format(*c.split(";")),
    "plus_seconds": lambda c: "timestampadd(SECOND, {1}, {0})".format(*c.split(";")),
    "first_json": lambda c: f"cast(get_json_object({c},'$.k') as bigint)",
}
_DUCK = {
    "d8": lambda c: f"strftime({c},'%Y%m%d')",
    "t6": lambda c: f"strftime({c},'%H%M%S')",
    "day": lambda c: f"strftime({c},'%Y-%m-%d')",
    "dash": lambda c: f"strftime({c},'%Y-%m-%d-%H-%M-%S')",
    "full": lambda c: f"strftime({c},'%Y-%m-%d %H:%M:%S')",
    "colon": lambda c: f"strftime({c},'%Y:%m:%d %H:%M:%S')",
    "hm": lambda c: f"strftime({c},'%Y%m%d-%H%M')",
    "secs": lambda c: f"cast(floor(epoch({c})) as bigint)",
    "int": lambda c: f"cast({c} as bigint)",
    "str": lambda c: f"cast({c} as varchar)",
    "idiv": lambda c: "(({}) // ({}))".format(*c.split(";")),
    "plus_seconds": lambda c: "({0} + to_seconds({1}))".format(*c.split(";")),
    "first_json": lambda c: f"cast(json_extract({c},'$.k') as bigint)",
}

_CALL = re.compile(r"@(\w+)\[([^\[\]]*)\]")


def _render(text: str, table: dict) -> str:
    """Replace ``@name[arg]`` calls, innermost first."""
    while True:
        new = _CALL.sub(lambda m: table[m.group(1)](m.group(2)), text)
        if new == text:
            return text
        text = new


# view -> (source table, [(column, expression), ...])
_VIEWS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    # one row per event, seen as a scanned file whose name, folder and times carry date evidence
    "assets": ("events", [
        ("id", "event_id"),
        ("src_root", "'/lib'"),
        ("folder", "case event_id%4 when 0 then '2024-01 Paris trip' when 1 then 'DCIM/100CANON' "
                   "when 2 then 'user_'||@str[user_id] else 'backup' end"),
        ("stem", "case event_type when 'click' then 'IMG_'||@d8[ts]||'_'||@t6[ts] "
                 "when 'view' then 'Screenshot_'||@dash[ts] "
                 "when 'signup' then 'IMG_'||lpad(@str[event_id%10000],4,'0') "
                 "when 'purchase' then 'IMG-'||@d8[ts]||'-WA'||lpad(@str[event_id%10000],4,'0') "
                 "else 'mmexport'||@str[@secs[ts]]||'000' end"),
        ("mtime", "@secs[ts] + (event_id%3)*86400*40"),
        ("size", "@int[round(value*100)]"),
        ("pinned", "event_id%7=0"),
        ("ext", "case event_id%6 when 0 then 'JPEG' when 1 then 'png' when 2 then 'tif' else 'jpg' end"),
        ("exif_original", "case when event_id%10=1 then '2000:01:01 00:00:05' when event_id%6=0 then "
                          "@colon[@plus_seconds[ts;(event_id%5)*86400]] end"),
        ("manual_date", "case when event_id%97=0 then '1998-07-01 00:00:00|day' end"),
        ("width", "@int[case when event_id%9=0 then 0 else 600+(event_id*37)%1000 end]"),
        ("height", "@int[case when event_id%9=0 then 0 else 500+(event_id*53)%900 end]"),
        ("user_id", "user_id"),
        ("kind", "event_type"),
        ("k", "@first_json[props]"),
        ("day", "@day[ts]"),
    ]),
    # one row per order, seen as a catalogued asset after the date, tag and organize stages
    "shelf": ("orders", [
        ("id", "o_orderkey"),
        ("src_root", "'/lib'"),
        ("src_path", "'/lib/'||lower(substr(o_orderpriority,3))||'/IMG_'||lpad(@str[o_orderkey],10,'0')||'.jpg'"),
        ("size", "@int[round(o_totalprice*100)]"),
        ("mtime", "@secs[o_orderdate]"),
        ("date_value", "case when o_orderkey%11=0 then null when o_orderkey%5=1 then substr(@day[o_orderdate],1,4)||'-01-01 00:00:00' "
                       "when o_orderkey%5=2 then substr(@day[o_orderdate],1,7)||'-01 00:00:00' "
                       "when o_orderkey%5=3 then @day[o_orderdate]||' 00:00:00' "
                       "else @full[@plus_seconds[o_orderdate;(o_orderkey*37)%86400]] end"),
        ("date_prec", "case when o_orderkey%11=0 then 'none' when o_orderkey%5=1 then 'year' when o_orderkey%5=2 then 'month' "
                      "when o_orderkey%5=3 then 'day' else 'second' end"),
        ("date_conf", "((o_orderkey*7)%101)/100.0D"),
        ("needs_review", "(o_orderkey*7)%101<55 or o_orderkey%11=0"),
        ("resolved", "o_orderkey%13<>0"),
        ("vision_status", "case o_orderstatus when 'F' then 'done' when 'O' then 'failed' end"),
        ("dest_path", "case when o_orderstatus='F' and o_orderkey%3=0 then '/out/'||@d8[o_orderdate]||'_'||lpad(@str[1+o_orderkey%500],5,'0')||'.jpg' end"),
        ("day_key", "case when o_orderkey%11=0 then '00000000' when o_orderkey%5=1 then substr(@d8[o_orderdate],1,4)||'0000' "
                    "when o_orderkey%5=2 then substr(@d8[o_orderdate],1,6)||'00' else @d8[o_orderdate] end"),
        ("sn", "@int[case when o_orderstatus='F' and o_orderkey%3=0 then 1+o_orderkey%500 else 0 end]"),
        ("dup_of", "@int[case when o_orderkey%17=0 and o_orderkey>0 then o_orderkey-1 else 0 end]"),
        ("similar_to", "@int[case when o_orderkey%19=0 and o_orderkey>1 then o_orderkey-2 else 0 end]"),
        ("location", "case o_orderkey%7 when 0 then null when 1 then 'Paris' when 2 then 'Kyoto' when 3 then 'Lima' else 'New York' end"),
        ("clip_model", "case when o_orderkey%10=5 then 'm0' when o_orderkey%5<>0 then 'm1' end"),
        ("meta_state", "case when o_orderkey%3=0 then case when o_orderkey%2=0 then 'full' else 'base' end end"),
        ("favorite", "o_orderkey%23=0"),
        ("gen_tool", "case when o_orderkey%29=0 then 'A1111' end"),
        ("cust", "o_custkey"),
        ("status", "o_orderstatus"),
        ("file_size", "@int[round(o_totalprice*100)] + case when o_orderkey%31=0 then 1 else 0 end"),
    ]),
    # one row per document, seen as an asset with a description
    "docs": ("documents", [
        ("id", "doc_id"),
        ("name", "source"),
        ("body", "text"),
        ("lang", "lang"),
        ("n_chars", "n_chars"),
        ("src_path", "'/lib/'||source||'/'||lang||case when doc_id%9=0 then '/backup' else '' end||'/doc_'||@str[doc_id]||"
                     "case when doc_id%5=0 then ' (1)' else '' end||'.txt'"),
        ("mtime", "@int[case when doc_id%8=0 then 0 else 1600000000+(doc_id*7919)%1000000 end]"),
        ("meta_len", "@int[(doc_id*31)%5]"),
        ("pinned", "doc_id%50=0"),
        ("dest_path", "case when doc_id%20=3 then '/out/doc_'||@str[doc_id]||'.txt' end"),
        ("date_value", "@day[cast('2018-01-01' as timestamp)]"),
    ]),
    # rows of the decision log
    "decisions": ("events", [
        ("id", "event_id"),
        ("at", "@full[ts]"),
        ("kind", "case when event_type in ('click','view') then 'date' when event_type='signup' then 'place' else 'search' end"),
        ("photo_id", "user_id"),
        ("subject", "'/lib/user_'||@str[user_id]||'/'||event_type"),
        ("changed", "@int[case when event_id%3=0 then 1 else 0 end]"),
        ("p", "((event_id*37)%101)/100.0D"),
    ]),
    # undo journal
    "journal_fx": ("events", [
        ("id", "event_id"),
        ("run", "@day[ts]"),
        ("at", "@full[ts]"),
        ("kind", "case event_type when 'click' then 'copy' when 'view' then 'move' when 'signup' then 'rename' when 'purchase' then 'refile' else 'meta' end"),
        ("photo_id", "user_id"),
        ("src", "'/lib/f'||@str[event_id]"),
        ("dst", "'/out/f'||@str[event_id-event_id%2]"),
        ("undone", "event_id%5=0"),
    ]),
    # one row per part, seen as a tagged asset; the tag lists are text until parsed
    "tagrows": ("part", [
        ("id", "p_partkey"),
        ("src_path", "'/lib/'||lower(p_type)||'/'||p_name||' '||@str[p_partkey]||'.jpg'"),
        ("word1", "split_part(p_name,' ',1)"),
        ("word2", "split_part(p_name,' ',2)"),
        ("conf1", "@int[p_size*2]/100.0D"),
        ("conf2", "@int[(p_partkey*13)%100]/100.0D"),
        ("kind", "lower(p_type)"),
        ("brand", "p_brand"),
        ("size", "@int[p_size]"),
        ("price", "p_retailprice"),
        ("removed", "case when p_partkey%6=0 then split_part(p_name,' ',1) end"),
        ("added", "case when p_partkey%10=0 then 'Forest' when p_partkey%10=5 then upper(split_part(p_name,' ',2)) end"),
        ("user_tags", "case when p_partkey%15=0 then 'Grandma,garden,grandma' end"),
        ("clip_model", "case when p_partkey%4=0 then null when p_partkey%4=1 then 'm0' else 'm1' end"),
        ("clip_vocab", "case when p_partkey%3=0 then 'v1' else 'v2' end"),
        ("gen_tool", "case when p_partkey%9=0 then 'A1111' end"),
        ("has_date", "p_partkey%2=0"),
        ("has_kw", "p_partkey%3=0"),
        ("has_desc", "p_partkey%5=0"),
        ("has_place", "p_partkey%7=0"),
    ]),
    # correction proposals and their outcome
    "corrections": ("part", [
        ("id", "p_partkey"),
        ("photo_id", "@int[@idiv[p_partkey;3]]"),
        ("field", "'tag'"),
        ("action", "case when p_partkey%2=0 then 'remove' else 'add' end"),
        ("current", "case when p_partkey%2=0 then split_part(p_name,' ',1) else '' end"),
        ("proposed", "case when p_partkey%2=0 then '' else split_part(p_name,' ',2) end"),
        ("confidence", "@int[p_size]/50.0D"),
        ("source", "lower(p_type)"),
        ("status", "case p_partkey%4 when 0 then 'rejected' when 1 then 'applied' else 'pending' end"),
    ]),
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of long texts, spread over all cores when it is one small file."""
    from ..operators.ranking import spread

    return spread(read(spark, sf_dir, table))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, cols = _VIEWS[name]
    df = read(spark, sf_dir, table)
    return df.selectExpr(*[f"{_render(e, _SPARK)} as {c}" for c, e in cols])


def _duck_view(name: str) -> str:
    table, cols = _VIEWS[name]
    body = ", ".join(f"{_render(e, _DUCK)} AS {c}" for c, e in cols).replace("0.0D", "0.0::double").replace("00.0D", "00.0::double")
    return f"SELECT {body} FROM {table}"


# base hash of every vector (first comparison in the highest bit), plus copies with two and five bits flipped
_HASH_SQL = """
SELECT vec_id AS id, label, list_reduce(list_prepend(0::bigint, list_transform(range(1,65), lambda i:
  CASE WHEN embedding[i] > embedding[(i % 64) + 1] THEN (CASE WHEN i=1 THEN (-9223372036854775808)::bigint ELSE (1::bigint << (64-i)::int) END) ELSE 0::bigint END)),
  lambda a, b: a | b) AS h FROM embeddings"""

_EXTRA_SQL = {
    "hashes0": _HASH_SQL,
    "hashes": """
SELECT id, h, w, ht, sz FROM (
 SELECT id, h, (800+(id%3)*400)::bigint w, (600+(id%3)*300)::bigint ht, (1000+id)::bigint sz FROM hashes0
 UNION ALL SELECT id+100000, xor(h, xor(1::bigint << (id%62)::int, 1::bigint << ((id*7)%62)::int)), 400::bigint, 300::bigint, (500+id)::bigint FROM hashes0
 UNION ALL SELECT id+200000, xor(h, xor(xor(xor(xor(1::bigint << (id%62)::int, 1::bigint << ((id+11)%62)::int), 1::bigint << ((id+22)%62)::int),
   1::bigint << ((id+33)%62)::int), 1::bigint << ((id+44)%62)::int)), 300::bigint, (CASE WHEN id%2=0 THEN 400 ELSE 225 END)::bigint, (400+id)::bigint FROM hashes0)""",
    "vocab_raw": """
SELECT label, d, avg(v::double) AS m FROM (SELECT label, unnest(embedding) AS v, unnest(range(64)) AS d FROM embeddings) GROUP BY label, d""",
    "vocab": """
SELECT 'label_'||label AS tag, 'cat_'||(label%3) AS category, label::bigint AS pos,
  list(m/n ORDER BY d) AS v FROM (SELECT label, d, m, sqrt(sum(m*m) OVER (PARTITION BY label)) AS n FROM vocab_raw) GROUP BY label""",
    "cosines": """
SELECT e.vec_id, e.label, t.tag, t.category, t.pos, list_dot_product(list_transform(e.embedding, lambda x: x::double), t.v) AS cos
FROM embeddings e, vocab t""",
}
_NEEDS = {"hashes": ("hashes0",), "vocab": ("vocab_raw",), "cosines": ("vocab_raw", "vocab")}


def with_views(names: tuple[str, ...], body: str) -> str:
    """``body`` preceded by the CTEs it uses (materialised where they are expensive)."""
    order: list[str] = []
    for n in names:
        for need in (*_NEEDS.get(n, ()), n):
            if need not in order:
                order.append(need)
    if not order:
        return body.strip()
    ctes = ", ".join(f"{n} AS ({(_EXTRA_SQL[n] if n in _EXTRA_SQL else _duck_view(n)).strip()})" for n in order)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        if rest[:10].upper() == "RECURSIVE ":
            return f"WITH RECURSIVE {ctes}, {rest[10:]}"
        return f"WITH {ctes}, {rest}"
    return f"WITH {ctes} {body}"


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, h, w, ht, sz``: perceptual hashes of the vectors and of two altered copies of each."""
    from ..functions.hashes import dhash_of_vector

    base = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), dhash_of_vector(F.col("embedding")).alias("h"))

    def flip(*exprs: str):
        out = F.lit(0).cast("bigint")
        for e in exprs:
            out = out.bitwiseXOR(F.expr(f"shiftleft(cast(1 as bigint), cast({e} as int))"))
        return F.col("h").bitwiseXOR(out)

    def rows(off: int, h, w: str, ht: str, sz: str):
        return base.select((F.col("id") + off).alias("id"), h.alias("h"), F.expr(w).cast("bigint").alias("w"),
                           F.expr(ht).cast("bigint").alias("ht"), F.expr(sz).cast("bigint").alias("sz"))

    return (rows(0, F.col("h"), "800+(id%3)*400", "600+(id%3)*300", "1000+id")
            .unionByName(rows(100000, flip("id%62", "(id*7)%62"), "400", "300", "500+id"))
            .unionByName(rows(200000, flip(*[f"(id+{k * 11})%62" for k in range(5)]), "300",
                              "case when id%2=0 then 400 else 225 end", "400+id")))


def label_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tag, category, pos, vec``: the unit-length mean vector of each label."""
    from ..operators.tags import prompt_ensemble

    e = read(spark, sf_dir, "embeddings").select(F.col("label").alias("tag_id"), "embedding")
    return prompt_ensemble(e, "tag_id", "embedding").select(
        F.concat(F.lit("label_"), F.col("tag_id").cast("string")).alias("tag"),
        F.concat(F.lit("cat_"), (F.col("tag_id") % 3).cast("string")).alias("category"),
        F.col("tag_id").cast("bigint").alias("pos"), F.col("vec"))
