"""Catalog maintenance and analytics: scans folded in, counts, histograms, orders, logs and user overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import SEARCHABLE
from ..functions.text import alower, path_under, utf8_cut


def n_true(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("bigint")), F.lit(0))


# ---- scans

def skip_unchanged(scan: DataFrame, catalog: DataFrame, keys: tuple = ("src_path", "size", "mtime")) -> DataFrame:
    """Files the catalog does not know in exactly this size and time."""
    return scan.join(catalog.select(*keys), list(keys), "left_anti")


def upsert_scan(catalog: DataFrame, scan: DataFrame) -> DataFrame:
    """The catalog after a scan: new rows added, changed files reset where their content matters, everything else kept.

    Both sides carry ``src_path, size, mtime, quick_hash, gen_json, gen_keywords, name_keywords``; the catalog also ``id``,
    ``resolved, content_hash, vision_status``.
    """
    c, s = catalog.alias("c"), scan.alias("s")
    j = c.join(s, F.col("c.src_path") == F.col("s.src_path"), "full_outer")
    hit = F.col("s.src_path").isNotNull()
    same_gen = (F.coalesce("c.gen_json", F.lit("")) == F.coalesce("s.gen_json", F.lit(""))) & (F.coalesce("s.gen_keywords", F.lit("")) == "")
    same_file = (F.col("c.quick_hash") == F.col("s.quick_hash")) & (F.col("c.size") == F.col("s.size"))
    take = lambda n: F.when(hit, F.col(f"s.{n}")).otherwise(F.col(f"c.{n}")).alias(n)
    return j.select(
        F.coalesce("c.src_path", "s.src_path").alias("src_path"), take("size"), take("mtime"), take("quick_hash"), take("gen_json"),
        F.when(hit & ~(F.col("c.src_path").isNotNull() & same_gen), F.col("s.gen_keywords")).otherwise(F.col("c.gen_keywords")).alias("gen_keywords"),
        F.when(hit & ~F.coalesce(F.col("c.name_keywords").like("%1.0]%"), F.lit(False)), F.col("s.name_keywords")).otherwise(F.col("c.name_keywords")).alias("name_keywords"),
        F.when(hit, False).otherwise(F.col("c.resolved")).alias("resolved"),
        F.when(hit, None).otherwise(F.col("c.content_hash")).alias("content_hash"),
        F.when(hit & ~F.coalesce(same_file, F.lit(False)), None).otherwise(F.col("c.vision_status")).alias("vision_status"))


def latest_version(rows: DataFrame, key: str = "src_path", order: str = "at") -> DataFrame:
    """The newest row of each path."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def meta_lines_to_map(lines: DataFrame, id_: str = "id", line: str = "line", pos: str = "pos") -> DataFrame:
    """"key type value" lines to ``id, meta map<key, struct<t, v>>``; bulky binary values are dropped, long ones cut."""
    p = r"^(\S+) +(\S+) *(.*)$"
    g = lambda i: F.regexp_extract(line, p, i)
    rows = lines.where(F.col(line).rlike(r"^\S+ +\S")).select(id_, F.col(pos).alias("_p"), g(1).alias("k"), g(2).alias("t"), utf8_cut(g(3), 4000).alias("v"),
                                                               F.octet_length(g(3)).alias("_n"))
    rows = rows.where(~((F.col("t") == "Undefined") & (F.col("_n") > 200)))
    # the values of one key of one file: as long as the file's own metadata
    per_key = rows.groupBy(id_, "k").agg(F.max_by("t", "_p").alias("t"), F.array_sort(F.collect_list(F.struct("_p", "v"))).alias("vs"))
    return per_key.groupBy(id_).agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("t", F.transform("vs", lambda x: x["v"]).alias("v"))))).alias("meta"))


def meta_list(entry: Column) -> Column:
    """The values of one metadata key; bags and sequences are comma lists."""
    v = entry["v"]
    parts = F.when(entry["t"].isin("XmpBag", "XmpSeq"), F.flatten(F.transform(v, lambda x: F.split(x, ",")))).otherwise(v)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def file_carries(keys: Column) -> Column:
    """What the file itself holds already, from its metadata keys. The key names."""
    has = lambda *ks: F.arrays_overlap(keys, F.array(*[F.lit(k) for k in ks]))
    return F.struct(
        has("Exif.Photo.DateTimeOriginal", "Xmp.exif.DateTimeOriginal", "Xmp.photoshop.DateCreated").alias("date"),
        has("Xmp.dc.subject", "Iptc.Application2.Keywords").alias("keywords"),
        has("Xmp.dc.description", "Exif.Image.ImageDescription", "Iptc.Application2.Caption").alias("description"),
        has("Exif.GPSInfo.GPSLatitude", "Xmp.iptc.Location", "Xmp.photoshop.City", "Iptc.Application2.City").alias("place"))


# ---- analytics

def catalog_stats(df: DataFrame) -> DataFrame:
    dated = F.col("date_value").isNotNull()
    dup = F.col("dup_of") > 0
    return df.agg(
        F.count("*").alias("total"), n_true(F.col("resolved")).alias("resolved"), n_true(F.col("resolved") & F.col("needs_review")).alias("review"),
        n_true(F.col("resolved") & ~dated).alias("undated"), n_true(F.col("vision_status") == "done").alias("described"),
        n_true(F.col("vision_status") == "failed").alias("failed"), n_true(F.col("dest_path").isNotNull()).alias("organized"),
        n_true(dup).alias("dups"), n_true(F.col("location").isNotNull()).alias("located"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.when(dup, F.col("size"))), F.lit(0)).alias("dup_bytes"), n_true(F.col("similar_to") > 0).alias("similar"),
        n_true(F.col("clip_model").isNotNull()).alias("tagged"))


def month_of() -> Column:
    return (F.when(F.col("date_value").isNull(), "undated").when(F.col("date_prec") == "year", F.left("date_value", F.lit(4)))
            .otherwise(F.left("date_value", F.lit(7))))


def month_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy(month_of().alias("month")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def year_rollup(df: DataFrame) -> DataFrame:
    m = df.select(F.when(F.col("date_value").isNull(), "undated").otherwise(F.left("date_value", F.lit(4))).alias("year"), month_of().alias("month"), "size")
    return (m.rollup("year", "month").agg(F.count("*").alias("files"), F.grouping_id().cast("bigint").alias("level"))
            .select(F.coalesce("year", F.lit("(all)")).alias("year"), F.coalesce("month", F.lit("(all)")).alias("month"), "files", "level"))


def decision_stats(df: DataFrame) -> DataFrame:
    """Asked and changed per kind, and the total in the row without a kind."""
    return df.rollup("kind").agg(F.count("*").alias("asked"), F.sum("changed").alias("changed")).select(F.coalesce("kind", F.lit("(all)")).alias("kind"), "asked", "changed")


def embedding_counts(df: DataFrame, model: str, vocab: str) -> DataFrame:
    """Rows in total, without the current model's vector, with a stale vocabulary, with fewer than two sure tags (``tags``); duplicates don't count."""
    df = df.where(F.coalesce(F.col("dup_of"), F.lit(0)) == 0)
    has = F.coalesce(F.col("clip_model") == model, F.lit(False))
    sure = F.size(F.filter("tags", lambda t: t["conf"] >= SEARCHABLE))
    return df.agg(F.count("*").alias("total"), n_true(~has).alias("no_vec"), n_true(has & (F.col("clip_vocab") != vocab)).alias("stale"), n_true(has & (sure < 2)).alias("few"))


def journal_runs(df: DataFrame, limit: int) -> DataFrame:
    return (df.groupBy("run").agg(F.min("at").alias("at"), F.count_distinct("photo_id").alias("files"), F.min(F.col("undone").cast("int")).alias("undone"),
                                  F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))  # five kinds exist
            .orderBy(F.desc("run")).limit(limit))


def place_counts(df: DataFrame, limit: int | None = 8) -> DataFrame:
    """Files per place; the most frequent ``limit`` places for a panel, or all."""
    counts = df.where(F.col("location").isNotNull()).groupBy("location").agg(F.count("*").alias("files"))
    return counts.orderBy(F.desc("files"), "location").limit(limit) if limit else counts


def older_runs(df: DataFrame, keep: int) -> DataFrame:
    """Runs beyond the newest ``keep``: everything below the smallest of the newest ones."""
    runs = df.select("run").distinct()
    newest = runs.orderBy(F.desc("run")).limit(keep).agg(F.when(F.count("*") >= keep, F.min("run")).alias("_from"))
    return runs.where(F.col("run") < newest.scalar())


def keep_last_runs(df: DataFrame, keep: int) -> DataFrame:
    return df.join(older_runs(df, keep), "run", "left_anti")


# ---- browse and order

def browse(df: DataFrame, words: list[str] = (), review_only: bool = False, month: str = "", folders: list[str] = ()) -> DataFrame:
    """Rows whose ``search_text`` contains every word, within the other conditions."""
    for w in words:
        df = df.where(F.contains("search_text", F.lit(w.lower())))
    if folders:
        df = df.where(path_under("src_path", list(folders)))
    if review_only:
        df = df.where(F.col("needs_review") | F.col("date_value").isNull())
    if month == "undated":
        df = df.where(F.col("date_value").isNull())
    elif month:
        df = df.where(F.col("date_value").startswith(month))
    return df


def order_browse(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.col("date_value").isNull(), "date_value", "src_path").limit(limit)


ASSET_ORDERS = {"star": "favorite", "date": "date_value", "tags": "tags", "score": "score", "place": "location", "size": "size", "path": "src_path"}


def order_assets(df: DataFrame, by: str, desc: bool = False, limit: int | None = None) -> DataFrame:
    c = F.col(ASSET_ORDERS[by])
    keys = ([F.col("date_value").isNull()] if by == "date" else []) + [c.desc() if desc else c.asc(), F.col("id").asc()]
    out = df.orderBy(*keys)
    return out.limit(limit) if limit else out


TAG_ROW_ORDERS = {"tag": lambda: F.coalesce(F.col("first_tag"), F.lit("~")), "best": lambda: F.col("best"), "date": lambda: F.col("date_value"),
                  "flags": lambda: sum((F.col(c).cast("int") for c in ("has_kw", "has_desc", "has_place")), F.col("has_date").cast("int")),
                  "place": lambda: F.col("location"), "path": lambda: F.col("src_path")}
CORRECTION_ORDERS = {"confidence": lambda: F.col("confidence"), "path": lambda: F.col("src_path"), "change": lambda: F.concat("current", "proposed"), "source": lambda: F.col("source")}


def order_by_choice(df: DataFrame, choices: dict, by: str, desc: bool = False, limit: int | None = None) -> DataFrame:
    c = choices[by]()
    out = df.orderBy(c.desc() if desc else c.asc(), F.col("id").asc())
    return out.limit(limit) if limit else out


# ---- decisions, suggestions, overrides

def decisions_for_folder(decisions: DataFrame, assets: DataFrame, folders: list[str]) -> DataFrame:
    """Decisions about the folders, and search decisions about assets in them."""
    inside = assets.where(path_under("src_path", folders)).select(F.col("id").alias("photo_id")).distinct()
    about = decisions.where(path_under("subject", folders))
    searched = decisions.where(~path_under("subject", folders) & (F.col("kind") == "search")).join(inside, "photo_id", "left_semi")
    return about.unionByName(searched)


def known_tags(used: DataFrame, vocab: DataFrame) -> DataFrame:
    """Distinct lower-case tags of the catalog (``tags`` arrays) and the vocabulary."""
    return used.select(F.explode("tags").alias("tag")).select(alower(F.trim("tag")).alias("tag")).unionByName(vocab.select(alower("tag").alias("tag"))).where("tag <> ''").distinct()


FLAG_WORDS = [("favorites", "is:fav"), ("starred", "is:fav"), ("generated", "is:ai")]  # fixed values


def suggest(typed: str, tags: DataFrame, places: DataFrame, months: DataFrame, blocked: list[str] = ()) -> DataFrame:
    """``kind, text, query`` suggestions for typed text: up to 5 tags, 7 with places, 8 with years and months, then flags.

    Blank text suggests nothing and blocked tags are never offered. Every source is cut to its own maximum before the union, so only a few
    rows meet in the final ranking.
    """
    t = typed.strip().lower()
    spark = tags.sparkSession
    if not t:
        return spark.createDataFrame([], "kind string, text string, query string")
    tags = tags.where(~alower("tag").isin([b.strip().lower() for b in blocked])) if blocked else tags
    quoted = lambda c: F.when(F.contains(c, F.lit(" ")), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)

    def part(df, prio, kind, n):
        return df.orderBy("text").limit(n).select(F.lit(prio).alias("prio"), F.lit(kind).alias("kind"), "text", "query")

    tg = tags.where(F.contains("tag", F.lit(t))).select(F.col("tag").alias("text"), F.concat(F.lit("tag:"), quoted(F.col("tag"))).alias("query"))
    pl = places.where(F.contains(alower("location"), F.lit(t))).select(F.col("location").alias("text"), F.concat(F.lit("place:"), quoted(alower("location"))).alias("query")).distinct()
    dated = months.where("month <> 'undated'")
    yr = dated.select(F.left("month", F.lit(4)).alias("text")).distinct().where(F.col("text").startswith(t)).select("text", F.concat(F.lit("date:"), "text").alias("query"))
    mo = dated.where(F.col("month").startswith(t) & F.lit(len(t) >= 5)).select(F.col("month").alias("text"), F.concat(F.lit("date:"), "month").alias("query"))
    flags = [(5, "filter", w, q) for w, q in FLAG_WORDS if w.startswith(t)] + ([(5, "filter", "ai", "is:ai")] if t in ("ai", "aigc") else [])
    rows = part(tg, 1, "tag", 5).unionByName(part(pl, 2, "place", 7)).unionByName(part(yr, 3, "year", 8)).unionByName(part(mo, 4, "month", 8))
    w = Window.partitionBy(F.lit(1)).orderBy("prio", "text")  # at most 28 rows
    rows = rows.withColumn("_n", F.row_number().over(w)).where(
        ((F.col("prio") == 1) & (F.col("_n") <= 5)) | ((F.col("prio") == 2) & (F.col("_n") <= 7)) | ((F.col("prio") >= 3) & (F.col("_n") <= 8))).drop("_n")
    if flags:
        rows = rows.unionByName(spark.createDataFrame(flags, "prio int, kind string, text string, query string"))
    return rows.select("kind", "text", "query")


def apply_user_overrides(df: DataFrame, favorites: DataFrame, tag_lists: DataFrame, pins: DataFrame) -> DataFrame:
    """User values replace automatic ones; the last write per asset wins. A pin holds for one member of its group.

    ``favorites: id, on, at`` · ``tag_lists: id, tags, at`` · ``pins: group_id, id, at``.
    """
    f = favorites.groupBy("id").agg(F.max_by("on", "at").alias("_fav"))
    t = tag_lists.groupBy("id").agg(F.max_by(F.struct("tags"), "at").alias("_tags"))
    p = pins.groupBy("group_id").agg(F.max_by("id", "at").alias("_pin"))
    df = df.join(f, "id", "left").join(t, "id", "left").join(p, "group_id", "left")
    changed = F.col("_tags").isNotNull()
    return (df.withColumn("favorite", F.coalesce("_fav", "favorite")).withColumn("user_tags", F.when(changed, F.col("_tags.tags")).otherwise(F.col("user_tags")))
            .withColumn("pinned", F.when(F.col("_pin").isNotNull(), F.col("_pin") == F.col("id")).otherwise(F.col("pinned")))
            .withColumn("meta_state", F.when(changed & (F.col("meta_state") == "full"), "base").otherwise(F.col("meta_state")))
            .drop("_fav", "_tags", "_pin"))


WORK = {
    "undecided": lambda c: ~F.col("resolved"),
    "unembedded": lambda c: (F.col("dup_of") == 0) & (F.col("clip_model").isNull() | (F.col("clip_model") != c["model"])),
    "stale_tags": lambda c: (F.col("dup_of") == 0) & (F.col("clip_model") == c["model"]) & ~F.col("clip_vocab").eqNullSafe(F.lit(c["vocab"])),
    "few_tags": lambda c: (F.col("dup_of") == 0) & (F.col("clip_model") == c["model"]) & F.col("clip_vocab").eqNullSafe(F.lit(c["vocab"])) & (F.col("sure") < 2),
    "no_prompt_keywords": lambda c: F.col("gen_tool").isNotNull() & (F.coalesce("gen_keywords", F.lit("")) == ""),
    "undescribed": lambda c: (F.col("dup_of") == 0) & F.col("vision_status").isNull(),
    "failed": lambda c: (F.col("dup_of") == 0) & (F.col("vision_status") == "failed"),
}


def work_selection(df: DataFrame, config: dict) -> DataFrame:
    """``stage, id`` of everything each stage still has to do, in one pass over the catalog. ``sure`` counts an asset's sure tags."""
    todo = F.filter(F.array(*[F.when(F.coalesce(test(config), F.lit(False)), name) for name, test in WORK.items()]), lambda x: x.isNotNull())
    return df.select("id", F.explode(todo).alias("stage"))
