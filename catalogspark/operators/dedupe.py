"""Exact duplicates: tiers of ever more expensive keys, the copy to keep, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import content_key, quick_key
from ..functions.text import looks_like_copy
from .ranking import numbered


def content_keys(df: DataFrame, size: str, body: str, *keep: str) -> DataFrame:
    """Narrow rows with the keys of all tiers, computed where the file is read: contents are never shuffled."""
    return df.where(F.col(size) > 0).select(*keep, size, quick_key(body, size).alias("quick"), content_key(body).alias("full"), F.sha2(F.col(body), 256).alias("proof"))


def collision_tiers(df: DataFrame, size: str, body: str) -> DataFrame:
    """Groups, files and bytes still in play after each tier: same size; same quick key; same full key.

    A later key implies the earlier ones, so every tier is a plain map-side combined count.
    """
    keys = content_keys(df, size, body)

    def line(tier, by):
        g = keys.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
        return g.agg(F.lit(tier).alias("tier"), F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"),
                     F.coalesce(F.sum(F.col("n") * F.col(size)), F.lit(0)).alias("bytes"))

    return line("size", [size]).unionByName(line("quick", [size, "quick"])).unionByName(line("full", [size, "full"]))


def keeper_key(pinned="pinned", dest="dest_path", meta_len="meta_len", path="src_path", mtime="mtime", id_="id"):
    """Smallest is kept: pinned, organized, richer metadata, not copy-looking, older, shorter path, lower id.

    An unknown time (0) counts as newest, which makes the order total.
    """
    t = F.when(F.col(mtime) > 0, F.col(mtime))
    return F.struct((~F.col(pinned)).alias("p"), F.col(dest).isNull().alias("d"), (-F.col(meta_len)).alias("m"), looks_like_copy(path).alias("c"),
                    t.isNull().alias("u"), t.alias("t"), F.octet_length(path).alias("l"), F.col(id_).alias("i"))


def choose_keeper(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, keeper, copies`` of every group."""
    return df.groupBy(*keys).agg(F.min_by("id", keeper_key()).alias("keeper"), F.count("*").alias("copies"))


KEEPER_COLUMNS = ("id", "pinned", "dest_path", "meta_len", "src_path", "mtime")


def dedupe_exact(df: DataFrame, size: str, body: str, compare_bytes: bool = False) -> DataFrame:
    """``id, dup_of, size``: every extra copy and the file kept instead.

    Copies agree in size, full key and a second, 256-bit key of the whole content. ``compare_bytes`` also fetches the contents of the
    linked files and compares them, at the price of moving those contents.
    """
    keys = content_keys(df, size, body, *KEEPER_COLUMNS)
    by = [size, "full", "proof"]
    best = keys.groupBy(*by).agg(F.min_by("id", keeper_key()).alias("dup_of"), F.count("*").alias("_n")).where("_n > 1")
    links = keys.select("id", *by).join(best, by).where(F.col("id") != F.col("dup_of")).select("id", "dup_of", F.col(size).alias("size"))
    if compare_bytes:
        mine, kept = df.select("id", F.col(body).alias("_a")), df.select(F.col("id").alias("dup_of"), F.col(body).alias("_b"))
        links = links.join(mine, "id").join(kept, "dup_of").where("_a = _b").select("id", "dup_of", "size")
    return links


def dup_groups(df: DataFrame, link: str = "dup_of") -> DataFrame:
    """Members next to the row they link to."""
    k = df.select(F.col("id").alias("keeper"), F.col("size").alias("keeper_size"), F.col("src_path").alias("keeper_path"))
    return df.where(F.col(link) > 0).join(k, F.col(link) == F.col("keeper"))


def dup_summary(df: DataFrame) -> DataFrame:
    """One row: files, bytes, exact groups, extra copies, reclaimable bytes, similar groups and their members."""
    linked = df.select("size", F.explode(F.array(F.struct(F.lit("exact").alias("kind"), F.col("dup_of").alias("link")), F.struct(F.lit("similar").alias("kind"), F.col("similar_to").alias("link")))).alias("x"))
    linked = linked.select("size", "x.kind", "x.link").where("link > 0").join(df.select(F.col("id").alias("keeper")), F.col("link") == F.col("keeper"))
    rows = df.select("size", F.lit("file").alias("kind"), F.lit(None).cast("bigint").alias("keeper")).unionByName(linked.select("size", "kind", F.col("keeper").cast("bigint")))
    n = lambda kind, c=F.lit(1): F.count(F.when(F.col("kind") == kind, c))
    groups = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("keeper")))
    size = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("size")))
    return rows.agg(n("file").alias("files"), size("file").alias("bytes"), groups("exact").alias("exact_groups"), n("exact").alias("extra"),
                    F.coalesce(size("exact"), F.lit(0)).alias("reclaimable"), groups("similar").alias("similar_groups"), (n("similar") + groups("similar")).alias("similar_files"))


def group_sizes(df: DataFrame, link: str = "dup_of") -> DataFrame:
    g = dup_groups(df, link)
    return g.groupBy("keeper", "keeper_size").agg(F.count("*").alias("members"), F.sum("size").alias("member_bytes"))


def order_dup_groups(df: DataFrame, link: str = "dup_of") -> DataFrame:
    """Groups by the space they waste, largest first."""
    return group_sizes(df, link).withColumn("waste", F.col("keeper_size") * F.col("members")).orderBy(F.desc("waste"), "keeper")


def numbered_groups(df: DataFrame, link: str = "dup_of") -> DataFrame:
    """``keeper, group``: dense numbers of the groups, largest waste first."""
    g = group_sizes(df, link).withColumn("waste", F.col("keeper_size") * F.col("members"))
    return numbered(g, [], [F.desc("waste"), F.asc("keeper")], "group")


def trash_groups(df: DataFrame) -> DataFrame:
    """Every extra copy with its group number (in order of the kept file) and the seconds its removal takes."""
    g = dup_groups(df)
    ids = numbered(g.select("keeper").distinct(), [], [F.asc("keeper")], "group")
    return g.join(ids, "keeper").select("group", "keeper", "id", "size", F.lit(0.05).alias("seconds"))


def dupe_report(df: DataFrame, link: str = "dup_of", roles: tuple[str, str] = ("keep", "duplicate")) -> DataFrame:
    """``group, role, id, size, width, height, date, path`` lines: the kept file and its copies, ready for a CSV sink."""
    nums = numbered_groups(df, link).select("keeper", "group")
    members = df.where(F.col(link) > 0).join(nums, F.col(link) == F.col("keeper")).withColumn("role", F.lit(roles[1]))
    keepers = df.join(nums, F.col("id") == F.col("keeper")).withColumn("role", F.lit(roles[0]))
    return members.unionByName(keepers).select("group", "role", "id", "size", "width", "height", F.coalesce("date_value", F.lit("")).alias("date"), F.col("src_path").alias("path"))
