"""Readers: folder scans and vocabulary text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import alower, col, ext_lower, path_under

# fixed values: the image extensions a scan keeps
IMAGE_EXTENSIONS = """jpg jpeg jpe png gif bmp webp tif tiff heic heif avif dng cr2 cr3 crw nef nrw arw srf sr2 orf rw2 raf
pef srw x3f 3fr erf kdc mrw""".split()


def scannable(path, exclude: list[str] = ()) -> Column:
    """Image files outside hidden, thumbnail-store and output folders."""
    p = col(path)
    keep = ext_lower(p).isin(IMAGE_EXTENSIONS) & ~p.rlike(r"(^|/)(\.[^/]*|@eaDir)(/|$)")
    return keep & ~path_under(p, list(exclude)) if exclude else keep


def scan_assets(spark: SparkSession, roots: list[str], exclude: list[str] = ()) -> DataFrame:
    """``src_path, size, mtime`` of every image below the roots. File contents are never read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
             .select(F.regexp_replace("path", "^file:/*", "/").alias("src_path"), F.col("length").alias("size"),
                     F.unix_seconds("modificationTime").alias("mtime")))
    return files.where(scannable("src_path", exclude))


def assign_root(df: DataFrame, roots: list[str], path: str = "src_path") -> DataFrame:
    """Each file belongs to the shortest configured root that contains it. The roots are settings, a handful of literals."""
    out = F.lit(None).cast("string")
    for r in sorted(roots, key=len, reverse=True):
        out = F.when(path_under(path, [r]), r).otherwise(out)
    return df.withColumn("root", out)


LINE_RANGE = 100_000


def vocabulary_lines(lines: DataFrame, pos: str = "pos", text: str = "text", width: int = LINE_RANGE) -> DataFrame:
    """``tag, category, pos`` from lines: "# name" opens a category, the first spelling of a tag wins.

    Headings are carried forward inside ranges of ``width`` positions; the last heading of the ranges before is added, so no task reads
    more than one range and one row of each range.
    """
    t = F.trim(F.col(text))
    name = F.trim(F.substring(t, F.lit(2), F.length(t)))
    heading = t.startswith("#")
    cat = F.when(heading & (name != "") & ~F.contains(name, F.lit(":")), F.when(name == "style", "composition").otherwise(name))
    rows = lines.select(t.alias("tag"), F.col(pos).alias("pos"), cat.alias("_cat"), heading.alias("_head"), F.floor(F.col(pos) / width).alias("_range"))
    inside = Window.partitionBy("_range").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    lasts = rows.groupBy("_range").agg(F.max_by("_cat", F.when(F.col("_cat").isNotNull(), F.col("pos"))).alias("_last"))
    lasts = lasts.select("_range", F.last("_last", ignorenulls=True).over(before).alias("_open"))
    tagged = rows.withColumn("_cat", F.last("_cat", ignorenulls=True).over(inside)).where((F.col("tag") != "") & ~F.col("_head")).join(lasts, "_range")
    firsts = tagged.select("tag", F.coalesce("_cat", "_open", F.lit("object")).alias("category"), "pos")
    return firsts.groupBy(alower("tag").alias("_key")).agg(F.min_by(F.struct("tag", "category", "pos"), "pos").alias("f")).select("f.*")


def merge_vocab(mine: DataFrame, builtin: DataFrame, moved: list[str] = ()) -> DataFrame:
    """Built-in tags first, then the user's own that are neither built in nor moved elsewhere."""
    extra = mine.where(~alower("tag").isin(list(moved)) if moved else F.lit(True)).join(
        builtin.select(alower("tag").alias("_k")), alower(mine["tag"]) == F.col("_k"), "left_anti")
    return builtin.withColumn("own", F.lit(0)).unionByName(extra.withColumn("own", F.lit(1)))
