"""The watched catalog kept up to date by deltas: a batch touches only the groups its own files belong to.

Four Parquet tables, each in a fixed number of buckets of its own key, and a batch replaces only buckets it touches (dynamic partition overwrite):

* ``files``: the newest version of every path, by path; deleted files stay as a mark, so that older versions that arrive late are recognised;
* ``copies``: members of content groups, by content key, each with the file that its group keeps;
* ``minutes``: members of (folder, minute of file time), by that key, with their first and last evidence day;
* ``results``: decided dates, tags and whatever else ``decide`` returns, by path.

A batch is reduced to paths whose newest version it brings. Those leave their old groups and join new ones; a keeper is chosen again for the content groups among them, and
the bulk-copy flag is compared before and after for the minutes among them. Changed files, and all files of minutes whose flag turned, are decided again.

Batches may come in any order, twice, or be cut off at any point: what a batch adds is computed from ``files``, which is replaced last,
and the other steps give the same result when they are repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import dirname
from ..operators.catalog import latest_version
from ..operators.dedupe import KEEPER_COLUMNS, keeper_key
from ..session import Scratch, hadoop_path

BUCKETS = 64
MINUTE = ["dir", "minute"]


class Buckets:
    """A Parquet table in buckets of ``keys``; an update replaces whole buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], n: int):
        self.spark, self.path, self.schema, self.keys, self.n = spark, path, schema, list(keys), n

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def touched_by(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys: at most ``n`` numbers."""
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def read(self, touched: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; no other bucket's files are opened."""
        where, fs = hadoop_path(self.spark, self.path)
        if not fs.exists(where) or touched is not None and not touched:
            return self.spark.createDataFrame([], self.schema)
        df = self.spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(self.path)
        if touched is not None:
            df = df.where(F.col("bucket").isin(list(touched)))
        return df.where("src_path is not null").drop("bucket")

    def replace(self, rows: DataFrame, touched: Sequence[int]) -> None:
        """Put ``rows`` in place of the touched buckets. Large buckets are written by several tasks; an empty one keeps a row without a path."""
        if not touched:
            return
        marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int")
        blank = marks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], "bucket")
        out = rows.select(*self.schema.names).withColumn("bucket", self.bucket()).unionByName(blank)
        out.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(self.path)


class LiveCatalog:
    """Duplicates, dates and tags of a folder that changes.

    Scan rows carry ``src_path, at`` (orders versions of a path), ``deleted``, ``size, mtime, id, pinned, dest_path, meta_len``, the columns of
    ``copy_keys``, ``days`` (days of evidence besides file times) and whatever ``decide`` reads. ``decide`` gets live rows with ``bulk`` and returns
    one row per ``src_path``; it may look at nothing but its rows and tables that stay as they are.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, decide: Callable[[DataFrame], DataFrame], copy_keys: Sequence[str] = ("size", "full"), buckets: int = BUCKETS):
        self.spark, self.decide, self.copy_keys = spark, decide, list(copy_keys)
        rows = spark.createDataFrame([], schema)
        table = lambda name, df, keys: Buckets(spark, f"{path}/{name}", df.schema, keys, buckets)
        self.files = table("files", rows, ["src_path"])
        self.copies = table("copies", self._copy_rows(rows).withColumn("dup_of", F.col("id")), self.copy_keys)
        self.minutes = table("minutes", self._minute_rows(rows), MINUTE)
        self.results = table("results", decide(rows.withColumn("bulk", F.lit(False))), ["src_path"])

    def _copy_rows(self, rows: DataFrame) -> DataFrame:
        return rows.where("size > 0").select(*dict.fromkeys([*self.copy_keys, *KEEPER_COLUMNS]))

    def _minute_rows(self, rows: DataFrame) -> DataFrame:
        return rows.select(dirname("src_path").alias("dir"), F.floor(F.col("mtime") / 60).alias("minute"), "src_path", F.array_min("days").alias("lo"), F.array_max("days").alias("hi"))

    # ---- reading

    def live(self) -> DataFrame:
        return self.files.read().where("not deleted")

    def duplicates(self) -> DataFrame:
        """``src_path, id, dup_of`` of every extra copy."""
        return self.copies.read().where("dup_of <> id").select("src_path", "id", "dup_of")

    def decisions(self) -> DataFrame:
        return self.results.read()

    def missing(self, scan: DataFrame, root: str, at: Column) -> DataFrame:
        """Rows that mark the live files below ``root`` which a full scan of it no longer has."""
        below = self.live().where(F.col("src_path").startswith(root.rstrip("/") + "/"))
        return below.join(scan.select("src_path"), "src_path", "left_anti").withColumns({"deleted": F.lit(True), "at": at}).select(*self.files.schema.names)

    # ---- one batch

    def fold(self, batch: DataFrame) -> None:
        with Scratch(self.spark) as scratch:
            newest = scratch.keep(latest_version(batch.select(*self.files.schema.names)), "newest")
            near = self.files.touched_by(newest)
            known = self.files.read(near)
            old = known.select("src_path", F.struct(*known.columns).alias("old"))
            versions = newest.select("src_path", F.struct(*newest.columns).alias("new")).join(old, "src_path", "left")
            changes = scratch.keep(versions.where(F.col("old").isNull() | (F.col("new.at") > F.col("old.at"))), "changes")
            paths = changes.select("src_path")
            come = changes.where("not new.deleted").select("new.*")
            gone = changes.where("old is not null and not old.deleted").select("old.*")
            copies, near_copies = self._copies(scratch, paths, gone, come)
            minutes, near_minutes, turned = self._minutes(scratch, paths, gone, come)
            results, near_results = self._results(scratch, paths, come, minutes, turned)
            files = scratch.keep(known.join(paths, "src_path", "left_anti").unionByName(changes.select("new.*")), "files")
            self.results.replace(results, near_results)
            self.copies.replace(copies, near_copies)
            self.minutes.replace(minutes, near_minutes)
            self.files.replace(files, near)

    def _copies(self, scratch: Scratch, paths: DataFrame, gone: DataFrame, come: DataFrame) -> tuple[DataFrame, list[int]]:
        """The touched buckets of content groups, the groups of changed files with a keeper chosen anew."""
        joined = self._copy_rows(come)
        keys = scratch.keep(self._copy_rows(gone).unionByName(joined).select(*self.copy_keys).distinct(), "content")
        near = self.copies.touched_by(keys)
        kept = self.copies.read(near).join(paths, "src_path", "left_anti")
        members = kept.unionByName(joined.withColumn("dup_of", F.lit(None).cast(kept.schema["dup_of"].dataType)))
        best = members.join(keys, self.copy_keys, "left_semi").groupBy(*self.copy_keys).agg(F.min_by("id", keeper_key()).alias("_keeper"))
        settled = members.join(best, self.copy_keys, "left").withColumn("dup_of", F.coalesce("_keeper", "dup_of"))
        return scratch.keep(settled.select(*self.copies.schema.names), "copies"), near

    def _minutes(self, scratch: Scratch, paths: DataFrame, gone: DataFrame, come: DataFrame) -> tuple[DataFrame, list[int], DataFrame]:
        """The touched buckets of minutes, and the minutes whose bulk flag turned."""
        left, joined = self._minute_rows(gone), self._minute_rows(come)
        keys = scratch.keep(left.unionByName(joined).select(*MINUTE).distinct(), "moments")
        near = self.minutes.touched_by(keys)
        before = self.minutes.read(near)
        after = scratch.keep(before.join(paths, "src_path", "left_anti").unionByName(joined), "minutes")
        mine = lambda rows: rows.join(keys, MINUTE, "left_semi")
        was, now = bulk_minutes(mine(before)).withColumnRenamed("bulk", "was"), bulk_minutes(mine(after)).withColumnRenamed("bulk", "now")
        both = keys.join(was, MINUTE, "left").join(now, MINUTE, "left")
        no = F.lit(False)
        return after, near, scratch.keep(both.where(F.coalesce("was", no) != F.coalesce("now", no)).select(*MINUTE), "turned")

    def _results(self, scratch: Scratch, paths: DataFrame, come: DataFrame, minutes: DataFrame, turned: DataFrame) -> tuple[DataFrame, list[int]]:
        """Decisions on changed files and on all files of minutes whose flag turned."""
        swept = scratch.keep(minutes.join(turned, MINUTE, "left_semi").select("src_path").join(paths, "src_path", "left_anti"), "swept")
        others = self.files.read(self.files.touched_by(swept)).join(swept, "src_path", "left_semi")
        rows = others.unionByName(come)
        flags = bulk_minutes(minutes).where("bulk")
        keyed = rows.withColumns({"dir": dirname("src_path"), "minute": F.floor(F.col("mtime") / 60)}).join(flags, MINUTE, "left")
        todo = scratch.keep(keyed.withColumn("bulk", F.coalesce("bulk", F.lit(False))).drop(*MINUTE), "undecided")
        again = paths.unionByName(swept)
        near = self.results.touched_by(again)
        kept = self.results.read(near).join(again, "src_path", "left_anti")
        return scratch.keep(kept.unionByName(self.decide(todo).select(*self.results.schema.names)), "results"), near


def bulk_minutes(members: DataFrame) -> DataFrame:
    """``dir, minute, bulk``: five files or more with evidence of two days or more, or twenty files, were copied together."""
    sums = members.groupBy(*MINUTE).agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return sums.select(*MINUTE, F.coalesce(((F.col("n") >= 5) & (F.col("lo") < F.col("hi"))) | (F.col("n") >= 20), F.lit(False)).alias("bulk"))


def watch_live(spark: SparkSession, source: str, schema: StructType, catalog: LiveCatalog, checkpoint: str, *, prepare=None, files_per_batch: int | None = None, every: str | None = None):
    """Start the stream: scan rows arriving as Parquet files are prepared and folded into the catalog.

    Without ``every`` everything present is processed and the stream ends; otherwise it keeps running at that interval.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(source)
    writer = (prepare(rows) if prepare else rows).writeStream.foreachBatch(lambda b, _: catalog.fold(b)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
