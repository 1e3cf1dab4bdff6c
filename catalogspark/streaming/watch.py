"""Watching folders: new scan rows are folded into the catalog as they arrive."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.catalog import latest_version


def run_metrics(df: DataFrame, name: str) -> DataFrame:
    """Report done, bytes and errors of a stage with its normal execution."""
    return df.observe(name, *metric_columns())


def metric_columns() -> list:
    """The figures of a stage: rows, bytes, and rows without content."""
    return [F.count(F.lit(1)).alias("done"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.when(F.col("size") <= 0, 1)).alias("errors")]


class Catalog:
    """A table kept as a base and the changes since, in one folder.

    A batch writes one change folder that is named by its stream and number, so a repeated batch replaces its own and a stream with new progress
    adds to what is there. The newest ``at`` of a path wins, in whatever order batches arrive. ``compact`` folds changes into a new base.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _done(self, kind: str) -> list[str]:
        """Finished folders of a kind, by name."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        top = hadoop(f"{self.path}/{kind}")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(top) if fs.exists(hadoop(s.getPath(), "_SUCCESS")))

    def _parts(self) -> tuple[list[str], list[str]]:
        return self._done("base")[-1:], self._done("changes")

    def _read(self, base: list[str], changes: list[str]) -> DataFrame | None:
        paths = [f"{self.path}/base/{b}" for b in base] + [f"{self.path}/changes/{c}" for c in changes]
        if not paths:
            return None
        return latest_version(self.spark.read.option("mergeSchema", "true").parquet(*paths))

    def read(self) -> DataFrame | None:
        return self._read(*self._parts())

    def fold(self, batch: DataFrame, batch_id: int, decide=None, stream: str = "") -> None:
        """Add one micro-batch: its newest row of each path, decided, with derived results reset."""
        rows = latest_version(batch.withColumn("resolved", F.lit(False)))
        name = f"{hashlib.sha256(stream.encode()).hexdigest()[:16]}-{batch_id:010d}"
        (decide(rows) if decide else rows).write.mode("overwrite").parquet(f"{self.path}/changes/{name}")

    def compact(self) -> None:
        """Write everything as a new base; the changes in it are dropped afterwards and would do no harm if they stayed."""
        base, changes = self._parts()
        if not changes:
            return
        number = int(base[0]) + 1 if base else 1
        self._read(base, changes).write.mode("overwrite").parquet(f"{self.path}/base/{number:010d}")
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for old in [f"{self.path}/changes/{c}" for c in changes] + [f"{self.path}/base/{b}" for b in base]:
            p = hadoop(old)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def watch_catalog(spark: SparkSession, source: str, schema: StructType, catalog_path: str, checkpoint: str, *, prepare=None, decide=None, files_per_batch: int | None = None,
                  every: str | None = None):
    """Start the stream: scan rows arriving as Parquet files are prepared, folded in and decided; nothing touches the files.

    Without ``every`` everything present is processed and the stream ends; otherwise it keeps running at that interval.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(source)
    if prepare:
        rows = prepare(rows)
    target = Catalog(spark, catalog_path)
    writer = run_metrics(rows, "scan").writeStream.foreachBatch(lambda b, i: target.fold(b, i, decide, checkpoint)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
