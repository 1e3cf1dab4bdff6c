"""Helpers of the corpus operators: reading, shared-folder tables, Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir, hadoop_path

BATCH_ROWS = 400


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a Python worker holds a few hundred texts at a time however long they are."""
    for key, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str, used: list[str] | None = None) -> DataFrame:
    """The rows as a table in the folder that every executor shares: computed once, readable after the loss of executors. Its path is noted in ``used``."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if used is not None:
        used.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, used: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    while used:
        where, fs = hadoop_path(spark, used.pop())
        fs.delete(where, True)


def shuffle_parts(spark: SparkSession) -> int:
    """Partitions of hand-made buckets: the session's setting, which is sized to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def id_key(id_col: str) -> Column:
    """The id as a join key that is never null."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and in whatever lambda the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_blocks(values: Column) -> Column:
    """The values in blocks of about the square root of their number."""
    def cut(v: Column) -> Column:
        side = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / side).cast("int")), lambda k: F.slice(v, k * side + 1, side))

    return bound(values, cut)


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` that no output column replaces (names compared without case, as Spark does)."""
    low = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in low]


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Free memory of a Python worker goes back to the system at the end of a task: a worker waits for its next task for as long as a minute."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc keeps it
    if trim is not None:
        trim(0)


def schema_with(df: DataFrame, keep: list[str], extra: str) -> StructType:
    """The kept columns' types followed by the fields of a DDL string."""
    out = StructType([f for f in df.schema.fields if f.name in keep])
    for f in StructType.fromDDL(extra).fields:
        out = out.add(f)
    return out
