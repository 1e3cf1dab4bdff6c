"""Row numbers that survive hot groups, and small helpers around partitioning."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def spread(df: DataFrame) -> DataFrame:
    """More partitions for CPU-heavy work when the input has fewer than the cluster has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stage(df: DataFrame, name: str) -> DataFrame:
    """Count the rows a stage hands on. Conditions on its results stay above it instead of being rewritten in terms of its inputs,
    which for long evidence expressions would repeat them for every condition."""
    return df.observe(f"{name}-{uuid.uuid4().hex[:8]}", F.count(F.lit(1)).alias("rows"))


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str = "rn") -> DataFrame:
    """``row_number()`` per ``keys`` (none = over everything).

    A window would sort each group in one task. The rows are therefore range-partitioned on keys and order, numbered inside each
    range, and shifted by the sizes of the ranges before it. The order must be total.
    """
    # written out once: partition numbers must not change between the two uses below
    ranged = written(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*keys, "_part").count()
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    local = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys] + [F.col("l._part") == F.col("s._part")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = local.alias("l").join(shift.alias("s"), cond)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._rn") + F.col("s._shift")).cast("int").alias(out))


def in_batches(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Number rows into request groups of ``size``; each group is one row holding its items in order."""
    n = numbered(df, [], order, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size))
    items = F.array_sort(F.collect_list(F.struct(F.col("_n").alias("pos"), *[F.col(c) for c in df.columns])))
    return n.groupBy("batch").agg(items.alias("items"))
