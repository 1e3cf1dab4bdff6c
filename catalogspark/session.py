"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


BATCH_ROWS = 1000


def build_session(master: str | None = None, name: str = "catalogspark", **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; AQE sizes and splits the shuffles at run time."""
    b = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # long evidence expressions are built from thousands of columns; recording the call site of each takes longer than planning
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Set the session options the plans rely on."""
    # metadata times are zone-less; a fixed zone makes epoch values read the same everywhere
    # evidence lists are computed once per row; pruning their fields through explode would compute them once per field
    # a Python worker holds one batch of vectors and of their scores as objects; a task with four UDFs has four workers
    for key, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.optimizer.expression.nestedPruning.enabled", "false"), ("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's setting, or a scratch folder in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return configured


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as Spark itself reaches them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, readable after the loss of executors."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that are needed for a while: computed once, readable after the loss of executors, deleted at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        where, fs = hadoop_path(self.spark, self.path)
        fs.delete(where, True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
