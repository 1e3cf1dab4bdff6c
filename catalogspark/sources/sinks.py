"""Writers: append-only facts and the duplicate report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_facts(df: DataFrame, path: str, run: str) -> None:
    """Append decisions or journal rows of one run; runs are partitions, so reading or dropping one touches nothing else."""
    (df.withColumn("run", F.lit(run)).withColumn("logged_at", F.current_timestamp())
     .write.mode("append").partitionBy("run").parquet(path))


def dupe_report_csv(report: DataFrame, path: str) -> None:
    report.write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
