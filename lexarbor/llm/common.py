"""What the operators of this package share: staged tables and table access."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.staging import shared_dir, staged

__all__ = ["partitions", "release", "shared_dir", "staged", "staged_buckets", "table"]


def staged_buckets(df: DataFrame, label: str, column: str, n: int) -> DataFrame:
    """staged(), but written in n buckets of `column`, so that a join on it does not move these rows again.

    Buckets need a table in the catalogue; it is dropped when this Python process ends.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(n, column).option("path", path).saveAsTable(name)
    atexit.register(_drop, spark, name)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.table(name)


def _drop(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):  # the session may have been stopped before
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of rounds that are over; it acts on what the driver no longer refers to."""
    gc.collect()
    spark._jvm.System.gc()
