"""Versioned chunk snapshots: written whole, then switched to."""

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


class NoSnapshot(LookupError):
    """Nothing was published under this path yet."""


SKEW_ROWS_PER_FILE, FILES_PER_PARTITION = 1_000_000, 16


def write_snapshot(df: DataFrame, base: str, partition: str = "repo_id") -> str:
    """Writes a new version under ``base`` and returns its path.

    Nothing of an earlier version is touched, so readers keep a whole index
    until ``publish``. A repository is dealt to ``FILES_PER_PARTITION`` tasks at most,
    so a large one is written by several and a small one does not get a file of
    every task. The schema is stored beside the data.
    """
    spark = df.sparkSession
    path = f"{base}/v{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
    rest = [c for c in df.columns if c != partition]
    part = F.pmod(F.hash(*rest), F.lit(FILES_PER_PARTITION)) if rest else F.lit(0)
    (df.repartition(F.col(partition), part).write.partitionBy(partition)
     .option("maxRecordsPerFile", SKEW_ROWS_PER_FILE).parquet(path))
    spark.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1).write.parquet(
        f"{path}-schema")
    return path


def publish(spark: SparkSession, base: str, path: str) -> None:
    """Records ``path`` as the current version (an append, never a rewrite)."""
    spark.range(1).select(
        F.lit(path).alias("path"), F.current_timestamp().alias("at")
    ).coalesce(1).write.mode("append").parquet(f"{base}/versions_log")


def latest_version(spark: SparkSession, base: str) -> str:
    """The path that was published last."""
    try:
        log = spark.read.parquet(f"{base}/versions_log")
    except AnalysisException as e:
        raise NoSnapshot(base) from e
    return log.orderBy(F.desc("at"), F.desc("path")).first()["path"]


def current_snapshot(spark: SparkSession, base: str) -> DataFrame:
    path = latest_version(spark, base)
    schema = spark.read.parquet(f"{path}-schema").first()["schema"]
    # Without it the type of the partition column would be guessed from its values.
    return spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(path)
