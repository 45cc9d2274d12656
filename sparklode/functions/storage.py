"""Where intermediate tables go."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    In local mode, where all threads see one disk, a temporary folder will do; a
    cluster without a named folder is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sparklode-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder.

    Unlike executor-local caching this survives lost executors, and the file
    sizes give the planner true statistics for what follows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparklode/{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    # Later plans may read the table at any time; it goes with the application.
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def graph_facts(chunks: DataFrame) -> DataFrame:
    """The narrow part of a chunk table that structure operators read, stored.

    Structure plans read these columns up to eight times; without texts the
    table is a small part of the corpus.
    """
    return materialize(chunks.select(
        "repo_id", "chunk_key", "file_path", "file_rel_path", "node_type", "name",
        "start_line", "end_line", "calls"))
