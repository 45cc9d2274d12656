"""A stored index in hash buckets: a run writes the buckets that it touches and no others.

Every part of an index (chunks, hashes, vectors, ...) is dealt by its file, (repo_id, file_path),
to the same numbered buckets, so a repository of any size spreads over all of them and the rows
of one file lie in one bucket of each part. Under ``base``:

    data/<version>/<part>/bucket=<n>/   the rows of a bucket; written once, never changed
    manifests/<version>/                for each part and bucket the folder that holds it
    versions_log/                       one row per version, appended last

A reader takes the newest row of the log, and with it one manifest for all parts: chunks of one
version are never seen with hashes of another. A run that dies before its row is appended has
changed nothing. One run at a time may write.
"""

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sparklode.sources.snapshots import latest_version, publish

BUCKETS = 64
ROWS_PER_FILE = 1_000_000
NO_ROWS = -1   # the entry that gives the schema of a part, also of one without rows
MANIFEST = T.StructType([
    T.StructField("part", T.StringType()), T.StructField("bucket", T.IntegerType()),
    T.StructField("path", T.StringType()), T.StructField("rows", T.LongType()),
    T.StructField("schema", T.StringType()), T.StructField("buckets", T.IntegerType()),
    T.StructField("version", T.StringType())])


def bucket_of(buckets: int) -> Column:
    """The bucket of a row with repo_id and file_path; NULL counts as empty."""
    key = F.concat_ws("/", F.coalesce("repo_id", F.lit("")), F.coalesce("file_path", F.lit("")))
    return (F.conv(F.left(F.sha2(key, 256), F.lit(8)), 16, 10).cast("long")
            % buckets).cast("int")


def buckets_of(rows: DataFrame, buckets: int) -> list[int]:
    """The distinct buckets of rows, never more than there are buckets."""
    found = rows.select(bucket_of(buckets).alias("b")).distinct().collect()
    return sorted(r["b"] for r in found)


@dataclass
class StoredIndex:
    """One version of a stored index; its manifest has a row per part and bucket."""
    spark: SparkSession
    base: str
    buckets: int
    entries: list
    version: str | None = None

    def read(self, part: str, only: list[int] | None = None) -> DataFrame | None:
        """The rows of a part, or of some of its buckets; None if it was never written."""
        mine = [e for e in self.entries if e["part"] == part]
        if not mine:
            return None
        schema = T.StructType.fromJson(json.loads(mine[0]["schema"]))
        paths = [e["path"] for e in mine
                 if e["path"] and (only is None or e["bucket"] in set(only))]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def replace(self, parts: dict[str, tuple[DataFrame, list[int] | None]]) -> "StoredIndex":
        """Writes the touched buckets (None: all) of the given parts, then switches.

        ``parts``: the rows and the touched buckets of each part. Rows of other buckets are left
        out; a part that is not given, and every bucket that is not touched, stays in the
        folder where it is. A bucket is written by one task, so the number of buckets is to be
        chosen by what a task can hold.
        """
        version = f"v{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
        entries = [e for e in self.entries if e["part"] not in parts]
        for part, (rows, touched) in parts.items():
            path, schema = f"{self.base}/data/{version}/{part}", rows.drop("bucket").schema
            written = set(range(self.buckets) if touched is None else touched)
            dealt = rows if "bucket" in rows.columns else rows.withColumn(
                "bucket", bucket_of(self.buckets))
            dealt = dealt.where(F.col("bucket").isin(sorted(written)))
            (dealt.repartition(max(1, len(written)), "bucket").write.partitionBy("bucket")
             .option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path))
            counts = self.spark.read.schema(T.StructType([
                *schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path).groupBy(
                "bucket").agg(F.count(F.lit(1)).alias("n")).collect()
            about = {"schema": schema.json(), "part": part, "buckets": self.buckets,
                     "version": version}
            entries += [e for e in self.entries
                        if e["part"] == part and e["bucket"] not in written | {NO_ROWS}]
            entries += [{**about, "bucket": r["bucket"], "rows": r["n"],
                         "path": f"{path}/bucket={r['bucket']}"} for r in counts]
            entries.append({**about, "bucket": NO_ROWS, "rows": 0, "path": None})
        manifest = f"{self.base}/manifests/{version}"
        self.spark.createDataFrame([tuple(e[n] for n in MANIFEST.names) for e in entries],
                                   MANIFEST).coalesce(1).write.parquet(manifest)
        publish(self.spark, self.base, manifest)
        return StoredIndex(self.spark, self.base, self.buckets, entries, version)


def new_index(spark: SparkSession, base: str, buckets: int = BUCKETS) -> StoredIndex:
    return StoredIndex(spark, base, buckets, [])


def open_index(spark: SparkSession, base: str) -> StoredIndex:
    """The newest version under ``base``; ``NoSnapshot`` if there is none."""
    manifest = latest_version(spark, base)
    entries = [r.asDict() for r in spark.read.schema(MANIFEST).parquet(manifest).collect()]
    return StoredIndex(spark, base, entries[0]["buckets"], entries, manifest.rsplit("/", 1)[-1])
