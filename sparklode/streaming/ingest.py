"""Continuous indexing: a stream of file rows keeps a stored index up to date."""

from pyspark.sql import DataFrame, functions as F

from sparklode.functions.storage import materialize
from sparklode.operators import incremental as inc
from sparklode.operators.topk import rank_rows
from sparklode.plans.upkeep import update_index
from sparklode.sources.buckets import BUCKETS


def ingest_batch(batch: DataFrame, base: str, exclude_tests: bool = True,
                 buckets: int = BUCKETS):
    """Merges the latest rows of files into the index under ``base``.

    ``batch``: repo_id, file_path, file_rel_path, length, content [, error, version, withdrawn].
    Of several rows of a file the one of highest version counts. A row withdraws its file if
    ``withdrawn`` says so; without that column a NULL content does, unless ``error`` tells
    why it is missing. Any other file without a readable content is an error row of the
    index and keeps its chunks.
    """
    if "version" in batch.columns:
        batch = rank_rows(batch, [F.desc("version")], 1, "r", within=inc.KEYS)
    gone = F.col("content").isNull()
    if "error" in batch.columns:
        gone = gone & F.col("error").isNull()
    if "withdrawn" in batch.columns:
        gone = F.coalesce("withdrawn", F.lit(False))
    batch = materialize(batch.withColumn("gone", gone))
    return update_index(batch.where("NOT gone"), base, listing=False, buckets=buckets,
                        exclude_tests=exclude_tests, withdrawn=batch.where("gone"))


def start_ingest(files: DataFrame, base: str, checkpoint: str, exclude_tests: bool = True,
                 buckets: int = BUCKETS, **trigger):
    """Starts a query that merges each micro-batch of ``files`` (see ``ingest_batch``).

    A batch reads the hashes of the buckets of its files and writes the buckets whose files
    changed; a batch replayed after a failure finds the same hashes and writes nothing.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, base, exclude_tests, buckets)

    return (files.writeStream.foreachBatch(merge)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
            .start())
