"""Helpers of the pipeline operators: shared tables, bounded slices of Arrow batches."""

import ctypes
import gc
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparklode.functions.storage import shared_dir

SLICE_BYTES = 4 << 20
FILE_BYTES = 8 << 20


def _merges(spark: SparkSession) -> bool:
    """Whether Spark merges small partitions behind a shuffle."""
    return "false" not in (spark.conf.get("spark.sql.adaptive.enabled").lower(),
                           spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled").lower())


def text_bytes(df: DataFrame, column: str = "text") -> int | None:
    """Bytes of all texts; None where Spark merges partitions, since nobody asks then."""
    return None if _merges(df.sparkSession) else df.agg(F.sum(octets(column))).first()[0] or 0


def spread(df: DataFrame, size: int | None) -> DataFrame:
    """``df`` in about as many partitions as ``size`` bytes need, if shuffles leave many more.

    Spark merges small partitions behind a shuffle unless the session forbids it; then a table
    of a few KB is written as one file for each of them. The files are dealt after the work,
    which keeps all its tasks. On a local disk without Hadoop's native library every file
    starts several child processes of the executor's JVM, each with all its memory for a moment.
    """
    if size is None or _merges(df.sparkSession):
        return df
    conf = df.sparkSession.conf
    files = max(1, -(-size // FILE_BYTES))
    few = 2 * files <= int(conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(files) if few else df


def store(df: DataFrame, size: int | None = None) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder.

    ``size``: about how many bytes it has at most, if that is known; see ``spread``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}"
    spread(df, size).write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored_bytes(stored: DataFrame) -> int:
    """Bytes of a stored table, from its files."""
    spark = stored.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stored.stored_at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(
        path).getLength()


def drop(df: DataFrame) -> None:
    """Deletes a table of ``store`` that no later plan reads any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def octets(column: str = "text"):
    """UTF-8 bytes of a text, 0 for NULL."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array, and n + 1 offsets; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type)
                                  or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(
        column.type) else column.cast(kind)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0]:at[-1]]
    return flat, at - at[0]


def slices(batches, column: int, limit: int = SLICE_BYTES):
    """Arrow batches cut to at most ``limit`` bytes of text each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0)
        total = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


_KEPT: dict[str, dict] = {}


def kept(kind: str) -> dict:
    """What tasks of one kind keep in a Python worker for the next one of their kind.

    To be reached by this function only: a task takes a copy of any other module's dict that
    it names, and emptying the copy frees nothing.
    """
    return _KEPT.setdefault(kind, {})


def begin(kind: str | None) -> None:
    """Frees what tasks of other kinds have kept in this worker."""
    others = [k for k in _KEPT if k != kind]
    for k in others:
        del _KEPT[k]
    if others:
        give_back()


def give_back() -> None:
    """Unused memory goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def tidy(run, kind: str | None = None):
    """A function for mapInArrow that frees what other kinds of tasks have kept, and at its end
    gives its own memory back but for what it keeps under ``kind``.

    Python workers outlive their task, and the next one may be of another kind.
    """
    @wraps(run)
    def whole(batches):
        begin(kind)
        try:
            yield from run(batches)
        finally:
            give_back()
    return whole


def encoded(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; NULL is empty."""
    flat, at = text_buffer(column)
    whole = flat.tobytes()
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
