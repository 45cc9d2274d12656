"""Incremental chunk index of any number of repositories in one run."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparklode import model as M
from sparklode.functions import paths
from sparklode.functions.storage import materialize
from sparklode.operators import incremental as inc
from sparklode.operators.segment import chunk_files


@dataclass
class IndexResult:
    chunks: DataFrame
    hashes: DataFrame
    stats: DataFrame
    errors: DataFrame
    new_chunks: DataFrame
    changes: DataFrame
    gone: DataFrame
    vectors: DataFrame | None = None


def empty_index(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], M.CHUNKS), spark.createDataFrame([], M.HASHES)


def build_index(files: DataFrame, chunks: DataFrame | None = None,
                hashes: DataFrame | None = None, force: bool = False,
                exclude_tests: bool = True, repos: DataFrame | None = None,
                embed: Callable[[DataFrame], DataFrame] | None = None,
                vectors: DataFrame | None = None) -> IndexResult:
    """New state of the index; only changed files are chunked (and embedded).

    ``embed`` turns chunks into vectors (``incremental.embed`` or ``embed_hashing``
    with its parameters bound); with it the result holds the vectors of new chunks
    and, of the given ``vectors``, those of chunks that stay. Only repositories in
    ``repos`` (default: those with a file) can lose files.

    ``files``: repo_id, file_path, file_rel_path, length, content. The changes
    (keys and hashes, no content) are written out once: every result needs
    them, and their true size tells the planner whether the join that picks the
    changed contents can broadcast them.
    """
    empty = empty_index(files.sparkSession)
    chunks = empty[0] if chunks is None else chunks
    hashes = empty[1] if hashes is None else hashes
    listed = files.where(paths.indexable(F.col("file_rel_path"), "length", exclude_tests))
    changes = materialize(inc.detect_changes(listed, hashes, force))
    gone = materialize(inc.orphans(hashes, changes, repos))
    todo = listed.join(inc.to_index(changes).select(*inc.KEYS), inc.KEYS, "left_semi")
    new_chunks = materialize(chunk_files(todo))
    if embed is not None:
        fresh = embed(new_chunks)
        if vectors is not None:
            fresh = inc.kept_chunks(vectors, changes, gone).select(*fresh.columns).unionByName(
                fresh)
        vectors = fresh
    return IndexResult(
        inc.kept_chunks(chunks, changes, gone).unionByName(new_chunks),
        inc.new_hashes(hashes, changes, gone),
        inc.index_stats(changes, new_chunks, gone), inc.errors(changes), new_chunks,
        changes, gone, vectors)
