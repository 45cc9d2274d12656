"""Metadata of stored chunks, without texts and vectors."""

from pyspark.sql import DataFrame, functions as F

from sparklode.functions import paths

COLUMNS = ["repo_id", "chunk_key", "file_path", "file_rel_path", "node_type", "name",
           "parent_class", "calls", "docstring", "start_line", "end_line"]


def scan_metadata(chunks: DataFrame, path_prefix: str | None = None) -> DataFrame:
    """The metadata columns that ``chunks`` has, of all chunks or those under a path.

    Only these columns are selected, so a Parquet scan reads no text and no vector.
    """
    found = chunks.select(*[c for c in COLUMNS if c in chunks.columns])
    if not path_prefix:
        return found
    return found.where(paths.under_prefix(F.col("file_rel_path"), path_prefix))
