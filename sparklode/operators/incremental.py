"""Change detection and bookkeeping of an incremental chunk index.

Joins here carry keys and hashes only; file contents stay where they are until
the changed files are known.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from sparklode import model as M

KEYS = ["repo_id", "file_path"]


def content_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", F.sha2("content", 256))


def detect_changes(files: DataFrame, hashes: DataFrame,
                   force: bool = False) -> DataFrame:
    """repo_id, file_path, sha256, status, is_readable.

    ``status`` is new, changed or unchanged; with ``force`` a known file counts
    as changed. A file that could not be read (NULL content, an ``error`` of the
    scan) or is no valid UTF-8 is listed, but not readable.
    """
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    if "error" in files.columns:
        valid = valid & F.col("error").isNull()
    now = content_hash(files).select(
        *KEYS, "sha256", F.coalesce(valid, F.lit(False)).alias("is_readable"),
        (F.col("error") if "error" in files.columns else F.lit(None).cast("string")).alias("why"),
        F.col("content").isNull().alias("is_missing"))
    old = hashes.select(*KEYS, F.col("sha256").alias("old_sha256"))
    same = F.coalesce((F.col("sha256") == F.col("old_sha256")) & F.lit(not force), F.lit(False))
    status = (F.when(F.col("old_sha256").isNull(), "new")
              .when(same, "unchanged").otherwise("changed"))
    return now.join(old, KEYS, "left").select(
        *KEYS, "sha256", status.alias("status"), "is_readable", "why", "is_missing")


def to_index(changes: DataFrame) -> DataFrame:
    return changes.where((F.col("status") != "unchanged") & F.col("is_readable"))


def orphans(hashes: DataFrame, files: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Stored paths of listed repositories that are no longer listed.

    ``repos``: repo_id of the repositories that were listed; without it, those with
    a file. A repository that has lost all its files must be named there.
    """
    listed = (files if repos is None else repos).select("repo_id").distinct()
    return (hashes.join(listed, "repo_id", "left_semi")
            .join(files.select(*KEYS), KEYS, "left_anti").select(*KEYS))


def kept_chunks(chunks: DataFrame, changes: DataFrame, gone: DataFrame) -> DataFrame:
    """Old chunks of neither re-indexed nor orphaned files."""
    stale = to_index(changes).select(*KEYS).unionByName(gone)
    return chunks.join(stale, KEYS, "left_anti")


def new_hashes(hashes: DataFrame, changes: DataFrame, gone: DataFrame) -> DataFrame:
    """Hash table after the run: from files, so files without chunks are in it.

    A file that failed keeps its earlier hash and is tried again next time.
    """
    done = to_index(changes).select(*KEYS, "sha256")
    stale = done.select(*KEYS).unionByName(gone)
    return hashes.select(*KEYS, "sha256").join(stale, KEYS, "left_anti").unionByName(done)


def errors(changes: DataFrame) -> DataFrame:
    bad = changes.where((F.col("status") != "unchanged") & ~F.col("is_readable"))
    reason = F.coalesce("why", F.when(F.col("is_missing"), "content is missing")
                        .otherwise("content is not UTF-8"))
    return bad.select(*KEYS, F.concat("file_path", F.lit(": "), reason).alias("error"))


def index_stats(changes: DataFrame, new_chunks: DataFrame,
                gone: DataFrame) -> DataFrame:
    """One row per repository: total_files, indexed, skipped, total_chunks, ..."""
    fresh = F.col("status") != "unchanged"
    seen = changes.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(fresh & F.col("is_readable")).alias("indexed"),
        F.count_if(~fresh).alias("skipped"),
        F.count_if(fresh & ~F.col("is_readable")).alias("errors"))
    made = new_chunks.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_chunks"))
    lost = gone.groupBy("repo_id").agg(F.count(F.lit(1)).alias("cleaned"))
    out = seen.join(made, "repo_id", "left").join(lost, "repo_id", "full")
    return out.select("repo_id", *[
        F.coalesce(c, F.lit(0)).alias(c) for c in
        ("total_files", "indexed", "skipped", "total_chunks", "cleaned", "errors")])


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]],
          batch: int = M.EMBED_BATCH) -> DataFrame:
    """[repo_id, file_path,] chunk_key, embedding: texts go to ``embedder`` in batches,
    order kept."""
    keys = [c for c in (*KEYS, "chunk_key") if c in chunks.columns]

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at:at + batch]
                yield part[keys].assign(embedding=embedder(part["search_text"].tolist()))
    return chunks.select(*keys, "search_text").mapInPandas(
        run, "".join(f"{k} string, " for k in keys) + "embedding array<float>")


def embed_hashing(chunks: DataFrame, dims: int = 256) -> DataFrame:
    """Built-in local embedder: hashed word counts of unit length, JVM-side."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array
    words = RegexTokenizer(inputCol="search_text", outputCol="words",
                           pattern=r"\w+", gaps=False)
    counts = HashingTF(numFeatures=dims, inputCol="words", outputCol="counts")
    unit = Normalizer(inputCol="counts", outputCol="unit")
    keys = [c for c in (*KEYS, "chunk_key") if c in chunks.columns]
    out = unit.transform(counts.transform(words.transform(
        chunks.select(*keys, "search_text"))))
    return out.select(*keys, vector_to_array("unit", "float32").alias("embedding"))
