"""File and document segmentation into chunks of at most 300 tokens."""

from pyspark.sql import DataFrame, Window, functions as F

from sparklode import model as M
from sparklode.functions import lex, paths
from sparklode.functions.storage import materialize
from sparklode.functions import text as X
from sparklode.operators.segment_js import js_chunks
from sparklode.operators.segment_python import python_chunks


def chunk_files(files: DataFrame, cap: int = M.CHUNK_TOKEN_CAP) -> DataFrame:
    """One row per function or class: the chunk table of ``files``.

    ``files``: repo_id, file_path, file_rel_path, content. Unknown extensions
    give no rows. Source beyond ``cap`` tokens is cut; name, calls and
    docstring come from the whole definition. Contents are read and masked once and
    written to the shared folder: definitions are found in the masked texts alone, and
    one join brings them back to their file.
    """
    f = materialize(masked_files(files))
    chunks = python_chunks(f.where(F.col("lang") == "python")).unionByName(
        js_chunks(f.where(F.col("lang").isin("javascript", "typescript", "tsx"))))
    return finish_chunks(chunks, cap)


def masked_files(files: DataFrame) -> DataFrame:
    """repo_id, file_path, file_rel_path, lang, text, masked of files in a known language.

    ``row`` numbers the files, so that windows and joins compare one number; it holds
    within one stored table only.
    """
    lang = paths.language("file_path")
    return (files.select("repo_id", "file_path", "file_rel_path", lang.alias("lang"),
                         F.col("content").cast("string").alias("text"))
            .where(F.col("lang").isNotNull()).withColumns({"masked": lex.mask(), "row": F.monotonically_increasing_id()}))


def finish_chunks(chunks: DataFrame, cap: int = M.CHUNK_TOKEN_CAP) -> DataFrame:
    """Token cap, chunk key and search text."""
    key = paths.chunk_key("file_path", "start_line")
    out = chunks.withColumn("n", X.token_count("source")).select(
        "repo_id",
        F.when(F.col("ordinal") > 0, F.concat_ws("#", key, F.col("ordinal").cast("string")))
        .otherwise(key).alias("chunk_key"),
        "file_path", "file_rel_path", "node_type", "name",
        F.when(F.col("n") > cap, X.first_tokens("source", cap))
        .otherwise(F.col("source")).alias("source"),
        F.col("start_line").cast("int").alias("start_line"),
        F.col("end_line").cast("int").alias("end_line"),
        F.least("n", F.lit(cap)).alias("token_count"), "calls", "docstring",
        "parent_class", (F.col("n") > cap).alias("is_truncated"))
    return out.withColumn("search_text", X.search_text())


def segment_documents(docs: DataFrame, cap: int = M.CHUNK_TOKEN_CAP) -> DataFrame:
    """Prose in segments of at most ``cap`` tokens; nothing is dropped.

    ``docs``: doc_id, text. Lines (long ones cut into pieces) of at most cap/2
    tokens are numbered by the tokens before them; pieces in the same half-cap
    step form a segment, so none exceeds the cap. The running sum and the grouping
    share one shuffle by document and are linear in its length. Result: doc_id,
    segment, start_line, end_line, token_count, source.
    """
    half = cap // 2
    piece = rf"(?:\s*(?:{X.TOKEN})){{1,{half}}}\s*"
    pieces = F.flatten(F.transform(F.split("text", "\n"), lambda line, i: F.transform(
        F.regexp_extract_all(line, F.lit(f"({piece})"), F.lit(1)),
        lambda p: F.struct((i + 1).alias("line"), p.alias("text"),
                           X.token_count(p).alias("n")))))
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = numbered.select("doc_id", "row",
                           F.posexplode(pieces).alias("i", "p")).select("doc_id", "row", "i", "p.*")
    before = (Window.partitionBy("row").orderBy("i")
              .rowsBetween(Window.unboundedPreceding, -1))
    step = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / half).cast("int")
    parts = rows.withColumn("segment", step).groupBy("row", "segment").agg(
        F.first("doc_id").alias("doc_id"),
        F.array_sort(F.collect_list(F.struct("i", "line", "text", "n"))).alias("part"))
    part = F.col("part")
    return parts.select(
        "doc_id", "segment", F.get(part, F.lit(0))["line"].alias("start_line"),
        F.element_at(part, -1)["line"].alias("end_line"),
        F.aggregate(part, F.lit(0), lambda a, p: a + p["n"]).alias("token_count"),
        F.array_join(F.transform(part, lambda p, i: F.concat(F.when(
            (i > 0) & (F.get(part, i - 1)["line"] != p["line"]), "\n").otherwise(""),
            p["text"])), "").alias("source"))
