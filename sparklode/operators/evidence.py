"""Orientation evidence: one text per repository about its selected chunks."""

from pyspark.sql import DataFrame, functions as F

from sparklode import model as M
from sparklode.functions.storage import materialize


def preview(source, lines: int = M.PREVIEW_LINES):
    """First lines of a chunk, and how many more there are."""
    rows = F.split(F.regexp_replace(source, r"\n\z", ""), "\n")
    head = F.concat_ws("\n", F.slice(rows, 1, lines))
    more = F.format_string("\n... (%d more lines)", F.size(rows) - lines)
    return F.when(F.size(rows) > lines, F.concat(head, more)).otherwise(head)


def tour_evidence(selected: DataFrame, top: DataFrame, chunks: DataFrame,
                  scope: str = "full repo") -> DataFrame:
    """repo_id, evidence.

    ``selected``: repo_id, pos, chunk_key (a few per repository);
    ``top``: repo_id, rank, name, file_rel_path, inbound.
    The selection is written out first: its true size then decides whether the
    join with the chunk table broadcasts it, which spares shuffling sources.
    """
    picked = materialize(selected.select("repo_id", "pos", "chunk_key"))
    shown = chunks.select("repo_id", "chunk_key", "name", "node_type", "docstring",
                          "file_rel_path", "start_line", "end_line", "source")
    block = F.concat_ws(
        "\n",
        F.format_string("\n[%d] %s (%s) — %s:%d-%d", "pos", "name", "node_type",
                        "file_rel_path", "start_line", "end_line"),
        F.when(F.col("docstring") != "", F.concat(
            F.lit("Docstring: "),
            F.substring("docstring", 1, M.PREVIEW_DOC_CHARS))),
        preview(F.col("source")), F.lit("---"))
    blocks = (shown.join(picked, ["repo_id", "chunk_key"])
              .groupBy("repo_id")
              .agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("t")))).alias("b"),
                   F.count_distinct("file_rel_path").alias("files")))
    line = F.format_string("  %s (%s) — called by %d functions", "name",
                           "file_rel_path", "inbound")
    tops = top.groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))).alias("f"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("REPO: "), "repo_id"), F.lit(f"SCOPE: {scope}"),
        F.format_string("FILES: %d", "files"), F.lit(""),
        F.lit("TOP FUNCTIONS BY INBOUND REFERENCES:"),
        F.transform("f", lambda x: x["t"]), F.lit(""), F.lit("SELECTED CHUNKS:"),
        F.transform("b", lambda x: x["t"]))
    return blocks.join(tops, "repo_id", "left").select(
        "repo_id", text.alias("evidence"))
