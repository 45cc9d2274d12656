"""Hybrid retrieval as one plan per bounded question block."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sparklode import model as M
from sparklode.operators import search
from sparklode.operators.topk import question_blocks


def retrieve(queries: DataFrame, chunks: DataFrame, vectors: DataFrame,
             n: int = M.RETRIEVE_N, k: int = M.RETURN_N,
             expand: int = M.EXPAND_N) -> DataFrame:
    """Ranked chunks for every question: k fused hits plus up to ``expand`` calls.

    ``queries``: query_id, question, embedding [, repo_id]. A chunk is named by
    (repo_id, chunk_key); a question with a repo_id gets chunks of that repository only.
    """
    parts = [_block(b, chunks, vectors, n, k, expand)
             for b in question_blocks(queries, "question")]
    return reduce(DataFrame.unionByName, parts)


def _block(queries, chunks, vectors, n, k, expand):
    keys = search.keys_of(chunks)
    if keys != search.keys_of(vectors):
        raise ValueError("chunks and vectors must both have a repo_id, or neither")
    fused = search.rrf([
        (search.vector_topk(queries.where(F.col("embedding").isNotNull()),
                            vectors, n), "vrank"),
        (search.keyword_topk(queries, chunks, n), "krank")])
    # A block holds at most BLOCK_ROWS questions and 2n fused hits for each, so
    # both broadcasts are bounded; they keep chunk text out of any shuffle.
    facts = chunks.select(*keys, "name", "file_path", "calls", "docstring")
    hits = facts.join(F.broadcast(fused), keys)
    top = search.topk_cut(search.rerank(hits, queries), k)
    ranked = search.expand_calls(top, chunks, expand)
    shown = chunks.select(*keys, "file_path", "file_rel_path", "name",
                          "node_type", "parent_class", "start_line", "end_line",
                          "calls", "docstring", "source", "is_truncated")
    return shown.join(F.broadcast(ranked), keys)
