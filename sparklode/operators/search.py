"""Retrieval operators: vector and keyword top-n, fusion, re-rank, expansion.

``queries``  query_id, question [, embedding] [, repo_id]
``chunks``   chunk_key, name, file_path, calls, docstring, search_text, source ...
A ``repo_id`` on the queries restricts each question to its own repository.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparklode import model as M
from sparklode.functions import paths
from sparklode.functions.text import question_tokens
from sparklode.operators.postings import keyword_topk_lists
from sparklode.operators.topk import (
    PartialTopN, joined_keys, question_blocks, rank_rows, repo_mask)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def keys_of(df: DataFrame) -> list[str]:
    """What names a chunk: its key within its repository, if there are repositories."""
    return [c for c in ("repo_id", "chunk_key") if c in df.columns]


def _partial_schema(queries: DataFrame, keys: list[str], score: str) -> str:
    kind = queries.schema["query_id"].dataType.simpleString()
    return f"query_id {kind}, " + "".join(f"{k} string, " for k in keys) + f"{score} double"


def _need_repos(queries: DataFrame, *tables: DataFrame) -> bool:
    """Whether each question is bound to its own repository."""
    scoped = "repo_id" in queries.columns
    if scoped and any("repo_id" not in t.columns for t in tables):
        raise ValueError("questions with a repo_id need chunks and vectors with one")
    return scoped


# --- vector search ---------------------------------------------------------

def vector_errors(vectors: DataFrame, dim: int, metric: str = "l2") -> DataFrame:
    """Vectors that no search can rank, with the reason: repo_id, chunk_key, error.

    ``vector_topk`` leaves exactly these out; the index run reports them.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    length = F.size(F.coalesce("embedding", F.array().cast("array<float>")))
    reason = (F.when(F.col("embedding").isNull(), "no embedding")
              .when(length != dim, F.concat(F.lit("length "), length.cast("string"),
                                            F.lit(f", not {dim}")))
              .when(bad, "NULL or NaN element"))
    if metric == "cosine":
        reason = reason.when(F.forall("embedding", lambda x: x == 0), "zero vector")
    return vectors.select(*keys_of(vectors), reason.alias("error")).where("error IS NOT NULL")


def vector_topk(queries: DataFrame, vectors: DataFrame, n: int = M.RETRIEVE_N,
                metric: str = "l2") -> DataFrame:
    """Exact n nearest chunks per question: squared L2, or cosine distance.

    ``vectors``: chunk_key, embedding [, repo_id]. Result: query_id, [repo_id,]
    chunk_key, distance, vrank. Ties (distance to 9 places) go to the smaller key.
    Rows of ``vector_errors`` take no part; questions of unequal length are refused.
    """
    _need_repos(queries, vectors)
    keys = keys_of(vectors)
    parts = [_vector_block(b, vectors, n, metric, keys) for b in question_blocks(queries)]
    return rank_rows(_union(parts), ["distance", *reversed(keys)], n, "vrank")


def _vector_block(block, vectors, n, metric, keys):
    scoped = "repo_id" in block.columns
    rows = block.select("query_id", "embedding",
                        *(["repo_id"] if scoped else [])).toArrow()
    ids = rows["query_id"].to_pylist()
    q_repo = rows["repo_id"].to_pylist() if scoped else None
    asked = rows["embedding"].to_pylist()
    if len({len(v) for v in asked}) > 1:
        raise ValueError("the questions' vectors differ in length")
    q = np.asarray(asked, dtype=np.float64)
    if q.size == 0:
        q = np.zeros((len(ids), 0))
    names = ["query_id", *keys, "distance"]
    shared = block.sparkSession.sparkContext.broadcast((ids, q, q_repo))

    def scan(batches):
        ids, q, q_repo = shared.value
        best = PartialTopN(len(ids), n)
        dim = q.shape[1]
        q_sq = (q * q).sum(axis=1)[:, None]
        step = best.rows_per_step()
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                flat = b.column(len(keys)).flatten().to_numpy(zero_copy_only=False)
                v = flat.astype(np.float64).reshape(-1, dim)
                v_sq = (v * v).sum(axis=1)[None, :]
                dot = q @ v.T
                if metric == "l2":
                    d = q_sq + v_sq - 2.0 * dot
                else:
                    d = 1.0 - dot / np.sqrt(q_sq * v_sq)
                d = np.round(np.maximum(d, 0.0), 9) + 0.0
                if q_repo is not None:
                    d[~repo_mask(q_repo, b.column(0))] = np.inf
                best.push(d, joined_keys(b, len(keys)))
        if ids:
            yield best.table(ids, names)

    return usable_vectors(vectors, q.shape[1], metric).select(*keys, "embedding").mapInArrow(
        scan, _partial_schema(block, keys, "distance"))


def usable_vectors(vectors: DataFrame, dim: int, metric: str = "l2") -> DataFrame:
    """The vectors without the rows that ``vector_errors`` reports."""
    fine = (F.size("embedding") == dim) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    if metric == "cosine":
        fine = fine & F.exists("embedding", lambda x: x != 0)
    return vectors.where(fine)


# --- keyword search --------------------------------------------------------

def keyword_topk(queries: DataFrame, chunks: DataFrame,
                 n: int = M.RETRIEVE_N) -> DataFrame:
    """Best n chunks per question by number of tokens contained as substrings.

    Tokens are lower case, documents are not; repeated tokens count again.
    Result: query_id, [repo_id,] chunk_key, matches, krank.
    """
    _need_repos(queries, chunks)
    keys = keys_of(chunks)
    parts = [_keyword_block(b, chunks, n, keys)
             for b in question_blocks(queries, "question")]
    ranked = rank_rows(_union(parts), ["neg", *reversed(keys)], n, "krank")
    return ranked.select("query_id", *keys,
                         (-F.col("neg")).cast("long").alias("matches"), "krank")


def _keyword_block(block, chunks, n, keys):
    scoped = "repo_id" in block.columns
    rows = block.select("query_id", question_tokens("question").alias("tokens"),
                        *(["repo_id"] if scoped else [])).toArrow()
    ids = rows["query_id"].to_pylist()
    q_repo = rows["repo_id"].to_pylist() if scoped else None
    uses: dict[str, dict[int, int]] = {}
    for q, tokens in enumerate(rows["tokens"].to_pylist()):
        for t in tokens or []:
            per = uses.setdefault(t, {})
            per[q] = per.get(q, 0) + 1
    tokens = list(uses)
    asked = [(np.array(list(per)), np.array(list(per.values()), np.int32)[:, None])
             for per in uses.values()]
    names = ["query_id", *keys, "neg"]
    shared = block.sparkSession.sparkContext.broadcast((ids, tokens, asked, q_repo))

    def scan(batches):
        ids, tokens, asked, q_repo = shared.value
        best = PartialTopN(len(ids), n)
        contained = _substring_finder(tokens)
        step = min(best.rows_per_step(), max(256, 64_000_000 // max(1, len(tokens))))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                found = np.zeros((len(tokens), b.num_rows), dtype=bool)
                for j, text in enumerate(b.column(len(keys)).to_pylist()):
                    found[contained(text), j] = True
                counts = np.zeros((len(ids), b.num_rows), dtype=np.int32)
                for t in np.nonzero(found.any(axis=1))[0]:
                    qs, times = asked[t]
                    counts[qs] += times * found[t][None, :]
                score = np.where(counts > 0, -counts.astype(np.float64), np.inf)
                if q_repo is not None:
                    score[~repo_mask(q_repo, b.column(0))] = np.inf
                best.push(score, joined_keys(b, len(keys)))
        if ids:
            yield best.table(ids, names)

    usable = chunks.where(F.col("search_text").isNotNull())
    return usable.select(*keys, "search_text").mapInArrow(
        scan, _partial_schema(block, keys, "neg"))


def _substring_finder(tokens: list[str]):
    """text -> indexes of the tokens it contains, in one pass over the text."""
    import ahocorasick
    if not tokens:
        return lambda text: []
    automaton = ahocorasick.Automaton()
    for i, t in enumerate(tokens):
        automaton.add_word(t, i)
    automaton.make_automaton()
    return lambda text: [i for _, i in automaton.iter(text)]


def build_postings(chunks: DataFrame) -> DataFrame:
    """Inverted index: one row per chunk and distinct word ([repo_id,] word, chunk_key)."""
    words = F.array_distinct(F.split("search_text", r"\s+"))
    return (chunks.select(F.explode(words).alias("word"), *keys_of(chunks))
            .where(F.length("word") >= 2))


def keyword_topk_postings(queries: DataFrame, postings: DataFrame,
                          n: int = M.RETRIEVE_N) -> DataFrame:
    """Same result as ``keyword_topk`` from an inverted index of any order.

    A token holds no white space, so it lies in a document iff it lies in one of its words.
    The postings are dealt by chunk, in one shuffle of words: a task has all words of its
    chunks, looks each distinct one up once per ``SEGMENT_CHUNKS`` chunks, counts there, and
    shuffles its n best rows alone. No word and no pair of a chunk with a token or a question
    leaves its task, so neither a frequent word nor many questions make a large table.
    Rows of one chunk key are one chunk, rows of one question id one question.
    """
    scope = ["repo_id"] if _need_repos(queries, postings) else []
    keys = keys_of(postings)
    asked = queries.groupBy("query_id", *scope).agg(
        F.array_join(F.collect_list("question"), " ").alias("question"))
    lists = postings.groupBy(*keys).agg(F.collect_list("word").alias("words"))
    return keyword_topk_lists(asked, lists, n).select("query_id", *keys, "matches", "krank")


# --- fusion and re-rank ----------------------------------------------------

def rrf(ranked: list[tuple[DataFrame, str]], k: int = M.RRF_K) -> DataFrame:
    """Reciprocal Rank Fusion of any number of ranked lists.

    ``ranked``: (DataFrame with query_id, [repo_id,] chunk_key and a rank column, its name).
    Result: query_id, [repo_id,] chunk_key, rrf_score, ranks (one per list, NULL if absent).
    """
    keys = keys_of(ranked[0][0])
    lists = [df.select("query_id", *keys, F.col(rank).alias(f"rank_{i}"))
             for i, (df, rank) in enumerate(ranked)]
    # The lists are already hashed by query_id, which this join can use as it is.
    merged = reduce(lambda a, b: a.join(b, ["query_id", *keys], "full"), lists)
    score = reduce(lambda a, b: a + b, [
        F.coalesce(1.0 / (k + F.col(f"rank_{i}")), F.lit(0.0))
        for i in range(len(ranked))])
    return merged.withColumn("rrf_score", score)


def fused_order(lists: int = 2, keys=("chunk_key",)) -> list:
    """Score first, then the order of the earlier lists, then the key."""
    return ([F.desc("rrf_score")]
            + [F.asc_nulls_last(f"rank_{i}") for i in range(lists)]
            + [F.asc(k) for k in reversed(keys)])


def rerank_score(question="question", base=None):
    """Fused score plus metadata boosts, cumulative over every token."""
    tokens = question_tokens(question, 1)
    name, doc = F.lower("name"), F.lower(F.coalesce("docstring", F.lit("")))
    stem = F.lower(paths.file_stem(F.col("file_path")))
    calls = F.transform(F.coalesce("calls", F.array().cast("array<string>")),
                        lambda c: F.lower(c))

    def points(t):
        return (F.when(F.contains(name, t), M.BOOST_NAME).otherwise(0)
                + F.when(F.contains(stem, t), M.BOOST_STEM).otherwise(0)
                + F.when(F.contains(doc, t), M.BOOST_DOC).otherwise(0)
                + F.when(F.exists(calls, lambda c: F.contains(c, t)),
                         M.BOOST_CALL).otherwise(0))

    boost = F.aggregate(tokens, F.lit(0), lambda acc, t: acc + points(t))
    if base is None:
        base = F.col("rrf_score")
    return base + boost / F.lit(100.0)


def rerank(hits: DataFrame, queries: DataFrame, lists: int = 2) -> DataFrame:
    """Adds rerank_score and hit_rank to fused hits that carry chunk metadata.

    Hits without a fused score (a single-list search) start from 1 - distance.
    """
    base = None
    keys = keys_of(hits)
    ties = fused_order(lists, keys)
    if "rrf_score" not in hits.columns:
        base = 1.0 - F.coalesce("distance", F.lit(0.5))
        ties = [F.asc(k) for k in reversed(keys)]
    scored = (hits.join(queries.select("query_id", "question"), "query_id")
              .withColumn("rerank_score", rerank_score(base=base)))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), *ties)
    return scored.withColumn("hit_rank", F.row_number().over(w))


def topk_cut(ranked: DataFrame, k: int = M.RETURN_N) -> DataFrame:
    return ranked.where(F.col("hit_rank") <= k)


# --- names and expansion ---------------------------------------------------

def first_by_name(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Smallest chunk key per wanted name: exact-name lookup.

    ``wanted``: name [, repo_id]. Only matching chunks pass the semi join, and
    the minimum is pre-aggregated per task, so a name shared by many chunks is
    no hot group.
    """
    on = [c for c in ("repo_id", "name") if c in wanted.columns]
    return (chunks.select(*on, "chunk_key")
            .join(wanted.select(*on).distinct(), on, "left_semi")
            .groupBy(*on).agg(F.min("chunk_key").alias("chunk_key")))


def lookup_names(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """wanted with the first chunk of exactly that name (NULL if none)."""
    on = [c for c in ("repo_id", "name") if c in wanted.columns]
    return wanted.join(first_by_name(chunks, wanted), on, "left")


def expand_calls(top: DataFrame, chunks: DataFrame,
                 limit: int = M.EXPAND_N) -> DataFrame:
    """Appends up to ``limit`` chunks called by the hits, at a low fixed score.

    ``top``: query_id, hit_rank, [repo_id,] chunk_key, name, calls, rrf_score,
    rerank_score. A call is looked up in the repository of the hit that makes it. Per
    question the few hits travel as one row, so the plan is a single chain: hits ->
    called names -> lookup -> hits.
    """
    keys = keys_of(top)
    repo = keys[:-1]
    hit = F.struct("hit_rank", *keys, "name", "calls", "rrf_score", "rerank_score")
    per_query = top.groupBy("query_id").agg(
        F.array_sort(F.collect_list(hit)).alias("hits"))

    def named(h, name):
        return F.struct(*[h[c].alias(c) for c in repo], name.alias("name"))

    known = F.transform("hits", lambda h: named(h, h["name"]))
    called = F.flatten(F.transform("hits", lambda h: F.transform(F.coalesce(
        h["calls"], F.array().cast("array<string>")), lambda c: named(h, c))))
    # array_except keeps the first occurrence, in hit then call order.
    wanted = (per_query
              .withColumn("called", F.array_except(called, known))
              .select("query_id", "hits", F.posexplode_outer("called").alias("pos", "want"))
              .select("query_id", "hits", "pos", "want.*"))
    found = (lookup_names(wanted, chunks)
             .groupBy("query_id")
             .agg(F.any_value("hits").alias("hits"),
                  F.array_sort(F.collect_list(F.when(
                      F.col("chunk_key").isNotNull(),
                      F.struct("pos", *keys)))).alias("extra")))
    extra = F.transform(
        F.slice("extra", 1, limit),
        lambda e, i: F.struct(
            (F.size("hits") + i + 1).cast("int").alias("hit_rank"),
            *[e[k].alias(k) for k in keys],
            F.lit(M.EXPANSION_SCORE).alias("rrf_score"),
            F.lit(M.EXPANSION_SCORE).alias("rerank_score"),
            F.lit(True).alias("is_expansion")))
    kept = F.transform("hits", lambda h: F.struct(
        h["hit_rank"].alias("hit_rank"), *[h[k].alias(k) for k in keys],
        h["rrf_score"].alias("rrf_score"),
        h["rerank_score"].alias("rerank_score"),
        F.lit(False).alias("is_expansion")))
    return found.select("query_id", F.inline(F.concat(kept, extra)))
