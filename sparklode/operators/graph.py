"""Call-graph operators, for all repositories at once.

Edges are by name: ``calls`` of a chunk against ``name`` of chunks in the same
repository. Where the first of several chunks counts, it is the one with the
smallest chunk key.
"""

from pyspark.sql import DataFrame, functions as F

from sparklode import model as M
from sparklode.functions import paths
from sparklode.operators.topk import rank_rows


def call_edges(chunks: DataFrame) -> DataFrame:
    """repo_id, chunk_key, src_name, dst_name, pos; blank callees dropped."""
    return (chunks.select("repo_id", "chunk_key", F.col("name").alias("src_name"),
                          F.posexplode("calls").alias("pos", "dst_name"))
            .where(F.trim("dst_name") != ""))


def inbound_counts(edges: DataFrame) -> DataFrame:
    """Number of calling chunks per callee name, builtins left out.

    The builtin filter removes the usual hub names before the shuffle and the
    count is pre-aggregated per task, so hot callees cost one row per task.
    """
    return (edges.where(~F.col("dst_name").isin(M.BUILTIN_NAMES))
            .groupBy("repo_id", F.col("dst_name").alias("name"))
            .agg(F.count(F.lit(1)).alias("inbound")))


def top_functions(counts: DataFrame, n: int = M.TOP_FUNCTIONS) -> DataFrame:
    return rank_rows(counts, [F.desc("inbound"), "name"], n, "rank",
                     within=("repo_id",))


def first_chunks(chunks: DataFrame, names: DataFrame | None, *cols) -> DataFrame:
    """First chunk per (repo_id, name), with ``cols`` of that chunk."""
    facts = chunks.select("repo_id", "name", "chunk_key", *cols)
    if names is not None:
        facts = facts.join(names.select("repo_id", "name").distinct(),
                           ["repo_id", "name"], "left_semi")
    return (facts.groupBy("repo_id", "name")
            .agg(F.min(F.struct("chunk_key", *cols)).alias("first"))
            .select("repo_id", "name", "first.*"))


def resolve_files(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds the path of the first chunk of each name, 'unknown' if none."""
    first = first_chunks(chunks, names, "file_rel_path").drop("chunk_key")
    return (names.join(first, ["repo_id", "name"], "left")
            .withColumn("file_rel_path",
                        F.coalesce("file_rel_path", F.lit("unknown"))))


def with_inbound(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    return (chunks.join(counts, ["repo_id", "name"], "left")
            .withColumn("inbound", F.coalesce("inbound", F.lit(0))))


def entry_points(chunks: DataFrame, counts: DataFrame,
                 cap: int = M.ENTRY_CAP) -> DataFrame:
    """Likely entry points per repository: signal 1 by name, 2 by graph.

    Result: repo_id, rank, signal, chunk_key, name, file_rel_path.
    """
    facts = chunks.select("repo_id", "name", "chunk_key", "file_rel_path",
                          F.size("calls").alias("n_calls"))
    by_name = (F.lower(paths.file_name(F.col("file_rel_path"))).isin(M.ENTRY_FILES)
               | F.col("name").isin(M.ENTRY_FUNCTIONS))
    by_graph = (F.col("inbound") == 0) & (F.col("n_calls") > 0)
    signal = F.when(by_name, 1).when(by_graph, 2)
    first = (with_inbound(facts, counts).withColumn("signal", signal)
             .where(F.col("signal").isNotNull())
             .groupBy("repo_id", "name")
             .agg(F.min(F.struct("chunk_key", "signal", "file_rel_path")).alias("c"))
             .select("repo_id", "name", "c.*"))
    return rank_rows(first, ["signal", "chunk_key"], cap, "rank",
                     within=("repo_id",))


def structural_score(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """repo_id, chunk_key, name, file_rel_path, inbound, score."""
    facts = chunks.select("repo_id", "name", "chunk_key", "file_rel_path",
                          F.size("calls").alias("n_calls"))
    return (with_inbound(facts, counts)
            .withColumn("score", F.col("inbound") + 0.5 * F.col("n_calls"))
            .drop("n_calls"))


def select_representatives(scored: DataFrame, entries: DataFrame,
                           cap: int = M.TOUR_CHUNKS) -> DataFrame:
    """Up to ``cap`` chunks per repository, spread over files and names.

    Entry points first; then by score, one per file and name; then by name
    only. The greedy choice is sequential, but at most ``cap`` names and files
    are ever blocked, so only these rows can matter: the best chunk per (file,
    name), at most cap+1 of them per file and per name, 2*cap*(cap+1)+1 per
    repository. Each cut is a limited rank, applied before its shuffle; what is
    left of a repository is one short array. Result: repo_id, pos, chunk_key,
    name, file_rel_path.
    """
    order = F.struct((-F.col("score")).alias("neg"), "chunk_key")
    pairs = (scored.groupBy("repo_id", "file_rel_path", "name")
             .agg(F.min(order).alias("o")))
    wide = rank_rows(pairs, ["o"], cap + 1, "r", within=("repo_id", "file_rel_path"))
    wide = rank_rows(wide, ["o"], cap + 1, "r", within=("repo_id", "name"))
    wide = rank_rows(wide, ["o"], 2 * cap * (cap + 1) + 1, "r", within=("repo_id",))
    deep = scored.groupBy("repo_id", "name").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), "chunk_key",
                       "file_rel_path")).alias("o"))
    deep = rank_rows(deep, ["o"], 2 * cap, "r", within=("repo_id",))

    def gather(rows, stage, neg, key, file, name):
        c = F.struct(neg.cast("double").alias("neg"), key.alias("chunk_key"),
                     F.col("name").alias("name"), file.alias("file_rel_path"),
                     F.lit(stage).alias("stage"))
        return rows.groupBy("repo_id").agg(F.array_sort(F.collect_list(c)).alias(name))

    o = F.col("o")
    per_repo = gather(deep, 2, o["neg"], o["chunk_key"], o["file_rel_path"], "deep").join(
        gather(wide, 1, o["neg"], o["chunk_key"], F.col("file_rel_path"), "wide"),
        "repo_id").join(
        gather(entries, 0, F.col("rank"), F.col("chunk_key"), F.col("file_rel_path"),
               "entry"), "repo_id", "left")

    def blocked(picked, c):
        return F.exists(picked, lambda p: (p["name"] == c["name"]) | (
            (c["stage"] == 1) & (p["file_rel_path"] == c["file_rel_path"])))

    picked = F.aggregate(
        F.concat("wide", "deep"),
        F.coalesce("entry", F.slice("deep", 1, 0)),
        lambda acc, c: F.when((F.size(acc) < cap) & ~blocked(acc, c),
                              F.array_append(acc, c)).otherwise(acc))
    return (per_repo
            .select("repo_id", F.posexplode(F.slice(picked, 1, cap))
                    .alias("pos", "c"))
            .select("repo_id", (F.col("pos") + 1).alias("pos"), "c.chunk_key",
                    "c.name", "c.file_rel_path"))


def callers(symbols: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Backward trace, one level: every chunk whose calls contain the symbol.

    ``symbols``: repo_id, symbol. Result adds name, file_rel_path, start_line.
    """
    wanted = symbols.select("repo_id", F.col("symbol").alias("dst_name")).distinct()
    hits = edges.join(wanted, ["repo_id", "dst_name"]).select(
        "repo_id", F.col("dst_name").alias("symbol"), "chunk_key")
    facts = chunks.select("repo_id", "chunk_key", "name", "file_rel_path",
                          "file_path", "start_line")
    return hits.join(facts, ["repo_id", "chunk_key"])
