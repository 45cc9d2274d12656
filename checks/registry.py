"""The registered queries: one callable (spark, sf_dir) -> DataFrame per operator."""

import uuid

from pyspark.sql import DataFrame, functions as F

from checks import views as V
from sparklode.functions import paths, text as X
from sparklode.functions.storage import graph_facts, materialize, shared_dir
from sparklode.operators import graph, incremental as inc, report, search, trace
from sparklode.operators.postings import build_segments, keyword_topk_segments
from sparklode.operators.segment import chunk_files, masked_files, segment_documents
from sparklode.operators.segment_python import python_definitions
from sparklode.plans.index import build_index
from sparklode.plans.retrieve import retrieve
from sparklode.sources import buckets, snapshots
from sparklode.sources.corpus import scan_corpus
from sparklode.sources.metadata import scan_metadata
from sparklode.streaming.ingest import ingest_batch

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _r9(c) -> F.Column:
    return F.round(c, 9)


# --- retrieval -------------------------------------------------------------

@query
def RET_1_vector_knn(spark, sf) -> DataFrame:
    q = V.queries(spark, sf).where(F.col("embedding").isNotNull())
    return search.vector_topk(q, V.vectors(spark, sf)).select(
        "query_id", "chunk_key", F.round("distance", 6).alias("distance"),
        F.col("vrank").cast("long").alias("vrank"))


@query
def RET_2_keyword_search(spark, sf) -> DataFrame:
    return search.keyword_topk(V.queries(spark, sf), V.chunks(spark, sf)).select(
        "query_id", "chunk_key", "matches", F.col("krank").cast("long").alias("krank"))


@query
def RET_2_keyword_postings(spark, sf) -> DataFrame:
    return search.keyword_topk_postings(
        V.queries(spark, sf), search.build_postings(V.chunks(spark, sf))).select(
        "query_id", "chunk_key", "matches", F.col("krank").cast("long").alias("krank"))


@query
def RET_2_stored_postings(spark, sf) -> DataFrame:
    """Segments of a first version without the texts of poor documents, then brought up to date."""
    now = materialize(V.chunks(spark, sf).select(
        "repo_id", "file_path", "chunk_key", "search_text", "doc_id"))
    poor = now.join(V.table(spark, sf, "labels").where("quality = 0"), "doc_id", "left_semi")
    before = now.join(poor, "doc_id", "left_anti").unionByName(
        poor.withColumn("search_text", F.lit("withdrawn")))
    store = buckets.new_index(spark, _new_folder(spark), 64)
    store = store.replace({"postings": (build_segments(before, 64), None)})
    touched = buckets.buckets_of(poor, 64)
    after = now.where(buckets.bucket_of(64).isin(touched))
    store = store.replace({"postings": (build_segments(after, 64), touched)})
    return keyword_topk_segments(V.queries(spark, sf), store.read("postings")).select(
        "query_id", "chunk_key", "matches", F.col("krank").cast("long").alias("krank"))


def _fused(spark, sf):
    q = V.queries(spark, sf)
    return search.rrf([
        (search.vector_topk(q.where(F.col("embedding").isNotNull()),
                            V.vectors(spark, sf)), "vrank"),
        (search.keyword_topk(q, V.chunks(spark, sf)), "krank")])


@query
def RET_3_rrf(spark, sf) -> DataFrame:
    return _fused(spark, sf).select(
        "query_id", "chunk_key", _r9("rrf_score").alias("rrf_score"),
        F.col("rank_0").cast("long").alias("vrank"),
        F.col("rank_1").cast("long").alias("krank"))


def _reranked(spark, sf):
    hits = V.chunks(spark, sf).select(
        "repo_id", "chunk_key", "name", "file_path", "calls", "docstring").join(
        _fused(spark, sf), ["repo_id", "chunk_key"])
    return search.rerank(hits, V.queries(spark, sf))


@query
def RET_4_rerank(spark, sf) -> DataFrame:
    return _reranked(spark, sf).select(
        "query_id", "chunk_key", _r9("rerank_score").alias("rerank_score"),
        F.col("hit_rank").cast("long").alias("hit_rank"))


@query
def RET_5_topk_cut(spark, sf) -> DataFrame:
    return search.topk_cut(_reranked(spark, sf)).select(
        "query_id", "chunk_key", F.col("hit_rank").cast("long").alias("hit_rank"))


@query
def RET_6_call_expansion(spark, sf) -> DataFrame:
    top = search.topk_cut(_reranked(spark, sf))
    out = search.expand_calls(top, V.chunks(spark, sf))
    return out.where("is_expansion").select(
        "query_id", "chunk_key", F.col("hit_rank").cast("long").alias("hit_rank"),
        _r9("rerank_score").alias("rerank_score"))


@query
def RET_7_name_lookup(spark, sf) -> DataFrame:
    """Looks up every called name of every chunk by exact name."""
    c = V.chunks(spark, sf)
    wanted = c.select("repo_id", F.explode("calls").alias("name")).distinct()
    return search.lookup_names(wanted, c).select("repo_id", "name", "chunk_key")


@query
def RET_8_hybrid_retrieve(spark, sf) -> DataFrame:
    out = retrieve(V.queries(spark, sf), V.chunks(spark, sf), V.vectors(spark, sf))
    return out.select(
        "query_id", F.col("hit_rank").cast("long").alias("hit_rank"), "chunk_key",
        "name", "source", _r9("rrf_score").alias("rrf_score"),
        _r9("rerank_score").alias("rerank_score"))


@query
def RET_2_scoped(spark, sf) -> DataFrame:
    return search.keyword_topk(V.scoped_queries(spark, sf), V.shared_chunks(spark, sf)).select(
        "query_id", "repo_id", "chunk_key", "matches", F.col("krank").cast("long").alias("krank"))


@query
def RET_2_postings_scoped(spark, sf) -> DataFrame:
    return search.keyword_topk_postings(
        V.scoped_queries(spark, sf), search.build_postings(V.shared_chunks(spark, sf))).select(
        "query_id", "repo_id", "chunk_key", "matches", F.col("krank").cast("long").alias("krank"))


@query
def RET_8_scoped(spark, sf) -> DataFrame:
    out = retrieve(V.scoped_queries(spark, sf), V.shared_chunks(spark, sf),
                   V.shared_vectors(spark, sf))
    return out.select(
        "query_id", F.col("hit_rank").cast("long").alias("hit_rank"), "repo_id", "chunk_key",
        "name", _r9("rrf_score").alias("rrf_score"), _r9("rerank_score").alias("rerank_score"))


# --- call graph ------------------------------------------------------------

def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


@query
def GRF_1_call_edges(spark, sf) -> DataFrame:
    return graph.call_edges(V.chunks(spark, sf)).select(
        "repo_id", "chunk_key", "src_name", "dst_name", *_long("pos"))


def _counts(spark, sf):
    return graph.inbound_counts(graph.call_edges(V.chunks(spark, sf)))


@query
def GRF_2_inbound_counts(spark, sf) -> DataFrame:
    return _counts(spark, sf)


@query
def GRF_2_inbound_counts_parts(spark, sf) -> DataFrame:
    return graph.inbound_counts(V.part_edges(spark, sf))


@query
def GRF_3_top_functions(spark, sf) -> DataFrame:
    return graph.top_functions(_counts(spark, sf)).select(
        "repo_id", "name", "inbound", *_long("rank"))


@query
def GRF_3_top_functions_parts(spark, sf) -> DataFrame:
    return graph.top_functions(graph.inbound_counts(V.part_edges(spark, sf))).select(
        "repo_id", "name", "inbound", *_long("rank"))


@query
def GRF_4_callee_files(spark, sf) -> DataFrame:
    """Every called name with the file it resolves to."""
    return graph.resolve_files(_counts(spark, sf), V.chunks(spark, sf))


@query
def GRF_5_entry_points(spark, sf) -> DataFrame:
    c = graph_facts(V.chunks(spark, sf))
    counts = graph.inbound_counts(graph.call_edges(c))
    return graph.entry_points(c, counts).select(
        "repo_id", "chunk_key", "name", "file_rel_path", *_long("signal", "rank"))


@query
def GRF_6_structural_score(spark, sf) -> DataFrame:
    return graph.structural_score(V.chunks(spark, sf), _counts(spark, sf))


def _selected(spark, sf):
    c = graph_facts(V.chunks(spark, sf))
    counts = graph.inbound_counts(graph.call_edges(c))
    return graph.select_representatives(
        graph.structural_score(c, counts), graph.entry_points(c, counts))


@query
def GRF_7_diverse_selection(spark, sf) -> DataFrame:
    return _selected(spark, sf).select(
        "repo_id", "chunk_key", "name", "file_rel_path", *_long("pos"))


def _state(spark, sf):
    c = graph_facts(V.chunks(spark, sf))
    symbols = c.select("repo_id", F.col("name").alias("symbol")).distinct()
    return trace.forward_state(symbols, c)


@query
def GRF_8_forward_trace_nodes(spark, sf) -> DataFrame:
    return trace.trace_nodes(_state(spark, sf)).select(
        "repo_id", "symbol", "name", "parent", "is_indexed", "is_truncated",
        *_long("ord", "depth"))


@query
def GRF_8_forward_trace_edges(spark, sf) -> DataFrame:
    return trace.trace_edges(_state(spark, sf)).select(
        "repo_id", "symbol", "parent", "child", "already_visited", *_long("pos"))


@query
def GRF_9_backward_trace(spark, sf) -> DataFrame:
    c = graph_facts(V.chunks(spark, sf))
    e = graph.call_edges(c)
    symbols = e.select("repo_id", F.col("dst_name").alias("symbol")).distinct()
    return graph.callers(symbols, e, c).select(
        "repo_id", "symbol", "chunk_key", "name", "file_rel_path", *_long("start_line"))


@query
def GRF_10_trace_tree(spark, sf) -> DataFrame:
    return trace.trace_tree(_state(spark, sf))


@query
def GRF_11_trace_bundle(spark, sf) -> DataFrame:
    """Traces every called name, indexed or not."""
    c = graph_facts(V.chunks(spark, sf))
    e = graph.call_edges(c)
    symbols = e.select("repo_id", F.col("dst_name").alias("symbol")).distinct()
    return trace.run_trace(symbols, c, e).select(
        "repo_id", "symbol", "tree", "is_truncated", "not_found", "n_callers", "error",
        F.concat_ws(",", F.transform("callers", lambda c: c["name"])).alias("callers"),
        *_long("visited_count"))


@query
def GRF_12_tour_evidence(spark, sf) -> DataFrame:
    from sparklode.plans.tour import tour
    return tour(V.chunks(spark, sf)).evidence


# --- paths and scalar text -------------------------------------------------

def _paths(spark, sf, keep=None):
    p = V.listed_paths(spark, sf)
    return (p if keep is None else p.where(keep)).select("doc_id", "rel")


@query
def FLT_1_ignored_dirs(spark, sf) -> DataFrame:
    return _paths(spark, sf, ~paths.in_ignored_dir("rel"))


@query
def FLT_2_test_code(spark, sf) -> DataFrame:
    return _paths(spark, sf, ~paths.is_test_code("rel"))


@query
def FLT_3_extensions(spark, sf) -> DataFrame:
    return _paths(spark, sf, paths.has_source_extension("rel"))


@query
def FLT_4_file_size(spark, sf) -> DataFrame:
    return _paths(spark, sf, paths.within_size("length"))


@query
def FLT_5_path_prefix(spark, sf) -> DataFrame:
    return _paths(spark, sf, paths.under_prefix(F.col("rel"), "SRC/"))


@query
def PRJ_1_relative_path(spark, sf) -> DataFrame:
    return V.listed_paths(spark, sf).select(
        "doc_id", paths.relative_path("path", "/r/en").alias("rel_en"))


@query
def PRJ_2_display_path(spark, sf) -> DataFrame:
    p = V.listed_paths(spark, sf).withColumn(
        "shown", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), "rel")).otherwise(" "))
    return p.select("doc_id", paths.display_path("shown", "path").alias("display"))


@query
def PRJ_3_search_text(spark, sf) -> DataFrame:
    return V.chunks(spark, sf).select("chunk_key", "search_text")


@query
def PRJ_4_language(spark, sf) -> DataFrame:
    return V.listed_paths(spark, sf).select(
        "doc_id", paths.language("rel").alias("language"))


@query
def PRJ_5_confidence(spark, sf) -> DataFrame:
    return V.hits(spark, sf).where("hit_rank = 1").select(
        "query_id", X.confidence(F.col("rerank_score")).alias("confidence"))


@query
def PRJ_6_keyword_tokens(spark, sf) -> DataFrame:
    return V.queries(spark, sf).select("query_id", F.concat_ws(
        "|", X.question_tokens("question", 2)).alias("tokens"))


@query
def PRJ_7_rerank_tokens(spark, sf) -> DataFrame:
    return V.queries(spark, sf).select("query_id", F.concat_ws(
        "|", X.question_tokens("question", 1)).alias("tokens"))


# --- prompts, answers, reports ---------------------------------------------

@query
def SNK_2_hit_report(spark, sf) -> DataFrame:
    return report.format_hits(V.conv_questions(spark, sf), V.hits(spark, sf))


@query
def TXT_1_prompts(spark, sf) -> DataFrame:
    return report.assemble_prompts(report.labelled_chunks(V.hits(spark, sf)),
                                   V.conv_questions(spark, sf))


@query
def TXT_2_caution(spark, sf) -> DataFrame:
    return report.caution_flags(V.hits(spark, sf)).select(
        "query_id", "top_score", "needs_caution")


def _citations(spark, sf):
    return report.citations(report.labelled_chunks(V.hits(spark, sf)),
                            V.responses(spark, sf))


@query
def TXT_3_citations(spark, sf) -> DataFrame:
    return _citations(spark, sf).select(
        "query_id", "label", "file_rel_path", "name", "parent_class", "is_truncated",
        *_long("start_line", "end_line"))


@query
def TXT_4_strip_citations(spark, sf) -> DataFrame:
    return V.responses(spark, sf).select(
        "query_id", report.strip_citations("response").alias("answer"))


@query
def TXT_5_answer_sections(spark, sf) -> DataFrame:
    return V.responses(spark, sf).select(
        "query_id", report.answer_sections(report.strip_citations("response")).alias("s")
    ).select("query_id", "s.*")


@query
def TXT_6_briefing_sections(spark, sf) -> DataFrame:
    return V.briefings(spark, sf).select(
        "query_id", report.briefing_sections("briefing").alias("s")).select("query_id", "s.*")


@query
def TXT_7_narration_input(spark, sf) -> DataFrame:
    c = graph_facts(V.chunks(spark, sf))
    symbols = c.select("repo_id", F.col("name").alias("symbol")).distinct()
    trees = trace.trace_tree(trace.forward_state(symbols, c))
    return report.narration_inputs(trees, graph.callers(symbols, graph.call_edges(c), c))


@query
def TXT_8_answer_records(spark, sf) -> DataFrame:
    out = report.answer_records(V.conv_questions(spark, sf), V.hits(spark, sf),
                                V.responses(spark, sf))
    return out.select(
        "query_id", "answer", "sections.how_it_works", "chunks_used", "confidence",
        F.concat_ws(",", F.transform("citations", lambda c: c["label"])).alias("labels"))


@query
def TXT_9_cited_order(spark, sf) -> DataFrame:
    return report.display_order(V.hits(spark, sf), _citations(spark, sf)).select(
        "query_id", "chunk_key", *_long("label_no", "position"))


@query
def TXT_10_label_mentions(spark, sf) -> DataFrame:
    return report.label_mentions(V.responses(spark, sf).select(
        "query_id", report.strip_citations("response").alias("answer")))


# --- incremental index -----------------------------------------------------

def _changes(spark, sf, force=False):
    return inc.detect_changes(V.files(spark, sf), V.old_hashes(spark, sf), force)


def _gone(spark, sf):
    return inc.orphans(V.old_hashes(spark, sf), V.files(spark, sf))


@query
def SRC_2_content_hash(spark, sf) -> DataFrame:
    return inc.content_hash(V.files(spark, sf)).select("file_path", "sha256")


@query
def SRC_3_metadata_scan(spark, sf) -> DataFrame:
    """Metadata columns of the chunks under a path scope; no vectors, no text."""
    return scan_metadata(V.chunks(spark, sf), "src1").select(
        "chunk_key", "file_rel_path", "node_type", "name", "parent_class",
        F.size("calls").cast("long").alias("n_calls"), *_long("start_line", "end_line"))


@query
def INC_1_change_detection(spark, sf) -> DataFrame:
    return _changes(spark, sf).select("repo_id", "file_path", "status")


@query
def INC_1_forced(spark, sf) -> DataFrame:
    return _changes(spark, sf, force=True).select("repo_id", "file_path", "status")


@query
def INC_2_kept_chunks(spark, sf) -> DataFrame:
    return inc.kept_chunks(V.old_chunks(spark, sf), _changes(spark, sf), _gone(spark, sf)
                           ).select("repo_id", "file_path", *_long("start_line"))


@query
def INC_3_new_hashes(spark, sf) -> DataFrame:
    return inc.new_hashes(V.old_hashes(spark, sf), _changes(spark, sf), _gone(spark, sf))


@query
def INC_4_orphans(spark, sf) -> DataFrame:
    return _gone(spark, sf)


@query
def INC_4_orphans_partial_listing(spark, sf) -> DataFrame:
    """Only the English files are listed: files of other repositories are no orphans."""
    return inc.orphans(V.old_hashes(spark, sf), V.files(spark, sf).where("repo_id = 'en'"))


@query
def INC_4_orphans_named_repository(spark, sf) -> DataFrame:
    """The English repository was listed and has no files any more."""
    repos = V.files(spark, sf).where("repo_id = 'en'").select("repo_id")
    return inc.orphans(V.old_hashes(spark, sf), V.files(spark, sf).where("repo_id = 'de'"), repos)


@query
def INC_6_unreadable(spark, sf) -> DataFrame:
    """Contents of even length are missing, every other of these with the scan's reason."""
    even = F.col("length") % 2 == 0
    f = V.files(spark, sf).withColumns({
        "content": F.when(~even, F.col("content")),
        "error": F.when(F.col("length") % 4 == 0, "cannot be read (OSError)")})
    return inc.errors(inc.detect_changes(f, V.old_hashes(spark, sf)))


@query
def INC_5_index_stats(spark, sf) -> DataFrame:
    changes = _changes(spark, sf)
    made = inc.to_index(changes).select("repo_id", F.explode(F.array(F.lit(1), F.lit(9))))
    return inc.index_stats(changes, made, _gone(spark, sf))


def _broken(spark, sf):
    """Documents of odd byte length get one invalid byte at the end."""
    bad = F.col("length") % 2 == 1
    return V.files(spark, sf).withColumn("content", F.when(bad, F.concat(
        "content", F.unhex(F.lit("FF")))).otherwise(F.col("content")))


@query
def INC_6_error_rows(spark, sf) -> DataFrame:
    return inc.errors(inc.detect_changes(_broken(spark, sf), V.old_hashes(spark, sf)))


def _shape(texts):
    return [[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in texts]


@query
def INC_7_batched_embedding(spark, sf) -> DataFrame:
    """Injected embedder: characters, blanks and line ends of each text."""
    return inc.embed(V.chunks(spark, sf), _shape).select(
        "chunk_key", *[F.col("embedding")[i].cast("long").alias(n)
                       for i, n in enumerate(("chars", "blanks", "breaks"))])


@query
def INC_7_hashing_embedding(spark, sf) -> DataFrame:
    e = inc.embed_hashing(V.chunks(spark, sf))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return e.select("chunk_key", F.round(norm, 4).alias("norm"))


@query
def SNK_1_chunk_snapshot(spark, sf) -> DataFrame:
    """Kept chunks plus new ones, written as a version, published, read back."""
    changes = materialize(_changes(spark, sf))
    kept = inc.kept_chunks(V.old_chunks(spark, sf), changes, _gone(spark, sf))
    new = inc.to_index(changes).select("repo_id", "file_path", F.explode(
        F.array(F.lit(2), F.lit(5))).alias("start_line"))
    base = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    snapshots.publish(spark, base, snapshots.write_snapshot(kept.unionByName(new), base))
    return snapshots.current_snapshot(spark, base).select(
        "repo_id", "file_path", *_long("start_line"))


def _new_folder(spark) -> str:
    return f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"


@query
def SNK_1_touched_buckets(spark, sf) -> DataFrame:
    """Bad documents get other chunks: which buckets are written anew, what all of them hold."""
    c = V.chunks(spark, sf).withColumn("file_path", F.concat("file_path", F.lit("/"), "doc_id")
                                       ).select("repo_id", "file_path", "doc_id", "source")
    first = buckets.new_index(spark, _new_folder(spark), 64).replace({"chunks": (c, None)})
    bad = V.table(spark, sf, "labels").where("quality = 0 AND toxic = 1")
    stale = materialize(c.join(bad.select("doc_id"), "doc_id", "left_semi"))
    touched = buckets.buckets_of(stale, first.buckets)
    kept = first.read("chunks", touched).join(
        bad.select("doc_id"), "doc_id", "left_anti").select(*c.columns)
    fresh = stale.select("repo_id", "file_path", "doc_id", F.lit("").alias("source"))
    second = first.replace({"chunks": (kept.unionByName(fresh), touched)})
    was = {e["bucket"]: e["path"] for e in first.entries}
    moved = [e["bucket"] for e in second.entries if e["path"] != was.get(e["bucket"])]
    return (buckets.open_index(spark, first.base).read("chunks")
            .groupBy(buckets.bucket_of(64).cast("long").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n_files"),
                 F.sum(F.length("source").cast("long")).alias("chars"))
            .withColumn("written", F.col("bucket").isin(moved)))


@query
def INC_S_unreadable(spark, sf) -> DataFrame:
    """A second batch cannot read poor documents and withdraws toxic ones."""
    base, files = _new_folder(spark), V.files(spark, sf)
    ingest_batch(files, base)
    marked = files.join(V.table(spark, sf, "labels"), "doc_id").withColumns({
        "content": F.lit(None).cast("binary"), "withdrawn": F.col("toxic") == 1,
        "error": F.when(F.col("doc_id") % 2 == 0, "cannot be read (OSError)")})
    store, _ = ingest_batch(marked.where("quality = 0 OR toxic = 1"), base)
    return store.read("hashes").join(store.read("errors"), ["repo_id", "file_path"], "left")


# --- segmentation ----------------------------------------------------------

def _python(spark, sf):
    return chunk_files(V.python_files(spark, sf))


def _js(spark, sf):
    return chunk_files(V.js_files(spark, sf))


def _both(spark, sf):
    return chunk_files(V.python_files(spark, sf).unionByName(V.js_files(spark, sf)))


@query
def CHK_1_python_definitions(spark, sf) -> DataFrame:
    return _python(spark, sf).select(
        "file_path", "name", "node_type", *_long("start_line", "end_line"))


@query
def CHK_2_decorators(spark, sf) -> DataFrame:
    files = materialize(masked_files(V.python_files(spark, sf)))
    found = materialize(python_definitions(files))
    return found.join(files.select("row", "file_path"), "row").select(
        "file_path", "name", *_long("first", "def_line"))


@query
def CHK_3_js_definitions(spark, sf) -> DataFrame:
    return _js(spark, sf).select(
        "file_path", "name", "node_type", *_long("start_line", "end_line"))


@query
def CHK_4_parent_class(spark, sf) -> DataFrame:
    return _both(spark, sf).select("file_path", "name", "parent_class")


@query
def CHK_5_call_names(spark, sf) -> DataFrame:
    return _both(spark, sf).select(
        "file_path", "name", F.concat_ws(",", "calls").alias("calls"))


@query
def CHK_6_docstrings(spark, sf) -> DataFrame:
    return _python(spark, sf).select("file_path", "name", "docstring")


@query
def CHK_7_token_cap(spark, sf) -> DataFrame:
    return _python(spark, sf).select(
        "file_path", "name", "is_truncated", "source", *_long("token_count"))


@query
def CHK_8_document_segments(spark, sf) -> DataFrame:
    return segment_documents(V.spread(V.table(spark, sf, "documents"))).select(
        "doc_id", "source", *_long("segment", "start_line", "end_line", "token_count"))


@query
def CHK_9_chunk_keys(spark, sf) -> DataFrame:
    return _both(spark, sf).select("chunk_key")


@query
def IDX_build_index(spark, sf) -> DataFrame:
    """Whole index run: files whose text changed against a first version."""
    # As a corpus is read: from storage, not made anew for every read.
    now = materialize(V.python_files(spark, sf).unionByName(V.js_files(spark, sf)))
    known = now.join(V.old_hashes(spark, sf).select(
        F.replace("file_path", F.lit("/pages/p_"), F.lit("/old/p_")).alias("file_path")),
        "file_path", "left_semi").select(
        "repo_id", "file_path", F.sha2("content", 256).alias("sha256"))
    return build_index(now, hashes=known).stats


@query
def SRC_1_corpus_scan(spark, sf) -> DataFrame:
    """Lists the stored tables themselves as a corpus: path and size of each file."""
    return scan_corpus(spark, sf, content=False, extensions=".parquet", max_bytes=0).select(
        "file_rel_path", "length")


def _write_files(docs: DataFrame, base: str) -> None:
    """Every document as a file <lang>/<source>/doc_<id>.py under ``base``, written by the tasks."""
    def write(batches):
        from pyarrow import RecordBatch, fs
        store, root = fs.FileSystem.from_uri(base)
        known = set()
        for b in batches:
            for r in b.to_pylist():
                folder = f"{root}/{r['lang']}/{r['source']}"
                if folder not in known:
                    store.create_dir(folder, recursive=True)
                    known.add(folder)
                with store.open_output_stream(f"{folder}/doc_{r['doc_id']}.py") as f:
                    f.write(r["text"].encode())
            yield RecordBatch.from_pydict({"n": [b.num_rows]})

    docs.select("doc_id", "lang", "source", "text").mapInArrow(write, "n long").agg(
        F.sum("n")).collect()


@query
def SRC_1_scan_contents(spark, sf) -> DataFrame:
    """The documents written out as files, and every file found with its contents."""
    base = _new_folder(spark)
    _write_files(V.spread(V.table(spark, sf, "documents")), base)
    return scan_corpus(spark, base).select("file_rel_path", "length", F.sha2("content", 256)
                                           .alias("sha256"))


@query
def SRC_1_scan_and_filter(spark, sf) -> DataFrame:
    """All corpus filters over the listed paths."""
    p = V.listed_paths(spark, sf)
    return p.where(paths.indexable(F.col("rel"), "length")).select("doc_id", "rel")
