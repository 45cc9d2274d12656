"""Prompt, answer and report tables. The model call itself lies outside.

``hits``       query_id, hit_rank and the chunk columns of ``retrieve``
``queries``    query_id, question
``responses``  query_id, response
Every group collected here is cut by rank first, so it is of fixed size.
"""

from pyspark.sql import Column, DataFrame, functions as F

from sparklode import model as M
from sparklode.functions import paths
from sparklode.functions.text import confidence
from sparklode.operators.topk import rank_rows


def _gather(df: DataFrame, key, order: str, text: Column, sep: str, name: str):
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                                text.alias("t"))))
    return df.groupBy(key).agg(F.array_join(
        F.transform(rows, lambda r: r["t"]), sep).alias(name))


# --- prompts ---------------------------------------------------------------

def labelled_chunks(hits: DataFrame, n: int = M.PROMPT_CHUNKS) -> DataFrame:
    """First n hits per question, labelled [1], [2] ... in rank order."""
    shown = paths.display_path(F.col("file_rel_path"), F.col("file_path"))
    return (hits.where(F.col("hit_rank") <= n)
            .withColumn("file_rel_path", shown)
            .withColumn("label", F.format_string("[%d]", "hit_rank")))


def assemble_prompts(labelled: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, prompt: labelled chunk blocks, then the question."""
    context = F.when(F.col("parent_class") != "", F.concat_ws(
        ".", "parent_class", "name")).otherwise(F.col("name"))
    block = F.format_string(
        "CHUNK %s\nFile: %s  Lines: %d-%d\nFunction: %s\n---\n%s", "label",
        "file_rel_path", "start_line", "end_line", context, "source")
    blocks = _gather(labelled, "query_id", "hit_rank", block, "\n\n", "blocks")
    return blocks.join(queries.select("query_id", "question"), "query_id").select(
        "query_id", F.format_string(
            "%s\n\nQUESTION: %s\n\nANSWER (cite chunks inline using [1], [2] etc.):",
            "blocks", "question").alias("prompt"))


def caution_flags(hits: DataFrame, cut: float = M.CONFIDENCE_HIGH) -> DataFrame:
    """query_id, top_score, needs_caution, note (appended to the instructions)."""
    weak = F.col("rerank_score") < cut
    return hits.where(F.col("hit_rank") == 1).select(
        "query_id", F.col("rerank_score").alias("top_score"),
        weak.alias("needs_caution"),
        F.when(weak, M.CAUTION_NOTE).otherwise("").alias("note"))


# --- responses -------------------------------------------------------------

def citations(labelled: DataFrame, responses: DataFrame) -> DataFrame:
    """Issued labels whose text occurs anywhere in the response."""
    return (labelled.join(responses, "query_id")
            .where(F.col("response").contains(F.col("label")))
            .select("query_id", "label", F.col("hit_rank").alias("label_no"),
                    "file_rel_path", "file_path", "start_line", "end_line", "name",
                    "parent_class", "is_truncated"))


def strip_citations(text) -> Column:
    """Text before the first line that starts with CITATIONS, right-trimmed."""
    text = F.col(text) if isinstance(text, str) else text
    cut = F.regexp_replace(F.regexp_replace(
        text, r"(?ims)^[^\S\n]*citations.*\z", ""), r"\s+\z", "")
    return F.when(text.rlike(r"(?im)^[^\S\n]*citations"), cut).otherwise(text)


def _trim(text) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def _section(text, start: str, header: str, end: str) -> Column:
    """Trimmed text after the last ``header`` up to the next one, else NULL."""
    after = F.regexp_extract(text, rf"{start}{header}(.*)\z", 1)
    body = _trim(F.regexp_replace(after, end, ""))
    return F.when(text.rlike(rf"{start}{header}"), body)


def answer_sections(text) -> Column:
    """STRUCT(answer, how_it_works, where_to_look) by bold headers."""
    text = F.col(text) if isinstance(text, str) else text
    any_header = "|".join(M.ANSWER_HEADERS.values())
    part = {k: _section(text, r"(?is)\A.*", rf"\*\*{h}:\*\*",
                        rf"(?is)\*\*(?:{any_header}):\*\*.*\z")
            for k, h in M.ANSWER_HEADERS.items()}
    part["answer"] = F.coalesce(part["answer"], text)
    return F.struct(*[c.alias(k) for k, c in part.items()])


def briefing_sections(text) -> Column:
    """STRUCT of the five briefing sections; headers stand alone on a line."""
    text = F.col(text) if isinstance(text, str) else text
    any_header = "|".join(M.BRIEFING_HEADERS.values())
    return F.struct(*[
        _section(text, r"(?ims)\A(?:.*^)?", rf"{h}[^\S\n]*$",
                 rf"(?ims)^(?:{any_header})[^\S\n]*$.*\z").alias(k)
        for k, h in M.BRIEFING_HEADERS.items()])


def label_mentions(answers: DataFrame) -> DataFrame:
    """query_id, label_no, mentions: inline [n] marks in ``answer``."""
    marks = F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1))
    return (answers.select("query_id", F.explode(marks).alias("label_no"))
            .groupBy("query_id", "label_no").agg(F.count(F.lit(1)).alias("mentions")))


def answer_records(queries: DataFrame, hits: DataFrame,
                   responses: DataFrame) -> DataFrame:
    """One record per question, also for questions without hits."""
    labelled = labelled_chunks(hits)
    top = hits.where(F.col("hit_rank") == 1).select("query_id", "rerank_score")
    used = labelled.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks_used"))
    cited = citations(labelled, responses).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "label_no", "label", "file_rel_path", "start_line", "end_line",
            "name", "parent_class", "is_truncated"))).alias("citations"))
    out = (queries.select("query_id")
           .join(top, "query_id", "left").join(used, "query_id", "left")
           .join(responses, "query_id", "left").join(cited, "query_id", "left"))
    empty = F.col("chunks_used").isNull()
    answer = strip_citations(F.coalesce("response", F.lit("")))
    return (out
            .withColumn("answer", F.when(empty, M.NO_HITS_ANSWER).otherwise(answer))
            .withColumn("sections", F.when(~empty, answer_sections("answer")))
            .withColumn("confidence", F.when(empty, "low").otherwise(
                confidence(F.col("rerank_score"))))
            .withColumn("chunks_used", F.coalesce("chunks_used", F.lit(0)))
            .select("query_id", "answer", "sections", "citations", "chunks_used",
                    "confidence"))


def display_order(hits: DataFrame, cited: DataFrame) -> DataFrame:
    """Hits with the first label of their name; cited ones first, by label."""
    label = cited.groupBy("query_id", "name").agg(
        F.min("label_no").alias("label_no"))
    return rank_rows(hits.join(label, ["query_id", "name"], "left"),
                     [F.asc_nulls_last("label_no"), "hit_rank"], None, "position")


# --- reports ---------------------------------------------------------------

def format_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, report: a numbered block per hit."""
    block = F.format_string(
        "── Result %d ──────────────────────────────\nFile:     %s\n"
        "Function: %s  (lines %d–%d)\nScore:    %.4f\n\n%s\n", "hit_rank",
        paths.display_path(F.col("file_rel_path"), F.col("file_path")), "name",
        "start_line", "end_line", "rerank_score", "source")
    text = _gather(hits, "query_id", "hit_rank", block, "\n", "report")
    return queries.select("query_id").join(text, "query_id", "left").select(
        "query_id", F.coalesce("report", F.lit(M.NO_HITS_REPORT)).alias("report"))


def narration_inputs(trees: DataFrame, callers: DataFrame,
                     n: int = M.TRACE_CALLERS) -> DataFrame:
    """repo_id, symbol, context: trace tree and the first n callers."""
    first = rank_rows(callers, ["chunk_key"], n, "r", within=("repo_id", "symbol"))
    line = F.format_string("  %s  [%s:%d]", "name", "file_rel_path", "start_line")
    rows = F.array_sort(F.collect_list(F.struct("r", line.alias("t"))))
    lines = first.groupBy("repo_id", "symbol").agg(F.array_join(
        F.transform(rows, lambda x: x["t"]), "\n").alias("lines"))
    return trees.join(lines, ["repo_id", "symbol"], "left").select(
        "repo_id", "symbol", F.format_string(
            "SYMBOL: %s\n\nFORWARD CALL TREE:\n%s\n\nCALLERS OF %s:\n%s", "symbol",
            "tree", "symbol", F.coalesce("lines", F.lit(M.NO_CALLERS))
        ).alias("context"))
