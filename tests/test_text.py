"""Scalar text operators, prompts, citations and sections."""

import pytest
from pyspark.sql import functions as F

from sparklode.functions import paths, text as X
from sparklode.operators import report
from sparklode.operators.segment import segment_documents

HIT = ("query_id long, hit_rank int, file_rel_path string, file_path string, name string, "
       "parent_class string, start_line int, end_line int, source string, rerank_score double, "
       "chunk_key string, is_truncated boolean")


def hits(spark, n, score=0.5):
    return spark.createDataFrame(
        [(1, i, f"f{i}.py", f"/r/f{i}.py", f"n{i}", "K" if i == 2 else None, i, i + 1, f"src{i}", score,
          f"k{i}", False) for i in range(1, n + 1)], HIT)


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize("rel, path, want", [
    ("pkg/mod.py", "/abs/pkg/mod.py", "pkg/mod.py"), ("  ", "/abs/repo/auth.py", "repo/auth.py"),
    (None, "auth.py", "auth.py")])
def test_display_path(spark, rel, path, want):
    df = spark.createDataFrame([(rel, path)], "rel string, path string")
    assert df.select(paths.display_path(F.col("rel"), F.col("path"))).first()[0] == want


@pytest.mark.parametrize("score, want", [(0.4, "high"), (0.399, "medium"), (0.05, "medium"), (0.04, "low")])
def test_confidence(spark, score, want):
    assert spark.range(1).select(X.confidence(F.lit(score))).first()[0] == want


@pytest.mark.parametrize("path, want", [
    ("a/b.test.ts", ".ts"), ("a/.py", ""), ("x.y/z", ""), ("..a.py", ".py"), ("B.TSX", ".TSX")])
def test_suffix(spark, path, want):
    assert one(spark, path, paths.suffix) == want


def test_prompt_cap_and_format(spark):
    labelled = report.labelled_chunks(hits(spark, 10))
    q = spark.createDataFrame([(1, "why?")], "query_id long, question string")
    prompt = report.assemble_prompts(labelled, q).first()["prompt"]
    assert labelled.count() == 8 and "CHUNK [8]" in prompt and "CHUNK [9]" not in prompt
    assert "CHUNK [2]\nFile: f2.py  Lines: 2-3\nFunction: K.n2\n---\nsrc2\n\nCHUNK [3]" in prompt
    assert prompt.endswith("QUESTION: why?\n\nANSWER (cite chunks inline using [1], [2] etc.):")


@pytest.mark.parametrize("response, want", [
    ("See [2] and [1].", ["[1]", "[2]"]), ("[1] and [9]", ["[1]"]), ("[1] [1]", ["[1]"]), ("none", [])])
def test_citations(spark, response, want):
    r = spark.createDataFrame([(1, response)], "query_id long, response string")
    out = report.citations(report.labelled_chunks(hits(spark, 3)), r).orderBy("label_no")
    assert [x["label"] for x in out.collect()] == want


@pytest.mark.parametrize("text, want", [
    ("Prose.\n\nCITATIONS\n[1] a", "Prose."), ("Prose.\n  citations:\nx", "Prose."), ("Just prose \n", "Just prose \n"),
    ("", ""), ("No CITATIONS here", "No CITATIONS here"), ("CITATIONS\n[1]", "")])
def test_strip_citations(spark, text, want):
    assert one(spark, text, report.strip_citations) == want


@pytest.mark.parametrize("text, want", [
    ("**Answer:** A.\n\n**How it works:** H.\n**where to look next:** W.", ("A.", "H.", "W.")),
    ("**Answer:** A.\n**How it works:** H.", ("A.", "H.", None)), ("plain", ("plain", None, None)),
    ("x **How it works:** H", ("x **How it works:** H", "H", None)),
    ("**Answer:** one **Answer:** two", ("two", None, None))])
def test_answer_sections(spark, text, want):
    assert tuple(one(spark, text, report.answer_sections)) == want


@pytest.mark.parametrize("text, want", [
    ("OVERVIEW\nIt is.\n\nentry points  \nmain\nMAJOR MODULES\nm\nKEY ABSTRACTIONS\nk\nSTART HERE\ns\n",
     ("It is.", "main", "m", "k", "s")),
    ("OVERVIEW\na\nSTART HERE\nz", ("a", None, None, None, "z")), ("OVERVIEW is not alone", (None,) * 5)])
def test_briefing_sections(spark, text, want):
    assert tuple(one(spark, text, report.briefing_sections)) == want


def test_answer_record_without_hits(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, question string")
    r = spark.createDataFrame([(1, "**Answer:** yes [1]\nCITATIONS\n[1] f")], "query_id long, response string")
    a, b = report.answer_records(q, hits(spark, 9), r).orderBy("query_id").collect()
    assert (a["answer"], a["sections"]["answer"], a["chunks_used"], a["confidence"], len(a["citations"])) == (
        "**Answer:** yes [1]", "yes [1]", 8, "high", 1)
    assert (b["answer"], b["sections"], b["chunks_used"], b["confidence"]) == (
        "No relevant code found for this query.", None, 0, "low")


def test_reports(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, question string")
    a, b = report.format_hits(q, hits(spark, 2)).orderBy("query_id").collect()
    assert b["report"] == "No results found."
    assert "Function: n1  (lines 1–2)\nScore:    0.5000\n\nsrc1\n\n── Result 2" in a["report"]


def test_segments_are_whole_and_capped(spark):
    text = "one two three\n\n" + " ".join(f"w{i}" for i in range(1000)) + "\nlast, line."
    out = segment_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("segment").collect()
    assert all(r["token_count"] <= 300 for r in out)
    assert "".join("".join(r["source"] for r in out).split()) == "".join(text.split())
    assert out[0]["start_line"] == 1 and out[-1]["end_line"] == 4
