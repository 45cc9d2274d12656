"""Scores and orders of the retrieval operators on small tables."""

import pytest
from pyspark.sql import functions as F

from sparklode.operators import search, topk
from sparklode.plans.retrieve import retrieve

CHUNK = ("chunk_key string, file_path string, file_rel_path string, node_type string, name string, "
         "source string, start_line int, end_line int, calls array<string>, docstring string, "
         "parent_class string, is_truncated boolean, search_text string, repo_id string")


def chunk(key, name, text, calls=(), doc=None, repo="r"):
    return (key, f"/r/{key}.py", f"{key}.py", "function_definition", name, text, 1, 2, list(calls),
            doc, None, False, text, repo)


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([
        chunk("a", "walk_repo", "import os walk repo", ["helper", "missing", "main"]),
        chunk("b", "other", "walk only", ["helper2"]),
        chunk("c", "helper", "nothing here"),
        chunk("d", "helper2", "Repo Walk in capitals", repo="s"),
    ], CHUNK)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(
        [("a", [1.0, 0.0], "r"), ("b", [0.0, 1.0], "r"), ("c", [0.6, 0.8], "r"), ("d", [-1.0, 0.0], "s")],
        "chunk_key string, embedding array<float>, repo_id string")


def ask(spark, *texts, vec=(1.0, 0.0)):
    return spark.createDataFrame(
        [(i, t, list(vec)) for i, t in enumerate(texts)],
        "query_id long, question string, embedding array<float>")


def keys(df, order):
    return [r["chunk_key"] for r in df.orderBy("query_id", order).collect()]


@pytest.mark.parametrize("question, want", [
    ("os", ["a"]), ("a b", []), ("zzznomatch", []), ("walk repo!", ["a", "b"]), ("Walk walk", ["a", "b"]),
])
def test_keyword(spark, chunks, question, want):
    q = ask(spark, question)
    assert keys(search.keyword_topk(q, chunks), "krank") == want
    assert keys(search.keyword_topk_postings(q, search.build_postings(chunks)), "krank") == want


def test_repeated_tokens_count_again(spark, chunks):
    row = search.keyword_topk(ask(spark, "walk walk repo"), chunks).orderBy("krank").first()
    assert (row["chunk_key"], row["matches"]) == ("a", 3)


def test_vector_order_and_ties(spark, vectors):
    out = search.vector_topk(ask(spark, "x"), vectors, n=3).orderBy("vrank").collect()
    assert [r["chunk_key"] for r in out] == ["a", "c", "b"]
    assert [round(r["distance"], 6) for r in out] == [0.0, 0.8, 2.0]
    twins = vectors.unionByName(vectors.withColumn("chunk_key", F.concat("chunk_key", F.lit("2"))))
    assert keys(search.vector_topk(ask(spark, "x"), twins, n=3), "vrank") == ["a", "a2", "c"]


def test_vector_cosine(spark, vectors):
    out = search.vector_topk(ask(spark, "x", vec=(5.0, 0.0)), vectors, 4, "cosine").orderBy("vrank")
    assert [round(r["distance"], 6) for r in out.collect()] == [0.0, 0.4, 1.0, 2.0]


def test_repo_scope(spark, chunks, vectors):
    q = ask(spark, "walk repo in").withColumn("repo_id", F.lit("s"))
    assert keys(search.vector_topk(q, vectors), "vrank") == ["d"]
    assert keys(search.keyword_topk(q, chunks), "krank") == ["d"]


def test_question_blocks_give_the_same_result(spark, chunks, vectors, monkeypatch):
    q = ask(spark, *[f"walk repo {i}" for i in range(9)])
    one = sorted(map(tuple, search.keyword_topk(q, chunks).collect()))
    near = sorted(map(tuple, search.vector_topk(q, vectors).collect()))
    full = sorted(map(str, retrieve(q, chunks, vectors).collect()))
    monkeypatch.setattr(topk, "BLOCK_ROWS", 2)
    assert len(topk.question_blocks(q)) > 1
    assert sorted(map(tuple, search.keyword_topk(q, chunks).collect())) == one
    assert sorted(map(tuple, search.vector_topk(q, vectors).collect())) == near
    assert sorted(map(str, retrieve(q, chunks, vectors).collect())) == full


def ranked(spark, rows, name):
    return spark.createDataFrame([(0, k, i + 1) for i, k in enumerate(rows)],
                                 f"query_id long, chunk_key string, {name} int")


def test_rrf(spark):
    out = search.rrf([(ranked(spark, ["x", "y"], "vrank"), "vrank"),
                      (ranked(spark, ["y", "z"], "krank"), "krank")])
    score = {r["chunk_key"]: r["rrf_score"] for r in out.collect()}
    assert score["x"] == pytest.approx(1 / 61)
    assert score["y"] == pytest.approx(1 / 62 + 1 / 61)
    assert keys(out.withColumn("o", F.row_number().over(
        __import__("pyspark").sql.Window.orderBy(*search.fused_order()))), "o") == ["y", "x", "z"]


def test_rerank_name_boost_and_distance_base(spark, chunks):
    hits = chunks.withColumn("query_id", F.lit(0).cast("long")).withColumn("distance", F.lit(0.5))
    out = search.rerank(hits, ask(spark, "helper")).orderBy("hit_rank").collect()
    assert out[0]["name"] in ("helper", "helper2") and out[0]["rerank_score"] == pytest.approx(0.8)
    assert out[2]["rerank_score"] == pytest.approx(0.6)   # only its calls match


def test_expansion(spark, chunks):
    top = chunks.where("chunk_key IN ('a', 'b')").select(
        F.lit(0).cast("long").alias("query_id"),
        F.when(F.col("chunk_key") == "a", 1).otherwise(2).alias("hit_rank"), "chunk_key", "name",
        "calls", F.lit(0.1).alias("rrf_score"), F.lit(0.2).alias("rerank_score"))
    out = search.expand_calls(top, chunks).orderBy("hit_rank").collect()
    assert [r["chunk_key"] for r in out] == ["a", "b", "c", "d"]
    assert [r["rerank_score"] for r in out] == [0.2, 0.2, 0.005, 0.005]
    assert len(search.expand_calls(top, chunks, 1).collect()) == 3


def test_empty_tables(spark, chunks, vectors):
    q = ask(spark, "walk")
    assert retrieve(q.limit(0), chunks, vectors).count() == 0
    assert retrieve(q, chunks.limit(0), vectors.limit(0)).count() == 0


def test_equal_keys_in_two_repositories(spark, chunks, vectors):
    both = chunks.withColumn("repo_id", F.lit("s")).unionByName(chunks.withColumn("repo_id", F.lit("r")))
    v = vectors.withColumn("repo_id", F.lit("s")).unionByName(vectors.withColumn("repo_id", F.lit("r")))
    q = ask(spark, "walk repo").withColumn("repo_id", F.lit("s"))
    out = retrieve(q, both, v).orderBy("hit_rank").collect()
    assert {r["repo_id"] for r in out} == {"s"}
    assert [r["hit_rank"] for r in out] == list(range(1, len(out) + 1))
    found = search.keyword_topk_postings(q, search.build_postings(both))
    assert {r["repo_id"] for r in found.collect()} == {"s"}
    free = retrieve(ask(spark, "walk repo"), both, v)
    assert free.groupBy("repo_id", "chunk_key").count().where("count > 1").count() == 0


def test_chunks_without_a_repository(spark, chunks, vectors):
    nameless = spark.createDataFrame([chunk("a", "walk", "walk os", repo=None)], CHUNK)
    more = spark.createDataFrame([("a", [1.0, 0.0], None)], vectors.schema)
    got = search.vector_topk(ask(spark, "q"), vectors.unionByName(more), n=2).collect()
    assert {(r.chunk_key, r.repo_id) for r in got} == {("a", "r"), ("a", None)}
    got = search.keyword_topk(ask(spark, "os"), chunks.unionByName(nameless)).collect()
    assert {(r.chunk_key, r.repo_id) for r in got} == {("a", "r"), ("a", None)}


def test_unusable_vectors_are_reported(spark):
    v = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [None, 1.0]), ("c", [1.0]), ("d", [float("nan"), 0.0]),
         ("e", [0.0, 0.0]), ("f", None)], "chunk_key string, embedding array<float>")
    bad = {r["chunk_key"]: r["error"] for r in search.vector_errors(v, 2, "cosine").collect()}
    assert set(bad) == {"b", "c", "d", "e", "f"} and bad["c"] == "length 1, not 2"
    assert keys(search.vector_topk(ask(spark, "x"), v, metric="cosine"), "vrank") == ["a"]
    assert keys(search.vector_topk(ask(spark, "x"), v), "vrank") == ["a", "e"]
    uneven = ask(spark, "x").unionByName(ask(spark, "y", vec=(1.0,)))
    with pytest.raises(ValueError, match="differ in length"):
        search.vector_topk(uneven, v)


@pytest.mark.parametrize("size", [1, 64])
def test_segments_give_the_same_as_a_scan(spark, monkeypatch, size):
    import random
    from sparklode.operators import postings
    monkeypatch.setattr(postings, "SEGMENT_CHUNKS", size)
    monkeypatch.setattr(postings, "SEGMENT_CHARS", 100_000)
    r = random.Random(size)
    parts = ["ab", "abc", "bcd", "é", "zz", "x", "Ab", " q", "repo", "walk"]

    def text():
        return r.choice(" \n\t").join("".join(r.choices(parts, k=r.randint(1, 3)))
                                      for _ in range(r.randint(0, 12)))
    rows = [(r.choice(["r", "s", None]), f"/f{i % 9}", f"k{i:03}", r.choice([None, text(), text()]))
            for i in range(150)]
    rows += [("r", "/f", "k000", text()), ("s", "/f", "long", "ab " * 100_000)]
    table = spark.createDataFrame(
        rows, "repo_id string, file_path string, chunk_key string, search_text string")
    asked = spark.createDataFrame(
        [(i, r.choice(["r", "s"]), text()) for i in range(30)] + [(98, "r", ""), (99, "s", None)],
        "query_id long, repo_id string, question string")
    segments = postings.build_segments(table, 4)
    for questions in (asked.drop("repo_id"), asked):
        for n in (1, 5, 200):
            want = search.keyword_topk(questions, table, n)
            found = postings.keyword_topk_segments(questions, segments, n).select(*want.columns)
            assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    none = postings.keyword_topk_segments(asked, postings.build_segments(table.where("false"), 4))
    assert none.count() == 0
    assert postings.keyword_topk_segments(asked.where("false"), segments).count() == 0


def test_postings_shuffle_no_pairs(spark, chunks):
    """Postings in any order and the same question twice; only words and best rows are shuffled."""
    q = ask(spark, "walk repo", "os in")
    postings = search.build_postings(chunks).orderBy("word", "chunk_key")
    twice = postings.unionByName(postings).repartition(3)
    want = search.keyword_topk(q, chunks).select("query_id", "chunk_key", "matches", "krank")
    got = search.keyword_topk_postings(q, twice).select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    both = search.keyword_topk_postings(q.unionByName(q), postings)
    assert {r.matches for r in both.collect()} == {2 * r.matches for r in want.collect()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("questions", [1, 200, 1_000])
def test_scores_of_a_step_take_few_megabytes(questions):
    from sparklode.operators.topk import PartialTopN
    assert PartialTopN(questions, 20).rows_per_step() * questions * 8 <= 8 << 20
