"""Typed views over the driver tables: the inputs of the registered queries.

Each view is derived from whole tables; ``oracle.py`` states the same views in
SQL. Nothing here is sampled, cut or capped.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparklode import model as M
from sparklode.functions import text as X

# A document becomes one chunk; its file name is picked by doc_id modulo 5.
FILE_NAMES = ["util.py", "core.ts", "view.jsx", "Index.js", "main.py"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a table of fewer files than cores to all cores (test input is one file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def _word(x):
    return F.btrim(x, F.lit(M.TOKEN_STRIP_CHARS))


def chunks(spark, sf) -> DataFrame:
    d = spread(table(spark, sf, "documents"))
    names = F.array(*[F.lit(n) for n in FILE_NAMES])
    lines = F.split("text", "\n")
    rel = F.concat("source", F.lit("/"), F.element_at(
        names, F.pmod("doc_id", F.lit(5)).cast("int") + 1))
    path = F.concat(F.lit("/"), "lang", F.lit("/"), rel)
    calls = F.array_sort(F.array_distinct(F.filter(F.transform(
        F.split(F.element_at(lines, -1), r"\s+"), _word), lambda w: w != "")))
    out = d.select(
        F.col("lang").alias("repo_id"),
        F.concat_ws(":", path, F.col("doc_id").cast("string")).alias("chunk_key"),
        path.alias("file_path"), rel.alias("file_rel_path"),
        F.when(F.col("n_chars") % 2 == 0, "function_definition")
        .otherwise("class_definition").alias("node_type"),
        _word(F.element_at(F.split("text", r"\s+"), 1)).alias("name"),
        F.col("text").alias("source"),
        F.col("doc_id").cast("int").alias("start_line"),
        (F.col("doc_id") + F.size(lines) - 1).cast("int").alias("end_line"),
        calls.alias("calls"),
        F.element_at(lines, 1).alias("docstring"),
        F.when(F.col("n_chars") % 3 == 0, F.col("source")).alias("parent_class"),
        (F.col("n_chars") > 2000).alias("is_truncated"),
        F.col("doc_id"))
    return out.withColumn("search_text", X.search_text())


def vectors(spark, sf) -> DataFrame:
    """Chunk vectors: vec_id is the doc_id of the chunk it belongs to."""
    keys = chunks(spark, sf).select("doc_id", "repo_id", "chunk_key")
    return (spread(table(spark, sf, "embeddings"))
            .join(keys, F.col("vec_id") == F.col("doc_id"))
            .select("repo_id", "chunk_key", "embedding"))


def shared_chunks(spark, sf) -> DataFrame:
    """Two repositories with the same chunk keys; the second is searched by docstring."""
    c = chunks(spark, sf)
    return c.withColumn("repo_id", F.lit("r")).unionByName(
        c.withColumns({"repo_id": F.lit("s"), "search_text": F.col("docstring")}))


def shared_vectors(spark, sf) -> DataFrame:
    """Vectors of both; those of the second point the other way."""
    v = vectors(spark, sf)
    return v.withColumn("repo_id", F.lit("r")).unionByName(v.withColumns({
        "repo_id": F.lit("s"), "embedding": F.transform("embedding", lambda x: -x)}))


def scoped_queries(spark, sf) -> DataFrame:
    """Even questions ask the first repository, odd ones the second."""
    return queries(spark, sf).withColumn(
        "repo_id", F.when(F.col("query_id") % 2 == 0, "r").otherwise("s"))


def queries(spark, sf) -> DataFrame:
    """Every benchmark text is a question; its vector is the one of equal id."""
    q = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    v = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), "embedding")
    return q.join(v, "query_id", "left")


def part_edges(spark, sf) -> DataFrame:
    """Call graph of parts: within an order, each line calls the next line."""
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    steps = (table(spark, sf, "lineitem")
             .select("l_orderkey", F.col("l_partkey").alias("src"),
                     F.lead("l_partkey").over(w).alias("dst"))
             .where(F.col("dst").isNotNull()).select("src", "dst").distinct())
    return steps.select(F.lit("parts").alias("repo_id"),
                        F.col("src").cast("string").alias("src_name"),
                        F.col("dst").cast("string").alias("dst_name"))


# Path predicates: directories and file names are combined by doc_id.
DIRS = ["src/pkg", "tests", ".git/hooks", "web/node_modules/x", "lib/Spec", "app/.hidden",
        "SRC2/core", "e2e/deep"]
NAMES = ["test_a.py", "b_test.py", "main.py", "a.test.ts", "b.TSX", "c.jsx", "Makefile",
         ".py", "d.tar.js"]


def listed_paths(spark, sf) -> DataFrame:
    """One path per document, with a made-up size derived from its length."""
    dirs, names = (F.array(*[F.lit(x) for x in xs]) for xs in (DIRS, NAMES))
    rel = F.concat(F.get(dirs, F.pmod("doc_id", F.lit(8)).cast("int")), F.lit("/"),
                   F.get(names, F.pmod(F.floor(F.col("doc_id") / 8), F.lit(9)).cast("int")))
    return table(spark, sf, "documents").select(
        "doc_id", rel.alias("rel"), F.concat(F.lit("/r/"), "lang", F.lit("/"), rel).alias("path"),
        F.concat(F.lit("/r/"), "lang").alias("root"), "lang",
        (F.col("n_chars") * 100).alias("length"))


def hits(spark, sf) -> DataFrame:
    """Ranked hits per conversation: turn t of conversation c hits document c + t."""
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"), (F.col("conv_id") + F.col("turn")).alias("doc_id"))
    from sparklode.operators.topk import rank_rows
    score = (F.pmod(F.col("doc_id") * 37, F.lit(100)) / F.lit(100.0))
    h = turns.join(chunks(spark, sf), "doc_id").withColumn("rerank_score", score)
    return rank_rows(h, [F.desc("rerank_score"), "chunk_key"], None, "hit_rank")


def _joined(rows, order, text, sep, name):
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))),
        lambda r: r["t"]), sep).alias(name))


def conv_questions(spark, sf) -> DataFrame:
    """Every conversation; its question is the text of its user turns."""
    c = table(spark, sf, "conversations").withColumnRenamed("conv_id", "query_id")
    asked = _joined(c.where("role = 'user'"), "turn", F.col("text"), " ", "question")
    return c.select("query_id").distinct().join(asked, "query_id", "left").select(
        "query_id", F.coalesce("question", F.lit("")).alias("question"))


def responses(spark, sf) -> DataFrame:
    """Assistant turns with section headers, [n] marks and a CITATIONS block."""
    from pyspark.sql import Window
    c = (table(spark, sf, "conversations").where("role = 'assistant'")
         .withColumnRenamed("conv_id", "query_id")
         .withColumn("k", F.row_number().over(
             Window.partitionBy("query_id").orderBy("turn"))))
    head = (F.when(F.col("k") == 1, "**Answer:** ").when(F.col("k") == 2, "**how it works:** ")
            .when(F.col("k") == 3, "**Where to look next:** ").otherwise(""))
    text = F.concat(head, "text", F.lit(" ["), F.col("turn").cast("string"), F.lit("]"))
    body = _joined(c, "turn", text, "\n", "body")
    return body.select("query_id", F.concat(
        "body", F.lit("\n  Citations:\n[1] somewhere")).alias("response"))


def briefings(spark, sf) -> DataFrame:
    """All turns of a conversation, the first five under briefing headers."""
    from pyspark.sql import Window
    heads = F.array(*[F.lit(h) for h in M.BRIEFING_HEADERS.values()])
    c = (table(spark, sf, "conversations").withColumnRenamed("conv_id", "query_id")
         .withColumn("k", F.row_number().over(
             Window.partitionBy("query_id").orderBy("turn"))))
    head = F.get(heads, F.col("k") - 1)
    head = F.when(F.col("query_id") % 2 == 0, F.lower(head)).otherwise(head)
    text = F.concat(F.coalesce(F.concat(head, F.lit("  \n")), F.lit("")), "text")
    return _joined(c, "turn", text, "\n", "briefing")


def files(spark, sf) -> DataFrame:
    """Every document as a source file."""
    path = F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/doc_"),
                    F.col("doc_id").cast("string"), F.lit(".py"))
    return spread(table(spark, sf, "documents")).select(
        F.col("lang").alias("repo_id"), path.alias("file_path"),
        F.expr("substring(concat('/', source, '/doc_', doc_id, '.py'), 2)").alias("file_rel_path"),
        F.octet_length("text").cast("long").alias("length"),
        F.col("text").cast("binary").alias("content"), "doc_id")


def old_hashes(spark, sf) -> DataFrame:
    """Stored hashes: labelled documents (toxic ones with other content), and pages
    as files that no longer exist."""
    f = files(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    old = F.when(F.col("toxic") == 1, F.concat(F.col("content"), F.lit("x").cast("binary"))
                 ).otherwise(F.col("content"))
    known = f.select("repo_id", "file_path", F.sha2(old, 256).alias("sha256"))
    pages = table(spark, sf, "pages").select(
        F.lit("en").alias("repo_id"),
        F.concat(F.lit("/en/pages/p_"), F.col("page_id").cast("string"), F.lit(".js")).alias("file_path"),
        F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))
    return known.unionByName(pages)


def old_chunks(spark, sf) -> DataFrame:
    """Two stored chunks for every stored file."""
    return old_hashes(spark, sf).select(
        "repo_id", "file_path", F.explode(F.array(F.lit(1), F.lit(9))).alias("start_line"))


def _code_lines(spark, sf):
    """Documents with their lines reduced to ASCII words, and call names from them."""
    d = spread(table(spark, sf, "documents"))
    # \p{Alnum} is [A-Za-z0-9]; with the ranges written out the threads of a JVM hinder each
    # other at every character (8 threads: 30 times as long).
    clean = F.transform(F.split("text", "\n"), lambda x: F.trim(
        F.regexp_replace(x, r"[^\p{Alnum} ]+", " ")))
    return d.select("doc_id", "lang", "source", clean.alias("lines"))


def _called(line, last: bool):
    """The first or last run of three letters or more in a line of blanks, letters and digits."""
    before = r"\A.*(?<![A-Za-z])" if last else ""
    word = F.regexp_extract(line, before + r"([A-Za-z]{3,})", 1)
    return F.concat(F.lit("w_"), F.coalesce(F.nullif(word, F.lit("")), F.lit("none")))


def python_files(spark, sf) -> DataFrame:
    """Each document as a Python class with one decorated method per line."""
    d = _code_lines(spark, sf)
    methods = F.transform("lines", lambda x, i: F.concat(
        F.lit("    @mark("), i.cast("string"), F.lit(")\n    def fn_"), i.cast("string"),
        F.lit("(self, a=\"def no():\"):\n        '''"),
        x, F.lit("'''\n        "), _called(x, False), F.lit("("), _called(x, True),
        F.lit("())\n        return x  # call_"), i.cast("string"), F.lit("()\n")))
    text = F.concat(F.format_string("class Doc_%d:\n    \"\"\"", "doc_id"),
                    F.get("lines", F.lit(0)), F.lit("\"\"\"\n"), F.array_join(methods, "\n"))
    return _as_files(d, text, ".py")


def js_files(spark, sf) -> DataFrame:
    """Each document as a class with one method per line, an arrow, a callback."""
    d = _code_lines(spark, sf)
    methods = F.transform("lines", lambda x, i: F.concat(
        F.lit("  fn_"), i.cast("string"), F.lit("(a, b) {\n    return "), _called(x, False), F.lit("("),
        _called(x, True), F.lit("(`x ${a} }`));\n  }\n")))
    text = F.concat(
        F.format_string("// header \"class Fake {\"\nexport class Doc_%d extends Base {\n", "doc_id"),
        F.array_join(methods, "\n"), F.lit("\n}\n"),
        F.format_string("const arrow_%d = (x) => { ", "doc_id"),
        _called(F.get("lines", F.lit(0)), False),
        F.lit("(x); };\nitems.map(function (y) { hidden(y); });\n"))
    return _as_files(d, text, ".ts")


def _as_files(d, text, ext):
    rel = F.format_string("%s/doc_%d%s", "source", "doc_id", F.lit(ext))
    return d.select(
        F.col("lang").alias("repo_id"), F.concat(F.lit("/"), "lang", F.lit("/"), rel).alias("file_path"),
        rel.alias("file_rel_path"), F.length(text).cast("long").alias("length"),
        text.cast("binary").alias("content"))
