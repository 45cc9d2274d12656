"""Python definitions as chunks, from a table of lines.

A block ends before the next statement that is not indented deeper. For every
indentation at which a file has definitions, the statements indented at most
that far form one ordered list, and the end of a definition is its successor
there: a ``lead`` per (file, indentation), linear in the number of lines.
Balanced lines deeper than every definition cannot end one; they are dropped
before the shuffle, so mostly headers travel and never any text.
Lines that begin inside a string, inside brackets or after a backslash are
no statements. Decorator lines directly above belong to the definition.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparklode.functions import lex
from sparklode.functions import text as X
from sparklode.operators.nesting import FILE, KEYS, resolve_nesting

_ID = r"[\p{L}_][\p{L}\p{N}_]*+"
_DEF = rf"^\s*(?:async\s+)?(def|class)\s+({_ID})"
_ROUND = rf"[({lex.LOST_CALL}]"
# Statements match (x): and case (x): open a block, they call nothing.
# The name and its bracket come first: few places have to be looked at behind.
_CALL = (rf"(?m)(?<![\p{{L}}\p{{N}}_])(?={_ID}\s*+{_ROUND})(?<!\bdef )(?<!\bclass )"
         rf"(?!(?:match|case)(?<=^[ \t]{{0,199}}(?:match|case))\s*+{_ROUND}[^\n]*:[ \t]*$)"
         rf"({_ID})\s*+{_ROUND}")
_HEADER = (rf"\A\s*(?:async\s+)?(?:def|class)\s+{_ID}\s*"
           r"(?:\[[^\]]*+\])?\s*"
           r"(?:\([^()]*+\))?"
           r"\s*(?:->[^:]*+)?:\s*")
_DOC = rf"\A{lex.OPEN}[{lex.INSIDE}\n]*(?=[ \t]*(?:\n|;|\z))"
# Words that may stand before "(" without being called.
_KEYWORDS = [
    "and", "as", "assert", "async", "await", "class", "def", "del", "elif", "else",
    "except", "for", "from", "if", "import", "in", "is", "lambda", "not", "or",
    "raise", "return", "while", "with", "yield",
]


def _width(blanks) -> Column:
    return F.length(F.replace(blanks, F.lit("\t"), F.lit(" " * 8)))


def _delta(line: str) -> Column:
    """Brackets that a masked line opens beyond those it closes: brackets never nest there
    (see ``lex``), so the first and the last one of a line tell."""
    opens = F.col(line).rlike(r"[(\[{][^()\[\]{}]*+\z").cast("int")
    return opens - F.col(line).rlike(r"\A[^()\[\]{}]*+[)\]}]").cast("int")


def python_definitions(files: DataFrame) -> DataFrame:
    """row, first (with decorators), def_line, last, kind, name, parent.

    ``files``: row, masked. Blank and comment lines may still follow
    the definition within ``last``.
    """
    f = files.select(*KEYS, "masked")
    levels = F.array_distinct(F.transform(F.regexp_extract_all(
        "masked", F.lit(r"(?m)^([ \t]*)(?:async[ \t]+)?(?:def|class)\s"), F.lit(1)), _width))
    f = f.select(*KEYS, F.split("masked", "\n").alias("lines"), levels.alias("levels"))
    line = f.where(F.size("levels") > 0).select(
        *KEYS, "levels", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("i", "line"))
    line = line.select(
        *KEYS, "levels", "n_lines", "line", (F.col("i") + 1).alias("line_no"),
        _width(F.left("line", F.length("line") - F.length(F.ltrim("line", F.lit(" \t")))))
        .alias("indent"),
        _delta("line").alias("delta"),
        F.rtrim("line", F.lit(" \t\r")).endswith("\\").alias("goes_on"))
    line = line.where(
        (F.col("delta") != 0) | F.col("goes_on")
        | ((F.col("indent") <= F.array_max("levels")) & (F.btrim("line", F.lit(" \t\r\f")) != "")))
    line = line.select(
        *KEYS, "levels", "n_lines", "line_no", "indent", "delta", "goes_on",
        F.col("line").startswith(lex.INSIDE).alias("inside"),
        F.col("line").rlike(r"^\s*@").alias("is_decorator"),
        F.regexp_extract("line", _DEF, 1).alias("kind"),
        F.regexp_extract("line", _DEF, 2).alias("name"))

    w = Window.partitionBy(*KEYS).orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    stmt = line.select(
        "*", F.coalesce(F.sum("delta").over(before), F.lit(0)).alias("open"),
        F.lag(F.when(F.col("goes_on"), F.col("line_no"))).over(w).alias("goes_on_at"))
    stmt = stmt.where(~F.col("inside") & (F.col("open") <= 0) & ~F.coalesce(
        F.col("goes_on_at") == F.col("line_no") - 1, F.lit(False)))
    stmt = stmt.select("*", F.lead("line_no").over(w).alias("next_no"))
    stmt = stmt.select("*", F.coalesce(
        F.max(F.when(~F.col("is_decorator"), F.col("next_no"))).over(before),
        F.first("line_no").over(before), F.col("line_no")).alias("first"))

    per_level = stmt.select(
        *KEYS, "line_no", "indent", "kind", "name", "first", "n_lines",
        F.explode("levels").alias("level")).where(F.col("level") >= F.col("indent"))
    ends = per_level.withColumn("last", F.coalesce(F.lead("line_no").over(
        Window.partitionBy(*KEYS, "level").orderBy("line_no")) - 1, "n_lines"))
    defs = ends.where((F.col("kind") != "") & (F.col("level") == F.col("indent"))).select(
        *KEYS, "first", F.col("line_no").alias("def_line"), "last", "kind", "name",
        (F.col("kind") == "def").alias("is_function"), F.col("indent").alias("depth"))
    return resolve_nesting(defs)


def python_chunks(files: DataFrame) -> DataFrame:
    """Chunk columns before the token cap; see ``segment.chunk_files``."""
    found = python_definitions(files).groupBy(*KEYS).agg(F.sort_array(F.collect_list(
        F.struct("first", "def_line", "last", "kind", "name",
                 F.col("parent.name").alias("parent")))).alias("defs"))
    # One row per file again: its lines are split once and cut per definition.
    f = files.select(*KEYS, *FILE, F.split("text", "\n").alias("lines"),
                     F.split("masked", "\n").alias("masked"))

    def cut(lines, a, b):
        return F.array_join(F.slice(lines, a, b - a + 1), "\n")

    rows = f.join(found, KEYS).select(*FILE, F.inline(F.transform("defs", lambda d: F.struct(
        d["kind"].alias("kind"), d["name"].alias("name"), d["parent"].alias("parent_class"),
        d["first"].alias("start_line"), d["def_line"].alias("def_line"),
        cut("lines", d["first"], d["def_line"] - 1).alias("decorators"),
        cut("lines", d["def_line"], d["last"]).alias("raw"),
        cut("masked", d["def_line"], d["last"]).alias("masked")))))
    # Trailing blanks and comments are no part of a definition.
    rows = rows.withColumn("masked", X.rstrip("masked")).withColumn(
        "raw", F.left("raw", F.length("masked")))
    whole = F.concat_ws("\n", F.nullif("decorators", F.lit("")), "raw")
    return rows.select(
        *FILE, F.when(F.col("kind") == "def", "function_definition")
        .otherwise("class_definition").alias("node_type"),
        "name", F.regexp_replace(whole, r"\A[ \t]+", "").alias("source"), "start_line",
        (F.col("def_line") + X.line_breaks("masked")).alias("end_line"),
        F.lit(0).alias("ordinal"), python_calls("masked").alias("calls"),
        docstring("raw", "masked").alias("docstring"), "parent_class")


def python_calls(masked) -> Column:
    """Distinct called names, sorted: the last name segment before a bracket."""
    names = F.regexp_extract_all(masked, F.lit(_CALL), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(
        names, lambda n: ~n.isin(_KEYWORDS))))


def docstring(raw, masked) -> Column:
    """The string literal that is the first statement, delimiters removed."""
    head = F.length(F.regexp_extract(masked, _HEADER, 0))
    body = F.substr(masked, head + 1)
    size = F.length(F.regexp_extract(body, _DOC, 0))
    literal = F.trim(F.substr(raw, head + 1, size))
    bare = F.regexp_replace(literal, r"(?s)\A\s*[rRbBuUfF]{0,2}(\"\"\"|'''|\"|')(.*)\1\s*\z", "$2")
    return F.when((head > 0) & (size > 0), F.regexp_replace(bare, r"\A\s+|\s+\z", ""))
