"""JavaScript and TypeScript definitions as chunks, from a table of marks.

The masked text is cut into definition headers, brackets and separators. The
running bracket depth gives each mark its level; a definition with a block ends
at the next closing brace that returns to its level, an arrow with a plain
expression at the next separator on its level. Both are windows per (file,
level). Callbacks and other unnamed functions give no row but hide what is
inside them.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparklode.functions import text as X
from sparklode.functions.lex import LOST_CALL
from sparklode.operators.nesting import FILE, KEYS, resolve_nesting


def nested(left: str, right: str, depth: int) -> str:
    """Pattern of text between two brackets, nested up to ``depth`` times."""
    plain = rf"[^{left}{right}]++"
    pattern = rf"{left}(?:{plain})*+{right}"
    for _ in range(depth - 1):
        pattern = rf"{left}(?:{plain}|{pattern})*+{right}"
    return pattern


_NAME = r"[\p{L}_$][\w$]*+"
_PARAMS = nested(r"\(", r"\)", 12)
_OBJECT = nested(r"\{", r"\}", 4)
# A type may be or hold an object type; what follows it decides where it ends.
_TYPE = rf"(?:\s*:(?:[^={{}};]++(?:{_OBJECT}[^={{}};]*+)?|\s*{_OBJECT}[^={{}};]*+))?"
_ARROW = rf"(?:async\s+)?(?:<[^>(]*+>\s*)?(?:{_PARAMS}{_TYPE}|{_NAME})\s*=>\s*"
_FUNCTION = rf"(?:async\s+)?function\b\s*\*?\s*(?:{_NAME})?\s*(?:<[^>(]*+>)?\s*{_PARAMS}{_TYPE}\s*(?=\{{)"
_BEFORE_NAME = r"(?:(?:const|let|var)\s+)?"
_ASSIGNED = rf"{_BEFORE_NAME}{_NAME}(?:\s*:[^=;\n]*+)?\s*=(?![=>])\s*"
_MODIFIERS = r"(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*+(?:\*\s*)?"
# Words before "(...) {" or "(" that name no function.
_RESERVED = (r"(?:if|for|while|switch|catch|with|function|return|else|do|try|new|await"
             r"|super|typeof|delete|void|throw|case|in|of|instanceof|yield|import)\b")
_METHOD = rf"{_MODIFIERS}#?(?!{_RESERVED}){_NAME}\s*(?:<[^>(]*+>)?\s*{_PARAMS}{_TYPE}\s*(?=\{{)"
_ANGLES = rf"<(?:[^<>{{}}]++|{_OBJECT}|<(?:[^<>{{}}]++|{_OBJECT})*+>)*+>"
_CLASS = rf"class\s+(?!extends\b){_NAME}(?:[^{{}}();<]++|{_ANGLES}|{_PARAMS})*+(?=\{{)"
_HEAD = rf"(?<![\w$.#])(?:{_CLASS}|{_ASSIGNED}(?:{_FUNCTION}|{_ARROW})|{_FUNCTION}|{_ARROW}|{_METHOD})|{_ARROW}"
_BREAK = r"(?<![-+*/&|=?:,<>]|[-+*/&|=?:,<>] )\n(?!\s*(?:[.?:&|+*/)\]}=,<>-]|\z))"
_REST = rf"(?:{_NAME}|\d[\w$]*+|[^\w$(){{}}\[\];,\n]|\n)"
# Round brackets in which nothing begins end nothing outside either: they are one mark.
_GROUP = rf"\((?:(?!{_HEAD})(?:{_REST}|[;,]))*+\)"
_GROUP = rf"\((?:(?!{_HEAD})(?:{_REST}|[;,]|{_GROUP}))*+\)"
_MARK = (rf"{_HEAD}|{_GROUP}|[(){{}}\[\];,]|{_BREAK}|(?:(?!{_HEAD}|{_BREAK}){_REST})++|[\s\S]")
# Without arrows that return a plain expression, separators end nothing.
_BLOCK_MARK = rf"{_HEAD}|{_GROUP}|[(){{}}\[\]]|(?:(?!{_HEAD})(?:{_REST}|[;,]))++|[\s\S]"
_PLAIN_ARROW = r"=>\s*(?!\{)\S"
_HEAD_TEXT = rf"\A(?:class\s+{_NAME}[\s\S]|[\s\S]*=>\s*\z|[\s\S]*{_PARAMS}{_TYPE}\s*\z)"
_CALL = rf"(?<![\w$#])(?<!\bnew )(?<!\bfunction )(?!{_RESERVED}|async\b)(#?{_NAME})\s*(?:<[\w\s,.\[\]|]*+>)?(?:\((?![^()]*+\)\s*\{{)|{LOST_CALL})"


def js_definitions(files: DataFrame) -> DataFrame:
    """row, first, last (0-based offsets), line, is_function, name, parent."""
    # Texts are dealt before their many marks are made, so no mark is shuffled; with a number, as
    # the bytes of masked texts, which Spark would join partitions by, say little of the marks.
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f = files.select(*KEYS, "masked").repartition(n, *KEYS)
    marks = F.when(F.col("masked").rlike(_PLAIN_ARROW), F.regexp_extract_all(
        "masked", F.lit(f"({_MARK})"), F.lit(1))).otherwise(F.regexp_extract_all(
            "masked", F.lit(f"({_BLOCK_MARK})"), F.lit(1)))
    t = f.select(*KEYS, F.length("masked").alias("size"),
                 F.posexplode(marks).alias("i", "t"))
    # Only headers and single marks keep their text in the shuffle. Of the others only groups
    # hold a bracket; a header that begins with one is an arrow.
    text = F.col("t")
    head = F.when(text.startswith("("), text.contains("=>") & text.rlike(r"=>\s*\z")).otherwise(
        (text.contains("(") | text.contains("=>") | text.startswith("class"))
        & text.rlike(_HEAD_TEXT))
    t = t.select(*KEYS, "size", "i", F.length("t").alias("n"), X.line_breaks("t").alias("breaks"),
                 F.when((F.length("t") == 1) | head, text).alias("t"))
    w = Window.partitionBy(*KEYS).orderBy("i")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    one = F.col("n") == 1
    opens = one & F.col("t").isin("(", "[", "{")
    closes = one & F.col("t").isin(")", "]", "}")
    head = (F.col("n") > 1) & F.col("t").isNotNull()
    t = t.select(
        *KEYS, "i", "size", "t", head.alias("is_head"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"),
        F.coalesce(F.sum("breaks").over(before), F.lit(0)).alias("breaks"),
        F.coalesce(F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(before),
                   F.lit(0)).alias("depth"),
        F.lead("t").over(w).alias("next"))
    t = t.where(F.col("is_head") | F.col("t").isin("}", ")", "]", ";", ",", "\n"))

    row = F.struct
    lv = F.lit(None).cast("int")
    own = row(F.col("depth").alias("level"), lv.alias("block"),
              F.when(~F.col("is_head"), F.col("at").cast("int")).alias("stop"))
    outer = row((F.col("depth") - 1).alias("level"), (F.col("at") + 1).cast("int").alias("block"),
                lv.alias("stop"))
    rows = F.when(F.col("t") == "}", F.array(own, outer)).otherwise(F.array(own))
    e = t.select(*KEYS, "i", "size", "is_head", "at", "breaks", "depth", "t",
                 "next", F.inline(rows))
    later = (Window.partitionBy(*KEYS, "level").orderBy(F.desc("i"), F.desc("is_head"))
             .rowsBetween(Window.unboundedPreceding, -1))
    e = e.select("*", F.last("block", ignorenulls=True).over(later).alias("block_end"),
                 F.last("stop", ignorenulls=True).over(later).alias("expr_end"))
    h = e.where("is_head")

    has_block = F.col("next") == "{"
    end = F.coalesce(F.when(has_block, F.col("block_end")).otherwise(F.col("expr_end")),
                     F.col("size"))
    assigned = F.length(F.regexp_extract("t", rf"\A{_ASSIGNED}(?=async\b|function\b|\(|<|{_NAME}\s*=>)", 0))
    assigned = F.when(F.col("t").rlike(r"\Aclass\s"), 0).otherwise(assigned)
    kind = (F.when(F.col("t").rlike(r"\Aclass\s"), "class")
            .when(assigned > 0, "assigned")
            .when(F.col("t").rlike(r"\A(?:async\s+)?function\b"), "function")
            .when(F.col("t").rlike(r"=>\s*\z"), "arrow").otherwise("method"))
    name = (F.when(kind == "class", F.regexp_extract("t", rf"\Aclass\s+({_NAME})", 1))
            .when(kind == "assigned", F.regexp_extract("t", rf"\A{_BEFORE_NAME}({_NAME})", 1))
            .when(kind == "function", F.regexp_extract("t", rf"\A(?:async\s+)?function\s+({_NAME})", 1))
            .when(kind == "method", F.regexp_extract("t", rf"\A{_MODIFIERS}({_NAME})", 1))
            .otherwise(""))
    defs = h.select(
        *KEYS, (F.col("at") + assigned).cast("int").alias("first"),
        (F.col("breaks") + 1 + F.regexp_count(F.left("t", assigned), F.lit("\n")))
        .cast("int").alias("line"),
        (end - 1).cast("int").alias("last"), (kind != "class").alias("is_function"),
        name.alias("name"), F.col("depth").cast("int").alias("depth"), kind.alias("kind"),
        ((kind == "assigned") & ~F.col("t").rlike(r"\A(?:const|let|var)\s")).alias("bare"),
        F.col("t").rlike(r"\A(?:async\s+)?function\s*\*").alias("is_generator"))
    nested = resolve_nesting(defs.where(~F.col("is_generator")).drop("is_generator"))
    # name = () => ... directly in a class body is a field, not a named function.
    is_field = F.col("bare") & (F.col("depth") == F.col("parent.depth") + 1)
    return nested.where((F.col("name") != "") & ~F.coalesce(is_field, F.lit(False)))


def js_chunks(files: DataFrame) -> DataFrame:
    """Chunk columns before the token cap; see ``segment.chunk_files``."""
    found = js_definitions(files).groupBy(*KEYS).agg(F.sort_array(F.collect_list(
        F.struct("first", "last", "kind", "name", F.col("parent.name").alias("parent"),
                 "line"))).alias("defs"))
    f = files.select(*KEYS, *FILE, "text", "masked").join(found, KEYS)
    f = f.select(*FILE, "text", "masked", F.transform("defs", lambda d: F.struct(
        d["first"].alias("first"),
        (d["last"] - d["first"] + 1).alias("size"),
        d["kind"].alias("kind"), d["name"].alias("name"), d["parent"].alias("parent"),
        d["line"].alias("line"))).alias("defs"))
    f = f.withColumn("starts", F.transform("defs", lambda d: d["line"]))
    rows = f.select(*FILE, F.inline(F.transform("defs", lambda d, i: F.struct(
        d["kind"].alias("kind"), d["name"].alias("name"), d["parent"].alias("parent_class"),
        d["line"].alias("start_line"),
        (i + 1 - F.array_position("starts", d["line"])).cast("int").alias("ordinal"),
        F.substr("text", d["first"] + 1, d["size"]).alias("source"),
        F.substr("masked", d["first"] + 1, d["size"]).alias("masked")))))
    rows = rows.withColumn("source", X.rstrip("source")).withColumn(
        "masked", F.left("masked", F.length("source")))
    is_class = F.col("kind") == "class"
    return rows.select(
        *FILE, F.when(is_class, "class").otherwise("function").alias("node_type"), "name",
        "source", "start_line",
        (F.col("start_line") + X.line_breaks("source")).alias("end_line"),
        "ordinal", F.when(is_class, F.array().cast("array<string>"))
        .otherwise(js_calls("masked")).alias("calls"),
        F.lit("").alias("docstring"), "parent_class")


def js_calls(masked) -> Column:
    """Distinct called names in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(masked, F.lit(_CALL), F.lit(1)))
