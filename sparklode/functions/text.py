"""Column expressions on question, chunk and answer text (all JVM-side)."""

from pyspark.sql import Column, functions as F

from sparklode import model as M

TOKEN = r"\w+|[^\w\s]"


def question_tokens(question, min_length: int = 2) -> Column:
    """Whitespace split, punctuation stripped at both ends, lower case.

    Repeated tokens stay: each occurrence counts. ``min_length`` is 2 for
    keyword search and 1 for re-ranking.
    """
    stripped = F.transform(F.split(question, r"\s+"),
                           lambda t: F.btrim(t, F.lit(M.TOKEN_STRIP_CHARS)))
    return F.transform(F.filter(stripped, lambda t: F.length(t) >= min_length),
                       lambda t: F.lower(t))


def search_text(rel="file_rel_path", node_type="node_type", name="name",
                docstring="docstring", source="source") -> Column:
    """The document that is embedded and keyword-searched."""
    kind = F.replace(F.col(node_type), F.lit("_definition"), F.lit(""))
    return F.concat_ws(
        "\n\n",
        F.when(F.col(rel) != "", F.concat(F.lit("file: "), F.col(rel))),
        F.concat(kind, F.lit(": "), F.col(name)),
        F.nullif(F.col(docstring), F.lit("")),
        F.col(source))


def confidence(score, high: float = M.CONFIDENCE_HIGH,
               medium: float = M.CONFIDENCE_MEDIUM) -> Column:
    return (F.when(score >= high, "high").when(score >= medium, "medium")
            .otherwise("low"))


def token_count(text) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def rstrip(text) -> Column:
    """Text without the blanks (``\\s``) at its end."""
    return F.rtrim(text, F.lit(" \t\n\x0b\f\r"))


def line_breaks(text) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def first_tokens(text, n: int = M.CHUNK_TOKEN_CAP) -> Column:
    """Text up to the end of its n-th token."""
    return F.regexp_extract(text, rf"^(?:\s*(?:{TOKEN})){{0,{n}}}", 0)
