"""Quality rules with thresholds from mergeable quantile sketches per language and source.

Counts per text come from one pass. Each ratio is then put into a sketch per (lang, source):
a log-linear histogram with integer buckets, at most 1/16 wide relative to the value, so
sketches merge by adding counts and do not depend on the partitioning. The fence of a group
is its upper decile plus a multiple of the spread between upper decile and median, which counts
as ``LEAST`` buckets where the group has less; a text that lies beyond a fence of its own group
fails. There are no fixed cutoffs: what one group calls too much is normal in another.
"""

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparklode.llm.common import encoded, slices, store, table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(rb"[#*$%&|<>]")
CONTINUATION = bytes(range(0x80, 0xC0))
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
SPREAD, LEAST = 2, 8


def counts_of(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    words = WORD.findall(raw)
    n = len(words)
    chars = len(b"".join(words).translate(None, CONTINUATION))
    symbols = len(SYMBOL.findall(raw))
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
    repeated = 0
    if n > WINDOW:
        grams = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(grams)) < len(grams):
            often = {g for g, c in Counter(grams).items() if c > 1}
            end = 0   # words before it are counted already
            for i, gram in enumerate(grams):
                if gram in often:
                    repeated += i + WINDOW - max(i, end)
                    end = i + WINDOW
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_counts(docs: DataFrame, keep, text: str = "text") -> DataFrame:
    """The ``keep`` columns and the five counts per row. NULL has no words."""
    keep = list(keep)
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches):
        for b in slices(batches, len(keep)):
            rows = list(zip(*map(counts_of, encoded(b.column(len(keep))))))
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(keep))]
                + [pa.array(r, pa.int64()) for r in rows], names=[*keep, *COUNTS])

    return docs.select(*keep, text).mapInArrow(
        run, kinds + ", ".join(f"{c} long" for c in COUNTS))


def _ratios() -> dict:
    per = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_words"),
           "repeats": ("n_repeat_words", "n_words"),
           "word_chars_per_word": ("word_chars", "n_words")}
    return {name: F.expr(f"1000 * {a} div greatest({b}, 1)") for name, (a, b) in per.items()}


def bucket(value):
    """Integer bucket of a value: exact below 16, then 16 per doubling."""
    shift = F.greatest(F.length(F.bin(value)) - 5, F.lit(0)).cast("int")
    return (shift * 16 + F.call_function("shiftright", value, shift)).cast("long")


def fences(counts: DataFrame, groups=("lang", "source"), spread: int = SPREAD,
           least: int = LEAST) -> DataFrame:
    """Per group and ratio the bucket beyond which a text fails.

    The sketch is (group, ratio, bucket) -> number of texts, pre-aggregated per task; its
    size is bounded by the groups. Quantiles are read off the running counts.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("ratio"), bucket(v).alias("bucket"))
                      for n, v in _ratios().items()])
    sketch = (counts.select(*groups, F.inline(pairs))
              .groupBy(*groups, "ratio", "bucket").agg(F.count(F.lit(1)).alias("n")))
    by = Window.partitionBy(*groups, "ratio")
    running = (sketch
               .withColumn("upto", F.sum("n").over(by.orderBy("bucket")))
               .withColumn("all", F.sum("n").over(by)))
    quantiles = running.groupBy(*groups, "ratio").agg(
        F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("bucket"))).alias("mid"),
        F.min(F.when(F.col("upto") * 10 >= F.col("all") * 9, F.col("bucket"))).alias("high"))
    return quantiles.select(*groups, "ratio", (F.col("high") + F.greatest(
        spread * (F.col("high") - F.col("mid")), F.lit(least))).alias("fence"))


def judge_quality(docs: DataFrame, keep=("doc_id",), groups=("lang", "source"),
                  spread: int = SPREAD, least: int = LEAST) -> DataFrame:
    """Counts, base_failed and kept for every row.

    ``base_failed``: fewer than 10 words, or more than a fifth of them in repeated 5-word
    windows. ``kept``: not base_failed and no ratio beyond the fence of the row's group.
    NULL is a group of its own; a NULL or empty text has no words and fails. Whole texts are
    counted, however long. Texts on the fence (ties) are kept. Repeated rows count and stay, an
    empty table gives an empty result, other columns are not read.
    """
    names = [f"g{i}" for i in range(len(groups))]
    wanted = docs.select(*keep, *[F.col(g).alias(n) for g, n in zip(groups, names)], "text")
    counts = store(text_counts(wanted, [*keep, *names]))
    pivoted = fences(counts, names, spread, least).groupBy(*names).agg(*[
        F.min(F.when(F.col("ratio") == n, F.col("fence"))).alias(f"fence_{n}")
        for n in _ratios()])
    same = [F.col(f"c.{n}").eqNullSafe(F.col(f"f.{n}")) for n in names]
    joined = counts.alias("c").join(pivoted.alias("f"), same, "left")
    failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > "
                    f"{REPEAT_PERCENT} * n_words")
    beyond = F.lit(False)
    for name, value in _ratios().items():
        beyond = beyond | (bucket(value) > F.col(f"fence_{name}"))
    return joined.select(*[f"c.{k}" for k in keep], *COUNTS,
                         failed.alias("base_failed"), (~failed & ~beyond).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


_BUCKET = ("(CASE WHEN {v} < 16 THEN {v} ELSE (length(bin({v})) - 5) * 16"
           " + ({v} >> (length(bin({v})) - 5)) END)")
_WHITE = r"[^\x20\x09-\x0D]+"
_SQL_RATIOS = {"symbols": "1000 * n_symbols // greatest(word_chars, 1)",
               "dup_lines": "1000 * n_dup_lines // greatest(n_words, 1)",
               "repeats": "1000 * n_repeat_words // greatest(n_words, 1)",
               "word_chars_per_word": "1000 * word_chars // greatest(n_words, 1)"}


OP6_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_WHITE}') AS words FROM documents),
grams AS (
  SELECT n, unnest(range(len(words) - 4)) AS i, words FROM docs WHERE len(words) > 5),
gram_keys AS (SELECT n, i, words[i + 1:i + 5] AS gram FROM grams),
often AS (
  SELECT n, i, count(*) OVER (PARTITION BY n, gram) AS times FROM gram_keys),
repeats AS (
  SELECT n, count(DISTINCT i + k) AS n_repeat_words
  FROM often, range(5) AS r(k) WHERE times > 1 GROUP BY n),
counts AS (
  SELECT n, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WHITE}')))
      - len(list_distinct(list_filter(string_split(text, chr(10)),
          lambda x: regexp_matches(x, '{_WHITE}')))) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs LEFT JOIN repeats USING (n)),
buckets AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  {", ".join(f"{_BUCKET.format(v=f'({v})')} AS b_{n}" for n, v in _SQL_RATIOS.items())}
  FROM counts),
fences AS (
  SELECT lang, source, {", ".join(
    f"quantile_disc(b_{n}, 0.9) + greatest({SPREAD} * (quantile_disc(b_{n}, 0.9)"
    f" - quantile_disc(b_{n}, 0.5)), {LEAST}) AS f_{n}" for n in _SQL_RATIOS)}
  FROM buckets GROUP BY lang, source)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"b_{n} <= f_{n}" for n in _SQL_RATIOS)} AS kept
FROM buckets b JOIN fences f
  ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""
