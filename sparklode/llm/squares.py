"""Periodic runs of words, found by catching squares online over dyadic blocks.

A run with period q of at least 4 q words is caught at the level whose blocks have S words, S the
power of two with S / 2 <= q < S. Blocks of S words start at every S / 4 words of a text, so one of
them lies in the run together with its copy q words on. A completed block gets a catcher, which
lives while suffixes of S words start S / 2 to S - 1 words behind the block's start: each appended
word moves that suffix on, and it is compared with the blocks whose catchers are alive, never more
than two a level. The first suffix that equals the block closes a square, since the copy
overlaps its block or meets it, and ends the catcher. Squares of one period that overlap by the
period merge into a run, and its ends advance word by word as long as the words q apart are
equal; the blocks are so dense that each end moves by less than S / 4 words. What has a smaller
period has been caught at a lower level, with the same ends.

Words are appended a slice of texts at a time, so a level compares all suffixes as arrays. They
are compared by hash and every square is confirmed on the words; should a hash ever mislead, the
slice is done again with another seed. A text takes part in as many levels as its length has
doublings, with a constant number of array steps per word, also where it repeats one word only.
Memory is that of a slice, or of one text if that is longer.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparklode.llm.common import encoded, mix, slices, table
from sparklode.llm.merkle import CRC32_SQL

LEAST, TIMES = 6, 4   # a run has at least LEAST words and TIMES periods
MARK = np.uint64(0x9E3779B97F4A7C15)
RUN_TYPE = "array<struct<start:long,length:long,period:long>>"
_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def _squares(words: np.ndarray, starts: np.ndarray, seed: int):
    """Per level (block size, starts of the caught blocks, their periods)."""
    origin, hashes = np.arange(len(words)), mix((words.astype(np.uint64) + np.uint64(seed)) * MARK)
    length = np.diff(starts)
    long = np.repeat(length, length)
    place = origin - np.repeat(starts[:-1], length)
    size = 2
    while True:
        half, step = size // 2, max(1, size // 4)
        stay = long >= max(LEAST, TIMES * half)
        if not stay.any():
            return
        if not stay.all():
            origin, hashes, long, place = (x[stay] for x in (origin, hashes, long, place))
        whole = hashes.copy()
        whole[:-half] = mix(hashes[:-half] * MARK + hashes[half:])
        hashes = whole
        index, full = np.arange(len(origin)), place + size <= long
        blocks, periods = [], []
        for alive in range(max(1, half // step), -(-size // step)):
            back = (place & (step - 1)) + alive * step
            block = np.maximum(index - back, 0)
            equal = np.flatnonzero((hashes == hashes[block]) & full & (place >= back))
            blocks.append(block[equal])
            periods.append(back[equal])
        blocks, periods = np.concatenate(blocks), np.concatenate(periods)
        order = np.lexsort((periods, blocks))
        blocks, periods = blocks[order], periods[order]
        first = np.ones(len(blocks), bool)
        first[1:] = blocks[1:] != blocks[:-1]
        yield size, origin[blocks[first]], periods[first]
        size *= 2


def _merged(size: int, blocks: np.ndarray, periods: np.ndarray):
    """Squares of one period that overlap by it, as (start, end, period)."""
    order = np.lexsort((blocks, periods))
    blocks, periods = blocks[order], periods[order]
    head = np.ones(len(blocks), bool)
    head[1:] = (periods[1:] != periods[:-1]) | (blocks[1:] > blocks[:-1] + size)
    last = np.append(np.flatnonzero(head)[1:], len(blocks)) - 1 if len(blocks) else []
    return zip(blocks[head].tolist(), (blocks[last] + size + periods[last]).tolist(),
               periods[head].tolist())


def catch_runs(words: np.ndarray, starts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Per text its runs (start, length, period), by start and period.

    ``words`` numbers the words of all texts, ``starts`` has their n + 1 borders.
    """
    seed = 0
    while True:
        found = _confirmed(words, starts, seed)
        if found is not None:
            break
        seed += 1
    runs = [[] for _ in starts[:-1]]
    for (start, end), q in sorted(found.items(), key=lambda x: (x[0][0], x[1])):
        text = int(np.searchsorted(starts, start, "right")) - 1
        runs[text].append((start - int(starts[text]), end - start, q))
    return runs


def _confirmed(words: np.ndarray, starts: np.ndarray, seed: int):
    """{(start, end): smallest period} of all runs, or None if a hash misled."""
    runs = {}
    for size, blocks, periods in _squares(words, starts, seed):
        for start, end, q in _merged(size, blocks, periods):
            if not np.array_equal(words[start:end - q], words[start + q:end]):
                return None
            if end - start + 2 * (size // 4) < max(LEAST, TIMES * q):
                continue
            text = int(np.searchsorted(starts, start, "right"))
            low, high = int(starts[text - 1]), int(starts[text])
            while start > low and words[start - 1] == words[start - 1 + q]:
                start -= 1
            while end < high and words[end] == words[end - q]:
                end += 1
            if end - start >= max(LEAST, TIMES * q):
                runs[start, end] = min(q, runs.get((start, end), q))
    return runs


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
                  ) -> DataFrame:
    """The kept columns of every row, n_words, runs and collapsed.

    Words are split at ASCII white space, in whole texts. ``runs`` has start, length and period
    (in words, by start and period) of every stretch that has a smallest period of a quarter of
    its words at most and no neighbour that goes on with it; ``collapsed`` joins by one space
    the words that no run holds after its first period. NULL and texts without words have no
    runs and an empty string, a text without runs keeps all its words. Rows are judged one by one:
    repeated rows and equal ids stay. Columns not asked for are not read.
    """
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for b in slices(batches, len(keep)):
            texts = [t.split() for t in encoded(b.column(len(keep)))]
            starts = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(t) for t in texts], out=starts[1:])
            number = {}
            words = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t),
                                np.int64, int(starts[-1]))
            runs = catch_runs(words, starts)
            left = []
            for found, t in zip(runs, texts):
                if found:
                    stays = np.ones(len(t), bool)
                    for start, length, q in found:
                        stays[start + q:start + length] = False
                    t = [t[i] for i in np.flatnonzero(stays).tolist()]
                left.append(b" ".join(t))
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(keep))] + [
                    pa.array(np.diff(starts), pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in found]
                              for found in runs], _RUNS),
                    pa.array(left, pa.binary()).cast(pa.string())],
                names=[*keep, "n_words", "runs", "collapsed"])

    return docs.select(*keep, text).mapInArrow(
        run, f"{kinds}, n_words long, runs {RUN_TYPE}, collapsed string")


def _planted() -> Column:
    """The text; of every tenth id its words from one place on repeat, as the query wants."""
    words = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w != '')"
    return F.expr(f"""CASE WHEN crc32(CAST(doc_id AS string)) % 10 = 0 THEN
        element_at(transform(array(named_struct('w', {words}, 'g',
            crc32(CAST(doc_id AS string)) div 10)), x ->
          CASE WHEN size(x.w) = 0 THEN '' ELSE array_join(transform(x.w, (w, i) ->
            CASE WHEN i < x.g % size(x.w) THEN w ELSE x.w[int(x.g % size(x.w)
              + (i - x.g % size(x.w)) % (1 + (size(x.w) - x.g % size(x.w)) div (3 + x.g % 8)))]
            END), ' ') END), 1) ELSE text END""")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _planted().alias("text"))
    best = F.expr("array_max(transform(runs, r -> named_struct("
                  "'length', r.length, 'start', -r.start, 'period', -r.period)))")
    return (periodic_runs(docs).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', "
                      "r.period, '\\n')), '')"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256")))


# A run of length max(6, 4 q) has at least five places in a row where five words in a row
# equal those q later, or is as short as six equal words.
OP12_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''),
    '[^\x20\x09-\x0D]+') AS o, @CRC@ AS h FROM (
      SELECT doc_id, text, doc_id::VARCHAR AS id FROM documents)),
planned AS (
  SELECT *, len(o) AS n, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) END AS a,
    h // 10 % 8 AS e FROM cut),
docs AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN o ELSE list_transform(range(n), lambda i:
    o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + e)) END]) END AS w
  FROM planned),
words AS (SELECT r, unnest(range(n)) AS i, unnest(w) AS word FROM docs),
grams AS (
  SELECT r, i, word AS first, hash(word, lead(word, 1) OVER t, lead(word, 2) OVER t,
    lead(word, 3) OVER t, lead(word, 4) OVER t) AS g, lead(word, 4) OVER t IS NOT NULL AS whole
  FROM words WINDOW t AS (PARTITION BY r ORDER BY i)),
pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM grams x JOIN grams y
    ON x.r = y.r AND x.g = y.g AND x.first = y.first AND y.i > x.i WHERE x.whole AND y.whole),
islands AS (
  SELECT r, q, min(i) AS start, max(i) + 5 + q - min(i) AS length FROM (
    SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs)
  GROUP BY r, q, island),
runs AS (
  SELECT r, start, length, min(q) AS period FROM islands
  WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
told AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), ''
    ORDER BY start, period) AS list, arg_min({'s': start, 'l': length, 'p': period},
    (-length, start, period)) AS best FROM runs GROUP BY r),
dropped AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS rest
  FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length,
  best.p AS period, 1000 * best.l // best.p AS exponent_milli,
  sha256(coalesce(list, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM docs LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
""".replace("@CRC@", CRC32_SQL.format("id"))
