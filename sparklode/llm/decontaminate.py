"""Benchmark decontamination: BM25 index of test items, block-max MaxScore, overlap check.

Items are the indexed documents, passages of the corpus the queries. The weight of a word
in an item is its BM25 impact as a share of the item's total, so a passage with all words
of an item scores 1 on it. Passages are runs of two cells of ``step`` words, one from every
cell on; no item is longer than a cell, so a copy of it lies in some passage.

As in MaxScore, words that many items share are not essential: no item can reach the threshold on
them alone, so their lists are not read to bound a score; per block of items they add at most
a known share. For every passage the largest weights per block of its other words bound the
scores; blocks below the threshold are skipped, the items of the others are scored in full.
There are no cursors and no pivot as in WAND: the threshold is fixed, so one sum over arrays
bounds all passages and blocks at once, where moving a pivot would be a Python step each.
Every item at or above the threshold is then verified: enough word trigrams of both its
question (first two thirds) and its answer (the rest) must occur in the passage. Of a part
of less than 8 words, of which one other word may leave too few trigrams, enough words in
order within a run one word longer do as well.
"""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparklode.llm.common import encoded, octets, slices, table, tidy

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
K1, B, BLOCK, LEAST_STEP = 1.2, 0.75, 4, 64
# What the words that are not essential may come to in any item, as a share of the threshold.
COMMON = 0.6
_CELLS = 1 << 21
THRESHOLD, OVERLAP, GRAM = 0.5, 0.5, 3
# From so many words on, one other word leaves half of the trigrams at least.
SHORT = 3 * GRAM - 1
# Broadcast bound: benchmarks beyond it are split into several indexes of this many bytes.
INDEX_BYTES = 16 << 20


def _grams(words) -> set:
    size = min(GRAM, len(words))
    return set(zip(*(words[i:] for i in range(size)))) if size else set()


def _in_order(part: list, words: list) -> float:
    """Most words of ``part`` in its order within len(part) + 1 words, as a share of it."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(part):
        places[w] = places.get(w, 0) | 1 << i
    full, most = (1 << len(part)) - 1, 0
    for start, first in enumerate(words):
        if first not in places:
            continue
        free = full   # a zero bit: one more word in order up to this place
        for w in words[start:start + len(part) + 1]:
            new = free & places.get(w, 0)
            free = (free + new | free - new) & full
        most = max(most, len(part) - free.bit_count())
        if most == len(part):
            break
    return most / len(part)


class ItemIndex:
    """Inverted index of items with weights, block maxima and essential words."""

    def __init__(self, items: list[tuple], rarity=None, average: float | None = None,
                 threshold: float = THRESHOLD, longest: int = 0):
        """``items``: (item_id, text). ``rarity``: word -> idf; else from these items.

        ``longest``: words of the longest item of all indexes, if there are more.
        """
        self.ids, lists, self.question, self.answer, self.short = [], [], [], [], []
        for item, text in items:
            words = WORD.findall((text or "").encode().lower())
            if not words:   # nothing to be found
                continue
            cut = min(-(-2 * len(words) // 3), max(len(words) - 1, 1))
            self.ids.append(item)
            lists.append(words)
            self.question.append(_grams(words[:cut]))
            self.answer.append(_grams(words[cut:]))
            self.short.append([p if 0 < len(p) < SHORT else None
                               for p in (words[:cut], words[cut:])])
        self.threshold = threshold
        self.step = max([LEAST_STEP, longest, *map(len, lists)])
        average = average or sum(map(len, lists)) / max(len(lists), 1)
        counts = [{w: ws.count(w) for w in set(ws)} for ws in lists]
        if rarity is None:
            seen: dict[bytes, int] = {}
            for c in counts:
                for w in c:
                    seen[w] = seen.get(w, 0) + 1
            rarity = {w: math.log(1 + (len(lists) - n + 0.5) / (n + 0.5))
                      for w, n in seen.items()}
        self.terms = {w: i for i, w in enumerate(sorted(rarity))}
        rows = []
        for i, (words, count) in enumerate(zip(lists, counts)):
            weight = {w: rarity[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / average))
                      for w, n in count.items()}
            total = sum(weight.values())
            rows += [(self.terms[w], i, x / total) for w, x in weight.items()]
        rows.sort()
        term = np.array([r[0] for r in rows], np.int64)
        self.item = np.array([r[1] for r in rows], np.int64)
        self.share = np.array([r[2] for r in rows])
        self.at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        block_key = term * (len(self.ids) // BLOCK + 1) + self.item // BLOCK
        heads = np.flatnonzero(np.r_[True, block_key[1:] != block_key[:-1]]) if len(rows) else []
        self.block = self.item[heads] // BLOCK if len(rows) else self.item
        self.block_max = np.maximum.reduceat(self.share, heads) if len(rows) else self.share
        self.block_at = np.searchsorted(term[heads] if len(rows) else term,
                                        np.arange(len(self.terms) + 1))
        self.blocks = len(self.ids) // BLOCK + 1
        self._split_off_common()

    def _split_off_common(self):
        """Takes the most frequent terms from the essential ones, as long as they may go."""
        self.essential = np.ones(len(self.terms) + 1, bool)
        self.essential[-1] = False   # the last one: no term
        shares = np.zeros(len(self.ids))
        sizes = np.diff(self.at)
        for t in np.argsort(-sizes, kind="stable").tolist():
            part = slice(self.at[t], self.at[t + 1])
            shares[self.item[part]] += self.share[part]
            if shares.size and shares.max() > COMMON * self.threshold:
                shares[self.item[part]] -= self.share[part]
                break
            self.essential[t] = False
        self.common = np.zeros(self.blocks)   # the most that they add per block
        np.maximum.at(self.common, np.arange(len(self.ids)) // BLOCK, shares)

    def _lists(self, at, terms):
        """Positions of the lists of all given terms, and the number of each list."""
        size = at[terms + 1] - at[terms]
        owner = np.repeat(np.arange(len(terms)), size)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        return at[terms][owner] + within, owner

    def possible(self, passage: np.ndarray, terms: np.ndarray):
        """(passage, blocks) where an item may reach the threshold.

        The arguments are the distinct pairs of passage and essential term, by passage.
        """
        step = max(1, _CELLS // self.blocks)
        start = 0
        while start < len(passage):
            first = passage[start]
            end = int(np.searchsorted(passage, first + step))
            at, owner = self._lists(self.block_at, terms[start:end])
            cell = (passage[start:end][owner] - first) * self.blocks + self.block[at]
            most = np.bincount(cell, self.block_max[at])
            most = most + self.common[np.arange(len(most)) % self.blocks]
            found = np.flatnonzero(most >= self.threshold - 1e-9)
            found = found[np.isin(found, cell)]
            for p in np.unique(found // self.blocks):
                yield int(first + p), found[found // self.blocks == p] % self.blocks
            start = end

    def search(self, terms: np.ndarray, blocks) -> list[tuple[int, float]]:
        """(item, score) of all items of the blocks at or above the threshold."""
        full, _ = self._lists(self.at, terms)
        full = full[np.isin(self.item[full] // BLOCK, blocks)]
        score = np.bincount(self.item[full], self.share[full], len(self.ids))
        return [(i, float(score[i])) for i in np.flatnonzero(score >= self.threshold - 1e-9)]

    def leaks(self, raw: bytes, overlap: float = OVERLAP) -> list[tuple]:
        """(item_id, score, question share, answer share, first word) per item found.

        Of several passages the one with the largest shares counts.
        """
        words = WORD.findall(raw.lower())
        none, get = len(self.terms), self.terms.get
        ids = np.array([get(w, none) for w in words], np.int64)
        hits = np.flatnonzero(self.essential[ids])
        if not len(hits):
            return []
        # A word lies in the passage that starts with its cell and in the one before.
        last = max((len(words) - 1) // self.step - 1, 0)
        cell = hits // self.step
        pairs = np.unique(np.r_[np.minimum(cell, last), np.maximum(cell - 1, 0)] * none
                          + np.r_[ids[hits], ids[hits]])
        best: dict[int, tuple] = {}
        for passage, blocks in self.possible(pairs // none, pairs % none):
            start = passage * self.step
            terms = np.unique(ids[start:start + 2 * self.step])
            grams = None
            for i, score in self.search(terms[terms < none], blocks):
                if grams is None:
                    inside = words[start:start + 2 * self.step]
                    grams = {n: set(zip(*(inside[k:] for k in range(n))))
                             for n in range(1, GRAM + 1)}
                shares = []
                for part, short in zip((self.question[i], self.answer[i]), self.short[i]):
                    size = len(next(iter(part), ()))
                    share = len(part & grams[size]) / len(part) if part else 1.0
                    shares.append(max(share, _in_order(short, inside))
                                  if short and share < 1 else share)
                row = (self.ids[i], score, *shares, start)
                if min(shares) >= overlap and (i not in best or row[2:4] > best[i][2:4]):
                    best[i] = row
        return [best[i] for i in sorted(best)]


def each_index(items: DataFrame, threshold: float = THRESHOLD, size: int = INDEX_BYTES):
    """Yields indexes of at most about ``size`` bytes of items each, one at a time.

    Words, rarities, mean length and step are those of all items with words, so an item
    has the same scores in one index as in many. Rows without an id or words are no items;
    repeated items stay, and both are found.
    """
    # As bytes.lower(): only A to Z have other letters.
    words = F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()),
                                 F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    usable = items.where("item_id IS NOT NULL AND text IS NOT NULL").where(F.size(words) > 0)
    total, count, average, longest = usable.agg(
        F.coalesce(F.sum(octets()), F.lit(0)), F.count(F.lit(1)),
        F.avg(F.size(words)), F.max(F.size(words))).first()
    if total <= size:
        rows = usable.select("item_id", "text").orderBy("item_id", "text").collect()
        yield ItemIndex([tuple(r) for r in rows], threshold=threshold)
        return
    parts = -(-total * 5 // (size * 4))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    seen = usable.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"))
    for p in range(parts):
        chosen = usable.where(part == p).select("item_id", "text")
        own = chosen.select(F.explode(F.array_distinct(words)).alias("word")).distinct()
        rarity = {r.word.encode(): math.log(1 + (count - r.n + 0.5) / (r.n + 0.5))
                  for r in seen.join(own, "word").collect()}
        rows = [tuple(r) for r in chosen.orderBy("item_id", "text").collect()]
        yield ItemIndex(rows, rarity, average, threshold, longest)


def item_indexes(items: DataFrame, threshold: float = THRESHOLD,
                 size: int = INDEX_BYTES) -> list[ItemIndex]:
    """All of ``each_index``, for small tables."""
    return list(each_index(items, threshold, size))


def scan_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
               overlap: float = OVERLAP, keep=("doc_id",), text: str = "text",
               size: int = INDEX_BYTES) -> DataFrame:
    """The ``keep`` columns and ``leaks`` of every row: an array, empty for clean texts.

    NULL and empty texts are clean. Repeated rows stay; other columns are not read.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    leak = (f"array<struct<item_id: {kind}, score: double, question_share: double, "
            "answer_share: double, first_word: long>>")
    spark, keep = docs.sparkSession, list(keep)
    # A text that is kept is sent to the tasks once, as t.
    named = {c: "t" if c == text else f"k{i}" for i, c in enumerate(keep)}
    names = [n for n in named.values() if n != "t"]
    kinds = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, "
                    for c, n in named.items() if n != "t")
    out = docs.select(*[F.col(c).alias(n) for c, n in named.items() if n != "t"],
                      F.col(text).alias("t"), F.array().cast(leak).alias("leaks"))
    item_type = pa.int64() if kind in ("bigint", "long") else pa.int32() if kind == "int" \
        else pa.string()
    struct = pa.struct([("item_id", item_type), ("score", pa.float64()),
                        ("question_share", pa.float64()), ("answer_share", pa.float64()),
                        ("first_word", pa.int64())])
    fields = [f.name for f in struct]

    def scanner(shared):
        def run(batches):
            k = len(names)
            for b in slices(batches, k):
                found = [shared.value.leaks(raw, overlap) for raw in encoded(b.column(k))]
                rows = [old + [dict(zip(fields, r)) for r in new]
                        for old, new in zip(b.column(k + 1).to_pylist(), found)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(i) for i in range(k + 1)] + [pa.array(rows, pa.list_(struct))],
                    names=[*names, "t", "leaks"])
        return run

    # One index at a time is in the driver's Python.
    for shared in map(spark.sparkContext.broadcast, each_index(items, threshold, size)):
        out = out.mapInArrow(tidy(scanner(shared)), f"{kinds}t string, leaks {leak}")
    return out.select(*[F.col(named[c]).alias(c) for c in keep], "leaks")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and test item that it gives away; clean documents have none."""
    found = scan_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("leaks"))
