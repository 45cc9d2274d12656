"""License scan: an exact containment join of text blocks with license templates.

Blocks are runs of ``BLOCK`` words, one starting every half block. A block meets a template
if it holds at least ``CONTAINMENT`` of the template's distinct words. The words of all
templates are ordered by how often they occur in the whole corpus, rarest first; a block
that meets the threshold must hold one word of the template's prefix in this order, be long
enough, and, from the first shared word on, have enough words of the template left.
"""

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparklode.llm.common import encoded, slices, table

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Phrases and labels that every scan must find.
PHRASES = [("under the mit license", "mit"),
           ("apache license version 2", "apache-2"),
           ("cc by nc", "cc-by-nc")]
# First sentences of public licenses.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this "
     "software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("redistribution and use in source and binary forms with or without modification are "
     "permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0",
     "mpl-2"),
]
BLOCK, CONTAINMENT = 40, 0.85


def words_of(raw: bytes) -> list[bytes]:
    return WORD.findall(raw.lower())   # bytes: only A-Z change


def word_frequencies(docs: DataFrame, words: set[bytes], text: str = "text") -> dict:
    """How often each of the given words occurs in all texts (a bounded result)."""
    def run(batches):
        total = dict.fromkeys(words, 0)
        for b in slices(batches, 0):
            for raw in encoded(b.column(0)):
                for w in filter(words.__contains__, words_of(raw)):
                    total[w] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in total], pa.string()),
             pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    rows = (docs.select(text).mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())
    return {r.word.encode(): r.n for r in rows}


class Templates:
    """Templates as word lists, rarest word first, with an index on their prefixes."""

    def __init__(self, templates, phrases, frequency, containment=CONTAINMENT, block=BLOCK):
        self.block, self.step = block, block // 2
        self.labels, self.words, self.need, self.prefix = [], [], [], {}
        for t, (text, label) in enumerate(templates):
            order = sorted(set(words_of(text.encode())), key=lambda w: (frequency.get(w, 0), w))
            need = math.ceil(containment * len(order) - 1e-9)
            if not order or need > self.step:
                raise ValueError(f"a template needs 1 to {self.step} distinct words: {text}")
            self.labels.append(label)
            self.words.append(order)
            self.need.append(need)
            for place, word in enumerate(order[:len(order) - need + 1]):
                self.prefix.setdefault(word, []).append((t, place))
        between = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
        inside = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
        self.phrases = [
            (re.compile(rb"(?<!" + inside + rb")" + between.join(text.encode().split())
                        + rb"(?!" + inside + rb")"), label, len(text.split()))
            for text, label in phrases]

    def blocks(self, words):
        """(template, containment, first word of the block) of every match in one text."""
        tried, found = set(), []
        last = max(0, math.ceil(len(words) / self.step) - 2)
        for i in [i for i, w in enumerate(words) if w in self.prefix]:
            cell = i // self.step
            for t, place in self.prefix[words[i]]:
                for b in range(max(0, cell - 1), min(cell, last) + 1):
                    if (t, b) in tried:
                        continue
                    tried.add((t, b))
                    start = b * self.step
                    inside = set(words[start:start + self.block])
                    need, order = self.need[t], self.words[t]
                    if len(inside) < need:   # too short a block
                        continue
                    # The first shared word in the global order bounds what can follow.
                    first = next(p for p, w in enumerate(order) if w in inside)
                    if len(order) - first < need:
                        continue
                    shared = 1 + sum(w in inside for w in order[first + 1:])
                    if shared >= need:
                        found.append((t, shared / len(order), start))
        return found

    def scan(self, raw: bytes):
        """n_words, n_base, first_word, last_word, base_labels, labels, score, blocks."""
        raw = raw.lower()
        words = WORD.findall(raw)
        places, base = [], set()
        for pattern, label, size in self.phrases:
            for match in pattern.finditer(raw):
                places.append(len(WORD.findall(raw[:match.start()])))
                base.add(label)
        blocks = self.blocks(words)
        labels = base | {self.labels[t] for t, _, _ in blocks}
        score = max([1.0] * bool(base) + [share for _, share, _ in blocks], default=0.0)
        return (len(words), len(places), min(places, default=None), max(places, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), score,
                [start for _, _, start in blocks])


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES,
                  containment: float = CONTAINMENT, block: int = BLOCK, text: str = "text",
                  keep=("doc_id",)) -> DataFrame:
    """Phrases and template blocks of every whole text.

    Per row: n_words; n_base, first_word, last_word, base_labels (places of the phrases);
    labels (with those of the blocks); score (1 with a phrase, else the best containment,
    else 0); blocks (first words of the matching blocks). NULL is the empty text: no words,
    empty labels, NULL places. Phrases must not overlap themselves. Repeated rows stay,
    other columns are not read. The templates are a bounded parameter.
    """
    vocabulary = {w for t, _ in templates for w in words_of(t.encode())}
    found = Templates(templates, phrases, word_frequencies(docs, vocabulary, text),
                      containment, block)
    keep = list(keep)
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
             "score", "blocks"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(),
             pa.float64(), pa.list_(pa.int64())]

    def run(batches):
        for b in slices(batches, len(keep)):
            columns = zip(*map(found.scan, encoded(b.column(len(keep)))))
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(keep))]
                + [pa.array(c, t) for c, t in zip(columns, types)], names=[*keep, *names])

    return docs.select(*keep, text).mapInArrow(
        run, kinds + "n_words long, n_base long, first_word long, last_word long, "
                     "base_labels string, labels string, score double, blocks array<long>")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


def _sql() -> str:
    order = [(sorted(set(t.split())), label) for t, label in TEMPLATES]
    shares = ", ".join(
        f"({len(words)}, {math.ceil(CONTAINMENT * len(words) - 1e-9)}, '{label}', "
        f"[{', '.join(repr(w) for w in words)}])" for words, label in order)
    phrases = ", ".join(f"('{label}', [{', '.join(repr(w) for w in t.split())}])"
                        for t, label in PHRASES)
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
phrases(label, phrase) AS (VALUES {phrases}),
places AS (
  SELECT n, label, unnest(list_filter(range(len(words)),
    lambda i: words[i + 1:i + len(phrase)] = phrase)) AS place
  FROM docs, phrases WHERE list_has_all(words, phrase)),
base AS (
  SELECT n, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY n),
cells AS (
  SELECT n, words, unnest(range(greatest(0, CAST(ceil(len(words) / {BLOCK // 2}) AS BIGINT)
    - 2) + 1)) AS b FROM docs),
blocks AS (
  SELECT n, words[b * {BLOCK // 2} + 1:b * {BLOCK // 2} + {BLOCK}] AS inside FROM cells),
templates(size, need, label, wanted) AS (VALUES {shares}),
hits AS (
  SELECT n, label, len(list_intersect(wanted, inside)) / size AS share
  FROM blocks, templates WHERE len(list_intersect(wanted, inside)) >= need),
labelled AS (
  SELECT n, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
    SELECT n, label FROM hits UNION ALL SELECT n, label FROM places) GROUP BY n),
best AS (SELECT n, max(share) AS share FROM hits GROUP BY n)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
  first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM docs LEFT JOIN base USING (n) LEFT JOIN labelled USING (n) LEFT JOIN best USING (n)
"""


OP2_SQL = _sql()
