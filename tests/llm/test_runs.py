"""Periodic runs of words against comparing all distances."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklode.llm import squares
from sparklode.llm.queries import QUERIES
from llm_helpers import ID_TEXT, words


def brute(w):
    """(start, length, smallest period) of all runs."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and j > i:
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted([(s, n, q) for (s, n), q in found.items()], key=lambda r: (r[0], r[2]))


def number(texts):
    starts = np.cumsum([0, *map(len, texts)])
    return np.array([x for t in texts for x in t], np.int64), starts


def random_texts(r):
    texts = []
    for _ in range(r.randint(1, 6)):
        k = r.choice([1, 2, 2, 3, 5, 50])
        w = [r.randrange(k) for _ in range(r.choice([0, 1, 5, 6, 7, 20, 60, 150]))]
        if r.random() < 0.6 and w:
            p = [r.randrange(k) for _ in range(r.randint(1, 20))]
            w = w[:r.randint(0, len(w))] + (p * r.randint(1, 12))[:r.randint(1, 150)] + w
        texts.append(w)
    return texts


def test_all_runs_are_caught():
    r = random.Random(1)
    for _ in range(600):
        texts = random_texts(r)
        assert squares.catch_runs(*number(texts)) == [brute(t) for t in texts]


@pytest.mark.parametrize("period", [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 100])
@pytest.mark.parametrize("more", [0, 1])
def test_shortest_run_at_every_place(period, more):
    """A run of exactly four periods is found wherever it starts, one word less is none."""
    body = [i for i in range(period)]
    size = max(6, 4 * period) - 1 + more
    for before in range(0, 70, 3 if period > 8 else 1):
        text = list(range(-1, -before - 1, -1)) + (body * 7)[:size] + [-1000, -1001]
        want = [(before, size, period)] if more else []
        assert squares.catch_runs(*number([text]))[0] == want


def test_a_hash_that_misleads_is_noticed(monkeypatch):
    """Where all suffixes of the first seed hash alike, the next seed decides."""
    real = squares.mix

    def weak(x):
        weak.calls += 1
        return real(x) if weak.calls > 8 else np.zeros_like(x)

    weak.calls = 0
    monkeypatch.setattr(squares, "mix", weak)
    text = list(range(40)) + [1, 2, 3] * 5 + list(range(50, 70))
    assert squares.catch_runs(*number([text]))[0] == brute(text) and weak.calls > 8


def test_one_word_over_and_over():
    assert squares.catch_runs(*number([[7] * 200_000])) == [[(0, 200_000, 1)]]


def planted(i, w):
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 or not w:
        return w
    g = h // 10
    a, p = g % len(w), 1 + (len(w) - g % len(w)) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]


def expected(i, text):
    w = planted(i, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = brute(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *(best or (None,) * 3),
            best and 1000 * best[1] // best[2],
            sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_query_on_odd_and_planted_rows(spark, tmp_path, odd_rows):
    r = random.Random(4)
    rows = [x for x in odd_rows if len(x[1] or "") < 20_000]
    for i in range(100, 220):
        text = words(i, r.choice([3, 9, 40, 120]), 30)
        if i % 3:
            text += " \v" + "Go on " * r.randint(2, 9) + " ü\n" * r.randint(1, 8)
        rows.append((i, text, "en", "s", 1))
    docs = spark.createDataFrame(rows, ID_TEXT).repartition(3)
    docs.select("*", *[F.lit("x").alias(c) for c in ("runs", "collapsed", "n_words", "best")]
                ).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [expected(x[0], x[1]) for x in rows], key=repr)
    assert sum(x.n_runs > 0 for x in got) > 60


def test_collapsed_text_and_empty_table(spark, no_docs):
    rows = [(1, "say ha ha ha ha ha ha ha now", None, None, None), (2, None, None, None, None)]
    got = squares.periodic_runs(spark.createDataFrame(rows, ID_TEXT), keep=("doc_id", "lang"))
    found = {r.doc_id: r for r in got.collect()}
    assert found[1].collapsed == "say ha now" and found[1].n_words == 9
    assert [tuple(x) for x in found[1].runs] == [(1, 7, 1)]
    assert (found[2].collapsed, found[2].runs, found[2].n_words) == ("", [], 0)
    assert squares.periodic_runs(no_docs).collect() == []
