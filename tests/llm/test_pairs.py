"""Near copies, repeated bytes and components against brute force."""

import glob
import hashlib
import random
import re

import numpy as np
import pytest

from sparklode.llm import repeats
from sparklode.llm.components import connected_components
from sparklode.llm.parity_join import Bands, near_duplicates, one_of_each_group
from sparklode.llm.repeats import remove_repeats
from llm_helpers import ID_TEXT, sorted_rows, words

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(size))))


def groups(rows, size, percent):
    """doc_id, set size, smallest id of the group, by comparing all pairs."""
    sets = [shingles(r[1], size) for r in rows]
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j]:
                shared = len(x & sets[j])
                if 100 * shared >= percent * (len(x) + len(sets[j]) - shared):
                    a, b = label[i], label[j]
                    label = [b if v == a else v for v in label]
    ids = {}
    for v, r in zip(label, rows):
        if r[0] is not None:
            ids[v] = min(ids.get(v, r[0]), r[0])
    return sorted([(r[0], len(s), ids.get(v)) for r, s, v in zip(rows, sets, label)], key=repr)


def test_long_unlike_words_stay_apart(spark):
    """Words that every polynomial modulo 2^64 confuses."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{one} x y", "en", "s", 1), (2, f"{two} x y", "en", "s", 1),
            (3, f"{one} X y", "en", "s", 1)]
    found = near_duplicates(spark.createDataFrame(rows, ID_TEXT), 3, 90)
    assert sorted_rows(found, "doc_id", "component_id") == [(1, 1), (2, 2), (3, 1)]


def near_rows():
    r = random.Random(3)
    rows, n = [], 0
    for g in range(30):
        base = words(100 + g, r.choice([3, 8, 12, 30, 60, 200, 400])).split()
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = f"n{r.randrange(50)}"
            rows.append((n, (" ".join(w)).upper() if r.random() < 0.2 else " ".join(w),
                         None, None, None))
            n += 1
    return rows


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (2, 100)])
def test_components_of_near_copies(spark, odd_rows, size, percent):
    rows = near_rows() + [(None if i is None else i + 1000, *rest) for i, *rest in odd_rows]
    docs = spark.createDataFrame(rows, ID_TEXT).repartition(4)
    got = sorted_rows(near_duplicates(docs, size, percent), "doc_id", "n_shingles", "component_id")
    assert got == groups(rows, size, percent)


def test_odd_documents_and_empty_table(odd_docs, odd_rows, no_docs):
    got = sorted_rows(near_duplicates(odd_docs, 3, 90), "doc_id", "n_shingles", "component_id")
    assert got == groups(odd_rows, 3, 90)
    assert near_duplicates(no_docs).count() == 0


def test_one_of_each_group_stays(spark, odd_docs, odd_rows):
    rows = near_rows()
    docs = spark.createDataFrame(rows, ID_TEXT)
    kept = {r.doc_id for r in one_of_each_group(docs).collect()}
    assert kept == {c for _, _, c in groups(rows, 5, 80)}
    odd = [r.doc_id for r in one_of_each_group(odd_docs).collect()]
    # 3 stands for its copies, with and without an id; both texts of 6 and of 10 differ.
    assert sorted(i for i in odd if i is not None) == [1, 2, 3, 5, 6, 7, 8, 9, 10, 10, 11]
    assert odd.count(None) == 1   # the row without text


def test_small_tables_are_few_files(spark, monkeypatch):
    """Where Spark does not merge partitions, a small table is not a file for each of them."""
    from sparklode.functions.storage import shared_dir
    from sparklode.llm import components, parity_join

    rows = [(r[0], r[1], "en", "web", 0) for r in near_rows() + passages()]
    docs = spark.createDataFrame(rows, ID_TEXT).repartition(3)
    whole = {f: sorted_rows(f(docs), "doc_id") for f in (one_of_each_group, remove_repeats)}
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",
                                           "spark.sql.adaptive.coalescePartitions.enabled")}
    for module in (components, parity_join):
        monkeypatch.setattr(module, "drop", lambda df: None)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for f, want in whole.items():
            before = set(glob.glob(f"{shared_dir(spark)}/llm/*"))
            found = f(docs)
            assert found.rdd.getNumPartitions() == 1
            assert sorted_rows(found, "doc_id") == want
            tables = set(glob.glob(f"{shared_dir(spark)}/llm/*")) - before
            assert tables
            assert max(len(glob.glob(f"{t}/part-*")) for t in tables) == 1
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_a_shared_key_is_certain():
    """Linked sets always share a key, for every size and threshold."""
    r = np.random.default_rng(1)
    for percent in (80, 90):
        bands = Bands(percent)
        for size in [*range(1, 60), 99, 200, 1000]:
            x = np.sort(r.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
            for cut in {0, size * (100 - percent) // 100}:
                y = np.sort(r.permutation(x)[cut:])
                if len(y) and 100 * len(y) >= percent * size and cut:
                    assert set(bands.keys(x).tolist()) & set(bands.keys(y).tolist())
                k = int(size * (100 - percent) / (100 + percent))
                if k and 100 * (size - k) < percent * (size + k):
                    continue
                z = np.sort(np.r_[r.permutation(x)[k:], r.integers(0, 1 << 63, k).astype(np.uint64)])
                if k:
                    assert set(bands.keys(x).tolist()) & set(bands.keys(z).tolist())


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(8, 60)]
    links += [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(150)]
    links += [(5, 5), (None, 3)]
    want = {}
    for a, b in links:
        if a is not None and a != b:
            want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(400):
        before = dict(want)
        for a, b in links:
            if a in want and b in want:
                want[a] = want[b] = min(want[a], want[b])
        if before == want:
            break
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert sorted_rows(got, "node", "component") == sorted(want.items(), key=repr)


def cut(rows, length=100):
    key = lambda r: repeats.NO_ID if r[0] is None else r[0]
    first, out = {}, []
    for r in rows:
        b = (r[1] or "").encode()
        for i in range(len(b) - length + 1):
            w, k = b[i:i + length], (key(r), i)
            if w not in first or k < first[w]:
                first[w] = k
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] != (key(r), i):
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((r[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages():
    r = random.Random(5)

    def rnd(n):
        return "".join(r.choice("abcdefgh é\n") for _ in range(n))
    base, rows = [rnd(300) for _ in range(4)], []
    for i in range(120):
        b, a = r.choice(base), r.randint(0, 200)
        text = r.choice([rnd(r.randint(0, 150)), ""]) + b[a:r.randint(a, 300)]
        text += r.choice([rnd(r.randint(0, 90)), b[a:], "x" * 250, "ab" * 120])
        rows.append((r.choice([i, i, i, i // 2, None]), text, None, None, None))
    more = [None, "", "a" * 99, "a" * 100, "a" * 100, "a" * 3000, "a" * 3000, "\0" * 300]
    return rows + [(200 + i // 2, t, None, None, None) for i, t in enumerate(more)]


COUNTS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("max_group", [8_192, 2])
def test_repeated_bytes(spark, max_group):
    rows = passages()
    docs = spark.createDataFrame(rows, ID_TEXT).repartition(3)
    assert sorted_rows(remove_repeats(docs, max_group=max_group), *COUNTS) == cut(rows)


def test_repeats_in_odd_documents(odd_docs, odd_rows, no_docs):
    got = remove_repeats(odd_docs, keep=("doc_id", "n_chars"), cut_text=True)
    assert sorted_rows(got, *COUNTS) == cut(odd_rows)
    assert all("�" not in r.cut_text for r in got.collect())
    assert remove_repeats(no_docs).count() == 0


def test_long_texts_in_parts(monkeypatch):
    """A text that comes in parts has the same windows as in one piece."""
    r = random.Random(6)
    text = "".join(r.choice("abc ") for _ in range(3000)).encode()
    flat = np.frombuffer(text, np.uint8)
    starts, count, anchor, ah, _ = repeats.anchor_runs(flat, np.array([0, len(flat)]), 100, 20)
    whole = {(s + k, a) for s, n, a in zip(starts, count, anchor) for k in range(n)}
    split = set()
    for base in range(0, len(flat) - 99, 700):
        part = flat[base:base + 700 + 99]
        starts, count, anchor, ah, _ = repeats.anchor_runs(part, np.array([0, len(part)]), 100, 20)
        split |= {(base + s + k, base + a) for s, n, a in zip(starts, count, anchor)
                  for k in range(n)}
    assert whole == split and len(whole) == 2901


def test_borders_of_the_transform():
    r = random.Random(8)
    text = [r.choice([0, 1, 2, 3]) for _ in range(400)] * 2 + [0]
    symbols = np.array(text, np.int64)
    order = repeats.suffix_order(symbols, 20)
    borders = repeats.marked_borders(symbols, order, 20)
    for i in range(1, len(order)):
        a, b = (tuple(text[j:j + 20]) for j in (order[i - 1], order[i]))
        if 0 not in a:   # windows never hold the separator
            assert borders[i] == (a != b)
