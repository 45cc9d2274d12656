"""Min-max hashing against comparing all pairs."""

import numpy as np
import pytest

from sparklode.llm import minmax
from llm_helpers import ID_TEXT, sorted_rows
from test_pairs import groups, near_rows


@pytest.mark.parametrize("size,percent", [(5, 85), (5, 80), (2, 100)])
def test_components(spark, odd_rows, size, percent):
    rows = near_rows() + [(None if r[0] is None else 1000 + r[0], *r[1:]) for r in odd_rows]
    docs = spark.createDataFrame(rows, ID_TEXT).repartition(3)
    found = minmax.minmax_duplicates(docs, size, percent)
    assert sorted_rows(found, "doc_id", "n_shingles", "component_id") == groups(
        rows, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_clashing_columns_and_empty_table(spark, odd_docs, odd_rows, no_docs):
    found = minmax.minmax_duplicates(odd_docs, 5, 85)
    assert sorted_rows(found, "doc_id", "n_shingles", "component_id") == groups(
        odd_rows, 5, 85)
    assert minmax.minmax_duplicates(no_docs).collect() == []


def test_large_group_of_near_copies(spark):
    """Copies that differ in one word, and a chain whose ends are far apart."""
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        w[i % 120] = f"x{i}"
        rows.append((i, " ".join(w), "en", "s", 1))
    for i in range(40):   # each link moves on by one word
        rows.append((1000 + i, " ".join(f"c{k}" for k in range(i, i + 100)), "en", "s", 1))
    found = minmax.minmax_duplicates(spark.createDataFrame(rows, ID_TEXT).repartition(4), 5, 85)
    assert sorted_rows(found, "doc_id", "n_shingles", "component_id") == groups(rows, 5, 85)


def test_signature_estimates_similarity():
    """Unbiased, and of less variance than independent values would have."""
    r = np.random.default_rng(5)
    misses = []
    for _ in range(200):
        pool = r.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)
        values = minmax.signatures([pool[:200], pool[100:]])
        misses.append(np.mean(values[0] == values[1]) - 1 / 3)
    assert abs(np.mean(misses)) < 0.01
    assert np.std(misses) < 1.1 * (1 / 3 * 2 / 3 / minmax.VALUES) ** 0.5


def test_linked_sets_share_a_band_and_pass_the_sketch():
    r = np.random.default_rng(6)
    limit = int(minmax._can_link(85).rsplit(" ", 1)[1])
    for n in (1, 5, 20, 200, 2000):
        for _ in range(30):
            pool = np.unique(r.integers(0, 1 << 63, 2 * n).astype(np.uint64))
            apart = 15 * n // 115     # similarity (n - apart) / (n + apart) of 0.85 or more
            values = minmax.signatures([pool[:n], pool[apart:n + apart]])
            keys, bits = minmax.band_keys(values), minmax.bit_sketches(values)
            assert set(keys[0].tolist()) & set(keys[1].tolist())
            assert np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum() <= limit
