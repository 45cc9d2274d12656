"""The Merkle manifest against a plain tree in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sparklode.llm import merkle
from sparklode.llm.queries import QUERIES
from llm_helpers import ID_TEXT


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}"
                     for x in (row[0], row[3], row[2], row[4], row[1])))


def climb(nodes):
    """All levels of one tree, from its leaves to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H("".join(last[i:i + 8])) for i in range(0, len(last), 8)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        low = at // 8 * 8
        out += [h for i, h in enumerate(level[low:low + 8], low) if i != at]
        at //= 8
    return out


def folded(levels, at, h):
    for level in levels[:-1]:
        low = at // 8 * 8
        run = list(level[low:low + 8])
        run[at - low] = h
        h, at = H("".join(run)), at // 8
    return h


def expected(rows):
    """(doc_id, leaf, subroot, root, proof hash, folded root, verified) of every row."""
    order = lambda x: (x is not None, x if x is None or isinstance(x, int) else x.encode())  # noqa
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=order)
    for tree in trees.values():
        tree.sort(key=lambda r: (order(r[0]) if r[0] is not None else (False, 0), leaf(r)))
    inner = {t: climb([leaf(r) for r in trees[t]]) for t in langs}
    crown = climb([inner[t][-1][0] for t in langs])
    out = []
    for k, t in enumerate(langs):
        for i, r in enumerate(trees[t]):
            told = leaf(r)
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                low = r[1].translate({c: c + 32 for c in range(65, 91)})
                told = leaf((r[0], low, *r[2:]))
            end = folded(crown, k, folded(inner[t], i, told))
            out.append((r[0], leaf(r), inner[t][-1][0], crown[-1][0],
                        H("".join(siblings(inner[t], i) + siblings(crown, k))), end,
                        end == crown[-1][0]))
    return out


def told(spark, tmp_path, rows, extra=()):
    docs = spark.createDataFrame(rows, ID_TEXT).repartition(3)
    docs.select("*", *[F.lit("clash").alias(c) for c in extra]).write.parquet(
        str(tmp_path / "documents.parquet"))
    return [tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()]


CLASHING = ("key", "tree", "h", "leaf", "path", "pos", "n", "tie", "at", "members", "height")


def test_odd_rows(spark, tmp_path, odd_rows):
    got = told(spark, tmp_path, odd_rows, CLASHING)
    assert sorted(got, key=repr) == sorted(expected(odd_rows), key=repr)


@pytest.mark.parametrize("trees,leaves", [(1, 1), (1, 9), (2, 65), (70, 3), (1, 600)])
def test_shapes(spark, tmp_path, trees, leaves):
    rows = [(1000 * t + i, f"Text {i}" if i % 7 else None, f"l{t}" if t else None, None, i)
            for t in range(trees) for i in range(leaves + t)]
    assert sorted(told(spark, tmp_path, rows), key=repr) == sorted(expected(rows), key=repr)


def test_hot_tree_over_many_stored_levels(spark, monkeypatch):
    """With runs of two a tree of 700 leaves has ten levels, five of them stored."""
    monkeypatch.setattr(merkle, "FANOUT", 2)
    monkeypatch.setattr(merkle, "WIDTH", 4)
    rows = spark.range(1000).select(
        F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 40))
        .alias("tree"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256)
        .alias("h"))
    got = merkle.prove_rows(rows).select(
        "*", merkle.fold(F.col("h"), F.col("path")).alias("end"), F.size("path").alias("deep"))
    found = got.collect()
    assert len(found) == 1000 and len({r.root for r in found}) == 1
    assert all(r.end == r.root for r in found)
    # ceil(log2) of the leaves of the tree, and of the 41 trees
    assert {(r.tree == "hot", r.deep) for r in found} == {(True, 16), (False, 9)}
    assert {r.pos for r in found if r.tree == "hot"} == set(range(700))


def test_repeated_rows_have_a_place_each(spark, tmp_path):
    rows = [(5, "same", "en", "s", 4)] * 30 + [(4, "Other", "en", "s", 5)]
    got = told(spark, tmp_path, rows)
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)


def test_empty_table(spark, tmp_path):
    assert told(spark, tmp_path, []) == []
