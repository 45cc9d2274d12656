"""License scan, quality rules and network, decontamination, URL rules, sharding, pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparklode.llm import quality_rules
from sparklode.llm.decontaminate import ItemIndex, item_indexes, scan_leaks
from sparklode.llm.license_scan import PHRASES, TEMPLATES, scan_licenses, words_of
from sparklode.llm.quality_net import ByteNet, fit, held_out, score_quality
from sparklode.llm.sharding import shard_documents
from sparklode.llm.url_rules import RULES, RuleTrie, judge_urls, split_url
from llm_helpers import CLASHING, ID_TEXT, sorted_rows, words

SMALL = "/root/testdata/sf0.01"


# --- URL rules ---------------------------------------------------------------

@pytest.mark.parametrize("url,rule,verdict", [
    ("http://a.example.org/es/1", "example.org/es/", "block"),
    ("http://EXAMPLE.org/en/12?x", "example.org/en/1", "block"),
    ("http://example.org/en/2", "org/", "allow"),
    ("http://example.org", None, "allow"),          # an empty path starts with no rule's
    ("http://x.com/de/", "com/de/", "block"),
    ("http://x.com/de", None, "allow"),
    ("http://notcom/de/", None, "allow"),
    ("no url", None, "allow"), ("", None, "allow"), (None, None, "allow"),
])
def test_longest_rule_wins(spark, url, rule, verdict):
    found = RuleTrie(RULES).find(*split_url(url))
    assert (found or (None, "allow")) == (rule, verdict)


def test_url_table_and_ties(spark):
    trie = RuleTrie([("allow", "a.b/x"), ("block", "a.b/x"), ("allow", "b/xyz")])
    assert trie.find("a.b", "/x/y") == ("a.b/x", "block")
    pages = spark.createDataFrame([(1, None), (1, None), (None, "ftp://a.org/x#y")],
                                  "page_id long, url string")
    got = judge_urls(pages.withColumn("host", F.lit(1)).withColumn("rule", F.lit(1)), RULES)
    assert sorted_rows(got, *got.columns) == sorted(
        [(1, "", "", None, "allow"), (1, "", "", None, "allow"),
         (None, "a.org", "/x", "org/", "allow")], key=repr)
    assert judge_urls(pages.limit(0), RULES).count() == 0


# --- licenses ------------------------------------------------------------------

def license_brute(text, block=40, share=0.85):
    w = [x.decode() for x in words_of((text or "").encode())]
    places = [(i, label) for p, label in PHRASES for i in range(len(w))
              if w[i:i + len(p.split())] == p.split()]
    step, best, labels = block // 2, 0.0, {label for _, label in places}
    for start in range(0, max(len(w) - step, 1), step):
        inside = set(w[start:start + block])
        for t, label in TEMPLATES:
            t = set(t.split())
            if len(t & inside) >= share * len(t) - 1e-9:
                labels.add(label)
                best = max(best, len(t & inside) / len(t))
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None),
            ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)),
            1.0 if at else best)


def test_license_scan_is_exact(spark, odd_docs, odd_rows, no_docs):
    r = random.Random(7)
    rows = []
    for i in range(300):
        parts = [words(i, r.randint(0, 70))]
        for t, _ in r.choices(TEMPLATES, k=r.randint(0, 2)):
            t = t.split()
            if r.random() < 0.6:
                t.pop(r.randrange(len(t)))
            if r.random() < 0.5:
                r.shuffle(t)
            parts += [", ".join(t).title(), words(i + 500, r.randint(0, 50))]
        rows.append((i, " ".join(parts), None, None, None))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    docs = spark.createDataFrame(rows, ID_TEXT)
    assert sorted_rows(scan_licenses(docs), "doc_id", *names) == sorted(
        [(x[0], *license_brute(x[1])) for x in rows], key=repr)
    assert sorted_rows(scan_licenses(odd_docs), "doc_id", *names) == sorted(
        [(x[0], *license_brute(x[1])) for x in odd_rows], key=repr)
    assert scan_licenses(no_docs).count() == 0


# --- quality rules ---------------------------------------------------------------

def test_repeated_words():
    text = b"a b c d e x a b c d e f a b c d e"
    assert quality_rules.counts_of(text)[4] == 15
    assert quality_rules.counts_of(b"a " * 30)[4] == 30
    assert quality_rules.counts_of(b"l\nl\n\n \nl")[3] == 2
    assert quality_rules.counts_of("é# ü$".encode())[:3] == (2, 4, 2)
    assert quality_rules.counts_of(b"") == (0, 0, 0, 0, 0)


def test_fence_follows_the_group(spark):
    rows = [(i, words(i, 60) + "#" * (i % 4), "en", "clean", None) for i in range(100)]
    rows += [(200 + i, words(i, 60).replace(" ", "# "), "en", "hash", None) for i in range(100)]
    rows += [(400, words(9, 60).replace(" ", "# "), "en", "clean", None)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge_quality(
        spark.createDataFrame(rows, ID_TEXT)).collect()}
    assert not kept[400] and all(kept[200 + i] for i in range(100)) and kept[0]


def test_quality_of_odd_documents(odd_docs, odd_rows, no_docs):
    got = quality_rules.judge_quality(odd_docs)
    assert got.count() == len(odd_rows)
    for r in got.collect():
        assert r.base_failed is not None and r.kept is not None
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge_quality(no_docs).count() == 0


# --- quality network ----------------------------------------------------------------

def test_network_learns_and_covers_whole_texts(spark, odd_docs, odd_rows, no_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect()
    split = [zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows]
    net = ByteNet().train([r.text.encode() for r, s in zip(rows, split) if s],
                          [r.quality for r, s in zip(rows, split) if s])
    texts = [r.text.encode() for r, s in zip(rows, split) if not s]
    truth = np.array([r.quality for r, s in zip(rows, split) if not s])

    def scores(texts):
        at = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        return net.scores(np.frombuffer(b"".join(texts), np.uint8), at)
    found = scores(texts)
    good, bad = found[truth == 1], found[truth == 0]
    assert np.mean(good[:, None] > bad[None, :]) > 0.97
    assert np.mean((found >= 0.3) == truth) > 0.93
    # A score does not depend on the neighbours, and the end of a long text counts.
    assert np.allclose(found, [scores([t])[0] for t in texts], atol=1e-5)
    long = b"the and of the by " * 20_000
    assert abs(scores([long])[0] - scores([long + b"%%% *** $$$ " * 20_000])[0]) > 1e-4
    got = score_quality(odd_docs, net)
    assert got.count() == len(odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.collect())
    assert score_quality(no_docs, net).count() == 0
    marks = docs.select("doc_id", held_out("doc_id").alias("h")).limit(50).collect()
    assert all(m.h == (zlib.crc32(str(m.doc_id).encode()) % 5 == 0) for m in marks)


def test_a_long_text_does_not_end_the_sample(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(ByteNet, "train", lambda net, texts, labels: taken.append(
        (texts, labels)) or net)
    ids = [r.id for r in spark.range(40).where(~held_out("id")).orderBy(F.xxhash64("id")).collect()]
    rows = [(i, "x" * (5000 if i == ids[0] else 500 if i == ids[1] else 10), None, None, None)
            for i in ids]
    docs = spark.createDataFrame(rows + rows[-1:], ID_TEXT)
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    fit(docs, labels, size=1000)   # the first text never fits, the second one comes last
    fit(docs, labels, size=40)
    assert sorted(map(len, taken[0][0])) == [10] * (len(ids) - 1) + [500]
    assert taken[0][1].count(1) == sum(i % 2 for i in ids[1:] + ids[-1:])
    assert list(map(len, taken[1][0])) == [10] * 4
    assert taken[1][1] == [i % 2 for i in ids[2:6]]
    with pytest.raises(ValueError):
        fit(docs, labels, size=9)


def test_gradients_are_those_of_the_loss():
    net = ByteNet(3)
    texts = [b"abcab" * 60, b"xyz" * 10, b""]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    at = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        net.tables = None
        p = net.scores(flat, at)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))
    from sparklode.llm.quality_net import Padded
    slopes = net._gradients(Padded(flat, at), labels)
    for name in ("weights", "bias", "filters", "embed"):
        values, slope = net.params[name].reshape(-1), slopes[name].reshape(-1)
        for i in np.argsort(-abs(slope))[:3]:
            old = values[i]
            values[i] = old + 1e-3
            up = loss()
            values[i] = old - 1e-3
            down = loss()
            values[i] = old
            assert abs((up - down) / 2e-3 - slope[i]) < 0.05 * abs(slope[i]) + 1e-3


# --- decontamination -------------------------------------------------------------------

def test_search_finds_all_at_or_above_the_threshold():
    items = [(i, words(i, 20 + i % 17, 300)) for i in range(120)]
    index = ItemIndex(items)
    for seed in range(60):
        text = words(1000 + seed, 90, 300) + " " + items[seed][1]
        terms = np.unique([index.terms[w] for w in words_of(text.encode()) if w in index.terms])
        score = np.zeros(len(items))
        for t in terms:
            for k in range(index.at[t], index.at[t + 1]):
                score[index.item[k]] += index.share[k]
        want = [i for i in range(len(items)) if score[i] >= index.threshold]
        rare = terms[index.essential[terms]]
        found = dict(index.possible(np.zeros(len(rare), np.int64), rare)).get(0, [])
        assert [i for i, _ in index.search(terms, found)] == want and seed in want
    assert 0 < (~index.essential[:-1]).sum() < len(index.terms)


def test_leaks_are_found_anywhere(spark, odd_docs, odd_rows, no_docs):
    items = [(i, words(i, 30)) for i in range(50)] + [(50, None), (51, ""), (None, words(7, 30)),
                                                      (52, "one"), (53, words(3, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, words(900 + i, i * 13) + " " + items[i][1].upper() + ". " + words(800 + i, 40),
             None, None, None) for i in range(50)]
    rows += [(100 + i, " ".join(items[i][1].split()[:15]) + " " + words(i + 600, 90), None, None,
              None) for i in range(20)]
    docs = spark.createDataFrame(rows, ID_TEXT)
    found = scan_leaks(docs, bench).select("doc_id", F.inline("leaks")).collect()
    want = {(i, i) for i in range(50)} | {(3, 53)}
    assert {(r.doc_id, r.item_id) for r in found} == want
    # Several indexes find the same.
    many = item_indexes(bench, size=400)
    assert len(many) > 2 and sum(len(i.ids) for i in many) == 52
    got = scan_leaks(odd_docs, bench)
    assert got.count() == len(odd_rows)
    assert {r.doc_id for r in got.where(F.size("leaks") > 0).collect()} == {
        None, 3, 4, 5, 6, 9, 10}   # random words of one seed begin alike
    assert scan_leaks(no_docs, bench).count() == 0
    assert scan_leaks(docs, bench.limit(0)).where(F.size("leaks") > 0).count() == 0


@pytest.mark.parametrize("size", [6, 9, 11, 15, 16, 20, 23, 24])
def test_one_word_edits_of_short_items_are_found(size):
    items = [(i, words(i, size)) for i in range(40)]
    index = ItemIndex(items)
    for i, text in items[:8]:
        w = text.split()
        for k in range(size):
            for new in (["other"], [], [w[k], "other"]):
                copy = " ".join(w[:k] + new + w[k + 1:])
                raw = f"{words(700 + k, 40)} {copy} {words(800 + k, 90)}".encode()
                assert i in {r[0] for r in index.leaks(raw)}, (i, k, new)
    # Half of the question alone, or words in another order, are no copies.
    for i, text in items[:8]:
        w = text.split()
        for other in (w[:len(w) // 2], w[::-1]):
            assert not index.leaks(" ".join([words(900, 50), *other, words(901, 60)]).encode())


def test_one_index_and_many_give_equal_rows(spark):
    items = [(i, "ÉTÉ Über A1 " + words(i, 20 + i % 3) + " ÉTÉ") for i in range(40)]
    items += [(40, words(40, 200))] + [(50 + i, "... !") for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, words(500 + i, 70 + i) + " " + " ".join(t.split()[:14 + i % 10]) + " "
             + words(600 + i, 300), None, None, None) for i, t in items[:41]]
    docs = spark.createDataFrame(rows, ID_TEXT)
    one, many = (scan_leaks(docs, bench, size=n).select("doc_id", F.inline("leaks")).collect()
                 for n in (1 << 20, 2000))
    assert len(item_indexes(bench, size=2000)) > 2

    def rounded(found):
        return sorted((r.doc_id, r.item_id, round(r.score, 9), *r[3:]) for r in found)
    assert rounded(one) == rounded(many) and len(one) > 5


# --- sharding -----------------------------------------------------------------------------

def check_shards(got, rows, shards, slack):
    out = got.collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out if r.doc_id is not None) == sorted(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows
        if i is not None)
    assert len(out) == len(rows)
    total = [0] * shards
    for s in range(shards):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
        total[s] = sum(r.size for r in out if r.shard == s)
    assert max(total) - min(total) <= slack, total


def test_shards_of_equal_bytes(spark, odd_docs, odd_rows, no_docs):
    r = random.Random(9)
    # A third of all rows share one source and one text.
    rows = [(i, words(1, 50) if i % 3 == 0 else words(i, r.randint(0, 60)),
             "en", "hot" if i % 3 == 0 else f"s{i % 5}", None) for i in range(1500)]
    rows += rows[:100]
    docs = spark.createDataFrame(rows, ID_TEXT).repartition(5)
    check_shards(shard_documents(docs, 24), rows, 24, 1000)
    check_shards(shard_documents(docs, 7), rows, 7, 1000)
    check_shards(shard_documents(odd_docs, 3), odd_rows, 3, 150_000)
    assert shard_documents(no_docs, 24).count() == 0
    total = sum(len(t.encode()) + 8 for _, t, *_ in rows)
    assert shard_documents(docs, target_bytes=total // 5 + 1).select("shard").distinct().count() == 5


# --- pipeline ------------------------------------------------------------------------------

def test_pipeline_stages(spark, odd_docs, no_docs):
    found = {}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for case, given in (("docs", docs), ("odd", odd_docs), ("none", no_docs)):
            out = stage(spark, given, "/root/testdata/sf0.001")
            found[name, case] = out.count()
            if name != "byte-level BPE":
                assert out.columns == corpus_pipeline.COLUMNS
    assert all(n == 0 for (_, case), n in found.items() if case == "none")
    assert found["byte-level BPE", "odd"] == 16
    assert len(CLASHING) > 10
