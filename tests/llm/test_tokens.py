"""The BPE transducer and the token counts against the public libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from sparklode.llm.bpe_transducer import Codec, Utf8Stream, encode_documents
from sparklode.llm.pretokens import splitter
from sparklode.llm.token_counts import Counter, count_tokens
from llm_helpers import sorted_rows

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
FILE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "aa", "b", " ", "  ", "\n", "é", "ß", "1", "12", "'s", "'", "!", "the", "ing", "tion",
         "　", "中", "文", "😀", "\x1c", "_", "Ⅷ", "²", "<|endoftext|>", "<|end", "oftext|>",
         "\x00", "́", "'ll", "\t"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    made = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    made += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))
             for _ in range(400)]
    return made + ["a" + chr(p) + "1 " + chr(p) * 2 for p in range(0x20, 0x3200)]


@pytest.fixture(scope="module")
def codec():
    return Codec(RANKS)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=codec.transducer.ranks, special_tokens={})


def test_split_is_the_public_pattern(texts):
    split, pattern = splitter(), regex.compile(public_tokenizers.PATTERN)
    # The library's white space has no separators 1C to 1F; the pattern module's has.
    for t in texts[:4400]:   # unassigned characters differ between versions
        if "\x1c" not in t:
            assert split(t) == pattern.findall(t)


def test_ids_are_those_of_the_library(codec, library, texts):
    for t in texts:
        assert codec.encode(t).tolist() == library.encode_ordinary(t)


def test_forgetting_does_not_change_ids(library, texts, monkeypatch):
    monkeypatch.setattr("sparklode.llm.bpe_transducer.MAX_STATES", 50)
    monkeypatch.setattr("sparklode.llm.bpe_transducer.MAX_WORDS", 10)
    small = Codec(RANKS)
    for t in texts[:1500]:
        assert small.encode(t).tolist() == library.encode_ordinary(t)
    assert small.encode("b" * 5000 + "q").tolist() == library.encode_ordinary("b" * 5000 + "q")


def test_round_trip_in_any_steps(codec, texts):
    for t in texts[:500]:
        for step in (1, 3):
            assert codec.decode(codec.encode(t), step) == t


@pytest.mark.parametrize("raw", [b"\xff", b"\xe2\x82", b"a\xf0\x9f\x98", b"\xed\xa0\x80", b"\xc0\xaf"])
def test_stream_decodes_as_the_whole_does(raw):
    stream = Utf8Stream()
    assert "".join(stream.feed(raw[i:i + 1]) for i in range(len(raw))) + stream.close() \
        == raw.decode("utf-8", "replace")


def test_odd_documents_encode(spark, odd_docs, odd_rows, no_docs, library):
    got = sorted_rows(encode_documents(odd_docs, RANKS), "doc_id", "n_tokens", "ids_sha256",
                      "decoded_sha256", "round_trip")
    want = []
    for i, t, *_ in odd_rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert got == sorted(want, key=repr)
    assert encode_documents(no_docs, RANKS).count() == 0


def test_counts_are_those_of_the_library(texts, monkeypatch):
    library = Tokenizer.from_file(FILE)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    counter = Counter(FILE)
    assert counter.count_all(texts) == want
    monkeypatch.setattr("sparklode.llm.token_counts.LONG", 3)   # the way of long pieces
    assert Counter(FILE).count_all(texts[:1500]) == want[:1500]


def test_odd_documents_count(odd_docs, odd_rows, no_docs):
    library = Tokenizer.from_file(FILE)
    want = []
    for i, t, *_ in odd_rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert sorted_rows(count_tokens(odd_docs, FILE), "doc_id", "n_bytes", "n_tokens",
                       "over_limit") == sorted(want, key=repr)
    assert count_tokens(no_docs, FILE).count() == 0


def test_kept_memory_goes_when_another_kind_of_task_begins():
    """Functions reach a worker pickled, as here: a module's dict named by one is a copy there."""
    from pyspark import cloudpickle
    from sparklode.llm import common

    def sent(kind):
        def run(batches):
            common.kept(kind or "none")["used"] = True
            yield from batches
        return cloudpickle.loads(cloudpickle.dumps(common.tidy(run, kind)))

    common._KEPT.clear()
    assert list(sent("codec")([1])) == [1] and set(common._KEPT) == {"codec"}
    assert list(sent("codec")([1])) == [1] and set(common._KEPT) == {"codec"}
    assert list(sent("counter")([1])) == [1] and set(common._KEPT) == {"counter"}
    common.begin(None)
    assert not common._KEPT
