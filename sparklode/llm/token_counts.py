"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch lie behind each other in one array of symbols. In each
round every pre-token merges all places of its lowest-rank pair at once; pre-tokens without
a pair that merges leave the round. What is left are the tokens, of which only the number
is kept.
"""

import heapq
import json

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparklode.llm.common import encoded, kept, octets, slices, table, tidy
from sparklode.llm.pretokens import splitter

MAX_WORDS, LONG = 300_000, 2_000
_NONE = np.int64(1 << 40)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """Merges of a tokenizer file as arrays; symbols are numbered bytes first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, before = whole["model"], whole.get("pre_tokenizer") or {}
        if (model["type"] != "BPE" or before.get("type") != "ByteLevel"
                or before.get("add_prefix_space") or not before.get("use_regex", True)
                or whole.get("normalizer") or model.get("ignore_merges")
                or model.get("dropout")):
            raise ValueError(f"not a plain byte-level BPE: {path}")
        self.specials = sorted((t["content"] for t in whole.get("added_tokens", [])),
                               key=len, reverse=True)
        number = byte_symbols()
        lefts, rights, ranks, made = [], [], [], []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            if left not in number or right not in number:
                raise ValueError(f"merge {rank} uses a part that comes later")
            result = number.setdefault(left + right, len(number))
            lefts.append(number[left])
            rights.append(number[right])
            ranks.append(rank)
            made.append(result)
        self.by_pair: dict[int, tuple[int, int]] = {}
        pairs = np.array(lefts, np.int64) << 32 | np.array(rights, np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs = pairs[order]
        self.rank = np.array(ranks, np.int64)[order]
        self.made = np.array(made, np.int64)[order]

    def _ranked(self, left, right):
        """Position in the table of each pair of symbols, -1 if it does not merge."""
        if not len(self.pairs):
            return np.full(len(left), -1)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, at, -1)

    def _count_one(self, piece: bytes) -> int:
        """The same for one long piece: its pairs wait in a heap by rank and place."""
        if not self.by_pair:
            self.by_pair = dict(zip(self.pairs.tolist(),
                                    zip(self.rank.tolist(), self.made.tolist())))
        size, symbols = len(piece), list(piece)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = []

        def offer(i):
            j = after[i]
            if j < size and (pair := self.by_pair.get(symbols[i] << 32 | symbols[j])):
                heapq.heappush(heap, (pair[0], i, symbols[i], symbols[j], pair[1]))
        for i in range(size):
            offer(i)
        count = size
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i] if symbols[i] == left else size
            if j >= size or symbols[j] != right:
                continue
            symbols[i], symbols[j], after[i] = made, -1, after[j]
            if after[j] < size:
                before[after[j]] = i
            count -= 1
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return count

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Number of tokens of each piece."""
        long = [i for i, p in enumerate(pieces) if len(p) > LONG]
        if long:   # so many rounds for one sequence would cost its length each
            found = self.count([b"" if len(p) > LONG else p for p in pieces])
            found[long] = [self._count_one(pieces[i]) for i in long]
            return found
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        total = np.zeros(len(pieces), np.int64)
        symbols = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        row = np.repeat(np.arange(len(pieces)), sizes)
        while len(symbols):
            at = np.full(len(symbols), -1)
            if len(symbols) > 1:
                same = row[:-1] == row[1:]
                at[:-1][same] = self._ranked(symbols[:-1][same], symbols[1:][same])
            rank = np.where(at >= 0, self.rank[at] if len(self.rank) else _NONE, _NONE)
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(row)])
            open_rows = best < _NONE
            done = ~open_rows
            total[row[starts[done]]] += lengths[done]
            best = np.repeat(best, lengths)
            merge = (rank == best) & (best < _NONE)
            # Where places overlap (x x x), every second one of a run counts, from the left.
            places = np.flatnonzero(merge)
            if len(places):
                fresh = np.r_[True, np.diff(places) != 1]
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
                merge[places[(np.arange(len(places)) - first) % 2 == 1]] = False
            gone = np.r_[False, merge[:-1]]
            symbols = np.where(merge, self.made[at] if len(self.made) else 0, symbols)
            keep = ~gone & (best < _NONE)
            symbols, row = symbols[keep], row[keep]
        return total


class Counter:
    """Token counts of whole texts, with a bounded memory of pre-tokens."""

    def __init__(self, path: str):
        self.merges, self.split, self.words = MergeTable(path), splitter(), {}

    def count_all(self, texts: list[str]) -> list[int]:
        counts, pieces, owner = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            parts = [text]
            for special in self.merges.specials:
                if special in text:
                    parts = [p for part in parts for p in part.split(special)]
            # Each special string inside the text is one token of its own.
            counts[i] += len(parts) - 1
            for part in parts:
                pieces.append(self.split(part))
                owner.append(i)
        known = self.words
        if len(known) > MAX_WORDS:
            known.clear()
        new = list(set().union(*pieces) - known.keys()) if pieces else []
        if new:
            found = self.merges.count([p.encode() for p in new]).tolist()
            known.update(zip(new, found))
        for i, words in zip(owner, pieces):
            counts[i] += sum(map(known.__getitem__, words))
        for p in new:
            if len(p) > 64:
                del known[p]
        return counts


def counter_of(path: str) -> Counter:
    counters = kept("counter")
    if path not in counters:
        counters.clear()
        counters[path] = Counter(path)
    return counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, text: str = "text",
                 keep=("doc_id",)) -> DataFrame:
    """n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every whole text.

    NULL is taken as the empty text, which has no tokens. Every row gives one row, repeated
    ones too; columns other than ``keep`` and the text are not read.
    """
    keep = list(keep)
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    k = len(keep)

    def run(batches):
        counter = counter_of(tokenizer)
        for b in slices(batches, k + 1):
            counts = counter.count_all([t.decode() for t in encoded(b.column(k + 1))])
            tokens = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(k + 1)), tokens,
                 pa.compute.greater(tokens, limit)],
                names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(*keep, octets(text).alias("n_bytes"), text).mapInArrow(
        tidy(run, "counter"), kinds + "n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"))
