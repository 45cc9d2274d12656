"""Byte-level BPE encoding by a lazily determinised finite-state transducer.

A token sequence is the BPE encoding of its bytes iff every adjacent pair is: no merge
across the border comes first. That makes a nondeterministic transducer with states
(previous token, node of the token trie): reading a byte goes down the trie, and at a node
that is a token which may follow the previous one it may emit that token. Exactly one path
is complete after every prefix. The subset construction keeps, per open path, the tokens
not yet emitted; what all open paths share is emitted at once, so the lookahead is bounded
by the longest token. Subsets are built when first reached and forgotten when too many.

All tables are flat: one dict of trie edges, one of the steps of numbered subsets, one of
verdicts on token pairs. A state of the first transducer is one number made of both parts.
"""

import base64
import gc
import hashlib
import struct

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparklode.llm.common import encoded, kept, slices, table, tidy
from sparklode.llm.pretokens import splitter

MAX_STATES, MAX_PAIRS, MAX_WORDS = 200_000, 500_000, 150_000
_NEVER = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], bytes]:
    """Plain merging, lowest rank and leftmost first; also the left part of the last merge."""
    parts, left = [piece[i:i + 1] for i in range(len(piece))], b""
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], _NEVER), i)
                      for i in range(len(parts) - 1))
        if rank == _NEVER:
            break
        left = parts[i]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts, left


class Transducer:
    """``encode(piece)`` gives the token ids of one pre-token."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.whole: dict[bytes, int] = {}   # tokens that merging does not reach
        self.edges: dict[int, int] = {}     # node << 8 | byte -> child
        self.inner = [False]                # whether a node has children
        self.token_at: list[int | None] = [None]
        for token, rank in ranks.items():
            parts, left = merge_by_rank(token, ranks)
            if len(parts) > 1:
                self.whole[token] = rank
                continue
            if len(token) > 1:
                pair = ranks[left], ranks[token[len(left):]]
                # Single bytes are there from the start, whatever their rank is.
                if any(p > rank and len(self.bytes_of[p]) > 1 for p in pair):
                    raise ValueError(f"token {rank} comes before a part of it")
                self.parts[rank] = pair
            node = 0
            for byte in token:
                edge, self.inner[node] = node << 8 | byte, True
                node = self.edges.setdefault(edge, len(self.inner))
                if node == len(self.inner):
                    self.inner.append(False)
                    self.token_at.append(None)
            self.token_at[node] = rank
        # A place is (previous token + 1) << width | node.
        self.width = len(self.inner).bit_length()
        self.pairs: dict[int, bool] = {}    # place before a token, its node -> may follow
        self._forget()

    def _forget(self):
        self.steps: dict[int, tuple[int, tuple]] = {}   # state << 8 | byte -> next, emitted
        self.paths: list[tuple] = []    # per state (place, pending ids), oldest first
        self.state_of: dict[tuple, int] = {}
        self._state(((0, ()),))

    def _state(self, paths: tuple) -> int:
        state = self.state_of.get(paths)
        if state is None:
            state = self.state_of[paths] = len(self.paths)
            self.paths.append(paths)
        return state

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between the two tokens.

        Until they are whole, the border lies between a part on the right edge of
        ``left`` and one on the left edge of ``right``. Such a pair merges if its rank
        comes before the merges that use up either part; at equal ranks the left wins.
        """
        a, a_until, b, b_until = left, _NEVER, right, _NEVER
        ok = True
        while ok:
            merged = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], _NEVER)
            ok = not (merged < a_until and merged <= b_until) or merged == _NEVER
            a_since = a if a in self.parts else -1
            b_since = b if b in self.parts else -1
            if a_since < 0 and b_since < 0:
                break
            # Back in time: undo the younger of the two.
            if a_since > b_since:
                a, a_until = self.parts[a][1], a
            else:
                b, b_until = self.parts[b][0], b
        return ok

    def _step(self, state: int, byte: int) -> tuple[int, tuple]:
        """The state after one more byte, and the ids that all its paths share."""
        edges, token_at, inner, pairs = self.edges, self.token_at, self.inner, self.pairs
        width = self.width
        node_bits = (1 << width) - 1
        paths, last = [], None
        for place, out in self.paths[state]:
            node = place & node_bits
            child = edges.get(node << 8 | byte)
            if child is None:
                continue
            further = place - node + child
            if inner[child]:
                paths.append((further, out))
            token = token_at[child]
            if token is not None:
                # Of all paths only one ends in a whole token that may follow.
                follows = pairs.get(further)
                if follows is None:
                    previous = place >> width
                    follows = pairs[further] = (
                        not previous or self.may_follow(previous - 1, token))
                if follows:
                    last = token + 1 << width, out + (token,)
        if last is None:
            raise ValueError("no encoding; the ranks are not those of a BPE")
        paths.append(last)
        shared = paths[0][1]
        if shared:
            for _, out in paths:
                while shared != out[:len(shared)]:
                    shared = shared[:-1]
            if shared:
                cut = len(shared)
                paths = [(place, out[cut:]) for place, out in paths]
        known = self.steps[state << 8 | byte] = self._state(tuple(paths)), shared
        return known

    def encode(self, piece: bytes) -> list[int]:
        rank = self.whole.get(piece)
        if rank is not None:
            return [rank]
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        if len(self.paths) > MAX_STATES:
            self._forget()
        state, ids, steps = 0, [], self.steps
        for byte in piece:
            known = steps.get(state << 8 | byte)
            if known is None:
                if len(self.paths) > 2 * MAX_STATES:   # within one long piece
                    here = self.paths[state]
                    self._forget()
                    state, steps = self._state(here), self.steps
                known = self._step(state, byte)
            state, emitted = known
            if emitted:
                ids += emitted
        ids += self.paths[state][-1][1]   # the path that is complete here
        return ids


class Utf8Stream:
    """Incremental UTF-8 decoding: a small state machine finds what is still incomplete.

    Its state is the number of bytes that the open character still needs and the range of
    its next byte. What can no longer become a character turns into U+FFFD.
    """

    def __init__(self):
        self.open = b""

    @staticmethod
    def _tail(data: bytes) -> int:
        """Length of an incomplete but possible character at the end."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need, low, high = ((1, 0x80, 0xBF) if 0xC2 <= lead <= 0xDF
                               else (2, 0xA0 if lead == 0xE0 else 0x80,
                                     0x9F if lead == 0xED else 0xBF) if 0xE0 <= lead <= 0xEF
                               else (3, 0x90 if lead == 0xF0 else 0x80,
                                     0x8F if lead == 0xF4 else 0xBF) if 0xF0 <= lead <= 0xF4
                               else (0, 0, 0))
            if back > need or (back > 1 and not low <= data[1 - back] <= high):
                return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data) - self._tail(data)
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Whole texts to ids and back, with a bounded memory of pre-tokens."""

    def __init__(self, path: str):
        self.transducer = Transducer(load_ranks(path))
        size = max(self.transducer.bytes_of) + 1
        self.token_bytes = [self.transducer.bytes_of.get(i, b"") for i in range(size)]
        self.split = splitter()
        codec = self

        class Words(dict):
            """Packed ids of short pre-tokens; what was in use lately outlives a clearing."""
            before: dict[str, bytes] = {}

            def __missing__(self, piece):
                packed = self.before.get(piece)
                if packed is None:
                    ids = codec.transducer.encode(piece.encode())
                    packed = struct.pack(f"<{len(ids)}I", *ids)
                if len(piece) <= 64:
                    self[piece] = packed
                return packed
        self.new_words = Words
        self.words = Words()

    def encode(self, text: str) -> np.ndarray:
        if len(self.words) > MAX_WORDS:
            before = dict(self.words)
            self.words = self.new_words()
            self.words.before = before
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.split(text))),
                             "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray, step: int = 1 << 16) -> str:
        stream = Utf8Stream()
        parts = [stream.feed(self.decode_bytes(ids[i:i + step]))
                 for i in range(0, len(ids), step)]
        return "".join(parts) + stream.close()


def codec_of(path: str) -> Codec:
    """One codec per Python worker; it stays until a task of another kind begins."""
    codecs = kept("codec")
    if path not in codecs:
        codecs.clear()
        codecs[path] = Codec(path)
    return codecs[path]


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", keep=("doc_id",),
                     ids: bool = False) -> DataFrame:
    """Token ids of every text, and what they decode to.

    Per row: the ``keep`` columns, n_tokens, ids_sha256 (ids as little-endian unsigned
    32-bit integers), decoded_sha256 (the decoded bytes), round_trip (whether the streamed
    decoding equals the text) and, if asked for, the ids. NULL is taken as the empty text.
    Rows are independent of each other: repeated rows stay, other columns are not read.
    """
    keep = list(keep)
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    schema = kinds + ("n_tokens long, ids_sha256 string, decoded_sha256 string, "
                      "round_trip boolean") + (", ids array<int>" if ids else "")
    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
    names += ["ids"] if ids else []

    def run(batches):
        codec = codec_of(vocabulary)
        gc.disable()   # the automaton is large and has no cycles
        try:
            yield from encode_batches(codec, batches)
        finally:
            gc.enable()

    def encode_batches(codec, batches):
        for b in slices(batches, len(keep)):
            out = [[], [], [], [], []]
            for raw in encoded(b.column(len(keep))):
                whole = raw.decode()
                found = codec.encode(whole)
                digest, back, stream = hashlib.sha256(), [], Utf8Stream()
                for i in range(0, len(found), 1 << 16):
                    piece = codec.decode_bytes(found[i:i + (1 << 16)])
                    digest.update(piece)
                    back.append(stream.feed(piece))
                back.append(stream.close())
                row = (len(found), hashlib.sha256(found.tobytes()).hexdigest(),
                       digest.hexdigest(), "".join(back) == whole,
                       found.astype(np.int32) if ids else None)
                for values, value in zip(out, row):
                    values.append(value)
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()),
                      pa.array(out[2], pa.string()), pa.array(out[3], pa.bool_())]
            if ids:
                arrays.append(pa.array(out[4], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(keep))] + arrays, names=names)

    return docs.select(*keep, F.col(text).alias("whole text")).mapInArrow(
        tidy(run, "codec"), schema)


def op3_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"),
                            public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
