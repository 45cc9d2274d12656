"""Keyword search over a stored inverted index in segments.

A segment is one row: the keys of some chunks, their distinct words, and for every word the
places of the chunks that hold it. All words of a chunk lie in its segment, so a task that reads
a segment knows the counts of its chunks, and no (word, chunk) pair is ever shuffled. Segments
are dealt to the buckets of a stored index like the chunks: a run writes the segments of touched
buckets anew, and needs no marks for deleted chunks.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sparklode import model as M
from sparklode.functions.storage import materialize
from sparklode.functions.text import question_tokens
from sparklode.operators.topk import (
    PartialTopN, joined_keys, question_blocks, rank_rows, repo_mask)
from sparklode.sources.buckets import bucket_of

# Bounds of one segment; a chunk beyond the second one has a segment of its own.
SEGMENT_CHUNKS = 1_024
SEGMENT_CHARS = 4 * 1024 * 1024
_PLACES = 1 << 20
SEGMENT = ("bucket int, repos array<string>, keys array<string>, words array<string>, "
           "ends array<int>, places array<int>")
_TEXTS, _NUMBERS = pa.list_(pa.string()), pa.list_(pa.int32())
_SCHEMA = pa.schema([("bucket", pa.int32()), ("repos", _TEXTS), ("keys", _TEXTS),
                     ("words", _TEXTS), ("ends", _NUMBERS), ("places", _NUMBERS)])


def build_segments(chunks: DataFrame, buckets: int) -> DataFrame:
    """Segments of the chunks (repo_id, file_path, chunk_key, search_text), by bucket.

    Only keys and texts are shuffled, once. A chunk without a search text is in no segment.
    """
    rows = chunks.where("search_text IS NOT NULL").select(
        bucket_of(buckets).alias("bucket"), "repo_id", "chunk_key", "search_text")

    def write(batches):
        now, keys, words, sizes, chars = None, [], [], [], 0

        def segment():
            flat = pa.array(words, pa.binary()).cast(pa.string())
            lists = _inverted(flat, np.array(sizes, np.int64))
            one = [[r for r, _ in keys], [k for _, k in keys], *lists]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(
                pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t.value_type))
                for x, t in zip(one, _SCHEMA.types[1:]))], schema=_SCHEMA)

        for b in batches:
            for at in range(0, b.num_rows, SEGMENT_CHUNKS):
                for bucket, repo, key, text in zip(
                        *(c.to_pylist() for c in b.slice(at, SEGMENT_CHUNKS).columns)):
                    if keys and (bucket != now or len(keys) >= SEGMENT_CHUNKS
                                 or chars + len(text) > SEGMENT_CHARS):
                        yield segment()
                        keys, words, sizes, chars = [], [], [], 0
                    # Of bytes, split() takes the white space that parts the tokens of a question.
                    distinct = set(text.encode().split())
                    words += distinct
                    sizes.append(len(distinct))
                    now, chars = bucket, chars + len(text)
                    keys.append((repo, key))
        if keys:
            yield segment()

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(write, SEGMENT)


def _inverted(words: pa.Array, sizes: np.ndarray):
    """The words of some chunks, so many of each, as distinct words, ends and places.

    Words of one character are left out: no token is shorter than two.
    """
    coded = words.dictionary_encode()
    long = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False) > 1
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair = code * len(sizes) + np.repeat(np.arange(len(sizes)), sizes)
    code, place = np.divmod(np.unique(pair[long[code]]), max(1, len(sizes)))
    number = np.cumsum(long) - 1
    ends = np.cumsum(np.bincount(number[code], minlength=int(long.sum())))
    return (coded.dictionary.filter(pa.array(long)), ends.astype(np.int32),
            place.astype(np.int32))


def keyword_topk_segments(queries: DataFrame, segments: DataFrame,
                          n: int = M.RETRIEVE_N) -> DataFrame:
    """The result of ``search.keyword_topk``, read from segments.

    A question meets the chunks of a segment only if all its tokens among the words of the
    segment could bring a chunk to its n best of the task. Result: query_id, repo_id,
    chunk_key, matches, krank.
    """
    return _ranked(queries, segments.select("repos", "keys", "words", "ends", "places"), n,
                   _stored)


def keyword_topk_lists(queries: DataFrame, lists: DataFrame,
                       n: int = M.RETRIEVE_N) -> DataFrame:
    """The same from the words of each chunk: [repo_id,] chunk_key, words array<string>.

    A task makes its segments as it goes and writes none.
    """
    repo = F.col("repo_id") if "repo_id" in lists.columns else F.lit(None).cast("string")
    return _ranked(queries, lists.select(repo.alias("repo_id"), "chunk_key", "words"), n,
                   _made)


def _stored(batches):
    """Repositories, keys, words, ends and places of one segment after the other."""
    for b in batches:
        for at in range(b.num_rows):
            repos, keys, words, ends, places = (c.slice(at, 1).flatten() for c in b.columns)
            yield repos, keys, words.to_pylist(), np.asarray(ends), np.asarray(places)


def _made(batches):
    """The same of chunks that come with their words; segments have the bounds above."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            size = pc.list_value_length(b.column(2).slice(at, SEGMENT_CHUNKS)).to_numpy(
                zero_copy_only=False).astype(np.int64)
            most = np.searchsorted(np.cumsum(size), SEGMENT_CHARS // 8, "right")
            part = b.slice(at, max(1, int(most)))
            at += part.num_rows
            words, ends, places = _inverted(part.column(2).flatten(), size[:part.num_rows])
            yield part.column(0), part.column(1), words.to_pylist(), ends, places


def _ranked(queries, rows, n, segments):
    blocks = question_blocks(queries, "question")
    if len(blocks) > 1 and segments is _made:   # a scan for each block
        rows = materialize(rows)
    parts = [_block(b, rows, n, segments) for b in blocks]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rank_rows(rows, ["neg", "chunk_key", "repo_id"], n, "krank").select(
        "query_id", "repo_id", "chunk_key", (-F.col("neg")).cast("long").alias("matches"),
        "krank")


def _block(block, table, n, segments):
    scoped = "repo_id" in block.columns
    rows = block.select("query_id", question_tokens("question").alias("tokens"),
                        *(["repo_id"] if scoped else [])).toArrow()   # a bounded block
    ids = rows["query_id"].to_pylist()
    wanted = np.asarray(rows["repo_id"].to_pylist(), object) if scoped else None
    uses: dict[str, dict[int, int]] = {}
    for q, tokens in enumerate(rows["tokens"].to_pylist()):
        for t in tokens or []:
            per = uses.setdefault(t, {})
            per[q] = per.get(q, 0) + 1
    asked = [(np.array(list(per)), np.array(list(per.values()), np.int32))
             for per in uses.values()]
    shared = block.sparkSession.sparkContext.broadcast((ids, list(uses), asked, wanted))
    kind = block.schema["query_id"].dataType.simpleString()

    def scan(batches):
        import ahocorasick
        ids, tokens, asked, wanted = shared.value
        best = PartialTopN(len(ids), n)
        automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            automaton.add_word(t, i)
        if tokens:
            automaton.make_automaton()
        for repos, keys, words, ends, places in segments(batches if tokens else ()):
            found, marks = _found(automaton, words, ends, places, len(keys))
            most = np.zeros(len(ids), np.int64)
            for t in found:
                qs, times = asked[t]
                most[qs] += times
            live = np.array([q for q in np.flatnonzero(most)
                             if most[q] >= _least(best, q)], np.int64)
            if not len(live):
                continue
            row = np.full(len(ids), -1)
            row[live] = np.arange(len(live))
            counts = np.zeros((len(live), len(keys)), np.int32)
            for t, chunks in zip(found, marks):
                qs, times = asked[t]
                here = row[qs] >= 0
                counts[row[qs[here]]] += times[here][:, None] * chunks
            score = np.where(counts > 0, -counts.astype(np.float64), np.inf)
            if wanted is not None:
                score[~repo_mask(wanted[live], repos)] = np.inf
            best.push(score, joined_keys(
                pa.RecordBatch.from_arrays([repos, keys], names=["r", "k"]), 2), live)
        if ids:
            yield best.table(ids, ["query_id", "repo_id", "chunk_key", "neg"])

    return table.mapInArrow(
        scan, f"query_id {kind}, repo_id string, chunk_key string, neg double")


def _least(best: PartialTopN, q: int) -> float:
    """The matches that a further chunk needs for the n best of a question."""
    scores, _ = best.best[q]
    return -scores[-1] if len(scores) >= best.n else 1


def _found(automaton, words, ends, places, chunks) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that lie within a word, and for each the chunks of its words as 0 and 1."""
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    hits = np.array(list(automaton.iter("\n".join(words))), np.int64).reshape(-1, 2)
    word = np.searchsorted(starts, hits[:, 0], "right") - 1
    token, word = np.divmod(np.unique(hits[:, 1] * len(starts) + word), len(starts))
    tokens, token = np.unique(token, return_inverse=True)
    marks = np.zeros((len(tokens), chunks), np.int8)
    begin = np.r_[0, ends][word]
    sizes = ends[word] - begin if len(word) else begin
    total, at = np.cumsum(sizes), 0
    while at < len(word):   # a bounded number of places at once
        before = total[at] - sizes[at]
        end = max(at + 1, int(np.searchsorted(total, before + _PLACES, "right")))
        size = sizes[at:end]
        place = np.arange(total[end - 1] - before) + np.repeat(
            begin[at:end] - (total[at:end] - size - before), size)
        marks[np.repeat(token[at:end], size), places[place]] = 1
        at = end
    return tokens, marks
