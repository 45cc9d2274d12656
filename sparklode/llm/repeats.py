"""Suffix-array dedup: removes every byte of a 100-byte string that also starts earlier.

Strings meet by their content first. Each 100-byte window has an anchor, the smallest hash
of its 20-byte pieces; neighbouring windows with one anchor form a run. Equal windows have
equal anchors at the same place, so only runs with one anchor hash can share a window.
Narrow rows (anchor hash, hash of the run's bytes, place) are shuffled by anchor hash and
walked in sorted order: equal runs are one class, of which only the first occurrence can
hold windows that are the first of their kind. Where an anchor has several classes, the
bytes of their first occurrences are gathered into blocks of whole anchors.

In a block the suffixes are ordered, and on the Burrows-Wheeler transform the intervals of
all strings are extended backwards breadth first: round by round this marks the borders
between suffixes with a common prefix of 0, 1, 2 ... bytes. It stops at the minimum length;
suffixes without a marked border between them share that many bytes. Of such a group all
but the first window by (doc_id, start) repeat.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparklode.llm.common import (
    encoded, mix, slices, spread, store, stored_bytes, table, text_buffer, text_bytes, tidy)
from sparklode.llm.shingles import powers, prefix_sums, _P_INVERSE

LENGTH, PIECE = 100, 20
PART_BYTES, BLOCK_BYTES = 2 << 20, 2 << 20
# More runs than this on one anchor are dealt anew by narrower parts of their windows.
MAX_GROUP = 8_192
WIDTHS = (8, 1)
NO_ID = -(1 << 63)
_ROW = "ah long, ch long, d long, place long, n long"
_FOUND = "kind int, ah long, d long, place long, n long"


# --- runs of windows with one anchor ----------------------------------------

def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchor_runs(flat: np.ndarray, offsets: np.ndarray, length: int, piece: int):
    """Start, number of windows, anchor, anchor hash and content hash of every run.

    Ties of the smallest hash go to the leftmost piece, so an anchor depends on the bytes
    of its window only.
    """
    none = np.zeros(0, np.int64)
    if len(flat) < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums, back = prefix_sums(flat), powers(len(flat) + 1, _P_INVERSE)
    last = len(flat) - piece + 1
    hashes = mix((sums[piece:] - sums[:-piece]) * back[:last])
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(last, dtype=np.uint64)
    anchor = (_sliding_min(ranked, length - piece + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Windows lie within one text.
    inside = np.zeros(len(flat) + 1, np.int32)
    sizes = np.diff(offsets)
    held = sizes >= length
    inside[offsets[:-1][held]] += 1
    inside[offsets[1:][held] - length + 1] -= 1
    valid = np.cumsum(inside[:len(anchor)]) > 0
    turn = np.ones(len(anchor), bool)
    turn[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(valid & turn)
    ends = np.append(np.flatnonzero(turn | ~valid), len(anchor))
    count = ends[np.searchsorted(ends, starts, "right")] - starts
    stop = starts + count + length - 1
    content = mix((sums[stop] - sums[starts]) * back[starts] + count.astype(np.uint64))
    at = anchor[starts]
    return starts, count, at, hashes[at], content


def _parts(batch, column: int, overlap: int):
    """(row, base) per text and the texts as flat bytes, in parts of bounded size.

    A longer text comes in several parts that overlap so that no window is lost.
    """
    for b in slices([batch], column, PART_BYTES):
        flat, offsets = text_buffer(b.column(column))
        if b.num_rows > 1 or len(flat) <= 2 * PART_BYTES:
            yield b, np.zeros(b.num_rows, np.int64), flat, offsets
            continue
        for base in range(0, len(flat) - overlap, PART_BYTES):
            part = flat[base:base + PART_BYTES + overlap]
            yield b, np.array([base]), part, np.array([0, len(part)])


def _merged(d, tag, start, count):
    """Rows (d, tag, start, count) with adjacent ranges of one text joined."""
    if not len(d):
        return d, tag, start, count
    order = np.lexsort((start, tag, d))
    d, tag, start, count = d[order], tag[order], start[order], count[order]
    new = np.ones(len(d), bool)
    new[1:] = ((d[1:] != d[:-1]) | (tag[1:] != tag[:-1])
               | (start[1:] != start[:-1] + count[:-1]))
    at = np.flatnonzero(new)
    return d[at], tag[at], start[at], np.add.reduceat(count, at)


def _place(start, tag):
    return start << 32 | tag   # sorted by start; 24 bits tell texts of one doc_id apart


def _run_rows(texts: DataFrame, length: int, piece: int) -> DataFrame:
    """One row per run; n > 0 marks windows that repeat an earlier run of the same slice."""
    def run(batches):
        for whole in batches:
            for b, base, flat, offsets in _parts(whole, 2, length - 1):
                starts, count, _, ah, ch = anchor_runs(flat, offsets, length, piece)
                if not len(starts):
                    continue
                row = np.searchsorted(offsets, starts, "right") - 1
                d = b.column(0).to_numpy()[row]
                tag = b.column(1).to_numpy()[row]
                start = starts - offsets[row] + base[row]
                order = np.lexsort((start, d, ch, ah))
                ah, ch = ah[order].view(np.int64), ch[order].view(np.int64)
                d, tag, start, count = d[order], tag[order], start[order], count[order]
                new = np.ones(len(ah), bool)
                new[1:] = (ah[1:] != ah[:-1]) | (ch[1:] != ch[:-1])
                first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                later = (d != d[first]) | (start != start[first])
                keep = ~later
                md, mtag, mstart, mcount = _merged(*(x[later] for x in (d, tag, start, count)))
                spread = mix(md.view(np.uint64) + mstart.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[x, y]) for x, y in (
                    (ah[keep], spread), (ch[keep], np.zeros_like(md)), (d[keep], md),
                    (_place(start[keep], tag[keep] << 8 | count[keep]),
                     _place(mstart, mtag << 8)),
                    (np.zeros(keep.sum(), np.int64), mcount))],
                    names=["ah", "ch", "d", "place", "n"])

    return texts.mapInArrow(tidy(run), _ROW)


def _walk(rows: DataFrame, payload: bool = False) -> DataFrame:
    """Walks rows sorted by (ah, ch, d, place), keeping only the current class in memory.

    kind 1: windows that repeat (n of them); kind 2: first runs of anchors with several
    classes, n of windows each, with their bytes if these are carried along.
    """
    order = ["ah", "ch", "d", "place"]
    ready = rows.repartition("ah").sortWithinPartitions(*order)
    names = ["kind", "ah", "d", "place", "n"] + (["bytes"] if payload else [])

    def batch(kind, ah, d, place, n, extra):
        arrays = [pa.array(np.full(len(ah), kind, np.int32)), *map(pa.array, (ah, d, place, n))]
        return pa.RecordBatch.from_arrays(arrays + ([extra] if payload else []), names=names)

    def run(batches):
        last = None      # ah, ch, and d and start of the first run of the class
        several = False  # whether the current anchor has a second class
        held = []        # its first runs so far, while it has none
        for b in batches:
            ah, ch, d, place, n = (b.column(i).to_numpy() for i in range(5))
            if not len(ah):
                continue
            bytes_ = b.column(5) if payload else None
            start, tag, count = place >> 32, (place >> 8) & 0xFFFFFF, place & 0xFF
            done = n > 0
            new = np.ones(len(ah), bool)
            new[1:] = (ah[1:] != ah[:-1]) | (ch[1:] != ch[:-1])
            new_anchor = np.ones(len(ah), bool)
            new_anchor[1:] = ah[1:] != ah[:-1]
            if last:
                new_anchor[0] = ah[0] != last[0]
                new[0] = new_anchor[0] or ch[0] != last[1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(ah)), -1))
            fd = np.where(first >= 0, d[first], last[2] if last else 0)
            fs = np.where(first >= 0, start[first], last[3] if last else 0)
            later = ((d != fd) | (start != fs)) & ~done
            yield batch(1, ah[later], d[later], _place(start[later], tag[later] << 8),
                        count[later], pa.nulls(int(later.sum()), pa.binary()))
            yield batch(1, ah[done], d[done], place[done], n[done],
                        pa.nulls(int(done.sum()), pa.binary()))
            # Rows of one anchor: those before the batch have number 0.
            group = np.cumsum(new_anchor) - new_anchor[0]
            more = np.bincount(group[new & ~new_anchor], minlength=group[-1] + 1) > 0
            if not new_anchor[0]:
                more[0] |= several
            elif held:
                held = []
            firsts = ~later & ~done
            out = firsts & more[group]
            if held and more[0]:
                for x in held:
                    yield batch(2, *x)
                held = []
            pick = np.flatnonzero(out)
            yield batch(2, ah[pick], d[pick], place[pick], count[pick],
                        bytes_.take(pa.array(pick)) if payload else None)
            if group[-1] or new_anchor[0]:
                held = []
            several = bool(more[-1])
            if not several:
                pick = np.flatnonzero(firsts & (group == group[-1]))
                held.append((ah[pick], d[pick], place[pick], count[pick],
                             bytes_.take(pa.array(pick)) if payload else None))
            last = ah[-1], ch[-1], fd[-1], fs[-1]

    return ready.mapInArrow(tidy(run), _FOUND + (", bytes binary" if payload else ""))


# --- the bytes of runs --------------------------------------------------------

def _gather(found: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Bytes of the runs of kind 2. A text's list is bounded by its own length."""
    wanted = (found.where("kind = 2")
              .groupBy("d", F.expr("shiftright(place, 8) & 16777215").alias("tag"))
              .agg(F.collect_list(F.struct("ah", "place", "n")).alias("runs")))

    def run(batches):
        for b in slices(batches, 2, PART_BYTES):
            for i, raw in enumerate(encoded(b.column(2))):
                runs = b.column(3)[i].values.flatten()
                ah, place, n = (r.to_numpy() for r in runs)
                for at in range(0, len(ah), 8_192):
                    part = slice(at, at + 8_192)
                    cut = [raw[s:s + k + length - 1] for s, k in
                           zip((place[part] >> 32).tolist(), n[part].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ah[part]), pa.array(np.full(len(cut), b.column(0)[i].as_py())),
                         pa.array(place[part]), pa.array(n[part]), pa.array(cut, pa.binary())],
                        names=["ah", "d", "place", "n", "bytes"])

    return (texts.join(wanted, ["d", "tag"]).select("d", "tag", "text", "runs")
            .mapInArrow(tidy(run), "ah long, d long, place long, n long, bytes binary"))


def _narrower(runs: DataFrame, width: int, length: int, piece: int) -> DataFrame:
    """Runs cut where the distance to the anchor passes a multiple of ``width``.

    All windows of such a part hold a common middle, as do equal ones of other runs, so the
    parts are dealt by the hash of it instead of the anchor alone.
    """
    def run(batches):
        for b in slices(batches, 4, PART_BYTES):
            out = []
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                       b.column(2).to_pylist(), b.column(3).to_pylist(), encoded(b.column(4)))
            for ah, d, place, n, raw in rows:
                flat = np.frombuffer(raw, np.uint8)
                anchors = anchor_runs(flat, np.array([0, len(flat)]), length, piece)
                anchor = int(anchors[2][0])
                s = 0
                while s < n:
                    part = (anchor - s) // width
                    end = min(n, anchor - part * width + 1)
                    middle = raw[anchor - part * width:anchor - (part + 1) * width + 1 + length]
                    cut = raw[s:end + length - 1]
                    key = hashlib.blake2b(middle, digest_size=8, key=b"%d %d" % (ah, part))
                    out.append((int.from_bytes(key.digest(), "little", signed=True),
                                int.from_bytes(hashlib.blake2b(cut, digest_size=8).digest(),
                                               "little", signed=True),
                                d, place + (s << 32) - (place & 0xFF) + end - s, 0, cut))
                    s = end
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:5]),
                 pa.array(columns[5], pa.binary())],
                names=["ah", "ch", "d", "place", "n", "bytes"])

    return runs.mapInArrow(tidy(run), _ROW + ", bytes binary")


# --- blocks --------------------------------------------------------------------

def suffix_order(symbols: np.ndarray, length: int):
    """Suffixes in the order of their first ``length`` symbols or more (values 0 to 256).

    Prefix doubling; from the second round on only suffixes that are still tied are sorted.
    """
    n = len(symbols)
    padded = np.zeros(n + 7, np.uint64)
    padded[:n] = symbols
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = key << np.uint64(9) | padded[j:j + n]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    sorted_key = key[order]
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    known = 7
    while known < length:
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n + 1, np.int64)
        rank[order] = first + 1
        rank[n] = 0
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        suffix = order[slots]
        pair = rank[suffix] << 32 | rank[np.minimum(suffix + known, n)]
        by = np.argsort(pair, kind="stable")
        order[slots] = suffix[by]
        pair = pair[by]
        again = np.ones(len(slots), bool)
        again[1:] = pair[1:] != pair[:-1]
        new[slots] = again
        known *= 2
    return order


def marked_borders(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """borders[i]: suffixes i - 1 and i in the order share fewer than ``length`` symbols.

    Round r holds the intervals of strings of r + 1 symbols whose upper border was unmarked
    before, and marks it: its common prefix has r symbols. Each extends backwards by every
    symbol of its part of the transform. A border is marked once, so all rounds together
    hold at most one interval per suffix.
    """
    n = len(symbols)
    transform = symbols[order - 1].astype(np.int64)
    counts = np.bincount(transform, minlength=257)
    below = np.r_[0, np.cumsum(counts)]
    step = np.empty(n, np.int64)   # the suffix one symbol longer, as far as intervals go
    step[np.argsort(transform.astype(np.int16), kind="stable")] = np.arange(n)
    borders = np.zeros(n + 1, bool)
    borders[0] = borders[n] = True
    present = np.flatnonzero(counts)
    low, high = below[present], below[present + 1]   # high is exclusive
    for _ in range(length):
        fresh = ~borders[high]
        low, high = low[fresh], high[fresh]
        borders[high] = True
        size = high - low
        total = int(size.sum())
        if not total:
            break
        owner = np.repeat(np.arange(len(low)), size)
        at = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + low[owner]
        # For one symbol the steps of an interval lie next to each other.
        key = np.sort((owner * 257 + transform[at]) << 32 | step[at])
        new = np.ones(total, bool)
        new[1:] = (key[1:] >> 32) != (key[:-1] >> 32)
        heads = np.flatnonzero(new)
        low = key[heads] & 0xFFFFFFFF
        high = low + np.diff(np.r_[heads, total])
    return borders


def _repeated_windows(d, place, n, flat, offsets, length):
    """Windows of the runs that also start earlier, as (d, place, n) rows."""
    sizes = np.diff(offsets)
    runs = len(n)
    symbols = np.zeros(len(flat) + runs, np.int64)   # 0 behind each run
    at = np.arange(len(flat)) + np.repeat(np.arange(runs), sizes)
    symbols[at] = flat.astype(np.int64) + 1
    head = offsets[:-1] + np.arange(runs)
    order = suffix_order(symbols, length)
    borders = marked_borders(symbols, order, length)
    owner = np.repeat(np.arange(runs), n)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    window = np.full(len(symbols), -1, np.int64)
    window[head[owner] + within] = np.arange(len(owner))
    group = np.cumsum(borders[:-1])
    found = window[order]
    group, found = group[found >= 0], found[found >= 0]
    often = np.bincount(group)[group] > 1
    group, found = group[often], found[often]
    doc, start = d[owner[found]], (place >> 32)[owner[found]] + within[found]
    by = np.lexsort((start, doc, group))
    group, found, doc, start = group[by], found[by], doc[by], start[by]
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = (doc != doc[first]) | (start != start[first])
    tag = ((place >> 8) & 0xFFFFFF)[owner[found[later]]]
    doc, tag, start, count = _merged(doc[later], tag, start[later],
                                     np.ones(int(later.sum()), np.int64))
    return doc, _place(start, tag << 8), count


def _blocks(runs: DataFrame, length: int) -> DataFrame:
    """d, place, n of repeated windows, from blocks that hold whole anchors."""
    ready = runs.repartition("ah").sortWithinPartitions("ah")

    def solve(parts):
        whole = pa.Table.from_batches(parts).combine_chunks()
        flat, offsets = text_buffer(whole["bytes"])
        rows = _repeated_windows(*(whole[c].to_numpy() for c in ("d", "place", "n")),
                                 flat, offsets, length)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows],
                                          names=["d", "place", "n"])

    def run(batches):
        parts, size = [], 0
        for b in slices(batches, 4, BLOCK_BYTES):
            if size > BLOCK_BYTES:
                ah = b.column(0).to_numpy()
                same = int(np.searchsorted(ah != parts[-1].column(0)[-1].as_py(), True))
                if same < b.num_rows:
                    if same:
                        parts.append(b.slice(0, same))
                    yield solve(parts)
                    parts, size, b = [], 0, b.slice(same)
            parts.append(b)
            size += int(pa.compute.sum(pa.compute.binary_length(b.column(4))).as_py() or 0)
        if parts:
            yield solve(parts)

    return ready.mapInArrow(tidy(run), "d long, place long, n long")


# --- the operator ---------------------------------------------------------------

def _keyed(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({
        "d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
        "tag": F.xxhash64(body).bitwiseAND(0xFFFFFF)}).withColumn("text", body)


def repeated_ranges(texts: DataFrame, length: int = LENGTH, piece: int = PIECE,
                    max_group: int = MAX_GROUP, size: int | None = None) -> DataFrame:
    """d, tag and the ranges (start, n) of windows that also start earlier.

    ``texts`` has d, tag and text; ``size``: about its bytes, if known.
    """
    if not 0 < piece < length < 120 + piece:
        raise ValueError("a run must have less than 256 windows, an anchor fit a window")
    texts = texts.select("d", "tag", "text")
    found = store(_walk(_run_rows(texts, length, piece)), size)
    known = [found.where("kind = 1").select("d", "place", "n")]
    runs = store(_gather(found, texts, length), size)
    for width in WIDTHS:
        sizes = runs.groupBy("ah").agg(F.count(F.lit(1)).alias("c"))
        hot = store(sizes.where(F.col("c") > max_group).select("ah"), stored_bytes(found))
        if hot.isEmpty():
            break
        known.append(_blocks(runs.join(hot, "ah", "left_anti"), length))
        narrow = store(_walk(_narrower(runs.join(hot, "ah", "left_semi"), width, length, piece),
                             payload=True), size)
        known.append(narrow.where("kind = 1").select("d", "place", "n"))
        runs = narrow.where("kind = 2").select("ah", "d", "place", "n", "bytes")
    known.append(_blocks(runs, length))
    whole = known[0]
    for more in known[1:]:
        whole = whole.unionByName(more)
    return (whole.groupBy("d", F.expr("shiftright(place, 8) & 16777215").alias("tag"))
            .agg(F.collect_list(F.struct(F.shiftright("place", 32).alias("start"), "n"))
                 .alias("ranges")))


def _covered(size: int, ranges, length: int) -> np.ndarray:
    """True where a byte lies in a repeated window."""
    if ranges is None or not len(ranges):
        return np.zeros(size, bool)
    start, n = (x.to_numpy() for x in ranges.flatten())
    turns = np.zeros(size + 1, np.int64)
    np.add.at(turns, start, 1)
    np.add.at(turns, start + n + length - 1, -1)
    return np.cumsum(turns[:-1]) > 0


def _whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` without characters of which a byte stays."""
    head = (raw & 0xC0) != 0x80
    char = np.cumsum(head) - 1
    kept = np.zeros(int(char[-1]) + 1, bool) if len(raw) else np.zeros(0, bool)
    kept[char[~gone]] = True
    return ~kept[char]


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep=("doc_id",),
                   text: str = "text", cut_text: bool = False,
                   max_group: int = MAX_GROUP) -> DataFrame:
    """n_bytes, n_removed, n_spans and kept_sha256 of every row, beside ``keep``.

    Texts are UTF-8 bytes; NULL is empty. A row without doc_id comes before all others.
    Rows with the same doc_id are one document: equal starts are not earlier than each
    other, so repeated rows have equal results. With ``cut_text`` the column cut_text
    holds what is left, characters kept whole. An empty table gives an empty result.
    """
    keep = list(keep)
    names = [f"k{i}" for i in range(len(keep))]
    texts = _keyed(docs.select("doc_id", text, *[F.col(c).alias(n) for c, n in
                                                 zip(keep, names)]), text)
    size = text_bytes(docs, text)
    ranges = repeated_ranges(texts, length, max_group=max_group, size=size)
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    k = len(keep)

    def run(batches):
        for b in slices(batches, k):
            out = []
            for i, raw in enumerate(encoded(b.column(k))):
                held = b.column(k + 1)[i]
                gone = _covered(len(raw), held.values if held.is_valid else None, length)
                flat = np.frombuffer(raw, np.uint8)
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(raw) else 0
                row = (len(raw), int(gone.sum()), spans,
                       hashlib.sha256(flat[~gone].tobytes()).hexdigest())
                if cut_text:
                    row += (flat[~_whole_characters(flat, gone)].tobytes().decode()
                            if spans else raw.decode(),)
                out.append(row)
            columns = zip(*out)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(k)]
                + [pa.array(c, t) for c, t in zip(columns, types)],
                names=keep + ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
                + (["cut_text"] if cut_text else []))

    cut = (texts.join(ranges, ["d", "tag"], "left").select(*names, "text", "ranges")
           .mapInArrow(tidy(run), kinds + "n_bytes long, n_removed long, n_spans long, "
                       "kept_sha256 string" + (", cut_text string" if cut_text else "")))
    return spread(cut, size)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
