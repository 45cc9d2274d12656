"""N-gram Jaccard join by parity sketches.

Shingles are dealt to parts by their hash, and each part holds the XOR of the hashes it got: a
shingle that only one of two sets has changes one part, so sets that differ in D shingles
differ in at most D parts. In a size band a sketch has 2 (D + 1) parts, D being the most that
linked sets can differ in when the smaller one is of this band. A set of known size can differ
in d <= D only, so a linked one has all but d of its parts. In any fixed order of all parts, the
first d + 1 of both must then meet (pigeonhole with a prefix): the order takes parts with many
shingles first, since they say most. Such parts are the keys
that meet in a shuffle. A candidate pair must have sizes that can link, and bit sketches
(every shingle flips one of ``BITS`` bits) of a Hamming distance of at most D, since that
bounds the symmetric difference from below; then it is verified on the sets themselves.

Equal sets are one class from the start. Where a key has many classes, they are first
compared with the smallest one only; what is connected then needs no more comparison among
itself. Only keys that several components still share go on, and only pairs across components
that sizes and bit sketches allow leave the join, each at the first key it has in common. So
connected sets cost their number, not its square; sets of different components that share a
key are compared by sketch inside the join. No link between different components is missed.
"""

from bisect import bisect_right
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparklode.llm.common import (
    drop, mix, slices, spread, store, stored_bytes, table, text_buffer, text_bytes, tidy)
from sparklode.llm.components import connected_components
from sparklode.llm.shingles import shingle_sets

BAND = 2.0   # ratio of the largest to the smallest size of a band
BITS, EARLY = 1024, 32
SLICE = 1 << 20   # bytes of text hashed at once
# Representatives of candidates are sent to the texts up to this size, else both are shuffled.
BROADCAST_BYTES = 16 << 20


class Bands:
    """Size bands, and the keys of a set in each band where it may meet a partner."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("the threshold must lie between 50 and 100 percent")
        self.percent, self.starts = percent, [1]

    def band(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * BAND)))
        return bisect_right(self.starts, size) - 1

    def differ(self, band: int) -> int:
        """In how many shingles linked sets may differ, the smaller one being of this band."""
        return (self.starts[band + 1] - 1) * (100 - self.percent) // self.percent

    def bands(self, size: int):
        """Bands of the smallest partner up to the own one, without those of equal sets."""
        last = self.band(size)
        first = self.band(-(-size * self.percent // 100))
        return [b for b in range(first, last + 1) if self.differ(b)]

    def own(self, size: int, band: int) -> int:
        """In how many shingles a set of this size may differ from linked ones of the band."""
        if band == self.band(size):   # the partner may be larger, too
            return size * (100 - self.percent) // self.percent
        largest = self.starts[band + 1] - 1
        return (100 - self.percent) * (size + largest) // (100 + self.percent)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """The first d + 1 parts of each band in the order of (shingles, hash)."""
        found = []
        for band in self.bands(len(hashes)):
            most, parts = self.own(len(hashes), band) + 1, 2 * self.differ(band) + 2
            if most == 1:   # only equal sets
                continue
            part = ((hashes >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
            sketch = np.zeros(parts, np.uint64)
            np.bitwise_xor.at(sketch, part, hashes)
            place = np.arange(parts, dtype=np.uint64) + np.uint64(band << 40)
            marks = mix(sketch + mix(place + np.uint64(1)))
            count = np.bincount(part, minlength=parts)
            found.append(marks[np.lexsort((marks, -count))[:most]])
        return np.concatenate(found) if found else np.zeros(0, np.uint64)


def bit_sketch(hashes: np.ndarray) -> np.ndarray:
    """BITS parities as 64-bit words."""
    odd = np.bincount((hashes & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _features(docs: DataFrame, words: int, percent: int, text: str) -> DataFrame:
    """doc_id, tag, n_shingles, set_id (NULL for the empty set), keys, sketch, row number.

    Within a slice only the first of equal sets carries keys and sketch.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bands = Bands(percent)
        for b in slices(batches, 2, SLICE):
            sets = shingle_sets(*text_buffer(b.column(2)), words)
            ids = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                   for s in sets]
            seen, keys, sketches = set(), [], []
            for i, s in zip(ids, sets):
                fresh = i is not None and i not in seen
                keys.append(bands.keys(s).view(np.int64) if fresh else None)
                sketches.append(bit_sketch(s) if fresh else None)
                seen.add(i)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "tag", "n_shingles", "set_id", "keys", "sketch"])

    return docs.select("doc_id", F.xxhash64(text).alias("tag"), text).mapInArrow(
        tidy(run), f"doc_id {kind}, tag long, n_shingles long, set_id binary, keys array<long>, "
             "sketch array<long>").withColumn("row", F.monotonically_increasing_id())


def _sets_of(nodes: DataFrame, docs: DataFrame, words: int, text: str) -> DataFrame:
    """node and its sorted hashes, from the text of one document of the class."""
    def run(batches):
        for b in slices(batches, 2, SLICE):
            sets = [s.tobytes() for s in shingle_sets(*text_buffer(b.column(2)), words)]
            want = b.column(1).to_pylist()
            same = [blake2b(s, digest_size=16).digest() == w for s, w in zip(sets, want)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sets, pa.binary())],
                names=["node", "hashes"]).filter(pa.array(same, pa.bool_()))

    if stored_bytes(nodes) <= BROADCAST_BYTES:
        nodes = F.broadcast(nodes)
    # A row without an id can stand for its class too, so the join takes NULL as equal.
    texts = (docs.select(F.col("doc_id").alias("id"), F.col(text).alias("t"))
             .join(nodes, F.col("id").eqNullSafe(F.col("doc_id"))))
    return (texts.select("node", "set_id", "t").mapInArrow(tidy(run), "node long, hashes binary")
            .dropDuplicates(["node"]))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets meet the threshold."""
    def run(batches):
        for b in batches:
            left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
            keep = []
            for x, y in zip(left, right):
                shared = len(np.intersect1d(np.frombuffer(x, np.uint64),
                                            np.frombuffer(y, np.uint64), True))
                union = (len(x) + len(y)) // 8 - shared
                keep.append(100 * shared >= percent * union)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
            .select("a", "b", "x", "y"))
    return store(both.mapInArrow(tidy(run), "a long, b long"), stored_bytes(pairs))


def _can_link(percent: int) -> str:
    """Whether sizes n_a, n_b and bit sketches sketch_a, sketch_b allow a link.

    A similarity of p percent or more is the same as a symmetric difference of at most
    (100 - p) / (100 + p) of both sizes together, which the sketches bound from below.
    """
    return (f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) AND {100 + percent} * "
            "aggregate(zip_with(sketch_a, sketch_b, (x, y) -> bit_count(x ^ y)), 0, "
            f"(t, x) -> t + x) <= {100 - percent} * (n_a + n_b)")


def _placed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))


def _open_keys(members: DataFrame, labels: DataFrame, facts: DataFrame) -> DataFrame:
    """key, node, n, sketch and early of the keys that several components still share.

    ``early``: up to EARLY smaller keys of the node; two nodes that share one of them are
    a pair there already.
    """
    size = stored_bytes(members)
    placed = store(_placed(members.select("key", "node", "n"), labels), size)
    several = placed.groupBy("key").agg(F.min("component").alias("x"),
                                        F.max("component").alias("y")).where("x < y")
    shared = store(placed.join(several.select("key"), "key", "left_semi")
                   .select("key", "node", "n"), size)
    drop(placed)
    first = shared.groupBy("node").agg(   # no more keys than the set has shingles
        F.slice(F.array_sort(F.collect_list("key")), 1, EARLY).alias("first"))
    keys = shared.join(first, "node").join(facts.select("node", "sketch"), "node")
    found = store(keys.select("key", "node", "n", "sketch", F.filter(
        "first", lambda x: x < F.col("key")).alias("early")), 4 * size)
    drop(shared)
    return found


def _across(shared: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of one key in different components."""
    placed = _placed(shared, labels)
    per = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = per.groupBy("key").agg(F.max_by("component", F.struct("c", "component"))
                                   .alias("main"), F.count(F.lit(1)).alias("k"))
    mixed = store(placed.join(mixed.where("k > 1").drop("k"), "key"),
                  stored_bytes(shared))
    facts = ("node", "n", "component", "sketch", "early")
    one = mixed.select("key", "main", *[F.col(c).alias(f"{c}_a") for c in facts])
    two = mixed.where("component != main").select(
        "key", *[F.col(c).alias(f"{c}_b") for c in facts])

    def pairs(left, different):
        return left.join(two, (left["key"] == two["key"]) & F.expr(_can_link(percent))
                         & ~F.arrays_overlap("early_a", "early_b") & different).select(
            F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))

    return pairs(one.where("component_a = main"), F.lit(True)).unionByName(
        pairs(one.where("component_a != main"), F.expr("component_a < component_b"))).distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links."""
    ends = links
    for end in ("a", "b"):
        ends = _placed(ends.withColumnRenamed(end, "node"), labels).drop("node") \
            .withColumnRenamed("component", end)
    return store(connected_components(labels.select(
        F.col("node").alias("a"), F.col("component").alias("b")).unionByName(
            ends.select("a", "b")), size=stored_bytes(labels)), stored_bytes(labels))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80,
                    text: str = "text", size: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, tag and group_id of every row.

    Sets of distinct ``words``-word shingles of the lower-cased text link at a Jaccard
    similarity of ``percent`` or more; component_id is the smallest doc_id reachable. NULL
    and texts without words are empty sets and link with nothing. Repeated rows are equal
    sets. ``tag`` is xxhash64 of the text, ``group_id`` numbers the components (NULL for empty
    sets). A NULL doc_id is never the smallest one while there is another. Other columns are
    not read; an empty table gives an empty result. ``size``: about the bytes of the texts, if
    known.
    """
    wide = store(_features(docs, words, percent, text), size)
    hashed = stored_bytes(wide)
    rows = store(wide.drop("keys"), hashed)
    # A class is named by the first of its rows that carry keys; the others' keys are not read.
    classes = store(rows.where("set_id IS NOT NULL").groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"),
        F.min(F.when(F.isnotnull("sketch"), F.col("row"))).alias("node")), stored_bytes(rows))
    facts = rows.where("sketch IS NOT NULL").select(
        F.col("row").alias("node"), F.col("n_shingles").alias("n"), "sketch", "set_id")
    again = store(facts.select("set_id", F.col("node").alias("row")).join(
        classes.select("set_id", "node"), "set_id").where("row != node").select("row"),
        stored_bytes(classes))
    facts = facts.drop("set_id")
    keyed = wide.where("keys IS NOT NULL").join(again, "row", "left_anti").select(
        F.explode("keys").alias("key"), F.col("row").alias("node"),
        F.col("n_shingles").alias("n"))
    shared = store(keyed.groupBy("key").agg(
        F.min("node").alias("low"), F.max("node").alias("high"),
        F.count(F.lit(1)).alias("c")).where("low < high"), hashed)
    members = store(keyed.join(shared.where("c > 2").select("key", "low"), "key"),
                    hashed)
    held = stored_bytes(shared) + stored_bytes(members)
    for done in (wide, again):
        drop(done)
    stars = members.where("node != low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    pairs = (shared.where("c = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
             .unionByName(stars).distinct())
    pairs = store(_possible(pairs, facts, percent), held)
    # Members of large keys may be compared again, so their sets are wanted too.
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(
        members.select("node")).distinct()
    nodes = store(nodes.join(classes.select("node", "doc_id", "set_id"), "node"),
                  stored_bytes(classes))
    sets = store(_sets_of(nodes, docs, words, text), hashed)
    links = _verified(pairs, sets, percent)
    labels = store(connected_components(links, size=stored_bytes(links)), stored_bytes(links))
    opened = _open_keys(members, labels, facts)
    more = store(_across(opened, labels, percent), stored_bytes(opened))
    labels = _merged(labels, _verified(more, sets, percent))

    known = classes.select("set_id", "node", F.col("doc_id").alias("first")).join(
        labels, "node", "left")
    smallest = known.where("component IS NOT NULL").groupBy("component").agg(
        F.min("first").alias("smallest"))
    final = store(known.join(smallest, "component", "left").select(
        "set_id", F.coalesce("component", "node").alias("group_id"),
        F.coalesce("smallest", "first").alias("component_id")), stored_bytes(classes))
    for done in (members, shared, classes, sets, pairs, opened):
        drop(done)
    return (rows.select("doc_id", "tag", "n_shingles", "set_id").join(final, "set_id", "left")
            .select("doc_id", "n_shingles",
                    F.coalesce("component_id", "doc_id").alias("component_id"),
                    "tag", "group_id"))


def one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each component, the one of smallest id.

    A row without doc_id stays only if its component has none with one. Rows with equal id
    and text are one document. Texts without words stay.
    """
    size = text_bytes(docs)
    found = near_duplicates(docs, words, percent, size=size)
    low = F.lit(-(1 << 63))
    chosen = (found.where("group_id IS NOT NULL").groupBy("group_id")
              .agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "tag")).alias("r"))
              .select("r.doc_id", "r.tag")
              .unionByName(found.where("group_id IS NULL").select("doc_id", "tag"))
              .select(F.coalesce("doc_id", low).alias("__id"), F.col("tag").alias("__tag")))
    keyed = docs.select("*", F.coalesce("doc_id", low).alias("__id"),
                        F.xxhash64("text").alias("__tag"))
    return spread(keyed.join(chosen.distinct(), ["__id", "__tag"], "left_semi")
                  .dropDuplicates(["__id", "__tag"]).select(*docs.columns), size)


def _possible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and bit sketches allow a link."""
    return (pairs.join(facts.select(*[F.col(c).alias(x) for c, x in zip(
                facts.columns, ("a", "n_a", "sketch_a"))]), "a")
            .join(facts.select(*[F.col(c).alias(x) for c, x in zip(
                facts.columns, ("b", "n_b", "sketch_b"))]), "b")
            .where(_can_link(percent)).select("a", "b"))


def op10_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90).select(
        "doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
    ELSE list_transform(range(len(w) - 2), lambda i: w[i + 1:i + 3]) END) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * i >= 90 * (x.n + y.n - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM docs
  UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id
FROM docs d JOIN reach r USING (doc_id) LEFT JOIN sizes s USING (doc_id) GROUP BY d.doc_id
"""
