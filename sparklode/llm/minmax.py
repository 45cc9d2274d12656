"""MinHash near-dedup with min-max hashing.

A permutation of the hash space is evaluated once per shingle, and both its smallest and its
largest value are kept: ``PERMUTATIONS`` evaluations give a signature of twice as many values.
Each of them agrees in two sets with the probability of their Jaccard similarity, so their share
of agreements is an unbiased estimate, and as both ends of one permutation seldom agree
together, its variance is a little lower than that of as many single minima. A band is
``ROWS`` values, half of them minima and half maxima, all of other permutations; bands are the
keys that meet in a shuffle. A pair of similarity s has no band in common with a probability of
(1 - s^4)^32: 6e-11 at 0.85, 5e-8 at 0.8. Four bits of each value make a sketch, and pairs
are compared only where sizes allow a link and the sketches lie no further apart than ``SIGMAS``
deviations above what the threshold lets expect (one in 10^11), and where a parity of the sets
does not rule the link out for certain. Links are confirmed on full sets.

Equal sets are one class from the start. Every class of a band is compared with the one that
shares most bands with others, which of a text and its copies is mostly the text; connected
classes need no more comparison among themselves. Bands that still join several components are
then compared across components, by sketch and parity inside the join, so a large group of
copies costs its number and not its square.
"""

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparklode.llm.common import drop, mix, slices, store, table, text_buffer
from sparklode.llm.components import connected_components
from sparklode.llm.parity_join import _merged, _placed, _sets_of, _verified, bit_sketch
from sparklode.llm.shingles import shingle_sets

PERMUTATIONS, ROWS, SIGMAS = 64, 4, 7
VALUES, SKETCH_BITS = 2 * PERMUTATIONS, 4
BANDS = VALUES // ROWS
FACTS = ("n", "sketch", "parity")   # of a class, to tell whether a link is possible
_SEEDS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS, _SHIFTS = _SEEDS[:PERMUTATIONS] | np.uint64(1), _SEEDS[PERMUTATIONS:]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row per set (none may be empty): all minima, then all maxima."""
    flat = np.concatenate(sets)
    heads = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), VALUES), np.uint64)
    for k in range(PERMUTATIONS):
        moved = flat * _FACTORS[k] + _SHIFTS[k]
        out[:, k] = np.minimum.reduceat(moved, heads)
        out[:, PERMUTATIONS + k] = np.maximum.reduceat(moved, heads)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A row of BANDS keys per signature; the maxima of a band are far from its minima."""
    half = ROWS // 2
    low = values[:, :PERMUTATIONS].reshape(len(values), BANDS, half)
    high = np.roll(values[:, PERMUTATIONS:].reshape(len(values), BANDS, half), BANDS // 2, 1)
    keys = np.arange(BANDS, dtype=np.uint64)[None, :] * np.ones((len(values), 1), np.uint64)
    for part in (*np.moveaxis(low, 2, 0), *np.moveaxis(high, 2, 0)):
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + part)
    return keys


def bit_sketches(values: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits of each value, as 64-bit words."""
    mixed = mix(values ^ _SEEDS)
    bits = [(mixed >> np.uint64(s)).astype(np.uint8) & 1 for s in range(SKETCH_BITS)]
    return np.packbits(np.concatenate(bits, 1), 1).view(np.int64)


def _can_link(percent: int) -> str:
    """Whether sizes n, sketches and parities of a and b allow a link.

    Of the bits of values that do not agree half differ; the number of values that do not is
    binomial. The Hamming distance of the parities never exceeds the symmetric difference.
    """
    def distance(column):
        return (f"aggregate(zip_with({column}_a, {column}_b, (x, y) -> bit_count(x ^ y)), 0, "
                "(t, x) -> t + x)")

    apart = 1 - percent / 100
    expected = VALUES * apart * SKETCH_BITS / 2
    deviation = (VALUES * apart * (SKETCH_BITS / 4 + SKETCH_BITS ** 2 / 4 * (1 - apart))) ** 0.5
    return (f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) "
            f"AND {100 + percent} * {distance('parity')} <= {100 - percent} * (n_a + n_b) "
            f"AND {distance('sketch')} <= {int(expected + SIGMAS * deviation)}")


def _features(docs: DataFrame, words: int, text: str) -> DataFrame:
    """doc_id, n_shingles, set_id (NULL for the empty set), keys, sketch and parity per row.

    Within a slice only the first of equal sets carries the last three.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in slices(batches, 1):
            sets = shingle_sets(*text_buffer(b.column(1)), words)
            ids = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                   for s in sets]
            fresh = {}
            for row, i in enumerate(ids):
                if i is not None:
                    fresh.setdefault(i, row)
            keys, sketches, parities = ([None] * len(sets) for _ in range(3))
            if fresh:
                values = signatures([sets[row] for row in fresh.values()])
                for row, k, s in zip(fresh.values(), band_keys(values).view(np.int64),
                                     bit_sketches(values)):
                    keys[row], sketches[row], parities[row] = k, s, bit_sketch(sets[row])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(sketches, pa.list_(pa.int64())),
                 pa.array(parities, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_id", "keys", "sketch", "parity"])

    return docs.select("doc_id", text).mapInArrow(
        run, f"doc_id {kind}, n_shingles long, set_id binary, keys array<long>, "
             "sketch array<long>, parity array<long>")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(end), *[
            F.col(c).alias(f"{c}_{end}") for c in FACTS]), end)
    return pairs.where(_can_link(percent)).select("a", "b")


def _across(members: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Possible pairs (a, b) of one band in different components.

    Of each band the largest component is compared with the others only.
    """
    placed = store(_placed(members.select("key", "node"), labels))
    per = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = per.groupBy("key").agg(F.max_by("component", F.struct("c", "component"))
                                   .alias("main"), F.count(F.lit(1)).alias("k"))
    opened = store(placed.join(mixed.where("k > 1").drop("k"), "key")
                   .join(classes.select("node", *FACTS), "node"))
    facts = ("node", "component", *FACTS)
    one = opened.select("key", "main", *[F.col(c).alias(f"{c}_a") for c in facts])
    two = opened.where("component != main").select(
        "key", *[F.col(c).alias(f"{c}_b") for c in facts])

    def pairs(left, different):
        return left.join(two, (left["key"] == two["key"]) & F.expr(_can_link(percent))
                         & different).select(F.least("node_a", "node_b").alias("a"),
                                             F.greatest("node_a", "node_b").alias("b"))

    found = store(pairs(one.where("component_a = main"), F.lit(True)).unionByName(
        pairs(one.where("component_a != main"), F.expr("component_a < component_b"))).distinct())
    drop(placed)
    drop(opened)
    return found


def minmax_duplicates(docs: DataFrame, words: int = 5, percent: int = 80,
                      text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Sets of distinct ``words``-word shingles of the lower-cased text link at a Jaccard
    similarity of ``percent`` or more; component_id is the smallest doc_id reachable, and kept
    says that a row has that id itself. NULL and texts without words are empty sets and link
    with nothing. Repeated rows are equal sets and share their id and verdict. A NULL doc_id is
    never the smallest one while there is another; if there is none, component_id is NULL and
    the row is kept. Whole texts are read; other columns are not; an empty table gives an empty
    result.
    """
    rows = store(_features(docs, words, text))
    classes = store(rows.where("set_id IS NOT NULL").groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"),
        F.first("keys", ignorenulls=True).alias("keys"),
        F.first("sketch", ignorenulls=True).alias("sketch"),
        F.first("parity", ignorenulls=True).alias("parity"))
        .withColumn("node", F.monotonically_increasing_id()))
    keyed = classes.select(F.explode("keys").alias("key"), "node")
    shared = store(keyed.groupBy("key").agg(
        F.min("node").alias("low"), F.max("node").alias("high"),
        F.count(F.lit(1)).alias("c")).where("low < high"))
    members = store(keyed.join(shared.where("c > 2").select("key", "c"), "key"))
    company = members.groupBy("node").agg(F.sum("c").alias("c"))
    centers = members.drop("c").join(company, "node").groupBy("key").agg(
        F.max_by("node", F.struct("c", "node")).alias("center"))
    stars = members.join(centers, "key").where("node != center").select(
        F.least("center", "node").alias("a"), F.greatest("center", "node").alias("b"))
    pairs = store(_possible(
        shared.where("c = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
        .unionByName(stars).distinct(), classes, percent))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(
        members.select("node")).distinct()
    nodes = store(nodes.join(classes.select("node", "doc_id", "set_id"), "node"))
    sets = store(_sets_of(nodes, docs, words, text))
    labels = store(connected_components(_verified(pairs, sets, percent)))
    more = _across(members, labels, classes, percent)
    labels = _merged(labels, _verified(more, sets, percent))

    known = classes.select("set_id", "node", F.col("doc_id").alias("first")).join(
        labels, "node", "left")
    smallest = known.where("component IS NOT NULL").groupBy("component").agg(
        F.min("first").alias("smallest"))
    final = store(known.join(smallest, "component", "left").select(
        "set_id", F.coalesce("smallest", "first").alias("component_id")))
    for done in (members, shared, classes, sets, pairs, more):
        drop(done)
    return (rows.select("doc_id", "n_shingles", "set_id").join(final, "set_id", "left")
            .select("doc_id", "n_shingles", F.when(F.isnull("set_id"), F.col("doc_id"))
                    .otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def op13_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_duplicates(table(spark, sf_dir, "documents"), words=5, percent=85)


OP13_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
    ELSE list_transform(range(len(w) - 4), lambda i: w[i + 1:i + 5]) END) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * i >= 85 * (x.n + y.n - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM docs
  UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id,
  d.doc_id = min(r.other) AS kept
FROM docs d JOIN reach r USING (doc_id) LEFT JOIN sizes s USING (doc_id) GROUP BY d.doc_id
"""
