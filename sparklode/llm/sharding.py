"""Sharding by a k-d tree with distributed weighted medians.

Rows are points: language, source, size and doc_id, each scaled to the same width. A node
with k leaves is split along its widest dimension into halves of k // 2 and k - k // 2
leaves, at the key below which that share of its bytes lies. The keys order the rows of a
dimension completely (coordinate, text checksum, row), so even a value that all rows share
can be split. Rows of one coordinate and equal text stay together but for the border; copies
with other ids, languages or sources may part, as these come before the checksum.
Of language and source only the first 6 bytes count so far. The border is found by
refining histograms of ``BITS`` bits; only these, at most 2^BITS sums per node, reach the
driver. The tree is applied as one expression, so documents are not shuffled.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparklode.llm.common import octets, store, table

BITS, KEY_BITS, COORDINATE_BITS = 12, 60, 20
# A border is exact enough when at most this share of a leaf hangs on it.
SLACK = 0.0005
SLOT_GROUP = 50_000


def _text_number(name: str) -> Column:
    """A number that orders strings by their first bytes."""
    padded = F.rpad(F.substring(F.hex(F.coalesce(F.col(name).cast("string"), F.lit(""))), 1, 12),
                    12, "0")
    return F.conv(padded, 16, 10).cast("double")


def points(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row and one key per dimension, stored without texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    raw = store(docs.select(
        "doc_id", (octets(text) + 8).alias("size"), F.crc32(body).alias("text_crc32"),
        _text_number("lang").alias("lang"), _text_number("source").alias("source"),
        F.log2(octets(text) + 8.0).alias("bytes"),
        F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)).alias("id"))
        .withColumn("row", F.monotonically_increasing_id()))
    dims = ["lang", "source", "bytes", "id"]
    ends = raw.agg(*[f(d).alias(f"{f.__name__}_{d}") for d in dims
                     for f in (F.min, F.max)]).first()
    top = (1 << COORDINATE_BITS) - 1
    tail = (F.shiftright("text_crc32", 12).bitwiseAND(0xFFFFF) * (1 << 20)
            + F.xxhash64("row").bitwiseAND(0xFFFFF))
    keys = []
    for d in dims:
        low, high = ends[f"min_{d}"] or 0.0, ends[f"max_{d}"] or 0.0
        scaled = (F.col(d) - low) / (high - low) * top if high > low else F.lit(0)
        keys.append((F.floor(scaled).cast("long") * (1 << 40) + tail).alias(f"key_{d}"))
    return raw.select("doc_id", "size", "text_crc32", "row", *keys)


class Node:
    """Leaves first to first + leaves - 1; a split node has a key column and a border."""

    def __init__(self, first: int, leaves: int):
        self.first, self.leaves = first, leaves
        self.key = self.border = self.low = self.high = None

    def split(self, key: str, border: int):
        self.key, self.border = key, border
        self.low = Node(self.first, self.leaves // 2)
        self.high = Node(self.first + self.leaves // 2, self.leaves - self.leaves // 2)

    def expression(self) -> Column:
        """First leaf of the node that a row has come to."""
        if self.key is None:
            return F.lit(self.first)
        return F.when(F.col(self.key) < self.border, self.low.expression()).otherwise(
            self.high.expression())

    def open(self) -> list["Node"]:
        if self.key is None:
            return [self] if self.leaves > 1 else []
        return self.low.open() + self.high.open()


def _borders(rows: DataFrame, nodes: dict, keys: dict, leaf: float) -> dict:
    """Per open node the key below which its lower share of the bytes lies."""
    state = {n: (0, 0.0, None) for n in nodes}   # prefix, bytes below it, bytes wanted
    done: dict[int, int] = {}
    chosen = F.coalesce(*[F.when(F.col("node") == n, F.col(k)) for n, k in keys.items()])
    rows = rows.withColumn("key", chosen)
    for used in range(0, KEY_BITS, BITS):
        left = KEY_BITS - used
        alive = F.lit(False)
        for n, (prefix, _, _) in state.items():
            alive = alive | ((F.col("node") == n) & (F.shiftright("key", left) == prefix))
        sums = (rows.where(alive)
                .groupBy("node", F.shiftright("key", left - BITS).alias("bucket"))
                .agg(F.sum("size").alias("size")).collect())
        per: dict[int, list] = {}
        for r in sums:
            per.setdefault(r.node, []).append((r.bucket, r["size"]))
        for n in list(state):
            prefix, below, wanted = state[n]
            buckets = sorted(per.get(n, []))
            if wanted is None:
                k = nodes[n].leaves
                wanted = sum(s for _, s in buckets) * (k // 2) / k
            for bucket, size in buckets:
                if below + size >= wanted:
                    break
                below += size
            else:
                bucket, size = prefix << BITS, 0
            low = bucket << (left - BITS)
            if size <= SLACK * leaf or left == BITS:
                # The nearer end of the last bucket.
                done[n] = low if wanted - below <= below + size - wanted else (
                    (bucket + 1) << (left - BITS))
                del state[n]
            else:
                state[n] = bucket, below, wanted
        if not state:
            break
    return done


def build_tree(rows: DataFrame, shards: int) -> Node:
    keys = [c for c in rows.columns if c.startswith("key_")]
    root = Node(0, shards)
    total = rows.agg(F.sum("size")).first()[0] or 0
    while root.open():
        nodes = {n.first: n for n in root.open()}
        at = rows.withColumn("node", root.expression()).where(F.col("node").isin(list(nodes)))
        width = [(F.max(F.shiftright(c, 40)) - F.min(F.shiftright(c, 40))).alias(c)
                 for c in keys]
        widest = {}
        for r in at.groupBy("node").agg(*width).collect():
            widest[r.node] = max(keys, key=lambda c: r[c])
        for n in nodes:   # an empty node is split anywhere
            widest.setdefault(n, keys[0])
        borders = _borders(at, nodes, widest, total / shards)
        for n, node in nodes.items():
            node.split(widest[n], borders.get(n, 0))
    return root


def shard_documents(docs: DataFrame, shards: int | None = None,
                    target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    Either the number of shards or the bytes that a leaf may reach is given. A size is the
    UTF-8 bytes of the text (NULL: none) plus 8. Shards are of nearly equal bytes; slots
    count the rows of a shard without gaps from 0. NULL language, source or id are values
    like others, repeated rows stay, an empty table gives an empty result.
    """
    rows = store(points(docs))
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    tree = build_tree(rows, shards)
    groups = max(8, -(-rows.count() // (shards * SLOT_GROUP)))
    placed = rows.select("doc_id", "size", "text_crc32", "row",
                         tree.expression().cast("int").alias("shard"),
                         F.pmod(F.xxhash64("row"), F.lit(groups)).alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part",
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    return (placed.withColumn("within", within).join(offsets, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("before") + F.col("within") - 1).cast("long").alias("slot")))


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
