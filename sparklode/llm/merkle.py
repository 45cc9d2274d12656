"""Merkle manifest of a dataset, by checkpoint and recompute.

Every row is a leaf. The leaves of a tree (one per language, say) ascend by their key, and while
several nodes of a level remain, each run of ``FANOUT`` consecutive ones becomes their hash. Only
every ``EVERY``-th level is stored, as groups of the FANOUT ** EVERY nodes below one stored
node (aligned subtrees). A proof needs the other levels too: the pass over the groups of a stored
level regenerates the missing nodes of each subtree from its stored descendants, emits the
siblings of every member, and keeps none of them. Passes go from the top down, and each hands
the finished upper part of a proof to the subtree below by one join per group, not per leaf.

Places in a tree come from one range shuffle of hashes by (tree, key) and the counts per
partition, so a tree that holds most rows spreads over many tasks, and so does a key with many
rows. The subroots of all trees, ordered by tree, are the leaves of a last tree in the same way.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparklode.llm.common import store, table

FANOUT, EVERY = 8, 2
WIDTH = FANOUT ** EVERY
NO_PATH = "CAST(array() AS array<struct<left:string,right:string>>)"


def digest(parts: list[Column]) -> Column:
    """Lowercase hex sha256 of the parts, each ``-`` if NULL, else UTF-8 bytes, ``:``, value."""
    told = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in parts]
    return F.sha2(F.concat(*[F.coalesce(F.concat(
        F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in told]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


@dataclass
class Forest:
    """Stored levels from the leaves up, and (tree, subroot) of every tree."""
    levels: list[DataFrame]
    roots: DataFrame


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """The nodes with ``pos``, their place in their tree, and ``n``, the nodes of the tree."""
    ordered = store(nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
                    .withColumn("at", F.monotonically_increasing_id())
                    .withColumn("part", F.shiftright("at", 33)))
    runs = ordered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("c"),
                                               F.min("at").alias("low"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = store(runs.select(
        F.col("tree").alias("of"), F.col("part").alias("in"), F.sum("c").over(whole).alias("n"),
        (F.col("low") - F.coalesce(F.sum("c").over(before), F.lit(0))).alias("zero")))
    return (ordered.join(starts, F.col("tree").eqNullSafe(F.col("of"))
                         & (F.col("part") == F.col("in")))
            .withColumn("pos", F.col("at") - F.col("zero"))
            .drop("of", "in", "zero", "at", "part"))


def _groups(nodes: DataFrame) -> DataFrame:
    """Aligned subtrees of (tree, pos, n, h, ...): their members in order.

    ``height`` is the number of levels that a subtree has above its members.
    """
    rest = [c for c in nodes.columns if c not in ("tree", "n", "pos")]
    height = sum((F.col("n") > FANOUT ** k).cast("int") for k in range(EVERY))
    return store(nodes.groupBy("tree", "n", F.floor(F.col("pos") / WIDTH).alias("subtree")).agg(
        F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("members"))
        .withColumn("height", height))


def _with_levels(groups: DataFrame) -> DataFrame:
    """Adds ``l0``, ``l1``, ...: the hashes of each level inside the subtrees."""
    out = groups.withColumn("l0", F.col("members.h"))
    for k in range(EVERY):
        out = out.withColumn(f"l{k + 1}", F.expr(
            f"CASE WHEN height > {k} THEN transform(sequence(0, (size(l{k}) - 1) div {FANOUT}), "
            f"i -> sha2(array_join(slice(l{k}, int(i) * {FANOUT} + 1, {FANOUT}), ''), 256)) "
            f"ELSE l{k} END"))
    return out


def _parents(groups: DataFrame) -> DataFrame:
    return _with_levels(groups).select(
        "tree", F.ceil(F.col("n") / WIDTH).alias("n"), F.col("subtree").alias("pos"),
        F.col(f"l{EVERY}")[0].alias("h"))


def build_forest(nodes: DataFrame, order: list[str]) -> Forest:
    """The trees of nodes (tree, h, ...) whose leaves ascend by ``order``."""
    levels, roots = [], []
    level = _groups(_placed(nodes, order))
    while True:
        levels.append(level)
        above = _parents(level)
        roots.append(above.where("n = 1").select("tree", "h"))
        above = above.where("n > 1")
        if above.isEmpty():
            break
        level = _groups(above)
    done = roots[0]
    for r in roots[1:]:
        done = done.unionByName(r)
    return Forest(levels, store(done))


def extract_paths(forest: Forest, tops: DataFrame) -> DataFrame:
    """Every leaf of the forest with ``path``, its siblings from the leaf up, level by level.

    ``tops`` has for each tree the path (top) above its subroot, and columns that its leaves
    get too. An entry of a path is (left, right): the hashes before and after the node in its
    run, joined.
    """
    more = [c for c in tops.columns if c not in ("tree", "top")]
    entries = []
    for k in range(EVERY):
        run, place = f"i div {FANOUT ** (k + 1)} * {FANOUT}", f"i div {FANOUT ** k}"
        entries.append(
            f"CASE WHEN height > {k} THEN named_struct("
            f"'left', array_join(slice(l{k}, int({run} + 1), int({place} - {run})), ''), 'right', "
            f"array_join(slice(l{k}, int({place} + 2), int({run} + {FANOUT - 1} - {place})), '')) "
            "END")
    path = F.expr(f"concat(filter(array({', '.join(entries)}), s -> s IS NOT NULL), top)")
    found = None
    for level in reversed(forest.levels):
        heads = tops.withColumnRenamed("tree", "of")
        above = (level.where(F.col("n") <= WIDTH).select("tree", "subtree")
                 .join(heads, F.col("tree").eqNullSafe(F.col("of"))).drop("of"))
        above = above.unionByName(found) if found is not None else above
        above = above.withColumnsRenamed({"tree": "of", "subtree": "in"})
        members = (_with_levels(level)
                   .join(above, F.col("tree").eqNullSafe(F.col("of"))
                         & (F.col("subtree") == F.col("in")))
                   .select("tree", "n", "height", "top", *more, *[f"l{k}" for k in range(EVERY)],
                           F.posexplode("members").alias("i", "m")))
        if level is not forest.levels[0]:
            found = store(members.select("tree", F.col("m.pos").alias("subtree"), *more,
                                         path.alias("top")))
    return members.select("tree", "n", "m.*", *more, path.alias("path"))


def prove_rows(leaves: DataFrame) -> DataFrame:
    """Leaves (tree, key, h, ...) with pos, n, subroot, root and path, the proof of each.

    The leaves of a tree ascend by key (NULL first), equal keys by hash; equal leaves are
    interchangeable, and each has its own place. Subroots ascend by tree, NULL first. A tree of
    one leaf has that leaf as its subroot, and a lone subroot is the root. NULL trees are one
    tree. No leaves give no rows.
    """
    forest = build_forest(store(leaves.withColumn("tie", F.monotonically_increasing_id())),
                          ["key", "h", "tie"])
    crown = build_forest(forest.roots.select(
        F.lit(0).alias("tree"), F.col("tree").alias("key"), "h"), ["key"])
    tops = store(extract_paths(crown, crown.roots.select(
        "tree", F.col("h").alias("root"), F.expr(NO_PATH).alias("top"))).select(
        F.col("key").alias("tree"), F.col("h").alias("subroot"), "root",
        F.col("path").alias("top")))
    return extract_paths(forest, tops).drop("tie")


def document_leaf(text: str | Column = "text") -> Column:
    """The leaf of a row of documents, of another text if given."""
    return digest(["doc_id", "source", "lang", "n_chars", text])


def prove_documents(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path, pos and n of every document, a tree per language.

    ``claimed`` (default: the leaf itself) comes along, to be verified by
    ``fold(claimed, path) == root``. NULL fields are hashed as ``-``; texts are hashed whole and
    never shuffled; documents of equal id in one language have a place each. Columns other
    than those of documents are not read.
    """
    leaf = document_leaf()
    rows = docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("key"),
                       leaf.alias("h"), (leaf if claimed is None else claimed).alias("claimed"))
    return prove_rows(rows).withColumnsRenamed({"key": "doc_id", "h": "leaf", "tree": "lang"})


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    claimed = F.when(tampered, document_leaf(F.translate("text", upper, upper.lower())))
    proofs = prove_documents(table(spark, sf_dir, "documents"), claimed)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        fold(F.coalesce("claimed", "leaf"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


# crc32 of a decimal number: its digits, each followed by eight shifts.
CRC32_SQL = """xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i:
    ascii(substr({0}, i, 1))::BIGINT), lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0,
    0, 0]::BIGINT[], lambda x, k: xor(x >> 1, 3988292384 * (x & 1))), 4294967295::BIGINT),
    4294967295)"""

LEAF_SQL = """sha256(list_reduce(list_transform([id, source, lang, n_chars::VARCHAR, {0}],
    lambda x: coalesce(strlen(x)::VARCHAR || ':' || x, '-')), lambda a, b: a || b))"""

OP11_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT *, @CRC@ % 3 = 0 AS odd, row_number() OVER () AS row_id FROM (
    SELECT *, doc_id::VARCHAR AS id FROM documents)),
leaves AS (
  SELECT row_id, doc_id, lang, @LEAF@ AS h, CASE WHEN odd THEN @LOWER@ ELSE @LEAF@ END AS claimed
  FROM docs),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, h) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, pos, n, h FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 8),
subroots AS (SELECT lang, level AS height, h AS subroot FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos,
    count(*) OVER () AS n, subroot AS h, lang FROM subroots),
crown AS (
  SELECT level, pos, n, h FROM tops
  UNION ALL
  SELECT level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos))
  FROM crown WHERE n > 1 GROUP BY level, pos // 8),
steps AS (
  SELECT p.row_id, x.level AS step, coalesce(string_agg(x.h, '' ORDER BY x.pos)
      FILTER (x.pos < p.pos // (8 ** x.level)::BIGINT), '') AS before,
    coalesce(string_agg(x.h, '' ORDER BY x.pos)
      FILTER (x.pos > p.pos // (8 ** x.level)::BIGINT), '') AS after
  FROM placed p JOIN nodes x ON x.lang IS NOT DISTINCT FROM p.lang AND x.n > 1
    AND x.pos // 8 = p.pos // (8 ** (x.level + 1))::BIGINT
  GROUP BY p.row_id, x.level
  UNION ALL
  SELECT p.row_id, s.height + x.level, coalesce(string_agg(x.h, '' ORDER BY x.pos)
      FILTER (x.pos < t.pos // (8 ** x.level)::BIGINT), ''),
    coalesce(string_agg(x.h, '' ORDER BY x.pos)
      FILTER (x.pos > t.pos // (8 ** x.level)::BIGINT), '')
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
    JOIN tops t ON t.lang IS NOT DISTINCT FROM p.lang JOIN crown x ON x.n > 1
    AND x.pos // 8 = t.pos // (8 ** (x.level + 1))::BIGINT
  GROUP BY p.row_id, s.height, x.level),
folded AS (
  SELECT row_id, 0 AS step, claimed AS h FROM placed
  UNION ALL
  SELECT f.row_id, f.step + 1, sha256(s.before || f.h || s.after)
  FROM folded f JOIN steps s ON s.row_id = f.row_id AND s.step = f.step),
ends AS (SELECT row_id, max_by(h, step) AS folded_root FROM folded GROUP BY row_id),
proofs AS (
  SELECT row_id, string_agg(before || after, '' ORDER BY step) AS siblings
  FROM steps GROUP BY row_id)
SELECT p.doc_id, p.h AS leaf, s.subroot, c.h AS root,
  sha256(coalesce(q.siblings, '')) AS proof_sha256, e.folded_root,
  e.folded_root = c.h AS verified
FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN ends e USING (row_id)
  LEFT JOIN proofs q USING (row_id) CROSS JOIN (SELECT h FROM crown WHERE n = 1) c
""".replace("@CRC@", CRC32_SQL.format("id")).replace("@LEAF@", LEAF_SQL.format("text")).replace(
    "@LOWER@", LEAF_SQL.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                               "'abcdefghijklmnopqrstuvwxyz')"))
