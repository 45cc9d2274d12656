"""Connected components of a links table by alternating stars, all in shuffles."""

from pyspark.sql import DataFrame, functions as F

from sparklode.llm.common import drop, store, stored_bytes


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
                     ).first()


def connected_components(links: DataFrame, a: str = "a", b: str = "b",
                         size: int | None = None) -> DataFrame:
    """(node, component) for every node with a link; the component is its smallest node.

    Links are turned in rounds: first every larger neighbour of a node is linked to the
    smallest one around it, then every smaller one. The rounds needed grow with the
    logarithm of the nodes, and each writes its links to the shared folder. Smallest
    neighbours are pre-aggregated per task, so a hub is no hot group; the joins on a hub
    are ones that Spark splits. NULL ends and self links are ignored. ``size``: about the bytes
    of the links, if known.
    """
    ends = links.where(F.col(a).isNotNull() & (F.col(a) != F.col(b)))
    edges = store(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), size)
    size = stored_bytes(edges)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        turned = store(large, size)
        low = turned.groupBy("u").agg(F.min("v").alias("m"))
        small = (turned.join(low, "u").where("v > m").select(F.col("v").alias("u"),
                                                             F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = store(small, size)
        drop(edges)
        drop(turned)
        edges, before = after, state
        state = _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
