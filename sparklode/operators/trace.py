"""Forward traces of the call graph for a whole table of root symbols.

One row per root carries the bounded state of its search (at most
``max_nodes`` nodes). A level takes from it a narrow table of the frontier, (root, order,
name), looks the names up by an equi-join, gathers the hits per root and folds the
called names into the state; visited nodes never leave their root. The state of a
level is written to the shared folder: the next one reads it twice and makes it once.
A name that many frontiers share is a skewed probe side, which adaptive execution
splits.
"""

from pyspark.sql import Column, DataFrame, functions as F

from sparklode import model as M
from sparklode.functions import paths
from sparklode.functions.storage import materialize
from sparklode.operators.graph import callers, first_chunks
from sparklode.operators.topk import rank_rows

_NODE = ("struct<ord:int,name:string,depth:int,parent:int,pos:int,found:boolean,"
         "place:string,calls:array<string>>")


def _facts(chunks: DataFrame) -> DataFrame:
    place = F.concat(paths.display_path(F.col("file_rel_path"), F.col("file_path")),
                     F.lit(":"), F.col("start_line").cast("string"))
    calls = F.filter(F.coalesce("calls", F.array().cast("array<string>")),
                     lambda c: c != "")
    return first_chunks(chunks.select("repo_id", "name", "chunk_key",
                                      place.alias("place"), calls.alias("calls")),
                        None, "place", "calls").drop("chunk_key")


def _node(ord, name, depth, parent, pos, found=None, place=None, calls=None):
    def lit(x, t):
        return (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(
        lit(ord, "int").alias("ord"), lit(name, "string").alias("name"),
        lit(depth, "int").alias("depth"), lit(parent, "int").alias("parent"),
        lit(pos, "int").alias("pos"), lit(found, "boolean").alias("found"),
        lit(place, "string").alias("place"),
        lit(calls, "array<string>").alias("calls"))


def _look_up(state: DataFrame, facts: DataFrame, depth: int) -> DataFrame:
    """Fills place and calls of the nodes at ``depth``."""
    front = state.select("repo_id", "symbol", F.explode(F.filter(
        "nodes", lambda n: n["depth"] == depth)).alias("n"))
    hits = (front.select("repo_id", "symbol", "n.ord", "n.name")
            .join(facts, ["repo_id", "name"]).groupBy("repo_id", "symbol")
            .agg(F.map_from_entries(F.collect_list(F.struct(
                "ord", F.struct("place", "calls")))).alias("hits")))

    def filled(n):
        hit = F.try_element_at("hits", n["ord"])
        return F.when(n["depth"] == depth, _node(
            n["ord"], n["name"], n["depth"], n["parent"], n["pos"], hit.isNotNull(),
            hit["place"], hit["calls"])).otherwise(n)
    return state.join(hits, ["repo_id", "symbol"], "left").select(
        "repo_id", "symbol", F.transform("nodes", filled).alias("nodes"), "stop")


def _advance(state: DataFrame, depth: int, max_nodes: int) -> DataFrame:
    """Adds the unvisited callees of the nodes at ``depth``, in queue order.

    ``array_except`` keeps first occurrences in order, which is the order in
    which a queue would visit them. ``stop``: the (ord, pos) of the first
    callee that no longer fitted.
    """
    front = F.filter("nodes", lambda n: (n["depth"] == depth) & n["found"])
    queue = F.flatten(F.transform(front, lambda n: F.transform(
        n["calls"], lambda c, i: F.struct(n["ord"].alias("ord"), i.alias("pos"),
                                          c.alias("name")))))
    s = state.withColumns({"queue": queue,
                           "seen": F.transform("nodes", lambda n: n["name"])})
    s = s.withColumn("flat", F.transform("queue", lambda q: q["name"]))
    s = s.withColumn("fresh", F.array_except("flat", "seen"))
    room = F.lit(max_nodes) - F.size("nodes")

    def source(name):
        return F.get("queue", F.array_position("flat", name).cast("int") - 1)

    added = F.transform(F.slice("fresh", F.lit(1), room), lambda name, i: _node(
        F.size("nodes") + i, name, depth + 1, source(name)["ord"], source(name)["pos"]))
    left = source(F.get("fresh", room))
    stop = F.coalesce("stop", F.when(F.size("fresh") > room, F.struct(
        left["ord"].alias("ord"), left["pos"].alias("pos"))))
    return s.select("repo_id", "symbol", F.concat("nodes", added).alias("nodes"),
                    stop.alias("stop"))


def forward_state(symbols: DataFrame, chunks: DataFrame,
                  max_depth: int = M.TRACE_DEPTH,
                  max_nodes: int = M.TRACE_NODES) -> DataFrame:
    """One row per root: its visited nodes in visiting order.

    ``symbols``: repo_id, symbol. Result: repo_id, symbol, nodes (array),
    stop (struct, NULL unless the node limit was hit), not_found, max_depth.
    """
    facts = materialize(_facts(chunks))
    state = symbols.select("repo_id", "symbol").distinct().select(
        "repo_id", "symbol",
        F.array(_node(0, F.col("symbol"), 0, None, None)).alias("nodes"),
        F.lit(None).cast("struct<ord:int,pos:int>").alias("stop"))
    for depth in range(max_depth + 1):
        state = _look_up(state, facts, depth)
        if depth < max_depth:
            state = materialize(_advance(state, depth, max_nodes))
    root_found = F.get("nodes", F.lit(0))["found"]
    empty = F.array().cast(f"array<{_NODE}>")
    # Nodes, edges, tree and summary all read the state: written out once, it
    # is searched once.
    return materialize(state.select(
        "repo_id", "symbol",
        F.when(root_found, F.col("nodes")).otherwise(empty).alias("nodes"),
        "stop", (~root_found).alias("not_found"), F.lit(max_depth).alias("max_depth")))


def trace_nodes(state: DataFrame) -> DataFrame:
    """Visited nodes: ord, name, depth, parent name, is_indexed, is_truncated."""
    return state.select(
        "repo_id", "symbol", "max_depth", F.explode("nodes").alias("n"), "nodes"
    ).select(
        "repo_id", "symbol", "n.ord", "n.name", "n.depth",
        F.when(F.col("n.parent").isNotNull(), F.get(
            "nodes", F.col("n.parent"))["name"]).alias("parent"),
        F.col("n.found").alias("is_indexed"), F.col("n.place").alias("place"),
        _cut_off(F.col("n"), F.col("max_depth")).alias("is_truncated"))


def trace_summary(state: DataFrame) -> DataFrame:
    return state.select(
        "repo_id", "symbol", F.size("nodes").alias("visited_count"),
        F.col("stop").isNotNull().alias("is_truncated"), "not_found")


def _cut_off(n, max_depth) -> Column:
    return (n["depth"] >= max_depth) & F.coalesce(F.size(n["calls"]) > 0, F.lit(False))


def _edges(state: DataFrame) -> DataFrame:
    """Adds ``edges``: every child shown under an expanded node, in order.

    mark 0: tree edge; 1: child was visited when its caller was expanded;
    2: child was visited between that moment and its turn in the queue.
    """
    s = state.withColumn("seen", F.transform("nodes", lambda n: n["name"]))

    def of(n):
        def edge(c, i):
            at = F.array_position("seen", c).cast("int") - 1
            child = F.get("nodes", at)
            mark = (F.when(at <= n["ord"], 1)
                    .when((child["parent"] == n["ord"]) & (child["pos"] == i), 0)
                    .when(F.col("stop").isNull() | (F.struct(
                        n["ord"].alias("ord"), i.alias("pos")) < F.col("stop")), 2)
                    .otherwise(-1))
            return F.struct(n["ord"].alias("parent"), mark.alias("mark"),
                            i.alias("pos"), c.alias("name"), at.alias("child"))
        known = F.filter(F.transform(n["calls"], lambda c, i: F.struct(
            c.alias("c"), i.alias("i"))), lambda x: F.array_contains("seen", x["c"]))
        return F.filter(F.transform(known, lambda x: edge(x["c"], x["i"])),
                        lambda e: e["mark"] >= 0)

    expanded = F.filter("nodes", lambda n: n["found"] & (n["depth"] < F.col("max_depth")))
    return s.withColumn("edges", F.flatten(F.transform(expanded, of)))


def trace_edges(state: DataFrame) -> DataFrame:
    """repo_id, symbol, parent, child, pos, already_visited."""
    return (_edges(state)
            .select("repo_id", "symbol", "nodes", F.explode("edges").alias("e"))
            .select("repo_id", "symbol",
                    F.get("nodes", F.col("e.parent"))["name"].alias("parent"),
                    F.col("e.name").alias("child"), "e.pos",
                    (F.col("e.mark") > 0).alias("already_visited")))


def trace_tree(state: DataFrame) -> DataFrame:
    """The trace as an indented text tree: repo_id, symbol, tree.

    Every line gets the path of its sibling positions; sorting the lines of a
    root by that path is the pre-order. Callers come before their callees and
    tree children appear in visiting order, so one pass over the lines knows
    path and indent of every caller. All of it happens inside the one row.
    """
    s = _edges(state).where(~F.col("not_found"))

    def label(n):
        return F.concat(n["name"], F.lit("  ["), F.when(
            n["found"], n["place"]).otherwise("not indexed"), F.lit("]"))

    shown = F.transform("edges", lambda e: F.struct(
        e["parent"].alias("parent"), e["mark"].alias("mark"), e["pos"].alias("pos"),
        F.when(e["mark"] == 0, label(F.get("nodes", e["child"])))
        .otherwise(F.concat(e["name"], F.lit(" [already visited]"))).alias("text")))
    hints = F.transform(
        F.filter("nodes", lambda n: _cut_off(n, F.col("max_depth"))),
        lambda n: F.struct(
            n["ord"].alias("parent"), F.lit(9).alias("mark"), F.lit(0).alias("pos"),
            F.lit("[truncated — use --depth to go deeper]").alias("text")))
    s = s.withColumn("lines", F.array_sort(F.concat(shown, hints)))
    s = s.withColumn("lines", F.transform("lines", lambda x, i: F.struct(
        x["parent"].alias("parent"), (x["mark"] == 0).alias("is_node"),
        x["text"].alias("text"),
        F.coalesce(F.get("lines", i + 1)["parent"] != x["parent"], F.lit(True))
        .alias("last"))))

    line = "array<struct<path:array<int>,text:string>>"
    home = "array<struct<path:array<int>,indent:string,mark_indent:string>>"
    start = F.struct(
        F.array().cast(line).alias("lines"),
        F.array(F.struct(F.array().cast("array<int>").alias("path"),
                         F.lit("").alias("indent"),
                         F.lit("    ").alias("mark_indent"))).cast(home).alias("homes"),
        F.lit(-1).alias("parent"), F.lit(0).alias("i"))

    def draw(acc, x):
        here = F.get(acc["homes"], x["parent"])
        i = F.when(x["parent"] == acc["parent"], acc["i"] + 1).otherwise(1)
        path = F.array_append(here["path"], i)
        text = F.concat(
            F.when(x["is_node"], here["indent"]).otherwise(here["mark_indent"]),
            F.when(x["last"], "└── ").otherwise("├── "), x["text"])
        indent = F.concat(here["indent"], F.when(x["last"], "    ").otherwise("│   "))
        return F.struct(
            F.array_append(acc["lines"], F.struct(
                path.alias("path"), text.alias("text"))).alias("lines"),
            F.when(x["is_node"], F.array_append(acc["homes"], F.struct(
                path.alias("path"), indent.alias("indent"),
                indent.alias("mark_indent")))).otherwise(acc["homes"]).alias("homes"),
            x["parent"].alias("parent"), i.alias("i"))

    drawn = F.aggregate("lines", start, draw, lambda acc: acc["lines"])
    text = F.concat_ws("\n", label(F.get("nodes", F.lit(0))), F.transform(
        F.array_sort(drawn), lambda x: x["text"]))
    return s.select("repo_id", "symbol", text.alias("tree"))


def run_trace(symbols: DataFrame, chunks: DataFrame, edges: DataFrame,
              max_depth: int = M.TRACE_DEPTH, max_nodes: int = M.TRACE_NODES,
              include_backward: bool = True) -> DataFrame:
    """Bundle per symbol: tree, visited_count, is_truncated, n_callers, callers, error.

    ``callers`` holds the first ``M.TRACE_CALLERS`` chunks (by key) that call the symbol;
    ``graph.callers`` gives all of them as rows.
    """
    state = forward_state(symbols, chunks, max_depth, max_nodes)
    trees = (trace_tree(state)
             .unionByName(state.where("not_found").select(
                 "repo_id", "symbol", F.format_string(
                     "Symbol '%s' not found in index.", "symbol").alias("tree"))))
    out = trace_summary(state).join(trees, ["repo_id", "symbol"])
    if include_backward:
        back = callers(symbols, edges, chunks)
        caller = F.struct("chunk_key", "name", "file_rel_path", "start_line")
        first = rank_rows(back, ["chunk_key"], M.TRACE_CALLERS, "r",
                          within=("repo_id", "symbol"))
        out = (out.join(back.groupBy("repo_id", "symbol")
                        .agg(F.count(F.lit(1)).alias("n_callers")),
                        ["repo_id", "symbol"], "left")
               .join(first.groupBy("repo_id", "symbol").agg(
                   F.array_sort(F.collect_list(caller)).alias("callers")),
                   ["repo_id", "symbol"], "left"))
    else:
        out = out.withColumns({"n_callers": F.lit(0).cast("long"), "callers": F.lit(None).cast(
            "array<struct<chunk_key: string, name: string, file_rel_path: string, "
            "start_line: int>>")})
    n_callers = F.when(F.col("not_found"), 0).otherwise(
        F.coalesce("n_callers", F.lit(0)))
    return out.withColumn("n_callers", n_callers).withColumn(
        "error", F.when(F.col("not_found"), F.format_string(
            "'%s' was not found in the index.", "symbol")))
