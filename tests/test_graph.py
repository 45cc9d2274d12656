"""Call-graph operators on small graphs; traces against their definition."""

import random

import pytest
from pyspark.sql import functions as F

from sparklode.operators import graph, trace

CHUNK = ("repo_id string, chunk_key string, file_path string, file_rel_path string, node_type string, "
         "name string, source string, docstring string, start_line int, end_line int, calls array<string>")


def table(spark, rows):
    """rows: (repo, name, file, calls)."""
    return spark.createDataFrame([
        (repo, f"{i:04d}", f"/x/{file}", file, "function_definition", name, "src", None, i, i + 1, calls)
        for i, (repo, name, file, calls) in enumerate(rows)], CHUNK)


def counts(c):
    return graph.inbound_counts(graph.call_edges(c))


def test_inbound_counts_without_builtins_and_blanks(spark):
    c = table(spark, [("r", "A", "a.py", ["B", "C", "len", ""]), ("r", "B", "b.py", ["C"])])
    assert {r["name"]: r["inbound"] for r in counts(c).collect()} == {"B": 1, "C": 2}


def test_entry_points_cap_and_duplicates(spark):
    c = table(spark, [("r", n, f, ["x"]) for n, f in [
        ("lonely", "z.py"), ("main", "a.py"), ("main", "b.py"), ("k", "cli.py"), ("run", "c.py"),
        ("start", "d.py")]])
    out = graph.entry_points(c, counts(c)).orderBy("rank").collect()
    assert [r["name"] for r in out] == ["main", "k", "run"]


def greedy(rows, entries, cap=8):
    picked = list(entries)
    for by_file in (True, False):
        for r in rows:
            if len(picked) < cap and all(p["name"] != r["name"] and not (
                    by_file and p["file_rel_path"] == r["file_rel_path"]) for p in picked):
                picked.append(r)
    return [r["chunk_key"] for r in picked]


def test_selection_equals_plain_greedy(spark):
    rng = random.Random(5)
    rows = [(f"r{rng.randrange(12)}", f"n{rng.randrange(14)}", f"f{rng.randrange(6)}.py",
             [f"n{rng.randrange(14)}" for _ in range(rng.randrange(4))]) for _ in range(700)]
    rows += [("hot", "same", f"f{i}.py", ["n1"]) for i in range(60)]
    c = table(spark, rows)
    n = counts(c)
    scored, entries = graph.structural_score(c, n), graph.entry_points(c, n)
    got = {}
    for r in graph.select_representatives(scored, entries).orderBy("repo_id", "pos").collect():
        got.setdefault(r["repo_id"], []).append(r["chunk_key"])
    per = {}
    for r in scored.collect():
        per.setdefault(r["repo_id"], []).append(r)
    first = {}
    for r in entries.orderBy("rank").collect():
        first.setdefault(r["repo_id"], []).append(r)
    want = {k: greedy(sorted(v, key=lambda r: (-r["score"], r["chunk_key"])), first.get(k, []))
            for k, v in per.items()}
    assert got == want


def by_definition(by_name, symbol, max_depth, max_nodes):
    """Visited nodes with (depth, parent), repeated calls, and whether nodes were left out.

    A node's place is its smallest (depth, call positions on the way from the root); the
    first ``max_nodes`` places are visited. A call of a visited node is a repeated one if
    its target has another parent or an earlier place, unless the call's own place comes
    after the first node left out.
    """
    place, parent, level = {symbol: (0, ())}, {symbol: None}, [symbol]
    for depth in range(1, max_depth + 1):
        steps = sorted(((depth, place[u][1] + (i,)), u, v) for u in level
                       for i, v in enumerate(by_name.get(u, ())) if v not in place)
        first = {}
        for at, u, v in steps:
            first.setdefault(v, (at, u))
        for v, (at, u) in first.items():
            place[v], parent[v] = at, u
        level = list(first)
    order = sorted(place, key=place.get)
    seen, left = order[:max_nodes], order[max_nodes:]
    end = place[left[0]] if left else (max_depth + 1, ())
    repeated = set()
    for u in seen:
        for i, v in enumerate(by_name.get(u, ()) if place[u][0] < max_depth else ()):
            at = (place[u][0] + 1, place[u][1] + (i,))
            if v in seen and (place[v] <= place[u] or (parent[v] != u and at < end)):
                repeated.add((u, v))
    return [(n, place[n][0], parent[n]) for n in seen], repeated, bool(left)


@pytest.mark.parametrize("max_depth, max_nodes", [(3, 20), (2, 5), (4, 9)])
def test_traces_follow_the_definition(spark, max_depth, max_nodes):
    rng = random.Random(max_nodes)
    rows, want = [], {}
    for g in range(40):
        names = [f"s{i}" for i in range(rng.randrange(2, 14))]
        by_name = {n: rng.sample(names + ["ext"], rng.randrange(0, min(6, len(names)))) for n in names}
        rows += [(f"g{g}", n, "a.py", c) for n, c in by_name.items()]
        for n in names:
            want[f"g{g}", n] = by_definition(by_name, n, max_depth, max_nodes)
    c = table(spark, rows)
    state = trace.forward_state(c.select("repo_id", F.col("name").alias("symbol")), c,
                                max_depth, max_nodes)
    nodes, marks = {}, {}
    for r in trace.trace_nodes(state).orderBy("ord").collect():
        nodes.setdefault((r["repo_id"], r["symbol"]), []).append((r["name"], r["depth"], r["parent"]))
    for r in trace.trace_edges(state).where("already_visited").collect():
        marks.setdefault((r["repo_id"], r["symbol"]), set()).add((r["parent"], r["child"]))
    cut = {(r["repo_id"], r["symbol"]): r["is_truncated"] for r in trace.trace_summary(state).collect()}
    for key, (tree, repeated, stopped) in want.items():
        assert nodes[key] == tree
        assert marks.get(key, set()) == repeated
        assert cut[key] == stopped


def trees(spark, rows, symbol, **kw):
    c = table(spark, rows)
    s = spark.createDataFrame([("r", symbol)], "repo_id string, symbol string")
    return trace.run_trace(s, c, graph.call_edges(c), **kw).first()


def test_tree_text(spark):
    rows = [("r", "A", "a.py", ["B", "C", "A"]), ("r", "B", "b.py", ["C", "D"]), ("r", "C", "c.py", [])]
    assert trees(spark, rows, "A")["tree"] == "\n".join([
        "A  [a.py:0]", "├── B  [b.py:1]", "│   ├── D  [not indexed]", "│   └── C [already visited]",
        "├── C  [c.py:2]", "    └── A [already visited]"])


def test_chain_limits(spark):
    rows = [("r", f"c{i:02d}", "a.py", [f"c{i + 1:02d}"]) for i in range(25)]
    out = trees(spark, rows, "c00", max_depth=30, max_nodes=10)
    assert out["visited_count"] == 10 and out["is_truncated"]
    out = trees(spark, rows, "c00", max_depth=2)
    assert out["visited_count"] == 3 and not out["is_truncated"]
    assert out["tree"].splitlines()[-1].endswith("└── [truncated — use --depth to go deeper]")


def test_missing_symbol(spark):
    out = trees(spark, [("r", "A", "a.py", ["gone"])], "gone")
    assert out["not_found"] and out["error"] == "'gone' was not found in the index."


def test_callers(spark):
    c = table(spark, [("r", "x", "a.py", ["retrieve"]), ("r", "y", "b.py", ["retrieve", "z"]),
                      ("r", "z", "c.py", [])])
    s = spark.createDataFrame([("r", "retrieve")], "repo_id string, symbol string")
    assert sorted(r["name"] for r in graph.callers(s, graph.call_edges(c), c).collect()) == ["x", "y"]
