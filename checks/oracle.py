"""DuckDB SQL with the same result as each registered query."""

from sparklode import model as M
from checks.views import FILE_NAMES

STRIP = M.TOKEN_STRIP_CHARS.replace("'", "''")
NL = "chr(10)"


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def tokens(expr: str, n: int) -> str:
    return (f"list_transform(list_filter(list_transform(string_split_regex({expr}, "
            f"'\\s+'), lambda t: trim(t, '{STRIP}')), lambda t: length(t) >= {n}), "
            "lambda t: lower(t))")


CHUNKS = f"""
d0 AS (SELECT *, string_split(text, {NL}) AS lines,
    source || '/' || {_list(FILE_NAMES)}[(doc_id % 5) + 1] AS rel FROM documents),
c AS (SELECT lang AS repo_id, '/' || lang || '/' || rel || ':' || doc_id AS chunk_key,
    '/' || lang || '/' || rel AS file_path, rel AS file_rel_path,
    CASE WHEN n_chars % 2 = 0 THEN 'function_definition' ELSE 'class_definition' END AS node_type,
    trim(string_split_regex(text, '\\s+')[1], '{STRIP}') AS name, text AS source,
    doc_id AS start_line, doc_id + len(lines) - 1 AS end_line,
    list_sort(list_distinct(list_filter(list_transform(
        string_split_regex(lines[-1], '\\s+'), lambda w: trim(w, '{STRIP}')),
        lambda w: w <> ''))) AS calls,
    lines[1] AS docstring,
    CASE WHEN n_chars % 3 = 0 THEN source END AS parent_class,
    n_chars > 2000 AS is_truncated, doc_id,
    concat_ws(chr(10) || chr(10), 'file: ' || rel,
      CASE WHEN n_chars % 2 = 0 THEN 'function' ELSE 'class' END || ': '
        || trim(string_split_regex(text, '\\s+')[1], '{STRIP}'),
      nullif(lines[1], ''), text) AS search_text
  FROM d0)"""
QUESTIONS = """
q AS (SELECT item_id AS query_id, text AS question, embedding
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)"""
VECTOR = """
knn0 AS (SELECT q.query_id, c.chunk_key,
    round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2, 9) AS distance
  FROM embeddings e JOIN c ON c.doc_id = e.vec_id, q WHERE q.embedding IS NOT NULL),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY distance, chunk_key) AS vrank FROM knn0 QUALIFY vrank <= 10)"""
KEYWORD = f"""
asked AS (SELECT query_id, token, count(*) AS times FROM (
    SELECT query_id, unnest({tokens('question', 2)}) AS token FROM q) GROUP BY ALL),
kw0 AS (SELECT a.query_id, c.chunk_key, sum(a.times)::BIGINT AS matches
  FROM asked a JOIN c ON contains(c.search_text, a.token) GROUP BY ALL),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY matches DESC, chunk_key) AS krank FROM kw0 QUALIFY krank <= 10)"""
FUSED = """
fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id,
    coalesce(a.chunk_key, b.chunk_key) AS chunk_key, vrank, krank,
    coalesce(1.0::DOUBLE / (60 + vrank), 0) + coalesce(1.0::DOUBLE / (60 + krank), 0) AS rrf_score
  FROM knn a FULL JOIN kw b ON a.query_id = b.query_id AND a.chunk_key = b.chunk_key)"""
RERANKED = f"""
pts AS (SELECT f.query_id, c.repo_id, f.chunk_key, f.rrf_score, f.vrank, f.krank, c.name, c.calls,
    rrf_score + list_sum(list_concat([0], list_transform({tokens('q.question', 1)}, lambda t:
        CASE WHEN contains(lower(c.name), t) THEN 30 ELSE 0 END
      + CASE WHEN contains(lower(regexp_extract(c.file_path, '([^/]*)\\.[^./]*$', 1)), t) THEN 20 ELSE 0 END
      + CASE WHEN contains(lower(c.docstring), t) THEN 15 ELSE 0 END
      + CASE WHEN len(list_filter(c.calls, lambda x: contains(lower(x), t))) > 0 THEN 10 ELSE 0 END
    )))::DOUBLE / 100.0::DOUBLE AS rerank_score
  FROM fused f JOIN c USING (chunk_key) JOIN q USING (query_id)),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC,
    rrf_score DESC, vrank NULLS LAST, krank NULLS LAST, chunk_key) AS hit_rank FROM pts)"""
EXPANDED = """
top AS (SELECT * FROM rr WHERE hit_rank <= 5),
called AS (SELECT query_id, repo_id, hit_rank, unnest(calls) AS name,
    unnest(range(len(calls))) AS pos FROM top),
wanted AS (SELECT query_id, repo_id, name, min((hit_rank, pos)) AS at FROM called a
  WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.query_id = a.query_id
    AND t.repo_id = a.repo_id AND t.name = a.name)
  GROUP BY ALL),
firsts AS (SELECT repo_id, name, min(chunk_key) AS chunk_key FROM c GROUP BY ALL),
extra AS (SELECT w.query_id, w.repo_id, f.chunk_key, row_number() OVER (
    PARTITION BY w.query_id ORDER BY w.at) AS n
  FROM wanted w JOIN firsts f USING (repo_id, name) QUALIFY n <= 3),
expanded AS (SELECT e.query_id, e.repo_id, e.chunk_key, e.n + (SELECT count(*) FROM top t
    WHERE t.query_id = e.query_id) AS hit_rank, 0.005::DOUBLE AS rerank_score FROM extra e)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


_ret = (CHUNKS, QUESTIONS, VECTOR, KEYWORD, FUSED, RERANKED, EXPANDED)

ORACLE: dict[str, str] = {
    "RET_1_vector_knn": with_(*_ret[:3]) + """
SELECT query_id, chunk_key, round(distance, 6) AS distance, vrank FROM knn""",
    "RET_2_keyword_search": with_(CHUNKS, QUESTIONS, KEYWORD) + """
SELECT query_id, chunk_key, matches, krank FROM kw""",
    "RET_3_rrf": with_(*_ret[:5]) + """
SELECT query_id, chunk_key, round(rrf_score, 9) AS rrf_score, vrank, krank FROM fused""",
    "RET_4_rerank": with_(*_ret[:6]) + """
SELECT query_id, chunk_key, round(rerank_score, 9) AS rerank_score, hit_rank FROM rr""",
    "RET_5_topk_cut": with_(*_ret[:6]) + """
SELECT query_id, chunk_key, hit_rank FROM rr WHERE hit_rank <= 5""",
    "RET_6_call_expansion": with_(*_ret) + """
SELECT query_id, chunk_key, hit_rank, round(rerank_score, 9) AS rerank_score FROM expanded""",
    "RET_7_name_lookup": with_(CHUNKS) + """
, w AS (SELECT DISTINCT repo_id, unnest(calls) AS name FROM c),
f AS (SELECT repo_id, name, min(chunk_key) AS chunk_key FROM c GROUP BY ALL)
SELECT repo_id, name, chunk_key FROM w LEFT JOIN f USING (repo_id, name)""",
    "RET_8_hybrid_retrieve": with_(*_ret) + """
SELECT query_id, hit_rank, chunk_key, name, source, round(rrf_score, 9) AS rrf_score,
  round(rerank_score, 9) AS rerank_score FROM (
    SELECT query_id, hit_rank, chunk_key, rrf_score, rerank_score FROM top
    UNION ALL SELECT query_id, hit_rank, chunk_key, 0.005, rerank_score FROM expanded)
  JOIN c USING (chunk_key)""",
}
ORACLE["RET_2_keyword_postings"] = ORACLE["RET_2_keyword_search"]
ORACLE["RET_2_stored_postings"] = ORACLE["RET_2_keyword_search"]

# Two repositories with equal keys; every question is bound to one of them.
SHARED = CHUNKS.replace("\nc AS (", "\nc0 AS (") + """,
c AS (SELECT * REPLACE ('r' AS repo_id) FROM c0 UNION ALL
  SELECT * REPLACE ('s' AS repo_id, docstring AS search_text) FROM c0)"""
SCOPED_QUESTIONS = QUESTIONS.replace(
    "embedding\n", "embedding,\n  CASE WHEN item_id % 2 = 0 THEN 'r' ELSE 's' END AS repo_id\n")
SCOPED_VECTOR = """
knn0 AS (SELECT q.query_id, c.chunk_key, round(list_distance(
    CASE WHEN c.repo_id = 's' THEN list_transform(e.embedding, lambda x: -x)
      ELSE e.embedding END::DOUBLE[], q.embedding::DOUBLE[]) ** 2, 9) AS distance
  FROM embeddings e JOIN c ON c.doc_id = e.vec_id JOIN q ON q.repo_id = c.repo_id
  WHERE q.embedding IS NOT NULL),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY distance, chunk_key) AS vrank FROM knn0 QUALIFY vrank <= 10)"""
SCOPED_KEYWORD = KEYWORD.replace("SELECT query_id, token", "SELECT query_id, repo_id, token").replace(
    "SELECT query_id, unnest", "SELECT query_id, repo_id, unnest").replace(
    "a.query_id, c.chunk_key", "a.query_id, c.repo_id, c.chunk_key").replace(
    "a.token) GROUP", "a.token) AND c.repo_id = a.repo_id GROUP")
SCOPED_RERANKED = RERANKED.replace("JOIN c USING (chunk_key) JOIN q USING (query_id)",
                                   "JOIN q USING (query_id) JOIN c ON c.chunk_key = f.chunk_key"
                                   " AND c.repo_id = q.repo_id")
ORACLE["RET_2_scoped"] = ORACLE["RET_2_postings_scoped"] = with_(
    SHARED, SCOPED_QUESTIONS, SCOPED_KEYWORD) + """
SELECT query_id, repo_id, chunk_key, matches, krank FROM kw"""
ORACLE["RET_8_scoped"] = with_(SHARED, SCOPED_QUESTIONS, SCOPED_VECTOR, SCOPED_KEYWORD, FUSED,
                               SCOPED_RERANKED, EXPANDED) + """
SELECT query_id, hit_rank, repo_id, chunk_key, name, round(rrf_score, 9) AS rrf_score,
  round(rerank_score, 9) AS rerank_score FROM (
    SELECT query_id, hit_rank, repo_id, chunk_key, rrf_score, rerank_score FROM top
    UNION ALL SELECT query_id, hit_rank, repo_id, chunk_key, 0.005, rerank_score FROM expanded)
  JOIN c USING (repo_id, chunk_key)"""

# --- call graph ------------------------------------------------------------

PART_EDGES = """
pe AS (SELECT DISTINCT 'parts' AS repo_id, src::VARCHAR AS src_name, dst::VARCHAR AS dst_name
  FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL)"""
EDGES = """
e AS (SELECT repo_id, chunk_key, name AS src_name, unnest(calls) AS dst_name,
  unnest(range(len(calls))) AS pos FROM c)"""


def _counts(edges: str) -> str:
    return (f"\nn AS (SELECT repo_id, dst_name AS name, count(*) AS inbound FROM {edges} "
            f"WHERE dst_name NOT IN {_in(M.BUILTIN_NAMES)} GROUP BY ALL)")


COUNTS = _counts("e")
TOP = """
topf AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY inbound DESC, name)
  AS rank FROM n QUALIFY rank <= 5)"""
FIRST = """
f AS (SELECT repo_id, name, arg_min(file_rel_path, chunk_key) AS file_rel_path,
  arg_min(file_rel_path || ':' || start_line, chunk_key) AS place,
  arg_min(calls, chunk_key) AS calls FROM c GROUP BY ALL)"""
ENTRY = f"""
ep0 AS (SELECT c.repo_id, c.name, c.chunk_key, c.file_rel_path,
    CASE WHEN lower(regexp_extract(file_rel_path, '[^/]*$')) IN {_in(M.ENTRY_FILES)}
           OR c.name IN {_in(M.ENTRY_FUNCTIONS)} THEN 1
         WHEN coalesce(inbound, 0) = 0 AND len(calls) > 0 THEN 2 END AS signal
  FROM c LEFT JOIN n USING (repo_id, name)),
ep1 AS (SELECT *, row_number() OVER (PARTITION BY repo_id, name ORDER BY chunk_key) AS o
  FROM ep0 WHERE signal IS NOT NULL QUALIFY o = 1),
ep AS (SELECT repo_id, name, chunk_key, file_rel_path, signal, row_number() OVER (
    PARTITION BY repo_id ORDER BY signal, chunk_key) AS rank FROM ep1 QUALIFY rank <= 3)"""
SCORE = """
sc AS (SELECT c.repo_id, c.chunk_key, c.name, c.file_rel_path, coalesce(inbound, 0) AS inbound,
    coalesce(inbound, 0) + 0.5::DOUBLE * len(calls) AS score
  FROM c LEFT JOIN n USING (repo_id, name))"""
SELECTED = """
so AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, chunk_key) AS rn
  FROM sc),
p1 AS (
  SELECT r.repo_id, coalesce(list(ep.name ORDER BY rank) FILTER (rank > 0), []) AS names,
    coalesce(list(ep.file_rel_path ORDER BY rank) FILTER (rank > 0), []) AS files,
    coalesce(list(ep.chunk_key ORDER BY rank) FILTER (rank > 0), []) AS keys
  FROM (SELECT DISTINCT repo_id FROM c) r LEFT JOIN ep USING (repo_id) GROUP BY ALL
  UNION ALL
  SELECT repo_id, list_append(names, pick.name), list_append(files, pick.file),
    list_append(keys, pick.key) FROM (
    SELECT p1.repo_id, names, files, keys, min({'rn': rn, 'name': name,
        'file': file_rel_path, 'key': chunk_key}) AS pick
    FROM p1 JOIN so ON so.repo_id = p1.repo_id AND len(names) < 8
      AND NOT list_contains(names, so.name) AND NOT list_contains(files, so.file_rel_path)
    GROUP BY ALL)),
p2 AS (
  SELECT repo_id, names, files, keys FROM p1 QUALIFY row_number() OVER (
    PARTITION BY repo_id ORDER BY len(names) DESC) = 1
  UNION ALL
  SELECT repo_id, list_append(names, pick.name), list_append(files, pick.file),
    list_append(keys, pick.key) FROM (
    SELECT p2.repo_id, names, files, keys, min({'rn': rn, 'name': name,
        'file': file_rel_path, 'key': chunk_key}) AS pick
    FROM p2 JOIN so ON so.repo_id = p2.repo_id AND len(names) < 8
      AND NOT list_contains(names, so.name)
    GROUP BY ALL)),
sel AS (SELECT repo_id, unnest(names) AS name, unnest(files) AS file_rel_path,
    unnest(keys) AS chunk_key, unnest(range(1, len(keys) + 1)) AS pos
  FROM (SELECT * FROM p2 QUALIFY row_number() OVER (
    PARTITION BY repo_id ORDER BY len(names) DESC) = 1))"""


def trace_sql(symbols: str, depth: int = 3, cap: int = 20) -> str:
    """Level-by-level breadth-first search with position paths."""
    out = [FIRST, """
fe AS MATERIALIZED (SELECT repo_id, name AS src, unnest(calls) AS dst,
  unnest(range(len(calls))) AS pos FROM f)""", f"""
sym AS ({symbols})""", """
v0 AS (SELECT s.repo_id, symbol, symbol AS name, []::BIGINT[] AS path, 0 AS depth,
  NULL::VARCHAR AS parent, 0::BIGINT AS ord FROM sym s
  JOIN f ON f.repo_id = s.repo_id AND f.name = s.symbol)"""]
    for d in range(1, depth + 1):
        out.append(f"""
k{d} AS MATERIALIZED (SELECT v.repo_id, v.symbol, fe.dst AS name,
    min({{'path': list_append(v.path, fe.pos), 'parent': v.name}}) AS b
  FROM v{d - 1} v JOIN fe ON fe.repo_id = v.repo_id AND fe.src = v.name
  WHERE v.depth = {d - 1} AND NOT EXISTS (SELECT 1 FROM v{d - 1} o WHERE o.repo_id = v.repo_id
    AND o.symbol = v.symbol AND o.name = fe.dst) GROUP BY ALL)""")
        out.append(f"""
v{d} AS MATERIALIZED (SELECT * FROM v{d - 1} UNION ALL
  SELECT * FROM (SELECT repo_id, symbol, name, b.path, {d} AS depth, b.parent,
    (SELECT count(*) FROM v{d - 1} o WHERE o.repo_id = k.repo_id AND o.symbol = k.symbol)
      + row_number() OVER (PARTITION BY repo_id, symbol ORDER BY b.path) - 1 AS ord
    FROM k{d} k) WHERE ord < {cap})""")
    out.append(f"""
nodes AS MATERIALIZED (SELECT v.*, f.name IS NOT NULL AS is_indexed, f.place,
    coalesce(v.depth >= {depth} AND len(f.calls) > 0, false) AS is_truncated
  FROM v{depth} v LEFT JOIN f USING (repo_id, name))""")
    out.append(f"""
le AS MATERIALIZED (SELECT u.repo_id, u.symbol, u.name AS parent, u.ord AS uord, fe.dst AS child, fe.pos,
    w.ord AS vord, w.parent AS vparent
  FROM nodes u JOIN fe ON fe.repo_id = u.repo_id AND fe.src = u.name
  LEFT JOIN nodes w ON w.repo_id = u.repo_id AND w.symbol = u.symbol AND w.name = fe.dst
  WHERE u.depth < {depth}),
stop AS MATERIALIZED (SELECT repo_id, symbol, min((uord, pos)) AS at FROM le WHERE vord IS NULL GROUP BY ALL),
te AS MATERIALIZED (SELECT le.repo_id, le.symbol, le.parent, le.uord, child, pos, vord,
    CASE WHEN vord <= uord THEN 1 WHEN vparent = le.parent THEN 0 ELSE 2 END AS mark
  FROM le LEFT JOIN stop USING (repo_id, symbol)
  WHERE vord IS NOT NULL AND (vord <= uord OR vparent = le.parent
    OR stop.at IS NULL OR (uord, pos) < stop.at))""")
    return ",".join(out)


TREE = """
ent AS MATERIALIZED (SELECT repo_id, symbol, uord, mark, pos, mark = 0 AS is_node,
    CASE WHEN mark = 0 THEN vord END AS vord,
    CASE WHEN mark = 0 THEN child ELSE child || ' [already visited]' END AS label FROM te
  UNION ALL
  SELECT repo_id, symbol, ord, 9, 0, false, NULL, '[truncated — use --depth to go deeper]'
  FROM nodes WHERE is_truncated),
sib AS MATERIALIZED (SELECT ent.* EXCLUDE (label), CASE WHEN is_node THEN label || '  [' ||
      CASE WHEN w.is_indexed THEN w.place ELSE 'not indexed' END || ']' ELSE label END AS label,
    row_number() OVER (PARTITION BY ent.repo_id, ent.symbol, uord ORDER BY mark, pos) AS i,
    count(*) OVER (PARTITION BY ent.repo_id, ent.symbol, uord) AS m
  FROM ent LEFT JOIN nodes w ON w.repo_id = ent.repo_id AND w.symbol = ent.symbol AND w.ord = ent.vord),
ln AS (
  SELECT repo_id, symbol, vord, [i] AS path,
    CASE WHEN i = m THEN '    ' ELSE '│   ' END AS indent,
    CASE WHEN is_node THEN '' ELSE '    ' END
      || CASE WHEN i = m THEN '└── ' ELSE '├── ' END || label AS line
  FROM sib WHERE uord = 0
  UNION ALL
  SELECT s.repo_id, s.symbol, s.vord, list_append(ln.path, s.i),
    ln.indent || CASE WHEN s.i = s.m THEN '    ' ELSE '│   ' END,
    ln.indent || CASE WHEN s.i = s.m THEN '└── ' ELSE '├── ' END || s.label
  FROM ln JOIN sib s ON s.repo_id = ln.repo_id AND s.symbol = ln.symbol AND s.uord = ln.vord),
tree AS (SELECT n.repo_id, n.symbol, concat_ws(chr(10), n.name || '  [' || n.place || ']',
    l.body) AS tree
  FROM nodes n LEFT JOIN (SELECT repo_id, symbol, string_agg(line, chr(10) ORDER BY path) AS body
    FROM ln GROUP BY ALL) l USING (repo_id, symbol) WHERE ord = 0)"""
NAMES = "SELECT DISTINCT repo_id, name AS symbol FROM c"
CALLED = "SELECT DISTINCT repo_id, dst_name AS symbol FROM e"
PREVIEW = """array_to_string(string_split(source, chr(10))[1:20], chr(10))
  || CASE WHEN len(string_split(source, chr(10))) > 20
     THEN chr(10) || '... (' || (len(string_split(source, chr(10))) - 20) || ' more lines)' ELSE '' END"""


def rec(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


_g = (CHUNKS, EDGES, COUNTS)
ORACLE |= {
    "GRF_1_call_edges": with_(CHUNKS, EDGES) + "\nSELECT * FROM e",
    "GRF_2_inbound_counts": with_(*_g) + "\nSELECT * FROM n",
    "GRF_2_inbound_counts_parts": with_(PART_EDGES, _counts("pe")) + "\nSELECT * FROM n",
    "GRF_3_top_functions": with_(*_g, TOP) + "\nSELECT * FROM topf",
    "GRF_3_top_functions_parts": with_(PART_EDGES, _counts("pe"), TOP)
    + "\nSELECT * FROM topf",
    "GRF_4_callee_files": with_(*_g, FIRST) + """
SELECT n.repo_id, n.name, n.inbound, coalesce(f.file_rel_path, 'unknown') AS file_rel_path
FROM n LEFT JOIN f USING (repo_id, name)""",
    "GRF_5_entry_points": with_(*_g, ENTRY) + "\nSELECT * FROM ep",
    "GRF_6_structural_score": with_(*_g, SCORE) + "\nSELECT * FROM sc",
    "GRF_7_diverse_selection": rec(*_g, ENTRY, SCORE, SELECTED) + "\nSELECT * FROM sel",
    "GRF_8_forward_trace_nodes": with_(CHUNKS, trace_sql(NAMES)) + """
SELECT repo_id, symbol, name, parent, is_indexed, is_truncated, ord, depth::BIGINT AS depth
FROM nodes""",
    "GRF_8_forward_trace_edges": with_(CHUNKS, trace_sql(NAMES)) + """
SELECT repo_id, symbol, parent, child, mark > 0 AS already_visited, pos FROM te""",
    "GRF_9_backward_trace": with_(CHUNKS, EDGES) + """
SELECT c.repo_id, e.dst_name AS symbol, c.chunk_key, c.name, c.file_rel_path, c.start_line
FROM e JOIN c USING (repo_id, chunk_key)""",
    "GRF_10_trace_tree": rec(CHUNKS, trace_sql(NAMES), TREE) + "\nSELECT * FROM tree",
    "GRF_11_trace_bundle": rec(CHUNKS, EDGES, trace_sql(CALLED), TREE) + """
, back AS (SELECT repo_id, dst_name AS symbol, count(*) AS n_callers,
    array_to_string(list(src_name ORDER BY chunk_key)[1:5], ',') AS callers FROM e GROUP BY ALL),
vis AS (SELECT repo_id, symbol, count(*) AS visited_count FROM nodes GROUP BY ALL)
SELECT s.repo_id, s.symbol, coalesce(visited_count, 0) AS visited_count,
  stop.at IS NOT NULL AS is_truncated, tree IS NULL AS not_found,
  coalesce(tree, 'Symbol ''' || s.symbol || ''' not found in index.') AS tree,
  CASE WHEN tree IS NULL THEN 0 ELSE n_callers END AS n_callers, callers,
  CASE WHEN tree IS NULL THEN '''' || s.symbol || ''' was not found in the index.' END AS error
FROM sym s LEFT JOIN tree USING (repo_id, symbol) LEFT JOIN vis USING (repo_id, symbol)
LEFT JOIN stop USING (repo_id, symbol) LEFT JOIN back USING (repo_id, symbol)""",
    "GRF_12_tour_evidence": rec(*_g, TOP, FIRST, ENTRY, SCORE, SELECTED) + f"""
SELECT r.repo_id, 'REPO: ' || r.repo_id || chr(10) || 'SCOPE: full repo' || chr(10) || 'FILES: '
  || (SELECT count(DISTINCT file_rel_path) FROM sel WHERE sel.repo_id = r.repo_id)
  || chr(10) || chr(10) || 'TOP FUNCTIONS BY INBOUND REFERENCES:' || chr(10)
  || (SELECT string_agg('  ' || t.name || ' (' || coalesce(f.file_rel_path, 'unknown')
        || ') — called by ' || inbound || ' functions', chr(10) ORDER BY rank)
      FROM topf t LEFT JOIN f USING (repo_id, name) WHERE t.repo_id = r.repo_id)
  || chr(10) || chr(10) || 'SELECTED CHUNKS:' || chr(10)
  || (SELECT string_agg(chr(10) || '[' || pos || '] ' || c.name || ' (' || node_type || ') — '
        || c.file_rel_path || ':' || start_line || '-' || end_line || chr(10)
        || CASE WHEN docstring <> '' THEN 'Docstring: ' || docstring[1:200] || chr(10) ELSE '' END
        || {PREVIEW} || chr(10) || '---', chr(10) ORDER BY pos)
      FROM sel JOIN c USING (repo_id, chunk_key) WHERE sel.repo_id = r.repo_id) AS evidence
FROM (SELECT DISTINCT repo_id FROM c) r""",
}

# --- paths, reports, incremental index -------------------------------------

from checks.views import DIRS, NAMES as LEAVES  # noqa: E402

PATHS = f"""
p AS (SELECT doc_id, lang, n_chars * 100 AS length, {_list(DIRS)}[(doc_id % 8) + 1] || '/'
    || {_list(LEAVES)}[((doc_id // 8) % 9) + 1] AS rel FROM documents),
pp AS (SELECT *, '/r/' || lang || '/' || rel AS path, string_split(rel, '/') AS parts,
    regexp_extract(rel, '^(?:.*/)?\\.*[^/.][^/]*?(\\.[^./]+)$', 1) AS suffix,
    regexp_extract(rel, '[^/]*$') AS file FROM p),
ps AS (SELECT *, list_slice(parts, 1, len(parts) - 1) AS dirs,
    file[1:length(file) - length(suffix)] AS stem FROM pp)"""
HITS = """
h AS (SELECT t.conv_id AS query_id, c.*, (t.conv_id + t.turn) * 37 % 100 / 100.0::DOUBLE AS rerank_score,
    row_number() OVER (PARTITION BY t.conv_id ORDER BY (t.conv_id + t.turn) * 37 % 100 DESC,
      c.chunk_key) AS hit_rank
  FROM conversations t JOIN c ON c.doc_id = t.conv_id + t.turn)"""
CONV = """
cq AS (SELECT conv_id AS query_id, coalesce(string_agg(text, ' ' ORDER BY turn)
    FILTER (role = 'user'), '') AS question FROM conversations GROUP BY conv_id)"""
RESP = """
resp AS (SELECT query_id, string_agg(['**Answer:** ', '**how it works:** ',
      '**Where to look next:** ', ''][least(k, 4)] || text || ' [' || turn || ']',
      chr(10) ORDER BY turn) || chr(10) || '  Citations:' || chr(10) || '[1] somewhere' AS response
  FROM (SELECT conv_id AS query_id, turn, text, row_number() OVER (
      PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant')
  GROUP BY query_id)"""
STRIPPED = """
ans AS (SELECT query_id, CASE WHEN regexp_matches(response, '(?im)^[ \\t]*citations')
  THEN regexp_replace(regexp_replace(response, '(?ims)^[ \\t]*citations.*\\z', ''), '\\s+\\z', '')
  ELSE response END AS answer FROM resp)"""
LABELLED = """
lb AS (SELECT * EXCLUDE (doc_id), '[' || hit_rank || ']' AS label FROM h WHERE hit_rank <= 8),
cit AS (SELECT lb.* FROM lb JOIN resp USING (query_id) WHERE contains(response, label))"""


def section(text: str, start: str, header: str, end: str) -> str:
    after = f"regexp_extract({text}, '{start}{header}(.*)\\z', 1)"
    return (f"CASE WHEN regexp_matches({text}, '{start}{header}') THEN regexp_replace("
            f"regexp_replace({after}, '{end}', ''), '\\A\\s+|\\s+\\z', '', 'g') END")


def answer_part(key: str) -> str:
    heads = "|".join(M.ANSWER_HEADERS.values())
    return section("answer", r"(?is)\A.*", rf"\*\*{M.ANSWER_HEADERS[key]}:\*\*",
                   rf"(?is)\*\*(?:{heads}):\*\*.*\z")


def briefing_part(key: str) -> str:
    heads = "|".join(M.BRIEFING_HEADERS.values())
    return section("briefing", r"(?ims)\A(?:.*^)?", rf"{M.BRIEFING_HEADERS[key]}[ \t]*$",
                   rf"(?ims)^(?:{heads})[ \t]*$.*\z")


FILES = """
fl AS (SELECT lang AS repo_id, '/' || lang || '/' || source || '/doc_' || doc_id || '.py' AS file_path,
  text, doc_id, strlen(text) AS length FROM documents),
oh AS (SELECT repo_id, file_path, sha256(text || CASE WHEN toxic = 1 THEN 'x' ELSE '' END) AS sha256
    FROM fl JOIN labels USING (doc_id)
  UNION ALL SELECT 'en', '/en/pages/p_' || page_id || '.js', sha256(html) FROM pages),
ch AS (SELECT fl.repo_id, fl.file_path, sha256(text) AS sha256, CASE WHEN oh.sha256 IS NULL THEN 'new'
    WHEN oh.sha256 = sha256(text) THEN 'unchanged' ELSE 'changed' END AS status, length
  FROM fl LEFT JOIN oh USING (repo_id, file_path)),
gone AS (SELECT repo_id, file_path FROM oh ANTI JOIN fl USING (repo_id, file_path)),
stale AS (SELECT repo_id, file_path FROM ch WHERE status <> 'unchanged'
  UNION ALL SELECT * FROM gone),
kept AS (SELECT repo_id, file_path, unnest([1, 9]) AS start_line FROM oh
  ANTI JOIN stale USING (repo_id, file_path))"""
LABELS_OF = """coalesce((SELECT string_agg(label, ',' ORDER BY hit_rank) FROM cit
    WHERE cit.query_id = cq.query_id), '')"""

ORACLE |= {
    "FLT_1_ignored_dirs": with_(PATHS) + f"""
SELECT doc_id, rel FROM ps WHERE len(list_filter(dirs,
  lambda d: d IN {_in(M.IGNORED_DIRS)} OR starts_with(d, '.'))) = 0""",
    "FLT_2_test_code": with_(PATHS) + f"""
SELECT doc_id, rel FROM ps WHERE len(list_filter(dirs, lambda d: lower(d) IN {_in(M.TEST_DIRS)})) = 0
  AND NOT starts_with(stem, 'test_') AND NOT suffix(stem, '_test')""",
    "FLT_3_extensions": with_(PATHS) + f"""
SELECT doc_id, rel FROM ps WHERE suffix IN {_in(M.SOURCE_EXTENSIONS)}""",
    "FLT_4_file_size": with_(PATHS) + "\nSELECT doc_id, rel FROM ps WHERE length <= 512000",
    "FLT_5_path_prefix": with_(PATHS) + "\nSELECT doc_id, rel FROM ps WHERE starts_with(lower(rel), 'src')",
    "PRJ_1_relative_path": with_(PATHS) + """
SELECT doc_id, CASE WHEN starts_with(path, '/r/en/') THEN path[7:] ELSE path END AS rel_en FROM ps""",
    "PRJ_2_display_path": with_(PATHS) + """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN rel ELSE parts[-2] || '/' || parts[-1] END AS display FROM ps""",
    "PRJ_3_search_text": with_(CHUNKS) + "\nSELECT chunk_key, search_text FROM c",
    "PRJ_4_language": with_(PATHS) + """
SELECT doc_id, CASE lower(suffix) WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript'
  WHEN '.tsx' THEN 'tsx' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' END AS language
FROM ps""",
    "PRJ_5_confidence": with_(CHUNKS, HITS) + """
SELECT query_id, CASE WHEN rerank_score >= 0.4 THEN 'high' WHEN rerank_score >= 0.05
  THEN 'medium' ELSE 'low' END AS confidence FROM h WHERE hit_rank = 1""",
    "PRJ_6_keyword_tokens": with_(QUESTIONS) + f"""
SELECT query_id, array_to_string({tokens('question', 2)}, '|') AS tokens FROM q""",
    "PRJ_7_rerank_tokens": with_(QUESTIONS) + f"""
SELECT query_id, array_to_string({tokens('question', 1)}, '|') AS tokens FROM q""",
    "SNK_2_hit_report": with_(CHUNKS, HITS, CONV) + """
SELECT cq.query_id, coalesce(string_agg('── Result ' || hit_rank || ' ──────────────────────────────'
  || chr(10) || 'File:     ' || file_rel_path || chr(10) || 'Function: ' || name || '  (lines '
  || start_line || '–' || end_line || ')' || chr(10) || 'Score:    ' || printf('%.4f', rerank_score)
  || chr(10) || chr(10) || source || chr(10), chr(10) ORDER BY hit_rank), 'No results found.') AS report
FROM cq LEFT JOIN h USING (query_id) GROUP BY cq.query_id""",
    "TXT_1_prompts": with_(CHUNKS, HITS, CONV) + """
SELECT query_id, string_agg('CHUNK [' || hit_rank || ']' || chr(10) || 'File: ' || file_rel_path
  || '  Lines: ' || start_line || '-' || end_line || chr(10) || 'Function: '
  || coalesce(parent_class || '.', '') || name || chr(10) || '---' || chr(10) || source,
  chr(10) || chr(10) ORDER BY hit_rank) || chr(10) || chr(10) || 'QUESTION: ' || any_value(question)
  || chr(10) || chr(10) || 'ANSWER (cite chunks inline using [1], [2] etc.):' AS prompt
FROM h JOIN cq USING (query_id) WHERE hit_rank <= 8 GROUP BY query_id""",
    "TXT_2_caution": with_(CHUNKS, HITS) + """
SELECT query_id, rerank_score AS top_score, rerank_score < 0.4 AS needs_caution FROM h WHERE hit_rank = 1""",
    "TXT_3_citations": with_(CHUNKS, HITS, RESP, LABELLED) + """
SELECT query_id, label, file_rel_path, name, parent_class, is_truncated, start_line, end_line FROM cit""",
    "TXT_4_strip_citations": with_(RESP, STRIPPED) + "\nSELECT query_id, answer FROM ans",
    "TXT_5_answer_sections": with_(RESP, STRIPPED) + f"""
SELECT query_id, coalesce({answer_part('answer')}, answer) AS answer,
  {answer_part('how_it_works')} AS how_it_works, {answer_part('where_to_look')} AS where_to_look FROM ans""",
    "TXT_6_briefing_sections": "WITH br AS (SELECT conv_id AS query_id, string_agg("
    + "coalesce(CASE WHEN conv_id % 2 = 0 THEN lower(hd) ELSE hd END || '  ' || chr(10), '') || text,"
    + " chr(10) ORDER BY turn) AS briefing FROM (SELECT *, "
    + _list(M.BRIEFING_HEADERS.values()) + "[row_number() OVER (PARTITION BY conv_id ORDER BY turn)] AS hd"
    + " FROM conversations) GROUP BY conv_id) SELECT query_id, "
    + ", ".join(f"{briefing_part(k)} AS {k}" for k in M.BRIEFING_HEADERS) + " FROM br",
    "TXT_7_narration_input": rec(CHUNKS, EDGES, trace_sql(NAMES), TREE) + """
, cl AS (SELECT e.repo_id, e.dst_name AS symbol, c.chunk_key, c.name, c.file_rel_path, c.start_line,
    row_number() OVER (PARTITION BY e.repo_id, e.dst_name ORDER BY c.chunk_key) AS r
  FROM e JOIN c USING (repo_id, chunk_key) QUALIFY r <= 5),
cs AS (SELECT repo_id, symbol, string_agg('  ' || name || '  [' || file_rel_path || ':' || start_line
    || ']', chr(10) ORDER BY r) AS body FROM cl GROUP BY ALL)
SELECT repo_id, symbol, 'SYMBOL: ' || symbol || chr(10) || chr(10) || 'FORWARD CALL TREE:' || chr(10)
  || tree || chr(10) || chr(10) || 'CALLERS OF ' || symbol || ':' || chr(10)
  || coalesce(body, '  (no callers found in index)') AS context
FROM tree LEFT JOIN cs USING (repo_id, symbol)""",
    "TXT_8_answer_records": with_(CHUNKS, HITS, CONV, RESP, STRIPPED, LABELLED) + f"""
, u AS (SELECT query_id, count(*) AS chunks_used FROM lb GROUP BY ALL),
t AS (SELECT query_id, rerank_score FROM h WHERE hit_rank = 1)
SELECT query_id, coalesce(chunks_used, 0) AS chunks_used,
  CASE WHEN chunks_used IS NULL THEN 'No relevant code found for this query.'
    ELSE coalesce(answer, '') END AS answer,
  CASE WHEN chunks_used IS NOT NULL THEN {answer_part('how_it_works')} END AS how_it_works,
  CASE WHEN chunks_used IS NULL THEN 'low' WHEN rerank_score >= 0.4 THEN 'high'
    WHEN rerank_score >= 0.05 THEN 'medium' ELSE 'low' END AS confidence, {LABELS_OF} AS labels
FROM cq LEFT JOIN u USING (query_id) LEFT JOIN t USING (query_id) LEFT JOIN ans USING (query_id)""",
    "TXT_9_cited_order": with_(CHUNKS, HITS, RESP, LABELLED) + """
, l AS (SELECT query_id, name, min(hit_rank) AS label_no FROM cit GROUP BY ALL)
SELECT query_id, chunk_key, label_no, row_number() OVER (PARTITION BY query_id
  ORDER BY label_no NULLS LAST, hit_rank) AS position FROM h LEFT JOIN l USING (query_id, name)""",
    "TXT_10_label_mentions": with_(RESP, STRIPPED) + """
SELECT query_id, label_no, count(*) AS mentions FROM (SELECT query_id,
  unnest(regexp_extract_all(answer, '\\[(\\d+)\\]', 1)) AS label_no FROM ans) GROUP BY ALL""",
    "SRC_2_content_hash": with_(FILES) + "\nSELECT file_path, sha256(text) AS sha256 FROM fl",
    "SRC_3_metadata_scan": with_(CHUNKS) + """
SELECT chunk_key, file_rel_path, node_type, name, parent_class, len(calls) AS n_calls, start_line,
  end_line FROM c WHERE starts_with(lower(file_rel_path), 'src1')""",
    "INC_1_change_detection": with_(FILES) + "\nSELECT repo_id, file_path, status FROM ch",
    "INC_1_forced": with_(FILES) + """
SELECT repo_id, file_path, replace(status, 'un', '') AS status FROM ch""",
    "INC_2_kept_chunks": with_(FILES) + "\nSELECT * FROM kept",
    "INC_3_new_hashes": with_(FILES) + """
SELECT repo_id, file_path, sha256 FROM oh ANTI JOIN stale USING (repo_id, file_path)
UNION ALL SELECT repo_id, file_path, sha256 FROM ch WHERE status <> 'unchanged'""",
    "INC_4_orphans": with_(FILES) + "\nSELECT * FROM gone",
    "INC_4_orphans_partial_listing": with_(FILES) + """
SELECT repo_id, file_path FROM oh WHERE repo_id = 'en' AND file_path NOT IN (
  SELECT file_path FROM fl WHERE repo_id = 'en')""",
    "INC_4_orphans_named_repository": with_(FILES) + """
SELECT repo_id, file_path FROM oh WHERE repo_id = 'en'""",
    "INC_6_unreadable": with_(FILES) + """
SELECT repo_id, file_path, file_path || ': ' || CASE WHEN length % 4 = 0
  THEN 'cannot be read (OSError)' ELSE 'content is missing' END AS error
FROM ch WHERE length % 2 = 0""",
    "INC_5_index_stats": with_(FILES) + """
, a AS (SELECT repo_id, count(*) AS total_files, count_if(status <> 'unchanged') AS indexed,
    count_if(status = 'unchanged') AS skipped FROM ch GROUP BY ALL),
b AS (SELECT repo_id, count(*) AS cleaned FROM gone GROUP BY ALL)
SELECT repo_id, coalesce(total_files, 0) AS total_files, coalesce(indexed, 0) AS indexed,
  coalesce(skipped, 0) AS skipped, coalesce(indexed, 0) * 2 AS total_chunks,
  coalesce(cleaned, 0) AS cleaned, 0 AS errors FROM a FULL JOIN b USING (repo_id)""",
    "INC_6_error_rows": with_(FILES) + """
SELECT repo_id, file_path, file_path || ': content is not UTF-8' AS error FROM ch WHERE length % 2 = 1""",
    "INC_7_batched_embedding": with_(CHUNKS) + """
SELECT chunk_key, length(search_text) AS chars, length(search_text) - length(replace(search_text, ' ', ''))
  AS blanks, length(search_text) - length(replace(search_text, chr(10), '')) AS breaks FROM c""",
    "SNK_1_chunk_snapshot": with_(FILES) + """
SELECT * FROM kept UNION ALL SELECT repo_id, file_path, unnest([2, 5]) FROM ch WHERE status <> 'unchanged'""",
}

# --- segmentation: expected rows follow from how the sources are made ------

CODE = f"""
cd AS (SELECT doc_id, lang, source, '/' || lang || '/' || source || '/doc_' || doc_id AS stem,
    list_transform(string_split(text, {NL}),
      lambda x: trim(regexp_replace(x, '[^A-Za-z0-9 ]+', ' ', 'g'))) AS lines FROM documents),
cl AS (SELECT doc_id, stem, len(lines) AS m, line, i,
    'w_' || coalesce(regexp_extract_all(line, '[A-Za-z]{{3,}}')[1], 'none') AS a,
    'w_' || coalesce(regexp_extract_all(line, '[A-Za-z]{{3,}}')[-1], 'none') AS b
  FROM (SELECT *, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM cd)),
py AS (SELECT stem || '.py' AS file_path, 'Doc_' || doc_id AS name, 'class_definition' AS node_type,
    1 AS start_line, 1 AS def_line, 1 + 6 * len(lines) AS end_line, NULL AS parent_class,
    lines[1] AS docstring, doc_id, -1 AS i FROM cd
  UNION ALL SELECT stem || '.py', 'fn_' || i, 'function_definition', 3 + 6 * i, 4 + 6 * i, 7 + 6 * i,
    'Doc_' || doc_id, line, doc_id, i FROM cl),
js AS (SELECT stem || '.ts' AS file_path, 'Doc_' || doc_id AS name, 'class' AS node_type,
    2 AS start_line, 3 + 4 * len(lines) AS end_line, NULL AS parent_class, '' AS calls FROM cd
  UNION ALL SELECT stem || '.ts', 'fn_' || i, 'function', 3 + 4 * i, 5 + 4 * i, 'Doc_' || doc_id,
    CASE WHEN a = b THEN a ELSE a || ',' || b END FROM cl
  UNION ALL SELECT stem || '.ts', 'arrow_' || doc_id, 'function', 4 + 4 * m, 4 + 4 * m, NULL, a
    FROM cl WHERE i = 0)"""
BODY = """
fnsrc AS (SELECT doc_id, i, '@mark(' || i || ')' || chr(10) || '    def fn_' || i || '(self, a="def no():"):'
    || chr(10) || '        ''''''' || line || '''''''' || chr(10) || '        ' || a || '(' || b || '())'
    || chr(10) || '        return x' AS src, '  # call_' || i || '()' AS note FROM cl),
psrc AS (SELECT doc_id, i, src FROM fnsrc UNION ALL
  SELECT doc_id, -1, 'class Doc_' || doc_id || ':' || chr(10) || '    \"\"\"' || any_value(lines[1]) || '\"\"\"'
    || chr(10) || string_agg('    ' || src || CASE WHEN i + 1 < len(lines) THEN note ELSE '' END,
      chr(10) || chr(10) ORDER BY i) FROM fnsrc JOIN cd USING (doc_id)
  GROUP BY doc_id)"""
TOKENS = r"'\w+|[^\w\s]'"

ORACLE |= {
    "CHK_1_python_definitions": with_(CODE) + """
SELECT file_path, name, node_type, start_line, end_line FROM py""",
    "CHK_2_decorators": with_(CODE) + """
SELECT file_path, name, start_line AS first, def_line FROM py""",
    "CHK_3_js_definitions": with_(CODE) + """
SELECT file_path, name, node_type, start_line, end_line FROM js""",
    "CHK_4_parent_class": with_(CODE) + """
SELECT file_path, name, parent_class FROM py UNION ALL SELECT file_path, name, parent_class FROM js""",
    "CHK_5_call_names": with_(CODE) + """
SELECT file_path, name, calls FROM js
UNION ALL SELECT stem || '.py', 'fn_' || i, CASE WHEN a = b THEN a WHEN a < b THEN a || ',' || b
  ELSE b || ',' || a END FROM cl
UNION ALL SELECT stem || '.py', 'Doc_' || doc_id, 'mark,' || string_agg(DISTINCT w, ',' ORDER BY w)
FROM (SELECT doc_id, stem, unnest([a, b]) AS w FROM cl) GROUP BY stem, doc_id""",
    "CHK_6_docstrings": with_(CODE) + "\nSELECT file_path, name, docstring FROM py",
    "CHK_7_token_cap": with_(CODE, BODY) + f"""
SELECT file_path, name, len(t) > 300 AS is_truncated, least(len(t), 300) AS token_count,
  CASE WHEN len(t) > 300 THEN regexp_extract(src, '^(?:\\s*(?:\\w+|[^\\w\\s])){{0,300}}') ELSE src END AS source
FROM (SELECT py.file_path, py.name, p.src, regexp_extract_all(src, {TOKENS}) AS t
  FROM py JOIN psrc p ON p.doc_id = py.doc_id AND p.i = py.i)""",
    "CHK_8_document_segments": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, {NL})) AS line,
    unnest(range(1, len(string_split(text, {NL})) + 1)) AS line_no FROM documents),
p AS (SELECT doc_id, line_no, unnest(pc) AS piece, unnest(range(len(pc))) AS j FROM (
    SELECT *, regexp_extract_all(line, '(?:\\s*(?:\\w+|[^\\w\\s])){{1,150}}\\s*') AS pc FROM l)),
n AS (SELECT *, len(regexp_extract_all(piece, {TOKENS})) AS n FROM p),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY line_no, j
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 150 AS segment FROM n)
SELECT doc_id, segment, min(line_no) AS start_line, max(line_no) AS end_line,
  sum(n)::BIGINT AS token_count, string_agg(body, {NL} ORDER BY line_no) AS source
FROM (SELECT doc_id, segment, line_no, sum(n) AS n, string_agg(piece, '' ORDER BY j) AS body
  FROM s GROUP BY ALL) GROUP BY doc_id, segment""",
    "CHK_9_chunk_keys": with_(CODE) + """
SELECT file_path || ':' || start_line AS chunk_key FROM py
UNION ALL SELECT file_path || ':' || start_line FROM js""",
    "IDX_build_index": with_(CODE) + """
, k AS (SELECT lang AS repo_id, doc_id IN (SELECT doc_id FROM labels) AS known, len(lines) AS m
  FROM cd)
SELECT repo_id, count(*) * 2 AS total_files, count(*) * 2 - count_if(known) AS indexed,
  count_if(known) AS skipped, sum(m + 2)::BIGINT + coalesce(sum(m + 1) FILTER (NOT known), 0)::BIGINT
  AS total_chunks, 0 AS cleaned, 0 AS errors FROM k GROUP BY repo_id""",
}

ORACLE["SRC_1_scan_and_filter"] = with_(PATHS) + f"""
SELECT doc_id, rel FROM ps WHERE length <= 512000 AND suffix IN {_in(M.SOURCE_EXTENSIONS)}
  AND len(list_filter(dirs, lambda d: d IN {_in(M.IGNORED_DIRS)} OR starts_with(d, '.')
    OR lower(d) IN {_in(M.TEST_DIRS)})) = 0
  AND NOT starts_with(stem, 'test_') AND NOT suffix(stem, '_test')"""

ORACLE["SNK_1_touched_buckets"] = with_(CHUNKS) + """
, keyed AS (
  SELECT c.*, ('0x' || left(sha256(repo_id || '/' || file_path || '/' || doc_id), 8))::BIGINT % 64
    AS bucket, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 1) AS bad FROM c)
SELECT bucket, count(*) AS n_files, sum(CASE WHEN bad THEN 0 ELSE length(source) END)::BIGINT AS chars,
  bool_or(bad) AS written FROM keyed GROUP BY bucket"""

ORACLE["INC_S_unreadable"] = """
WITH f AS (
  SELECT lang AS repo_id, '/' || lang || '/' || source || '/doc_' || doc_id || '.py' AS file_path,
    doc_id, text, strlen(text) AS size FROM documents)
SELECT repo_id, file_path, sha256(text) AS sha256, CASE WHEN quality = 0 THEN file_path || ': ' ||
  CASE WHEN doc_id % 2 = 0 THEN 'cannot be read (OSError)' ELSE 'content is missing' END END AS error
FROM f LEFT JOIN labels USING (doc_id)
WHERE coalesce(toxic, 0) = 0 AND size <= 512000"""

ORACLE["SRC_1_scan_contents"] = """
SELECT lang || '/' || source || '/doc_' || doc_id || '.py' AS file_rel_path, strlen(text) AS length,
  sha256(text) AS sha256 FROM documents WHERE strlen(text) <= 512000"""
