"""Schemas and fixed values shared by every operator."""

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

FILES = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_rel_path", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

# What a scan gives: error says why a content is missing.
SCANNED_FILES = T.StructType([*FILES.fields, T.StructField("error", T.StringType())])

CHUNKS = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("chunk_key", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_rel_path", T.StringType()),
    T.StructField("node_type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("calls", T.ArrayType(T.StringType())),
    T.StructField("docstring", T.StringType()),
    T.StructField("parent_class", T.StringType()),
    T.StructField("is_truncated", T.BooleanType()),
    T.StructField("search_text", T.StringType()),
])

HASHES = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("sha256", T.StringType()),
])

# ---------------------------------------------------------------------------
# Results depend on these being exactly as listed.
# ---------------------------------------------------------------------------

IGNORED_DIRS = [
    ".git", ".hg", ".svn", "__pycache__", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", "node_modules", "venv", ".venv", "env", "dist", "build",
    ".next", ".nuxt", "target", "vendor",
]
TEST_DIRS = [
    "tests", "test", "__tests__", "__mocks__", "spec", "specs", "e2e",
    "fixtures",
]
SOURCE_EXTENSIONS = [".py", ".ts", ".tsx", ".js", ".jsx"]
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".ts": "typescript", ".tsx": "tsx",
    ".js": "javascript", ".jsx": "javascript",
}
MAX_FILE_BYTES = 500 * 1024
CHUNK_TOKEN_CAP = 300
EMBED_BATCH = 100

RETRIEVE_N = 10
RETURN_N = 5
RRF_K = 60
EXPAND_N = 3
EXPANSION_SCORE = 0.005
# Boosts in hundredths (0.30, 0.20, 0.15, 0.10), so that sums are exact.
BOOST_NAME, BOOST_STEM, BOOST_DOC, BOOST_CALL = 30, 20, 15, 10
CONFIDENCE_HIGH, CONFIDENCE_MEDIUM = 0.4, 0.05
PROMPT_CHUNKS = 8
TOKEN_STRIP_CHARS = ".,?!:;\"'()[]{}"

ENTRY_FILES = [
    "main.py", "app.py", "__main__.py", "index.py", "server.py", "cli.py",
    "run.py", "manage.py", "index.ts", "index.js", "server.ts", "server.js",
    "app.ts", "app.js", "main.ts", "main.js",
]
ENTRY_FUNCTIONS = [
    "main", "run", "start", "create_app", "init", "setup", "bootstrap",
    "serve", "launch",
]
BUILTIN_NAMES = [
    "get", "append", "extend", "update", "pop", "remove",
    "len", "str", "int", "float", "bool", "list", "dict",
    "set", "tuple", "print", "range", "enumerate", "zip",
    "map", "filter", "sorted", "reversed", "isinstance",
    "hasattr", "getattr", "setattr", "open", "read", "write",
    "join", "split", "strip", "lstrip", "rstrip", "format",
    "replace", "encode", "decode", "items", "keys", "values",
    "Path", "resolve", "exists", "mkdir", "unlink", "stat",
    "any", "all", "next", "iter", "sum", "min", "max",
    "super", "vars", "dir", "type", "id", "hash", "repr",
    "lower", "upper", "startswith", "endswith", "count",
    "push", "forEach", "find", "findIndex", "includes",
    "indexOf", "slice", "splice", "concat", "reduce",
    "JSON", "Promise", "console", "Object", "Array",
    "parseInt", "parseFloat", "toString", "valueOf",
    "addEventListener", "querySelector", "getElementById",
    "fetch", "then", "catch", "finally",
    "trim", "trimStart", "trimEnd",
    "add", "delete", "upsert", "query", "peek",
    "get_or_create_collection", "get_collection",
    "create_collection", "modify",
]
TOUR_CHUNKS, ENTRY_CAP, TOP_FUNCTIONS = 8, 3, 5
PREVIEW_LINES, PREVIEW_DOC_CHARS = 20, 200
TRACE_DEPTH, TRACE_NODES = 3, 20
TRACE_CALLERS = 5

ANSWER_HEADERS = {
    "answer": "Answer",
    "how_it_works": "How it works",
    "where_to_look": "Where to look next",
}
BRIEFING_HEADERS = {
    "overview": "OVERVIEW",
    "entry_points": "ENTRY POINTS",
    "major_modules": "MAJOR MODULES",
    "key_abstractions": "KEY ABSTRACTIONS",
    "start_here": "START HERE",
}
NO_HITS_ANSWER = "No relevant code found for this query."
NO_HITS_REPORT = "No results found."
NO_CALLERS = "  (no callers found in index)"
CAUTION_NOTE = (
    "\n\nNote: the match between question and chunks is weak. State only what "
    "the chunks show and say where to look for the rest."
)
