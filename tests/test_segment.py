"""Chunking of source snippets: Python, JavaScript, TypeScript."""

import pytest
from pyspark.sql import functions as F

from sparklode.operators.segment import chunk_files


@pytest.fixture(scope="module")
def chunks(spark):
    """All snippets in one job; rows per file in start order."""
    rows = [("r", f"/r/{name}", name, text.encode()) for name, text in SNIPPETS.items()]
    df = spark.createDataFrame(
        rows, "repo_id string, file_path string, file_rel_path string, content binary")
    out = {}
    for r in chunk_files(df).orderBy("start_line", "chunk_key").collect():
        out.setdefault(r["file_rel_path"], []).append(r)
    return out


LONG = "def big():\n" + "".join(f"    x_{i} = {i}\n" for i in range(200))
SNIPPETS = {
    "three.py": "def foo():\n    pass\n\ndef bar():\n    pass\n\n# note\ndef baz():\n    pass\n",
    "klass.py": 'class A(B):\n    """Doc of A."""\n\n    def one(self):\n        return two()\n\n'
                "    @property\n    def two(self):\n        '''Second.'''\n        return 2\n\nx = 1\n",
    "inner.py": "def outer():\n    def inner():\n        helper()\n    class K:\n        def m(self):\n"
                "            pass\n    return inner()\n\nif True:\n    async def cond(a,\n    b):\n        go(a)\n",
    "module.py": "x = 1\nprint(x)\n",
    "empty.py": "",
    "strings.py": 'def f():\n    x = """\ndef fake():\nclass Fake:\n"""\n    return run(x)  # call()\n\n\n'
                  "def g(): return h()\n",
    "calls.py": "def f():\n    zebra()\n    alpha()\n    obj.mango(1)\n    if (x):\n        alpha()\n",
    "deco.py": "import a\n\n@wrap(\n    1)\n@b\ndef f():\n    inner()\n",
    "nested.py": "class A:\n    class B:\n        def m(self):\n            pass\n    def n(self):\n        pass\n",
    "raw.py": "def f():\n    r'''Raw doc.'''\n\ndef g():\n    x = 'no doc'\n\ndef h():\n    'a' + 'b'\n",
    "big.py": LONG,
    "decl.js": "function greet(name) {\n  if (name) { console.log(name); }\n  return format(name);\n}\n",
    "arrow.js": "const add = (a, b) => a + b;\nconst run = async ({ x }) => {\n  go(x);\n};\nlet one = y => two(y)\n",
    "expr.js": "const f = function (a) {\n  return a;\n};\ng = function () { h(); };\nobj.k = function () { m(); };\n",
    "class.js": "class Animal extends Base {\n  field = () => { no(); };\n  constructor(a) { super(a); }\n"
                "  async speak(x) {\n    return this.say(x);\n  }\n}\n",
    "cb.js": "items.map(function (x) { return deep(x); });\nitems.forEach((x) => { const q = () => 1; });\n"
             "function after() {}\n",
    "one.js": "class Foo { bar() { baz(); } }\n",
    "comp.tsx": "export function App(props: Props): JSX.Element {\n  const s = useState(0);\n"
                "  return <div>{s}</div>;\n}\n",
    "typed.ts": "export class Svc {\n  private load(id: number): Promise<void> {\n    return get(id);\n  }\n}\n"
                "export const pick = (a: string): string => {\n  return cut(a);\n};\n",
    "soft.py": "def f(x):\n    match (x):\n        case (1):\n            one(x)\n    match(x)\n",
    "fstring.py": "def f(x):\n    return f\"{helper(x)} {{no(x)}} {x!r}\" + 'text(x)'\n",
    "unclosed.py": "def a():\n    x = foo(1,\n\ndef b():\n    go()\n\nclass C:\n    def m(self): pass\n",
    "deep.py": "def f(a=g(h(i(j(k(l(1))))))):\n    'Doc.'\n    return run(a)\n",
    "objtype.ts": "function f(a: string): { ok: boolean } {\n  return go(a);\n}\n"
                  "const g = (a): { ok: { x: number } } => {\n  run(a);\n};\n"
                  "function p(): Promise<{a: string}> {\n  return q();\n}\n",
    "mixin.ts": "class A extends mixin(Base) {\n  m() { a(); }\n}\n"
                "class D extends Comp<{a: string}> {\n  n() { b(); }\n}\n",
    "deep.js": "function f(a = g(h(i(j(k(1)))))) {\n  return m(a);\n}\n",
    "text.jsx": "function V(p) {\n  return <ul>{p.ok && <p>Don't</p>}<li>http://a.b</li></ul>;\n}\n"
                "function W() {\n  w();\n}\n",
    "tmpl.js": "class T {\n  #p() { return 1; }\n  q(x) {\n    return `v ${load(x)} ${no\n}` + this.#p();\n  }\n}\n",
    "fquote.py": "def f(d):\n    return f\"{d[\"k\"]} {helper(d, {'a': g(1)})} {x:>{w()}}\"\n",
    "match.py": "def f(x):\n    if re.match('a', x):\n        pass\n    while case(x):\n        pass\n"
                "def g(x):\n    return [c for c in match(x)]\n",
    "lost.py": "class C:\n    def m(self):\n        x = foo(1,\n    def n(self):\n        'Doc.'\n"
               "        return bar(x)\n",
    "depth.py": "def f(a=" + "g(" * 40 + "1" + ")" * 40 + "):\n    'Doc.'\n    return run(a)\n",
    "regex.js": "function a() {\n  return x => /[\"']/.test(x);\n}\nfunction b() {\n  if (q) /[(`]/.exec(c());\n"
                "  return 1 / d() / 2;\n}\nconst e = a => /\\//g.test(a);\nfunction c() { d(); }\n",
    "lost.js": "function a() {\n  foo(1;\n}\nfunction b() {\n  if (x) { y();\n}\nfunction c() { z(); }\n",
    "tmpl2.js": "function t(x) {\n  return `v ${load(x, `in ${deep(\"}\")} `)} ${[1].map(y => { return up(y); })}`;\n}\n"
                "function u() { w(); }\n",
    "tag.jsx": "const V = (p) => {\n  const n = a < b;\n  return <F a=\"}\" on={() => go('}')}>it's (x) {p.ok ? <b/> : f(1)}"
               "</F>;\n};\nfunction W() { w(); }\n",
    "notes.md": "def f():\n    pass\n",
}


def names(rows):
    return [r["name"] for r in rows]


def test_python_functions_in_order(chunks):
    rows = chunks["three.py"]
    assert names(rows) == ["foo", "bar", "baz"]
    assert [(r["start_line"], r["end_line"]) for r in rows] == [(1, 2), (4, 5), (8, 9)]


def test_class_with_methods(chunks):
    a, one, two = chunks["klass.py"]
    assert (a["name"], a["node_type"], a["parent_class"], a["docstring"]) == (
        "A", "class_definition", None, "Doc of A.")
    assert (one["name"], one["parent_class"], one["calls"]) == ("one", "A", ["two"])
    assert (two["start_line"], two["end_line"], two["docstring"]) == (7, 10, "Second.")
    assert two["source"].startswith("@property") and a["end_line"] == 10


def test_functions_are_not_descended(chunks):
    outer, cond = chunks["inner.py"]
    assert (outer["name"], outer["calls"]) == ("outer", ["helper", "inner"])
    assert (cond["name"], cond["start_line"], cond["end_line"]) == ("cond", 10, 12)


@pytest.mark.parametrize("name", ["module.py", "empty.py", "notes.md"])
def test_no_rows(chunks, name):
    assert name not in chunks


def test_strings_hide_definitions(chunks):
    f, g = chunks["strings.py"]
    assert (f["name"], f["end_line"], f["calls"]) == ("f", 6, ["run"])
    assert (g["start_line"], g["end_line"]) == (9, 9)


def test_calls_sorted_and_distinct(chunks):
    assert chunks["calls.py"][0]["calls"] == ["alpha", "mango", "zebra"]


def test_decorators_belong_to_chunk_but_not_to_calls(chunks):
    (f,) = chunks["deco.py"]
    assert (f["start_line"], f["calls"]) == (3, ["inner"])


def test_nearest_class(chunks):
    assert [(r["name"], r["parent_class"]) for r in chunks["nested.py"]] == [
        ("A", None), ("B", "A"), ("m", "B"), ("n", "A")]


def test_docstring_forms(chunks):
    assert [r["docstring"] for r in chunks["raw.py"]] == ["Raw doc.", None, None]


def test_token_cap(chunks):
    (big,) = chunks["big.py"]
    assert big["token_count"] == 300 and big["is_truncated"]
    assert LONG.startswith(big["source"]) and big["end_line"] == 201


def test_js_declaration(chunks):
    (f,) = chunks["decl.js"]
    assert (f["name"], f["node_type"], f["start_line"], f["end_line"]) == ("greet", "function", 1, 4)
    assert f["calls"] == ["log", "format"] and f["docstring"] == ""


def test_js_arrows(chunks):
    add, run, one = chunks["arrow.js"]
    assert add["source"] == "(a, b) => a + b"
    assert (run["name"], run["start_line"], run["end_line"], run["calls"]) == ("run", 2, 4, ["go"])
    assert (one["name"], one["source"]) == ("one", "y => two(y)")


def test_js_function_expressions(chunks):
    assert names(chunks["expr.js"]) == ["f", "g"]


def test_js_class(chunks):
    rows = chunks["class.js"]
    assert [(r["name"], r["parent_class"]) for r in rows] == [
        ("Animal", None), ("constructor", "Animal"), ("speak", "Animal")]
    assert [(r["start_line"], r["end_line"]) for r in rows] == [(1, 7), (3, 3), (4, 6)]
    assert rows[0]["calls"] == [] and rows[2]["calls"] == ["say"]


def test_js_callbacks_give_no_row(chunks):
    assert names(chunks["cb.js"]) == ["after"]


def test_js_chunks_on_one_line_have_distinct_keys(chunks):
    rows = chunks["one.js"]
    assert sorted(names(rows)) == ["Foo", "bar"]
    assert len({r["chunk_key"] for r in rows}) == 2


def test_tsx_and_ts(chunks):
    assert names(chunks["comp.tsx"]) == ["App"]
    assert [(r["name"], r["parent_class"]) for r in chunks["typed.ts"]] == [
        ("Svc", None), ("load", "Svc"), ("pick", None)]


def test_search_text(chunks):
    assert chunks["one.js"][0]["search_text"].startswith("file: one.js\n\nclass: Foo\n\n")


def test_soft_keywords_and_f_strings(chunks):
    assert chunks["soft.py"][0]["calls"] == ["match", "one"]
    assert chunks["fstring.py"][0]["calls"] == ["helper"]


def test_python_recovers_after_an_unclosed_bracket(chunks):
    assert names(chunks["unclosed.py"]) == ["a", "b", "C", "m"]
    assert chunks["deep.py"][0]["docstring"] == "Doc."


def test_ts_object_types(chunks):
    assert [(r["name"], r["start_line"], r["end_line"], r["calls"]) for r in chunks["objtype.ts"]] == [
        ("f", 1, 3, ["go"]), ("g", 4, 6, ["run"]), ("p", 7, 9, ["q"])]


def test_ts_heritage_expressions(chunks):
    assert [(r["name"], r["parent_class"], r["start_line"], r["end_line"]) for r in chunks["mixin.ts"]] == [
        ("A", None, 1, 3), ("m", "A", 2, 2), ("D", None, 4, 6), ("n", "D", 5, 5)]


def test_js_deep_parameters_text_and_templates(chunks):
    (f,) = chunks["deep.js"]
    assert f["name"] == "f" and f["end_line"] == 3 and "m" in f["calls"]
    assert [(r["name"], r["start_line"], r["end_line"]) for r in chunks["text.jsx"]] == [
        ("V", 1, 3), ("W", 4, 6)]
    q = [r for r in chunks["tmpl.js"] if r["name"] == "q"][0]
    assert q["calls"] == ["load", "#p"]


def test_strings_in_f_strings(chunks):
    assert chunks["fquote.py"][0]["calls"] == ["g", "helper", "w"]


def test_calls_of_names_that_are_soft_keywords(chunks):
    f, g = chunks["match.py"]
    assert f["calls"] == ["case", "match"] and g["calls"] == ["match"]


def test_python_methods_after_an_unclosed_bracket(chunks):
    c, m, n = chunks["lost.py"]
    assert (m["name"], m["calls"], m["end_line"]) == ("m", ["foo"], 3)
    assert (n["name"], n["calls"], n["docstring"], n["parent_class"]) == ("n", ["bar"], "Doc.", "C")
    assert chunks["depth.py"][0]["docstring"] == "Doc."


def test_js_regex_literals(chunks):
    assert [(r["name"], r["calls"]) for r in chunks["regex.js"]] == [
        ("a", ["test"]), ("b", ["exec", "c", "d"]), ("e", ["test"]), ("c", ["d"])]


def test_js_definitions_after_an_unclosed_bracket(chunks):
    assert names(chunks["lost.js"])[-1] == "c" and "a" in names(chunks["lost.js"])
    assert chunks["lost.js"][-1]["calls"] == ["z"]


def test_js_templates_and_tags_at_any_depth(chunks):
    t, u = chunks["tmpl2.js"]
    assert t["calls"] == ["load", "deep", "map", "up"] and u["calls"] == ["w"]
    v, w = chunks["tag.jsx"]
    assert (v["name"], v["calls"], v["end_line"]) == ("V", ["go", "f"], 4)
    assert (w["name"], w["calls"]) == ("W", ["w"])


def test_masking_keeps_every_position():
    import random
    from sparklode.functions.lex import scan_js, scan_python
    r = random.Random(2)
    parts = ["f'", '"', "'", '"""', "`", "${", "{", "}", "(", ")", "[", "]", "<a>", "</a>", "<b", "/>",
             "/", "//", "#", "\\", "\n", "return ", "x", " ", "é", ":", "=", "{{"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        for masked in (scan_python(text), scan_js(text, True), scan_js(text, False)):
            assert len(masked) == len(text)
            assert [i for i, c in enumerate(masked) if c == "\n"] == [
                i for i, c in enumerate(text) if c == "\n"]
            for o, c in ("()", "[]", "{}"):
                assert masked.count(o) == masked.count(c)


def test_masking_is_linear():
    import time
    from sparklode.functions.lex import scan_js, scan_python
    for unit, scan in (("class A:\n    def f(self):\n        return g(x, f'{h(x)}')\n", scan_python),
                       ("class T { f(a) { return `x ${go(a)}` + /a'b/.test(c); } }\n",
                        lambda t: scan_js(t, True)), ("a = <b>{", lambda t: scan_js(t, True)),
                       ("foo([", scan_python), ("f'{", scan_python)):
        start = time.time()
        scan(unit * (500 * 1024 // len(unit)))
        assert time.time() - start < 10


def test_long_documents_are_segmented_in_linear_time(spark):
    import time
    from sparklode.operators.segment import segment_documents

    def seconds(lines):
        docs = spark.createDataFrame([(1, "one two three\n" * lines)], "doc_id long, text string")
        start = time.time()
        assert segment_documents(docs).selectExpr("sum(token_count)").first()[0] == 3 * lines
        return time.time() - start
    seconds(1000)
    assert seconds(64_000) < 8 * max(seconds(16_000), 0.7)


def test_masking_holds_a_part_of_a_batch():
    """Beside the Arrow columns a task has the strings of a few texts, not of the whole batch."""
    import tracemalloc
    import pyarrow as pa
    from sparklode.functions import lex
    texts = pa.array([f"x = '{'a' * 12_000}'\n"] * 1_000 + [None])   # 12 MB
    langs = pa.array(["python"] * 1_001)
    tracemalloc.start()
    (masked,) = lex._mask.func(iter([(texts, langs)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert masked[0].as_py() == lex.scan_python(texts[0].as_py()) and masked[1_000].as_py() is None
    assert masked[999] == masked[0] and peak < 6_000_000


def test_brackets_in_which_nothing_begins_are_one_mark(spark):
    """Calls with their arguments make one row of the table of marks, not one per bracket."""
    from sparklode.operators import segment_js as J
    text = "function f(a) {\n  return g(h(a, b), [1](i(2)));\n}\n"
    one = spark.createDataFrame([(text,)], "masked string")
    for pattern in (J._MARK, J._BLOCK_MARK):
        (marks,) = one.select(F.regexp_extract_all("masked", F.lit(f"({pattern})"), F.lit(1))).first()
        assert "".join(marks) == text and marks[:2] == ["function f(a) ", "{"]
        assert "(h(a, b), [1](i(2)))" not in marks and "(h(a, b), " not in marks
    plain = text.replace("[1](i(2))", "i(2)")
    for pattern in (J._MARK, J._BLOCK_MARK):
        (marks,) = spark.createDataFrame([(plain,)], "masked string").select(
            F.regexp_extract_all("masked", F.lit(f"({pattern})"), F.lit(1))).first()
        assert "".join(marks) == plain and "(h(a, b), i(2))" in marks


def test_groups_end_no_definition(spark):
    """What is folded into one mark changes no end, level or line."""
    files = spark.createDataFrame([("r", f"/r/{n}", n, t.encode()) for n, t in {
        "a.js": "class K {\n  m(a) {\n    go(a,\n      up(a), x);\n    return at(() => { in_(a); });\n  }\n}\n"
                "const f = (a) => call(a, b(1), c(2)), g = y => (y, z(y));\nfunction h() { (w)(w(), 1); }\n",
        "b.js": "function p(a = (1, 2)) {\n  if (q(a)) { r((a), s(a)); }\n}\nfunction t() {}\n"}.items()],
        "repo_id string, file_path string, file_rel_path string, content binary")
    got = {(r["name"], r["parent_class"], r["start_line"], r["end_line"], tuple(r["calls"]))
           for r in chunk_files(files).collect()}
    assert got == {("K", None, 1, 7, ()), ("m", "K", 2, 6, ("go", "up", "at", "in_")),
                   ("f", None, 8, 8, ("call", "b", "c")), ("g", None, 8, 8, ("z",)), ("h", None, 9, 9, ("w",)),
                   ("p", None, 1, 3, ("q", "r", "s")), ("t", None, 4, 4, ())}


def test_test_sources_are_made_quickly(spark, tmp_path):
    """Cleaning texts in several threads takes no more than a small multiple of searching them."""
    import time
    from checks import views as V
    d = spark.createDataFrame([(i, "größe été 12-ab\n" * 125_000, "de", "s") for i in range(8)],
                              "doc_id long, text string, lang string, source string")
    d.repartition(8).write.parquet(f"{tmp_path}/documents.parquet")

    def seconds(df):
        times = []
        for _ in range(2):
            start = time.time()
            df.write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        return min(times)
    words = spark.read.parquet(f"{tmp_path}/documents.parquet").select(
        F.regexp_extract_all("text", F.lit(r"(\p{Alnum}+)"), F.lit(1)))
    lines = V._code_lines(spark, str(tmp_path)).select("lines")
    assert lines.first()[0][0] == "gr e  t  12 ab"
    assert seconds(lines) < 4 * max(seconds(words), 0.3)


def test_marks_are_not_shuffled(spark):
    """JavaScript texts are dealt by file; the rows made from them stay where they are."""
    from sparklode.operators import segment_js as J
    files = spark.createDataFrame([(1, "function f() {}\n")], "row long, masked string")
    plan = J.js_definitions(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [row" in plan
    physical = J.js_definitions(files)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange ") == 1 and physical.index("Generate posexplode") < physical.index("Exchange ")
    assert [r["name"] for r in J.js_definitions(files).collect()] == ["f"]
