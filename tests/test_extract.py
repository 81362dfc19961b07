import json

import pytest

from structmill.extract import extract, extract_files, extractor_version
from structmill.sources.scan import manifests, read_json_documents, read_tree, recursion_children, scan, yaml_fences
from structmill.streaming import telemetry

CASES = {
    "a.py": (
        'import os\nfrom m import a, b as c\n\nMAX = 3\n\nclass C:\n    """Doc."""\n    @dec\n    def f(self, x: int = 2, *a, **k) -> str:\n        # WHY: so\n        return self.g(os.path.join(x))\n\ndef _h():\n    return C()\n',
        {("C", "class", None), ("f", "method", "C"), ("_h", "function", None), ("MAX", "constant", None)},
        {("os", ()), ("m", ("a",)), ("m", ("b",))},
    ),
    "a.js": (
        'import d, { x, y as z } from "./m";\nconst q = require("q");\n/** Adds. */\nexport function add(a, b = 1) { return sum(a, b); }\nexport const f = async (x) => { return this.go(x); };\nexport class K {\n  /** Runs. */\n  async run(a) { return "function no() {"; }\n}\n',
        {("add", "function", None), ("f", "function", None), ("K", "class", None), ("run", "method", "K")},
        {("./m", ("x",)), ("./m", ("y",)), ("./m", ()), ("q", ())},
    ),
    "a.ts": (
        'import type { T } from "t";\nexport interface I { a: number }\nexport type A = string;\nexport enum E { X }\nexport const MAX = 1;\nclass B {\n  private go(x: number): string { return run(x); }\n}\n',
        {("I", "interface", None), ("A", "type_alias", None), ("E", "enum", None), ("MAX", "constant", None), ("B", "class", None), ("go", "method", "B")},
        {("t", ("T",))},
    ),
    "a.go": (
        'package p\n\nimport (\n\t"fmt"\n\tx "a/b"\n)\n\nconst Max = 1\n\n// T is kept.\ntype T struct {\n\tid int\n}\n\n// Run runs.\nfunc (t *T) Run(a int) error {\n\tfmt.Println("}")\n\treturn nil\n}\n\nfunc low() {}\n',
        {("T", "struct", None), ("Run", "method", "T"), ("low", "function", None), ("Max", "constant", None)},
        {("fmt", ()), ("a/b", ())},
    ),
    "A.java": (
        'package p;\n\nimport java.util.List;\nimport static a.B.*;\n\n/** Doc. */\npublic class A {\n    private static final int MAX = 1;\n\n    public A() { init(); }\n\n    /** Runs. */\n    @Override\n    protected int run(int a) { return new B(a).go(); }\n}\n',
        {("A", "class", None), ("MAX", "constant", "A"), ("A", "method", "A"), ("run", "method", "A")},
        {("java.util", ("List",)), ("a.B", ("*",))},
    ),
    "a.rs": (
        "use crate::a::{b, c as d};\nuse std::io;\n\nconst MAX: i64 = 1;\n\n/// Doc.\npub struct S {\n    id: i64,\n}\n\nimpl S {\n    /// Runs.\n    pub(crate) fn run(&self, x: i64) -> i64 {\n        self.go(x)\n    }\n}\n\nfn free() {}\n",
        {("S", "struct", None), ("MAX", "constant", None), ("run", "method", "S"), ("free", "function", None)},
        {("crate::a", ("b",)), ("crate::a", ("c",)), ("std", ("io",))},
    ),
}


@pytest.mark.parametrize("path", CASES)
def test_symbols_and_imports(path):
    text, symbols, imports = CASES[path]
    row = extract(path, text)
    assert {(s[0], s[1], s[6]) for s in row["symbols"]} == symbols
    assert {(i[0], tuple(i[1])) for i in row["imports"]} == imports
    assert not row["extraction_errors"]


def test_details():
    row = extract("a.py", CASES["a.py"][0])
    f = next(s for s in row["symbols"] if s[0] == "f")
    assert f[4] == "@dec" and f[9] == "str" and f[8][1] == ("x", "int", "2") and [p[0] for p in f[8]] == ["self", "x", "*a", "**k"]
    assert row["rationale_comments"] == [("WHY", "so", 10, "f")]
    assert {c[1] for c in row["call_edges"]} == {"g", "os.path.join", "C"}
    java = extract("A.java", CASES["A.java"][0])
    assert next(s for s in java["symbols"] if s[0] == "run")[5:8] == ("protected", "A", "Runs.")
    assert {"new B", "init"} <= {c[1] for c in java["call_edges"]}
    js = extract("a.js", CASES["a.js"][0])
    assert {(e[0], e[1]) for e in js["exports"]} == {("add", "named"), ("f", "named"), ("K", "named")}


def test_odd_files():
    assert extract("a.txt", "x") is None
    assert extract("a.py", "")["symbols"] == [] and extract("a.py", "")["line_count"] == 0
    assert extract("a.py", "def f(:\n")["extraction_errors"]
    assert extract("a.rs", "fn f() { " * 50)["language"] == "rust"


def test_job_and_incremental_scan(spark):
    rows = [(1, "r", "a.py", "def f():\n    return 1\n"), (2, "r", "b.py", None), (3, "r", "c.txt", "x"), (4, "r", None, "x")]
    sources = spark.createDataFrame(rows, "file_id bigint, repo string, file_path string, content string")
    first = extract_files(sources)
    assert sorted((r.file_id, len(r.symbols)) for r in first.collect()) == [(1, 1), (2, 0)]
    from pyspark.sql import functions as F

    store = first.withColumn("extractor_version", F.lit("v1")).withColumn("scanned_at", F.current_timestamp())
    again = {r.file_id: r.from_store for r in scan(sources.where("content IS NOT NULL AND file_path IS NOT NULL"), store, "v1").collect()}
    assert again == {1: True}
    assert {r.from_store for r in scan(sources.where("file_id = 1"), store, "v2").collect()} == {False}
    assert scan(sources.limit(0), None, "v1").count() == 0


def test_tree_json_and_fences(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("X = 1\n")
    (tmp_path / "src" / "b.md").write_text("x")
    (tmp_path / "src" / "node_modules" / "c.js").write_text("x")
    assert [r.file_path for r in read_tree(spark, str(tmp_path), "r").collect()] == ["src/a.py"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps({"a": 1}))
    (tmp_path / "j" / "b.json").write_text("{")
    assert sorted(str(r.a) for r in read_json_documents(spark, str(tmp_path / "j"), "a int").collect()) == ["1", "None"]
    docs = spark.createDataFrame([(1, "x\n```yaml\na: 1\n```\n"), (2, "none"), (3, None)], "doc_id int, text string")
    assert [tuple(r) for r in yaml_fences(docs).collect()] == [(1, "a: 1\n")]


def test_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [{"timestamp": f"2025-01-01T00:0{i}:00Z", "session_id": "s", "query": "q" * 300, "route_match_type": "fallback" if i < 4 else "pattern_route"} for i in range(5)]
    rows.append({"timestamp": "2025-01-02T00:00:00Z", "session_id": "t", "query": "q", "route_match_type": "fallback"})
    (log / "a.json").write_text("\n".join(map(json.dumps, rows)))
    telemetry.write_parquet(telemetry.fallback_sessions(telemetry.read_log(spark, str(log))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [(r.session_id, r.events, r.fallbacks) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("s", 5, 4)]


def test_calls_of_functions_inside_functions_are_left_out():
    calls = lambda path, text: {(c[0], c[1]) for c in extract(path, text)["call_edges"]}
    assert calls("a.js", "function f() {\n  a(1);\n  function g() { b(); }\n  x.map((q) => c(q), d());\n  y.each(function () { e(); });\n  z(() => { h(); });\n  i();\n}\n") == {("f", x) for x in ("a", "x.map", "d", "y.each", "z", "i")}
    assert calls("a.rs", "fn f() {\n  a();\n  fn g() { b(); }\n  x.map(|q| c(q));\n  let h = move || { d(); };\n  e(1 | 2, 3 | 4);\n}\n") >= {("f", "a"), ("f", "x.map"), ("f", "e")}
    assert not {("f", x) for x in "bcd"} & calls("a.rs", "fn f() {\n  a();\n  fn g() { b(); }\n  x.map(|q| c(q));\n  let h = move || { d(); };\n}\n")
    assert calls("a.go", "package p\n\nfunc f() {\n\ta()\n\tgo func(x int) { b() }(c())\n\td()\n}\n") == {("f", "a"), ("f", "c"), ("f", "d")}
    assert calls("A.java", "class A {\n  void f() {\n    a();\n    xs.forEach(x -> b(x));\n    run(() -> { c(); });\n    d();\n  }\n}\n") == {("A.f", "a"), ("A.f", "xs.forEach"), ("A.f", "run"), ("A.f", "d")}


def test_long_export_lists_constants_and_use_trees():
    names = [f"someRatherLongName{i}" for i in range(200)]
    exports = extract("a.js", "export { " + ",\n  ".join(names) + " };\nexport { a as b } from './m';\nexport * from './n';\n")["exports"]
    assert [(e[0], e[1]) for e in exports] == [(n, "named") for n in names] + [("b", "re_export"), ("*", "re_export")]
    go = extract("a.go", "package p\n\nconst A, b = 1, 2\n\nconst (\n\tC = iota\n\tD, e = (1 << iota), 2\n\t// note\n\t_ = 3\n)\n")
    assert [(s[0], s[1], s[5]) for s in go["symbols"]] == [("A", "constant", "public"), ("b", "constant", "private"), ("C", "constant", "public"), ("D", "constant", "public"), ("e", "constant", "private")]
    rust = extract("a.rs", "use a::{b, c::{d, e as f, g::*}, self};\nuse h;\nuse i::j as k;\n")
    assert {(i[0], tuple(i[1]), i[2]) for i in rust["imports"]} == {("a", ("b", "self"), None), ("a::c", ("d",), None), ("a::c", ("e",), "f"), ("a::c::g", ("*",), None), ("h", (), None), ("i", ("j",), "k")}


def test_version_is_that_of_the_sources(spark):
    import re

    assert re.fullmatch("[0-9a-f]{16}", extractor_version()) and extractor_version() == extractor_version()
    from pyspark.sql import functions as F

    sources = spark.createDataFrame([(1, "r", "a.py", "X = 1\n")], "file_id bigint, repo string, file_path string, content string")
    store = lambda v: extract_files(sources).withColumn("extractor_version", F.lit(v)).withColumn("scanned_at", F.current_timestamp())
    assert [r.from_store for r in scan(sources, store(extractor_version())).collect()] == [True]
    assert [r.from_store for r in scan(sources, store("older")).collect()] == [False]


def test_tree_with_odd_root(spark, tmp_path):
    root = tmp_path / "a+(b)" / "src"
    (root / ".git").mkdir(parents=True)
    for name in ("x.PY", "y.rs", "z.txt", ".git/w.py"):
        (root / name).write_text("x")
    assert sorted(r.file_path for r in read_tree(spark, str(tmp_path / "a+(b)"), "r").collect()) == ["src/x.PY", "src/y.rs"]


def test_manifests_and_recursion(spark):
    files = spark.createDataFrame([("r", "setup.py"), ("r", "Makefile"), ("r", "src/setup.py"), ("s", "a.py"), (None, None)], "repo string, path string")
    assert [tuple(r) for r in manifests(files).collect()] == [("r", ["Makefile", "setup.py"])]
    one = "---\nsubsystems_completed:\n  - frontend (recursive: chat-ui, app-shell, admin)\n  - \"search (recursive: vector)\"\n  - plain\n---\nrest (recursive: no)\n"
    two = "# State\n```yaml\nrecursion_applied:\n  - parent: retrieval\n    children:\n      - name: vector\n      - name: web\n  - parent: other\n    children: []\n```\n"
    states = spark.createDataFrame([("r", one), ("s", two), ("t", ""), ("u", None)], "repo string, text string")
    got = {(r.repo, r.name): r.children for r in recursion_children(states).collect()}
    assert got == {("r", "frontend"): ["chat-ui", "app-shell", "admin"], ("r", "search"): ["vector"], ("s", "retrieval"): ["vector", "web"]}


def test_formats(spark):
    from pyspark.sql import functions as F

    from structmill.functions import text

    rows = spark.createDataFrame([(1, "m (a, b)", 1.26), (2, "m", -0.04), (3, "m ((a), b))", -2.0), (4, None, None)], "i int, d string, v double")
    got = {r.i: (r.n, r.s) for r in rows.select("i", text.detail_names(F.col("d")).alias("n"), text.signed(F.col("v"), 1, "%").alias("s")).collect()}
    assert got == {1: (["a", "b"], "+1.3%"), 2: ([], "0.0%"), 3: (["(a)", "b"], "-2.0%"), 4: (None, None)}
    assert spark.sql("SELECT timestamp'2025-01-31 08:05:59' AS t").select(text.utc_minutes(F.col("t"))).first()[0] == "2025-01-31 08:05"
