from pyspark.sql import functions as F

from structmill.functions import paths, text
from structmill.operators import graph, resolve, results, routing

EDGES = "edge_id bigint, repo string, source string, target string, kind string, detail string, line int, confidence double, scanned_at timestamp"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()[0]


def test_paths(spark):
    for given, normal in {"./a/./b.py": "a/b.py", "a\\b//c.py": "a/b/c.py", "/a/b/../c.py": "a/c.py", "../x": "../x", "": "", "a/..": ""}.items():
        assert one(spark, paths.normal_path(F.col("x")), given) == normal
    assert one(spark, paths.normal_path(F.col("x")), None) is None
    assert [one(spark, f(F.col("x")), "a/b.tar.gz") for f in (paths.parent_dir, paths.stem, paths.suffix, paths.without_suffix)] == ["a", "b.tar", ".gz", "a/b.tar"]
    assert [one(spark, f(F.col("x")), ".env") for f in (paths.parent_dir, paths.stem, paths.suffix)] == ["(root)", ".env", ""]
    assert one(spark, paths.ancestors(F.col("x")), "a/b/c") == ["a", "a/b", "a/b/c"]


def test_text(spark):
    assert [one(spark, text.line_count(F.col("x")), t) for t in ("", "a", "a\n", "a\nb", "\n\n", None)] == [0, 1, 1, 2, 2, None]
    for line, tag, said in [("# WHY: x", "WHY", "x"), ("/* hack: y */", "HACK", "y"), (" * TODO: z", "TODO", "z"), ("# WHY x", "", ""), ("code # NOTE: n", "", "")]:
        assert (one(spark, text.comment_tag(F.col("x")), line), one(spark, text.comment_text(F.col("x")), line)) == (tag, said)
    assert one(spark, text.slug(F.col("x")), "  A -- b_C! ") == "a-b-c"
    assert one(spark, text.shell_quoted(F.col("x")), "it's") == "'it'\"'\"'s'"
    assert one(spark, text.words(F.col("x")), "The router and a ROUTER with api") == ["router", "and", "api"]


def small_graph(spark):
    """Eleven files, ten edges; expected figures worked out by hand."""
    names = "src/routers/users src/routers/posts src/routers/comments src/models/user src/models/post src/models/base src/utils/auth src/utils/helpers src/config tests/test_users tests/test_posts".split()
    counts = [3, 2, 2, 2, 1, 2, 3, 2, 2, 2, 1]
    files = [("r", f"{n}.py", n.rpartition("/")[0], "python", c) for n, c in zip(names, counts)]
    pairs = [(0, 3), (0, 6), (1, 4), (1, 6), (2, 6), (3, 5), (4, 5), (8, 7), (9, 0), (10, 1)]
    edges = [(i, "r", files[a][1], files[b][1], "tests" if a > 8 else "imports", None, 1, 1.0, None) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(files, "repo string, path string, directory string, language string, symbol_count int"), graph.edges_once(spark.createDataFrame(edges, EDGES))


def test_directory_edges(spark):
    files, edges = small_graph(spark)
    out = {r.directory: (r.file_count, r.symbol_count, r.internal_edges, r.outgoing_edges, r.incoming_edges, r.edge_density) for r in graph.directory_edges(files, graph.directory_pairs(files, edges)).collect()}
    assert out == {"src": (1, 2, 0, 1, 0, 0.0), "src/models": (3, 5, 2, 0, 2, 1.0), "src/routers": (3, 7, 0, 5, 2, 0.0), "src/utils": (2, 5, 0, 0, 4, 0.0), "tests": (2, 3, 0, 2, 0, 0.0)}


def test_degrees_and_pairs(spark):
    files, edges = small_graph(spark)
    deg = {r.path: (r.in_degree, r.out_degree) for r in graph.degrees(files, edges).collect()}
    assert deg["src/utils/auth.py"] == (3, 0) and deg["src/models/base.py"] == (2, 0) and deg["src/config.py"] == (0, 1)
    pairs = {(r.source_dir, r.target_dir): r.edges for r in graph.directory_pairs(files, edges).collect()}
    assert pairs["src/routers", "src/utils"] == 3 and pairs["tests", "src/routers"] == 2
    assert graph.circular_pairs(graph.directory_pairs(files, edges)).count() == 0
    assert {r.partner for r in graph.top_partners(graph.directory_pairs(files, edges), 1).where("directory = 'src/routers' AND direction = 'outgoing'").collect()} == {"src/utils"}


def test_graph_of_nothing(spark):
    files, _ = small_graph(spark)
    none = graph.edges_once(spark.createDataFrame([], EDGES))
    assert graph.directory_edges(files, graph.directory_pairs(files, none)).where("internal_edges + outgoing_edges + incoming_edges > 0").count() == 0
    assert graph.call_hubs(none).count() == 0


def resolved(spark, files, imports):
    f = spark.createDataFrame([("r", p) for p in files], "repo string, path string")
    i = spark.createDataFrame([("r", p, m, n, line) for p, m, n, line in imports], "repo string, path string, module string, names array<string>, line int")
    return resolve.resolve_imports(f, i)


def targets(df):
    return {(r.path, r.module): r.target for r in df.collect()}


def test_absolute_imports(spark):
    files = ["main.py", "utils.py", "a/x.py", "b/x.py", "src/pkg/__init__.py", "src/pkg/core.py", "app/m.py"]
    out = targets(resolved(spark, files, [("main.py", "utils", ["h"], 1), ("main.py", "x", [], 2), ("main.py", "a.x", [], 3), ("main.py", "pkg.core", [], 4), ("main.py", "pkg", [], 5), ("main.py", "main", [], 6), ("main.py", "os.path", [], 7)]))
    assert out == {("main.py", "utils"): "utils.py", ("main.py", "x"): None, ("main.py", "a.x"): "a/x.py", ("main.py", "pkg.core"): "src/pkg/core.py", ("main.py", "pkg"): "src/pkg/__init__.py", ("main.py", "main"): None, ("main.py", "os.path"): None}


def test_relative_imports(spark):
    files = ["a/b/m.py", "a/b/n.py", "a/n.py", "a/b/__init__.py", "w/p.ts", "w/q.ts", "w/q.js", "w/only.js", "w/dir/index.ts", "v/z.ts"]
    imports = [("a/b/m.py", ".n", [], 1), ("a/b/m.py", "..n", [], 2), ("a/b/m.py", ".", [], 3), ("w/p.ts", "./q", [], 4), ("w/p.ts", "./only", [], 5), ("w/p.ts", "./dir", [], 6), ("w/p.ts", "../v/z", [], 7), ("w/p.ts", "./none", [], 8), ("w/only.js", "./q", [], 9), ("v/z.ts", "../w/q.js", [], 10)]
    assert list(targets(resolved(spark, files, imports)).values()) and targets(resolved(spark, files, imports)) == {
        ("a/b/m.py", ".n"): "a/b/n.py", ("a/b/m.py", "..n"): "a/n.py", ("a/b/m.py", "."): "a/b/__init__.py", ("w/p.ts", "./q"): "w/q.ts", ("w/p.ts", "./only"): "w/only.js",
        ("w/p.ts", "./dir"): "w/dir/index.ts", ("w/p.ts", "../v/z"): "v/z.ts", ("w/p.ts", "./none"): None, ("w/only.js", "./q"): "w/q.js", ("v/z.ts", "../w/q.js"): "w/q.js",
    }


def test_edges_and_calls_of_imports(spark):
    r = resolved(spark, ["main.py", "utils.py"], [("main.py", "utils", ["helper"], 1), ("main.py", "json", [], 2)])
    assert [(e.source, e.target, e.detail) for e in resolve.import_edges(r).collect()] == [("main.py", "utils.py", "utils (helper)")]
    assert [e.module for e in resolve.external_imports(r).collect()] == ["json"]
    calls = spark.createDataFrame([("r", "main.py", "main", "helper", 3, 1.0), ("r", "main.py", "main", "other", 4, 1.0)], "repo string, path string, caller string, callee string, line int, confidence double")
    symbols = spark.createDataFrame([("r", "utils.py", "helper")], "repo string, path string, name string")
    assert [(c.target, c.detail) for c in resolve.call_edges(r, calls, symbols).collect()] == [("utils.py", "main → helper")]


def test_routes(spark):
    q = spark.createDataFrame([(1, "b/routers/chats.py"), (2, "b/routers2/x"), (3, "router endpoint api"), (4, ""), (5, None)], "query_id int, query string")
    routes = spark.createDataFrame([("api", "b/routers"), ("all", "b"), ("aaa", "b/routers")], "subsystem string, owned string")
    assert {r.query_id: (r.subsystem, r.matched) for r in routing.by_prefix(q, routes).collect()} == {1: ("aaa", "b/routers"), 2: ("all", "b")}
    tasks = spark.createDataFrame([("t2", ["router", "api"]), ("t1", ["router", "api", "x"]), ("t3", ["migration"])], "task string, words array<string>")
    assert {r.query_id: (r.task, r.overlap, r.strong) for r in routing.by_task(q.where("query_id = 3"), tasks).collect()} == {3: ("t1", 2, True)}
    patterns = spark.createDataFrame([(1, "model-triplet", None), (2, "chat-feature", ["middleware", "chats"]), (3, "chat-feature-two", ["middleware"]), (4, "api", []), (5, "", ["anything at all"]), (6, "zz", ["two words here", "x" * 30])], "ord int, pattern string, fragments array<string>")
    asked = spark.createDataFrame([(1, "model_triplet"), (2, "my middleware"), (3, "chats"), (4, "The MODEL-TRIPLET api"), (5, "an api"), (6, ""), (7, None), (8, "middlewar"), (9, "say TWO WORDS HERE."), (10, "two words  here"), (11, "y" + "x" * 31)], "query_id int, query string")
    assert {r.query_id: r.pattern for r in routing.by_pattern(asked, patterns).collect()} == {1: "model-triplet", 2: "chat-feature", 4: "model-triplet", 5: "api", 9: "zz", 11: "zz"}
    assert routing.by_pattern(asked, patterns.limit(0)).count() == 0


def test_route_index(spark):
    areas = [("API Routers", "a.md", "routes", ["b/routers"], ["b/routers"]), ("Data models", "b.md", None, ["b/models", "b/db"], None), ("config", None, "", ["b/config"], []), ("api-routers", "z.md", "late", [], []), (" ", "c.md", "", [], []), (None, "d.md", "", [], [])]
    areas = spark.createDataFrame(areas, "subsystem string, doc_path string, role string, owns_paths array<string>, brief_paths array<string>")
    recursion = spark.createDataFrame([("api routers", ["x", "y"]), ("none", ["z"])], "name string, children array<string>")
    got = {r.name: (r.doc_path, r.role, r.owns_paths, r.brief_paths, r.recursive_children) for r in routing.route_index(areas, recursion).collect()}
    assert got == {"api-routers": ("a.md", "routes", ["b/routers"], ["b/routers"], ["x", "y"]), "data-models": ("b.md", "", ["b/models", "b/db"], ["b/models", "b/db"], []), "config": ("", "", ["b/config"], ["b/config"], [])}


def test_lock(spark):
    cand = spark.createDataFrame([("a", "new a", 1), ("b", "new b", 2), ("c", None, 3)], "name string, role string, n int")
    lock = spark.createDataFrame([("a", "kept"), ("b", None), ("z", "gone")], "name string, role string")
    out = {r.name: (r.role, r.n, r.state, r.overrides) for r in routing.merge_lock(cand, lock, "name", ["role"], ["n"]).collect()}
    assert out == {"a": ("kept", 1, "matched", 1), "b": ("new b", 2, "matched", 0), "c": (None, 3, "new", 0), "z": ("gone", None, "stale", 0)}
    assert {r.name for r in routing.upsert_lock(cand.select("name", "role"), lock, "name").collect()} == {"a", "b", "c", "z"}
    assert routing.merged_only(routing.merge_lock(cand, lock, "name", ["role"], ["n"])).count() == 3


RESULTS = "ord int, mode string, tokens bigint, cost double, seconds double, strict boolean, lenient boolean, quality double, error string"


def deltas(spark, rows):
    return results.deltas(results.mode_stats(spark.createDataFrame(rows, RESULTS)), "f", "b").collect()[0]


def test_mode_stats_and_verdicts(spark):
    rows = [(1, "f", 1000, 0.10, 2.0, True, True, 7.0, None), (2, "f", 2000, 0.20, 3.0, False, True, 8.0, None), (3, "f", 9, 9.0, 9.0, True, True, 1.0, "failed")]
    s = results.mode_stats(spark.createDataFrame(rows, RESULTS)).first()
    assert (s.tokens, round(s.cost, 6), s.seconds, s.quality, s.strict_rate, s.lenient_rate, s.errors, s.total) == (1500.0, 0.15, 2.5, 7.5, 50.0, 100.0, 1, 3)
    better = [(1, "f", 1, 1.0, 1.0, True, True, 5.0, None), (1, "b", 1, 1.0, 1.0, True, False, 5.0, None)]
    assert deltas(spark, better).verdict == "PASS"
    assert deltas(spark, [(1, "f", 1, 1.06, 1.0, True, False, 5.0, None), (1, "b", 1, 1.0, 1.0, True, True, 5.0, None)]).verdict == "FAIL"
    assert deltas(spark, [(1, "f", 1, 0.0, 1.0, True, True, 5.0, None), (1, "b", 0, 0.0, 1.0, True, True, 5.0, None)]).verdict == "MIXED"
    assert deltas(spark, []).verdict == "MIXED"


def test_one_sided_results_are_an_error(spark):
    import pytest

    with pytest.raises(Exception, match="only one side"):
        deltas(spark, [(1, "f", 1, 1.0, 1.0, True, True, 5.0, None)])


def test_directory_ranking_has_every_directory(spark, tmp_path):
    from structmill.plans.repository import directory_ranking

    files = [("r", f"d{i:03}/a.py", f"d{i:03}", "python", 1, 0, False, 0, 0, 0, None) for i in range(130)] + [("s", "x/a.py", "x", "python", 1, 0, False, 0, 0, 0, None)]
    columns = "repo string, path string, directory string, language string, symbol_count int, import_count int, has_tests boolean, incoming_edges int, outgoing_edges int, call_edge_count int, scanned_at timestamp"
    spark.createDataFrame(files, columns).write.parquet(f"{tmp_path}/file_infos.parquet")
    edges = [(i, "r", "d000/a.py", f"d{129 - i % 2:03}/a.py", "calls", None, i, 1.0, None) for i in range(3)]
    spark.createDataFrame(edges, EDGES).write.parquet(f"{tmp_path}/graph_edges.parquet")
    rows = sorted((r.repo, r.rank, r.directory, r.incoming_edges) for r in directory_ranking(spark, str(tmp_path)).collect())
    assert rows == [("r", 1, "d129", 2), ("r", 2, "d128", 1), *[("r", i + 3, f"d{i:03}", 0) for i in range(128)], ("s", 1, "x", 0)]
