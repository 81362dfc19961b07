from structmill.operators import context

FILES = "repo string, path string, directory string"
SYMBOLS = "repo string, path string, name string, line int, visibility string, parent string"


def tables(spark):
    files = spark.createDataFrame([("r", f"a/{i}.py", "a") for i in range(7)] + [("r", "b/x.py", "b"), ("r", "c/1.py", "c"), ("r", "c/2.py", "c")], FILES)
    rows = [("r", f"a/{i}.py", f"s{i}_{k}", 10 - k, "private" if i == 0 else "public", None) for i in range(6) for k in range(10)] + [("r", "b/x.py", "m", 1, "public", "C")]
    return files, spark.createDataFrame(rows, SYMBOLS)


def test_signatures_skip_after_the_cut(spark):
    files, symbols = tables(spark)
    degrees = spark.createDataFrame([("r", "a/0.py", 9), ("r", "a/5.py", 2), ("r", "a/6.py", 99)], "repo string, path string, in_degree long")
    got = {r.path: (r.rank, r.symbols) for r in context.signatures(files, degrees, symbols).collect()}
    assert {p: x[0] for p, x in got.items()} == {"a/5.py": 2, "a/1.py": 3, "a/2.py": 4, "a/3.py": 5}
    assert got["a/5.py"][1] == [f"s5_{k}" for k in range(9, 1, -1)]


def test_top_symbols(spark):
    got = {r.directory: (r.file_count, r.top_symbols) for r in context.top_symbols(*tables(spark)).collect()}
    assert got == {"a": (7, [f"s{i}_{k}" for i in range(3) for k in (9, 8, 7)] + ["s3_9"]), "c": (2, [])}


def test_usual_directory(spark):
    rows = [("r", f"src/Tests/{i}.py", "src/Tests") for i in range(5)] + [("r", f"{d}/{i}.py", d) for d in ("z", "b") for i in (2, 1)] + [("t", "tests/a.py", "tests")]
    got = {r.repo: (r.directory, r.files, r.example) for r in context.usual_directory(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {"r": ("b", 2, "b/1.py"), "t": ("tests", 1, "tests/a.py")}


def test_children_and_tokens(spark):
    routes, recursion = spark.createDataFrame([("a",), ("b",)], "subsystem string"), spark.createDataFrame([("a", ["x", "y"])], "name string, children array<string>")
    assert {r.subsystem: r.recursive_children for r in context.with_children(routes, recursion).collect()} == {"a": ["x", "y"], "b": []}
    usage = spark.createDataFrame([(1, 2, 4, 8), (1, None, None, 8), (None,) * 4], "input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long")
    assert sorted(r.total_tokens for r in context.total_tokens(usage).collect()) == [0, 9, 15]
