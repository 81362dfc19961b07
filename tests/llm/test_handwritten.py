from pyspark.sql import functions as F

from structmill.llm.p4_handwritten import copied_classes, latest_shapes, origins, read_shapes
from structmill.llm.shape import shape, winnowed

FILES = "file_id bigint, repo string, file_path string, content string, ingested_at timestamp"
PROFILES = "repo string, path string, is_auto_generated boolean"


def code(seed, functions=12):
    """Hand-written-like: every function has its own names and body."""
    body = ["total = {a} + {n}\n    for x{n} in {b}:\n        total += x{n} * {n}", "if not {a}:\n        raise KeyError('{b}{n}')\n    {b} = [{a}, {n}]", "with open({a}) as f{n}:\n        {b} = f{n}.read()\n    print({b}, {n})", "{b} = dict({a}=1, k{n}={n})\n    {b}.update(x='{a}')"]
    return "import os\n\n" + "\n".join(f"def f{seed}_{i}(a{seed}, b{i}):\n    " + body[(seed + i * 7) % 4].format(a=f"a{seed}", b=f"b{i}", n=seed * 31 + i) + f"\n    return b{i}\n" for i in range(functions))


MINIFIED = "!function(){" + "".join(f"var v{i}=function(q){{for(var e=0,n=[];e<q;e++)n.push(e<<{i});return n}};" for i in range(30)) + "}();"
ACCESSORS = "".join(f"def get_a{i}(message):\n    return message.fields[{i}]\n\n" for i in range(20))
DATA = "TABLE = [\n" + "".join(f'    {{"id": {i}, "w": {i / 7:.3f}}},\n' for i in range(60)) + "]\n"


def test_shapes():
    assert shape("# Code generated by x v1. DO NOT EDIT.\n" + code(1), "python").banner
    assert shape("// Diese Datei wurde automatisch von x erzeugt.\na();\n", "javascript").banner
    assert not shape("# not generated: edited by hand\n" + code(1), "python").banner
    assert not shape(code(1) + "\n# This file was generated. DO NOT EDIT.\n", "python").banner
    assert not shape("BANNER = '# Code generated by x. DO NOT EDIT.'\n" + code(1), "python").banner
    assert shape(MINIFIED, "javascript").compressed and not shape(MINIFIED, "python").compressed and not shape(code(1), "python").compressed
    assert shape(DATA, "python").data and not shape(DATA + code(1), "python").data and not shape('{"a": [1, 2]}' * 30, "python").data
    assert shape("", "python")[:5] == (False, False, False, 0, 0)
    assert len(shape("f(1, 2, x)\n" * 4, "python").fingerprints) == 1 and len(shape("f(1)\n", "python").fingerprints) == 0
    assert len(shape("<!DOCTYPE html>\n<html>" + "<p>a b c d</p>" * 20 + "</html>", "python").fingerprints) == 0


def test_winnowing_finds_every_shared_run():
    import numpy as np

    rng = np.random.default_rng(0)
    shared = rng.integers(0, 1000, 80).astype(np.uint64)
    texts = [np.concatenate([rng.integers(0, 1000, n).astype(np.uint64), shared, rng.integers(0, 1000, 30).astype(np.uint64)]) for n in (13, 57, 101)]
    prints = [set(winnowed(t).tolist()) for t in texts]
    assert prints[0] & prints[1] & prints[2]
    assert len(winnowed(shared[:10])) == 0


def test_job(spark):
    rows = [(1, "r1", "lib/a.py", code(1), None), (2, "r2", "lib/b.py", code(1), None), (3, "r3", "x/c.py", "# header\n" + code(1).replace("\n", "\r\n") + "# end\n", None), (4, "r1", "own.py", code(2), None), (5, "r2", "gen/own.py", code(3), None), (6, "r1", "p.min.js", MINIFIED, None), (7, "r1", "acc.py", ACCESSORS, None), (8, "r1", "d.py", DATA, None), (9, "r1", "e.py", "", None), (10, "r1", "n.py", None, None), (11, None, "q.py", code(5), None), (12, "r4", "y/half.py", code(1)[: len(code(1)) // 2], None), (4, "r1", "own.py", code(2), None), (None, "r1", "z.py", code(9), None), (13, "r1", "z.txt", "x", None)]
    sources = spark.createDataFrame(rows, FILES).selectExpr("*", "1 AS copies", "2 AS print")
    profiles = spark.createDataFrame([("r2", "gen", True), ("r1", "(root)", None)], PROFILES)
    got = {r.file_id: r.origin for r in origins(sources, profiles).collect()}
    assert got == {1: "copied", 2: "copied", 3: "copied", 4: "hand", 5: "hand", 6: "compressed", 7: "generated", 8: "data", 9: "hand", 10: "hand", 11: "hand", 12: "copied"}
    assert origins(spark.createDataFrame([], FILES), spark.createDataFrame([], PROFILES)).count() == 0


def classes(spark, rows):
    read = read_shapes(spark.createDataFrame(rows, FILES)).cache()
    return copied_classes(read, latest_shapes(read)).count()


def test_copies_need_three_unrelated_repositories(spark):
    assert classes(spark, [(i, "r1", f"lib/{i}.py", code(1), None) for i in range(5)]) == 0
    assert classes(spark, [(i, f"r{i % 2}", f"lib/{i}.py", code(1), None) for i in range(6)]) == 0
    assert classes(spark, [(i, f"r{i % 3}", f"lib/{i}.py", code(1), None) for i in range(6)]) == 1
    # forks have one origin: the same files in each
    forks = [(100 * k + i, f"fork{k}", f"src/{i}.py", code(i), None) for k in range(4) for i in range(9)]
    assert classes(spark, forks) == 0
    assert classes(spark, forks + [(1000 + k, f"other{k}", "a.py", code(3), None) for k in range(2)]) == 1


def test_folders_and_notices_alone_make_no_copy(spark):
    rows = [(1, "r1", "external/own.py", code(1), None), (2, "r1", "node_modules/x/own.py", "# x v1.2.3 | (c) The x Authors | Permissive License\n" + code(2), None)]
    assert {r.origin for r in origins(spark.createDataFrame(rows, FILES), spark.createDataFrame([], PROFILES)).collect()} == {"hand"}


def test_a_copy_in_every_repository_is_no_hot_key(spark):
    rows = [(i, f"r{i}", "a.py", code(1), None) for i in range(60)]
    read = read_shapes(spark.createDataFrame(rows, FILES).repartition(2)).cache()
    assert read.where("size(prints) > 0").count() <= 3 * read.rdd.getNumPartitions() and copied_classes(read, latest_shapes(read)).count() == 1


def in_one_task(spark, rows):
    """The rows in the order of file_id in one partition, of so many that they aren't spread."""
    return spark.createDataFrame(rows, FILES).repartition(spark.sparkContext.defaultParallelism, F.lit(1)).sortWithinPartitions("file_id")


def test_forks_take_no_place_of_other_repositories(spark):
    forks = [(100 * k + i, f"fork{k}", f"src/{i}.py", code(i), None) for k in range(5) for i in range(9)]
    others = [(1000 + k, f"other{k}", "a.py", code(3), None) for k in range(2)]
    for rows in (forks + others, forks + [(-file_id, *row) for file_id, *row in others], forks + others[:1]):
        got = {r.file_id for r in origins(in_one_task(spark, rows), spark.createDataFrame([], PROFILES)).where("origin = 'copied'").collect()}
        assert got == ({file_id for file_id, _, _, text, _ in rows if text == code(3)} if len(rows) == 47 else set())


def test_classes_against_sets_of_origins(spark):
    from random import Random

    for seed in range(3):
        random = Random(seed)
        texts = [code(random.randrange(40), 4) + code(random.randrange(40), random.choice([1, 4])) for _ in range(40)]
        placed = [(f"fork{k}", text) for k in range(4) for text in texts[:9]] + [(f"own{i % 12}", random.choice(texts)) for i in range(60)]
        random.shuffle(placed)
        rows = [(i, repo, f"{i}.py", text, None) for i, (repo, text) in enumerate(placed)]
        stands = {}
        for repo, text in placed:
            for p in shape(text, "python").fingerprints.tolist():
                stands.setdefault(p, set()).add("fork" if repo.startswith("fork") else repo)
        want = set()
        for file_id, _, _, text, _ in rows:
            prints = shape(text, "python").fingerprints.tolist()
            hits = sum(len(stands[p]) >= 3 for p in prints)
            if hits >= 0.4 * len(prints) and hits >= min(3, len(prints)):
                want.add(file_id)
        got = {r.file_id for r in origins(in_one_task(spark, rows), spark.createDataFrame([], PROFILES)).where("origin = 'copied'").collect()}
        assert got == want and 0 < len(want) < len(rows)


def test_data_below_a_long_header(spark):
    licence = "# Permission is hereby granted, free of charge, to any person who has a copy of this table.\n" * 60
    assert len(licence) > 4000 and shape(licence + DATA, "python").data and not shape(licence + DATA + code(1), "python").data
    notes = "/*\n" + " * What each of the columns stands for, at some length.\n" * 100 + " */\n"
    assert shape(notes + "export const table = [\n" + "".join(f'  ["k{i}", {i}],\n' for i in range(60)) + "];\n", "typescript").data
    sources = spark.createDataFrame([(1, "r1", "d.py", licence + DATA, None), (2, "r1", "own.py", licence + code(2), None)], FILES)
    assert {r.file_id: r.origin for r in origins(sources, spark.createDataFrame([], PROFILES)).collect()} == {1: "data", 2: "hand"}
    assert not shape("x = " + " " * 200_000 + "\n" + "1, " * 60, "python").data
