import random

from structmill.llm.p2_top_items import best_files, best_symbols
from structmill.llm.topn import top_n


def brute(rows, n):
    groups = {}
    for g, s, i in rows:
        if s is not None and i is not None:
            groups.setdefault(g, set()).add((-s, i.encode(), i))
    return {(g, -s, i) for g, v in groups.items() for s, _, i in sorted(v)[:n]}


def test_equals_brute_force_with_a_giant_group_ties_and_nulls(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["giant"] * 6 + ["a", "b", None, ""]), rng.choice([None, *range(5)]), rng.choice([None, "é", "z", "A", "a"] + [str(i) for i in range(40)])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, s bigint, i string").repartition(9)
    for n in (1, 3, 7):
        out = [tuple(r) for r in top_n(df, ["g"], "s", "i", n).collect()]
        assert len(out) == len(set(out)) and set(out) == brute(rows, n)


def test_empty(spark):
    assert top_n(spark.createDataFrame([], "g string, s bigint, i string"), ["g"], "s", "i", 3).count() == 0


def test_latest_scan_counts_and_its_null_does_not_rank(spark):
    rows = [("r", "d/a", "d", 9, "2025-01-01"), ("r", "d/a", "d", 1, "2025-01-02"), ("r", "d/b", "d", 5, "2025-01-01"), ("r", "d/b", "d", None, "2025-01-03"), ("r", "d/c", "d", 1, "2025-01-01"), ("r", "d/c", "d", 1, "2025-01-01")]
    df = spark.createDataFrame(rows, "repo string, path string, directory string, incoming_edges bigint, t string").selectExpr("*", "timestamp(t) AS scanned_at", "1 AS score", "2 AS item")
    assert sorted(map(tuple, best_files(df).collect())) == [("r", "d", 1, "d/a"), ("r", "d", 1, "d/c")]


def test_symbols_sum_each_reference_once(spark):
    rows = [(1, "r", "d", "s", 3), (1, "r", "d", "s", 3), (2, "r", "d", "s", 2), (3, "r", "d", "t", 5), (4, "r", "d", "u", None)]
    df = spark.createDataFrame(rows, "ref_id bigint, repo string, path string, symbol string, ref_count bigint").selectExpr("*", "timestamp('2025-01-01') AS scanned_at")
    assert sorted(map(tuple, best_symbols(df).collect())) == [("r", "d", 5, "s"), ("r", "d", 5, "t")]
