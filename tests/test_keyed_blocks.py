import collections
import random

from pyspark.sql import functions as F

from structmill.operators.keyed_blocks import key_totals
from structmill.operators.latest import latest
from structmill.plans.graph_keys import heavy_keys

SCHEMA = "g string, h int, v bigint, w double"


def measures():
    return {"n": ("count", F.lit(1)), "vs": ("sum", F.col("v")), "v0": ("min", F.col("v")), "v1": ("max", F.col("v")), "ws": ("sum", F.col("w"))}


def brute(rows):
    out = {}
    for g, h, v, w in rows:
        k = out.setdefault((g, h), [0, [], []])
        k[0] += 1
        k[1] += [v] if v is not None else []
        k[2] += [w] if w is not None else []
    return {k: (n, sum(v) if v else None, min(v, default=None), max(v, default=None), round(sum(w), 6) if w else None) for k, (n, v, w) in out.items()}


def found(df):
    return {(r.g, r.h): (r.n, r.vs, r.v0, r.v1, None if r.ws is None else round(r.ws, 6)) for r in df.collect()}


def test_totals_equal_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b\x1f", '"q"', None, ""]), rng.choice([1, 2, None]), rng.choice([None, rng.randint(-(2**60), 2**60) // 2000]), rng.choice([None, rng.random()])) for _ in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert found(key_totals(df, ["g", "h"], measures())) == brute(rows)
    assert found(key_totals(df, ["g", "h"], measures(), blocks=1)) == brute(rows)


def test_empty_table_gives_no_rows(spark):
    assert key_totals(spark.createDataFrame([], SCHEMA), ["g"], {"n": ("count", F.lit(1))}).count() == 0


def test_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([("x", 1, 2, 0.5, "k")], SCHEMA + ", key string").withColumn("block", F.lit(9))
    assert [tuple(r) for r in key_totals(df, ["g"], {"n": ("sum", F.col("v"))}).collect()] == [("x", 2)]


def test_latest_takes_the_newest_and_is_stable_on_ties(spark):
    rows = [(1, "a", 5), (1, "b", 5), (1, "z", None), (2, "x", None), (None, "n", 1), (None, "n", 1), (None, "m", 1)]
    df = spark.createDataFrame(rows, "id int, v string, t int")
    assert sorted(map(tuple, latest(df, "id", [F.col("t")], ["id", "v"]).collect()), key=str) == sorted([(1, "b"), (2, "x"), (None, "n"), (None, "m")], key=str)


def test_heavy_keys_share_and_spelling(spark):
    edges = [(i, "r", "s.py", ["a/b.py", "./a/b.py", "a//b.py", "a\\b.py"][i % 4], "calls", None, None, 1.0, None) for i in range(50)]
    edges += [(100 + i, "r", "s.py", f"t{i}.py", "imports", None, 1, 1.0, None) for i in range(60)]
    edges += [(0, "r", "s.py", "a/b.py", "calls", None, None, 1.0, None), (999, "r", "s.py", None, "calls", None, None, 1.0, None)]
    schema = "edge_id bigint, repo string, source string, target string, kind string, detail string, line int, confidence double, scanned_at timestamp"
    files = spark.createDataFrame([("r", "a/b.py")], "repo string, path string")
    out = heavy_keys(spark.createDataFrame(edges, schema), files, share=0.4)
    assert [tuple(r) for r in out.collect()] == [("r", "a/b.py", "calls")]
    assert heavy_keys(spark.createDataFrame([], schema), files).count() == 0


def test_a_key_exactly_at_the_share_counts(spark):
    schema = "edge_id bigint, repo string, source string, target string, kind string, detail string, line int, confidence double, scanned_at timestamp"
    edges = [(i, "r", "s", f"t{i % 100}", "calls", None, None, 1.0, None) for i in range(200)]
    out = heavy_keys(spark.createDataFrame(edges, schema), spark.createDataFrame([], "repo string, path string"))
    assert out.count() == 100 and collections.Counter(r.kind for r in out.collect()) == {"calls": 100}
