import os

import pytest

from structmill.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_every_query_is_named_once_and_has_its_module():
    assert len(catalogue.QUERIES) == sum(len(m.QUERIES) for m in catalogue._MODULES)
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["directory_profile", "p1_found", "rationale", "route_cascade"])
def test_queries_run_on_whole_tables(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() >= 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["file_degrees", "symbol_popularity", "lock_merge", "module_index", "cache_probe", "fallback_bursts"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for file in os.listdir(DATA):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    result = db.execute(catalogue.SQL[name])
    names = [c[0] for c in result.description]
    want = sorted((tuple(r) for r in result.fetchall()), key=repr)
    df = catalogue.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == want


def test_order_of_rows_does_not_matter(spark):
    from pyspark.sql import functions as F

    from structmill.operators import graph

    edges = "edge_id bigint, repo string, source string, target string, kind string, detail string, line int, confidence double, scanned_at timestamp"
    rows = [(i % 40, "r", f"a/{i % 7}.py", f"./b/{i % 5}.py" if i % 2 else f"b/{i % 5}.py", ["imports", "calls"][i % 2], f"x → f{i % 9}", i, 1.0, None) for i in range(80)]
    df = spark.createDataFrame(rows, edges)
    results = []
    for shuffled in (df, df.orderBy(F.rand(1)), df.repartition(5)):
        once = graph.edges_once(shuffled)
        results.append([sorted(map(tuple, x.collect()), key=repr) for x in (once, graph.first_seen_edges(shuffled), graph.call_hubs(once, 2))])
    assert results[0] == results[1] == results[2]
