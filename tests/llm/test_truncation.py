from structmill.llm.p8_truncation import source_rates, truncated

DOCS = "doc_id bigint, text string, source string"
SENTENCE = "The branch service keeps one replica per shard and drops it after {} minutes."
WHOLE = [
    SENTENCE.format(5), "Ends well.\n\n-- the shard team", "Ends well.\n\n- `src/a/b.py`\n- `src/a/c.py`", "Ends well.\n\n| a | b |\n|---|---|\n| `x` | 1 |", "Ends well.\n\n```\ncode(\n```", "See\n\nhttps://docs.example/a/b", "Fine.\n\n[shard]: docs/shard.md",
    "Fine.\n\n(As said above, it ends here.)", "bundle session handler", "src/a/b.py", "What now?", "Done!", "He said \"stop.\"", "Build ab12ff.", "# Title\n\n## A heading", "Ends well.\r\n\r\n- `src/a/b.py`\r\n",
]
CUT = [
    (SENTENCE.format(7)[:40], "sentence or word"), ("Ends well. The branch service keeps one", "sentence"), ("Ends well. The branch service keeps one repl", "word"), ("Ends well.\n\n```python\ndef f(x):\n    return", "block"), ("Ends well.\n\n- `src/a/b.py`\n- `src/a/c.", "block"),
    ("Ends well.\n\n| a | b |\n|---|---|\n| `x` | 1", "block"), ("Ends well. The branch service ke�", "bytes or word"), ("Ends well. The branch service keeps one ...", "sentence"), ("Ends well. The branch service ke [...]", "form or word"), ("Ends well. Unheard zeb�", "bytes"), ("Ends well. Unheard zebras [...]", "form"), ("Ends well.\n\n(As said above. It goes", "block"), ("Unheard words stand here. Nobody knows whether zebras", "form"),
]


def corpus(spark, extra=()):
    rows = [(1000 + i, (SENTENCE.format(i) + " ") * 2 + "\n\n" + SENTENCE.format(i + 1), "readme") for i in range(30)]
    rows += [(i, t, " Wiki-Export") for i, t in enumerate(WHOLE)] + [(100 + i, t, "wiki_export") for i, (t, _) in enumerate(CUT)]
    rows += [(500, "", "readme"), (501, None, "readme"), (502, " \n ", None), (None, "The branch serv", "readme"), (100, CUT[0][0], "wiki_export"), *extra]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS ab", "2 AS inside", "3 AS c")


def test_each_ending(spark):
    got = {r.doc_id: r.why for r in truncated(corpus(spark)).collect()}
    assert {i: got[i] for i in range(len(WHOLE))} == dict.fromkeys(range(len(WHOLE)))
    assert [t for i, (t, why) in enumerate(CUT) if not got[100 + i] or got[100 + i] not in why] == []
    assert not {500, 501, 502, None} & set(got)


def test_rates(spark):
    rates = {r.source: (r.documents, r.truncated) for r in source_rates(corpus(spark)).collect()}
    assert rates["wiki_export"] == (len(WHOLE) + len(CUT), len(CUT)) and rates["readme"] == (32, 0) and rates[None] == (1, 0)


def test_long_text_and_empty_table(spark):
    long = (SENTENCE.format(3) + "\n\n") * 20000
    got = {r.doc_id: r.truncated for r in truncated(corpus(spark, [(900, long, "x"), (901, long + "The branch service keeps", "x")])).collect()}
    assert not got[900] and got[901]
    assert truncated(spark.createDataFrame([], DOCS)).count() == 0 and source_rates(spark.createDataFrame([], DOCS)).count() == 0


def test_copies_do_not_vote_for_their_own_cut_end(spark):
    ends = [("The branch service keeps one", "sentence"), ("The branch service keeps one repl", "word")]
    copies = [(2000 + 100 * k + i, "Unheard words stand here. " + t + "\r\n" * (i % 3), "wiki_export") for k, (t, _) in enumerate(ends) for i in range(40)]
    got = {r.doc_id: r.why for r in truncated(corpus(spark, copies)).collect()}
    assert [{got[2000 + 100 * k + i] for i in range(40)} for k in range(2)] == [{why} for _, why in ends]


def test_equals_its_sql(spark):
    import os

    import pytest

    from structmill.llm.p8_truncation import QUERIES, SQL

    duckdb, data = pytest.importorskip("duckdb"), "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    for name, sql in SQL.items():
        result = db.execute(sql)
        columns = [c[0] for c in result.description]
        assert sorted(map(tuple, QUERIES[name](spark, data).select(*columns).collect()), key=repr) == sorted(map(tuple, result.fetchall()), key=repr)
