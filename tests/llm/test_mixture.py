import pytest

from structmill.llm.p7_mixture import full_total, leaf_budgets, mixture, share_out, share_report, unique_texts

DOCS = "doc_id bigint, text string, lang string, source string"
TARGETS = "source string, target_share double, max_repeats int"


def test_share_out_hands_shortages_to_siblings():
    assert share_out(100, [(0.5, 1e9), (0.5, 1e9)]) == [50, 50]
    assert share_out(100, [(0.5, 10), (0.25, 1e9), (0.25, 1e9)]) == pytest.approx([10, 45, 45])
    assert share_out(100, [(0.5, 10), (0.5, 20)]) == [10, 20]
    assert share_out(100, []) == [] and share_out(100, [(1.0, 0.0)]) == [0.0]
    assert sum(share_out(97, [(0.2, 3), (0.3, 50), (0.5, 30), (0.1, 40)])) == pytest.approx(97)


def test_siblings_before_ancestors():
    leaf = lambda d, s, share, tokens, rep=1: dict(domain=d, source=s, lang="en", target_share=share, max_repeats=rep, tokens=tokens)
    b = leaf_budgets([leaf("a", "short", 0.3, 10), leaf("a", "sibling", 0.2, 1000), leaf("b", "other", 0.5, 1000)], 100)
    assert b == pytest.approx({("short", "en"): 10, ("sibling", "en"): 40, ("other", "en"): 50})
    b = leaf_budgets([leaf("a", "short", 0.3, 10), leaf("a", "sibling", 0.2, 15), leaf("b", "other", 0.5, 1000)], 100)
    assert b == pytest.approx({("short", "en"): 10, ("sibling", "en"): 15, ("other", "en"): 75})


def test_languages_stand_between_domains_and_sources():
    leaf = lambda d, s, lang, share, tokens, rep=1: dict(domain=d, source=s, lang=lang, target_share=share, max_repeats=rep, tokens=tokens)
    leaves = [leaf("a", "x", "en", 0.25, 10), leaf("a", "x", "de", 0.25, 30), leaf("a", "y", "en", 0.25, 1000), leaf("a", "y", "de", 0.25, 1000), leaf("b", "z", "en", 0.5, 1000)]
    b = leaf_budgets(leaves, 100)
    assert b == pytest.approx({("x", "en"): 6.25, ("y", "en"): 12.5, ("x", "de"): 18.75, ("y", "de"): 12.5, ("z", "en"): 50})
    # what x lacks in a language its sibling in that language gives
    assert leaf_budgets(leaves, 200) == pytest.approx({("x", "en"): 10, ("y", "en"): 27.5, ("x", "de"): 30, ("y", "de"): 32.5, ("z", "en"): 100})
    assert full_total(leaves) == pytest.approx(160) and full_total([]) == 0
    b = leaf_budgets(leaves, 160)
    assert b["x", "en"] + b["x", "de"] == pytest.approx(40)


def test_default_total_meets_all_that_have_texts(spark):
    texts = unique_texts(corpus(spark)).cache()
    targets = spark.createDataFrame([("readme", 0.6, 2), ("plan_note", 0.3, 3), ("digest", 0.05, 40), ("forum_post", 0.05, 2)], TARGETS)
    rows = share_report(mixture(texts, targets), texts, targets, tolerance=0.05).collect()
    assert {r.source: r.met for r in rows} == {"readme": True, "plan_note": True, "digest": True, "forum_post": True}
    few = share_report(mixture(texts, targets, total_tokens=2000), texts, targets, tolerance=0.02).collect()
    assert {r.source for r in few if r.gap > 0.02} and all(not r.met for r in few if abs(r.gap) > 0.02)
    domains = spark.createDataFrame([("README", "a"), ("plan note", "a"), ("digest", "b")], "source string, domain string")
    assert mixture(texts, targets, domains=domains).count() > 0


def corpus(spark):
    rows = [(i, f"text number {i} of the readme", "en", ["readme", " README", "Readme"][i % 3]) for i in range(300)]
    rows += [(1000 + i, f"plan note {i}", ["en", "de-DE", None][i % 3], "plan-note") for i in range(60)]
    rows += [(2000, "digest one", "en", "digest"), (2001, "digest one", "en", "digest"), (3000, "", "en", "readme"), (3001, None, "en", "readme"), (3002, "no source", "en", None), (None, "no id", "en", "readme"), (3003, "unknown source", "en", "elsewhere")]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS tokens", "2 AS uses")


def test_mixture(spark):
    texts = unique_texts(corpus(spark)).cache()
    assert texts.count() == 300 + 60 + 1 + 1
    targets = spark.createDataFrame([("readme", 0.5, 2), ("plan_note", 0.3, 3), ("digest", 0.1, 4), ("forum_post", 0.1, 2)], TARGETS)
    chosen = mixture(texts, targets, total_tokens=1200)
    rows = chosen.collect()
    assert {r.text_key: r.uses for r in rows} == {r.text_key: r.uses for r in mixture(texts.repartition(9), targets, total_tokens=1200).collect()}
    assert {r.text_key: r.uses for r in rows} != {r.text_key: r.uses for r in mixture(texts, targets, total_tokens=1200, seed=8).collect()}
    assert len({r.text_key for r in rows}) == len(rows) and "elsewhere" not in {r.source for r in rows}
    limits = {"readme": 2, "plan_note": 3, "digest": 4}
    assert all(0 < r.uses <= limits[r.source] for r in rows)
    assert 1200 - 40 <= sum(r.tokens * r.uses for r in rows) <= 1200
    report = {r.source: r for r in share_report(chosen, texts, targets).collect()}
    assert report["forum_post"].tokens_used == 0 and not report["forum_post"].met and not report["digest"].met
    assert report["digest"].most_uses == 4 and report["digest"].gap < 0 and report["readme"].gap > 0 and report["plan_note"].gap > 0
    assert sum(r.share for r in report.values()) == pytest.approx(1)


def test_nothing(spark):
    targets = spark.createDataFrame([("readme", 0.5, 2), (None, 0.5, 2), ("digest", None, 1)], TARGETS)
    empty = unique_texts(spark.createDataFrame([], DOCS))
    assert mixture(empty, targets).count() == 0
    assert {r.share for r in share_report(mixture(empty, targets), empty, targets).collect()} == {0.0}
    assert mixture(unique_texts(corpus(spark)), spark.createDataFrame([], TARGETS)).count() == 0
