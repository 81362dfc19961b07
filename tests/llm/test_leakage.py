import random

from hypothesis import given, settings
from hypothesis import strategies as st

from structmill.llm.automaton import SuffixAutomaton
from structmill.llm.p6_leakage import leaks, scrubbed
from structmill.llm.words import placed_words, words

TASK = "Name both files between emit_journal_rapid() plus patch_thicket_young() where 1524 plain edges cross the palette façade"


def brute(texts, doc, least):
    best = {}
    for item, task in texts:
        for i in range(len(doc)):
            for j in range(len(task)):
                n = 0
                while i + n < len(doc) and j + n < len(task) and doc[i + n] == task[j + n]:
                    n += 1
                if n >= least:
                    best[item] = max(best.get(item, 0), n)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=25), st.integers(1, 4))
def test_automaton_equals_brute_force(tasks, doc, least):
    texts = [(i % 3, t) for i, t in enumerate(tasks)]
    best, spans = SuffixAutomaton(texts, least).matches(doc)
    assert best == brute(texts, doc, least)
    covered = {k for a, b in spans for k in range(a, b)}
    runs = {tuple(t[j : j + least]) for _, t in texts for j in range(len(t) - least + 1)}
    assert covered == {k for i in range(len(doc) - least + 1) if tuple(doc[i : i + least]) in runs for k in range(i, i + least)}


def test_words_are_the_same_however_set():
    want = words(TASK)
    import unicodedata

    for t in (TASK.upper(), unicodedata.normalize("NFD", TASK), TASK.replace(" ", "&nbsp;"), TASK.replace(" ", "&#32;"), TASK.replace(" ", "\n * "), TASK.replace("files", "fi​l­es"), TASK.replace("both", "<b class='x'>both</b>"), TASK.replace(" ", "\\n"), TASK.replace("ç", "\\u00e7"), TASK.replace("Name", "_Name_").replace("both", "**both**"), "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in TASK)):
        assert words(t) == want
        assert [w for w, _, _ in placed_words(t)] == want
    assert words("<p>a</p><p>b</p>") == ["a", "b"] and words("a<b>b</b>c") == ["abc"]
    assert words("") == [] and words("_ -- !") == []


def tables(spark, docs, tasks):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS words")
    return d, spark.createDataFrame(tasks, "item_id int, family string, difficulty string, instruction string, reference_answer string")


def test_job(spark):
    w = words(TASK)
    docs = [(1, f"before {TASK} after"), (2, " ".join(w[:9]) + " gap " + " ".join(w[9:])), (3, ""), (4, None), (None, TASK), (5, " ".join(w[2:13])), (1, f"before {TASK} after"), (6, "x " * 200000 + TASK), (7, "Other words. " + TASK)]
    tasks = [(10, "f", "e", TASK, None), (11, "f", "e", None, "Other words. " + TASK), (12, "f", "e", "", ""), (13, "f", "e", None, None), (10, "f", "e", TASK, None), (14, "f", "e", " ".join(w[:8]), " ".join(w[8:]))]
    d, t = tables(spark, docs, tasks)
    want = {(1, 10), (1, 11), (6, 10), (6, 11), (7, 10), (7, 11)}
    assert {(r.doc_id, r.item_id) for r in leaks(d, t).collect()} == want
    assert {(r.doc_id, r.item_id) for r in leaks(d, t, block_chars=100).collect()} == want
    assert leaks(*tables(spark, [], tasks)).count() == 0 and leaks(*tables(spark, docs, [])).count() == 0


def test_scrubbing(spark):
    rest = "A long text of its own with many other words that no task has, said at length and twice over. " * 3
    d, t = tables(spark, [(1, rest + TASK + "! " + rest), (2, "x " + TASK), (3, rest)], [(10, "f", "e", TASK, None)])
    for block in (100_000, 50):
        out = {r.doc_id: (r.action, r.text) for r in scrubbed(d, t, block_chars=block).collect()}
        assert out == {1: ("cut", rest + "! " + rest), 2: ("drop", None)}


def test_random_documents_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    tasks = [(i, "f", "e", " ".join(rng.choices(vocabulary, k=40)), " ".join(rng.choices(vocabulary, k=30))) for i in range(6)]
    docs = []
    for n in range(60):
        source = rng.choice(tasks)[3 + n % 2].split()
        a = rng.randrange(len(source) - 10)
        docs.append((n, " ".join(rng.choices(vocabulary, k=20) + source[a : a + rng.randint(8, 16)] + rng.choices(vocabulary, k=5))))
    d, t = tables(spark, docs, tasks)
    texts = [(x[0], text.split()) for x in tasks for text in x[3:]]
    want = {(n, item, k) for n, text in docs for item, k in brute(texts, text.split(), 12).items()}
    assert {tuple(r) for r in leaks(d, t).collect()} == want and want


def test_blocks_change_no_result(spark):
    rng = random.Random(9)
    own = lambda n: " ".join(f"own{rng.randrange(10**6)}" for _ in range(n))
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(8)]
    tasks = [(k, "f", "e", p, None) for k, p in enumerate(passages)]
    docs = [(1, f"{passages[0]} {own(20)} {passages[1]} {own(20)}"), (2, f"{own(40)} {passages[2]} {own(40)}"), (3, f"{own(90)} {passages[3]} {passages[4]} {own(90)}"), (4, " ".join(passages[:5]) + " " + own(900)), (5, own(50)), (2, "")]
    d, t = tables(spark, docs, tasks)
    results = []
    for block in (1_000_000, 700, 200):
        results.append(({tuple(r) for r in scrubbed(d, t, block_chars=block).collect()}, {tuple(r) for r in leaks(d, t, block_chars=block).collect()}))
    assert all(r == results[0] for r in results)
    assert {(r[0], r[4]) for r in results[0][0]} == {(1, "drop"), (2, "cut"), (3, "cut"), (4, "drop")}
    assert {r[0]: r[3] for r in results[0][0]} == {1: 30, 2: 30, 3: 60, 4: 150}
