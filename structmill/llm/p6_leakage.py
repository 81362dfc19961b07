"""Problem 6: passages of held-out tasks inside a corpus.

The tasks become a generalised suffix automaton over their words. Corpus texts are streamed through it in their
own partitions: one step per word keeps the longest run that also stands in some task. No corpus row is shuffled but
those with leaks.

The automaton is bounded: more tasks than one block holds are done block after block, each held against the whole
corpus; the driver and the executors hold one block at a time. Spans are collected over all blocks before a document is
judged, so the size of the blocks changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structmill.llm.automaton import SuffixAutomaton
from structmill.llm.words import placed_words, words
from structmill.sources.tables import cut, table

#: Words in a row that make a leak.
LEAST_WORDS = 12
#: Characters of task text in one automaton, about 170,000 words; an automaton takes some 700 bytes a word.
BLOCK_CHARS = 1_000_000
#: Spans of more words, or a larger share of a document's words, drop the document; others are cut out.
DROP_WORDS, DROP_SHARE = 120, 0.5


@lru_cache(maxsize=1)
def _automaton(texts: tuple[tuple[int, str], ...], least: int) -> SuffixAutomaton:
    return SuffixAutomaton(((item, words(text)) for item, text in texts), least)


def _task_blocks(tasks: DataFrame, block_chars: int) -> Iterator[tuple[tuple[int, str], ...]]:
    """Both texts of each task, in blocks of about ``block_chars`` characters; one block is collected at a time."""
    size = tasks.agg(F.coalesce(F.sum(F.coalesce(F.length("instruction"), F.lit(0)) + F.coalesce(F.length("reference_answer"), F.lit(0))), F.lit(0))).first()[0]
    blocks = 1 + size // block_chars
    for b in range(blocks):
        rows = tasks.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "instruction", "reference_answer").collect()
        yield tuple(sorted({(r[0], text) for r in rows if r[0] is not None for text in r[1:] if text}))


def _over_blocks(documents: DataFrame, tasks: DataFrame, block_chars: int, scan: Callable, schema: str) -> DataFrame:
    """``scan`` of every document with the automaton of every block; each block's rows are written before the next."""
    context = documents.sparkSession.sparkContext
    rows = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text")
    found = []
    for block in _task_blocks(tasks, block_chars):
        shared = context.broadcast(block)
        found.append(cut(rows.mapInArrow(scan(shared), schema)))
        shared.destroy()
    return reduce(DataFrame.unionByName, found)


def _scan(least: int):
    def with_block(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared.value, least)
            for batch in batches:
                docs, items, longest = [], [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for item, n in automaton.matches(words(text))[0].items():
                        docs.append(doc)
                        items.append(item)
                        longest.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int32()), pa.array(longest, pa.int32())], ["doc_id", "item_id", "words"])

        return run

    return with_block


def leaks(documents: DataFrame, tasks: DataFrame, least: int = LEAST_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and task that share ``least`` words in a row: doc_id, item_id, the longest such run.

    Each of a task's texts counts by itself; a run doesn't go on from one into the other. Documents without id,
    null or empty texts and tasks without text give no rows. Repeated rows of a document count once.
    """
    found = _over_blocks(documents, tasks, block_chars, _scan(least), "doc_id bigint, item_id int, words int")
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _spans(least: int):
    """The texts with leaks and which of their words leak."""

    def with_block(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared.value, least)
            for batch in batches:
                out = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if spans := automaton.matches(words(text))[1]:
                        out.append((doc, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63), text, [{"a": a, "b": b} for a, b in spans]))
                columns = list(zip(*out)) or [[]] * 4
                kinds = [pa.int64(), pa.int64(), pa.string(), _SPANS]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "digest", "text", "spans"])

        return run

    return with_block


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(drop_words: int, drop_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                here, spans = len(words(text)), _merged(found)
                leaked, longest = sum(b - a for a, b in spans), max(b - a for a, b in spans)
                if longest > drop_words or leaked > drop_share * here:
                    out.append((doc, here, leaked, longest, "drop", None))
                    continue
                placed, kept, at = placed_words(text), [], 0
                for a, b in spans:
                    kept.append(text[at : placed[a][1]])
                    at = placed[b - 1][2]
                out.append((doc, here, leaked, longest, "cut", "".join([*kept, text[at:]])))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "words", "leaked_words", "longest", "action", "text"])

    return run


def scrubbed(documents: DataFrame, tasks: DataFrame, least: int = LEAST_WORDS, drop_words: int = DROP_WORDS, drop_share: float = DROP_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents with leaks, their spans removed; beyond either limit the action is ``drop`` and text null.

    Repeated rows of a document count once; a doc_id with several texts has a row for each text that leaks.
    """
    found = _over_blocks(documents, tasks, block_chars, _spans(least), "doc_id bigint, digest bigint, text string, spans array<struct<a: int, b: int>>")
    # a text leaks in few blocks: its spans are a short list
    whole = found.groupBy("doc_id", "digest").agg(F.max("text").alias("text"), F.flatten(F.collect_set("spans")).alias("spans"))
    return whole.select("doc_id", "text", "spans").mapInArrow(_cut(drop_words, drop_share), "doc_id bigint, words int, leaked_words int, longest int, action string, text string")


def p6_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return leaks(table(spark, data_dir, "documents"), table(spark, data_dir, "eval_tasks")).select("doc_id", "item_id")


def p6_scrubbed(spark: SparkSession, data_dir: str) -> DataFrame:
    return scrubbed(table(spark, data_dir, "documents"), table(spark, data_dir, "eval_tasks"))


def p6_task_report(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per task: documents that leak it and the longest run."""
    tasks = table(spark, data_dir, "eval_tasks")
    found = leaks(table(spark, data_dir, "documents"), tasks)
    counted = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("longest"))
    named = tasks.select("item_id", "family", "difficulty").dropDuplicates(["item_id"])
    return named.join(counted, "item_id", "left").select("item_id", "family", "difficulty", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("longest", F.lit(0)).alias("longest"))


QUERIES = {"p6_found": p6_found, "p6_scrubbed": p6_scrubbed, "p6_task_report": p6_task_report}
SQL: dict[str, str] = {}
