"""Problem 3: source files that do not parse.

Every file is cut into pieces, and each piece becomes a map from the states it can be entered in to the state it
leaves, with its tokens, of which every closed bracket group is already one symbol, and the brackets it closes and
leaves open. Such maps are joined associatively: runs of pieces where they lie, so that only short summaries are
shuffled, and the runs of a file where they meet. What is left of a file that closes all it opens is its outermost
statements, which the local grammar of its language parses. All languages and sizes take this one way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structmill.llm.lexing import Effect, effect, joined, parses, pieces, prepared, states
from structmill.llm.syntax import language_of
from structmill.llm.vocabulary import LANGUAGES
from structmill.sources.tables import spread, table

#: Characters of one piece; a line is never split.
PIECE = 2048
#: Pieces that are joined before the shuffle.
RUN = 64

_SUMMARY = pa.schema(
    [("key", pa.int64()), ("seen", pa.string()), ("digest", pa.int64()), ("repo", pa.string()), ("language", pa.string()), ("n", pa.int32()), ("begin", pa.int32())]
    + [("places", pa.list_(pa.int32())), ("states", pa.list_(pa.string())), ("tokens", pa.list_(pa.string())), ("ends", pa.list_(pa.string())), ("goes_on", pa.list_(pa.int32()))]
)
_SUMMARY_DDL = "key bigint, seen string, digest bigint, repo string, language string, n int, begin int, places array<int>, states array<string>, tokens array<string>, ends array<string>, goes_on array<int>"

#: What else is taken from a text while it is read: rows of a struct, their Arrow and SQL types.
Extras = tuple[Callable[[str, str], list[dict]], pa.DataType, str]


def suffix_language(path: Column) -> Column:
    """The language that a path's suffix stands for, null for other suffixes."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), suffix)


def runs(text: str, language: str, piece: int = PIECE, run: int = RUN) -> Iterator[Effect]:
    """The effects of runs of pieces of one text."""
    text = prepared(text, language)
    known = states(text, language)
    held: list[Effect] = []
    for begin, part in pieces(text, language, piece):
        held.append(effect(part, begin, language, known))
        if len(held) == run:
            yield reduce(lambda a, b: joined(a, b, language), held)
            held = []
    if held:
        yield reduce(lambda a, b: joined(a, b, language), held)


def _summarised(piece: int, run: int, extras: Extras | None):
    schema = _SUMMARY if extras is None else _SUMMARY.append(pa.field("extras", pa.list_(extras[1])))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, repo, path, text, seen in zip(*(c.to_pylist() for c in batch.columns)):
                language = language_of(path)
                digest = xxhash.xxh64_intdigest(f"{repo}\0{path}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)
                for n, (begin, accounts) in enumerate(runs(text, language, piece, run)):
                    own = (key, seen, digest, repo, language, n, begin, [k[0] for k in accounts], [k[1] for k in accounts], *[[a[i] for a in accounts.values()] for i in range(3)])
                    rows.append(own if extras is None else (*own, extras[0](text, language) if n == 0 else []))
            columns = list(zip(*rows)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return work


def _judged(extras: Extras | None):
    """Rows of a file come together, its deliveries one after another, each in the order of its runs."""
    fields = [("file_id", pa.int64()), ("invalid", pa.bool_()), ("repo", pa.string()), ("language", pa.string())]
    schema = pa.schema(fields if extras is None else [*fields, ("extras", pa.list_(extras[1]))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict | None = None  # the delivery that is being joined; a later one of the same file replaces it
        out: list[tuple] = []

        def close() -> None:
            if open_ is not None:
                own = (open_["key"], not parses(open_["effect"], open_["language"]), open_["repo"], LANGUAGES[".tsx"] if open_["language"] == "tsx" else open_["language"])
                out.append(own if extras is None else (*own, open_["extras"]))

        for batch in batches:
            for row in batch.to_pylist():
                here = (row["begin"], dict(zip(zip(row["places"], row["states"]), zip(row["tokens"], row["ends"], row["goes_on"]))))
                if open_ is not None and open_["key"] == row["key"] and open_["digest"] == row["digest"] and open_["seen"] == row["seen"]:
                    if row["n"] > open_["n"]:  # an exact repeat has the same number
                        open_["effect"], open_["n"] = joined(open_["effect"], here, row["language"]), row["n"]
                    continue
                if open_ is not None and open_["key"] != row["key"]:
                    close()
                open_ = {**row, "effect": here}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return work


def judged_files(source_files: DataFrame, piece: int = PIECE, run: int = RUN, extras: Extras | None = None) -> DataFrame:
    """One row per file: file_id, ``invalid``, repo and language, and the ``extras`` of its text; one pass over the table.

    Only files whose suffix names a known language. Null and empty content is valid, as is content of comments only.
    Rows without file_id are left out. A file that comes several times counts as its latest row (the greatest digest
    on ties).
    """
    rows = source_files.where(F.col("file_id").isNotNull() & suffix_language(F.col("file_path")).isNotNull())
    rows = rows.select("file_id", "repo", "file_path", F.coalesce("content", F.lit("")).alias("content"), F.col("ingested_at").cast("string").alias("seen"))
    ddl, out = _SUMMARY_DDL, "file_id bigint, invalid boolean, repo string, language string"
    if extras is not None:
        ddl, out = f"{ddl}, extras array<{extras[2]}>", f"{out}, extras array<{extras[2]}>"
    summaries = spread(rows, "file_id").mapInArrow(_summarised(piece, run, extras), ddl)
    met = summaries.repartition("key").sortWithinPartitions("key", F.col("seen").asc_nulls_first(), "digest", "n")
    return met.mapInArrow(_judged(extras), out)


def syntax_flags(source_files: DataFrame, piece: int = PIECE, run: int = RUN) -> DataFrame:
    """file_id and ``invalid``, one row per file; see :func:`judged_files`."""
    return judged_files(source_files, piece, run).select("file_id", "invalid")


def invalid_rates(source_files: DataFrame) -> DataFrame:
    """Per repo (null: "(none)") and language (by suffix): files, invalid ones, their share, also with either or both summed up (null)."""
    files = judged_files(source_files).select("file_id", "invalid", F.coalesce("repo", F.lit("(none)")).alias("repo"), "language")
    counted = files.cube("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.count_if("invalid").alias("invalid"))
    return counted.withColumn("rate", F.col("invalid") / F.col("files"))


def p3_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return syntax_flags(table(spark, data_dir, "source_files")).where("invalid").select("file_id")


def p3_rates(spark: SparkSession, data_dir: str) -> DataFrame:
    return invalid_rates(table(spark, data_dir, "source_files"))


QUERIES = {"p3_found": p3_found, "p3_rates": p3_rates}
SQL: dict[str, str] = {}
