"""What a task context is made of: central files, top symbols, the usual directory, documents of subsystems, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a path that make a directory one of tests, fixed values.
TEST_PARTS = "tests test spec specs __tests__ test_ _test testing".split()


def signatures(files: DataFrame, degrees: DataFrame, symbols: DataFrame, n: int = 5, names: int = 8) -> DataFrame:
    """The first ``n`` files with symbols of each directory by incoming edges, then without those that have no public
    top-level symbol, with ``names`` such symbols each. Ties fall to the smallest path; symbols go by line and name.

    files: repo, path, directory; degrees: repo, path, in_degree; symbols: repo, path, name, line, visibility, parent.
    """
    having = files.select("repo", "path", "directory").join(symbols.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    known = having.join(degrees.select("repo", "path", "in_degree"), ["repo", "path"], "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("repo", "directory").orderBy(F.col("in_degree").desc(), "path"))
    top = known.withColumn("rank", rank).where(F.col("rank") <= n)
    public = symbols.where((F.col("visibility") == "public") & (F.coalesce("parent", F.lit("")) == ""))
    place = F.row_number().over(Window.partitionBy("repo", "path").orderBy("line", "name"))
    shown = public.select("repo", "path", "name", place.alias("place")).where(F.col("place") <= names)
    listed = shown.groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).getField("name").alias("symbols"))
    return top.join(listed, ["repo", "path"]).select("repo", "directory", "path", "in_degree", "rank", "symbols")


def top_symbols(files: DataFrame, symbols: DataFrame, per_file: int = 3, n: int = 10) -> DataFrame:
    """Per directory of at least two files the first ``per_file`` symbols of each file, of these the first ``n``.

    Files go by path, symbols by line and name; directories without symbols have an empty list.
    """
    wide = files.groupBy("repo", "directory").agg(F.count(F.lit(1)).alias("file_count")).where("file_count >= 2")
    place = F.row_number().over(Window.partitionBy("repo", "path").orderBy("line", "name"))
    first = symbols.select("repo", "path", F.coalesce("name", F.lit("")).alias("name"), place.alias("place")).where(F.col("place") <= per_file)
    rank = F.row_number().over(Window.partitionBy("repo", "directory").orderBy("path", "place"))
    ranked = first.join(files.select("repo", "path", "directory"), ["repo", "path"]).withColumn("rank", rank).where(F.col("rank") <= n)
    lists = ranked.groupBy("repo", "directory").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).getField("name").alias("top_symbols"))
    return wide.join(lists, ["repo", "directory"], "left").withColumn("top_symbols", F.coalesce("top_symbols", F.array().cast("array<string>")))


def usual_directory(files: DataFrame) -> DataFrame:
    """Per repository the directory with most files that is none of tests, else of all; ties by name, and its first path."""
    tests = F.arrays_overlap(F.split(F.lower("directory"), "/"), F.array(*[F.lit(x) for x in TEST_PARTS]))
    counted = files.groupBy("repo", "directory").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("example"))
    best = counted.groupBy("repo").agg(F.min(F.struct(tests.alias("t"), (-F.col("files")).alias("n"), "directory", "example")).alias("b"))
    return best.select("repo", "b.directory", (-F.col("b.n")).alias("files"), "b.example")


def with_children(routes: DataFrame, recursion: DataFrame) -> DataFrame:
    """Routes (subsystem, ...) with the children of their subsystem in ``recursion`` (name, children); none: an empty list."""
    known = recursion.groupBy(F.col("name").alias("__name")).agg(F.max("children").alias("recursive_children"))
    joined = routes.join(known, F.col("subsystem") == F.col("__name"), "left").drop("__name")
    return joined.withColumn("recursive_children", F.coalesce("recursive_children", F.array().cast("array<string>")))


def total_tokens(usage: DataFrame) -> DataFrame:
    """``usage`` with the sum of its four counters, of which a null counts as 0."""
    counters = ["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"]
    return usage.withColumn("total_tokens", sum((F.coalesce(c, F.lit(0)) for c in counters), F.lit(0)).cast("bigint"))
