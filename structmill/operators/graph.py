"""Aggregates over the edge multigraph of repositories: degrees, directory coupling, partners, hubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structmill.functions.paths import normal_path
from structmill.operators.latest import latest


def files_once(file_infos: DataFrame, *columns: str) -> DataFrame:
    """Each file (repo, path) once, as its latest scan has it, with the named columns (all without names)."""
    keep = ["repo", "path", *columns] if columns else ["repo", "path", "directory", "language", "symbol_count", "import_count", "has_tests", "incoming_edges", "outgoing_edges", "call_edge_count"]
    return latest(file_infos, ["repo", "path"], [F.col("scanned_at")], keep)


def edges_once(graph_edges: DataFrame, *columns: str) -> DataFrame:
    """Each edge_id once, as its latest scan has it, both ends in one spelling. Partitioned by edge_id.

    Only the named columns (all without names) take part, also in breaking ties: less to shuffle.
    """
    keep = list(columns) or ["edge_id", "repo", "source", "target", "kind", "detail", "line", "confidence"]
    spelled = {c: normal_path(F.col(c)) for c in ("source", "target") if c in keep}
    rows = graph_edges.select("edge_id", *[spelled.get(c, F.col(c)).alias(c) for c in keep if c != "edge_id"], "scanned_at")
    return latest(rows, "edge_id", [F.col("scanned_at")], keep)


def path_id(path: Column) -> Column:
    """A 64-bit number for a path, null for null: within one repository two paths practically never share it."""
    return F.when(path.isNotNull(), F.xxhash64(path))


def numbered_edges_once(graph_edges: DataFrame) -> DataFrame:
    """As :func:`edges_once`, with repo and :func:`path_id` of both ends: half the bytes in every shuffle that follows."""
    ends = [path_id(normal_path(F.col(c))).alias(c) for c in ("source", "target")]
    return latest(graph_edges.select("edge_id", "repo", *ends, "scanned_at"), "edge_id", [F.col("scanned_at")], ["repo", "source", "target"])


def degrees(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file the edges of any kind that start and end at it; 0 for files without edges. Ends that are no file are ignored."""
    out = edges.where(F.col("source").isNotNull()).groupBy(F.col("repo").alias("o_repo"), F.col("source").alias("o_path")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.where(F.col("target").isNotNull()).groupBy(F.col("repo").alias("i_repo"), F.col("target").alias("i_path")).agg(F.count(F.lit(1)).alias("in_degree"))
    joined = files.select("repo", "path").join(out, (F.col("repo") == F.col("o_repo")) & (F.col("path") == F.col("o_path")), "left")
    joined = joined.join(into, (F.col("repo") == F.col("i_repo")) & (F.col("path") == F.col("i_path")), "left")
    return joined.select("repo", "path", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("in_degree", "out_degree")])


def directory_pairs(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges counted by the directories of their ends, both of which must be known files.

    Edges are joined at their sources first, where no key is hot, then summed per source directory and target, so a
    target that most edges point at meets its file once per directory and not once per edge. Paths may be numbers.
    """
    known = files.select(F.col("repo").alias("k_repo"), F.col("path").alias("k_path"), F.col("directory").alias("k_dir"))
    at_source = edges.join(known, (F.col("repo") == F.col("k_repo")) & (F.col("source") == F.col("k_path"))).groupBy("repo", F.col("k_dir").alias("source_dir"), "target").agg(F.count(F.lit(1)).alias("n"))
    at_both = at_source.join(known, (F.col("repo") == F.col("k_repo")) & (F.col("target") == F.col("k_path")))
    return at_both.groupBy("repo", "source_dir", F.col("k_dir").alias("target_dir")).agg(F.sum("n").alias("edges"))


def directory_edges(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per directory: files, symbols, edges inside, going out and coming in, and density = inside / (inside + out) to three decimals, 0 if none."""
    inside = F.col("source_dir") == F.col("target_dir")
    halves = pairs.select("repo", F.col("source_dir").alias("d"), F.when(inside, F.col("edges")).otherwise(0).alias("i"), F.when(inside, 0).otherwise(F.col("edges")).alias("o"), F.lit(0).cast("bigint").alias("n"))
    halves = halves.unionByName(pairs.where(~inside).select("repo", F.col("target_dir").alias("d"), F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("o"), F.col("edges").alias("n")))
    sums = halves.groupBy(F.col("repo").alias("s_repo"), F.col("d").alias("s_dir")).agg(F.sum("i").alias("internal_edges"), F.sum("o").alias("outgoing_edges"), F.sum("n").alias("incoming_edges"))
    dirs = files.groupBy("repo", "directory").agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("symbol_count"), F.lit(0)).alias("symbol_count"))
    joined = dirs.join(sums, (F.col("repo") == F.col("s_repo")) & (F.col("directory") == F.col("s_dir")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("internal_edges", "outgoing_edges", "incoming_edges")]
    filled = joined.select("repo", "directory", "file_count", "symbol_count", *counts)
    density = F.bround(F.coalesce(F.try_divide(F.col("internal_edges").cast("double"), (F.col("internal_edges") + F.col("outgoing_edges")).cast("double")), F.lit(0.0)), 3)
    return filled.withColumn("edge_density", density)


def circular_pairs(pairs: DataFrame) -> DataFrame:
    """Directories that depend on each other: once, the smaller name first, with the edges each way."""
    back = pairs.select(F.col("repo").alias("b_repo"), F.col("source_dir").alias("b_source"), F.col("target_dir").alias("b_target"), F.col("edges").alias("back"))
    both = pairs.where("source_dir < target_dir").join(back, (F.col("repo") == F.col("b_repo")) & (F.col("source_dir") == F.col("b_target")) & (F.col("target_dir") == F.col("b_source")))
    return both.select("repo", F.col("source_dir").alias("dir_a"), F.col("target_dir").alias("dir_b"), F.col("edges").alias("a_to_b"), F.col("back").alias("b_to_a"), (F.col("edges") + F.col("back")).alias("total"))


def coupling_bands(pairs: DataFrame) -> DataFrame:
    """Directory pairs by strength: strong from 50 edges on, moderate from 10, light from 5; weaker ones are dropped."""
    band = F.when(F.col("edges") >= 50, "strong").when(F.col("edges") >= 10, "moderate").when(F.col("edges") >= 5, "light")
    return pairs.where("source_dir <> target_dir AND edges >= 5").withColumn("band", band)


def top_partners(pairs: DataFrame, n: int = 5) -> DataFrame:
    """Per directory its n strongest partners in each direction; ties by name."""
    other = pairs.where("source_dir <> target_dir")
    out = other.select("repo", F.col("source_dir").alias("directory"), F.lit("outgoing").alias("direction"), F.col("target_dir").alias("partner"), "edges")
    into = other.select("repo", F.col("target_dir").alias("directory"), F.lit("incoming").alias("direction"), F.col("source_dir").alias("partner"), "edges")
    rank = F.row_number().over(Window.partitionBy("repo", "directory", "direction").orderBy(F.col("edges").desc(), "partner"))
    return out.unionByName(into).withColumn("rank", rank).where(F.col("rank") <= n)


def first_seen_edges(graph_edges: DataFrame) -> DataFrame:
    """Import and test edges: the first (lowest edge_id) of each source, target and kind. Calls are all kept."""
    edges = edges_once(graph_edges).where(F.col("target").isNotNull())
    once = edges.where("kind <> 'calls'").groupBy("repo", "source", "target", "kind").agg(F.min("edge_id").alias("edge_id"))
    return once.unionByName(edges.where("kind = 'calls'").select("repo", "source", "target", "kind", "edge_id"))


def call_hubs(edges: DataFrame, least: int = 5, names: int = 5) -> DataFrame:
    """Files with at least ``least`` incoming calls and the first callee names in order.

    The names of a hub are pre-aggregated per distinct name, so a hub with a third of all edges holds a set of names.
    """
    calls = edges.where((F.col("kind") == "calls") & F.col("target").isNotNull())
    callee = F.trim(F.element_at(F.split("detail", "→"), -1))
    named = calls.withColumn("callee", F.when(F.col("detail").contains("→"), callee)).groupBy("repo", "target", "callee").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("repo", "target").orderBy(F.col("callee").asc_nulls_last()))
    ranked = named.withColumn("k", F.when(F.col("callee").isNotNull(), rank))
    kept = F.array_sort(F.collect_list(F.when(F.col("k") <= names, F.col("callee"))))
    hubs = ranked.groupBy("repo", F.col("target").alias("path")).agg(F.sum("n").alias("calls"), F.array_join(kept, ",").alias("callees"))
    return hubs.where(F.col("calls") >= least)
