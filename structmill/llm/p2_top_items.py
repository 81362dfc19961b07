"""Problem 2: the best files and symbols of every directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structmill.llm.topn import top_n
from structmill.operators.latest import latest
from structmill.sources.tables import table


def file_scores(files: DataFrame) -> DataFrame:
    """Each file once, as its latest scan has it. Spread by file."""
    return latest(files, ["repo", "path"], [F.col("scanned_at")], ["repo", "path", "directory", "incoming_edges"])


def symbol_scores(refs: DataFrame) -> DataFrame:
    """Per repo, directory and symbol the sum of ref_count, each ref_id once. Spread by symbol."""
    once = latest(refs, "ref_id", [F.col("scanned_at")], ["repo", "path", "symbol", "ref_count"])
    return once.groupBy("repo", "path", "symbol").agg(F.sum("ref_count").alias("refs"))


def best_files(files: DataFrame, n: int = 3) -> DataFrame:
    scores = file_scores(files).where(F.col("directory").isNotNull())
    return top_n(scores, ["repo", "directory"], "incoming_edges", "path", n)


def best_symbols(refs: DataFrame, n: int = 3) -> DataFrame:
    return top_n(symbol_scores(refs).where(F.col("path").isNotNull()), ["repo", "path"], "refs", "symbol", n)


def p2_found(spark: SparkSession, data_dir: str) -> DataFrame:
    files = best_files(table(spark, data_dir, "file_infos")).select("repo", F.col("directory").alias("path"), F.lit("file").alias("grain"), F.col("path").alias("item"))
    symbols = best_symbols(table(spark, data_dir, "symbol_refs")).select("repo", "path", F.lit("symbol").alias("grain"), F.col("symbol").alias("item"))
    return files.unionByName(symbols)


def p2_top_files(spark: SparkSession, data_dir: str) -> DataFrame:
    """The three best files with their scores."""
    return best_files(table(spark, data_dir, "file_infos"))


QUERIES = {"p2_found": p2_found, "p2_top_files": p2_top_files}

_FILES = """SELECT repo, directory, path, incoming_edges FROM (
    SELECT *, row_number() OVER (PARTITION BY repo, directory ORDER BY incoming_edges DESC, path) AS k FROM (
        SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC NULLS LAST) AS n FROM file_infos
    ) WHERE n = 1 AND incoming_edges IS NOT NULL
) WHERE k <= 3"""

_SYMBOLS = """SELECT repo, path, symbol FROM (
    SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY refs DESC, symbol) AS k FROM (
        SELECT repo, path, symbol, sum(ref_count) AS refs FROM (
            SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY scanned_at DESC NULLS LAST) AS n FROM symbol_refs
        ) WHERE n = 1 GROUP BY ALL
    ) WHERE refs IS NOT NULL
) WHERE k <= 3"""

SQL = {
    "p2_found": f"""SELECT repo, directory AS path, 'file' AS grain, path AS item FROM ({_FILES})
UNION ALL SELECT repo, path, 'symbol' AS grain, symbol AS item FROM ({_SYMBOLS})""",
    "p2_top_files": _FILES,
}
