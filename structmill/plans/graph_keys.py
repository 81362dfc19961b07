"""Per-target results over the edge multigraph (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structmill.functions.paths import normal_path
from structmill.operators.graph import edges_once
from structmill.operators.keyed_blocks import key_totals
from structmill.sources.tables import cut, table


def edge_keys(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per repo, target and kind: edges, the confidence (sum in thousandths, least, greatest), first and last line."""
    edges = edges_once(table(spark, data_dir, "graph_edges"), "repo", "target", "kind", "line", "confidence").where(F.col("target").isNotNull())
    thousandths = F.round(F.col("confidence") * 1000).cast("bigint")
    return key_totals(
        edges,
        ["repo", "target", "kind"],
        {
            "edges": ("count", F.lit(1)),
            "confidence_sum": ("sum", thousandths),
            "confidence_min": ("min", F.col("confidence")),
            "confidence_max": ("max", F.col("confidence")),
            "line_min": ("min", F.col("line")),
            "line_max": ("max", F.col("line")),
        },
    )


def heavy_keys(edges: DataFrame, files: DataFrame, share: float = 0.01) -> DataFrame:
    """Keys with at least ``share`` of all edges that have a target, the target spelled as in ``files``.

    At most ``1 / share`` rows come out, so they are broadcast to the files. A target that is no known file keeps
    its normal spelling; without any edge there are no rows.
    """
    counted = cut(key_totals(edges_once(edges, "repo", "target", "kind").where(F.col("target").isNotNull()), ["repo", "target", "kind"], {"edges": ("count", F.lit(1))}))
    total = counted.agg(F.coalesce(F.sum("edges"), F.lit(0))).first()[0]
    heavy = counted.where((F.col("edges") >= share * total) & (F.col("edges") > 0))
    known = files.select(F.col("repo").alias("f_repo"), F.col("path").alias("f_path"), normal_path(F.col("path")).alias("f_key"))
    same = (F.col("f_repo") == F.col("repo")) & (F.col("f_key") == F.col("target"))
    spelled = known.join(F.broadcast(heavy), same, "inner").groupBy("repo", "target", "kind").agg(F.min("f_path").alias("f_path"))
    keys = ["repo", "target", "kind"]
    named = F.broadcast(spelled.withColumnsRenamed({k: f"s_{k}" for k in keys}))
    on = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys]
    return heavy.join(named, on, "left").select("repo", F.coalesce("f_path", "target").alias("target"), "kind").distinct()


def p1_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return heavy_keys(table(spark, data_dir, "graph_edges"), table(spark, data_dir, "file_infos"))


P1_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(replace(trim(target), '\', '/'), '/+', '/', 'g'), '^(\./)+|^/', ''), '/(\./)+', '/', 'g')"

P1_EDGES = f"""SELECT repo, {P1_NORMAL} AS target, kind, line, confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY scanned_at DESC NULLS LAST) AS n FROM graph_edges
) WHERE n = 1 AND target IS NOT NULL"""

QUERIES = {"p1_found": p1_found, "p1_edge_keys": edge_keys}

SQL = {
    "p1_found": f"""WITH e AS ({P1_EDGES}), k AS (SELECT repo, target, kind, count(*) AS n FROM e GROUP BY ALL)
SELECT repo, target, kind FROM k WHERE n >= 0.01 * (SELECT sum(n) FROM k)""",
    "p1_edge_keys": f"""WITH e AS ({P1_EDGES})
SELECT repo, target, kind, count(*) AS edges, CAST(sum(CAST(round(confidence * 1000) AS BIGINT)) AS BIGINT) AS confidence_sum,
    min(confidence) AS confidence_min, max(confidence) AS confidence_max,
    CAST(min(line) AS BIGINT) AS line_min, CAST(max(line) AS BIGINT) AS line_max
FROM e GROUP BY repo, target, kind""",
}
