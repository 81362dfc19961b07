"""A/B results: statistics per mode, deltas, a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mode_stats(results: DataFrame) -> DataFrame:
    """Per mode: means over rows without error (0 where there are none), pass rates in percent, errors, total.

    results: mode, tokens, cost, seconds, strict, lenient, quality, error. Null measures don't count.
    """
    fine = F.col("error").isNull()
    mean = lambda c: F.coalesce(F.avg(F.when(fine, F.col(c).cast("double"))), F.lit(0.0))
    rate = lambda c: F.coalesce(100.0 * F.avg(F.when(fine, F.col(c).cast("int"))), F.lit(0.0))
    return results.groupBy("mode").agg(
        mean("tokens").alias("tokens"), mean("cost").alias("cost"), mean("seconds").alias("seconds"), mean("quality").alias("quality"),
        rate("strict").alias("strict_rate"), rate("lenient").alias("lenient_rate"), F.count_if(~fine).alias("errors"), F.count(F.lit(1)).alias("total"),
    )


def deltas(stats: DataFrame, framework: str, baseline: str) -> DataFrame:
    """One row: relative changes in percent (0 where the baseline is 0) and differences, to two decimals, and the verdict.

    FAIL if it costs over 5 % more and passes less; PASS if it costs no more, passes 5 points more, has no lower
    quality and no errors; else MIXED. Exactly one side without rows is an error, none on both sides is MIXED.
    """
    one = lambda c, mode: F.max(F.when(F.col("mode") == mode, F.col(c)))
    sides = stats.agg(*[one(c, m).alias(f"{s}_{c}") for c in ("tokens", "cost", "seconds", "quality", "lenient_rate", "errors", "total") for s, m in (("f", framework), ("b", baseline))])
    pct = lambda c: F.when(F.coalesce(f"b_{c}", F.lit(0.0)) == 0, 0.0).otherwise(F.bround(100.0 * (F.col(f"f_{c}") - F.col(f"b_{c}")) / F.col(f"b_{c}"), 2))
    diff = lambda c: F.bround(F.coalesce(F.col(f"f_{c}") - F.col(f"b_{c}"), F.lit(0.0)), 2)
    row = sides.select(pct("tokens").alias("tokens_pct"), pct("cost").alias("cost_pct"), pct("seconds").alias("seconds_pct"), diff("lenient_rate").alias("lenient_pp"), diff("quality").alias("quality_diff"), "f_errors", "f_total", "b_total")
    one_sided = F.col("f_total").isNull() != F.col("b_total").isNull()
    verdict = (
        F.when(one_sided, F.raise_error(F.lit("only one side has results")).cast("string"))
        .when((F.col("cost_pct") > 5) & (F.col("lenient_pp") < 0), "FAIL")
        .when((F.col("cost_pct") <= 0) & (F.col("lenient_pp") >= 5) & (F.col("quality_diff") >= 0) & (F.coalesce("f_errors", F.lit(0)) == 0), "PASS")
        .otherwise("MIXED")
    )
    return row.select("tokens_pct", "cost_pct", "seconds_pct", "lenient_pp", "quality_diff", verdict.alias("verdict"))


def paired(results: DataFrame, framework: str, baseline: str) -> DataFrame:
    """The results of both modes side by side by their ordinal; a missing side is null."""
    f = results.where(F.col("mode") == framework).select(F.col("ord"), F.col("cost").alias("f_cost"), F.col("lenient").alias("f_lenient"))
    b = results.where(F.col("mode") == baseline).select(F.col("ord").alias("b_ord"), F.col("cost").alias("b_cost"), F.col("lenient").alias("b_lenient"))
    return f.join(b, F.col("ord") == F.col("b_ord"), "full").select(F.coalesce("ord", "b_ord").alias("ord"), "f_cost", "b_cost", "f_lenient", "b_lenient")
