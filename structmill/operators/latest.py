"""One row per identifier: the newest delivery of each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str | list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """Of the rows with one ``key`` the one that is greatest by ``order``, with the columns ``keep``.

    Partial aggregation runs before the shuffle, so repeats cost no traffic within a partition, and the
    result is evenly spread by the hash of the key. Nulls in ``order`` come first; remaining ties fall to the
    greatest values of ``keep``, so the result doesn't depend on row order. Rows whose key is null in every
    column can't be matched with each other: equal rows among them count as one record, others each as one.
    """
    keys = [key] if isinstance(key, str) else key
    unnamed = F.greatest(*[F.col(k).isNotNull().cast("int") for k in keys], F.lit(0)) == 0
    own = F.when(unnamed, F.xxhash64(*[F.col(c) for c in keep])).alias("__own")
    values = F.struct(*[F.col(c).alias(c) for c in keep])
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], values.alias("v"))
    picked = df.select(*keys, own, rank.alias("__r")).groupBy(*keys, "__own").agg(F.max("__r").alias("__r"))
    return picked.select(*[F.col(k) for k in keys if k not in keep], *[F.col(f"__r.v.{c}").alias(c) for c in keep])
