"""The N best items of every group by secondary sort, streamed: no group is ever held in memory.

The first pass ranks within the partitions as they are, which are even because they come from a shuffle on the
item. It leaves at most N items per group and partition, so a group with a third of all rows sends as little as
any other. The second pass partitions by group, sorts by score and identifier, and keeps the first N again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _differs(column: pa.Array) -> np.ndarray:
    """For each row but the first: whether it differs from the one before. Nulls are equal."""
    before, here = column.slice(0, len(column) - 1), column.slice(1)
    unequal = pc.fill_null(pc.not_equal(before, here), False)
    return pc.or_(unequal, pc.xor(before.is_null(), here.is_null())).to_numpy(zero_copy_only=False)


def _first_rows(n: int, n_keys: int):
    """Of sorted batches, the first n distinct rows of each run of equal keys (the first n_keys columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the row before this batch
        taken = 0  # distinct rows so far of its group
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks().to_batches()[0]
            new_key = np.concatenate([[last is None], np.any([_differs(c) for c in rows.columns[:n_keys]], axis=0)])
            new_row = new_key | np.concatenate([[False], np.any([_differs(c) for c in rows.columns], axis=0)])
            if last is not None:
                new_key[0] = new_row[0] = False
            count = np.cumsum(new_row) + (taken if last is not None else 0)
            start = np.maximum.accumulate(np.where(new_key, np.arange(len(count)), -1))
            rank = np.where(start >= 0, count - count[start] + 1, count)
            keep = new_row & (rank <= n)
            if keep.any():
                yield rows.filter(pa.array(keep))
            last, taken = rows.slice(rows.num_rows - 1), int(rank[-1])

    return run


def top_n(df: DataFrame, groups: list[str], score: str, item: str, n: int) -> DataFrame:
    """Per ``groups`` the ``n`` rows greatest by ``score``; equal scores by ``item``, ascending in byte order.

    Rows with a null score or item don't rank. A null group is a group like others. A row that repeats another in
    all of these columns counts once. Fewer than ``n`` come out where a group has fewer; an empty input gives no
    rows. Other columns are dropped. ``df`` should be spread evenly by something other than the group.
    """
    columns = [*groups, score, item]
    rows = df.where(F.col(score).isNotNull() & F.col(item).isNotNull()).select(*columns)
    order = [*[F.col(g).asc() for g in groups], F.col(score).desc(), F.col(item).asc()]
    schema = rows.schema
    local = rows.sortWithinPartitions(*order).mapInArrow(_first_rows(n, len(groups)), schema)
    met = local.repartition(*[F.col(g) for g in groups]).sortWithinPartitions(*order)
    return met.mapInArrow(_first_rows(n, len(groups)), schema)
