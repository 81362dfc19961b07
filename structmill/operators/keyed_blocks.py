"""Results per key with even work, although a few keys hold most rows.

Every split of the input encodes its keys in a dictionary and adds its rows into dense arrays (numpy bincount
and scatter-reduce), so a hot key costs a split one slot, however many rows it has. The arrays are cut into
blocks by the hash of the key, and only blocks are shuffled: a key arrives at its block at most once per split.
The blocks of all splits are summed where they meet, again slot by slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots a split collects before it hands its arrays on and starts new ones.
MAX_SLOTS = 200_000

_START = {"sum": 0, "count": 0, "min": None, "max": None}


def _neutral(how: str, dtype: np.dtype):
    if how in ("sum", "count"):
        return dtype.type(0)
    info = np.finfo(dtype) if dtype.kind == "f" else np.iinfo(dtype)
    return info.max if how == "min" else info.min


class _Arrays:
    """A dictionary of keys and, by its codes, one dense array per measure."""

    def __init__(self, measures: list[tuple[str, np.dtype]]):
        self.measures = measures
        self.codes: dict[str, int] = {}
        self.arrays = [np.full(1024, _neutral(how, t), t) for how, t in measures]
        self.seen = [np.zeros(1024, np.int64) for _ in measures]

    def slots(self, keys: list[str]) -> np.ndarray:
        codes = self.codes
        out = np.fromiter((codes.setdefault(k, len(codes)) for k in keys), np.int64, len(keys))
        while len(codes) > len(self.seen[0]):
            for i, (how, t) in enumerate(self.measures):
                self.arrays[i] = np.concatenate([self.arrays[i], np.full(len(self.arrays[i]), _neutral(how, t), t)])
                self.seen[i] = np.concatenate([self.seen[i], np.zeros(len(self.seen[i]), np.int64)])
        return out

    def add(self, i: int, slots: np.ndarray, values: np.ndarray, seen: np.ndarray) -> None:
        """Scatter-reduce values into the array of measure i. seen: how many input values each stands for."""
        n = len(self.codes)
        how, t = self.measures[i]
        self.seen[i][:n] += np.bincount(slots, weights=seen, minlength=n).astype(np.int64)[:n]
        if how in ("sum", "count"):
            if t.kind == "f":
                self.arrays[i][:n] += np.bincount(slots, weights=values, minlength=n)[:n]
            else:
                np.add.at(self.arrays[i], slots, values)
        else:
            (np.minimum if how == "min" else np.maximum).at(self.arrays[i], slots, values)


def _lists(values: pa.Array, lengths: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)


def _partial(names: list[str], measures: list[tuple[str, np.dtype]]):
    def emit(acc: _Arrays, blocks: np.ndarray) -> pa.RecordBatch:
        n = len(acc.codes)
        order = np.argsort(blocks[:n], kind="stable")
        ids, lengths = np.unique(blocks[:n], return_counts=True)
        keys = pa.array(list(acc.codes), pa.string()).take(pa.array(order))
        columns = [pa.array(ids.astype(np.int32)), _lists(keys, lengths)]
        for i in range(len(measures)):
            columns += [_lists(pa.array(acc.arrays[i][:n][order]), lengths), _lists(pa.array(acc.seen[i][:n][order]), lengths)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, blocks = _Arrays(measures), np.zeros(1024, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            local = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            slots = acc.slots(coded.dictionary.to_pylist())
            if len(blocks) < len(acc.codes):
                blocks = np.concatenate([blocks, np.zeros(max(len(blocks), len(acc.codes) - len(blocks)), np.int64)])
            rows = slots[local]
            blocks[rows] = batch.column(1).to_numpy(zero_copy_only=False)
            for i, (_, t) in enumerate(measures):
                column = batch.column(2 + i)
                if column.null_count:
                    there = column.is_valid().to_numpy(zero_copy_only=False)
                    values, at = column.drop_null().to_numpy(zero_copy_only=False).astype(t), rows[there]
                else:
                    values, at = column.to_numpy(zero_copy_only=False).astype(t), rows
                acc.add(i, at, values, np.ones(len(at)))
            if len(acc.codes) >= MAX_SLOTS:
                yield emit(acc, blocks)
                acc = _Arrays(measures)
        if acc.codes:
            yield emit(acc, blocks)

    return run


def _final(names: list[str], measures: list[tuple[str, np.dtype]]):
    def emit(acc: _Arrays) -> pa.RecordBatch:
        n = len(acc.codes)
        columns = [pa.array(list(acc.codes), pa.string())]
        for i, (how, _) in enumerate(measures):
            none = acc.seen[i][:n] == 0
            columns.append(pa.array(acc.arrays[i][:n], mask=None if how == "count" else none))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, now = _Arrays(measures), None
        for batch in batches:
            for r, block in enumerate(batch.column(0).to_pylist()):
                if block != now and acc.codes:
                    yield emit(acc)
                    acc = _Arrays(measures)
                now = block
                slots = acc.slots(batch.column(1)[r].values.to_pylist())
                for i in range(len(measures)):
                    values = batch.column(2 + 2 * i)[r].values.to_numpy(zero_copy_only=False)
                    seen = batch.column(3 + 2 * i)[r].values.to_numpy(zero_copy_only=False)
                    there = seen > 0
                    acc.add(i, slots[there], values[there], seen[there])
        if acc.codes:
            yield emit(acc)

    return run


def key_totals(df: DataFrame, keys: list[str], measures: dict[str, tuple[str, Column]], blocks: int | None = None) -> DataFrame:
    """One row per distinct ``keys`` with the ``measures``: name -> (count | sum | min | max, column).

    ``df`` should come in even splits, such as the output of a shuffle on an identifier; no row moves again.
    Numbers only. Sums of integers are exact (64 bits), sums of doubles depend on addition order in the last
    bits. Null keys are keys like others; null values are skipped, and a key without any value gets null (a
    count: 0). An empty input gives no rows. ``blocks`` (default: four per shuffle partition) bounds how many
    keys meet in one block.
    """
    spark = df.sparkSession
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    key = F.to_json(F.struct(*keys))
    typed: list[tuple[str, np.dtype]] = []
    inputs, kinds = [], []
    for how, column in measures.values():
        if how not in _START:
            raise ValueError(f"unknown measure {how!r}")
        kind = "bigint" if how == "count" else df.select(column.alias("v")).schema["v"].dataType.simpleString()
        kind = "double" if kind in ("float", "double") or kind.startswith("decimal") else "bigint"
        value = F.when(column.isNotNull(), F.lit(1)).cast("bigint") if how == "count" else column.cast(kind)
        inputs.append(value.alias(f"__m{len(inputs)}"))
        kinds.append(kind)
        typed.append((how, np.dtype(np.float64 if kind == "double" else np.int64)))
    rows = df.select(key.alias("__key"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("__block"), *inputs)
    parts = [(f"v{i}", f"n{i}", kind) for i, kind in enumerate(kinds)]
    arrays = ", ".join(f"{v} array<{kind}>, {n} array<bigint>" for v, n, kind in parts)
    partial = rows.mapInArrow(_partial(["block", "keys", *(x for v, n, _ in parts for x in (v, n))], typed), f"block int, keys array<string>, {arrays}")
    met = partial.repartition(F.col("block")).sortWithinPartitions("block")
    final = met.mapInArrow(_final(["key", *measures], typed), "key string, " + ", ".join(f"`{m}` {kind}" for m, kind in zip(measures, kinds)))
    unpacked = F.from_json("key", key_schema)
    return final.select(unpacked.alias("k"), *[F.col(m) for m in measures]).select("k.*", *measures)
