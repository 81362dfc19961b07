"""Parquet tables of a data directory, and cutting long lineages."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``data_dir``; only the columns a query selects are read."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Only a local session may go without: it gets a folder of this machine."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(?:\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no shared folder: executors could not read each other's checkpoints")
        shared = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the checkpoint folder, so that several uses read it back."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, by the hash of ``keys``; unchanged where it has them.

    For costly work in Python on a table of few files or row groups. Large tables come in enough splits and aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, *keys)
