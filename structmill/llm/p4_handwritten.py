"""Problem 4: generated, compressed, copied and data files among hand-written source.

Each file is read once, where it lies, and leaves a few numbers and its winnowed fingerprints. Copies of third-party
projects are found across files alone: a file most of whose fingerprints recur in several repositories of different
origin, whatever its folder or its notices say.

Fingerprints travel without their repositories: every task sends those of a class of exact copies once, so a file that
everybody has copied is no hot key. Where a class stands is counted apart, over all its files and whole origins, and
comes down to its smallest and greatest origin and whether there are others: the union of these tells "three or more"
exactly. One shuffle brings equal fingerprints together; only those that stand in several classes go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structmill.functions.paths import parent_dir
from structmill.llm.p3_syntax import suffix_language
from structmill.llm.shape import shape
from structmill.llm.syntax import language_of
from structmill.sources.tables import cut, spread, table

#: A fingerprint recurs if it stands in this many repositories of different origin.
LEAST_REPOS = 3
#: A copy has at least this share of recurring fingerprints, and at least so many (all, if it has fewer).
COPIED_SHARE, LEAST_RECURRING = 0.4, 3
#: Repositories of this many files that share the smallest hashes of their classes have one origin.
LEAST_TO_COMPARE = 8
#: A text is written out by a program if it repeats one shape: so few runs of tokens differ, and so small a share of
#: all runs. A larger share is allowed where the folder is marked as generated.
SHAPES, REPEATED, REPEATED_IF_MARKED = 60, 0.3, 0.42

_COLUMNS = [
    ("file_id", pa.int64()), ("seen", pa.string()), ("digest", pa.int64()), ("repo", pa.string()), ("path", pa.string()), ("banner", pa.bool_()), ("compressed", pa.bool_()), ("data", pa.bool_()),
    ("runs", pa.int32()), ("different_runs", pa.int32()), ("copies", pa.int64()), ("n", pa.int32()), ("prints", pa.list_(pa.int64())),
]
_SCHEMA = "file_id bigint, seen string, digest bigint, repo string, path string, banner boolean, compressed boolean, data boolean, runs int, different_runs int, copies bigint, n int, prints array<bigint>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sent: set[int] = set()  # classes whose fingerprints have been sent
    for batch in batches:
        rows = []
        for file_id, repo, path, text, seen in zip(*(c.to_pylist() for c in batch.columns)):
            s = shape(text, language_of(path))
            copies = xxhash.xxh64_intdigest(s.fingerprints.tobytes()) - (1 << 63)
            prints = s.fingerprints[:0] if copies in sent else s.fingerprints
            sent.add(copies)
            digest = xxhash.xxh64_intdigest(f"{repo}\0{path}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)
            rows.append((file_id, seen, digest, repo, path, s.banner, s.compressed, s.data, s.runs, s.different_runs, copies, len(s.fingerprints), prints))
        columns = list(zip(*rows)) or [[]] * len(_COLUMNS)
        offsets = pa.array(np.cumsum([0, *map(len, columns[-1])]), pa.int32())
        flat = pa.array(np.concatenate([np.zeros(0, np.int64), *columns[-1]]))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, (_, t) in zip(columns[:-1], _COLUMNS)), pa.ListArray.from_arrays(offsets, flat)], [name for name, _ in _COLUMNS])


def read_shapes(source_files: DataFrame) -> DataFrame:
    """Every row's shape, the number ``copies`` that exact copies share, ``n`` fingerprints, and themselves (``prints``) in the first row of a class in each task.

    A null repository is one without name. Rows without file_id or of unknown suffixes are left out.
    """
    rows = source_files.where(F.col("file_id").isNotNull() & suffix_language(F.col("file_path")).isNotNull())
    rows = rows.select("file_id", F.coalesce("repo", F.lit("")).alias("repo"), "file_path", F.coalesce("content", F.lit("")).alias("content"), F.col("ingested_at").cast("string").alias("seen"))
    return spread(rows, "file_id").mapInArrow(_read, _SCHEMA)


def latest_shapes(read: DataFrame) -> DataFrame:
    """One row per file_id, as its latest delivery has it (the greatest digest on ties), without fingerprints."""
    own = F.struct("repo", "path", "banner", "compressed", "data", "runs", "different_runs", "copies", "n")
    return read.groupBy("file_id").agg(F.max_by(own, F.struct("seen", "digest")).alias("s")).select("file_id", "s.*")


def origins_of_repos(files: DataFrame) -> DataFrame:
    """A number per repository that forks and mirrors share: both of its smallest class hashes, under two seeds.

    Two repositories whose classes overlap by a share J agree with probability J², so forks mostly do and others
    hardly ever. Smaller repositories than LEAST_TO_COMPARE have an origin of their own.
    """
    least = [F.min(F.xxhash64(F.lit(seed), F.col("copies"))).alias(f"m{seed}") for seed in (1, 2)]
    seen = files.where("n > 0").groupBy(F.col("repo").alias("o_repo")).agg(F.count(F.lit(1)).alias("files"), *least)
    return seen.select(F.xxhash64("o_repo").alias("o_who"), F.when(F.col("files") >= LEAST_TO_COMPARE, F.xxhash64("m1", "m2")).otherwise(F.xxhash64("o_repo")).alias("origin"))


def homes_of_classes(read: DataFrame, files: DataFrame) -> DataFrame:
    """Per class of exact copies: its smallest and greatest origin, and whether it has LEAST_REPOS or more. Every delivery counts."""
    known = read.where("n > 0").select(F.col("copies").alias("h_copies"), F.xxhash64("repo").alias("who")).join(origins_of_repos(files), F.col("who") == F.col("o_who"))
    each = known.select("h_copies", "origin").distinct()
    return each.groupBy("h_copies").agg(F.min("origin").alias("lo"), F.max("origin").alias("hi"), (F.count(F.lit(1)) >= LEAST_REPOS).alias("wide"))


def recurring_prints(read: DataFrame, homes: DataFrame) -> DataFrame:
    """copies, print: the fingerprints, shared by several classes, that stand in three or more origins. Those of one class stand where it stands."""
    same = Window.partitionBy("print")
    prints = read.select(F.explode("prints").alias("print"), "copies")
    shared = prints.withColumn("__least", F.min("copies").over(same)).withColumn("__most", F.max("copies").over(same)).where("__least < __most").select("print", "copies")
    ends = shared.join(homes, F.col("copies") == F.col("h_copies")).withColumn("__lo", F.min("lo").over(same)).withColumn("__hi", F.max("hi").over(same))
    between: list[Column] = [(F.col(end) > F.col("__lo")) & (F.col(end) < F.col("__hi")) for end in ("lo", "hi")]
    return ends.withColumn("__third", F.max(F.col("wide") | between[0] | between[1]).over(same)).where("__third").select("copies", "print").distinct()


def copied_classes(read: DataFrame, files: DataFrame, share: float = COPIED_SHARE, least: int = LEAST_RECURRING) -> DataFrame:
    """The classes of exact copies that mostly consist of fingerprints found in three repositories of different origin."""
    homes = homes_of_classes(read, files)
    hits = recurring_prints(read, homes).groupBy(F.col("copies").alias("c_copies")).agg(F.count(F.lit(1)).alias("hits"))
    sizes = files.where("n > 0").select("copies", "n").distinct()
    all_ = sizes.join(homes, F.col("copies") == F.col("h_copies")).join(hits, F.col("copies") == F.col("c_copies"), "left")
    met = all_.select("copies", "n", F.when(F.col("wide"), F.col("n")).otherwise(F.coalesce("hits", F.lit(0))).alias("hits"))
    return met.where((F.col("hits") >= share * F.col("n")) & (F.col("hits") >= F.least(F.col("n"), F.lit(least)))).select(F.col("copies").alias("c_copies"))


def origins(source_files: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per file: file_id, repo and ``origin``: copied | generated | compressed | data | hand.

    Judged from the content; a folder marked ``is_auto_generated`` only lowers the bar for repeated shapes. A null
    mark is none. Empty and null contents are by hand. Copies that stand in fewer than three repositories of different
    origin can't be told from a project's own code. Rows without file_id or of unknown suffixes are left out.
    """
    read = cut(read_shapes(source_files))
    files = cut(latest_shapes(read))
    marked = profiles.where(F.coalesce("is_auto_generated", F.lit(False))).select(F.col("repo").alias("m_repo"), F.col("path").alias("m_path"), F.lit(True).alias("marked")).distinct()
    copied = copied_classes(read, files).withColumn("copied", F.lit(True))
    all_ = files.join(marked, (F.col("repo") == F.col("m_repo")) & (parent_dir(F.col("path")) == F.col("m_path")), "left").join(copied, F.col("copies") == F.col("c_copies"), "left")
    bar = F.when(F.col("marked"), REPEATED_IF_MARKED).otherwise(REPEATED)
    origin = (
        F.when(F.col("copied"), "copied")
        .when(F.col("banner"), "generated")
        .when(F.col("compressed"), "compressed")
        .when(F.col("data"), "data")
        .when((F.col("different_runs") > 0) & (F.col("different_runs") <= SHAPES) & (F.col("different_runs") <= bar * F.col("runs")), "generated")
        .otherwise("hand")
    )
    return all_.select("file_id", "repo", origin.alias("origin"))


def _origins(spark: SparkSession, data_dir: str) -> DataFrame:
    return origins(table(spark, data_dir, "source_files"), table(spark, data_dir, "directory_profiles"))


def p4_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return _origins(spark, data_dir).where(F.col("origin") != "hand").select("file_id")


def p4_origins(spark: SparkSession, data_dir: str) -> DataFrame:
    """Files per repo and origin."""
    return _origins(spark, data_dir).groupBy("repo", "origin").agg(F.count(F.lit(1)).alias("files"))


QUERIES = {"p4_found": p4_found, "p4_origins": p4_origins}
SQL: dict[str, str] = {}
