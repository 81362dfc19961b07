"""Problem 5: functions paired with their documentation.

The files are read once for both questions: whether they parse (problem 3) and which functions they document.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structmill.llm.p3_syntax import judged_files
from structmill.llm.pairs import Pair, documented_functions, trivial
from structmill.sources.tables import table

_PAIR = pa.struct([("line", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("signature", pa.string()), ("documentation", pa.string()), ("code", pa.string())])
_PAIR_DDL = "struct<line: int, name: string, kind: string, signature: string, documentation: string, code: string>"


def _pairs(text: str, language: str) -> list[Pair]:
    return [p for p in documented_functions(text, language) if not trivial(p.documentation, p.name, language)]


def documented_pairs(source_files: DataFrame) -> DataFrame:
    """Functions and methods with a body and non-trivial documentation, in the files that parse.

    file_id, line (from 1) of the name, name, kind (function | method), signature, documentation, and the code from
    the signature to the end of the body, in Python without the docstring. A file that comes several times counts as
    its latest row. Null and empty content, unknown suffixes and rows without file_id give nothing.
    """
    files = judged_files(source_files, extras=(lambda text, language: [p._asdict() for p in _pairs(text, language)], _PAIR, _PAIR_DDL))
    return files.where(~F.col("invalid")).select("file_id", F.explode(F.array_distinct("extras")).alias("p")).select("file_id", "p.*")


def documented_lines(source_files: DataFrame) -> DataFrame:
    """file_id and line of :func:`documented_pairs`, once each; nothing else is shuffled."""
    files = judged_files(source_files, extras=(lambda text, language: [p.line for p in _pairs(text, language)], pa.int32(), "int"))
    return files.where(~F.col("invalid")).select("file_id", F.explode(F.array_distinct("extras")).alias("line"))


def p5_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return documented_lines(table(spark, data_dir, "source_files"))


def p5_pairs(spark: SparkSession, data_dir: str) -> DataFrame:
    """The code-description pairs themselves."""
    return documented_pairs(table(spark, data_dir, "source_files"))


QUERIES = {"p5_found": p5_found, "p5_pairs": p5_pairs}
SQL: dict[str, str] = {}
