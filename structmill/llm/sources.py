"""Spelling of the free-text labels of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from structmill.functions.text import source_name  # noqa: F401 - one spelling for all


def language_name(lang: Column) -> Column:
    """The two-letter code at the start of a language tag, lower case; ``und`` where there is none."""
    code = F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(F.coalesce(code, F.lit("")) == "", "und").otherwise(code)
