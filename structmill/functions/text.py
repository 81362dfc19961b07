"""Text expressions: lines, tags, words, slugs, truncation, shell quoting. Built-in columns only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that open a rationale comment; fixed values.
TAGS = ("WHY", "NOTE", "IMPORTANT", "HACK", "TODO", "FIXME")
#: Words that say nothing about a task; fixed values.
STOP_WORDS = "a an the add new create update delete remove get set find list change modify in to for of from with on at by".split()
#: What may stand before a tag on its line; fixed values.
COMMENT_SIGNS = ("#", "//", "/*", "*")
#: A tagged comment line: a comment sign, the tag in any case, a colon, and text, of which a closing sign is no part.
TAGGED_LINE = "(?i)^\\s*(?:" + "|".join(re.escape(x) for x in COMMENT_SIGNS) + ")\\s*(" + "|".join(TAGS) + r")\s*:\s*(\S.*?)\s*(?:\*/)?\s*$"


def line_count(text: Column) -> Column:
    """Lines by line feeds, without the empty piece after a last line feed. Empty text has none, null gives null."""
    pieces = F.size(F.split(text, "\n"))
    return F.when(text.isNotNull(), pieces - F.when(text.endswith("\n") | (text == ""), 1).otherwise(0)).cast("bigint")


def comment_tag(line: Column) -> Column:
    """The tag of a tagged comment line, upper case; empty for other lines."""
    return F.upper(F.regexp_extract(line, TAGGED_LINE, 1))


def comment_text(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, TAGGED_LINE, 2))


def words(text: Column) -> Column:
    """Distinct lower-case words of three letters or more (a-z), without stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))), F.array(*[F.lit(w) for w in STOP_WORDS]))


def slug(text: Column) -> Column:
    """Lower case, other characters than a-z and 0-9 become single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def instance_id(family: Column, target: Column) -> Column:
    """``family_`` and the first eight hex digits of the SHA-256 of ``family:target``."""
    return F.concat(family, F.lit("_"), F.left(F.sha2(F.concat_ws(":", family, target), 256), F.lit(8)))


def truncated(text: Column, limit: int) -> Column:
    """At most ``limit`` characters; a longer text ends in three dots."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def shell_quoted(word: Column) -> Column:
    """As a shell takes it: plain words stay, others go between single quotes."""
    quoted = F.concat(F.lit("'"), F.replace(word, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when(word == "", F.lit("''")).when(word.rlike(r"^[A-Za-z0-9@%_+=:,./-]+$"), word).otherwise(quoted)


def source_name(source: Column) -> Column:
    """A free-text label in plain lower-case form; blank gives null."""
    name = F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")
    return F.when(name != "", name)


def detail_names(detail: Column) -> Column:
    """The names in ``module (a, b)``: what stands after the first bracket, at commas. No bracket: no names."""
    inside = F.regexp_replace(F.regexp_extract(detail, r"(?s)^[^(]*\((.*)$", 1), r"\)+\s*$", "")
    return F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(x)), lambda x: x != "")


def utc_minutes(at: Column) -> Column:
    """A timestamp as ``2025-01-31 08:05``; the session's time zone is taken to be UTC."""
    return F.date_format(at, "yyyy-MM-dd HH:mm")


def signed(value: Column, decimals: int = 1, unit: str = "") -> Column:
    """With a plus for what is above zero, a minus below; zero, also after rounding, has no sign."""
    rounded = F.bround(value.cast("double"), decimals)
    return F.when(value.isNull(), None).when(rounded == 0, F.format_string(f"%.{decimals}f{unit.replace('%', '%%')}", F.lit(0.0))).otherwise(F.format_string(f"%+.{decimals}f{unit.replace('%', '%%')}", rounded))
