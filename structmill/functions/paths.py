"""Path expressions. All are built-in columns; none looks at a file system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """One spelling per file: forward slashes, no doubled or leading slash, no ``.`` part, ``a/..`` removed.

    A ``..`` that climbs above the root stays. Null gives null; an empty path gives an empty path.
    """
    flat = F.regexp_replace(F.translate(F.trim(path), "\\", "/"), "/+", "/")
    kept = F.filter(F.split(flat, "/"), lambda p: (p != "") & (p != "."))
    climbed = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."),
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.array_append(acc, p)),
    )
    # one look settles the paths that are normal already
    odd = path.rlike(r"[\\]|//|(?:^|/)\.\.?(?:/|$)|^[/ ]|[/ ]$")
    return F.when(odd, F.array_join(climbed, "/")).otherwise(path)


def parent_dir(path: Column, root: str = "(root)") -> Column:
    """Directory of a path; ``root`` for a file at the top."""
    up = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path.isNull(), None).when(up == "", F.lit(root)).otherwise(up)


def dir_at_depth(path: Column, depth: int, root: str = "(root)") -> Column:
    """The first ``depth`` parts of a path with more than ``depth`` parts, else its parent."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > depth, F.array_join(F.slice(parts, 1, depth), "/")).otherwise(parent_dir(path, root))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Last suffix with its dot, lower case; empty where there is none. A leading dot starts no suffix."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(path, r"^(.*[^/])\.[^./]+$", "$1")


def ancestors(path: Column) -> Column:
    """The path itself and every directory above it, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
