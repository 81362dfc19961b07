"""Imports resolved to files: candidate paths are exploded and met by equality, never by prefix scans.

Relations: ``files`` (repo, path), ``imports`` (repo, path, module, names, line). A module is relative if it begins
with a dot. The outcome is one row per import with ``target`` (null: external) and the way it was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structmill.functions.paths import parent_dir, stem, suffix, without_suffix

#: Suffixes tried in this order, and index files; fixed values.
SUFFIXES = ("", ".py", ".js", ".jsx", ".mjs", ".ts", ".tsx", ".go", ".java", ".rs")
INDEX_FILES = ("/index.js", "/index.ts", "/index.tsx", "/__init__.py")


def module_keys(files: DataFrame) -> DataFrame:
    """Keys by which a file can be imported absolutely; keys of several files have a null path, except the full path itself.

    A package directory with ``__init__.py`` also makes its files known relative to the directory above it.
    """
    p = F.col("path")
    bare = without_suffix(p)
    init = stem(p) == "__init__"
    own = F.array_distinct(F.array_compact(F.array(F.when(~init, stem(p)), F.when(init, F.element_at(F.split(p, "/"), -2)), F.translate(bare, "/", "."), bare)))
    plain = files.select("repo", "path", F.explode(own).alias("key"))
    roots = files.where(stem(p) == "__init__").select(F.col("repo").alias("r_repo"), parent_dir(parent_dir(p, ""), "").alias("root")).where("root <> ''").distinct()
    under = files.select("repo", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(p, "/")) - 1), lambda n: F.array_join(F.slice(F.split(p, "/"), 1, n), "/"))).alias("above"))
    in_package = under.join(roots, (F.col("repo") == F.col("r_repo")) & (F.col("above") == F.col("root")))
    relative = F.translate(F.regexp_replace(F.substring(bare, F.length("root") + 2, 1 << 20), "/__init__$", ""), "/", ".")
    keyed = plain.unionByName(in_package.select("repo", "path", relative.alias("key"))).where("key <> ''").distinct()
    index = keyed.groupBy("repo", "key").agg(F.when(F.count(F.lit(1)) == 1, F.min("path")).alias("key_path"))
    exact = files.select("repo", F.col("path").alias("key"), F.col("path").alias("key_path"))
    return index.join(exact.select(F.col("repo").alias("x_repo"), F.col("key").alias("x_key")), (F.col("repo") == F.col("x_repo")) & (F.col("key") == F.col("x_key")), "left_anti").unionByName(exact)


def _bases(module: Column, importer: Column) -> Column:
    """The path that a relative module means, without suffix."""
    here = F.split(parent_dir(importer, ""), "/")
    here = F.filter(here, lambda x: x != "")
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    is_path = module.contains("/")
    ups = F.when(is_path, F.size(F.regexp_extract_all(module, F.lit(r"\G(\.\./)"), F.lit(1)))).otherwise(dots - 1)
    kept = F.slice(here, 1, F.greatest(F.size(here) - ups, F.lit(0)))
    rest = F.when(is_path, F.regexp_replace(F.regexp_replace(module, r"^(?:\.\./)+", ""), r"^\./", "")).otherwise(F.translate(F.regexp_replace(module, r"^\.+", ""), ".", "/"))
    return F.array_join(F.array_compact(F.concat(kept, F.array(F.nullif(rest, F.lit(""))))), "/")


def resolve_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Each import with ``target``. Absolute: by key; ambiguous keys and the importer itself give null. Relative: the exact
    path, then suffixes, then index files; several hits of one stage count only if one has the importer's suffix."""
    numbered = imports.withColumn("import_id", F.xxhash64("repo", "path", "module", "line", F.to_json("names")))
    relative = F.col("module").startswith(".")
    keys = module_keys(files).withColumnRenamed("repo", "k_repo")
    absolute = numbered.where(~relative).join(keys, (F.col("repo") == F.col("k_repo")) & (F.col("module") == F.col("key")), "left")
    absolute = absolute.select("import_id", "repo", "path", "module", "names", "line", F.when(F.col("key_path") != F.col("path"), F.col("key_path")).alias("target"))
    tried = [(0 if s == "" else 1, s) for s in SUFFIXES] + [(2, s) for s in INDEX_FILES]
    endings = F.array(*[F.struct(F.lit(stage).alias("stage"), F.lit(s).alias("ending")) for stage, s in tried])
    based = numbered.where(relative).withColumn("base", _bases(F.col("module"), F.col("path")))
    candidates = based.select("import_id", "repo", "path", "base", F.explode(endings).alias("e")).select("import_id", "repo", F.col("path").alias("importer"), "e.stage", F.concat("base", "e.ending").alias("candidate"))
    known = files.select(F.col("repo").alias("f_repo"), F.col("path").alias("f_path"))
    hits = candidates.join(known, (F.col("repo") == F.col("f_repo")) & (F.col("candidate") == F.col("f_path"))).where("candidate <> importer")
    own = F.when(suffix(F.col("candidate")) == suffix(F.col("importer")), F.col("candidate"))
    staged = hits.groupBy("import_id", "stage").agg(F.count_distinct("candidate").alias("n"), F.min("candidate").alias("one"), F.min(own).alias("own"))
    first = staged.groupBy(F.col("import_id").alias("h_id")).agg(F.min_by(F.struct("n", "one", "own"), "stage").alias("h"))
    found = based.join(first, F.col("import_id") == F.col("h_id"), "left").select("import_id", "repo", "path", "module", "names", "line", F.coalesce("h.own", F.when(F.col("h.n") == 1, F.col("h.one"))).alias("target"))
    return absolute.unionByName(found).drop("import_id")


def import_edges(resolved: DataFrame) -> DataFrame:
    """Edges of the imports that were resolved, with ``module (names)`` as their detail."""
    detail = F.concat(F.col("module"), F.when(F.size("names") > 0, F.concat(F.lit(" ("), F.array_join("names", ", "), F.lit(")"))).otherwise(""))
    return resolved.where(F.col("target").isNotNull()).select("repo", F.col("path").alias("source"), "target", F.lit("imports").alias("kind"), detail.alias("detail"), "line")


def external_imports(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("target").isNull()).select("repo", "path", "module", "names", "line")


def call_edges(resolved: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls of imported names: the callee must be a symbol of the file that the name was imported from.

    calls: repo, path, caller, callee, line, confidence; symbols: repo, path, name. Of several imports of one name
    the last line counts. ``*`` and ``_`` bind nothing.
    """
    bound = resolved.where(F.col("target").isNotNull()).select("repo", "path", F.explode("names").alias("name"), "line", "target").where(~F.col("name").isin("*", "_"))
    last = bound.groupBy("repo", "path", "name").agg(F.max_by("target", F.struct("line", "target")).alias("target"))
    named = last.select(F.col("repo").alias("b_repo"), F.col("path").alias("b_path"), F.col("name").alias("b_name"), "target")
    met = calls.join(named, (F.col("repo") == F.col("b_repo")) & (F.col("path") == F.col("b_path")) & (F.col("callee") == F.col("b_name")))
    there = symbols.select(F.col("repo").alias("s_repo"), F.col("path").alias("s_path"), F.col("name").alias("s_name")).distinct()
    sure = met.join(there, (F.col("repo") == F.col("s_repo")) & (F.col("target") == F.col("s_path")) & (F.col("callee") == F.col("s_name")), "left_semi")
    return sure.select("repo", F.col("path").alias("source"), "target", F.lit("calls").alias("kind"), F.concat_ws(" → ", "caller", "callee").alias("detail"), "line", "confidence")
