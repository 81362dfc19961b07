"""Queries over extracted files: symbols, imports, comments, validation, incremental scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structmill.extract import extract_files
from structmill.functions import paths, text
from structmill.operators import graph, resolve
from structmill.plans.repository import _E
from structmill.operators.latest import latest
from structmill.sources.scan import scan
from structmill.sources.tables import table

#: Packages of standard libraries that are no dependency; fixed values.
STDLIB = (
    "os sys json typing pathlib datetime collections dataclasses abc enum re logging hashlib functools itertools io time math random copy uuid base64 urllib http email html xml csv "
    "contextlib inspect importlib pkgutil threading multiprocessing asyncio concurrent subprocess shutil tempfile glob fnmatch struct codecs string textwrap unicodedata socket ssl select "
    "signal warnings traceback types operator secrets __future__ builtins"
).split()
#: Spellings of languages; fixed values.
LANGUAGE_NAMES = {"js": "javascript", "ts": "typescript", "rs": "rust", "golang": "go", "py": "python"}
CURRENT_EXTRACTOR = "7c22e90d51aa83f6"


def _files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest(table(spark, d, "files"), "file_id", [F.col("scanned_at")], ["file_id", "repo", "file_path", *columns])


def _language():
    plain = F.lower(F.trim("language"))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in LANGUAGE_NAMES.items() for x in p]), plain), plain)


def public_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Public top-level symbols per file, the first eight by name."""
    own = F.filter("symbols", lambda s: (s["visibility"] == "public") & s["parent"].isNull())
    files = _files(spark, d, "symbols").select("file_id", "repo", "file_path", F.transform(own, lambda s: s["name"]).alias("names")).where(F.size("names") > 0)
    return files.select("file_id", "repo", "file_path", F.size("names").cast("bigint").alias("public"), F.array_join(F.slice("names", 1, 8), ",").alias("first_names"))


def long_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods that span five lines more than their first."""
    symbols = _files(spark, d, "symbols").select("file_id", F.explode("symbols").alias("s")).select("file_id", "s.name", "s.kind", "s.line_start", "s.line_end")
    return symbols.where(F.col("kind").isin("function", "method") & (F.col("line_start") > 0) & (F.col("line_end") > 0) & (F.col("line_end") - F.col("line_start") >= 5))


def symbol_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by language (spelled plainly), kind and visibility."""
    files = _files(spark, d, "language", "symbols").select(_language().alias("language"), F.explode("symbols").alias("s"))
    return files.groupBy("language", F.col("s.kind").alias("kind"), F.col("s.visibility").alias("visibility")).agg(F.count(F.lit(1)).alias("symbols"), F.count("s.docstring").alias("documented"))


def import_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct modules, symbols and calls per file."""
    modules = F.array_distinct(F.transform("imports", lambda i: i["module"]))
    n = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")
    return _files(spark, d, "imports", "symbols", "call_edges").select("file_id", n(modules).alias("import_count"), n("symbols").alias("symbol_count"), n("call_edges").alias("call_count"))


def external_packages(spark: SparkSession, d: str) -> DataFrame:
    """Packages (before the first dot) per repository: the fifteen most frequent, of these ten without standard libraries."""
    imports = _files(spark, d, "imports").select("repo", F.explode("imports").alias("i")).select("repo", F.substring_index("i.module", ".", 1).alias("package")).where("package <> ''")
    counted = imports.groupBy("repo", "package").agg(F.count(F.lit(1)).alias("imports"))
    first = counted.withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy(F.col("imports").desc(), "package"))).where("k <= 15")
    left = first.where(~F.col("package").isin(STDLIB)).withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.col("imports").desc(), "package")))
    return left.where("rank <= 10").select("repo", "package", "imports", "rank")


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "file_infos").select("repo", "path").distinct()
    imports = _files(spark, d, "imports").select("repo", F.col("file_path").alias("path"), F.explode("imports").alias("i")).select("repo", "path", "i.module", "i.names", "i.line")
    return resolve.resolve_imports(known, imports.where(F.col("module").isNotNull()).distinct())


def import_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Imports per repository and way of writing: resolved to a file or external."""
    way = F.when(F.col("module").startswith("."), "relative").otherwise("absolute")
    return _resolved(spark, d).groupBy("repo", way.alias("way")).agg(F.count(F.lit(1)).alias("imports"), F.count("target").alias("resolved"))


def declared_imports(spark: SparkSession, d: str) -> DataFrame:
    """Import edges of the graph written as imports, absolute with dots and relative with a path, and resolved again.

    Per repository and way: imports, those that were resolved, and those that led back to the edge's target.
    """
    edges = graph.edges_once(table(spark, d, "graph_edges"), "repo", "source", "target", "kind").where("kind = 'imports' AND target IS NOT NULL AND source <> target").select("repo", "source", "target").distinct()
    bare = paths.without_suffix(F.col("target"))
    climb = F.when(paths.parent_dir(F.col("source"), "") == "", F.lit("./")).otherwise(F.repeat(F.lit("../"), F.size(F.split(paths.parent_dir(F.col("source"), ""), "/"))))
    ways = F.array(F.struct(F.lit("absolute").alias("way"), F.translate(bare, "/", ".").alias("module")), F.struct(F.lit("relative").alias("way"), F.concat(climb, bare).alias("module")))
    written = edges.select("repo", F.col("source").alias("path"), "target", F.explode(ways).alias("w"))
    imports = written.select("repo", "path", "w.module", F.array("w.way", "target").alias("names"), F.lit(1).alias("line"))
    files = table(spark, d, "file_infos").select("repo", "path").where("path IS NOT NULL").distinct()
    resolved = resolve.resolve_imports(files, imports).withColumn("way", F.col("names")[0])
    return resolved.groupBy("repo", "way").agg(F.count(F.lit(1)).alias("imports"), F.count("target").alias("resolved"), F.count_if(F.col("target") == F.col("names")[1]).alias("led_back"))


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return resolve.import_edges(_resolved(spark, d))


def imported_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of imported names whose definition was found in the imported file."""
    files = _files(spark, d, "symbols", "call_edges")
    calls = files.select("repo", F.col("file_path").alias("path"), F.explode("call_edges").alias("c")).select("repo", "path", "c.*")
    symbols = files.select("repo", F.col("file_path").alias("path"), F.explode("symbols").alias("s")).select("repo", "path", "s.name")
    return resolve.call_edges(_resolved(spark, d), calls, symbols)


def local_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls per file whose callee is a symbol of the same file, and others."""
    files = _files(spark, d, "symbols", "call_edges")
    names = F.coalesce(F.transform("symbols", lambda s: s["name"]), F.array().cast("array<string>"))
    # counted per file: no call carries the file's symbols along
    n_local = F.size(F.filter("call_edges", lambda c: F.array_contains(names, c["callee"]))).cast("bigint")
    counted = files.where(F.size("call_edges") > 0).select("file_id", n_local.alias("local"), F.size("call_edges").alias("n"))
    return counted.select("file_id", "local", (F.col("n") - F.col("local")).alias("other"))


def rationale(spark: SparkSession, d: str) -> DataFrame:
    """Up to fifteen rationale comments per repository, the lowest lines last, with the symbol around each."""
    around = lambda r: F.try_element_at(F.filter("symbols", lambda s: (s["line_start"] <= r["line"]) & (r["line"] <= s["line_end"])), F.lit(-1))["name"]
    wanted = F.filter("rationale_comments", lambda r: r["tag"].isin("WHY", "HACK", "IMPORTANT", "NOTE"))
    # the symbol around is found before the comments part from their file
    named = F.transform(wanted, lambda r: F.struct(r["tag"].alias("tag"), r["line"].alias("line"), r["text"].alias("text"), around(r).alias("context")))
    kept = _files(spark, d, "symbols", "rationale_comments").select("repo", "file_path", F.explode(named).alias("r")).select("repo", "file_path", "r.tag", "r.line", text.truncated(F.col("r.text"), 120).alias("text"), "r.context")
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.col("line").desc(), "file_path", "tag", "text"))
    return kept.withColumn("rank", rank).where("rank <= 15")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "source_files"), "file_id", [F.col("ingested_at")], ["file_id", "repo", "file_path", "content"])


def tagged_comments(spark: SparkSession, d: str) -> DataFrame:
    """Tagged comment lines of the raw content."""
    lines = _sources(spark, d).select("file_id", F.posexplode(F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")).alias("n", "text"))
    tagged = lines.select("file_id", (F.col("n") + 1).alias("line"), text.comment_tag(F.col("text")).alias("tag"), text.comment_text(F.col("text")).alias("comment"))
    return tagged.where("tag <> ''")


def line_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the content against the recorded line_count."""
    recorded = _files(spark, d, "line_count").select(F.col("file_id").alias("r_file_id"), "line_count")
    counted = _sources(spark, d).select("file_id", text.line_count(F.regexp_replace("content", "\r\n", "\n")).alias("lines"))
    return counted.join(recorded, F.col("file_id") == F.col("r_file_id"), "left").select("file_id", "lines", (F.col("lines") == F.col("line_count")).alias("agrees"))


def cache_probe(spark: SparkSession, d: str) -> DataFrame:
    """Files whose extraction can be reused: same content hash, suffix and current extractor; hits and misses per repository."""
    cached = table(spark, d, "files").where(F.col("extractor_version") == CURRENT_EXTRACTOR).select(F.col("sha256").alias("c_sha"), paths.suffix(F.col("file_path")).alias("c_suffix")).distinct()
    sources = _sources(spark, d).select("repo", F.sha2("content", 256).alias("sha"), paths.suffix(F.col("file_path")).alias("suffix"))
    probed = sources.join(cached, (F.col("sha") == F.col("c_sha")) & (F.col("suffix") == F.col("c_suffix")), "left")
    return probed.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.count("c_sha").alias("hits"), (F.count(F.lit(1)) - F.count("c_sha")).alias("misses"))


def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    """Cache entries and bytes per extractor version."""
    entries = table(spark, d, "files").groupBy("sha256", paths.suffix(F.col("file_path")).alias("suffix"), "extractor_version").agg(F.max("file_size_bytes").alias("bytes"))
    return entries.groupBy("extractor_version").agg(F.count(F.lit(1)).alias("entries"), F.sum("bytes").alias("bytes"))


def scan_report(spark: SparkSession, d: str) -> DataFrame:
    """Per repository: files, those extracted by the current version, and those with errors."""
    files = _files(spark, d, "extractor_version", "extraction_errors")
    current = F.col("extractor_version") == CURRENT_EXTRACTOR
    return files.groupBy("repo").agg(F.count(F.lit(1)).alias("total"), F.count_if(current).alias("current"), F.count_if(~current).alias("stale"), F.count_if(F.size("extraction_errors") > 0).alias("failed"))


def invalid_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Files that break a rule of the extraction schema, by rule."""
    files = _files(spark, d, "language", "sha256", "line_count", "symbols", "imports", "call_edges")
    known = list({*LANGUAGE_NAMES.values()} | {"java"})
    rules = {
        "language": F.col("language").isNull() | ~F.col("language").isin(known),
        "sha256": F.coalesce(~F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(True)),
        "line_count": F.coalesce(F.col("line_count") < 0, F.lit(True)),
        "symbol_lines": F.exists(F.coalesce("symbols", F.array()), lambda s: F.coalesce(s["line_end"] < s["line_start"], F.lit(False))),
        "symbol_signature": F.exists(F.coalesce("symbols", F.array()), lambda s: F.coalesce(s["signature"], F.lit("")) == ""),
        "import_alias": F.exists(F.coalesce("imports", F.array()), lambda i: F.coalesce(i["alias"] == "", F.lit(False))),
        "confidence": F.exists(F.coalesce("call_edges", F.array()), lambda c: F.coalesce((c["confidence"] < 0) | (c["confidence"] > 1), F.lit(True))),
    }
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return files.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("files"))


def extracted_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols extracted from the raw content."""
    symbols = extract_files(_sources(spark, d)).select("file_id", F.explode("symbols").alias("s")).select("file_id", "s.*")
    return symbols.select("file_id", "name", "kind", "line_start", "line_end", "signature", "visibility", "parent", "docstring", "return_type")


def extracted_references(spark: SparkSession, d: str) -> DataFrame:
    """Imports, exports and calls extracted from the raw content, counted per file and kind."""
    files = extract_files(_sources(spark, d))
    parts = [files.select("file_id", F.lit(kind).alias("relation"), F.size(column).cast("bigint").alias("n")) for kind, column in (("imports", "imports"), ("exports", "exports"), ("calls", "call_edges"), ("comments", "rationale_comments"))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.where("n > 0")


def extraction_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Per suffix: recorded symbols, and those that a fresh extraction finds under the same name and kind.

    Functions and methods are one kind here: old extractors recorded the methods of some languages as functions.
    """
    kind = lambda c: F.when(F.col(c) == "method", "function").otherwise(F.col(c))
    recorded = _files(spark, d, "symbols").select("file_id", paths.suffix(F.col("file_path")).alias("suffix"), F.explode("symbols").alias("s")).select("file_id", "suffix", "s.name", kind("s.kind").alias("kind")).distinct()
    fresh = extracted_symbols(spark, d).select(F.col("file_id").alias("x_id"), F.col("name").alias("x_name"), kind("kind").alias("x_kind")).distinct()
    met = recorded.join(fresh, (F.col("file_id") == F.col("x_id")) & (F.col("name") == F.col("x_name")) & (F.col("kind") == F.col("x_kind")), "left")
    return met.groupBy("suffix").agg(F.count(F.lit(1)).alias("recorded"), F.count("x_id").alias("found"))


def incremental_scan(spark: SparkSession, d: str) -> DataFrame:
    """A scan that takes what the stored extractions still hold; files per repository and origin."""
    rows = scan(_sources(spark, d), table(spark, d, "files"), CURRENT_EXTRACTOR)
    return rows.groupBy("repo", "from_store").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("symbols")).cast("bigint").alias("symbols"), F.count_if(F.size("extraction_errors") > 0).alias("with_errors"))


QUERIES = {
    q.__name__: q
    for q in (
        public_symbols, long_functions, symbol_kinds, import_counts, external_packages, import_resolution, declared_imports, import_edges, imported_calls, local_calls, rationale, tagged_comments, line_counts,
        cache_probe, cache_stats, scan_report, invalid_extractions, extracted_symbols, extracted_references, extraction_agreement, incremental_scan,
    )
}

_FX = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC NULLS LAST) AS nn FROM files) WHERE nn = 1)"
_SX = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC NULLS LAST) AS nn FROM source_files) WHERE nn = 1)"
_LANG = "CASE lower(trim(language)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LANGUAGE_NAMES.items()) + " ELSE lower(trim(language)) END"
_SUFFIX = r"lower(regexp_extract(list_last(string_split({0}, '/')), '^.+(\.[^.]+)$', 1))"
_BARE = r"regexp_replace({0}, '^(.*[^/])\.[^./]+$', '\1')"
_STEM = r"regexp_replace(list_last(string_split({0}, '/')), '^(.+)\.[^.]+$', '\1')"
_DIRS = "list_filter(string_split(coalesce(nullif(regexp_extract({0}, '^(.*)/[^/]*$', 1), ''), ''), '/'), lambda x: x <> '')"
#: Imports i (id, repo, path, module) resolved as r (id, target): by key, or by the path that a relative module means with each ending.
_RESOLVED = rf"""kf AS (SELECT DISTINCT repo, path FROM file_infos WHERE path IS NOT NULL), kp AS (SELECT *, {_BARE.format('path')} AS bare, {_STEM.format('path')} AS stem, {_DIRS.format('path')} AS dirs FROM kf),
    kr AS (SELECT DISTINCT repo, array_to_string(list_slice(dirs, 1, len(dirs) - 1), '/') AS root FROM kp WHERE stem = '__init__' AND len(dirs) > 1),
    kk AS (SELECT repo, path, stem AS key FROM kp WHERE stem <> '__init__' UNION SELECT repo, path, list_last(dirs) FROM kp WHERE stem = '__init__' AND len(dirs) > 0 UNION SELECT repo, path, replace(bare, '/', '.') FROM kp UNION SELECT repo, path, bare FROM kp
        UNION SELECT kp.repo, path, replace(regexp_replace(substr(bare, length(root) + 2), '/__init__$', ''), '/', '.') FROM kp JOIN kr ON kr.repo = kp.repo AND starts_with(kp.path, root || '/')),
    ki AS (SELECT repo, key, CASE WHEN count(*) = 1 THEN min(path) END AS target FROM kk WHERE key <> '' AND (repo, key) NOT IN (SELECT (repo, path) FROM kf) GROUP BY ALL UNION ALL SELECT repo, path, path FROM kf),
    rb AS (SELECT *, contains(module, '/') AS p, {_DIRS.format('path')} AS here FROM i WHERE starts_with(module, '.')),
    ru AS (SELECT *, CASE WHEN p THEN length(regexp_extract(module, '^((?:\.\./)*)', 1)) // 3 ELSE length(regexp_extract(module, '^(\.*)', 1)) - 1 END AS ups,
        CASE WHEN p THEN regexp_replace(regexp_replace(module, '^(\.\./)+', ''), '^\./', '') ELSE replace(regexp_replace(module, '^\.+', ''), '.', '/') END AS rest FROM rb),
    rp AS (SELECT *, array_to_string(list_filter(list_concat(list_slice(here, 1, greatest(len(here) - ups, 0)), [rest]), lambda x: x <> ''), '/') AS base FROM ru),
    rc AS (SELECT id, rp.repo, path, unnest({[(0 if x == '' else 1, x) for x in resolve.SUFFIXES] + [(2, x) for x in resolve.INDEX_FILES]}) AS e, base FROM rp),
    rh AS (SELECT id, e[1] AS stage, base || e[2] AS hit, {_SUFFIX.format("base || e[2]")} = {_SUFFIX.format('rc.path')} AS same FROM rc JOIN kf ON kf.repo = rc.repo AND kf.path = base || e[2] WHERE base || e[2] <> rc.path),
    rs AS (SELECT id, stage, count(DISTINCT hit) AS n, min(hit) AS one, min(hit) FILTER (same) AS own FROM rh GROUP BY ALL), rf AS (SELECT id, coalesce(arg_min(own, stage), CASE WHEN arg_min(n, stage) = 1 THEN arg_min(one, stage) END) AS target FROM
        (SELECT * FROM rs WHERE stage = (SELECT min(stage) FROM rs x WHERE x.id = rs.id)) GROUP BY id),
    r AS (SELECT i.id, CASE WHEN starts_with(i.module, '.') THEN rf.target WHEN ki.target <> i.path THEN ki.target END AS target FROM i LEFT JOIN rf ON rf.id = i.id LEFT JOIN ki ON ki.repo = i.repo AND ki.key = i.module)"""
_I = f"""ii AS (SELECT DISTINCT repo, file_path AS path, x.module AS module, x.names AS names, x.line AS line FROM (SELECT repo, file_path, unnest(imports) AS x FROM f) WHERE x.module IS NOT NULL), i AS (SELECT row_number() OVER () AS id, * FROM ii)"""
_CLEAN = r"replace(content, chr(13) || chr(10), chr(10))"

SQL = {
    "public_symbols": f"""WITH {_FX}, n AS (SELECT file_id, repo, file_path, list_transform(list_filter(symbols, lambda x: x.visibility = 'public' AND x.parent IS NULL), lambda x: x.name) AS names FROM f)
        SELECT file_id, repo, file_path, len(names) AS public, array_to_string(list_slice(names, 1, 8), ',') AS first_names FROM n WHERE len(names) > 0""",
    "long_functions": f"""WITH {_FX}, u AS (SELECT file_id, unnest(symbols) AS x FROM f) SELECT file_id, x.name AS name, x.kind AS kind, x.line_start AS line_start, x.line_end AS line_end FROM u
        WHERE x.kind IN ('function', 'method') AND x.line_start > 0 AND x.line_end > 0 AND x.line_end - x.line_start >= 5""",
    "symbol_kinds": f"""WITH {_FX}, u AS (SELECT {_LANG} AS language, unnest(symbols) AS x FROM f)
        SELECT language, x.kind AS kind, x.visibility AS visibility, count(*) AS symbols, count(x.docstring) AS documented FROM u GROUP BY ALL""",
    "import_counts": f"""WITH {_FX} SELECT file_id, coalesce(len(list_distinct(list_transform(imports, lambda x: x.module))), 0) AS import_count, coalesce(len(symbols), 0) AS symbol_count, coalesce(len(call_edges), 0) AS call_count FROM f""",
    "external_packages": f"""WITH {_FX}, u AS (SELECT repo, unnest(imports) AS x FROM f), c AS (SELECT repo, string_split(x.module, '.')[1] AS package, count(*) AS imports FROM u WHERE string_split(x.module, '.')[1] <> '' GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY imports DESC, package) AS k FROM c), r AS (SELECT repo, package, imports, row_number() OVER (PARTITION BY repo ORDER BY imports DESC, package) AS rank
        FROM k WHERE k <= 15 AND package NOT IN ({', '.join(f"'{x}'" for x in STDLIB)})) SELECT * FROM r WHERE rank <= 10""",
    "import_resolution": f"""WITH {_FX}, {_I}, {_RESOLVED} SELECT repo, CASE WHEN starts_with(module, '.') THEN 'relative' ELSE 'absolute' END AS way, count(*) AS imports, count(target) AS resolved FROM i JOIN r USING (id) GROUP BY ALL""",
    "import_edges": f"""WITH {_FX}, {_I}, {_RESOLVED} SELECT repo, path AS source, target, 'imports' AS kind, module || CASE WHEN len(names) > 0 THEN ' (' || array_to_string(names, ', ') || ')' ELSE '' END AS detail, line FROM i JOIN r USING (id) WHERE target IS NOT NULL""",
    "declared_imports": rf"""WITH {_E}, de AS (SELECT DISTINCT repo, source, target FROM e WHERE kind = 'imports' AND source <> target), dw AS (SELECT repo, source AS path, target AS goal, 'absolute' AS way, replace({_BARE.format('target')}, '/', '.') AS module FROM de
        UNION ALL SELECT repo, source, target, 'relative', CASE WHEN contains(source, '/') THEN repeat('../', len(string_split(source, '/')) - 1) ELSE './' END || {_BARE.format('target')} FROM de),
        i AS (SELECT row_number() OVER () AS id, * FROM dw), {_RESOLVED} SELECT repo, way, count(*) AS imports, count(target) AS resolved, count(*) FILTER (target = goal) AS led_back FROM i JOIN r USING (id) GROUP BY ALL""",
    "imported_calls": f"""WITH {_FX}, {_I}, {_RESOLVED}, b AS (SELECT repo, path, unnest(names) AS name, line, target FROM i JOIN r USING (id) WHERE target IS NOT NULL),
        l AS (SELECT repo, path, name, target FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, name ORDER BY line DESC, target DESC) AS k FROM b WHERE name NOT IN ('*', '_')) WHERE k = 1),
        c AS (SELECT repo, file_path AS path, unnest(call_edges) AS c FROM f), y AS (SELECT DISTINCT repo, file_path AS path, unnest(symbols).name AS name FROM f)
        SELECT c.repo, c.path AS source, l.target, 'calls' AS kind, concat_ws(' → ', c.c.caller, c.c.callee) AS detail, c.c.line AS line, c.c.confidence AS confidence FROM c JOIN l ON l.repo = c.repo AND l.path = c.path AND l.name = c.c.callee
        WHERE EXISTS (SELECT 1 FROM y WHERE y.repo = c.repo AND y.path = l.target AND y.name = c.c.callee)""",
    "local_calls": f"""WITH {_FX}, u AS (SELECT file_id, list_transform(symbols, lambda x: x.name) AS names, unnest(call_edges) AS c FROM f)
        SELECT file_id, count(*) FILTER (list_contains(names, c.callee)) AS local, count(*) FILTER (NOT coalesce(list_contains(names, c.callee), false)) AS other FROM u GROUP BY file_id""",
    "rationale": f"""WITH {_FX}, u AS (SELECT repo, file_path, symbols, unnest(rationale_comments) AS r FROM f),
        t AS (SELECT repo, file_path, r.tag AS tag, r.line AS line, CASE WHEN length(r.text) > 120 THEN left(r.text, 117) || '...' ELSE r.text END AS text,
            list_last(list_filter(symbols, lambda x: x.line_start <= r.line AND r.line <= x.line_end)).name AS context FROM u WHERE r.tag IN ('WHY', 'HACK', 'IMPORTANT', 'NOTE'))
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY line DESC, file_path, tag, text) AS rank FROM t) WHERE rank <= 15""",
    "tagged_comments": rf"""WITH {_SX}, l AS (SELECT file_id, unnest(string_split({_CLEAN}, chr(10))) AS t, generate_subscripts(string_split({_CLEAN}, chr(10)), 1) AS line FROM s),
        m AS (SELECT file_id, line, upper(regexp_extract(t, '(?i)^\s*(?:#|//|/\*|\*)\s*(WHY|NOTE|IMPORTANT|HACK|TODO|FIXME)\s*:\s*(.+?)(?:\*/)?\s*$', 1)) AS tag,
            trim(regexp_extract(t, '(?i)^\s*(?:#|//|/\*|\*)\s*(WHY|NOTE|IMPORTANT|HACK|TODO|FIXME)\s*:\s*(.+?)(?:\*/)?\s*$', 2)) AS comment FROM l)
        SELECT file_id, line, tag, comment FROM m WHERE tag <> ''""",
    "line_counts": f"""WITH {_FX}, {_SX}, c AS (SELECT file_id, len(string_split({_CLEAN}, chr(10))) - CASE WHEN ends_with({_CLEAN}, chr(10)) OR content = '' THEN 1 ELSE 0 END AS lines FROM s)
        SELECT c.file_id, lines, lines = f.line_count AS agrees FROM c LEFT JOIN f ON f.file_id = c.file_id""",
    "cache_probe": f"""WITH {_SX}, c AS (SELECT DISTINCT sha256, {_SUFFIX.format('file_path')} AS suffix FROM files WHERE extractor_version = '{CURRENT_EXTRACTOR}'),
        p AS (SELECT repo, c.sha256 IS NOT NULL AS hit FROM s LEFT JOIN c ON c.sha256 = sha256(s.content) AND c.suffix = {_SUFFIX.format('s.file_path')})
        SELECT repo, count(*) AS files, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM p GROUP BY repo""",
    "cache_stats": f"""WITH e AS (SELECT sha256, {_SUFFIX.format('file_path')} AS suffix, extractor_version, max(file_size_bytes) AS bytes FROM files GROUP BY ALL)
        SELECT extractor_version, count(*) AS entries, CAST(sum(bytes) AS BIGINT) AS bytes FROM e GROUP BY ALL""",
    "scan_report": f"""WITH {_FX} SELECT repo, count(*) AS total, count(*) FILTER (extractor_version = '{CURRENT_EXTRACTOR}') AS current, count(*) FILTER (extractor_version <> '{CURRENT_EXTRACTOR}') AS stale,
        count(*) FILTER (len(extraction_errors) > 0) AS failed FROM f GROUP BY repo""",
    "invalid_extractions": rf"""WITH {_FX}, r AS (
        SELECT 'language' AS rule, count(*) FILTER (language IS NULL OR language NOT IN ('javascript', 'typescript', 'rust', 'go', 'python', 'java')) AS files FROM f
        UNION ALL SELECT 'sha256', count(*) FILTER (sha256 IS NULL OR NOT regexp_full_match(sha256, '[0-9a-f]{{64}}')) FROM f
        UNION ALL SELECT 'line_count', count(*) FILTER (line_count IS NULL OR line_count < 0) FROM f
        UNION ALL SELECT 'symbol_lines', count(*) FILTER (len(list_filter(symbols, lambda x: x.line_end < x.line_start)) > 0) FROM f
        UNION ALL SELECT 'symbol_signature', count(*) FILTER (len(list_filter(symbols, lambda x: coalesce(x.signature, '') = '')) > 0) FROM f
        UNION ALL SELECT 'import_alias', count(*) FILTER (len(list_filter(imports, lambda x: x.alias = '')) > 0) FROM f
        UNION ALL SELECT 'confidence', count(*) FILTER (len(list_filter(call_edges, lambda x: x.confidence IS NULL OR x.confidence < 0 OR x.confidence > 1)) > 0) FROM f)
        SELECT * FROM r WHERE files > 0""",
}
