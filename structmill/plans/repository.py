"""Directory and repository profiles over file_infos, graph_edges and symbol_refs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structmill.functions import paths
from structmill.operators import context, graph
from structmill.operators.latest import latest
from structmill.sources.tables import table

#: Directory names, fixed values.
GENERATED_DIRS = "migrations versions vendor node_modules dist build __pycache__ .cache generated gen static assets public".split()
TEST_DIRS = "test tests spec __tests__ testing".split()
GRAPH_TEST_DIRS = "tests test spec specs".split()
#: Stems of entry points, fixed values.
ENTRY_STEMS = "main app __main__ index server cli wsgi asgi".split()
#: The directories of the slice that slice_files and slice_edges report.
SLICE = ["src/shared", "tests"]


def _files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return graph.files_once(table(spark, d, "file_infos"), *columns)


def _edges(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Ends and the named columns only: fewer bytes to shuffle."""
    return graph.edges_once(table(spark, d, "graph_edges"), "repo", "source", "target", *columns).where(F.col("target").isNotNull())


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d, "directory", "symbol_count").withColumn("path", graph.path_id(F.col("path")))
    edges = graph.numbered_edges_once(table(spark, d, "graph_edges")).where(F.col("target").isNotNull())
    return graph.directory_pairs(files, edges)


def _profile(spark: SparkSession, d: str) -> DataFrame:
    """Files come in the same form for counts and pairs, so their exchange is used twice."""
    return graph.directory_edges(_files(spark, d, "directory", "symbol_count"), _pairs(spark, d))


def directory_profile(spark: SparkSession, d: str) -> DataFrame:
    """Directories with at least two files: counts, edges, density, flags."""
    profile = _profile(spark, d)
    last = F.lower(F.element_at(F.split("directory", "/"), -1))
    return profile.where("file_count >= 2").select("*", last.isin(TEST_DIRS).alias("is_test"), last.isin(GENERATED_DIRS).alias("is_auto_generated"))


def file_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_files(spark, d, "directory"), _edges(spark, d))


def directory_coupling(spark: SparkSession, d: str) -> DataFrame:
    return graph.coupling_bands(_pairs(spark, d))


def circular_directories(spark: SparkSession, d: str) -> DataFrame:
    return graph.circular_pairs(_pairs(spark, d))


def directory_partners(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_partners(_pairs(spark, d))


def first_seen_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.first_seen_edges(table(spark, d, "graph_edges"))


def call_hubs(spark: SparkSession, d: str) -> DataFrame:
    return graph.call_hubs(_edges(spark, d, "kind", "detail"))


def language_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Files per directory and language."""
    return _files(spark, d).groupBy("repo", "directory", "language").agg(F.count(F.lit(1)).alias("files"))


def dominant_language(spark: SparkSession, d: str) -> DataFrame:
    """Directories with at least three files of their main language, and its file with most symbols."""
    files = _files(spark, d).where(F.col("language").isNotNull())
    counted = files.groupBy("repo", "directory", "language").agg(F.count(F.lit(1)).alias("files"), F.min(F.struct((-F.coalesce("symbol_count", F.lit(0))).alias("s"), "path")).alias("example"))
    best = counted.groupBy("repo", "directory").agg(F.min(F.struct((-F.col("files")).alias("n"), "language", "example")).alias("b"))
    return best.select("repo", "directory", "b.language", (-F.col("b.n")).alias("files"), F.col("b.example.path").alias("example")).where("files >= 3")


def directory_ranking(spark: SparkSession, d: str) -> DataFrame:
    """All directories of each repository by incoming edges, most first, ties by path."""
    profile = _profile(spark, d)
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.col("incoming_edges").desc(), "directory"))
    return profile.select("repo", "directory", "incoming_edges", rank.alias("rank"))


def symbol_popularity(spark: SparkSession, d: str) -> DataFrame:
    """The ten most referenced symbols of each directory, with imports and calls apart."""
    refs = latest(table(spark, d, "symbol_refs"), "ref_id", [F.col("scanned_at")], ["repo", "path", "symbol", "kind", "ref_count"])
    one = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("ref_count"))), F.lit(0))
    sums = refs.groupBy("repo", "path", "symbol").agg(F.sum("ref_count").alias("refs"), one("import").alias("imports"), one("call").alias("calls")).where(F.col("refs").isNotNull())
    rank = F.row_number().over(Window.partitionBy("repo", "path").orderBy(F.col("refs").desc(), "symbol"))
    return sums.withColumn("rank", rank).where("rank <= 10")


def central_files(spark: SparkSession, d: str) -> DataFrame:
    """Files with three incoming edges or more, and whether no test covers them although they hold two symbols."""
    files, edges = _files(spark, d, "symbol_count"), _edges(spark, d, "kind")
    tested = edges.where("kind = 'tests'").select(F.col("repo").alias("t_repo"), F.col("target").alias("t_path")).distinct()
    deg = graph.degrees(files, edges).select(F.col("repo").alias("d_repo"), F.col("path").alias("d_path"), "in_degree")
    joined = files.join(deg, (F.col("repo") == F.col("d_repo")) & (F.col("path") == F.col("d_path"))).join(tested, (F.col("repo") == F.col("t_repo")) & (F.col("path") == F.col("t_path")), "left")
    untested = F.col("t_path").isNull() & (F.coalesce("symbol_count", F.lit(0)) >= 2)
    return joined.where("in_degree >= 3").select("repo", "path", "in_degree", untested.alias("untested"))


def _graph_test(path):
    stem = F.lower(paths.stem(path))
    parts = F.slice(F.split(F.lower(path), "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return stem.startswith("test_") | stem.endswith("_test") | F.arrays_overlap(parts, F.array(*[F.lit(x) for x in GRAPH_TEST_DIRS]))


def test_flags(spark: SparkSession, d: str) -> DataFrame:
    """The test-file definitions side by side: of the graph, of the profile and of the task context."""
    files = _files(spark, d).select("repo", "path", "directory")
    stem, name = F.lower(paths.stem(F.col("path"))), F.lower(paths.file_name(F.col("path")))
    six = F.array(*[F.lit(x) for x in [*GRAPH_TEST_DIRS, "__tests__", "testing"]])
    context = F.arrays_overlap(F.split(F.lower("path"), "/"), six) | stem.startswith("test") | stem.endswith("_test") | stem.endswith("_spec") | name.contains(".test.") | name.contains(".spec.")
    return files.select("repo", "path", _graph_test(F.col("path")).alias("graph_test"), F.lower(F.element_at(F.split("directory", "/"), -1)).isin(TEST_DIRS).alias("profile_test"), context.alias("context_test"))


def naming_test_map(spark: SparkSession, d: str) -> DataFrame:
    """Test files matched to source files by stem; a test edge wins over a name. Ties fall to the smallest path."""
    files, edges = _files(spark, d, "directory"), _edges(spark, d, "kind")
    is_test = _graph_test(F.col("path"))
    stem = F.lower(paths.stem(F.col("path")))
    bare = F.regexp_replace(F.regexp_replace(stem, "^(?:test_|spec_|test)", ""), "(?:_test|_spec)$", "")
    tests = files.where(is_test).select("repo", F.col("path").alias("test"), bare.alias("bare")).where("bare <> ''")
    sources = files.where(~is_test).groupBy(F.col("repo").alias("s_repo"), stem.alias("s_stem")).agg(F.min("path").alias("by_name"))
    by_edge = edges.where("kind = 'tests'").groupBy(F.col("repo").alias("e_repo"), F.col("source").alias("e_source")).agg(F.min("target").alias("by_edge"))
    joined = tests.join(sources, (F.col("repo") == F.col("s_repo")) & (F.col("bare") == F.col("s_stem")), "left").join(by_edge, (F.col("repo") == F.col("e_repo")) & (F.col("test") == F.col("e_source")), "left")
    return joined.select("repo", "test", F.coalesce("by_edge", "by_name").alias("source")).where(F.col("source").isNotNull())


def tested_sources(spark: SparkSession, d: str) -> DataFrame:
    """Test -> source: import and test edges of test files that end at other files, once each."""
    edges = _edges(spark, d, "kind").where("kind <> 'calls'")
    return edges.where(_graph_test(F.col("source")) & ~_graph_test(F.col("target"))).select("repo", "source", "target").distinct()


def entry_points(spark: SparkSession, d: str) -> DataFrame:
    """The ten files of each repository with an entry-point stem, by degree."""
    files = _files(spark, d).where(paths.stem(F.col("path")).isin(ENTRY_STEMS))
    deg = graph.degrees(files, _edges(spark, d)).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.col("degree").desc(), "path"))
    return deg.select("repo", "path", "degree", rank.alias("rank")).where("rank <= 10")


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """Path scalars of every file."""
    p = F.col("path")
    return _files(spark, d).select("repo", "path", paths.parent_dir(p).alias("parent"), paths.file_name(p).alias("name"), paths.stem(p).alias("stem"), paths.suffix(p).alias("suffix"), paths.without_suffix(p).alias("bare"), paths.dir_at_depth(p, 2).alias("dir2"))


def subtree_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Files and symbols under every directory at any depth: ancestors exploded, so a prefix join is an equality."""
    files = _files(spark, d).select("repo", F.explode(paths.ancestors(F.col("directory"))).alias("directory"), F.coalesce("symbol_count", F.lit(0)).alias("s"))
    return files.groupBy("repo", "directory").agg(F.count(F.lit(1)).alias("files"), F.sum("s").alias("symbols"))


def module_index(spark: SparkSession, d: str) -> DataFrame:
    """Keys under which a file can be imported (stem, dotted path, path with and without suffix); ``path`` is null where several files share one."""
    p = F.col("path")
    bare = paths.without_suffix(p)
    keys = F.array_distinct(F.array(paths.stem(p), F.translate(bare, "/", "."), bare, p))
    exploded = _files(spark, d).select("repo", "path", F.explode(keys).alias("key"))
    return exploded.groupBy("repo", "key").agg(F.count(F.lit(1)).alias("files"), F.when(F.count(F.lit(1)) == 1, F.min("path")).alias("path"))


def size_tier(spark: SparkSession, d: str) -> DataFrame:
    """Repositories by files: small, medium, large, very large; and whether they are to be decomposed."""
    flagged = _files(spark, d).withColumn("own", ~F.lower(F.element_at(F.split("directory", "/"), -1)).isin(GENERATED_DIRS))
    n = F.count(F.lit(1))
    tier = F.when(n < 150, "small").when(n < 800, "medium").when(n < 2000, "large").otherwise("very_large")
    return flagged.groupBy("repo").agg(n.alias("files"), tier.alias("tier"), (F.count_if("own") >= 50).alias("decompose"))


def name_patterns(spark: SparkSession, d: str) -> DataFrame:
    """At least three files of one shape of name (first word and suffix) in a directory."""
    files = _files(spark, d)
    shape = F.concat(F.regexp_extract(paths.stem(F.col("path")), "^([A-Za-z]+)", 1), F.lit("*"), paths.suffix(F.col("path")))
    return files.groupBy("repo", "directory", shape.alias("shape")).agg(F.count(F.lit(1)).alias("files")).where("files >= 3")


def slice_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of a slice given by directories or paths: any ancestor equals one of them."""
    wanted = F.array(*[F.lit(x) for x in SLICE])
    return _files(spark, d).where(F.arrays_overlap(paths.ancestors(F.col("path")), wanted)).select("repo", "path", "language", F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"))


def slice_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the slice per repository and side (internal, outgoing, incoming) and other directory."""
    wanted = F.array(*[F.lit(x) for x in SLICE])
    s = F.arrays_overlap(paths.ancestors(F.col("source")), wanted)
    t = F.arrays_overlap(paths.ancestors(F.col("target")), wanted)
    side = F.when(s & t, "internal").when(s, "outgoing").when(t, "incoming")
    other = F.when(s & t, "").when(s, paths.parent_dir(F.col("target"))).otherwise(paths.parent_dir(F.col("source")))
    edges = _edges(spark, d).withColumns({"side": side, "other": other}).where(F.col("side").isNotNull())
    return edges.groupBy("repo", "side", "other").agg(F.count(F.lit(1)).alias("edges"))


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    files = latest(table(spark, d, "files"), "file_id", [F.col("scanned_at")], ["file_id", "repo", "file_path", "symbols"])
    return files.select("repo", F.col("file_path").alias("path"), F.explode("symbols").alias("s")).select("repo", "path", "s.name", F.col("s.line_start").alias("line"), "s.visibility", "s.parent").distinct()


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """The files that were extracted, with their directories."""
    return table(spark, d, "files").where(F.col("file_path").isNotNull()).select("repo", F.col("file_path").alias("path"), paths.parent_dir(F.col("file_path")).alias("directory")).distinct()


def directory_signatures(spark: SparkSession, d: str) -> DataFrame:
    """The five most imported files of each directory, of these those with public top-level symbols, eight each."""
    files = _placed(spark, d)
    return context.signatures(files, graph.degrees(files, _edges(spark, d)), _symbols(spark, d)).withColumn("symbols", F.array_join("symbols", ","))


def directory_summary(spark: SparkSession, d: str) -> DataFrame:
    """Directories of two files and more with the first three symbols of each file, ten in all."""
    return context.top_symbols(_placed(spark, d), _symbols(spark, d)).withColumn("top_symbols", F.array_join("top_symbols", ","))


def usual_directory(spark: SparkSession, d: str) -> DataFrame:
    """Where a repository's files usually go: its largest directory without tests, else its largest."""
    return context.usual_directory(_files(spark, d, "directory"))


def profile_lag(spark: SparkSession, d: str) -> DataFrame:
    """Stored directory profiles against a fresh count: matched, changed, missing, stale."""
    fresh = _files(spark, d).groupBy("repo", F.col("directory").alias("path")).agg(F.count(F.lit(1)).alias("files"))
    stored = table(spark, d, "directory_profiles").select(F.col("repo").alias("s_repo"), F.col("path").alias("s_path"), "file_count")
    both = fresh.join(stored, (F.col("repo") == F.col("s_repo")) & (F.col("path") == F.col("s_path")), "full")
    state = F.when(F.col("s_path").isNull(), "missing").when(F.col("path").isNull(), "stale").when(F.col("files") == F.col("file_count"), "matched").otherwise("changed")
    return both.select(F.coalesce("repo", "s_repo").alias("repo"), state.alias("state")).groupBy("repo", "state").agg(F.count(F.lit(1)).alias("directories"))


_F = """f AS (SELECT repo, path, directory, language, symbol_count, import_count FROM (
    SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY scanned_at DESC NULLS LAST) AS n FROM file_infos) WHERE n = 1)"""
_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(replace(trim({0}), '\', '/'), '/+', '/', 'g'), '^(\./)+|^/', ''), '/(\./)+', '/', 'g')"
_E = f"""e AS (SELECT edge_id, repo, {_NORMAL.format("source")} AS source, {_NORMAL.format("target")} AS target, kind, detail FROM (
    SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY scanned_at DESC NULLS LAST) AS n FROM graph_edges) WHERE n = 1 AND target IS NOT NULL)"""
_P = """p AS (SELECT e.repo, a.directory AS source_dir, b.directory AS target_dir, count(*) AS edges FROM e
    JOIN f a ON a.repo = e.repo AND a.path = e.source JOIN f b ON b.repo = e.repo AND b.path = e.target GROUP BY ALL)"""
_D = """d AS (SELECT f.repo, f.directory, count(*) AS file_count, CAST(coalesce(sum(symbol_count), 0) AS BIGINT) AS symbol_count FROM f GROUP BY ALL),
x AS (SELECT d.*, CAST(coalesce((SELECT sum(edges) FROM p WHERE p.repo = d.repo AND source_dir = d.directory AND target_dir = d.directory), 0) AS BIGINT) AS internal_edges,
    CAST(coalesce((SELECT sum(edges) FROM p WHERE p.repo = d.repo AND source_dir = d.directory AND target_dir <> d.directory), 0) AS BIGINT) AS outgoing_edges,
    CAST(coalesce((SELECT sum(edges) FROM p WHERE p.repo = d.repo AND target_dir = d.directory AND source_dir <> d.directory), 0) AS BIGINT) AS incoming_edges FROM d)"""


_S = """sy AS (SELECT DISTINCT repo, path, u.name AS name, u.line_start AS line, u.visibility AS visibility, u.parent AS parent FROM (SELECT repo, file_path AS path, unnest(symbols) AS u FROM (
    SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC NULLS LAST) AS n FROM files) WHERE n = 1))"""


def _in(column: str, names: list[str]) -> str:
    return f"{column} IN (" + ", ".join(f"'{n}'" for n in names) + ")"


_LAST = "list_last(string_split({0}, '/'))"
_LAST_DIR = "lower(list_last(string_split(directory, '/')))"
_STEM = r"regexp_replace(list_last(string_split({0}, '/')), '^(.+)\.[^.]+$', '\1')"
_SUFFIX = r"lower(regexp_extract(list_last(string_split({0}, '/')), '^.+(\.[^.]+)$', 1))"
_PARENT = "coalesce(nullif(regexp_extract({0}, '^(.*)/[^/]*$', 1), ''), '(root)')"


def _gt(path: str) -> str:
    stem = f"lower({_STEM.format(path)})"
    dirs = f"list_slice(string_split(lower({path}), '/'), 1, len(string_split({path}, '/')) - 1)"
    return f"(starts_with({stem}, 'test_') OR ends_with({stem}, '_test') OR list_has_any({dirs}, ['test', 'tests', 'spec', 'specs']))"


_ANC = "list_transform(range(1, len(string_split({0}, '/')) + 1), lambda n: array_to_string(list_slice(string_split({0}, '/'), 1, n), '/'))"
_SLICED = "list_has_any(" + _ANC + f", {SLICE})"

QUERIES = {
    q.__name__: q
    for q in (
        directory_profile, file_degrees, directory_coupling, circular_directories, directory_partners, first_seen_edges, call_hubs, language_histogram, dominant_language,
        directory_ranking, symbol_popularity, central_files, test_flags, naming_test_map, tested_sources, entry_points, path_parts, subtree_sizes, module_index, size_tier,
        name_patterns, slice_files, slice_edges, profile_lag, directory_signatures, directory_summary, usual_directory,
    )
}

SQL = {
    "directory_profile": f"""WITH {_F}, {_E}, {_P}, {_D} SELECT *, CASE WHEN internal_edges + outgoing_edges = 0 THEN 0.0 ELSE round_even(internal_edges / (internal_edges + outgoing_edges), 3) END AS edge_density,
        {_in(_LAST_DIR, TEST_DIRS)} AS is_test, {_in(_LAST_DIR, GENERATED_DIRS)} AS is_auto_generated FROM x WHERE file_count >= 2""",
    "file_degrees": f"""WITH {_F}, {_E}, o AS (SELECT repo, source AS path, count(*) AS n FROM e GROUP BY ALL), i AS (SELECT repo, target AS path, count(*) AS n FROM e GROUP BY ALL)
        SELECT f.repo, f.path, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM f LEFT JOIN o USING (repo, path) LEFT JOIN i USING (repo, path)""",
    "directory_coupling": f"""WITH {_F}, {_E}, {_P} SELECT *, CASE WHEN edges >= 50 THEN 'strong' WHEN edges >= 10 THEN 'moderate' ELSE 'light' END AS band FROM p WHERE source_dir <> target_dir AND edges >= 5""",
    "circular_directories": f"""WITH {_F}, {_E}, {_P} SELECT a.repo, a.source_dir AS dir_a, a.target_dir AS dir_b, a.edges AS a_to_b, b.edges AS b_to_a, a.edges + b.edges AS total
        FROM p a JOIN p b ON a.repo = b.repo AND a.source_dir = b.target_dir AND a.target_dir = b.source_dir WHERE a.source_dir < a.target_dir""",
    "directory_partners": f"""WITH {_F}, {_E}, {_P}, h AS (SELECT repo, source_dir AS directory, 'outgoing' AS direction, target_dir AS partner, edges FROM p WHERE source_dir <> target_dir
        UNION ALL SELECT repo, target_dir, 'incoming', source_dir, edges FROM p WHERE source_dir <> target_dir)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, directory, direction ORDER BY edges DESC, partner) AS rank FROM h) WHERE rank <= 5""",
    "first_seen_edges": f"""WITH {_E} SELECT repo, source, target, kind, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY repo, source, target, kind ORDER BY edge_id) AS k FROM e) WHERE k = 1 OR kind = 'calls'""",
    "call_hubs": f"""WITH {_E}, c AS (SELECT repo, target, CASE WHEN detail LIKE '%→%' THEN trim(list_last(string_split(detail, '→'))) END AS callee FROM e WHERE kind = 'calls'),
        n AS (SELECT repo, target, list_sort(list(DISTINCT callee) FILTER (callee IS NOT NULL)) AS names, count(*) AS calls FROM c GROUP BY ALL)
        SELECT repo, target AS path, calls, coalesce(array_to_string(list_slice(names, 1, 5), ','), '') AS callees FROM n WHERE calls >= 5""",
    "language_histogram": f"WITH {_F} SELECT repo, directory, language, count(*) AS files FROM f GROUP BY ALL",
    "dominant_language": f"""WITH {_F}, c AS (SELECT repo, directory, language, count(*) AS files FROM f WHERE language IS NOT NULL GROUP BY ALL),
        b AS (SELECT *, row_number() OVER (PARTITION BY repo, directory ORDER BY files DESC, language) AS k FROM c),
        x AS (SELECT *, row_number() OVER (PARTITION BY repo, directory, language ORDER BY coalesce(symbol_count, 0) DESC, path) AS k FROM f)
        SELECT b.repo, b.directory, b.language, b.files, x.path AS example FROM b JOIN x ON x.repo = b.repo AND x.directory = b.directory AND x.language = b.language AND x.k = 1 WHERE b.k = 1 AND b.files >= 3""",
    "directory_ranking": f"WITH {_F}, {_E}, {_P}, {_D} SELECT * FROM (SELECT repo, directory, incoming_edges, row_number() OVER (PARTITION BY repo ORDER BY incoming_edges DESC, directory) AS rank FROM x)",
    "symbol_popularity": """WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY scanned_at DESC NULLS LAST) AS n FROM symbol_refs) WHERE n = 1),
        s AS (SELECT repo, path, symbol, CAST(sum(ref_count) AS BIGINT) AS refs, CAST(coalesce(sum(ref_count) FILTER (kind = 'import'), 0) AS BIGINT) AS imports,
            CAST(coalesce(sum(ref_count) FILTER (kind = 'call'), 0) AS BIGINT) AS calls FROM r GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY refs DESC, symbol) AS rank FROM s WHERE refs IS NOT NULL) WHERE rank <= 10""",
    "central_files": f"""WITH {_F}, {_E}, i AS (SELECT repo, target AS path, count(*) AS in_degree, bool_or(kind = 'tests') AS tested FROM e GROUP BY ALL)
        SELECT f.repo, f.path, in_degree, NOT tested AND coalesce(symbol_count, 0) >= 2 AS untested FROM f JOIN i USING (repo, path) WHERE in_degree >= 3""",
    "test_flags": f"""WITH {_F}, s AS (SELECT *, lower({_STEM.format('path')}) AS st, lower({_LAST.format('path')}) AS nm FROM f)
        SELECT repo, path, {_gt('path')} AS graph_test, {_in(_LAST_DIR, TEST_DIRS)} AS profile_test,
            list_has_any(string_split(lower(path), '/'), ['test', 'tests', 'spec', 'specs', '__tests__', 'testing']) OR starts_with(st, 'test') OR ends_with(st, '_test') OR ends_with(st, '_spec')
            OR contains(nm, '.test.') OR contains(nm, '.spec.') AS context_test FROM s""",
    "naming_test_map": rf"""WITH {_F}, {_E}, s AS (SELECT *, lower({_STEM.format('path')}) AS st, {_gt('path')} AS is_test FROM f),
        t AS (SELECT repo, path AS test, regexp_replace(regexp_replace(st, '^(test_|spec_|test)', ''), '(_test|_spec)$', '') AS bare FROM s WHERE is_test),
        by_name AS (SELECT repo, st, min(path) AS source FROM s WHERE NOT is_test GROUP BY ALL), by_edge AS (SELECT repo, source AS test, min(target) AS source FROM e WHERE kind = 'tests' GROUP BY ALL)
        SELECT t.repo, t.test, coalesce(b.source, n.source) AS source FROM t LEFT JOIN by_name n ON n.repo = t.repo AND n.st = t.bare LEFT JOIN by_edge b ON b.repo = t.repo AND b.test = t.test
        WHERE t.bare <> '' AND coalesce(b.source, n.source) IS NOT NULL""",
    "tested_sources": f"WITH {_E} SELECT DISTINCT repo, source, target FROM e WHERE kind <> 'calls' AND {_gt('source')} AND NOT {_gt('target')}",
    "entry_points": f"""WITH {_F}, {_E}, n AS (SELECT repo, source AS path FROM e UNION ALL SELECT repo, target FROM e), g AS (SELECT repo, path, count(*) AS n FROM n GROUP BY ALL),
        c AS (SELECT f.repo, f.path, coalesce(g.n, 0) AS degree FROM f LEFT JOIN g USING (repo, path) WHERE {_in(_STEM.format('f.path'), ENTRY_STEMS)})
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY degree DESC, path) AS rank FROM c) WHERE rank <= 10""",
    "path_parts": rf"""WITH {_F} SELECT repo, path, {_PARENT.format('path')} AS parent, {_LAST.format('path')} AS name, {_STEM.format('path')} AS stem, {_SUFFIX.format('path')} AS suffix,
        regexp_replace(path, '^(.*[^/])\.[^./]+$', '\1') AS bare,
        CASE WHEN len(string_split(path, '/')) > 2 THEN array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') ELSE {_PARENT.format('path')} END AS dir2 FROM f""",
    "subtree_sizes": f"""WITH {_F}, a AS (SELECT repo, unnest({_ANC.format('directory')}) AS directory, coalesce(symbol_count, 0) AS s FROM f)
        SELECT repo, directory, count(*) AS files, CAST(sum(s) AS BIGINT) AS symbols FROM a GROUP BY ALL""",
    "module_index": rf"""WITH {_F}, k AS (SELECT repo, path, {_STEM.format('path')} AS key FROM f UNION SELECT repo, path, replace(regexp_replace(path, '^(.*[^/])\.[^./]+$', '\1'), '/', '.') FROM f
        UNION SELECT repo, path, regexp_replace(path, '^(.*[^/])\.[^./]+$', '\1') FROM f UNION SELECT repo, path, path FROM f)
        SELECT repo, key, count(*) AS files, CASE WHEN count(*) = 1 THEN min(path) END AS path FROM k GROUP BY ALL""",
    "size_tier": f"""WITH {_F} SELECT repo, count(*) AS files, CASE WHEN count(*) < 150 THEN 'small' WHEN count(*) < 800 THEN 'medium' WHEN count(*) < 2000 THEN 'large' ELSE 'very_large' END AS tier,
        count(*) FILTER (NOT {_in(_LAST_DIR, GENERATED_DIRS)}) >= 50 AS decompose FROM f GROUP BY repo""",
    "name_patterns": f"""WITH {_F} SELECT repo, directory, regexp_extract({_STEM.format('path')}, '^([A-Za-z]+)', 1) || '*' || {_SUFFIX.format('path')} AS shape, count(*) AS files FROM f GROUP BY ALL HAVING count(*) >= 3""",
    "slice_files": f"WITH {_F} SELECT repo, path, language, coalesce(symbol_count, 0) AS symbol_count FROM f WHERE {_SLICED.format('path')}",
    "slice_edges": f"""WITH {_E}, s AS (SELECT *, {_SLICED.format('source')} AS s, {_SLICED.format('target')} AS t FROM e)
        SELECT repo, CASE WHEN s AND t THEN 'internal' WHEN s THEN 'outgoing' ELSE 'incoming' END AS side, CASE WHEN s AND t THEN '' WHEN s THEN {_PARENT.format('target')} ELSE {_PARENT.format('source')} END AS other,
        count(*) AS edges FROM s WHERE s OR t GROUP BY ALL""",
    "directory_signatures": f"""WITH {_E}, {_S}, p AS (SELECT DISTINCT repo, file_path AS path, {_PARENT.format('file_path')} AS directory FROM files WHERE file_path IS NOT NULL),
        i AS (SELECT repo, target AS path, count(*) AS n FROM e GROUP BY ALL), h AS (SELECT DISTINCT repo, path FROM sy),
        k AS (SELECT p.*, coalesce(i.n, 0) AS in_degree, row_number() OVER (PARTITION BY p.repo, directory ORDER BY coalesce(i.n, 0) DESC, p.path) AS rank FROM p JOIN h USING (repo, path) LEFT JOIN i USING (repo, path)),
        t AS (SELECT repo, path, name, row_number() OVER (PARTITION BY repo, path ORDER BY line NULLS FIRST, name NULLS FIRST) AS place FROM sy WHERE visibility = 'public' AND coalesce(parent, '') = ''),
        l AS (SELECT repo, path, string_agg(name, ',' ORDER BY place) AS symbols FROM t WHERE place <= 8 GROUP BY ALL)
        SELECT repo, directory, path, in_degree, rank, symbols FROM k JOIN l USING (repo, path) WHERE rank <= 5""",
    "directory_summary": f"""WITH {_S}, p AS (SELECT DISTINCT repo, file_path AS path, {_PARENT.format('file_path')} AS directory FROM files WHERE file_path IS NOT NULL),
        w AS (SELECT repo, directory, count(*) AS file_count FROM p GROUP BY ALL HAVING count(*) >= 2),
        t AS (SELECT repo, path, coalesce(name, '') AS name, row_number() OVER (PARTITION BY repo, path ORDER BY line NULLS FIRST, name NULLS FIRST) AS place FROM sy),
        r AS (SELECT p.repo, p.directory, t.name, row_number() OVER (PARTITION BY p.repo, p.directory ORDER BY p.path, place) AS rank FROM t JOIN p USING (repo, path) WHERE place <= 3),
        l AS (SELECT repo, directory, string_agg(name, ',' ORDER BY rank) AS top_symbols FROM r WHERE rank <= 10 GROUP BY ALL)
        SELECT w.repo, w.directory, file_count, coalesce(top_symbols, '') AS top_symbols FROM w LEFT JOIN l USING (repo, directory)""",
    "usual_directory": f"""WITH {_F}, c AS (SELECT repo, directory, count(*) AS files, min(path) AS example, list_has_any(string_split(lower(directory), '/'), {context.TEST_PARTS}) AS t FROM f GROUP BY ALL)
        SELECT repo, directory, files, example FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY t, files DESC, directory) AS k FROM c) WHERE k = 1""",
    "profile_lag": f"""WITH {_F}, n AS (SELECT repo, directory AS path, count(*) AS files FROM f GROUP BY ALL)
        SELECT coalesce(n.repo, s.repo) AS repo, CASE WHEN s.path IS NULL THEN 'missing' WHEN n.path IS NULL THEN 'stale' WHEN files = file_count THEN 'matched' ELSE 'changed' END AS state, count(*) AS directories
        FROM n FULL JOIN directory_profiles s ON s.repo = n.repo AND s.path = n.path GROUP BY ALL""",
}
