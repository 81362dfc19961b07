"""Queries over documents, tasks and the event log: purposes, rules for documents, routing, locks, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structmill.functions import text
from structmill.operators import graph, results, routing
from structmill.sources.scan import recursion_children
from structmill.sources.tables import table

def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("text", F.regexp_replace("text", "\r\n?", "\n"))


def document_purpose(spark: SparkSession, d: str) -> DataFrame:
    """First line of a readme with more than 20 characters that is no badge or markup, up to 200 characters."""
    readmes = _docs(spark, d).where(text.source_name(F.col("source")) == "readme")
    lines = readmes.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "raw")).withColumn("line", F.trim(F.regexp_replace(F.trim("raw"), "^#+", "")))
    good = (F.length("line") > 20) & ~F.col("line").rlike(r"^(?:\[!|!\[|<|```|\||---)") & ~F.lower("line").contains("badge") & ~F.lower("line").contains("shield")
    return lines.where(good).groupBy("doc_id").agg(F.left(F.min_by("line", "n"), F.lit(200)).alias("purpose"))


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines, table lines and headings of each document, and whether it keeps the limits of a context document."""
    lines = F.split("text", "\n")
    of = lambda rx: F.size(F.filter(lines, lambda x: x.rlike(rx))).cast("bigint")
    counted = _docs(spark, d).where(F.col("text").isNotNull()).select("doc_id", text.line_count(F.col("text")).alias("lines"), of(r"^\|").alias("table_lines"), of("^#{1,6} ").alias("headings"))
    return counted.withColumn("fits", (F.col("lines") < 120) & (F.col("table_lines") == 0))


def signal_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Share of the non-blank lines that carry a path, per source; below 0.3 is a warning."""
    lines = _docs(spark, d).select(text.source_name(F.col("source")).alias("source"), F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    counted = lines.groupBy("source").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("line").rlike(r"[A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+\.[a-z]+")).alias("path_lines"))
    return counted.withColumn("warns", F.col("path_lines") < 0.3 * F.col("lines"))


def content_copies(spark: SparkSession, d: str) -> DataFrame:
    """Texts that several documents share: their hash, copies and smallest id."""
    hashed = table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", F.sha2("text", 256).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc_id")).where("copies > 1")


def source_languages(spark: SparkSession, d: str) -> DataFrame:
    """Main language of every source."""
    counted = table(spark, d, "documents").select(text.source_name(F.col("source")).alias("source"), F.lower(F.substring("lang", 1, 2)).alias("lang")).where("source IS NOT NULL AND lang IS NOT NULL").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("m"), "lang")).alias("b"), F.sum("n").alias("documents"))
    return best.select("source", "b.lang", (-F.col("b.m")).alias("in_lang"), "documents")


def path_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Paths in code spans per repository of the document: mentions and whether the file is known there."""
    spans = _docs(spark, d).where(F.col("repo").isNotNull()).select("repo", F.explode(F.regexp_extract_all("text", F.lit(r"`([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.[a-z]+)`"), F.lit(1))).alias("path"))
    counted = spans.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("mentions"))
    known = table(spark, d, "file_infos").select(F.col("repo").alias("k_repo"), F.col("path").alias("k_path"), F.lit(True).alias("k")).distinct()
    return counted.join(known, (F.col("repo") == F.col("k_repo")) & (F.col("path") == F.col("k_path")), "left").select("repo", "path", "mentions", F.coalesce("k", F.lit(False)).alias("known"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where((text.source_name(F.col("source")) == "search_query") & F.col("text").isNotNull()).select(F.col("doc_id").alias("query_id"), F.trim("text").alias("query"))


def _routes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "directory_profiles").groupBy(F.col("path").alias("owned")).agg(F.min("repo").alias("subsystem"))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_tasks").where(F.col("instruction").isNotNull()).select(F.col("item_id").cast("string").alias("task"), text.words(F.col("instruction")).alias("words"))


def route_prefix(spark: SparkSession, d: str) -> DataFrame:
    return routing.by_prefix(_queries(spark, d), _routes(spark, d))


def route_task(spark: SparkSession, d: str) -> DataFrame:
    return routing.by_task(_queries(spark, d), _tasks(spark, d))


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    """An index of patterns from the profiles: the directory's path as a slug, its top symbols as fragments, largest first."""
    profiles = table(spark, d, "directory_profiles").where(F.col("path").isNotNull())
    order = F.struct((-F.coalesce("file_count", F.lit(0))).alias("n"), F.coalesce("repo", F.lit("")).alias("repo"), "path")
    return profiles.select(order.alias("ord"), text.slug(F.col("path")).alias("pattern"), F.col("top_symbols").alias("fragments"))


def _plain_docs(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def route_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Documents of every source by the first pattern they hold."""
    return routing.by_pattern(_plain_docs(spark, d), _patterns(spark, d)).withColumnRenamed("query_id", "doc_id")


def route_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Each query with its route: by prefix, else by pattern, else by task, else none."""
    q = _queries(spark, d)
    prefix = routing.by_prefix(q, _routes(spark, d)).select(F.col("query_id").alias("p_id"), "subsystem")
    task = routing.by_task(q, _tasks(spark, d)).select(F.col("query_id").alias("t_id"), "task")
    pattern = routing.by_pattern(q, _patterns(spark, d)).select(F.col("query_id").alias("n_id"), "pattern")
    joined = q.join(prefix, F.col("query_id") == F.col("p_id"), "left").join(task, F.col("query_id") == F.col("t_id"), "left").join(pattern, F.col("query_id") == F.col("n_id"), "left")
    kind = F.when(F.col("subsystem").isNotNull(), "directory_prefix").when(F.col("pattern").isNotNull(), "pattern_route").when(F.col("task").isNotNull(), "common_task").otherwise("fallback")
    return joined.select("query_id", kind.alias("match_type"), F.coalesce("subsystem", "pattern", "task").alias("target"))


def route_index(spark: SparkSession, d: str) -> DataFrame:
    """Routes by the top folder of every repository: owned directories, briefs where a profile is no test, children."""
    profiles = table(spark, d, "directory_profiles").where(F.col("path").isNotNull())
    named = profiles.withColumn("subsystem", F.concat_ws("/", "repo", F.substring_index("path", "/", 1)))
    areas = named.groupBy("subsystem").agg(
        F.min("path").alias("doc_path"), F.max(F.when(F.col("path") == F.substring_index("path", "/", 1), F.lit("top"))).alias("role"), F.array_sort(F.collect_set("path")).alias("owns_paths"),
        F.array_sort(F.collect_set(F.when(~F.coalesce("is_test", F.lit(False)) & (F.col("file_count") >= 5), F.col("path")))).alias("brief_paths"),
    )
    recursion = recursion_children(_docs(spark, d).select("repo", "text")).select("name", "children")
    index = routing.route_index(areas, recursion)
    return index.select("name", "subsystem", "doc_path", "role", *[F.array_join(c, ",").alias(c) for c in ("owns_paths", "brief_paths", "recursive_children")])


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "directory_profiles").select(F.concat_ws(":", "repo", "path").alias("name"), text.slug(F.concat_ws(" ", "repo", "path")).alias("role"), F.col("file_count"))


def _lock(spark: SparkSession, d: str) -> DataFrame:
    """An older lock: directories with a nested path or an edge count above 5; roles of some were edited by hand."""
    stored = table(spark, d, "symbol_refs").groupBy("repo", "path").agg(F.max("ref_count").alias("m"))
    role = F.when(F.col("m") > 30, F.lit("kept by hand")).when(F.col("m") > 20, F.lit(None)).otherwise(text.slug(F.concat_ws(" ", "repo", "path")))
    named = stored.where("m > 8").select(F.concat_ws(":", "repo", "path").alias("name"), role.alias("role"))
    gone = stored.where("m <= 3").select(F.concat_ws(":", "repo", "path", F.lit("old")).alias("name"), F.lit("gone").alias("role"))
    return named.unionByName(gone)


def lock_merge(spark: SparkSession, d: str) -> DataFrame:
    return routing.merge_lock(_candidates(spark, d), _lock(spark, d), "name", ["role"], ["file_count"])


def lock_counters(spark: SparkSession, d: str) -> DataFrame:
    """Matched, new and stale entries and the fields the lock overrode."""
    merged = lock_merge(spark, d)
    return merged.groupBy("state").agg(F.count(F.lit(1)).alias("entries"), F.sum("overrides").alias("overrides"))


def lock_upsert(spark: SparkSession, d: str) -> DataFrame:
    return routing.upsert_lock(_candidates(spark, d).select("name", "role"), _lock(spark, d), "name")


def _results(spark: SparkSession, d: str) -> DataFrame:
    """The event log read as results: users with an even id ran the framework."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    mode = F.when(F.col("user_id") % 2 == 0, "framework").otherwise("baseline")
    error = F.when(F.col("event_type") == "error", "failed")
    ord_ = F.floor(F.col("event_id") / 2)
    return table(spark, d, "events").select(ord_.alias("ord"), mode.alias("mode"), (k * 10).alias("tokens"), F.col("value").alias("cost"), (k / F.lit(2.0)).alias("seconds"), (k >= 50).alias("strict"), (k >= 20).alias("lenient"), F.least(F.greatest(F.col("value") / 10, F.lit(0.0)), F.lit(10.0)).alias("quality"), error.alias("error"), "event_id")


def mode_stats(spark: SparkSession, d: str) -> DataFrame:
    return results.mode_stats(_results(spark, d))


def mode_deltas(spark: SparkSession, d: str) -> DataFrame:
    return results.deltas(results.mode_stats(_results(spark, d)), "framework", "baseline")


def paired_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of both modes joined by their place in the run."""
    numbered = _results(spark, d).withColumn("ord", F.row_number().over(Window.partitionBy("mode", F.floor(F.col("event_id") / 1000)).orderBy("event_id")) + F.floor(F.col("event_id") / 1000) * 1000)
    return results.paired(numbered, "framework", "baseline")


def task_ids(spark: SparkSession, d: str) -> DataFrame:
    """Stable ids, slugs and shell words of the orders' parts."""
    parts = table(spark, d, "part")
    return parts.select("p_partkey", text.instance_id(F.col("p_brand"), F.col("p_name")).alias("instance"), text.slug(F.col("p_type")).alias("slug"), text.truncated(F.col("p_name"), 10).alias("short"), text.shell_quoted(F.col("p_name")).alias("word"))


def task_difficulties(spark: SparkSession, d: str) -> DataFrame:
    """Documents that mention a tested family's words, by difficulty: tasks per difficulty joined to routed queries."""
    routed = routing.by_task(_queries(spark, d), _tasks(spark, d)).select(F.col("task").alias("r_task"), "strong")
    tasks = table(spark, d, "eval_tasks").select(F.col("item_id").cast("string").alias("task"), "family", "difficulty")
    return tasks.join(routed, F.col("task") == F.col("r_task"), "left").groupBy("family", "difficulty").agg(F.count_distinct("task").alias("tasks"), F.count("r_task").alias("queries"), F.count_if("strong").alias("strong"))


def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    """Context documents scored by weighted checks (pass 2, partial 1, fail 0) and banded at 28, 22 and 16 of 32."""
    lines = document_lines(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("d_doc_id"), "n_chars"), F.col("doc_id") == F.col("d_doc_id"))
    grade = lambda full, half: F.when(full, 2).when(half, 1).otherwise(0)
    score = 6 * grade(F.col("lines") < 120, F.col("lines") < 160) + 5 * grade(F.col("table_lines") == 0, F.col("table_lines") <= 3) + 3 * grade(F.col("headings") >= 2, F.col("headings") >= 1) + 2 * grade(F.col("n_chars") >= 1000, F.col("n_chars") >= 300)
    scored = lines.select("doc_id", score.cast("bigint").alias("score"))
    return scored.withColumn("band", F.when(F.col("score") >= 28, "strong").when(F.col("score") >= 22, "good").when(F.col("score") >= 16, "fair").otherwise("weak"))


def fallback_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Extension: sessions of a user (30 minutes apart) with the errors before the first purchase."""
    gap = F.coalesce((F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))) > F.expr("INTERVAL 30 MINUTES"), F.lit(True))
    marked = table(spark, d, "events").withColumn("new", gap.cast("int"))
    numbered = marked.withColumn("session", F.sum("new").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))).over(Window.partitionBy("user_id", "session"))
    before = (F.col("event_type") == "error") & (first.isNull() | (F.struct("ts", "event_id") < first))
    return numbered.withColumn("before", before).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.count_if("before").alias("errors_before_purchase"))


def region_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile on the star schema: nations as files, regions as directories, shipments as edges."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    supplier = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey"))
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    ends = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = ends.groupBy("s_nationkey", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    a = nation.select(F.col("n_nationkey").alias("a_key"), F.col("n_regionkey").alias("a_region"))
    b = nation.select(F.col("n_nationkey").alias("b_key"), F.col("n_regionkey").alias("b_region"))
    pairs = edges.join(a, F.col("s_nationkey") == F.col("a_key")).join(b, F.col("c_nationkey") == F.col("b_key")).groupBy(F.lit("all").alias("repo"), F.col("a_region").cast("string").alias("source_dir"), F.col("b_region").cast("string").alias("target_dir")).agg(F.sum("n").alias("edges"))
    files = nation.select(F.lit("all").alias("repo"), F.col("n_nationkey").cast("string").alias("path"), F.col("n_regionkey").cast("string").alias("directory"), F.lit(1).alias("symbol_count"))
    profile = graph.directory_edges(files, pairs)
    region = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("r_key"), "r_name")
    return profile.join(region, F.col("directory") == F.col("r_key")).select("r_name", "file_count", "internal_edges", "outgoing_edges", "incoming_edges", "edge_density")



QUERIES = {
    q.__name__: q
    for q in (
        document_purpose, document_lines, signal_ratio, content_copies, source_languages, path_mentions, route_prefix, route_task, route_pattern, route_cascade, route_index, lock_merge, lock_counters,
        lock_upsert, mode_stats, mode_deltas, paired_results, task_ids, task_difficulties, weighted_score, fallback_bursts, region_profile,
    )
}

_T = r"regexp_replace(text, '\r\n?', chr(10), 'g')"
_SRC = r"nullif(regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g'), '')"
_L = f"string_split({_T}, chr(10))"
_SLUG = "regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_STOPS = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_WORDS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z]{{3,}}')), lambda w: NOT list_contains(" + _STOPS + ", w))"
_Q = f"q AS (SELECT doc_id AS query_id, trim({_T}) AS query FROM documents WHERE {_SRC} = 'search_query' AND text IS NOT NULL)"
_ANC = "list_transform(range(1, len(string_split({0}, '/')) + 1), lambda n: array_to_string(list_slice(string_split({0}, '/'), 1, n), '/'))"
_PREFIX = f"""r AS (SELECT path AS owned, min(repo) AS subsystem FROM directory_profiles GROUP BY path), st AS (SELECT query_id, unnest({_ANC.format('query')}) AS step FROM q WHERE query <> ''),
    px AS (SELECT query_id, subsystem, owned AS matched FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(owned) DESC, subsystem, owned) AS k FROM st JOIN r ON r.owned = st.step) WHERE k = 1)"""
_TASK = f"""t AS (SELECT CAST(item_id AS VARCHAR) AS task, unnest({_WORDS.format('instruction')}) AS w FROM eval_tasks), qw AS (SELECT query_id, unnest({_WORDS.format('query')}) AS w FROM q),
    tk AS (SELECT query_id, task, overlap, overlap >= 2 AS strong FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, task) AS k FROM
        (SELECT query_id, task, count(*) AS overlap FROM qw JOIN (SELECT DISTINCT * FROM t) t USING (w) GROUP BY ALL)) WHERE k = 1)"""


_SLUG_PATH = _SLUG.format("path")
_PAT = f"""pt AS (SELECT -coalesce(file_count, 0) AS n, coalesce(repo, '') AS r, path AS p, {_SLUG_PATH} AS pattern, list_concat([{_SLUG_PATH}, replace({_SLUG_PATH}, '-', '_')],
    list_filter(list_transform(coalesce(top_symbols, []), lambda x: lower(x)), lambda x: length(x) >= 8)) AS ws FROM directory_profiles WHERE path IS NOT NULL), pw AS (SELECT n, r, p, pattern, unnest(ws) AS w FROM pt WHERE pattern <> '')"""


def _by_pattern(queries: str) -> str:
    """What is looked for against every text, by brute force. queries: query_id, query."""
    return f"""{_PAT}, lq AS MATERIALIZED (SELECT query_id, lower(query) AS query FROM ({queries})), wd AS MATERIALIZED (SELECT w, min((n, r, p, pattern)) AS b FROM pw GROUP BY w),
    ph AS (SELECT query_id, b[4] AS pattern, row_number() OVER (PARTITION BY query_id ORDER BY b) AS k FROM lq JOIN wd ON contains(lq.query, w)), pm AS (SELECT query_id, pattern FROM ph WHERE k = 1)"""


_CAND = f"cand AS (SELECT repo || ':' || path AS name, {_SLUG.format("repo || ' ' || path")} AS role, file_count FROM directory_profiles)"
_LOCK = f"""sr AS (SELECT repo, path, max(ref_count) AS m FROM symbol_refs GROUP BY ALL), lk AS (SELECT repo || ':' || path AS name, CASE WHEN m > 30 THEN 'kept by hand' WHEN m > 20 THEN NULL ELSE {_SLUG.format("repo || ' ' || path")} END AS role
    FROM sr WHERE m > 8 UNION ALL SELECT repo || ':' || path || ':old', 'gone' FROM sr WHERE m <= 3)"""
_MERGED = f"""{_CAND}, {_LOCK}, mg AS (SELECT coalesce(c.name, l.name) AS name, coalesce(l.role, c.role) AS role, c.file_count, CASE WHEN c.name IS NULL THEN 'stale' WHEN l.name IS NULL THEN 'new' ELSE 'matched' END AS state,
    CASE WHEN c.name IS NOT NULL AND l.role IS NOT NULL AND l.role IS DISTINCT FROM c.role THEN 1 ELSE 0 END AS overrides FROM cand c FULL JOIN lk l ON l.name = c.name)"""
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_RES = f"""rs AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'framework' ELSE 'baseline' END AS mode, {_K} * 10 AS tokens, value AS cost, {_K} / 2.0 AS seconds, {_K} >= 50 AS strict, {_K} >= 20 AS lenient,
    least(greatest(value / 10, 0.0), 10.0) AS quality, event_type = 'error' AS failed FROM events)"""
_STATS = f"""{_RES}, ms AS (SELECT mode, coalesce(avg(tokens) FILTER (NOT failed), 0.0) AS tokens, coalesce(avg(cost) FILTER (NOT failed), 0.0) AS cost, coalesce(avg(CAST(seconds AS DOUBLE)) FILTER (NOT failed), 0.0) AS seconds,
    coalesce(avg(quality) FILTER (NOT failed), 0.0) AS quality, coalesce(100.0 * avg(CAST(strict AS INT)) FILTER (NOT failed), 0.0) AS strict_rate, coalesce(100.0 * avg(CAST(lenient AS INT)) FILTER (NOT failed), 0.0) AS lenient_rate,
    count(*) FILTER (failed) AS errors, count(*) AS total FROM rs GROUP BY mode)"""
_LINES = rf"""dl AS (SELECT doc_id, n_chars, len({_L}) - CASE WHEN ends_with({_T}, chr(10)) OR text = '' THEN 1 ELSE 0 END AS lines, len(list_filter({_L}, lambda x: starts_with(x, '|'))) AS table_lines,
    len(list_filter({_L}, lambda x: regexp_matches(x, '^#{{1,6}} '))) AS headings FROM documents WHERE text IS NOT NULL)"""

SQL = {
    "document_purpose": rf"""WITH l AS (SELECT doc_id, unnest({_L}) AS raw, generate_subscripts({_L}, 1) AS n FROM documents WHERE {_SRC} = 'readme'), m AS (SELECT doc_id, n, trim(regexp_replace(trim(raw), '^#+', '')) AS line FROM l)
        SELECT doc_id, left(min_by(line, n), 200) AS purpose FROM m WHERE length(line) > 20 AND NOT regexp_matches(line, '^(\[!|!\[|<|```|\||---)') AND NOT contains(lower(line), 'badge') AND NOT contains(lower(line), 'shield') GROUP BY doc_id""",
    "document_lines": f"WITH {_LINES} SELECT doc_id, lines, table_lines, headings, lines < 120 AND table_lines = 0 AS fits FROM dl",
    "signal_ratio": rf"""WITH l AS (SELECT {_SRC} AS source, unnest({_L}) AS line FROM documents), c AS (SELECT source, count(*) AS lines, count(*) FILTER (regexp_matches(line, '[A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+\.[a-z]+')) AS path_lines
        FROM l WHERE trim(line) <> '' GROUP BY source) SELECT *, path_lines < 0.3 * lines AS warns FROM c""",
    "content_copies": "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_doc_id FROM documents WHERE length(text) > 0 GROUP BY text HAVING count(*) > 1",
    "source_languages": f"""WITH c AS (SELECT {_SRC} AS source, lower(left(lang, 2)) AS lang, count(*) AS n FROM documents WHERE {_SRC} IS NOT NULL AND lang IS NOT NULL GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k, sum(n) OVER (PARTITION BY source) AS documents FROM c) SELECT source, lang, n AS in_lang, CAST(documents AS BIGINT) AS documents FROM k WHERE k = 1""",
    "path_mentions": rf"""WITH m AS (SELECT repo, unnest(regexp_extract_all({_T}, '`([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.[a-z]+)`', 1)) AS path FROM documents WHERE repo IS NOT NULL)
        SELECT m.repo, m.path, count(*) AS mentions, EXISTS (SELECT 1 FROM file_infos f WHERE f.repo = m.repo AND f.path = m.path) AS known FROM m GROUP BY m.repo, m.path""",
    "route_prefix": f"WITH {_Q}, {_PREFIX} SELECT query_id, subsystem, matched FROM px",
    "route_task": f"WITH {_Q}, {_TASK} SELECT query_id, task, overlap, strong FROM tk",
    "route_pattern": f"WITH {_by_pattern(f'SELECT doc_id AS query_id, {_T} AS query FROM documents')} SELECT query_id AS doc_id, pattern FROM pm",
    "route_cascade": f"""WITH {_Q}, {_PREFIX}, {_TASK}, {_by_pattern('SELECT * FROM q')}, j AS (SELECT q.query_id, px.subsystem, pm.pattern, tk.task FROM q LEFT JOIN px USING (query_id) LEFT JOIN tk USING (query_id) LEFT JOIN pm USING (query_id))
        SELECT query_id, CASE WHEN subsystem IS NOT NULL THEN 'directory_prefix' WHEN pattern IS NOT NULL THEN 'pattern_route' WHEN task IS NOT NULL THEN 'common_task' ELSE 'fallback' END AS match_type, coalesce(subsystem, pattern, task) AS target FROM j""",
    "route_index": f"""WITH n AS (SELECT *, concat_ws('/', repo, string_split(path, '/')[1]) AS subsystem, string_split(path, '/')[1] = path AS top FROM directory_profiles WHERE path IS NOT NULL),
        a AS (SELECT subsystem, min(path) AS doc_path, max(CASE WHEN top THEN 'top' END) AS role, array_to_string(list_sort(list(DISTINCT path)), ',') AS owns_paths,
            array_to_string(list_sort(list(DISTINCT path) FILTER (NOT coalesce(is_test, false) AND file_count >= 5)), ',') AS brief_paths FROM n GROUP BY subsystem)
        SELECT {_SLUG.format('subsystem')} AS name, subsystem, doc_path, coalesce(role, '') AS role, owns_paths, coalesce(nullif(brief_paths, ''), owns_paths) AS brief_paths, '' AS recursive_children FROM a""",
    "lock_merge": f"WITH {_MERGED} SELECT * FROM mg",
    "lock_counters": f"WITH {_MERGED} SELECT state, count(*) AS entries, CAST(sum(overrides) AS BIGINT) AS overrides FROM mg GROUP BY state",
    "lock_upsert": f"WITH {_CAND}, {_LOCK} SELECT name, role FROM lk UNION ALL SELECT name, role FROM cand WHERE name NOT IN (SELECT name FROM lk)",
    "mode_stats": f"WITH {_STATS} SELECT * FROM ms",
    "mode_deltas": f"""WITH {_STATS}, x AS (SELECT round_even(100.0 * (f.tokens - b.tokens) / b.tokens, 2) AS tokens_pct, round_even(100.0 * (f.cost - b.cost) / b.cost, 2) AS cost_pct, round_even(100.0 * (f.seconds - b.seconds) / b.seconds, 2) AS seconds_pct,
        round_even(f.lenient_rate - b.lenient_rate, 2) AS lenient_pp, round_even(f.quality - b.quality, 2) AS quality_diff, f.errors FROM ms f, ms b WHERE f.mode = 'framework' AND b.mode = 'baseline')
        SELECT tokens_pct, cost_pct, seconds_pct, lenient_pp, quality_diff, CASE WHEN cost_pct > 5 AND lenient_pp < 0 THEN 'FAIL' WHEN cost_pct <= 0 AND lenient_pp >= 5 AND quality_diff >= 0 AND errors = 0 THEN 'PASS' ELSE 'MIXED' END AS verdict FROM x""",
    "paired_results": f"""WITH {_RES}, n AS (SELECT *, row_number() OVER (PARTITION BY mode, event_id // 1000 ORDER BY event_id) + (event_id // 1000) * 1000 AS ord FROM rs), f AS (SELECT * FROM n WHERE mode = 'framework'), b AS (SELECT * FROM n WHERE mode = 'baseline')
        SELECT coalesce(f.ord, b.ord) AS ord, f.cost AS f_cost, b.cost AS b_cost, f.lenient AS f_lenient, b.lenient AS b_lenient FROM f FULL JOIN b ON f.ord = b.ord""",
    "task_ids": f"""SELECT p_partkey, p_brand || '_' || left(sha256(p_brand || ':' || p_name), 8) AS instance, {_SLUG.format('p_type')} AS slug, CASE WHEN length(p_name) > 10 THEN left(p_name, 7) || '...' ELSE p_name END AS short,
        CASE WHEN p_name = '' THEN '''''' WHEN regexp_full_match(p_name, '[A-Za-z0-9@%_+=:,./-]+') THEN p_name ELSE '''' || replace(p_name, '''', '''"''"''') || '''' END AS word FROM part""",
    "task_difficulties": f"""WITH {_Q}, {_TASK} SELECT e.family, e.difficulty, count(DISTINCT e.item_id) AS tasks, count(tk.task) AS queries, count(*) FILTER (tk.strong) AS strong
        FROM eval_tasks e LEFT JOIN tk ON tk.task = CAST(e.item_id AS VARCHAR) GROUP BY ALL""",
    "weighted_score": f"""WITH {_LINES}, s AS (SELECT doc_id, CAST(6 * CASE WHEN lines < 120 THEN 2 WHEN lines < 160 THEN 1 ELSE 0 END + 5 * CASE WHEN table_lines = 0 THEN 2 WHEN table_lines <= 3 THEN 1 ELSE 0 END
        + 3 * CASE WHEN headings >= 2 THEN 2 WHEN headings >= 1 THEN 1 ELSE 0 END + 2 * CASE WHEN n_chars >= 1000 THEN 2 WHEN n_chars >= 300 THEN 1 ELSE 0 END AS BIGINT) AS score FROM dl)
        SELECT doc_id, score, CASE WHEN score >= 28 THEN 'strong' WHEN score >= 22 THEN 'good' WHEN score >= 16 THEN 'fair' ELSE 'weak' END AS band FROM s""",
    "fallback_bursts": """WITH m AS (SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTES, true) THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        n AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM m),
        p AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN (ts, event_id) END) OVER (PARTITION BY user_id, session) AS first FROM n)
        SELECT user_id, session, count(*) AS events, count(*) FILTER (event_type = 'error' AND (first IS NULL OR (ts, event_id) < first)) AS errors_before_purchase FROM p GROUP BY user_id, session""",
    "region_profile": """WITH e AS (SELECT a.n_regionkey AS s, b.n_regionkey AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey)
        SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS file_count, count(*) FILTER (s = r_regionkey AND t = r_regionkey) AS internal_edges, count(*) FILTER (s = r_regionkey AND t <> r_regionkey) AS outgoing_edges,
        count(*) FILTER (s <> r_regionkey AND t = r_regionkey) AS incoming_edges, round_even(count(*) FILTER (s = r_regionkey AND t = r_regionkey) / count(*) FILTER (s = r_regionkey), 3) AS edge_density FROM region, e GROUP BY r_regionkey, r_name""",
}
