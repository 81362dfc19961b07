"""Search queries routed to subsystems by a small rule index, and a route lock kept in step with new candidates.

Routes: subsystem, owned path. A path query meets the routes by equality on its exploded ancestors; the longest
owned path wins, then the smallest name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structmill.functions.paths import ancestors
from structmill.functions.text import slug, words


def by_prefix(queries: DataFrame, routes: DataFrame) -> DataFrame:
    """query_id and the subsystem that owns the longest directory prefix of the query."""
    steps = queries.where(F.length("query") > 0).select("query_id", F.explode(ancestors(F.col("query"))).alias("step"))
    met = steps.join(routes, F.col("step") == F.col("owned"))
    best = met.groupBy("query_id").agg(F.min(F.struct((-F.length("owned")).alias("l"), "subsystem", "owned")).alias("b"))
    return best.select("query_id", "b.subsystem", F.col("b.owned").alias("matched"))


def by_task(queries: DataFrame, tasks: DataFrame) -> DataFrame:
    """query_id and the task with most words in common (ties: smaller name); strong from two words on. tasks: task, words.

    Words are met by equality; the pairs of one query and task are counted, not built.
    """
    q = queries.select("query_id", F.explode(words(F.col("query"))).alias("word"))
    t = tasks.select("task", F.explode("words").alias("t_word")).distinct()
    common = q.join(t, F.col("word") == F.col("t_word")).groupBy("query_id", "task").agg(F.count(F.lit(1)).alias("overlap"))
    best = common.groupBy("query_id").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "task")).alias("b"))
    return best.select("query_id", "b.task", (-F.col("b.o")).alias("overlap"), (-F.col("b.o") >= 2).alias("strong"))


#: Characters by which texts and fragments are met, and the least length of a fragment.
GRAM, LEAST_FRAGMENT = 8, 8


def by_pattern(queries: DataFrame, patterns: DataFrame) -> DataFrame:
    """query_id and the first pattern, in index order, whose name (also with underscores) or a fragment is in the query.

    patterns: ord (any type with an order), pattern, fragments; fragments under eight characters say nothing. Case
    doesn't count. The distinct words of all queries are looked through once: a word meets what is looked for (of
    several words their longest) by equality of its first eight characters with a run of the word, so no query meets
    every pattern.
    """
    name = F.lower("pattern")
    fragments = F.filter(F.transform(F.coalesce("fragments", F.array().cast("array<string>")), lambda f: F.lower(f)), lambda f: F.length(f) >= LEAST_FRAGMENT)
    wanted = patterns.where(F.trim(name) != "").select("ord", "pattern", F.explode(F.array_distinct(F.concat(F.array(name, F.translate(name, "-", "_")), fragments))).alias("wanted"))
    once = wanted.groupBy("wanted").agg(F.min(F.struct("ord", "pattern")).alias("b"))
    core = F.element_at(F.array_sort(F.split(F.trim("wanted"), r"\s+"), lambda x, y: F.length(y) - F.length(x)), 1)
    keyed = once.withColumn("core", core).where(F.length("core") > 0).withColumn("key", F.left("core", F.lit(GRAM)))
    text = queries.select("query_id", F.lower("query").alias("q")).where(F.length("q") > 0)
    said = text.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("q", F.lit(r"\S+"), F.lit(0)))).alias("word"))
    lengths = F.broadcast(keyed.select(F.length("key").alias("n")).distinct())  # at most eight
    runs = said.select("word").distinct().join(lengths, F.col("n") <= F.length("word"))
    runs = runs.select("word", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - F.col("n") + 1), lambda i: F.substring(F.col("word"), i, F.col("n"))))).alias("run"))
    met = runs.join(keyed, F.col("run") == F.col("key")).where(F.contains("word", "core"))
    whole = met.where(F.col("core") == F.col("wanted")).groupBy(F.col("word").alias("m_word")).agg(F.min("b").alias("b"))
    hits = said.join(whole, F.col("word") == F.col("m_word")).select("query_id", "b")
    parts = met.where(F.col("core") != F.col("wanted")).select(F.col("word").alias("m_word"), "wanted", "b")
    asked = said.join(parts, F.col("word") == F.col("m_word")).select(F.col("query_id").alias("n_id"), "wanted", "b")
    longer = text.join(asked, F.col("query_id") == F.col("n_id")).where(F.contains("q", "wanted")).select("query_id", "b")
    return hits.unionByName(longer).groupBy("query_id").agg(F.min("b").alias("b")).select("query_id", "b.pattern")


def route_index(areas: DataFrame, recursion: DataFrame) -> DataFrame:
    """The routes of subsystems: areas (subsystem, doc_path, role, owns_paths, brief_paths) with their defaults.

    ``name`` is the subsystem as a slug, a missing role is the empty text, missing paths are an empty list, and without
    briefs the owned paths take their place. ``recursive_children`` come from ``recursion`` (name, children) by slug or
    by name. Areas without a subsystem are left out; the first (by doc_path) of several with one slug counts.
    """
    none = F.array().cast("array<string>")
    rows = areas.where(F.coalesce(F.trim("subsystem"), F.lit("")) != "").withColumn("name", slug(F.col("subsystem")))
    first = rows.groupBy("name").agg(F.min_by(F.struct("subsystem", "doc_path", "role", "owns_paths", "brief_paths"), F.struct(F.coalesce("doc_path", F.lit("")), "subsystem")).alias("a"))
    owns = F.coalesce("a.owns_paths", none)
    shaped = first.select("name", "a.subsystem", F.coalesce("a.doc_path", F.lit("")).alias("doc_path"), F.coalesce("a.role", F.lit("")).alias("role"), owns.alias("owns_paths"), F.when(F.size("a.brief_paths") > 0, F.col("a.brief_paths")).otherwise(owns).alias("brief_paths"))
    known = recursion.groupBy(slug(F.col("name")).alias("__name")).agg(F.max("children").alias("recursive_children"))
    joined = shaped.join(known, F.col("name") == F.col("__name"), "left").drop("__name")
    return joined.withColumn("recursive_children", F.coalesce("recursive_children", none))


def merge_lock(candidates: DataFrame, lock: DataFrame, key: str, chosen: list[str], derived: list[str]) -> DataFrame:
    """Candidates reconciled with a lock: ``chosen`` fields keep the lock's value where it has one, ``derived`` fields
    take the candidate's; ``state`` is matched, new or stale, ``overrides`` counts the chosen fields the lock changed."""
    kept = lock.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in chosen], F.lit(True).alias("__locked"))
    both = candidates.select(F.col(key), *chosen, *derived, F.lit(True).alias("__there")).join(kept, F.col(key) == F.col("__k"), "full")
    state = F.when(F.col("__there").isNull(), "stale").when(F.col("__locked").isNull(), "new").otherwise("matched")
    changed = [F.when(F.col("__there") & F.col("__locked") & F.col(f"__{c}").isNotNull() & ~F.col(f"__{c}").eqNullSafe(F.col(c)), 1).otherwise(0) for c in chosen]
    overrides = changed[0]
    for c in changed[1:]:
        overrides = overrides + c
    return both.select(F.coalesce(key, "__k").alias(key), *[F.coalesce(f"__{c}", c).alias(c) for c in chosen], *derived, state.alias("state"), overrides.cast("bigint").alias("overrides"))


def merged_only(reconciled: DataFrame) -> DataFrame:
    """The routes that stay: stale entries are dropped."""
    return reconciled.where("state <> 'stale'").drop("state", "overrides")


def upsert_lock(candidates: DataFrame, lock: DataFrame, key: str) -> DataFrame:
    """The lock with new names added; entries that no candidate has are kept."""
    new = candidates.join(lock.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")
    return lock.unionByName(new.select(lock.columns))
