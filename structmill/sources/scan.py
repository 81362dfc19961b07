"""Reading source trees, the store of extracted files, and incremental scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structmill.extract import extract_files, extractor_version, supported_suffixes
from structmill.functions.paths import suffix
from structmill.operators.latest import latest

#: Folders that a scan leaves out; fixed values.
IGNORED_DIRS = ".git .hg .svn node_modules vendor __pycache__ .venv venv .env env dist build target .tox .mypy_cache .pytest_cache .cache agent-docs .claude".split()


def read_tree(spark: SparkSession, root: str, repo: str, ignored: list[str] | None = None) -> DataFrame:
    """file_id, repo, file_path, content of the supported files below ``root``, without ignored folders. Content is UTF-8 with replacement.

    Other suffixes and ignored folders below the root are left out when files are listed; only the bytes of the rest are read.
    """
    suffixes = ",".join(sorted({s.removeprefix(".") for x in supported_suffixes() for s in (x, x.upper())}))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{suffixes}}}").load(root)
    relative = F.regexp_replace("path", r"^.*?\Q" + root.rstrip("/") + r"\E/", "")
    files = raw.withColumn("file_path", relative)
    folders = F.split("file_path", "/")
    inside = F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0)))
    # the filter looks at the path alone, so the reader needs no content for what it drops
    kept = files.where(~F.arrays_overlap(inside, F.array(*[F.lit(x) for x in (ignored or IGNORED_DIRS)])))
    return kept.select(F.xxhash64(F.lit(repo), F.col("file_path")).alias("file_id"), F.lit(repo).alias("repo"), "file_path", F.decode("content", "UTF-8").alias("content"))


def scan(sources: DataFrame, store: DataFrame | None, version: str | None = None) -> DataFrame:
    """Extracted rows of all sources: from ``store`` where hash, suffix and version agree, else extracted now.

    The version is by default that of the extractors as they are. ``from_store`` tells which. Of several stored rows with one key the newest counts.
    """
    version = version or extractor_version()
    keyed = sources.select("file_id", "repo", "file_path", "content", F.sha2("content", 256).alias("sha"), suffix(F.col("file_path")).alias("sfx"))
    columns = ["language", "sha256", "file_size_bytes", "line_count", "symbols", "imports", "exports", "call_edges", "rationale_comments", "extraction_errors"]
    if store is None:
        fresh, hits = keyed, None
    else:
        kept = latest(store.where(F.col("extractor_version") == version).withColumn("sfx", suffix(F.col("file_path"))), ["sha256", "sfx"], [F.col("scanned_at")], ["sha256", "sfx", *[c for c in columns if c != "sha256"]])
        stored = kept.withColumnRenamed("sfx", "k_sfx")
        hits = keyed.join(stored, (F.col("sha") == F.col("sha256")) & (F.col("sfx") == F.col("k_sfx"))).select("file_id", "repo", "file_path", *columns)
        fresh = keyed.join(stored.select(F.col("sha256").alias("k_sha"), F.col("k_sfx").alias("k2")), (F.col("sha") == F.col("k_sha")) & (F.col("sfx") == F.col("k2")), "left_anti")
    extracted = extract_files(fresh).select("file_id", "repo", "file_path", *columns).withColumn("from_store", F.lit(False))
    return extracted if hits is None else extracted.unionByName(hits.withColumn("from_store", F.lit(True)))


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a declared schema; a document that can't be read has its text in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def yaml_fences(documents: DataFrame) -> DataFrame:
    """doc_id and the text of the first YAML fence of each Markdown document."""
    fenced = documents.select("doc_id", F.regexp_extract("text", r"(?s)```ya?ml\s*\n(.*?)```", 1).alias("yaml"))
    return fenced.where("yaml <> ''")


#: Manifests that are looked for at the root of a repository; fixed values.
MANIFESTS = "Cargo.toml Dockerfile Makefile build.gradle docker-compose.yaml docker-compose.yml go.mod package.json pom.xml pyproject.toml setup.cfg setup.py".split()


def manifests(files: DataFrame) -> DataFrame:
    """Per repository the manifests at its root, in order. files: repo, path."""
    return files.where(F.col("path").isin(MANIFESTS)).groupBy("repo").agg(F.array_sort(F.collect_set("path")).alias("manifests"))


def recursion_children(states: DataFrame) -> DataFrame:
    """Subsystems and their children, in order, from analysis states: repo, text -> repo, name, children.

    Both ways of writing count: ``name (recursive: a, b)`` as a list item, and an item ``parent: name`` with items
    ``name: child`` below it, in the front matter between two lines of three dashes or in a YAML fence. A state without
    either gives no rows.
    """
    front = F.regexp_extract("text", r"(?s)\A---\s*\n(.*?)\n---", 1)
    fence = F.regexp_extract("text", r"(?s)```ya?ml\s*\n(.*?)```", 1)
    yaml = states.select("repo", F.coalesce(F.nullif(front, F.lit("")), fence).alias("y"))
    inline = yaml.select("repo", F.explode(F.regexp_extract_all("y", F.lit(r"(?m)^\s*-\s*[\"']?([^\s:\"'(][^:\n\"'(]*\(recursive: ?[^)\n]*\))"), F.lit(1))).alias("item"))
    inline = inline.select("repo", F.trim(F.substring_index("item", "(", 1)).alias("name"), F.split(F.regexp_extract("item", r"\(recursive: ?([^)]*)\)", 1), r"\s*,\s*").alias("children"))
    nested = yaml.select("repo", F.explode(F.regexp_extract_all("y", F.lit(r"(?m)^\s*-\s*parent:\s*([^\n]+\n(?:(?!\s*-\s*parent:)\s+[^\n]*(?:\n|\z))*)"), F.lit(1))).alias("item"))
    nested = nested.select("repo", F.trim(F.substring_index("item", "\n", 1)).alias("name"), F.regexp_extract_all("item", F.lit(r"(?m)^\s*-\s*name:\s*(\S+)"), F.lit(1)).alias("children"))
    kept = inline.unionByName(nested).withColumn("children", F.filter(F.transform("children", lambda c: F.trim(c)), lambda c: c != "")).where((F.col("name") != "") & (F.size("children") > 0))
    return kept.groupBy("repo", "name").agg(F.max("children").alias("children"))
