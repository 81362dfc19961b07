"""Problem 7: a mixture of sources with target shares of all tokens.

Budgets go down a tree (domain, language, source): each node gives its children what their weights ask for. What a
child can't supply goes to its siblings first and, when they are full as well, back up to the parent's siblings.
Only the tree is worked on at the driver; it has a row per source and language, never one per document.

A leaf then takes whole epochs of its texts and the prefix of one more. An epoch is an order by a seeded hash; the
prefix is found without sorting a leaf in one place: token sums per slice of the hash range say in which slice the
budget ends, that slice is cut into slices again, and only the slice of a slice where the budget ends is sorted.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structmill.llm.sources import language_name, source_name
from structmill.sources.tables import cut, spread, table

#: Bits of the hash that number the slices of a leaf, and the slices of a slice.
SLICE_BITS = 12
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary cuts a text before it merges bytes (the published pattern of this public vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count_tokens(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [*batch.schema.names[:-1], "tokens"])

    return run


def unique_texts(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Each distinct text once, with the smallest doc_id that has it, its source and language, and its tokens.

    A text under several ids is one text, so repeats are counted for it and not per id. Null and empty texts and
    rows without doc_id or source are no material.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)  # the workers need not have it
    rows = documents.select("doc_id", source_name(F.col("source")).alias("source"), language_name(F.col("lang")).alias("lang"), "text")
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull() & (F.length("text") > 0))
    sized = spread(rows.select("doc_id", "source", "lang", F.sha2("text", 256).alias("text_key"), "text"), "doc_id").mapInArrow(
        _count_tokens(os.path.basename(vocabulary)), "doc_id bigint, source string, lang string, text_key string, tokens bigint"
    )
    once = sized.groupBy("text_key").agg(F.min(F.struct("doc_id", "source", "lang", "tokens")).alias("r"))
    return once.select("text_key", "r.*").where(F.col("tokens") > 0)


def share_out(amount: float, children: list[tuple[float, float]]) -> list[float]:
    """``amount`` among (weight, capacity) by weight; what exceeds a capacity goes to the others by their weights."""
    given = [0.0] * len(children)
    left, open_ = amount, [i for i, (w, c) in enumerate(children) if w > 0 and c > 0]
    while open_ and left > 1e-6:
        weights = sum(children[i][0] for i in open_)
        full = [i for i in open_ if given[i] + left * children[i][0] / weights >= children[i][1]]
        if not full:
            for i in open_:
                given[i] += left * children[i][0] / weights
            return given
        for i in full:
            left -= children[i][1] - given[i]
            given[i] = children[i][1]
        open_ = [i for i in open_ if i not in full]
        # the others start again from what is left, on top of what they have
    return given


def leaf_budgets(leaves: list[dict], total: float) -> dict[tuple[str, str], float]:
    """Tokens for each (source, lang). leaves: domain, source, lang, target_share, max_repeats, tokens (of one epoch).

    A source asks for its share in each of its languages by the tokens it has there.
    """
    there: dict[str, int] = {}
    for x in leaves:
        there[x["source"]] = there.get(x["source"], 0) + x["tokens"]
    tree: dict[str, dict[str, list[tuple[str, float, float]]]] = {}
    for x in sorted(leaves, key=lambda x: (x["domain"], x["lang"], x["source"])):
        weight = x["target_share"] * x["tokens"] / there[x["source"]]
        tree.setdefault(x["domain"], {}).setdefault(x["lang"], []).append((x["source"], weight, float(x["tokens"] * x["max_repeats"])))
    asks = lambda nodes: (sum(w for _, w, _ in nodes), sum(c for _, _, c in nodes))
    budgets: dict[tuple[str, str], float] = {}
    for by_lang, for_domain in zip(tree.values(), share_out(total, [asks([n for nodes in langs.values() for n in nodes]) for langs in tree.values()])):
        for (lang, nodes), for_lang in zip(by_lang.items(), share_out(for_domain, [asks(nodes) for nodes in by_lang.values()])):
            for (source, _, _), n in zip(nodes, share_out(for_lang, [(w, c) for _, w, c in nodes])):
                budgets[source, lang] = n
    return budgets


def full_total(leaves: list[dict]) -> float:
    """The most tokens with which every source that has texts still reaches its share; those without leave theirs to all."""
    share = {x["source"]: x["target_share"] for x in leaves}
    capacity = {s: sum(x["tokens"] * x["max_repeats"] for x in leaves if x["source"] == s) for s in share}
    return min((capacity[s] * sum(share.values()) / share[s] for s in share), default=0.0)


def _bits(order: Column, level: int) -> Column:
    """The number of the slice of ``order`` at a level: its highest bits, then those below them."""
    return F.shiftrightunsigned(order, 64 - SLICE_BITS * level) % (1 << SLICE_BITS)


def _end(texts: DataFrame, level: int) -> DataFrame:
    """Per leaf the slice in which the budget ends, and the tokens before it. texts: source, lang, order, tokens, rest, before."""
    slices = texts.groupBy("source", "lang", "rest", "before", _bits(F.col("order"), level).alias("slice")).agg(F.sum("tokens").alias("n"))
    up_to = Window.partitionBy("source", "lang").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = slices.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(up_to), F.lit(0)))
    ends = placed.where((F.col("start") <= F.col("rest")) & (F.col("start") + F.col("n") > F.col("rest")))
    return F.broadcast(ends.select(F.col("source").alias("e_source"), F.col("lang").alias("e_lang"), F.col("slice").alias("end"), "start"))  # a row per leaf


def mixture(texts: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, domains: DataFrame | None = None) -> DataFrame:
    """The chosen texts: text_key, doc_id, source, lang, tokens and how often each is used (``uses``).

    ``texts`` as from :func:`unique_texts`. ``total_tokens`` defaults to the most with which every source that has
    texts reaches its share (:func:`full_total`). With a greater total a source that has too few texts even at its
    ``max_repeats`` stays short, and others take over: first those of its domain and language, then of its domain, then
    all. ``domains`` (source, domain) says what belongs together; by default the last word of a source's name does.
    Targets with null or non-positive share or repeats take no part. The sum never exceeds the budget; a leaf ends at
    most one text below its own. The same seed gives the same choice, whatever the partitions.
    """
    spark = texts.sparkSession
    named = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0)).select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    kind = F.element_at(F.split("source", "_"), -1)
    if domains is None:
        named = named.withColumn("domain", kind)
    else:
        given = domains.select(source_name(F.col("source")).alias("d_source"), "domain").dropDuplicates(["d_source"])
        named = named.join(given, F.col("source") == F.col("d_source"), "left").withColumn("domain", F.coalesce("domain", kind))
    wanted = {r["source"]: r for r in named.collect() if r["source"]}  # a row per target
    sizes = texts.where(F.col("source").isin(list(wanted))).groupBy("source", "lang").agg(F.sum("tokens").alias("tokens")).collect()
    leaves = [{**wanted[r["source"]].asDict(), "lang": r["lang"], "tokens": r["tokens"]} for r in sizes]
    budgets = leaf_budgets(leaves, float(total_tokens if total_tokens is not None else full_total(leaves)))
    plan = []
    for x in leaves:
        budget = budgets[x["source"], x["lang"]] + 1e-6
        whole = min(int(budget // x["tokens"]), x["max_repeats"])
        rest = int(budget - whole * x["tokens"]) if whole < x["max_repeats"] else 0
        plan.append((x["source"], x["lang"], whole, rest))
    plan_table = F.broadcast(spark.createDataFrame(plan, "p_source string, p_lang string, whole int, rest bigint"))
    planned = texts.join(plan_table, (F.col("source") == F.col("p_source")) & (F.col("lang") == F.col("p_lang"))).drop("p_source", "p_lang")
    planned = planned.withColumn("order", F.xxhash64(F.lit(seed), F.col("whole"), F.col("text_key")))
    own = (F.col("source") == F.col("e_source")) & (F.col("lang") == F.col("e_lang"))
    open_ = planned.where("rest > 0").withColumn("before", F.lit(0).cast("bigint"))
    sure = planned.where("rest <= 0").withColumn("more", F.lit(0))
    for level in (1, 2):
        here = _bits(F.col("order"), level)
        met = open_.join(_end(open_, level), own, "left")
        # without an end the whole leaf fits
        sure = sure.unionByName(met.where(F.col("end").isNull() | (here != F.col("end"))).withColumn("more", F.coalesce((here < F.col("end")).cast("int"), F.lit(1))).select(*sure.columns))
        open_ = met.where(here == F.col("end")).withColumn("before", F.col("start")).select(*open_.columns)
    within = Window.partitionBy("source", "lang").orderBy("order", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    fits = (F.col("before") + F.sum("tokens").over(within) <= F.col("rest")).cast("int")
    split = open_.withColumn("more", fits).select(*sure.columns)
    uses = (F.col("whole") + F.col("more")).alias("uses")
    return sure.unionByName(split).select("text_key", "doc_id", "source", "lang", "tokens", uses).where("uses > 0")


def share_report(chosen: DataFrame, texts: DataFrame, targets: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Per target source: its share wanted and reached, tokens there are and tokens used, and whether it was met.

    ``met``: the share is within ``tolerance`` of the target, neither short of it nor beyond; ``gap`` is the difference.
    """
    named = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    used = chosen.groupBy(F.col("source").alias("u_source")).agg(F.sum(F.col("tokens") * F.col("uses")).alias("used"), F.count(F.lit(1)).alias("texts_used"), F.max("uses").alias("most_uses"))
    there = texts.join(F.broadcast(named.select(F.col("source").alias("n_source")).distinct()), F.col("source") == F.col("n_source"), "left_semi").groupBy(F.col("source").alias("t_source")).agg(F.sum("tokens").alias("there"))
    joined = named.join(F.broadcast(used), F.col("source") == F.col("u_source"), "left").join(F.broadcast(there), F.col("source") == F.col("t_source"), "left")
    zero = F.lit(0).cast("bigint")
    filled = joined.select(
        "source", "target_share", "max_repeats",
        F.coalesce("there", zero).alias("tokens_there"), F.coalesce("used", zero).alias("tokens_used"),
        F.coalesce("texts_used", zero).alias("texts_used"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
    total = F.sum("tokens_used").over(Window.partitionBy(F.lit(1)))  # a row per target
    share = F.coalesce(F.try_divide(F.col("tokens_used").cast("double"), total.cast("double")), F.lit(0.0))
    return filled.withColumn("share", share).withColumn("gap", F.col("share") - F.col("target_share")).withColumn("met", F.abs("gap") <= tolerance)


def _texts(spark: SparkSession, data_dir: str) -> DataFrame:
    return cut(unique_texts(table(spark, data_dir, "documents")))


def p7_mixture(spark: SparkSession, data_dir: str) -> DataFrame:
    return mixture(_texts(spark, data_dir), table(spark, data_dir, "mix_targets"))


def p7_shares(spark: SparkSession, data_dir: str) -> DataFrame:
    texts, targets = _texts(spark, data_dir), table(spark, data_dir, "mix_targets")
    return share_report(mixture(texts, targets), texts, targets)


QUERIES = {"p7_mixture": p7_mixture, "p7_shares": p7_shares}
SQL: dict[str, str] = {}
