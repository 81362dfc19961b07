"""Problem 8: texts that end before their own end.

How a text would go on is learnt from the corpus: every trigram of tokens is counted inside paragraphs and at
their ends. A text whose last trigram stands often inside and almost never at an end stops within a sentence; one
whose last token is only the beginning of tokens that often follow the same two stops within a word. Counts and
verdicts are SQL. The trigrams speak first; what they accuse is acquitted if its form closes it (a full stop, a
signature, a link, a whole table row, a closed fence), and what they haven't seen is judged by its form alone: fences,
code spans and brackets left open, broken bytes, prose without an end.

The counts are met by equality only: with the trigram itself, and, for tokens cut short, with counts summed up per
proper prefix of the third token. So two words that everything follows cost one row per prefix, not one per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structmill.llm.sources import source_name
from structmill.sources.tables import cut, spread, table

#: A trigram counts as frequent inside from this many times on, ...
LEAST_INSIDE = 2
#: ... and as almost never terminal up to this share of them.
MOST_AT_END = 0.05
#: A word goes on seldom from its two predecessors if it follows them in less than this share.
SELDOM = 0.08

#: Letters of one token: longer runs of letters are several tokens, so a token has few prefixes.
LONGEST = 48

_TOKEN = rf"[a-z_\p{{L}}\p{{M}}]{{1,{LONGEST}}}|`[^`\n]*`|[0-9]+(?:[.:][0-9]+)*|[^\s\p{{L}}\p{{M}}0-9_]"
_TRAIL = r"\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\.\.\.+|…)\s*$"


def _tokens(paragraph: Column) -> Column:
    """Two start marks and the tokens; code spans and numbers are all alike; an ellipsis at the end is left out."""
    lower = F.lower(paragraph)
    end = F.rtrim(lower, F.lit(" \t\n\r\f\v"))
    # most paragraphs need none of these: a look that costs little comes first
    plain = F.when(end.endswith("...") | end.endswith("…") | end.endswith("]"), F.regexp_replace(lower, _TRAIL, "")).otherwise(lower)
    plain = F.when(plain.contains("`"), F.regexp_replace(plain, r"`[^`\n]+`", "`x`")).otherwise(plain)
    plain = F.regexp_replace(plain, r"[0-9]+(?:[.:][0-9]+)*", "0")
    return F.concat(F.array(F.lit("^"), F.lit("^")), F.regexp_extract_all(plain, F.lit(f"({_TOKEN})"), F.lit(1)))


def _flat(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\s+$", "")


def trigram_counts(documents: DataFrame) -> DataFrame:
    """Of each trigram of the corpus: how often it stands inside a paragraph and how often at its end.

    A text counts once, however many rows and ids it has; line ends and blanks at the end make no other text of it.
    """
    texts = documents.select(_flat(F.col("text")).alias("t")).distinct()
    tokens = texts.select(F.explode(F.split("t", r"\n\s*\n")).alias("p")).select(_tokens(F.col("p")).alias("w"))
    return documents.sparkSession.sql(_COUNTS, tokens=tokens)


_COUNTS = """
SELECT ab, c, count_if(NOT last) AS inside, count_if(last) AS at_end
FROM (
  SELECT concat_ws(' ', g.`0`, g.`1`) AS ab, g.`2` AS c, at = n - 3 AS last
  FROM (SELECT size(w) AS n, posexplode(arrays_zip(slice(w, 1, size(w) - 2), slice(w, 2, size(w) - 2), slice(w, 3, size(w) - 2))) AS (at, g) FROM {tokens} WHERE size(w) > 2)
) GROUP BY ab, c"""

#: Of each last trigram: its counts without its own ending, and those of all tokens that begin with its last one.
_SEEN = """
WITH tails AS (SELECT ab, c, max(listing) AS listing FROM {ends} WHERE c IS NOT NULL GROUP BY ab, c),
near AS (SELECT n.ab, n.c, n.inside, n.at_end FROM {counts} n LEFT SEMI JOIN tails t ON n.ab = t.ab),
begun AS (
  SELECT ab, part, sum(n) AS n
  FROM (SELECT ab, inside + at_end AS n, explode(transform(sequence(0, length(c) - 1), k -> substring(c, 1, k))) AS part FROM near)
  GROUP BY ab, part
)
SELECT t.ab AS s_ab, t.c AS s_c, coalesce(n.inside, 0) AS inside, greatest(coalesce(n.at_end, 0) - 1, 0) AS at_end, coalesce(b.n, 0) AS longer, coalesce(a.n, 0) AS any
FROM tails t
LEFT JOIN near n ON t.ab = n.ab AND t.c = n.c
LEFT JOIN begun b ON t.ab = b.ab AND t.c = b.part
LEFT JOIN (SELECT ab, n FROM begun WHERE part = '') a ON t.listing AND t.ab = a.ab"""

_VERDICTS = """
WITH judged AS (
  SELECT e.*, coalesce(s.inside, 0) AS inside, coalesce(s.at_end, 0) AS at_end, coalesce(s.longer, 0) AS longer, coalesce(s.any, 0) AS any
  FROM {ends} e LEFT JOIN {seen} s ON e.ab = s.s_ab AND e.c = s.s_c
), whys AS (
  SELECT doc_id, CASE
    WHEN closed AND NOT dots AND NOT fence AND NOT opened AND NOT broken THEN NULL
    -- "..., kernel ...": an author trails off with a word that seldom goes on from here
    WHEN listing AND NOT bracketed AND NOT fence AND NOT opened AND inside + longer < {seldom} * any + {least} THEN NULL
    WHEN inside >= {least} AND at_end <= {most} * inside THEN 'sentence'
    WHEN longer >= {least} AND inside + at_end <= {most} * longer THEN 'word'
    WHEN fence OR opened THEN 'block'
    WHEN broken THEN 'bytes'
    WHEN dots AND bracketed THEN 'form'
    WHEN at_end > 0 THEN NULL
    WHEN dots OR prose THEN 'form'
  END AS why FROM judged
)
SELECT doc_id, min(why) IS NOT NULL AS truncated, min(why) AS why FROM whys GROUP BY doc_id"""


def _count(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def endings(documents: DataFrame) -> DataFrame:
    """Per document what its last paragraph shows by its form: open, closed, trailing dots, and its last trigram."""
    text = _flat(F.col("text"))
    shaped = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", text.alias("t")).where(F.col("t") != "")
    last = shaped.select(
        "doc_id",
        (F.size(F.regexp_extract_all("t", F.lit(r"(?m)^(\s*```)"), F.lit(1))) % 2 == 1).alias("fence"),
        F.col("t").rlike("\\uFFFD$").alias("broken"),
        F.regexp_replace("t", r"(?s)^.*\n\s*\n", "").alias("p"),
    )
    # each part once: they are looked at many times
    parts = last.select(
        "doc_id",
        "fence",
        "broken",
        "p",
        F.regexp_replace("p", r"(?s)^.*\n", "").alias("line"),
        F.regexp_extract("p", r"(?s)(?:^|\n)([^\n]*)\n[^\n]*$", 1).alias("before"),
        F.regexp_replace("p", r"(?s)```.*?```", "").alias("body"),
        _tokens(F.regexp_replace("p", "\\uFFFD+$", "")).alias("tokens"),
    )
    line, before, body, tokens = (F.col(c) for c in ("line", "before", "body", "tokens"))
    row = line.startswith("|")
    opened = (
        (_count(body, "`") % 2 == 1)
        | (F.col("p").startswith("(") & (_count(F.col("p"), "(") > _count(F.col("p"), ")")))
        | (F.col("p").startswith("{") & (_count(F.col("p"), "{") > _count(F.col("p"), "}")))
        | (row & (~line.endswith("|") | (before.startswith("|") & (_count(line, "|") < _count(before, "|")))))
    )
    closed = (
        line.rlike(r"[.!?。！？؟][\"'»”’)\]*_`]*$")  # a sentence
        | line.rlike(r"^-- ?\S")  # a signature
        | line.rlike(r"^<?https?://\S+>?$")  # a link alone
        | line.rlike(r"^\[[^\]]+\]:\s+\S+\.\w+$")  # a reference
        | line.rlike(r"^!?\[[^\]]*\]\([^)]*\)$")
        | line.rlike(r"^#{1,6} ")  # a heading
        | line.rlike(r"^\s*```\s*$")
        | row
        | line.rlike(r"^\s*(?:[-*+]|\d+[.)])\s+.*`$")  # an item that ends in code
        | line.rlike(r"^`[^`]+`$")
        | line.rlike(r"[}\];>]$")
        | (F.col("p").startswith("(") & line.endswith(")"))
        | line.rlike(r"^\S*[/\\]\S*\.\w+$")  # a path alone
    )
    return parts.select(
        "doc_id",
        "fence",
        "broken",
        opened.alias("opened"),
        (line.rlike(_TRAIL)).alias("dots"),
        line.rlike(r"\]$").alias("bracketed"),
        line.rlike(r",\s*[\p{L}\p{M}_]+ ?(?:\.\.\.|…)$").alias("listing"),
        closed.alias("closed"),
        (F.col("p").rlike(r"(?s)[.!?;:,]\s+\S") | F.col("p").rlike(r"^\W*\p{Lu}\S*(?:\s+\S+){2}")).alias("prose"),
        F.concat_ws(" ", F.element_at(tokens, -3), F.element_at(tokens, -2)).alias("ab"),
        F.element_at(tokens, -1).alias("c"),
    )


def truncated(documents: DataFrame, least_inside: int = LEAST_INSIDE, most_at_end: float = MOST_AT_END, seldom: float = SELDOM) -> DataFrame:
    """Per document with text: doc_id, whether it is cut, and why: block | bytes | sentence | word | form.

    Null and empty texts (also of blanks only) aren't cut and don't appear. Repeated rows of a document count
    once, and so does a text under several ids; a document is cut if any row of it is.
    """
    documents = spread(documents.select("doc_id", "text"), "doc_id", "text")
    counts = cut(trigram_counts(documents.where(F.col("text").isNotNull()).select("text")))
    ends = cut(endings(documents))
    seen = documents.sparkSession.sql(_SEEN, ends=ends, counts=counts)
    return documents.sparkSession.sql(_VERDICTS, ends=ends, seen=seen, seldom=seldom, least=least_inside, most=most_at_end)


def source_rates(documents: DataFrame) -> DataFrame:
    """Per source, spelled plainly (null: unknown): documents, truncated ones, their share. Empty texts count as whole."""
    flags = truncated(documents).where("truncated").select(F.col("doc_id").alias("f_doc_id"))
    once = documents.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(source_name(F.col("source"))).alias("source"))
    joined = once.join(flags, F.col("doc_id") == F.col("f_doc_id"), "left")
    counted = joined.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("f_doc_id").alias("truncated"))
    return counted.withColumn("rate", F.col("truncated") / F.col("documents"))


def p8_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return truncated(table(spark, data_dir, "documents")).where("truncated").select("doc_id")


def p8_source_rates(spark: SparkSession, data_dir: str) -> DataFrame:
    return source_rates(table(spark, data_dir, "documents"))


QUERIES = {"p8_found": p8_found, "p8_source_rates": p8_source_rates}


def _said(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_tokens(paragraph: str) -> str:
    plain = f"regexp_replace(regexp_replace(regexp_replace(lower({paragraph}), {_said(_TRAIL)}, ''), '`[^`\\n]+`', '`x`', 'g'), '[0-9]+(?:[.:][0-9]+)*', '0', 'g')"
    return f"list_concat(['^', '^'], regexp_extract_all({plain}, {_said(_TOKEN)}))"


def _sql_count(x: str, part: str) -> str:
    return f"(length({x}) - length(replace({x}, '{part}', '')))"


_FLAT = r"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\s+$', '')"
_CLOSED = " OR ".join(
    f"regexp_matches(line, {_said(x)})"
    for x in (
        r"[.!?。！？؟][\"'»”’)\]*_`]*$", r"^-- ?\S", r"^<?https?://\S+>?$", r"^\[[^\]]+\]:\s+\S+\.\w+$", r"^!?\[[^\]]*\]\([^)]*\)$", r"^#{1,6} ", r"^\s*```\s*$", r"^\|",
        r"^\s*(?:[-*+]|\d+[.)])\s+.*`$", r"^`[^`]+`$", r"[}\];>]$", r"^\S*[/\\]\S*\.\w+$",
    )
)
_JUDGED = rf"""texts AS (SELECT DISTINCT {_FLAT} AS t FROM documents WHERE text IS NOT NULL), para AS (SELECT unnest(string_split_regex(t, '\n\s*\n')) AS p FROM texts), toks AS (SELECT {_sql_tokens('p')} AS w FROM para),
    grams AS (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: struct_pack(ab := w[i] || ' ' || w[i + 1], c := w[i + 2], fin := i = len(w) - 2))) AS g FROM toks WHERE len(w) > 2),
    counts AS (SELECT g.ab AS ab, g.c AS c, count(*) FILTER (NOT g.fin) AS inside, count(*) FILTER (g.fin) AS at_end FROM grams GROUP BY ALL),
    shaped AS (SELECT doc_id, {_FLAT} AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), lasts AS (SELECT doc_id, len(regexp_extract_all(t, '(?m)^(\s*```)', 1)) % 2 = 1 AS fence, ends_with(t, chr(65533)) AS broken,
        regexp_replace(t, '(?s)^.*\n\s*\n', '') AS p FROM shaped WHERE t <> ''),
    parts AS (SELECT *, regexp_replace(p, '(?s)^.*\n', '') AS line, regexp_extract(p, '(?s)(?:^|\n)([^\n]*)\n[^\n]*$', 1) AS before, regexp_replace(p, '(?s)```.*?```', '', 'g') AS body,
        {_sql_tokens("regexp_replace(p, chr(65533) || '+$', '')")} AS w FROM lasts),
    ends AS (SELECT doc_id, fence, broken, {_sql_count('body', '`')} % 2 = 1 OR (starts_with(p, '(') AND {_sql_count('p', '(')} > {_sql_count('p', ')')}) OR (starts_with(p, '{{') AND {_sql_count('p', '{')} > {_sql_count('p', '}')})
        OR (starts_with(line, '|') AND (NOT ends_with(line, '|') OR (starts_with(before, '|') AND {_sql_count('line', '|')} < {_sql_count('before', '|')}))) AS opened, regexp_matches(line, {_said(_TRAIL)}) AS dots, ends_with(line, ']') AS bracketed,
        regexp_matches(line, ',\s*[\p{{L}}\p{{M}}_]+ ?(?:\.\.\.|…)$') AS listing, {_CLOSED} OR (starts_with(p, '(') AND ends_with(line, ')')) AS closed,
        regexp_matches(p, '(?s)[.!?;:,]\s+\S') OR regexp_matches(p, '^\W*\p{{Lu}}\S*(?:\s+\S+){{2}}') AS prose, w[-3] || ' ' || w[-2] AS ab, w[-1] AS c FROM parts),
    tails AS (SELECT DISTINCT ab, c FROM ends),
    seen AS (SELECT t.ab, t.c, coalesce(sum(inside) FILTER (n.c = t.c), 0) AS inside, greatest(coalesce(sum(at_end) FILTER (n.c = t.c), 0) - 1, 0) AS at_end, coalesce(sum(inside + at_end) FILTER (n.c <> t.c AND starts_with(n.c, t.c)), 0) AS longer,
        coalesce(sum(inside + at_end), 0) AS anything FROM tails t LEFT JOIN counts n ON n.ab = t.ab GROUP BY ALL),
    whys AS (SELECT doc_id, CASE WHEN closed AND NOT dots AND NOT fence AND NOT opened AND NOT broken THEN NULL WHEN listing AND NOT bracketed AND NOT fence AND NOT opened AND inside + longer < {SELDOM} * anything + {LEAST_INSIDE} THEN NULL
        WHEN inside >= {LEAST_INSIDE} AND at_end <= {MOST_AT_END} * inside THEN 'sentence' WHEN longer >= {LEAST_INSIDE} AND inside + at_end <= {MOST_AT_END} * longer THEN 'word' WHEN fence OR opened THEN 'block' WHEN broken THEN 'bytes'
        WHEN dots AND bracketed THEN 'form' WHEN at_end > 0 THEN NULL WHEN dots OR prose THEN 'form' END AS why FROM ends JOIN seen USING (ab, c)),
    cut_ids AS (SELECT doc_id FROM whys GROUP BY doc_id HAVING min(why) IS NOT NULL)"""

SQL = {
    "p8_found": f"WITH {_JUDGED} SELECT doc_id FROM cut_ids",
    "p8_source_rates": rf"""WITH {_JUDGED}, once AS (SELECT doc_id, min(nullif(regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g'), '')) AS source FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)
        SELECT source, count(*) AS documents, count(c.doc_id) AS truncated, count(c.doc_id) / count(*) AS rate FROM once LEFT JOIN cut_ids c USING (doc_id) GROUP BY source""",
}
