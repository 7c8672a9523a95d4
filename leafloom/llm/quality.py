"""Quality rules: word counts and repetition within a document, and the frequency of its lines across documents.

Lines are normalised (A-Z lower-cased, digits to 0, white space to single spaces) and hashed. For every host (`source`) and line the distinct
documents are counted; a line above the limits is boilerplate, and its words are counted as removed (no text is changed here); a document of which too little is left is depleted and is rejected.
Copies of a document must not make its lines boilerplate, so documents are told apart by a hash of the whole set of their lines: copies agree
in it and count once, for a line as for the size of the host. Documents that differ in one line are two, whatever template they share.

Only DataFrame functions are used. Every row is judged by itself, whatever its id. Null texts have no words, null hosts are one host. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.llm.common import ready, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEW = 48  # up to so many repeated windows, they are looked up one by one; beyond that by sorting


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * 6), " "), "")


def base_counts(docs: DataFrame) -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words in place of their text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACES, "") != "")
    df = docs.withColumn("text", text).withColumn("lines", lines).withColumn("words", words_of(F.col("text")))
    # A hash for each window of three words, then those that occur twice.
    df = df.withColumn("n_words", F.size("words"))
    window = lambda w, i: F.when(i < F.col("n_words") - 2, F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    df = df.withColumn("windows", F.filter(F.transform("words", window), lambda x: x.isNotNull()))
    df = df.withColumn("sorted", F.sort_array("windows"))
    df = df.withColumn("twice", F.array_distinct(F.filter("sorted", lambda x, i: (i > 0) & (F.get("sorted", i - 1) == x))))
    places = F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    looked_up = F.filter(places, lambda p: F.array_contains("twice", p["x"]))
    df = df.withColumn("ranked", F.when(F.size("twice") > FEW, F.sort_array(places)))
    among = F.filter("ranked", lambda p, k: (F.get("ranked", k - 1)["x"] == p["x"]) | F.coalesce(F.get("ranked", k + 1)["x"] == p["x"], F.lit(False)))
    hits = F.when(F.size("twice") == 0, F.array().cast("array<int>")).when(F.size("twice") <= FEW, F.transform(looked_up, lambda p: p["i"])).otherwise(F.transform(among, lambda p: p["i"]))
    df = df.withColumn("hits", hits)
    covered = F.array_distinct(F.concat("hits", F.transform("hits", lambda i: i + 1), F.transform("hits", lambda i: i + 2)))
    return df.select(
        "*",
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
    ).drop("lines", "words", "windows", "sorted", "twice", "ranked", "hits", "text").withColumn("n_words", F.col("n_words").cast("long"))


def normalised(line: Column) -> Column:
    plain = F.translate(line, UPPER + "123456789" + SPACES, LOWER + "0" * 9 + " " * 6)
    return F.trim(F.regexp_replace(plain, " +", " "))


def line_shares(docs: DataFrame, min_docs: int, percent: float) -> DataFrame:
    """row_key, words in boilerplate lines (removed) and in all lines (total), of every document that has such a line."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), normalised), lambda line: line != "")
    hashed = F.transform("lines", lambda line: F.struct(F.substring(F.md5(line), 1, 16).alias("line"), (F.length(line) - F.length(F.translate(line, " ", "")) + 1).alias("words")))
    df = docs.select("row_key", "host", lines.alias("lines")).withColumn("lines", hashed)
    df = df.withColumn("own", F.xxhash64(F.array_sort(F.array_distinct(F.col("lines.line"))))).withColumn("total", F.aggregate("lines", F.lit(0), lambda acc, line: acc + line["words"]))
    # A document without lines keeps a row, for the size of its host.
    df = df.select("row_key", "host", "total", "own", F.posexplode_outer("lines").alias("at", "line"))
    df = df.select("row_key", "host", "total", "own", "at", F.col("line.line").alias("line"), F.col("line.words").alias("words"))
    df = written(df, "lines")
    met = df.where("line is not null").select("host", "line", "own").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    hosts = df.where("at is null or at = 0").select("host", "own").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    frequent = met.where(F.col("n_docs") > min_docs).join(hosts, "host").where(F.col("n_docs") * 100 > F.col("host_docs") * percent).select("host", "line")
    # Repeated rows share a key and count once.
    met = df.join(frequent, ["host", "line"]).select("row_key", "at", "words", "total").distinct()
    return met.groupBy("row_key").agg(F.sum("words").alias("removed"), F.first("total").alias("total"))


def assess(docs: DataFrame, min_docs: int = 20, percent: float = 1.0, left_percent: float = 30.0) -> DataFrame:
    """The documents without their text, with the base counts, base_failed, n_line_words_removed and kept.

    base_failed: fewer than 50 words, or more than half of them in repeated windows of three. A line is boilerplate in a host if more than `min_docs`
    distinct documents and more than `percent` of its distinct documents have it. A document is depleted if less than `left_percent` of its words are left.
    """
    ready(docs.sparkSession)
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "source", "text")).withColumn("host", F.coalesce("source", F.lit("")))
    shares = line_shares(docs.select("row_key", "host", "text"), min_docs, percent)
    shares = shares.select("row_key", "removed", ((F.col("total") - F.col("removed")) * 100 < F.col("total") * left_percent).alias("depleted"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # The counts are a table of their own, so that a filter on the result meets numbers: pushed below, it would evaluate the nested array expressions once per use.
    df = written(base_counts(docs), "counts").join(shares, "row_key", "left").drop("row_key", "host")
    df = df.withColumn("base_failed", failed).withColumn("n_line_words_removed", F.coalesce("removed", F.lit(0)).cast("long"))
    return df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False))).drop("removed", "depleted")


COUNTS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words_removed"]


def verdicts(docs: DataFrame, **limits) -> DataFrame:
    """`assess` for doc_id, text and source alone, with the columns of `COUNTS`."""
    return assess(docs.select("doc_id", "text", "source"), **limits).select(*COUNTS)


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The documents that pass, with all their columns and whole texts."""
    columns = {c: f"own_{i}" for i, c in enumerate(docs.columns)}  # no clash with the columns made here
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in columns.items()], F.xxhash64("doc_id", "source", "text").alias("row_key"))
    verdict = assess(docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "source", "text").alias("key")), **limits)
    good = verdict.where("kept").select(F.col("key").alias("row_key"))
    return rows.join(good, "row_key", "left_semi").select(*[F.col(n).alias(c) for c, n in columns.items()])


LINES_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, host, u.i AS pos, u.line FROM docs, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i) u
),
worded AS (SELECT * FROM lines WHERE regexp_matches(line, '[^ 	-
]')),
plain AS (
  SELECT doc_id, host, pos, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[ 	-
]+', ' ', 'g')) AS line FROM worded
),
hashed AS (SELECT doc_id, host, pos, md5(line)[1:16] AS line, length(line) - length(replace(line, ' ', '')) + 1 AS words FROM plain),
owns AS (SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY line)) AS own FROM (SELECT DISTINCT doc_id, line FROM hashed) GROUP BY doc_id),
keyed AS (SELECT h.*, own FROM hashed h JOIN owns USING (doc_id)),
hosts AS (SELECT host, count(DISTINCT coalesce(own, '')) AS host_docs FROM docs LEFT JOIN owns USING (doc_id) GROUP BY host),
frequent AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT own) AS n FROM keyed GROUP BY host, line) JOIN hosts USING (host)
  WHERE n > 20 AND n * 100 > host_docs * 1.0
),
removed AS (SELECT doc_id, sum(words) AS removed FROM keyed SEMI JOIN frequent USING (host, line) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id),
words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(text, '[^ 	-
]+') AS w FROM docs)
),
triples AS (
  SELECT doc_id, i, n, word AS a, lead(word, 1) OVER (PARTITION BY doc_id ORDER BY i) AS b, lead(word, 2) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM words
),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM triples WHERE i <= n - 2) WHERE k > 1),
covered AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(d) GROUP BY doc_id),
base AS (
  SELECT doc_id, len(regexp_extract_all(text, '[^ 	-
]+')) AS n_words,
    length(regexp_replace(text, '[ 	-
]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed, 0) AS removed
  FROM docs LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)
),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT (n_words > 0 AND (n_words - removed) * 100 < n_words * 30) AS kept,
  removed::BIGINT AS n_line_words_removed
FROM judged
"""
