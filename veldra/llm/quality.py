"""Quality rules (operator 8): cross-document line frequency, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, WORD, Workspace, free, session

#: A line of any length is boilerplate of its host when it occurs in more than
#: max(LINE_DOCS, min(LINE_MOST, LINE_SHARE * the host's documents)) distinct documents of that host.
LINE_DOCS, LINE_SHARE, LINE_MOST = 10, 0.01, 1000
#: A document is depleted when less than KEEP_PERCENT of its words are in lines that stay: over 30 % of repeated lines is a usual limit.
KEEP_PERCENT = 70
MIN_WORDS, REPEAT_PERCENT = 50, 50


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, which a repeated column expression isn't."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def normalised(line: Column) -> Column:
    """A-Z lower-cased, runs of white space as one space, trimmed, numbers that stand alone (dates, sums) as 0."""
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.trim(F.regexp_replace(low, GAP, " ")), "(?<![^ ])[0-9][0-9.,:/-]*+(?![^ ])", "0")


def line_of(line: Column) -> Column:
    """(h, k) of a line: the hash of what it is counted as, and its number of words."""
    return F.struct(F.xxhash64(normalised(line)).alias("h"), F.size(words_of(line)).alias("k"))


def repeat_words(words: Column) -> Column:
    """Number of words that stand in a 3-word window found twice or more.

    Windows become (hash, position) pairs; sorting brings equal ones together, so the work for a text is n log n
    whatever repeats in it.
    """

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"])))
        p = F.sort_array(F.transform(twice, lambda x: x["p"]))
        return let(p, lambda q: F.aggregate(q, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-9).alias("last")), lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).cast("long").alias("n"), x.alias("last")), lambda acc: acc["n"]))

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - 3)
        return F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("p"))))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashed, lambda h: F.when(F.size(h) < 4, F.lit(0).cast("long")).otherwise(let(windows(h), covered)))


def without(text: Column, gone: Column) -> Column:
    """The text without the lines whose normalised hash is in gone; null or empty gone leaves it as it is."""
    left = F.filter(F.split(text, "\n"), lambda y: ~F.array_contains(gone, line_of(y)["h"]))
    return F.when(F.size(gone) > 0, F.array_join(left, "\n")).otherwise(text)


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, line_most: int = LINE_MOST, keep_percent: int = KEEP_PERCENT, keyed: bool = False) -> DataFrame:
    """Base counts, and the verdict by the frequency of lines over the documents of a host.

    Lines (split at \\n) are normalised and hashed; documents are counted for each (host, line), where documents of equal
    text count once, so copies don't make each other's lines frequent. Frequent lines go, whatever their length; a document of
    which less than keep_percent of the words is left is rejected.

    Nulls: a null text is the empty text (no words, so base_failed); a null host is one host of its own; a null id is
    carried as it is. Repeated rows each get a result. An empty table gives an empty result. Extra columns are ignored,
    whatever their names; keyed=True adds host, key and key2, hashes of the text, by which rows can be found again,
    and gone, the hashes of the document's frequent lines (null without any), which without() takes out of the text; cleaned() does both. Very long texts: sorting within the row,
    no windows are shuffled.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_words, kept.
    """
    work = Workspace(session(docs), "quality")
    text = F.coalesce(F.col("t"), F.lit(""))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"), F.col(f"`{host_col}`").cast("string").alias("host"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    base = src.select(
        F.monotonically_increasing_id().alias("n"), "id", "host", F.xxhash64("t").alias("key"), F.xxhash64(F.lit(5), "t").alias("key2"),
        let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace(text, GAP, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.transform(x, line_of).alias("each"))).alias("l"),
    )
    base = work.put(base, "base")
    each = base.select("n", "host", "key", F.explode("l.each").alias("x")).select("n", "host", "key", "x.h", "x.k")
    hosts = base.select("host", "key").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    often = each.select("host", "h", "key").distinct().groupBy("host", "h").agg(F.count("*").alias("found")).where(F.col("found") > line_docs)
    often = often.alias("o").join(hosts.alias("s"), F.expr("o.host <=> s.host")).where(F.col("found") > F.least(F.lit(float(line_most)), F.col("docs") * F.lit(line_share))).select("o.host", "o.h")
    gone = each.alias("e").join(often.alias("o"), F.expr("e.h = o.h AND e.host <=> o.host"), "left_semi").groupBy("n").agg(F.sum("k").alias("gone"), F.array_sort(F.collect_set("h")).alias("gone_lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = base.join(gone, "n", "left").select("id", "host", "key", "key2", "w.n_words", "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), "w.n_repeat_words", (F.col("w.n_words") - F.coalesce("gone", F.lit(0))).alias("kept_words"), F.col("gone_lines").alias("gone"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (100 * F.col("kept_words") >= keep_percent * F.col("n_words")))
    return work.last(out.select(F.col("id").alias(id_col), *(["host", "key", "key2", "gone"] if keyed else []), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_words", "kept"))


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their frequent lines; n_chars follows a text that lost some, all else is unchanged.

    Verdicts are small rows; documents are found again by hashes of id, host and text, on which a verdict depends. Nulls count as values;
    repeated rows share a verdict and all stay or go; an empty table stays empty. Other columns pass unchanged, whatever
    their names; without a source all documents are of one host.
    """
    host = docs["source"].cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    one, two, gone = free(docs.columns, "_place", "_text", "_gone")
    place = lambda i, host, key: F.xxhash64(i, host, key)
    mine = docs.withColumn(one, place(docs["doc_id"], host, F.xxhash64(docs["text"].cast("string")))).withColumn(two, F.xxhash64(F.lit(5), docs["text"].cast("string")))
    judged = line_quality(docs.select("doc_id", "text", host.alias("source")), keyed=True).where("kept")
    passed = judged.groupBy(place("doc_id", "host", "key").alias(one), F.col("key2").alias(two)).agg(F.first("gone", True).alias(gone))
    out = mine.join(passed.hint("merge"), [one, two]).withColumn("text", without(F.col("text"), F.col(gone)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & (F.size(gone) > 0), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(f"`{c}`" for c in docs.columns))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that pass, without the frequent lines of their host."""
    return cleaned(docs)


ORACLE = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, row_number() OVER () AS n FROM documents),
w AS (SELECT n, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT n, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT n, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, g) AS c FROM p) WHERE c > 1),
rw AS (SELECT n, count(DISTINCT i + j) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY n),
l AS (SELECT n, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT n, host, t, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS k,
  array_to_string(list_transform(string_split(trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' '),
    lambda word: CASE WHEN regexp_full_match(word, '[0-9][0-9.,:/-]*') THEN '0' ELSE word END), ' ') AS h
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT n, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY n),
hosts AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
often AS (SELECT o.host, o.h FROM (SELECT host, h, count(DISTINCT t) AS found FROM lw GROUP BY host, h) o
  JOIN hosts s ON o.host IS NOT DISTINCT FROM s.host WHERE found > {LINE_DOCS} AND found > least({LINE_MOST}, docs * {LINE_SHARE}::DOUBLE)),
gone AS (SELECT lw.n, sum(k) AS gone FROM lw JOIN often o ON lw.h = o.h AND lw.host IS NOT DISTINCT FROM o.host GROUP BY lw.n),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, (len(ws) - coalesce(gone, 0))::BIGINT AS kept_words
  FROM d JOIN w USING (n) LEFT JOIN rw USING (n) LEFT JOIN dl USING (n) LEFT JOIN gone USING (n))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed,
  (NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND 100 * kept_words >= {KEEP_PERCENT} * n_words) AS kept
FROM b
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_quality(docs).drop("kept_words")
