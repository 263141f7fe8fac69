"""Line-first quality rules (native DataFrame operators only).

Method: each line of a text is judged by itself (shape of its end, navigation, symbols, boilerplate
phrases). Lines that fail are removed; a document that loses more than half of its words with them
is rejected, whatever the rest looks like. Base counts of the whole text reject first.

Everything is computed within the row with array functions over whole texts: no shuffle, no Python,
and cost in proportion to the text (repeated windows are found by sorting their 64-bit hashes).

Cases: a null or empty text has no words, so it fails the base rule. An id may be null or repeat;
rows are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesync.llm.common import SPACE, WORD, let, text_of

# Limits of the base rule.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

# Rules of a line. A line fails if any of them holds.
NAVIGATION = r"[|»›•]"
MAX_NAVIGATION_MARKS = 2
NOISE = r"(?:[#*$%&]{2,}|!{2,})(?=[\x20\x09-\x0D]|$)"
BOILERPLATE = (
    r"(?:all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|licensed under"
    r"|released under|enable javascript|accept (?:all )?cookies|subscribe to our|sign up for"
    r"|click here|back to top|skip to content|share this|follow us)"
)
MAX_BOILERPLATE_WORDS = 25
SHORT_LINE_WORDS = 3
LINE_END = r"[.!?…:;\"'”’»)\]。！？]" + SPACE + "*$"
MAX_LOST_PERCENT = 50


def window_hashes(words: Column) -> Column:
    """Hash of every run of WINDOW words, in order; empty if there are fewer words."""

    def hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - WINDOW + 1)
        return F.when(
            F.size(h) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
        ).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashes)


def covered_words(hashes: Column) -> Column:
    """Words within windows whose hash occurs twice or more."""

    def places(runs: Column) -> Column:
        again = F.filter(
            runs,
            lambda r, i: (F.get(runs, i - 1)["h"] == r["h"]).eqNullSafe(F.lit(True))
            | (F.get(runs, i + 1)["h"] == r["h"]).eqNullSafe(F.lit(True)),
        )
        return F.sort_array(F.transform(again, lambda r: r["i"]))

    def total(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

    runs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(runs, places), total)


def repeated_words(words: Column) -> Column:
    return let(
        window_hashes(words),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered_words(h)),
    )


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(WORD)))
    return let(lines, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))


def line_fails(line: Column, n_words: Column) -> Column:
    marks = F.regexp_count(line, F.lit(NAVIGATION)) > MAX_NAVIGATION_MARKS
    noise = F.regexp_count(line, F.lit(NOISE)) * 4 > n_words
    boilerplate = (n_words <= MAX_BOILERPLATE_WORDS) & F.rlike(F.lower(line), F.lit(BOILERPLATE))
    stub = (n_words <= SHORT_LINE_WORDS) & ~F.rlike(line, F.lit(LINE_END))
    return marks | noise | boilerplate | stub


def good_lines(text: Column) -> Column:
    """Array of (line, n_words) of the lines that have words and pass every rule."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda line: F.struct(line.alias("line"), F.regexp_count(line, F.lit(WORD)).alias("n")),
    )
    return F.filter(lines, lambda x: (x["n"] > 0) & ~line_fails(x["line"], x["n"]))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the base counts, the verdict and the cleaned text."""
    text = text_of()
    counted = docs.select(
        "doc_id",
        F.inline(
            F.array(
                let(
                    F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
                    lambda w: F.struct(
                        F.size(w).cast("long").alias("n_words"),
                        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
                        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                        duplicate_lines(text).alias("n_dup_lines"),
                        repeated_words(w).alias("n_repeat_words"),
                        good_lines(text).alias("good"),
                    ),
                )
            )
        ),
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    good_words = F.aggregate("good", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    judged = counted.withColumn("n_good_words", good_words).withColumn("base_failed", base_failed)
    lost = 100 * (F.col("n_words") - F.col("n_good_words")) > MAX_LOST_PERCENT * F.col("n_words")
    return judged.withColumn("kept", ~F.col("base_failed") & ~lost).withColumn(
        "clean_text", F.array_join(F.transform("good", lambda x: x["line"]), "\n")
    )


def quality_digest(docs: DataFrame) -> DataFrame:
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_good_words"
    )


def oracle_sql() -> str:
    """DuckDB twin, by other means: windows as joined strings, positions by unnesting."""
    end = LINE_END.replace("'", "''")
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (
  SELECT rid, unnest(range(1, len(ws) - 6)) AS p, ws FROM w WHERE len(ws) >= {WINDOW}),
k AS (
  SELECT rid, p, count(*) OVER (PARTITION BY rid, array_to_string(ws[p:p + 7], ' ')) AS n FROM g),
c AS (
  SELECT rid, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT rid, unnest(range(p, p + {WINDOW})) AS q FROM k WHERE n > 1) GROUP BY rid),
l AS (
  SELECT rid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)),
lf AS (
  SELECT rid, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
         coalesce(sum(n) FILTER (n > 0 AND NOT (
           len(regexp_extract_all(line, '{NAVIGATION}')) > {MAX_NAVIGATION_MARKS}
           OR len(regexp_extract_all(line || ' ', '(?:[#*$%&]{{2,}}|!{{2,}})[\x20\x09-\x0D]')) * 4 > n
           OR (n <= {MAX_BOILERPLATE_WORDS} AND regexp_matches(lower(line), '{BOILERPLATE}'))
           OR (n <= {SHORT_LINE_WORDS} AND NOT regexp_matches(line, '{end}')))), 0) AS n_good_words
  FROM l GROUP BY rid),
j AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         n_good_words::BIGINT AS n_good_words
  FROM w LEFT JOIN c USING (rid) LEFT JOIN lf USING (rid))
SELECT *, NOT base_failed AND NOT 100 * (n_words - n_good_words) > {MAX_LOST_PERCENT} * n_words AS kept
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM j)
"""
