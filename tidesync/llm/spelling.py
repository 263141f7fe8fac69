"""Spelling variants: permuterm rotations, sorted; neighbours are found by scanning prefix groups.

Method:

1. Words are counted over whole texts (one aggregate with partial sums).
2. Each word is marked with a terminator and gives all of its rotations. Two words that differ by one
   replaced letter have rotations that are equal but for their last letter; a word that lacks one letter
   of another has a rotation equal to the other's without its last letter. So every rotation is filed
   whole and, skipping its last letter (the edited one), as a prefix.
3. The rotations are range-partitioned and sorted by prefix. One scan over each prefix group gives each
   member the number of its neighbours and its best one; no pair is ever written. A group holds a
   letter at most once, so it has at most as many members as the alphabet (90 letters) and one more.
   A letter within a run of equal letters can be deleted at several places with one result; only the
   last place of a run counts.
4. A word's groups are summed up. Forms at least double the count at each step, so a chain has less than
   64 steps and six rounds of pointer doubling find all roots.

Cases: a null text has no words; a null id is the empty text in the hash. Repeated rows count again.
Equal counts: the smallest word in code-point order is the better form. A very long word has as many
rotations as letters. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so
further columns never clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidesync.llm.common import pinned, text_of

# The letters of a word, and every how many-th (document, word) pair loses a letter.
RUN = "[A-Za-zÀ-ÿ]+"
SPOILED = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: Not a letter, so it never occurs in a word.
END = "$"
#: Steps double with each round and counts with each step, so 2 ** 6 steps cover every long.
ROUNDS = 6


def _lower(run: Column) -> Column:
    """A-Z lower-cased, other letters kept; translate() is slow, so only words beyond ASCII take it."""
    ascii_only = F.octet_length(run) == F.length(run)
    return F.when(ascii_only, F.lower(run)).otherwise(F.translate(run, string.ascii_uppercase, string.ascii_lowercase))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of at least LEAST_LENGTH letters that occur LEAST_COUNT times or more."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text_of(), F.lit(RUN), F.lit(0))).alias("run"),
    ).filter(F.length("run") >= LEAST_LENGTH)
    runs = runs.select("id", _lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    place = F.pmod(h, F.length("run")).cast("int")
    spoiled = F.concat(F.expr("substring(run, 1, place)"), F.expr("substring(run, place + 2)"))
    words = runs.select("run", h.alias("h"), place.alias("place")).select(
        F.when(F.col("h") % SPOILED == 0, spoiled).otherwise(F.col("run")).alias("word")
    )
    counted = words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, skips, once, rank): every rotation of every word, whole and without its last letter.

    ``skips``: the rotation had a letter skipped; ``once``: that letter is the last of its run; ``rank``:
    the word as (minus n, word), so that the smallest is the best form.
    """
    marked = words.select(
        F.struct((-F.col("n")).alias("less"), "word").alias("rank"),
        F.concat("word", F.lit(END)).alias("m"),
        F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"),
    )
    turned = marked.select("rank", "i", "m", F.expr("concat(substring(m, i + 1), substring(m, 1, i))").alias("turn"))
    whole = F.struct(F.col("turn").alias("prefix"), F.lit(False).alias("skips"), F.lit(False).alias("once"))
    skipped = F.struct(
        F.expr("substring(turn, 1, length(turn) - 1)").alias("prefix"),
        F.lit(True).alias("skips"),
        F.expr("substring(m, i, 1) != substring(m, i + 1, 1)").alias("once"),
    )
    # rotation 0 ends with the terminator, which is no letter to skip
    filed = F.when(F.col("i") > 0, F.array(whole, skipped)).otherwise(F.array(whole))
    return turned.select("rank", F.inline(filed))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best): best is the near word of largest n as (minus n, word), or null."""
    group = Window.partitionBy("prefix")
    in_order = group.orderBy(F.col("skips").desc(), "rank")
    skips, once = F.col("skips"), F.col("once")
    rank = F.col("rank")
    scanned = (
        rotations(words)
        .repartitionByRange("prefix")
        .select(
            "rank", "skips", "once",
            F.count(F.when(skips, 1)).over(group).alias("n_skips"),
            F.count(F.when(skips & once, 1)).over(group).alias("n_once"),
            F.min(F.when(~skips, rank)).over(group).alias("whole"),
            F.min(F.when(skips & once, rank)).over(group).alias("best_once"),
            F.min(F.when(skips, rank)).over(group).alias("first"),
            F.lead(F.when(skips, rank)).over(in_order).alias("next"),
        )
        .filter("n_skips > 0")
    )
    other = F.when(F.col("first") == rank, F.col("next")).otherwise(F.col("first"))
    shorter = F.when(once, F.col("whole"))
    found = scanned.select(
        "rank",
        F.when(skips, F.col("n_skips") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).otherwise(F.col("n_once")).alias("near"),
        F.when(skips, F.array_min(F.array(other, shorter))).otherwise(F.col("best_once")).alias("best"),
    ).filter("near > 0")
    none = words.select(
        F.struct((-F.col("n")).alias("less"), "word").alias("rank"),
        F.lit(0).cast("long").alias("near"),
        F.lit(None).cast("struct<less:bigint,word:string>").alias("best"),
    )
    summed = found.unionByName(none).groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return summed.select("rank.word", (-F.col("rank.less")).alias("n"), "n_near", "best")


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """(word, root) for every word of ``forms`` (word, form): the end of its chain of forms."""
    jumps = pinned(spark, forms.select("word", F.col("form").alias("root")), "spelling-jumps")
    for _ in range(ROUNDS):
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = jumps.join(onward, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")
        )
        moved = pinned(spark, moved, "spelling-jumps")
        jumps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return jumps


def spelling_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = pinned(spark, count_words(docs), "spelling-words")
    near = neighbours(words)
    better = -F.col("best.less") >= 2 * F.col("n")
    judged = near.select(
        "word", "n", "n_near",
        F.when(better, F.col("best.word")).alias("form"),
        F.when(better, -F.col("best.less")).alias("form_n"),
    )
    judged = pinned(spark, judged, "spelling-judged")
    ends = roots(spark, judged.filter("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def oracle_sql() -> str:
    """The same result by deletion neighbourhoods: near words share a word with one letter left out at the
    same place, or one is the other with a letter left out. crc32 is computed bit by bit."""
    lower = f"translate(run, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, {lower} AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL
),
bytes AS (
  SELECT run, k, hex(encode(id || ':' || run)) AS hx FROM runs
),
bits AS (
  SELECT run, k, list_transform(range(0, 4 * length(hx)), lambda j:
    ((ord(substr(hx, CAST(2 * (j // 8) + 2 - (j % 8) // 4 AS INTEGER), 1)) - 48
      - CASE WHEN substr(hx, CAST(2 * (j // 8) + 2 - (j % 8) // 4 AS INTEGER), 1) >= 'A' THEN 7 ELSE 0 END)
     >> CAST(j % 4 AS INTEGER)) & 1) AS bs
  FROM bytes
),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(bs, lambda b: CAST(b AS BIGINT))),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)))) AS h
  FROM bits
),
spoiled AS (
  SELECT CASE WHEN h % {SPOILED} = 0
    THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
    ELSE run END AS word, k FROM hashed
),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spoiled
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}
),
cut AS (
  SELECT word, n, i, substr(word, 1, CAST(i AS INTEGER) - 1) || substr(word, CAST(i AS INTEGER) + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
),
pairs AS (
  SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word != b.word
  UNION
  SELECT c.word, c.n, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION
  SELECT w.word, w.n, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
),
best AS (
  SELECT a, any_value(an) AS n, count(*) AS n_near, min((-bn, encode(b))) AS top FROM pairs GROUP BY a
),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN -top[1] >= 2 * w.n THEN decode(top[2]) END AS form,
    CASE WHEN -top[1] >= 2 * w.n THEN -top[1] END AS form_n
  FROM words w LEFT JOIN best ON w.word = a
),
chain AS (
  SELECT word, coalesce(form, word) AS root, form IS NULL AS ended FROM forms
  UNION ALL
  SELECT c.word, coalesce(f.form, f.word), f.form IS NULL FROM chain c JOIN forms f ON c.root = f.word WHERE NOT c.ended
)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM forms f JOIN chain c ON f.word = c.word AND c.ended
"""
