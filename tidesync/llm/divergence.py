"""Divergence of sources: in-mapper stripes of term counts, merged by key.

Method:

1. Each task folds its whole documents into hash stripes: per language and term the number of
   documents and the occurrences by source, kept as tables from term to number. A full table is spilled (its rows are handed on and the table
   is emptied), so a task's memory is bounded.
2. Spilled stripes are summed by language, term and source (partial sums, so a common term costs each
   task as many rows as there are sources) and put together to one merged stripe per term. Terms in
   fewer than LEAST_DOCS documents of their language are left out.
3. The merged stripes of a language are dealt to slices of about SLICE terms. A slice and the totals of the
   language's groups meet in one task, which emits the partial divergences of all pairs of sources and
   the best TOP terms of each source.
4. Partial divergences are summed, terms ranked. All arithmetic is on whole numbers; counts beyond 64 bits
   fall back to Python's numbers.

The result lists every pair of sources of a language, so slices hold a row per pair and a slice's memory is
SLICE times the sources of the language.

Cases: null text, lang and source count as empty. A group without terms has counts of 0 everywhere; a
language without kept terms has pairs of value 0 and no term rows; a single source has no pairs. Repeated
rows and null ids are documents of their own. Ties are ordered by the item's UTF-8 bytes. An empty table
gives an empty result. Only ``text``, ``lang`` and ``source`` are read, so further columns never clash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidesync.llm.common import pinned, text_of

LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: Terms of a slice, about; bounds the memory of a task, drops nothing.
SLICE = 1024
#: Cells (term and source) of a task's stripes before they are spilled; bounds the memory of a task.
SPILL_CELLS = 200_000
#: Terms compared at once within a slice.
BLOCK = 64

CELLS = "lang string, term string, source string, n long, df long"

#: A-Z become a-z, letters and all octets of other scripts stay, the rest of ASCII is white space.
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


class _Stripes:
    """Stripes of one language: a term's number of documents and, by source, its occurrences.

    The two parts are kept as tables from term to number, one of documents and one per source, because
    Python then counts a document's words in one call.
    """

    def __init__(self) -> None:
        self.docs: Counter[bytes] = Counter()
        self.by_source: defaultdict[str, Counter[bytes]] = defaultdict(Counter)

    def fold(self, source: str, words: list[bytes]) -> int:
        """Adds a document; returns the new cells."""
        counts = self.by_source[source]
        before = len(counts)
        counts.update(words)
        self.docs.update(set(words))
        return len(counts) - before

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        """The cells by source; the first of a term's cells carries its number of documents."""
        for source, counts in self.by_source.items():
            found = list(counts)
            docs = list(map(self.docs.pop, found, repeat(0)))
            texts = [pa.array(x, pa.string()) for x in ([lang] * len(found), found, [source] * len(found))]
            numbers = [pa.array(x, pa.int64()) for x in (list(counts.values()), docs)]
            yield pa.record_batch(texts + numbers, names=["lang", "term", "source", "n", "df"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stripes: defaultdict[str, _Stripes] = defaultdict(_Stripes)
    cells = 0
    for batch in batches:
        for text, lang, source in zip(*(c.to_pylist() for c in batch.columns)):
            cells += stripes[lang].fold(source, terms(text))
            if cells >= SPILL_CELLS:
                for code, of in stripes.items():
                    yield from of.rows(code)
                stripes.clear()
                cells = 0
    for code, of in stripes.items():
        yield from of.rows(code)


def merged_stripes(docs: DataFrame) -> DataFrame:
    """(lang, term, sources, counts): one stripe per kept term of a language."""
    read = docs.select(text_of().alias("text"), text_of("lang").alias("lang"), text_of("source").alias("source"))
    cells = read.mapInArrow(_folded, CELLS)
    cells = cells.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    stripes = cells.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return stripes.filter(F.col("df") >= LEAST_DOCS).select(
        "lang", "term", F.col("cells.source").alias("sources"), F.col("cells.n").alias("counts")
    )


def _smoothed(counts: np.ndarray, total, v: int) -> np.ndarray:
    return 1 + SCALE * (counts + 1) // (total + v)


def _divergences(key: tuple, stripes: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
    """Of one slice: partial sums of every pair of sources, and the best terms of each source."""
    lang, v = key[0], int(totals["v"].iloc[0]) if len(totals) else 0
    sources = totals["source"].tolist()
    place = {s: i for i, s in enumerate(sources)}
    k, width = len(stripes), len(sources)
    whole = int(totals["total"].sum())
    # SCALE * (count + 1) must fit into 63 bits; beyond, Python's numbers are exact
    kind = np.int64 if SCALE * (whole + 1) < 2**63 else object
    counts = np.zeros((k, width), kind)
    if k:
        at_term = np.repeat(np.arange(k), [len(x) for x in stripes["sources"]])
        at_source = np.array([place[s] for x in stripes["sources"] for s in x])
        counts[at_term, at_source] = np.concatenate([np.asarray(x) for x in stripes["counts"]]).astype(kind)
    names = stripes["term"].to_numpy(object)
    octets = np.array([t.encode("utf-8", "surrogatepass") for t in names], object)
    total = np.array(totals["total"].tolist(), kind)
    sums = np.zeros((width, width), kind)
    tops: list[list[tuple]] = [[] for _ in sources]
    for at in range(0, k, BLOCK):
        c = counts[at : at + BLOCK]
        p = _smoothed(c, total[None, :], v)
        q = _smoothed(c.sum(axis=1), whole, v)[:, None]
        for a in range(width):
            gap = p[:, a : a + 1] - p
            sums[a] += (gap * gap // p).sum(axis=0)
        gain = (p - q) * (p - q) // q
        for i, a in zip(*np.nonzero((c > 0) & (p > q))):
            tops[a].append((-int(gain[i, a]), octets[at + i], at + i))
    out = [
        ("pair", sources[a], sources[b], int(sums[a, b])) for a in range(width) for b in range(width) if a != b
    ]
    for a, found in enumerate(tops):
        out.extend(("term", sources[a], names[i], -value) for value, _, i in sorted(found)[:TOP])
    frame = pd.DataFrame(out, columns=["part", "source", "item", "value"]).astype({"value": np.int64})
    frame.insert(0, "lang", pd.Series(lang, frame.index, object))
    return frame


def source_divergence(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows of parts ``pair`` and ``term``: lang, source, part, item, value, rank."""
    stripes = pinned(spark, merged_stripes(docs), "stripes")
    groups = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct()
    sums = (
        stripes.select("lang", F.inline(F.arrays_zip("sources", "counts")))
        .groupBy("lang", F.col("sources").alias("source")).agg(F.sum("counts").alias("total"))
    )
    kept = stripes.groupBy("lang").agg(F.count("*").alias("v"))
    slices = F.greatest(F.ceil(F.coalesce("v", F.lit(0)) / SLICE), F.lit(1)).alias("slices")
    totals = (
        groups.join(sums, ["lang", "source"], "left").join(kept, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), slices)
    )
    totals = pinned(spark, totals, "stripe-totals")
    per_slice = totals.withColumn("slice", F.explode(F.sequence(F.lit(1), F.col("slices"))))
    spread = totals.groupBy("lang").agg(F.max("slices").alias("spread"))
    dealt = stripes.join(spread, "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.col("spread")) + 1).drop("spread")
    found = dealt.groupBy("lang", "slice").cogroup(per_slice.groupBy("lang", "slice")).applyInPandas(
        _divergences, "lang string, part string, source string, item string, value long"
    )
    found = pinned(spark, found, "stripe-parts")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = found.filter("part = 'term'").select("lang", "source", "part", "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order).alias("rank")
    top = best.select("*", rank).filter(F.col("rank") <= TOP)
    return pairs.select("*", rank).unionByName(top).select("lang", "source", "part", "item", "value", "rank")


ORACLE_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts
  FROM documents
),
hits AS (
  SELECT d, lang, source,
    translate(unnest(ts), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
),
kept AS (SELECT lang, term FROM hits GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST_DOCS}),
cells AS (
  SELECT h.lang, h.source, h.term, count(*)::HUGEINT AS c FROM hits h JOIN kept USING (lang, term) GROUP BY ALL
),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
totals AS (
  SELECT g.lang, g.source, coalesce(any_value(v), 0) AS v, coalesce(sum(c), 0)::HUGEINT AS total
  FROM groups g LEFT JOIN sizes USING (lang) LEFT JOIN cells x ON x.lang = g.lang AND x.source = g.source
  GROUP BY g.lang, g.source
),
grid AS (
  SELECT t.lang, t.source, k.term, coalesce(x.c, 0) AS c, 1 + {SCALE} * (coalesce(x.c, 0) + 1) // (t.total + t.v) AS p
  FROM totals t JOIN kept k USING (lang) LEFT JOIN cells x ON x.lang = t.lang AND x.source = t.source AND x.term = k.term
),
whole AS (
  SELECT lang, term, 1 + {SCALE} * (c + 1) // (total + v) AS q
  FROM (SELECT lang, term, sum(c)::HUGEINT AS c FROM cells GROUP BY lang, term)
  JOIN (SELECT lang, sum(total)::HUGEINT AS total, any_value(v) AS v FROM totals GROUP BY lang) USING (lang)
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM grid x JOIN grid y USING (lang, term)
      WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
),
terms AS (
  SELECT g.lang, g.source, 'term' AS part, g.term AS item, (g.p - q) * (g.p - q) // q AS value
  FROM grid g JOIN whole USING (lang, term) WHERE g.c > 0 AND g.p > q
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
