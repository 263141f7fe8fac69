"""Near-duplicate groups: MinHash by one-permutation hashing with optimal densification.

Method:

1. A text's set is its distinct 5-word shingles (64-bit hashes). Equal sets are one class, named by a
   64-bit digest of the set; only the smallest id of a class goes on, so copies are never expanded.
2. One permutation splits the hash range into BINS bins; the minimum of each bin is its sketch
   value. An empty bin borrows from the non-empty bin that comes first in the bin's own fixed random
   order (optimal densification), so a match stays as likely as the similarity also for short texts.
3. BANDS bands of ROWS values make the buckets. A pair at similarity 0.75 shares a bucket with
   probability 1 - (1 - 0.75^4)^40 > 0.9999997.
4. Each bucket gives a star: every member and the smallest one. Stars are linear in the members. They
   are confirmed on full sets and joined to components.
5. A star can miss a link between two members that are both unlike its centre. So in each bucket that
   still holds several components, members of different components are compared block by block, a pair
   only in the first band that it shares. A first pass on the sketches finds the members that may have a
   link; a second one brings their full sets into the blocks and tests them there, with a union-find per
   block: pairs that are joined already are skipped, and at most (members - 1) links leave a block. Pairs
   are never written, so a group close to the threshold costs tests, not rows. No bucket or candidate is
   capped.

Before sets are moved, a pair is dropped if the sizes of its sets rule out the threshold (exact), or if both
have SMALL shingles or more and their sketches agree in too few bins (4.5 standard deviations of slack).

Links are confirmed with ``100 * |A & B| >= 75 * |A | B|`` on the full sets. Components come from
repeated large-star and small-star steps on the confirmed links.

Cases: a text with fewer than five words has its whole word sequence as only shingle; a text without
words (or null) has an empty set, no link, and itself as component. A null id is the largest id of
its class; its component id is null if the class has no other. Repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesync.llm.common import pinned, text_of

SHINGLE = 5
BINS = 512
ROWS = 4
BANDS = 40
#: Bins whose values (16 bits) make the bands; of all bins 8 bits are kept for comparisons.
BANDED = BANDS * ROWS
THRESHOLD = 75
#: Least number of agreeing sketch values of a pair that may reach the threshold: mean 384, deviation 9.8.
LEAST_AGREE = 340
#: Largest list of pair ends (measured, in rows) that is sent to the texts; beyond, the texts are shuffled.
BROADCAST_ENDS = 500_000
#: Sets smaller than this are always tested in full: a sketch says too little about them.
SMALL = 64
#: Rows and bytes of sets of a block of the residual comparison, about; bounds memory, drops nothing.
BLOCK = 512
BLOCK_BYTES = 8 << 20
MAX_WORD_CACHE = 400_000

_BOUNDS = (np.arange(1, BINS, dtype=np.float64) * (2.0**64 / BINS)).astype(np.uint64)
_ORDER = np.argsort(np.argsort(np.random.RandomState(7).rand(BINS, BINS), axis=1), axis=1).astype(np.int16)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class _WordHashes(dict):
    """Word to 64-bit hash, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def class_of(hashes: np.ndarray) -> int:
    """Signed 64-bit digest of a set: the name of its class."""
    value = xxhash.xxh3_64_intdigest(hashes.tobytes())
    return value - (1 << 64) if value >> 63 else value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, cache: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    if len(cache) > MAX_WORD_CACHE:
        cache.clear()
    n = min(SHINGLE, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = _mixed(out + h[j : len(h) - n + 1 + j] * _ODD[j])
    return np.unique(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """BINS values of 64 bits; ``hashes`` is sorted, distinct and not empty."""
    starts = np.concatenate(([0], np.searchsorted(hashes, _BOUNDS)))
    ends = np.append(starts[1:], len(hashes))
    full = np.flatnonzero(ends > starts)
    donor = np.arange(BINS)
    empty = np.flatnonzero(ends <= starts)
    if len(empty):
        donor[empty] = full[np.argmin(_ORDER[empty[:, None], full[None, :]], axis=1)]
    return _mixed(hashes[starts[donor]])


def packed_sketch(values: np.ndarray) -> bytes:
    """16 bits of the banded values, then 8 bits of all."""
    return (values[:BANDED] >> np.uint64(48)).astype(np.uint16).tobytes() + (values >> np.uint64(40)).astype(np.uint8).tobytes()


def band_keys(values: np.ndarray) -> np.ndarray:
    """One signed 64-bit bucket key per band, seeded by the band's number."""
    v = values.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[0]
    for j in range(ROWS):
        key = _mixed(key + v[:, j] * _ODD[j])
    return key.view(np.int64)


def _signed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache = _WordHashes()
    for rows in batches:
        n, classes, keys, sketches = [], [], [], []
        for text in rows["text"]:
            s = shingle_set(text, cache)
            n.append(len(s))
            if len(s):
                values = sketch(s)
                classes.append(class_of(s))
                sketches.append(packed_sketch(values))
            else:
                classes.append(None)
                sketches.append(None)
        frame = {"row": rows["row"], "doc_id": rows["doc_id"], "n_chars": rows["text"].str.len().astype("int64")}
        yield pd.DataFrame({**frame, "n_shingles": n, "cls": pd.array(classes, "Int64"), "sketch": sketches})


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The set of one end of a pair. Rows whose id repeats with another text are left out by their class."""
    cache = _WordHashes()
    for rows in batches:
        out, last = [], (None, None)
        for cls, text in zip(rows["cls"], rows["text"]):
            if last[0] != text:
                s = shingle_set(text, cache)
                last = (text, (class_of(s), s.tobytes()) if len(s) else (None, None))
            out.append(last[1][1] if last[1][0] == cls else None)
        yield pd.DataFrame({"a": rows["a"], "b": rows["b"], "hashes": out}).dropna(subset=["hashes"])


def _confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        good = np.zeros(len(rows), bool)
        for i, (a, b) in enumerate(zip(rows["ha"], rows["hb"])):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            if 100 * min(len(x), len(y)) >= THRESHOLD * max(len(x), len(y)):
                both = len(x) + len(y) - len(np.union1d(x, y))
                good[i] = _similar(both, len(x), len(y))
        yield rows.loc[good, ["a", "b"]]


def _banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for i in range(0, len(rows), 1000):
            part = rows.iloc[i : i + 1000]
            keys = [band_keys(np.frombuffer(s, np.uint16, BANDED)) for s in part["sketch"]]
            yield pd.DataFrame({"bucket": np.concatenate(keys), "cls": part["cls"].repeat(BANDS).to_numpy()})


def _similar(both: int, x: int, y: int) -> bool:
    return 100 * both >= THRESHOLD * (x + y - both)


def _likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose sketches agree enough, or of which a set is small."""
    for rows in batches:
        good = np.minimum(rows["na"], rows["nb"]).to_numpy() < SMALL
        for i in np.flatnonzero(~good):
            x, y = (np.frombuffer(rows[c].iat[i], np.uint8)[2 * BANDED :] for c in ("sa", "sb"))
            good[i] = (x == y).sum() >= LEAST_AGREE
        yield rows.loc[good, ["a", "b"]]


def likely_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not rule out."""
    a, b = (classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    sized = pairs.join(a, "a").join(b, "b").filter(100 * F.least("na", "nb") >= THRESHOLD * F.greatest("na", "nb"))
    return sized.mapInPandas(_likely, "a long, b long")


class _Block:
    """Members of one bucket: class, component, set size, sketch bins and band keys."""

    def __init__(self, rows) -> None:
        self.rows = rows
        self.cls = np.array([r["cls"] for r in rows], np.int64)
        self.comp = np.array([r["comp"] for r in rows], np.int64)
        self.n = np.array([r["n"] for r in rows], np.int64)
        whole = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), -1)
        self.bins = whole[:, 2 * BANDED :]
        self.bands = np.array([band_keys(np.frombuffer(r["sketch"], np.uint16, BANDED)) for r in rows])
        self._sets: dict[int, frozenset] = {}

    def set_of(self, i: int) -> frozenset:
        if i not in self._sets:
            self._sets[i] = frozenset(np.frombuffer(self.rows[i]["hashes"], np.uint64).tolist())
        return self._sets[i]

    def near(self, i: int, other: "_Block", bucket: int) -> np.ndarray:
        """Members of ``other`` that may be similar to ``i``, in another component, and meet first here."""
        least, most = np.minimum(other.n, self.n[i]), np.maximum(other.n, self.n[i])
        at = np.flatnonzero((other.comp != self.comp[i]) & (100 * least >= THRESHOLD * most))
        agree = (other.bins[at] == self.bins[i]).sum(axis=1)
        at = at[(agree >= LEAST_AGREE) | (least[at] < SMALL)]
        first = (other.bands[at] == self.bands[i]).argmax(axis=1)
        return at[self.bands[i][first] == bucket]


def _involved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of two blocks that may have a link to a member of another component."""
    for rows in batches:
        for bucket, left, right in zip(rows["bucket"], rows["outside"], rows["members"]):
            x, y, found = _Block(left), _Block(right), set()
            for i in range(len(left)):
                near = x.near(i, y, bucket)
                if len(near):
                    found.add(int(x.cls[i]))
                    found.update(y.cls[near].tolist())
            yield pd.DataFrame({"bucket": np.full(len(found), bucket, np.int64), "cls": np.array(list(found), np.int64)})


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between two blocks of a bucket that join components; a spanning forest of them at most."""
    for rows in batches:
        for bucket, left, right, same in zip(rows["bucket"], rows["left"], rows["right"], rows["same"]):
            x = _Block(left)
            y = x if same else _Block(right)
            parent: dict[int, int] = {}

            def find(c: int) -> int:
                while (up := parent.get(c, c)) != c:
                    parent[c] = parent.get(up, up)
                    c = up
                return c

            a, b = [], []
            for i in range(len(left)):
                for j in x.near(i, y, bucket).tolist():
                    if same and j <= i:
                        continue
                    p, q = find(int(x.comp[i])), find(int(y.comp[j]))
                    if p != q and _similar(len(x.set_of(i) & y.set_of(j)), int(x.n[i]), int(y.n[j])):
                        parent[p] = q
                        a.append(min(x.cls[i], y.cls[j]))
                        b.append(max(x.cls[i], y.cls[j]))
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sets of classes. Rows whose id repeats with another text are left out by their class."""
    cache = _WordHashes()
    for rows in batches:
        sets = [shingle_set(text, cache) for text in rows["text"]]
        good = [len(s) > 0 and class_of(s) == cls for s, cls in zip(sets, rows["cls"])]
        yield pd.DataFrame({"cls": rows["cls"], "hashes": [s.tobytes() for s in sets]})[good]


def texts_of(texts: DataFrame, ends: DataFrame) -> DataFrame:
    """``ends`` (with __id, the document of a class) and their texts. A short list goes to the texts; a longer
    one meets them in a shuffle."""
    if ends.count() <= BROADCAST_ENDS:
        ends = F.broadcast(ends)
    return texts.join(ends, F.col("doc_id").eqNullSafe(F.col("__id")))


def confirm(spark: SparkSession, texts: DataFrame, classes: DataFrame, pairs: DataFrame, purpose: str) -> DataFrame:
    """The pairs (a, b) of classes that are similar on their full sets.

    ``texts``: (doc_id, text); ``classes``: (cls, first_id, n, sketch). Both ends of a pair fetch their
    text, become sets where the text is, and meet under the pair: a set is moved once per pair.
    """
    pairs = pinned(spark, likely_pairs(pairs.distinct(), classes), f"{purpose}-pairs")
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls"), "a", "b").join(classes.select("cls", "first_id"), "cls")
    ends = pinned(spark, ends.select(F.col("first_id").alias("__id"), "cls", "a", "b"), f"{purpose}-ends")
    with_text = texts_of(texts, ends).select("a", "b", "cls", "text")
    sets = with_text.mapInPandas(_ends, "a long, b long, hashes binary")
    pair_sets = sets.groupBy("a", "b").agg(F.min("hashes").alias("ha"), F.max("hashes").alias("hb"))
    return pinned(spark, pair_sets.mapInPandas(_confirmed, "a long, b long"), f"{purpose}-links")


def components(spark: SparkSession, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(cls, comp) for every class with a link: comp is the smallest class of its component.

    Alternates large-star and small-star; the edge set shrinks to stars around the minima in a
    number of rounds logarithmic in the longest chain. Neighbour minima are plain aggregates, so a
    hub with very many neighbours costs partial sums, not one task.
    """
    edges = pinned(spark, links.filter("a != b").distinct(), "cc")
    for _ in range(max_rounds):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = pinned(spark, least, "cc-min")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = pinned(spark, large.filter("a != b").distinct(), "cc-large")
        # every edge now runs from the larger class a to the smaller class b
        low = pinned(spark, large.groupBy("a").agg(F.min("b").alias("m")), "cc-low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = pinned(spark, small.select("e.a", "e.b").filter("a != b").distinct(), "cc")
        old_keys = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        same = new.count() == edges.count() and new.join(old_keys, ["a", "b"], "left_anti").isEmpty()
        edges = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("a").alias("cls"), F.col("b").alias("comp"))
    roots = stars.select(F.col("comp").alias("cls"), "comp").distinct()
    return pinned(spark, stars.union(roots), "cc-out")


def _blocked(rows: DataFrame, number: Column, *lists: Column) -> DataFrame:
    return rows.groupBy("bucket", F.pmod(F.xxhash64("cls", "bucket"), number).alias("block")).agg(*lists)


def residual_links(spark: SparkSession, texts: DataFrame, classes: DataFrame, members: DataFrame, comps: DataFrame) -> DataFrame:
    """Links between the components of a bucket that no star has seen; enough to join what they connect."""
    comp = F.coalesce("comp", "cls").alias("comp")
    placed = members.filter("size > 2").join(comps, "cls", "left").select("bucket", "cls", comp, "size")
    placed = pinned(spark, placed, "near-placed")
    counts = placed.groupBy("bucket", "comp").agg(F.count("*").alias("count"))
    mixed = (
        counts.groupBy("bucket").agg(F.max(F.struct("count", "comp")).alias("top"), F.count("*").alias("k"))
        .filter("k > 1").select("bucket", F.col("top.comp").alias("top"))
    )
    mixed = pinned(spark, mixed, "near-mixed")
    rows = placed.join(mixed, "bucket").join(classes.select("cls", "n", "sketch"), "cls")
    rows = rows.withColumn("r", F.struct("cls", "comp", "n", "sketch"))
    outside = F.collect_list(F.when(F.col("comp") != F.col("top"), F.col("r"))).alias("outside")
    blocks = _blocked(rows, F.ceil(F.col("size") / BLOCK), F.collect_list("r").alias("members"), outside)
    blocks = pinned(spark, blocks, "near-blocks")
    tested = blocks.filter(F.size("outside") > 0).select("bucket", "outside").join(blocks.select("bucket", "members"), "bucket")
    involved = tested.select("bucket", "outside", "members").mapInPandas(_involved, "bucket long, cls long")
    involved = pinned(spark, involved.distinct(), "near-involved")
    if involved.isEmpty():
        return spark.createDataFrame([], "a long, b long")

    wanted = involved.select("cls").distinct().join(classes, "cls").select(F.col("first_id").alias("__id"), "cls")
    wanted = pinned(spark, wanted, "near-wanted")
    sets = texts_of(texts, wanted).select("cls", "text").mapInPandas(_sets, "cls long, hashes binary")
    sets = sets.groupBy("cls").agg(F.min("hashes").alias("hashes"))         # a document may be there twice
    of = classes.select("cls", "n", "sketch").join(wanted.select("cls"), "cls").join(comps, "cls", "left")
    described = of.join(sets, "cls").select("cls", F.struct("cls", F.coalesce("comp", "cls").alias("comp"), "n", "sketch", "hashes").alias("r"))
    rows = involved.join(pinned(spark, described, "near-sets"), "cls")
    load = rows.groupBy("bucket").agg(F.count("*").alias("count"), (8 * F.sum("r.n")).alias("bytes"))
    number = F.ceil(F.greatest(F.col("count") / BLOCK, F.col("bytes") / BLOCK_BYTES))
    sized = rows.join(load.select("bucket", number.alias("blocks")), "bucket")
    blocks = pinned(spark, _blocked(sized, F.col("blocks"), F.collect_list("r").alias("right")), "near-set-blocks")
    left = blocks.select("bucket", F.col("block").alias("at"), F.col("right").alias("left"))
    pairs = left.join(blocks, "bucket").filter("at <= block")
    links = pairs.select("bucket", "left", "right", F.expr("at = block").alias("same")).mapInPandas(_linked, "a long, b long")
    return pinned(spark, links.distinct(), "near-rest-links")


def labelled_rows(spark: SparkSession, docs: DataFrame, row: Column) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_chars, n_shingles, cls, comp, component_id.

    ``comp`` names the component by its smallest class; it is null, like ``cls``, for texts without words.
    """
    texts = docs.select(row.alias("row"), "doc_id", text_of().alias("text"))
    signed = pinned(
        spark,
        texts.mapInPandas(_signed_rows, "row long, doc_id long, n_chars long, n_shingles long, cls long, sketch binary"),
        "near-signed",
    )
    texts = texts.drop("row")
    classes = pinned(
        spark,
        signed.filter("cls IS NOT NULL").groupBy("cls")
        .agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")),
        "near-classes",
    )
    buckets = classes.select("cls", "sketch").mapInPandas(_banded, "bucket long, cls long")
    centres = pinned(
        spark,
        buckets.groupBy("bucket").agg(F.min("cls").alias("centre"), F.count("*").alias("size")).filter("size > 1"),
        "near-centres",
    )
    members = pinned(spark, buckets.join(centres, "bucket"), "near-members")
    stars = members.filter("cls != centre").select(F.col("centre").alias("a"), F.col("cls").alias("b"))
    links = confirm(spark, texts, classes, stars, "near-stars")
    comps = components(spark, links)
    more = residual_links(spark, texts, classes, members, comps)
    if not more.isEmpty():
        comps = components(spark, links.union(more))
    labelled = classes.select("cls", "first_id").join(comps, "cls", "left").select(
        "cls", "first_id", F.coalesce("comp", "cls").alias("comp")
    )
    least = pinned(spark, labelled.groupBy("comp").agg(F.min("first_id").alias("component_id")), "near-least")
    by_class = pinned(spark, labelled.join(least, "comp").select("cls", "comp", "component_id"), "near-labels")
    out = signed.drop("sketch").join(by_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("row", "doc_id", "n_chars", "n_shingles", "cls", "comp", component.alias("component_id"))


def near_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    out = labelled_rows(spark, docs, F.lit(0).cast("long"))
    return out.select("doc_id", "n_shingles", "component_id").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies and each text without words, all columns kept.

    Of a group the row with the smallest id stays (null ids last, then the longest text). Rows are told
    apart by a number of their own, so ids may repeat or be null; of texts without words only rows
    that repeat id and length are copies. The choice is one aggregate with partial results per task.
    """
    rows = pinned(spark, docs.withColumn("__row", F.monotonically_increasing_id()), "near-rows")
    labels = labelled_rows(spark, rows, F.col("__row"))
    wordless = F.when(F.col("cls").isNull(), F.struct("doc_id", "n_chars"))
    best = F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", (-F.col("n_chars")).alias("less"), "cls", "row"
    )
    kept = labels.groupBy("comp", wordless.alias("wordless")).agg(F.min(best).alias("best"))
    kept = pinned(spark, kept.select(F.col("best.row").alias("__row")), "near-kept")
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)
