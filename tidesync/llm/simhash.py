"""SimHash near-duplicates: tiled exact comparison with exclusive-or and bit counts.

Method:

1. A text's 3-word shingles (repeats included) vote with their XXH64: a bit of the fingerprint is 1 if
   it is set in more than half of them. Equal fingerprints are one node, so copies are never expanded.
2. The four quarters of a fingerprint have 0 to 16 bits set each; these four population counts are its
   cell. Two fingerprints within RADIUS bits have cells whose counts differ by RADIUS in sum at most, so a
   cell meets itself and 20 of its neighbours only (a stricter form of the test on the whole count,
   which alone would keep a third of all tile pairs; this one keeps about one in 60).
3. A cell is cut into tiles of about TILE fingerprints. Each pair of tiles whose cells may be close is
   one row; numpy compares all of its fingerprints (exclusive-or, then bit counts), exactly.
4. Of the links that a tile pair finds, a spanning forest leaves the task: never more than its members,
   also where thousands of fingerprints are all close to each other. Links become components.

No candidate is lost or capped. The work grows with the square of the distinct fingerprints (the method
compares exactly), divided by the number of cells.

Cases: a text with fewer than three words has its whole word sequence as only shingle; a text without
words (or null) has fingerprint zero and is linked like any other. A null id is larger than all others:
``component_id`` is null only if the component has no other. Repeated rows are rows of one component.
An empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so further columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesync.llm.common import pinned, text_of
from tidesync.llm.near_dedup import components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints of a tile, about; bounds the memory of a comparison (TILE squared bytes), drops nothing.
TILE = 1024
QUARTERS = 4
#: Population counts of a quarter: 0 to 16. There are LEVELS ** QUARTERS = 83,521 cells at most.
LEVELS = 64 // QUARTERS + 1
#: Shingles whose bits are counted at once; bounds the memory of a very long text.
CHUNK = 1 << 16

_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str) -> int:
    """Fingerprint of a whole text as an unsigned number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = min(SHINGLE, len(words))
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    spans = zip(starts[: len(words) - n + 1].tolist(), (starts[n:] - 1).tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    votes = np.zeros((8, 8), np.int64)
    for i in range(0, len(hashes), CHUNK):
        octets = hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8) + _PLACE
        seen = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256)
        votes += seen @ _BITS
    ones = (2 * votes.ravel() > len(hashes)).astype(np.uint8)
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        prints = np.array([fingerprint(t) for t in rows["text"]], np.uint64)
        yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "fp": prints.view(np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed long."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.mapInPandas(_signed, "doc_id long, fp long")


def _close(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """A spanning forest of the links of each tile pair."""
    for rows in batches:
        a, b = [], []
        for left, right, same in zip(rows["left"], rows["right"], rows["same"]):
            x, y = np.asarray(left, np.int64), np.asarray(right, np.int64)
            close = np.bitwise_count((x[:, None] ^ y[None, :]).view(np.uint64)) <= radius
            if same:
                np.fill_diagonal(close, False)
            for i, j in spanning(close):
                a.append(x[i])
                b.append(y[j])
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def spanning(close: np.ndarray) -> list[tuple[int, int]]:
    """Cells of a link matrix that join its rows and columns into the same components as all of its cells."""
    out: list[tuple[int, int]] = []
    rows = np.flatnonzero(close.any(axis=1))
    row_new, col_new = np.ones(close.shape[0], bool), np.ones(close.shape[1], bool)
    for start in rows.tolist():
        if not row_new[start]:
            continue
        row_new[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            found = np.flatnonzero(close[i] & col_new)
            col_new[found] = False
            for j in found.tolist():
                out.append((i, j))
                further = np.flatnonzero(close[:, j] & row_new)
                row_new[further] = False
                out.extend((k, j) for k in further.tolist())
                queue.extend(further.tolist())
    return out


def _neighbours(radius: int) -> list[tuple[int, ...]]:
    """Differences of two cells within ``radius``, one of each opposite two."""
    steps = product(range(-radius, radius + 1), repeat=QUARTERS)
    near = [d for d in steps if sum(map(abs, d)) <= radius]
    return [d for d in near if d >= (0,) * QUARTERS]


def close_links(spark: SparkSession, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints ``prints.fp`` as all pairs within ``radius`` do."""
    bits = 64 // QUARTERS
    counts = [F.bit_count(F.shiftrightunsigned("fp", bits * q).bitwiseAND(F.lit((1 << bits) - 1))) for q in range(QUARTERS)]
    cell = F.array(*counts)
    placed = pinned(spark, prints.select("fp", cell.alias("cell")), "simhash-cells")
    # one row per cell, so at most 83,521 rows of four small numbers: bounded whatever the input
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / TILE).alias("k"))
    tiles = (
        placed.join(F.broadcast(sizes), "cell")
        .groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("k")).alias("part"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = pinned(spark, tiles, "simhash-tiles")
    steps = F.array(*[F.array(*map(F.lit, d)) for d in _neighbours(radius)])
    left = tiles.select("part", F.col("fps").alias("left"), F.col("cell").alias("home"), F.explode(steps).alias("step"))
    left = left.withColumn("cell", F.zip_with("home", "step", lambda c, d: c + d)).filter(
        F.forall("cell", lambda c: (c >= 0) & (c < LEVELS))
    )
    right = tiles.select("cell", F.col("part").alias("other"), F.col("fps").alias("right"))
    same_cell = F.col("cell") == F.col("home")
    pairs = left.join(right, "cell").filter(~same_cell | (F.col("part") <= F.col("other")))
    pairs = pairs.select("left", "right", (same_cell & (F.col("part") == F.col("other"))).alias("same"))
    return pairs.mapInPandas(lambda batches: _close(batches, radius), "a long, b long")


def simhash_groups(spark: SparkSession, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lowercase hex digits), component_id."""
    signed = pinned(spark, fingerprints(docs), "simhash-signed")
    prints = pinned(spark, signed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-prints")
    links = pinned(spark, close_links(spark, prints, radius), "simhash-links")
    comps = components(spark, links).withColumnRenamed("cls", "fp")
    labelled = prints.join(comps, "fp", "left").select("fp", "first_id", F.coalesce("comp", "fp").alias("comp"))
    least = labelled.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    by_print = pinned(spark, labelled.join(least, "comp").select("fp", "component_id"), "simhash-labels")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return signed.join(by_print, "fp").select("doc_id", hexed, "component_id")
