"""Removal of repeated 50-byte strings across documents by sampled suffixes and induction.

What is kept of external induced sorting, and what is not: as there, only a sample of the suffixes is
sorted (by Spark's external sort), samples whose whole context is equal get one name, and the order of
the others is induced from the sample. But the sort stops at 50 bytes, as longer common prefixes never
change the result, and the disk-backed priority queues are Spark's shuffle and spill; no full suffix
array is built (16 bytes for each suffix would be about 16 times the text on disk).

Method:

1. Sample. Every string of 50 bytes picks its anchor: of its 35 substrings of 16 bytes, the one with the
   least hash, the leftmost of equal ones. Equal strings have equal anchors at equal offsets.
   Neighbouring strings mostly share an anchor: a run. A run is one row: hash of its 16 anchor bytes,
   hash of its whole context (all bytes of its strings), document. About one row per 18 bytes.
2. Sort and name. The rows meet under their anchor. A run whose whole context also occurs in a smaller
   document is removed as a whole. Anchors that only one document has are done.
3. Induce. The runs left whose anchor also has other contexts lie at the edge of a repeat. Only these
   are opened into their single strings, and only those on the sides of the anchor that another context
   shares; they meet under their hash, and a string that also starts in a smaller document is removed.

Hot passages: rows of one batch with equal anchor and context are settled in the batch, and only the one
of its smallest document is sent on, so a passage that a third of all documents share costs one row
a batch.

Cases: a null text has no bytes; texts under 50 bytes lose nothing. Matches never cross documents, and
repeats within one document do not count. A null id is larger than all others, and null ids are equal to
each other. Rows that repeat an id count as one document for the matches; each gets its own result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidesync.llm.common import pinned, text_of

LENGTH = 50
ANCHOR = 16
SPAN = LENGTH - ANCHOR + 1
#: Start positions handled at a time; bounds memory, and only splits runs.
CHUNK = 1 << 18
NO_ID = (1 << 63) - 1
PLACE_BITS = 31
#: Bits of the neighbour hashes: of the left one below the anchor hash in a key, of the right one below the
#: context hash in a code; and the bytes they cover.
SIDE_BITS = 16
SIDE = (LENGTH - ANCHOR) // 2
#: Low bits of a run's code: settled in its batch; or the sides that it shares with another context.
FLAG_BITS = 2
LEFT, RIGHT = 1, 2

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(CHUNK + 2 * LENGTH, _BASE, _U))
_INVERSE = np.cumprod(np.full(CHUNK + 2 * LENGTH, _U(pow(int(_BASE), -1, 1 << 64)), _U))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Piece:
    """Hashes over a part of a text: ``starts`` windows from ``base`` on."""

    def __init__(self, data: bytes, base: int):
        self.base = base
        self.bytes = data[base : base + CHUNK + LENGTH - 1]
        self.starts = len(self.bytes) - LENGTH + 1
        values = np.frombuffer(self.bytes, np.uint8).astype(_U) + _U(1)
        self.prefix = np.concatenate((np.zeros(1, _U), np.cumsum(values * _POWERS[: len(values)])))

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges, also by their length."""
        return _mixed((self.prefix[end] - self.prefix[begin]) * _INVERSE[begin] + (end - begin).astype(_U) * _BASE)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one anchor: first window, end of windows, anchor's place, key, code.

        The key holds the hashes of the anchor and of the bytes left of it. The code names the run within
        a document: hashes of its context and of the bytes right of the anchor, and no flags. Runs of a
        document with equal codes have equal bytes, so what holds for one holds for all.
        """
        n = len(self.bytes) - ANCHOR + 1
        low = np.ndarray((n,), "<u8", self.bytes, 0, (1,))
        high = np.ndarray((n,), "<u8", self.bytes, 8, (1,))
        grams = _mixed(low * _U(0xC2B2AE3D27D4EB4F) + _mixed(high ^ _BASE))
        least = (grams >> _U(20) << _U(20)) | np.arange(n, dtype=_U)
        width = 1
        while width * 2 <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = SPAN - width
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        anchors = (least & _U((1 << 20) - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(anchors)) + 1))
        end = np.append(first[1:], self.starts)
        anchor = anchors[first]
        context = _mixed(self.hashes(first, end + LENGTH - 1) ^ (anchor - first).astype(_U))
        left = self.hashes(np.maximum(anchor - SIDE, 0), anchor)
        right = self.hashes(anchor + ANCHOR, np.minimum(anchor + ANCHOR + SIDE, len(self.bytes)))
        key = (grams[anchor] >> _U(SIDE_BITS) << _U(SIDE_BITS)) | (left >> _U(64 - SIDE_BITS))
        low_bits = _U(SIDE_BITS + FLAG_BITS)
        code = (context >> low_bits << low_bits) | (right >> _U(64 - SIDE_BITS) << _U(FLAG_BITS))
        return first, end, anchor, key, code


def pieces(data: bytes) -> Iterator[Piece]:
    for base in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        yield Piece(data, base)


def coded(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Place (31 bits) and 33 bits of a hash in one signed 64-bit number."""
    return ((hashes >> _U(PLACE_BITS) << _U(PLACE_BITS)) | places.astype(_U)).view(np.int64)


def _ids(column: pd.Series) -> np.ndarray:
    return column.fillna(NO_ID).astype("int64").to_numpy() if column.dtype != object else np.array(
        [NO_ID if v is None else v for v in column], np.int64
    )


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _settled(keys: np.ndarray, subkeys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Rows of which the batch has a smaller document with equal keys."""
    order = np.lexsort((docs, subkeys, keys))
    k, s, d = keys[order], subkeys[order], docs[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1]))) if len(k) else np.empty(0, bool)
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(k) else d
    out = np.empty(len(k), bool)
    out[order] = d > least
    return out


def _dealt(keys: np.ndarray, settled: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Settled rows need no meeting: they are dealt by document, which also compresses well."""
    return np.where(settled, _mixed(docs.astype(_U) * _BASE), keys).view(np.int64)


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        keys, contexts, codes, docs = [], [], [], []
        for doc, text in zip(_ids(rows["doc_id"]), rows["text"]):
            for piece in pieces(_bytes(text)):
                *_, key, code = piece.runs()
                keys.append(key)
                codes.append(code)
                docs.append(np.full(len(key), doc, np.int64))
        if keys:
            k, c, d = np.concatenate(keys), np.concatenate(codes), np.concatenate(docs)
            settled = _settled(k, c, d)
            yield pd.DataFrame({"k": _dealt(k, settled, d), "code": (c | settled).view(np.int64), "doc": d})


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Single strings of the runs named by ``codes``, from the sides named by their flags.

    A string holds all bytes that SIDE covers on one side of the anchor, or on both: those that start
    at least SIDE before the anchor hold the left ones, the others, and that at SIDE, the right ones.
    """
    for rows in batches:
        keys, places, docs = [], [], []
        for doc, pressed, codes in zip(_ids(rows["doc_id"]), rows["pressed"], rows["codes"]):
            wanted = np.asarray(codes, np.int64).view(_U)
            flags = _U((1 << FLAG_BITS) - 1)
            by_left, by_right = (wanted[wanted & _U(bit) != 0] & ~flags for bit in (LEFT, RIGHT))
            for piece in pieces(zstandard.decompress(pressed)):
                first, end, anchor, _, code = piece.runs()
                left, right = np.isin(code, by_left), np.isin(code, by_right)
                begin = np.where(left, first, np.maximum(first, anchor - SIDE))
                stop = np.where(right, end, np.minimum(end, anchor - SIDE + 1))
                mine = (left | right) & (begin < stop)
                if mine.any():
                    sizes = (stop - begin)[mine]
                    at = np.repeat(begin[mine], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    keys.append(piece.hashes(at, at + LENGTH))
                    places.append(at + piece.base)
                    docs.append(np.full(len(at), doc, np.int64))
        if keys:
            k, p, d = np.concatenate(keys), np.concatenate(places), np.concatenate(docs)
            settled = _settled(k, k, d)
            yield pd.DataFrame({"k": _dealt(k, settled, d), "code": coded(k, p), "doc": d, "settled": settled})


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for pressed, runs, strings in zip(rows["pressed"], rows["runs"], rows["strings"]):
            data = zstandard.decompress(pressed)
            starts = np.zeros(len(data) + 1, np.int32)
            if runs is not None or strings is not None:
                whole = np.asarray([] if runs is None else runs, np.int64).view(_U)
                single = np.asarray([] if strings is None else strings, np.int64)
                for piece in pieces(data):
                    first, end, *_, code = piece.runs()
                    mine = np.isin(code, whole)
                    for a, b in zip(first[mine] + piece.base, end[mine] + piece.base):
                        starts[a] += 1
                        starts[b + LENGTH - 1] -= 1
                    at = (single & ((1 << PLACE_BITS) - 1)) - piece.base
                    inside = (at >= 0) & (at < piece.starts)
                    at = at[inside]
                    right = coded(piece.hashes(at, at + LENGTH), at + piece.base) == single[inside]
                    np.add.at(starts, at[right] + piece.base, 1)
                    np.add.at(starts, at[right] + piece.base + LENGTH, -1)
            gone = np.cumsum(starts[:-1]) > 0
            spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
            rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace")))
        frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])
        frame.insert(0, "doc_id", rows["doc_id"].to_numpy())
        yield frame


def _zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts compressed for the shuffle that brings them their lists."""
    press = zstandard.ZstdCompressor(level=3)
    for rows in batches:
        yield pd.DataFrame({"doc_id": rows["doc_id"], "pressed": [press.compress(_bytes(t)) for t in rows["text"]]})


def settle_runs(rows: DataFrame) -> DataFrame:
    """(doc, code, whole): runs to remove as a whole, and runs to open, with the sides to open in their code.

    A string of a run that also occurs elsewhere shares, beside the anchor, the SIDE bytes left or
    right of it; runs that share neither with another context are not opened.
    """
    side_mask, flag_mask = F.lit((1 << SIDE_BITS) - 1), F.lit((1 << FLAG_BITS) - 1)
    plain = F.shiftleft(F.shiftright("code", FLAG_BITS), FLAG_BITS)
    by_anchor = Window.partitionBy("anchor")
    judged = (
        rows.select(F.shiftright("k", SIDE_BITS).alias("anchor"), F.col("k").bitwiseAND(side_mask).alias("left"),
                    F.shiftright("code", FLAG_BITS).bitwiseAND(side_mask).alias("right"),
                    plain.alias("code"), "doc", (F.col("code").bitwiseAND(flag_mask) != 0).alias("settled"))
        .repartition("anchor")
        .withColumn("owner", F.min("doc").over(Window.partitionBy("anchor", "code")))
        .withColumn("least", F.min("doc").over(by_anchor)).withColumn("most", F.max("doc").over(by_anchor))
        .withColumn("c0", F.min("code").over(by_anchor)).withColumn("c1", F.max("code").over(by_anchor))
        .withColumn("whole", F.col("settled") | (F.col("owner") < F.col("doc")))
        .filter("whole OR (least < most AND c0 < c1)")
    )
    shared = F.lit(0).cast("long")
    for side, bit in (("left", LEFT), ("right", RIGHT)):
        by_side = Window.partitionBy("anchor", side)
        judged = judged.withColumn(f"{side}_shared", F.min("code").over(by_side) < F.max("code").over(by_side))
        shared = shared.bitwiseOR(F.when(F.col(f"{side}_shared") & ~F.col("whole"), F.lit(bit)).otherwise(F.lit(0)))
    opened = judged.filter("whole OR left_shared OR right_shared")
    return opened.select("doc", F.col("code").bitwiseOR(shared).alias("code"), "whole")


def settle_strings(rows: DataFrame) -> DataFrame:
    """(doc, code) of the strings that also start in a smaller document."""
    owned = rows.repartition("k").withColumn("owner", F.min("doc").over(Window.partitionBy("k")))
    return owned.filter(F.col("settled") | (F.col("owner") < F.col("doc"))).select("doc", "code")


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    number = F.coalesce("doc_id", F.lit(NO_ID))
    schema = "k long, code long, doc long"
    pressed = texts.mapInPandas(_zipped, "doc_id long, pressed binary")
    runs = pinned(spark, settle_runs(texts.mapInPandas(_sampled, schema)), "repeat-runs")
    edges = runs.filter("NOT whole").groupBy("doc").agg(F.collect_set("code").alias("codes"))
    edges = pinned(spark, edges, "repeat-edges")
    to_open = pressed.join(edges, number == F.col("doc")).select("doc_id", "pressed", "codes")
    strings = pinned(spark, settle_strings(to_open.mapInPandas(_opened, schema + ", settled boolean")), "repeat-strings")
    marks = (
        runs.filter("whole").select("doc", F.col("code").alias("run"), F.lit(None).cast("long").alias("string"))
        .unionByName(strings.select("doc", F.lit(None).cast("long").alias("run"), F.col("code").alias("string")))
    )
    lists = marks.groupBy("doc").agg(F.collect_set("run").alias("runs"), F.collect_set("string").alias("strings"))
    lists = pinned(spark, lists, "repeat-lists")
    joined = pressed.join(lists, number == F.col("doc"), "left").select("doc_id", "pressed", "runs", "strings")
    return joined.mapInPandas(
        _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    )
