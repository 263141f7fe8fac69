"""Toxicity: a convolutional text classifier trained in numpy, scored where the texts are.

Method: a word's vector is the mean of the hashed vectors of the word, its first four and five bytes
and its last four, so that inflected forms share a vector.
Filters of widths 1, 2 and 3 run over the word vectors, each keeps its maximum over the whole text,
and a logistic layer gives the score. Per-language thresholds are fitted on rows kept out of the
training and folded into the score, so that 0.5 is the threshold in every language. The language is
guessed from function words of the text itself; lang, source, ids and labels are never inputs.

Every labelled row outside the held-out fold is learnt from, where it is. Letter groups are counted by the
tasks and added up by bucket. The rows are dealt by hash into shards of about ``SHARD_ROWS``; in each round every shard
goes on from the same model with all its rows, and the shards' changes are averaged by bucket, weighted by their rows.
One row in ten is kept out of the rounds and sets the thresholds, by counts of the scores in steps of 1 / ``STEPS``.
The driver holds the model (about 4 MB, as much again for the step sizes) and these counts, whatever the data; the
model goes to the tasks, which score whole texts.

Cases: null and empty texts have the score of a text without any word. Labels that are null, or whose
document is missing, are ignored; a document labelled twice counts as toxic if any label says so.
Without labelled rows of both classes every score is the share of toxic labels.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesync.llm.common import text_of
from tidesync.operators.sizing import fits_broadcast, hinted, measure

# Folds of the contract.
FOLDS = 5
#: Rows that one task learns from in a round, about; rounds where there are several such shards; least row visits of one shard.
SHARD_ROWS = 4000
ROUNDS = 3
LEAST_VISITS = 9600
BATCH, RATE = 32, 0.1
#: Words of a batch, about; a batch of long texts has fewer rows.
BATCH_WORDS = 200_000
#: Steps of the counted logits, and where they are cut (the score is 0 or 1 to 13 digits there).
STEPS, FARTHEST = 100, 30.0
#: Fixed point in which the shards' changes are added, so that the sum does not depend on the order.
UNIT = 1 << 24

BUCKETS = 1 << 17
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Letter groups of fewer labelled documents have no vector, so no text is judged by words seen once.
LEAST_DOCUMENTS = 4
#: Words whose projections a task keeps at hand; beyond, it starts anew.
VOCABULARY = 200_000

# Function words that tell the language of a text.
LANGUAGES = {
    "en": "the of and to in is that for it with was this".split(),
    "de": "der die und das ist nicht ein zu den mit von auf".split(),
    "fr": "le la les et des est du une dans que pour sur".split(),
    "es": "el los y las por con del una para se en es".split(),
}
_MARKS: dict[str, list[int]] = {}
for _n, _words in enumerate(LANGUAGES.values()):
    for _w in _words:
        _MARKS.setdefault(_w, []).append(_n)
_OFFSETS = [(k, j) for k in range(len(WIDTHS)) for j in range(WIDTHS[k])]
_LETTERS = re.compile(r"[^\W\d_]+")


def word_grams(word: str) -> tuple[int, int, int, int]:
    """Buckets of a word: its letters, the first four bytes, the first five, the last four."""
    plain = word.lower().strip(".,;:!?%&*#$'\"()")
    if not plain.isalpha():
        plain = "".join(_LETTERS.findall(plain))
        if not plain:
            return (0, 0, 0, 0)
    b = plain.encode("utf-8", "surrogatepass")
    crc, n = zlib.crc32, BUCKETS - 1
    return (1 + crc(b) % n, 1 + crc(b[:4], 1) % n, 1 + crc(b[:5], 2) % n, 1 + crc(b[-4:], 3) % n)


@dataclass
class Model:
    embedding: np.ndarray
    filters: np.ndarray  # (offsets, DIM, FILTERS)
    bias: np.ndarray  # (widths, FILTERS)
    out: np.ndarray  # (widths * FILTERS,)
    out_bias: float
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES) + 1))
    constant: float | None = None


class Words(dict):
    """Word to row number; rows hold the word's projections by every filter column and its language marks."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.pending = model, []
        self.size = 0
        self.rows = np.zeros((len(_OFFSETS), VOCABULARY, FILTERS), np.float32)
        self.marks = np.zeros((VOCABULARY, len(LANGUAGES)), np.float32)

    def __missing__(self, word: str) -> int:
        n = self[word] = self.size + len(self.pending)
        self.pending.append(word)
        return n

    def numbers(self, words: list[str]) -> np.ndarray:
        if self.size + len(words) > VOCABULARY:
            self.clear()
            self.size = 0
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.pending:
            grams = np.array([word_grams(w) for w in self.pending])
            vectors = self.model.embedding[grams].mean(axis=1)
            here = slice(self.size, self.size + len(grams))
            for o in range(len(_OFFSETS)):
                self.rows[o, here] = vectors @ self.model.filters[o]
            for i, w in enumerate(self.pending):
                lang = _MARKS.get(w.lower())
                if lang:
                    self.marks[self.size + i, lang] = 1
                else:
                    self.marks[self.size + i] = 0
            self.size += len(grams)
            self.pending = []
        return ids


def pooled(projections: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum of each filter over the text, and where it stands. ``projections``: (words, offsets, FILTERS)."""
    best, place, o = [], [], 0
    for k, width in enumerate(WIDTHS):
        n = len(projections) - width + 1
        if n <= 0:
            best.append(np.full(FILTERS, -bias[k]))
            place.append(np.full(FILTERS, -1))
        else:
            total = projections[:n, o].copy()
            for j in range(1, width):
                total += projections[j : n + j, o + j]
            at = total.argmax(axis=0)
            best.append(total[at, np.arange(FILTERS)])
            place.append(at)
        o += width
    return np.maximum(np.stack(best) + bias, 0).ravel(), np.stack(place).ravel()


def maxima(words: Words, ids: np.ndarray) -> np.ndarray:
    """What ``pooled`` gives for known words, without the places."""
    best, o = [], 0
    for k, width in enumerate(WIDTHS):
        n = len(ids) - width + 1
        if n <= 0:
            best.append(np.full(FILTERS, -words.model.bias[k]))
        else:
            total = words.rows[o].take(ids[:n], axis=0)
            for j in range(1, width):
                total += words.rows[o + j].take(ids[j : n + j], axis=0)
            best.append(total.max(axis=0))
        o += width
    return np.maximum(np.stack(best) + words.model.bias, 0).ravel()


#: Words scored at a time; pieces overlap, and the maximum over the pieces is the maximum over the text.
PIECE = 20_000


def raw_score(words: Words, text: str) -> tuple[float, int]:
    """Logit and guessed language of a whole text."""
    m = words.model
    parts = text.split()
    features, marks = np.zeros(len(WIDTHS) * FILTERS), np.zeros(len(LANGUAGES))
    for i in range(0, len(parts), PIECE):
        ids = words.numbers(parts[i : i + PIECE + WIDTHS[-1] - 1])
        features = np.maximum(features, maxima(words, ids))
        marks += words.marks.take(ids, axis=0).sum(axis=0)
    lang = int(marks.argmax()) if marks.any() else len(LANGUAGES)
    return float(features @ m.out + m.out_bias), lang


class Grams(dict):
    """Word to row number; rows hold the buckets of the word."""

    def __init__(self):
        super().__init__()
        self.rows = np.zeros((VOCABULARY, 4), np.int32)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        if n >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n] = word_grams(word)
        return n

    def buckets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the distinct words of a text, and for each word of the text the number of its distinct word."""
        if len(self) > VOCABULARY:
            self.clear()
        used, local = np.unique(np.fromiter(map(self.__getitem__, text.split()), np.int64), return_inverse=True)
        return self.rows[used], local.astype(np.int32)


PREPARED = "shard long, pass int, check boolean, y int, text string, buckets binary, ids binary"


def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with the buckets of their words as bytes; only the rows that set the thresholds keep their text."""
    grams = Grams()
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.iloc[at : at + 1000]
            found = [grams.buckets(t) for t in part["text"]]
            yield part.assign(
                text=part["text"].where(part["check"], ""), buckets=[f[0].tobytes() for f in found], ids=[f[1].tobytes() for f in found],
            )[["shard", "pass", "check", "y", "text", "buckets", "ids"]]


def buckets_of(prepared: bytes) -> np.ndarray:
    return np.frombuffer(prepared, np.int32).reshape(-1, 4)


COUNTED = "bucket int, seen long, toxic long"


def count_letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows and toxic rows by bucket, of the rows of a task."""
    seen, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for prepared, label in zip(batch["buckets"], batch["y"]):
            here = np.unique(buckets_of(prepared))
            seen[here] += 1
            toxic[here] += label
    found = np.flatnonzero(seen)
    yield pd.DataFrame({"bucket": found.astype(np.int32), "seen": seen[found], "toxic": toxic[found]})


def start(seen: np.ndarray, toxic: np.ndarray, n_toxic: int, n_clean: int, seed: int = 5) -> Model:
    """The model before the first round: random filters, and vectors that begin with the log-odds of a letter group."""
    rng = np.random.RandomState(seed)
    model = Model(
        rng.normal(0, 0.2, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.3, (len(_OFFSETS), DIM, FILTERS)).astype(np.float32),
        np.zeros((len(WIDTHS), FILTERS), np.float32), rng.normal(0, 0.1, len(WIDTHS) * FILTERS), 0.0,
    )
    # the first dimension holds the log-odds, and every filter listens to it
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((seen - toxic + 0.5) / (n_clean + 1))
    model.embedding[:, 0] = np.clip(odds / 2, -2, 2)
    model.filters[:, 0, :] = np.abs(model.filters[:, 0, :]) + 0.5
    model.out = np.abs(model.out)
    model.embedding[seen < LEAST_DOCUMENTS] = 0
    model.embedding[0] = 0
    return model


DENSE = ("filters", "bias", "out", "out_bias")


def packed(model: Model) -> np.ndarray:
    """All values of a model as rows of DIM numbers: the vectors by bucket, then the rest."""
    rest = np.concatenate([np.ravel(getattr(model, n)).astype(float) for n in DENSE])
    return np.concatenate([model.embedding.astype(float), np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)])


def unpacked(values: np.ndarray, like: Model) -> Model:
    rest, at, out = values[BUCKETS:].ravel(), 0, {}
    for n in DENSE:
        old = getattr(like, n)
        part = rest[at : at + np.size(old)]
        out[n] = float(part[0]) if np.ndim(old) == 0 else part.reshape(np.shape(old)).astype(old.dtype)
        at += np.size(old)
    return Model(values[:BUCKETS].astype(np.float32), **out)


_FILTER_OFFSET = np.repeat([sum(WIDTHS[:k]) for k in range(len(WIDTHS))], FILTERS)
_FILTER_WIDTH = np.repeat(WIDTHS, FILTERS)
_COLUMN = np.tile(np.arange(FILTERS), len(WIDTHS))


def pooled_text(projections: np.ndarray, ids: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``pooled`` over the words ``ids``, by pieces that overlap."""
    features, places = pooled(projections[ids[: PIECE + WIDTHS[-1] - 1]], bias)
    for i in range(PIECE, len(ids), PIECE):
        more, where = pooled(projections[ids[i : i + PIECE + WIDTHS[-1] - 1]], bias)
        places = np.where(more > features, where + i, places)
        features = np.maximum(features, more)
    return features, places


class Learner:
    """Adagrad over the rows of one shard, from a common model and its sums of squared gradients."""

    def __init__(self, model: Model, sums: Model, known: np.ndarray, weights: tuple[float, float]):
        self.begun = packed(model), packed(sums)
        self.model, self.sums = unpacked(self.begun[0], model), unpacked(self.begun[1], sums)
        self.known, self.weights = known, weights
        self.rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.n_words = self.n_rows = 0

    def add(self, buckets: np.ndarray, ids: np.ndarray, label: int) -> None:
        self.rows.append((np.where(self.known[buckets], buckets, 0), ids, label))
        self.n_words += len(ids)
        self.n_rows += 1
        if len(self.rows) >= BATCH or self.n_words >= BATCH_WORDS:
            self.learn()

    def step(self, name: str, grad, rows=...) -> None:
        if name == "out_bias":
            self.model.out_bias -= RATE * grad
            return
        sums, values = getattr(self.sums, name), getattr(self.model, name)
        sums[rows] += grad**2
        values[rows] -= RATE * grad / np.sqrt(sums[rows])

    def learn(self) -> None:
        rows, self.rows, self.n_words = self.rows, [], 0
        model = self.model
        g_fil, g_bias, g_out, g_ob = np.zeros_like(model.filters), np.zeros_like(model.bias), np.zeros_like(model.out), 0.0
        touched, shares = [], []
        for buckets, ids, label in rows:
            vectors = model.embedding[buckets].mean(axis=1)
            features, places = pooled_text(np.tensordot(vectors, model.filters, ([1], [1])), ids, model.bias)
            z = features @ model.out + model.out_bias
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * self.weights[label] / len(rows)
            g_out += d * features
            g_ob += d
            df = d * model.out * (features > 0)
            g_bias += df.reshape(g_bias.shape)
            for j in range(WIDTHS[-1]):
                live = (_FILTER_WIDTH > j) & (places >= 0) & (df != 0)
                if live.any():
                    w = ids[places[live] + j]
                    o, c = _FILTER_OFFSET[live] + j, _COLUMN[live]
                    np.add.at(g_fil, (o, slice(None), c), df[live, None] * vectors[w])
                    touched.append(buckets[w].ravel())
                    share = df[live, None] * model.filters[o, :, c] / buckets.shape[1]
                    shares.append(np.repeat(share, buckets.shape[1], axis=0))
        if touched:
            which, where = np.unique(np.concatenate(touched), return_inverse=True)
            g_emb = np.zeros((len(which), DIM))
            np.add.at(g_emb, where, np.concatenate(shares))
            self.step("embedding", g_emb, which)
            model.embedding[0] = 0
        for name, grad in (("filters", g_fil), ("bias", g_bias), ("out", g_out), ("out_bias", g_ob)):
            self.step(name, grad)

    def changes(self) -> pd.DataFrame:
        """What the shard changed, in fixed point and times its rows: only places that it touched, and all dense ones."""
        if self.rows:
            self.learn()
        value, square = packed(self.model) - self.begun[0], packed(self.sums) - self.begun[1]
        place = np.flatnonzero((value != 0).any(axis=1) | (np.arange(len(value)) >= BUCKETS))
        numbers = np.rint(np.concatenate([value[place], square[place]], axis=1) * UNIT).astype(np.int64) * self.n_rows
        out = pd.DataFrame(numbers, columns=NUMBERS)
        out.insert(0, "place", place.astype(np.int32))
        out.insert(1, "n", np.int64(self.n_rows))
        return out


NUMBERS = [f"{kind}{i}" for kind in "vs" for i in range(DIM)]
CHANGED = "place int, n long, " + ", ".join(f"{c} long" for c in NUMBERS)


def learn_shards(model: Model, sums: Model, known: np.ndarray, weights: tuple[float, float]):
    """Task function: rows in the order of their shards to the changes of each shard."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learner, shard = None, None
        for batch in batches:
            for here, prepared, ids, label in zip(batch["shard"], batch["buckets"], batch["ids"], batch["y"]):
                if learner is None or here != shard:
                    if learner is not None:
                        yield learner.changes()
                    learner, shard = Learner(model, sums, known, weights), here
                learner.add(buckets_of(prepared), np.frombuffer(ids, np.int32), label)
        if learner is not None:
            yield learner.changes()

    return learn


COUNTED_SCORES = "lang int, step int, y int"


def score_steps(model: Model):
    """Task function: rows to guessed language, logit in steps, label."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(model)
        for batch in batches:
            found = [raw_score(words, t) for t in batch["text"]]
            z = np.clip(np.array([f[0] for f in found], float), -FARTHEST, FARTHEST)
            lang = np.array([f[1] for f in found], np.int32)
            yield pd.DataFrame({"lang": lang, "step": np.rint(z * STEPS).astype(np.int32), "y": batch["y"].to_numpy(np.int32)})

    return score


def train(rows: DataFrame) -> Model:
    """Fit the classifier by Adagrad on nine tenths of ``rows`` (doc_id, y, text); the rest sets the thresholds."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()
    n, n_toxic = int(total["n"]), int(total["toxic"])
    if n_toxic in (0, n):
        nothing = start(np.zeros(BUCKETS), np.zeros(BUCKETS), 0, 0)
        nothing.constant = n_toxic / n if n else 0.0
        return nothing
    shards = -(-n // SHARD_ROWS)
    passes = max(ROUNDS, -(-LEAST_VISITS // n)) if shards == 1 else 1
    drawn = F.xxhash64(F.lit("draw"), "doc_id", "text")
    dealt = (
        rows.withColumns({"check": F.pmod(F.xxhash64(F.lit("check"), "doc_id"), F.lit(10)) == 0, "shard": F.pmod(drawn, F.lit(shards))})
        .withColumn("pass", F.explode(F.when(F.col("check"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(passes - 1)))))
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "pass", F.xxhash64("pass", "doc_id", "text"), "doc_id")
        .select("shard", "pass", "check", "y", "text").mapInPandas(prepare, PREPARED)
        .persist(StorageLevel.DISK_ONLY)
    )
    try:
        counted = (
            dealt.where("pass = 0").select("buckets", "y").mapInPandas(count_letters, COUNTED)
            .groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic")).toArrow()      # at most BUCKETS rows
        )
        seen, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        where = counted["bucket"].to_numpy()
        seen[where], toxic[where] = counted["seen"].to_numpy(), counted["toxic"].to_numpy()
        model, known = start(seen, toxic, n_toxic, n - n_toxic), seen >= LEAST_DOCUMENTS
        sums = unpacked(np.full_like(packed(model), 1e-2), model)
        weights = n / (2 * (n - n_toxic)), n / (2 * n_toxic)
        for _ in range(1 if shards == 1 else ROUNDS):
            changed = (
                dealt.where("NOT check").select("shard", "buckets", "ids", "y").mapInPandas(learn_shards(model, sums, known, weights), CHANGED)
                .groupBy("place").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in NUMBERS]).toArrow()     # as many rows as the model
            )
            place, share = changed["place"].to_numpy(), changed["n"].to_numpy() * float(UNIT)
            mean = np.stack([changed[c].to_numpy() / share for c in NUMBERS], axis=1)
            values, squares = packed(model), packed(sums)
            values[place] += mean[:, :DIM]
            squares[place] += mean[:, DIM:]
            model, sums = unpacked(values, model), unpacked(squares, sums)
        scores = (
            dealt.where("check").select("text", "y").mapInPandas(score_steps(model), COUNTED_SCORES)
            .groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic")).toArrow()     # at most 6001 a language
        )
    finally:
        dealt.unpersist()
    lang, step, rows_of, toxic_of = (scores[c].to_numpy() for c in ("lang", "step", "n", "toxic"))
    overall = best_threshold(step / STEPS, rows_of, toxic_of, 0.0)
    model.shift = np.array([best_threshold(step[lang == k] / STEPS, rows_of[lang == k], toxic_of[lang == k], overall) for k in range(len(LANGUAGES) + 1)])
    return model


def best_threshold(z: np.ndarray, n: np.ndarray, toxic: np.ndarray, default: float) -> float:
    """The middle of the gap between scores with the fewest wrong rows (a clean row counts twice); ``default`` if few rows.

    ``n`` and ``toxic`` count the rows at each score; a score may come more than once."""
    if n.sum() < 20 or toxic.sum() in (0, n.sum()):
        return default
    points, at = np.unique(z, return_inverse=True)
    below_toxic = np.concatenate(([0], np.cumsum(np.bincount(at, toxic))))
    below_clean = np.concatenate(([0], np.cumsum(np.bincount(at, n - toxic))))
    middles = np.concatenate(([points[0] - 1], (points[1:] + points[:-1]) / 2, [points[-1] + 1]))
    wrong = 2 * (below_clean[-1] - below_clean) + below_toxic
    good = middles[wrong == wrong.min()]
    return float(good[np.argmin(np.abs(good - np.median(good)))])


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs`` with a usable label outside the held-out fold: doc_id, y, text."""
    usable = (
        labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold("doc_id") != 0)
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    )
    small = fits_broadcast(docs.sparkSession, measure(usable))
    return docs.select("doc_id", text_of().alias("text")).join(hinted(usable, small), "doc_id").select("doc_id", "y", "text")


def fold(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    return train(labelled_rows(docs, labels))


def score_udf(model: Model):
    """Pandas UDF: text to score."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words(model)
        for texts in batches:
            out = np.empty(len(texts))
            for i, text in enumerate(texts):
                if model.constant is not None:
                    out[i] = model.constant
                else:
                    z, lang = raw_score(words, text)
                    out[i] = 1 / (1 + np.exp(-np.clip(z - model.shift[lang], -30, 30)))
            yield pd.Series(out)

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    score = score_udf(fitted(docs, labels))
    scored = docs.select("doc_id", score(text_of()).alias("score"))
    held_out = F.coalesce(fold("doc_id") == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, all columns kept."""
    score = score_udf(fitted(docs, labels))
    return docs.withColumn("__score", score(text_of())).filter("__score < 0.5").drop("__score")
