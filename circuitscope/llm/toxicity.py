"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import held_out, keep_rows
from .words import IN_LETTERS, Texts, Words, find_words, hash_words, slices

#: About so many labelled documents (picked by hash of their id) train the model.
TRAIN_DOCS = 40_000
#: Of these, this share estimates the log-odds; the rest fits the calibration on words it has not seen.
LEXICON_SHARE = 0.7
#: Weight of the Dirichlet prior, as a share of the counted words; its means are the words' overall shares.
PRIOR = 0.1
#: Tokens are words and the first bytes of longer words, which speak for a word that was not learned itself.
PREFIX = 4
#: A token counts if its log-odds lie MIN_Z standard deviations from 0, with SHRINK of them taken off; others are neutral.
MIN_Z, SHRINK = 3.0, 1.5
#: What every word costs beside its log-odds, so that a segment of neutral words loses: of these, what explains the
#: calibration part best. Log-odds are limited to +-CAP.
DRIFTS, CAP = (0.4, 1.0, 1.8), 8.0
#: Passages with at most this many chance equals expected in a text of this length are significant.
MAX_EXPECTED = 0.05
#: Documents with this probability or more are toxic.
THRESHOLD = 0.3


@dataclass
class Model:
    """Sorted token hashes with their scores; the extreme-value parameters; weights of the calibration."""

    hashes: np.ndarray
    scores: np.ndarray
    rate: float = 1.0
    scale: float = 1.0
    weights: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0]))
    drift: float = DRIFTS[0]


def token_hashes(texts: Texts, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each word's hash, and the hash of its prefix (its own hash again where it has no letter more)."""
    whole = hash_words(texts, words)
    cut = np.minimum(words.ends, words.starts + PREFIX)
    prefix = hash_words(texts, Words(words.starts, cut, words.text, words.counts)) ^ np.uint64(1)
    return whole, np.where(words.ends > cut, prefix, whole)


def maximal_segments(at: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a text, in linear time.

    ``at`` has the places of words that score above 0, in order, and ``scores`` every word's score.
    Each segment is disjoint from the others and no longer or shorter one about it scores more.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float]] = []  # first, last, total before it, total with it
    for i in at:
        first, last, low, high = int(i), int(i), float(sums[i]), float(sums[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= high:
                stack.append((first, last, low, high))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(f, e, high - low) for f, e, low, high in stack]


def passage_features(segments: list[tuple[int, int, float]], n_words: int, model: Model) -> tuple[float, float, list]:
    """Best score, evidence of the best by extreme-value statistics, and the significant passages.

    Chance gives about scale * n_words * exp(-rate * score) segments of a score or more.
    """
    if not segments:
        return 0.0, 0.0, []
    size = math.log(max(model.scale * n_words, 1e-9))
    rated = [(f, e, s, math.exp(min(50.0, size - model.rate * s))) for f, e, s in segments]
    best = max(s for _, _, s, _ in rated)
    # for each passage -log10 of the chance that n_words neutral words hold such a segment
    evidence = sum(-math.log10(max(-math.expm1(-x), 1e-12)) for *_, x in rated)
    return best, min(evidence, 100.0), [r for r in rated if r[3] <= MAX_EXPECTED]


def _segments(column: pa.Array, model: Model) -> Iterator[tuple[int, list[tuple[int, list[tuple[int, int, float]]]]]]:
    """(index of the first text, [(words, maximal segments)]) for whole texts."""
    for first, texts in slices(column, lower=True):
        words = find_words(texts, IN_LETTERS)
        scores = np.full(len(words.starts), -model.drift)
        if len(model.hashes) and len(scores):
            unseen = np.ones(len(scores), bool)
            for hashes in token_hashes(texts, words):  # a word's own score stands before its prefix's
                place = np.minimum(np.searchsorted(model.hashes, hashes), len(model.hashes) - 1)
                hit = unseen & (model.hashes[place] == hashes)
                scores[hit] += model.scores[place[hit]]
                unseen &= ~hit
        ends = np.cumsum(words.counts)
        above = np.flatnonzero(scores > 0)
        parts = np.searchsorted(above, np.concatenate([[0], ends]))
        rows = []
        for i, n in enumerate(words.counts):
            begin = int(ends[i] - n)
            at = above[parts[i]:parts[i + 1]] - begin
            rows.append((int(n), maximal_segments(at, scores[begin:begin + n]) if len(at) else []))
        yield first, rows


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int) -> DataFrame:
    """(text, toxic, fold): about ``limit`` labelled documents that are not held out."""
    known = (labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__toxic"))
             .where("__id is not null and __toxic in (0, 1)").where(~held_out(F.col("__id")))
             .groupBy("__id").agg(F.max("__toxic").alias("__toxic")))
    draw = F.pmod(F.xxhash64("__id"), F.lit(1 << 30))
    total = known.count()
    picked = known.where(draw < min(1.0, limit / max(total, 1)) * (1 << 30))
    fold = F.pmod(F.xxhash64("__id", F.lit("fold")), F.lit(100)) < 100 * LEXICON_SHARE
    return (docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
            .join(F.broadcast(picked), "__id")  # about ``limit`` rows of two numbers
            .select("__text", "__toxic", fold.alias("__fold")))


def _lexicon(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes and log-odds of the words that differ significantly, and the neutral share of clean words.

    Documents, not places, are counted, so a word repeated in one document counts once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for first, texts in slices(batch.column(0), lower=True):
                words = find_words(texts, IN_LETTERS)
                text, tokens = np.tile(words.text, 2), np.concatenate(token_hashes(texts, words))
                order = np.lexsort((tokens, text))
                text, tokens = text[order], tokens[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (tokens[1:] != tokens[:-1])
                hashes, place = np.unique(tokens[new], return_inverse=True)
                bad = toxic[first + text[new]] == 1
                y = np.bincount(place, bad, len(hashes)).astype("i8")
                n = np.bincount(place, minlength=len(hashes))
                yield pa.record_batch([pa.array(hashes.view("i8")), pa.array(y), pa.array(n - y)], ["h", "y1", "y0"])

    counts = (rows.where("__fold").select("__text", "__toxic").mapInArrow(run, "h long, y1 long, y0 long")
              .groupBy("h").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")))
    n1, n0 = counts.agg(F.coalesce(F.sum("y1"), F.lit(0)), F.coalesce(F.sum("y0"), F.lit(0))).first()
    if not n1 or not n0:
        return np.zeros(0, "u8"), np.zeros(0), 0.0
    weight = PRIOR * (n1 + n0)
    prior = F.lit(weight / (n1 + n0)) * (F.col("y1") + F.col("y0"))
    odds = lambda y, n: (y + prior) / (n + F.lit(weight) - y - prior)
    delta = F.log(odds(F.col("y1"), F.lit(n1))) - F.log(odds(F.col("y0"), F.lit(n0)))
    sd = F.sqrt(1 / (F.col("y1") + prior) + 1 / (F.col("y0") + prior))
    found = (counts.select("h", (delta - F.signum(delta) * SHRINK * sd).alias("d"), (delta / sd).alias("z"))
             .where(F.abs("z") >= MIN_Z).select("h", "d").toPandas())  # of a bounded sample's words, the significant ones
    order = np.argsort(found.h.to_numpy("i8").view("u8"))
    return found.h.to_numpy("i8").view("u8")[order], np.clip(found.d.to_numpy("f8"), -CAP, CAP)[order], float(n0)


def _rate(scores: np.ndarray, chances: np.ndarray) -> float:
    """The positive root of sum(chances * exp(rate * score)) = 1 (Karlin and Altschul)."""
    if not (scores > 0).any() or float(scores @ chances) >= 0:
        return 1.0
    total = lambda x: float(chances @ np.exp(np.minimum(x * scores, 700.0))) - 1
    low, high = 0.0, 1.0
    while total(high) < 0 and high < 100:
        high *= 2
    for _ in range(60):
        low, high = ((low + high) / 2, high) if total((low + high) / 2) < 0 else (low, (low + high) / 2)
    return high


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on standardized features with a slight ridge: Newton's steps, halved until the loss falls, so that
    classes that can be told apart entirely don't throw the weights about. Returns the weights and the loss."""
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    ridge = np.array([0.01, *[1.0] * x.shape[1]])
    loss = lambda w: float(np.sum(np.logaddexp(0, z @ w) - y * (z @ w)) + 0.5 * ridge @ (w * w))
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        size, now = 1.0, loss(w)
        while size > 1e-6 and not loss(w + size * step) <= now:
            size /= 2
        w = w + size * step
        if abs(size * step).max() < 1e-7 or size <= 1e-6:
            break
    return np.array([w[0] - np.sum(w[1:] * mean / sd), *(w[1:] / sd)]), loss(w)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          train_docs: int = TRAIN_DOCS) -> Model:
    """Fit word log-odds, extreme-value parameters and calibration on about ``train_docs`` labelled documents.

    The driver gets the significant tokens and the segments' scores of the calibration part's documents.
    """
    rows = _labelled(docs, labels, id_col, text_col, label_col, train_docs)
    hashes, deltas, _ = _lexicon(rows)
    models = [Model(hashes, deltas, drift=drift) for drift in DRIFTS]
    send = docs.sparkSession.sparkContext.broadcast(models)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for together in zip(*[_segments(batch.column(0), model) for model in send.value]):
                first, found = together[0]
                columns = [pa.array([[s for _, _, s in x] for _, x in part], pa.list_(pa.float64())) for _, part in together]
                yield pa.record_batch([pa.array([n for n, _ in found], pa.int64()), batch.column(1).slice(first, len(found)), *columns],
                                      ["n", "y", *[f"s{k}" for k in range(len(columns))]])

    kinds = ", ".join(f"s{k} array<double>" for k in range(len(models)))
    part = rows.where("not __fold").select("__text", "__toxic").mapInArrow(features, f"n long, y int, {kinds}").toPandas()
    if not len(part) or part.y.nunique() < 2:
        share = (part.y.sum() + 0.5) / (len(part) + 5)
        models[0].weights = np.array([math.log(share / (1 - share)), 1.0 if len(hashes) else 0.0, 0.0])
        return models[0]
    losses = [_fit(model, part.n, part[f"s{k}"], part.y.to_numpy("f8")) for k, model in enumerate(models)]
    return models[int(np.argmin(losses))]


def _fit(model: Model, n_words, segments, toxic: np.ndarray) -> float:
    """Set a model's extreme-value parameters, from clean texts, and its calibration; returns the loss."""
    clean = toxic == 0
    chance = (float(segments[clean].map(len).sum()) + 0.5) / (float(n_words[clean].sum()) + 1)  # of a clean word to start a segment
    positive = model.scores[model.scores > model.drift] - model.drift
    if len(positive):
        model.rate = _rate(np.concatenate([[-model.drift], positive]), np.concatenate([[1 - chance], np.full(len(positive), chance / len(positive))]))
    model.scale = chance
    x = np.array([passage_features([(0, 0, s) for s in found], int(n), model)[:2] for n, found in zip(n_words, segments)])
    model.weights, loss = _calibrate(x, toxic)
    return loss


def _probabilities(column: pa.Array, model: Model) -> Iterator[tuple[int, np.ndarray, list]]:
    """(index of the first text, probabilities, features and significant passages) for whole texts."""
    for first, found in _segments(column, model):
        rated = [passage_features(segments, n, model) for n, segments in found]
        x = np.array([(1.0, best, evidence) for best, evidence, _ in rated])
        yield first, 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))), rated


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score, predicted, passages.

    ``score`` is the probability of label 1; ``predicted`` is 1 from THRESHOLD up. ``passages`` has the
    significant segments: first word, number of words (runs of letters), score, expected chance
    equals. Null and empty texts have no passage and the score of a text without evidence. Repeated rows
    stay repeated; very long texts are scored whole.
    """
    send = docs.sparkSession.sparkContext.broadcast(model)
    passage = T.StructType([T.StructField("first_word", T.LongType()), T.StructField("words", T.LongType()),
                            T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())])
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
                           T.StructField("passages", T.ArrayType(passage))])
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, p, rated in _probabilities(batch.column(1), send.value):
                part = batch.slice(first, len(p))
                passages = [[{"first_word": f, "words": e - f + 1, "score": s, "expected": c} for f, e, s, c in r] for *_, r in rated]
                yield pa.record_batch([part.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype("i4")), pa.array(passages, kind)], schema.names)

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted to be toxic. Nothing is shuffled."""
    send = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text_col, lambda column: np.concatenate([p < THRESHOLD for _, p, _ in _probabilities(column, send.value)]))


def predict(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Train on the labelled rows and score every document; held_out marks the quarter not learned from."""
    return score(docs, train(docs, labels, id_col, text_col, label_col), id_col, text_col).withColumn(
        "held_out", F.coalesce(held_out(F.col(id_col)), F.lit(False)))
