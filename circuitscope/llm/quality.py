"""Quality rules: fixed base rules, then a hashed n-gram log-likelihood ratio against the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import materialize
from .words import IN_WORD, Texts, Words, find_words, hash_words, pair_hash, slices

#: Size of the hashed feature space: unigrams and bigrams of words. It bounds the model, whatever the corpus.
BUCKETS = 1 << 16
#: One good document in so many is left out of the target, to choose the threshold.
FOLDS = 4
#: The threshold rejects at most this share of the good documents that choose it.
MAX_LOST = 0.02
#: Scores that choose the threshold are counted in steps of this width, so that the counts of any number of documents stay few.
STEP = 1e-4
#: So many trusted ids are sent to every task; if there are more, texts are shuffled by id, once.
MAX_SENT = 1 << 20
#: Documents below this mean log ratio (nats per n-gram) are rejected if there are no labels of both kinds to choose a threshold.
MIN_SCORE = -0.1
#: Additive smoothing of the raw multinomial, and the weight, in n-grams, of the raw shares as the target's Dirichlet prior.
ALPHA, PRIOR = 1.0, float(BUCKETS)
_SYMBOL, _CODE_POINT = np.zeros(256, bool), np.ones(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CODE_POINT[128:192] = False  # all but UTF-8's continuation bytes


def ngrams(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the text of every unigram and bigram."""
    same = words.text[1:] == words.text[:-1]
    pairs = pair_hash(hashes[:-1], hashes[1:])[same]
    return ((np.concatenate([hashes, pairs]) % np.uint64(BUCKETS)).astype("i8"),
            np.concatenate([words.text, words.text[1:][same]]))


def repeated_words(texts: Texts, words: Words, hashes: np.ndarray) -> np.ndarray:
    """For each text the words in a 3-word window found twice or more in it, its first place included."""
    n = len(hashes)
    if n < 3:
        return np.zeros(len(texts), "i8")
    whole = words.text[2:] == words.text[:-2]
    window = pair_hash(pair_hash(pair_hash(hashes[:-2], hashes[1:-1]), hashes[2:]), words.text[2:].astype("u8"))
    at = np.flatnonzero(whole)
    _, place, times = np.unique(window[at], return_inverse=True, return_counts=True)
    again = at[times[place] > 1]
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[again + k] = True
    return np.bincount(words.text[covered], minlength=len(texts))


def duplicate_lines(raw: bytes) -> int:
    lines = [line for line in raw.split(b"\n") if line.strip()]  # bytes.strip knows \x20 and \x09-\x0D only
    return len(lines) - len(set(lines))


def corpus_counts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, raw, target): n-grams of all documents, and of the documents whose id is in ``trusted``.

    Each task sums its own documents into the fixed buckets, and only those sums are shuffled. ``trusted`` may hold any number of
    ids: up to MAX_SENT, which are counted, are broadcast; texts are shuffled by id only if there are more.
    """
    ids = trusted.select(F.col(id_col).alias("__id"), F.lit(True).alias("__trusted"))
    ids = F.broadcast(ids) if trusted.count() <= MAX_SENT else ids
    marked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(ids, "__id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), "i8")
        for batch in batches:
            target = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for first, texts in slices(batch.column(0)):
                words = find_words(texts)
                buckets, text = ngrams(words, hash_words(texts, words))
                sums[0] += np.bincount(buckets, minlength=BUCKETS)
                sums[1] += np.bincount(buckets[target[first + text]], minlength=BUCKETS)
        used = np.flatnonzero(sums[0])
        yield pa.record_batch([pa.array(used.astype("i4")), pa.array(sums[0][used]), pa.array(sums[1][used])],
                              ["bucket", "raw", "target"])

    partial = marked.select("__text", "__trusted").mapInArrow(run, "bucket int, raw long, target long")
    return partial.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """The log of target over raw probability of each bucket: BUCKETS numbers, on the driver.

    The target is drawn towards the raw shares by PRIOR n-grams, so what few trusted documents don't show stays near
    them and a bucket's size alone says nothing; without a trusted n-gram every ratio is 0.
    """
    sums = np.zeros((2, BUCKETS))
    for bucket, raw, target in counts.collect():  # at most BUCKETS rows
        sums[:, bucket] = raw, target
    raw = (sums[0] + ALPHA) / (sums[0].sum() + ALPHA * BUCKETS)
    target = (sums[1] + PRIOR * raw) / (sums[1].sum() + PRIOR)
    return np.log(target / raw).astype("f4")


def _labelled(labels: DataFrame, id_col: str) -> DataFrame:
    """(id, quality, counted): one row for each id, of two labels the larger; ``counted`` if its text may enter the target."""
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("quality").alias("quality"))
    return known.withColumn("counted", (F.col("quality") == 1) & (F.pmod(F.xxhash64(id_col), F.lit(FOLDS)) > 0))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ids of all rows of ``labels`` of quality 1, but for one in FOLDS by hash, which is left to :func:`judged_ids`."""
    return _labelled(labels, id_col).where("counted").select(id_col)


def judged_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, quality) of all labelled rows that :func:`trusted_ids` doesn't take."""
    return _labelled(labels, id_col).where("not counted").select(id_col, "quality")


def _cut(at: np.ndarray, good: np.ndarray, bad: np.ndarray, max_lost: float, step: float) -> float:
    """:func:`threshold` of scores in ascending order, each up to ``step`` above its ``at``, with the numbers of good and bad ones."""
    lost, passed = (good.cumsum() - good) / good.sum(), 1 - (bad.cumsum() - bad) / bad.sum()
    error = np.where(lost <= max_lost, lost + passed, np.inf)  # of the cut at each score
    k = np.flatnonzero(error == error.min())[-1]
    return float(at[k] if k == 0 else max(at[k - 1], (at[k - 1] + step + at[k]) / 2))


def threshold(good: np.ndarray, bad: np.ndarray, max_lost: float = MAX_LOST) -> float:
    """The cut of least summed error rates among those that reject at most ``max_lost`` of ``good``.

    Scores at the cut are kept. Between equally good places it takes the highest, and there the middle between the
    scores on its two sides. Without scores of both kinds it is MIN_SCORE.
    """
    if not len(good) or not len(bad):
        return MIN_SCORE
    at, place = np.unique(np.concatenate([good, bad]), return_inverse=True)
    return _cut(at, np.bincount(place[:len(good)], minlength=len(at)), np.bincount(place[len(good):], minlength=len(at)), max_lost, 0.0)


def score(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          min_score: float = MIN_SCORE) -> DataFrame:
    """One row per row of ``docs``: id, n_words, the four base counts, base_failed, score, kept.

    ``score`` is the mean log ratio of the text's n-grams (0.0 for a text without a word), so length
    does not count; ``kept`` is ``score >= min_score`` for every document that the base rules pass, with
    no random draw. Null texts have no words and fail the base rules. Repeated rows stay repeated.
    """
    send = docs.sparkSession.sparkContext.broadcast(ratios)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([docs.schema[id_col]] + [T.StructField(c, T.LongType()) for c in counts] + [
        T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = send.value
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                words = find_words(texts)
                hashes = hash_words(texts, words)
                buckets, text = ngrams(words, hashes)
                grams = np.bincount(text, minlength=len(texts))
                mean = np.bincount(text, ratio[buckets].astype("f8"), len(texts)) / np.maximum(grams, 1)
                columns = [words.counts, texts.sums((_CODE_POINT & IN_WORD)[texts.data]), texts.sums(_SYMBOL[texts.data]),
                           np.array([duplicate_lines(texts.raw(i)) for i in range(len(texts))], "i8"),
                           repeated_words(texts, words, hashes)]
                failed = (columns[0] < 50) | (100 * columns[4] > 50 * columns[0])
                yield pa.record_batch([batch.column(0).slice(first, len(texts))] + [pa.array(c, pa.int64()) for c in columns] + [
                    pa.array(failed), pa.array(mean), pa.array(~failed & (mean >= min_score))], schema.names)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def fit_threshold(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> float:
    """The threshold that all labelled documents outside the target choose, those aside that the base rules reject.

    ``scored`` is :func:`score`'s result: ids and scores meet the labels, texts don't.
    """
    judged = judged_ids(labels, id_col).select(F.col(id_col).alias("__id"), F.col("quality").alias("__quality"))
    # Rows that repeat an id are one. A mean log ratio lies within 30 of 0, so a few hundred thousand rows at most reach the driver, whatever the corpus.
    rows = scored.where("not base_failed").select(F.col(id_col).alias("__id"), "score").join(judged, "__id")
    counts = rows.groupBy("__id").agg(F.min("score").alias("score"), F.first("__quality").alias("__quality")).groupBy(
        F.floor(F.col("score") / STEP).alias("at")).agg(F.count_if(F.col("__quality") == 1).alias("good"), F.count("*").alias("all")).orderBy("at").collect()
    at, good, both = (np.array([r[k] for r in counts]) for k in range(3))
    if not len(counts) or not good.sum() or good.sum() == both.sum():
        return MIN_SCORE
    return _cut(at * STEP, good, both - good, MAX_LOST, STEP)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            min_score: float | None = None) -> DataFrame:
    """Fit the two multinomials and the threshold, unless ``min_score`` gives one, and judge every document; see :func:`score` for the rows.

    Null labels and ids count as no label; an empty table gives an empty one; other columns of either table, whatever
    their names, are ignored; texts of any length are read whole. To choose the threshold the rows are written without their texts and judged from there.
    """
    ratios = log_ratios(corpus_counts(docs, trusted_ids(labels, id_col), id_col, text_col))
    if min_score is not None:
        return score(docs, ratios, id_col, text_col, min_score)
    scored = materialize(score(docs, ratios, id_col, text_col), "scored")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= fit_threshold(scored, labels, id_col)))
