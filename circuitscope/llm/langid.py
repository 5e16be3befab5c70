"""Language identification: scripts narrow the candidates, Viterbi labels spans of mixed-language text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import held_out, keep_rows
from .words import IN_LETTERS, Texts, Words, find_words, mix, slices

#: About so many documents of each language (picked by hash of their id) train the model.
TRAIN_DOCS = 1_500
#: Hashed byte 3-grams and 4-grams of words, with a mark before and after each word.
BUCKETS = 1 << 17
#: What a change of language between two words costs, in nats.
SWITCH = 8.0
ALPHA = 0.5
#: A language uses a script that has this share of its letters; other scripts' words exclude it.
SCRIPT_SHARE = 0.02
EXCLUDED = -60.0
#: Words whose scores are held until their texts are labelled together.
HELD_WORDS = 500_000
#: Fixed values of the Unicode standard: first code point of each range, and the range's script.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"),
    (0x0B80, "Tamil"), (0x0C00, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"),
    (0xD800, "Other"), (0x20000, "Han"), (0x30000, "Other"),
]
_FIRST = np.array([first for first, _ in SCRIPTS])
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


@dataclass
class Model:
    """Learned languages, the log-probability of each bucket in each, and which scripts each uses."""

    langs: list[str]
    log_p: np.ndarray
    uses: np.ndarray


def _letter_marks() -> tuple[np.ndarray, np.ndarray]:
    """By the first two bytes of a character: whether it is no letter, and whether it stands for a word of its own."""
    other, alone = np.zeros((256, 256), bool), np.zeros((256, 256), bool)
    for block in range(0x80, 0xC0):  # U+0080 to U+00BF, but for three that are letters
        other[0xC2, block] = block not in (0xAA, 0xB5, 0xBA)
    other[0xC3, [0x97, 0xB7]] = True  # the signs of multiplication and division
    other[0xE2, 0x80:0xB0] = True  # U+2000 to U+2BFF: punctuation, signs, arrows, boxes
    other[0xE3, 0x80] = True  # U+3000 to U+303F: punctuation of East Asian scripts
    other[0xF0, 0x9F] = True  # pictures
    alone[0xE3, 0x81:0x84] = True  # kana
    alone[0xE3, 0x90:0xC0] = alone[0xE4:0xEA] = True  # Han
    alone[0xE0, 0xB8:0xBA] = True  # Thai
    return other, alone


_OTHER, _ALONE = _letter_marks()


def find_letters(texts: Texts) -> Words:
    """Runs of letters. Punctuation beyond ASCII parts words like any other; characters of scripts that are written without
    spaces are words of their own, so that a span can begin at any of them."""
    data = texts.data
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return find_words(texts, IN_LETTERS)
    padded = np.concatenate([data, np.zeros(4, "u1")])
    first, second = padded[lead], padded[lead + 1]
    length = np.where(first >= 0xF0, 4, np.where(first >= 0xE0, 3, 2))
    inside, begins = IN_LETTERS[data], np.zeros(len(data) + 5, bool)
    other = _OTHER[first, second]
    for k in range(4):
        inside[lead[other & (length > k)] + k] = False
    own = _ALONE[first, second]
    begins[lead[own]] = begins[lead[own] + length[own]] = True
    begins[texts.offsets[:-1]] = True
    begins = begins[:len(data)]
    starts = np.flatnonzero(inside & (begins | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & np.concatenate([begins[1:] | ~inside[1:], [True]])) + 1
    counts = np.diff(np.searchsorted(starts, texts.offsets))
    return Words(starts, ends, np.repeat(np.arange(len(texts)), counts), counts)


def word_grams(texts: Texts, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word of each byte 3-gram and 4-gram of the marked words."""
    if not len(words.starts):
        none = np.zeros(0, "i8")
        return none, none
    lengths = words.ends - words.starts + 2
    first = np.cumsum(lengths) - lengths
    marked = np.full(int(lengths.sum()), 0x20, "u8")
    of = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(marked)) - first[of]
    inner = (at > 0) & (at < lengths[of] - 1)
    marked[inner] = texts.data[(words.starts[of] + at - 1)[inner]]
    left = lengths[of] - at
    three = marked[:-2] | marked[1:-1] << np.uint64(8) | marked[2:] << np.uint64(16)
    four = three[:-1] | marked[3:] << np.uint64(24)
    has3, has4 = np.flatnonzero(left[:-2] >= 3), np.flatnonzero(left[:-3] >= 4)
    grams = np.concatenate([three[has3], four[has4] | np.uint64(1 << 32)])
    return (mix(grams + np.uint64(1)) % np.uint64(BUCKETS)).astype("i8"), of[np.concatenate([has3, has4])]


def word_scripts(texts: Texts, words: Words) -> np.ndarray:
    """The script that most letters of each word have."""
    n = len(SCRIPT_NAMES)
    latin = SCRIPT_NAMES.index("Latin")
    lead = np.flatnonzero(texts.data >= 0xCA)  # below lie ASCII and Latin letters
    if not len(lead) or not len(words.starts):
        return np.full(len(words.starts), latin)
    padded = np.concatenate([texts.data, np.zeros(3, "u1")]).astype("i8")
    b0, b1, b2, b3 = (padded[lead + k] for k in range(4))
    points = np.where(b0 < 0xE0, (b0 & 31) << 6 | b1 & 63, np.where(
        b0 < 0xF0, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
    of_point = _SCRIPT[np.searchsorted(_FIRST, points, "right") - 1]
    begins = (texts.data & 0xC0) != 0x80
    letters = np.concatenate([[0], np.cumsum(begins)])
    total = letters[words.ends] - letters[words.starts]
    word = np.searchsorted(words.starts, lead, "right") - 1
    inside = (word >= 0) & (lead < words.ends[np.maximum(word, 0)])
    counts = np.bincount(word[inside] * n + of_point[inside], minlength=len(total) * n).reshape(-1, n)
    counts[:, latin] += total - counts.sum(1)
    return counts.argmax(1)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from the texts and non-null languages of documents that are not held out.

    About ``train_docs`` documents of each language are taken, by a hash of their id; their bucket
    counts are summed in each task, then over tasks. The driver gets those sums: at most BUCKETS for
    each language.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"),
                       F.col(lang_col).cast("string").alias("__lang")).where("__lang is not null and __text is not null")
    rows = rows.where(~F.coalesce(held_out(F.col("__id")), F.lit(True)))
    sizes = {lang: n for lang, n in rows.groupBy("__lang").count().collect()}  # one row per language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, 0), "f4"), np.zeros((0, 0), bool))
    rate = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, train_docs / sizes[lang]))])
    rows = rows.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < rate[F.col("__lang")] * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, scripts = np.zeros((len(langs), BUCKETS), "i8"), np.zeros((len(langs), len(SCRIPT_NAMES)), "i8")
        for batch in batches:
            for first, texts in slices(batch.column(0), lower=True):
                lang = np.array([langs.index(x) for x in batch.column(1).slice(first, len(texts)).to_pylist()])
                words = find_letters(texts)
                bucket, word = word_grams(texts, words)
                np.add.at(grams, (lang[words.text[word]], bucket), 1)
                np.add.at(scripts, (lang[words.text], word_scripts(texts, words)), words.ends - words.starts)
        for k, sums in enumerate((grams, scripts)):
            at, bucket = np.nonzero(sums)
            yield pa.record_batch([pa.array(np.full(len(at), k, "i4")), pa.array(at.astype("i4")), pa.array(bucket.astype("i4")),
                                   pa.array(sums[at, bucket])], ["kind", "lang", "bucket", "n"])

    found = (rows.select("__text", "__lang").mapInArrow(run, "kind int, lang int, bucket int, n long")
             .groupBy("kind", "lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    counts, letters = np.zeros((BUCKETS, len(langs))), np.zeros((len(SCRIPT_NAMES), len(langs)))
    for k, sums in enumerate((counts, letters)):
        part = found[found.kind == k]
        sums[part.bucket, part.lang] = part.n
    log_p = np.log((counts + ALPHA) / (counts.sum(0) + ALPHA * BUCKETS))
    return Model(langs, log_p.astype("f4"), letters >= SCRIPT_SHARE * np.maximum(letters.sum(0), 1))


def word_scores(texts: Texts, words: Words, model: Model) -> np.ndarray:
    """Log-probability of each word in each language, up to a constant for the word."""
    n = len(words.starts)
    bucket, word = word_grams(texts, words)
    out = np.stack([np.bincount(word, model.log_p[bucket, k], n) for k in range(len(model.langs))], 1).astype("f4")
    fits = model.uses[word_scripts(texts, words)]
    fits |= ~fits.any(1, keepdims=True)  # no language uses this script: all stay candidates
    out[~fits] += EXCLUDED
    return out - out.max(1, keepdims=True)


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word, when a change between neighbours costs ``switch``.

    All texts advance together, word by word; ties go to staying, then to the first language.
    """
    total, n = scores.shape
    out = np.zeros(total, "u1" if n < 256 else "i4")
    if not total:
        return out
    order = np.argsort(-counts, kind="stable")
    first, sizes = (np.cumsum(counts) - counts)[order], counts[order]
    longest = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")
    back = np.zeros((total, n), out.dtype)
    own = np.arange(n, dtype=out.dtype)
    best = np.zeros((len(sizes), n), "f4")
    for t in range(longest):
        k = active[t]
        at, value = first[:k] + t, best[:k]
        if t:
            top = value.argmax(1)
            move = value[np.arange(k), top] - switch
            stay = value >= move[:, None]
            back[at] = np.where(stay, own, top[:, None])
            value = np.where(stay, value, move[:, None])
        value = value + scores[at]
        best[:k] = value - value.max(1, keepdims=True)  # only differences count; long texts stay exact
    state = best.argmax(1).astype("i8")
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        out[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return out


def _has_letter(texts: Texts, i: int) -> bool:
    raw = texts.raw(i)
    return any(65 <= b <= 90 or 97 <= b <= 122 for b in raw) or any(c.isalpha() for c in raw.decode())


def _identified(column: pa.Array, model: Model, switch: float = SWITCH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """(index of the first text, texts, language, score, spans) for whole texts."""
    begin, held, parts = 0, 0, []
    for first, texts in slices(column, lower=True):
        words = find_letters(texts)
        parts.append((word_scores(texts, words, model) if model.langs else np.zeros((len(words.starts), 1), "f4"), words.counts,
                      words.ends - words.starts, [_has_letter(texts, i) for i in range(len(texts))]))
        held += len(words.starts)
        if held >= HELD_WORDS or first + len(texts) == len(column):
            yield begin, first + len(texts) - begin, *_label(parts, model, switch)
            begin, held, parts = first + len(texts), 0, []


def _label(parts: list, model: Model, switch: float) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    scores, counts, sizes, lettered = (np.concatenate(x) for x in zip(*parts))
    best, n = viterbi(scores, counts, switch).astype("i8"), max(1, len(model.langs))
    text = np.repeat(np.arange(len(counts)), counts)
    shares = np.bincount(text * n + best, sizes, len(counts) * n).reshape(-1, n)
    known = lettered.astype(bool) & bool(model.langs)
    share = np.where(known, shares.max(1) / np.maximum(shares.sum(1), 1), 0.0)
    names = np.array([*model.langs, "und"], object)
    change = np.ones(len(best), bool)
    change[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1])
    change &= known[text]
    at = np.flatnonzero(change)
    runs = np.bincount(np.cumsum(change)[known[text]] - 1, minlength=len(at)) if len(at) else np.zeros(0, "i8")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text[at], minlength=len(counts)))]).astype("i4")
    spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
        [pa.array(names[best[at]], pa.string()), pa.array(runs, pa.int64())], ["lang", "words"]))
    return names[np.where(known, shares.argmax(1), -1)], share, spans


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score, spans.

    ``spans``: in order, language and number of words (see :func:`find_letters`) of each span. ``lang_pred``
    is the language of most bytes of words (ties: the first by name), ``score`` its share of them.
    Null texts and texts without a letter, and all texts of a model without a language, get ``und``,
    0.0 and no span; a text whose letters are signs only (as in formulas) gets the first language by name, 0.0 and no span. Repeated rows stay repeated; very long texts are labelled whole.
    """
    send = docs.sparkSession.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.LongType())])
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("spans", T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, lang, share, spans in _identified(batch.column(1), send.value, switch):
                yield pa.record_batch([batch.column(0).slice(first, n), pa.array(lang, pa.string()), pa.array(share), spans], schema.names)

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, of which a learned language has ``min_score`` of the words' bytes or more."""
    send = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text_col, lambda column: np.concatenate(
        [(lang != "und") & (share >= min_score) for _, _, lang, share, _ in _identified(column, send.value)]))


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on ``docs`` and identify every row; held_out marks the quarter that was not learned from."""
    return identify(docs, train(docs, id_col, text_col, lang_col), id_col, text_col).withColumn(
        "held_out", F.coalesce(held_out(F.col(id_col)), F.lit(False)))
