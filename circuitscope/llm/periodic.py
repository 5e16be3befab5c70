"""Periodic runs of words: repeated k-grams mask what can't be in a run, divide and conquer finds the runs in what survives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import WORD
from .words import Texts, Words, find_words, hash_words, pair_hash, same_bytes, slices

#: A run has so many words at least, and so many times its period.
MIN_WORDS = 6
MIN_EXPONENT = 4
#: Surviving segments are searched together up to so many words; a longer one alone.
GROUP_WORDS = 1 << 17


def least_overlap(min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> int:
    """The fewest words in which a run and the run moved by its period can overlap.

    A run of period q has at least max(min_words, min_exponent * q) words, so it overlaps itself in q fewer. That falls with q while
    min_words decides and rises behind, so the least is at one of the periods about the change.
    """
    return min(max(min_words, min_exponent * q) - q for q in range(1, min_words // min_exponent + 2))


def survivors(words: Words, hashes: np.ndarray, k: int) -> np.ndarray:
    """Which words are in a k-gram that comes twice or more in their text.

    All words of a run are: its k-grams but those of the last period come again a period later, k being at most the overlap.
    Grams are told by hash; two that met by chance would only leave more words to search.
    """
    covered = np.zeros(len(hashes) + 1, "i4")
    last = len(hashes) - k + 1
    if last > 1:
        gram = hashes[:last]
        for j in range(1, k):
            gram = pair_hash(gram, hashes[j:last + j])
        gram = pair_hash(gram, words.text[:last].astype("u8"))
        at = np.flatnonzero(words.text[:last] == words.text[k - 1:])
        order = np.argsort(gram[at])
        values = gram[at][order]
        same = values[1:] == values[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        begin = at[twice]
        np.add.at(covered, begin, 1)
        np.add.at(covered, begin + k, -1)
    return np.cumsum(covered[:-1]) > 0


def block_names(x: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all stretches of 1, 2, 4, ... items up to ``longest``: stretches of one length are equal if their names are.

    Returned as one array and where each length's names begin. About 4 bytes for each item and length.
    """
    tables = [np.unique(x, return_inverse=True)[1].astype("i4")]
    width = 1
    while 2 * width <= longest:
        t = tables[-1].astype("i8")
        tables.append(np.unique(t[:-width] * (int(t.max()) + 1) + t[width:], return_inverse=True)[1].astype("i4"))
        width *= 2
    return np.concatenate(tables), np.concatenate([[0], np.cumsum([len(t) for t in tables])])


def equal_ahead(names: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many items from i on equal those from j on, for i < j."""
    far = np.zeros(len(i), "i8")
    for level in range(len(at) - 2, -1, -1):
        size = at[level + 1] - at[level]
        b = j + far
        same = (b < size) & (names[at[level] + np.minimum(i + far, size - 1)] == names[at[level] + np.minimum(b, size - 1)])
        far += same.astype("i8") << level
    return far


def equal_behind(names: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many items before i equal those before j, for i < j."""
    far = np.zeros(len(i), "i8")
    for level in range(len(at) - 2, -1, -1):
        size = at[level + 1] - at[level]
        a = i - far - (1 << level)
        same = (a >= 0) & (names[at[level] + np.maximum(a, 0)] == names[at[level] + np.minimum(np.maximum(a, 0) + (j - i), size - 1)])
        far += same.astype("i8") << level
    return far


def runs_of(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_words: int = MIN_WORDS,
            min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, period) of every run in the segments ``starts`` to ``ends`` of ``x``, by begin and period.

    Main and Lorentz: a segment is halved, and the runs that cross its middle are those that the halves don't have. One of
    four periods or more has two on one side of the middle, so for each period the two squares there are compared by name; what passes is
    extended to both sides by longest common extensions. All segments of a level are worked on at once. Items between segments must
    equal no other item, the first and the last of ``x`` among them. n items take O(n log^2 n) time and 4 log n bytes an item.
    """
    if min_exponent < 4:
        raise ValueError("runs need an exponent of four or more")
    none = np.zeros(0, "i8")
    if not len(starts):
        return none, none, none
    names, at = block_names(x, int((ends - starts).max()))
    left, right = starts.astype("i8"), ends.astype("i8")
    found = [np.zeros((3, 0), "i8")]
    while len(left):
        middle = (left + right) >> 1
        periods = (right - left) // min_exponent
        node = np.repeat(np.arange(len(left)), periods)
        period = np.arange(len(node)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
        for first in (middle[node], middle[node] - 2 * period):
            fits = np.flatnonzero((first >= left[node]) & (first + 2 * period <= right[node]))
            i, q = first[fits], period[fits]
            level = np.frexp(q.astype("f8"))[1] - 1
            base, rest = at[level], q - (1 << level)
            square = np.flatnonzero((names[base + i] == names[base + i + q]) & (names[base + i + rest] == names[base + i + q + rest]))
            i, q = i[square], q[square]
            begin = i - equal_behind(names, at, i, i + q)
            end = i + q + equal_ahead(names, at, i, i + q)
            long = end - begin >= np.maximum(min_words, min_exponent * q)
            found.append(np.stack([begin[long], end[long], q[long]]))
        left, right = np.concatenate([left, middle]), np.concatenate([middle, right])
        enough = right - left >= min_words
        left, right = left[enough], right[enough]
    begin, end, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, end, begin))
    begin, end, q = begin[order], end[order], q[order]
    # a stretch has one smallest period; those found beside it are multiples
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    begin, end, q = begin[new], end[new], q[new]
    order = np.lexsort((q, begin))
    return begin[order], end[order], q[order]


def word_numbers(texts: Texts, words: Words, hashes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """A number for each chosen word, equal for equal words only: hashes, checked byte by byte."""
    part = Words(words.starts[chosen], words.ends[chosen], words.text[chosen], words.counts)
    _, first, numbers = np.unique(hashes[chosen], return_index=True, return_inverse=True)
    if same_bytes(texts, part, first[numbers]):
        return numbers
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(texts.data[a:b].tobytes(), len(seen)) for a, b in zip(part.starts.tolist(), part.ends.tolist())])


def text_runs(texts: Texts, words: Words, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, period) of every run of a slice's texts, in words of the slice."""
    hashes = hash_words(texts, words)
    inside = survivors(words, hashes, least_overlap(min_words, min_exponent))
    edge = np.diff(np.concatenate([[0], inside.view("i1"), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a stretch that goes on over the end of a text is cut there
    first_words = np.cumsum(words.counts) - words.counts
    inner = first_words[(words.counts > 0) & (first_words > 0)]
    inner = inner[inside[inner] & inside[inner - 1]]
    begin, end = np.sort(np.concatenate([begin, inner])), np.sort(np.concatenate([end, inner]))
    enough = end - begin >= min_words
    begin, end = begin[enough], end[enough]
    out = [np.zeros((3, 0), "i8")]
    at = 0
    total = np.concatenate([[0], np.cumsum(end - begin)])
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(total, total[at] + GROUP_WORDS, "right")) - 1)
        lengths = end[at:to] - begin[at:to]
        starts = total[at:to] - total[at] + np.arange(1, to - at + 1)  # an item before each segment, and one behind the last
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        chosen = np.repeat(begin[at:to], lengths) + place
        x = -np.arange(1, int(lengths.sum()) + len(lengths) + 2)
        x[np.repeat(starts, lengths) + place] = word_numbers(texts, words, hashes, chosen)
        b, e, q = runs_of(x, starts, starts + lengths, min_words, min_exponent)
        moved = (begin[at:to] - starts)[np.searchsorted(starts, b, "right") - 1]
        out.append(np.stack([b + moved, e + moved, q]))
        at = to
    return tuple(np.concatenate(out, axis=1))


def joined_words(texts: Texts, words: Words, keep: np.ndarray) -> pa.Array:
    """For each text the words to keep, joined by one space."""
    chosen = np.flatnonzero(keep)
    lengths = words.ends[chosen] - words.starts[chosen]
    text = words.text[chosen]
    last = np.ones(len(chosen), bool)
    last[:-1] = text[1:] != text[:-1]
    taken = lengths + ~last
    first = np.cumsum(taken) - taken
    out = np.full(int(taken.sum()), 0x20, "u1")
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(first, lengths) + within] = texts.data[np.repeat(words.starts[chosen], lengths) + within]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text, taken, len(texts)).astype("i8"))])
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.string())


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
              min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(id_col, n_words, runs, collapsed) for every row of ``docs``.

    ``runs``: start, length, period of each maximal stretch of words with smallest period q and at least max(min_words, min_exponent * q) words, by
    start and period; words are numbered from 0. ``collapsed``: the words but those that a run holds behind its first period,
    joined by one space. Whole texts are searched, and exactly: words are told apart by their bytes. Null and empty texts have no
    word and no run; repeated rows have equal results; ids of any kind, nulls too, are carried; only the two columns are read, so others may have
    any name. Nothing is shuffled; a task holds a slice or one longer text, and about 4 log2(n) bytes for each of the n words that survive
    in the longest segment. An empty table gives an empty one.
    """
    run_type = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run_type)),
                           T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                words = find_words(texts)
                begin, end, period = text_runs(texts, words, min_words, min_exponent)
                drop = np.zeros(len(words.starts) + 1, "i8")
                np.add.at(drop, begin + period, 1)
                np.add.at(drop, end, -1)
                text = words.text[begin] if len(begin) else begin
                number = begin - (np.cumsum(words.counts) - words.counts)[text]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))]).astype("i4")
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                    [pa.array(x.astype("i8")) for x in (number, end - begin, period)], names=["start", "length", "period"]))
                yield pa.record_batch([batch.column(0).slice(first, len(texts)), pa.array(words.counts.astype("i8")), runs,
                                       joined_words(texts, words, np.cumsum(drop[:-1]) == 0)], schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def strongest(runs: Column | str = "runs") -> Column:
    """The run with the greatest length over period, compared as fractions; of equal ones the first. Null without a run."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    return F.aggregate(runs, F.get(runs, 0), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col) with a periodic tail in the tenth of the rows whose id's crc32 ends in 0; the others as they are.

    With g = floor(crc32 / 10) and n words, word i from a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def planted(words: Column) -> Column:
        n = F.greatest(F.size(words), F.lit(1))
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    # the words are bound once, as the only item of an array
    bound = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), planted), 0)
    return docs.select(id_col, F.when(h % 10 == 0, bound).otherwise(text).alias(text_col))
