"""Fill-in-the-middle texts: byte cuts by rank and select over packed code point boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .words import slices

#: Bits of a block of the directory, and 64-bit words in it.
BLOCK_BITS = 512
BLOCK_WORDS = BLOCK_BITS // 64


@dataclass(frozen=True)
class Sentinels:
    """What stands before the prefix, the suffix and the middle.

    All have one length, and no sentinel's end begins a sentinel: then a text without any of them, cut
    anywhere, can be told from what was put between its parts.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = [m.encode() for m in self.all]
        if len({*marks}) < 3 or len({*map(len, marks)}) > 1 or not marks[0]:
            raise ValueError("sentinels must differ, have one length and not be empty")
        if any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, len(a))):
            raise ValueError("no sentinel's end may begin a sentinel")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class Boundaries:
    """A bit for each byte, 1 where a code point begins, packed 64 to a word, with a directory of ones by block and by word.

    About 0.2 bytes for each byte of text.
    """

    def __init__(self, data: np.ndarray):
        bits = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        packed = np.zeros((len(bits) // (8 * BLOCK_WORDS) + 1) * 8 * BLOCK_WORDS, "u1")
        packed[:len(bits)] = bits
        self.words = packed.view("<u8")
        ones = np.bitwise_count(self.words).reshape(-1, BLOCK_WORDS).astype("u2")
        within = np.cumsum(ones, axis=1, dtype="u2")
        self.before = np.concatenate([[0], np.cumsum(within[:, -1], dtype="i8")])  # ones before each block
        self.inner = within - ones  # and, in its block, before each word

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each byte."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype("u8")) - np.uint64(1)
        return self.before[word // BLOCK_WORDS] + self.inner.ravel()[word] + np.bitwise_count(self.words[word] & below)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The byte of the one that has so many before it."""
        block = np.searchsorted(self.before, rank, "right") - 1
        rest = rank - self.before[block]
        slot = (self.inner[block] <= rest[:, None]).sum(1) - 1
        rest = rest - self.inner[block, slot]
        word = block * BLOCK_WORDS + slot
        bits = np.unpackbits(self.words[word].view("u1").reshape(-1, 8), axis=1, bitorder="little")
        return word * 64 + np.argmax(np.cumsum(bits, axis=1, dtype="u1") == rest[:, None] + 1, axis=1)


def draws(id_col: str, seed: int) -> list[Column]:
    """Four numbers of 32 bits that a row's id and the seed fix: the first 8-digit groups of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentinels: Sentinels = Sentinels(),
              percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """(id_col, n, form, output, prefix_chars, middle_chars) for every row: its whole text, rearranged at two cuts between code points.

    The cuts are two draws of 0 to n code points; ``percent`` of texts are rearranged, of these ``spm_percent`` with the
    suffix first (form ``spm``, else ``psm``). Other texts, empty ones and those that hold a sentinel are given as they are
    (form ``plain``, no lengths). The total of ones in a text's boundary bits is n, and the cuts' bytes
    are selected by rank, so no text is decoded. Null texts are empty, null ids draw as an empty id; rows that repeat have equal
    results; only the two columns are read, so others may have any name. Nothing is shuffled; a task holds a slice or
    one longer text at a time. An empty table gives an empty one.
    """
    marks = {name: m.encode() for name, m in zip("psm", sentinels.all)}
    width = len(marks["p"])
    schema = T.StructType([docs.schema[id_col], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("output", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())])

    def marked(texts) -> np.ndarray:
        """Which texts hold a sentinel."""
        data, found = texts.data, np.zeros(len(texts), bool)
        for mark in marks.values():
            hit = np.ones(max(0, len(data) - width + 1), bool)
            for k, byte in enumerate(mark):
                hit &= data[k:len(data) - width + 1 + k] == byte
            at = np.flatnonzero(hit)
            text = np.searchsorted(texts.offsets, at, "right") - 1
            found[text[at + width <= texts.offsets[text + 1]]] = True
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(k).to_numpy() for k in range(2, 6)]
            for first, texts in slices(batch.column(1)):
                size = len(texts)
                h1, h2, h3, h4 = (x[first:first + size] for x in h)
                bounds = Boundaries(texts.data)
                ranks = bounds.rank(texts.offsets)
                n = np.diff(ranks)
                cuts = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
                plain = (n == 0) | (h3 % 100 >= percent) | marked(texts)
                chosen = np.flatnonzero(~plain)
                inside = cuts[:, chosen]
                bytes_at = np.repeat(texts.offsets[chosen + 1][None, :], 2, axis=0)
                inner = inside < n[chosen]
                bytes_at[inner] = bounds.select((ranks[chosen] + inside)[inner])
                a, b = np.zeros((2, size), "i8")
                a[chosen], b[chosen] = bytes_at
                forms = np.where(plain, "plain", np.where(h4 % 100 < spm_percent, "spm", "psm")).tolist()
                out = []
                for i, form in enumerate(forms):
                    raw = texts.raw(i)
                    if form != "plain":
                        begin = int(texts.offsets[i])
                        x, y = int(a[i]) - begin, int(b[i]) - begin
                        part = {"p": raw[:x], "m": raw[x:y], "s": raw[y:]}
                        raw = b"".join(marks[c] + part[c] for c in (form[0], form[1], form[2]))
                    out.append(raw)
                yield pa.record_batch([
                    batch.column(0).slice(first, size), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(out, pa.binary()).cast(pa.string()),
                    pa.array(cuts[0], pa.int64(), mask=plain), pa.array(cuts[1] - cuts[0], pa.int64(), mask=plain)], schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"), *[d.alias(f"__{k}") for k, d in enumerate(draws(id_col, seed))]).mapInArrow(run, schema)


def restore(output: Column | str = "output", form: Column | str = "form", sentinels: Sentinels = Sentinels()) -> Column:
    """The exact text that an output and its form stand for."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(map(re.escape, sentinels.all)), -1)
    psm = F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1)))
