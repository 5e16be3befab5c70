"""Words of Arrow text columns as arrays: run boundaries and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about so many bytes, or of one text that is longer.
SLICE_BYTES = 1 << 18
#: Bytes that are in a word: all but \x20 and \x09-\x0D; or letters: a-z, A-Z and all of non-ASCII text.
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
IN_LETTERS = np.zeros(256, bool)
IN_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE, _K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: Of eight bytes, the first k.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], "u8")


@dataclass
class Texts:
    """A slice of a text column: its bytes, and where each text begins and ends. Nulls are empty."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """For each text the sum of a small number for each of its bytes."""
        total = np.concatenate([[0], np.cumsum(per_byte, dtype="i8")])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def slices(column: pa.Array, lower: bool = False, size: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """(index of the first text, Texts) over a whole column, whole texts only."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], "i8")[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, "i8")
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        part = column.slice(first, last - first)
        if lower:
            part = pc.utf8_lower(part)
        buffer = part.buffers()
        offsets = np.frombuffer(buffer[1], "i8")[part.offset:part.offset + len(part) + 1]
        data = np.frombuffer(buffer[2], "u1")[offsets[0]:offsets[-1]] if buffer[2] is not None else np.zeros(0, "u1")
        yield first, Texts(data, offsets - offsets[0])
        first = last


@dataclass
class Words:
    """The words of a slice: byte range and text of each, and how many each text has."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    counts: np.ndarray


def find_words(texts: Texts, table: np.ndarray = IN_WORD) -> Words:
    """Maximal runs of the bytes that ``table`` marks, within each text."""
    inside = table[texts.data]
    if not len(inside):
        none = np.zeros(0, "i8")
        return Words(none, none, none, np.zeros(len(texts), "i8"))
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = texts.offsets[:-1][texts.offsets[:-1] < len(inside)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    place = np.searchsorted(starts, texts.offsets)
    counts = np.diff(place)
    return Words(starts, ends, np.repeat(np.arange(len(texts)), counts), counts)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * _K2
    h = (h ^ (h >> np.uint64(29))) * _K1
    return h ^ (h >> np.uint64(32))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _BASE + b * _K1 + _K2)


def _eight_from(texts: Texts) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    padded = np.concatenate([texts.data, np.zeros(8, "u1")])
    return np.ndarray(len(texts.data) + 1, "<u8", padded, strides=(1,))


def hash_words(texts: Texts, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal words are taken for the same word by it.

    A word is the sum of its 8-byte lanes, each mixed with its place, so no algebra of repeated or swapped
    letters makes two words meet, as it does with polynomials.
    """
    if not len(words.starts):
        return np.zeros(0, "u8")
    lengths = words.ends - words.starts
    at_byte = _eight_from(texts)
    lanes = (lengths + 7) >> 3
    if int(lanes.max(initial=1)) <= 1:
        return mix(mix((at_byte[words.starts] & _MASKS[lengths]) + _K1) + lengths.astype("u8") * _K2)
    first = np.cumsum(lanes) - lanes
    within = np.arange(int(lanes.sum())) - np.repeat(first, lanes)
    values = at_byte[np.repeat(words.starts, lanes) + 8 * within] & _MASKS[np.minimum(np.repeat(lengths, lanes) - 8 * within, 8)]
    place = within.astype("u8") + np.uint64(1)
    return mix(np.add.reduceat(mix(values + mix(place * _K1) * (place > 1) + _K1), first) + lengths.astype("u8") * _K2)


def group_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, group): the group of each hash, numbered as they first occur, and where each group does. By a hash table, not by sorting."""
    group, found = pd.factorize(hashes)
    first = np.empty(len(found), "i8")
    first[group[::-1]] = np.arange(len(hashes) - 1, -1, -1)  # of repeated places the last assignment stays: the first occurrence
    return first, group


def same_bytes(texts: Texts, words: Words, other: np.ndarray) -> bool:
    """Whether each word has the bytes of the word whose number ``other`` gives: eight bytes at a time."""
    lengths = words.ends - words.starts
    if not len(lengths):
        return True
    if (lengths != lengths[other]).any():
        return False
    at_byte = _eight_from(texts)
    mask = _MASKS[np.minimum(lengths, 8)]
    if ((at_byte[words.starts] ^ at_byte[words.starts[other]]) & mask).any():
        return False
    long = np.flatnonzero(lengths > 8)
    lanes = (lengths[long] - 1) >> 3  # those behind the first eight bytes
    within = 8 * (np.arange(1, int(lanes.sum()) + 1) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    mine = at_byte[np.repeat(words.starts[long], lanes) + within]
    theirs = at_byte[np.repeat(words.starts[other[long]], lanes) + within]
    return not ((mine ^ theirs) & _MASKS[np.minimum(np.repeat(lengths[long], lanes) - within, 8)]).any()
