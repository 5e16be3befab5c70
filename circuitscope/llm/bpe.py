"""BPE encoding and decoding through a table of distinct words."""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .words import Texts, find_words, group_hashes, hash_words, same_bytes

#: Documents are dealt with in blocks of about so many bytes of text, or of one document that is longer.
BLOCK_BYTES = 8 << 20
#: A bucket of the distinct-word table takes the words of so many bytes of text; its lists have about a tenth of them.
BUCKET_BYTES = 64 << 20
#: Words that are encoded in one call of the library.
CALL_WORDS = 20_000
#: Words that a worker's cache holds, some 200 bytes each; see :class:`CachedEncoder`.
CACHE_WORDS = 800_000

_loaded: dict[str, object] = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public vocabulary file lies; operators take the path of any file of its kind as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The steps of a vocabulary file for which a text's ids are its words' ids, as :func:`split_words` and :class:`CachedEncoder` take for granted.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def require_words(tokenizer, path: str) -> None:
    """An error unless a vocabulary is of the kind that these operators encode word by word: others would get other ids than the library's."""
    parts = json.loads(tokenizer.to_str())
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not set(t["content"]) & set(" \t\n\x0b\x0c\r") for t in parts["added_tokens"])
    model = parts["model"]
    if not (added and parts["normalizer"] == NORMALIZER and parts["pre_tokenizer"] == PRE_TOKENIZER and parts["post_processor"] is None
            and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["continuing_subword_prefix"] and not model["dropout"]):
        raise ValueError(f"{path} is no vocabulary of lower-cased words: its ids can't be made word by word")


def load(path: str):
    """The tokenizer of a file, without truncation or padding; one a process. Files of another kind are refused; see :func:`require_words`."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        require_words(tokenizer, path)
        _loaded[path] = tokenizer
    return _loaded[path]


def split_words(text: str | None) -> list[bytes]:
    """A text's words: what stands between \\x20 and \\x09-\\x0D. The vocabulary drops white space, and its
    normalization and splitting never look across these characters, so a text's ids are its words' ids."""
    return (text or "").encode().split()


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others, in
    order, for what follows Latin-1."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


#: Bytes of plain words: those that one or more ASCII letters begin with, and those that may follow these.
_NO_LETTER, _NO_MARK = np.ones(256, bool), np.ones(256, bool)
_NO_LETTER[[*range(65, 91), *range(97, 123)]] = False
_NO_MARK[list(b".,;:!?")] = False


def _letters_in_front(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word how many ASCII letters it begins with, if nothing but plain punctuation follows these; else -1."""
    others = np.append(np.flatnonzero(_NO_LETTER[texts.data]), len(texts.data))
    stop = np.minimum(others[np.searchsorted(others, starts)], ends)
    odd = np.concatenate([[0], np.cumsum(_NO_MARK[texts.data], dtype="i4" if len(texts.data) < 1 << 31 else "i8")])
    return np.where(odd[ends] == odd[stop], stop - starts, -1)


class CachedEncoder:
    """Encodes texts word by word with the library, and keeps the ids of words seen lately.

    The cache is emptied when it is full, which bounds memory and changes no result; ids are kept as bytes, a quarter of what tuples of numbers take. Most words are plain: Latin letters, then perhaps
    plain punctuation. The vocabulary lower-cases and splits these into the two parts, so they go straight to the library's
    model; every other word goes through all of the library's steps.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known = load(path), {}
        self.letters = _byte_letters()

    def plain_parts(self, word: str) -> tuple[str, ...] | None:
        """The parts of a plain word as the model takes them, else None."""
        body = word.rstrip(".,;:!?")
        if not body:
            return (word,)
        if body.isascii():
            if not body.isalpha():
                return None
            low = body.lower()
        elif body.isalpha() and max(body) < "ɐ" and "İ" not in body and unicodedata.is_normalized("NFC", body):
            low = "".join([self.letters[b] for b in body.lower().encode()])
        else:
            return None
        return (low, word[len(body):]) if len(body) < len(word) else (low,)

    def _looked_up(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """For each word of a slice the number of its text and of its group; and the ids of each group's word, as bytes.

        Words are grouped by hash, and the groups checked byte by byte; only a word of each group is looked up. Should
        two words ever share a hash, the slice is grouped by the words themselves.
        """
        words = find_words(texts)
        if not len(words.starts):
            return np.zeros(0, "i8"), np.zeros(0, "i8"), []
        raw, known = texts.data.tobytes(), self.known
        first, group = group_hashes(hash_words(texts, words))
        if not same_bytes(texts, words, first[group]):
            numbers: dict[bytes, int] = {}
            group = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(words.starts.tolist(), words.ends.tolist())])
            first = np.unique(group, return_index=True)[1]
        each = [raw[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist())]
        new = [k for k, w in enumerate(each) if w not in known]
        self._add([each[k] for k in new], _letters_in_front(texts, words.starts[first[new]], words.ends[first[new]]).tolist())
        ids = list(map(known.get, each))
        if len(known) > CACHE_WORDS:
            known.clear()
        return words.text, group, ids

    def count(self, texts: Texts) -> np.ndarray:
        """How many ids each text of a slice has."""
        text, group, ids = self._looked_up(texts)
        return np.bincount(text, np.fromiter(map(len, ids), "i8", len(ids))[group] // 4, len(texts)).astype("i8")

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts, one after another, and how many each text has."""
        text, group, ids = self._looked_up(texts)
        if not len(text):
            return np.zeros(0, "u4"), np.zeros(len(texts), "i8")
        lengths, flat = np.fromiter(map(len, ids), "i8", len(ids)) // 4, np.frombuffer(b"".join(ids), "u4")
        n = lengths[group]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(lengths) - lengths)[group] - (ends - n), n)
        at += np.arange(len(at))
        return flat[at], np.bincount(text, n, len(texts)).astype("i8")

    def _add(self, missing: list[bytes], letters: list[int]) -> None:
        """Keeps the ids of words that aren't known; ``letters`` as :func:`_letters_in_front` gives them."""
        known, tokenize, odd = self.known, self.tokenizer.model.tokenize, []
        parts: dict[str, bytes] = {"": b""}
        for word, front in zip(missing, letters):
            if front >= 0:
                low = word.lower().decode()
                plain = (low[:front], low[front:])
            elif (plain := self.plain_parts(text := word.decode())) is None:
                odd.append((word, text))
                continue
            for p in plain:
                if p not in parts:
                    parts[p] = array("I", [t.id for t in tokenize(p)]).tobytes()
            known[word] = parts[plain[0]] + parts[plain[1]] if len(plain) > 1 else parts[plain[0]]
        for at in range(0, len(odd), CALL_WORDS):
            some = odd[at:at + CALL_WORDS]
            for (word, _), x in zip(some, self.tokenizer.encode_batch([text for _, text in some], add_special_tokens=False)):
                known[word] = array("I", x.ids).tobytes()


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of a vocabulary: a table whose size the vocabulary file fixes."""
    tokenizer = load(path)
    if tokenizer.decoder is not None:
        raise ValueError(f"{path} has a decoder of its own; joined pieces would not be its text")
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    return spark.createDataFrame(pa.table({"id": pa.array(vocabulary.values(), pa.int32()), "piece": pa.array(vocabulary.keys(), pa.string())}))


def _piece_lists(spark: SparkSession, path: str) -> DataFrame:
    """(vocabulary, pieces): the table of :func:`pieces` as one row, with the piece of each id at its place."""
    found = pieces(spark, path)
    listed = found.agg(F.array_sort(F.collect_list(F.struct("id", "piece"))).alias("p"), F.max("id").alias("most"))
    by_id = F.map_from_entries("p")
    return listed.select(F.lit(path).alias("vocabulary"),
                         F.when(F.size("p") == F.col("most") + 1, F.col("p.piece")).otherwise(
                             F.transform(F.sequence(F.lit(0), F.col("most")), lambda i: F.try_element_at(by_id, i))).alias("pieces"))


def _squeeze(numbers: np.ndarray) -> bytes:
    """32-bit numbers, byte planes one after another, compressed; in front, their count."""
    planes = numbers.astype("<u4").view("u1").reshape(-1, 4).T.tobytes()
    return len(numbers).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def _expand(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(pa.decompress(data[4:], 4 * n, "zstd", asbytes=True), "u1").reshape(4, n).T.copy().view("<u4").ravel()


def _squeeze_words(words: list[bytes]) -> bytes:
    line = b" ".join(words)
    return len(line).to_bytes(4, "little") + pa.compress(line, "zstd", asbytes=True)


def _expand_words(data: bytes) -> list[bytes]:
    return pa.decompress(data[4:], int.from_bytes(data[:4], "little"), "zstd", asbytes=True).split()


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """One row for each block of documents: its key, the documents' ids and word counts, its distinct words as
    they first occur, and for each place the number of its word. Words are split where texts are scanned."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
                           T.StructField("counts", T.ArrayType(T.IntegerType())),
                           T.StructField("words", T.BinaryType()), T.StructField("places", T.BinaryType())])

    def close(key: int, ids: list, counts: list[int], numbers: dict[bytes, int], places: list[np.ndarray], id_type) -> pa.RecordBatch:
        return pa.record_batch([pa.array([key]), pa.array([ids], pa.list_(id_type)), pa.array([counts], pa.list_(pa.int32())),
                                pa.array([_squeeze_words(list(numbers))], pa.binary()),
                                pa.array([_squeeze(np.concatenate([*places, np.zeros(0, "i4")]))], pa.binary())], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 32
        ids, counts, numbers, places, size = [], [], {}, [], 0
        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = split_words(value.as_py())
                places.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), "i4", len(words)))
                ids.append(i)
                counts.append(len(words))
                size += sum(map(len, words))
                if size >= block_bytes or len(ids) >= 1 << 16:
                    yield close(key, ids, counts, numbers, places, batch.column(0).type)
                    key += 1
                    ids, counts, numbers, places, size = [], [], {}, [], 0
        if ids:
            yield close(key, ids, counts, numbers, places, batch.column(0).type)

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def _dealt(words: list[bytes], buckets: int) -> tuple[list[int], np.ndarray]:
    """The words' numbers in order of bucket and word, and each one's bucket. Buckets are ranges of the words' hash."""
    bucket = [zlib.crc32(w) * buckets >> 32 for w in words]
    order = sorted(range(len(words)), key=lambda k: (bucket[k], words[k]))
    return order, np.array([bucket[k] for k in order], "i8")


def _encoded_words(blocks: DataFrame, path: str, buckets: int) -> DataFrame:
    """(of, bucket, lengths, ids): the ids of each block's words, bucket by bucket, in the order of :func:`_dealt`.

    A bucket is the part of the distinct-word table with its hashes: all blocks' lists of it meet, and each of its
    words is encoded once.
    """
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist()):
                words = _expand_words(packed)
                if not words:
                    continue
                order, bucket = _dealt(words, buckets)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(words)]])
                yield pa.record_batch([pa.array(bucket[cuts[:-1]], pa.int64()), pa.array([block] * (len(cuts) - 1), pa.int64()),
                                       pa.array([_squeeze_words([words[k] for k in order[a:b]]) for a, b in zip(cuts, cuts[1:])], pa.binary())],
                                      ["bucket", "of", "words"])

    def encode(table: pa.Table) -> pa.Table:
        lists = [_expand_words(x) for x in table.column("words").to_pylist()]
        distinct = list({w: None for some in lists for w in some})
        known: dict[bytes, list[int]] = {}
        tokenizer = load(path)
        for at in range(0, len(distinct), CALL_WORDS):
            some = distinct[at:at + CALL_WORDS]
            found = tokenizer.encode_batch([w.decode() for w in some], add_special_tokens=False)
            known.update(zip(some, (x.ids for x in found)))
        ids = [[known[w] for w in some] for some in lists]
        return pa.table([table.column("of"), table.column("bucket"),
                         pa.array([_squeeze(np.fromiter(map(len, x), "u4", len(x))) for x in ids], pa.binary()),
                         pa.array([_squeeze(np.fromiter((i for w in x for i in w), "u4")) for x in ids], pa.binary())],
                        ["of", "bucket", "lengths", "ids"])

    # all columns go in, so that this and the join below read one shuffle of the blocks
    return (blocks.mapInArrow(deal, "bucket long, of long, words binary")
            .groupBy("bucket").applyInArrow(encode, "of long, bucket long, lengths binary, ids binary"))


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                  digests_only: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of ``docs``: id, n_tokens, ids and the decoded text; or, with ``digests_only``, the hex SHA-256
    of the ids as decimals joined by a space, and of the decoded text.

    Texts are split where they are scanned, into blocks of bounded size; a block lists its distinct words
    and each place's word. The lists of all blocks meet in the distinct-word table, dealt by hash over buckets whose number
    grows with the bytes of text, where each word is encoded once; the ids go back to the blocks and are joined by position. A word so costs an
    entry for each block that has it, not for each place, and a hot word no more than any. The id
    lists are decoded by a broadcast join with the vocabulary's pieces, a row for each vocabulary, whose size the file fixes.
    Without a decoder in the vocabulary file the library joins pieces by a space, and so does this; a file with one is an error.
    Null and empty texts have no ids; repeated rows stay repeated; long texts are whole.
    """
    path, spark = path or vocabulary_path(), docs.sparkSession
    lists = F.broadcast(_piece_lists(spark, path))
    blocks = _blocks(docs, id_col, text_col, block_bytes).repartition("block")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    buckets = max(24, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    schema = T.StructType([T.StructField("vocabulary", T.StringType()), T.StructField("docs", T.ArrayType(docs.schema[id_col].dataType)),
                           T.StructField("ids", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def rebuild(block: pa.Table, words: pa.Table) -> pa.Table:
        row = {name: block.column(name)[0] for name in block.schema.names}
        counts, places = row["counts"].values.to_numpy(), _expand(row["places"].as_py()).astype("i8")
        order, _ = _dealt(_expand_words(row["words"].as_py()), buckets)
        words = words.sort_by("bucket")
        none = [np.zeros(0, "u4")]
        lengths = np.concatenate([_expand(x) for x in words.column("lengths").to_pylist()] or none).astype("i8")
        flat = np.concatenate([_expand(x) for x in words.column("ids").to_pylist()] or none)
        if len(lengths) != len(order):
            raise ValueError("a block's words are not those it listed")
        number, first = np.zeros(len(order), "i8"), np.cumsum(lengths) - lengths
        number[order] = np.arange(len(order))  # of each of the block's words, its place among the encoded ones
        which = number[places]
        n = lengths[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(first[which] - ends[:-1], n)
        at += np.arange(len(at))
        offsets = ends[np.concatenate([[0], np.cumsum(counts)])]
        ids = pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), pa.array(flat[at].astype("i4")))
        outer = pa.array([0, len(counts)], pa.int32())
        return pa.table([pa.array([path]), pa.ListArray.from_arrays(outer, row["ids"].values), pa.ListArray.from_arrays(outer, ids)], schema.names)

    encoded = blocks.groupBy("block").cogroup(_encoded_words(blocks, path, buckets).groupBy("of")).applyInArrow(rebuild, schema)
    joined = encoded.join(lists, "vocabulary")
    decoded = lambda ids: F.array_join(F.transform(ids, lambda i: F.get("pieces", i)), " ")
    if digests_only:
        digests = F.transform("ids", lambda ids: F.struct(F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
                                                          F.sha2(decoded(ids), 256).alias("decoded_sha256")))
        rows = joined.select(F.inline(F.arrays_zip(F.col("docs").alias("d"), digests.alias("x"))))
        return rows.select(F.col("d").alias(id_col), "x.*")
    texts = F.transform("ids", lambda ids: F.struct(F.size(ids).cast("long").alias("n_tokens"), ids.alias("ids"), decoded(ids).alias("decoded")))
    rows = joined.select(F.inline(F.arrays_zip(F.col("docs").alias("d"), texts.alias("x"))))
    return rows.select(F.col("d").alias(id_col), "x.*")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded): any id lists decoded by an id-to-piece join. Null and empty lists give an empty text;
    ids that the vocabulary lacks give nothing, as in the library. ``id_col`` must be unique."""
    table = F.broadcast(pieces(encoded.sparkSession, path or vocabulary_path()))
    rows = encoded.select(id_col, F.posexplode_outer(ids_col).alias("__pos", "id")).join(table, "id", "left")
    found = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("__pos", "piece")))).alias("p"))
    return found.select(id_col, F.array_join("p.piece", " ").alias("decoded"))
