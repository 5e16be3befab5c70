"""Token ids as patched frame-of-reference blocks: written by Spark, read back without a shuffle."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .bpe import CachedEncoder, vocabulary_path
from .common import scratch_dir
from .words import slices

#: Ids in a block, and the share of them that the packed width must hold; the others are exceptions.
BLOCK_IDS = 1024
PERCENTILE = 0.9
#: A segment (one row of the file) closes with the document that brings it to so many ids.
SEGMENT_IDS = 1 << 18
#: Bytes of text that are encoded at once, about.
SLICE_BYTES = 2 << 20
HEADER = np.dtype([("base", "<u4"), ("count", "<u2"), ("width", "u1"), ("high_bytes", "u1"), ("exceptions", "<u2")])


def pack_block(ids: np.ndarray) -> bytes:
    """One block of 1 to BLOCK_IDS unsigned 32-bit numbers.

    Header; low ``width`` bits of each number less the minimum, packed; then the places of the numbers that
    need more bits, and their high parts, ``high_bytes`` bytes each. ``width`` is the least that holds
    the PERCENTILE share of numbers.
    """
    base = int(ids.min())
    rest = (ids.astype("u8") - base).astype("u4")
    width = int(np.sort(rest)[max(0, int(np.ceil(PERCENTILE * len(rest))) - 1)]).bit_length()
    low = rest & np.uint32((1 << width) - 1)
    outlier = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, "i8")
    high = (rest[outlier] >> np.uint32(width)) if len(outlier) else np.zeros(0, "u4")
    size = (int(high.max()).bit_length() + 7) // 8 if len(outlier) else 0
    bits = np.unpackbits(low.astype("<u4").view("u1").reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    header = np.array([(base, len(ids), width, size, len(outlier))], HEADER)
    return b"".join([header.tobytes(), np.packbits(bits, bitorder="little").tobytes(), outlier.astype("<u2").tobytes(),
                     high.astype("<u4").view("u1").reshape(-1, 4)[:, :size].tobytes()])


def unpack_block(data: bytes | memoryview, at: int = 0) -> np.ndarray:
    """The numbers of the block that begins at byte ``at``."""
    base, count, width, size, n = np.frombuffer(data, HEADER, 1, at)[0].tolist()
    at += HEADER.itemsize
    packed = (count * width + 7) // 8
    out = np.full(count, base, "u4")
    if width:
        bits = np.zeros((count, 32), "u1")
        bits[:, :width] = np.unpackbits(np.frombuffer(data, "u1", packed, at), bitorder="little")[:count * width].reshape(count, width)
        out += np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    if n:
        where = np.frombuffer(data, "<u2", n, at + packed)
        high = np.zeros((n, 4), "u1")
        high[:, :size] = np.frombuffer(data, "u1", n * size, at + packed + 2 * n).reshape(n, size)
        out[where] += high.view("<u4").ravel() << np.uint32(width)
    return out


def pack(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """Blocks one after another, and the byte at which each begins. Full blocks are packed together, as :func:`pack_block` does."""
    full = len(ids) // BLOCK_IDS
    blocks: list[bytes] = [b""] * full
    table = ids[:full * BLOCK_IDS].reshape(full, BLOCK_IDS).astype("u4")
    if full:
        base = table.min(1)
        rest = table - base[:, None]
        holds = int(np.ceil(PERCENTILE * BLOCK_IDS)) - 1
        at = np.partition(rest, holds, axis=1)[:, holds]
        widths = np.array([int(x).bit_length() for x in at])
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            some = rest[rows]
            low = some & np.uint32((1 << width) - 1)
            cells = low.astype("<u2").view("u1").reshape(-1, 2) if width <= 16 else low.astype("<u4").view("u1").reshape(-1, 4)
            bits = np.packbits(np.unpackbits(cells, axis=1, bitorder="little")[:, :width].reshape(len(rows), -1), axis=1, bitorder="little")
            over = some >> np.uint32(width) if width < 32 else np.zeros_like(some)
            for k, row in enumerate(rows.tolist()):
                outlier = np.flatnonzero(over[k])
                high = over[k][outlier]
                size = (int(high.max()).bit_length() + 7) // 8 if len(outlier) else 0
                header = np.array([(base[row], BLOCK_IDS, width, size, len(outlier))], HEADER)
                blocks[row] = b"".join([header.tobytes(), bits[k].tobytes(), outlier.astype("<u2").tobytes(),
                                        high.astype("<u4").view("u1").reshape(-1, 4)[:, :size].tobytes()])
    if full * BLOCK_IDS < len(ids):
        blocks.append(pack_block(ids[full * BLOCK_IDS:]))
    starts = [0]
    for b in blocks:
        starts.append(starts[-1] + len(b))
    return b"".join(blocks), starts[:-1]


def unpack(data: bytes, starts: list[int], first: int = 0, count: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``first + count`` (all by default): only the blocks that hold them are read."""
    last = len(starts) if count is None else min(len(starts), -(-(first + count) // BLOCK_IDS))
    begin = first // BLOCK_IDS
    chosen = starts[begin:last]
    headers = np.array([np.frombuffer(data, HEADER, 1, s)[0] for s in chosen], HEADER)
    full = np.flatnonzero(headers["count"] == BLOCK_IDS)
    blocks: list[np.ndarray] = [np.zeros(0, "u4")] * len(chosen)
    for width in np.unique(headers["width"][full]).tolist():
        rows = full[headers["width"][full] == width]
        out = np.repeat(headers["base"][rows].astype("u4")[:, None], BLOCK_IDS, axis=1)
        packed = BLOCK_IDS * width // 8
        if width:
            raw = np.zeros((len(rows), packed + 8), "u1")  # so that eight bytes can be read from each place
            for k, r in enumerate(rows.tolist()):
                raw[k, :packed] = np.frombuffer(data, "u1", packed, chosen[r] + HEADER.itemsize)
            bit = np.arange(BLOCK_IDS) * width  # a number's bits begin within a byte, and four or eight bytes hold them
            kind = "<u4" if width <= 25 else "<u8"
            from_byte = np.ndarray((len(rows), packed + 1), kind, raw, strides=(packed + 8, 1))
            numbers = from_byte[:, bit >> 3] >> (bit & 7).astype(kind)
            out += (numbers & np.array((1 << width) - 1, kind)).astype("u4")
        for k, r in enumerate(rows.tolist()):
            n, size = int(headers["exceptions"][r]), int(headers["high_bytes"][r])
            if n:
                at = chosen[r] + HEADER.itemsize + packed
                high = np.zeros((n, 4), "u1")
                high[:, :size] = np.frombuffer(data, "u1", n * size, at + 2 * n).reshape(n, size)
                out[k, np.frombuffer(data, "<u2", n, at)] += high.view("<u4").ravel() << np.uint32(width)
            blocks[r] = out[k]
    for r in np.flatnonzero(headers["count"] != BLOCK_IDS).tolist():
        blocks[r] = unpack_block(data, chosen[r])
    return np.concatenate([*blocks, np.zeros(0, "u4")])[first - begin * BLOCK_IDS:][:count]


def write_tokens(docs: DataFrame, out: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 1, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole text, append ``end_id`` and write all ids in ascending order of ``id_col`` to ``out``.

    A range shuffle by id puts the documents in order (null ids first; rows with equal ids in any order,
    each with its own place). Each task is one shard and writes segments of whole documents: their ids as
    PFOR blocks, where blocks and documents begin, and the ids' range. Parquet is the container, so
    Spark's commit protocol covers lost and repeated tasks on any file system.
    Null and empty texts are the end id alone; an empty table writes an empty file.
    """
    path = path or vocabulary_path()
    id_type = docs.schema[id_col].dataType
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("n_ids", T.LongType()),
        T.StructField("block_starts", ints), T.StructField("data", T.BinaryType()),
        T.StructField("docs", T.ArrayType(id_type)), T.StructField("doc_starts", longs), T.StructField("doc_ids", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(path), TaskContext.get().partitionId()
        docs_, parts, segment, before, size = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            lengths = [len(p) for p in parts]
            data, starts = pack(np.concatenate(parts))
            return pa.record_batch([pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([size], pa.int64()),
                                    pa.array([starts], pa.list_(pa.int32())), pa.array([data], pa.binary()), pa.array([docs_], pa.list_(kind)),
                                    pa.array([before + np.cumsum(lengths) - lengths], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32()))],
                                   schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for first, texts in slices(batch.column(1), size=SLICE_BYTES):
                ids, counts = encoder.encode(texts)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, np.uint32(end_id))  # behind each text
                ends += np.arange(1, len(ends) + 1)
                for doc, a, b in zip(batch.column(0).slice(first, len(texts)).to_pylist(), [0, *ends.tolist()], ends.tolist()):
                    docs_.append(doc)
                    parts.append(ids[a:b])
                    size += b - a
                    if size >= segment_ids:
                        yield close()
                        docs_, parts, segment, before, size = [], [], segment + 1, before + size, 0
        if docs_:
            yield close()

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    rows.repartitionByRange("__id").sortWithinPartitions("__id").mapInArrow(run, schema).write.parquet(out)


_encoders: dict[str, CachedEncoder] = {}


def _encoder(path: str) -> CachedEncoder:
    """One encoder a process, so that its cache serves all of a worker's tasks."""
    return _encoders.setdefault(path, CachedEncoder(path))


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens) for every row of ``docs``: the ids that the vocabulary gives its text, and an end mark.

    The lengths are those of :func:`write_tokens`. Texts are encoded where they are scanned, and not shuffled.
    """
    path = path or vocabulary_path()
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for first, texts in slices(batch.column(1), size=SLICE_BYTES):
                yield pa.record_batch([batch.column(0).slice(first, len(texts)), pa.array(encoder.count(texts) + 1, pa.int64())], schema.names)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def shard_starts(segments: DataFrame) -> DataFrame:
    """(shard, shard_start): ids before each shard. One row for each shard, i.e. for each task of the writer."""
    sizes = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def read_tokens(segments: DataFrame, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32[, ids]) of every document in a file of :func:`write_tokens`.

    Each segment is unpacked where it is read. ``start`` counts all ids before the document's.
    ``ids_crc32``: of the document's ids as little-endian unsigned 32-bit numbers.
    """
    id_type = segments.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField(id_col, id_type), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
                          + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                ids = unpack(row["data"].as_py(), row["block_starts"].as_py())
                lengths = row["doc_ids"].values.to_numpy()
                parts = np.split(ids, np.cumsum(lengths)[:-1])
                columns = [pa.array(np.full(len(lengths), row["shard"].as_py(), "i4")), row["docs"].values, row["doc_starts"].values,
                           pa.array(lengths.astype("i8")), pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([p.astype("i8") for p in parts], pa.list_(pa.int64())))
                yield pa.record_batch(columns, schema.names)

    found = segments.select("shard", "block_starts", "data", "docs", "doc_starts", "doc_ids").mapInArrow(run, schema)
    joined = found.join(F.broadcast(shard_starts(segments)), "shard")  # a row for each of the writer's tasks
    return joined.withColumn("start", F.col("start") + F.col("shard_start")).drop("shard", "shard_start")


def tokenize_and_read_back(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the file into the shared folder and read every document's place, length and checksum from it."""
    import uuid

    spark = docs.sparkSession
    out = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, out, path, id_col, text_col)
    return read_tokens(spark.read.parquet(out), id_col, with_ids=False)
