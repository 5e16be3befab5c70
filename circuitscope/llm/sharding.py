"""Shards of equal bytes, tokens and rows: groups of equal texts as vectors, each packed where the room left points its way."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .bpe import vocabulary_path
from .common import materialize
from .pfor import SLICE_BYTES, _encoder
from .words import slices

SHARDS = 16
#: A group is placed by itself from this part of a shard on, in any measure; at most 3 * shards * PARTS groups can be so large.
PARTS = 256
#: Smaller groups are placed together, by size and hash: so many bundles for each doubling of a text's size.
BUNDLES = 1024
#: A group beyond this part of a shard is cut into pieces of 1 / PIECES of a shard each: whole, it would tip the shard.
WHOLE = 0.5
PIECES = 16
#: Places within a shard are numbered in cells of about 1 / CELLS of all rows.
CELLS = 4096
MEASURES = ("size", "tokens", "n_rows")
GROUP = ["g1", "g2", "size", "text_crc32"]


def measures(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, g1, g2, tokens) of every row: UTF-8 bytes and 1, checksum, 128 bits that tell its text, ids and end mark of the vocabulary.

    Null texts are empty. Texts are measured where they are scanned, and not shuffled.
    """
    path = path or vocabulary_path()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    wide = docs.select(F.col(id_col), text.alias("__text"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2"))
    schema = T.StructType([f for f in wide.schema if f.name != "__text"] + [T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            kept = [batch.column(k) for k in range(batch.num_columns) if k != 1]
            for first, texts in slices(batch.column(1), size=SLICE_BYTES):
                tokens = pa.array(encoder.count(texts) + 1, pa.int64())
                yield pa.record_batch([c.slice(first, len(texts)) for c in kept] + [tokens], schema.names)

    return wide.mapInArrow(run, schema)


def place(vectors: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """The shard of each vector (a row of measures), in the order given.

    Room is counted in parts of a fair share of each measure. A vector goes where its dot product with the room left
    is highest, of equal ones to the first; room below zero counts against a shard.
    """
    parts = vectors / np.maximum(vectors.sum(0), 1) * shards
    room = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), "i8")
    for k, part in enumerate(parts):
        out[k] = best = int(np.argmax(room @ part))
        room[best] -= part
    return out


def _heavy_groups(measured: DataFrame, totals: dict[str, int], shards: int) -> DataFrame:
    """(GROUP, group, pieces, parts): groups that are placed by themselves, numbered, with the pieces they are cut into
    and the cells that a piece's rows are numbered in. At most 3 * shards * PARTS rows, as each takes so much of a total."""
    groups = measured.groupBy(*GROUP, "tokens").agg(F.count("*").alias("n_rows"))
    share = F.greatest(*[F.col("n_rows") * (F.lit(1) if m == "n_rows" else F.col(m)) / F.lit(float(max(totals[m], 1))) for m in MEASURES]) * shards
    heavy = groups.withColumn("share", share).where(F.col("share") * PARTS >= 1).collect()
    rows = []
    for number, r in enumerate(sorted(heavy, key=lambda r: [r[c] for c in GROUP])):
        pieces = -int(-r["share"] * PIECES // 1) if r["share"] > WHOLE and r["n_rows"] > 1 else 1
        rows.append([*[r[c] for c in GROUP], number, pieces, max(1, -(-r["n_rows"] * CELLS // (totals["n_rows"] * pieces)))])
    return measured.sparkSession.createDataFrame(rows, "g1 long, g2 long, size long, text_crc32 long, group long, pieces long, parts long")


def _cells(measured: DataFrame, totals: dict[str, int], shards: int, id_col: str) -> DataFrame:
    """``measured`` with ``unit``, what is placed together, and ``cell``, what is numbered together."""
    heavy = F.broadcast(_heavy_groups(measured, totals, shards))  # at most 3 * shards * PARTS rows
    deal = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(11)), F.col("pieces") * F.col("parts"))
    bundle = F.floor(F.log2(F.col("size").cast("double"))) * BUNDLES + F.pmod("g1", F.lit(BUNDLES))
    joined = measured.join(heavy, GROUP, "left").withColumn("__deal", deal)
    # numbers below zero are bundles; a group has 2^20 pieces and 2^20 cells at most: pieces are below 16 * 16 + 1, cells as few as rows by 4,096ths
    return joined.withColumns({
        "unit": F.coalesce(F.col("group") * (1 << 20) + F.floor(F.col("__deal") / F.col("parts")), -bundle - 1),
        "cell": F.coalesce(F.col("group") * (1 << 20) + F.col("__deal"), -bundle - 1)}).drop("group", "pieces", "parts", "__deal", "g1", "g2")


def _placed(cells: list, shards: int) -> list[tuple[int, int, int]]:
    """(cell, shard, rows of the shard before the cell): units by falling share of their greatest measure."""
    numbers, at = np.unique([c["unit"] for c in cells], return_inverse=True)
    vectors = np.zeros((len(numbers), len(MEASURES)))
    np.add.at(vectors, at, [[c[m] for m in MEASURES] for c in cells])
    order = np.lexsort((numbers, -(vectors / np.maximum(vectors.sum(0), 1)).max(1)))
    shard = np.zeros(len(numbers), "i8")
    shard[order] = place(vectors[order], shards)
    filled, out = [0] * shards, []
    for c, k in sorted(zip(cells, shard[at].tolist()), key=lambda x: (x[1], x[0]["cell"])):
        out.append((c["cell"], k, filled[k]))
        filled[k] += c["n_rows"]
    return out


def assign(docs: DataFrame, shards: int = SHARDS, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, tokens, shard, slot) for every row: shards near equal in bytes, tokens and rows, and the place in the shard from 0.

    Equal texts are a group, whose vector is its rows' bytes, tokens and number; it stays in one shard unless it has more than WHOLE of
    a shard's fair share in a measure, in which case its rows are dealt into equal pieces by hash of the id. Groups below 1 / PARTS of a
    share go in bundles of texts of like size, by hash of the text. Groups, pieces and bundles are placed by :func:`place`, the largest first.
    So what one place decides is bounded whatever the input: 3 * shards * PARTS groups, three times shards * PIECES pieces and, for
    each doubling of text sizes, BUNDLES bundles; only their sums reach the driver, and each cell's shard is sent back by broadcast.

    Slots follow cell, id and text; only narrow rows are shuffled, once by group with partial sums and once by cell. Null texts are
    empty; null ids are one id; rows that repeat id and text stay in one cell, each with its own slot; one row that is larger than a share
    tips its shard. The result doesn't depend on partitioning. Other columns may have any name. An empty table gives an empty one.
    """
    measured = materialize(measures(docs, path, id_col, text_col), "measures")
    sums = measured.agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES[:2]]).first().asDict()
    dealt = _cells(measured, sums, shards, id_col)
    cells = dealt.groupBy("unit", "cell").agg(F.count("*").alias("n_rows"), F.sum("size").alias("size"), F.sum("tokens").alias("tokens")).collect()
    places = docs.sparkSession.createDataFrame(_placed(cells, shards) if cells else [], "cell long, shard int, first long")
    within = Window.partitionBy("cell").orderBy(id_col, "text_crc32", "size", "tokens")
    numbered = dealt.withColumn("slot", F.row_number().over(within).cast("long") - 1).join(F.broadcast(places), "cell")  # bounded as the cells are
    return numbered.select(id_col, "size", "text_crc32", "tokens", "shard", (F.col("slot") + F.col("first")).alias("slot"))


def totals(assigned: DataFrame) -> DataFrame:
    """(shard, n_rows, size, tokens), to see how near the shards are."""
    return assigned.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("size"), F.sum("tokens").alias("tokens"))
