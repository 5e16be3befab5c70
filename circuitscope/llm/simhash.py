"""SimHash near-duplicate detection by multi-index hashing."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import Scratch, materialize
from .components import connected_components

#: Fingerprints are hashed and cut as two segments of 32 bits.
BITS, SEGMENTS = 64, 2
#: The most differing bits of a link: twice what one segment's meeting balls can bridge.
MAX_BITS = 4
#: Shingle hashes that are turned into bits at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = 4, lower: bool = True) -> int:
    """The unsigned 64-bit fingerprint of one text (the whole of it).

    Shingles are runs of ``shingle_words`` words joined by a space, repeats included; fewer words make
    one shingle, none (or a null text) make fingerprint zero. A bit is set if over half the shingles'
    XXH64 values (seed 42) have it. Only A-Z are lower-cased.
    """
    raw = (text or "").encode()
    words = (raw.lower() if lower else raw).split()  # bytes.split parts at exactly \x20 and \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(words) - shingle_words + 1)
    last = ends[min(shingle_words, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[s:e], 42) for s, e in zip(starts, last)), "<u8", n)
    ones = np.zeros(BITS, "i8")
    for k in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[k:k + CHUNK].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """(id_col, fp BIGINT holding the 64 bits). Other columns of ``docs`` are not read."""
    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle_words) for t in batch.column(1)], "<u8").view("<i8")
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], [id_col, "fp"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def ball(column, bits: int):
    """The values within one bit of a segment's value, itself included."""
    return [column] + [column.bitwiseXOR(F.lit(1 << b)) for b in range(bits)]


def hamming_links(fps: DataFrame, crowd: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """Links (src, dst) that connect exactly those distinct fingerprints ``fp`` that chains of steps of
    at most four differing bits connect.

    Of two 32-bit segments one holds at most two of four differing bits, and then the two one-bit
    Hamming balls around that segment's values share a value. So each fingerprint is entered under the
    66 values of its balls, and the members of a value are verified by their complete distances.
    Values that more than ``crowd`` fingerprints share (large groups of near copies) would give a
    number of pairs that grows with the square of the group. Their members are entered instead under
    all 2,081 values within two bits of the complete fingerprint: two fingerprints within four bits
    share such a value, and, by the triangle inequality, all that share one are within four bits, so a
    link of each to the smallest is right and enough.
    """
    width = BITS // SEGMENTS
    keys = [key.bitwiseOR(F.lit(s << width))
            for s in range(SEGMENTS)
            for key in ball(F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit((1 << width) - 1)), width)]
    entered = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    scratch = scratch or Scratch(fps.sparkSession)
    # copies are one row and a fingerprint has 66 values, so no value holds a large share: one shuffle and a sort count them
    shared = scratch.table(entered.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"), "hamming")
    pairs = (shared.where(F.col("n") <= crowd).groupBy("key").agg(F.collect_list("fp").alias("fps"))
             .select(F.explode(F.expr(f"""flatten(transform(fps, (x, i) -> transform(
                 filter(slice(fps, i + 2, size(fps)), y -> bit_count(x ^ y) <= {MAX_BITS}),
                 y -> struct(least(x, y) AS src, greatest(x, y) AS dst))))""")).alias("p"))
             .select("p.src", "p.dst").distinct())
    crowded = shared.where(F.col("n") > crowd).select("fp").distinct()
    masks = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) * (b == 63)) for b in range(BITS)])
    near = (crowded.withColumn("m", masks)
            .select("fp", F.explode(F.expr("""concat(array(fp), flatten(transform(sequence(0, 63), i ->
                 transform(sequence(i + 1, 64), j -> fp ^ m[i] ^ m[j]))))""")).alias("z")))
    stars = (near.select(F.col("fp").alias("dst"), F.min("fp").over(Window.partitionBy("z")).alias("src"))
             .where("src != dst").select("src", "dst").distinct())
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = 4) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint``: 16 lower-case hex digits. ``component_id``: the smallest id reachable over
    fingerprints that differ in four bits or less, itself included. Equal fingerprints are one
    node from the start, so thousands of exact copies cost one row in the search. Null and empty texts
    have fingerprint zero and are linked like any other; repeated rows stay repeated; null ids are
    linked but never name a component unless nothing else is in it; an empty table gives an empty one.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle_words).withColumnRenamed(id_col, "__id"), "fps")
    classes = fps.groupBy("fp").agg(F.min("__id").alias("rep"))
    scratch = Scratch(docs.sparkSession)
    found = connected_components(hamming_links(classes.select("fp"), scratch=scratch))
    scratch.drop()
    linked = classes.join(found.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    names = linked.join(least, "component").select("fp", "component_id")
    return (fps.join(classes.join(names, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "fp")
            .select(F.col("__id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))
