"""SimHash near-dedup by similarity of word shingles: wide fingerprints find candidates, the shingle sets themselves decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import Scratch, materialize
from .components import connected_components
from .simhash import ball
from .words import IN_WORD, Texts, find_words, hash_words, mix, pair_hash, slices

#: Texts are linked if the Jaccard similarity of their shingle sets is this or more, and the share of
#: fingerprint bits in which sets of that similarity are expected to differ.
SIMILARITY = 0.8
SHARE = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
#: A sketch of 24 bits of a fingerprint and the size of the set (on a scale of powers of 1.1) drops most chance
#: meetings before complete fingerprints are fetched: sets of similarity 0.8 differ in over SKETCH_BITS of the
#: bits with a chance of 0.0001, and never by more than SIZE_STEPS in size.
SKETCH_BITS, SIZE_STEPS = 10, 3
#: Members of a crowded value are gathered at a hub whose fingerprint differs in this share of bits or less.
HUB_SHARE = 0.4
#: The rows of a hub are compared in pairs of chunks of so many texts or bytes of shingles.
CHUNK, CHUNK_BYTES = 512, 4 << 20


@dataclass(frozen=True)
class Tables:
    """How fingerprints are cut for the tables: so many segments of so many bits, each entered with all values of its one-bit
    Hamming ball, so that texts within two bits in a segment meet."""

    segments: int
    width: int

    @property
    def words(self) -> int:
        return -(-self.segments * self.width // 64)

    @property
    def limit(self) -> int:
        """Differing bits of a candidate: three standard deviations above what SIMILARITY makes expected."""
        bits = 64 * self.words
        return math.ceil(bits * SHARE + 3 * math.sqrt(bits * SHARE * (1 - SHARE)))


def tables_for(texts: int) -> Tables:
    """Segments wide enough that values are entered about once by chance, and so many that similarity 0.8 meets in one or
    more with probability 0.95 or more (0.85: 0.99). A segment of w bits differs in two bits or less with the chance
    of the binomial law with SHARE."""
    width = 24
    while texts * (width + 1) > 1 << width and width < 40:
        width += 4
    miss = 1 - sum(math.comb(width, k) * SHARE**k * (1 - SHARE)**(width - k) for k in range(3))
    return Tables(math.ceil(math.log(0.05) / math.log(miss)), width)


def shingle_sets(texts: Texts, shingle_words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of each text's distinct shingles in rising order, text by text, and the number of each one's text."""
    words = find_words(texts, IN_WORD)
    hashes = hash_words(texts, words)
    n = len(hashes)
    shingle, text = hashes, words.text
    for k in range(1, shingle_words):
        shingle = pair_hash(shingle[:max(0, n - k)], hashes[k:])
    inside = words.text[:len(shingle)] == words.text[n - len(shingle):]
    shingle, text = shingle[inside], words.text[:len(inside)][inside]
    begins = np.cumsum(words.counts) - words.counts
    short = np.flatnonzero((words.counts > 0) & (words.counts < shingle_words))
    alone = []
    for i in short:  # fewer words make one shingle
        h = hashes[begins[i]]
        for k in range(1, words.counts[i]):
            h = pair_hash(np.array([h]), hashes[begins[i] + k:begins[i] + k + 1])[0]
        alone.append(h)
    shingle = np.concatenate([shingle, np.array(alone, "u8")])
    text = np.concatenate([text, short])
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    return shingle[new], text[new]


def wide_fingerprints(texts: Texts, words: int, shingle_words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a slice ``words`` times 64 bits, set where over half its distinct shingles have them; and how many it has."""
    shingle, text = shingle_sets(texts, shingle_words)
    out, sizes = np.zeros((len(texts), words), "u8"), np.bincount(text, minlength=len(texts))
    there, first, counts = np.unique(text, return_index=True, return_counts=True)
    if not len(there):
        return out, sizes
    for k in range(words):
        bits = mix(shingle + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))).view("u1").reshape(-1, 8)
        ones = np.add.reduceat(np.unpackbits(bits, axis=1, bitorder="little"), first, axis=0, dtype="i4")
        out[there, k] = np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out, sizes


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, tables: Tables) -> DataFrame:
    """(id, fp, segments, sketch) of every row with an id."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.ArrayType(T.LongType())),
                           T.StructField("segments", T.ArrayType(T.LongType())), T.StructField("sketch", T.IntegerType())])
    cut = tables.segments * tables.width
    weights = 1 << np.arange(tables.width, dtype="i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1), lower=True):
                fps, sizes = wide_fingerprints(texts, tables.words, shingle_words)
                steps = np.minimum(np.log(np.maximum(sizes, 1)) / np.log(1.1), 127).astype("i4")  # up to 180,000 shingles; one step beyond
                sketch = (fps[:, -1] >> np.uint64(40)).astype("i4") | steps << 24
                bits = np.unpackbits(fps.view("u1").reshape(len(fps), -1), axis=1, bitorder="little")[:, :cut]
                segments = bits.reshape(len(fps), tables.segments, tables.width) @ weights
                yield pa.record_batch([batch.column(0).slice(first, len(texts)), pa.array(list(fps.view("i8")), pa.list_(pa.int64())),
                                       pa.array(list(segments), pa.list_(pa.int64())), pa.array(sketch, pa.int32())], schema.names)

    return docs.where(F.col(id_col).isNotNull()).select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def _differing(a: str, b: str, tables: Tables) -> Column:
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(tables.words)), F.lit(0))


def _close(a: str, b: str) -> str:
    low = (1 << 24) - 1
    return f"(bit_count(({a} ^ {b}) & {low}) <= {SKETCH_BITS} AND abs(shiftright({a}, 24) - shiftright({b}, 24)) <= {SIZE_STEPS})"


def _hubs(crowded: DataFrame, classes: DataFrame, tables: Tables, scratch: Scratch) -> DataFrame:
    """(rep, hub) of the members of crowded values that have a hub: of the values' leaders that their sketches are close
    to, the one with the most copies, or that one's own, or that one's; never one with a fingerprint beyond HUB_SHARE.

    A hub only says which texts are compared together, so a poor choice costs time and no link.
    """
    near = F.when(F.expr(_close("s", "l.s")), F.col("l"))
    own = scratch.table(crowded.groupBy("rep").agg(F.min(near).alias("l")).where("l is not null").select("rep", F.col("l.rep").alias("h1")), "hubs")
    chain = own
    for k in (1, 2):
        chain = chain.join(own.select(F.col("rep").alias(f"h{k}"), F.col("h1").alias(f"h{k + 1}")), f"h{k}", "left")
    for side in ("rep", "h1", "h2", "h3"):
        chain = chain.join(classes.select(F.col("rep").alias(side), F.col("fp").alias(f"fp_{side}")), side, "left")
    most, hub = int(HUB_SHARE * 64 * tables.words), F.lit(None).cast(classes.schema["rep"].dataType)
    for side in ("h1", "h2", "h3"):
        hub = F.when(_differing("fp_rep", f"fp_{side}", tables) <= most, F.col(side)).otherwise(hub)
    return chain.select("rep", hub.alias("hub")).where("hub is not null")


def _sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """(id, shingles) of the wanted documents: the sorted hashes of the distinct shingles, little-endian.
    A repeated id has a row for each of its sets."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1), lower=True):
                shingle, text = shingle_sets(texts, shingle_words)
                at = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
                yield pa.record_batch([batch.column(0).slice(first, len(texts)), pa.array(
                    [shingle[a:b].astype("<u8").tobytes() for a, b in zip(at, at[1:])], pa.binary())], schema.names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("__text")).join(wanted, "id", "left_semi")
    return rows.mapInArrow(run, schema).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst) of which the shingle sets have a Jaccard similarity of SIMILARITY or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                total = len(a) + len(b)
                both = total - len(np.union1d(a, b))
                keep.append(both >= SIMILARITY * (total - both))
            yield pa.record_batch([batch.column("src"), batch.column("dst")], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    both = (pairs.select("src", "dst").join(sets.select(F.col("id").alias("src"), F.col("shingles").alias("x")), "src")
            .join(sets.select(F.col("id").alias("dst"), F.col("shingles").alias("y")), "dst"))
    return both.mapInArrow(run, pairs.select("src", "dst").schema).distinct()


def links_within(ids: np.ndarray, sets: list[np.ndarray], resolved: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """Links (a, b), as places, that connect what similarity connects among sets of which some are ``resolved``: these are in one
    component already, so only the others are compared, with all. With ``side`` only across its two values."""
    sizes = np.array([len(x) for x in sets])
    filled = np.flatnonzero(sizes > 0)
    root = np.arange(len(ids))
    if resolved.any():
        root[resolved] = np.flatnonzero(resolved)[0]
    _, values = np.unique(np.concatenate([*sets, np.zeros(0, "u8")]), return_inverse=True)
    begins = (np.cumsum(sizes) - sizes)[filled]
    mark, links = np.zeros(len(values) + 1, bool), []
    starts = np.cumsum(sizes) - sizes
    for a in np.flatnonzero(~resolved & (sizes > 0)):
        own = values[starts[a]:starts[a] + sizes[a]]
        mark[own] = True
        both = np.add.reduceat(mark[values], begins, dtype="i8")
        mark[own] = False
        near = filled[both >= SIMILARITY * (sizes[a] + sizes[filled] - both)]
        if side is not None:
            near = near[side[near] != side[a]]
        for b in near[root[near] != root[a]]:
            if root[b] != root[a]:
                links.append((int(a), int(b)))
                root[root == root[b]] = root[a]
    return links


def _links_at_hubs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(src, dst): links that connect what similarity connects among each hub's members (hub, rep, resolved).

    No pairs are emitted: the members, with their sets, meet chunk by chunk, and each task compares one pair of chunks.
    Those that a verified link connects to the hub (``resolved``) are compared only with those that none does.
    """
    rows = members.join(sets.select(F.col("id").alias("rep"), "shingles"), "rep").withColumn("bytes", F.length("shingles"))
    plan = rows.groupBy("hub", "resolved").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("bytes") / CHUNK_BYTES)).cast("int").alias("chunks"))
    plan = plan.groupBy("hub").agg(F.coalesce(F.max(F.when(F.col("resolved"), F.col("chunks"))), F.lit(0)).alias("done"),
                                   F.coalesce(F.max(F.when(~F.col("resolved"), F.col("chunks"))), F.lit(0)).alias("open")).where("open > 0")
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.when(F.col("resolved"), F.col("done")).otherwise(F.col("open"))).cast("int")
    own = F.when(F.col("resolved"), F.col("open") + own).otherwise(own)  # chunks of open members come first
    # an open chunk meets itself and every other chunk; a chunk of resolved members every open one
    last = F.when(F.col("resolved"), F.col("open") - 1).otherwise(F.col("open") + F.col("done") - 1)
    parts = (rows.join(plan, "hub").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
             .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
             .select("rep", "resolved", "shingles", F.xxhash64("hub", "low", "high").alias("part"), (F.col("own") == F.col("low")).alias("side"),
                     (F.col("low") < F.col("high")).alias("cross")))
    kind = members.schema["rep"].dataType
    schema = T.StructType([T.StructField("src", kind), T.StructField("dst", kind)])

    def found(part: pa.Table) -> pa.RecordBatch:
        ids = part.column("rep").combine_chunks()
        links = links_within(np.arange(len(ids)), [np.frombuffer(x, "<u8") for x in part.column("shingles").to_pylist()],
                             part.column("resolved").to_numpy(), part.column("side").to_numpy() if part.column("cross")[0].as_py() else None)
        a, b = (pa.array([x[k] for x in links], pa.int64()) for k in (0, 1))
        return pa.record_batch([ids.take(a), ids.take(b)], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            part = table.column("part").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
            yield from (found(table.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:]))
            rest = table.slice(cuts[-1]).combine_chunks() if len(table) else None
        if rest is not None and len(rest):
            yield found(rest)

    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, crowd: int = 4,
                      tables: Tables | None = None) -> DataFrame:
    """(id_col, component_id) of each document that is linked to another: near copies on word shingles.

    Links join documents whose sets of ``shingle_words``-word shingles (A-Z and other letters in lower case) have a
    Jaccard similarity of SIMILARITY or more. Nothing else links: candidates are found by multi-index hashing of
    fingerprints (see :class:`Tables`), those within the limit of differing bits are compared by their sets.

    Values that more than ``crowd`` fingerprints share come from large groups of near copies, whose pairs grow with the
    square of the group. Their members are gathered at a hub, commonly the most copied text of the group. Each
    member is compared with its hub; then those that are not linked to it are compared with all of the hub's
    members, in tasks that hold two chunks of them and give out links only. Pairs are made only in small values, and by the few members
    that are at another hub than the value's leader.

    Documents with equal fingerprints are one class from the start, as are all without a word. Null ids link with nothing.
    A repeated id is one document with all its texts. Other columns of ``docs`` are not read; an empty table gives an empty one.
    """
    if tables is None:
        tables = tables_for(docs.count())
    scratch = Scratch(docs.sparkSession)
    rows = materialize(_fingerprints(docs, id_col, text_col, shingle_words, tables), "wide")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").cast("int").alias("copies"),
                                                 F.first("segments").alias("segments"), F.min("sketch").alias("s")), "classes")
    keys = F.flatten(F.transform("segments", lambda x, i: F.array(
        *[k.bitwiseOR(F.shiftleft(i.cast("long"), tables.width)) for k in ball(x, tables.width)])))
    # Copies are one row and a text has hundreds of values, so no value holds a large share of these rows: one shuffle and a
    # sort, which spills, count them in less memory than a hash join does
    entered = classes.select("rep", "copies", "s", F.explode(keys).alias("key"))
    value = Window.partitionBy("key")
    shared = scratch.table(entered.withColumn("n", F.count("*").over(value)).withColumn(
        "l", F.min(F.struct((-F.col("copies")).alias("c"), "rep", "s")).over(value)).where("n > 1"), "shared")
    few = (shared.where(F.col("n") <= crowd).groupBy("key").agg(F.collect_list(F.struct("rep", "s")).alias("m"))
           .select(F.explode(F.expr(f"""flatten(transform(m, (x, i) -> transform(
               filter(slice(m, i + 2, size(m)), y -> {_close("x.s", "y.s")}),
               y -> struct(least(x.rep, y.rep) AS src, greatest(x.rep, y.rep) AS dst))))""")).alias("p")).select("p.src", "p.dst"))
    crowded = shared.where(F.col("n") > crowd)
    hubs = scratch.table(_hubs(crowded, classes, tables, scratch), "hubs")

    # Members that are at another hub than their value's leader, against the value's other members, unless these are at
    # their own hub. Which entries these are is marked by a union and an aggregate; all others are at the leader's hub.
    led = crowded.select("rep", F.col("l.rep").alias("leader")).distinct()
    at = led.join(hubs.withColumnRenamed("rep", "leader"), "leader", "left").withColumn("hub", F.coalesce("hub", "leader")).where("rep != hub")
    away = at.join(hubs, ["rep", "hub"], "left_anti").select("rep", "leader").join(hubs, "rep", "left").select("rep", "leader", F.coalesce("hub", "rep").alias("hub"))
    apart = scratch.table(crowded.select("key", "rep", "s", F.col("l.rep").alias("leader")).join(scratch.table(away, "away"), ["rep", "leader"])
                          .select("key", F.col("rep").alias("r2"), F.col("s").alias("s2"), F.col("hub").alias("h2")), "apart")
    marked = (crowded.select("key", "rep", "s", F.lit(None).cast(classes.schema["rep"].dataType).alias("hub")).union(apart)
              .groupBy("key", "rep", "s").agg(F.max("hub").alias("hub")))
    others = F.col("hub").isNull() | ((F.col("hub") != F.col("h2")) & (F.col("rep") < F.col("r2")))
    across = (marked.join(apart, "key").where(others & (F.col("rep") != F.col("r2")) & F.expr(_close("s", "s2")))
              .select(F.least("rep", "r2").alias("src"), F.greatest("rep", "r2").alias("dst")))

    of = classes.select("rep", "fp").join(hubs, "rep", "left")
    pairs = (few.union(across).distinct()
             .join(of.select(F.col("rep").alias("src"), F.col("fp").alias("a"), F.col("hub").alias("ha")), "src")
             .join(of.select(F.col("rep").alias("dst"), F.col("fp").alias("b"), F.col("hub").alias("hb")), "dst")
             .where((_differing("a", "b", tables) <= tables.limit) & ~F.coalesce(F.coalesce("ha", "src") == F.coalesce("hb", "dst"), F.lit(False)))
             .select("src", "dst"))
    spokes = hubs.where("hub != rep").select(F.col("hub").alias("src"), F.col("rep").alias("dst"))
    pairs = scratch.table(pairs.union(spokes).distinct(), "pairs")
    sets = scratch.table(_sets(pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct(), docs, id_col, text_col, shingle_words), "sets")
    links = scratch.table(_verified(pairs, sets), "links")
    members = spokes.join(links.withColumn("resolved", F.lit(True)), ["src", "dst"], "left").select(
        F.col("src").alias("hub"), F.col("dst").alias("rep"), F.coalesce("resolved", F.lit(False)).alias("resolved"))
    more = scratch.table(_links_at_hubs(members, sets), "links")
    components = connected_components(links.union(more))
    scratch.drop()
    found = (classes.join(components.withColumnRenamed("node", "rep"), "rep", "left")
             .where(F.col("component").isNotNull() | (F.col("copies") > 1)).select("fp", F.coalesce("component", "rep").alias("component_id")))
    return rows.select(F.col("id").alias(id_col), "fp").join(found, "fp").select(id_col, "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5) -> DataFrame:
    """``docs`` without near copies: of each group the document of the smallest id stays, with all columns.

    Rows that repeat an id stay or go together; rows of null id stay.
    """
    found = similar_documents(docs, id_col, text_col, shingle_words)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col)
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
