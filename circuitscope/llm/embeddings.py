"""Embedding near-duplicates: random-hyperplane signatures in several tables, exact cosine, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import materialize
from .components import connected_components

#: Tables, and sign bits of a table's key. A pair at cosine 0.98 agrees in a bit with probability 0.936, in a
#: key with 0.27, and in one of 24 keys or more with 0.9995. More bits suit more vectors, with more tables.
TABLES, BITS = 24, 20
#: A bucket is compared in pairs of chunks of about so many vectors, so no task holds more than two; a vector of a bucket
#: of n is sent n / CHUNK times.
CHUNK = 1024
SEED = 20_221


def planes(dims: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).standard_normal((dims, TABLES * BITS))


def _usable(vector: Column) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & ok & F.exists(vector, lambda x: x != 0)


def _signatures(classes: DataFrame) -> DataFrame:
    """(rep, label, vector, copies, keys): the key of each vector in each table."""
    weights = (1 << np.arange(BITS)).astype("i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column("vector")
            sizes = np.diff(lists.offsets.to_numpy())
            flat, keys = lists.flatten().to_numpy(zero_copy_only=False), np.zeros((len(batch), TABLES), "i8")
            first = np.cumsum(sizes) - sizes
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                vectors = flat[first[rows, None] + np.arange(dims)]
                if dims not in drawn:
                    drawn[dims] = planes(int(dims))
                keys[rows] = ((vectors @ drawn[dims]) > 0).reshape(len(rows), TABLES, BITS) @ weights
            yield pa.record_batch([*batch.columns, pa.array(list(keys), pa.list_(pa.int64()))], [*batch.schema.names, "keys"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{kinds}, keys array<bigint>")


#: What makes a part of a bucket: the vectors of one label and length that share a table's key, and two of their chunks.
PART = ["tag", "dims", "t", "key", "low", "high"]


def _tag(rows: DataFrame) -> Column:
    """The label as a value that Arrow compares as Spark does: NaN is equal to itself, nested values go as JSON."""
    kind = rows.schema["label"].dataType
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.to_json(F.struct("label"))
    return F.col("label").cast("string") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col("label")


def _changes(table: pa.Table) -> np.ndarray:
    """For each row but the first whether it is of another part than the one before it."""
    found = np.zeros(max(len(table) - 1, 0), bool)
    for name in PART:
        column = table.column(name)
        found |= pc.not_equal(column.slice(1), column.slice(0, len(found))).to_numpy()
    return found


def _verify(threshold: float):
    """Compare within each run of rows of one bucket part; rows come sorted by all that makes a part, so a shared hash joins none."""
    def links(part: pa.RecordBatch | pa.Table) -> tuple[list, list, list]:
        vectors = np.stack(part.column("vector").to_pylist())
        keys = np.stack(part.column("keys").to_pylist())
        rep, copies = part.column("rep").to_numpy(), part.column("copies").to_numpy()
        side = part.column("side").to_numpy()
        table = part.column("t")[0].as_py()
        norms = np.linalg.norm(vectors, axis=1)
        near = (vectors @ vectors.T) / np.outer(norms, norms) >= threshold
        for t in range(table):  # an earlier table has this pair
            near &= keys[:, t, None] != keys[None, :, t]
        if part.column("cross")[0].as_py():  # two chunks: each has a part of its own for its own pairs
            near &= side[:, None] != side[None, :]
        np.fill_diagonal(near, False)
        root = np.arange(len(rep))
        while True:
            least = np.minimum(root, np.where(near, root[None, :], len(rep)).min(1))
            if (least == root).all():
                break
            root = least
        return rep.tolist(), (near @ copies).tolist(), rep[root].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            cuts = np.concatenate([[0], np.flatnonzero(_changes(table)) + 1])
            yield from found([table.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])])
            rest = table.slice(cuts[-1]).combine_chunks() if len(table) else None
        if rest is not None and len(rest):
            yield from found([rest])

    def found(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = [x for part in parts if len(part) > 1 for x in zip(*links(part)) if x[1]]
        if rows:
            reps, n, roots = zip(*rows)
            yield pa.record_batch([pa.array(reps, pa.int64()), pa.array(n, pa.int64()), pa.array(roots, pa.int64())], ["rep", "n", "root"])

    return run


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.98) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row.

    Vectors with equal, non-null labels and the same number of components are linked if their cosine in double precision
    is ``threshold`` or more; pairs below are never linked, pairs above are found if they share a key in one
    of the tables. Vectors that are null, zero or hold null or non-finite components, rows with a null label
    and rows with a null id link with nothing. Equal vectors of a label are one class from the start: their
    links are counted, not listed. Each pair is verified once, in the first table that has it in one bucket;
    large buckets are compared chunk by chunk. Repeated rows count as other vectors.
    """
    vector = F.col(vector_col).cast("array<double>")
    known = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vector.alias("vector"))
    usable = known.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector")))
    classes = materialize(_signatures(usable.groupBy("label", "vector").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"))), "classes")

    entered = classes.select("rep", "label", F.size("vector").alias("dims"), F.posexplode("keys").alias("t", "key"))
    bucket = ["label", "dims", "t", "key"]
    shared = entered.join(entered.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1"), bucket)
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(1)), chunks).cast("int")
    # each chunk meets itself and every other chunk of its bucket in a part of its own
    parts = (shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
             .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
             .select("rep", _tag(shared).alias("tag"), "dims", "t", "key", "low", "high", F.col("own").alias("side"),
                     (F.col("low") < F.col("high")).alias("cross")))
    members = parts.join(classes.select("rep", "vector", "copies", "keys"), "rep")
    links = materialize(members.repartition(*PART).sortWithinPartitions(*PART).mapInArrow(
        _verify(threshold), "rep long, n long, root long"), "links")
    components = connected_components(links.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    named = (classes.select("label", "vector", "rep", "copies").join(counts, "rep", "left")
             .join(components.withColumnRenamed("node", "rep"), "rep", "left")
             .select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    linked = usable.join(named, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = known.where(~(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(_usable(F.col("vector")), F.lit(False))))
    return linked.union(alone.select("id", F.lit(0).cast("long"), "id")).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
