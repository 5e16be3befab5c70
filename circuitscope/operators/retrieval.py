"""Retrieval of similar past examples, without their answers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import scalars as S

#: A block has at most so many requests or rows, and so many numbers in all.
MAX_REQUESTS, MAX_NUMBERS = 1 << 16, 1 << 19
#: Rows are dealt out in so many blocks or more if that leaves MIN_BLOCK in each, so that few queries keep all tasks busy too.
MIN_BLOCKS, MIN_BLOCK = 16, 1024
#: Blocks meet in at most so many tasks.
MAX_TASKS = 1024
#: At most so many queries and rows are held against each other at once: their distances stay in a core's cache.
_TILE = (32, 1024)


def prompt_safe(record_input: Column) -> Column:
    """What of a past record's input may be shown: named fields only, so targets, evaluations and circuit text stay behind."""
    circuit = record_input["circuit"]
    return F.struct(
        record_input["objective"].alias("objective"), record_input["user_constraints"].alias("user_constraints"),
        F.struct(circuit["name"].alias("name"), circuit["summary"].alias("summary"), circuit["features"]["by_name"].alias("features")).alias("circuit"),
        F.transform(record_input["compatible_backends"], lambda b: F.struct(
            b["id"].alias("id"), b["num_qubits"].alias("num_qubits"), b["operation_names"].alias("operation_names"))).alias("compatible_backends"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, none null, as columns."""
    numbers = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(numbers.reshape(len(column), len(numbers) // len(column)).T)


def _distances(asked: np.ndarray, rows: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Mean relative differences of all pairs of columns, summed in the order of the numbers; vectors without numbers are at distance 0."""
    total, difference, greater = space[:, :asked.shape[1], :rows.shape[1]]
    total[:] = 0.0
    for a, b in zip(asked, rows):
        np.abs(np.subtract(a[:, None], b, out=difference), out=difference)
        np.maximum(np.abs(a)[:, None], np.abs(b), out=greater)
        greater += 1
        difference /= greater
        total += difference
    if len(asked):
        total /= len(asked)
    return total


def _tiles(vectors: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the columns in parts of at most ``most``, cut at the median of the widest number, so that parts are near in all numbers."""
    parts, left = [], [np.arange(vectors.shape[1])]
    while left:
        at = left.pop()
        if len(at) <= most or not len(vectors):
            parts += [at[i:i + most] for i in range(0, len(at), most)]
            continue
        low, high = vectors[:, at].min(axis=1), vectors[:, at].max(axis=1)
        by = np.argpartition(vectors[np.argmax((high - low) / (1 + np.maximum(np.abs(low), np.abs(high)))), at], len(at) // 2)
        left += [at[by[len(at) // 2:]], at[by[:len(at) // 2]]]
    return parts


def _least(few: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each box (a column of ``low`` and ``high``) a distance that no column of ``few`` is below to anything in it."""
    if not len(few):
        return np.zeros(low.shape[1])
    first, last = few.min(axis=1)[:, None], few.max(axis=1)[:, None]
    gap = np.maximum(0, np.maximum(low - last, first - high))
    greatest = np.maximum(np.maximum(np.abs(low), np.abs(high)), np.maximum(np.abs(first), np.abs(last)))
    return np.nan_to_num((gap / (1 + greatest)).mean(axis=0) * (1 - 1e-9), nan=0.0)  # a little less, for rounding


def _nearest(asked: np.ndarray, rows: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the ``k`` nearest rows of every query, ties by ``order``; a distance that is no number comes last.

    Tiles of near rows are met in the order of the least distance that they can have; those beyond the ``k`` that a tile of queries has found are left out.
    """
    found, space = [], np.empty((3, *_TILE))
    with np.errstate(invalid="ignore", over="ignore"):
        tiles = _tiles(rows, _TILE[1])
        parts = [np.ascontiguousarray(rows[:, at]) for at in tiles]
        low, high = (np.stack([limit(part, axis=1) for part in parts], axis=1) for limit in (np.min, np.max))
        for members in _tiles(asked, _TILE[0]):
            few = np.ascontiguousarray(asked[:, members])
            query, row, distance = np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0)
            bound = np.full(len(members), np.nan)  # nothing is above it
            least = _least(few, low, high)
            for n, j in enumerate(np.argsort(least, kind="stable")):
                if least[j] > bound.max():
                    break
                d = _distances(few, parts[j], space)
                if n == 0 and d.shape[1] >= k:
                    bound = np.partition(d, k - 1, axis=1)[:, k - 1]
                at = np.nonzero(~(d > bound[:, None]))
                if not len(at[0]):
                    continue
                query, row, distance = np.concatenate([query, at[0]]), np.concatenate([row, tiles[j][at[1]]]), np.concatenate([distance, d[at]])
                by = np.lexsort((order[row], distance, query))
                query, row, distance = query[by], row[by], distance[by]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                last, kept = place == k - 1, place < k
                bound[query[last]] = distance[last]
                query, row, distance = query[kept], row[kept], distance[kept]
            found.append((members[query], row, distance))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _ranked(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query, rank, row, distance) of the ``k`` rows nearest to each query of their group and length; ties go to the smaller row id.

    Both have group, id and vector (array<double>, without nulls). Every query meets every row of its group: queries and rows are dealt out in blocks by their ids,
    a task holds one block of each and passes on at most ``k`` rows of a query. Blocks have a bounded size, so more rows make more of them. Of rows of one
    vector only the ``k`` of the smallest ids can be among the nearest, so others aren't met.
    """
    first = F.row_number().over(Window.partitionBy("group", "vector").orderBy("id"))
    rows = rows.withColumn("__copy", first).where(F.col("__copy") <= k).drop("__copy")
    size = F.max(F.size("vector")).alias("size")
    (n_asked, longest), (n_rows, _) = (tuple(side.agg(F.count("*"), size).first()) for side in (asked, rows))
    most = max(1, min(MAX_REQUESTS, MAX_NUMBERS // max(longest or 1, 1)))
    asked_blocks, row_blocks = max(1, -(-2 * n_asked // most)), max(1, -(-n_rows // most), min(MIN_BLOCKS, n_rows // MIN_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["group", "length", "a", "b"]
    # a fixed number of tasks: by bytes, which are few, Spark would put the blocks into one to three
    tasks = min(MAX_TASKS, 2 * asked_blocks * row_blocks)
    left = asked.withColumns({"length": F.size("vector"), "a": block(asked_blocks)}).withColumn("b", every(row_blocks)).repartition(tasks, *keys)
    right = rows.withColumns({"length": F.size("vector"), "b": block(row_blocks)}).withColumn("a", every(asked_blocks)).repartition(tasks, *keys)
    schema = T.StructType([T.StructField("query", asked.schema["id"].dataType), T.StructField("row", rows.schema["id"].dataType), T.StructField("distance", T.DoubleType())])

    def run(some: pa.Table, others: pa.Table) -> pa.Table:
        query, row, distance = np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0)
        if k and len(some) and len(others):
            order = pc.rank(others["id"].combine_chunks(), null_placement="at_start", tiebreaker="dense").to_numpy()
            query, row, distance = _nearest(_matrix(some["vector"]), _matrix(others["vector"]), order, k)
        return pa.table({"query": some["id"].take(pa.array(query)), "row": others["id"].take(pa.array(row)), "distance": pa.array(distance)})

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "row"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "row", "distance")


def nearest_examples(requests: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """(request_id, rank, record_id, distance, prompt_input): for each request the ``k`` nearest eligible records.

    ``requests``: request_id, figure_of_merit, features, available (device ids). A record is eligible if its input is there,
    its objective is the request's, it has every feature of the request, finite, and one of its devices is available. Ties go to
    the smaller record id; ``k`` of 0 or less gives nothing. Requests of one objective, of the same features and of the same available devices are a group;
    records join the groups that they are eligible for, each with the features asked there, and every request is held against every record of its group.
    """
    past = records.where(F.col("input").isNotNull()).select(
        "record_id", F.col("input.objective.name").alias("figure_of_merit"), F.col("input.circuit.features.by_name").alias("__features"),
        F.transform("input.compatible_backends", lambda b: b["id"]).alias("__devices"))
    kind = ["figure_of_merit", "__names", "__available"]
    asked = requests.where("features IS NOT NULL").select(
        F.col("request_id").alias("id"), "figure_of_merit", F.array_sort(F.map_keys("features")).alias("__names"), F.col("features").alias("__query"),
        F.array_sort(F.array_distinct(F.array_compact("available"))).alias("__available"))
    group = F.to_json(F.struct(*kind)).alias("group")
    values = lambda m: F.transform("__names", lambda n: F.try_element_at(m, n).cast("double"))
    known = lambda x: x.isNotNull()
    queries = asked.select(group, "id", values(F.col("__query")).alias("vector")).where(F.forall("vector", known))
    met = past.join(asked.select(*kind).distinct(), "figure_of_merit").where(S.share_element(F.col("__devices"), F.col("__available")))
    rows = met.select(group, F.col("record_id").alias("id"), values(F.col("__features")).alias("vector")).where(
        F.forall("vector", lambda x: F.coalesce(S.is_finite(x), F.lit(False))))
    top = _ranked(queries, rows, max(k, 0)).select(F.col("query").alias("request_id"), "rank", F.col("row").alias("record_id"), "distance")
    return top.join(records.select("record_id", prompt_safe(F.col("input")).alias("prompt_input")), "record_id").select(
        "request_id", "rank", "record_id", "distance", "prompt_input")


def nearest_rows(rows: DataFrame, query: Column, vector: str, identity: str, k: int) -> DataFrame:
    """The ``k`` rows nearest to one vector by mean relative difference: one top-k, no full sort."""
    pairs = F.zip_with(vector, query, lambda a, b: S.relative_difference(a.cast("double"), b.cast("double")))
    distance = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x) / F.size(vector)
    return rows.select(identity, distance.alias("distance")).orderBy("distance", identity).limit(max(k, 0))


def nearest_rows_each(queries: DataFrame, rows: DataFrame, vector: str, identity: str, k: int) -> DataFrame:
    """(query_id, rank, identity, distance): for each query row the ``k`` rows nearest by mean relative difference.

    Every query meets every row in blocks of both, neither side held whole; a task passes on at most ``k`` rows of a query.
    Ties go to the smaller identity; null or empty vectors, and vectors of another length, have no distance and don't appear.
    """
    def side(table: DataFrame) -> DataFrame:
        whole = table.where((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull()))
        return whole.select(F.lit("").alias("group"), F.col(identity).alias("id"), F.col(vector).cast("array<double>").alias("vector"))

    return _ranked(side(queries), side(rows), max(k, 0)).select(F.col("query").alias("query_id"), "rank", F.col("row").alias(identity), "distance")
