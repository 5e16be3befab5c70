"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Permitted sequence lengths, in tokens.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: About so many pieces are packed together, in one task; a corpus is that many independent packings.
GROUP_ITEMS = 50_000
#: Equal rows are numbered in runs of so many.
RUN = 4096


def sequence_cost(capacity: int) -> float:
    """Work of a sequence: linear layers, and attention that grows with the square."""
    return capacity * (1 + capacity / 65536)


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...], cost: Callable[[int], float] = sequence_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item (in falling order of length), and each bin's capacity.

    Each item goes into the open bin that it leaves the least room in. If none has room, that
    permitted size is opened whose cost is least for each token that it can come to hold: the item and, of the
    items still to come, what is short enough to join it. At the end each bin shrinks to the least
    permitted size that holds its contents.
    """
    sizes = sorted(capacities)
    costs = [cost(c) for c in sizes]
    n = len(lengths)
    ahead = np.concatenate([np.cumsum(lengths[::-1])[::-1], [0]])  # tokens from this item on
    bins, offsets, used = np.zeros(n, "i8"), np.zeros(n, "i8"), []
    room: dict[int, list[int]] = {}  # bins by the room they have
    open_rooms, total = 0, []  # bit r is set if a bin has room r
    falling = -lengths
    for i, length in enumerate(lengths.tolist()):
        fits = open_rooms >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            which = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
        else:
            best = None
            for c, price in zip(sizes, costs):
                if c >= length:
                    joining = int(ahead[max(i + 1, int(np.searchsorted(falling, length - c)))])
                    rate = price / min(c, length + joining)
                    if best is None or rate < best[0]:
                        best = (rate, c)
            which, left = len(used), best[1]
            used.append(0)
            total.append(left)
        bins[i], offsets[i] = which, used[which]
        used[which] += length
        left -= length
        if left:
            room.setdefault(left, []).append(which)
            open_rooms |= 1 << left
    fitted = np.array(sizes)[np.searchsorted(sizes, used)] if used else np.zeros(0, "i8")
    return bins, offsets, fitted


def pack(items: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", capacities: tuple[int, ...] = CAPACITIES,
         cost: Callable[[int], float] = sequence_cost) -> DataFrame:
    """(id_col, piece, piece_start, piece_tokens, bin, bin_offset, capacity): every token of every row in one bin.

    Items longer than the largest capacity are cut into pieces of it and a rest; no token is dropped. Rows of null or
    no length need no place and give no row. Only ids and lengths are shuffled. Pieces are dealt by hash of id, length and piece
    into groups of about GROUP_ITEMS, so the bins don't depend on how the rows are partitioned, nor on a task that runs again. Rows that
    repeat id and length are counted first and numbered, so they spread over the groups.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    largest = max(capacities)
    length = F.col(length_col).cast("long")
    equal = items.select(F.col(id_col).alias("__id"), length.alias("__n")).where("__n > 0").groupBy("__id", "__n").agg(F.count("*").alias("times"))
    copies = (equal.select("__id", "__n", "times", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / RUN))).alias("run"))
              .select("__id", "__n", F.explode(F.sequence(F.col("run") * RUN, F.least("times", (F.col("run") + 1) * RUN) - 1)).alias("copy")))
    pieces = copies.select("__id", "__n", "copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / largest))).alias("piece"))
    groups = max(1, -(-int(items.agg(F.coalesce(F.sum(F.ceil(length / largest)), F.lit(0))).first()[0]) // GROUP_ITEMS))
    dealt = pieces.select(F.pmod(F.xxhash64("__id", "__n", "copy", "piece"), F.lit(groups)).alias("group"), "__id", "piece",
                          F.least(F.lit(largest), F.col("__n") - F.col("piece") * largest).alias("n"))
    id_type = items.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), *[T.StructField(c, T.LongType()) for c in (
        "piece", "piece_start", "piece_tokens", "bin", "bin_offset", "capacity")]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "descending"), ("__id", "ascending"), ("piece", "ascending")])
        lengths, piece = table.column("n").to_numpy(), table.column("piece").to_numpy()
        bins, offsets, fitted = best_fit(lengths, tuple(capacities), cost)
        first = table.column("group")[0].as_py() << 24
        return pa.table([table.column("__id"), *[pa.array(x, pa.int64()) for x in (
            piece, piece * largest, lengths, first + bins, offsets, fitted[bins])]], schema.names)

    return dealt.groupBy("group").applyInArrow(run, schema)
