"""What a stream keeps by key: appended batch by batch, merged in sorted runs, looked up without reading the history.

``<root>/batches/<n>`` holds the last row of each key of batch n. ``<root>/runs/<name>/bucket=<b>`` holds merged batches: one row a key, in buckets by the key's
hash, sorted by key within. ``<root>/CURRENT`` is the one file that says which runs count and up to which batch they reach; it is replaced by one
rename, so a merge that fails, or is under way, changes nothing that a reader sees.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import copies

#: Rows of a bucket of a run, about: what a lookup of one key has to look at, less what its file's statistics exclude.
BUCKET_ROWS = 1_000_000
#: Keys of one lookup, at most; more are a join with :meth:`VersionedStore.latest`.
LOOKUP_KEYS = 1_000
#: A merge takes in an older run that isn't more than so many times larger than what is merged already.
GROWTH = 2


@dataclass
class VersionedStore:
    """One writer appends (a stream's batches, in order), one process merges; any number read."""

    spark: SparkSession
    root: str
    key: str
    bucket_rows: int = BUCKET_ROWS

    def __post_init__(self):
        self.root = self.root.rstrip("/")

    def append(self, batch: DataFrame, number: int) -> None:
        """Stores a batch, once: one that was stored already, or merged, is left as it is. Of rows of equal key within it the greatest by all other
        columns in their order stays, whichever task reads it. The signature is that of ``foreachBatch``."""
        if number <= self._current()["through"] or self._exists(f"batches/{number}/_SUCCESS"):
            return
        rest = [c for c in batch.columns if c != self.key]
        last = batch.groupBy(self.key).agg(F.max(F.struct(*rest)).alias("r")).select(self.key, "r.*", F.lit(number).cast("long").alias("version"))
        last.write.mode("overwrite").parquet(f"{self.root}/batches/{number}")

    def latest(self) -> DataFrame:
        """The last row of each key, with the ``version`` (number of the batch) that wrote it."""
        return self._last(self._parts(None))

    def lookup(self, *keys) -> DataFrame:
        """The last row of each of some keys. Of a run only the buckets of these keys are read."""
        if len(keys) > LOOKUP_KEYS:
            raise ValueError(f"more than {LOOKUP_KEYS} keys; join with latest() instead")
        return self._last(self._parts(list(keys)))

    def merge(self, whole: bool = False) -> str | None:
        """Merges the batches behind the newest run into one run, with older runs while these aren't more than ``GROWTH`` times larger (all with
        ``whole``), and returns its name; None if there is nothing to merge.

        Runs so grow geometrically: a row is rewritten once for each doubling of what is stored, and a lookup reads as many runs.
        """
        state = self._current()
        numbers = self._batches(state["through"])
        if not numbers and not (whole and len(state["runs"]) > 1):
            return None
        taken, size = [], sum(self.spark.read.parquet(self._batch(n)).count() for n in numbers)  # of file footers
        kept = list(state["runs"])  # newest first
        while kept and (whole or kept[0]["rows"] <= GROWTH * size):
            run = kept.pop(0)
            taken.append(run)
            size += run["rows"]
        parts = [self.spark.read.parquet(self._batch(n)) for n in numbers] + [self._run(r).drop("bucket") for r in taken]
        buckets = max(1, -(-size // self.bucket_rows))
        name = f"{max([state['through'], *numbers]):012d}-{uuid.uuid4().hex}"
        folder = f"{self.root}/runs/{name}"
        merged = self._last(parts).withColumn("bucket", self._bucket(F.col(self.key), buckets))
        merged.repartition(buckets, "bucket").sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(folder)
        rows = self.spark.read.parquet(folder).count()
        through = max([state["through"], *numbers])
        self._switch({"through": through, "runs": [{"name": name, "rows": rows, "buckets": buckets}, *kept]})
        return name

    def drop_merged(self) -> list[str]:
        """Deletes batches and runs that the current state doesn't read; returns their names. For when readers of an older state are done."""
        state = self._current()
        live = {r["name"] for r in state["runs"]}
        gone = [f"batches/{n}" for n in self._batches(-1) if n <= state["through"]] + [f"runs/{n}" for n in self._names("runs") if n not in live]
        for name in gone:
            path = self._path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return gone

    def _last(self, parts: list[DataFrame]) -> DataFrame:
        if not parts:
            raise FileNotFoundError(f"nothing is stored in {self.root}")
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        rest = [c for c in rows.columns if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(self.key, "r.*")

    def _parts(self, keys: list | None) -> list[DataFrame]:
        state = self._current()
        wanted = lambda t: t if keys is None else t.where(F.col(self.key).isin(keys))
        parts = [wanted(self.spark.read.parquet(self._batch(n))) for n in self._batches(state["through"])]
        for run in state["runs"]:
            rows = self._run(run)
            if keys is not None:
                literals = self.spark.range(1).select(F.array(*[self._bucket(F.lit(k).cast(rows.schema[self.key].dataType), run["buckets"]) for k in keys]).alias("b"))
                rows = rows.where(F.col("bucket").isin(literals.first().b))  # constants, so whole folders are left out
            parts.append(wanted(rows).drop("bucket"))
        return parts

    @staticmethod
    def _bucket(key, buckets: int):
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _batch(self, number: int) -> str:
        return f"{self.root}/batches/{number}"

    def _run(self, run: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/runs/{run['name']}")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _exists(self, name: str) -> bool:
        path = self._path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _names(self, name: str) -> list[str]:
        path = self._path(name)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []

    def _batches(self, after: int) -> list[int]:
        """Numbers of the batches that were committed, of those beyond ``after``."""
        return sorted(int(n) for n in self._names("batches") if n.isdigit() and int(n) > after and self._exists(f"batches/{n}/_SUCCESS"))

    def _current(self) -> dict:
        found = copies.current_version(self.spark, self.root)
        return json.loads(found) if found else {"through": -1, "runs": []}

    def _switch(self, state: dict) -> None:
        beside = f"{self.root}/.{copies.POINTER}-{uuid.uuid4().hex}"
        path = self._path(beside.rsplit("/", 1)[1])
        stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        copies.replace_file(self.spark, beside, f"{self.root}/{copies.POINTER}")


def keep_recommendations(rows: DataFrame, store: VersionedStore, checkpoint: str):
    """Starts a query that appends each batch of a stream to ``store``, once, whatever is restarted."""
    return rows.writeStream.foreachBatch(store.append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
