"""Helpers shared by the operators: reading tables, scratch tables, small lookups."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: What separates words throughout these operators: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch to or from a Python worker, at most. Spark's own limit lets each task hold several times 64 MB outside the heap.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of Arrow batches to BATCH_BYTES, which no result depends on; a lower one stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(name).lower()).groups()
    if int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit] > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_own_folders: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only a local session, which has no other machine, may
    leave it unset and gets a temporary folder; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^,]*(,\s*\d+)?\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="circuitscope-")
    return _own_folders[context.applicationId]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, so a
    lost executor costs a reread and no recomputation."""
    return write_scratch(df, tag)[0]


def write_scratch(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """As :func:`materialize`, with the path, for tables that can be dropped once superseded."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


class Scratch:
    """Scratch tables of one computation, dropped together once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        found, path = write_scratch(df, tag)
        self.paths.append(path)
        return found

    def drop(self) -> None:
        for path in self.paths:
            drop_scratch(self.spark, path)
        self.paths.clear()


def held_out(id_column):
    """True for the quarter of documents kept for measuring: crc32(id as text) mod 4 is 2."""
    return F.crc32(id_column.cast("string").cast("binary")) % 4 == 2


def keep_rows(docs: DataFrame, text_col: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows for which ``keep``, given a batch of texts, is true: all columns as they are, no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield batch.filter(pa.array(keep(batch.column(at).cast(pa.string()))))

    return docs.mapInArrow(run, docs.schema)
