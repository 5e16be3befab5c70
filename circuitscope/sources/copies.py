"""Files copied and hashed by tasks, and sets of files published as versions behind one pointer.

A set lies in ``<target>/versions/<version>/``; ``<target>/CURRENT`` names the version that readers take. The pointer is replaced by one rename, so
whatever step fails, readers see the old set or the new one, and both are whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes that a task holds of a file at a time.
CHUNK_BYTES = 8 << 20
POINTER = "CURRENT"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """A file system that tasks can reach, and the path in it. Paths without a scheme are those of a folder that all machines share."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path)) if re.match("[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def _chunks(path: str) -> Iterator[bytes]:
    system, at = _opened(path)
    with system.open_input_stream(at) as stream:
        while chunk := stream.read(CHUNK_BYTES):
            yield chunk


def _digest(path: str) -> tuple[int, str]:
    size, digest = 0, hashlib.sha256()
    for chunk in _chunks(path):
        size += len(chunk)
        digest.update(chunk)
    return size, digest.hexdigest()


def listed(spark: SparkSession, path: str, *patterns: str) -> DataFrame:
    """(name, source) of the files of a folder that match a pattern, each once, empty ones too (Spark's readers leave these out).

    The names come from one listing by the file system; no content is read.
    """
    folder = _hadoop(spark, path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for pattern in patterns or ("*",):
        for f in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, pattern)) or []:
            if f.isFile() and not f.getPath().getName().startswith("."):
                found[f.getPath().getName()] = f.getPath().toString()
    return spark.createDataFrame(sorted(found.items()), "name string, source string")


def _spread(files: DataFrame) -> DataFrame:
    """Files dealt out singly: each is a task's work of its own length, so there are more tasks than cores."""
    return files.repartition(max(64, 4 * files.sparkSession.sparkContext.defaultParallelism))


def hashed(files: DataFrame) -> DataFrame:
    """(name, n_bytes, sha256) of files (name, source), read chunk by chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, source in zip(*(c.to_pylist() for c in batch.columns)):
                size, digest = _digest(source)
                yield pa.record_batch([pa.array([name]), pa.array([size], pa.int64()), pa.array([digest])], ["name", "n_bytes", "sha256"])

    return _spread(files.select("name", "source")).mapInArrow(run, "name string, n_bytes long, sha256 string")


def copied(files: DataFrame) -> DataFrame:
    """Copies files (name, source, target) and gives (name, n_bytes, sha256) of each once its copy was read back and is equal.

    A task copies one file after another, chunk by chunk; one that runs again writes the same files again.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, source, target in zip(*(c.to_pylist() for c in batch.columns)):
                system, at = _opened(target)
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                size, digest = 0, hashlib.sha256()
                with system.open_output_stream(at) as out:
                    for chunk in _chunks(source):
                        size += len(chunk)
                        digest.update(chunk)
                        out.write(chunk)
                if _digest(target) != (size, digest.hexdigest()):
                    raise OSError(f"the copy of {name} differs")
                yield pa.record_batch([pa.array([name]), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], ["name", "n_bytes", "sha256"])

    return _spread(files.select("name", "source", "target")).mapInArrow(run, "name string, n_bytes long, sha256 string")


def _hadoop(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def replace_file(spark: SparkSession, source: str, target: str) -> None:
    """One rename over whatever is there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    path = _hadoop(spark, target)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.getFileSystem(conf).getUri(), conf).rename(_hadoop(spark, source), path, options)


def current_version(spark: SparkSession, target: str) -> str | None:
    path = _hadoop(spark, f"{target}/{POINTER}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.text(f"{target}/{POINTER}").first().value


def _switch(spark: SparkSession, target: str, version: str) -> None:
    beside = f"{target}/.{POINTER}-{version}"
    stream = _hadoop(spark, beside).getFileSystem(spark._jsc.hadoopConfiguration()).create(_hadoop(spark, beside), True)
    stream.write(bytearray(version.encode()))
    stream.close()
    replace_file(spark, beside, f"{target}/{POINTER}")


def publish_set(spark: SparkSession, source: str, target: str, *patterns: str) -> str:
    """Publishes the matching files of a folder as one new version, and returns its name.

    Copied and compared by tasks, listed in the version's manifest by Spark's commit protocol, then switched to by one rename. A run that
    fails before that leaves a version that nothing names, which :func:`drop_old_versions` removes. A folder without matching files is an error.
    """
    version = uuid.uuid4().hex
    folder = f"{target.rstrip('/')}/versions/{version}"
    files = listed(spark, source, *patterns).withColumn("target", F.concat(F.lit(folder + "/files/"), "name"))
    copied(files).write.parquet(f"{folder}/manifest")
    if spark.read.parquet(f"{folder}/manifest").isEmpty():
        raise FileNotFoundError(f"no file of {source} matches")
    _switch(spark, target.rstrip("/"), version)
    return version


def published(spark: SparkSession, target: str) -> DataFrame:
    """(name, n_bytes, sha256, path) of the files of the current version; none before the first."""
    version = current_version(spark, target.rstrip("/"))
    if version is None:
        return spark.createDataFrame([], "name string, n_bytes long, sha256 string, path string")
    folder = f"{target.rstrip('/')}/versions/{version}"
    return spark.read.parquet(f"{folder}/manifest").withColumn("path", F.concat(F.lit(folder + "/files/"), "name"))


def drop_old_versions(spark: SparkSession, target: str, keep: int = 1) -> list[str]:
    """Deletes all versions but the current one and, of the others, the ``keep`` newest; returns the names of the deleted. Readers that began with a kept
    version can go on."""
    path = _hadoop(spark, f"{target.rstrip('/')}/versions")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    current = current_version(spark, target.rstrip("/"))
    others = sorted(((f.getModificationTime(), f.getPath().getName()) for f in system.listStatus(path) if f.getPath().getName() != current), reverse=True) if system.exists(path) else []
    gone = [name for _, name in others[keep:]]
    for name in gone:
        system.delete(_hadoop(spark, f"{target.rstrip('/')}/versions/{name}"), True)
    return gone
