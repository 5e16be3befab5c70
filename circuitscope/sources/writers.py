"""Sinks: committed writes, appended logs, published copies."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S
from . import copies


def require_finite(rows: DataFrame, *columns: str) -> DataFrame:
    """Fails the query at the first number that JSON cannot hold."""
    for c in columns:
        rows = rows.withColumn(c, F.when(F.col(c).isNull() | S.is_finite(F.col(c)), F.col(c)).otherwise(
            F.raise_error(F.concat(F.lit(f"not finite: {c}"))).cast("double")))
    return rows


def write_records(rows: DataFrame, path: str) -> None:
    """Records as JSON lines, by Spark's commit protocol: all of them or none are seen."""
    rows.write.mode("overwrite").json(path)


def write_document(document: dict, path: str) -> None:
    """One small JSON document (a header or report) with sorted keys, written beside and renamed into place. NaN is refused."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    text = json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False)
    handle, beside = tempfile.mkstemp(dir=folder, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, path)
    except BaseException:
        os.unlink(beside)
        raise


def append_log(rows: DataFrame, path: str) -> None:
    """Adds a batch to an append-only JSON log; as a ``foreachBatch`` sink it serves streams."""
    rows.write.mode("append").json(path)


def write_training(rows: DataFrame, path: str) -> None:
    """Features, labels and scores in one table keyed by circuit: nothing is aligned by position."""
    rows.write.mode("overwrite").parquet(path)


def write_compiled(rows: DataFrame, path: str) -> None:
    """Compiled circuits, checked before they are published: each text must parse."""
    from ..operators import qasm

    checked = qasm.parse_each(rows.withColumnRenamed("circuit", "name")).withColumnRenamed("name", "circuit")
    checked.withColumn("qasm", F.when(F.col("problem").isNull(), F.col("qasm")).otherwise(
        F.raise_error(F.concat_ws(": ", "circuit", "problem")).cast("string"))).select("circuit", "device", "qasm").write.mode("overwrite").parquet(path)


def copy_plan(source: DataFrame, target: DataFrame, overwrite: bool = False) -> DataFrame:
    """(name, action) for publishing files, from two inventories (name, sha256): copy, skip, replace or conflict.

    A full outer join: files only at the target are ``extra`` and stay.
    """
    joined = source.select("name", F.col("sha256").alias("a")).join(target.select("name", F.col("sha256").alias("b")), "name", "full_outer")
    return joined.select("name", F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "copy").when(F.col("a") == F.col("b"), "skip").otherwise(
        "replace" if overwrite else "conflict").alias("action"))


def publish(spark, source: str, target: str, *patterns: str, overwrite: bool = False, dry_run: bool = False) -> DataFrame:
    """Copies the files of a folder that match a pattern to another, and returns the plan (name, action).

    A file of the same name and other content is an error unless ``overwrite``; then nothing is copied. Files are copied and compared
    in tasks under a temporary name, then renamed over what is there, so a reader never sees half of one or none. ``dry_run`` only
    plans. For a set of files that must change as one see :mod:`.copies`.
    """
    plan = copy_plan(file_inventory(spark, source, *patterns), file_inventory(spark, target, *patterns), overwrite)
    conflicts = [r.name for r in plan.where("action = 'conflict'").orderBy("name").limit(5).collect()]
    if conflicts and not dry_run:
        raise FileExistsError(f"other content is there already: {', '.join(conflicts)}")
    if dry_run:
        return plan
    wanted = plan.where("action in ('copy', 'replace')").select("name")
    at = lambda folder, name: F.concat(F.lit(folder.rstrip("/") + "/"), name)
    beside = F.concat(F.lit("."), F.col("name"), F.lit(".tmp"))
    copied = [r.name for r in copies.copied(wanted.select("name", at(source, F.col("name")).alias("source"), at(target, beside).alias("target"))).select("name").toLocalIterator()]
    for name in copied:  # names only: the bytes went from task to file system
        copies.replace_file(spark, f"{target.rstrip('/')}/.{name}.tmp", f"{target.rstrip('/')}/{name}")
    return spark.createDataFrame([(name, "copied") for name in copied], "name string, action string")


def file_inventory(spark, path: str, *patterns: str) -> DataFrame:
    """(name, sha256) of the files that match a pattern, each once; read chunk by chunk in tasks, so a file may have any size."""
    return copies.hashed(copies.listed(spark, path, *patterns)).select("name", "sha256")


def legacy_imports(jobs: DataFrame, valid_now: DataFrame, valid_legacy: DataFrame) -> DataFrame:
    """Jobs whose own output is not valid but whose legacy output is: those to import."""
    return jobs.join(valid_now.select("key"), "key", "left_anti").join(valid_legacy.select("key"), "key", "left_semi")
