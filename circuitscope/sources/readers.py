"""Sources: circuit text, append-only logs, nested JSON datasets, device catalogs, models' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import schemas
from ..functions import scalars as S
from ..operators import qasm
from . import archives

#: A compiled file's name: circuit, metric, device.
COMPILED_NAME = r"^(.+)_(expected_fidelity|critical_depth)-(.+)\.qasm$"


def scan_circuits(spark: SparkSession, directory: str) -> DataFrame:
    """(name, qasm, file) of every ``*.qasm`` file, one row each."""
    text = spark.read.text(directory, wholetext=True, pathGlobFilter="*.qasm")
    return text.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.qasm$", "").alias("name"), F.col("value").alias("qasm"),
                       F.col("_metadata.file_path").alias("file"))


def parse_circuits(circuits: DataFrame, strict: bool = True) -> DataFrame:
    """``circuits`` with num_qubits, num_clbits, ops and problem. With ``strict`` a bad circuit fails the query."""
    parsed = qasm.parse_each(circuits)
    if not strict:
        return parsed
    return parsed.withColumn("problem", F.when(F.col("problem").isNull(), F.lit(None).cast("string")).otherwise(
        F.raise_error(F.concat_ws(": ", "name", "problem")).cast("string")))


def circuits_or_archive(spark: SparkSession, directory: str, archive: str) -> DataFrame:
    """Circuits of a directory or, where it has none, of a zip archive; neither is an error."""
    found = scan_circuits(spark, directory)
    if not found.isEmpty():
        return found
    unpacked = scan_archive(spark, archive)
    if unpacked.isEmpty():
        raise FileNotFoundError(f"no circuits in {directory} or {archive}")
    return unpacked


def scan_archive(spark: SparkSession, archive: str) -> DataFrame:
    """The ``*.qasm`` members of zip files, each archive read by as many tasks as its size asks for (:mod:`.archives`). A member that is a large-file
    pointer, whose circuit was never fetched, fails the query."""
    members = archives.read_members(spark, archive, ".qasm")
    text = F.when(archives.pointer("text").isNull(), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("a large-file pointer, not a circuit: "), "member")).cast("string"))
    return members.select(F.regexp_extract("member", r"([^/]*)\.qasm$", 1).alias("name"), text.alias("qasm"), F.concat("archive", F.lit("!"), "member").alias("file"))


def scan_compiled(spark: SparkSession, directory: str) -> DataFrame:
    """(circuit, metric, device, qasm, modified, size) of compiled files; names of another form are left out."""
    text = spark.read.text(directory, wholetext=True, pathGlobFilter="*.qasm")
    name = F.col("_metadata.file_name")
    return (text.select(*[F.regexp_extract(name, COMPILED_NAME, k + 1).alias(c) for k, c in enumerate(("circuit", "metric", "device"))],
                        F.col("value").alias("qasm"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"))
            .where("device != ''"))


def number_lines(lines: DataFrame) -> DataFrame:
    """``value`` with ``line_no``, which orders lines by their place in the log: older files first (by modification time, then path),
    then by the block of the file and the line in it. It is a struct that compares in that order, whichever task reads a file.
    ``lines`` are those of ``spark.read.text``. A log of several files must be appended, not rewritten."""
    at = F.col("_metadata")
    # row numbers grow within a task, so also within a block, but say nothing across tasks
    place = F.struct(at["file_modification_time"].alias("modified"), at["file_path"].alias("file"), at["file_block_start"].alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return lines.select(place.alias("line_no"), "value")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The log of a path, typed; see :func:`parse_manifest`."""
    return parse_manifest(number_lines(spark.read.text(path)))


def parse_manifest(lines: DataFrame) -> DataFrame:
    """Log rows from (line_no, value): lines that are no JSON object, or whose key is no string, are left out."""
    v = F.col("v")
    parsed = lines.select("line_no", F.try_parse_json("value").alias("v")).where(S.is_object(v) & (S.kind(S.field(v, "$.key")) == "STRING"))
    text = lambda name: S.text_field(v, f"$.{name}").alias(name)
    return parsed.select(
        "line_no", text("timestamp"), text("key"), text("circuit"), text("device"),
        S.int_field(v, "$.attempt", bool_as_int=True).alias("attempt"), text("status"), text("mode"), text("phase"),
        S.int_field(v, "$.pid").alias("pid"), F.try_variant_get(v, "$.duration_seconds", "double").alias("duration_seconds"),
        F.try_variant_get(v, "$.passes", "array<string>").alias("passes"), text("fallback_reason"), text("rl_status"), text("error"), text("traceback"),
        S.has_key(v, "$.fallback_reason").alias("has_fallback"), S.has_key(v, "$.mode").alias("has_mode"),
        (S.kind(S.field(v, "$.mode")) == "VOID").alias("mode_is_null"))


def malformed_lines(lines: DataFrame) -> DataFrame:
    """What :func:`parse_manifest` leaves out, with why."""
    v = F.try_parse_json("value")
    return lines.select("line_no", "value", F.when(v.isNull(), "not_json").when(~S.is_object(v), "not_an_object").when(
        F.coalesce(S.kind(S.field(v, "$.key")) != "STRING", F.lit(True)), "key_not_a_string").alias("reason")).where("reason is not null")


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Training rows; an empty table is an error. Parquet holds what pickled arrays would: nothing is unpickled."""
    rows = spark.read.schema(schemas.TRAINING).parquet(path)
    if rows.isEmpty():
        raise ValueError(f"no training rows in {path}")
    return rows


def read_selector_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, records) of a device-selector document; records keep their order in ``index``."""
    doc = spark.read.schema(schemas.SELECTOR_DATASET).json(path, multiLine=True)
    return doc.drop("records"), doc.select(F.explode("records").alias("r")).select("r.*")


def read_context_dataset(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    """Records for retrieval. A missing file is an empty table unless it is ``required``."""
    try:
        doc = spark.read.schema(schemas.CONTEXT_DATASET).json(path, multiLine=True)
    except Exception as error:
        if required or "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schemas.CONTEXT_RECORD)
    return doc.select(F.explode("records").alias("r")).select("r.*")


def read_context_records(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_context_dataset`, for records that are written as JSON lines: read in as many tasks as there are blocks."""
    return spark.read.schema(spark.createDataFrame([], schemas.CONTEXT_RECORD).schema).json(path)


def list_devices(devices: DataFrame, names: list[str]) -> DataFrame:
    """The named devices of a catalog, each once, by name. No name, or one the catalog lacks, is an error."""
    if not names:
        raise ValueError("no device named")
    wanted = list(dict.fromkeys(names))
    found = devices.where(F.col("device_id").isin(wanted)).dropDuplicates(["device_id"])
    missing = sorted(set(wanted) - {r[0] for r in found.select("device_id").collect()})  # as many rows as names
    if missing:
        raise ValueError(f"not in the catalog: {', '.join(missing)}")
    return found.orderBy("device_id")


def device_overview(devices: DataFrame) -> DataFrame:
    return devices.select("device_id", "num_qubits", F.size("operation_names").alias("n_operations")).orderBy("device_id")


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """(key, step, action) from worker logs: lines that name a job and the pass chosen for it; steps count from 1 in log order."""
    line = F.col("value")
    found = (number_lines(spark.read.text(path)).select("line_no", F.regexp_extract(line, r"\bjob=(\S+)", 1).alias("key"),
                                                        F.regexp_extract(line, r"\bazione_RL=(\S+)", 1).alias("action"))
             .where("key != '' and action != ''"))
    return found.select("key", F.row_number().over(Window.partitionBy("key").orderBy("line_no")).alias("step"), "action")


def read_monitor(spark: SparkSession, path: str) -> DataFrame:
    """Reward, length and time of training episodes: CSV behind a comment line."""
    return spark.read.schema(schemas.MONITOR).csv(path, header=True, comment="#")
