"""Command line: ``python -m circuitscope select|export|publish``. Tables are Parquet folders, circuits and logs as they are read by ``sources``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import jobs as J, qasm, sampling, scores as C
from .plans import device_selector, strict_export, verified_cells
from .sources import observed, readers, writers


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="circuitscope", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    select = commands.add_parser("select", help="labelled samples of circuits, from their texts, the log and the scores")
    for name in ("circuits", "devices", "log", "compiled", "scores", "out"):
        select.add_argument(f"--{name}", required=True)
    select.add_argument("--metric", default="expected_fidelity", choices=sorted(strict_export.METRICS))
    select.add_argument("--max-attempts", type=int, default=2)
    export = commands.add_parser("export", help="examples for a recommender, from circuits and rated cells")
    for name in ("circuits", "cells", "labels", "devices", "out"):
        export.add_argument(f"--{name}", required=True)
    export.add_argument("--metric", default="expected_fidelity", choices=sorted(strict_export.METRICS))
    export.add_argument("--balance", default="cap-ratio", choices=("none", "undersample", "cap-ratio"))
    export.add_argument("--ratio", type=float, default=3.0)
    export.add_argument("--seed", type=int, default=0)
    export.add_argument("--max-records", type=int)
    export.add_argument("--minimum-per-device", type=int, default=1)
    export.add_argument("--compiled", help="folder of compiled files; cells (circuit, device, device_pos, score, mode, status, passes) are then checked and scored again from these")
    export.add_argument("--edges"), export.add_argument("--instructions")
    export.add_argument("--overwrite", action="store_true")
    export.add_argument("--audit-only", action="store_true")
    publish = commands.add_parser("publish", help="copy files to a folder unless others of the same name are there")
    publish.add_argument("source"), publish.add_argument("target"), publish.add_argument("patterns", nargs="*", default=["*"])
    publish.add_argument("--overwrite", action="store_true"), publish.add_argument("--dry-run", action="store_true")
    return parser


def _vectors(circuits: DataFrame) -> DataFrame:
    return qasm.feature_map(qasm.features(circuits))


def select(spark: SparkSession, args: argparse.Namespace) -> None:
    parsed = readers.parse_circuits(readers.scan_circuits(spark, args.circuits))
    table = lambda path: spark.read.parquet(path)
    scores = table(args.scores)
    C.require_labels(scores)
    features = _vectors(parsed).withColumnRenamed("name", "circuit").select("circuit", "features")
    found = device_selector.build(parsed, table(args.devices), readers.read_manifest(spark, args.log), table(args.compiled), scores, features, args.metric, args.max_attempts)
    writers.write_records(device_selector.export_records(found.cells, found.samples), f"{args.out}/records")
    writers.write_records(found.pending.orderBy(*J.job_order()), f"{args.out}/pending")


def export(spark: SparkSession, args: argparse.Namespace) -> None:
    names = list(qasm.FEATURE_NAMES)
    devices = spark.read.parquet(args.devices)
    out = spark._jvm.org.apache.hadoop.fs.Path(f"{args.out}/header")
    files = out.getFileSystem(spark._jsc.hadoopConfiguration())
    if not args.overwrite and files.exists(out):
        raise SystemExit(f"{args.out} holds an export; --overwrite replaces it")
    files.delete(out, True)  # nothing tells a whole export until all of the new one is there
    # the circuits are read and parsed once; numbers, features, widths and summaries come from this table
    observed.write(readers.parse_circuits(readers.scan_circuits(spark, args.circuits)), f"{args.out}/circuits", {"n": F.count("*")})
    parsed = C.require_distinct(spark.read.parquet(f"{args.out}/circuits"), "name")
    circuits = _vectors(parsed).select("name", "qasm", "num_qubits", "features").join(device_selector.with_index(parsed.select("name"), "name", "idx"), "name")
    cells = spark.read.parquet(args.cells)
    if args.compiled:
        if not (args.edges and args.instructions):
            raise SystemExit("--compiled needs --edges and --instructions")
        cells = verified_cells.verified_cells(cells, parsed, readers.scan_compiled(spark, args.compiled).where(F.col("metric") == args.metric), devices,
                                              spark.read.parquet(args.edges), spark.read.parquet(args.instructions), args.metric)
    # written once: what every circuit was refused for is read again by the balance, the header and the records; its counts are taken in the write
    built = strict_export.build(circuits, cells, spark.read.parquet(args.labels), names, args.metric, name_devices=bool(args.compiled))
    known = [r.device_id for r in devices.select("device_id").distinct().limit(observed.MAX_LABELS + 1).collect()]
    if len(known) > observed.MAX_LABELS:
        raise SystemExit(f"more than {observed.MAX_LABELS} devices")
    seen = observed.write_counted(built, f"{args.out}/eligibility", F.col("label"), known, F.col("reason").isNull())
    few = {name: n for name, n in seen.by_label.items() if n < args.minimum_per_device}
    if few:
        raise SystemExit("too few examples: " + ", ".join(f"{name}={n}" for name, n in few.items()))
    built = spark.read.parquet(f"{args.out}/eligibility")
    kept, report = sampling.balance(built.where("reason is null"), "label", "record_id", args.balance, args.ratio, args.seed, seen.smallest())
    if args.max_records is not None:
        kept = sampling.cap_rows(kept, "record_id", args.max_records, args.seed)
    exported = None
    if not args.audit_only:
        records = strict_export.to_records(kept.orderBy("idx"), qasm.summary(parsed), devices, names, args.metric)
        exported = observed.write_counted(records, f"{args.out}/records", F.col("expected_output.selected_device"), known, source="json")
    # last, since it tells a whole export
    writers.write_records(strict_export.header(built, kept, report, args.balance, names, args.metric, seen, exported), f"{args.out}/header")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("circuitscope").getOrCreate()
    if args.command == "publish":
        writers.publish(spark, args.source, args.target, *args.patterns, overwrite=args.overwrite, dry_run=args.dry_run).show(truncate=False)
    else:
        {"select": select, "export": export}[args.command](spark, args)


if __name__ == "__main__":
    main()
