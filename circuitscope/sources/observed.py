"""Counts taken of rows while they are written, instead of by another scan of what they came from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

#: At most so many labels are counted in a write: each is an aggregate of its own.
MAX_LABELS = 1_000


@dataclass(frozen=True)
class Seen:
    """What a write saw: ``n`` rows, those that were ``chosen``, these by label, and how many of them have none of the labels asked for."""

    n: int
    chosen: int
    by_label: dict[str, int]
    elsewhere: int

    def smallest(self) -> int | None:
        """Rows of the smallest class that has any; None if there are none, or if some have a label that was not asked for."""
        return None if self.elsewhere else min((n for n in self.by_label.values() if n), default=None)


def write(rows: DataFrame, path: str, metrics: dict[str, Column], source: str = "parquet") -> dict:
    """Writes ``rows`` over what is at ``path`` and returns aggregates of them, taken by the tasks that write.

    Nothing comes between the aggregates and the writing, so they belong to the tasks of the job's last stage, and of these Spark
    counts each partition once, however often executors are lost. An empty table gives counts of 0. Distinct counts and windows are refused.
    """
    seen = Observation()
    rows.observe(seen, *[c.alias(name) for name, c in metrics.items()]).write.format(source).mode("overwrite").save(path)
    return seen.get


def write_counted(rows: DataFrame, path: str, label: Column, labels: list[str], chosen: Column | None = None, source: str = "parquet") -> Seen:
    """:func:`write`, counting rows, ``chosen`` rows (all by default) and these by ``label``. Null labels are elsewhere; a repeated label counts once."""
    labels = sorted(set(labels))
    if len(labels) > MAX_LABELS:
        raise ValueError(f"{len(labels)} labels; at most {MAX_LABELS} are counted while writing")
    chosen = F.coalesce(chosen, F.lit(False)) if chosen is not None else F.lit(True)
    known = F.coalesce(label.isin(labels), F.lit(False)) if labels else F.lit(False)
    metrics = {"n": F.count("*"), "chosen": F.count_if(chosen), "elsewhere": F.count_if(chosen & ~known)} | {
        f"label_{k}": F.count_if(chosen & F.coalesce(label == name, F.lit(False))) for k, name in enumerate(labels)}
    got = write(rows, path, metrics, source)
    return Seen(got["n"], got["chosen"], {name: got[f"label_{k}"] for k, name in enumerate(labels)}, got["elsewhere"])
