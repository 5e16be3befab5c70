"""Scores of circuit-device cells: labels, rankings, margins, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scalars as S
from .jobs import broadcast_if_small


def best_device(scores: DataFrame, keys: list[str] | None = None, device: str = "device", position: str = "device_pos", score: str = "score") -> DataFrame:
    """(keys, label, best_score): the device of the greatest valid score; ties go to the first by ``position``.

    Without a valid score label and best score are null. One partial aggregate, no sort.
    """
    keys = keys or ["circuit"]
    order = F.when(S.valid_score(F.col(score)), F.struct(F.col(score), -F.col(position)))
    return scores.groupBy(*keys).agg(F.max_by(device, order).alias("label"), F.max(F.when(S.valid_score(F.col(score)), F.col(score))).alias("best_score"))


def rank_devices(scores: DataFrame, keys: list[str] | None = None, device: str = "device", score: str = "score") -> DataFrame:
    """Valid cells with rank (by score, then device name, from 1) and the next score."""
    keys = keys or ["circuit"]
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), device)
    return scores.where(S.valid_score(F.col(score))).select(*keys, device, score, F.row_number().over(w).alias("rank"), F.lead(score).over(w).alias("next_score"))


def selection_margin(scores: DataFrame, keys: list[str] | None = None, device: str = "device", score: str = "score") -> DataFrame:
    """(keys, device, score, second_score, margin) of the winner; margin is null for a single candidate."""
    ranked = rank_devices(scores, keys, device, score).where("rank = 1")
    return ranked.select(*(keys or ["circuit"]), device, score, F.col("next_score").alias("second_score"), (F.col(score) - F.col("next_score")).alias("margin"))


def paired_outcomes(scores: DataFrame, choices: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(circuit, outcome, regret, first_score, second_score, best_score) of two ways to choose a device for each circuit.

    ``choices``: circuit, first, second (device names, unique by circuit). ``outcome`` of the first against the second: ``win``, ``loss``, or ``tie`` within
    ``tolerance``; a device without a valid score loses to one with it, two of them tie. ``regret``: the best valid score of the circuit less the
    first's, null if either is missing. Circuits without scores count too. One aggregate by circuit behind one join.
    """
    valid = F.when(S.valid_score(F.col("score")), F.col("score"))
    own = lambda who: F.max(F.when(F.col("device") == F.col(who), valid))
    met = choices.select("circuit", "first", "second").join(scores.select("circuit", "device", "score"), "circuit", "left").groupBy("circuit").agg(
        own("first").alias("first_score"), own("second").alias("second_score"), F.max(valid).alias("best_score"))
    a, b = F.col("first_score"), F.col("second_score")
    outcome = (F.when(a.isNull() & b.isNull(), "tie").when(b.isNull(), "win").when(a.isNull(), "loss").when(a - b > tolerance, "win").when(b - a > tolerance, "loss").otherwise("tie"))
    return met.select("circuit", outcome.alias("outcome"), (F.col("best_score") - a).alias("regret"), "first_score", "second_score", "best_score")


def comparison(outcomes: DataFrame) -> DataFrame:
    """(n, wins, ties, losses, failures, mean_regret, max_regret) of :func:`paired_outcomes`; failures are circuits where the first has no valid score."""
    of = lambda what: F.count_if(F.col("outcome") == what)
    return outcomes.agg(F.count("*").alias("n"), of("win").alias("wins"), of("tie").alias("ties"), of("loss").alias("losses"), F.count_if(F.col("first_score").isNull()).alias("failures"),
                        F.avg("regret").alias("mean_regret"), F.max("regret").alias("max_regret"))


def confusion(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(label, predicted, n, share): how often each label was taken for which, and the part of the label's rows."""
    counts = predictions.groupBy(label, predicted).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))  # a row for each pair of labels


def label_distribution(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))


def provenance(cells: DataFrame) -> DataFrame:
    return cells.groupBy("mode").agg(F.count("*").alias("n"))


def failure_counts(scores: DataFrame) -> DataFrame:
    """(failed_cells, failed_circuits): cells without a valid score, and circuits without any."""
    ok = S.valid_score(F.col("score"))
    per = scores.groupBy("circuit").agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("bad"), F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("failed_cells"), F.count_if(F.col("bad") == F.col("n")).alias("failed_circuits"))


def all_failed(scores: DataFrame) -> DataFrame:
    """(n_circuits, n_dropped): circuits, and those without a valid score on any device."""
    per = scores.groupBy("circuit").agg(F.bool_or(F.coalesce(S.valid_score(F.col("score")), F.lit(False))).alias("ok"))
    return per.agg(F.count("*").alias("n_circuits"), F.count_if(~F.col("ok")).alias("n_dropped"))


def require_labels(scores: DataFrame) -> int:
    """How many circuits have no label; an error where none has one."""
    n, dropped = all_failed(scores).first()
    if n and n == dropped:
        raise ValueError(f"all {n} circuits failed on every device")
    return dropped


def labelled_samples(scores: DataFrame, features: DataFrame) -> DataFrame:
    """Training rows: circuits with a winner, their features and all scores by device. See :func:`require_labels` for those without."""
    table = scores.groupBy("circuit").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("device", "score")))).alias("scores"))
    return best_device(scores).where("label is not null").join(features, "circuit").join(table, "circuit").select("circuit", "features", "label", "scores")


def dense_scores(jobs: DataFrame, circuits: DataFrame, devices: DataFrame, scores: DataFrame) -> DataFrame:
    """The complete matrix, long: every circuit and device, failures and missing cells at the worst score."""
    cells = circuits.select(F.col("name").alias("circuit")).crossJoin(broadcast_if_small(devices.select(F.col("device_id").alias("device"), "device_pos")))
    return cells.join(scores.select("circuit", "device", "score"), ["circuit", "device"], "left").withColumn(
        "score", F.when(S.valid_score(F.col("score")), F.col("score")).otherwise(F.lit(S.WORST_SCORE)))


def require_distinct(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows``, or an error where the columns together are not unique."""
    n, distinct = rows.agg(F.count("*"), F.count_distinct(F.struct(*columns))).first()
    if n != distinct:
        raise ValueError(f"{n - distinct} rows repeat {', '.join(columns)}")
    return rows


def smallest_class(labels: DataFrame, label: str = "label") -> DataFrame:
    return label_distribution(labels, label).agg(F.min("n").alias("smallest"))


def below_minimum(devices: DataFrame, labels: DataFrame, minimum: int) -> DataFrame:
    """(device, n) of devices with fewer winners than ``minimum``, none included."""
    counts = label_distribution(labels).withColumnRenamed("label", "device")
    return devices.select(F.col("device_id").alias("device")).join(counts, "device", "left").select("device", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < minimum)
