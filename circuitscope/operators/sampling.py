"""Deterministic samples: class caps by seeded hash, top-k by seeded hash, stratified splits, class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scalars as S
from .jobs import ranked_within


def cap_classes(rows: DataFrame, label: str, identity: str, ratio: float, seed: int = 0, smallest: int | None = None) -> DataFrame:
    """At most floor(smallest class * ratio) rows (one at least) of each class, those of the smallest seeded hashes.

    Other columns stay. Rows of null label are a class of their own. Only ids and labels are ranked, and each task passes on
    no more rows of a class than the cap; the rows themselves are then semi-joined by id, which should be unique.
    ``smallest`` is the size of the smallest class where it is known; otherwise it is counted.
    """
    sizes = rows.groupBy(label).agg(F.count("*").alias("n")) if smallest is None else rows.sparkSession.range(1).select(F.lit(smallest).cast("long").alias("n"))
    cap = sizes.agg(S.class_cap(F.min("n"), ratio).alias("cap")).first()["cap"]
    if cap is None:
        return rows
    w = Window.partitionBy(label).orderBy("__key", identity)
    kept = (rows.select(identity, label, S.stable_key(seed, F.col(identity)).alias("__key"))
            .withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= F.lit(int(cap))).select(identity))
    return rows.join(kept, identity, "left_semi")


def cap_rows(rows: DataFrame, identity: str, limit: int, seed: int = 0, order: str | None = None) -> DataFrame:
    """``limit`` rows of the smallest seeded hashes, in the order of ``order``: a partial top-k in each task, then one merge."""
    chosen = rows.select(identity, S.stable_key(seed, F.col(identity)).alias("__key")).orderBy("__key", identity).limit(limit).select(identity)
    kept = rows.join(chosen, identity, "left_semi")
    return kept.orderBy(order) if order else kept


def stratified_split(rows: DataFrame, label: str, identity: str, train_share: float = 0.7, seed: int = 5) -> DataFrame:
    """``rows`` with ``is_train``: of each class the share of the smallest seeded hashes. A class is ranked over many tasks."""
    keyed = rows.withColumn("__key", S.stable_key(seed, F.col(identity)))
    ranked = ranked_within(keyed, label, ["__key", identity], F.substring("__key", 1, 2), "__rank")
    sizes = rows.groupBy(label).agg(F.count("*").alias("__n")).withColumnRenamed(label, "__label")
    return ranked.join(sizes, ranked[label].eqNullSafe(sizes["__label"])).withColumn("is_train", F.col("__rank") <= F.round(F.col("__n") * train_share)).select(
        *rows.columns, "is_train")


def group_split(rows: DataFrame, group: str, label: str, shares: dict[str, float] | None = None, seed: int = 5) -> DataFrame:
    """``rows`` with ``side``: whole groups are dealt to sides, so nothing that belongs together is learned from on one and judged on another.

    ``shares``: parts of all rows, in order (train 0.7, validation 0.1, test 0.2). A group has the label that most of its rows have, of equally frequent ones the
    least. In each such class the groups are laid end to end in seeded order, and a group falls to the side that its middle lies in: so each class has
    its shares but for one group at each cut. A null group is a group, a null label a class. The order is summed up piece by piece, so no class is
    one task's work; rows meet the sides of their groups by one join.
    """
    shares = shares or {"train": 0.7, "validation": 0.1, "test": 0.2}
    per = rows.groupBy(F.col(group).alias("__g"), F.col(label).alias("__l")).agg(F.count("*").alias("__n"))
    groups = per.groupBy("__g").agg(F.sum("__n").alias("__n"), F.min(F.struct((-F.col("__n")).alias("n"), F.col("__l").alias("l")))["l"].alias("__class"))
    keyed = groups.withColumn("__key", S.stable_key(seed, F.coalesce(F.col("__g").cast("string"), F.lit("")))).withColumn("__part", F.substring("__key", 1, 2))
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = before(Window.partitionBy("__class", "__part").orderBy("__key", "__g"))
    pieces = keyed.groupBy(F.col("__class").alias("__c"), F.col("__part").alias("__p")).agg(F.sum("__n").alias("__n")).select(
        "__c", "__p", before(Window.partitionBy("__c").orderBy("__p")).alias("__before"), F.sum("__n").over(Window.partitionBy("__c")).alias("__total"))  # 256 rows a class
    placed = keyed.withColumn("__inside", inside).join(pieces, F.col("__class").eqNullSafe(F.col("__c")) & (F.col("__part") == F.col("__p")))
    middle = (F.col("__inside") + F.col("__before") + F.col("__n") / 2) / F.col("__total")
    side, reached, names = None, 0.0, list(shares)
    for name in names[:-1]:
        reached += shares[name]
        hit = middle < F.lit(round(reached, 12))
        side = F.when(hit, name) if side is None else side.when(hit, name)
    sides = placed.select("__g", (side.otherwise(names[-1]) if side is not None else F.lit(names[-1])).alias("side"))
    return rows.join(sides, F.col(group).eqNullSafe(F.col("__g"))).select(*rows.columns, "side")


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``weight`` = n / (classes * n of the class): a join to a table of one row for each class."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("__n"))
    total = sizes.agg(F.sum("__n").alias("__total"), F.count("*").alias("__k"))
    weights = sizes.crossJoin(total).select(label, (F.col("__total") / (F.col("__k") * F.col("__n"))).alias("weight"))
    return rows.join(weights, label)


def fold_column(rows: DataFrame, label: str, identity: str, folds: int, seed: int = 5) -> DataFrame:
    """``rows`` with ``fold``: classes dealt evenly over the folds in seeded order. A class is ranked over many tasks."""
    keyed = rows.withColumn("__key", S.stable_key(seed, F.col(identity)))
    ranked = ranked_within(keyed, label, ["__key", identity], F.substring("__key", 1, 2), "__rank")
    return ranked.withColumn("fold", ((F.col("__rank") - 1) % folds).cast("int")).select(*rows.columns, "fold")


def balance(rows: DataFrame, label: str, identity: str, strategy: str = "cap-ratio", ratio: float = 3.0, seed: int = 0,
            smallest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` after balancing, and a report (label, before, after). ``none`` keeps all, ``undersample`` cuts each class to the
    smallest, ``cap-ratio`` to ``ratio`` times that; nothing is drawn twice."""
    if strategy not in ("none", "undersample", "cap-ratio"):
        raise ValueError(f"no such strategy: {strategy}")
    kept = rows if strategy == "none" else cap_classes(rows, label, identity, 1.0 if strategy == "undersample" else ratio, seed, smallest)
    count = lambda t, name: t.groupBy(label).agg(F.count("*").alias(name))
    report = count(rows, "before").join(count(kept, "after"), label, "left").select(F.col(label).alias("label"), "before", F.coalesce("after", F.lit(0)).alias("after"))
    return kept, report
