"""The device selector: a weighted random forest, chosen by cross-validation where the data allow it."""

from __future__ import annotations

from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from . import sampling, scores as C

#: The searched grid, 3 * 4 * 3 * 3 * 2 = 216 combinations; and when rows are too few to search.
GRID = {"numTrees": (100, 200, 500), "maxDepth": (8, 14, 20, 30), "minInstancesPerNode": (1, 2, 4), "minInfoGain": (0.0, 0.001, 0.01), "bootstrap": (True, False)}
FEW_ROWS, FEW_OF_A_CLASS, SMALL_TREES, PLAIN_TREES, MAX_FOLDS, SEED = 20, 2, 200, 500, 5, 5


#: Fits of the search that run at the same time.
PARALLEL_FITS = 4


def grid(options: dict[str, tuple] = GRID) -> list[dict]:
    return [dict(zip(options, values)) for values in product(*options.values())]


def plan(rows: int, smallest_class: int) -> tuple[str, int]:
    """How to fit: (small, trees), (plain, trees) or (search, folds). Too few rows or a class of one forbid a search."""
    if rows < FEW_ROWS or smallest_class < FEW_OF_A_CLASS:
        return "small", SMALL_TREES
    folds = min(MAX_FOLDS, smallest_class)
    return ("search", folds) if folds >= 2 else ("plain", PLAIN_TREES)


def train(samples: DataFrame, feature_names: list[str], label: str = "label", identity: str = "circuit",
          options: dict[str, tuple] = GRID) -> PipelineModel:
    """Fit on ``samples`` (a column for each feature). The best combination is refitted on all rows, classes weighted evenly."""
    counts = samples.groupBy(label).agg(F.count("*").alias("n")).agg(F.sum("n"), F.min("n")).first()
    kind, size = plan(counts[0] or 0, counts[1] or 0)
    weighted = sampling.balanced_weights(samples, label)
    forest = RandomForestClassifier(labelCol="label_index", featuresCol="features_vector", weightCol="weight", seed=SEED)
    stages = [StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc"),
              VectorAssembler(inputCols=feature_names, outputCol="features_vector"), forest]
    pipeline = Pipeline(stages=stages)
    if kind != "search":
        forest.setNumTrees(size)
        return pipeline.fit(weighted)
    builder = ParamGridBuilder()
    for name, values in options.items():
        builder = builder.addGrid(forest.getParam(name), list(values))
    folded = sampling.fold_column(weighted, label, identity, size, SEED)
    search = CrossValidator(estimator=pipeline, estimatorParamMaps=builder.build(), numFolds=size, foldCol="fold", seed=SEED, parallelism=PARALLEL_FITS,
                            evaluator=MulticlassClassificationEvaluator(labelCol="label_index", metricName="accuracy"))
    return search.fit(folded).bestModel


def predict(model: PipelineModel, samples: DataFrame) -> DataFrame:
    """``samples`` with ``predicted``, the label that the model gives."""
    labels = F.array(*[F.lit(x) for x in model.stages[0].labels])
    weighted = samples if "weight" in samples.columns else samples.withColumn("weight", F.lit(1.0))
    found = model.transform(weighted).withColumn("predicted", F.element_at(labels, (F.col("prediction") + 1).cast("int")))
    return found.select(*samples.columns, "predicted")


def train_held_out(samples: DataFrame, feature_names: list[str], group: str, scores: DataFrame, baseline: str, label: str = "label", identity: str = "circuit",
                   options: dict[str, tuple] = GRID, shares: dict[str, float] | None = None) -> tuple[PipelineModel, DataFrame, DataFrame, DataFrame]:
    """A model fitted without the test side of :func:`.sampling.group_split`, and what it does there: predictions, confusion, and one row of wins, ties,
    losses and regret against always choosing the device ``baseline``.

    Test rows whose label the training side lacks keep it in the confusion: they count as errors, and are not left out.
    """
    split = sampling.group_split(samples, group, label, shares)
    model = train(split.where("side <> 'test'").drop("side"), feature_names, label, identity, options)
    test = split.where("side = 'test'").drop("side")
    indexer = model.stages[0].setHandleInvalid("keep")
    tested = predict(PipelineModel([indexer, *model.stages[1:]]), test)
    choices = tested.select(F.col(identity).alias("circuit"), F.col("predicted").alias("first"), F.lit(baseline).alias("second"))
    return model, tested, C.confusion(tested, label), C.comparison(C.paired_outcomes(scores, choices))


def load(path: str) -> PipelineModel:
    """A saved model, or an error that says which folder holds none."""
    try:
        return PipelineModel.load(path)
    except Exception as error:
        raise ValueError(f"no usable selector model in {path}: {str(error).splitlines()[0]}") from error


def save_checked(model: PipelineModel, path: str, sample: DataFrame) -> PipelineModel:
    """Save beside ``path``, load again and predict one row; only then does the new model take the old one's place, which stays at
    ``path``-before until the next save."""
    spark = sample.sparkSession
    beside, before = f"{path}-new", f"{path}-before"
    model.write().overwrite().save(beside)
    load(beside).transform(sample.limit(1)).select("prediction").collect()
    hadoop = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(hadoop(path)):
        files.delete(hadoop(before), True)
        files.rename(hadoop(path), hadoop(before))
    if not files.rename(hadoop(beside), hadoop(path)):
        raise OSError(f"{beside} could not be moved to {path}")
    return load(path)
