"""Random forests: scrap rate, machine state, minutes to the next tool change."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forja.ml import trees as grown

SEED = 42
DEEPEST = 30  # the deepest trees that Spark grows
#: Bound on the leaves of a deep tree: a leaf holds at least 1 / LEAVES of the rows, so the trees on the driver do not grow with the data.
LEAVES = 512
#: A pass splits as many nodes as a gigabyte of statistics holds.
GROWTH = {"checkpointInterval": 10, "maxMemoryInMB": 1024, "seed": SEED}
#: Up to this depth, which bounds a tree to 1,024 leaves, rows walk their trees anew in each pass: node ids, kept in several copies,
#: take 4 bytes a row, tree and copy.
WALKED = 10


def fit_regressor(train: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 10,
                  leaf: int = 5, prediction: str = "pred") -> PipelineModel:
    """Forest over all features at each split; leaves hold ``leaf`` rows.

    Trees of more than WALKED levels are Spark's own, and their leaves hold more rows where LEAVES asks for it.
    """
    vector = VectorAssembler(inputCols=list(features), outputCol="features")

    def forest(rows: int) -> RandomForestRegressor:
        return RandomForestRegressor(labelCol=label, predictionCol=prediction, numTrees=trees, maxDepth=depth,
                                     minInstancesPerNode=rows, featureSubsetStrategy="all", cacheNodeIds=depth > WALKED, **GROWTH)

    if depth <= WALKED:
        return grown.fit(train, vector, forest(leaf))
    return _fitted(train, leaf, lambda rows: [vector, forest(rows)])


def _fitted(train: DataFrame, leaf: int, stages: Callable[[int], list]) -> PipelineModel:
    """Fits the stages for the rows that a leaf must hold; the training rows are computed once for all passes."""
    train = train.persist()
    try:
        return Pipeline(stages=stages(leaf_rows(train, leaf))).fit(train)
    finally:
        train.unpersist()


def leaf_rows(train: DataFrame, least: int) -> int:
    """Rows that a leaf of a deep tree must hold."""
    return max(least, -(-train.count() // LEAVES))


def fit_classifier(train: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 12,
                   leaf: int = 2) -> PipelineModel:
    """Forest with classes in alphabetical order."""
    return _fitted(train, leaf, lambda rows: [
        StringIndexer(inputCol=label, outputCol="label_ix", stringOrderType="alphabetAsc", handleInvalid="keep"),
        VectorAssembler(inputCols=list(features), outputCol="features"),
        RandomForestClassifier(labelCol="label_ix", predictionCol="pred_ix", numTrees=trees, maxDepth=depth,
                               minInstancesPerNode=rows, cacheNodeIds=depth > WALKED, **GROWTH),
    ])


def classes(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predict_regression(model: PipelineModel, rows: DataFrame) -> DataFrame:
    *before, vector, forest = _flat(model)
    if forest.getMaxDepth() > WALKED:
        return model.transform(rows).drop("features")
    return grown.predict(forest, PipelineModel(before).transform(rows), vector.getInputCols())


def _flat(model: PipelineModel) -> list:
    """The stages of a model, those of models in it too."""
    return [s for stage in model.stages for s in (_flat(stage) if isinstance(stage, PipelineModel) else [stage])]


def predict_state(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Predicted class, its confidence and the probability of every class."""
    names = classes(model)
    scoring = PipelineModel(model.stages[1:])  # new rows carry no label
    p = scoring.transform(rows).withColumn("p", vector_to_array("probability"))
    label = F.get(F.array(*[F.lit(n) for n in names]), F.col("pred_ix").cast("int"))
    probs = F.struct(*[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return p.withColumns({
        "estado_predicho": label, "confianza": F.array_max(F.slice("p", 1, len(names))), "probabilidades": probs,
    }).drop("features", "rawPrediction", "probability", "pred_ix", "p")


def importances(model: PipelineModel, features: Sequence[str], like: DataFrame) -> DataFrame:
    """Feature and importance rows, most important first."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    rows = list(zip(features, values, strict=True))
    return like.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def report(predicted: DataFrame, truth: str, pred: str, metrics: DataFrame, ranks: DataFrame) -> DataFrame:
    """Training report as rows (seccion, nombre, valor)."""
    names = metrics.columns
    m = metrics.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], list(names), "nombre", "valor")
    s = predicted.agg(*[fn(c).alias(f"{c}_{n}") for c in (truth, pred) for n, fn in (("media", F.avg), ("minimo", F.min), ("maximo", F.max))])
    s = s.unpivot([], list(s.columns), "nombre", "valor")
    parts = [("metricas", m), ("predicciones", s), ("importancia", ranks.select(F.col("feature").alias("nombre"), F.col("importance").alias("valor")))]
    out = None
    for section, df in parts:
        one = df.select(F.lit(section).alias("seccion"), "nombre", "valor")
        out = one if out is None else out.unionByName(one)
    return out
