"""Order duration from reference and quantity."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def total_time(life: DataFrame) -> DataFrame:
    """Target: lead time plus incident minutes."""
    made = F.col("fabricacion_duracion_min") + F.col("incidencias_duracion_total")
    return life.withColumn("tiempo_total_min", made)


def fit_duration(train: DataFrame) -> PipelineModel:
    """Linear regression on one-hot reference and launched quantity."""
    rows = train.dropna(subset=["ref_id_str", "cantidad_lanzada", "tiempo_total_min"])
    return Pipeline(stages=[
        StringIndexer(inputCol="ref_id_str", outputCol="ref_ix", handleInvalid="keep"),
        OneHotEncoder(inputCol="ref_ix", outputCol="ref_vec", dropLast=False),
        VectorAssembler(inputCols=["ref_vec", "cantidad_lanzada"], outputCol="features"),
        LinearRegression(featuresCol="features", labelCol="tiempo_total_min", predictionCol="pred_tiempo_total_min"),
    ]).fit(rows)


def predict_duration(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows.dropna(subset=["ref_id_str", "cantidad_lanzada"]))
    p = F.col("pred_tiempo_total_min")
    return out.withColumns({"pred_tiempo_total_horas": p / 60, "pred_tiempo_total_dias": p / 1440}).drop("ref_ix", "ref_vec", "features")


def known_references(train: DataFrame) -> DataFrame:
    return train.where(F.col("ref_id_str").isNotNull()).select("ref_id_str").distinct()


def predict_scenarios(model: PipelineModel, scenarios: DataFrame, known: DataFrame, strict: bool = False) -> DataFrame:
    """Scores scenarios of known references; others carry an error text.

    With ``strict`` a single unknown reference raises instead.
    """
    unknown = scenarios.join(known, "ref_id_str", "left_anti")
    if strict:
        bad = unknown.limit(1).collect()
        if bad:
            raise ValueError(f"unknown reference {bad[0]['ref_id_str']}: no prediction")
    good = predict_duration(model, scenarios.join(known, "ref_id_str", "left_semi")).withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(unknown.withColumn("error", F.lit("referencia desconocida")), allowMissingColumns=True)
