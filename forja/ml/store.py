"""Versioned model store in a shared folder."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = ("name string, version int, kind string, features array<string>, classes array<string>, "
          "metrics map<string,double>, path string")


def scaler_stage(stats: DataFrame, cols: Sequence[str]) -> SQLTransformer:
    """The scaling of ``metrics.scaler_stats`` (one row) as a stage that is stored with its model."""
    row = stats.first()
    z = ", ".join(f"(`{c}` - {float(row[f'media_{c}'] or 0.0)!r}D) / {float(row[f'desv_{c}'] or 1.0)!r}D AS `z_{c}`" for c in cols)
    return SQLTransformer(statement=f"SELECT *, {z} FROM __THIS__")


def scaled_model(stats: DataFrame, cols: Sequence[str], *stages: Transformer, assemble: bool = False) -> PipelineModel:
    """Scaler and fitted stages as one model that scores unscaled rows; ``assemble`` adds the feature vector."""
    vector = [VectorAssembler(inputCols=[f"z_{c}" for c in cols], outputCol="features")] if assemble else []
    return PipelineModel([scaler_stage(stats, cols), *vector, *stages])


def list_models(spark: SparkSession, root: str) -> DataFrame:
    """Stored models with features, classes and metrics."""
    try:
        return spark.read.schema(SCHEMA).option("recursiveFileLookup", True).json(f"{root}/_models")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def _claim(spark: SparkSession, root: str, name: str, version: int) -> bool:
    """Whether this caller now owns the version: its claim file is created only if it is absent."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_claims/{name}/{version}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":  # Hadoop's local file system checks, then creates; Java's own call is one step
        local = spark._jvm.java.io.File(fs.makeQualified(at).toUri().getPath())
        local.getParentFile().mkdirs()
        return local.createNewFile()
    try:
        fs.create(at, False).close()
    except Py4JJavaError as e:
        if not e.java_exception.getClass().getSimpleName().endswith("FileAlreadyExistsException"):
            raise
        return False
    return True


def save_model(spark: SparkSession, root: str, name: str, model: PipelineModel, features: Sequence[str],
               metrics: Mapping[str, float], classes: Sequence[str] = (), kind: str = "") -> int:
    """Writes the next free version of ``name``, then its row; returns the version.

    A version belongs to who creates its claim file (atomic on file systems
    with exclusive creation, as Hadoop's), so savers at the same time get
    different ones; each row is a folder of its own.  A saver that dies leaves its version unlisted.
    """
    last = list_models(spark, root).where(F.col("name") == name).agg(F.max("version").alias("v")).first()["v"]
    version = (last or 0) + 1
    while not _claim(spark, root, name, version):
        version += 1
    path = f"{root}/{name}/{version}"
    model.write().overwrite().save(path)
    row = (name, version, kind, list(features), list(classes), {k: float(v) for k, v in metrics.items()}, path)
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("overwrite").json(f"{root}/_models/{name}-{version}")
    return version


def load_model(spark: SparkSession, root: str, name: str, version: int | None = None) -> tuple[PipelineModel, list[str]]:
    """A stored model (the newest by default) and its feature list."""
    rows = list_models(spark, root).where(F.col("name") == name)
    if version is not None:
        rows = rows.where(F.col("version") == version)
    found = rows.orderBy(F.desc("version")).limit(1).collect()
    if not found:
        raise KeyError(f"no stored model {name!r}" + (f" version {version}" if version else ""))
    return PipelineModel.load(found[0]["path"]), list(found[0]["features"])
