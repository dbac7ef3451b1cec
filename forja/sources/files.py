"""Readers of the factory files and writers of the results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forja import schemas
from forja.sources import conform


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV by header name: header padding is ignored, missing columns are NULL.

    Only the header line is looked at before the job; columns are then read
    as text and cast to ``schema`` with ``try_cast``, so one bad cell never
    fails or shifts a row.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=False,
                         ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=False)
    names = {c.strip(): c for c in raw.columns}
    cols = []
    for f in schema.fields:
        if f.name in names:
            cols.append(F.col(f"`{names[f.name]}`").try_cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def read_refs(spark: SparkSession, path: str) -> DataFrame:
    return conform.conform_refs(read_csv(spark, path, schemas.REFS))


def read_rates(spark: SparkSession, path: str, refs: DataFrame) -> DataFrame:
    """Rates, or zero rates per reference if the file does not exist."""
    try:
        header = spark.read.csv(path, header=True).columns
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return conform.default_rates(refs)
    have = {c.strip() for c in header}
    schema = T.StructType([f for f in schemas.RATES.fields if f.name in have])
    return conform.conform_rates(read_csv(spark, path, schema))


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    return conform.conform_orders(read_csv(spark, path, schemas.ORDERS))


def read_operations(spark: SparkSession, path: str) -> DataFrame:
    """Recorded operations with every id as text, so no zero is lost."""
    return read_csv(spark, path, schemas.OPERATIONS)


def read_purchases(spark: SparkSession, path: str) -> DataFrame:
    return conform.conform_purchases(read_csv(spark, path, schemas.PURCHASES))


def read_stock(spark: SparkSession, path: str) -> DataFrame:
    return conform.conform_stock(read_csv(spark, path, schemas.STOCK))


def read_labour(spark: SparkSession, path: str) -> DataFrame:
    return conform.conform_labour(read_csv(spark, path, schemas.LABOUR))


def read_tool_changes(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.TOOL_CHANGES)


def read_order_life(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Order documents: JSON Lines as written here, or one JSON array."""
    return spark.read.schema(schemas.ORDER_LIFE).json(path, multiLine=multiline)


def scan_order_life(spark: SparkSession, path: str, out: str, multiline: bool = False) -> DataFrame:
    """Order documents with ``archivo``, ``registro`` and ``motivo``, stored under ``out`` in a folder per reason.

    ``motivo`` is NULL for a sound document, else ``ilegible`` (no JSON, or a
    JSON array file broken anywhere), ``tipo`` (a field of another type: that
    field is NULL, the others are read), ``sin_of`` (no order id) or
    ``sin_operaciones``.  ``registro`` is the text of a document that could not
    be read in full.  A bad document never fails the scan.  The documents are
    parsed once, with all their fields: a reader that skips a field would not
    see that it is bad.
    """
    schema = T.StructType([*schemas.ORDER_LIFE.fields, T.StructField("registro", T.StringType(), True)])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "registro").json(path, multiLine=multiline)
    known = F.trim(F.coalesce("work_order_id", F.lit(""))) != ""
    rows = rows.select("*", F.col("_metadata.file_path").alias("archivo")).withColumn(
        "motivo",
        F.when(F.col("registro").isNotNull() & ~known, "ilegible").when(F.col("registro").isNotNull(), "tipo")
        .when(~known, "sin_of").when(F.coalesce(F.size("operaciones"), F.lit(0)) <= 0, "sin_operaciones"))
    rows.write.mode("overwrite").partitionBy("motivo").parquet(out)
    return spark.read.schema(rows.schema).parquet(out)


def sound_order_life(scanned: DataFrame) -> DataFrame:
    """The sound documents of ``scan_order_life``."""
    return scanned.where(F.col("motivo").isNull()).select(*schemas.ORDER_LIFE.names)


def quarantine(scanned: DataFrame) -> DataFrame:
    """The bad documents of ``scan_order_life`` with all that was read of them."""
    return scanned.where(F.col("motivo").isNotNull())


def write_order_life(life: DataFrame, path: str) -> None:
    """One JSON document per order and line; times in ISO form."""
    life.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").option(
        "ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet; facts are partitioned by month so date filters prune files."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
