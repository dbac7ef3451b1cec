"""Derived tables written once per application and read by every query.

The derived fact is the analogue of the loaded and joined production table:
it is written as Parquet into the shared folder (``spark.checkpoint.dir``),
so later queries scan only the columns they name and nothing is recomputed
when an executor is lost.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from forja.session import shared_dir

_ready: dict[tuple[str, str, str], tuple[str, StructType]] = {}
_roots: dict[str, str] = {}
#: Raised whenever a derived table changes its meaning, so that none of an older kind is read again.
VERSION = 2


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Digest of the files behind ``sf_dir``: names, sizes and times, as the store reports them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = []
    for status in fs.listStatus(path):
        inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        parts += [(str(x.getPath().getName()), x.getLen(), x.getModificationTime()) for x in inner]
    return hashlib.md5(repr((VERSION, sf_dir, sorted(parts))).encode()).hexdigest()[:16]


def out_dir(spark: SparkSession, sf_dir: str) -> str:
    """Folder for tables derived from ``sf_dir`` as it is now.

    It is named after the source's fingerprint, so another application with
    the same shared folder finds what is there, and changed sources get a
    folder of their own.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = shared_dir(spark)
    return f"{_roots[app]}/forja-{fingerprint(spark, sf_dir)}"


def _complete(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """Table ``name`` of ``sf_dir``; ``build`` runs only if no complete copy is there.

    ``by`` names the column whose values become folders.
    """
    folder = out_dir(spark, sf_dir)
    key = (folder, name, by or "")
    if key not in _ready:
        path = f"{folder}/{name}"
        df = build()
        if not _complete(spark, path):
            writer = df.hint("rebalance", by).write.partitionBy(by) if by else df.write
            writer.mode("overwrite").parquet(path)
        _ready[key] = (path, df.schema)
    path, schema = _ready[key]
    return spark.read.schema(schema).parquet(path)


_temporary: dict[str, list[str]] = {}


def temporary_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``clear_temporary`` removes what lies there."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = shared_dir(spark)
    path = f"{_roots[app]}/forja-tmp-{app}/{name}-{uuid.uuid4().hex}"
    _temporary.setdefault(app, []).append(path)
    return path


def temporary(spark: SparkSession, df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written into the shared folder (at ``path`` if given) and read back: lineage is cut and survives lost executors.

    ``clear_temporary`` removes what this application wrote, once its results are no longer read.
    """
    path = path or temporary_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_temporary(spark: SparkSession, path: str) -> None:
    """Removes one temporary table that is no longer read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _temporary[spark.sparkContext.applicationId].remove(path)


def clear_temporary(spark: SparkSession) -> None:
    """Removes the temporary tables of this application."""
    for path in list(_temporary.get(spark.sparkContext.applicationId, [])):
        drop_temporary(spark, path)
