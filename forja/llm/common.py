"""Helpers shared by the operators: tables, shared folder, text as flat byte arrays.

Python stages work on slices of a few megabytes of text, so their memory
depends on the slice (or on one text, if that is longer), not on the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forja.session import shared_dir

SLICE_BYTES = 1 << 20

#: Seeds of the hash family: the bases of the polynomial and of the mixers.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Whole table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return table(spark, sf_dir, "documents")


_roots: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = shared_dir(spark).rstrip("/")
    return f"{_roots[app]}/llm-{app}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the shared folder and read back.

    Cuts the lineage in a way that outlives executors, and lets Spark see
    the real size of the table when it chooses how to join it.  The folder is
    the application's own, see ``clear_written``.
    """
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_written(spark: SparkSession) -> None:
    """Removes all tables that ``written`` made for this application, once no result is read from them any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_key(text: Column) -> Column:
    """128-bit content key of a text (null counts as empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def unused(df: DataFrame, name: str, *others: str) -> str:
    """``name``, lengthened until no column of ``df`` and none of ``others`` has it in any case."""
    taken = {c.lower() for c in (*df.columns, *others)}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; a null key counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % divisor


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column with at most ``limit`` bytes (or one row) each."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null is empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    body = filled.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body and len(filled) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(filled) else np.zeros(1, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse (modulo 2^64)."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        step = [np.full(size, b, dtype=np.uint64) for b in (BASE, BASE_INV)]
        for s in step:
            s[0] = 1
        have = _powers[0] = tuple(np.cumprod(s) for s in step)
    return have[0][:n], have[1][:n]


class Prefix:
    """Prefix sums from which the hash of any byte range follows in O(1)."""

    def __init__(self, data: np.ndarray, codes: np.ndarray = _BYTE_CODES):
        self.up, down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(codes[data] * down[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges [start, stop)."""
        return mix((self.sums[stop] - self.sums[start]) * self.up[start] + (stop - start).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all byte windows of one length."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.up[:n] + np.uint64(length))


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
LOWER_CODES = _BYTE_CODES[_lower]
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, row) of every word: runs of ASCII letters, digits and non-ASCII bytes within a row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = WORD_BYTE[data]
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | fresh[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | fresh[1:-1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.searchsorted(offsets, start, side="right") - 1


def listed(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column whose rows take ``counts`` consecutive values each."""
    ends = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, type=kind))
