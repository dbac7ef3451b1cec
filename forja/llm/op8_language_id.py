"""Language identification with blended-spectrum string kernels.

A text is the set of hashed character n-grams (n = 1, 2, 3) that occur in it;
the kernel of two texts is the cosine of these sets.  Nyström landmarks (a few
texts per language) map every text to a short vector, on which one-versus-rest
ridge regressions are solved.  Scoring is two matrix products per batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forja.llm.common import crc_mod, documents, flat, mix, slices
from forja.llm.registry import register

BITS = 12
#: Bounds of the training sample: texts per language to fit on (on average), and of these as landmarks.
PER_LANGUAGE = 500
LANDMARKS = 64
RIDGE = 1e-2
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), dtype=np.uint8).astype(bool)
    return _letters


def presence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(which of the 2^BITS hashed n-grams occur, whether there is a letter) for each text; null counts as ''."""
    lowered = pc.utf8_lower(pc.fill_null(column, ""))
    data, offsets = flat(lowered)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    starts_at = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=starts_at[1:])
    ends = starts_at[offsets]
    rows = len(ends) - 1
    letter = _letter_table()[points]
    row = np.repeat(np.arange(rows), np.diff(ends))
    has = np.bincount(row[letter], minlength=rows)[:rows] > 0
    seen = np.zeros((rows, 1 << BITS), dtype=bool)
    code = np.where(letter, points, 32).astype(np.uint64)
    if len(code):
        code[1:][~letter[1:] & ~letter[:-1]] = 0  # runs of other characters: a single gap
        keep = (code != 0) | (row != np.concatenate([[-1], row[:-1]]))
        code, row = code[keep], row[keep]
        gram, shift = code.copy(), np.uint64(64 - BITS)
        for n in (1, 2, 3):
            if n > 1:
                gram = gram[:-1] * np.uint64(0x10FFFF + 2) + code[n - 1 :]
            same = row[n - 1 :] == row[: len(gram)]
            slot = (mix(gram * np.uint64(4) + np.uint64(n)) >> shift).astype(np.int64)
            seen.reshape(-1)[(row[: len(gram)][same] << BITS) + slot[same]] = True
    return seen, has


def unit(seen: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; an empty row stays 0."""
    x = seen.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


@dataclass
class Kernel:
    """Fitted model: landmarks and the regression on top of them."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """One regression value per text and language."""
        k = unit(seen) @ self.landmarks.T
        return np.hstack([k, np.ones((len(k), 1), np.float32)]) @ self.weights


def fit(seen: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Kernel | None:
    """Kernel ridge regression on the Nyström features of a sample; None without rows."""
    if not labels:
        return None
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    chosen = np.concatenate([np.flatnonzero(y == c)[:landmarks] for c in range(len(languages))])
    x = unit(seen)
    base = x[chosen]
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    good = values > 1e-6 * values.max() if len(values) else values > 0
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.hstack([(x @ base.T).astype(np.float64) @ root, np.ones((len(x), 1))])
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1.0 / np.bincount(y)[y]  # each language counts alike
    gram = (phi * weight[:, None]).T @ phi
    solved = np.linalg.solve(gram + ridge * np.eye(len(gram)) * np.trace(gram) / len(gram), (phi * weight[:, None]).T @ target)
    weights = np.vstack([root @ solved[:-1], solved[-1:]])
    return Kernel(languages, base.astype(np.float32), weights.astype(np.float32))


def train(docs: DataFrame, text: str, lang: str, key: str, per_language: int = PER_LANGUAGE) -> Kernel | None:
    """Model from the rows of ``docs``.

    The sample holds, by the hash of ``key``, about ``per_language`` texts of
    each language: that bounds what reaches the driver (one bit set of 2^BITS
    bits per text, however long the text is).
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not counts:
        return None
    steps = 1 << 20
    limit = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, int(min(1.0, per_language / n) * steps))])
    order = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(steps))
    sample = known.select(F.col(text).alias("text"), F.col(lang).alias("lang"), order.alias("o")).filter(F.col("o") < limit[F.col("lang")])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                part = batch.slice(start, stop - start)
                seen, has = presence(part.column(0))
                packed = [row.tobytes() for row in np.packbits(seen, axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.array(packed, pa.binary()), pa.array(has)], names=["lang", "o", "bits", "has"])

    rows = sample.mapInArrow(bits, "lang string, o long, bits binary, has boolean").filter("has").collect()
    rows.sort(key=lambda r: (r["lang"], r["o"], bytes(r["bits"])))
    if not rows:
        return None
    seen = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(bool)
    return fit(seen, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Kernel | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language of ``text`` and its score (0 to 1, softmax of the regression values).

    A text that is null or has no letter is ``und`` with score 0, as is every
    text if the model saw no row.  The whole text counts.  Rows are worked
    alone, ties go to the language first in the alphabet, other columns are
    passed on (those called ``lang_pred`` or ``score`` are replaced).
    """
    fields = [f for f in docs.schema if f.name.lower() not in (lang.lower(), score.lower())]
    schema = T.StructType([*fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: languages x LANDMARKS rows of 2^BITS numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for start, stop in slices(column):
                part = batch.slice(start, stop - start)
                if kernel is None:
                    names, points = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                else:
                    seen, has = presence(column.slice(start, stop - start))
                    values = kernel.scores(seen).astype(np.float64) * 3
                    best = values.argmax(axis=1)
                    odds = np.exp(values - values.max(axis=1, keepdims=True))
                    points = np.where(has, odds.max(axis=1) / odds.sum(axis=1), 0.0)
                    names = [kernel.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
                columns = [part.column(part.schema.get_field_index(f.name)) for f in fields]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(points, pa.float64())],
                                                 names=[*(f.name for f in fields), lang, score])

    return docs.mapInArrow(work, schema)


def held_out(key: Column) -> Column:
    """Rows that no model may learn from."""
    return crc_mod(key, 5) == 0


@register()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learned from the rows that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.filter(~F.col("held_out")), "text", "lang", "doc_id")
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
