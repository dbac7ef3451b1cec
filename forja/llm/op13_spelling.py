"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

Two words one edit apart share all characters before the edit and all after it.
Words are grouped by what they must share if the edit's place (the length of
their longest common prefix) lies in a certain interval; an interval whose
group is too large is halved for that group, down to a single place, where a
group holds no more words than the alphabet has letters.  So no task holds an
unbounded list, and every pair belongs to exactly one group.

Inside a group the words are a sorted list.  A word is scanned against it with
banded rows of the edit matrix: the rows of one list word are kept as far as
the next shares its prefix, and once a row exceeds one edit, the whole range of
words with that prefix is skipped.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forja.llm.common import documents, flat, slices, written
from forja.llm.registry import register

SLICE = 4 << 20
#: Words of one group that are compared as one list; larger groups are divided, never cut.
GROUP = 2_048
LEAST, SHORTEST = 5, 6
#: A variant has a form only if that is so many times as frequent.
TIMES = 5
#: Tokens of more bytes have their checksum computed one by one.
LONG = 64
PAD = "\0\0\0"
LAST = "\U0010ffff"


def crc_table() -> np.ndarray:
    """Checksum steps of the 256 bytes (reversed polynomial of crc32)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


def checksums(data: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """crc32 of the byte ranges, each going on from its own ``seed`` (the crc32 of what stands before it)."""
    step = crc_table()
    out = np.empty(len(start), dtype=np.uint32)
    size = stop - start
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(data[start[i] : stop[i]].tobytes(), int(seed[i]))
    short = np.flatnonzero(size <= LONG)
    short = short[np.argsort(-size[short], kind="stable")]
    state, size, at = seed[short] ^ np.uint32(0xFFFFFFFF), -size[short], start[short]
    for j in range(LONG):
        n = int(np.searchsorted(size, -j, side="left"))  # ranges longer than j
        if not n:
            break
        state[:n] = step[(state[:n] ^ data[at[:n] + j]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    out[short] = state ^ np.uint32(0xFFFFFFFF)
    return out


def runs(column: pa.Array, keys: list[str], garble: int | None) -> pa.Array:
    """The lower-cased runs of letters of all texts, in order.

    Letters are A-Z, a-z and U+00C0 to U+00FF; only A-Z changes.  With
    ``garble``, a run loses the character ``h % length`` where ``garble``
    divides ``h``, the crc32 of ``<key>:<run>``.
    """
    data, offsets = flat(column)
    if not len(data):
        return pa.array([], pa.large_string())
    data = data.copy()
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    inside = (data >= 97) & (data <= 122)
    lead = data == 0xC3  # first of the two bytes of U+00C0 to U+00FF
    inside |= lead
    inside[1:] |= lead[:-1]
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | fresh[1:-1]
    last[:-1] &= ~inside[1:] | fresh[1:-1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    body, size = data[inside], stop - start
    ends = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(size, out=ends[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(body)])
    if garble:
        row = np.searchsorted(offsets, start, side="right") - 1
        seeds = np.array([zlib.crc32(f"{k}:".encode()) for k in keys], dtype=np.uint32)
        h = checksums(data, start, stop, seeds[row])
        hit = np.flatnonzero(h % np.uint32(garble) == 0)
        changed = []
        for word, x in zip(words.take(pa.array(hit)).to_pylist(), h[hit].tolist(), strict=True):
            at = x % len(word)
            changed.append(word[:at] + word[at + 1 :])
        mask = np.zeros(len(words), dtype=bool)
        mask[hit] = True
        words = pc.replace_with_mask(words, pa.array(mask), pa.array(changed, pa.large_string()))
    return words


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id", garble: int | None = None,
               shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): the runs of letters of all whole texts with at least ``shortest`` characters and ``least`` occurrences.

    Null and empty texts have none, a null key counts as ''.  Words are
    counted inside the tasks first, so a word however frequent is a few rows
    of the shuffle.  Very long texts and runs are read whole; repeated rows
    count each; an empty table gives no word; other columns are not read.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                found = runs(batch.column(1).slice(a, b - a), batch.column(0).slice(a, b - a).to_pylist(), garble)
                found = found.filter(pc.greater_equal(pc.utf8_length(found), shortest))
                counted = pc.value_counts(found)
                yield pa.RecordBatch.from_arrays([counted.field(0).cast(pa.string()), counted.field(1).cast(pa.int64())], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    counts = rows.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least)


def scan(words: list[str], query: str, low: int, high: int) -> Iterator[int]:
    """Places in the sorted list of the words one edit from ``query`` whose longest common prefix with it is in [low, high).

    All words share the first ``low`` characters; none is shorter than the
    query, and none longer by more than one character.
    """
    n = len(query)
    q = query + PAD
    # rows[d]: edits between d characters of the list word and d-1, d, d+1 of the query
    rows = [(2, 0, 1)] if not low else [None] * low + [(1, 0, 1)]
    i, before, shared = 0, "", low
    while i < len(words):
        word = words[i]
        if i:
            top = min(len(rows) - 1, len(word))
            shared = low
            while shared < top and before[shared] == word[shared]:
                shared += 1
        del rows[shared + 1 :]
        before = word
        x, y, z = rows[shared]
        over = shared
        for d in range(shared, len(word)):
            c = word[d]
            a = min(y + 1, x + (d == 0 or c != q[d - 1]))
            b = min(y + (c != q[d]), z + 1, a + 1)
            z = min(z + (c != q[d + 1]), b + 1)
            x, y = a, b
            rows.append((x, y, z))
            over = d + 1
            if (x > 1 and y > 1 and z > 1) or (over == high and word[:high] == query[:high]):
                break
        else:
            if (y if len(word) == n else x) == 1:
                yield i
            i += 1
            continue
        i = bisect_left(words, word[:over] + LAST, i + 1)  # the range with this prefix is over one edit (or another group's)


def pairs(words: list[str], size: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Every pair of a sorted group once: a word of ``size`` characters, and its near word (later in the list if as long)."""
    for i, word in enumerate(words):
        if len(word) == size:
            for j in scan(words, word, low, high):
                if len(words[j]) > size or j > i:
                    yield i, j


GROUPED = ("size", "low", "high", "pre", "suf")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, size, low, high) with what their group shares: characters before ``low``, and after an edit before ``high``."""
    return rows.select("word", "n", "size", "low", "high", F.substring("word", F.lit(1), F.col("low")).alias("pre"),
                       F.right("word", F.greatest(F.col("size") - F.col("high"), F.lit(0))).alias("suf"))


def _halved(rows: DataFrame) -> DataFrame:
    """Every row once for either half of its interval of places."""
    middle = F.expr("(low + high + 1) div 2").cast("int")
    halves = F.array(F.struct(F.col("low").alias("l"), middle.alias("h")), F.struct(middle.alias("l"), F.col("high").alias("h")))
    cut = rows.withColumn("half", F.explode(halves)).filter(F.col("half.l") < F.col("half.h"))
    return _keyed(cut.select("word", "n", "size", F.col("half.l").alias("low"), F.col("half.h").alias("high")))


def _compare(keyed: DataFrame) -> DataFrame:
    """Pairs (word, n, near, near_n) of every group, each pair once; tasks read sorted rows and keep one group at a time."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, counts = None, [], []

        def flush(out):
            if key and len(words) > 1:
                for i, j in pairs(words, *key[:3]):
                    out.append((words[i], counts[i], words[j], counts[j]))

        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for word, n, *own in zip(*columns, strict=True):
                if own != key:
                    flush(out)
                    key, words, counts = own, [], []
                words.append(word)
                counts.append(n)
            if out:
                yield _rows(out)
        out = []
        flush(out)
        if out:
            yield _rows(out)

    dealt = keyed.repartition(*GROUPED).sortWithinPartitions(*GROUPED, "word")
    return dealt.mapInArrow(work, "word string, n long, near string, near_n long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.int64())],
                                      names=["word", "n", "near", "near_n"])


def links(spark: SparkSession, words: DataFrame, group: int = GROUP) -> DataFrame:
    """All pairs of near words of (word, n), once each: (word, n, near, near_n)."""
    size = F.length("word")
    whole = words.withColumn("size", F.explode(F.array(size, size - 1)))
    keyed = _halved(whole.select("word", "n", "size", F.lit(0).alias("low"), (F.col("size") + 1).alias("high")))
    found = None
    while True:
        large = (F.count("*") > group) & (F.first("high") - F.first("low") > 1)
        hot = keyed.groupBy(*GROUPED).agg(large.alias("large")).filter("large").select(*GROUPED)
        hot = written(spark, hot, "spelling-groups")  # at most 1 / group of the rows
        any_hot = not hot.isEmpty()
        small = keyed.join(hot, list(GROUPED), "left_anti").select("word", "n", *GROUPED) if any_hot else keyed
        part = _compare(small)
        found = part if found is None else found.unionAll(part)
        if not any_hot:
            return found
        keyed = written(spark, _halved(keyed.join(hot, list(GROUPED), "left_semi")), "spelling-halves")


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word of the chain of forms, by doubling the steps taken in each round."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = written(spark, moved, "spelling-roots")
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def variants(spark: SparkSession, words: DataFrame, word: str = "word", n: str = "n", times: int = TIMES, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a counted vocabulary.

    Near words differ by one inserted, deleted or replaced character.  The
    form is the near word of largest ``n`` (of equal ones the first in the
    order of code points) if that is ``times`` the word's, else null; the root
    is where the chain of forms ends, the word itself if it has none.  Words
    of any length and alphabet; null words are left out, repeated ones have
    their counts added (null: 0), an empty table gives no row, other columns
    are not read.
    """
    own = words.select(F.col(word).alias("word"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n")).filter("word IS NOT NULL")
    own = written(spark, own.groupBy("word").agg(F.sum("n").alias("n")), "spelling-words")
    found = links(spark, own, group)
    both = F.array(F.struct("word", "n", F.col("near").alias("other"), F.col("near_n").alias("other_n")),
                   F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = found.select(F.explode(both).alias("l")).select("l.*").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    rows = own.join(best, "word", "left")
    enough = -F.col("best.m") >= F.col("n") * times
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                       F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"))
    rows = written(spark, rows, "spelling-forms")
    ends = roots(spark, rows.filter("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@register()
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of all words of the whole documents."""
    return variants(spark, vocabulary(documents(spark, sf_dir), garble=199))
