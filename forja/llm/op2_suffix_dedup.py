"""Removal of repeated substrings: suffixes sorted by most significant digits, up to a length limit.

A suffix matters only through its first ``length`` bytes, its window.  The
windows of all texts are sorted digit by digit; what is alone in its group
after a digit leaves, and what is surely repeated needs no further digit:

1. The first digit is the window's minimiser, the smallest hash of GRAM bytes
   inside it.  Neighbouring windows share one (an anchor), so one suffix in a
   hundred is sorted.  Anchors whose GRAM bytes occur once leave.
2. The second digit is all that a window of the anchor could read.  Anchors
   equal in it are repeats as a whole; one of them stands in for the others.
3. The third digit is that of BLOCK neighbouring windows of an anchor: a block
   whose common bytes occur once leaves, one whose bytes all repeat is a repeat.
4. The last digit is the window itself, for the blocks left over.

Groups of at least two windows are exactly the repeated substrings.  Copies of
a text share its content key and are read once.  Positions that come back to a
text are compared with its own hashes before they are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forja.llm.common import Prefix, documents, flat, listed, mix, slices, unused, written
from forja.llm.registry import register

LENGTH = 400
GRAM = 192
BLOCK = 16

WHOLE, PART, MODEL, RUN, SINGLE = 1, 2, 3, 4, 5
#: A mark on a text: position of an anchor (of a window if SINGLE), its hashes, and the block of a RUN.
_MARK = "struct<pos:int,kind:int,block:int,first:bigint,second:bigint>"


def text_id(text: Column) -> list[Column]:
    """128-bit content hash of a text, as two columns."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("__a"), F.xxhash64(F.lit(3), text).alias("__b")]


class Slice:
    """Windows of some texts, laid end to end, and their anchors."""

    def __init__(self, column: pa.Array, length: int, gram: int):
        self.data, self.offsets = flat(column)
        self.length, self.gram, self.reach = length, gram, length - gram + 1
        self.prefix = Prefix(self.data)
        none = np.zeros(0, np.int64)
        self.starts, self.anchor_of, self.codes = none, none, np.zeros(0, np.uint64)
        n = len(self.data) - length + 1
        if n <= 0:
            return
        row = np.repeat(np.arange(len(self.offsets) - 1, dtype=np.int32), np.diff(self.offsets))
        self.starts = np.flatnonzero(row[:n] == row[length - 1 :])
        self.codes = self.prefix.windows(gram)
        best = np.arange(len(self.codes), dtype=np.int32)
        size = 1
        while size < self.reach:  # leftmost smallest code among ``size`` positions, doubled up to ``reach``
            step = min(size, self.reach - size)
            right = best[step:]
            left = best[: len(right)]
            best = np.where(self.codes[left] <= self.codes[right], left, right)
            size += step
        self.anchor_of = best[self.starts].astype(np.int64)

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, side="right") - 1

    def second(self, at: np.ndarray) -> np.ndarray:
        """Second digit of anchors: hash of all that their windows can read within the text."""
        row = self.row_of(at)
        low = np.maximum(at - self.reach + 1, self.offsets[row])
        high = np.minimum(at + self.length, self.offsets[row + 1])
        return mix(self.prefix.ranges(low, high) + (at - low).astype(np.uint64))

    def run(self, at: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Third digit of blocks: hashes of the bytes common to their windows, and of all their bytes.

        A block that would read beyond its text gets a hash of its own place for the latter.
        """
        row, near = self.row_of(at), block.astype(np.int64) * BLOCK
        salt = self.codes[at] + near.astype(np.uint64)
        core = self.prefix.ranges(at - near, at - near + self.length - BLOCK + 1)
        low, high = at - near - BLOCK + 1, at - near + self.length
        inside = (low >= self.offsets[row]) & (high <= self.offsets[row + 1])
        full = self.prefix.ranges(np.where(inside, low, 0), np.where(inside, high, 0))
        return mix(core + salt), np.where(inside, mix(full + salt), np.uint64(0))

    def single(self, start: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Last digit: hash of whole windows."""
        return mix(self.prefix.ranges(start, start + self.length) + self.codes[at])

    def marked(self, marks: pa.Array, kinds: tuple[int, ...]) -> tuple[np.ndarray, ...]:
        """(row, place, kind, block, first, second) of the marks of these kinds that fit their text."""
        counts = pa.compute.fill_null(pa.compute.list_value_length(marks), 0).to_numpy(zero_copy_only=False)
        pos, kind, block, first, second = (marks.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(5))
        row = np.repeat(np.arange(len(counts)), counts)
        at = self.offsets[row] + pos
        keep = np.isin(kind, kinds) & (at + self.gram <= self.offsets[row + 1])
        row, at, kind, block = row[keep], at[keep], kind[keep], block[keep]
        first, second = first[keep].view(np.uint64), second[keep].view(np.uint64)
        true = (kind == SINGLE) | (kind == RUN) | (self.codes[at] == first)  # these two have hashes of their own
        return row[true], at[true], kind[true], block[true], first[true], second[true]

    def windows_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, index into ``at``) of the windows whose anchor is in ``at`` (sorted, distinct)."""
        if not len(at) or not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(at, self.anchor_of), len(at) - 1)
        hit = np.flatnonzero(at[place] == self.anchor_of)
        return self.starts[hit], place[hit]


def _anchors(docs: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """A row per text with its anchors; ``rid`` numbers the rows of the table that this is written to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, j in slices(batch.column(2)):
                part = batch.slice(i, j - i)
                piece = Slice(part.column(2), length, gram)
                at = np.unique(piece.anchor_of)
                row = piece.row_of(at)
                counts = np.bincount(row, minlength=j - i)
                lists = [listed((at - piece.offsets[row]).astype(np.int32), counts, pa.int32()),
                         listed(piece.codes[at].view(np.int64), counts, pa.int64()), listed(piece.second(at).view(np.int64), counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rid, rid + j - i)), part.column(0), part.column(1), *lists], names=["rid", "__a", "__b", "pos", "first", "second"])
                rid += j - i

    rows = docs.filter(F.octet_length(text) >= length).select(*text_id(F.col(text)), F.col(text).alias("text"))
    return rows.mapInArrow(work, "rid long, __a long, __b long, pos array<int>, first array<bigint>, second array<bigint>")


def _blocks(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(core, full, rid, pos, block, first, sought) of the blocks of anchors that need a third digit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(1)):
                part = batch.slice(i, j - i)
                piece = Slice(part.column(1), length, gram)
                row, at, kind, *_ = piece.marked(part.column(2), (PART, MODEL))
                order = np.argsort(at)
                row, at, kind = row[order], at[order], kind[order]
                start, owner = piece.windows_of(at)
                pairs = np.unique(owner * (1 << 20) + (at[owner] - start) // BLOCK)
                owner, block = pairs >> 20, pairs & ((1 << 20) - 1)
                core, full = piece.run(at[owner], block)
                lone = full == 0
                rids = part.column(0).to_numpy(zero_copy_only=False)[row[owner]]
                pos = at[owner] - piece.offsets[row[owner]]
                own = mix(rids.astype(np.uint64) * np.uint64(1 << 24) + pos.astype(np.uint64)) + block.astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.view(np.int64)), pa.array(np.where(lone, own, full).view(np.int64)), pa.array(rids), pa.array(pos.astype(np.int32)),
                     pa.array(block.astype(np.int32)), pa.array(piece.codes[at[owner]].view(np.int64)), pa.array(kind[owner] == PART)],
                    names=["core", "full", "rid", "pos", "block", "first", "sought"])

    return texts.mapInArrow(work, "core long, full long, rid long, pos int, block int, first long, sought boolean")


def _windows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(code, rid, pos, sought) of the single windows of marked blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(1)):
                part = batch.slice(i, j - i)
                piece = Slice(part.column(1), length, gram)
                row, at, kind, block, *_ = piece.marked(part.column(2), (PART, MODEL))
                span = np.int64(1 << 20)
                wanted, where = np.unique(at * span + block, return_index=True)
                anchors = np.unique(at)
                start, owner = piece.windows_of(anchors)
                key = anchors[owner] * span + (anchors[owner] - start) // BLOCK
                place = np.minimum(np.searchsorted(wanted, key), max(len(wanted) - 1, 0))
                hit = wanted[place] == key if len(wanted) else np.zeros(0, bool)
                start, owner, mark = start[hit], owner[hit], where[place[hit]]
                rids = part.column(0).to_numpy(zero_copy_only=False)[row[mark]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(piece.single(start, anchors[owner]).view(np.int64)), pa.array(rids),
                     pa.array((start - piece.offsets[row[mark]]).astype(np.int32)), pa.array(kind[mark] == PART)], names=["code", "rid", "pos", "sought"])

    return texts.mapInArrow(work, "code long, rid long, pos int, sought boolean")


def _mark(kind: Column | int, block: str | None = None, first: str | None = None, second: str | None = None) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.struct(
        F.col("pos").cast("int").alias("pos"), (F.lit(kind) if isinstance(kind, int) else kind).cast("int").alias("kind"),
        (F.col(block) if block else F.lit(0)).cast("int").alias("block"), (F.col(first) if first else zero).alias("first"),
        (F.col(second) if second else zero).alias("second"))


def marked_texts(docs: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """(rid, text, marks, __a, __b): each distinct text with an anchor that occurs twice, once."""
    spark = docs.sparkSession
    anchors = written(spark, _anchors(docs, text, length, gram), "anchors")
    rows = anchors.select("rid", F.explode(F.arrays_zip("pos", "first", "second")).alias("x")).select("rid", "x.pos", "x.first", "x.second")
    alike = rows.groupBy("first", "second").agg(F.count("*").alias("n"))
    totals = alike.groupBy("first").agg(F.sum("n").alias("total")).filter("total > 1")
    groups = written(spark, alike.join(totals, "first").select("first", "second", F.when(F.col("n") == 1, PART).otherwise(WHOLE).alias("kind"),
                                                               (F.col("n") < F.col("total")).alias("mixed")), "groups")
    hot = written(spark, rows.join(groups, ["first", "second"]), "hot")
    # of copies of a text the first row stands for all; it also is the first row of any group that the text is in
    models = hot.filter((F.col("kind") == WHOLE) & F.col("mixed")).groupBy("first", "second").agg(F.min(F.struct("rid", "pos")).alias("m"))
    models = models.select("m.rid", "m.pos", "first", "second")
    marks = hot.select("rid", _mark(F.col("kind"), None, "first", "second").alias("mark")).unionByName(
        models.select("rid", _mark(MODEL, None, "first", "second").alias("mark"))).groupBy("rid").agg(F.collect_list("mark").alias("marks"))
    firsts = anchors.groupBy("__a", "__b").agg(F.min("rid").alias("rid"))
    texts = docs.filter(F.octet_length(text) >= length).select(*text_id(F.col(text)), F.col(text).alias("text")).dropDuplicates(["__a", "__b"])
    return written(spark, texts.join(marks.join(firsts, "rid"), ["__a", "__b"]).select("rid", "text", "marks", "__a", "__b"), "texts")


def removals(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(__a, __b, spans, kept): the distinct texts of which something is removed, by content key.

    ``spans`` are the maximal removed runs (start, stop), ``kept`` the bytes that remain.
    """
    if not BLOCK < gram < length:
        raise ValueError("gram must lie between the block and the length")
    spark = docs.sparkSession
    texts = marked_texts(docs, text, length, gram)
    third = texts.filter(F.exists("marks", lambda m: m["kind"] != WHOLE)).select("rid", "text", "marks")
    blocks = written(spark, _blocks(third, length, gram), "blocks")
    full = blocks.groupBy("core", "full").agg(F.count("*").alias("n"), F.max("sought").alias("sought"), F.min(F.struct("rid", "pos", "block", "first")).alias("m"))
    core = full.groupBy("core").agg(F.sum("n").alias("total"), F.count_if((F.col("n") == 1) & F.col("sought")).alias("open")).filter("total > 1")
    full = written(spark, full.join(core, "core"), "runs")
    runs = blocks.filter("sought").join(full.filter("n > 1").select("core", "full"), ["core", "full"], "left_semi")
    open_runs = full.filter("open > 0").select("m.rid", "m.pos", "m.block", "m.first", F.when((F.col("n") == 1) & F.col("sought"), PART).otherwise(MODEL).alias("kind"))
    wanted = open_runs.groupBy("rid").agg(F.collect_list(_mark(F.col("kind"), "block", "first")).alias("wanted"))
    last = third.join(wanted, "rid").select("rid", "text", F.col("wanted").alias("marks"))
    windows = written(spark, _windows(last, length, gram), "windows")
    again = windows.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1").select("code")
    singles = windows.filter("sought").join(again, "code", "left_semi")
    extra = runs.select("rid", _mark(RUN, "block", None, "full").alias("mark")).unionByName(
        singles.select("rid", _mark(SINGLE, None, None, "code").alias("mark"))).groupBy("rid").agg(F.collect_list("mark").alias("extra"))
    whole = F.filter("marks", lambda m: m["kind"] == WHOLE)
    final = texts.select("rid", "text", whole.alias("marks"), "__a", "__b").join(extra, "rid", "left")
    final = final.select("text", F.concat("marks", F.coalesce("extra", F.array().cast(f"array<{_MARK}>"))).alias("marks"), "__a", "__b").filter(F.size("marks") > 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(0)):
                part = batch.slice(i, j - i)
                piece = Slice(part.column(0), length, gram)
                row, start, stop = covered(piece, part.column(1))
                edges = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))])
                kept = []
                for k in range(j - i):
                    data, at, pieces = piece.data[piece.offsets[k] : piece.offsets[k + 1]].tobytes(), 0, []
                    for e in range(edges[k], edges[k + 1]):
                        pieces.append(data[at : start[e]])
                        at = stop[e]
                    kept.append(b"".join([*pieces, data[at:]]))
                runs = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["start", "stop"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(2), part.column(3), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), runs), pa.array(kept, pa.binary())],
                    names=["__a", "__b", "spans", "kept"])

    return final.mapInArrow(work, "__a long, __b long, spans array<struct<start:int,stop:int>>, kept binary").filter(F.size("spans") > 0)


def covered(piece: Slice, marks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of the maximal runs of bytes that a repeated window covers."""
    row, at, kind, block, first, second = piece.marked(marks, (WHOLE, RUN, SINGLE))
    starts = [np.zeros(0, np.int64)]
    whole = np.unique(at[(kind == WHOLE)][piece.second(at[kind == WHOLE]) == second[kind == WHOLE]])
    starts.append(piece.windows_of(whole)[0])
    run = kind == RUN
    true = piece.run(at[run], block[run])[1] == second[run]
    wanted = np.unique(at[run][true] * (1 << 20) + block[run][true])
    anchors = np.unique(at[run][true])
    start, owner = piece.windows_of(anchors)
    starts.append(start[np.isin(anchors[owner] * (1 << 20) + (anchors[owner] - start) // BLOCK, wanted)])
    one = at[kind == SINGLE]
    place = np.minimum(np.searchsorted(piece.starts, one), max(len(piece.starts) - 1, 0))
    inner = piece.starts[place] == one if len(piece.starts) else np.zeros(len(one), bool)
    one, place, code = one[inner], place[inner], second[kind == SINGLE][inner]
    starts.append(one[piece.single(one, piece.anchor_of[place]) == code])
    start = np.unique(np.concatenate(starts))
    depth = np.zeros(len(piece.data) + 1, dtype=np.int32)
    depth[start] += 1
    depth[start + piece.length] -= 1
    inside = np.cumsum(depth)[:-1] > 0
    fresh = np.zeros(len(piece.data) + 1, dtype=bool)
    fresh[piece.offsets] = True
    begin, end = inside.copy(), inside.copy()
    if len(inside):
        begin[1:] &= ~inside[:-1] | fresh[1:-1]
        end[:-1] &= ~inside[1:] | fresh[1:-1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    row = piece.row_of(start)
    return row, start - piece.offsets[row], stop - piece.offsets[row]


def annotate(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` without ``text`` and with n_bytes, spans (start, stop of the removed runs) and kept (the remaining bytes).

    Removed is every byte covered by a window of ``length`` bytes that also
    starts anywhere else in the table.  Copies of a text of that length go
    wholly.  A null text counts as empty; texts shorter than ``length`` stay
    whole; repeated rows count as copies and lose the same bytes; there is
    nothing to tie; very long texts are read whole; an empty table gives no
    row; other columns are passed on, whatever their names, and those with the
    three names, in upper or lower case, are replaced.
    """
    h_a, h_b, h_bytes = (unused(docs, c, "kept", "spans", "n_bytes") for c in ("_a", "_b", "_bytes"))
    found = written(docs.sparkSession, removals(docs, text, length, gram), "removals").withColumnsRenamed({"__a": h_a, "__b": h_b})
    own = [c for c in docs.columns if c.lower() not in (text.lower(), "n_bytes", "spans", "kept")]
    content = [x.alias(h) for x, h in zip(text_id(F.col(text)), (h_a, h_b), strict=True)]
    rows = docs.select(*[F.col(f"`{c}`") for c in own], *content, F.coalesce(F.col(text), F.lit("")).cast("binary").alias(h_bytes))
    rows = rows.withColumn("n_bytes", F.octet_length(h_bytes).cast("bigint")).join(found, [h_a, h_b], "left")
    return rows.select(*[F.col(f"`{c}`") for c in own], "n_bytes", F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"),
                       F.coalesce("kept", h_bytes).alias("kept"))


@register()
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings of all documents, removed; only digests of the texts travel to the last join."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = removals(docs).select("__a", "__b", F.octet_length("kept").alias("left"), F.size("spans").cast("bigint").alias("runs"), F.sha2("kept", 256).alias("sha"))
    found = written(spark, found, "removals")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", *text_id(F.col("text")), F.octet_length(raw).cast("bigint").alias("n_bytes"), F.sha2(raw, 256).alias("own"))
    rows = rows.join(found, ["__a", "__b"], "left")
    return rows.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.coalesce("left", "n_bytes")).alias("n_removed"),
        F.coalesce("runs", F.lit(0).cast("bigint")).alias("n_spans"), F.coalesce("sha", "own").alias("kept_sha256"))
