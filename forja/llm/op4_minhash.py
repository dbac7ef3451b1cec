"""Near-duplicate classes by BagMinHash signatures, banding and exact verification.

A text is the multiset of its five-word shingles.  Every unit of weight is a
Poisson process of (time, register) points; the weights are cut into the
levels 1, 2, 4, 8, … so that a shingle of weight w has about log2(w) processes,
of which the topmost is thinned to the weight.  A register keeps its earliest
time, and two texts agree in a register with probability equal to their
weighted Jaccard similarity.  Bands of registers give buckets; in each the
best connected member leads, and only links between members and leader are
verified; then the members of a bucket that are still in different classes are
compared in blocks, inside tasks, so that only links leave them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forja.llm.common import LOWER_CODES, Prefix, documents, flat, listed, mix, slices, text_key, unused, words, written
from forja.llm.registry import register

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Members of a bucket that are laid into one block.
BLOCK = 256
_ODD = [np.uint64(2 * int(x) + 1) for x in mix(np.arange(11, 11 + SHINGLE, dtype=np.uint64)) >> np.uint64(1)]
_STEP = np.uint64(0xD1342543DE82EF95)


def jump(i: int) -> np.uint64:
    """``i`` steps of the hash sequence (modulo 2^64)."""
    return np.uint64(i * int(_STEP) % (1 << 64))


def sums_by_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums (modulo 2^64) of consecutive runs of ``counts`` values."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    ends = np.concatenate([[0], np.cumsum(counts)])
    return total[ends[1:]] - total[ends[:-1]]


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, row of each, 2 x rows content hashes of the word sequences)."""
    data, offsets = flat(column)
    rows = len(offsets) - 1
    start, stop, row = words(data, offsets)
    counts = np.bincount(row, minlength=rows)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((2, rows), np.uint64)
    code = Prefix(data, LOWER_CODES).ranges(start, stop)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    place = (np.arange(len(code)) - first[row]).astype(np.uint64)
    nodes = np.stack([mix(sums_by_row(mix(code + place * _STEP + np.uint64(salt)), counts) + counts.astype(np.uint64)) for salt in (1, 2)])
    padded = np.concatenate([code, np.zeros(SHINGLE - 1, np.uint64)])
    total = np.zeros(len(code), np.uint64)
    for j in range(SHINGLE):
        reach = place + np.uint64(j) < counts[row].astype(np.uint64)
        total += np.where(reach, padded[j : j + len(code)] * _ODD[j], np.uint64(0))
    full = place + np.uint64(SHINGLE) <= counts[row].astype(np.uint64)
    keep = full | ((counts[row] < SHINGLE) & (place == 0))
    short = np.where(full, np.uint64(0), counts[row].astype(np.uint64) + np.uint64(1))
    return mix(total + short)[keep], row[keep], nodes


def weighted(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (code, row) with their multiplicities."""
    order = np.lexsort((codes, row))
    codes, row = codes[order], row[order]
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    return codes[at], row[at], np.diff(np.append(at, len(codes)))


def signatures(codes: np.ndarray, row: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """Earliest time of each register, rows x registers; inf in rows without a shingle."""
    code, doc, weight = weighted(codes, row)
    seeds, docs, rates, lows, tops = [mix(code)], [doc], [np.ones(len(code))], [np.zeros(len(code))], [weight]
    level = 1
    while (more := weight > level).any():  # the stratum (level, 2 level]
        seeds.append(mix(code[more] + jump(level)))
        docs.append(doc[more])
        rates.append(np.full(more.sum(), float(level)))
        lows.append(np.full(more.sum(), float(level)))
        tops.append(weight[more])
        level *= 2
    seed, owner, rate, low, top = (np.concatenate(x) for x in (seeds, docs, rates, lows, tops))
    total = np.bincount(doc, weights=weight, minlength=rows)
    out = np.full(rows * registers, np.inf)
    factor = np.log(registers) + 4.0
    open_rows = total > 0
    while open_rows.any():
        limit = np.where(open_rows, factor / np.maximum(total, 1), 0.0)
        at = np.flatnonzero(open_rows[owner])
        time = np.zeros(len(at))
        i = 0
        while len(at):
            draw = mix(seed[at] + jump(i + 1))
            time = time - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / (rate[at] * registers)
            live = time <= limit[owner[at]]
            at, time = at[live], time[live]
            spread = mix(draw[live] + np.uint64(0x632BE59BD9B4E019))
            slot = (spread % np.uint64(registers)).astype(np.int64)
            height = low[at] + 1 + np.floor((spread >> np.uint64(20)).astype(np.float64) * 2.0**-44 * rate[at])
            taken = height <= top[at]
            np.minimum.at(out, owner[at][taken] * registers + slot[taken], time[taken])
            i += 1
        open_rows &= np.isinf(out.reshape(rows, registers)).any(axis=1)
        factor *= 2
    return out.reshape(rows, registers)


def band_codes(times: np.ndarray, bands: int, size: int) -> np.ndarray:
    """One 64-bit code per row and band."""
    bits = np.ascontiguousarray(times).view(np.uint64).reshape(len(times), bands, size)
    code = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (len(times), 1))
    for j in range(size):
        code = mix(code + bits[:, :, j])
    return code


def sketch(docs: DataFrame, text: str) -> DataFrame:
    """(key, node, n, bands) of every row with a word: content keys of text and word sequence, shingles, band codes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                codes, row, nodes = shingles(part.column(1))
                n = np.bincount(row, minlength=b - a)
                has = np.flatnonzero(n)
                if not len(has):
                    continue
                times = signatures(codes, np.searchsorted(has, row), len(has))
                bands = band_codes(times, BANDS, ROWS)
                node = pa.array([x.tobytes() for x in np.ascontiguousarray(nodes[:, has].T)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(has)), node, pa.array(n[has].astype(np.int32)),
                     listed(bands.reshape(-1).view(np.int64), np.full(len(has), BANDS), pa.int64())],
                    names=["key", "node", "n", "bands"])

    return docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text")).filter("text IS NOT NULL").mapInArrow(
        work, "key binary, node binary, n int, bands array<long>")


def multisets(texts: DataFrame) -> DataFrame:
    """(node, items): the shingles of (node, text) with equal ones told apart by their count, so sets stand for multisets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                codes, row, _ = shingles(part.column(1))
                code, doc, weight = weighted(codes, row)
                first = np.repeat(np.cumsum(weight) - weight, weight)
                copy = (np.arange(len(first)) - first).astype(np.uint64)
                items = mix(np.repeat(code, weight) + copy * _STEP).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), listed(items, np.bincount(np.repeat(doc, weight), minlength=b - a), pa.int64())], names=["node", "items"])

    return texts.mapInArrow(work, "node binary, items array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets have at least this Jaccard similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    rows = pairs.join(left, "a").join(right, "b")
    rows = rows.select("a", "b", (F.size("ia") + F.size("ib")).alias("n"), F.size(F.array_intersect("ia", "ib")).alias("both"))
    return rows.filter(F.col("both") >= similarity * (F.col("n") - F.col("both"))).select("a", "b")


def meetings(named: DataFrame) -> DataFrame:
    """(band, node, n, label, own, lo, hi): the members of mixed buckets, once for each pair of blocks (lo, hi) that theirs, own, is in.

    Of a bucket with M members, R are outside its largest class.  Members of
    that class are compared with the R only, never with one another, so each
    is listed about R / BLOCK times and each of the R about M / BLOCK times.
    The R are dealt into the first blocks, the class into the others.
    """
    counts = named.groupBy("band", "label").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("band").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.filter("labels > 1").select(
        "band", F.col("top.label").alias("large"), blocks(F.col("size") - F.col("top.n")).alias("rest"), blocks(F.col("top.n")).alias("dealt"))
    of_large = F.col("label") == F.col("large")
    spread = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    meets = F.when(of_large, F.col("rest")).otherwise(F.col("rest") + F.col("dealt"))
    own = named.join(mixed, "band").withColumn("own", F.when(of_large, F.col("rest") + spread(F.col("dealt"))).otherwise(spread(F.col("rest"))))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1)))
    return own.select("band", "node", "n", "label", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def block_links(named: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): labels joined by a link between members of a bucket; named: band, node, n, label.

    Every two blocks that meet are one group of at most about 2 BLOCK rows,
    however large the bucket is.  A pair is looked at in the first bucket that
    it shares, with its whole 64-bit items.
    """
    rows = meetings(named).join(sets.join(nodes.select("node", "bands"), "node"), "node")
    rows = rows.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi").select("band", "lo", "hi", "own", "n", "label", "bands", "items")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else batch
            ends = _ends(whole)
            for a, b in zip([0, *ends[:-1]], ends, strict=False):
                yield from _group_links(whole.slice(a, b - a), similarity)
            held = [whole.slice(ends[-1])] if ends else [whole]
        for rest in held:
            if rest.num_rows:
                yield from _group_links(rest, similarity)

    return rows.mapInArrow(work, "a binary, b binary").distinct()


def _ends(batch: pa.RecordBatch) -> list[int]:
    """Where groups end within a batch; its last group may go on in the next batch."""
    key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
    return (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()


def _group_links(group: pa.RecordBatch, similarity: float) -> Iterator[pa.RecordBatch]:
    """Labels of one group that a verified pair joins; pairs whose labels are joined already are skipped."""
    band, lo, hi = (group.column(i)[0].as_py() for i in range(3))
    names = group.column(5).to_pylist()
    order = {x: i for i, x in enumerate(dict.fromkeys(names))}
    if len(order) < 2:
        return
    label = np.array([order[x] for x in names])
    own, n = group.column(3).to_numpy(zero_copy_only=False), group.column(4).to_numpy(zero_copy_only=False)
    bands = group.column(6).flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1)
    counts = pa.compute.list_value_length(group.column(7)).to_numpy(zero_copy_only=False).astype(np.int64)
    items = group.column(7).flatten().to_numpy(zero_copy_only=False)
    edge = np.concatenate([[0], np.cumsum(counts)])
    links = []
    for i in range(len(names)):
        if lo != hi and own[i] != lo:
            continue
        with_me = np.arange(i + 1, len(names)) if lo == hi else np.flatnonzero(own == hi)
        with_me = with_me[(label[with_me] != label[i]) & (np.minimum(n[with_me], n[i]) >= similarity * np.maximum(n[with_me], n[i]))]
        if not len(with_me):
            continue
        same = bands[with_me] == bands[i]
        with_me = with_me[bands[i][same.argmax(axis=1)] == band]
        if not len(with_me):
            continue
        mine = np.sort(items[edge[i] : edge[i + 1]])
        taken = counts[with_me]
        ends = np.cumsum(taken)
        theirs = items[np.arange(ends[-1]) - np.repeat(ends - taken, taken) + np.repeat(edge[with_me], taken)]
        at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        both = np.bincount(np.repeat(np.arange(len(with_me)), taken), weights=mine[at] == theirs, minlength=len(with_me))
        for j in with_me[both >= similarity * (n[with_me] + n[i] - both)]:
            if label[j] != label[i]:
                links.append((names[i], names[j]))
                label[label == label[j]] = label[i]
    if links:
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of the component; only nodes with an edge."""
    spark = edges.sparkSession
    both = written(spark, edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        far = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        step = written(spark, step.join(far, "to").select("node", "old", F.col("far").alias("label")), "labels")
        moved = step.filter(F.col("old") != F.col("label")).limit(1).count()
        labels = step.select("node", "label")
        if not moved:
            return labels


def classes(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(key, label): the class of every distinct text with a word; equal labels mean near duplicates.

    Two texts are linked if the Jaccard similarity of their shingle multisets
    is at least ``similarity`` (banding finds a pair of exactly 0.8 with
    probability 0.9999); classes are the connected components.  A text of
    fewer than five words is one shingle.  Texts that are null or have no word
    are in no class.  Copies are one node and never form pairs.
    """
    spark = docs.sparkSession
    sketches = written(spark, sketch(docs, text), "sketches")
    nodes = sketches.groupBy("node").agg(F.min(F.struct("key", "n", "bands")).alias("s")).select("node", "s.key", "s.n", "s.bands")
    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = written(spark, banded.join(sizes, "band"), "members")
    degrees = members.groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = members.join(degrees, "node")
    leaders = ranked.groupBy("band").agg(F.max(F.struct("degree", "node", "n")).alias("leader")).select("band", "leader.node", "leader.n")
    leaders = leaders.select("band", F.col("node").alias("b"), F.col("n").alias("nb"))
    near = F.least("n", "nb") >= similarity * F.greatest("n", "nb")
    stars = members.join(leaders, "band").filter((F.col("node") != F.col("b")) & near)
    pairs = written(spark, stars.select(F.col("node").alias("a"), "b").distinct(), "pairs")

    # as many rows as texts with a near neighbour: never to be broadcast, however few they are here
    wanted = written(spark, degrees.select("node").join(nodes.select("node", "key"), "node"), "wanted").hint("merge")
    keyed = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    sets = written(spark, multisets(wanted.join(keyed, "key").select("node", "text")).dropDuplicates(["node"]), "sets")
    links = written(spark, verified(pairs, sets, similarity), "links")
    labels = components(links)

    # what could still join two classes: members of a bucket that are neither its leader nor in one class
    named = members.join(labels, "node", "left").select("band", "node", "n", F.coalesce("label", "node").alias("label"))
    named = written(spark, named.join(leaders.select("band", "b"), "band").filter(F.col("node") != F.col("b")).drop("b"), "named")
    bridges = components(written(spark, block_links(named, nodes, sets, similarity), "bridges"))
    bridges = bridges.select(F.col("node").alias("part"), F.col("label").alias("whole"))
    final = sketches.select("key", "node").distinct().join(labels, "node", "left").withColumn("part", F.coalesce("label", "node"))
    return final.join(bridges, "part", "left").select("key", F.coalesce("whole", "part").alias("label"))


def annotate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key column, class_id, class_size) of every row: the smallest key of its class and the class's rows.

    Rows without a word are a class of their own each, with their own key and
    size 1.  Null keys count as rows but are never the smallest; a class of
    null keys has a null class_id.  Repeated rows fall in one class, ties of
    keys change nothing, very long texts are read whole, an empty table gives
    no row.  Other columns are not read, so their names do not matter.
    """
    labels = written(docs.sparkSession, classes(docs, text), "classes")
    rows = docs.select(F.col(key).alias("id"), text_key(F.col(text)).alias("key")).join(labels, "key", "left")
    rows = written(docs.sparkSession, rows.select("id", "label"), "labelled")
    sizes = rows.filter("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(sizes, "label", "left").select(
        F.col("id").alias(key), F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the smallest key stays (nulls last).

    Ties (repeated rows, null keys) go to the smallest text key, and one of
    rows equal in both stays.  Rows without a word all stay.  Very long texts
    are read whole, an empty table gives no row, and other columns are passed
    on, whatever their names.
    """
    spark = docs.sparkSession
    labels = written(spark, classes(docs, text), "classes")
    ids = docs.select(F.col(key).alias("id"), text_key(F.col(text)).alias("key")).join(labels, "key")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"))
    best = ids.groupBy("label").agg(F.min(order).alias("best"))
    ids = ids.join(best, "label").groupBy("label", "id", "key").agg(F.count("*").alias("n"), F.first("best").alias("best"))
    mine = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key"))
    h_key, h_away, h_id, h_again = (unused(docs, c) for c in ("_key", "_away", "_id", "_again"))
    away = written(spark, ids.filter(~mine | (F.col("n") > 1)).select(
        F.col("id").alias(h_id), F.col("key").alias(h_away), mine.alias(h_again)), "dropped")
    rows = docs.withColumn(h_key, text_key(F.col(text)))
    same = (F.col(h_key) == F.col(h_away)) & F.col(f"`{key}`").eqNullSafe(F.col(h_id))
    # as many rows as near copies: never to be broadcast, however few they are here
    rows = rows.join(away.hint("merge"), same, "left")
    single = rows.filter(F.col(h_again).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
    again = rows.filter(h_again).dropDuplicates([h_key, key]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return single.unionByName(again)


@register()
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return annotate(documents(spark, sf_dir).select("doc_id", "text"))
