"""Alignment of two tokenizers on the same texts, as Arrow tables inside tasks.

The token ids of a slice of texts are two list columns.  Flattened, with the
row each comes from, the running sums of their token lengths are the byte
places where they end; one hash join on these places lays both sequences side
by side.  A place where both end closes a group; between two neighbouring
places exactly one token of either side lies over the other, which is a link.

Which links a document holds is counted by ``Table.group_by`` for a block of
documents first; Spark merges the counts of all blocks.  A block's own pairs
get their corpus-wide counts by a join and meet the block's documents again,
so neither the links of the corpus nor its table of pairs travel whole.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forja.llm.common import documents, flat, listed, slices, written
from forja.llm.registry import register

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text aligned at once, and of a block whose pairs are counted together (or one text, if that is longer).
SLICE, BLOCK = 2 << 20, 4 << 20
#: Stretches of text whose ids a task remembers, and of how many characters at most.
KNOWN, SHORT = 1 << 17, 40
#: Stretches given to a tokenizer at once.
BATCH = 1 << 14

Encoder = Callable[[list[str]], list[list[int]]]


@dataclass
class Side:
    """A tokenizer in a task: ids of texts (each with one space before it), the bytes of every id, and whether texts cannot be cut at spaces."""

    encode: Encoder
    spelled: list[bytes]
    whole: bool = False

    def __post_init__(self):
        self.bytes = pa.array(self.spelled, pa.large_binary())
        self.known: dict[str, list[int]] = {}

    def lists(self, texts: list[str]) -> list[list[int]]:
        """Ids of different texts; short ones are remembered."""
        if len(self.known) > KNOWN:
            self.known.clear()
        new = [t for t in texts if t not in self.known]
        for i in range(0, len(new), BATCH):
            self.known.update(zip(new[i : i + BATCH], self.encode(new[i : i + BATCH]), strict=True))
        found = list(map(self.known.__getitem__, texts))
        for t in new:
            if len(t) > SHORT:
                del self.known[t]
        return found


def byte_letters() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: printable ones stand for themselves, the rest follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_side(model: bytes) -> Side:
    """Byte-level BPE from a vocabulary file's content; special tokens' strings are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(model)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    letters = byte_letters()
    spelled = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        spelled[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    return Side(encode, spelled)


def piece_side(model: bytes) -> Side:
    """Pieces from a model file's content, which adds the space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=model)
    spelled = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
               for i in range(model.get_piece_size())]
    return Side(lambda texts: model.encode(texts, num_threads=1), spelled, any(b" " in s.lstrip(b" ") for s in spelled))


_sides: dict[tuple, Side] = {}


def side(kind: Callable[[bytes], Side], model: bytes) -> Side:
    """Tokenizer built once per Python worker."""
    key = (kind.__name__, hashlib.md5(model).digest())
    if key not in _sides:
        _sides[key] = kind(model)
    return _sides[key]


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(stretches of the texts, each after one space, and the text of each stretch).

    A text is cut at a space between a printable ASCII character or one of
    U+00C0 to U+00FF and any other; neither tokenizer has a token over such a
    place, so the stretches can be encoded alone.  Null and empty texts have none.
    """
    data, offsets = flat(texts)
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    plain = (data > 32) & (data < 127)
    plain[1:] |= data[:-1] == 0xC3
    cut = data == 32
    cut[1:] &= plain[:-1]
    cut[0] = False
    cut[:-1] &= ~(cut[:-1] & np.isin(np.arange(1, len(data)), offsets))  # a text's last character stays with what is before it
    cut[-1] = False
    first = offsets[:-1][np.diff(offsets) > 0]
    cut[first] = False
    start = np.sort(np.concatenate([first, np.flatnonzero(cut) + 1]))
    keep = ~cut
    place = np.concatenate([[0], np.cumsum(keep)])
    ends = np.append(place[start], place[-1])
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[keep])])
    return found, np.searchsorted(offsets, start, side="right") - 1


class Tokens:
    """One side's tokens of a slice: ids, how many in each text, where they end when all texts are laid end to end."""

    def __init__(self, own: Side, ids: np.ndarray, per: np.ndarray):
        self.per = per
        column = listed(ids, per, pa.int32())
        self.ids = pc.list_flatten(column)
        self.row = pc.list_parent_indices(column)
        taken = own.bytes.take(self.ids)
        self.end = pc.cumulative_sum(pc.binary_length(taken))
        self.letters = taken.buffers()[2]

    def texts(self) -> list[bytes]:
        """What the tokens of every text spell, joined."""
        edge = np.concatenate([[0], self.end.to_numpy()])[np.concatenate([[0], np.cumsum(self.per)])]
        whole = self.letters.to_pybytes() if self.letters else b""
        return [whole[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)]

    def only(self, own: Side, good: np.ndarray) -> Tokens:
        """Without the tokens of other texts."""
        return Tokens(own, self.ids.to_numpy()[np.repeat(good, self.per)], np.where(good, self.per, 0))


def tokens(own: Side, stretches: list[str], code: np.ndarray, row: np.ndarray, rows: int) -> Tokens:
    """Tokens of the texts made of the coded stretches; a stretch is encoded once."""
    lists = own.lists(stretches)
    size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat_ids = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(size.sum()))
    n = size[code]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat((np.cumsum(size) - size)[code], n)
    return Tokens(own, flat_ids[at], np.bincount(row, weights=n, minlength=rows).astype(np.int64))


def both_sides(a: Side, b: Side, texts: pa.Array) -> tuple[Tokens, Tokens]:
    """Tokens of both sides; none for a text that is null, empty, or that either side spells otherwise."""
    if a.whole or b.whole:
        found, row = pc.fill_null(texts, "").cast(pa.large_binary()), np.arange(len(texts))
        some = pc.greater(pc.binary_length(found), 0)
        found, row = found.filter(some), row[some.to_numpy(zero_copy_only=False)]
    else:
        found, row = units(texts)
    codes = found.dictionary_encode()
    stretches, code = codes.dictionary.cast(pa.large_string()).to_pylist(), codes.indices.to_numpy()
    sides = [tokens(s, stretches, code, row, len(texts)) for s in (a, b)]
    want = [b" " + t.encode() if t else b"" for t in texts.to_pylist()]
    good = np.array([x == y == z for x, y, z in zip(want, *(s.texts() for s in sides), strict=True)], dtype=bool)
    return tuple(t if good.all() else t.only(s, good) for s, t in zip((a, b), sides, strict=True))


def side_by_side(a: Tokens, b: Tokens) -> pa.Table:
    """(row, a, b, cut) of every link in order: the two ids, and whether both end with it."""
    left = pa.table({"end": a.end, "row": a.row.cast(pa.int32()), "a": a.ids})
    right = pa.table({"end": b.end, "b": b.ids})
    both = left.join(right, keys="end", join_type="full outer", use_threads=False).sort_by("end").combine_chunks()
    ids = [both[c].combine_chunks() if both.num_rows else pa.array([], pa.int32()) for c in ("row", "a", "b")]
    cut = pc.and_(pc.is_valid(ids[1]), pc.is_valid(ids[2]))
    ends = {"ends_a": pc.is_valid(ids[1]), "ends_b": pc.is_valid(ids[2])}
    return pa.table({"row": pc.fill_null_backward(ids[0]), "a": pc.fill_null_backward(ids[1]), "b": pc.fill_null_backward(ids[2]), "cut": cut, **ends})


class Speller:
    """Groups written as ``a1,a2|b1;a3|b2,b3``: every id with the sign after it, laid in order."""

    def __init__(self, size_a: int, size_b: int):
        signs = [*((n, s) for s in (",", "|") for n in range(size_a)), *((n, s) for s in (",", ";", "") for n in range(size_b))]
        self.size_a, self.size_b = size_a, size_b
        self.parts = pa.array([f"{n}{s}".encode() for n, s in signs], pa.large_binary())

    def texts(self, a: Tokens, b: Tokens, table: pa.Table) -> list[bytes]:
        cut = table["cut"].to_numpy()
        cut_a, cut_b = cut[table["ends_a"].to_numpy()], cut[table["ends_b"].to_numpy()]
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        groups = int(cut.sum())
        upto_a = np.cumsum(np.bincount(group_a, minlength=groups))
        upto_b = np.cumsum(np.bincount(group_b, minlength=groups))
        before_b = upto_b - np.bincount(group_b, minlength=groups)
        code = np.empty(len(cut_a) + len(cut_b), dtype=np.int64)
        code[np.arange(len(cut_a)) + before_b[group_a]] = a.ids.to_numpy() + self.size_a * cut_a
        sign = cut_b.astype(np.int64)
        last = np.cumsum(b.per)[b.per > 0] - 1
        sign[last] = 2
        code[np.arange(len(cut_b)) + upto_a[group_b]] = b.ids.to_numpy() + self.size_b * sign + 2 * self.size_a
        found = self.parts.take(pa.array(code))
        edge = np.concatenate([[0], pc.cumulative_sum(pc.binary_length(found)).to_numpy()])[np.concatenate([[0], np.cumsum(a.per + b.per)])]
        whole = found.buffers()[2].to_pybytes() if len(found) else b""
        return [whole[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)]


_spellers: dict[tuple[int, int], Speller] = {}

FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def aligned(a: Side, b: Side, texts: pa.Array) -> tuple[pa.Table, pa.Table, list[bytes]]:
    """(figures of every text, its different links (row, pair, n), its groups as text) of a slice."""
    size = (len(a.spelled), len(b.spelled))
    if size not in _spellers:
        _spellers[size] = Speller(*size)
    left, right = both_sides(a, b, texts)
    table = side_by_side(left, right)
    row, cut = table["row"].to_numpy(), table["cut"].to_numpy()
    figures = pa.table({"n_a": left.per, "n_b": right.per, "n_groups": np.bincount(row[cut], minlength=len(texts)),
                        "n_links": np.bincount(row, minlength=len(texts))})
    pair = pc.add(pc.multiply(table["a"].cast(pa.int64()), 1 << 32), table["b"].cast(pa.int64()))
    links = pa.table({"row": table["row"], "pair": pair}).group_by(["row", "pair"], use_threads=False).aggregate([([], "count_all")])
    return figures, links.rename_columns(["row", "pair", "n"]), _spellers[size].texts(left, right, table)


def _block(block: int, own: list[pa.Array], parts: list[tuple[pa.Table, pa.Table, list[bytes]]], names: list[str], outputs: tuple[str, ...]) -> pa.RecordBatch:
    """Rows of a block: its texts, then one row with its pairs and in how many of its texts they stand."""
    figures = pa.concat_tables([p[0] for p in parts]).combine_chunks()
    rows = figures.num_rows
    starts = np.cumsum([0, *(p[0].num_rows for p in parts)])
    links = pa.concat_tables([p[1].set_column(0, "row", pc.add(p[1]["row"].cast(pa.int64()), int(s))) for p, s in zip(parts, starts, strict=False)])
    pairs = links.group_by("pair", use_threads=False).aggregate([([], "count_all")])
    pair = pairs["pair"].combine_chunks() if pairs.num_rows else pa.array([], pa.int64())
    row = links["row"].to_numpy()
    order = np.argsort(row, kind="stable")
    code = pc.index_in(links["pair"], value_set=pair).to_numpy()[order]
    per = np.bincount(row, minlength=rows)
    spelled = [t for p in parts for t in p[2]]
    kinds = {"groups": lambda: pa.array([t.decode() for t in spelled], pa.string()),
             "groups_sha256": lambda: pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in spelled], pa.string())}
    columns = [pa.array([block] * rows, pa.int64()), *own, *(figures[n].combine_chunks().cast(pa.int64()) for n in FIGURES),
               *(kinds[o]() for o in outputs), listed(code, per, pa.int32()), listed(links["n"].to_numpy()[order], per, pa.int32())]
    both = pair.to_numpy()
    single = [listed(both >> 32, np.array([len(both)]), pa.int32()), listed(both & 0xFFFFFFFF, np.array([len(both)]), pa.int32()),
              listed(pairs["count_all"].to_numpy() if pairs.num_rows else both, np.array([len(both)]), pa.int64())]
    columns = [pa.concat_arrays([c, pa.nulls(1, c.type)]) for c in columns] + [pa.concat_arrays([pa.nulls(rows, c.type), c]) for c in single]
    columns[0] = pa.array([block] * (rows + 1), pa.int64())
    return pa.RecordBatch.from_arrays(columns, names=names)


def align(docs: DataFrame, byte_model: bytes, piece_model: bytes, text: str = "text",
          outputs: tuple[str, ...] = ("groups",), block_bytes: int = BLOCK) -> DataFrame:
    """How a byte-level BPE and a piece model cut every whole text, and how common its links are in the corpus.

    Columns: those of ``docs`` without ``text``, whatever their names (of the
    same name as a new one, upper or lower case, they are replaced); ``n_a``,
    ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best`` (links whose
    document count is the highest of their A id, ties included), ``count_sum``
    (of the document counts of all links); and ``outputs``: ``groups``, the
    token ids of every group as ``a1,a2|b1;a3|b2,b3``, or ``groups_sha256``,
    the digest of that text.

    A text that is null, empty, or that either tokenizer does not spell again
    byte by byte has zeros and ''.  Very long texts are read whole, a repeated
    row counts as one more document, an empty table gives no row.
    """
    new = [*FIGURES, *outputs, "n_best", "count_sum"]
    spark, lower = docs.sparkSession, {n.lower() for n in (*new, text)}
    fields = [f for f in docs.schema if f.name.lower() not in lower]
    inner = [f"in{i}" for i in range(len(fields))]
    schema = T.StructType([T.StructField("block", T.LongType()), *(T.StructField(n, f.dataType) for n, f in zip(inner, fields, strict=True)),
                           *(T.StructField(n, T.LongType()) for n in FIGURES), *(T.StructField(n, T.StringType()) for n in outputs),
                           *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("codes", "times", "pair_a", "pair_b")),
                           T.StructField("pair_n", T.ArrayType(T.LongType()))])
    shared = spark.sparkContext.broadcast((byte_model, piece_model))  # two vocabulary files

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = side(byte_side, shared.value[0]), side(piece_side, shared.value[1])
        block = TaskContext.get().partitionId() << 32
        own, parts, held = [], [], 0

        def flush():
            columns = [pa.concat_arrays([p[i] for p in own]) for i in range(len(fields))]
            return _block(block, columns, parts, schema.names, outputs)

        for batch in batches:
            column = batch.column(len(fields))
            for x, y in slices(column, min(SLICE, block_bytes)):
                part = column.slice(x, y - x)
                parts.append(aligned(a, b, part))
                own.append([batch.column(i).slice(x, y - x) for i in range(len(fields))])
                held += part.nbytes
                if held >= block_bytes:
                    yield flush()
                    own, parts, held, block = [], [], 0, block + 1
        if parts:
            yield flush()

    source = docs.select(*[docs[f"`{f.name}`"].alias(n) for n, f in zip(inner, fields, strict=True)], docs[f"`{text}`"].alias("text"))
    rows = written(spark, source.mapInArrow(work, schema), "alignment-blocks")
    zipped = rows.filter("pair_n IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("place", "p"))
    pairs = zipped.select("block", "place", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"))
    corpus = pairs.groupBy("a", "b").agg(F.sum("n").alias("total"))
    corpus = corpus.withColumn("best", F.col("total") == F.max("total").over(W.partitionBy("a")))  # of an A id: no more rows than B has ids
    counted = pairs.join(corpus, ["a", "b"]).select(F.col("block").alias("of_block"), "place", "total", "best")

    final = T.StructType([T.StructField(n, f.dataType) for n, f in zip(inner, fields, strict=True)]
                         + [T.StructField(n, T.LongType()) for n in FIGURES] + [T.StructField(n, T.StringType()) for n in outputs]
                         + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def finish(texts: pa.Table, counts: pa.Table) -> pa.Table:
        place = counts["place"].to_numpy()
        total, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        total[place], best[place] = counts["total"].to_numpy(), counts["best"].to_numpy()
        codes, times = (texts[c].combine_chunks() for c in ("codes", "times"))
        row, code, n = pc.list_parent_indices(codes).to_numpy(), pc.list_flatten(codes).to_numpy(), pc.list_flatten(times).to_numpy().astype(np.int64)
        sums = []
        for weight in (n * best[code], n * total[code]):
            ends = np.concatenate([[0], np.cumsum(weight)])
            per = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=texts.num_rows))])
            sums.append(pa.array(ends[per[1:]] - ends[per[:-1]], pa.int64()))
        return pa.table([*(texts[n] for n in final.names[:-2]), *sums], names=final.names)

    texts = rows.filter("pair_n IS NULL").drop("pair_a", "pair_b", "pair_n")
    done = texts.groupBy("block").cogroup(counted.groupBy("of_block")).applyInArrow(finish, final)
    return done.toDF(*(f.name for f in fields), *final.names[len(fields) :])


def model(path: str) -> bytes:
    """Content of a vocabulary file (read on the driver, of fixed size)."""
    with open(path, "rb") as f:
        return f.read()


@register()
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of all whole documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = align(docs, model(BYTE_BPE), model(PIECE_BPE), outputs=("groups_sha256",))
    return rows.select("doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256")
