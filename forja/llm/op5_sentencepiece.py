"""SentencePiece encoding and decoding: Aho-Corasick automaton and single-pass Viterbi.

The pieces of a model file form one automaton over bytes.  Reading a text, the
automaton's state names the longest piece that ends here and its output links
the shorter ones; each relaxes the best score of this position.  Characters
without a piece fall back to byte pieces.

Texts are cut where no piece can cross (before a run of spaces, around bytes
that stand alone).  The different cuts of a slice are read side by side,
position by position, as arrays; the result is that of a scan of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forja.llm.common import Prefix, documents, flat, listed, slices
from forja.llm.registry import register

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The space symbol inside the automaton: a byte that no UTF-8 text holds.
GAP = 0xFF
UNKNOWN_PENALTY = 10.0
SLICE = 2 << 20
CELLS = 1 << 20
LONG = 96


@dataclass
class Vocabulary:
    """Pieces (byte strings with GAP for the space symbol), their ids and scores, and the ids of the 256 byte pieces."""

    pieces: list[bytes]
    ids: list[int]
    scores: list[float]
    byte_ids: list[int]

    @property
    def tag(self) -> str:
        return hashlib.md5(repr((self.pieces, self.ids, self.scores, self.byte_ids)).encode()).hexdigest()


def load(path: str = MODEL) -> Vocabulary:
    """Vocabulary of a model file (read on the driver; its size bounds what is broadcast)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, ids, scores, byte_ids = [], [], [], [-1] * 256
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append(b"\xff".join(x.encode() for x in model.id_to_piece(i).split("▁")))
            ids.append(i)
            scores.append(model.get_score(i))
    if -1 in byte_ids:
        raise ValueError("the model has no byte pieces, so not every text could be decoded again")
    return Vocabulary(pieces, ids, scores, byte_ids)


class Automaton:
    """Transitions, output links, and per state the length, score and id of the piece that ends there."""

    def __init__(self, vocabulary: Vocabulary):
        children: list[dict[int, int]] = [{}]
        depth, piece = [0], [-1]
        for k, text in enumerate(vocabulary.pieces):
            at = 0
            for b in text:
                step = children[at].get(b)
                if step is None:
                    step = children[at][b] = len(children)
                    children.append({})
                    depth.append(depth[at] + 1)
                    piece.append(-1)
                at = step
            if at and piece[at] < 0:
                piece[at] = k
        size = len(children)
        self.go = np.zeros((size, 256), dtype=np.int32)
        self.link = np.zeros(size, dtype=np.int32)
        fail = np.zeros(size, dtype=np.int32)
        level = [0]
        while level:  # by depth: failure states are complete before they are copied
            below = []
            for at in level:
                if at:
                    self.go[at] = self.go[fail[at]]
                    back = fail[at]
                    self.link[at] = back if piece[back] >= 0 else self.link[back]
                for b, child in children[at].items():
                    fail[child] = self.go[at, b] if at else 0
                    self.go[at, b] = child
                    below.append(child)
            level = below
        ends = np.array(piece)
        self.ends = ends >= 0
        self.length = np.array(depth, dtype=np.int32)
        self.score = np.where(self.ends, np.array([*vocabulary.scores, 0.0])[ends], -np.inf)
        self.id = np.where(self.ends, np.array([*vocabulary.ids, 0])[ends], -1).astype(np.int32)
        self.byte_ids = np.array(vocabulary.byte_ids, dtype=np.int32)
        self.byte_ids[GAP] = self.byte_ids[32]
        unknown = min(vocabulary.scores, default=0.0) - UNKNOWN_PENALTY
        lead = (np.arange(256) & 0xC0) != 0x80
        self.byte_score = np.where(lead, unknown, 0.0)  # one penalty per character
        joined = [set(p) for p in vocabulary.pieces if len(p) > 1]
        self.alone = np.ones(256, dtype=bool)
        for p in joined:
            self.alone[list(p)] = False
        self.alone[128:] = False
        self.alone[GAP] = False
        self.cut_at_gap = not any(b"\xff" in p.lstrip(b"\xff") for p in vocabulary.pieces)

    def scan(self, text: np.ndarray) -> list[int]:
        """Piece ids of one long unit, position by position."""
        n = len(text)
        best, size, ids = [0.0] + [-np.inf] * n, [0] * (n + 1), [0] * (n + 1)
        state = 0
        for t, b in enumerate(text.tolist()):
            state = int(self.go[state, b])
            top, length, name = best[t] + self.byte_score[b], 1, int(self.byte_ids[b])
            at = state if self.ends[state] else int(self.link[state])
            while at:
                k = int(self.length[at])
                value = best[t + 1 - k] + self.score[at]
                if value > top:
                    top, length, name = value, k, int(self.id[at])
                at = int(self.link[at])
            best[t + 1], size[t + 1], ids[t + 1] = top, length, name
        out = []
        while n:
            out.append(ids[n])
            n -= size[n]
        return out[::-1]

    def scan_many(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many units at once, longest first: (number of ids of each unit, ids in a rows x length table from the right)."""
        rows, width = len(start), int(length[0])
        best = np.full((rows, width + 1), -np.inf)
        best[:, 0] = 0
        size = np.zeros((rows, width + 1), dtype=np.int32)
        name = np.zeros((rows, width + 1), dtype=np.int32)
        state = np.zeros(rows, dtype=np.int32)
        flat_best = best.reshape(-1)
        for t in range(width):
            n = int(np.searchsorted(-length, -t, side="left"))  # units longer than t
            b = data[start[:n] + t]
            state = self.go[state[:n], b]
            top = best[:n, t] + self.byte_score[b]
            span, ids = np.ones(n, dtype=np.int32), self.byte_ids[b]
            row = np.arange(n)
            at = np.where(self.ends[state], state, self.link[state])
            row, at = row[at > 0], at[at > 0]
            while len(row):
                k = self.length[at]
                value = flat_best[row * (width + 1) + (t + 1 - k)] + self.score[at]
                better = value > top[row]
                hit = row[better]
                top[hit], span[hit], ids[hit] = value[better], k[better], self.id[at[better]]
                at = self.link[at]
                row, at = row[at > 0], at[at > 0]
            best[:n, t + 1], size[:n, t + 1], name[:n, t + 1] = top, span, ids
        table = np.zeros((rows, width), dtype=np.int32)
        counts = np.zeros(rows, dtype=np.int64)
        row, place = np.arange(rows), length.copy()
        while len(row):
            counts[row] += 1
            table[row, width - counts[row]] = name[row, place]
            place = place - size[row, place]
            row, place = row[place > 0], place[place > 0]
        return counts, table

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after the other, ids per row)."""
        text, offsets = flat(column)
        rows = len(offsets) - 1
        sizes = np.diff(offsets)
        some = sizes > 0
        moved = offsets[:-1] + np.cumsum(some) - some  # every text that is not empty begins with one more space
        data = np.empty(len(text) + int(some.sum()), dtype=np.uint8)
        inside = np.ones(len(data), dtype=bool)
        inside[moved[some]] = False
        data[inside] = np.where(text == 32, GAP, text)
        data[moved[some]] = GAP
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        cut = np.zeros(len(data), dtype=bool)
        cut[moved[some]] = True
        if self.cut_at_gap:
            gap = data == GAP
            cut[1:] |= gap[1:] & ~gap[:-1]
            alone = self.alone[data]
            cut |= alone
            cut[1:] |= alone[:-1]
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, len(data)))
        codes = Prefix(data).ranges(start, start + length)
        _, first, unit = np.unique(codes, return_index=True, return_inverse=True)
        order = np.argsort(-length[first], kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        first, unit = first[order], place[unit]
        u_start, u_length = start[first], length[first]
        counts = np.zeros(len(first), dtype=np.int64)
        pieces: list[np.ndarray] = []
        a = 0
        while a < len(first) and u_length[a] > LONG:
            found = np.array(self.scan(data[u_start[a] : u_start[a] + u_length[a]]), dtype=np.int32)
            counts[a] = len(found)
            pieces.append(found)
            a += 1
        while a < len(first):
            b = min(len(first), a + max(1, CELLS // (int(u_length[a]) + 1)))
            n, table = self.scan_many(data, u_start[a:b], u_length[a:b])
            counts[a:b] = n
            pieces.append(table[np.arange(table.shape[1]) >= table.shape[1] - n[:, None]])
            a = b
        ids = np.concatenate(pieces)
        begins = np.cumsum(counts) - counts
        taken = counts[unit]
        ends = np.cumsum(taken)
        at = np.arange(ends[-1]) - np.repeat(ends - taken, taken) + np.repeat(begins[unit], taken)
        row = np.searchsorted(moved[some], start, side="right") - 1
        per = np.zeros(rows, dtype=np.int64)
        per[some] = np.bincount(row, weights=taken, minlength=int(some.sum())).astype(np.int64)
        return ids[at], per


_built: dict[str, Automaton] = {}


def automaton(vocabulary: Vocabulary) -> Automaton:
    """Automaton of a vocabulary, built once per Python worker."""
    tag = vocabulary.tag
    if tag not in _built:
        _built.clear()
        _built[tag] = Automaton(vocabulary)
    return _built[tag]


class Speller:
    """What piece ids spell: the bytes of every piece, laid end to end."""

    def __init__(self, vocabulary: Vocabulary):
        self.top = max([*vocabulary.ids, *vocabulary.byte_ids]) + 1
        spelled = [b""] * (self.top + 1)
        for i, piece in zip(vocabulary.ids, vocabulary.pieces, strict=True):
            spelled[i] = piece.replace(b"\xff", b" ")
        for b, i in enumerate(vocabulary.byte_ids):
            spelled[i] = bytes([b])
        self.sizes = np.array([len(s) for s in spelled], dtype=np.int32)
        self.begins = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.letters = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The text of each run of ``counts`` ids, without the space that every encoded text begins with."""
        ids = np.where((ids >= 0) & (ids < self.top), ids, self.top)
        n = self.sizes[ids]
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        data = self.letters[np.arange(total) + np.repeat(self.begins[ids] - ends + n, n)].tobytes()
        edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [data[x:y][1:] for x, y in zip(edge[:-1], edge[1:], strict=True)]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", exact: str | None = None) -> DataFrame:
    """``docs`` with ``ids``, the piece ids of the best segmentation of the whole text.

    '' has no id, null stays null.  Of segmentations with equal scores the one
    whose last pieces are longer wins.  With ``exact`` a column of that name
    tells whether the ids, decoded again, are the very text (null: true).
    Rows are worked alone, other columns are passed on, those with the new
    names are replaced.
    """
    fields = [f for f in docs.schema if f.name.lower() not in {x.lower() for x in (ids, exact) if x}]
    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if exact:
        schema = schema.add(exact, T.BooleanType())
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared.value)
        speller = Speller(shared.value) if exact else None
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in slices(column, SLICE):
                part = batch.slice(a, b - a)
                own = column.slice(a, b - a)
                found, per = machine.encode(own)
                lists = listed(found, per, pa.int32())
                if own.null_count:
                    lists = pc.if_else(pc.is_null(own), pa.scalar(None, lists.type), lists)
                out = [*(part.column(part.schema.get_field_index(f.name)) for f in fields), lists]
                if speller:
                    data, offsets = flat(own)
                    raw = data.tobytes()
                    again = speller.texts(found, per)
                    out.append(pa.array([raw[x:y] == z for x, y, z in zip(offsets[:-1], offsets[1:], again, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.mapInArrow(work, schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with ``text``, what their piece ids spell (null for null); an id without a piece spells nothing."""
    fields = [f for f in rows.schema if f.name != text]
    schema = T.StructType([*fields, T.StructField(text, T.StringType())])
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                column = part.column(part.schema.get_field_index(ids))
                counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                found = speller.texts(column.flatten().to_numpy(zero_copy_only=False), counts)
                texts = [x.decode("utf-8", "replace") if y else None for x, y in zip(found, column.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(f.name)) for f in fields), pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(work, schema)


@register()
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole document, and whether they decode to the very text."""
    rows = encode(documents(spark, sf_dir).select("doc_id", "text"), load(), exact="exact")
    return rows.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"), "exact")
