"""SentencePiece encoding and decoding as a weighted transducer.

Normaliser, pieces and byte fallback are compiled into one machine: blanks become the piece mark, the piece trie gives an
arc for every piece from every position, and characters without a piece give byte arcs. Composed with an input it is a
lattice over positions, and the encoding is its cheapest path in the tropical semiring (minimum, plus). For a BPE model
the weight of an arc is 0 where the piece may follow the one before it and infinite where a merge across their border
would have come first; that makes the finite path unique, and each position keeps one arc."""

from __future__ import annotations

import functools
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Chunks and piece pairs a process remembers, and characters of text it works on at a time.
CACHE = 400_000
PAIRS = 800_000
SLICE = 2_000_000
_NORMAL, _BYTE, _USER = 1, 6, 4


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, raw[at : at + size]
            at += size


def read_model(path: str) -> tuple[list[tuple[str, float, int]], dict[int, int | bytes], int]:
    """Pieces (text, score, type), normaliser fields and model type (2: BPE) of a model file."""
    pieces, normaliser, kind = [], {}, 1
    with open(path, "rb") as file:
        for number, value in _fields(file.read()):
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                pieces.append((piece[1].decode(), score, piece.get(3, _NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                normaliser = dict(_fields(value))
    return pieces, normaliser, kind


class PieceTransducer:
    """The compiled machine of a BPE model file with byte fallback."""

    def __init__(self, path: str):
        pieces, normaliser, kind = read_model(path)
        if kind != 2 or normaliser.get(2) or normaliser.get(4, 1):
            raise ValueError("only BPE models with an identity normaliser that keeps blanks are supported")
        self.prefix = bool(normaliser.get(3, 1))
        self.texts = [t for t, _, _ in pieces]
        self.bytes = {int(t[3:5], 16): i for i, (t, _, k) in enumerate(pieces) if k == _BYTE}
        self.ids = {t: i for i, (t, _, k) in enumerate(pieces) if k in (_NORMAL, _USER)}
        self.rank = {i: -pieces[i][1] for i in self.ids.values()}
        self.output = [b"" if k in (2, 3) else bytes([int(t[3:5], 16)]) if k == _BYTE else t.encode() for t, _, k in pieces]
        self.trie: dict = {}
        self.left: dict[int, list[tuple[str, float]]] = {}
        self.right: dict[int, list[tuple[str, float]]] = {}
        for text, number in self.ids.items():
            tree = self._merge_tree(text)
            if tree is not None:
                self._spines(number, tree)
                node = self.trie
                for char in text:
                    node = node.setdefault(char, {})
                node[""] = number
        #: a piece never goes on behind a mark that follows other text, so texts fall apart before marks
        self.split = not any(re.search(f"[^{MARK}]{MARK}", t) for t in self.ids)
        self.chunks = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if self.split else r"(?s:.+)")
        self.count = len(pieces)
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}

    def _merge_tree(self, text: str):
        """How merges build a piece: nested (text, left, right), or None if they never do."""
        nodes = [(char, None, None) for char in text]
        if any(char not in self.ids for char in text):
            return None
        while len(nodes) > 1:
            best, at = None, 0
            for k in range(len(nodes) - 1):
                number = self.ids.get(nodes[k][0] + nodes[k + 1][0])
                if number is not None and (best is None or self.rank[number] < best):
                    best, at = self.rank[number], k
            if best is None:
                return None
            nodes[at : at + 2] = [(nodes[at][0] + nodes[at + 1][0], nodes[at], nodes[at + 1])]
        return nodes[0]

    def _spines(self, number: int, tree) -> None:
        """Parts that touch the piece's left and right border, each with the rank of the merge that swallows it."""
        for side, into in ((1, self.left), (2, self.right)):
            spine, node, end = [], tree, float("inf")
            while node is not None:
                spine.append((node[0], end))
                end = self.rank[self.ids[node[0]]]
                node = node[side]
            into[number] = spine

    def may_follow(self, first: int, second: int) -> bool:
        """Whether no merge across the border of two pieces comes before both are complete."""
        known = self.pairs.get(first * self.count + second)
        if known is None:
            known = True
            for part, end in self.right[first]:
                for other, stop in self.left[second]:
                    number = self.ids.get(part + other)
                    if number is not None and self.rank[number] < end and self.rank[number] <= stop:
                        known = False
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[first * self.count + second] = known
        return known

    def shortest_path(self, chunk: str) -> list[int]:
        """Piece numbers on the cheapest path through the lattice of a chunk."""
        size, trie = len(chunk), self.trie
        last: list[int | None] = [None] * (size + 1)
        back = [0] * (size + 1)
        known, may_follow, count = self.pairs.get, self.may_follow, self.count
        last[0] = -1
        for at in range(size):
            before = last[at]
            if before is None:
                continue
            node = trie.get(chunk[at])
            if node is None:
                last[at + 1], back[at + 1] = -2, at  # byte arcs; nothing merges across them
                continue
            end = at
            while node is not None:
                end += 1
                number = node.get("")
                if number is not None and last[end] is None:
                    fits = True if before < 0 else known(before * count + number)
                    if may_follow(before, number) if fits is None else fits:
                        last[end], back[end] = number, at
                if end == size:
                    break
                node = node.get(chunk[end])
        out: list[int] = []
        at = size
        while at:
            start = back[at]
            if last[at] == -2:
                out.extend(self.bytes[b] for b in reversed(chunk[start:at].encode()))
            else:
                out.append(last[at])
            at = start
        out.reverse()
        return out

    def normalise(self, text: str) -> str:
        """Mark for blank, and the leading mark; nothing for the empty text."""
        return ((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else ""

    def _chunk_bytes(self, chunk: str) -> bytes:
        found = array("i", self.shortest_path(chunk)).tobytes()
        if len(chunk) <= 64:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[chunk] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Piece numbers of the whole text."""
        known = self.cache
        return np.frombuffer(
            b"".join([known.get(c) or self._chunk_bytes(c) for c in self.chunks.findall(self.normalise(text))]), np.int32
        )

    def decode(self, ids) -> str:
        """Text of piece numbers; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    """One machine for each process and model file."""
    return PieceTransducer(path)


def _coded(batch: pa.RecordBatch, at: int, machine: PieceTransducer) -> pa.RecordBatch:
    """The batch with ids, n_ids and round_trip of the text in column ``at``."""
    texts = batch.column(at).to_pylist()
    ids = [None if t is None else machine.encode(t) for t in texts]
    same = [None if t is None else machine.decode(i.tolist()) == t for t, i in zip(texts, ids)]
    counts = np.array([0 if i is None else len(i) for i in ids], np.int64)
    flat = np.concatenate([i for i in ids if i is not None] or [np.empty(0, np.int32)])
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()), mask=pa.array([i is None for i in ids], pa.bool_()))
    return pa.RecordBatch.from_arrays(
        [*batch.columns, lists, pa.array(counts), pa.array(same, pa.bool_())], [*batch.schema.names, "ids", "n_ids", "round_trip"]
    )


def encode(docs: DataFrame, path: str = MODEL, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``n_ids`` and ``round_trip``: whether decoding gives the text back.

    Null text gives null ids, n_ids 0 and a null round trip; the empty text gives no ids. A text that holds the piece mark
    itself decodes to a blank there, so its round trip is false. Every other column of ``docs`` stays (ids, n_ids and
    round_trip of the input are replaced). Whole texts, one pass, no shuffle; a batch goes through in slices of bounded
    length; ``path`` is a model file every executor has."""
    rows = docs.drop("ids", "n_ids", "round_trip")
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            turn = np.cumsum(sizes, dtype=np.int64) // SLICE
            edges = [0, *(np.flatnonzero(np.diff(turn)) + 1), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                yield _coded(batch.slice(low, high - low), at, machine)

    schema = StructType([*rows.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("n_ids", LongType()),
                         StructField("round_trip", BooleanType())])
    return rows.mapInArrow(run, schema)


def decode(coded: DataFrame, path: str = MODEL, ids: str = "ids") -> DataFrame:
    """``coded`` with ``decoded``: the text of ``ids``; null ids give null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(path)
        for batch in batches:
            yield pd.Series([None if i is None else machine.decode(i) for i in batch], dtype=object)

    return coded.withColumn("decoded", F.pandas_udf(run, StringType())(ids))
