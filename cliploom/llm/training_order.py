"""Training-order materialisation: a keyed permutation gives every sequence a slot, ranges of slots become shards."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliploom.llm.secrets import TOKENIZERS, VOCABULARY
from cliploom.llm.spelling import counted, slices, spelled
from cliploom.llm.storage import as_text, partitions, shared_folder, stored
from cliploom.llm.words import mixed

SEQUENCE = 512
PAD = 50256
SHARD_ROWS = 65536
ROUNDS = 6
KEY = 20_240_601
#: Most tasks that write shards; beyond it a task writes several.
WRITERS = 20_000
_SLOT = ">q"
_HEAD = ">qii"  # document (smallest number: none), sequence in the document, tokens before padding
_NAME = 10  # digits of a shard's folder
ROW = "slot long, shard long, offset long, doc_id long, seq int, n_tokens int, record binary"


def feistel(index: np.ndarray, count: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 to count - 1: Feistel rounds over the next even power of two, walking the cycle of a
    value until it falls inside the range."""
    half = np.uint64(max(1, (max(count - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key) * np.uint64(ROUNDS + 1))

    def once(value: np.ndarray) -> np.ndarray:
        left, right = value >> half, value & mask
        for k in keys:
            with np.errstate(over="ignore"):
                left, right = right, left ^ (mixed(right * np.uint64(0x9E3779B97F4A7C15) + k) & mask)
        return (left << half) | right

    out = once(index.astype(np.uint64))
    outside = np.flatnonzero(out >= count)
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= count]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """Fixed stride of a record: slot, head, ``sequence`` ids of two bytes, and one closing byte."""

    sequence: int = SEQUENCE
    shard_rows: int = SHARD_ROWS

    @property
    def stride(self) -> int:
        return struct.calcsize(_SLOT) + struct.calcsize(_HEAD) + 2 * self.sequence + 1

    def unpack(self, record: bytes) -> tuple[int | None, int, list[int]]:
        """(doc_id, sequence number, token ids) of a record, with or without its closing byte."""
        at = struct.calcsize(_SLOT)
        doc_id, number, tokens = struct.unpack_from(_HEAD, record, at)
        ids = np.frombuffer(record, "<u2", tokens, at + struct.calcsize(_HEAD))
        return None if doc_id == -(2**63) else doc_id, number, ids.tolist()

    def columns(self, stored: str) -> list:
        """A stored record as the columns of ``ROW``; everything but the bytes follows from its slot and head."""
        number = lambda at, size: F.conv(F.hex(F.substring(stored, at, size)), 16, -10).cast("long")
        slot, doc_id = number(1, 8), number(9, 8)
        return [
            slot.alias("slot"), F.floor(slot / self.shard_rows).alias("shard"),
            (slot % self.shard_rows * self.stride).alias("offset"), F.when(doc_id != -(2**63), doc_id).alias("doc_id"),
            number(17, 4).cast("int").alias("seq"), number(21, 4).cast("int").alias("n_tokens"),
            F.substring(stored, 1, self.stride - 1).alias("record"),
        ]


def _speller(path: str):
    """A function that spells a text as two-byte ids."""
    return lambda text: spelled(next(slices(pa.array([text]))), path)[0]


def _cut(ids: bytes, doc_id: int | None, layout: Layout) -> Iterator[tuple[int, int, bytes]]:
    """(number, tokens, head and padded ids) of each sequence of a document."""
    pad, step = struct.pack("<H", PAD) * layout.sequence, 2 * layout.sequence
    own = -(2**63) if doc_id is None else doc_id
    for seq, at in enumerate(range(0, len(ids), step)):
        piece = ids[at : at + step]
        yield seq, len(piece) // 2, struct.pack(_HEAD, own, seq, len(piece) // 2) + piece + pad[len(piece) :]


def _along(doc_ids, texts: pa.Array, spell, path: str) -> Iterator[tuple]:
    """Each document's number with what ``spell`` makes of its text, a slice at a time."""
    made = (x for some in slices(texts) for x in spell(some, path))
    return zip(doc_ids, made, strict=True)


def sequences(docs: DataFrame, layout: Layout, path: str) -> DataFrame:
    """Records of all documents with their task and place in it: part, place, doc_id, seq, n_tokens, record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, place = TaskContext.get().partitionId(), 0
        names = ["part", "place", "doc_id", "seq", "n_tokens", "record"]
        for batch in batches:
            rows = []
            for doc_id, ids in _along(batch["doc_id"], pa.Array.from_pandas(batch["text"], type=pa.string()), spelled, path):
                for seq, tokens, record in _cut(ids, None if doc_id is None else int(doc_id), layout):
                    rows.append((part, place, doc_id, seq, tokens, record))
                    place += 1
                if len(rows) >= 4096:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    made = docs.select(*as_text("doc_id"), "text").mapInPandas(
        run, "part int, place long, doc_id string, seq int, n_tokens int, record binary"
    )
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def _slotted(docs: DataFrame, layout: Layout, key: int, path: str) -> tuple[DataFrame, int]:
    """Every sequence with its slot, in no order, and their number."""
    spark = docs.sparkSession
    table = stored(sequences(docs, layout, path), "sequences")
    counts = table.groupBy("part").agg((F.max("place") + 1).alias("n"))  # one row per task
    starts = stored(counts.select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("start"), "n",
    ), "starts")
    count = starts.agg(F.sum("n")).first()[0] or 0

    from pyspark.sql.types import LongType

    @F.pandas_udf(LongType())
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), count, key))

    placed = table.join(F.broadcast(starts.select("part", "start")), "part").withColumn("slot", slot(F.col("start") + F.col("place")))
    named = F.unhex(F.lpad(F.hex("slot"), 16, "0"))  # the slot's eight bytes
    return placed.select(
        "slot", F.floor(F.col("slot") / layout.shard_rows).alias("shard"),
        (F.col("slot") % layout.shard_rows * layout.stride).alias("offset"), "doc_id", "seq", "n_tokens",
        F.concat(named, "record").alias("record"),
    ), count


def training_order(
    docs: DataFrame, layout: Layout = Layout(), key: int = KEY, path: str = f"{TOKENIZERS}/{VOCABULARY}"
) -> DataFrame:
    """Every sequence of ``docs`` (doc_id, text) in training order: slot, shard, offset, doc_id, seq, n_tokens, record.

    A document's tokens are cut into sequences of ``layout.sequence``; the last is padded. Null or empty texts have none.
    Tokens are written once; a sequence's index is its place in that table (tasks in order, rows in order), and the
    keyed permutation maps it to a gapless slot, so nothing but one count per task is gathered. Rows are ranged by slot,
    where slots are dense, so no document or source can make a range hot. Repeated rows give repeated sequences; other
    columns of ``docs`` are not read."""
    rows, _ = _slotted(docs, layout, key, path)
    return rows.repartitionByRange(partitions(docs.sparkSession), "slot").sortWithinPartitions("slot")


def _recounted(docs: DataFrame, layout: Layout, key: int, path: str) -> tuple[DataFrame, int]:
    """Shard, slot and record of every sequence, as ``training_order`` numbers them, and their number; no tokens are stored.

    One pass counts the sequences of each task, a second spells the documents again with their slots. A task that meets
    other documents than in the first pass, or another order, fails, so no slot is lost or used twice."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")

    def read(batches: Iterator[pa.RecordBatch], spell) -> Iterator[tuple]:
        for batch in batches:
            yield from _along(batch.column(0).to_pylist(), batch.column(1), spell, path)

    def named(seen: int, doc_id: int | None, n: int) -> int:
        return zlib.crc32(f"{doc_id}:{n}".encode(), seen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, seen = TaskContext.get().partitionId(), 0, 0
        for doc_id, tokens in read(batches, counted):
            n = -(-int(tokens) // layout.sequence)
            total, seen = total + n, named(seen, doc_id, n)
        yield pa.RecordBatch.from_pydict({"part": [part], "n": [total], "seen": [seen]})

    tallies = sorted(tuple(r) for r in texts.mapInArrow(count, "part long, n long, seen long").collect())  # one row per task
    first = np.cumsum([0, *(n for _, n, _ in tallies)]).tolist()
    known = docs.sparkSession.sparkContext.broadcast({part: (at, at + n, seen) for at, (part, n, seen) in zip(first, tallies)})

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, end, before = known.value.get(TaskContext.get().partitionId(), (0, 0, 0))
        seen, held = 0, []

        def slotted() -> pa.RecordBatch:
            slots = feistel(np.arange(at, at + len(held)), first[-1], key)
            made = [struct.pack(_SLOT, slot) + record for slot, record in zip(slots.tolist(), held)]
            return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(made, pa.binary())], names=["slot", "record"])

        for doc_id, ids in read(batches, spelled):
            size = len(held)
            held.extend(record for _, _, record in _cut(ids, doc_id, layout))
            seen = named(seen, doc_id, len(held) - size)
            if len(held) >= 4096 and at + len(held) <= end:
                yield slotted()
                at, held = at + len(held), []
        if at + len(held) != end or seen != before:
            raise RuntimeError("the documents changed between two readings; store them before they are ordered")
        if held:
            yield slotted()

    made = texts.mapInArrow(records, "slot long, record binary")
    return made.select(F.floor(F.col("slot") / layout.shard_rows).alias("shard"), "slot", "record"), first[-1]


def write_shards(rows: DataFrame, folder: str, shards: int | None = None) -> None:
    """One file per shard under ``folder``/shard=N, records at ``offset`` with the fixed stride.

    Slots are dense, so a shard's range needs no sample: its number names the task that writes it. Spark's own writer and
    commit protocol put the bytes there (as text: the writer copies them as they are), so any file system works and lost
    tasks leave nothing behind. A shard is one task's file: its size is the layout's, whatever the corpus holds.
    ``shards`` is their number where it is known."""
    if shards is None:
        shards = (rows.agg(F.max("shard")).first()[0] or 0) + 1
    tasks = max(1, min(shards, WRITERS))
    (
        rows.select("shard", "slot", F.col("record").cast("string").alias("value"))
        .repartitionById(tasks, F.floor(F.col("shard") * tasks / max(shards, 1)).cast("int"))
        .withColumn("shard", F.lpad(F.col("shard").cast("string"), _NAME, "0"))
        .sortWithinPartitions("shard", "slot").drop("slot")
        .write.partitionBy("shard").option("lineSep", "\n").text(folder)
    )


def _from_shard(first: int) -> str:
    """A path pattern for the folders of the shards from ``first`` on: one alternative for each digit that may rise."""
    name = str(first).zfill(_NAME)
    rising = [
        f"{name[:at]}[{int(digit) + 1}-9]{'?' * (_NAME - at - 1)}" for at, digit in enumerate(name) if digit != "9"
    ]
    return "shard={" + ",".join([name, *rising]) + "}"


def read_shards(spark: SparkSession, folder: str, layout: Layout = Layout(), from_slot: int = 0) -> DataFrame:
    """Rows of the shards from a slot on: slot, shard, offset, doc_id, seq, n_tokens, record.

    Files before its shard are not opened. Spark's reader of fixed-length records splits files of any size at record
    borders and streams them, so no file is ever one value; of the first shard the records before the slot are passed
    over. A folder without such shards gives no rows."""
    first = from_slot // layout.shard_rows
    shard = F.regexp_extract("path", r"shard=(\d+)", 1).cast("long")
    if spark.read.format("binaryFile").load(folder).select("path").filter(shard >= first).isEmpty():
        return spark.createDataFrame([], ROW)
    records = spark.sparkContext.binaryRecords(f"{folder}/{_from_shard(first)}", layout.stride)
    whole = spark.createDataFrame(records.map(lambda r: (bytearray(r),)), "stored binary", verifySchema=False)
    return whole.select(*layout.columns("stored")).filter(F.col("slot") >= from_slot)


def materialised(
    docs: DataFrame, layout: Layout = Layout(), key: int = KEY, path: str = f"{TOKENIZERS}/{VOCABULARY}",
    folder: str | None = None,
) -> DataFrame:
    """``training_order`` written as shards to ``folder`` (a new one in the shared folder if none is named) and read from them.

    ``docs`` are read twice and must come alike both times, as a table's rows do; their tokens are not stored besides the
    shards. Documents without tokens, or none at all, leave no shard and give no rows."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    rows, count = _recounted(docs, layout, key, path)
    if not count:
        return spark.createDataFrame([], ROW)
    write_shards(rows, folder, -(-count // layout.shard_rows))
    return read_shards(spark, folder, layout)
