"""Document fingerprints: MinHash over word shingles with universal hash permutations in numpy, signature bands joined
in Spark, Jaccard verified on the full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from cliploom.llm import setsketch
from cliploom.llm.sharding import Splitter
from cliploom.llm.storage import as_text, partitions
from cliploom.llm.words import minima, parameters, set_digest, shingle_hashes, word_hashes

_NONE = -(2**63)


@dataclass(frozen=True)
class MinHash:
    """Words in a shingle, permutations, bits kept of each minimum (16), and bands of the signature."""

    size: int = 5
    permutations: int = 128
    bands: int = 32
    percent: int = 80
    seed: int = 1

    @property
    def rows(self) -> int:
        return self.permutations // self.bands


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper 16 bits of the least hash of each permutation over the shingles."""
    return (minima(shingles, a, b) >> np.uint64(48)).astype(np.uint16)


def likeness(first: np.ndarray, second: np.ndarray) -> float:
    """Share of equal minima: an estimate of the Jaccard similarity."""
    return float((first == second).mean())


def edited_text(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bounds(rows: DataFrame) -> list[Splitter]:
    """First (key, tie) of every range of the rows: one for each shuffle partition that holds rows."""
    ranged = rows.select("_key", "_tie").repartitionByRange(partitions(rows.sparkSession), "_key", "_tie")
    first = ranged.groupBy(F.spark_partition_id().alias("_part")).agg(F.min(F.struct("_key", "_tie")).alias("f"))
    return [Splitter(r["f"]["_key"], r["f"]["_tie"]) for r in first.orderBy("_part").collect()]


def _dealt(bounds: list[Splitter]) -> Column:
    """Range of a row, and whether the row is the first of its range."""
    marks = np.array([(s.key, s.tie) for s in bounds], np.int64).reshape(-1, 2)

    def run(keys: pd.Series, ties: pd.Series) -> pd.DataFrame:
        both = np.concatenate((marks[:, 0], keys)), np.concatenate((marks[:, 1], ties))
        is_row = np.arange(len(both[0])) >= len(marks)
        order = np.lexsort((is_row, both[1], both[0]))
        seen = np.empty(len(order), np.int64)
        seen[order] = np.cumsum(~is_row[order])
        part = np.maximum(seen[len(marks):] - 1, 0)
        return pd.DataFrame({"part": part, "first": ((marks[part, 0] == keys) & (marks[part, 1] == ties)).astype(int)})

    return F.pandas_udf(run, StructType([StructField("part", LongType()), StructField("first", IntegerType())]))("_key", "_tie")


def with_following(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) dealt into ranges by doc_id, each range closed by a guest: the first row of the next one.

    Columns part, guest, doc_id (as text), text; partitions are sorted by part, guest, doc_id, so a task that reads on sees every row's
    follower. One shuffle of the texts; the guests are one row for each range."""
    rows = docs.select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(_NONE)).alias("_key"), F.xxhash64("text").alias("_tie")
    )
    bounds = _bounds(rows)
    count = max(1, len(bounds))
    dealt = rows.withColumn("_at", _dealt(bounds))
    before = F.pmod(F.col("_at.part") - 1, F.lit(count))
    places = F.when(F.col("_at.first") == 1, F.array(
        F.struct(F.col("_at.part").alias("part"), F.lit(0).alias("guest")), F.struct(before.alias("part"), F.lit(1).alias("guest"))
    )).otherwise(F.array(F.struct(F.col("_at.part").alias("part"), F.lit(0).alias("guest"))))
    return dealt.withColumn("_place", F.explode(places)).select(
        F.col("_place.part").alias("part"), F.col("_place.guest").alias("guest"), "doc_id", "text", "_key", "_tie"
    ).repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part", "guest", "_key", "_tie").select(
        "part", "guest", *as_text("doc_id"), "text"
    )


def fingerprints(docs: DataFrame, how: MinHash = MinHash()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, jaccard_edited, shared_bands.

    The edited text takes its end from the next document by doc_id (after the last: the first; rows without an id come
    first, rows with one id stand in the order of their texts' hash). Null text is empty; empty or blank texts have the
    fingerprint of the empty set, which is like itself only. ``jaccard_edited`` is the exact similarity of the shingle
    sets of text and edited text, ``shared_bands`` the number of signature bands they share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = parameters(how.permutations, how.seed)

        def marked(doc_id, text):
            shingles = shingle_hashes(word_hashes(text), how.size)
            return doc_id, text, shingles, signature(shingles, a, b)

        def row(own, following):
            doc_id, text, shingles, sign = own
            edited = edited_text(text, following[1])
            other = shingle_hashes(word_hashes(edited), how.size)
            changed = signature(other, a, b)
            both = len(np.intersect1d(shingles, other, assume_unique=True))
            union = len(shingles) + len(other) - both
            return (
                doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), sign.astype(">u2").tobytes().hex(), changed.astype(">u2").tobytes().hex(),
                likeness(sign, changed), likeness(sign, following[3]), both / union if union else float(text == edited),
                int((sign == changed).reshape(how.bands, -1).all(1).sum()),
            )

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
                 "jaccard_edited", "shared_bands"]
        waiting, part = None, None
        for batch in batches:
            rows = []
            for at, guest, doc_id, text in zip(batch["part"], batch["guest"], batch["doc_id"], batch["text"]):
                if guest and waiting is None:
                    continue
                now = marked(doc_id, text or "")
                if waiting is not None:
                    if at != part:
                        raise ValueError("a range lost the row that follows it")
                    rows.append(row(waiting, now))
                waiting, part = (None, None) if guest else (now, at)
            yield pd.DataFrame(rows, columns=names)

    made = with_following(docs).mapInPandas(
        run, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, jaccard_edited double, shared_bands int",
    )
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


_SIGNED = StructType([
    StructField("n_shingles", LongType()), StructField("set_key", BinaryType()), StructField("sketch", BinaryType())
])


def minhash_groups(docs: DataFrame, how: MinHash = MinHash()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Signatures of distinct shingle sets are banded, band keys meet in Spark, and pairs are verified on the full sets:
    100 * intersection >= ``percent`` * union. Buckets are never capped: what a chosen member does not link is compared
    block against block. Nulls, empty texts and repeated rows are treated as in ``setsketch.near_duplicates``."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a, b = parameters(how.permutations, how.seed)
        for batch in batches:
            out = []
            for text in batch:
                shingles = shingle_hashes(word_hashes(text), how.size)
                sign = signature(shingles, a, b)
                out.append((len(shingles), set_digest(shingles), sign.tobytes() if len(shingles) else None))
            yield pd.DataFrame(out, columns=["n_shingles", "set_key", "sketch"])

    bands = setsketch.Sketching(
        size=how.size, percent=how.percent, bands=how.bands, rows=how.rows, spacing=None, margin=5 * (0.25 / how.permutations) ** 0.5
    )
    return setsketch.grouped(docs, F.pandas_udf(run, _SIGNED)("text"), bands)
