"""A corpus pipeline of five stages over ``documents``, each stage's rows written and read again as the next one's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cliploom.llm.language import known_language
from cliploom.llm.mixing import mix
from cliploom.llm.pieces import encode
from cliploom.llm.setsketch import without_near_duplicates
from cliploom.llm.site_lines import drop_site_boilerplate
from cliploom.llm.storage import shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mostly in one learned language; those without letters or without a leading language go."""
    return known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; ``n_chars`` follows the text."""
    return drop_site_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on five-word shingles at 0.8."""
    return without_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows repeat by epochs, and a source's last row is cut at its exact budget."""
    return mix(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with piece numbers and whether those decode to the text."""
    return encode(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", piece_ids),
]

#: The language model, sketches and pieces have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``; stages hand over Parquet tables in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return done
        done.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
