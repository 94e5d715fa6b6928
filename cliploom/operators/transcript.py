"""Transcript chunks, words, speakers and excerpts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.operators.intervals import interval_join, point_join
from cliploom.operators.reporting import first_per_key


def chunk_plan(sources: DataFrame, chunk_ms: int = 480_000, overlap_ms: int = 1_000) -> DataFrame:
    """Core windows of ``chunk_ms`` and the overlapping span to transcribe for each."""
    big = lambda v: F.lit(v).cast("bigint")
    usable = sources.filter(F.col("duration_ms") > 0)
    starts = F.sequence(big(0), F.floor((F.col("duration_ms") - 1) / chunk_ms).cast("bigint"))
    chunks = usable.select("source_id", "duration_ms", F.explode(starts).alias("chunk_index"))
    core = F.col("chunk_index") * chunk_ms
    core_end = F.least(F.col("duration_ms"), core + chunk_ms)
    start = F.greatest(big(0), core - overlap_ms)
    return chunks.select(
        "source_id", "chunk_index", core.alias("core_start"), core_end.alias("core_end"), start.alias("chunk_start"),
        F.least(F.col("duration_ms"), core_end + overlap_ms).alias("chunk_end"), (core - start).alias("overlap_before"),
    )


def chunk_word_assign(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Words (chunk-relative times) kept by the chunk whose core holds their midpoint, clamped to it."""
    joined = words.join(chunks, ["source_id", "chunk_index"])
    middle = F.col("chunk_start") + (F.col("w_start") + F.col("w_end")) / 2
    start = F.greatest(F.col("core_start"), F.col("chunk_start") + F.col("w_start"))
    end = F.least(F.col("core_end"), F.col("chunk_start") + F.col("w_end"))
    return joined.filter((middle >= F.col("core_start")) & (middle < F.col("core_end"))).select(
        "source_id", "chunk_index", F.trim("w").alias("w"), start.alias("start_ms"), end.alias("end_ms")
    ).filter((F.col("w") != "") & (F.col("end_ms") > F.col("start_ms")))


def midpoint_speaker_join(words: DataFrame, segments: DataFrame) -> DataFrame:
    """Speaker of the first segment that holds the word's midpoint (null without one)."""
    spans = segments.select(
        "transcript_id", F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e"), F.col("speaker").alias("segment_speaker")
    )
    keyed = words.drop("speaker").withColumn("__m", (F.col("start_ms") + F.col("end_ms")) / 2)
    hits = point_join(keyed.select("transcript_id", "chunk_index", "pos", "__m"), spans, ["transcript_id"], "__m", ("__s", "__e"))
    keys = ["transcript_id", "chunk_index", "pos"]
    first = first_per_key(hits, keys, [F.col("__s"), F.col("__e")]).select(*keys, "segment_speaker")
    return keyed.drop("__m").join(first, keys, "left")


def excerpts(clips: DataFrame, words: DataFrame, limit: int = 4000) -> DataFrame:
    """Words overlapping each clip, in order, as text of at most ``limit`` characters."""
    w = words.select(
        F.col("transcript_id").alias("source_id"), F.col("start_ms").alias("w_start"), F.col("end_ms").alias("w_end"), "w",
        "chunk_index", "pos",
    )
    hits = interval_join(
        clips.select("clip_id", "source_id", "start_ms", "end_ms"), w, ["source_id"], ("start_ms", "end_ms"), ("w_start", "w_end")
    )
    # A clip lasts at most a minute, so its words form a short list.
    listed = F.array_sort(F.collect_list(F.struct("w_start", "chunk_index", "pos", "w")))
    return hits.groupBy("clip_id").agg(F.count("*").alias("words"), listed.alias("__w")).select(
        "clip_id", "words", F.substring(F.trim(F.array_join(F.transform("__w", lambda x: x["w"]), " ")), 1, limit).alias("excerpt")
    )


def transcript_chunks(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Text of every planned chunk, null without words, and whether all chunks of its transcript are done.

    ``chunks`` carries the planned chunk numbers with their status. A transcript of any length stays spread: only the words
    of one chunk meet in a row."""
    texts = words.filter(F.trim("w") != "").groupBy("transcript_id", "chunk_index").agg(
        F.array_sort(F.collect_list(F.struct("start_ms", "pos", F.trim("w").alias("w")))).alias("__w")
    ).select("transcript_id", "chunk_index", F.array_join(F.transform("__w", lambda x: x["w"]), " ").alias("chunk_text"))
    done = chunks.groupBy(F.col("transcript_id").alias("__id")).agg((F.count_if(F.col("status") != "SUCCEEDED") == 0).alias("complete"))
    told = chunks.join(texts, ["transcript_id", "chunk_index"], "left")
    return told.join(done, F.col("transcript_id").eqNullSafe(F.col("__id"))).select(
        "transcript_id", "chunk_index", "status", "complete", "chunk_text"
    )


def transcript_assemble(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Full text of each transcript as one row; incomplete ones are marked and left empty.

    For transcripts too long for a row, read ``transcript_chunks`` in order instead."""
    whole = transcript_chunks(words, chunks).groupBy("transcript_id", "complete").agg(
        F.array_sort(F.collect_list(F.when(F.col("complete") & F.col("chunk_text").isNotNull(), F.struct("chunk_index", "chunk_text")))).alias("__c"),
    )
    return whole.select(
        "transcript_id", "complete", F.when(F.col("complete"), F.array_join(F.transform("__c", lambda x: x["chunk_text"]), " ")).alias("full_text")
    )


def pending_chunks(planned: DataFrame, finished: DataFrame) -> DataFrame:
    done = finished.filter("status = 'SUCCEEDED'").select("source_id", "chunk_index")
    return planned.join(done, ["source_id", "chunk_index"], "left_anti")
