"""What a task of op12 holds stays bounded when every phrase passes the cells."""

import random
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cliploom.llm import phrases


def relation_of(spark, rows, how):
    texts = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    _, words, seed = phrases._frequent_words(texts, how)
    held = phrases.Filter.of(words.select("lang", F.array("name").alias("ws"), "n"), 1, how.filter_bits)
    return phrases.first_relation(texts, held, how, seed).localCheckpoint()


def test_sums_hold_little_besides_their_rows():
    draw = np.random.Generator(np.random.PCG64(3))
    sums, rows = phrases._Sums(1 << 16), 1 << 14
    tracemalloc.start()
    for _ in range(32):
        sums.add([draw.integers(0, 1 << 60, rows).astype(np.uint64) for _ in range(6)], np.ones(rows, np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 32 * rows * 7 * 8


def test_a_reader_and_a_task_hold_few_slices_at_once(spark):
    """Slices are short, and a task of the count has one Python worker and hands on rows, not tables in a row."""
    rng, how = random.Random(2), phrases.Mining(least=20)
    rows = [("xx", " ".join(rng.choice("abcdefgh") for _ in range(9000))), ("yy", "one two " * 300), ("xx", "a b. c d " * 40)]
    relation = relation_of(spark, rows, how)
    longest = relation.agg(F.max(F.size("w"))).first()[0]
    assert longest * 8 * 4096 < 16 << 20  # rows that Spark's Parquet reader holds at once
    crowded = phrases.crowded_cells(relation, 2, how)
    counts = phrases.task_counts(relation, 2, how, crowded)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "array" not in counts.schema.simpleString()
    pairs = Counter()
    for lang, text in rows:
        for piece in text.split("."):
            pairs.update((lang, *p) for p in zip(piece.split(), piece.split()[1:]))
    assert counts.agg(F.sum("n")).first()[0] == sum(pairs.values())
    third = phrases.next_relation(relation, phrases.Filter.of(phrases.phrase_counts(relation, 2, how, crowded), 2, how.filter_bits), 2, how)
    crowded = phrases.crowded_cells(third, 3, how)
    runs = Counter((lang, *t) for lang, text in rows for p in text.split(".") for t in zip(p.split(), p.split()[1:], p.split()[2:]))
    got = sorted(r.n for r in phrases.phrase_counts(third, 3, how, crowded).collect())
    assert got == sorted(n for n in runs.values() if n >= 20)
