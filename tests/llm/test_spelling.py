"""Batches of texts are spelled as the tokenizer spells each of them, from distinct words only."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from cliploom.llm import secrets, spelling

PATH = f"{secrets.TOKENIZERS}/{secrets.VOCABULARY}"


def alike(texts: list) -> None:
    vocabulary = secrets.encoding(PATH)
    expected = [np.array(vocabulary.encode_ordinary(t or ""), "<u2").tobytes() for t in texts]
    parts = list(spelling.slices(pa.array(texts, pa.string())))
    assert [ids for part in parts for ids in spelling.spelled(part, PATH)] == expected
    assert [n for part in parts for n in spelling.counted(part, PATH).tolist()] == [len(ids) // 2 for ids in expected]


def test_awkward_texts_are_spelled_as_the_tokenizer_does():
    draw = random.Random(3)
    signs = list(" \n\t\r  '''strevmldSTab12٣½²_-.,!é漢字ї\x00") + ["́", " ", "\u0085", "​", "　", "﻿", "‍", "😀", "\U0001d7ce"]
    alike(["".join(draw.choices(signs, k=draw.randint(0, 14))) for _ in range(20_000)])
    alike(["".join(draw.choices(signs[:-10], k=draw.randint(0, 14))) for _ in range(20_000)])
    alike(["it'", "s", "x ", "y", "'re", "'r", "e", "", None, "'", "'l", "l's ", " 's", "\n's", "''s", "'s't're", "a  b", "a \n b", "  "])
    alike(["".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000), " ".join(map(chr, range(0x3000)))])
    alike([])
    alike([None])
    alike(["", ""])


def test_slices_keep_order_and_borders(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 7)
    alike(["one two", "", None, "'s three four five six", "seven", " ", "x" * 40, "é漢'll go"])


def test_the_tokenizer_meets_each_distinct_word_once(monkeypatch):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks()
    met, spell = [], spelling._spellings
    monkeypatch.setattr(spelling, "_spellings", lambda words, path: met.append(words.to_pylist()) or spell(words, path))
    for part in spelling.slices(texts):
        words = spelling._words(part)[0].to_pylist()
        assert b"".join(words) == b"".join(part.to_pylist())
        met.clear()
        spelling.counted(part, PATH)
        spelling.spelled(part, PATH)
        assert [sorted(m) for m in met] == [sorted(set(words))] * 2
        assert 2 * len(set(words)) < len(words)
