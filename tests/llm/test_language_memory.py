"""What the language model holds in a task stays bounded, and parts change no result."""

import tracemalloc

import numpy as np
import pyarrow as pa

from cliploom.llm import language


def words(n, start=0):
    return [f"{w}".translate(str.maketrans("0123456789", "abcdefghij")) for w in range(10**9 + start, 10**9 + start + n)]


def peak_mb(run):
    language._letter_table()
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def batch(rows):
    return pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]}, pa.schema([("lang", pa.string()), ("text", pa.string())]))


def model(kinds=4):
    table = np.random.default_rng(1).normal(-8, 1, (1 << language.BUCKETS_LOG2, kinds)).astype(np.float32)
    scripts = np.zeros((len(language.SCRIPTS) + 1, kinds), bool)
    scripts[language.SCRIPTS.index("latin") + 1] = True
    return language.LanguageModel(tuple("abcd"[:kinds]), table, scripts)


def test_judging_many_words_holds_few_grams():
    many, judge = words(120_000), model()
    assert peak_mb(lambda: judge._judged(many)) < 60  # 24 MB are what it returns and cleans up
    assert peak_mb(lambda: judge.known_letters(many)) < 20


def test_counting_holds_words_of_all_languages_together():
    rows = [(lang, " ".join(words(1000, 10**6 * k + 1000 * i))) for i in range(150) for k, lang in enumerate(("aa", "bb", "cc", "dd"))]
    given = [batch(rows[i : i + 100]) for i in range(0, len(rows), 100)]
    assert peak_mb(lambda: list(language._cells(iter(given)))) < 70


def test_parts_of_words_give_what_each_word_gives():
    many = [*words(20_000), "x" * (2 * language.GRAM_CHARS), "µ", "123", "日本", *words(9_000, 10**6)]
    assert len(list(language._parts(many))) > 3
    judge = model()
    whole = judge._judged(many)
    for i in [0, 1, 6000, 19_999, 20_000, 20_001, 20_002, 20_003, 20_004, len(many) - 1]:
        assert all((a[i] == b[0]).all() for a, b in zip(whole, judge._judged([many[i]])))
        assert judge.known_letters(many)[i] == judge.known_letters([many[i]])[0]


def test_counts_are_those_of_all_grams():
    rows = [("aa", " ".join(words(15_000))), ("bb", "abc ABC"), ("aa", "one one"), ("bb", ""), ("cc", " ")]
    found = {(r["lang"], r["cell"]): r["n"] for out in language._cells(iter([batch(rows[:2]), batch([]), batch(rows[2:])])) for r in out.to_pylist()}
    want = {}
    for lang, text in rows:
        if split := text.lower().split():
            buckets, _, letters, script = language._grams(split)
            for cell, n in [*zip(buckets, np.ones(len(buckets))), *zip(script + np.int64(1 << language.BUCKETS_LOG2), letters)]:
                want[lang, int(cell)] = want.get((lang, int(cell)), 0) + n
    assert found == {k: n for k, n in want.items() if n}


def test_slices_are_whole_rows():
    texts = pa.array([None, "a" * language.SLICE_CHARS, "", "ß" * (language.SLICE_CHARS // 2), None, "b" * 10])
    cuts = list(language._slices(texts))
    assert [i for a, b in cuts for i in range(a, b)] == list(range(len(texts))) and len(cuts) == 2
    assert list(language._slices(pa.array([], pa.string()))) == []
