"""Prefix trie, phrase mining and quality rules against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cliploom.llm import phrases, prefix_trie, quality
from tests.llm.frames import SF, awkward, empty

CONV = "conv_id long, turn long, role string, text string, depth int, k1 string, shard int, _range int, conv int"


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    ends = defaultdict(list)
    for c, path in built.items():
        ends[tuple(path)].append(c)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], digest(p)) for p, m in nodes.items()
    )


def spark_trie(spark, rows, how):
    df = spark.createDataFrame([(*r, 1, "k", 2, 3, 4) for r in rows], CONV)
    out = prefix_trie.prefix_trie(df, how).collect()
    return sorted(
        (r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in out
    )


def conversations(seed=1):
    rng, rows = random.Random(seed), []
    for c in [*range(100, 160), *range(205, 260), -3, -150]:
        for turn in range(rng.choice([1, 2, 5, 9])):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(["a", "bé", "ccc"])))
    rows += [(700 + i, 0, "user", "same") for i in range(80)]
    rows += [(900, t, "user", f"long {t}") for t in range(60)] + [(901, t, "user", f"long {t}") for t in range(40)]
    rows += [(100, None, None, None), (100, None, "user", ""), (101, 1, "user", "x"), (101, 1, "user", "x"), (None, 1, "user", "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", [
    prefix_trie.Sharding(), prefix_trie.Sharding(members=3, band=4, queue=2), prefix_trie.Sharding(members=20, band=7, queue=4),
])
def test_trie_matches_plain(spark, how):
    rows = conversations()
    assert spark_trie(spark, rows, how) == plain_trie(rows)


def test_trie_of_table_and_of_nothing(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert spark_trie(spark, rows, prefix_trie.Sharding(members=8, band=3)) == plain_trie(rows)
    assert prefix_trie.prefix_trie(table.limit(0)).count() == 0


def test_queue_spills_and_keeps_order():
    queue, rng, held = prefix_trie.SpillingQueue(8), random.Random(2), []
    for k in range(500):
        item = (rng.randrange(50), k)
        queue.push(item)
        held.append(item)
        if k % 3 == 0:
            held.sort()
            assert queue.peek() == held[0] and queue.pop() == held.pop(0)
    assert queue.runs
    held.sort()
    while queue.peek() is not None:
        assert queue.pop() == held.pop(0)
    assert not held


def plain_phrases(rows, least, longest, top):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({k: k + 32 for k in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, found in counts.items():
        f = {p: c for p, c in found.items() if c >= least}
        best = []
        for p, a in f.items():
            if len(p) < 2 or any(len(q) > len(p) and f[q] >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q in f):
                continue
            score, k = min((1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


def spark_phrases(docs, how):
    return sorted(tuple(r) for r in phrases.collocations(docs, how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


SMALL = phrases.Mining(least=3, top=40, slice_words=7, block_bytes=64, block_rows=50, filter_bits=1 << 12, cells=1 << 8)


def test_phrases_match_plain(spark):
    rng, rows = random.Random(5), []
    for i in range(120):
        words = [rng.choice(["the", "Of", "a", "new", "york", "san", "é", "Zürich", "b"]) + rng.choice(["", "", ".", ",", "\n", "\t x"]) for _ in range(rng.randint(0, 40))]
        rows.append((i, " ".join(words), rng.choice(["xx", "yy", None]), "s", 0, 1, 2, "k", "t"))
    rows += [(1, None, "xx", "s", 0, 1, 2, "k", "t"), (2, "", None, "s", 0, 1, 2, "k", "t"), (None, "one two three four five six " * 400, "zz", None, 0, 1, 2, "k", "t")]
    rows += [(3, "w" * 500 + " of the " + "w" * 500, "yy", "s", 0, 1, 2, "k", "t")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, name int, w int, phrase string, word string")
    plain = [(r[2], r[1]) for r in rows]
    assert spark_phrases(docs, SMALL) == plain_phrases(plain, 3, 5, 40)
    assert spark_phrases(docs, phrases.Mining(least=3)) == plain_phrases(plain, 3, 5, 2000)


def test_phrases_of_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    rows = [(r.lang, r.text) for r in docs.collect() if r.text is None or len(r.text) < 100_000]
    few = docs.filter("text is null or length(text) < 100000")
    assert spark_phrases(few, SMALL) == plain_phrases(rows, 3, 5, 40)
    assert phrases.collocations(empty(spark)).count() == 0


def test_phrase_counts_leave_a_task_once(spark):
    """However many blocks a task reads, it sends a phrase once, and the tasks do not grow in number with the input."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [("xx", " ".join(rng.choice("abcdefgh") for _ in range(400))) for _ in range(60)] + [("yy", "one two " * 300)]
    texts = spark.createDataFrame(rows, "lang string, text string").repartition(40)
    how = phrases.Mining(least=100, slice_words=50, block_bytes=1 << 12, block_rows=64, filter_bits=1 << 12, cells=1 << 8)
    _, words, seed = phrases._frequent_words(texts, how)
    held = phrases.Filter.of(words.select("lang", F.array("name").alias("ws"), "n"), 1, how.filter_bits)
    relation = phrases.first_relation(texts, held, how, seed).localCheckpoint()
    crowded = phrases.crowded_cells(relation, 2, how)
    wide = Counter((lang, *pair) for lang, text in rows for pair in zip(text.split(), text.split()[1:]))
    tasks, cores = relation.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    sent = phrases.task_counts(relation, 2, how, crowded).agg(F.count("*"), F.sum("n")).first()
    assert tasks > cores and sent[0] <= cores * len(wide) and sent[1] == sum(wide.values())
    alone = phrases.task_counts(relation.repartition(1), 2, how, crowded).count()
    assert alone == len(wide)
    counted = phrases.phrase_counts(relation, 2, how, crowded).collect()
    assert sorted(r.n for r in counted) == sorted(n for n in wide.values() if n >= 100)


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(cover) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), failed


def test_quality_measures_match_plain(spark):
    docs = awkward(spark)
    extra = ["a b c d e a b c d e", "a b c d e f", "x\nx\n\n \ny #|<\nx", "a b c d a b c d a b c d e " * 3, "α\x0bβ\x85γ  δ ε", "one\r\ntwo\r\none\r\n"]
    more = spark.createDataFrame([(1000 + i, t, "en", None, 0, 0, 0, "", "") for i, t in enumerate(extra)], docs.schema)
    docs = docs.unionByName(more)
    found = quality.verdicts(docs).collect()
    want = sorted(((r.doc_id, *plain_quality(r.text)) for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found), key=repr) == want
    assert all(not r.kept for r in found if r.base_failed)
    assert all(r.kept == (not r.broken) for r in found)


def test_quality_rules_judge_and_keep_columns(spark):
    good = "the house of a man and his dog is on the hill, " + " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    texts = [good, good.replace(" ", " | "), " ".join(str(k) for k in range(100)), " ".join(f"zz{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)),
             "\n".join([good] + ["one line"] * 9), None]
    docs = spark.createDataFrame([(i, t, "en", 1, "m") for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int, m string")
    said = {r.doc_id: r.broken for r in quality.verdicts(docs).collect()}
    assert said[0] == [] and said[1] == ["symbols", "words without letters"]
    assert said[2] == ["word length", "words without letters", "stop words"]
    assert said[3] == ["stop words"] and "duplicate lines" in said[4] and said[5][0] == "too few words"
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [0]
    assert quality.verdicts(empty(spark)).count() == 0


def test_quality_stays_in_one_projection(spark):
    plan = quality.verdicts(awkward(spark).repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "Python" not in plan and "Arrow" not in plan
