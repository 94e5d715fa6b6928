"""Documents with every awkward case, and plain Python versions of what the operators should say."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int, rep int, key string, text_a string"
SF = "/root/testdata/sf0.001"


def awkward(spark, copies=6):
    """Nulls in each column, empty, blank and long texts, repeated rows, copies, near copies, clashing column names."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 7))) for _ in range(400)]
    words = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = words(120)
    texts = [None, "", "  \t\n ", "one", "One  tWo", "one two three four", base, base.upper(), base + " tail", words(60000)]
    texts += [base] * copies
    for _ in range(copies):
        near = base.split()
        near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += [words(rng.randint(1, 200)) for _ in range(25)]
    rows = []
    for i, text in enumerate(texts):
        lang = [None, "aa", "bb"][i % 3]
        rows.append((i * 3 + 1, text, lang, [None, "s1", "s2", ""][i % 4], None if text is None else len(text), i, i, "k", "t"))
    rows += rows[5:7]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    take = min(size, len(words))
    return frozenset(tuple(words[i : i + take]) for i in range(len(words) - take + 1))


def components(nodes, linked):
    """Least reachable node of each, by comparing all pairs."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and root(a) != root(b) and linked(a, b):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {n: root(n) for n in nodes}
