"""The pipeline's stages against plain versions, each on what its predecessor kept."""

import random
import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cliploom.llm import language, pieces
from tests.llm.frames import SF, awkward, components, empty, shingles
from tests.llm.test_operators import WORD, plain_mix, rows


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after every stage over the smallest documents and the awkward ones."""
    folder = tmp_path_factory.mktemp("stages")
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    odd = awkward(spark).select(*plain.columns).selectExpr("doc_id + 100000 doc_id", "text", "lang", "source", "n_chars")
    plain.unionByName(odd).write.parquet(str(folder / "in"))
    docs, seen = spark.read.parquet(str(folder / "in")), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(number)))
        after = spark.read.parquet(str(folder / str(number)))
        seen.append((rows(docs), rows(after), after.columns))
        docs = after
    return seen


def key(r):
    return tuple(str(v) for v in r.values())


def test_stages_keep_the_columns(stages):
    for _, _, columns in stages[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_keeps_clean_documents(spark, stages):
    before, after, _ = stages[0]
    model = language.train(spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in before], "doc_id long, text string, lang string"))
    want = []
    for r in before:
        said = language.label_texts([r["text"] or ""], model)[0]
        if said[0] != "und" and said[2] >= 0.5:
            want.append(r)
    assert sorted(map(key, after)) == sorted(map(key, want))
    assert {r["doc_id"] for r in before if r["doc_id"] < 100000} <= {r["doc_id"] for r in after}


def test_language_stage_drops_unlearned_scripts_and_random_letters(spark):
    rng = random.Random(8)
    letters = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n))
    plain = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = [
        "αυτό είναι ένα ελληνικό κείμενο", "זה טקסט בעברית", "这是一个中文文本", "Spark是一个用于大规模数据处理的统一分析引擎", letters(40), letters(400),
        "Hyvää huomenta kaikille, tänään sataa lunta ja tiet ovat hyvin liukkaita, joten ajakaa varovasti kotiin",
    ]
    added = spark.createDataFrame([(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(odd)], plain.schema)
    docs = plain.unionByName(added)
    kept = {r["doc_id"] for r in language.known_language(docs).select("doc_id").collect()}
    assert not [odd[i - 10**6] for i in kept if i >= 10**6]
    assert len(kept) == plain.count()
    said = {r["doc_id"]: r for r in rows(language.identify(added, language.train(plain), ["doc_id"]))}
    assert said[10**6]["lang_pred"] == "de" and said[10**6]["share"] == 0


def test_line_stage(stages):
    before, after, _ = stages[1]
    strip = lambda line: line.strip("\x20\t\n\x0b\x0c\r")
    pages, hits = Counter(r["source"] for r in before), Counter()
    for r in before:
        hits.update((r["source"], s) for s in {strip(x) for x in (r["text"] or "").split("\n")} if s)
    bad = {k for k, n in hits.items() if n >= 3 and n > 0.1 * pages[k[0]]}
    want = []
    for r in before:
        lines = None if r["text"] is None else r["text"].split("\n")
        kept = lines and [x for x in lines if (r["source"], strip(x)) not in bad]
        text = r["text"] if lines is None or len(kept) == len(lines) else "\n".join(kept)
        want.append({**r, "text": text, "n_chars": r["n_chars"] if text == r["text"] else len(text)})
    assert sorted(map(key, after)) == sorted(map(key, want))
    assert any(a["text"] != b["text"] for a, b in zip(sorted(before, key=key), sorted(after, key=key)))


def test_near_stage(stages):
    before, after, _ = stages[2]
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in before}
    part = components(sets, lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    want = {r["doc_id"]: key(r) for r in before if part[r["doc_id"]] == r["doc_id"]}
    assert sorted(key(r) for r in after) == sorted(want.values())
    assert len(after) < len(before)


def test_mix_stage(stages):
    before, after, _ = stages[3]
    total, target = plain_mix(before)
    words = defaultdict(int)
    for r in after:
        words[r["source"]] += len(WORD.findall(r["text"]))
    assert all(abs(words[s] - t) <= 1 for s, t in target.items())
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(texts[r["doc_id"]].startswith(r["text"]) for r in after)
    assert sum(r["text"] != texts[r["doc_id"]] for r in after) <= len(total)
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2


def test_piece_stage(stages):
    import sentencepiece

    before, after, columns = stages[4]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert len(before) == len(after) and set(columns) >= {"doc_id", "ids", "n_ids", "round_trip"}
    for r in after:
        assert r["ids"] == library.encode(r["text"], num_threads=1) and r["round_trip"] and r["n_ids"] == len(r["ids"])


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF)
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    assert got.columns[:5] == docs.columns and got.count() > 0


def test_empty_documents(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0


def test_names_of_queries():
    names = [q for q in entry.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
