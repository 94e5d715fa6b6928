"""Language identification: scripts narrow the candidates, Viterbi with a switching penalty labels spans of words."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.llm.words import mixed

#: A task adds up the grams of its words when it holds so many different ones, all languages together.
HELD_WORDS = 200_000
#: Grams are made for words of about so many characters at a time: some 200 bytes a character while they are.
GRAM_CHARS = 1 << 16
#: Evidence is told apart to so many decimals when its percentiles are taken, so that a language is at most some ten thousand values.
EVIDENCE_DECIMALS = 3
BUCKETS_LOG2 = 15
GRAMS = (1, 2, 3, 4)
SMOOTHING = 0.5
#: A word speaks at most so strongly against a language, and changing language between words costs so much (nats).
FLOOR = 4.0
SWITCH = 8.0
#: A script belongs to a language that writes at least this share of its letters in it.
SCRIPT_SHARE = 0.01
SLICE_CHARS = 4_000_000
UNKNOWN = "und"
#: A text is foreign to its language if its evidence lies this many times as far under the median of the language's labelled
#: documents as their lowest hundredth does (at least LEAST_SPREAD nats a gram); a text of n words may fall NOISE / sqrt(n) lower.
SPREADS = 3.0
LEAST_SPREAD = 0.5
NOISE = 3.0

# First code points of the blocks that tell scripts apart (Unicode).
_SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"),
    (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF5B, "other"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x30000, "other"),
)
SCRIPTS = tuple(sorted({name for _, name in _SCRIPT_STARTS}))
_WORD = re.compile(r"\S+")


@functools.cache
def _letter_table() -> np.ndarray:
    """Script number plus one of every letter below the last block, 0 for what is no letter."""
    starts = np.array([s for s, _ in _SCRIPT_STARTS])
    number = np.array([SCRIPTS.index(n) + 1 for _, n in _SCRIPT_STARTS], np.uint8)
    points = np.arange(0x110000)
    letters = np.fromiter((chr(p).isalpha() for p in points), bool, len(points))
    return np.where(letters, number[np.searchsorted(starts, points, "right") - 1], 0).astype(np.uint8)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the character grams of all words, the word of each, letters per word, main script per word.

    A word is lowered by the caller, its non-letters become blanks, and a blank stands before and behind it."""
    table = _letter_table()
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    script = table[points]
    owner = np.concatenate(([0], np.repeat(np.arange(len(words)), lengths)))
    letters = np.bincount(owner, script > 0, len(words)).astype(np.int64)
    last = np.zeros(len(words), np.uint8)
    marked = np.flatnonzero(script)[::-1]
    last[owner[marked]] = script[marked]  # the first letter's script
    codes = np.where(script > 0, points, 32).astype(np.uint64)
    ends = np.cumsum(lengths)  # the blank behind each word
    start = np.concatenate(([0], ends[:-1]))
    buckets, owners = [], []
    position = np.arange(len(codes))
    word_of_start = np.minimum(np.searchsorted(ends, position, "right"), len(words) - 1)
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            valid = len(codes) - n + 1
            h = mixed(h[:valid] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 : n - 1 + valid] + np.uint64(n))
            if n not in GRAMS:
                continue
            own = word_of_start[:valid]
            inside = (position[:valid] >= start[own]) & (position[:valid] + n - 1 <= ends[own])
            inside &= (script[:valid] > 0) if n == 1 else True
            buckets.append((h[inside] >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64))
            owners.append(own[inside])
    return np.concatenate(buckets), np.concatenate(owners), letters, last


def _parts(words: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of words with about ``GRAM_CHARS`` characters; a longer word ends its run."""
    if words:
        run = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) // GRAM_CHARS
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(words)]
        yield from zip(edges, edges[1:])


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``SLICE_CHARS`` characters, so that a batch is never whole in Python's strings."""
    if len(texts):
        run = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_CHARS
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
        yield from zip(edges, edges[1:])


@dataclass(frozen=True)
class LanguageModel:
    """Learned languages in sorted order, log chances of gram buckets, and the scripts of each language."""

    languages: tuple[str, ...]
    table: np.ndarray  # buckets x languages, float32
    scripts: np.ndarray  # script number x languages, bool

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each language for each word (0 for the best, at least -FLOOR), and letters per word.

        Languages that do not write the word's script get -FLOOR; words without letters, or in a script that no
        language writes, favour none."""
        return self._judged(words)[:2]

    def _judged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``emissions``, and the log chance of each word's grams in each language and their number (0 in an unlearned script)."""
        score = np.empty((len(words), len(self.languages)))
        letters, script, grams = np.empty(len(words), np.int64), np.empty(len(words), np.uint8), np.empty(len(words), np.int64)
        for a, b in _parts(words):
            buckets, owner, letters[a:b], script[a:b] = _grams(words[a:b])
            for k in range(len(self.languages)):
                score[a:b, k] = np.bincount(owner, self.table[buckets, k], b - a)
            grams[a:b] = np.bincount(owner, minlength=b - a)
        allowed = self.scripts[script]
        chance, grams = score.copy(), grams * allowed.any(1)
        score[~allowed] = -np.inf
        open_words = (letters == 0) | ~allowed.any(1)
        score[open_words] = 0.0
        score -= score.max(1, keepdims=True)
        return np.maximum(score, -FLOOR), letters, chance, grams

    def known_letters(self, words: list[str]) -> np.ndarray:
        """Letters of each word in scripts that some learned language writes."""
        known, out = self.scripts.any(1), np.empty(len(words))
        for a, b in _parts(words):
            points = np.frombuffer("".join(words[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32)
            owner = np.repeat(np.arange(b - a), np.fromiter(map(len, words[a:b]), np.int64, b - a))
            out[a:b] = np.bincount(owner, known[_letter_table()[points]], b - a)
        return out


def sampled(docs: DataFrame, bound: int | None = None) -> DataFrame:
    """Labelled documents: all, or about ``bound`` of each language at most, the same on every run."""
    if bound is None:
        return docs
    counts = docs.groupBy("lang").agg(F.count("*").alias("_n"))  # one row per language
    dice = F.xxhash64("doc_id", F.lit("train")).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return docs.join(F.broadcast(counts), "lang").filter(dice < F.lit(float(bound)) / F.col("_n"))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of gram buckets and of letters by script for each language (lang, cell, n) over a task's texts (lang, text)."""
    totals: dict[str, np.ndarray] = {}
    held: dict[str, Counter] = {}

    def add_held() -> None:
        while held:
            lang, seen = held.popitem()
            words, times = list(seen), np.fromiter(seen.values(), np.float64, len(seen))
            for a, b in _parts(words):
                buckets, owner, letters, script = _grams(words[a:b])
                sums = totals.setdefault(lang, np.zeros((1 << BUCKETS_LOG2) + len(SCRIPTS) + 1))
                sums[: 1 << BUCKETS_LOG2] += np.bincount(buckets, times[a:b][owner], 1 << BUCKETS_LOG2)
                sums[1 << BUCKETS_LOG2 :] += np.bincount(script, times[a:b] * letters, len(SCRIPTS) + 1)

    different = 0
    for batch in batches:
        for a, b in _slices(batch.column("text")):
            part = batch.slice(a, b - a)
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                seen = held.setdefault(lang, Counter())
                different -= len(seen)
                seen.update(text.lower().split())
                different += len(seen)
                if different >= HELD_WORDS:
                    add_held()
                    different = 0
    add_held()
    for lang, sums in totals.items():
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(sums[at])], ["lang", "cell", "n"])


def train(docs: DataFrame, bound: int | None = None) -> LanguageModel:
    """Learn from all of (doc_id, text, lang), or ``bound`` documents of each language; rows without text or language teach nothing.

    Executors count gram buckets; the driver gets one row per language and bucket (at most languages x 32 768)."""

    labelled = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    cells = sampled(labelled, bound).select("lang", "text").mapInArrow(_cells, "lang string, cell long, n double")
    rows = cells.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(rows["lang"].unique()))
    sums = np.zeros(((1 << BUCKETS_LOG2) + len(SCRIPTS) + 1, len(languages)))
    if languages:
        sums[rows["cell"], rows["lang"].map(languages.index)] = rows["n"]
    grams, letters = sums[: 1 << BUCKETS_LOG2] + SMOOTHING, sums[1 << BUCKETS_LOG2 :]
    return LanguageModel(
        languages, np.log(grams / grams.sum(0)).astype(np.float32) if languages else grams.astype(np.float32),
        letters > SCRIPT_SHARE * np.maximum(letters.sum(0), 1),
    )


def viterbi(emission: np.ndarray, word: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word of many documents at once.

    ``word`` numbers the rows of ``emission`` in text order, ``offsets`` delimit documents. Documents step together,
    longest first; a step keeps the label or pays ``switch`` for the best other one. Ties keep the label, then take
    the first language."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    begin, length = offsets[:-1][order], lengths[order]
    total, kinds = int(offsets[-1]), emission.shape[1]
    stays = np.ones((total, kinds), bool)
    best_before = np.zeros(total, np.int16)
    state = np.zeros((len(order), kinds))
    final = np.zeros(len(order), np.int64)
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(1, steps + 1), "right")
    for t in range(steps):
        k = active[t]
        at = begin[:k] + t
        if t:
            now = state[:k]
            top = now.argmax(1)
            moved = now[np.arange(k), top] - switch
            keep = now >= moved[:, None]
            stays[at], best_before[at] = keep, top
            state[:k] = np.where(keep, now, moved[:, None]) + emission[word[at]]
        else:
            state[:k] = emission[word[at]]
        done = active[t + 1] if t + 1 < steps else 0
        final[done:k] = state[done:k].argmax(1)
    label = np.zeros(total, np.int16)
    current = final.copy()
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        label[at] = current[:k]
        current[:k] = np.where(stays[at, current[:k]], current[:k], best_before[at])
    return label


def label_texts(texts: list[str], model: LanguageModel) -> list[tuple[str, float, float, list[tuple[int, int, str]]]]:
    """For each text: language, score, share of letters in its spans, spans (start, end, language) in code points.

    Letters in a script that no learned language writes are nobody's share."""
    return [r[:4] for r in judged_texts(texts, model)]


def judged_texts(texts: list[str], model: LanguageModel) -> list[tuple[str, float, float, list[tuple[int, int, str]], float, int]]:
    """As ``label_texts``, with the evidence and the number of words it rests on.

    Evidence is the mean log chance of the text's grams, each word in the language it is labelled with: unlike the score,
    which compares the languages, it is low for what none of them would write. Nothing to judge by is 0 words."""
    codes: dict[str, int] = {}
    numbers = [np.fromiter((codes.setdefault(w, len(codes)) for w in t.lower().split()), np.int64) for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(doc) for doc in numbers]))).astype(np.int64)
    word = np.concatenate([*numbers, np.empty(0, np.int64)])
    kinds = len(model.languages)
    if not codes or not kinds:
        return [(UNKNOWN, 0.0, 0.0, [], 0.0, 0) for _ in texts]
    emission, letters, told, grams = model._judged(list(codes))
    label = viterbi(emission, word, offsets)
    known = model.known_letters(list(codes))[word]
    weight = letters[word].astype(float)
    chance = np.exp(emission)
    chance /= chance.sum(1, keepdims=True)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    votes = np.bincount(owner * kinds + label, weight, len(texts) * kinds).reshape(-1, kinds)
    sure = np.stack([np.bincount(owner, weight * chance[word, k], len(texts)) for k in range(kinds)], 1)
    total = votes.sum(1)
    held = np.bincount(owner * kinds + label, known, len(texts) * kinds).reshape(-1, kinds)
    judged = grams[word] > 0
    n_words = np.bincount(owner, judged, len(texts)).astype(int)
    evidence = np.bincount(owner, told[word, label] * judged, len(texts)) / np.maximum(np.bincount(owner, grams[word], len(texts)), 1)
    out = []
    for i, text in enumerate(texts):
        if not total[i]:
            out.append((UNKNOWN, 0.0, 0.0, [], 0.0, 0))
            continue
        best = int(votes[i].argmax())
        own = label[offsets[i] : offsets[i + 1]]
        turns = np.flatnonzero(np.diff(own)) + 1
        spans = [(0, len(text), model.languages[own[0]])]
        if len(turns):
            starts = [m.start() for m in _WORD.finditer(text)]
            cuts = [0, *(starts[k] for k in turns), len(text)]
            spans = [(cuts[k], cuts[k + 1], model.languages[own[p]]) for k, p in enumerate([0, *turns])]
        out.append((
            model.languages[best], min(1.0, float(sure[i, best] / total[i])), float(held[i, best] / total[i]), spans,
            float(evidence[i]), int(n_words[i]),
        ))
    return out


_SCHEMA = "lang_pred string, score double, share double, spans array<struct<start: int, end: int, lang: string>>"


def identify(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred, score, share and spans of ``text``.

    Null text, or text without a letter, is ``und`` with score 0; a text in a script that no learned language writes
    goes to the first language with a low score and share 0; with nothing learned all are ``und``. Whole texts, one pass, no shuffle;
    a batch is worked through in slices of bounded length, a single long text being a slice of its own."""
    handle = docs.sparkSession.sparkContext.broadcast(model)  # languages x 32 768 numbers
    names = [n for n in keep if n != "text"]
    whole = [n for n in names if docs.schema[n].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")]
    fields = ", ".join(f"`{n}` {'string' if n in whole else docs.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = np.cumsum([len(t or "") for t in batch["text"]]) // SLICE_CHARS
            for _, part in batch.groupby(size, sort=False):
                labelled = label_texts([t or "" for t in part["text"]], handle.value)
                out = part[names].reset_index(drop=True)
                out["lang_pred"], out["score"], out["share"] = ([r[k] for r in labelled] for k in range(3))
                out["spans"] = [[{"start": s, "end": e, "lang": lang} for s, e, lang in r[3]] for r in labelled]
                yield out

    made = docs.withColumns({n: F.col(n).cast("string") for n in whole}).select(*names, "text").mapInPandas(run, f"{fields}, {_SCHEMA}")
    return made.withColumns({n: F.col(n).cast(docs.schema[n].dataType) for n in whole})


def held_out(doc_id: Column) -> Column:
    """Every fourth document by a checksum of its id; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def predict(docs: DataFrame, bound: int | None = None) -> DataFrame:
    """Learn from the documents that are not held out and predict all: doc_id, held_out, lang_pred, score, share, spans."""
    model = train(docs.filter(~held_out(F.col("doc_id"))), bound)
    labelled = identify(docs.select("doc_id", "text"), model, ["doc_id"])
    return labelled.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "share", "spans")


def evidence_limits(docs: DataFrame, model: LanguageModel, bound: int | None = None) -> dict[str, float]:
    """Least evidence of a long text in each language, from the labelled documents that ``train`` learns from.

    The driver gets one row per language."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in _slices(texts):
                found = [(r[0], r[4]) for r in judged_texts(texts.slice(a, b - a).to_pylist(), handle.value) if r[5]]
                columns = [pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "evidence"])

    labelled = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    found = sampled(labelled, bound).select("text").mapInArrow(weigh, "lang string, evidence double")
    told = found.withColumn("evidence", F.round("evidence", EVIDENCE_DECIMALS))
    levels = told.groupBy("lang").agg(F.percentile("evidence", [0.01, 0.5]).alias("at")).collect()
    return {r["lang"]: r["at"][1] - SPREADS * max(r["at"][1] - r["at"][0], LEAST_SPREAD) for r in levels}


def is_known(verdict: tuple, limits: dict[str, float], least_share: float = 0.5) -> bool:
    """Whether a row of ``judged_texts`` is mostly in its language and reads like it."""
    lang, _, share, _, evidence, n_words = verdict
    if lang == UNKNOWN or share < least_share:
        return False
    return n_words > 0 and evidence >= limits.get(lang, -np.inf) - NOISE / n_words**0.5


def known_language(docs: DataFrame, least_share: float = 0.5) -> DataFrame:
    """Rows of ``docs`` with a text mostly in one learned language: not ``und``, ``least_share`` of its letters or more, and
    evidence no lower than the labelled documents show (``evidence_limits``).

    Letters in a script that no learned language writes count for none. Columns stay as they are; the verdict rides along
    in the same pass, so texts are not shuffled. Without any labelled row there is nothing to judge by and only texts
    without letters go."""
    model = train(docs)
    handle = docs.sparkSession.sparkContext.broadcast(model)
    limits = evidence_limits(docs, model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            for a, b in _slices(batch):
                texts = [t or "" for t in batch.slice(a, b - a).to_pylist()]
                if model_has := bool(handle.value.languages):
                    verdicts = [is_known(r, limits, least_share) for r in judged_texts(texts, handle.value)]
                parts += verdicts if model_has else [any(c.isalpha() for c in t) for t in texts]
            yield pa.array(parts, pa.bool_())

    from pyspark.sql.types import BooleanType

    return docs.filter(F.arrow_udf(run, BooleanType())("text"))
