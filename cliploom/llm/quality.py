"""Quality rules: a table of thresholds compiled into one projection of DataFrame functions.

Every measure is a Column over the row's own text, so a scan reads, measures and judges a document in one task; nothing is
shuffled and no Python runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = r"[\x20\x09-\x0D]+"
#: Signs that may stand around a word.
_MARKS = ".,;:!?\"'()[]{}*_-"
#: Words of a window that may not come again.
WINDOW = 5

# Common function words by language; a language without a list has no stop-word rule.
STOP_WORDS = {
    "de": ("der", "die", "das", "und", "in", "zu", "den", "von", "mit", "ist", "nicht", "ein", "eine", "des", "im", "auf"),
    "en": ("the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "it", "for", "was", "on", "as", "by"),
    "es": ("de", "la", "el", "que", "y", "en", "los", "se", "del", "las", "un", "por", "con", "una", "para", "no"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "qui", "dans", "pour", "par", "sur"),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for each row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _twin(rows: Column, name: str) -> Callable[[Column, Column], Column]:
    """Whether a struct of a sorted array has a neighbour with the same ``name``."""
    return lambda row, i: F.coalesce(F.get(rows, i - 1)[name] == row[name], F.lit(False)) | F.coalesce(
        F.get(rows, i + 1)[name] == row[name], F.lit(False)
    )


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Number of words that lie in a run of ``size`` words found twice or more in ``words``, the first run included.

    Hashes of the runs tell most texts clear at once; runs whose hash comes again are compared by their words."""
    runs = F.slice(F.transform(words, lambda _, i: F.xxhash64(F.slice(words, i + 1, size))), 1, F.size(words) - (size - 1))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda at, i: F.least(F.lit(size), F.coalesce(F.get(starts, i + 1) - at, F.lit(size))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    def exact(places: Column) -> Column:
        named = F.sort_array(F.transform(places, lambda p: F.struct(
            F.array_join(F.slice(words, p["at"] + 1, size), " ").alias("run"), p["at"].alias("at")
        )))
        return let(named, lambda rows: let(
            F.sort_array(F.transform(F.filter(rows, _twin(rows, "run")), lambda row: row["at"])), covered
        ))

    def among(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
        suspects = let(placed, lambda rows: let(F.filter(rows, _twin(rows, "hash")), exact))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), suspects).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) > size, let(runs, among)).otherwise(F.lit(0).cast("long"))


def measures(text: Column, lang: Column) -> Column:
    """Struct of everything the rules look at, of one whole text; null is the empty text.

    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_alpha_words, n_stop_words (null where the
    language has no list)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(_WORD))
    lists = F.create_map(*[
        part for name, listed in STOP_WORDS.items() for part in (F.lit(name), F.array(*[F.lit(w) for w in listed]))
    ])
    listed = F.try_element_at(lists, F.coalesce(lang, F.lit("")))

    def of_words(words: Column) -> list[Column]:
        letters = F.filter(words, lambda w: w.rlike(r"\p{L}"))
        bare = F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(_MARKS))))
        stop = let(listed, lambda known: F.when(known.isNotNull(), F.size(
            F.filter(bare, lambda w: F.array_contains(known, w)))))
        return [
            F.size(words).cast("long").alias("n_words"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(letters).cast("long").alias("n_alpha_words"),
            stop.cast("long").alias("n_stop_words"),
        ]

    by_word = let(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda words: F.struct(*of_words(words)))
    by_line = let(lines, lambda kept: F.struct(
        F.size(kept).cast("long").alias("n_lines"),
        (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
    ))
    return let(F.struct(by_word.alias("w"), by_line.alias("l")), lambda both: F.struct(
        both["w"]["n_words"].alias("n_words"),
        F.length(F.regexp_replace(text, _BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        both["l"]["n_lines"].alias("n_lines"),
        both["l"]["n_dup_lines"].alias("n_dup_lines"),
        both["w"]["n_repeat_words"].alias("n_repeat_words"),
        both["w"]["n_alpha_words"].alias("n_alpha_words"),
        both["w"]["n_stop_words"].alias("n_stop_words"),
    ))


@dataclass(frozen=True)
class Rule:
    """``share`` per cent of ``of`` that ``measure`` must reach or may not pass; whole-number arithmetic throughout.

    Without ``of`` the measure itself is held against the bounds. Texts with fewer than ``from_words`` words, and
    texts whose measure is null, are not judged by the rule."""

    name: str
    measure: str
    of: str | None = None
    at_least: int | None = None
    at_most: int | None = None
    from_words: int = 0

    def failed(self, m: Column) -> Column:
        value = m[self.measure] * (100 if self.of else 1)
        unit = m[self.of] if self.of else F.lit(1)
        fails = F.lit(False)
        if self.at_least is not None:
            fails = fails | (value < F.lit(self.at_least) * unit)
        if self.at_most is not None:
            fails = fails | (value > F.lit(self.at_most) * unit)
        return F.coalesce(fails & (m["n_words"] >= self.from_words), F.lit(False))


#: What every text must meet.
BASE = (
    Rule("too few words", "n_words", at_least=10),
    Rule("repeated runs", "n_repeat_words", "n_words", at_most=20),
)
#: The table of the method: ratios in per cent.
RULES = (
    Rule("word length", "word_chars", "n_words", at_least=200, at_most=1500),
    Rule("symbols", "n_symbols", "n_words", at_most=20),
    Rule("words without letters", "n_alpha_words", "n_words", at_least=60),
    Rule("stop words", "n_stop_words", "n_words", at_least=2, from_words=50),
    Rule("duplicate lines", "n_dup_lines", "n_lines", at_most=50),
)


def _failing(m: Column, rules: Sequence[Rule]) -> Column:
    """Names of the rules that the measures break, in the order of the table."""
    return F.array_compact(F.array(*[F.when(r.failed(m), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")


def verdicts(docs: DataFrame, base: Sequence[Rule] = BASE, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, the measures, base_failed, kept, and the names of the broken rules.

    Null, empty and blank texts have no words and fail the base; a null or unknown language has no stop-word rule; ids
    are never looked at, so repeated rows and null ids get a row each; no rows give no rows. Extra columns are ignored."""
    told = docs.select("doc_id", measures(F.col("text"), F.col("lang")).alias("m"))
    judged = told.select("doc_id", let(F.col("m"), lambda m: F.struct(
        m.alias("m"), _failing(m, base).alias("base"), _failing(m, rules).alias("more")
    )).alias("j"))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_alpha_words", "n_stop_words"]
    return judged.select(
        "doc_id", *[F.col(f"j.m.{n}").alias(n) for n in names], (F.size("j.base") > 0).alias("base_failed"),
        (F.size("j.base") + F.size("j.more") == 0).alias("kept"), F.concat("j.base", "j.more").alias("broken"),
    )


def keep_good(docs: DataFrame, base: Sequence[Rule] = BASE, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that break no rule, columns and texts as they are."""
    fine = let(measures(F.col("text"), F.col("lang")), lambda m: F.size(_failing(m, (*base, *rules))) == 0)
    return docs.filter(fine)
