"""Phrase collocations by relational mining of occurrences.

``R1`` holds the occurrences of frequent words, sorted by piece and position, as a table of slices. A step merge-joins the
occurrences of frequent k-word phrases with those that start one position later in the same piece, persists the joined
relation ``R(k+1)``, counts its phrases in Spark, and lets only frequent ones take part in the next step."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliploom.llm.storage import measured, stored
from cliploom.llm.words import mixed

_WORD, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass(frozen=True)
class Mining:
    """Least count and greatest length of a phrase, and how many of a language are returned."""

    least: int = 100
    longest: int = 5
    top: int = 2000
    #: Words of a slice of the relation; each carries the next words too, so phrases across its end are seen. Slices are short, as
    #: Spark's readers hold thousands of rows at once.
    slice_words: int = 1 << 7
    #: Bytes of text that are taken apart at once, and occurrences that are counted at once.
    block_bytes: int = 1 << 19
    block_rows: int = 1 << 18
    #: Bits of the filter that tasks hold of the frequent phrases: its size never grows, and a false hit is counted
    #: and then found infrequent, so it costs time only.
    filter_bits: int = 1 << 26
    #: Cells of each of two tables that occurrences are counted in before their phrases are: a phrase is infrequent if one of its
    #: cells stays under ``least``. Also of fixed size; two phrases in one cell cost time only.
    cells: int = 1 << 22


class Hashing:
    """Two polynomial hashes of byte strings modulo 2**64 with bases drawn from a seed."""

    def __init__(self, seed: int):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.bases = [int(v) | 1 for v in draw.integers(1 << 40, 1 << 63, 2, np.uint64)]
        self.powers = [np.ones(1, np.uint64)] * 2
        self.inverses = [np.ones(1, np.uint64)] * 2

    def _grow(self, n: int) -> None:
        if len(self.powers[0]) >= n:
            return
        size = 1 << int(n).bit_length()
        for k, base in enumerate(self.bases):
            for store, step in ((self.powers, base), (self.inverses, pow(base, -1, 1 << 64))):
                steps = np.full(size, step, np.uint64)
                steps[0] = 1
                with np.errstate(over="ignore"):
                    store[k] = np.multiply.accumulate(steps)

    def words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of ``raw[start:end]`` for each word."""
        self._grow(len(raw) + 1)
        out = []
        values = raw.astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            for powers, inverses in zip(self.powers, self.inverses):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers[: len(raw)])))
                out.append(mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64)))
        return out[0], out[1]


@dataclass
class Occurrences:
    """Words of a batch in order: language number, place (steps of one inside a piece, of more between pieces), hashes,
    and where their bytes lie in ``raw``."""

    lang: np.ndarray
    place: np.ndarray
    name: np.ndarray
    check: np.ndarray
    start: np.ndarray
    end: np.ndarray


def occurrences(raw: np.ndarray, offsets: np.ndarray, langs: np.ndarray, hashing: Hashing, block: int) -> Occurrences:
    """All words of the texts ``raw[offsets[i]:offsets[i + 1]]``, taken apart in blocks that end between words."""
    parts: list[Occurrences] = []
    at, words, breaks, size = 0, 0, 0, len(raw)
    opened = np.unique(offsets[:-1])
    opened = opened[opened < size]
    while at < size:
        stop = min(size, at + block)
        while stop < size and _KIND[raw[stop]] == _WORD and _KIND[raw[stop - 1]] == _WORD:
            rest = np.flatnonzero(_KIND[raw[stop : stop + block]] != _WORD)
            stop = stop + int(rest[0]) if len(rest) else min(size, stop + block)
        piece = raw[at:stop]
        kind = _KIND[piece]
        inside = kind == _WORD
        edge = np.zeros(len(piece) + 1, bool)  # a text begins here, so a word before it ends
        edge[opened[(opened >= at) & (opened < stop)] - at] = True
        begins = inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1])
        ends = np.concatenate((inside[:-1] & (~inside[1:] | edge[1:-1]), inside[-1:]))
        starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        turns = np.cumsum((kind == _BREAK) | edge[:-1])
        name, check = hashing.words(piece, starts, ends)
        text = np.searchsorted(offsets, starts + at, "right") - 1
        parts.append(Occurrences(
            langs[text], words + np.arange(len(starts)) + breaks + turns[starts], name, check, starts + at, ends + at
        ))
        at, words, breaks = stop, words + len(starts), breaks + (int(turns[-1]) if len(turns) else 0)
    join = lambda f, kind: np.concatenate([getattr(p, f) for p in parts] or [np.empty(0, kind)])
    return Occurrences(
        join("lang", np.int64), join("place", np.int64), join("name", np.uint64), join("check", np.uint64),
        join("start", np.int64), join("end", np.int64),
    )


def _taken_apart(batch: pa.RecordBatch, hashing: Hashing, how: Mining) -> Iterator[tuple[list[str], np.ndarray, Occurrences]]:
    """Languages, lowered bytes and occurrences of a batch of (lang, text), some texts at a time: whole texts, up to
    ``block_bytes`` of them unless one alone is longer."""
    text, lang = batch.column(1), batch.column(0).dictionary_encode()
    text = text.cast(pa.large_string())
    _, place, data = text.buffers()
    offsets = np.frombuffer(place, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    codes, at = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + how.block_bytes, "right")) - 1)
        lowered = _LOWER[raw[offsets[at] : offsets[to]]]
        found = occurrences(lowered, offsets[at : to + 1] - offsets[at], codes[at:to], hashing, how.block_bytes)
        yield lang.dictionary.to_pylist(), lowered, found
        at = to
    pa.default_memory_pool().release_unused()  # workers live on beside the JVM


def _grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers that stand for the distinct rows, and how often each row comes.

    Rows are sorted by a hash of their columns and compared column by column with the row before; a clash of hashes can
    only split a group, and the parts add up later."""
    count = len(columns[0])
    if not count:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(_tuple_names(columns))
    fresh = np.zeros(count, bool)
    fresh[0] = True
    for column in columns:
        ordered = column[order]
        fresh[1:] |= ordered[1:] != ordered[:-1]
    first = np.flatnonzero(fresh)
    return order[first], np.diff(np.append(first, count))


def _tuple_names(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for column in columns:
            out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + column.astype(np.uint64))
    return out


def _lang_names(langs: list[str]) -> np.ndarray:
    """A number for each language that is the same in every task."""
    import hashlib

    return np.array([int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") for v in langs] or [0], np.uint64)


def word_counts(texts: DataFrame, how: Mining, seed: int) -> DataFrame:
    """(lang, name, word, n): every word of each language with its hash and number of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = Hashing(seed)
        for langs, raw, found in (part for batch in batches for part in _taken_apart(batch, hashing, how)):
            rows, counts = _grouped([found.lang.astype(np.uint64), found.name, found.check])
            whole = raw.tobytes()
            words = [whole[a:b].decode("utf-8", "replace") for a, b in zip(found.start[rows].tolist(), found.end[rows].tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array([langs[k] for k in found.lang[rows].tolist()], pa.string()), pa.array(found.name[rows].view(np.int64)),
                pa.array(words, pa.string()), pa.array(counts.astype(np.int64)),
            ], names=["lang", "name", "word", "n"])

    parts = texts.mapInArrow(run, "lang string, name bigint, word string, n bigint")
    return parts.groupBy("lang", "name", "word").agg(F.sum("n").alias("n"))


class Filter:
    """Which tuples of words are frequent, as two bits each in a table of fixed size."""

    @staticmethod
    def probes(lang: np.ndarray, words: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
        name = _tuple_names([lang, *words])
        return name % np.uint64(bits), mixed(name) % np.uint64(bits)

    @staticmethod
    def of(frequent: DataFrame, size: int, bits: int):
        """A broadcast table of the probes of ``frequent`` (lang, ws); at most ``bits`` / 64 numbers reach the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs = batch.column(0).dictionary_encode()
                lang = _lang_names(langs.dictionary.to_pylist())[langs.indices.to_numpy(zero_copy_only=False)] if len(batch) else np.empty(0, np.uint64)
                words = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, size)
                spots = np.concatenate(Filter.probes(lang, list(words.T), bits))
                yield pa.RecordBatch.from_arrays([
                    pa.array((spots >> np.uint64(6)).astype(np.int64)),
                    pa.array((np.uint64(1) << (spots & np.uint64(63))).view(np.int64)),
                ], names=["at", "bit"])

        cells = frequent.select("lang", "ws").mapInArrow(run, "at bigint, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("bit"))
        got = cells.toArrow()
        table = np.zeros(bits // 64, np.int64)
        table[got.column("at").to_numpy()] = got.column("bit").to_numpy()
        return frequent.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    @staticmethod
    def hits(table: np.ndarray, lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        hit = np.ones(len(lang), bool)
        for spot in Filter.probes(lang, words, len(table) * 64):
            hit &= (table[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) != 0
        return hit


_SLICE = "lang string, w array<bigint>, follows array<boolean>, starts array<boolean>, own int"


def _slice_batch(langs: pa.Array, edges: np.ndarray, w: np.ndarray, place: np.ndarray, starts: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    """Rows of the relation: slice ``i`` holds the words from ``edges[i]`` to ``edges[i + 1]``."""
    several = lambda values: pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))
    follows = np.diff(place, prepend=place[:1]) == 1  # all that matters of the places: which words stand next to each other
    follows[edges[:-1]] = False
    return pa.RecordBatch.from_arrays(
        [langs, several(w.view(np.int64)), several(follows), several(starts), pa.array(own.astype(np.int32))],
        names=["lang", "w", "follows", "starts", "own"],
    )


def _next_to(place: np.ndarray) -> np.ndarray:
    """Whether the following occurrence is the next word of the same piece."""
    return np.append(np.diff(place) == 1, False) if len(place) else np.empty(0, bool)


def _pruned(w, place, starts, size: int):
    """Occurrences that lie in a run of ``size`` words whose start is marked."""
    cover = starts.copy()
    for k in range(1, size):
        cover[k:] |= starts[: len(starts) - k]
    return w[cover], place[cover], starts[cover], cover


def first_relation(texts: DataFrame, frequent, how: Mining, seed: int) -> DataFrame:
    """``R2`` before its count: occurrences of frequent words that have a frequent word next to them, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing, table = Hashing(seed), frequent.value
        for langs, _, found in (part for batch in batches for part in _taken_apart(batch, hashing, how)):
            alive = Filter.hits(table, _lang_names(langs)[found.lang], [found.name])
            lang, place, name = found.lang[alive], found.place[alive], found.name[alive]
            order = np.argsort(lang, kind="stable")
            lang, place, name = lang[order], place[order], name[order]
            edges = np.searchsorted(lang, np.arange(len(langs) + 1))
            for k, label in enumerate(langs):
                w, p = name[edges[k] : edges[k + 1]], place[edges[k] : edges[k + 1]]
                w, p, starts, _ = _pruned(w, p, _next_to(p), 2)
                if len(w):
                    at = np.arange(0, len(w), how.slice_words)
                    to = np.minimum(len(w), at + how.slice_words)
                    ends = np.cumsum(np.minimum(len(w), to + how.longest - 1) - at)
                    lengths = np.diff(ends, prepend=0)
                    pick = np.arange(ends[-1]) + np.repeat(at - ends + lengths, lengths)
                    yield _slice_batch(pa.array([label] * len(at), pa.string()), np.append(0, ends), w[pick], p[pick], starts[pick], to - at)

    return texts.mapInArrow(run, _SLICE)


@dataclass
class _Block:
    """Consecutive slices as arrays: of each word the language's number, place (no slice begins next to the one before), mark,
    whether it is the slice's own, and where its slice ends; ``langs``, ``edges`` and ``own`` are of the slices."""

    langs: pa.Array
    edges: np.ndarray
    own: np.ndarray
    lang: np.ndarray
    w: np.ndarray
    place: np.ndarray
    starts: np.ndarray
    mine: np.ndarray
    end: np.ndarray


def _blocks(batch: pa.RecordBatch, words: int) -> Iterator[_Block]:
    """Rows of the relation, as many at a time as hold ``words`` words, at least one."""
    langs, own = batch.column(0), batch.column(4).to_numpy(zero_copy_only=False)
    coded = langs.dictionary_encode()
    names = _lang_names(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)] if len(batch) else []
    offsets, at = [batch.column(c).offsets.to_numpy(zero_copy_only=False) for c in (1, 2, 3)], 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offsets[0], offsets[0][at] + words, "right")) - 1)
        w, follows, starts = (
            batch.column(c).values.slice(o[at], o[to] - o[at]).to_numpy(zero_copy_only=False) for c, o in zip((1, 2, 3), offsets)
        )
        edges = (offsets[0][at : to + 1] - offsets[0][at]).astype(np.int64)
        lengths = np.diff(edges)
        yield _Block(
            langs.slice(at, to - at), edges, own[at:to], np.repeat(names[at:to], lengths), w.view(np.uint64),
            np.cumsum(np.where(follows.astype(bool), 1, 2)), starts.astype(bool),
            np.arange(len(w)) < np.repeat(edges[:-1] + own[at:to], lengths), np.repeat(edges[1:], lengths),
        )
        at = to
    pa.default_memory_pool().release_unused()


def next_relation(relation: DataFrame, frequent, size: int, how: Mining = Mining()) -> DataFrame:
    """Merge-join of the occurrences of frequent phrases of ``size`` words with those one position later: ``R(size + 1)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        for block in (b for batch in batches for b in _blocks(batch, how.block_rows)):
            found = np.flatnonzero(block.starts)
            found = found[found + size <= block.end[found]]
            alive = np.zeros(len(block.w), bool)
            alive[found[Filter.hits(table, block.lang[found], [block.w[found + k] for k in range(size)])]] = True
            joined = alive & _next_to(block.place) & np.append(alive[1:], False)
            marks = np.append(0, np.cumsum(joined & block.mine))
            used = marks[block.edges[1:]] > marks[block.edges[:-1]]
            if used.any():
                joined &= np.repeat(used, np.diff(block.edges))
                w, place, starts, cover = _pruned(block.w, block.place, joined, size + 1)
                kept = np.append(0, np.cumsum(cover))
                own = kept[block.edges[:-1] + block.own] - kept[block.edges[:-1]]
                edges = np.append(0, kept[block.edges[1:]][used])
                yield _slice_batch(block.langs.filter(pa.array(used)), edges, w, place, starts, own[used])

    return relation.mapInArrow(run, _SLICE)


_SEGMENT = 1 << 12


def _cells(columns: list[np.ndarray], cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Both cells of the phrases in ``columns`` (language number and words); the second lies in a half of its own."""
    name = _tuple_names(columns)
    first, second = (mixed(name ^ np.uint64(salt)) % np.uint64(cells) for salt in (0xA5A5A5A5A5A5A5A5, 0x5BD1E995C6A4A793))
    return first.astype(np.int64), second.astype(np.int64) + cells


def _marked(block: _Block, size: int) -> list[np.ndarray]:
    """Language number and words of the phrases of ``size`` words that the block's own words start."""
    found = np.flatnonzero(block.starts & block.mine)
    return [block.lang[found], *[block.w[found + k] for k in range(size)]]


def crowded_cells(relation: DataFrame, size: int, how: Mining):
    """A broadcast table of the cells, in two halves, that at least ``how.least`` marked occurrences fall into.

    A task counts into its own cells and hands on the segments it used; segments are added up in Spark, and one flag per
    cell reaches the driver."""
    kind = np.min_scalar_type(how.least)  # no count passes it

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, any_ = np.zeros(2 * how.cells, kind), False
        for block in (b for batch in batches for b in _blocks(batch, how.block_rows)):
            columns = _marked(block, size)
            if len(columns[0]):
                any_ = True
                for cell in _cells(columns, how.cells):
                    at, n = np.unique(cell, return_counts=True)
                    held[at] = np.minimum(held[at] + n, how.least)
        if any_:
            parts = held.reshape(-1, min(_SEGMENT, how.cells))
            used = np.flatnonzero(parts.any(1))
            for at in range(0, len(used), 64):
                some = used[at : at + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array([parts[k].tobytes() for k in some], pa.binary())], names=["segment", "counts"]
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        flags = lambda: pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int32()), pa.array([np.packbits(total >= how.least).tobytes()], pa.binary())], names=["segment", "crowded"])
        for batch in batches:
            for segment, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(counts.as_buffer(), kind).astype(np.int64)
                if segment == at:
                    total += part
                    continue
                if at is not None:
                    yield flags()
                at, total = segment, part
        if at is not None:
            yield flags()

    parts = relation.mapInArrow(count, "segment int, counts binary").repartition("segment").sortWithinPartitions("segment")
    table = np.zeros((2 * how.cells // min(_SEGMENT, how.cells), min(_SEGMENT, how.cells) // 8), np.uint8)
    for row in parts.mapInArrow(add, "segment int, crowded binary").toArrow().to_pylist():  # one row per segment: fixed
        table[row["segment"]] = np.frombuffer(row["crowded"], np.uint8)
    return relation.sparkSession.sparkContext.broadcast(table.reshape(-1))


class _Sums:
    """Counts of phrases, added up whenever ``block`` rows more are held than were left the last time."""

    def __init__(self, block: int):
        self.block, self.parts, self.rows, self.least = block, [], 0, 0

    def add(self, columns: list[np.ndarray], counts: np.ndarray) -> None:
        self.parts.append([*columns, counts])
        self.rows += len(counts)
        if self.rows >= self.least + self.block:
            self.parts = [self.get()]
            self.rows = self.least = len(self.parts[0][0])

    def get(self) -> list[np.ndarray]:
        """The distinct rows and the sums of their counts. Columns are put together one by one and their parts let go; a clash
        of hashes can only split a group."""
        parts, columns = self.parts, []
        for c in range(len(parts[0])):
            columns.append(np.concatenate([p[c] for p in parts]))
            for p in parts:
                p[c] = None
        self.parts = []
        order, fresh = np.argsort(_tuple_names(columns[:-1])), np.zeros(len(columns[0]), bool)
        fresh[:1] = True
        for c, column in enumerate(columns):
            columns[c] = column = column[order]
            if c < len(columns) - 1:
                fresh[1:] |= column[1:] != column[:-1]
        first = np.flatnonzero(fresh)
        columns[-1] = np.add.reduceat(columns[-1], first) if len(first) else columns[-1]
        for c in range(len(columns) - 1):
            columns[c] = columns[c][first]
        return columns


#: Rows that a task hands on at once.
_SENT_ROWS = 1 << 16


def task_counts(relation: DataFrame, size: int, how: Mining, crowded) -> DataFrame:
    """(lang, w0, w1 ..., n): what each task counts of the phrases of ``size`` words.

    Occurrences with a cell that is not ``crowded`` cannot be of a frequent phrase and are not sent. A task reads its parts of
    the relation as one stream, adds up blocks of it and hands on a phrase once, unless it meets more than 2 ``block_rows`` of
    them: what it holds is bounded by that, however many pass the cells. There are as many tasks as cores: if they grew in
    number with the input, as phrases do, their counts would grow with its square."""
    names = [f"w{k}" for k in range(size)]

    def flushed(labels: dict[int, str], sums: _Sums) -> Iterator[pa.RecordBatch]:
        columns = sums.get()
        for at in range(0, len(columns[0]), _SENT_ROWS):
            lang, *words, n = (c[at : at + _SENT_ROWS] for c in columns)
            known, codes = np.unique(lang, return_inverse=True)
            yield pa.RecordBatch.from_arrays([
                pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int32)), pa.array([labels[k] for k in known.tolist()], pa.string())).cast(pa.string()),
                *[pa.array(c.view(np.int64)) for c in words], pa.array(n),
            ], names=["lang", *names, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: dict[int, str] = {}
        table, sums = crowded.value, _Sums(how.block_rows)
        for batch in batches:
            said = batch.column(0).unique().to_pylist()
            labels.update(zip(_lang_names(said).tolist(), said))
            for block in _blocks(batch, how.block_rows):
                columns = _marked(block, size)
                both = [(table[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 != 0 for c in _cells(columns, how.cells)]
                columns = [c[both[0] & both[1]] for c in columns]
                if not len(columns[0]):
                    continue
                first, counts = _grouped(columns)
                sums.add([c[first] for c in columns], counts.astype(np.int64))
                if sums.least >= 2 * how.block_rows:
                    yield from flushed(labels, sums)
                    sums = _Sums(how.block_rows)
        if sums.rows:
            yield from flushed(labels, sums)

    cores = max(1, relation.sparkSession.sparkContext.defaultParallelism)
    return relation.coalesce(cores).mapInArrow(run, ", ".join(["lang string", *[f"{n} bigint" for n in names], "n bigint"]))


def phrase_counts(relation: DataFrame, size: int, how: Mining, crowded) -> DataFrame:
    """(lang, ws, n): phrases of ``size`` words that the relation marks, at least ``how.least`` times."""
    names = [f"w{k}" for k in range(size)]
    counted = task_counts(relation, size, how, crowded).groupBy("lang", *names).agg(F.sum("n").alias("n")).filter(F.col("n") >= how.least)
    return counted.select("lang", F.array(*names).alias("ws"), "n")


def _frequent_words(texts: DataFrame, how: Mining) -> tuple[DataFrame, DataFrame, int]:
    """Sizes of the languages (lang, n), frequent words (lang, name, word, n), and the seed whose hashes tell every
    frequent word from all others."""
    for seed in range(12, 44):
        words = stored(word_counts(texts, how, seed), "words")
        frequent = stored(words.filter(F.col("n") >= how.least), "frequent")
        sizes = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
        known = frequent.select("lang", "name", F.col("word").alias("known"))
        clash = words.join(measured(known), ["lang", "name"]).filter("word <> known")
        if clash.isEmpty():
            return sizes, frequent, seed
    raise RuntimeError("no seed tells the frequent words apart")


def frequent_phrases(docs: DataFrame, how: Mining) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes of the languages, frequent words, and all frequent phrases (lang, ws, n) of 1 to ``longest`` words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    sizes, words, seed = _frequent_words(texts, how)
    phrases = words.select("lang", F.array("name").alias("ws"), "n")
    kept, relation = [phrases], None
    for size in range(1, how.longest):
        held = Filter.of(kept[-1], size, how.filter_bits)
        found = first_relation(texts, held, how, seed) if size == 1 else next_relation(relation, held, size, how)
        relation = stored(found, f"occurrences-{size + 1}")
        held.unpersist()
        crowded = crowded_cells(relation, size + 1, how)
        kept.append(stored(phrase_counts(relation, size + 1, how, crowded), f"phrases-{size + 1}"))
        crowded.unpersist()
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return sizes, words, out


def collocations(docs: DataFrame, how: Mining = Mining()) -> DataFrame:
    """The best phrases of each language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    A-Z are lowered; texts split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, pieces into words ``[^\\x20\\x09]+``. a counts all
    occurrences inside pieces; the cut with the lowest ``floor(1000 * a * n / (l * r))`` scores a phrase, in 38-digit
    decimals. Phrases inside a longer one that is as frequent go. A null language is ``und``, null and empty texts
    hold no words, repeated rows count each, ids are not looked at, and no frequent phrase gives no rows. Ties of score
    and count stand in byte order of the phrase. Extra columns are ignored."""
    sizes, words, phrases = frequent_phrases(docs, how)
    long = phrases.filter(F.size("ws") > 1).withColumnRenamed("n", "a")
    length = F.size("ws")
    within = long.filter(length > 2).select(
        "lang", F.explode(F.array(F.slice("ws", 1, length - 1), F.slice("ws", 2, length - 1))).alias("ws"), F.col("a").alias("longer")
    ).groupBy("lang", "ws").agg(F.max("longer").alias("longer"))  # two words longer and as frequent: so is the one between
    open_ = long.join(within, ["lang", "ws"], "left").filter("longer is null or longer < a").select("lang", "ws", "a")
    cuts = open_.withColumn("k", F.explode(F.sequence(F.lit(1), length - 1))).withColumns({
        "first": F.slice("ws", F.lit(1), F.col("k")), "rest": F.slice("ws", F.col("k") + 1, length - F.col("k")),
    })
    left = phrases.select("lang", F.col("ws").alias("first"), F.col("n").alias("l"))
    right = phrases.select("lang", F.col("ws").alias("rest"), F.col("n").alias("r"))
    total = sizes.select("lang", F.col("n").alias("total"))
    exact = lambda name, digits: F.col(name).cast(f"decimal({digits},0)")
    whole = (F.lit(1000).cast("decimal(4,0)") * exact("a", 15) * exact("total", 17)).alias("whole")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(measured(total), "lang").select(
        "lang", "ws", "a", "total", "k", "l", "r", whole, (exact("l", 19) * exact("r", 18)).alias("parts")
    ).withColumn("score", F.expr("whole div parts"))
    best = scored.groupBy("lang", "ws", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select(
        "lang", "ws", "a", F.col("total").alias("n"), "b.score", "b.l", "b.r"
    )
    order = [F.col("score").desc(), F.col("a").desc()]
    front = best.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= how.top)
    front = stored(front.drop("place"), "front")
    spelled = (
        front.select("lang", "ws", F.posexplode("ws").alias("at", "name"))
        .join(words.select("lang", "name", "word"), ["lang", "name"]).groupBy("lang", "ws")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    ranked = front.join(spelled, ["lang", "ws"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.col("phrase"))).cast("long")
    )
    return ranked.filter(F.col("rank") <= how.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
