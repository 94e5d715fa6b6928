"""Token ids of whole batches of texts: numpy finds the words of the vocabulary's pattern, Arrow names each distinct word
of a slice once, and the tokenizer spells only those."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cliploom.llm.secrets import encoding

#: Bytes of text worked on at a time; a longer text is a slice of its own.
SLICE = 4_000_000
_OTHER, _LETTER, _DIGIT, _BLANK, _UNKNOWN = range(5)
_SPACE, _QUOTE = ord(" "), ord("'")
_ENDINGS = tuple(np.array([ord(c) for c in e], np.uint32) for e in ("s", "t", "m", "d", "re", "ve", "ll"))


@functools.lru_cache(maxsize=1)
def _classes():
    """A function that gives the class of each code point, as the tokenizer's own pattern engine sees it.

    An encoding that knows single bytes only spells out what its pattern matches; each code point is asked for once."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    engines = [
        (kind, tiktoken.Encoding(f"class{kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={}))
        for kind, pattern in ((_LETTER, r"\p{L}"), (_DIGIT, r"\p{N}"), (_BLANK, r"\s"))
    ]
    table = np.full(0x110000, _UNKNOWN, np.uint8)

    def classes(codes: np.ndarray) -> np.ndarray:
        found = table[codes]
        new = np.unique(codes[found == _UNKNOWN])
        if len(new):
            table[new] = _OTHER
            text = new.astype("<u4").tobytes().decode("utf-32-le")
            for kind, engine in engines:
                table[_codes(bytes(engine.encode_ordinary(text)))] = kind
            found = table[codes]
        return found

    return classes


def _codes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")


def _starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the words of the pattern in ``secrets.encoding`` start; ``first`` marks the first code points of texts.

    A word is a run of letters, of digits, or of other signs, with one space before it if there is one; or an English
    ending after a quote; or a run of blanks, which leaves its last one to itself or to the word that follows in the text."""
    kinds = _classes()(codes)
    start = first.copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    after = np.flatnonzero((kinds[1:] != _BLANK) & (kinds[:-1] == _BLANK) & ~first[1:]) + 1
    start[after - 1] = True
    start[after] = codes[after - 1] != _SPACE
    quotes = np.flatnonzero((codes == _QUOTE) & start)
    for ending in _ENDINGS:
        size = len(ending)
        at = quotes[quotes + size < len(codes)]
        for k in range(size):
            at = at[(codes[at + 1 + k] == ending[k]) & ~first[at + 1 + k]]
        start[at + 1] = False
        rest = at + 1 + size
        start[rest[rest < len(codes)]] = True
    return start


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all ``texts`` (large binary, no nulls) in a row, and the place of each text's first word and the end."""
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    if not len(raw):
        return pa.array([], pa.large_binary()), np.zeros(len(edges), np.int64)
    begins = np.zeros(len(raw), bool)
    begins[edges[:-1][edges[:-1] < edges[1:]]] = True
    marks = (raw & 0xC0) != 0x80  # the first byte of each code point
    marks[marks] = _starts(_codes(raw.tobytes()), begins[marks])
    starts = np.append(np.flatnonzero(marks), len(raw))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(raw)])
    return words, np.searchsorted(starts, edges)


@functools.lru_cache(maxsize=2)
def _one_by_one(path: str):
    """The vocabulary with a pattern that takes whatever stands between two NUL characters as one word."""
    import tiktoken

    vocabulary = encoding(path)
    return tiktoken.Encoding(
        f"{vocabulary.name}-words", pat_str=r"\x00|[^\x00]+", mergeable_ranks=vocabulary._mergeable_ranks, special_tokens={}
    )


def _spellings(words: pa.Array, path: str) -> pa.Array:
    """The ids of each word as two-byte numbers: one call for all words, with a NUL after each.

    Words that hold a NUL themselves are rare; then they go one at a time."""
    if not len(words):
        return words
    edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    if not raw.all():
        single = encoding(path)._core_bpe.encode_single_piece
        return pa.array([np.array(single(w), "<u2").tobytes() for w in words.to_pylist()], pa.large_binary())
    vocabulary = _one_by_one(path)
    joined = np.ones(len(raw) + len(words), bool)
    joined[edges[1:] - edges[0] + np.arange(len(words))] = False
    text = np.zeros(len(joined), np.uint8)
    text[joined] = raw
    ids = np.array(vocabulary.encode_ordinary(text.tobytes().decode()), "<u2")
    apart = ids == vocabulary._mergeable_ranks[b"\0"]
    ends = 2 * (np.flatnonzero(apart) - np.arange(len(words)))
    offsets = np.concatenate((np.zeros(1, np.int64), ends))
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(ids[~apart])]
    )


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` (null: empty) as large binary arrays of about ``SLICE`` bytes."""
    whole = pc.fill_null(texts.cast(pa.large_binary()), b"")
    turn = np.cumsum(pc.binary_length(whole).to_numpy(zero_copy_only=False)) // SLICE
    edges = [0, *(np.flatnonzero(np.diff(turn)) + 1), len(whole)]
    for low, high in zip(edges, edges[1:]):
        if low < high:
            yield whole.slice(low, high - low)


def _named(texts: pa.Array, path: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """For each word of ``texts`` the number of its spelling, the spellings, and the places of the texts' first words."""
    words, first = _words(texts)
    named = words.dictionary_encode()
    return named.indices, _spellings(named.dictionary, path), first


def _totals(sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))[first]


def counted(texts: pa.Array, path: str) -> np.ndarray:
    """How many ids each text of a slice has."""
    words, spellings, first = _named(texts, path)
    sizes = pc.binary_length(spellings).to_numpy(zero_copy_only=False) // 2
    return np.diff(_totals(sizes[words.to_numpy(zero_copy_only=False)], first))


def spelled(texts: pa.Array, path: str) -> list[bytes]:
    """The ids of each text of a slice as two-byte numbers."""
    words, spellings, first = _named(texts, path)
    if not len(words):
        return [b""] * len(texts)
    ids = spellings.take(words)
    at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][first].tolist()
    data = memoryview(ids.buffers()[2] or b"")
    return [bytes(data[low:high]) for low, high in zip(at, at[1:])]
