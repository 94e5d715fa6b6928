"""Secret scans: fixed patterns, plus strings that a public vocabulary can only spell in many tokens."""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.storage import as_text

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: A candidate has at least this many characters, and fewer than this many characters for each token.
MIN_LENGTH = 20
MAX_CHARS_PER_TOKEN = 2.0

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
#: What a run that is not random as a whole is judged by next: its parts between these signs, then between any.
_PARTS = (re.compile(r"[^/=]{%d,}" % MIN_LENGTH), re.compile(r"[A-Za-z0-9]{%d,}" % MIN_LENGTH))
#: Shapes that are public by nature: digests by their lengths, UUIDs, numbers, words of under MIN_LENGTH letters joined by signs.
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.IGNORECASE)
_NUMBER = re.compile(r"[0-9+/_=-]+")
_NAME = "(?:[A-Z]?[a-z]{1,%d}|[A-Z]{1,%d})" % (MIN_LENGTH - 2, MIN_LENGTH - 1)
_IDENTIFIER = re.compile(rf"[/_=+-]*(?:(?:{_NAME}|[0-9]{{1,4}})[/_=+-]+)*{_NAME}[0-9]{{0,4}}[/_=+-]*")


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """The vocabulary file as a tiktoken encoding, once for each process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        os.path.basename(path), mergeable_ranks=ranks, special_tokens={},
        pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    )


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed kinds, sorted; per kind leftmost matches that do not overlap."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def is_random(run: str, vocabulary) -> bool:
    """Whether the run is no public shape and costs more tokens than its length allows; letters alone are judged alike."""
    if any(shape.fullmatch(run) for shape in (_DIGEST, _UUID, _NUMBER, _IDENTIFIER)):
        return False
    return len(run) < MAX_CHARS_PER_TOKEN * len(vocabulary.encode_ordinary(run))


def random_spans(run: str, at: int, base: list[tuple[int, int, int]], vocabulary, level: int = 0) -> list[tuple[int, int, int]]:
    """The run as a span if it is random and outside the base spans, else those of its parts that are; it starts at ``at``."""
    if not any(s < at + len(run) and at < e for s, _, e in base) and is_random(run, vocabulary):
        return [(at, 3, at + len(run))]
    if level == len(_PARTS):
        return []
    return [s for m in _PARTS[level].finditer(run) for s in random_spans(m.group(), at + m.start(), base, vocabulary, level + 1)]


def all_spans(text: str, vocabulary) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base spans with the random strings outside them."""
    base = base_spans(text)
    added = []
    for m in _RUN.finditer(text):
        added += random_spans(m.group(), m.start(), base, vocabulary)
    return base, sorted(base + added)


def scan(docs: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """Per row: doc_id, counts of the base kinds, digest of the base spans, all spans as ``kind:start:end``.

    Offsets count code points, ends are exclusive. Null text is empty; extra columns are ignored; equal rows give equal
    results; no rows give no rows. One pass without a shuffle; ``path`` names a vocabulary file every executor has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = encoding(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                base, every = all_spans(text or "", vocabulary)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                joined, spans = (",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found) for found in (base, every))
                rows.append((doc_id, *counts, hashlib.sha256(joined.encode()).hexdigest(), spans))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    found = docs.select(*as_text("doc_id"), "text").mapInPandas(
        run, "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
