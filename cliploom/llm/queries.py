"""The dealt operators as registered queries over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import (
    fingerprints, language, lattice, mixing, phrases, pieces, prefix_trie, quality, secrets, setsketch, sharding,
    site_lines, training_order,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


@_query
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of 150 % takes of each document."""
    return mixing.mix_plan(_table(spark, sf_dir, "documents")).drop("source")


ORACLES["op5_source_mix"] = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sources
), turns AS (
  SELECT 0 AS turn, source, source_size, weight, false AS filled, 0.0::DOUBLE AS level FROM weighted
  UNION ALL
  SELECT turn + 1, source, source_size, weight, filled OR 2 * source_size < next_level * weight, next_level
  FROM (
    SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) FILTER (WHERE filled) OVER (), 0))::DOUBLE
      / sum(weight) FILTER (WHERE NOT filled) OVER () AS next_level
    FROM turns WHERE turn < 40
  )
), targets AS (
  SELECT source, source_size,
    round(CASE WHEN filled THEN (2 * source_size)::DOUBLE ELSE least((2 * source_size)::DOUBLE, level * weight) END, 6) AS target
  FROM turns WHERE turn = 40
), placed AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
    coalesce(sum(size) OVER (
      PARTITION BY s.source ORDER BY md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS reached
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0
    ELSE (budget // source_size) * size + least(greatest(budget % source_size - reached, 0), size) END::BIGINT AS taken
FROM placed
"""


@_query
def op7_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in over a tenth of their source's documents."""
    docs = _table(spark, sf_dir, "documents")
    cleaned = site_lines.drop_site_boilerplate(docs.select("doc_id", "source", "text"), counts=("n_lines", "n_dropped"))
    return cleaned.select("doc_id", "source", "text", "n_lines", "n_dropped")


ORACLES["op7_site_lines"] = r"""
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT *, nullif(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '') AS key FROM lines
), counted AS (
  SELECT source, key, count(DISTINCT doc_id) AS hits FROM keyed WHERE key IS NOT NULL GROUP BY source, key
), pages AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY source
), bad AS (
  SELECT c.source, key FROM counted c JOIN pages p ON c.source IS NOT DISTINCT FROM p.source
  WHERE hits >= 3 AND hits > 0.1 * pages
), rebuilt AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY place) FILTER (WHERE b.key IS NULL) AS kept, count(*) AS n_lines,
    count(b.key) AS n_dropped
  FROM keyed k LEFT JOIN bad b ON k.source IS NOT DISTINCT FROM b.source AND k.key = b.key GROUP BY doc_id
)
SELECT d.doc_id, d.source, CASE WHEN n_dropped > 0 THEN coalesce(kept, '') ELSE d.text END AS text,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN rebuilt r ON d.doc_id = r.doc_id
"""


@_query
def op1_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


@_query
def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token sequence of the documents with its slot, shard and byte offset, as read back from the shards."""
    return training_order.materialised(_table(spark, sf_dir, "documents"))


@_query
def op3_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from three quarters of them."""
    return language.predict(_table(spark, sf_dir, "documents"))


@_query
def op6_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents on two-word shingles."""
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents"), setsketch.Sketching(size=2))


@_query
def op8_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece numbers of every document, and whether they decode to its text."""
    return pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_ids", "ids", "round_trip")


@_query
def op9_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: fixed patterns and strings that take many tokens."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


@_query
def op10_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate vectors of one label."""
    return lattice.near_vectors(_table(spark, sf_dir, "embeddings"))


@_query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of the quality rules for every document."""
    found = quality.verdicts(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("broken", ", ").alias("broken"),
    )


def _stop_list(lang: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in quality.STOP_WORDS[lang]) + "]"


ORACLES["op13_quality_rules"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, CASE lang %s END AS listed FROM documents
), listed AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts
), runs AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS place, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS run
  FROM listed WHERE len(w) > 5
), twins AS (
  SELECT doc_id, place FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1
), repeated AS (
  SELECT doc_id, sum(step) AS n FROM (
    SELECT doc_id, least(5, coalesce(lead(place) OVER (PARTITION BY doc_id ORDER BY place) - place, 5)) AS step FROM twins
  ) GROUP BY doc_id
), measured AS (
  SELECT l.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines) AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_alpha,
    CASE WHEN listed IS NOT NULL THEN len(list_filter(w, lambda x: list_contains(listed, lower(trim(x, '.,;:!?"''()[]{}*_-'))))) END AS n_stop
  FROM listed l LEFT JOIN repeated r USING (doc_id)
), ruled AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    array_to_string([x FOR x IN [
      CASE WHEN n_words < 10 THEN 'too few words' END, CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 'repeated runs' END,
      CASE WHEN 100 * word_chars < 200 * n_words OR 100 * word_chars > 1500 * n_words THEN 'word length' END,
      CASE WHEN 100 * n_symbols > 20 * n_words THEN 'symbols' END,
      CASE WHEN 100 * n_alpha < 60 * n_words THEN 'words without letters' END,
      CASE WHEN 100 * n_stop < 2 * n_words AND n_words >= 50 THEN 'stop words' END,
      CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 'duplicate lines' END] IF x IS NOT NULL], ', ') AS broken FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, broken = '' AS kept, broken FROM ruled
""" % " ".join(f"WHEN '{lang}' THEN {_stop_list(lang)}" for lang in quality.STOP_WORDS)


@_query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of each language."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def _grams(size: int) -> str:
    """All runs of ``size`` words inside pieces."""
    words = ", ".join(f"lead(word, {k}) OVER w" for k in range(size)).replace("lead(word, 0) OVER w", "word")
    return f"""
  SELECT lang, {size} AS len, phrase, count(*) AS f FROM (
    SELECT lang, [{words}] AS ws, array_to_string([{words}], ' ') AS phrase FROM words
    WINDOW w AS (PARTITION BY rid, piece ORDER BY place)
  ) WHERE ws[{size}] IS NOT NULL GROUP BY lang, phrase HAVING count(*) >= 100"""


ORACLES["op12_phrase_collocations"] = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT rid, lang, unnest(p) AS body, generate_subscripts(p, 1) AS piece
  FROM (SELECT rid, lang, string_split_regex(text, '[.,;:!?\x0A-\x0D]') AS p FROM texts)
), words AS MATERIALIZED (
  SELECT rid, lang, piece, unnest(w) AS word, generate_subscripts(w, 1) AS place
  FROM (SELECT *, regexp_extract_all(body, '[^\x20\x09]+') AS w FROM pieces)
), sizes AS (
  SELECT lang, count(*) AS n FROM words GROUP BY lang
), grams AS MATERIALIZED (%s
), cuts AS (
  SELECT g.lang, g.phrase, g.f AS a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * g.f * n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len)) AS k, string_split(phrase, ' ') AS ws FROM grams WHERE len > 1) g
  JOIN grams l ON l.lang = g.lang AND l.phrase = array_to_string(ws[1:k], ' ')
  JOIN grams r ON r.lang = g.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')
  JOIN sizes s ON s.lang = g.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), open AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM grams g WHERE g.lang = b.lang AND g.f >= b.a AND g.phrase <> b.phrase AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM open
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
""" % " UNION ALL".join(_grams(k) for k in range(1, 6))


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))
