"""Similarity queries."""

from pyspark.sql import functions as F

from cliploom.functions import evidence as ev
from cliploom.functions.text import set_cosine, set_overlap_max, tokens_ascii, tokens_unicode
from cliploom.operators import similarity as s
from cliploom.plans import compare_sql as q
from cliploom.plans.common import rounded
from cliploom.plans.registry import query


def ready(t):
    return s.comparable(t.pool, t.vector)


@query("tokens_unicode", f"""
SELECT short_id, CAST(len({q.tokens('transcript')}) AS BIGINT) AS tokens FROM pool""")
def _(t):
    return t.pool.select("short_id", F.size(tokens_unicode("transcript")).cast("bigint").alias("tokens"))


@query("token_intersection", f"""
SELECT short_id, array_to_string(list_sort(list_intersect({q.tokens('title')}, {q.tokens('transcript')})), ' ') AS shared FROM pool""")
def _(t):
    both = F.array_intersect(tokens_unicode("title"), tokens_unicode("transcript"))
    return t.pool.select("short_id", F.array_join(F.array_sort(both), " ").alias("shared"))


@query("text_set_cosine", f"""
SELECT short_id, round({q.cos(q.tokens('title'), q.tokens('transcript'))}, 9) AS similarity FROM pool""")
def _(t):
    return rounded(t.pool.select(
        "short_id", set_cosine(tokens_unicode("title"), tokens_unicode("transcript")).alias("similarity")), "similarity", digits=9)


@query("token_overlap_max", """
WITH x AS (SELECT short_id, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(transcript), '[a-z0-9]+')) AS b FROM pool)
SELECT short_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(a, b)) / greatest(len(a), len(b)), 9) END AS similarity FROM x""")
def _(t):
    return rounded(t.pool.select(
        "short_id", set_overlap_max(tokens_ascii("title"), tokens_ascii("transcript")).alias("similarity")), "similarity", digits=9)


@query("hamming_similarity", f"SELECT short_id, {q.ham('h0', 'h1')} AS similarity FROM pool")
def _(t):
    return t.pool.select("short_id", ev.hamming_similarity("h0", "h1").alias("similarity"))


@query("sequence_similarity", f"""
SELECT short_id, ({q.ham('h0', 'h1')} + {q.ham('h1', 'h0')}) / 2 AS similarity
FROM (SELECT short_id, h0, h1 FROM pool)""")
def _(t):
    longer = F.array("h1", "h0", "h0")
    # Two frames against three: the first meets the first and the last meets the last.
    return t.pool.select("short_id", ev.sequence_similarity(F.array("h0", "h1"), longer).alias("similarity"))


@query("cosine_similarity", """
SELECT a.vec_id, round(greatest(0, least(1, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))))), 6) AS similarity
FROM vector a JOIN vector b ON b.vec_id = a.vec_id + 1""")
def _(t):
    following = t.vector.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return rounded(t.vector.join(following, "vec_id").select(
        "vec_id", ev.cosine_similarity("v", "w").alias("similarity")), "similarity")


@query("temporal_similarity", f"""
SELECT a.short_id, round({q.overlap('a', 'b')}, 9) AS overlap_shorter,
  round(greatest(0, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) / greatest(1, greatest(a.end_ms, b.end_ms) - least(a.start_ms, b.start_ms)), 9) AS iou
FROM pool a JOIN pool b ON b.short_id = a.short_id + 1""")
def _(t):
    p = t.pool.select("short_id", "start_ms", "end_ms")
    nxt = p.select((F.col("short_id") - 1).alias("short_id"), F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    return p.join(nxt, "short_id").select(
        "short_id", F.round(ev.overlap_of_shorter("start_ms", "end_ms", "s2", "e2"), 9).alias("overlap_shorter"),
        F.round(ev.interval_iou("start_ms", "end_ms", "s2", "e2"), 9).alias("iou"))


PAIRS_SQL = f"""
WITH r AS (SELECT *, min(short_id) OVER (PARTITION BY owner_id, frames, list_sort(concept_t), coalesce(vec_id, -1)) AS rep_id FROM pool_t),
pairs AS (
  SELECT a.short_id AS x, b.short_id AS y FROM r a JOIN r b ON a.owner_id = b.owner_id AND a.source_hash = b.source_hash AND a.short_id < b.short_id
    AND (least(a.end_ms, b.end_ms) > greatest(a.start_ms, b.start_ms) OR abs(a.event_ms - b.event_ms) < 2000)
  UNION
  SELECT a.short_id, b.short_id FROM r a JOIN r b ON a.owner_id = b.owner_id AND a.short_id < b.short_id AND a.short_id = a.rep_id AND b.short_id = b.rep_id
    AND {q.visual('a', 'b')} >= 0.97 AND {q.semantic('a', 'b')} >= 0.65
  UNION SELECT min(short_id) OVER (PARTITION BY owner_id, render_hash), short_id FROM pool_t WHERE render_hash IS NOT NULL
    QUALIFY min(short_id) OVER (PARTITION BY owner_id, render_hash) <> short_id
  UNION SELECT rep_id, short_id FROM r WHERE rep_id <> short_id)
"""


@query("pairwise_similarity", PAIRS_SQL + f"""
SELECT x AS a_id, y AS b_id, round({q.visual('a', 'b')}, 6) AS visual, round({q.semantic('a', 'b')}, 6) AS semantic,
  round({q.cos('a.hook_t', 'b.hook_t')}, 6) AS hook, round({q.cos('a.transcript_t', 'b.transcript_t')}, 6) AS transcript
FROM pairs JOIN pool_t a ON a.short_id = x JOIN pool_t b ON b.short_id = y""")
def _(t):
    out = s.pairwise_similarity(ready(t)).select(
        F.col("a_short_id").alias("a_id"), F.col("b_short_id").alias("b_id"),
        *[F.coalesce(F.col(f"cmp.components.{c}"), F.lit(0.0)).alias(c) for c in ("visual", "semantic", "hook", "transcript")])
    return rounded(out, "visual", "semantic", "hook", "transcript")


@query("editorial_compare", PAIRS_SQL + f"""
SELECT x AS a_id, y AS b_id, round({q.score('a', 'b')}, 6) AS score, {q.duplicate('a', 'b')} AS duplicate, {q.reason('a', 'b')} AS reason,
  {q.exception('a', 'b')} AS exception
FROM pairs JOIN pool_t a ON a.short_id = x JOIN pool_t b ON b.short_id = y""")
def _(t):
    return s.pairwise_similarity(ready(t)).select(
        F.col("a_short_id").alias("a_id"), F.col("b_short_id").alias("b_id"), F.round("cmp.score", 6).alias("score"),
        "cmp.duplicate", "cmp.reason", "cmp.exception")


@query("history_anti_join", f"""
SELECT short_id FROM pool_t a WHERE short_id // 20 % 5 <> 0 AND NOT EXISTS (
  SELECT 1 FROM pool_t b WHERE b.short_id // 20 % 5 = 0 AND b.owner_id = a.owner_id AND {q.duplicate('a', 'b')})""")
def _(t):
    r = ready(t)
    return s.history_anti_join(r.filter("short_id div 20 % 5 <> 0"), r.filter("short_id div 20 % 5 = 0")).select("short_id")
