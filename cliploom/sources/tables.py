"""Domain tables over the supplied parquet files.

Each view is one projection (or equi join) written once and rendered for Spark
and for the checking engine, so both sides read the same rows. Constants: the
report clock is fixed at 2024-01-31, media time is integer milliseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TODAY = "2024-01-31"
NOW_US = 1706659200000000
EPOCH_2024_US = 1704067200000000
HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


class _Spark:
    @staticmethod
    def us(x):
        return f"unix_micros(CAST({x} AS TIMESTAMP))"

    @staticmethod
    def ts(x):
        return f"timestamp_micros({x})"

    @staticmethod
    def div(a, b):
        return f"(({a}) div ({b}))"

    @staticmethod
    def words(x):
        return f"regexp_extract_all({x}, '[\\\\p{{{{L}}}}\\\\p{{{{N}}}}]+', 0)"

    @staticmethod
    def line(x, n):
        return f"trim(split_part({x}, '\\n', {n}))"

    @staticmethod
    def explode_words(words, key):
        return f"SELECT {key}, pos, w FROM (SELECT {key}, posexplode(ws) AS (pos, w) FROM ({words}))"


class _Duck:
    @staticmethod
    def us(x):
        return f"epoch_us({x})"

    @staticmethod
    def ts(x):
        return f"make_timestamp({x})"

    @staticmethod
    def div(a, b):
        return f"(({a}) // ({b}))"

    @staticmethod
    def words(x):
        return f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+')"

    @staticmethod
    def line(x, n):
        return f"trim(split_part({x}, chr(10), {n}))"

    @staticmethod
    def explode_words(words, key):
        return (
            f"SELECT {key}, CAST(unnest(range(len(ws))) AS INTEGER) AS pos, unnest(ws) AS w FROM ({words})"
        )


def pick(options: list[str], index: str) -> str:
    """The ``index``-th (0-based expression) of a fixed list of names."""
    return f"split_part('{'|'.join(options)}', '|', CAST({index} AS INTEGER) + 1)"


FILENAMES = [
    "gta_vi-heist.mp4", "GTA5_night.mov", "warzone.final.webm", "cod-round2.mp4", "fc 25 derby.mp4",
    "fifa_2023.mp4", "fortnite.mp4", "valorant-ace.mov", "apex.legends.mp4", "minecraft_build.mp4",
    "rocket league.mp4", "nba2k24.mov", "my-podcast-ep1.mp4", "holiday.avi", "interview.final.mov",
]
GAMES = ["EA Sports FC", "Grand Theft Auto V", "Call of Duty", "Fortnite", "Unknown gameplay", "Minecraft"]
SCORES = {
    "highlight": 7, "hook_potential": 11, "retention": 13, "emotional": 17, "novelty": 19, "share": 23,
    "context": 29, "clarity": 31, "surprise": 37, "humor": 41, "tension": 43, "skill": 47, "editability": 53,
    "quality": 59, "confidence": 61, "worthiness": 67,
}

VIEWS: dict[str, tuple[tuple[str, ...], Callable]] = {}


def view(*sources: str):
    def register(fn):
        VIEWS[fn.__name__] = (sources, fn)
        return fn

    return register


@view("events")
def observation(d):
    return """
    SELECT event_id AS observation_id, user_id % 7 AS owner_id,
      CASE WHEN event_type = 'signup' THEN 'CHANNEL' ELSE 'VIDEO' END AS scope,
      CASE WHEN event_type = 'signup' THEN NULL ELSE user_id END AS video_id,
      CAST(ts AS DATE) AS report_date, ts AS collected_at,
      CAST(floor(value * 100) AS BIGINT) AS views,
      CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value * 60) AS BIGINT) END AS engaged_views,
      value AS watch_minutes, CAST(event_id % 60 AS DOUBLE) AS avg_duration,
      CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) END AS avg_pct,
      event_id % 17 AS likes, event_id % 4 AS comments, event_id % 5 AS shares,
      event_id % 3 AS subs_gained, CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_id % 2 END AS subs_lost
    FROM {events}"""


@view("events")
def revenue(d):
    return """
    SELECT event_id AS observation_id, user_id % 7 AS owner_id,
      CASE WHEN event_type = 'signup' THEN 'CHANNEL' ELSE 'VIDEO' END AS scope,
      CASE WHEN event_type = 'signup' THEN NULL ELSE user_id END AS video_id,
      CAST(ts AS DATE) AS report_date, ts AS collected_at,
      CASE WHEN event_id % 4 = 0 THEN 'GHS' ELSE 'USD' END AS currency,
      CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS est_revenue,
      value * 0.5 AS ad_revenue, value * 0.25 AS premium_revenue,
      CAST(floor(value * 10) AS BIGINT) AS playbacks, CAST(event_id % 20 AS DOUBLE) AS cpm
    FROM {events}"""


@view("orders")
def publication(d):
    return f"""
    SELECT o_orderkey AS publication_id, o_orderkey AS short_id, o_orderkey % 7 AS owner_id,
      CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey END AS video_id,
      CASE o_orderstatus WHEN 'F' THEN 'PUBLISHED' WHEN 'O' THEN 'SCHEDULED' ELSE 'PENDING' END AS state,
      {d.ts(f"{EPOCH_2024_US} + (o_orderkey % 30) * {DAY_US} + (o_custkey % 24) * {HOUR_US}")} AS publish_at,
      CAST(o_orderkey % 7 AS INTEGER) AS attempts, o_orderkey % 11 = 0 AS cancel_requested,
      {d.ts(f"{NOW_US} - 36 * {HOUR_US} + (o_custkey % 72) * {HOUR_US}")} AS next_attempt_at
    FROM {{orders}}"""


@view("orders", "part")
def short(d):
    return """
    SELECT o_orderkey AS short_id, o_orderkey % 7 AS owner_id, o_custkey AS source_id,
      p_brand AS game, p_type AS event_type, p_name AS title, CAST(p_size AS DOUBLE) AS duration_s,
      CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'HERO' WHEN '2' THEN 'DISCOVERY'
        WHEN '3' THEN 'ENGAGEMENT' ELSE NULL END AS editorial_role,
      CAST(o_orderkey % 101 AS INTEGER) AS quality, CAST((o_orderkey * 7) % 101 AS INTEGER) AS confidence,
      CAST((o_orderkey * 13) % 101 AS INTEGER) AS highlight,
      CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST((o_orderkey * 17) % 1000 AS DOUBLE) / 10.0 END AS predicted,
      CASE WHEN o_orderkey % 5 = 0 THEN 'DRAFT' ELSE 'READY' END AS state,
      o_orderkey % 4 <> 0 AS publishable,
      CASE WHEN o_orderkey % 3 = 0 THEN 'HEURISTIC_FALLBACK' ELSE 'AI' END AS analysis_method,
      CASE o_orderkey % 6 WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'PENDING' WHEN 4 THEN 'PENDING'
        ELSE 'APPROVED' END AS review_state,
      o_orderdate AS created_at, (o_orderkey * 37) % 600000 AS event_ms
    FROM {orders} JOIN {part} ON p_partkey = o_orderkey % 200"""


@view("lineitem")
def render(d):
    return """
    SELECT l_orderkey AS short_id, l_linenumber AS render_no, l_extendedprice AS render_rank,
      CASE l_linenumber % 3 WHEN 0 THEN 'PREVIEW' WHEN 1 THEN 'HIGH' ELSE 'STANDARD' END AS preset,
      CASE WHEN l_returnflag = 'A' THEN 'FAILED' ELSE 'READY' END AS state,
      l_shipdate AS created_at, l_quantity + 12.0 AS frame_rate, l_partkey AS sha_no, l_suppkey AS store_no,
      l_quantity AS qty
    FROM {lineitem}"""


@view("customer")
def source(d):
    return f"""
    SELECT c_custkey AS source_id, c_custkey % 7 AS owner_id,
      {pick(FILENAMES, "c_custkey % 15")} AS filename,
      {pick(["READY", "FAILED", "UPLOADED", "PROCESSING", "ANALYZING"], "c_custkey % 5")} AS status,
      CAST(floor(c_acctbal * 1000) AS BIGINT) AS bytes,
      CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS duration_s,
      {d.ts(f"{EPOCH_2024_US} + c_custkey * 60000000")} AS created_at,
      {pick(["AUTO", "AUTO", "GAMEPLAY", "PODCAST"], "c_custkey % 4")} AS content_type,
      {pick(["video/mp4", "video/quicktime", "video/webm"], "c_custkey % 3")} AS mime,
      c_custkey % 8 <> 0 AS rights_ok, c_nationkey AS nation_id, c_mktsegment AS segment
    FROM {{customer}}"""


@view("orders")
def job(d):
    return f"""
    SELECT o_orderkey AS job_id, o_custkey AS source_id,
      {pick(["INGEST", "ANALYZE", "RANK", "PLAN", "RENDER"], "CAST(substring(o_orderpriority, 1, 1) AS BIGINT) - 1")} AS kind,
      {pick(["PENDING", "RUNNING", "RETRYING", "SUCCEEDED", "FAILED", "CANCELLED"], "o_orderkey % 6")} AS state,
      o_orderdate AS created_at,
      {d.ts(f"{NOW_US} - (o_orderkey % 7200) * 1000000")} AS updated_at,
      CAST(o_orderkey % 4 AS INTEGER) AS attempt, CAST((o_orderkey * 3) % 120 AS INTEGER) AS progress
    FROM {{orders}}"""


@view("events")
def signal(d):
    return f"""
    SELECT event_id AS signal_id, user_id AS source_id,
      CASE event_type WHEN 'view' THEN 'SCENE_CHANGE' WHEN 'purchase' THEN 'AUDIO_PEAK'
        WHEN 'error' THEN 'SILENCE' ELSE 'MOTION_PEAK' END AS kind,
      {d.div(d.us('ts') + f' - {EPOCH_2024_US}', '14400000')} AS t_ms,
      CASE WHEN event_type = 'error' THEN CAST(floor(value * 20) AS BIGINT) ELSE 0 END AS dur_ms, value
    FROM {{events}}"""


@view("events")
def media_clip(d):
    at = d.div(d.us('ts') + f' - {EPOCH_2024_US}', '14400000')
    return f"""
    SELECT event_id AS clip_id, user_id AS source_id, greatest(0, {at} - 5000) AS start_ms, {at} AS event_ms,
      {at} + 25000 AS end_ms
    FROM {{events}} WHERE event_type = 'signup'"""


@view("conversations")
def talk_clip(d):
    return """
    SELECT conv_id * 100 + turn AS clip_id, conv_id AS source_id, turn * 60000 AS start_ms, turn * 60000 + 6000 AS event_ms,
      turn * 60000 + 20000 AS end_ms FROM {conversations}"""


@view("conversations")
def talk_silence(d):
    return """
    SELECT conv_id AS source_id, turn * 60000 + 3000 + (conv_id % 5) * 500 AS t_ms, 1000 + (conv_id + turn) % 4 * 300 AS dur_ms
    FROM {conversations}"""


@view("events")
def media_source(d):
    return f"""
    SELECT DISTINCT user_id AS source_id, {pick(GAMES, "user_id % 6")} AS game,
      CASE WHEN user_id % 5 = 0 THEN 0.4 ELSE 0.82 END AS game_confidence,
      CAST(180000 AS BIGINT) AS duration_ms
    FROM {{events}}"""


@view("events")
def frame_metric(d):
    return """
    SELECT user_id AS source_id, event_id * 1000 AS t_ms, value / 500 AS luma FROM {events}"""


@view("events")
def loudness(d):
    return """
    SELECT user_id AS source_id, event_id * 500 AS t_ms, -value AS db FROM {events}"""


@view("documents")
def pool(d):
    scores = ",\n      ".join(
        f"CAST((doc_id * {prime}) % 101 AS INTEGER) AS {name}" for name, prime in SCORES.items()
    )
    return f"""
    SELECT doc_id AS short_id, doc_id % 20 % 7 AS owner_id, source || '-' || {d.div('doc_id', '480')} AS source_hash, lang AS game,
      {pick(["GOAL", "CLUTCH_SEQUENCE", "CHASE", "BUILD_ACTIVITY", "SAVE"], "doc_id % 5")} AS event_type,
      (doc_id * 3701) % 600000 AS start_ms, (doc_id * 3701) % 600000 + 6000 + n_chars % 54000 AS end_ms,
      (doc_id * 3701) % 600000 + 3000 AS event_ms,
      lower({d.line('text', 1)}) AS title, lower({d.line('text', 2)}) AS hook, lower({d.line('text', 3)}) AS concept,
      CASE WHEN doc_id % 3 <> 1 THEN nullif(lower({d.line('text', 4)}), '') END AS objects,
      text AS transcript, substring(md5(text), 1, 16) AS h0, substring(md5(lang || source), 1, 16) AS h1,
      CASE WHEN doc_id % 4 = 0 THEN md5(text) ELSE NULL END AS render_hash,
      CAST(6000 + n_chars % 54000 AS DOUBLE) / 1000 AS duration_s,
      {pick(["CROP:CLEAN", "CROP:ZOOM", "BLUR:REPLAY"], "doc_id % 3")} AS template,
      {pick(["humor", "tension", "skill"], "doc_id % 3")} AS tone,
      CASE WHEN doc_id % 3 <> 0 THEN doc_id % 500 ELSE NULL END AS vec_id, n_chars,
      CASE WHEN doc_id % 50 = 20 THEN 'REPLAY' ELSE NULL END AS reuse_kind,
      CASE WHEN doc_id % 50 = 20 THEN doc_id - 20 ELSE NULL END AS reuse_of_id,
      CASE WHEN doc_id % 100 = 20 THEN 'alternate angle of the play' WHEN doc_id % 50 = 20 THEN 'short' ELSE NULL END AS reuse_reason,
      {scores}
    FROM {{documents}}"""


@view("orders")
def slot(d):
    offset = f"{d.div('o_orderkey', '21')} % 720"
    third = f"({d.div('o_orderkey', '7')} % 3)"
    return f"""
    SELECT o_orderkey AS slot_id, o_orderkey % 7 AS owner_id, DATE '2023-06-01' + CAST({offset} AS INTEGER) AS local_date,
      {pick(["DISCOVERY", "ENGAGEMENT", "HERO"], third)} AS role, {pick(["12:00", "16:00", "20:00"], third)} AS local_time,
      CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_orderkey END AS short_id,
      {d.ts(f"1685577600000000 + ({offset}) * {DAY_US} + (12 + 4 * {third}) * {HOUR_US}")} AS planned_at
    FROM {{orders}}"""


@view("embeddings")
def vector(d):
    return "SELECT vec_id, label AS model, CAST(embedding AS " + ("ARRAY<DOUBLE>" if d is _Spark else "DOUBLE[]") + ") AS v FROM {embeddings}"


@view("conversations")
def word(d):
    words = f"SELECT conv_id, turn, role, {d.words('lower(text)')} AS ws FROM {{conversations}}"
    return f"""
    SELECT conv_id AS transcript_id, turn AS chunk_index, role AS speaker, pos, w,
      turn * 60000 + pos * 400 AS start_ms, turn * 60000 + pos * 400 + 300 AS end_ms
    FROM ({d.explode_words(words, 'conv_id, turn, role')})"""


@view("conversations")
def turn_span(d):
    return """
    SELECT conv_id AS transcript_id, turn AS chunk_index, role AS speaker,
      turn * 60000 AS start_ms, turn * 60000 + 20000 + (conv_id * 977) % 30000 AS end_ms
    FROM {conversations}"""


@view("lineitem")
def ai_cache(d):
    return """
    SELECT l_orderkey AS input_hash, l_partkey AS provider_no, l_returnflag AS model, l_linestatus AS prompt_version,
      CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS input_tokens,
      CAST(l_linenumber AS BIGINT) AS output_tokens, l_extendedprice AS price
    FROM {lineitem}"""


@view("lineitem")
def ledger(d):
    return f"""
    SELECT l_orderkey AS short_id, l_suppkey AS source_id, l_linenumber AS line_no, l_tax AS estimate_usd,
      CASE WHEN l_returnflag = 'R' THEN l_discount ELSE NULL END AS actual_usd,
      {pick(["PENDING", "SUBMITTING", "SUBMITTED", "PROCESSING", "COMPLETED", "NEEDS_RECONCILIATION", "FAILED"], "l_linenumber % 7")} AS status
    FROM {{lineitem}}"""


def _render(name: str, dialect, wrap: str) -> str:
    sources, fn = VIEWS[name]
    text = fn(dialect)
    for base in sources:
        text = text.replace("{" + base + "}", wrap.format(base))
    return text


DUCK_VIEWS: dict[str, str] = {name: _render(name, _Duck, "{}") for name in VIEWS}
DUCK_VIEWS["latest_obs"] = """
    SELECT * FROM observation QUALIFY row_number() OVER (
      PARTITION BY owner_id, scope, video_id, report_date ORDER BY collected_at DESC, observation_id DESC) = 1"""
DUCK_VIEWS["latest_rev"] = """
    SELECT * FROM revenue QUALIFY row_number() OVER (
      PARTITION BY owner_id, scope, video_id, report_date, currency ORDER BY collected_at DESC, observation_id DESC) = 1"""


class Tables:
    """Lazy access to the supplied tables and the domain views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.sf_dir = sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        sources, fn = VIEWS[name]
        return self.spark.sql(fn(_Spark), **{base: self.base(base) for base in sources})
