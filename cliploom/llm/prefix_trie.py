"""Prefix trie of conversations, totals by time-forward processing.

Nodes of a shard are sorted by reverse level order and read once; a node takes the messages of its children from a
priority queue that spills, and sends its own subtree totals on to its parent through the same queue. What leaves a shard
goes to the shard of the parent in the next round: first the shards of deep conversations among each other, then all
shards to the crown of nodes that many conversations share."""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliploom.llm.storage import measured, partitions, stored


@dataclass(frozen=True)
class Sharding:
    """How the trie is cut.

    Nodes with more than ``members`` conversations are the crown; below it a shard holds the nodes of one such
    subtree within ``band`` levels, so it has at most ``members`` * ``band`` nodes. The crown has at most ``crown`` nodes:
    ``members`` grows with the input once that is needed."""

    members: int = 256
    band: int = 4096
    crown: int = 1 << 18
    #: Messages a queue holds in memory before it writes a sorted run.
    queue: int = 100_000

    def limit(self, rows: int) -> int:
        return max(self.members, -(-rows // self.crown))


class SpillingQueue:
    """Least item first; beyond ``limit`` items the upper half goes to a sorted run in an unnamed scratch file."""

    def __init__(self, limit: int):
        self.limit, self.heap, self.runs = limit, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            ordered = sorted(self.heap)
            self.heap, run = ordered[: self.limit // 2], ordered[self.limit // 2 :]
            store = tempfile.TemporaryFile()
            for one in run:
                pickle.dump(one, store)
            store.seek(0)
            self.runs.append([pickle.load(store), len(run) - 1, store])

    def _source(self):
        least = min(range(len(self.runs)), key=lambda k: self.runs[k][0], default=None)
        if least is None or (self.heap and self.heap[0] <= self.runs[least][0]):
            return None
        return least

    def peek(self) -> tuple | None:
        if not self.heap and not self.runs:
            return None
        source = self._source()
        return self.heap[0] if source is None else self.runs[source][0]

    def pop(self) -> tuple:
        source = self._source()
        if source is None:
            return heapq.heappop(self.heap)
        run = self.runs[source]
        item = run[0]
        if run[1]:
            run[0], run[1] = pickle.load(run[2]), run[1] - 1
        else:
            run[2].close()
            del self.runs[source]
        return item


def _placed(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, role, text) with their place from 1 in the order of turn, null first, ties by role and text.

    One range sort over all turns, so a conversation of any length is spread; a window numbers the turns of a conversation
    inside a range, and the counts of the ranges before are added."""
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    ranged = stored(
        turns.repartitionByRange(partitions(turns.sparkSession), "conv_id", *order).withColumn("_range", F.spark_partition_id()),
        "turns",
    )
    counts = ranged.groupBy("conv_id", "_range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv_id", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("conv_id", "_range").orderBy(*order)
    return ranged.withColumn("at", F.row_number().over(inside)).join(offsets, ["conv_id", "_range"]).withColumn(
        "at", F.col("at") + F.col("ahead")
    ).drop("ahead", "turn")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, x1, x2, chars, _range) of every rebuilt turn, and (conv_id) of every conversation."""
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    placed = _placed(turns)
    slim = stored(placed.select("conv_id", "_range", "at", *[
        h.alias(n) for n, h in zip(("h1", "h2"), [F.xxhash64(F.lit(s), "role", "text") for s in (3, 104729)])
    ], F.length("text").cast("long").alias("chars")), "places")
    convs = slim.groupBy("conv_id").agg(F.max("at").alias("turns")).withColumns({
        "head": F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)),
        "base": F.col("conv_id") - F.col("conv_id") % 100,
    })
    fronts = slim.filter("at <= 5").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "h1", "h2", "chars"))).alias("front")
    )
    plan = stored(
        convs.join(fronts.select(F.col("conv_id").alias("base"), "front"), "base", "left")
        .withColumn("front", F.when(F.col("front").isNotNull() & (F.col("head") > 0), F.slice("front", F.lit(1), F.col("head").cast("int"))))
        .withColumn("taken", F.coalesce(F.size("front"), F.lit(0)))
        .withColumn("taken", F.greatest("taken", F.lit(0))), "plan",
    )
    taken = plan.select("conv_id", F.lit(-1).alias("_range"), F.explode("front").alias("f")).select(
        "conv_id", "_range", F.col("f.at").cast("long").alias("depth"), "f.h1", "f.h2", "f.chars"
    )
    spread = slim.select("conv_id", "_range").distinct().join(plan.select("conv_id", "head", "taken"), "conv_id")
    own = slim.join(spread, ["conv_id", "_range"]).filter("at > head").select(
        "conv_id", "_range", (F.col("at") - F.col("head") + F.col("taken")).cast("long").alias("depth"), "h1", "h2", "chars"
    )
    tagged = taken.unionByName(own).select(
        "conv_id", "_range", "depth", "chars", F.xxhash64(F.lit(5), "depth", "h1", "h2").alias("x1"), F.xxhash64(F.lit(6133), "depth", "h2", "h1").alias("x2")
    )
    return tagged, plan.select("conv_id")


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, chars, last): every prefix of every rebuilt conversation by a 128-bit name.

    A name is the exclusive or of the hashes of the turns with their places, so prefixes of a conversation are running
    aggregates: inside a range by a window, across ranges by one row per conversation and range. p1, p2 name the prefix that is
    shorter by one turn."""
    turns, convs = rebuilt_turns(conversations)
    turns = stored(turns, "rebuilt")
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = turns.groupBy("conv_id", "_range").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"), F.max("depth").alias("end"))
    ahead = stored(parts.select(
        "conv_id", "_range", *[F.coalesce(F.bit_xor(f"b{k}").over(before), F.lit(0)).alias(f"a{k}") for k in (1, 2)],
        F.max("end").over(Window.partitionBy("conv_id")).alias("deepest"),
    ), "ahead")
    inside = Window.partitionBy("conv_id", "_range").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    named = turns.withColumns({f"i{k}": F.bit_xor(f"x{k}").over(inside) for k in (1, 2)}).join(ahead, ["conv_id", "_range"]).withColumns(
        {f"k{k}": F.col(f"i{k}").bitwiseXOR(F.col(f"a{k}")) for k in (1, 2)}
    ).select(
        "conv_id", "depth", "k1", "k2", *[F.col(f"k{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k in (1, 2)], "chars",
        (F.col("depth") == F.col("deepest")).alias("last"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.join(ahead.select("conv_id", "deepest").distinct(), "conv_id", "left").select(
        "conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("chars"),
        F.col("deepest").isNull().alias("last"),
    )
    return named.unionByName(roots)


_KEY = ["depth", "k1", "k2"]


def trie_nodes(rows: DataFrame) -> DataFrame:
    """Distinct prefixes: (depth, k1, k2, p1, p2, conv_id, n_convs, saved): saved is the node's own share."""
    return rows.groupBy(*_KEY).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.min("chars").alias("chars"),
    ).select(*_KEY, "p1", "p2", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))


#: A shard's rows: messages (kind 0) stand before the node they are for (kind 1).
_ROW = ["shard", "depth", "k1", "k2", "kind", "p1", "p2", "children", "leaves", "saved"]
_TOTALS = "depth long, k1 long, k2 long, p1 long, p2 long, n_children long, n_leaves long, saved_tokens long, top boolean"


def _forward(how: Sharding):
    """Totals of the nodes of whole shards, sorted by shard and reverse level order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, queue, given, floor = None, None, (None, 0, 0, 0), 0
        for batch in batches:
            out = []
            for name, depth, k1, k2, kind, p1, p2, lowest, children, leaves, saved in zip(*[batch[c] for c in (
                "shard", "depth", "k1", "k2", "kind", "p1", "p2", "floor", "children", "leaves", "saved"
            )]):
                if name != shard:
                    shard, queue, given = name, SpillingQueue(how.queue), (None, 0, 0, 0)
                key = (-depth, k1, k2)
                if kind == 0:
                    known = given if given[0] == key else (key, 0, 0, 0)
                    given = (key, known[1] + children, known[2] + leaves, known[3] + saved)
                    continue
                n, below, total = (given[1], given[2], given[3]) if given[0] == key else (0, 0, 0)
                while (item := queue.peek()) is not None and item[:3] == key:
                    queue.pop()
                    n, below, total = n + 1, below + item[3], total + item[4]
                below += leaves if leaves >= 0 else (n == 0)
                total += saved
                top = depth <= lowest
                if not top:
                    queue.push((-(depth - 1), int(p1), int(p2), below, total))
                out.append((depth, k1, k2, p1, p2, n, below, total, top))
            yield pd.DataFrame(out, columns=["depth", "k1", "k2", "p1", "p2", "n_children", "n_leaves", "saved_tokens", "top"])

    return run


def _pass(nodes: DataFrame, messages: DataFrame | None, how: Sharding) -> DataFrame:
    """Totals of ``nodes`` (shard, floor, depth, k1, k2, p1, p2, leaves, saved) with the messages from other shards.

    ``floor`` is the least depth of the shard on the node's path: a node there sends its totals out. ``leaves`` is what the node
    counts itself, -1: one if it has no child. Rows go to their shard's task and are sorted there by Spark, on disk if need be."""
    zero = F.lit(0).cast("long")
    p1, p2 = (F.coalesce(p, zero).alias(p) for p in ("p1", "p2"))
    rows = nodes.select("shard", "floor", *_KEY, F.lit(1).alias("kind"), p1, p2, zero.alias("children"), "leaves", "saved")
    if messages is not None:
        rows = rows.unionByName(messages.select(
            "shard", zero.alias("floor"), *_KEY, F.lit(0).alias("kind"), zero.alias("p1"), zero.alias("p2"), "children", "leaves", "saved"
        ))
    dealt = rows.repartition(partitions(nodes.sparkSession), "shard").sortWithinPartitions(
        "shard", F.col("depth").desc(), "k1", "k2", "kind"
    )
    return dealt.mapInPandas(_forward(how), _TOTALS)


def _outgoing(totals: DataFrame) -> DataFrame:
    """What shard roots send to their parents, added up by parent."""
    return totals.filter("top and depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )


def subtree_totals(rows: DataFrame, nodes: DataFrame, limit: int, how: Sharding) -> DataFrame:
    """(depth, k1, k2, n_children, n_leaves, saved_tokens) of every node of the trie.

    ``rows`` are prefixes of conversations, ``nodes`` the distinct ones. 1. Nodes below the crown pass totals inside their
    shards. 2. If conversations go on for more than a band, the roots of bands form a trie of their own, its totals are taken
    the same way, and the bands are passed again with what really comes from below. 3. Shard roots send their totals,
    added up by parent, to the crown, which is one more shard."""
    crown = stored(nodes.filter(F.col("n_convs") > limit), "crown")
    marks = measured(crown.select(*_KEY))
    reach = rows.join(marks, _KEY, "left_semi").groupBy("conv_id").agg(F.max("depth").alias("shared"))
    convs = rows.filter("depth = 0").select("conv_id").join(reach, "conv_id", "left").select(
        "conv_id", (F.coalesce("shared", F.lit(-1)) + 1).alias("first")
    )
    # the light node where a conversation leaves the crown names its shards
    leaving = rows.join(convs.withColumn("depth", F.col("first")), ["conv_id", "depth"]).select("conv_id", "first", *_KEY)
    light = nodes.join(marks, _KEY, "left_anti")
    named = stored(leaving.join(light.select(*_KEY, F.col("conv_id").alias("unit")), _KEY).select("conv_id", "first", "unit"), "units")
    reached = nodes.groupBy("conv_id").agg(F.max("depth").alias("deepest"))
    bands = named.join(reached, "conv_id").withColumn("band", F.explode(F.expr(f"sequence(first div {how.band}, deepest div {how.band})")))
    placed = light.withColumn("band", F.expr(f"depth div {how.band}")).join(
        bands.select("conv_id", "band", "first", "unit"), ["conv_id", "band"]
    ).withColumns({
        "floor": F.greatest("first", F.col("band") * how.band), "shard": F.xxhash64("unit", "band"), "leaves": F.lit(-1).cast("long"),
    })
    placed = stored(placed, "placed")
    edge = placed.filter(F.col("depth") == F.col("floor")).filter(F.col("floor") > F.col("first"))
    to_parent = lambda df: df.withColumns({
        "shard": F.xxhash64("unit", F.col("band") - 1), "depth": F.col("depth") - 1, "k1": F.col("p1"), "k2": F.col("p2"), "children": F.lit(1).cast("long"),
    })
    if edge.isEmpty():
        totals = stored(_pass(placed, None, how), "totals")
    else:
        blank = to_parent(edge).withColumns({"leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")})
        partial = stored(_pass(placed, blank, how), "partial").filter("top").select(*_KEY, "n_leaves", "saved_tokens")
        roots = placed.filter(F.col("depth") == F.col("floor")).drop("leaves", "saved").join(partial, _KEY)
        # the band root above a band root: the same conversation's prefix at the floor of the band before
        above = edge.select("conv_id", *[F.col(c).alias(f"of_{c}") for c in _KEY], F.greatest("first", F.col("floor") - how.band).alias("depth"))
        linked = above.join(rows.select("conv_id", *_KEY), ["conv_id", "depth"]).select(
            F.col("of_depth").alias("depth"), F.col("of_k1").alias("k1"), F.col("of_k2").alias("k2"), F.col("k1").alias("q1"), F.col("k2").alias("q2")
        )
        chain = roots.join(linked, _KEY, "left").select(
            F.xxhash64("unit").alias("shard"), "first", "unit", "band", (F.col("band") - F.expr(f"first div {how.band}")).alias("depth"), "k1", "k2",
            F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(0).cast("long").alias("floor"),
            F.col("depth").alias("at"), F.col("p1").alias("parent1"), F.col("p2").alias("parent2"),
        )
        chain = stored(chain, "chain")
        whole = _pass(chain, None, how).select("depth", "k1", "k2", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        sent = chain.drop("leaves", "saved", "p1", "p2").join(whole, _KEY).filter("depth > 0").select(
            "unit", "band", F.col("at").alias("depth"), F.col("parent1").alias("p1"), F.col("parent2").alias("p2"), "leaves", "saved"
        )
        totals = stored(_pass(placed, to_parent(sent), how), "totals")
    top = crown.withColumns({
        "shard": F.lit(0).cast("long"), "floor": F.lit(0).cast("long"), "leaves": F.lit(-1).cast("long"),
    })
    arriving = _outgoing(totals).join(marks, _KEY, "left_semi").withColumn("shard", F.lit(0).cast("long"))
    crowned = _pass(top, arriving, how)
    return totals.unionByName(crowned).select(*_KEY, "n_children", "n_leaves", "saved_tokens")


def _stream_digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the parts of a list, read in order; a list's parts may come in several batches."""
    at, state = None, None
    for batch in batches:
        out = []
        for depth, k1, k2, part in zip(batch["depth"], batch["k1"], batch["k2"], batch["part"]):
            key = (depth, k1, k2)
            if key != at:
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = key, hashlib.sha256(part.encode())
            else:
                state.update(b"," + part.encode())
        yield pd.DataFrame(out, columns=["depth", "k1", "k2", "ends_sha256"])
    if at is not None:
        yield pd.DataFrame([(*at, state.hexdigest())], columns=["depth", "k1", "k2", "ends_sha256"])


def end_digests(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes where conversations end: their ids in order, comma-joined, hashed.

    Ids are range-sorted by node and id and joined inside ranges, so a node that a third of all conversations end at comes as
    one part per range; the few nodes with several parts are streamed through a hash in order."""
    ends = rows.filter("last").select(*_KEY, "conv_id")
    ranged = ends.repartitionByRange(partitions(rows.sparkSession), *_KEY, "conv_id").withColumn("_range", F.spark_partition_id())
    parts = stored(stored(ranged, "ends").groupBy(*_KEY, "_range").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("part")
    ), "parts")
    sizes = parts.groupBy(*_KEY).agg(F.count("*").alias("n"))
    split = measured(stored(sizes.filter("n > 1").select(*_KEY), "split"))
    whole = parts.join(split, _KEY, "left_anti").select(*_KEY, F.sha2("part", 256).alias("ends_sha256"))
    streamed = parts.join(split, _KEY, "left_semi").repartition(partitions(rows.sparkSession), *_KEY).sortWithinPartitions(
        *_KEY, "_range"
    ).select(*_KEY, "part").mapInPandas(_stream_digest, "depth long, k1 long, k2 long, ends_sha256 string")
    return whole.unionByName(streamed)


def prefix_trie(conversations: DataFrame, how: Sharding = Sharding()) -> DataFrame:
    """The trie of rebuilt ``conversations`` (conv_id, turn, role, text), one row per node: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns stand by turn, null first, then by role and text; null role or text is empty. A conversation c takes the first
    h = crc32(c) % 6 turns of conversation c - c % 100 and goes on with its own turns after its first h. Rows without
    a conversation id belong to none and are not looked at; repeated rows are turns of their own; a conversation that is left
    without turns ends at the root; no conversations give no rows. Extra columns are ignored."""
    rows = stored(prefixes(conversations), "prefixes")
    nodes = stored(trie_nodes(rows), "nodes")
    limit = how.limit(nodes.count())
    totals = subtree_totals(rows, nodes, limit, how)
    crown = measured(stored(nodes.filter(F.col("n_convs") > limit).select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("crown_conv")
    ), "crown-ids"))
    under = ["depth", "p1", "p2"]
    hung = nodes.join(crown, under, "left")
    below = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv"))
    light = hung.filter("crown_conv is null").join(below, under, "left")
    parents = light.select(*_KEY, "conv_id", "n_convs", F.col("parent_conv").alias("parent_conv_id")).unionByName(
        hung.filter("crown_conv is not null").select(*_KEY, "conv_id", "n_convs", F.col("crown_conv").alias("parent_conv_id"))
    )
    told = parents.join(totals, _KEY).join(end_digests(rows), _KEY, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return told.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
