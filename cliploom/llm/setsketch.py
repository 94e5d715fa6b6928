"""Near-duplicates by SetSketch registers: banded registers find candidates, a likelihood estimate sorts them, full
shingle sets decide.

A register is the exponentially spaced, truncated minimum of a hash over the set, so sketches merge by their maxima."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from cliploom.llm.components import components
from cliploom.llm.storage import measured, stored
from cliploom.llm.words import minima, parameters, set_digest, shingle_hashes, shingle_set, word_hashes


@dataclass(frozen=True)
class Sketching:
    """Bands of registers, spacing of register values, and the rule for a link in per cent.

    With 7 registers a band and 56 bands a pair at the limit of 0.8 is missed with a chance of about 2 in a million."""

    size: int = 5
    percent: int = 80
    bands: int = 56
    rows: int = 7
    #: None: plain minima, whose equal share is the estimate.
    spacing: float | None = 1.02
    scale: float = 20.0
    top: int = 2000
    seed: int = 6
    #: Pairs whose estimate lies this far below the limit are let go: five standard errors of the estimate.
    margin: float = 0.10
    #: Bands that are looked at together: each portion meets only what the portions before left apart.
    portions: tuple[tuple[int, int], ...] = ((0, 6), (6, 56))
    #: 0 leaves out the pairing with a named member, so that blocks have to find everything.
    rounds: int = 1
    #: Members of a bucket (registers only) and of a cluster (with texts) in a block; a task holds two blocks.
    block: int = 2048
    text_block: int = 512

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def limit(self) -> float:
        return self.percent / 100


def sketch(shingles: np.ndarray, how: Sketching, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of a set: floor(1 - log of the least exponential variate), kept within 0 and ``top`` + 1."""
    if not len(shingles):
        return np.zeros(how.registers, np.uint16)
    u = (minima(shingles, a, b).astype(np.float64) + 0.5) / 2.0**64
    h = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / how.scale
    return np.clip(np.floor(1 - np.log(h) / np.log(how.spacing)), 0, how.top + 1).astype(np.uint16)


def merged(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(first, second)


_GRID = np.linspace(0.0, 1.0, 201)


def estimate(above: np.ndarray, below: np.ndarray, n1: np.ndarray, n2: np.ndarray, how: Sketching) -> np.ndarray:
    """Most likely Jaccard similarity of pairs, given how many registers of the first are above and below the second's
    and the sizes of both sets: the joint likelihood of the three register outcomes on a grid of similarities."""
    b, m = how.spacing, how.registers
    if b is None:
        return 1 - (above + below) / m
    n1, n2 = np.maximum(n1, 1).astype(float), np.maximum(n2, 1).astype(float)
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    grid = _GRID[None, :] * np.minimum(u / v, v / u)[:, None]

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (b - 1) / b) / np.log(b)

    up, down = chance(u[:, None] - v[:, None] * grid), chance(v[:, None] - u[:, None] * grid)
    tiny = 1e-12
    score = (
        above[:, None] * np.log(np.maximum(up, tiny)) + below[:, None] * np.log(np.maximum(down, tiny))
        + (m - above - below)[:, None] * np.log(np.maximum(1 - up - down, tiny))
    )
    return grid[np.arange(len(grid)), score.argmax(1)]


_SKETCH = StructType([
    StructField("n_shingles", LongType()), StructField("set_key", BinaryType()), StructField("sketch", BinaryType())
])


def sketched(text: Column, how: Sketching) -> Column:
    """Struct of set size, 128-bit name of the set, and registers (two bytes each) of each whole text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a, b = parameters(how.registers, how.seed)
        for batch in batches:
            rows = []
            for text in batch:
                shingles = shingle_hashes(word_hashes(text), how.size)
                rows.append((len(shingles), set_digest(shingles), sketch(shingles, how, a, b).tobytes() if len(shingles) else None))
            yield pd.DataFrame(rows, columns=["n_shingles", "set_key", "sketch"])

    return F.pandas_udf(run, _SKETCH)(text)


def band_keys(sketch: Column, how: Sketching, low: int, high: int) -> Column:
    """Array of (band, 64-bit key) for the bands ``low`` to ``high`` of a sketch."""
    width = 2 * how.rows
    return F.array(*[
        F.struct(F.lit(k).alias("band"), F.xxhash64(F.lit(k), F.substring(sketch, k * width + 1, width)).alias("key")) for k in range(low, high)
    ])


def _likely(how: Sketching):
    """Whether the registers of a pair leave room for a link."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for first, second, n1, n2 in batches:
            if not len(first):
                yield pd.Series([], dtype=bool)
                continue
            x = np.frombuffer(b"".join(first), np.uint16).reshape(len(first), -1)
            y = np.frombuffer(b"".join(second), np.uint16).reshape(len(second), -1)
            n1, n2 = n1.to_numpy(), n2.to_numpy()
            guess = estimate((x > y).sum(1), (x < y).sum(1), n1, n2, how)
            sizes = 100 * np.minimum(n1, n2) >= how.percent * np.maximum(n1, n2)
            yield pd.Series(sizes & (guess >= how.limit - how.margin))

    return F.pandas_udf(run, BooleanType())


def _linked(how: Sketching):
    """Whether 100 * intersection >= percent * union holds on the full shingle sets of two texts."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for first, second in batches:
            out, before, known = [], None, None
            for x, y in zip(first, second):
                if x != before:
                    before, known = x, shingle_set(x, how.size)
                other = shingle_set(y, how.size)
                both = len(known & other)
                out.append(100 * both >= how.percent * (len(known) + len(other) - both))
            yield pd.Series(out, dtype=bool)

    return F.pandas_udf(run, BooleanType())


def verified(pairs: DataFrame, texts: DataFrame, how: Sketching) -> DataFrame:
    """Of the pairs (a, b) those whose full sets link; ``texts`` has (rep, text)."""
    first = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    return both.filter(_linked(how)("text_a", "text_b")).select("a", "b")


def _share(registers: np.ndarray, i: int, js: np.ndarray, n: np.ndarray, how: Sketching) -> np.ndarray:
    """Of the rows ``js`` those whose size and registers leave room for a link with row ``i``."""
    js = js[100 * np.minimum(n[js], n[i]) >= how.percent * np.maximum(n[js], n[i])]
    if not len(js):
        return js
    x, y = registers[i], registers[js]
    equal = (x == y).sum(1)
    fair = equal >= (how.limit - how.margin) * how.registers  # registers agree at least as often as sets do
    js, y = js[fair], y[fair]
    if not len(js):
        return js
    guess = estimate((x > y).sum(1), (x < y).sum(1), np.full(len(js), n[i]), n[js], how)
    return js[guess >= how.limit - how.margin]


def _sides(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of the two blocks of a task, and whether they are one block."""
    left, right, block = int(batch["left"].iloc[0]), int(batch["right"].iloc[0]), batch["block"].to_numpy()
    return np.flatnonzero(block == left), np.flatnonzero(block == right), left == right


def _apart(how: Sketching):
    """Components that likely pairs of a bucket's members would join, as a forest, found block against block.

    A pair is left to the first band whose registers agree, so each is looked at once."""

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        registers = np.frombuffer(b"".join(batch["sketch"]), np.uint16).reshape(len(batch), -1)
        bands = np.ascontiguousarray(registers).view(f"V{2 * how.rows}").reshape(len(batch), how.bands)
        names = np.unique(bands, return_inverse=True)[1].reshape(bands.shape)
        component, n, band = batch["component"].to_numpy(), batch["n_shingles"].to_numpy(), int(batch["band"].iloc[0])
        rows, columns, one = _sides(batch)
        kept, own = np.unique(component, return_inverse=True)
        part, found_a, found_b = own.copy(), [], []  # part: what the pairs found so far have joined
        for i in rows:
            js = columns[columns > i] if one else columns
            js = js[part[js] != part[i]]
            js = js[~(names[js, :band] == names[i, :band]).any(1)]
            js = _share(registers, i, js, n, how)
            if len(js):
                joined, first = np.unique(part[js], return_index=True)
                found_a.append(np.full(len(joined), own[i]))
                found_b.append(own[js[first]])
                part[np.isin(part, joined)] = part[i]
        none = np.empty(0, np.int64)
        return pd.DataFrame({"a": kept[np.concatenate(found_a or [none])], "b": kept[np.concatenate(found_b or [none])]})

    return compare


def _joined(how: Sketching):
    """Links between different components of a cluster on the full sets, as a forest, found block against block."""

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        registers = np.frombuffer(b"".join(batch["sketch"]), np.uint16).reshape(len(batch), -1)
        n, rep = batch["n_shingles"].to_numpy(), batch["rep"].to_numpy()
        part = np.unique(batch["component"].to_numpy(), return_inverse=True)[1]
        texts, sets = batch["text"].tolist(), {}
        rows, columns, one = _sides(batch)

        def shingles(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_hashes(word_hashes(texts[k]), how.size)
            return sets[k]

        found = []
        for i in rows:
            js = columns[columns > i] if one else columns
            for j in _share(registers, i, js[part[js] != part[i]], n, how):
                if part[i] == part[j]:
                    continue
                both = len(np.intersect1d(shingles(i), shingles(j), assume_unique=True))
                if 100 * both >= how.percent * (n[i] + n[j] - both):
                    part[part == part[j]] = part[i]
                    found.append((rep[i], rep[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return compare


def _blocks(members: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Rows of ``members`` copied to the block pairs they take part in: as many copies as their group has blocks.

    ``groups`` has (key, blocks)."""
    dealt = members.join(groups, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(o, F.col("block")).alias("left"), F.greatest(o, F.col("block")).alias("right")
    ))
    return dealt.withColumn("pair", F.explode(others)).select(*members.columns, "block", "pair.left", "pair.right")


def _named(labels: DataFrame | None, rows: DataFrame) -> DataFrame:
    """``rows`` (rep, ...) with the component they are known to belong to; ``labels`` holds those that have left their own."""
    if labels is None:
        return rows.withColumn("component", F.col("rep"))
    return rows.join(measured(labels), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """``labels`` (rep, component) after the components in ``links`` (a, b) have joined."""
    if links.isEmpty():
        return labels
    moved = stored(components(links).filter("node <> component").select("node", F.col("component").alias("into")), "moved")
    fresh = moved.select(F.col("node").alias("rep"), F.col("into").alias("component"))
    if labels is None:
        return fresh
    old = labels.join(measured(moved), F.col("component") == F.col("node"), "left").select(
        "rep", F.coalesce("into", "component").alias("component")
    )
    return stored(old.unionByName(fresh), "labels")


def _of(table: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Rows of ``table`` whose rep is in ``ids`` (repeats allowed), written once."""
    return stored(table.join(measured(stored(ids, "ids")), "rep", "left_semi"), name)


def set_components(sets: DataFrame, texts: DataFrame, how: Sketching) -> DataFrame:
    """Components of distinct sets under the link rule: (rep, component) for every set whose component is another's.

    ``sets`` has (rep, n_shingles, sketch) with one row per distinct set, ``texts`` (rep, text) of at least those.
    1. The bands are taken in portions. A bucket whose members are known to be in different components names the member
    with the least hash; the others are paired with it, likely pairs are verified, and components grow: copies of one text
    settle in the first few bands and never meet again. 2. Members of buckets that still hold several components are compared
    by registers, block against block inside tasks; components that a likely pair would join form a cluster. 3. Those members of
    a cluster are compared on their full sets, again block against block. No bucket is capped and none is written out as pairs:
    tasks hand on forests, fewer rows than members."""
    labels, rest = None, None
    likely = _likely(how)
    for turn, (low, high) in enumerate(how.portions):
        keyed = _named(labels, sets.select("rep", F.explode(band_keys(F.col("sketch"), how, low, high)).alias("b")).select("rep", "b.*"))
        chosen = stored(keyed.groupBy("key").agg(
            F.min(F.struct(F.xxhash64("rep", F.lit(turn)), "rep", "component")).alias("to"),
            F.min("component").alias("low"), F.max("component").alias("high"),
        ).filter("low <> high").select("key", F.col("to.rep").alias("to"), F.col("to.component").alias("to_component")), "chosen")
        met = stored(keyed.join(measured(chosen), "key"), "met")
        rest = met.select("rep", "band", "key") if rest is None else rest.unionByName(met.select("rep", "band", "key"))
        if not how.rounds:
            continue
        pairs = stored(met.filter("component <> to_component").groupBy(
            F.least("rep", "to").alias("a"), F.greatest("rep", "to").alias("b")
        ).agg(F.min("component").alias("part"), F.min("to_component").alias("to_part")), "pairs")
        parts = pairs.select("a", "b", "part", "to_part")
        held = _of(sets.select("rep", "n_shingles", "sketch"), pairs.select(F.explode(F.array("a", "b")).alias("rep")), "held")
        side = lambda name: held.select(
            F.col("rep").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}")
        )
        able = parts.join(side("a"), "a").join(side("b"), "b").filter(likely("sketch_a", "sketch_b", "n_a", "n_b"))
        able = stored(able.select("a", "b", "part", "to_part"), "able")
        read = _of(texts.select("rep", "text"), able.select(F.explode(F.array("a", "b")).alias("rep")), "texts")
        sure = stored(verified(able.select("a", "b"), read, how).join(able, ["a", "b"]).select(
            F.col("part").alias("a"), F.col("to_part").alias("b")).distinct(), "links")
        labels = _relabelled(labels, sure)

    state = stored(_named(labels, rest), "state")
    spans = stored(state.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")
    ).filter("low <> high").select("key", F.ceil(F.col("n") / how.block).cast("int").alias("blocks")), "spans")
    if spans.isEmpty():
        return labels if labels is not None else state.select("rep", "component").limit(0)
    open_ = stored(state.join(measured(spans.select("key")), "key", "left_semi"), "open")
    held = _of(sets.select("rep", "n_shingles", "sketch"), open_.select("rep"), "held")
    facing = _blocks(open_.select("rep", "component", "band", "key"), spans, "key").join(held, "rep")
    unsure = stored(facing.groupBy("key", "left", "right").applyInPandas(_apart(how), "a long, b long").distinct(), "unsure")
    clusters = stored(components(unsure).select(F.col("node").alias("component"), F.col("component").alias("cluster")), "clusters")
    inside = stored(open_.select("rep", "component").distinct().join(measured(clusters), "component"), "inside")
    sizes = stored(inside.groupBy("cluster").agg(F.ceil(F.count("*") / how.text_block).cast("int").alias("blocks")), "sizes")
    read = _of(texts.select("rep", "text"), inside.select("rep"), "texts")
    shown = _blocks(inside, sizes, "cluster").join(held, "rep").join(read, "rep")
    late = stored(shown.groupBy("cluster", "left", "right").applyInPandas(_joined(how), "a long, b long"), "late")
    known = inside.select("rep", "component")
    sure = verified(late, read, how)
    for name in ("a", "b"):
        sure = sure.join(known.select(F.col("rep").alias(name), F.col("component").alias(f"part_{name}")), name)
    labels = _relabelled(labels, stored(sure.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")).distinct(), "links"))
    return labels if labels is not None else state.select("rep", "component").limit(0)


def near_duplicates(docs: DataFrame, how: Sketching = Sketching()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are lower-cased in A-Z; a document's set holds its distinct shingles, or the whole sequence if it is shorter;
    null, empty or blank texts have the empty set and link with nothing. Documents with equal sets are one class, stood for
    by the least id; classes link by the rule on their full sets. component_id is the least id reachable, kept marks
    the rows that have it. Rows repeated with one id get equal results (with different
    texts they count as one document with several texts); a null id stays null, links through its
    class, and is kept if it has no set or its class has no other id. Extra columns are ignored."""
    return grouped(docs, sketched(F.col("text"), how), how)


def grouped(docs: DataFrame, sketch_of_text: Column, how: Sketching) -> DataFrame:
    """``near_duplicates`` with the sketches that ``sketch_of_text`` gives: struct of n_shingles, set_key, sketch."""
    table = stored(docs.select("doc_id", sketch_of_text.alias("s")).select("doc_id", "s.*"), "sketches")
    classes = stored(
        table.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(
            F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch")
        ), "classes",
    )
    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    found = set_components(classes.select("rep", "n_shingles", "sketch"), texts, how)
    named = classes.join(found, "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("class_component")
    )
    joined = table.join(named, "set_key", "left")
    component = F.coalesce("class_component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    )


def without_near_duplicates(docs: DataFrame, how: Sketching = Sketching()) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the least id. Columns and texts stay as they are.

    Rows without a set or without an id stay; of rows repeated with one kept id one stays."""
    kept = near_duplicates(docs, how).filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_times"))
    kept = stored(kept, "kept")
    repeated = kept.filter("_times > 1").select("doc_id")
    single = docs.join(measured(kept.filter("_times = 1").select("doc_id")), "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
    if repeated.isEmpty():
        return single
    return single.unionByName(docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
