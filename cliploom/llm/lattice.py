"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 points, neighbouring cells probed,
cosine verified in double precision."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.components import components, forest
from cliploom.llm.storage import stored
from cliploom.llm.words import mixed


@dataclass(frozen=True)
class Lattice:
    """Tables of projections, neighbouring cells probed in each, and the cell size against the projected unit vectors.

    At a cosine of 0.98 a table misses a pair of 64 dimensions with a chance of 0.1, so six miss it once in a million;
    closer pairs are safer."""

    cosine: float = 0.98
    tables: int = 6
    probes: int = 16
    scale: float = 1.4
    seed: int = 10
    #: Members of a bucket compared in one task at a time.
    block: int = 1024


def minimal_vectors() -> np.ndarray:
    """The 240 shortest points of E8, from their rule: two entries of one, or all of one half with an even number below 0."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            point = np.zeros(8)
            point[i], point[j] = s, t
            out.append(point)
    for signs in itertools.product((0.5, -0.5), repeat=8):
        if sum(s < 0 for s in signs) % 2 == 0:
            out.append(np.array(signs))
    return np.array(out)


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole entries of even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2)
    if len(odd):
        off = x[odd] - near[odd]
        worst = np.abs(off).argmax(1)
        near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the better of the whole and the half coset."""
    whole, half = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    better = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(better[:, None], half, whole)


def _cell_keys(points: np.ndarray, table: int, label: np.ndarray) -> np.ndarray:
    """64-bit names of lattice points, different by table and label."""
    with np.errstate(over="ignore"):
        h = mixed(label.astype(np.int64).view(np.uint64) + np.uint64((table + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        doubled = np.rint(2 * points).astype(np.int64).view(np.uint64)
        for k in range(8):
            h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + doubled[..., k])
    return h.view(np.int64)


def cells(unit: np.ndarray, label: np.ndarray, how: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector in each table (n, tables), and its nearest neighbouring cells (n, tables, probes)."""
    draw = np.random.Generator(np.random.PCG64(how.seed))
    shortest = minimal_vectors()
    home = np.empty((len(unit), how.tables), np.int64)
    around = np.empty((len(unit), how.tables, how.probes), np.int64)
    for t in range(how.tables):
        x = unit @ draw.standard_normal((unit.shape[1], 8)) * how.scale
        point = decode_e8(x)
        home[:, t] = _cell_keys(point, t, label)
        near = np.argpartition(-((x - point) @ shortest.T), how.probes, axis=1)[:, : how.probes]
        around[:, t] = _cell_keys(point[:, None, :] + shortest[near], t, np.repeat(label[:, None], how.probes, 1))
    return home, around


def _coded(vectors: DataFrame, how: Lattice) -> DataFrame:
    """Vectors with unit form and cell names; invalid ones are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["embedding"].map(len)
            for _, part in batch.groupby(lengths):
                raw = np.array([np.asarray(v, float) for v in part["embedding"]])
                if not raw.shape[1]:
                    continue
                with np.errstate(all="ignore"):
                    raw = raw / np.abs(raw).max(1, keepdims=True)
                    unit = raw / np.sqrt((raw * raw).sum(1, keepdims=True))
                good = np.isfinite(unit).all(1)
                unit, part = np.ascontiguousarray(unit[good]), part[good]
                home, around = cells(unit, part["label"].to_numpy(), how)
                yield pd.DataFrame({
                    "homes": [h.tobytes() for h in home], "arounds": [a.tobytes() for a in around], "rep": part["rep"].to_numpy(), "weight": part["weight"].to_numpy(), "unit": [u.tobytes() for u in unit],
                    "home": list(home), "around": [a.ravel() for a in around],
                })

    return vectors.select("rep", "weight", "label", "embedding").mapInPandas(
        run, "rep long, weight long, unit binary, homes binary, arounds binary, home array<long>, around array<long>"
    )


#: Groups up to this size are compared many at a time, larger ones by matrix products.
SMALL = 64
PAIRS = 2_000_000


def _candidates(rows: pd.DataFrame, unit: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs in one group (key, left, right) whose cosine reaches the limit, by pieces of bounded size."""
    group = rows["group"].to_numpy()
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((start, [len(group)])))
    own, last = np.repeat(size, size), np.repeat(start + size, size)
    follow = np.where(own <= SMALL, last - np.arange(len(group)) - 1, 0)  # later rows of the same group
    reach = np.cumsum(follow)
    low = 0
    while low < len(group):
        high = max(low + 1, int(np.searchsorted(reach, (reach[low - 1] if low else 0) + PAIRS, "right")))
        count = follow[low:high]
        i = np.repeat(np.arange(low, high), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        close = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine if len(i) else np.zeros(0, bool)
        yield i[close], j[close]
        low = high
    left, right, block = (rows[c].to_numpy() for c in ("left", "right", "block"))
    for k in np.flatnonzero(size > SMALL):
        at = np.arange(start[k], start[k] + size[k])
        first, second = at[block[at] == left[at]], at[block[at] == right[at]]
        i, j = np.nonzero(unit[first] @ unit[second].T >= cosine)
        i, j = first[i], second[j]
        ordered = (i < j) | (left[at[0]] != right[at[0]])
        yield i[ordered], j[ordered]


def _links(rows: pd.DataFrame, how: Lattice) -> pd.DataFrame:
    """Links inside whole groups of rows, as counts per vector and a forest of pairs.

    A bucket holds vectors at home in the cell and visitors that probe it. A pair is left to the first table where it meets,
    and there to the smaller of two cells, so it counts once."""
    rep, weight, key, table = (rows[c].to_numpy() for c in ("rep", "weight", "key", "table"))
    unit = np.frombuffer(b"".join(rows["unit"]), float).reshape(len(rows), -1)
    home = np.frombuffer(b"".join(rows["home"]), np.int64).reshape(len(rows), how.tables)
    around = np.frombuffer(b"".join(rows["around"]), np.int64).reshape(len(rows), how.tables, how.probes)
    at_home = home[np.arange(len(rows)), table] == key

    def meets(i, j, t):
        return home[i, t] == home[j, t], (around[i, t] == home[j, t, None]).any(1), (around[j, t] == home[i, t, None]).any(1)

    found = []
    for i, j in _candidates(rows, unit, how.cosine):
        fit = at_home[i] | at_home[j]
        i, j = i[fit], j[fit]
        for t in range(how.tables):
            same, out, back = meets(i, j, t)
            other = np.where(at_home[i], home[j, t], home[i, t])
            gone = np.where(table[i] > t, same | out | back, (table[i] == t) & ~same & out & back & (other < key[i]))
            i, j = i[~gone], j[~gone]
        found.append((i, j))
    i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    counts = np.bincount(i, weight[j], len(rows)) + np.bincount(j, weight[i], len(rows))
    kept, node = np.unique(rep, return_inverse=True)
    counts = np.bincount(node, counts, len(kept)).astype(np.int64)
    a, b = forest(node[i], node[j], len(kept))
    hit = np.flatnonzero(counts)
    return pd.DataFrame({
        "a": np.concatenate((kept[hit], kept[a])), "b": pd.array([None] * len(hit) + kept[b].tolist(), "Int64"),
        "n": np.concatenate((counts[hit], np.zeros(len(a), np.int64))),
    })


def _compared(how: Lattice):
    """Reads rows sorted by group and works on whole groups: a task holds a batch and the group it breaks off in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in batches:
            rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            last = (rows[["key", "left", "right"]] == rows[["key", "left", "right"]].iloc[-1]).all(axis=1)
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            waiting = rows.iloc[cut:].reset_index(drop=True)
            if cut:
                yield from whole(rows.iloc[:cut].reset_index(drop=True))
        if waiting is not None and len(waiting):
            yield from whole(waiting)

    def whole(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Vectors of one length at a time; groups never mix lengths that link."""
        names = rows[["key", "left", "right"]]
        rows["group"] = (names != names.shift()).any(axis=1).cumsum()
        for _, part in rows.groupby(rows["unit"].map(len), sort=False):
            yield _links(part.reset_index(drop=True), how)

    return run


def near_vectors(vectors: DataFrame, how: Lattice = Lattice()) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link when labels are equal and not null and their cosine is ``how.cosine`` or more. A null or zero vector, or one
    with a null, NaN or infinite component, links with nothing, nor do vectors of different length. Equal vectors of a label
    are one class that counts as many links as it has rows; rows repeated with one vec_id are rows like others. A bucket of
    any size is split into blocks that are compared pair by pair inside tasks; only counts and a forest leave them."""
    fine = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x)
    )
    rows = vectors.select("vec_id", "label", "embedding").withColumn("copy", F.when(fine, F.sha2(F.concat_ws(
        "|", F.col("label").cast("string"), F.array_join("embedding", ",")), 256)))
    classes = rows.filter("copy is not null").groupBy("copy").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.min("label").alias("label"), F.min("embedding").alias("embedding")
    )
    classes = stored(classes, "classes")
    coded = stored(_coded(classes, how), "coded")
    homes = coded.select("rep", F.posexplode("home").alias("table", "key"), F.lit(1).alias("own"))
    visits = coded.select("rep", F.posexplode("around").alias("place", "key"), F.lit(0).alias("own")).select(
        "rep", F.floor(F.col("place") / how.probes).cast("int").alias("table"), "key", "own"
    )
    places = homes.unionByName(visits)
    crowded = places.groupBy("key").agg(F.sum("own").alias("own"), F.count("*").alias("n")).filter("own > 0 and n > 1").select(
        "key", F.ceil(F.col("n") / how.block).cast("int").alias("blocks")
    )
    members = places.select("rep", "table", "key").join(crowded, "key").withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    )
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(o, F.col("block")).alias("left"), F.greatest(o, F.col("block")).alias("right")
    ))
    spread = members.select("rep", "table", "key", "block", F.explode(others).alias("pair")).join(
        coded.select("rep", "weight", "unit", "homes", "arounds"), "rep"
    ).select("rep", "weight", "unit", F.col("homes").alias("home"), F.col("arounds").alias("around"), "table", "key", "block",
             "pair.left", "pair.right")
    grouped = spread.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "rep")
    found = stored(grouped.mapInPandas(_compared(how), "a long, b long, n long"), "found")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    parts = components(found.filter("b is not null").select("a", "b"))
    named = classes.select("copy", "rep", "weight").join(coded.select("rep", F.lit(True).alias("valid")), "rep", "left").join(
        counts, "rep", "left"
    ).join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").filter("valid").select(
        "copy", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    return rows.join(named, "copy", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
