"""Mixing sources to target weights: hash-random order in each source, distributed prefix sums, exact budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cliploom.llm.ranges import prefix_sums
from cliploom.llm.storage import measured, stored
from cliploom.llm.words import _SPACE

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
_BLANK = bytes(i for i in range(256) if _SPACE[i]).decode()


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS
) -> DataFrame:
    """One row per source of ``rows`` (source, size): source_size, ``before`` (sizes of sources ahead), target.

    Sources in code point order, null last, carry the weights in turn. Targets share ``share`` of all sizes by weight;
    none exceeds ``epochs`` times its source, and the excess goes to the others by weight. That is the level at which
    ``least(epochs * size, level * weight)`` sums to the budget: with sources ordered by how soon they fill up, prefix
    sums give the level of each possible cut, and the first source that does not fill at its level decides."""
    order = [F.col("source").asc_nulls_last()]
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = prefix_sums(sizes, order, {"before": F.col("source_size"), "place": F.lit(1)})
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighted = ranked.withColumn("weight", F.get(cycle, (F.col("place") % len(weights)).cast("int")).cast("long"))
    filling = weighted.withColumns({"cap": F.lit(epochs) * F.col("source_size")}).withColumn(
        "fills_at", F.col("cap") / F.col("weight")
    )
    cut = prefix_sums(filling, [F.col("fills_at"), F.col("place")], {"full": F.col("cap"), "spent": F.col("weight")})
    cut = stored(cut, "sources")
    all_size, all_weight = cut.agg(F.sum("source_size"), F.sum("weight")).first()
    level = F.lit(None).cast("double")
    if all_size:
        at = (F.lit(share * all_size) - F.col("full")) / (F.lit(all_weight) - F.col("spent"))
        level = F.lit(cut.withColumn("level", at).filter("fills_at >= level").agg(
            F.min_by("level", F.struct("fills_at", "place"))).first()[0]).cast("double")
    cap = F.col("cap").cast("double")
    return cut.select(
        "source", "source_size", "before", F.round(F.coalesce(F.least(cap, level * F.col("weight")), cap), 6).alias("target")
    )


def mix_plan(
    docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
    epochs: int = EPOCHS, seed: str = SEED,
) -> DataFrame:
    """What the mix takes of each row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken.

    Rows of a source stand in the order of a keyed hash of their id; the source gives ``floor(target)`` words: whole
    epochs first, then rows from the front, and the row at the cut gives the words still missing. Null source is a
    source of its own, null or wordless texts have size 0 and give nothing, rows with one id keep a fixed order by size.
    Extra columns are ignored; no rows give no rows. One range sort carries ids and sizes only, so a source of any
    share of the rows is spread over all tasks."""
    rows = stored(docs.select("doc_id", "source", (word_count(F.col("text")) if size is None else size).alias("size")), "sizes")
    targets = stored(source_targets(rows, weights, share, epochs), "targets")
    keyed = rows.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size")]
    placed = prefix_sums(keyed, order, {"reached": F.col("size")})
    budget = F.floor("target").cast("long")
    turns = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - turns * F.col("source_size") - (F.col("reached") - F.col("before"))
    return placed.alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source")).select(
        "doc_id", F.col("p.source").alias("source"), "size", "source_size", "target",
        (turns * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))).cast("long").alias("taken"),
    )


@F.pandas_udf(StringType())
def first_words(text: pd.Series, count: pd.Series) -> pd.Series:
    """The text up to and with its ``count``-th word."""

    def cut(t, n):
        at = 0
        for end in _ends(t, n):
            at = end
        return t[:at]

    return pd.Series([cut(t, n) for t, n in zip(text, count)], dtype=object)


def _ends(text: str, count: int):
    """Ends of the first ``count`` words."""
    inside = False
    for at, char in enumerate(text):
        if char in _BLANK:
            if inside:
                yield at
                count -= 1
                if not count:
                    return
            inside = False
        else:
            inside = True
    if inside:
        yield len(text)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: each row as often as the mix takes it whole, and the row at a source's cut shortened to the words
    still missing. Columns stay as they are, whatever their names, ``n_chars`` follows the text. Rows that share id, source and
    size share what they take evenly; null sources and ids are values of their own, null and wordless texts are not
    taken, and no rows give no rows."""
    plan = mix_plan(docs, **options).groupBy("doc_id", "source", "size").agg(
        F.floor(F.sum("taken") / F.count("*")).cast("long").alias("taken")
    )
    taken = measured(stored(plan.filter("taken > 0"), "taken"))
    # the input row travels as one struct, so no name of its columns can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), word_count(F.col("text")).alias("words"))
    joined = rows.join(taken, F.expr("row.doc_id <=> doc_id and row.source <=> source and words = size"))
    turns = F.concat(
        F.array_repeat(F.lit(None).cast("long"), F.floor(F.col("taken") / F.col("size")).cast("int")),
        F.when(F.col("taken") % F.col("size") > 0, F.array(F.col("taken") % F.col("size"))).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    spread = joined.select("row", F.explode(turns).alias("cut"))
    as_were = {c: F.col("row").getField(c) for c in docs.columns}
    whole = spread.filter("cut is null").select(*[v.alias(c) for c, v in as_were.items()])
    part = spread.filter("cut is not null").withColumn("short", first_words(F.col("row.text"), F.col("cut")))
    changed = as_were | {"text": F.col("short")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("short").cast(docs.schema["n_chars"].dataType)
    return whole.unionByName(part.select(*[v.alias(c) for c, v in changed.items()]))
