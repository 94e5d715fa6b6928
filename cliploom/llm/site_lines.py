"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.llm.storage import BROADCAST_ROWS, stored

#: A line goes when it stands in more than this share of its site's pages ...
MAX_RATIO = 0.1
#: ... and in at least this many of them.
MIN_PAGES = 3


def _key(line: Column) -> Column:
    """What makes two lines equal: the text without blanks at its ends; null for a blank line."""
    return F.nullif(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), F.lit(""))


def boilerplate_lines(
    docs: DataFrame, site: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(site, line): for each site the 64-bit hashes of the lines that too many of its pages contain.

    A page counts once for a line however often it repeats it; null site is a site of its own; a page with null text
    counts as a page without lines. They are few: pages hold so many lines, so at most
    (lines per page) / ``max_ratio`` lines of a site can pass."""
    pages = docs.groupBy(F.col(site).alias("site")).agg(F.count("*").alias("pages"))
    keys = F.array_distinct(F.transform(F.split(text, "\n"), lambda x: F.when(_key(x).isNotNull(), F.xxhash64(_key(x)))))
    lines = docs.select(F.col(site).alias("site"), F.explode(F.array_compact(keys)).alias("line"))
    counted = lines.groupBy("site", "line").agg(F.count("*").alias("hits")).filter(F.col("hits") >= min_pages)
    return (
        counted.alias("c").join(pages.alias("p"), F.expr("c.site <=> p.site"))
        .filter(F.col("hits") > F.lit(max_ratio) * F.col("pages")).select("c.site", "line")
    )


def drop_site_boilerplate(
    docs: DataFrame, site: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """``docs`` with the boilerplate lines of their site cut from the text; ``n_chars``, if there, follows a text that changed.

    Other columns stay as they are, whatever their names; ``counts`` names two columns to add, for the lines of a text and the
    lines dropped. Other lines keep their order and spelling; a text without boilerplate stays as it is, null stays null,
    a page of boilerplate only becomes the empty text, and no rows give no rows. Counting shuffles (site, hash)
    pairs after a partial count. The lines found are written and counted: up to the bound of ``storage`` they are
    broadcast and no text moves, beyond it sites and their lists are joined and a hot site is split by the adaptive skew join."""
    lines = stored(boilerplate_lines(docs, site, text, max_ratio, min_pages), "boilerplate")
    marks = lines.groupBy("site").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    if lines.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    # the input row travels as one struct, so no name of its columns can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    body = F.col("row").getField(text)
    parts = F.split(body, "\n")
    keep = F.filter(parts, lambda x: _key(x).isNull() | ~F.array_contains(F.col("lines"), F.xxhash64(_key(x))))
    joined = rows.join(marks, F.col("row").getField(site).eqNullSafe(F.col("site")), "left")
    judged = joined.select(
        "row", F.when(F.col("lines").isNotNull() & body.isNotNull(), keep).alias("kept"),
        F.coalesce(F.when(body.isNotNull(), F.size(parts)), F.lit(0)).cast("long").alias("all"),
    ).withColumn("gone", F.coalesce(F.col("all") - F.size("kept"), F.lit(0)).cast("long")).withColumn(
        "body", F.when(F.col("gone") > 0, F.array_join("kept", "\n")).otherwise(body)
    )
    out = {c: F.col("row").getField(c) for c in docs.columns} | {text: F.col("body")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("gone") > 0, F.length("body").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    if counts:
        out |= {counts[0]: F.col("all"), counts[1]: F.col("gone")}
    return judged.select(*[v.alias(c) for c, v in out.items()])
