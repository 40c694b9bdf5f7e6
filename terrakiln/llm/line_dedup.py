"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakiln.llm.common import attach, checkpointed, empty_if_null, without

#: A host's list of boilerplate digests is broadcast up to this many digests in all.
BROADCAST_DIGESTS = 200_000


def _digest(line):
    return F.xxhash64(F.trim(line))


def boilerplate(df: DataFrame, host: str, text: str, min_pages: int, max_ratio: float) -> DataFrame:
    """One row per host with lines that more than `max_ratio` of its pages (and `min_pages` at least) contain.

    Columns: _host, _drop (array of line digests), _pages. Each page counts once for a line, and a page has L lines,
    so a host has at most L / max_ratio such lines: the arrays are bounded by the pages' mean length.
    """
    pages = df.select(empty_if_null(F.col(host)).alias("_host"), F.col(text).alias("_text"))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: F.trim(x) != "")
    per_line = (
        pages.select("_host", F.explode(F.array_distinct(F.transform(lines, _digest))).alias("_line"))
        .groupBy("_host", "_line")
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") >= min_pages)
    )
    totals = pages.groupBy("_host").agg(F.count("*").alias("_pages"))
    return (
        per_line.join(totals, "_host")
        .where(F.col("_n") > F.lit(max_ratio) * F.col("_pages"))
        .groupBy("_host")
        .agg(F.sort_array(F.collect_list("_line")).alias("_drop"), F.max("_pages").alias("_pages"))
    )


def drop_boilerplate(
    df: DataFrame, host: str = "host", text: str = "text", min_pages: int = 3, max_ratio: float = 0.05
) -> DataFrame:
    """`df` with the boilerplate lines of each host cut from `text`, and long columns n_lines, n_dropped.

    Lines end at a newline and compare without spaces at their ends; a line counts once for each page (row).
    A line goes, wherever it stands, if at least `min_pages` pages of its host and more than `max_ratio` of
    them have it. Blank lines stay. A null host is the host ''; a null text has no lines and stays null; a
    text that loses every line is ''. Repeated rows are pages of their own. Input columns named n_lines or
    n_dropped are replaced; one named _host, _drop, _lines or _kept raises ValueError.
    """
    if clash := sorted({c.lower() for c in df.columns} & {"_host", "_drop", "_lines", "_kept"}):
        raise ValueError(f"columns in the way: {clash}")
    found = checkpointed(boilerplate(df, host, text, min_pages, max_ratio))
    digests = found.agg(F.coalesce(F.sum(F.size("_drop")), F.lit(0))).first()[0]
    out = without(df, "n_lines", "n_dropped").withColumn("_host", empty_if_null(F.col(host)))
    if digests <= BROADCAST_DIGESTS:
        out = out.join(F.broadcast(found.drop("_pages")), "_host", "left")
    else:  # a large host's pages are dealt over several tasks
        out = attach(out, found, ["_host"], "_pages", "left", 0)
    out = out.withColumn("_lines", F.split(F.col(text), "\n"))
    kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(
        F.filter("_lines", lambda x: (F.trim(x) == "") | ~F.array_contains("_drop", _digest(x)))
    )
    out = out.withColumn("_kept", kept)
    n_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long")
    n_kept = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size("_kept")).cast("long")
    return out.select(
        *[
            (F.array_join("_kept", "\n").alias(c) if c == text else F.col(f"`{c}`"))
            for c in df.columns
            if c.lower() not in ("n_lines", "n_dropped")
        ],
        n_lines.alias("n_lines"),
        (n_lines - n_kept).alias("n_dropped"),
    )
