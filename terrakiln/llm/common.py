"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word: space, tab, newline, vertical tab, form feed, return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder in spark.checkpoint.dir and cut its lineage.

    A temporary folder serves only where the setting is empty and Spark runs in one process.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Parquet options for rows of a megabyte and more: by default a page has 100 rows at least before its size is looked at,
#: and Snappy holds whole pages outside the heap.
WIDE_ROWS = {"compression": "zstd", "parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def stored(df: DataFrame, **options: str | int) -> DataFrame:
    """`checkpointed` as a Parquet table in the same folder, a fraction of the size; for tables as large as the corpus."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, set if need be."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without the columns that an operator is about to add (names compare as Spark compares them)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def empty_if_null(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def url_host(url: Column) -> Column:
    """The lower-case host of a URL without user and port; empty where there is none."""
    authority = F.regexp_extract(empty_if_null(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(authority, r"^.*@|:[0-9]*$", ""))


#: A table of so many rows at most is broadcast by `attach`.
BROADCAST_ROWS = 10_000
#: A key of more rows than this, and than a ten-thousandth of all, is dealt over several tasks by `attach`.
HOT_ROWS = 1_000


def attach(rows: DataFrame, table: DataFrame, keys: list[str], n: str, how: str = "inner", broadcast_rows: int | None = None) -> DataFrame:
    """`rows` joined with `table`, which has one row a key and in column `n` (dropped) about how many of `rows` have it.

    `table` should be cheap to read again. Up to `broadcast_rows` (BROADCAST_ROWS) rows it is broadcast. A larger one is joined
    by key, where a hot key's row is repeated and its rows are dealt over the repetitions by a hash of their
    contents. At most 10,000 keys can be hot, so their list may be broadcast.
    """
    size, total = table.agg(F.count("*"), F.sum(n)).first()
    if size <= (BROADCAST_ROWS if broadcast_rows is None else broadcast_rows):
        return rows.join(F.broadcast(table.drop(n)), keys, how)
    most = max(HOT_ROWS, (total or 0) // 10_000)
    parts = F.ceil(F.col(n) / F.lit(most)).cast("int")
    hot = table.where(F.col(n) > most).select(*keys, parts.alias("_parts"))
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.col("_parts")).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.coalesce(part, F.lit(0))).drop("_parts")
    last = F.when(F.col(n) > most, parts - 1).otherwise(F.lit(0))
    copies = table.withColumn("_part", F.explode(F.sequence(F.lit(0), last))).drop(n)
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")
