"""Sharding by a Feistel permutation of global row numbers, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrakiln.llm.common import checkpointed, empty_if_null

#: Rows are numbered bucket by bucket; the buckets' offsets, so many rows at most, are broadcast.
BUCKETS = 4096
ROUNDS = 6
MASK = 0xFFFFFFFF


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """One 31-bit key a round."""
    out, x = [], seed & MASK
    for _ in range(rounds):
        x = (x * 1103515245 + 12345) & MASK
        out.append((x ^ x >> 15) & 0x7FFFFFFF)
    return out


def _scrambled(x: Column, key: Column) -> Column:
    """A 32-bit mix of a half (below 2^31) and a key; every product stays below 2^63."""
    low = F.lit(0x7FFFFFFF).cast("long")
    a = ((x + key).bitwiseAND(low) * F.lit(1597334677).cast("long")).bitwiseAND(F.lit(MASK))
    a = a.bitwiseXOR(F.shiftright(a, 15)).bitwiseAND(low)
    b = (a * F.lit(1103515245).cast("long")).bitwiseAND(F.lit(MASK))
    return b.bitwiseXOR(F.shiftright(b, 13))


def halves(rows: int) -> tuple[int, int]:
    """The sides a, b of the grid that the permutation works on: a * b is at least `rows`, by less than a."""
    a = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    return a, max(1, -(-rows // a))


def permuted(number: Column, rows: int, seed: int) -> Column:
    """Where row `number` of `rows` goes: alternating unbalanced Feistel rounds modulo a and b, then cycle walking.

    Fewer than a of the a * b cells lie outside, so a walk has that many steps at most; 16 are tried, and a
    longer walk (a chance below (1 / sqrt(rows))^16 in a large table) raises an error.
    """
    a, b = halves(rows)
    keys = F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(i % 2 == 0).alias("left")) for i, k in enumerate(round_keys(seed))])

    def once(v: Column) -> Column:
        left = F.call_function("div", v, F.lit(b)).cast("long")
        state = F.struct(left.alias("l"), (v % F.lit(b)).cast("long").alias("r"))
        return F.aggregate(
            keys,
            state,
            lambda s, k: F.struct(
                F.when(k["left"], (s["l"] + _scrambled(s["r"], k["key"])) % F.lit(a)).otherwise(s["l"]).cast("long").alias("l"),
                F.when(k["left"], s["r"]).otherwise((s["r"] + _scrambled(s["l"], k["key"])) % F.lit(b)).cast("long").alias("r"),
            ),
            lambda s: s["l"] * F.lit(b) + s["r"],
        )

    steps = F.sequence(F.lit(1), F.lit(max(1, min(a * b - rows + 1, 16))))
    out = F.aggregate(steps, number.cast("long"), lambda v, i: F.when((i > 1) & (v < rows), v).otherwise(once(v)))
    return F.aggregate(F.array(out), F.lit(0).cast("long"), lambda _, v: F.when(v < rows, v).otherwise(F.raise_error(F.lit("a cycle walk did not end"))))


def numbered(df: DataFrame, key: str, ties: list[Column]) -> DataFrame:
    """`df` with long column _number from 0, in an order that only the rows' contents decide.

    Buckets by a hash of the key and `ties`, within them the key (null first) and `ties`. The buckets are
    counted first, their offsets broadcast (BUCKETS rows at most). Rows without a key are spread by their
    ties; only rows alike in all of these share a bucket whatever their number.
    """
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(f"`{key}`"), *ties), F.lit(BUCKETS)).cast("int"))
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_bucket").orderBy(F.col(f"`{key}`"), *ties)
    rows = rows.withColumn("_rank", F.row_number().over(within)).join(F.broadcast(offsets), "_bucket")
    return rows.withColumn("_number", F.col("_offset") + F.col("_rank") - 1).drop("_bucket", "_rank", "_offset")


def refuse(df: DataFrame, *names: str) -> None:
    """ValueError if `df` has a column that the operator needs on its way."""
    if clash := sorted({c.lower() for c in df.columns} & set(names)):
        raise ValueError(f"columns in the way: {clash}")


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, seed: int = 20_11) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard, number) for every row; the law is `rows`.

    The permuted number p of a row gives shard p mod `shards` and slot p div `shards`: counts differ by one
    at most and slots have no gap. Anyone can compute both from `number`, the row count and the seed.
    size: bytes of the text in UTF-8 and 8 more; a null text counts as empty, a null key sorts first.
    Rows with equal keys and texts are interchangeable and each gets its own slot; other columns are not read.
    """
    value = empty_if_null(F.col(text))
    slim = checkpointed(
        df.select(
            F.col(f"`{key}`"),
            (F.octet_length(value).cast("long") + 8).alias("size"),
            F.crc32(F.encode(value, "UTF-8")).cast("long").alias("text_crc32"),
            F.xxhash64(value).alias("_tie"),
        )
    )
    total = slim.count()
    place = permuted(F.col("_number"), total, seed)
    return (
        numbered(slim, key, [F.col("size"), F.col("text_crc32"), F.col("_tie")])
        .withColumn("_place", place)
        .select(
            key,
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            (F.col("_place") % shards).cast("int").alias("shard"),
            F.call_function("div", F.col("_place"), F.lit(shards)).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            F.col("_number").cast("long").alias("number"),
        )
    )


def shuffled(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, seed: int = 20_11) -> DataFrame:
    """All columns of `df` with size, text_crc32, law, shard and slot: rows take the places of `assign`.

    Rows meet their places by key, size and checksum of the text and their number among equal ones. Columns named
    _k, _c, _s or _i raise ValueError.
    """
    refuse(df, "_k", "_c", "_s", "_i")
    same = ["_k", "_c", "_s", "_i"]
    of = Window.partitionBy("_k", "_c", "_s")
    places = assign(df, key, text, shards, seed)
    places = places.withColumns({"_k": F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-1)), "_c": F.col("text_crc32"), "_s": F.col("size")}).drop(key, "grown_shard", "number")
    places = places.withColumn("_i", F.row_number().over(of.orderBy("shard", "slot")))
    value = empty_if_null(F.col(text))
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("size", "text_crc32", "law", "shard", "slot")])
    rows = rows.withColumns({"_k": F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-1)), "_c": F.crc32(F.encode(value, "UTF-8")).cast("long"), "_s": F.octet_length(value).cast("long") + 8})
    rows = rows.withColumn("_i", F.row_number().over(of.orderBy("_k")))
    return rows.join(places, same).drop(*same)
