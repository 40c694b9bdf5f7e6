"""SimHash near-duplicates, linked by anchor points of a covering code."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrakiln.llm.common import attach, checkpointed, stored
from terrakiln.llm.components import components

SEED = 42
SHINGLE = 4
THRESHOLD = 4
#: The fingerprint's blocks: first bit, width. Four differing bits leave one bit at most in one of three
#: blocks, so the threshold within a block is 1.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: In each block the anchors are a Hamming code on 15 bits times all words on the other bits: its covering
#: radius is 1. Bit j of the 15 has the syndrome j + 1.
CODED = 15
#: Groups at one anchor up to this size are compared in vector steps over the whole batch.
SMALL_GROUP = 128


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of the text's shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    n = len(words) - size + 1
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    counts = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, 1 << 16):
        h = np.array([digest(join(words[i : i + size]), SEED) for i in range(at, min(n, at + (1 << 16)))], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint's 64 bits as a signed long."""
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1).cast(pa.binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return source.mapInArrow(run, T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("fp", T.LongType())]))


def _patterns(width: int) -> list[list[int]]:
    """By syndrome: the error patterns of weight 2 or less in a block of `width` bits that have it."""
    syndrome = [j + 1 if j < CODED else 0 for j in range(width)]
    out: list[list[int]] = [[] for _ in range(16)]
    for weight in range(3):  # covering radius 1 plus threshold 1
        for bits in combinations(range(width), weight):
            s = 0
            for j in bits:
                s ^= syndrome[j]
            out[s].append(sum(1 << j for j in bits))
    return out


def _anchors(fp: Column, k: int) -> Column:
    """Array of the anchors of block `k` within distance 2 of the fingerprint's bits there, the block's number on top."""
    first, width = BLOCKS[k]
    word = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    syndrome = F.lit(0)
    for bit in range(4):
        mask = sum(1 << j for j in range(CODED) if (j + 1) >> bit & 1)
        syndrome = syndrome + F.bit_count(word.bitwiseAND(F.lit(mask).cast("long"))) % 2 * (1 << bit)
    table = F.array(*[F.array(*[F.lit(e | k << 32).cast("long") for e in own]) for own in _patterns(width)])
    return F.transform(F.element_at(table, syndrome + 1), lambda e: e.bitwiseXOR(word))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one word, or of several words in the last axis of two."""
    bits = np.bitwise_count(a ^ b)
    return bits if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int64)


def _close_in_large(fps: np.ndarray, threshold: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of one group: a search that takes each node out once it is reached."""
    left = np.arange(len(fps))
    while len(left):
        root, left = left[0], left[1:]
        stack = [root]
        while stack and len(left):
            near = _apart(fps[left], fps[stack.pop()]) <= threshold
            if near.any():
                for j in left[near]:
                    yield root, j
                stack.extend(left[near])
                left = left[~near]


def _close_in_small(keys: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[list[np.ndarray], list[np.ndarray], list[tuple[int, int]]]:
    """Close pairs (two lists of index arrays) in groups of equal keys (sorted) of up to SMALL_GROUP, and the larger groups (start, size)."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    ends = np.repeat(starts + sizes, sizes)
    found_a, found_b = [], []
    active = np.flatnonzero(np.repeat(sizes <= SMALL_GROUP, sizes))
    for step in range(1, SMALL_GROUP):
        active = active[active + step < ends[active]]
        if not len(active):
            break
        near = _apart(fps[active], fps[active + step]) <= threshold
        found_a.append(active[near])
        found_b.append(active[near] + step)
    large = sizes > SMALL_GROUP
    return found_a, found_b, list(zip(starts[large].tolist(), sizes[large].tolist(), strict=True))


def _pieces(block: int, threshold: int) -> list[np.uint64]:
    """Masks of `threshold` + 1 pieces of the bits outside the block: fingerprints that are close agree on one of them."""
    first, width = BLOCKS[block]
    bits = [b for b in range(64) if not first <= b < first + width]
    return [np.uint64(sum(1 << b for b in bits[k :: threshold + 1])) for k in range(threshold + 1)]


def _forest(keys: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked within each group of equal keys (sorted), a group's size at most.

    A group over SMALL_GROUP is split again, by its values on each piece outside its block.
    """
    found_a, found_b, large = _close_in_small(keys, fps, threshold)
    for at, size in large:
        own = fps[at : at + size]
        for mask in _pieces(int(keys[at]) >> 32, threshold):
            order = np.argsort(own & mask)
            near_a, near_b, rest = _close_in_small((own & mask)[order], own[order], threshold)
            for start, n in rest:
                edges = np.array(list(_close_in_large(own[order[start : start + n]], threshold)), np.int64).reshape(-1, 2) + start
                near_a.append(edges[:, 0])
                near_b.append(edges[:, 1])
            found_a += [at + order[x] for x in near_a]
            found_b += [at + order[x] for x in near_b]
    label = _least_reached(len(keys), found_a, found_b)
    moved = np.flatnonzero(label != np.arange(len(keys)))
    return fps[moved], fps[label[moved]]


def _least_reached(n: int, found_a: list[np.ndarray], found_b: list[np.ndarray]) -> np.ndarray:
    """For each of n rows the least one that its links reach, by repeated minimum."""
    label = np.arange(n)
    if found_a:
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        while len(a):
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == before).all():
                break
    return label


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all pairs within `threshold` bits.

    Every fingerprint goes to all anchors within covering radius plus threshold of each block (14.5 to 16 a
    block); two that differ in 4 bits or fewer share the first one's nearest anchor in some block. At an
    anchor all are compared on 64 bits, and what is linked there comes out as a forest: the rows out never
    outnumber the rows in, however large a group of near copies is.
    """
    if threshold > THRESHOLD:
        raise ValueError(f"the code covers {THRESHOLD} bits")
    every = F.concat(*[_anchors(F.col("fp"), k) for k in range(len(BLOCKS))])
    dealt = fps.select("fp", F.explode(every).alias("anchor")).repartition("anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, keys in whole_groups(batches, key=1):
            a, b = _forest(keys, own.view(np.uint64), threshold)
            pairs = np.unique(np.stack([a, b]).view(np.int64), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 0, rows: int = 200_000) -> Iterator[list[np.ndarray]]:
    """The columns of about so many rows at a time, sorted by column `key`, without cutting a group of equal keys."""
    held: list[list[np.ndarray]] = []
    n, full = 0, rows
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        n += batch.num_rows
        if n >= full:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[key], whole[key][-1]))  # the last group may go on
            if cut:
                yield [c[:cut] for c in whole]
            held, n = [[c[cut:] for c in whole]], n - cut
            full = max(rows, 2 * n)
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


#: Fingerprints of several words for similarities: bits in all, and samples of them with an anchor each.
WIDE_WORDS = 4
SAMPLES, SAMPLE_BITS = 48, 19
SAMPLED = np.array([np.random.RandomState(SEED + k).permutation(64 * WIDE_WORDS)[:SAMPLE_BITS] for k in range(SAMPLES)])


def bits_at(similarity: float) -> int:
    """How many of the bits of a wide fingerprint two shingle sets of equal size with this Jaccard similarity let differ, as expected."""
    return int(64 * WIDE_WORDS * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def wide_fingerprint(text: bytes | None, size: int) -> np.ndarray:
    """WIDE_WORDS unsigned longs, the SimHash of the text's different shingles; all 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(WIDE_WORDS, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - size + 1)
    h = np.unique(np.fromiter((digest(join(words[i : i + size]), SEED) for i in range(n)), np.uint64, n))
    counts = np.zeros(64 * WIDE_WORDS, np.int64)
    for at in range(0, len(h), 1 << 14):
        x = h[at : at + (1 << 14), None] + np.arange(WIDE_WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)


def nearest_anchors(fps: np.ndarray) -> np.ndarray:
    """(rows, SAMPLES): for each sample the nearest anchor of its bits, the sample's number on top.

    Anchors are the Hamming code on CODED of the bits times all words on the rest; it is perfect, so each
    fingerprint has exactly one anchor within the covering radius 1.
    """
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")[:, SAMPLED].astype(np.int64)
    syndrome = np.bitwise_xor.reduce(bits[:, :, :CODED] * np.arange(1, CODED + 1), axis=2)
    word = (bits << np.arange(SAMPLE_BITS)).sum(axis=2)
    return np.where(syndrome > 0, word ^ 1 << np.maximum(syndrome - 1, 0), word) | np.arange(SAMPLES) << SAMPLE_BITS


def similar_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for every row of `df`: near copies by the Jaccard similarity of their word shingles.

    Sets of `size`-word shingles (fewer words: the whole text) link when their wide fingerprints differ in
    `bits_at(similarity)` bits or fewer, as sets of that similarity do on average. Each fingerprint stands at its
    nearest anchor in each of SAMPLES samples of its bits, and all at one anchor are compared on all bits. Of pairs
    within the bits about 1 in 100 shares no anchor at similarity 0.8, 1 in 160 at 0.85, 1 in 800 at 0.9. What is linked
    at an anchor comes out as a forest. Equal fingerprints collapse first. component_id is the least doc_id
    reachable. Texts without words, null included, are alike. Null ids, repeated rows and other columns as in
    `near_duplicates`.
    """
    threshold = bits_at(similarity)
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    words = [f"f{k}" for k in range(WIDE_WORDS)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([wide_fingerprint(x.as_py(), size) for x in batch.column(1).cast(pa.binary())], np.uint64).reshape(-1, WIDE_WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, k]) for k in range(WIDE_WORDS)]], names=["doc_id", *words])

    longs = [T.StructField(f, T.LongType()) for f in words]
    docs = stored(source.mapInArrow(made, T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), *longs])))
    distinct = docs.groupBy(*words).agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    distinct = checkpointed(distinct.withColumn("node", F.monotonically_increasing_id()))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                fps = np.stack([part.column(k + 1).to_numpy() for k in range(WIDE_WORDS)], axis=1)
                row = pa.array(np.repeat(np.arange(part.num_rows), SAMPLES))
                yield pa.RecordBatch.from_arrays([pa.array(nearest_anchors(fps).ravel()), *[c.take(row) for c in part.columns]], names=["anchor", "node", *words])

    placed = distinct.select("node", *words).mapInArrow(dealt, T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "node", *words)]))
    placed = placed.repartition("anchor").sortWithinPartitions("anchor")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[np.ndarray]) -> pa.RecordBatch:
            keys, nodes, fps = rows[0], rows[1], np.stack(rows[2:], axis=1).view(np.uint64)
            found_a, found_b, large = _close_in_small(keys, fps, threshold)
            for at, n in large:
                edges = np.array(list(_close_in_large(fps[at : at + n], threshold)), np.int64).reshape(-1, 2) + at
                found_a.append(edges[:, 0])
                found_b.append(edges[:, 1])
            label = _least_reached(len(keys), found_a, found_b)
            moved = np.flatnonzero(label != np.arange(len(keys)))
            pairs = np.unique(np.stack([nodes[moved], nodes[label[moved]]]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        for rows in whole_groups(batches):
            yield made(rows)

    roots = components(placed.mapInArrow(compared, "a long, b long"))
    marked = checkpointed(distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = checkpointed(marked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_nodes")))
    marked = checkpointed(attach(marked.select(*words, "root", "n"), least, ["root"], "n_nodes").select(*words, "component_id", "n"))
    return attach(docs, marked, words, "n").select("doc_id", "component_id")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, n_copies) for every row of `df`.

    Texts link at `THRESHOLD` or fewer differing bits; component_id is the least doc_id reachable. Equal
    fingerprints collapse before any comparison (n_copies: rows with the same one). A text without words,
    null included, has fingerprint 0, linked like any other. A null doc_id stays null and counts for no
    component_id unless its component has no other. Repeated rows come out as often as they come in;
    other columns are not read. Needs the checkpoint folder.
    """
    docs = checkpointed(fingerprints(df, doc_id, text))
    distinct = checkpointed(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies")))
    roots = components(links(distinct.select("fp")))
    marked = checkpointed(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = checkpointed(marked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    marked = checkpointed(attach(marked.select("fp", "root", "n_copies"), least, ["root"], "n").select("fp", "component_id", "n_copies"))
    found = attach(docs, marked.withColumn("n", F.col("n_copies")), ["fp"], "n")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")
