"""Benchmark decontamination by a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakiln.llm.common import WIDE_ROWS, stored

WINDOW = 10
#: Items are searched in blocks of about so many bytes of text; a block's words are what is broadcast.
BLOCK_BYTES = 1_000_000
#: A segment of the index closes beyond so many words; a longer text is a segment of its own or closes one.
SEGMENT_WORDS = 200_000
#: So many places of the rarest terms are followed at once.
STEP = 1_000_000
#: Letters to lower case, all ASCII but letters and digits to a space; characters beyond ASCII stay as they are.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' ids and words, in blocks of bounded size; items without an id or words have no window."""
    block, size = [], 0
    for key, value in items.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        words = words_of(value.encode()) if value is not None and key is not None else []
        if words:
            block.append((key, words))
            size += len(value)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def segments(docs: DataFrame, gap: int) -> DataFrame:
    """The positional inverted index of all words of `docs` (doc_id, row, text), one row a segment.

    A segment holds the documents of some consecutive rows of a partition: docs (row, doc_id, words, and the
    place where it starts; documents are `gap` places apart, so that nothing near spans two), its terms, how
    many places each has, and the places, term after term and ascending. These three are packed (the terms
    with a space between them, which no word has, the numbers as 32 bits), so that the JVM moves bytes
    instead of unfolding some 100,000 values a row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch, first: int, counts: list[int], words: list[bytes]) -> pa.RecordBatch:
            own = batch.slice(first, len(counts))
            n = np.array(counts, np.int32)
            before = np.r_[0, np.cumsum(n[:-1])]
            starts = np.r_[0, np.cumsum(n[:-1] + gap)].astype(np.int32)
            coded = pa.array(words, pa.binary()).dictionary_encode()
            terms = coded.indices.to_numpy()
            places = (np.arange(len(words)) + np.repeat(starts - before, n)).astype(np.int32)
            sizes = np.bincount(terms, minlength=len(coded.dictionary)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (own.column(1), own.column(0), pa.array(n), pa.array(starts))]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), pa.scalar(b" ", pa.binary()))
            numbers = [pa.array([x.tobytes()], pa.binary()) for x in (sizes, places[np.argsort(terms, kind="stable")])]
            return pa.RecordBatch.from_arrays([*lists, joined, *numbers], names=["rows", "doc_ids", "counts", "starts", "terms", "sizes", "places"])

        for batch in batches:
            counts, words, first = [], [], 0
            for k, text in enumerate(batch.column(2).cast(pa.binary())):
                own = words_of(text.as_py())
                counts.append(len(own))
                words += own
                if len(words) >= SEGMENT_WORDS:
                    yield made(batch, first, counts, words)
                    counts, words, first = [], [], k + 1
            if counts:
                yield made(batch, first, counts, words)

    schema = f"rows array<long>, doc_ids array<{kind}>, counts array<int>, starts array<int>, terms binary, sizes binary, places binary"
    return docs.select("doc_id", "row", "text").mapInArrow(run, schema)


def _terms(packed: pa.Scalar) -> pa.Array:
    return pa.array(packed.as_py().split(), pa.binary())


def _numbers(packed: pa.Scalar) -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), np.int32)


def index(docs: DataFrame, gap: int) -> DataFrame:
    """`segments` with terms (binary), sizes and places (int) as arrays."""
    packed = segments(docs, gap)
    plain = ["rows", "doc_ids", "counts", "starts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [pa.array([_terms(x).to_pylist() for x in batch.column("terms")], pa.list_(pa.binary()))]
            arrays += [pa.array([_numbers(x) for x in batch.column(c)], pa.list_(pa.int32())) for c in ("sizes", "places")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in plain], *arrays], names=batch.schema.names)

    kinds = ", ".join(f"{c} {packed.schema[c].dataType.simpleString()}" for c in plain)
    return packed.mapInArrow(run, f"{kinds}, terms array<binary>, sizes array<int>, places array<int>")


class Block:
    """A block's items, and its windows as rows of term numbers, by length."""

    def __init__(self, block: list[tuple[str, list[bytes]]], size: int) -> None:
        self.items = [key for key, _ in block]
        self.size = size
        number: dict[bytes, int] = {}
        self.words = [np.array([number.setdefault(w, len(number)) for w in words], np.int32) for _, words in block]
        self.terms = list(number)

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, the item of each) for each length; fewer words than `size` are one window."""
        by_length: dict[int, tuple[list, list]] = {}
        for item, words in enumerate(self.words):
            length = min(self.size, len(words))
            rows, of = by_length.setdefault(length, ([], []))
            made = np.lib.stride_tricks.sliding_window_view(words, length)
            rows.append(made)
            of.append(np.full(len(made), item))
        for rows, of in by_length.values():
            yield np.concatenate(rows), np.concatenate(of)


def _ranks(windows: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The offsets of each window's terms, the rarest first; ties by the term's bytes (`order`), then the offset."""
    length = windows.shape[1]
    key = (counts[windows] * len(order) + order[windows]) * length + np.arange(length)
    return np.argsort(key, axis=1, kind="stable")


def _search(segment: dict[int, np.ndarray], block: Block, counts: np.ndarray, order: np.ndarray, slop: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(start places, items, length) of one segment's matches, length 0 for near ones; `segment` has the posting lists by term.

    Places of a window's rarest term, moved back by its offset, meet the lists of its other terms one after
    the other, the next rarest first; what is left are the phrase's places. Near: the rarest term and the
    rarest other one stand as the window has them, up to `slop` places apart.
    """
    known = np.zeros(len(block.terms), bool)
    known[list(segment)] = True
    held = sorted(segment)
    # One sorted list of all postings: the term's place among `held` times the segment's length, and the place.
    slot = np.zeros(len(block.terms), np.int64)
    slot[held] = np.arange(len(held))
    width = end + 2 * (block.size + slop) + 2
    postings = np.concatenate([segment[t].astype(np.int64) + slot[t] * width for t in held]) if held else np.empty(0, np.int64)
    firsts = np.r_[0, np.cumsum([len(segment[t]) for t in held])].astype(np.int64)

    def stands(term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = slot[term] * width + place
        at = np.searchsorted(postings, key)
        return (place >= 0) & (at < len(postings)) & (postings[np.minimum(at, len(postings) - 1)] == key)

    for windows, items in block.windows():
        length = windows.shape[1]
        ranks = _ranks(windows, counts, order)
        rarest = windows[np.arange(len(windows)), ranks[:, 0]]
        other = np.take_along_axis(windows, ranks, 1) != rarest[:, None]
        second = np.where(other.any(1), ranks[np.arange(len(windows)), other.argmax(1)], -1)
        ok = np.flatnonzero(known[rarest])
        sizes = np.diff(firsts)[slot[rarest[ok]]]
        cut = np.searchsorted(np.cumsum(sizes), np.arange(STEP, sizes.sum() + STEP, STEP))
        for some in np.split(ok, np.unique(np.minimum(cut + 1, len(ok)))):
            if not len(some):
                continue
            n = np.diff(firsts)[slot[rarest[some]]]
            window = np.repeat(some, n)
            into = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(firsts[slot[rarest[some]]], n)
            start = postings[into] - slot[rarest[window]] * width - ranks[window, 0]
            near_window, near_start = window[second[window] >= 0], start[second[window] >= 0]
            for k in range(1, length):
                if not len(window):
                    break
                offset = ranks[window, k]
                term = windows[window, offset]
                met = known[term] & stands(term, start + offset)
                window, start = window[met], start[met]
            yield start, items[window], length
            offset = second[near_window]
            term = windows[near_window, offset]
            sure = known[term]
            near_window, place, term = near_window[sure], (near_start + offset)[sure], term[sure]
            key = slot[term] * width + np.maximum(place - slop, 0)
            at = np.searchsorted(postings, key)
            close = (at < len(postings)) & (postings[np.minimum(at, len(postings) - 1)] <= slot[term] * width + place + slop)
            # The place of the rarest term itself says in which document the match is.
            anchor = place - second[near_window] + ranks[near_window, 0]
            yield anchor[close], items[near_window[close]], 0


def search(indexed: DataFrame, block: Block, counts: dict[bytes, int], slop: int) -> DataFrame:
    """(row, starts, stops, items, near_items) of every document with a match of the block, from the stored index."""
    n = np.array([counts.get(t, 0) for t in block.terms], np.int64)
    order = np.empty(len(block.terms), np.int64)
    order[sorted(range(len(block.terms)), key=block.terms.__getitem__)] = np.arange(len(block.terms))
    shared = indexed.sparkSession.sparkContext.broadcast((block, n, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n, order = shared.value
        wanted = pa.array(block.terms, pa.binary())
        longs, names = pa.list_(pa.int64()), pa.list_(pa.string())
        for batch in batches:
            for segment in range(batch.num_rows):
                rows, starts, counts = (batch.column(k)[segment].values for k in range(3))
                numbers = pc.index_in(_terms(batch.column(3)[segment]), value_set=wanted)
                met = np.flatnonzero(numbers.is_valid().to_numpy(zero_copy_only=False))
                if not len(met):
                    continue
                sizes, places = (_numbers(batch.column(k)[segment]) for k in (4, 5))
                ends = np.cumsum(sizes)
                lists = {t: places[ends[k] - sizes[k] : ends[k]] for k, t in zip(met.tolist(), numbers.take(pa.array(met)).to_pylist(), strict=True)}
                first = starts.to_numpy().astype(np.int64)
                out: dict[int, tuple[list, list, set, set]] = {}
                for start, item, length in _search(lists, block, n, order, slop, int(first[-1] + counts[-1].as_py())):
                    doc = np.searchsorted(first, start, side="right") - 1
                    for pair in np.unique(doc * len(block.items) + item).tolist():
                        own = out.setdefault(pair // len(block.items), ([], [], set(), set()))
                        own[3].add(block.items[pair % len(block.items)])
                        if length:
                            own[2].add(block.items[pair % len(block.items)])
                    if length:
                        for place in np.unique(start).tolist():
                            d = int(np.searchsorted(first, place, side="right") - 1)
                            out[d][0].append(place - int(first[d]))
                            out[d][1].append(place - int(first[d]) + length)
                docs = sorted(out)
                columns = [rows.take(pa.array(docs, pa.int64())), *[pa.array([list(out[d][k]) for d in docs], longs if k < 2 else names) for k in range(4)]]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "starts", "stops", "items", "near_items"])

    some = indexed.select("rows", "starts", "counts", "terms", "sizes", "places")
    return some.mapInArrow(run, "row long, starts array<long>, stops array<long>, items array<string>, near_items array<string>")


def frequencies(indexed: DataFrame, block: Block) -> dict[bytes, int]:
    """How often each of the block's terms stands in all texts."""
    shared = indexed.sparkSession.sparkContext.broadcast(block.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(shared.value, pa.binary())
        for batch in batches:
            total = np.zeros(len(wanted), np.int64)
            for terms, sizes in zip(*batch.columns, strict=True):
                numbers = pc.index_in(_terms(terms), value_set=wanted)
                met = np.flatnonzero(numbers.is_valid().to_numpy(zero_copy_only=False))
                total[numbers.take(pa.array(met)).to_numpy()] += _numbers(sizes)[met]
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "n"])

    found = indexed.select("terms", "sizes").mapInArrow(run, "term long, n long")
    return {block.terms[t]: n for t, n in found.groupBy("term").agg(F.sum("n")).collect()}


def decontaminate(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, slop: int = 3
) -> DataFrame:
    """For every row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    Words: runs of ASCII letters (lower-cased), digits and characters beyond ASCII. A word inside any
    occurrence of a window of `size` item words is hit. The documents' postings of all words are stored once,
    in segments; each block of items reads the lists of its own terms, and in each segment a window's lists,
    moved by their offsets, are intersected from the rarest on (rarest in all texts). n_near_items: items of
    which a window occurs, or its two rarest different terms stand as the item has them, up to `slop` words
    apart. Null texts have no words; items without words match nothing; a null item_id is no item; equal ids
    are one item. Repeated rows come out as often as they come in; other columns are not read.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    indexed = stored(segments(source, size + slop + 1), **WIDE_ROWS)
    of_docs = F.explode(F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("rows").alias("row"), F.col("counts").alias("n_words")))
    listed = indexed.select(of_docs.alias("x")).select("x.doc_id", "x.row", F.col("x.n_words").cast("long").alias("n_words"))
    found = []
    for own in blocks(items, item_id, item_text):
        block = Block(own, size)
        found.append(search(indexed, block, frequencies(indexed, block), slop))
    if found:
        matches = stored(reduce(DataFrame.unionByName, found))
        merged = matches.groupBy("row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "stops", "items", "near_items")])
        spans = F.array_sort(F.arrays_zip("starts", "stops"))
        hit = F.aggregate(
            spans,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("stop")),
            lambda a, x: F.struct(
                (a["n"] + F.greatest(F.lit(0).cast("long"), x["stops"] - F.greatest(x["starts"], a["stop"]))).alias("n"), F.greatest(a["stop"], x["stops"]).alias("stop")
            ),
            lambda a: a["n"],
        )
        merged = merged.select("row", hit.alias("n_hit"), F.sort_array(F.array_distinct("items")).alias("items"), F.size(F.array_distinct("near_items")).alias("n_near_items"))
        out = listed.join(merged, "row", "left")
    else:
        out = listed.withColumns({"n_hit": F.lit(0), "items": F.array().cast("array<string>"), "n_near_items": F.lit(0)})
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_col).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_col, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items"),
    )
