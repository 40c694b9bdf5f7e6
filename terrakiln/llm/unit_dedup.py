"""Substring dedup: hashes of lines, paragraphs or sentences, and of passages of many words, grouped over the whole corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrakiln.llm.common import attach, checkpointed, stored, without

#: A unit's end: of the line, of the paragraph, or of a sentence within its line.
ENDS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[^\S\n]*\n\s*"), "sentence": re.compile(r"\n|[.!?]+[\"')\]]*(?=\s)")}


def split_units(text: str, unit: str, min_words: int) -> list[tuple[int, int, int, str]]:
    """(start, end, words, normalised text) of the units, offsets in code points.

    Normalised: lower case, white space as one space. A sentence with fewer than `min_words` words joins the
    sentences after it in its line; what is left with fewer words at a line's end is no unit.
    """
    out, start, n = [], 0, len(text)
    for m in (*ENDS[unit].finditer(text), None):
        stop = n if m is None else m.start() if unit != "sentence" or m.group()[0] == "\n" else m.end()
        words = text[start:stop].lower().split()
        closes = m is None or unit != "sentence" or m.group()[0] == "\n"
        if len(words) >= min_words:
            lead = len(text[start:stop]) - len(text[start:stop].lstrip())
            trail = len(text[start:stop].rstrip())
            out.append((start + lead, start + trail, len(words), " ".join(words)))
        elif not closes:
            continue
        start = stop if m is None or unit == "sentence" and m.group()[0] != "\n" else m.end()
    return out


#: Words of the short windows that point to repeated passages.
ANCHOR_WORDS = 16
#: An odd base of rolling digests modulo 2^64 and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
WORD = re.compile(r"\S+")


class _Digests(dict):
    """Digests of words, forgotten when they are many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


_DIGESTS = _Digests()


def window_digests(words: list[str], *sizes: int) -> list[np.ndarray]:
    """For each size the digests of all windows of so many words, each of at most len(words)."""
    n = len(words)
    own = np.fromiter(map(_DIGESTS.__getitem__, words), np.uint64, n)
    power, back = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    power[:1] = back[:1] = 1
    sums = np.r_[np.uint64(0), np.cumsum(own * np.cumprod(power))]
    back = np.cumprod(back)
    out = []
    for size in sizes:
        x = (sums[size:] - sums[:-size]) * back[: n - size + 1]
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ x >> np.uint64(31))
    return out


def _sliding(x: np.ndarray, size: int, of: np.ufunc) -> np.ndarray:
    """`of` over each `size` neighbours."""
    length = 1
    while length < size:
        step = min(length, size - length)
        x = of(x[:-step], x[step:])
        length += step
    return x


def least_anchors(anchors: np.ndarray, passage: int) -> np.ndarray:
    """For each window of `passage` words the least digest of the anchors inside: equal windows have equal ones."""
    return _sliding(anchors, passage - ANCHOR_WORDS + 1, np.minimum)


def chosen_anchors(texts: list[tuple[int, list[str]]], passage: int) -> list[tuple[int, int, int]]:
    """(id, place, digest) of each text's first and last anchor of each digest that is the least of some window; all texts in one go."""
    words = [w for _, own in texts for w in own]
    if len(words) < passage:
        return []
    (anchors,) = window_digests(words, ANCHOR_WORDS)
    stops = np.cumsum([len(own) for _, own in texts])
    of = np.repeat(np.arange(len(texts)), [len(own) for _, own in texts])
    size = passage - ANCHOR_WORDS + 1
    least = np.where(of[: len(of) - passage + 1] == of[passage - 1 :], least_anchors(anchors, passage), np.uint64(0))
    none = np.zeros(size - 1, np.uint64)
    places = np.flatnonzero((_sliding(np.r_[none, least, none], size, np.maximum) == anchors) & (anchors > 0))
    first: dict[tuple[int, int], int] = {}
    last: dict[tuple[int, int], int] = {}
    for at, k, digest in zip(places.tolist(), of[places].tolist(), anchors[places].view(np.int64).tolist(), strict=True):
        if first.setdefault((k, digest), at) != at:
            last[k, digest] = at
    return [(texts[k][0], at - int(stops[k]) + len(texts[k][1]), digest) for ends in (first, last) for (k, digest), at in ends.items()]


#: Kinds of marks: an anchor, and the whole text of a copy; other marks are units by their number.
ANCHOR, WHOLE = -1, -2
#: What tells a document; rows that share an id but not the text are documents of their own.
DOC = ["doc_id", "text_hash"]
#: Copies' ids, and documents with shared anchors, up to so many rows are broadcast to the texts.
BROADCAST_COPIES = 100_000


def _source(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    some = df.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    return some.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))


def _marks(source: DataFrame, unit: str, min_words: int, passage: int | None) -> DataFrame:
    """(doc_id, text_hash, unit, at, start, end, words, digest): the units, at being the number of words before.

    With `passage` also the chosen anchors (words 0). Of a copy (copy_of) with so many words only one mark of the
    whole text, whose digest is copy_of.
    """
    kinds = [*[pa.int32()] * 5, pa.int64()]
    names = ["unit", "at", "start", "end", "words", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
            of, *columns = zip(*rows, strict=True) if rows else [[]] * 7
            of = pa.array(of, pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *[pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]], names=[*DOC, *names])

        for batch in batches:
            rows: list[tuple] = []
            held: list[tuple[int, list[str]]] = []
            n = 0
            for row, (value, original) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
                text, before, at = value.as_py(), 0, 0
                all_words = text.lower().split() if passage else []
                if original is not None and len(all_words) >= passage:
                    first = len(text) - len(text.lstrip())
                    rows.append((row, WHOLE, 0, first, len(text.rstrip()), len(all_words), original))
                    continue
                for k, (start, end, words, normal) in enumerate(split_units(text, unit, min_words)):
                    at += len(text[before:start].split())
                    digest = xxhash.xxh3_64_intdigest(normal.encode("utf-8", "surrogatepass"))
                    rows.append((row, k, at, start, end, words, digest - (digest >> 63 << 64)))
                    before, at = end, at + words
                if passage:
                    held.append((row, all_words))
                    n += len(all_words)
                if n >= 50_000:
                    rows += [(key, ANCHOR, place, 0, 0, 0, digest) for key, place, digest in chosen_anchors(held, passage)]
                    held, n = [], 0
                if len(rows) >= 50_000:
                    yield made(batch, rows)
                    rows = []
            if held:
                rows += [(key, ANCHOR, place, 0, 0, 0, digest) for key, place, digest in chosen_anchors(held, passage)]
            yield made(batch, rows)

    return source.select(*DOC, "text", "copy_of").mapInArrow(run, "doc_id long, text_hash long, unit int, at int, start int, end int, words int, digest long")


def _windows(source: DataFrame, passage: int) -> DataFrame:
    """(doc_id, text_hash, at, start, end, digest) of the windows of `passage` words whose least anchor is in the column `anchors`."""
    names = [*DOC, "at", "start", "end", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text_hash, value, known in zip(*batch.columns, strict=True):
                text = value.as_py()
                words = text.lower().split()
                if len(words) < passage:
                    continue
                anchors, whole = window_digests(words, ANCHOR_WORDS, passage)
                at = np.flatnonzero(np.isin(least_anchors(anchors, passage).view(np.int64), known.values.to_numpy()))
                place = np.array([m.span() for m in WORD.finditer(text)], np.int32)
                key = [np.full(len(at), x.as_py(), np.int64) for x in (doc, text_hash)]
                columns = [*key, at.astype(np.int32), place[at, 0], place[at + passage - 1, 1], whole[at].view(np.int64)]
                for k in range(0, len(at), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000]) for x in columns], names=names)

    return source.select(*DOC, "text", "anchors").mapInArrow(run, "doc_id long, text_hash long, at int, start int, end int, digest long")


def _placed(rows: DataFrame, *key: str) -> DataFrame:
    """`rows` whose key stands in two places or more, with `first`, the earliest; rows of a hot key are dealt over tasks."""
    place = F.struct(*DOC, "at")
    first = rows.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    first = checkpointed(first.where(F.col("first") != F.col("last")).select(*key, "first", "n"))
    return attach(rows, first, list(key), "n")


def _later() -> Column:
    return F.struct(*DOC, "at") != F.col("first")


def _runs(units: DataFrame, min_span_words: int) -> DataFrame:
    """Neighbouring units (`_placed`, later ones) as runs of `min_span_words` words or more."""
    of_doc = Window.partitionBy(*DOC).orderBy("unit")
    return (
        units.dropDuplicates([*DOC, "unit"])
        .withColumn("run", F.col("unit") - F.row_number().over(of_doc))
        .groupBy(*DOC, "run")
        .agg(
            F.min("at").alias("at"),
            F.max(F.col("at") + F.col("words")).alias("stop"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.count("*").alias("n_units"),
            F.sum("words").alias("n_words"),
            F.sort_array(F.collect_set("first.doc_id")).alias("kept_doc_ids"),
        )
        .where(F.col("n_words") >= min_span_words)
        .drop("run")
    )


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = 1, min_span_words: int = 1) -> DataFrame:
    """The spans to remove: doc_id, text_hash, start, end (code points of the original), n_units, n_words, kept_doc_ids.

    Units (lines, paragraphs or sentences) with equal normalised text (digest and word count) form a group over
    the corpus; its earliest (by doc_id, then place) stays and the others go. Neighbouring units that go form
    one span. As it is, every repeated unit with a word goes; `min_words` leaves out short units, and spans under
    `min_span_words` words stay, as phrases and notices that clean documents share. kept_doc_ids: the
    documents with the earlier units. A group's size is never held in a task: its earliest unit comes from a
    partial aggregate, and the join back deals a hot group's units over tasks. Null ids and texts have no
    units; a document in repeated rows is one document; rows that share an id but not the text are documents
    of their own, told by text_hash (xxhash64 of the text), the lesser first. An empty table gives no rows;
    other columns are not read. Needs the checkpoint folder.
    """
    source = _source(df, doc_id, text).withColumn("copy_of", F.lit(None).cast("long"))
    every = stored(_marks(source, unit, min_words, None))
    return _runs(_placed(every, "digest", "words").where(_later()), min_span_words).drop("at", "stop")


def passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", passage: int = 50, unit: str = "line", min_words: int = 1, min_span_words: int = 50) -> DataFrame:
    """The spans of `repeats` and, wherever they begin and end, of all runs of `passage` words or more that occur earlier.

    Columns as in `repeats`; n_units counts the whole units found by themselves, n_words all words of the span.
    A window of `passage` words (lower case, white space as one space) goes if it occurs before, by doc_id, then
    place; spans that meet or overlap are one. A text of `passage` words or more that equals an earlier one's goes
    whole, and nothing else of it is looked at. Only windows whose least anchor of `ANCHOR_WORDS` words occurs
    elsewhere are looked up, and equal windows have equal anchors, so none is missed. In a text that repeats
    with a short period the first period stays. kept_doc_ids: earlier documents with the same units, windows or
    text. Null ids and texts have no spans, ids that several texts share are as in `repeats`. Needs the
    checkpoint folder.
    """
    source = _source(df, doc_id, text)
    slim = checkpointed(source.select(*DOC, F.xxhash64(F.lit(7), F.col("text")).alias("more")))
    groups = slim.groupBy("text_hash", "more").agg(F.min("doc_id").alias("copy_of"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    groups = checkpointed(groups.where("copy_of != most").drop("most"))
    copies = attach(slim, groups, ["text_hash", "more"], "n").where("doc_id != copy_of").select(*DOC, "copy_of").distinct()
    copies = checkpointed(copies.withColumn("n", F.lit(1)))
    source = attach(source, copies, DOC, "n", "left", BROADCAST_COPIES)
    marks = stored(_marks(source, unit, min_words, passage))
    found = stored(_placed(marks.where(F.col("unit") != WHOLE), "digest", "words").where((F.col("unit") == ANCHOR) | _later()))
    runs = _runs(found.where(F.col("unit") != ANCHOR), min_span_words).drop("n_words")
    anchors = stored(found.where(F.col("unit") == ANCHOR).groupBy(*DOC).agg(F.collect_set("digest").alias("anchors")).withColumn("n", F.lit(1)))
    shared = attach(_source(df, doc_id, text), anchors, DOC, "n")
    windows = _placed(stored(_windows(shared, passage)), "digest").where(_later())
    island = F.col("at") - F.dense_rank().over(Window.partitionBy(*DOC).orderBy("at"))
    ends = [F.min("at").alias("at"), (F.max("at") + passage).alias("stop"), F.min("start").alias("start"), F.max("end").alias("end"), F.lit(0).cast("long").alias("n_units")]
    windows = windows.select(*DOC, "at", "start", "end", F.col("first.doc_id").alias("kept")).withColumn("island", island)
    windows = windows.groupBy(*DOC, "island").agg(*ends, F.collect_set("kept").alias("kept_doc_ids")).drop("island")
    whole = marks.where(F.col("unit") == WHOLE).dropDuplicates(DOC)
    whole = whole.select(*DOC, "at", F.col("words").alias("stop"), "start", "end", F.lit(0).cast("long").alias("n_units"), F.array("digest").alias("kept_doc_ids"))
    places = Window.partitionBy(*DOC).orderBy("at", "stop")
    reach = F.max("stop").over(places.rowsBetween(Window.unboundedPreceding, -1))
    every = runs.unionByName(windows).unionByName(whole).withColumn("new", (F.col("at") > F.coalesce(reach, F.lit(-1))).cast("int"))
    return (
        every.withColumn("span", F.sum("new").over(places.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*DOC, "span")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum("n_units").alias("n_units"),
            (F.max("stop") - F.min("at")).cast("long").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("kept_doc_ids")))).alias("kept_doc_ids"),
        )
        .drop("span")
    )


def remove(df: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` with `spans` cut from its texts and array column kept_offsets of (start, end) in the original.

    A span belongs to the rows with its doc_id and text_hash. Rows without spans keep their text, null ids and
    texts too. An input column kept_offsets is replaced; one named _id, _hash, _cut or _offsets raises ValueError.
    """
    if clash := sorted({c.lower() for c in df.columns} & {"_id", "_hash", "_cut", "_offsets"}):
        raise ValueError(f"columns in the way: {clash}")
    per_doc = spans.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cut"))
    out = without(df, "kept_offsets")
    out = out.join(per_doc, (out[doc_id].cast("long") == per_doc["_id"]) & (F.xxhash64(out[text]) == per_doc["_hash"]), "left").drop("_id", "_hash")
    cut = F.coalesce(F.col("_cut"), F.array().cast("array<struct<start:int,end:int>>"))
    size = F.length(F.col(text))
    starts = F.concat(F.array(F.lit(0)), F.transform(cut, lambda x: x["end"]))
    ends = F.concat(F.transform(cut, lambda x: x["start"]), F.array(size))
    offsets = F.filter(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda x: x["start"] < x["end"])
    out = out.withColumn("_offsets", F.when(F.col(text).isNotNull(), offsets))
    joined = F.array_join(F.transform("_offsets", lambda x: F.substring(F.col(text), x["start"] + 1, x["end"] - x["start"])), "")
    columns = [joined.alias(c) if c == text else F.col(f"`{c}`") for c in out.columns if c not in ("_cut", "_offsets")]
    return out.select(*columns, F.col("_offsets").alias("kept_offsets"))
