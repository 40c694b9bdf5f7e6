"""Quality rules: base counts of a text and compression bands of zstandard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from terrakiln.llm.common import without

SYMBOLS = b"#*$%&|<>"
GAPS = b" \t\n\v\f\r"
#: The bytes of UTF-8 that don't begin a character.
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 8


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size / size.

    whole: (bytes below which the row holds, least ratio, greatest ratio); short texts carry the frame's own
    bytes and little context, so their bands are wider. The greatest ratios lie between prose (at most 0.52 from
    2 KiB, 0.43 from 16 KiB) and random base64 (at least 0.75), from 8 KiB also below random hex digits (0.51).
    The chunk band holds for each full chunk; the rest, and the parts of texts under `chunk_bytes` (`short_chunks`:
    least size of a text, size of its parts), have the band of their own length. A text fails when more than
    `bad_chunks` of its bytes are in parts outside.
    """

    whole: tuple[tuple[float, float, float], ...] = (
        (128, 0.0, 99.0),
        (256, 0.40, 99.0),
        (512, 0.35, 0.84),
        (1024, 0.30, 0.785),
        (2048, 0.25, 0.74),
        (4096, 0.22, 0.70),
        (8192, 0.20, 0.65),
        (16384, 0.20, 0.51),
        (float("inf"), 0.18, 0.49),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.20, 0.65)
    short_chunks: tuple[tuple[int, int], ...] = ((2048, 1024), (1024, 512))
    bad_chunks: float = 0.25

    def of_length(self, size: int) -> tuple[float, float]:
        return next((a, b) for below, a, b in self.whole if size < below)

    def step(self, size: int) -> int:
        """The size of a text's parts; 0 where the text is its only part."""
        return self.chunk_bytes if size >= self.chunk_bytes else next((step for least, step in self.short_chunks if size >= least), 0)
    level: int = 3


ADDED = T.StructType(
    [T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [
        T.StructField("base_failed", T.BooleanType(), False),
        T.StructField("zstd_ratio", T.DoubleType(), True),
        T.StructField("n_chunks", T.LongType(), False),
        T.StructField("n_bad_chunks", T.LongType(), False),
        T.StructField("band", T.StringType(), False),
        T.StructField("kept", T.BooleanType(), False),
    ]
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window of `window` words that the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    # Ranks of windows of doubled length, until the length is the window's: exact, no digest.
    length = 1
    while length < window:
        step = min(length, window - length)
        pairs = ids[:-step] * (ids.max() + 1) + ids[step:] if step else ids
        ids = np.unique(pairs, return_inverse=True)[1]
        length += step
    again = np.flatnonzero(np.bincount(ids)[ids] > 1)
    if not len(again):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = text.split()  # of bytes: at ASCII white space only
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, CONTINUATION + GAPS)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def band_verdict(text: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple[float | None, int, int, str]:
    """The whole text's ratio, its chunks (the rest at the end is one), those outside their band, and the verdict."""
    size = len(text)
    if not size:
        return None, 0, 0, "ok"
    ratio = len(compressor.compress(text)) / size
    low, high = bands.of_length(size)
    chunks = bad = bad_bytes = 0
    step = bands.step(size)
    for at in range(0, size, step) if step else ():
        part = text[at : at + step]
        least, most = bands.chunk if len(part) == bands.chunk_bytes else bands.of_length(len(part))
        chunks += 1
        if not least <= len(compressor.compress(part)) / len(part) <= most:
            bad += 1
            bad_bytes += len(part)
    if ratio < low:
        return ratio, chunks, bad, "repetitive"
    if ratio > high:
        return ratio, chunks, bad, "incompressible"
    return ratio, chunks, bad, "chunks" if bad_bytes > bands.bad_chunks * size else "ok"


def judge(text: bytes | None, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple:
    text = text or b""
    base = base_counts(text)
    failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
    ratio, chunks, bad, band = band_verdict(text, bands, compressor)
    return (*base, failed, ratio, chunks, bad, band, not failed and band == "ok")


def annotate(df: DataFrame, text: str = "text", bands: Bands | None = None) -> DataFrame:
    """`df` with the columns of ADDED, one row for each row; each whole text is read once, without a shuffle.

    base_failed: under 20 words, or over 30 % of them in repeated 8-word windows. kept: not base_failed and
    within the bands. A null or empty text has no words, so it fails. Rows repeat as they come; an empty
    table gives an empty one. Input columns with a name of ADDED are replaced.
    """
    bands = bands or Bands()
    source = without(df, *(f.name for f in ADDED))
    kinds = [pa.float64() if f.dataType == T.DoubleType() else pa.string() if f.dataType == T.StringType() else pa.bool_() if f.dataType == T.BooleanType() else pa.int64() for f in ADDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
            rows = [judge(x.as_py(), bands, compressor) for x in texts]
            added = zip(*rows, strict=True) if rows else [[]] * len(ADDED)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(x, k) for x, k in zip(added, kinds, strict=True))],
                names=[*batch.schema.names, *ADDED.names],
            )

    return source.mapInArrow(run, T.StructType([*source.schema.fields, *ADDED.fields]))
