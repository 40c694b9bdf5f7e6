"""Language identification by fusing text likelihoods with declared language, address and host priors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakiln.llm.common import attach, checkpointed, empty_if_null, url_host

#: Hashed byte trigrams of the text model, and the rows that train it, at most: a bounded sample by digest.
FEATURES = 1 << 14
SAMPLE_ROWS = 8_000
#: A trigram says this part of what it would if it were independent of its neighbours.
TEMPER = 0.25
#: Pseudo-counts: suffix towards the whole corpus, host towards its suffix, and in the tables of evidence.
KAPPA_SUFFIX, KAPPA_HOST, KAPPA_EVIDENCE = 20.0, 10.0, 1.0
#: What fuse() adds, for the result or on the way.
RESERVED = frozenset("lang probability text_lang posterior n n_rows p of_host of_suffix of_declared".split())
MARKUP = re.compile(rb"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def trigrams(text: bytes) -> np.ndarray:
    """Feature numbers of the text's byte trigrams; ASCII letters in lower case, other ASCII as one space."""
    low = b" " + b" ".join(text.lower().translate(_LETTERS).split()) + b" "
    b = np.frombuffer(low, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint32)
    return ((b[:-2] * np.uint32(40503) + b[1:-1]) * np.uint32(40503) + b[2:]) * np.uint32(2654435769) >> np.uint32(32 - 14)


_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


class TextModel:
    """Multinomial model of trigrams: log-likelihood of a text for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        self.weights = np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)) if languages else counts

    def score(self, text: bytes) -> np.ndarray:
        """Tempered log-likelihoods, the best at 0; all 0 for a text without letters."""
        found = np.bincount(trigrams(text), minlength=FEATURES)
        out = TEMPER * (self.weights @ found)
        return out - out.max() if len(out) else out


def drawn_by(key: str, known: int, sample_rows: int = SAMPLE_ROWS) -> Column:
    """Whether a row is in the sample that trains the model, of `known` labelled rows."""
    part = min(1.0, sample_rows / max(1, known))
    return F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) < int(part * (1 << 30))


def train(rows: DataFrame, text: str, label: str, key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """A model of about `sample_rows` labelled rows, those whose keys hash lowest (null labels and texts are left out).

    Each language's trigram counts are summed in Spark; languages * FEATURES numbers come to the driver.
    """
    known = rows.where(F.col(label).isNotNull())
    some = known.where(drawn_by(key, known.count(), sample_rows) & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(label).alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for value, label in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(label, np.zeros(FEATURES, np.int64))
                counts[label] += np.bincount(trigrams(value.as_py()), minlength=FEATURES)
        for label, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], names=["label", "feature", "n"])

    sums = some.mapInArrow(run, "label string, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["label"] for r in sums})
    counts = np.zeros((len(languages), FEATURES))
    for label, feature, n in sums:
        counts[languages.index(label), feature] += n
    return TextModel(languages, counts)


def suffix_of(url: Column) -> Column:
    """The address suffix: the host's last label and, after it, a two-letter first step of the path."""
    last = F.regexp_extract(url_host(url), r"([^.]*)$", 1)
    path = F.lower(F.regexp_extract(empty_if_null(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?=[/?#]|$)", 1))
    return F.concat_ws("/", last, F.when(path != "", path))


def declared_in(page: Column) -> Column:
    """The primary language that the page's html element declares; empty if none."""
    return F.lower(F.regexp_extract(empty_if_null(page), r"""(?i)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?([A-Za-z]+)""", 1))


def evidence(df: DataFrame, text: str, markup: bool, model: TextModel, ids: list[str], declared: Column, suffix: Column, host: Column) -> DataFrame:
    """ids, declared, suffix, host, n_bytes and text_scores (one per language) of every row; reads each text once."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(*ids, empty_if_null(declared).alias("declared"), empty_if_null(suffix).alias("suffix"), empty_if_null(host).alias("host"), F.col(text).alias("_text"))
    keep = source.drop("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores, sizes = [], []
            for value in batch.column(batch.num_columns - 1).cast(pa.binary()):
                data = value.as_py() or b""
                data = MARKUP.sub(b" ", data) if markup else data
                sizes.append(len(data))
                scores.append(own.score(data).tolist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(scores, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "n_bytes", "text_scores"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema)
    return source.mapInArrow(run, f"{fields}, n_bytes long, text_scores array<double>")


def _normal(scores: Column) -> Column:
    """Probabilities from log scores."""
    top = F.array_max(scores)
    raised = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """Soft counts of each language by group, as an array column `n`, and how many rows it has."""
    return rows.groupBy(*by).agg(F.array(*[F.sum(F.element_at("p", i + 1)) for i in range(n)]).alias("n"), F.count("*").alias("n_rows"))


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """`rows` of evidence() with lang, probability, text_lang and posterior (array in the order of `languages`).

    `rows` has the columns of evidence(); ids may have any name but these and declared, suffix, host, n_bytes,
    text_scores, n, n_rows, p, of_host, of_suffix and of_declared: such a name raises ValueError.
    The texts' own posteriors are summed by declared language, by suffix and by host. Host prior: its soft
    counts with KAPPA_HOST pseudo-counts of its suffix, which has KAPPA_SUFFIX of the corpus; the row's own
    part is taken out first. Declared language: P(declared | language), smoothed. The suffix speaks through
    the prior. Log posterior: text score + log P(declared | language) + log host prior. A row without letters
    or evidence gets the corpus's prior; without any model the language is null.
    """
    n, columns = len(languages), rows.columns
    lower = [c.lower() for c in columns]
    if clash := sorted({c for c in lower if lower.count(c) > 1} | set(lower) & RESERVED):
        raise ValueError(f"columns in the way: {clash}")
    if not n:
        return rows.select("*", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.array().cast("array<double>").alias("posterior"))
    rows = rows.withColumn("p", _normal(F.col("text_scores")))
    whole = _sums(rows, n).first()["n"]
    whole = [x or 0.0 for x in whole]
    total = sum(whole) or 1.0
    corpus = [(x + 1.0) / (total + n) for x in whole]
    hosts = checkpointed(_sums(rows, n, "suffix", "host").withColumnRenamed("n", "of_host"))
    suffixes = checkpointed(_sums(rows, n, "suffix").withColumnRenamed("n", "of_suffix"))
    stated = checkpointed(_sums(rows, n, "declared").withColumnRenamed("n", "of_declared"))
    kinds = stated.count()
    rows = attach(rows, hosts, ["suffix", "host"], "n_rows")
    rows = attach(attach(rows, suffixes, ["suffix"], "n_rows"), stated, ["declared"], "n_rows")

    def at(name: str, i: int) -> Column:
        return F.element_at(name, i + 1)

    def rest(name: str, i: int) -> Column:
        return F.greatest(F.lit(0.0), at(name, i) - at("p", i))

    def total_of(name: str) -> Column:
        return F.greatest(F.lit(0.0), sum((at(name, i) for i in range(1, n)), at(name, 0)) - 1.0)

    scores = []
    for i in range(n):
        of_suffix = (rest("of_suffix", i) + F.lit(KAPPA_SUFFIX * corpus[i])) / (total_of("of_suffix") + F.lit(KAPPA_SUFFIX))
        of_host = (rest("of_host", i) + F.lit(KAPPA_HOST) * of_suffix) / (total_of("of_host") + F.lit(KAPPA_HOST))
        given = (rest("of_declared", i) + F.lit(KAPPA_EVIDENCE)) / F.lit(whole[i] + KAPPA_EVIDENCE * (kinds + 1))
        scores.append(at("text_scores", i) + F.log(of_host) + F.when(F.col("declared") != "", F.log(given)).otherwise(F.lit(0.0)))
    rows = rows.withColumn("posterior", _normal(F.array(*scores)))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    spoken = F.aggregate(F.transform("text_scores", F.abs), F.lit(0.0), lambda a, b: a + b) > 0
    return rows.select(
        *columns, best("posterior").alias("lang"), F.array_max("posterior").alias("probability"), F.when(spoken, best("p")).alias("text_lang"), "posterior"
    )


def identify(parts: list[DataFrame], languages: list[str]) -> DataFrame:
    """fuse() of the union of evidence tables, which are written to the checkpoint folder first.

    A column that one table lacks is null in its rows. Repeated rows count and come out as often as they come
    in; null texts, declarations, suffixes and hosts count as empty; empty tables give no rows.
    """
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return fuse(checkpointed(rows), languages)
