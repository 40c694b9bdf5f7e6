"""The corpus operators' queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakiln.llm import decontam, html_extract, language, line_dedup, mixing, oracles, quality, secret_scan, sharding, simhash, unit_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their site's boilerplate lines; the source is the site."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, host="source", text="text")


def op2_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and compression bands of every document."""
    return quality.annotate(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; the source is the owner, its parts by language are the repositories."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return secret_scan.scan(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of documents that repeat an earlier one's lines or passages, from 50 words on."""
    return unit_dedup.passages(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.assign(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark matches of every document."""
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page and document, fused over both tables.

    A page declares it in its markup and has an address; a document's declaration is the column lang and
    its host the source. Documents that trained the text model declare nothing: their label is spent.
    """
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    spent = language.drawn_by("doc_id", docs.where("lang is not null").count())
    model = language.train(docs.select("doc_id", "text", "lang"), "text", "lang")
    of_docs = language.evidence(
        docs.withColumn("page_id", F.lit(None).cast("long")), "text", False, model, ["doc_id", "page_id"], F.when(~spent, F.lower("lang")), F.lit(""), F.col("source")
    )
    of_pages = language.evidence(
        pages.withColumn("doc_id", F.lit(None).cast("long")),
        "html",
        True,
        model,
        ["doc_id", "page_id"],
        language.declared_in(F.col("html")),
        language.suffix_of(F.col("url")),
        language.url_host(F.col("url")),
    )
    out = language.identify([of_docs, of_pages], model.languages)
    return out.select("doc_id", "page_id", "host", "suffix", "declared", "text_lang", "lang", F.round("probability", 6).alias("probability"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors, rate and copies of every document."""
    out = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return out.drop("row", "digest")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus_pipeline's stages, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_quality_bands, op3_html_extraction, op4_secret_scan, op5_substring_dedup, op6_sharding, op7_simhash, op8_decontamination, op9_language_id, op10_mixing, pipeline)
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": """
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS host, g AS pos, string_split(text, chr(10))[g] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS g)
),
totals AS (SELECT coalesce(source, '') AS host, count(*) AS pages FROM documents GROUP BY 1),
frequent AS (
  SELECT host, trim(line, ' ') AS line, count(DISTINCT doc_id) AS n
  FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1, 2
),
boilerplate AS (
  SELECT f.host, f.line FROM frequent f JOIN totals t ON f.host = t.host
  WHERE f.n >= 3 AND f.n > 0.05 * t.pages
),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text, count(*) AS n
  FROM lines l LEFT JOIN boilerplate b ON l.host = b.host AND trim(l.line, ' ') = b.line
  WHERE b.line IS NULL GROUP BY 1
),
numbers AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1)
SELECT d.doc_id, d.source,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       coalesce(n.n, 0) AS n_lines,
       coalesce(n.n, 0) - coalesce(k.n, 0) AS n_dropped
FROM documents d LEFT JOIN numbers n ON d.doc_id = n.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
    "op4_secret_scan": oracles.SECRET_SCAN,
    "op8_decontamination": oracles.DECONTAMINATION,
}
