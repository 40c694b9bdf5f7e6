"""From raw documents to shards: quality rules, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakiln.llm import decontam, mixing, quality, sharding, simhash
from terrakiln.llm.common import shared_folder


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the rules and compression bands; null and empty texts fail, repeated rows are judged alike."""
    return quality.annotate(docs).where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def key_of(docs: DataFrame) -> Column:
    """What names a row: its id, if any, and its text's digest; orders as ids do, with rows without an id last."""
    text = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    return F.struct(docs["doc_id"].isNull().alias("none"), F.coalesce(docs["doc_id"], F.lit(0)).alias("id"), text.alias("text"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies its document of least id, of which one row; ids come before rows without.

    Near copies: a similarity of 0.8 or more of five-word shingles, as wide SimHash fingerprints tell. Rows that
    share an id but not the text are documents of their own; all texts without words are copies of one another.
    """
    groups = simhash.similar_documents(docs.select(key_of(docs).alias("doc_id"), "text"), size=5, similarity=0.8)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_key")).distinct()
    found = docs.join(kept, key_of(docs) == kept["_key"], "left_semi")
    return found.withColumn("_key", key_of(found)).dropDuplicates(["_key"]).drop("_key")


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; id and text tell rows."""
    found = decontam.decontaminate(docs.select(key_of(docs).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where("contaminated").select(F.col("doc_id").alias("_key"))
    return docs.join(hit, key_of(docs) == hit["_key"], "left_anti")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says; a second copy is a row like the first. Id and text tell rows.

    Null and empty texts count no tokens and have the rate of their posteriors; rows alike in id and text share a draw.
    """
    mixed = mixing.mix(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    copies = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.max("copies").alias("_copies")).where(F.col("_copies") > 0)
    same = docs["doc_id"].eqNullSafe(copies["_id"]) & (mixing.digest_of(docs["text"]) == copies["_digest"])
    again = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return docs.join(copies, same).withColumn("_again", again).select(*[docs[f"`{c}`"] for c in docs.columns])


def stage_shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot: every row, null ids and texts too, has a slot of its own."""
    return sharding.shuffled(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stage_quality),
    ("simhash_near_dedup", stage_near_dedup),
    ("benchmark_decontamination", stage_decontaminate),
    ("mixing", stage_mix),
    ("sharding", stage_shard),
]

#: Compression and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again; only the last folder stays."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
