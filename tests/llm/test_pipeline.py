import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from terrakiln.llm import mixing, quality
from tests.llm import brute


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = mixing.checkpointed(stage(spark, docs, sf))
        made[name] = docs
        assert name == "sharding" or docs.columns == columns
    ids = {name: sorted(r.doc_id for r in df.select("doc_id").collect()) for name, df in made.items()}
    z = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    kept = sorted(d for d, t in texts.items() if not brute.quality(t)[5] and quality.band_verdict(t.encode(), quality.Bands(), z)[3] == "ok")
    assert ids["quality_rules"] == kept
    roots = brute.linked([brute.wide_fingerprint(texts[d]) for d in kept], 38)
    kept = [d for i, d in enumerate(kept) if roots[i] == i]
    assert ids["simhash_near_dedup"] == kept
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = brute.contamination([(d, texts[d]) for d in kept], items)
    kept = [d for d in kept if not hit[d][1]]
    assert ids["benchmark_decontamination"] == kept
    copies = mixing.mix(made["benchmark_decontamination"], spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert ids["mixing"] == sorted(r.doc_id for r in copies for _ in range(r.copies))
    assert ids["sharding"] == ids["mixing"]
    assert sorted(r[0] for r in made["sharding"].select(F.md5("text")).collect()) == sorted(r[0] for r in made["mixing"].select(F.md5("text")).collect())
    assert made["sharding"].select("shard", "slot").distinct().count() == len(ids["sharding"])


def test_stages_take_odd_tables(spark, sf):
    for rows in ([(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "words " * 30, None, None, None)], []):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).count()


def test_rows_without_an_id(spark, sf):
    prose = " ".join(f"w{i}" for i in range(60))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(7, prose), (3, prose), (None, prose), (None, "a clean " + prose[::-1]), (None, "a clean " + prose[::-1]), (None, item + " " + item)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    alone = sorted(str(r.doc_id) + r.text[:7] for r in corpus_pipeline.stage_near_dedup(spark, docs, sf).collect())
    assert alone == sorted(["3" + prose[:7], "Nonea clean", "None" + item[:7]])
    clean = [(r.doc_id, r.text) for r in corpus_pipeline.stage_decontaminate(spark, docs, sf).collect()]
    assert sorted(map(str, clean)) == sorted(map(str, rows[:5]))
    assert {r.doc_id for r in corpus_pipeline.stage_mix(spark, docs.where("doc_id is null"), sf).collect()} <= {None}


def test_rows_that_share_an_id(spark, sf):
    one, two = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(7, one), (7, two), (7, two), (3, one), (8, two + " own"), (8, item + " " + item), (9, one[::-1]), (9, two[::-1])]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    alone = sorted((r.doc_id, r.text) for r in corpus_pipeline.stage_near_dedup(spark, docs, sf).where("text not like '%own'").collect())
    assert alone == sorted([(3, one), (7, two), rows[5], *rows[6:]])
    clean = sorted((r.doc_id, r.text) for r in corpus_pipeline.stage_decontaminate(spark, docs, sf).collect())
    assert clean == sorted(r for r in rows if r != rows[5])
