import pytest
from pyspark.sql import functions as F

from terrakiln.llm import common, line_dedup, sharding


def test_numbers_follow_buckets_and_contents(spark):
    rows = [(i, f"text {i % 9}") for i in range(60)] + [(None, f"t{i}") for i in range(40)] + [(7, "same")] * 5 + [(8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign(df, shards=5, seed=3).collect()
    assert sorted(r.number for r in got) == list(range(len(rows)))
    value = F.coalesce("text", F.lit(""))
    plain = df.select("doc_id", (F.octet_length(value).cast("long") + 8).alias("s"), F.crc32(F.encode(value, "UTF-8")).alias("c"), F.xxhash64(value).alias("t"))
    plain = plain.withColumn("b", F.pmod(F.xxhash64("doc_id", "s", "c", "t"), F.lit(sharding.BUCKETS))).collect()
    order = sorted(plain, key=lambda r: (r.b, r.doc_id is not None, r.doc_id or 0, r.s, r.c, r.t))
    assert [(r.doc_id, r.size, r.text_crc32) for r in sorted(got, key=lambda r: r.number)] == [(r.doc_id, r.s, r.c) for r in order]
    assert len({r.b for r in plain if r.doc_id is None}) > 30  # rows without an id aren't one bucket
    place = {r.id: r.p for r in spark.range(len(rows)).select("id", sharding.permuted(F.col("id"), len(rows), 3).alias("p")).collect()}
    assert all((r.shard, r.slot) == (place[r.number] % 5, place[r.number] // 5) for r in got)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_lines_of_a_large_host(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_DIGESTS", broadcast)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = [(i, "big", f"notice\nown {i}") for i in range(50)] + [(100 + i, "small", f"notice\nown {i}") for i in range(2)] + [(200, None, None)]
    got = {r.id: r.text for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "id long, host string, text string")).collect()}
    assert got == {**{i: f"own {i}" for i in range(50)}, 100: "notice\nown 0", 101: "notice\nown 1", 200: None}


def test_names_in_the_way(spark):
    df = spark.createDataFrame([(1, "a", "h", 2)], "doc_id long, text string, host string, _k int")
    with pytest.raises(ValueError, match="_k"):
        sharding.shuffled(df)
    with pytest.raises(ValueError, match="_host"):
        line_dedup.drop_boilerplate(df.withColumnRenamed("_k", "_host"))
