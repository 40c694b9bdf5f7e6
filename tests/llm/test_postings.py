import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from terrakiln.llm import common, decontam
from tests.llm import brute


def near(docs, items, size=10, slop=3):
    """Items by document of which a window occurs or its two rarest terms stand near, in plain Python."""
    every = {d: brute.tokens(t) for d, t in docs}
    counts = {}
    for words in every.values():
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    out = {d: set() for d in every}
    for item, text in items:
        words = brute.tokens(text)
        for k in range(max(1, len(words) - size + 1)) if words else ():
            window = words[k : k + size]
            if any(w not in counts for w in window):
                continue
            ranked = sorted(range(len(window)), key=lambda i: (counts[window[i]], window[i].encode(), i))
            a = ranked[0]
            b = next((i for i in ranked if window[i] != window[a]), None)
            for d, own in every.items():
                exact = any(own[i : i + len(window)] == window for i in range(len(own)))
                if exact or b is not None and any(own[i] == window[a] and own[j] == window[b] and abs((j - b) - (i - a)) <= slop for i in range(len(own)) for j in range(max(0, i - size - slop), min(len(own), i + size + slop + 1))):
                    out[d].add(str(item))
    return {d: len(x) for d, x in out.items()}


def test_postings_against_brute_force(spark, monkeypatch):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(12)] + ["é", "ſ", "Z"]
    items = [(i, " ".join(draw.choices(words, k=draw.choice([1, 2, 3, 10, 14])))) for i in range(12)] + [(50, "w1 w1 w1"), (51, None), (52, "  "), (None, "w1 w2"), (53, "unknown w1")]
    docs = [(i, " ".join(draw.choices(words, k=draw.randrange(0, 60)))) for i in range(60)] + [(100, items[0][1]), (101, None), (102, ""), (103, " ".join(["w1"] * 40))]
    docs += [(200 + i, " x ".join([items[i][1]] * 2)) for i in range(12)]
    frame, wanted = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    some = [x for x in items if x[0] is not None]
    expected, close = brute.contamination(docs, some), near(docs, some)
    for segment, block in ((200_000, 1_000_000), (1, 1), (100, 60)):
        monkeypatch.setattr(decontam, "SEGMENT_WORDS", segment)
        monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
        monkeypatch.setattr(decontam, "STEP", segment)
        for size in (10, 3):
            want = expected if size == 10 else brute.contamination(docs, some, size)
            got = {r.doc_id: r for r in decontam.decontaminate(frame, wanted, size=size).collect()}
            assert {d: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for d, r in got.items()} == want
            if size == 10:
                assert {d: r.n_near_items for d, r in got.items()} == close


def test_index_holds_every_place(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 50)
    docs = [(i, " ".join(f"t{j % 7}" for j in range(i))) for i in range(40)] + [(None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.monotonically_increasing_id())
    found = {}
    for s in decontam.index(frame, 14).collect():
        ends = [sum(s.sizes[: k + 1]) for k in range(len(s.sizes))]
        at = {p: bytes(t) for t, end, n in zip(s.terms, ends, s.sizes, strict=True) for p in s.places[end - n : end]}
        for doc, n, start in zip(s.doc_ids, s.counts, s.starts, strict=True):
            found[doc] = b" ".join(at[start + k] for k in range(n)).decode()
    assert found == {d: t or "" for d, t in docs}


def test_index_is_stored_in_small_parts(spark, tmp_path, monkeypatch):
    """Neither a page nor a row group grows with the number of segments in a task: both are held in memory, pages beyond the heap too."""
    draw = random.Random(8)
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 100_000)
    kept = []
    monkeypatch.setattr(decontam, "stored", lambda df, **options: kept.append(common.stored(df, **options)) or kept[-1])
    text = " ".join(f"w{draw.randrange(1 << 30)}" for _ in range(100_000))
    docs = spark.range(24).coalesce(1).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    items = spark.createDataFrame([(1, " ".join(text.split()[5:20]))], "item_id long, text string")
    assert {(r.n_words, r.n_hit) for r in decontam.decontaminate(docs, items).collect()} == {(100_000, 15)}
    for file in kept[0].inputFiles():
        groups = pq.ParquetFile(file.removeprefix("file:")).metadata
        assert groups.num_rows == 24
        assert max(groups.row_group(k).total_byte_size for k in range(groups.num_row_groups)) < 24_000_000
        assert all(groups.row_group(k).column(c).num_values <= 100 for k in range(groups.num_row_groups) for c in range(groups.num_columns))
