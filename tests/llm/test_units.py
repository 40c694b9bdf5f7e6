import re

import pytest
from pyspark.sql import functions as F

from terrakiln.llm import common, unit_dedup

SPLIT = {"line": r"\n", "paragraph": r"\n[^\S\n]*\n\s*"}


@pytest.mark.parametrize("unit", ["line", "paragraph"])
@pytest.mark.parametrize("hot", [False, True])
def test_every_repeated_unit_goes(spark, sf, monkeypatch, unit, hot):
    if hot:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(common, "HOT_ROWS", 3)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120").collect()]
    docs += [(1000 + i, f"a notice\n\nown {i}\nA  NOTICE") for i in range(20)] + [(2000, None), (None, "a notice"), (2001, " \n\n ")]
    # Two texts of one id: the one whose digest is less comes first.
    docs += [(3000, "one side\nshared by both"), (3000, "shared by both\nother side"), (3000, "shared by both\nother side")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    texts = sorted({(r.doc_id, r.h, r.text) for r in frame.where("doc_id is not null and text is not null").collect()})
    seen, expected = set(), set()
    for doc, h, text in texts:
        at = 0
        for part in re.split(f"({SPLIT[unit]})", text):
            normal = " ".join(part.lower().split())
            if normal and normal in seen:
                expected |= {(doc, h, at + i) for i, c in enumerate(part) if not c.isspace()}
            if normal:
                seen.add(normal)
            at += len(part)
    got = unit_dedup.repeats(frame, unit=unit).collect()
    solid = {(d, h, i) for d, h, t in texts for i, c in enumerate(t) if not c.isspace()}
    assert {(r.doc_id, r.text_hash, i) for r in got for i in range(r.start, r.end)} & solid == expected and expected
    cleaned = unit_dedup.remove(frame, unit_dedup.repeats(frame, unit=unit)).collect()
    assert len(cleaned) == len(docs)
    left = {(r.doc_id, r.h): "".join((r.text or "").split()) for r in cleaned if r.doc_id is not None and r.h}
    for doc, h, text in texts:
        assert left[doc, h] == "".join(c for i, c in enumerate(text) if not c.isspace() and (doc, h, i) not in expected)


def test_copies_and_shared_ids(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(i, f" {long}\n") for i in range(5, 45)] + [(50, "x " + long), (3, long.upper()), (60, long[:100]), (61, long[:100])]
    rows += [(70, f"{long} one"), (70, f"{long} two"), (None, long)]
    for most in (10_000, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        monkeypatch.setattr(unit_dedup, "BROADCAST_COPIES", most)
        monkeypatch.setattr(common, "HOT_ROWS", 7)
        got = unit_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        spans = sorted((r.doc_id, r.start, r.end, r.n_words) for r in got)
        # The upper-case text is the first of all; 5 is its copy in other letters, by windows.
        assert spans == sorted([(i, 1, 1 + len(long), 80) for i in range(5, 45)] + [(50, 2, 2 + len(long), 80)] + [(70, 0, len(long), 80)] * 2)
        assert {r.doc_id: r.kept_doc_ids for r in got}[44] == [5]


def test_names_in_the_way(spark):
    df = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, _cut int")
    with pytest.raises(ValueError, match="_cut"):
        unit_dedup.remove(df, unit_dedup.repeats(df))
