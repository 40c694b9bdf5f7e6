import math
import random

import numpy as np
from pyspark.sql import functions as F

from terrakiln.llm import simhash
from tests.llm import brute


def test_wide_fingerprints():
    assert simhash.bits_at(0.8) == 38 and simhash.bits_at(1.0) == 0
    for text in ("", "one", "A b  c\nd e f g", "a b c d e f g h a b c d e f g h " * 3, "é ß x\x85y z w v"):
        got = simhash.wide_fingerprint(text.encode(), 5)
        assert sum(int(x) << 64 * k for k, x in enumerate(got)) == brute.wide_fingerprint(text)
    assert not simhash.wide_fingerprint(None, 5).any()


def test_one_anchor_within_the_radius():
    draw = np.random.default_rng(1)
    fps = draw.integers(0, 1 << 63, (50, simhash.WIDE_WORDS)).astype(np.uint64)
    anchors = simhash.nearest_anchors(fps)
    assert anchors.shape == (50, simhash.SAMPLES) and (anchors >> simhash.SAMPLE_BITS == np.arange(simhash.SAMPLES)).all()
    for row, own in zip(fps, anchors, strict=True):
        whole = sum(int(x) << 64 * k for k, x in enumerate(row))
        for k, sample in enumerate(simhash.SAMPLED):
            word = sum((whole >> int(b) & 1) << j for j, b in enumerate(sample))
            anchor = int(own[k]) & (1 << simhash.SAMPLE_BITS) - 1
            syndrome = 0
            for j in range(simhash.CODED):
                syndrome ^= (anchor >> j & 1) * (j + 1)
            assert syndrome == 0 and (word ^ anchor).bit_count() <= 1


def test_similar_documents(spark, sf):
    draw = random.Random(11)
    words = [f"v{i}" for i in range(3000)]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for i in range(40):
        base = draw.choices(words, k=draw.choice([60, 300]))
        rows.append((10_000 + 10 * i, " ".join(base)))
        for j in range(1, 4):  # one word in 40 to 60 is another
            own = [draw.choice(words) if draw.random() < 1 / (40 + 7 * j) else w for w in base]
            rows.append((10_000 + 10 * i + j, " ".join(own)))
    rows += [(20_000 + i, None if i % 2 else " \n") for i in range(4)] + [(5, rows[5][1]), (None, rows[300][1])]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    known = sorted({(d, t) for d, t in rows if d is not None}, key=lambda x: x[0])
    roots = brute.linked([brute.wide_fingerprint(t) for _, t in known], simhash.bits_at(0.8))
    want = {d: known[r][0] for (d, _), r in zip(known, roots, strict=True)}
    assert sum(of[d] == want[d] for d in want) >= 0.99 * len(want)
    sets = [(d, brute.shingles(t)) for d, t in known]
    close = lost = false = 0
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            same = len(x & y) / len(x | y) if x or y else 1.0
            if same >= 0.8:
                close += 1
                lost += of[a] != of[b]
            false += same < 0.5 and of[a] == of[b]
    assert close > 60 and lost <= 0.1 * close and false == 0
    assert {r.component_id for r in got if r.doc_id is None} == {of[10_000 + 10 * ((rows[300][0] - 10_000) // 10)]} if rows[300][0] >= 10_000 else True
    assert simhash.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chance_of_a_shared_anchor():
    draw = np.random.default_rng(4)
    for similarity, least in ((0.8, 0.94), (0.85, 0.975), (0.9, 0.993)):
        part = math.acos(2 * similarity / (1 + similarity)) / math.pi
        a = draw.integers(0, 2, (2000, 256)).astype(np.uint8)
        b = a ^ (draw.random((2000, 256)) < part).astype(np.uint8)
        x, y = (simhash.nearest_anchors(np.packbits(v, axis=1, bitorder="little").view(np.uint64)) for v in (a, b))
        assert (x == y).any(axis=1).mean() > least
