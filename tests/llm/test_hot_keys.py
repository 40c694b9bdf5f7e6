import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from terrakiln.llm import common, components, language, secret_scan, simhash
from tests.llm import brute


@pytest.mark.parametrize("most", [10_000, 0])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach(spark, monkeypatch, most, how):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = [(i, 7 if i % 3 else i) for i in range(300)] + [(5, 7), (5, 7), (400, None)]
    table = [(7, "hot", 200), (9, "one", 1), (1000, "none", 3)]
    got = common.attach(spark.createDataFrame(rows, "i long, k long"), spark.createDataFrame(table, "k long, v string, n long"), ["k"], "n", how)
    values = {k: v for k, v, _ in table}
    want = [(i, k, values.get(k)) for i, k in rows if how == "left" or k in values]
    assert sorted(map(str, want)) == sorted(str((r.i, r.k, r.v)) for r in got.collect()) and set(got.columns) == {"i", "k", "v"}


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    edges = [(1000, i) for i in range(2, 300)] + [(2000, 2001)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(2, 300), 1000], 2), 2000: 2000, 2001: 2000}


def test_large_groups_are_split(spark):
    draw = random.Random(8)
    base = draw.getrandbits(64)
    # Over SMALL_GROUP members with equal bits in the first block: some linked, some far from one another.
    fps = sorted({base & (1 << 21) - 1 | draw.getrandbits(43) << 21 for _ in range(400)})
    fps += [f ^ 1 << 30 ^ 1 << 50 ^ 1 << 60 for f in fps[:50]] + [fps[0] ^ 1 << b for b in range(21, 64)]
    signed = [f - (f >> 63 << 64) for f in fps]
    roots = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    classes = defaultdict(set)
    expected = brute.linked(fps)
    for f, r in zip(signed, expected, strict=True):
        classes[roots.get(f, f)].add(r)
    assert all(len(x) == 1 for x in classes.values()) and len(classes) == len(set(expected))


def test_a_value_in_many_repositories_is_an_example(spark):
    key = "ghp_" + "a1B2c3" * 6
    rows = [(i, f"use {key} now", "one", f"r{i}") for i in range(5)] + [(9, f"use {key}x now", "two", "r9"), (10, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, o string, r string")
    got = {r.doc_id: (r.n_live, r.n_example) for r in secret_scan.scan(df, repository=F.col("r"), owner=F.col("o")).collect()}
    assert got == {**dict.fromkeys(range(5), (0, 1)), 9: (1, 0), 10: (0, 0)}
    got = {r.doc_id: r.n_live for r in secret_scan.scan(df, repository=F.col("r"), owner=F.col("o"), max_repositories=5).collect()}
    assert got[0] == 1


def fused(rows, languages):
    """language.fuse in plain Python on rows of (declared, suffix, host, scores)."""
    n = len(languages)

    def normal(scores):
        raised = [math.exp(x - max(scores)) for x in scores]
        return [x / sum(raised) for x in raised]

    p = [normal(r[3]) for r in rows]
    sums = defaultdict(lambda: [0.0] * n)
    for (declared, suffix, host, _), own in zip(rows, p, strict=True):
        for key in ("all", ("d", declared), ("s", suffix), ("h", suffix, host)):
            sums[key] = [a + b for a, b in zip(sums[key], own, strict=True)]
    total = sum(sums["all"])
    corpus = [(x + 1) / (total + n) for x in sums["all"]]
    kinds = len({r[0] for r in rows})
    out = []
    for (declared, suffix, host, scores), own in zip(rows, p, strict=True):
        left = {k: [max(0.0, a - b) for a, b in zip(sums[k], own, strict=True)] for k in (("d", declared), ("s", suffix), ("h", suffix, host))}
        whole = {k: max(0.0, sum(sums[k]) - 1) for k in left}
        final = []
        for i in range(n):
            s = (left["s", suffix][i] + 20 * corpus[i]) / (whole["s", suffix] + 20)
            h = (left["h", suffix, host][i] + 10 * s) / (whole["h", suffix, host] + 10)
            given = (left["d", declared][i] + 1) / (sums["all"][i] + kinds + 1)
            final.append(scores[i] + math.log(h) + (math.log(given) if declared else 0.0))
        out.append(normal(final))
    return out


@pytest.mark.parametrize("most", [10_000, 0])
def test_fusion_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    monkeypatch.setattr(common, "HOT_ROWS", 15)
    draw = random.Random(3)
    languages = ["de", "en", "fr"]
    rows = []
    for _ in range(120):
        scores = [-draw.random() * 8 for _ in languages]
        scores[draw.randrange(3)] = 0.0
        rows.append((draw.choice(["", "de", "en", "xx"]), draw.choice(["com", "de", ""]), draw.choice(["h"] * 5 + ["a", "b"]), [x - max(scores) for x in scores]))
    rows += [rows[0], ("", "", "", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, *r[:3], 1, r[3]) for i, r in enumerate(rows)], "doc_id long, declared string, suffix string, host string, n_bytes long, text_scores array<double>")
    got = {r.doc_id: r for r in language.fuse(df, languages).collect()}
    for i, want in enumerate(fused(rows, languages)):
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[i].posterior, want, strict=True))
        assert abs(got[i].probability - max(want)) < 1e-9 and got[i].lang == languages[got[i].posterior.index(max(got[i].posterior))]
    assert got[len(rows) - 1].text_lang is None


def test_names_in_the_way(spark):
    model = language.TextModel(["de"], __import__("numpy").ones((1, language.FEATURES)))
    df = spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="lang"):
        language.identify([language.evidence(df, "text", False, model, ["doc_id", "lang"], F.lit(""), F.lit(""), F.lit(""))], model.languages)
