import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrakiln.llm import mixing

SCHEMA = "doc_id long, tokens long, p_clean double, p_low double, p_toxic double"


def plain(p, tok, b, rounds=60_000):
    """Projected gradient in plain numpy, in the metric of the tokens: the least distance it comes to."""
    m = (p * tok[:, None]).T @ p
    step = 1 / np.linalg.eigvalsh(m)[-1]
    r = last = np.ones(len(tok))
    for k in range(rounds):  # with momentum
        y = r + k / (k + 3) * (r - last)
        g = (p * (tok * y)[:, None]).sum(0) - b
        last, r = r, np.maximum(0, y - step * (p @ g))
    return np.linalg.norm((p * (tok * r)[:, None]).sum(0) - b)


@pytest.mark.parametrize(("alpha", "shares", "feasible"), [
    ((3, 0.6, 0.3), (0.8, 0.15, 0.05), True),
    ((1, 1, 1), (0.34, 0.33, 0.33), True),
    ((6, 3, 3), (0.92, 0.06, 0.02), False),
    ((20, 10, 10), (0.97, 0.02, 0.01), False),
    ((2, 2, 8), (0.9, 0.05, 0.05), False),
])
def test_least_squares(spark, alpha, shares, feasible):
    draw = np.random.default_rng(7)
    p, tok = draw.dirichlet(alpha, 300), draw.integers(10, 2000, 300)
    df = spark.createDataFrame([(i, int(tok[i]), *map(float, p[i])) for i in range(300)], SCHEMA)
    rows, reached, goal = mixing.fit_rates(df, mixing.Targets(dict(zip(mixing.DOMAINS, shares, strict=True))))
    rate = np.array([r.rate for r in rows.orderBy("doc_id").collect()])
    b = np.array(list(goal.values()))
    assert (rate >= 0).all() and np.allclose((p * (tok * rate)[:, None]).sum(0), reached)
    far, least = np.linalg.norm(np.array(reached) - b), plain(p, tok, b)
    if feasible:
        assert far <= 1.01e-4 * b.sum() * math.sqrt(3) and not mixing.residuals(reached, goal)
    else:
        # Cells of 1/200 cost a little where only the outermost documents count.
        assert least > 1e-3 * b.sum() and far <= 1.01 * least + 2e-3 * b.sum() and mixing.residuals(reached, goal)


def test_rates_of_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    rows, reached, goal = mixing.fit_rates(none, mixing.Targets())
    assert rows.count() == 0 and reached == [0.0] * 3 and set(goal.values()) == {0.0}
    empty = spark.createDataFrame([(1, 0, 0.5, 0.3, 0.2), (2, 0, 0.5, 0.3, 0.2)], SCHEMA)
    assert [r.rate for r in mixing.fit_rates(empty, mixing.Targets())[0].collect()] == [1.0, 1.0]
    same = spark.createDataFrame([(1, 10, 1.0, 0.0, 0.0), (1, 10, 1.0, 0.0, 0.0), (None, 0, 1.0, 0.0, 0.0)], SCHEMA)
    rows, reached, goal = mixing.fit_rates(same, mixing.Targets({"clean": 1.0}))
    assert sorted(r.rate for r in rows.collect()) == pytest.approx([1.0] * 3) and reached == pytest.approx([20.0, 0.0, 0.0])


def test_default_targets_are_met(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = mixing.mixed(docs, labels)
    assert not out.missing and set(out.reached) == set(out.goal) == set(mixing.DOMAINS)
    told = out.rows.join(labels, "doc_id").where("quality = 1 and toxic = 0").agg(F.count("*"), F.count_if(F.col("copies") == 0)).first()
    assert told[1] < 0.05 * told[0]


def test_posteriors_are_calibrated_on_unseen_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(2)) == 0
    known = labels.select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    slim = docs.select("doc_id", "text").join(labels.select("doc_id"), "doc_id")
    model = mixing.train(slim, known.where(half))
    rows = mixing.posteriors(slim.where(~half), model).join(known, "doc_id").collect()
    p = np.array([(r.p_clean, r.p_low, r.p_toxic) for r in rows])
    y = np.array([mixing.DOMAINS.index(r.domain) for r in rows])
    assert (p.argmax(1) == y).mean() > 0.93
    for k in range(3):  # what is said with a probability happens as often
        assert abs(p[:, k].mean() - (y == k).mean()) < 0.03
        sure = p[:, k] > 0.9
        assert (y[sure] == k).mean() > 0.9


def plain_model(rows):
    """Weights in plain Python from (features, domain) lists."""
    size = {d: sum(x[1] == d for x in rows) for d in mixing.DOMAINS}
    total = len(rows)
    out = {}
    for f in {f for own, _ in rows for f in own}:
        n = {d: sum(f in own for own, x in rows if x == d) for d in mixing.DOMAINS}
        every = sum(n.values())
        tells = max(abs(n[d] - every * size[d] / total) / math.sqrt(every * max(size[d] / total * (1 - size[d] / total), 1e-3)) for d in mixing.DOMAINS)
        if every >= mixing.LEAST_DOCS and tells >= mixing.LEAST_DEVIATIONS:
            rate = (every + 0.5) / (total + 1)
            logs = {d: math.log((n[d] + mixing.SMOOTHING * rate) / (size[d] + mixing.SMOOTHING)) for d in mixing.DOMAINS}
            out[f] = (logs["low"] - logs["clean"], logs["toxic"] - logs["clean"])
    return out


def plain_features(text):
    text = text or ""
    words = [w for w in re.split("[ \t\n\v\f\r]+", text.lower()) if w]
    n, size = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip(" ")]
    symbols = sum(c in mixing.SYMBOLS for c in text)
    kinds = {"symbols": min(6, 8 * symbols // n), "distinct words": 8 * len(set(words)) // n, "length": size.bit_length() - 1, "repeated lines": math.floor(4 * (1 - len(set(lines)) / max(1, len(lines)))), "word length": min(12, size // n)}
    return {*words, *[f"{k} {v}" for k, v in kinds.items()]}


def test_model_against_plain_python(spark):
    draw = random.Random(2)
    say = {"clean": "sun sea sky air", "low": "# | $$$ buy", "toxic": "idiot trash scum sun"}
    rows = [(i, " ".join(draw.choices(say[d].split() + ["the", "of"], k=draw.randrange(3, 30))), d) for i, d in enumerate(draw.choices(mixing.DOMAINS, (6, 2, 2), k=240))]
    rows.append((1000, None, None))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t, _ in rows], "doc_id long, text string, tokens int, row string")
    labels = spark.createDataFrame([(i, d) for i, _, d in rows if d] * 2 + [(5000, "low"), (7, None)], "doc_id long, domain string")
    model = mixing.train(docs.select("doc_id", "text"), labels)
    want = plain_model([(plain_features(t), d) for _, t, d in rows if d])
    got = {r.feature: (r.low, r.toxic) for r in model.weights.collect()}
    assert set(got) == set(want) and all(got[f] == pytest.approx(want[f]) for f in want)
    out = {r.doc_id: r for r in mixing.posteriors(docs, model).collect()}
    for i, t, _ in rows:
        x = [sum(want[f][k] for f in plain_features(t) if f in want) for k in range(2)]
        x = [math.copysign(math.log1p(abs(v)), v) for v in x]
        z = [0.0] + [a + b * x[0] + c * x[1] for a, b, c in model.calibration]
        raised = [math.exp(v - max(z)) for v in z]
        assert (out[i].p_clean, out[i].p_low, out[i].p_toxic) == pytest.approx([v / sum(raised) for v in raised])
        assert out[i].tokens == len((t or "").split())


def test_calibration_against_plain_descent(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 2)) * 3
    y = np.where(x[:, 0] + draw.normal(size=300) > 2, 1, np.where(x[:, 1] + draw.normal(size=300) > 2, 2, 0))
    df = spark.createDataFrame([(mixing.DOMAINS[k], *map(float, v)) for k, v in zip(y, x, strict=True)], "domain string, x_low double, x_toxic double")
    got = np.array(mixing._calibrated(df))
    full = np.r_[np.c_[np.ones(300), x], np.tile([1.0, 0.0, 0.0], (3, 1))]
    told = np.eye(3)[np.r_[y, 0, 1, 2]][:, 1:]
    b = np.zeros((2, 3))
    for _ in range(40_000):
        e = np.exp(full @ b.T)
        p = e / (1 + e.sum(1, keepdims=True))
        b -= 5e-4 * ((p - told).T @ full + mixing.SLOPE_PENALTY * b * [0, 1, 1])
    assert np.abs(got - b).max() < 1e-2


def test_rates_stay_near_one_where_targets_are_out_of_reach(spark):
    draw = np.random.default_rng(5)
    p = np.r_[draw.dirichlet((95, 2, 3), 300), draw.dirichlet((5, 5, 90), 40), draw.dirichlet((5, 90, 5), 40)]
    p[:, 2] += 0.03  # no document is under the target's share
    p /= p.sum(1, keepdims=True)
    tok = draw.integers(100, 500, len(p))
    df = spark.createDataFrame([(i, int(tok[i]), *map(float, p[i])) for i in range(len(p))], SCHEMA)
    kept, far = {}, {}
    for left in (mixing.MOST_LEFT, math.inf):
        rows, reached, goal = mixing.fit_rates(df, mixing.Targets(), most_left=left)
        rate = np.array([r.rate for r in rows.orderBy("doc_id").collect()])
        kept[left] = (rate[:300] > 0).mean(), rate.max()
        far[left] = np.linalg.norm(np.array(reached) - np.array(list(goal.values()))) / sum(goal.values())
    assert kept[mixing.MOST_LEFT][0] > 0.9 and kept[mixing.MOST_LEFT][1] < 5
    assert far[math.inf] <= far[mixing.MOST_LEFT] < 3 * far[math.inf] and kept[math.inf][0] < kept[mixing.MOST_LEFT][0]
