"""Mixing by soft membership, in DataFrame functions only."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakiln.llm.common import checkpointed, empty_if_null

LOG = logging.getLogger(__name__)

#: Labelled documents that train the classifier, about, by a hash of their ids; its features, at most.
SAMPLE_ROWS = 20_000
VOCABULARY = 1_000
#: A feature stands in so many labelled documents, and deviates so many standard deviations in some domain.
LEAST_DOCS = 4
LEAST_DEVIATIONS = 4.0
#: Documents that each domain seems to have more, spread as the feature is over all.
SMOOTHING = 2.0
#: Weight of the squared slopes in the calibration.
SLOPE_PENALTY = 1.0
#: Posteriors within a cell of this many to a side share one rate: (GRID + 1) (GRID + 2) / 2 cells at most.
GRID = 200
SYMBOLS = "#*$%&|<>"
#: Rates move on towards targets out of reach while a step leaves this part of the miss at most.
MOST_LEFT, FREE_PULL = 0.5, 1e-3
DOMAINS = ("clean", "low", "toxic")


@dataclass(frozen=True)
class Targets:
    """Shares of the domains' expected tokens, and the budget as a multiple of the clean tokens over their share."""

    shares: dict[str, float] = field(default_factory=lambda: {"clean": 0.92, "low": 0.06, "toxic": 0.02})
    budget: float = 1.0


def domain_of(quality: Column, toxic: Column) -> Column:
    """The labelled domain: toxic, else low (quality 0), else clean; null without labels."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality.isNotNull(), "clean")


def _words(text: Column) -> Column:
    # Plain replacements and a split at one character are several times as fast as a split at a pattern.
    spaced = F.lower(text)
    for gap in "\t\n\v\f\r":
        spaced = F.replace(spaced, F.lit(gap), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def shape(text: Column, words: Column) -> Column:
    """Features of a text's form, as strings that can't be words (they hold a space)."""
    n_words, size = F.greatest(F.size(words), F.lit(1)), F.greatest(F.length(text), F.lit(1))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    repeated = F.lit(1.0) - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
    kinds = {
        "symbols": F.least(F.lit(6), F.floor(F.lit(8) * symbols / n_words)),
        "distinct words": F.floor(F.lit(8) * F.size(F.array_distinct(words)) / n_words),
        "length": F.floor(F.log2(size)),
        "repeated lines": F.floor(F.lit(4) * repeated),
        "word length": F.least(F.lit(12), F.floor(size / n_words)),
    }
    return F.array(*[F.concat(F.lit(f"{k} "), v.cast("string")) for k, v in kinds.items()])


def digest_of(text: Column) -> Column:
    """The long by which rows with the same id, or none, are told apart."""
    return F.xxhash64(empty_if_null(text))


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, tokens and features: the different words of the whole text and its shape's features."""
    text = empty_if_null(F.col("text"))
    rows = docs.select(*keep, text.alias("text"), _words(text).alias("words"))
    return rows.select(*keep, F.size("words").cast("long").alias("tokens"), F.concat(F.array_distinct("words"), shape(F.col("text"), F.col("words"))).alias("features"))


@dataclass(frozen=True)
class Model:
    """Features with weights for low and toxic against clean, and the calibration: for each an intercept and two slopes."""

    weights: DataFrame
    calibration: tuple[tuple[float, float, float], ...] = ((0.0, 0.0, 0.0), (0.0, 0.0, 0.0))


def _weighted(counts: DataFrame, halves: tuple[int, ...], sizes: dict[tuple[str, int], int], vocabulary: int) -> DataFrame:
    """(feature, low, toxic): log P(feature | domain) - log P(feature | clean) from the counts of some halves of the sample."""
    n = {d: sum((F.col(f"n_{d}_{h}") for h in halves[1:]), F.col(f"n_{d}_{halves[0]}")) for d in DOMAINS}
    size = {d: sum(sizes.get((d, h), 0) for h in halves) for d in DOMAINS}
    total = sum(size.values())
    every = F.lit(0)
    for x in n.values():
        every = every + x
    rate = (every + 0.5) / F.lit(total + 1.0)
    logs = {d: F.log((n[d] + F.lit(SMOOTHING) * rate) / F.lit(size[d] + SMOOTHING)) for d in DOMAINS}
    shares = {d: size[d] / max(1, total) for d in DOMAINS}
    off = [F.abs(n[d] - every * shares[d]) / F.sqrt(every * max(shares[d] * (1 - shares[d]), 1e-3)) for d in DOMAINS]
    told = counts.select("feature", every.alias("n"), F.greatest(*off).alias("tells"), *[(logs[d] - logs["clean"]).alias(d) for d in DOMAINS[1:]])
    told = told.where((F.col("n") >= LEAST_DOCS) & (F.col("tells") >= LEAST_DEVIATIONS))
    return told.orderBy(F.col("tells").desc(), "feature").limit(vocabulary).select("feature", *DOMAINS[1:])


def _scored(rows: DataFrame, weights: DataFrame, *by: str) -> DataFrame:
    """by, x_low and x_toxic: the sums of the features' weights on a logarithmic scale; `weights` is small."""
    met = rows.select(*by, F.explode_outer("features").alias("feature")).join(F.broadcast(weights), "feature", "left")
    sums = met.groupBy(*by).agg(*[F.coalesce(F.sum(d), F.lit(0.0)).alias(f"x_{d}") for d in DOMAINS[1:]])
    return sums.select(*by, *[(F.signum(f"x_{d}") * F.log1p(F.abs(F.col(f"x_{d}")))).alias(f"x_{d}") for d in DOMAINS[1:]])


def _solved(m: list[list[float]], b: list[float]) -> list[float]:
    """x of m x = b by Gauss elimination; m is positive definite."""
    n = len(b)
    a = [[*m[i], b[i]] for i in range(n)]
    for k in range(n):
        best = max(range(k, n), key=lambda i: abs(a[i][k]))
        a[k], a[best] = a[best], a[k]
        a[k] = [x / a[k][k] for x in a[k]]
        for i in range(n):
            if i != k:
                a[i] = [x - a[i][k] * y for x, y in zip(a[i], a[k], strict=True)]
    return [row[n] for row in a]


def _calibrated(rows: DataFrame, most_steps: int = 40) -> tuple[tuple[float, float, float], ...]:
    """Multinomial logistic regression of `domain` on x_low and x_toxic by Newton steps, one aggregate each.

    Each domain has one document more, without a feature. Slopes are held small by SLOPE_PENALTY.
    """
    x = [F.lit(1.0), F.col("x_low"), F.col("x_toxic")]
    size = rows.count()

    def measured(b: list[float]) -> tuple[float, list[float], list[list[float]]]:
        """Loss, gradient and curvature at the two domains' parameters."""
        z = [sum((x[j] * F.lit(b[3 * k + j]) for j in (1, 2)), F.lit(b[3 * k])) for k in range(2)]
        top = F.greatest(F.lit(0.0), *z)
        raised = [F.exp(v - top) for v in z]
        whole = raised[0] + raised[1] + F.exp(-top)
        p = [v / whole for v in raised]
        told = [F.when(F.col("domain") == d, 1.0).otherwise(0.0) for d in DOMAINS[1:]]
        own = told[0] * z[0] + told[1] * z[1]
        point = rows.select(*[v.alias(f"x{j}") for j, v in enumerate(x)], *[v.alias(f"p{k}") for k, v in enumerate(p)], *[v.alias(f"t{k}") for k, v in enumerate(told)], (F.log(whole) + top - own).alias("loss"))
        col = F.col
        sums = [F.sum("loss")] + [F.sum((col(f"p{k}") - col(f"t{k}")) * col(f"x{j}")) for k in range(2) for j in range(3)]
        pairs = [(k, j, m, i) for k in range(2) for j in range(3) for m in range(2) for i in range(3)]
        sums += [F.sum(col(f"p{k}") * ((1.0 if k == m else 0.0) - col(f"p{m}")) * col(f"x{j}") * col(f"x{i}")) for k, j, m, i in pairs]
        values = [v or 0.0 for v in point.agg(*sums).first()]
        loss, g, h = values[0], values[1:7], [values[7 + 6 * r : 13 + 6 * r] for r in range(6)]
        none = [math.exp(b[0]), math.exp(b[3])]
        rest = 1.0 + sum(none)
        loss += 3 * math.log(rest) - b[0] - b[3]
        for k in range(2):
            share = none[k] / rest
            g[3 * k] += 3 * share - 1
            for m in range(2):
                h[3 * k][3 * m] += 3 * share * ((k == m) - none[m] / rest)
            for j in (1, 2):
                loss += SLOPE_PENALTY * b[3 * k + j] ** 2 / 2
                g[3 * k + j] += SLOPE_PENALTY * b[3 * k + j]
                h[3 * k + j][3 * k + j] += SLOPE_PENALTY
        return loss, g, h

    b, part = [0.0] * 6, 1.0
    now = measured(b)
    for _ in range(most_steps):
        step = _solved(now[2], now[1])
        if max(map(abs, step)) < 1e-4 or part < 1e-3:
            break
        tried = [v - part * s for v, s in zip(b, step, strict=True)]
        then = measured(tried) if max(abs(tried[0]), abs(tried[3])) < 300 else (math.inf, [], [])
        if then[0] <= now[0]:
            done = now[0] - then[0] < 1e-7 * (size + 1)
            b, now, part = tried, then, min(1.0, 2 * part)
            if done:
                break
        else:
            part /= 2
    return tuple(b[:3]), tuple(b[3:])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY) -> Model:
    """Naive Bayes on the presence of features in labelled documents, calibrated on documents it hasn't seen.

    About `sample_rows` labelled documents, those whose ids hash lowest (a bounded broadcast joins them to the
    texts), give counts of features by domain. Features that tell (LEAST_DOCS, LEAST_DEVIATIONS; the
    `vocabulary` strongest at most) have log-ratio weights. Each half of the sample is scored with the other
    half's weights, and a logistic regression on these scores gives the posteriors. No labels: no feature and
    equal posteriors.
    """
    known = checkpointed(labels.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain")))
    part = min(1.0, sample_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(part * (1 << 30)))
    rows = features(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"), "doc_id", "domain")
    rows = checkpointed(rows.select(F.monotonically_increasing_id().alias("row"), "domain", "features", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(2)).cast("int").alias("half")))
    sizes = {(d, h): n for d, h, n in rows.groupBy("domain", "half").count().collect()}
    cases = [(d, h) for d in DOMAINS for h in (0, 1)]
    ones = [F.count_if((F.col("domain") == d) & (F.col("half") == h)).alias(f"n_{d}_{h}") for d, h in cases]
    counts = checkpointed(rows.select("domain", "half", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), *ones).where(F.col("n") >= LEAST_DOCS))
    crossed = [_scored(rows.where(F.col("half") == 1 - h), checkpointed(_weighted(counts, (h,), sizes, vocabulary)), "row", "domain") for h in (0, 1)]
    calibration = _calibrated(checkpointed(crossed[0].unionByName(crossed[1]).coalesce(1))) if sizes else Model.calibration
    return Model(checkpointed(_weighted(counts, (0, 1), sizes, vocabulary)), calibration)


def posteriors(docs: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, digest, tokens, p_clean, p_low, p_toxic) of every row of `docs`; the model has VOCABULARY rows at most.

    Each text is read once; only sums of weights leave their row.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest_of(F.col("text")).alias("digest"), "text")
    scored = _scored(features(rows, "row", "doc_id", "digest"), model.weights, "row", "doc_id", "digest", "tokens")
    z = {d: F.lit(a) + F.lit(b) * F.col("x_low") + F.lit(c) * F.col("x_toxic") for d, (a, b, c) in zip(DOMAINS[1:], model.calibration, strict=True)}
    z = {"clean": F.lit(0.0), **z}
    top = F.greatest(*z.values())
    raised = {d: F.exp(v - top) for d, v in z.items()}
    whole = raised["clean"] + raised["low"] + raised["toxic"]
    return scored.select("row", "doc_id", "digest", "tokens", *[(e / whole).alias(f"p_{d}") for d, e in raised.items()])


def fit_rates(rows: DataFrame, targets: Targets, tolerance: float = 1e-4, least_pull: float = 1e-9, most_left: float = math.inf) -> tuple[DataFrame, list[float], dict[str, float]]:
    """`rows` with double column rate >= 0, the domains' expected tokens at these rates, and their targets.

    Nonnegative least squares: least |A r - b|^2 over r >= 0, A the expected tokens of the documents by domain
    and b the targets. Documents whose posteriors share a cell of GRID share a rate, so one aggregate over the
    corpus leaves a table of bounded size, from which all else follows exactly. On it projected gradient
    steps, of which the sum u is kept (r = max(0, 1 + p . u), p a cell's posteriors): u takes a step against
    the gradient g = A r - b + pull * u, scaled by the inverse of M + pull, M the sum of tokens * p p' over the
    cells whose rate isn't 0, and halved while the distance doesn't fall. pull holds the rates near 1; it goes
    down tenfold from 0.1 until every domain is within `tolerance` of the budget, at last to `least_pull`, where the
    distance is that of least squares: g = 0 is its optimum's condition, also where targets are out of reach.
    There the optimum lies in ever fewer documents of ever greater rates; with `most_left` the pull, from FREE_PULL on,
    stops before a fall that leaves more than this part of the greatest miss, so that rates leave 1 only for a gain.
    """
    k = len(DOMAINS)
    at = {f"_{d}": F.floor(F.col(f"p_{d}") * GRID).cast("int") for d in DOMAINS[1:]}
    keyed = rows.withColumns(at)
    sums = [F.sum(F.col("tokens") * F.col(f"p_{d}")).alias(f"s_{d}") for d in DOMAINS] + [F.avg(f"p_{d}").alias(f"m_{d}") for d in DOMAINS]
    cells = keyed.groupBy(*at).agg(F.sum("tokens").cast("double").alias("t"), *sums)
    cells = cells.select(*at, "t", *[f"s_{d}" for d in DOMAINS], *[F.when(F.col("t") > 0, F.col(f"s_{d}") / F.col("t")).otherwise(F.col(f"m_{d}")).alias(f"m_{d}") for d in DOMAINS])
    cells = checkpointed(cells.coalesce(1))
    s, p = [F.col(f"s_{d}") for d in DOMAINS], [F.col(f"m_{d}") for d in DOMAINS]
    first = cells.agg(F.sum("t"), *[F.sum(x) for x in s]).first()
    total, held = first[0] or 0.0, [x or 0.0 for x in first[1:]]
    norm = sum(targets.shares.values())
    share = [targets.shares.get(d, 0.0) / norm for d in DOMAINS]
    budget = targets.budget * (held[0] / share[0] if share[0] else sum(held))
    goal = dict(zip(DOMAINS, [budget * x for x in share], strict=True))
    if not total:
        return rows.withColumn("rate", F.lit(1.0)), [0.0] * k, goal
    b = [x / total for x in goal.values()]

    def rate_at(u: list[float]) -> Column:
        return F.greatest(F.lit(0.0), sum((x * F.lit(v) for x, v in zip(p, u, strict=True)), F.lit(1.0)))

    def measured(u: list[float], pull: float) -> tuple[float, list[float], list[list[float]], list[float]]:
        """The distance (its dual's value), the gradient, its derivative and the domains' tokens at u; tokens as parts of all."""
        point = cells.select("t", *s, *p, rate_at(u).alias("r"))
        on = F.when(F.col("r") > 0, F.col("t")).otherwise(0.0)
        found = point.agg(F.sum(F.col("t") * F.col("r") * F.col("r")), *[F.sum(x * F.col("r")) for x in s], *[F.sum(on * x * y) for x in p for y in p]).first()
        square, *rest = [(x or 0.0) / total for x in found]
        now, m = rest[:k], [rest[k + i * k : 2 * k + i * k] for i in range(k)]
        value = square / 2 + pull * sum(x * x for x in u) / 2 - sum(x * y for x, y in zip(b, u, strict=True))
        g = [x - y + pull * z for x, y, z in zip(now, b, u, strict=True)]
        return value, g, [[m[i][j] + pull * (i == j) for j in range(k)] for i in range(k)], now

    def off(now: list[float]) -> float:
        return max(abs(x - y) for x, y in zip(now, b, strict=True))

    u, pull = [0.0] * k, 0.1
    here, held = measured(u, pull), None
    while True:
        for _ in range(8):
            if max(map(abs, here[1])) <= 1e-3 * min(off(here[3]), 1e-3):
                break
            step = _solved(here[2], here[1])
            part, falls = 1.0, sum(x * y for x, y in zip(step, here[1], strict=True))
            while part > 1e-6:
                tried = [x - part * y for x, y in zip(u, step, strict=True)]
                then = measured(tried, pull)
                if then[0] <= here[0] - 1e-4 * part * falls + 1e-15 * abs(here[0]):
                    break
                part /= 2
            else:
                break
            u, here = tried, then
        if pull <= least_pull or off(here[3]) <= tolerance / 2 * sum(b):
            break
        if pull < FREE_PULL and off(here[3]) > most_left * off(held[1][3]):
            u, here = held
            break
        held = u, here
        pull = max(pull / 10, least_pull)
        here = measured(u, pull)
    rates = cells.select(*at, rate_at(u).alias("rate"))
    out = keyed.join(F.broadcast(rates), list(at)).select(*[F.col(f"`{c}`") for c in rows.columns], "rate")
    return out, [x * total for x in here[3]], goal


def residuals(reached: list[float], goal: dict[str, float], tolerance: float = 1e-4) -> dict[str, float]:
    """Tokens reached less the goal, as shares of all the goal's, of the domains that are off by more than `tolerance`."""
    budget = sum(goal.values())
    off = {d: (x - goal[d]) / budget for d, x in zip(DOMAINS, reached, strict=True)} if budget else {}
    return {d: x for d, x in off.items() if abs(x) > tolerance}


@dataclass(frozen=True)
class Mixed:
    """The rows of `mix`, the domains' expected tokens and their goal, and what is missing (see `residuals`)."""

    rows: DataFrame
    reached: dict[str, float]
    goal: dict[str, float]
    missing: dict[str, float]


def mixed(docs: DataFrame, labels: DataFrame, targets: Targets | None = None) -> Mixed:
    """`mix` with the totals that its rates reach."""
    slim = docs.select("doc_id", F.col("text"))
    model = train(slim, labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")))
    rows, reached, goal = fit_rates(checkpointed(posteriors(slim, model)), targets or Targets(), most_left=MOST_LEFT)
    off = residuals(reached, goal)
    if off:
        LOG.warning("target shares not reached: %s of the goal's tokens", ", ".join(f"{d} {x:+.4f}" for d, x in off.items()))
    draw = F.pmod(F.xxhash64("doc_id", "digest", F.lit(1729)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return Mixed(rows.withColumn("copies", copies.cast("long")), dict(zip(DOMAINS, reached, strict=True)), goal, off)


def mix(docs: DataFrame, labels: DataFrame, targets: Targets | None = None) -> DataFrame:
    """(row, doc_id, digest, tokens, p_clean, p_low, p_toxic, rate, copies) for every row of `docs` (doc_id, text).

    `labels`: doc_id, quality, toxic; other columns of both tables are not read. rate is the expected number of
    copies; copies is its whole part and one more with the chance of the rest, drawn by a hash of the id and
    digest_of(text), so that runs agree. Null texts have no tokens; repeated rows are rows of their own, drawn
    alike; rows without an id are told by text. Labels that repeat count once (the first domain by name);
    null labels count for nothing. Empty tables give none. Targets that the posteriors can't meet are logged
    with what is missing (`mixed` returns it); the rates then stop near 1, as MOST_LEFT says.
    """
    return mixed(docs, labels, targets).rows
