"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrakiln.llm.common import attach, checkpointed, empty_if_null


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""(?:{KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in their order: name, pattern, group with the secret, its least length. Where a pattern's run is
#: greedy and complete the least length stands in the pattern itself, which drops the same matches.
KINDS = (
    ("assign", ASSIGN, 1, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("vendor", r"gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|sk_live_[A-Za-z0-9]{16,}|-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 10),
)
BASE = 3


def _candidates(text: Column, matches: Column, kind: int) -> Column:
    """Array of structs: kind, order, characters before (since the last match), matched, of the secret, its hash."""
    _, pattern, group, _ = KINDS[kind]
    pieces = F.split(text, pattern, -1)
    values = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.transform(
        F.arrays_zip(matches.alias("m"), values.alias("v"), F.slice(pieces, 1, F.size(matches)).alias("p")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("order"),
            F.length(x["p"]).alias("gap"),
            F.length(x["m"]).alias("width"),
            F.length(x["v"]).alias("chars"),
            F.xxhash64(x["v"]).alias("secret"),
        ),
    )
    return F.when(F.size(matches) > 0, zipped)


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: Column | None = None, owner: Column | None = None, max_owners: int = 2, max_repositories: int = 4) -> DataFrame:
    """One row for each row of `df`: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    Candidates of all kinds come from whole texts, with offsets in code points from the pieces between the
    matches. Hashes of their values are counted over the corpus by distinct repositories and owners: a value of
    up to `max_owners` owners and `max_repositories` repositories looks live ('live'), a value in more hands or
    more places is a copied example. All base spans stay; spans of further kinds join only if live. n_live and n_example count all candidates. A
    null text counts as empty, a null owner or repository as ''; repeated rows are rows of their own; other
    columns are not read.
    """
    repository = F.lit("") if repository is None else repository
    owner = repository if owner is None else owner
    docs = df.select(
        F.col(doc_id).alias("doc_id"),
        empty_if_null(owner).alias("owner"),
        empty_if_null(repository).alias("repository"),
        empty_if_null(F.col(text)).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    docs = docs.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m{k}") for k, (_, p, _, _) in enumerate(KINDS)])
    some = F.array_compact(F.array(*[_candidates(F.col("text"), F.col(f"m{k}"), k) for k in range(len(KINDS))]))
    rows = docs.select("row", "doc_id", "owner", "repository", F.explode_outer(F.flatten(some)).alias("c")).select("row", "doc_id", "owner", "repository", "c.*")
    before = Window.partitionBy("row", "kind").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(before))
    least = F.element_at(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("kind") + 1)
    # Failing matches stay as rows without a kind, so that their document keeps its row.
    good = F.col("kind").isNotNull() & (F.col("chars") >= least)
    rows = checkpointed(
        rows.select(
            "row",
            "doc_id",
            "owner",
            "repository",
            F.when(good, F.col("kind")).alias("kind"),
            F.when(good, F.col("end") - F.col("width")).alias("start"),
            F.when(good, F.col("end")).alias("end"),
            F.when(good, F.col("secret")).alias("secret"),
        )
    )
    spread = (
        rows.where(F.col("secret").isNotNull())
        .groupBy("secret", "owner", "repository")
        .agg(F.count("*").alias("n"))
        .groupBy("secret")
        .agg(F.count_distinct("owner").alias("owners"), F.count("*").alias("repositories"), F.sum("n").alias("n"))
        .select("secret", ((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).alias("live"), "n")
    )
    # Rows without a secret take their number in its place, which keeps them apart; whatever it meets is not read.
    keyed = rows.select("row", "doc_id", "kind", "start", "end", F.coalesce("secret", "row").alias("secret"))
    marked = attach(keyed, checkpointed(spread), ["secret"], "n", "left")
    span = F.struct("start", "kind", "end", "live")
    docs = marked.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("all"))
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    base = F.filter("all", lambda x: x["kind"] < BASE)
    count = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long")
    return docs.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.filter("all", lambda x: (x["kind"] < BASE) | x["live"])).alias("spans"),
        F.size(F.filter("all", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("all", lambda x: ~x["live"])).cast("long").alias("n_example"),
    )
