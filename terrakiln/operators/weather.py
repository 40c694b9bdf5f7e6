"""Trailing windows of daily series before an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakiln.functions.scalar import finite


def within(days: int, when: Column, anchor: Column) -> Column:
    """Closed at both ends, with the time of day: a midnight anchor sees days + 1 midnights."""
    return (when >= anchor - F.expr(f"INTERVAL {days} DAYS")) & (when <= anchor)


def _bucket(when: Column, days: int) -> Column:
    """Number of the span of `days` days that a time is in."""
    return F.floor(F.datediff(when, F.lit("1970-01-01").cast("date")) / days)


def _buckets(anchor: Column, days: int) -> Column:
    """The two spans that the `days` days before an anchor touch."""
    own = _bucket(anchor, days)
    return F.explode(F.when(own.isNotNull(), F.array(own - 1, own)).otherwise(F.array(own)))


def trailing(
    anchors: DataFrame, series: DataFrame, place: str, anchor: str, when: str, values: list[str], windows: tuple[int, ...], summed: tuple[str, ...] = (), keys: tuple[str, ...] = ()
) -> DataFrame:
    """keys, place, anchor and {value}_max_{w}d, _mean_{w}d (and _sum_{w}d of `summed`) over the last w days.

    One join on the place and on spans of the longest window's length serves all windows: an anchor meets the
    rows of two spans, however long the place's series is. An anchor without rows keeps nulls. Values are taken to hundredths, so that sums don't depend on their order.
    """
    own = list(dict.fromkeys([*keys, place, anchor]))
    cents = [F.round(finite(F.col(v).cast("double")) * 100).cast("bigint").alias(v) for v in values]
    longest = max(windows)
    right = series.select(F.col(place).alias("_place"), F.col(when).alias("_when"), _bucket(F.col(when), longest).alias("_span"), *cents)
    left = anchors.select(*own, _buckets(F.col(anchor), longest).alias("_at"))
    same = (F.col(place) == F.col("_place")) & (F.col("_at") == F.col("_span"))
    met = left.join(right, same & within(longest, F.col("_when"), F.col(anchor)), "left")
    out = []
    for v in values:
        for w in windows:
            x = F.when(within(w, F.col("_when"), F.col(anchor)), F.col(v))
            out += [(F.max(x) / 100.0).alias(f"{v}_max_{w}d"), (F.sum(x) / F.count(x) / 100.0).alias(f"{v}_mean_{w}d")]
            if v in summed:
                any_row = F.max(within(w, F.col("_when"), F.col(anchor)).cast("int"))
                out.append((F.when(any_row == 1, F.coalesce(F.sum(x), F.lit(0))) / 100.0).alias(f"{v}_sum_{w}d"))
    return met.groupBy(*own).agg(*out)


def complete(anchors: DataFrame, series: DataFrame, place: str, anchor: str, when: str, window: int, share: float, start: str | None = None) -> DataFrame:
    """place, anchor and n_days of the anchors whose window has `share` of its days at least, and that follow `start`."""
    right = series.select(F.col(place).alias("_place"), F.to_date(when).alias("_day")).distinct()
    first = F.to_date(F.col(anchor) - F.expr(f"INTERVAL {window} DAYS"))
    met = anchors.select(place, anchor).distinct().where(F.col(anchor).isNotNull())
    if start:
        met = met.where(F.col(anchor) >= F.to_timestamp_ntz(F.lit(f"{start} 00:00:00")))
    right = right.withColumn("_span", _bucket(F.col("_day"), window))
    met = met.withColumn("_at", _buckets(F.col(anchor), window))
    same = (F.col(place) == F.col("_place")) & (F.col("_at") == F.col("_span"))
    met = met.join(right, same & F.col("_day").between(first, F.to_date(anchor)), "left")
    out = met.groupBy(place, anchor).agg(F.count("_day").alias("n_days"))
    return out.where(F.col("n_days") >= share * (window + 1))


def fresh_columns(columns: list[str], variables: tuple[str, ...]) -> list[tuple[str, str]]:
    """(given, plain) names of the known variables, in the variables' order: 'pr (mm)' is pr."""
    plain = {c.split("(")[0].strip(): c for c in columns}
    return [(plain[v], v) for v in variables if v in plain]
