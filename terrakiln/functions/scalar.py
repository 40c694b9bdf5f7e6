"""Scalar expressions: missing values, dates, terrain, vegetation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The marks of missing pixels in slope, aspect and composite rasters.
SLOPE_NODATA, ASPECT_NODATA, COMPOSITE_NODATA = 255, 32767, -9999.0
#: `uniform` repeats itself after so many numbers.
PERIOD = 1_000_003


def finite(value: Column) -> Column:
    """The value, or null for NaN and the infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def known(value: Column, nodata: float) -> Column:
    return F.nullif(finite(value), F.lit(nodata))


def from_epoch_ms(value: Column) -> Column:
    """Timestamp of milliseconds since 1970; null for a missing or unbounded one."""
    bounded = F.when(F.abs(finite(value.cast("double"))) < 9.2e15, value)
    return F.timestamp_millis(bounded.cast("bigint"))


def from_text(value: Column) -> Column:
    return F.try_to_timestamp(value)


def epoch_unit(largest: float | None) -> str:
    """The unit that a column of epochs is in, by its largest value."""
    if largest is not None and largest > 1e14:
        return "ns"
    return "ms" if largest is not None and largest > 1e11 else "text"


def year_of_epoch(value: Column, unit: str) -> Column:
    """Year of an epoch in `unit` (or a date as text); -1 if missing."""
    if unit == "text":
        return F.coalesce(F.year(F.try_to_timestamp(value.cast("string"))), F.lit(-1))
    ms = F.floor(finite(value.cast("double")) / 1e6) if unit == "ns" else finite(value.cast("double"))
    return F.coalesce(F.year(F.timestamp_millis(ms.cast("bigint"))), F.lit(-1))


def plain_name(name: Column) -> Column:
    """The part before a unit in brackets: 'tmmx (K)' is tmmx."""
    return F.trim(F.substring_index(name, "(", 1))


def scene_dates(alarm: Column, year: Column, months: tuple[int, ...]) -> tuple[Column, Column]:
    """First and last day of the scenes to look at: 60 days before to 30 after, else the year's months to day 28."""
    first = F.coalesce(F.date_sub(F.to_date(alarm), 60), F.make_date(year, F.lit(min(months)), F.lit(1)))
    last = F.coalesce(F.date_add(F.to_date(alarm), 30), F.make_date(year, F.lit(max(months)), F.lit(28)))
    return first, last


def south_factor(aspect: Column) -> Column:
    """1 for 180 degrees, 0 for the northern half; null for a missing aspect."""
    return F.when(finite(aspect).isNotNull(), F.greatest(F.lit(0.0), F.cos(F.radians(aspect - 180))))


def slope_aspect(left: Column, right: Column, above: Column, below: Column, size: Column | float) -> tuple[Column, Column]:
    """Degrees of slope and mathematical aspect from the four neighbours of a cell; a flat cell has aspect 180."""
    size = F.lit(size) if isinstance(size, (int, float)) else size
    dx, dy = (right - left) / (2 * size), (below - above) / (2 * size)
    slope = F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))
    angle = F.when((dx == 0) & (dy == 0), F.pi()).otherwise(F.atan2(dy, -dx))
    return slope, F.pmod(F.degrees(angle), F.lit(360.0))


def density(ndvi: Column) -> Column:
    return F.least(F.greatest((ndvi + 1) / 2, F.lit(0.0)), F.lit(1.0))


def reflectance(number: Column) -> Column:
    """Digital numbers over 2 are ten-thousandths."""
    return F.when(number > 2, number / 10000).otherwise(number)


def normalised_difference(low: Column, high: Column) -> Column:
    """(high - low) / (high + low); null where that is undefined."""
    return finite(F.try_divide(high - low, high + low))


def uniform(number: Column, a: int, b: int, seed: int, m: int = PERIOD) -> Column:
    """A reproducible fraction of [0, 1) for an integer: integer arithmetic that any SQL engine can repeat."""
    return F.pmod(number.cast("bigint") * F.lit(a).cast("bigint") + F.lit(b * seed).cast("bigint"), F.lit(m).cast("bigint")) / F.lit(float(m))


def half_away(value: Column, digits: int) -> Column:
    """Rounded as DuckDB rounds a double: scaled, to the nearest whole number, halves away from zero, and back."""
    return F.round(value * F.lit(10.0**digits)) / F.lit(10.0**digits)
