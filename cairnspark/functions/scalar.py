"""Column expressions: distance, ratios, bins, rounding, targets. Null means missing; NaN is never used."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(a.isNotNull(), 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def anchor_distances(lat: Column, lon: Column, anchors: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """A distance for each anchor, and the least of them."""
    each = {f"dist_{name}_km": haversine_km(lat, lon, F.lit(y), F.lit(x)) for name, (y, x) in anchors.items()}
    return {**each, "dist_min_km": F.least(*each.values())}


def grid_cell(lat: Column, lon: Column, step: float, missing: str = "__missing__") -> Column:
    """Equal-angle cell id; null coordinates give the sentinel."""
    part = [F.floor(c / step).cast("string") for c in (lat, lon)]
    return F.when(lat.isNull() | lon.isNull(), missing).otherwise(F.concat(part[0], F.lit("_"), part[1]))


def curve_code(lat: Column, lon: Column, level: int) -> Column:
    """The number of a cell of 360 / 2^level degrees along a Z-curve, null without a place: close places mostly have close numbers, so a
    table sorted by it keeps them in the same files, and what is asked of a cell is a range of numbers. Levels up to 31."""
    def spread(x: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    side = 360.0 / 2**level
    y, x = F.floor((lat + 90) / side).cast("long"), F.pmod(F.floor((lon + 180) / side).cast("long"), F.lit(1 << level))
    return F.shiftleft(spread(y), 1).bitwiseOR(spread(x))


def curve_cell(lat: Column, lon: Column, level: int, missing: str = "__missing__") -> Column:
    """The same number as ``level`` digits of base 4: a cell's parents are the prefixes of its name."""
    code = curve_code(lat, lon, level)
    return F.coalesce(F.lpad(F.conv(code.cast("string"), 10, 4), level, "0"), F.lit(missing))


def curve_range(code: Column, level: int, finest: int) -> tuple[Column, Column]:
    """The least and greatest ``finest`` code in a cell of a coarser level."""
    first = F.shiftleft(code.cast("long"), 2 * (finest - level))
    return first, first + ((1 << 2 * (finest - level)) - 1)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, with 1 for a denominator that is null or not positive."""
    return a / F.when(b > 0, b).otherwise(1.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null unless the denominator is positive."""
    return a / F.when(b > 0, b)


def edge_bin(x: Column, edges: Sequence[float], missing: float = -1.0) -> Column:
    """How many ascending edges are at most x; a null counts as ``missing``."""
    value = F.coalesce(x, F.lit(missing))
    return reduce(Column.__add__, [F.when(value >= e, 1).otherwise(0) for e in edges]).cast("int")


def half_even(x: Column, missing: int = -1) -> Column:
    return F.bround(F.coalesce(x.cast("double"), F.lit(float(missing)))).cast("int")


def log1p_or_zero(x: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0)))


def unit_clip(x: Column) -> Column:
    return F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def age(year: Column, reference: int) -> Column:
    """Years since ``year``, at least 0; null stays null."""
    return F.when(year.isNotNull(), F.greatest(F.lit(0), F.lit(reference) - year))


def log_target(y: Column, size: Column | None = None) -> Column:
    return F.log1p(y if size is None else y / F.when(size > 0, size).otherwise(1.0))


def from_log_target(p: Column, size: Column | None = None, floor: float = 0.0) -> Column:
    value = F.expm1(p) if size is None else F.expm1(p) * F.when(size > 0, size).otherwise(1.0)
    return F.greatest(value, F.lit(floor))


def decade(year: Column) -> Column:
    return F.when(year.isNull(), "missing").otherwise(F.concat((F.floor(year / 10) * 10).cast("int").cast("string"), F.lit("s")))


def absolute_error(y: Column, p: Column) -> Column:
    return F.abs(y - p)


def percentage_error(y: Column, p: Column) -> Column:
    return F.abs(y - p) / F.greatest(F.abs(y), F.lit(1e-9))
