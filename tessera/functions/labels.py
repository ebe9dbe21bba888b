"""Category labels and display strings as column expressions."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F


def _within(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text, rounding the exact binary value (format_string rounds its decimal form)."""
    text = F.call_function("format_number", value, F.lit("0." + "0" * digits))
    # Below one unit of the last digit format_number takes the double next to half a unit for half a unit.
    half = 0.5 / 10**digits
    size = F.abs(value)
    above = size >= half if Fraction(half) > Fraction(1, 2 * 10**digits) else size > half
    unit = F.concat(F.when(value < 0, "-").otherwise(""), F.lit("0." + "0" * (digits - 1) + "1"))
    return F.when((size < 1.0 / 10**digits) & above, unit).otherwise(text)


def first_match(rules: list[tuple[Column, Column]], default: Column) -> Column:
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default)


def region_type(lat: Column, lon: Column) -> Column:
    # Region rectangles and half-planes, in order; the first match wins.
    rules = [
        (_within(lat, lon, 35.0, 36.0, 139.0, 140.0), "tokyo_metropolitan"),
        (_within(lat, lon, 34.0, 35.0, 135.0, 136.0), "osaka_metropolitan"),
        (_within(lat, lon, 35.0, 36.0, 136.0, 137.0), "nagoya_metropolitan"),
        (lat > 43.0, "hokkaido"),
        (lat < 32.0, "kyushu"),
        (_within(lat, lon, 35.0, 40.0, 140.0, 141.0), "tohoku"),
    ]
    return first_match([(c, F.lit(v)) for c, v in rules], F.lit("regional"))


# Prefecture rectangles (south, north, west, east) and their labels.
PREFECTURES = [
    (35.0, 36.0, 139.0, 140.0, "東京都"),
    (34.0, 35.0, 135.0, 136.0, "大阪府"),
    (35.0, 36.0, 136.0, 137.0, "愛知県"),
    (43.0, 44.0, 141.0, 142.0, "北海道"),
    (33.0, 34.0, 130.0, 131.0, "福岡県"),
]


def address_label(lat: Column, lon: Column, short: bool = False) -> Column:
    """Prefecture label, else the coordinates: five labels and 4 decimals, or four and 3."""
    known = PREFECTURES[:4] if short else PREFECTURES
    suffix = "" if short else "周辺"
    digits = 3 if short else 4
    rules = [
        (_within(lat, lon, s, n, w, e), F.lit(name + suffix)) for s, n, w, e, name in known
    ]
    place = F.concat(
        F.lit("緯度: "), fixed(lat, digits), F.lit(", 経度: "), fixed(lon, digits)
    )
    return first_match(rules, place)


def in_national_window(lat: Column, lon: Column) -> Column:
    # The window served by the national source.
    return _within(lat, lon, 24.0, 46.5, 122.0, 146.5)


def band(value: Column, low: float, high: float, names: tuple[str, str, str]) -> Column:
    return first_match(
        [(value < low, F.lit(names[0])), (value < high, F.lit(names[1]))], F.lit(names[2])
    )


def density_band(sparsity: Column, low: float = 0.3, high: float = 0.7) -> Column:
    return band(sparsity, low, high, ("high_density", "medium_density", "low_density"))


def resilience_band(resilience: Column) -> Column:
    return band(resilience, 0.3, 0.7, ("low", "medium", "high"))


def polycentricity_band(multi_nodality: Column) -> Column:
    return band(multi_nodality, 1.0, 2.5, ("monocentric", "moderate", "polycentric"))


def location_label(location_id: Column, name: Column) -> Column:
    named = F.format_string("%s (ID %d)", name, location_id)
    plain = F.format_string("Location %d", location_id)
    return F.when(F.length(F.trim(name)) > 0, named).otherwise(plain)


def location_metric_label(
    location_id: Column, name: Column, sparsity: Column, resilience: Column
) -> Column:
    return F.concat(
        location_label(location_id, name),
        F.lit(" | S: "),
        fixed(sparsity, 3),
        F.lit(", R: "),
        fixed(resilience, 3),
    )


def marker_size(value: Column) -> Column:
    filled = F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))
    return F.least(F.greatest(filled, F.lit(0.0)), F.lit(1.0)) * F.lit(0.8) + F.lit(0.2)


def title_case(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))
