"""Scalar expressions on columns: geodesy, predicates, colours, classes and dates. None needs a Python worker."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6_371_000.0
M_PER_DEG = 111_320.0
M_PER_DEG_LAT = 110_540.0

# Speed ceilings in metres a second by activity type.
SPEED_CEILINGS: dict[str, float] = {
    "walking": 12, "running": 18, "cycling": 30, "scooter": 30, "car": 90, "taxi": 90, "motorcycle": 90, "bus": 60,
    "tram": 40, "metro": 50, "train": 140, "boat": 45, "skiing": 50, "stationary": 30, "airplane": 400,
}
DEFAULT_CEILING = 300.0

# Colours of known categories, and those ignored unless asked for.
CATEGORY_COLORS: dict[str, str] = {
    "walking": "#4fc97e", "running": "#a3e635", "cycling": "#2dd4bf", "skiing": "#93c5fd", "car": "#d1d5db", "taxi": "#cbd5e1",
    "motorcycle": "#fb923c", "scooter": "#fdba74", "bus": "#a78bfa", "metro": "#c084fc", "tram": "#e879f9", "train": "#f472b6",
    "boat": "#38bdf8", "kayaking": "#7dd3fc", "airplane": "#ef4444", "stationary": "#9ca3af", "unknown": "#7d8590", "bogus": "#6b7280",
}
IGNORED_TYPES = ("bogus", "unknown")
UNDATED_COLOR = "#7d8590"
# Hue, saturation and lightness of the oldest and the newest year.
OLDEST_HSL, NEWEST_HSL = (48, 48, 62), (215, 85, 55)

# Codes of railway and highway tags, and what a road class costs.
RAIL_KINDS = {"subway": 1, "light_rail": 2, "tram": 3, "rail": 4, "narrow_gauge": 5, "monorail": 6}
ROAD_TUNNEL_KIND, BUS_KIND = 7, 20
ROAD_CLASSES = {"motorway": 1, "trunk": 2, "primary": 3, "secondary": 4, "tertiary": 5, "unclassified": 6, "residential": 7, "living_street": 8}
CLASS_PENALTIES = {1: 0.55, 2: 0.6, 3: 0.7, 4: 0.8, 5: 0.9, 6: 1.05, 7: 1.1, 8: 1.6, 20: 0.85}
#: Kinds that a ride of each type may run on.
KINDS_OF_TYPE = {"metro": (1, 2), "subway": (1, 2), "tram": (3, 2), "train": (4, 5, 6)}
ROAD_TUNNEL_TYPES = ("car", "taxi", "bus")

# Tolerances in degrees of the detail levels, and the zooms from which the next finer one is shown.
DETAIL_TOLERANCES = (1e-3, 1e-4, 1e-5)
DETAIL_ZOOMS = (8, 13)


def lookup(key: Column, values: Mapping, default) -> Column:
    """``values[key]``, or ``default`` for what isn't there (null, too)."""
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    # Not least(): that would take null for 1.
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def equirectangular_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """A short distance in metres on the plane that touches the first point."""
    dx = (lon2 - lon1) * F.cos(F.radians(lat1)) * M_PER_DEG
    return F.hypot(dx, (lat2 - lat1) * M_PER_DEG_LAT)


def finite(x: Column) -> Column:
    """If a double is a finite number; false for null."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def valid_position(lat: Column, lon: Column) -> Column:
    """If a position is finite, on the globe, and not the exact origin that failing receivers report."""
    on_globe = (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))
    return finite(lat) & finite(lon) & F.coalesce(on_globe, F.lit(False))


def boxes_meet(min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> Column:
    """If a row's box (min_lat, min_lon, max_lat, max_lon) meets the given one; null boxes meet none. Parquet prunes by it."""
    return (F.col("max_lat") >= min_lat) & (F.col("min_lat") <= max_lat) & (F.col("max_lon") >= min_lon) & (F.col("min_lon") <= max_lon)


BOUNDS = ("min_lat", "min_lon", "max_lat", "max_lon")


def box_union(a: Column, b: Column) -> Column:
    """The least box (struct of BOUNDS) that holds both; a box of nulls holds nothing."""
    return F.struct(*((F.least if n.startswith("min") else F.greatest)(a[n], b[n]).alias(n) for n in BOUNDS))


def box_within(inner: Column, outer: Column) -> Column:
    """If one box lies within the other, edges included; false for a box of nulls."""
    hit = (inner["min_lat"] >= outer["min_lat"]) & (inner["max_lat"] <= outer["max_lat"]) & (inner["min_lon"] >= outer["min_lon"]) & (inner["max_lon"] <= outer["max_lon"])
    return F.coalesce(hit, F.lit(False))


def box_padded(box: Column, margin: Column | float) -> Column:
    """A box wider by ``margin`` degrees on each side, within the globe."""
    m = margin if isinstance(margin, Column) else F.lit(float(margin))
    low = lambda n, least: F.when(box[n].isNotNull(), F.greatest(F.lit(least), box[n] - m)).alias(n)
    high = lambda n, most: F.when(box[n].isNotNull(), F.least(F.lit(most), box[n] + m)).alias(n)
    return F.struct(low("min_lat", -90.0), low("min_lon", -180.0), high("max_lat", 90.0), high("max_lon", 180.0))


def overlaps(start: Column, end: Column, since: int | None = None, until: int | None = None) -> Column:
    """If a span of time may overlap [since, until]; unknown times pass."""
    out = F.lit(True)
    if since is not None:
        out = out & (end.isNull() | (end >= since))
    if until is not None:
        out = out & (start.isNull() | (start <= until))
    return out


def js_round(x: Column) -> Column:
    """The nearest whole number, halves upward (also below zero)."""
    return F.floor(x + 0.5)


def speed_ceiling(type_: Column, overrides: Mapping[str, float] | None = None, default: float = DEFAULT_CEILING) -> Column:
    return lookup(type_, {k: float(v) for k, v in {**SPEED_CEILINGS, **(overrides or {})}.items()}, float(default))


def string_hash32(s: Column) -> Column:
    """31 * hash + code, wrapped to 32 bits, over a string's UTF-16 units: two for a character above U+FFFF."""
    wrap = lambda h: F.pmod(h + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    digits = F.hex(F.encode(s, "UTF-16BE"))
    unit = lambda k: F.conv(F.substring(digits, k * 4 + 1, F.lit(4)), 16, 10).cast("long")
    units = F.when(F.length(digits) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length(digits) / 4).cast("int") - 1)), unit))
    return F.aggregate(units, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))


def category_color(name: Column) -> Column:
    """A known category's colour, or a hue from the name's hash."""
    hue = F.pmod(string_hash32(name), F.lit(360))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in CATEGORY_COLORS.items() for x in p)), name), F.format_string("hsl(%d, 65%%, 60%%)", hue))


def year_color(year: Column, first: Column, last: Column) -> Column:
    """A point of the ramp from the oldest to the newest year; undated years are grey, a lone year is newest."""
    t = F.when(last > first, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (year - first) / (last - first)))).otherwise(1.0)
    h, s, l = (js_round(F.lit(float(a)) + (b - a) * t) for a, b in zip(OLDEST_HSL, NEWEST_HSL, strict=True))
    return F.when(year.isNull() | (year <= 0), F.lit(UNDATED_COLOR)).otherwise(F.format_string("hsl(%d, %d%%, %d%%)", h, s, l))


def years_between(start_ms: Column, end_ms: Column) -> Column:
    """The UTC years from a start to an end, empty if either is unknown or they are out of order."""
    a, b = F.year(F.timestamp_millis(start_ms)), F.year(F.timestamp_millis(end_ms))
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def rail_kind(tag: Column) -> Column:
    return lookup(tag, RAIL_KINDS, 0)


def road_class(tag: Column) -> Column:
    """The class of a highway tag; links share the class of their road, what is unknown is 0."""
    return lookup(F.regexp_replace(tag, "^(motorway|trunk|primary|secondary|tertiary)_link$", "$1"), ROAD_CLASSES, 0)


def class_cost(kind: Column, emphasis: float | Column) -> Column:
    return F.pow(lookup(kind, CLASS_PENALTIES, 1.0), emphasis if isinstance(emphasis, Column) else F.lit(float(emphasis)))


def emphasis(distance_deg: Column) -> Column:
    """How much a route of this length prefers big roads: its kilometres over 8, within 1 and 4."""
    return F.least(F.lit(4.0), F.greatest(F.lit(1.0), distance_deg * M_PER_DEG / 1000 / 8))


def corridor_factor(distance_deg: Column, width: float = 0.002, strength: float = 4.0, most: float = 50.0) -> Column:
    r = distance_deg / width
    return F.least(F.lit(most), 1 + strength * r * r)


def detail_for_zoom(zoom: Column) -> Column:
    return F.when(zoom < DETAIL_ZOOMS[0], 0).when(zoom < DETAIL_ZOOMS[1], 1).otherwise(2)


def iso_week_of_name(name: Column) -> tuple[Column, Column]:
    """(year, week) of the first ``YYYY-Www`` in a file name, null where there is none or no such week."""
    year, week = (F.regexp_extract(name, r"(\d{4})-W(\d{2})", i) for i in (1, 2))
    week = F.when(week != "", week.cast("int"))
    ok = week.between(1, 53)
    return F.when(ok, F.when(year != "", year.cast("int"))), F.when(ok, week)


def iso_week(ts_ms: Column) -> tuple[Column, Column]:
    """(year, week) of a time by ISO 8601: a week belongs to the year of its Thursday."""
    ts = F.timestamp_millis(ts_ms)
    return F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def hex_color(color: Column) -> Column:
    """A colour given as hex or hsl(h, s%, l%), as # and six hex digits; grey for anything else."""
    n = r"(\d+\.?\d*|\.\d+)"
    part = lambda i: F.regexp_extract(color, rf"(?i)^hsl\(\s*{n}\s*,\s*{n}%\s*,\s*{n}%\s*\)$", i).try_cast("double")
    h, s, l = part(1), part(2) / 100, part(3) / 100
    # A channel is the lightness less or plus the chroma, by how far the hue is from the channel's own.
    chroma = s * F.least(l, 1 - l)

    def channel(turn: int) -> Column:
        k = F.pmod(h / 30 + turn, F.lit(12.0))
        v = l - chroma * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return F.lower(F.lpad(F.hex(F.floor(v * 255 + 0.5).cast("long")), 2, "0"))

    made = F.concat(F.lit("#"), channel(0), channel(8), channel(4))
    return F.when(color.rlike("(?i)^#[0-9a-f]{6}$"), color).otherwise(F.coalesce(made, F.lit("#888888")))


def hilbert(lat: Column, lon: Column, bits: int = 16) -> Column:
    """The place of a position on a Hilbert curve through the cells of ``bits`` halvings of the globe each way: near numbers are near positions."""
    n = 1 << bits
    cell = lambda value, low, span: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((value - low) / span * n))).cast("long")

    def step(at: Column, side: Column) -> Column:
        x, y = at["x"], at["y"]
        right, up = x.bitwiseAND(side) > 0, y.bitwiseAND(side) > 0
        quarter = F.when(right & up, 2).when(right, 3).when(up, 1).otherwise(0)
        turned = lambda own, other: F.when(up, own).when(right, n - 1 - other).otherwise(other)
        return F.struct(turned(x, y).alias("x"), turned(y, x).alias("y"), (at["d"] + side * side * quarter).alias("d"))

    start = F.struct(cell(lon, -180.0, 360.0).alias("x"), cell(lat, -90.0, 180.0).alias("y"), F.lit(0).cast("long").alias("d"))
    sides = F.array(*(F.lit(1 << k).cast("long") for k in reversed(range(bits))))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.aggregate(sides, start, step, lambda at: at["d"]))
