"""Coordinate reference systems: transverse Mercator (Krüger series), UTM, Web Mercator, Gauß-Krüger with datum shift.

Every function returns stages (see steps) that read columns and add the named results. Planar (x, y)
of the geographic system 4326 is (longitude, latitude).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import steps
from geoloom.functions.steps import Stages


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    inverse_flattening: float

    @property
    def f(self) -> float:
        return 1 / self.inverse_flattening

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)


# Ellipsoids; the shift from DHDN to WGS84 (metres, arc seconds, ppm; position vector);
# coefficients of n, n^2 ... n^6 in the Krüger series as published by Karney (2011).
GRS80, WGS84, BESSEL = Ellipsoid(6378137.0, 298.257222101), Ellipsoid(6378137.0, 298.257223563), Ellipsoid(6377397.155, 299.1528128)
DHDN_SHIFT, DHDN_TURN, DHDN_SCALE = (598.1, 73.7, 418.2), (0.202, 0.045, -2.455), 6.7
ALPHA = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600],
    [0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840],
    [0, 0, 0, 0, 0, 212378941 / 319334400],
]
BETA = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600],
    [0, 0, 0, 0, 4583 / 161280, -108847 / 3991680],
    [0, 0, 0, 0, 0, 20648693 / 638668800],
]
DELTA = [
    [2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675],
    [0, 7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945],
    [0, 0, 56 / 15, -136 / 35, -1262 / 105, 73814 / 2835],
    [0, 0, 0, 4279 / 630, -332 / 35, -399572 / 14175],
    [0, 0, 0, 0, 4174 / 315, -144838 / 6237],
    [0, 0, 0, 0, 0, 601676 / 22275],
]
NAMES = {
    4326: "WGS 84 (geographic lat/lon)",
    25832: "ETRS89 / UTM zone 32N",
    25833: "ETRS89 / UTM zone 33N",
    32632: "WGS 84 / UTM zone 32N",
    32633: "WGS 84 / UTM zone 33N",
    4647: "ETRS89 / UTM zone 32N (zE-N, 32-prefixed easting)",
    5650: "ETRS89 / UTM zone 33N (zE-N, 33-prefixed easting)",
    3857: "WGS 84 / Pseudo-Mercator (web maps)",
    31466: "DHDN / Gauß-Krüger zone 2 (Bessel)",
    31467: "DHDN / Gauß-Krüger zone 3 (Bessel)",
    31468: "DHDN / Gauß-Krüger zone 4 (Bessel)",
    31469: "DHDN / Gauß-Krüger zone 5 (Bessel)",
}


def num(x: float) -> str:
    """A double literal in both Spark and ANSI SQL."""
    return f"CAST('{x!r}' AS DOUBLE)"


def _series(table, n: float) -> list[float]:
    return [sum(c * n ** (k + 1) for k, c in enumerate(row)) for row in table]


@dataclass(frozen=True)
class TransverseMercator:
    ellipsoid: Ellipsoid
    lon0: float
    k0: float
    false_e: float
    false_n: float = 0.0

    @property
    def n(self) -> float:
        return self.ellipsoid.f / (2 - self.ellipsoid.f)

    @property
    def radius(self) -> float:
        n2 = self.n**2
        return self.k0 * self.ellipsoid.a / (1 + self.n) * (1 + n2 / 4 + n2**2 / 64 + n2**3 / 256)

    def forward(self, lat: str, lon: str, x: str, y: str, tag: str = "") -> Stages:
        p, e = f"t_{tag}", 2 * math.sqrt(self.n) / (1 + self.n)
        a = _series(ALPHA, self.n)
        xi = " + ".join(f"{num(c)} * sin({2 * j}e0 * {p}xi) * cosh({2 * j}e0 * {p}eta)" for j, c in enumerate(a, 1))
        eta = " + ".join(f"{num(c)} * cos({2 * j}e0 * {p}xi) * sinh({2 * j}e0 * {p}eta)" for j, c in enumerate(a, 1))
        return [
            {f"{p}s": f"sin(radians({lat}))", f"{p}l": f"radians({lon} - {num(self.lon0)})"},
            {f"{p}t": f"sinh(atanh({p}s) - {num(e)} * atanh({num(e)} * {p}s))"},
            {f"{p}xi": f"atan2({p}t, cos({p}l))", f"{p}eta": f"asinh(sin({p}l) / sqrt({p}t * {p}t + cos({p}l) * cos({p}l)))"},
            {x: f"{num(self.false_e)} + {num(self.radius)} * ({p}eta + {eta})", y: f"{num(self.false_n)} + {num(self.radius)} * ({p}xi + {xi})"},
        ]

    def inverse(self, x: str, y: str, lat: str, lon: str, tag: str = "") -> Stages:
        p, b, d = f"t_{tag}", _series(BETA, self.n), _series(DELTA, self.n)
        xi = " - ".join(f"{num(c)} * sin({2 * j}e0 * {p}u) * cosh({2 * j}e0 * {p}v)" for j, c in enumerate(b, 1))
        eta = " - ".join(f"{num(c)} * cos({2 * j}e0 * {p}u) * sinh({2 * j}e0 * {p}v)" for j, c in enumerate(b, 1))
        phi = " + ".join(f"{num(c)} * sin({2 * j}e0 * {p}chi)" for j, c in enumerate(d, 1))
        return [
            {f"{p}u": f"({y} - {num(self.false_n)}) / {num(self.radius)}", f"{p}v": f"({x} - {num(self.false_e)}) / {num(self.radius)}"},
            {f"{p}up": f"{p}u - {xi}", f"{p}vp": f"{p}v - {eta}"},
            {f"{p}chi": f"asin(sin({p}up) / cosh({p}vp))"},
            {lat: f"degrees({p}chi + {phi})", lon: f"{num(self.lon0)} + degrees(atan2(sinh({p}vp), cos({p}up)))"},
        ]


def utm(zone: int, ellipsoid: Ellipsoid = GRS80, prefixed: bool = False) -> TransverseMercator:
    if not 1 <= zone <= 60:
        raise ValueError(f"UTM zones are 1 to 60, not {zone}")
    return TransverseMercator(ellipsoid, 6.0 * zone - 183.0, 0.9996, 500_000.0 + (zone * 1e6 if prefixed else 0.0))


def gauss_krueger(zone: int) -> TransverseMercator:
    if not 2 <= zone <= 5:
        raise ValueError(f"Gauß-Krüger zones are 2 to 5, not {zone}")
    return TransverseMercator(BESSEL, 3.0 * zone, 1.0, zone * 1e6 + 500_000.0)


def gauss_krueger_zone(lon: str) -> str:
    """SQL for the zone of a longitude, kept within 2 to 5; halves go to the even zone."""
    third = f"({lon} / 3e0)"
    near = f"CASE WHEN {third} - floor({third}) = 0.5e0 THEN 2 * floor({third} / 2 + 0.5e0) ELSE floor({third} + 0.5e0) END"
    return f"CAST(least(greatest({near}, 2e0), 5e0) AS INT)"


def to_ecef(lat: str, lon: str, e: Ellipsoid, p: str) -> Stages:
    return [
        {f"{p}sp": f"sin(radians({lat}))", f"{p}cp": f"cos(radians({lat}))"},
        {f"{p}nn": f"{num(e.a)} / sqrt(1e0 - {num(e.e2)} * {p}sp * {p}sp)"},
        {f"{p}x": f"{p}nn * {p}cp * cos(radians({lon}))", f"{p}y": f"{p}nn * {p}cp * sin(radians({lon}))", f"{p}z": f"{p}nn * {num(1 - e.e2)} * {p}sp"},
    ]


def from_ecef(p: str, e: Ellipsoid, lat: str, lon: str, rounds: int = 8) -> Stages:
    """Latitude by a fixed number of rounds; reads {p}x, {p}y, {p}z."""
    out: Stages = [{f"{p}r": f"sqrt({p}x * {p}x + {p}y * {p}y)"}, {f"{p}f0": f"atan2({p}z, {p}r * {num(1 - e.e2)})"}]
    for k in range(rounds):
        out += [{f"{p}g{k}": f"sin({p}f{k})"}, {f"{p}f{k + 1}": f"atan2({p}z + {num(e.e2 * e.a)} * {p}g{k} / sqrt(1e0 - {num(e.e2)} * {p}g{k} * {p}g{k}), {p}r)"}]
    return [*out, {lat: f"degrees({p}f{rounds})", lon: f"degrees(atan2({p}y, {p}x))"}]


def _turn() -> list[list[float]]:
    rx, ry, rz = (math.radians(v / 3600) for v in DHDN_TURN)
    return [[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]]


def _inverse3(m: list[list[float]]) -> list[list[float]]:
    cof = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    det = sum(m[0][j] * cof(0, j) for j in range(3))
    return [[cof(j, i) / det for j in range(3)] for i in range(3)]


def shift(p: str, q: str, back: bool) -> Stages:
    """ECEF {p}xyz to {q}xyz: from DHDN to WGS84, or back (the exact inverse of the small-angle matrix)."""
    scale, axes = 1 + DHDN_SCALE * 1e-6, "xyz"
    if back:
        m = _inverse3(_turn())
        moved = [f"(({p}{c} - {num(t)}) / {num(scale)})" for c, t in zip(axes, DHDN_SHIFT)]
        return [{f"{q}{c}": " + ".join(f"{num(v)} * {x}" for v, x in zip(row, moved)) for c, row in zip(axes, m)}]
    m = _turn()
    return [{f"{q}{c}": f"{num(t)} + {num(scale)} * (" + " + ".join(f"{num(v)} * {p}{x}" for v, x in zip(row, axes)) + ")" for c, t, row in zip(axes, DHDN_SHIFT, m)}]


def from_geo(epsg: int, lat: str, lon: str, x: str, y: str, tag: str = "f") -> Stages:
    """Stages from latitude and longitude (WGS84, degrees) to x and y."""
    p = f"t_{tag}"
    match known(epsg):
        case 4326:
            return [{x: lon, y: lat}]
        case 25832 | 25833:
            return utm(epsg - 25800).forward(lat, lon, x, y, tag)
        case 32632 | 32633:
            return utm(epsg - 32600, WGS84).forward(lat, lon, x, y, tag)
        case 4647 | 5650:
            return utm(32 if epsg == 4647 else 33, prefixed=True).forward(lat, lon, x, y, tag)
        case 3857:
            return [{x: f"{num(GRS80.a)} * radians({lon})", y: f"{num(GRS80.a)} * ln(tan({num(math.pi / 4)} + radians({lat}) / 2e0))"}]
        case _:
            return [*to_ecef(lat, lon, WGS84, f"{p}w"), *shift(f"{p}w", f"{p}d", True), *from_ecef(f"{p}d", BESSEL, f"{p}lat", f"{p}lon"),
                    *gauss_krueger(epsg - 31464).forward(f"{p}lat", f"{p}lon", x, y, tag)]


def to_geo(epsg: int, x: str, y: str, lat: str, lon: str, tag: str = "g") -> Stages:
    """Stages from x and y to latitude and longitude."""
    p = f"t_{tag}"
    match known(epsg):
        case 4326:
            return [{lat: y, lon: x}]
        case 25832 | 25833:
            return utm(epsg - 25800).inverse(x, y, lat, lon, tag)
        case 32632 | 32633:
            return utm(epsg - 32600, WGS84).inverse(x, y, lat, lon, tag)
        case 4647 | 5650:
            return utm(32 if epsg == 4647 else 33, prefixed=True).inverse(x, y, lat, lon, tag)
        case 3857:
            return [{lat: f"degrees(2e0 * atan(exp({y} / {num(GRS80.a)})) - {num(math.pi / 2)})", lon: f"degrees({x} / {num(GRS80.a)})"}]
        case _:
            return [*gauss_krueger(epsg - 31464).inverse(x, y, f"{p}lat", f"{p}lon", tag), *to_ecef(f"{p}lat", f"{p}lon", BESSEL, f"{p}d"),
                    *shift(f"{p}d", f"{p}w", False), *from_ecef(f"{p}w", WGS84, lat, lon)]


def known(epsg: int) -> int:
    if epsg not in NAMES:
        raise KeyError(f"EPSG:{epsg} is not registered; known are {', '.join(map(str, sorted(NAMES)))}")
    return epsg


def convert(source: int, target: int, x: str, y: str, out_x: str, out_y: str) -> Stages:
    """Between any two registered systems, through latitude and longitude."""
    return [*to_geo(source, x, y, "t_lat", "t_lon", "c1"), *from_geo(target, "t_lat", "t_lon", out_x, out_y, "c2")]


def with_projected(df: DataFrame, epsg: int, lat: str = "lat", lon: str = "lon", x: str = "x", y: str = "y") -> DataFrame:
    return steps.apply(df, from_geo(epsg, lat, lon, x, y))


def with_geographic(df: DataFrame, epsg: int, x: str = "x", y: str = "y", lat: str = "lat", lon: str = "lon") -> DataFrame:
    return steps.apply(df, to_geo(epsg, x, y, lat, lon))


def with_converted(df: DataFrame, source: int, target: int, x: str, y: str, out_x: str, out_y: str) -> DataFrame:
    return steps.apply(df, convert(source, target, x, y, out_x, out_y))


def convert_by_column(df: DataFrame, epsg: str, x: str, y: str, lat: str, lon: str) -> DataFrame:
    """Latitude and longitude where the system is a column: one branch per registered system, without a shuffle."""
    stages = [s for code in sorted(NAMES) for s in to_geo(code, x, y, f"t_lat{code}", f"t_lon{code}", f"b{code}")]
    pick = lambda v: "CASE " + " ".join(f"WHEN {epsg} = {c} THEN t_{v}{c}" for c in sorted(NAMES)) + " END"
    return steps.apply(df, [*stages, {lat: pick("lat"), lon: pick("lon")}])


#: The systems in which a position is shown.
SHOWN = (25832, 25833, 32632, 4647, 3857, 31468)


def in_every_system(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """A row (epsg, x, y) of each position for every system of SHOWN, with the other columns of df."""
    stages = [stage for e in SHOWN for stage in from_geo(e, lat, lon, f"x{e}", f"y{e}", f"s{e}")]
    rows = F.array(*(F.struct(F.lit(e).alias("epsg"), F.col(f"x{e}").alias("x"), F.col(f"y{e}").alias("y")) for e in SHOWN))
    return steps.apply(df, stages).select(*df.columns, F.inline(rows))


def dms(value: str, positive: str, negative: str) -> str:
    """SQL for degrees, minutes and seconds with two decimals; degrees and minutes are cut, not rounded."""
    d, m = f"floor(abs({value}))", f"floor((abs({value}) - floor(abs({value}))) * 60e0)"
    s = f"round((abs({value}) - {d} - {m} / 60e0) * 3600e0, 2)"
    return (f"concat(CAST(CAST({d} AS INT) AS STRING), '°', lpad(CAST(CAST({m} AS INT) AS STRING), 2, '0'), '''', "
            f"lpad(format_string('%.2f', {s}), 5, '0'), '\"', CASE WHEN {value} < 0 THEN '{negative}' ELSE '{positive}' END)")
