"""Which reference system a pair of numbers is in: every plausible reading, ranked by confidence.

The UTM systems share one projection, of which zones and prefixes only move the easting or turn the
longitude, and a pair can be in one strip only. So all of them are one projection of a row, and so
are the Gauß-Krüger strips with their datum shift; the expressions stay small enough to be compiled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geodesy, steps

#: Regions as (min lat, max lat, min lon, max lon).
GERMANY, CENTRAL_EUROPE = (46.5, 55.8, 4.5, 16.5), (43.0, 58.0, -1.0, 25.0)
#: Weight of the region, base confidence, and what a swapped order costs.
REGION_WEIGHT, BASE, SWAP_COST, FADE = 0.55, 0.4, 0.15, 3.0


def region_fit(lat: str, lon: str, region=GERMANY) -> str:
    """SQL: 1 inside, falling to 0 at FADE degrees outside."""
    out = lambda v, lo, hi: f"greatest({geodesy.num(lo)} - {v}, {v} - {geodesy.num(hi)}, 0e0)"
    return f"greatest(0e0, 1e0 - greatest({out(lat, *region[:2])}, {out(lon, *region[2:])}) / {geodesy.num(FADE)})"


def _readings(a: str, b: str):
    """(EPSG, x, y, swapped, condition), in the order that breaks ties."""
    north = lambda v: f"{v} > 5100000e0 AND {v} < 6200000e0"
    found = []
    for x, y, swapped in ((a, b, False), (b, a, True)):
        found += [(epsg, x, y, swapped, f"{x} > 100000e0 AND {x} < 1000000e0 AND {north(y)}") for epsg in (25832, 25833)]
    found += [(epsg, a, b, False, f"{a} > {lo} AND {a} < {hi} AND {north(b)}") for epsg, lo, hi in
              ((4647, "32000000e0", "33000000e0"), (5650, "32999999.999999e0", "34000000e0"))]
    found += [(31464 + z, a, b, False, f"{a} > {max(z * 1e6 - 1e-6, 2e6)!r} AND {a} < {(z + 1) * 1e6!r} AND {north(b)}") for z in (2, 3, 4, 5)]
    found.append((3857, a, b, False, f"abs({a}) > 400000e0 AND {a} < 2000000e0 AND {a} > -20100000e0 AND {b} > 5000000e0 AND {b} < 8000000e0"))
    return found


def detection_stages(a: str = "a", b: str = "b", region=GERMANY):
    """The same readings written out one by one, which the SQL checks use: stages that add lat{i}, lon{i}, conf{i} of every reading i (conf null: not plausible), and the list of readings."""
    stages, readings = [], []
    for swapped, lat, lon in ((False, a, b), (True, b, a)):
        i = len(readings)
        more = f" AND abs({a} - {b}) > 1e-9" if swapped else ""
        base = BASE - SWAP_COST if swapped else BASE
        stages.append({f"t_lat{i}": lat, f"t_lon{i}": lon, f"t_conf{i}": f"CASE WHEN abs({lat}) <= 90e0 AND abs({lon}) <= 180e0{more} THEN {geodesy.num(REGION_WEIGHT)} * {region_fit(lat, lon, region)} + {geodesy.num(base)} END"})
        readings.append((4326, swapped))
    for epsg, x, y, swapped, when in _readings(a, b):
        i = len(readings)
        base = BASE - SWAP_COST if swapped else BASE
        stages += [{f"t_x{i}": f"CASE WHEN {when} THEN {x} END", f"t_y{i}": f"CASE WHEN {when} THEN {y} END"}]
        stages += geodesy.to_geo(epsg, f"t_x{i}", f"t_y{i}", f"t_lat{i}", f"t_lon{i}", f"d{i}")
        stages += [{f"t_fit{i}": region_fit(f"t_lat{i}", f"t_lon{i}", region)},
                   {f"t_conf{i}": f"CASE WHEN t_x{i} IS NOT NULL AND t_fit{i} > 0e0 THEN {geodesy.num(REGION_WEIGHT)} * t_fit{i} + {geodesy.num(base)} END"}]
        readings.append((epsg, swapped))
    return stages, readings


def _slots(a: str, b: str, region) -> tuple[steps.Stages, list[dict[str, str]]]:
    """Stages that evaluate each family of systems once, and the readings: i (the place that breaks ties), epsg, lat, lon, conf and swapped in SQL.

    A pair at the very end of two strips at once is read in the first of them.
    """
    readings = _readings(a, b)
    first = next(i for i, r in enumerate(readings) if r[0] == 4647)
    plain, swapped, gk, web = readings[:2], readings[2:4], readings[first + 2 : first + 6], readings[-1]
    prefixed = readings[first : first + 2]
    pick = lambda rows: "CASE " + " ".join(f"WHEN {when} THEN {value}" for when, value in rows) + " END"
    strips = [(plain[0], "0"), (swapped[0], "1"), (prefixed[0], "2"), (prefixed[1], "3")]
    zone = {"2": "32e6", "3": "33e6"}
    one = geodesy.TransverseMercator(geodesy.GRS80, 0.0, 0.9996, 500_000.0)
    bessel = geodesy.TransverseMercator(geodesy.BESSEL, 0.0, 1.0, 500_000.0)
    stages = [
        {"t_uk": pick([(r[4], k) for r, k in strips]), "t_gz": pick([(r[4], str(r[0] - 31464)) for r in gk])},
        {"t_ux": pick([(f"t_uk = {k}", f"{r[1]} - {zone[k]}" if k in zone else r[1]) for r, k in strips]), "t_uy": pick([(f"t_uk = {k}", r[2]) for r, k in strips]),
         "t_gx": f"CASE WHEN t_gz IS NOT NULL THEN {gk[0][1]} - t_gz * 1e6 END", "t_gy": f"CASE WHEN t_gz IS NOT NULL THEN {gk[0][2]} END",
         "t_mx": f"CASE WHEN {web[4]} THEN {web[1]} END", "t_my": f"CASE WHEN {web[4]} THEN {web[2]} END"},
        *one.inverse("t_ux", "t_uy", "t_ulat", "t_ud", "u"),
        {"t_lon32": "9e0 + t_ud", "t_lon33": "15e0 + t_ud"},
        *bessel.inverse("t_gx", "t_gy", "t_blat", "t_bd", "g"),
        {"t_blon": "t_gz * 3e0 + t_bd"},
        *geodesy.to_ecef("t_blat", "t_blon", geodesy.BESSEL, "t_d"), *geodesy.shift("t_d", "t_w", False), *geodesy.from_ecef("t_w", geodesy.WGS84, "t_glat", "t_glon"),
        *geodesy.to_geo(3857, "t_mx", "t_my", "t_mlat", "t_mlon"),
        {"t_f32": region_fit("t_ulat", "t_lon32", region), "t_f33": region_fit("t_ulat", "t_lon33", region), "t_fg": region_fit("t_glat", "t_glon", region), "t_fm": region_fit("t_mlat", "t_mlon", region)},
    ]
    base = lambda turned: f"CASE WHEN {turned} THEN {geodesy.num(BASE - SWAP_COST)} ELSE {geodesy.num(BASE)} END"
    made = lambda when, fit, turned: f"CASE WHEN {when} AND {fit} > 0e0 THEN {geodesy.num(REGION_WEIGHT)} * {fit} + {base(turned)} END"
    out = []
    for turned, lat, lon in (("false", a, b), ("true", b, a)):
        more = f" AND abs({a} - {b}) > 1e-9" if turned == "true" else ""
        out.append({"i": str(len(out)), "epsg": "4326", "lat": lat, "lon": lon, "swapped": turned, "conf": f"CASE WHEN abs({lat}) <= 90e0 AND abs({lon}) <= 180e0{more} THEN {geodesy.num(REGION_WEIGHT)} * {region_fit(lat, lon, region)} + {base(turned)} END"})
    for z, alone in ((32, "2"), (33, "3")):
        at = z - 32
        out.append({"i": f"CASE t_uk WHEN 0 THEN {2 + at} WHEN 1 THEN {4 + at} ELSE {6 + at} END", "epsg": f"CASE WHEN t_uk = {alone} THEN {prefixed[at][0]} ELSE {25800 + z} END", "lat": "t_ulat", "lon": f"t_lon{z}",
                    "swapped": "t_uk = 1", "conf": made(f"t_uk IN (0, 1, {alone})", f"t_f{z}", "t_uk = 1")})
    out.append({"i": "t_gz + 6", "epsg": "31464 + t_gz", "lat": "t_glat", "lon": "t_glon", "swapped": "false", "conf": made("t_gz IS NOT NULL", "t_fg", "false")})
    out.append({"i": "12", "epsg": "3857", "lat": "t_mlat", "lon": "t_mlon", "swapped": "false", "conf": made("t_mx IS NOT NULL", "t_fm", "false")})
    return stages, out


def detect(df: DataFrame, a: str = "a", b: str = "b", region=GERMANY) -> DataFrame:
    """df with `guesses`: array of (epsg, lat, lon, confidence, swapped), best first; ties keep the fixed order."""
    stages, slots = _slots(a, b, region)
    wide = steps.apply(df, [*stages, {f"t_conf{k}": s["conf"] for k, s in enumerate(slots)}], drop="none_")
    guess = [F.struct((-F.col(f"t_conf{k}")).alias("order"), F.expr(s["i"]).cast("int").alias("i"), F.expr(s["epsg"]).cast("int").alias("epsg"), F.expr(s["lat"]).alias("lat"), F.expr(s["lon"]).alias("lon"),
                      F.col(f"t_conf{k}").alias("confidence"), F.expr(s["swapped"]).alias("swapped")) for k, s in enumerate(slots)]
    ranked = F.array_sort(F.filter(F.array(*guess), lambda g: g["confidence"].isNotNull()))
    picked = F.transform(ranked, lambda g: F.struct(g["epsg"].alias("epsg"), g["lat"].alias("lat"), g["lon"].alias("lon"), g["confidence"].alias("confidence"), g["swapped"].alias("swapped")))
    return wide.withColumn("guesses", picked).select(*df.columns, "guesses")


def best_reading(df: DataFrame, a: str = "a", b: str = "b", region=GERMANY) -> DataFrame:
    """df with epsg, lat, lon, confidence and swapped of the best reading, and n_guesses; null where there is none.

    The reading is unpacked by a generator, so later filters are not copied into the long expressions.
    """
    found = detect(df, a, b, region)
    return found.select(*df.columns, F.size("guesses").alias("n_guesses"), F.inline_outer(F.slice("guesses", 1, 1)))


#: Confidence below which a reading has to be looked at.
DOUBTFUL = 0.6


def with_doubt(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    """df with doubtful: whether the confidence is low, or there is none."""
    return df.withColumn("doubtful", F.coalesce(F.col(confidence), F.lit(0.0)) < DOUBTFUL)


def interpret(df: DataFrame, epsg: int, x: str, y: str, region=GERMANY) -> DataFrame:
    """lat, lon and confidence under a given system; null where the place is beyond the region."""
    stages = [*geodesy.to_geo(epsg, x, y, "lat", "lon"), {"t_fit": region_fit("lat", "lon", region)}, {"confidence": "CASE WHEN t_fit > 0e0 THEN 0.5e0 + 0.45e0 * t_fit END"}]
    return steps.apply(df, stages)
