"""Closed-form terrain, soil, erosion and runoff expressions, on columns; a null factor gives a null result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: land-cover class, then the curve numbers of soil groups A to D by condition (cover without a condition has the same in all)
CURVE_NUMBERS_BY = {
    "poor": {10: (45, 66, 77, 83), 20: (48, 67, 77, 83), 30: (68, 79, 86, 89), 40: (72, 81, 88, 91), 50: (89, 92, 94, 95), 60: (77, 86, 91, 94), 80: (100, 100, 100, 100)},
    "fair": {10: (36, 60, 73, 79), 20: (35, 56, 70, 77), 30: (49, 69, 79, 84), 40: (67, 78, 85, 89), 50: (89, 92, 94, 95), 60: (77, 86, 91, 94), 80: (100, 100, 100, 100)},
    "good": {10: (30, 55, 70, 77), 20: (30, 48, 65, 73), 30: (39, 61, 74, 80), 40: (67, 78, 85, 89), 50: (89, 92, 94, 95), 60: (77, 86, 91, 94), 80: (100, 100, 100, 100)},
}
CURVE_NUMBERS = CURVE_NUMBERS_BY["fair"]
COVER_GROUPS = {"tree": (10,), "shrub": (20,), "grass": (30,), "crop": (40,), "built": (50,), "bare": (60,), "water": (80,), "wetland": (90, 95), "other": (70, 100)}
# fixed values: cover and support factors, sheet-flow roughness and retardance by land-cover class, slope exponents by slope in per cent
COVER_C = {10: 0.0255, 20: 0.03, 30: 0.08, 40: 0.25, 50: 0.125, 60: 0.5, 70: 0.0, 80: 0.0, 90: 0.001, 95: 0.001, 100: 0.01}
SUPPORT_P = {10: 0.6, 20: 0.8, 30: 0.9, 40: 0.7}
SHEET_N = {10: 0.40, 20: 0.24, 30: 0.15, 40: 0.06, 50: 0.011, 60: 0.011}
KERBY_N = {10: 0.60, 20: 0.40, 30: 0.40, 40: 0.20, 50: 0.02, 60: 0.10}
SLOPE_M = ((1, 0.2), (3, 0.3), (5, 0.4), (10, 0.45), (20, 0.5), (30, 0.55))
# fixed values: class schemes as breaks, names and scores
FIVE = ("Very low", "Low", "Moderate", "High", "Very high")
SCHEMES = {
    "spi_fixed": ((0.0, 5.0, 10.0), ("Low", "Moderate", "High", "Severe"), (1, 2, 3, 5)),
    "soil_loss": ((5.0, 12.0, 25.0, 50.0), FIVE, (1, 2, 3, 4, 5)),
    "soil_loss_regional": ((5.0, 10.0, 20.0, 40.0), ("Slight", "Moderate", "High", "Very high", "Severe"), (1, 2, 3, 4, 5)),
    "volume": ((1000.0, 5000.0, 15000.0), ("Low", "Moderate", "High", "Severe"), (1, 2, 3, 5)),
}
# fixed values: codes of soil-group rasters and letters; 14 is a dual group
GROUP_CODES = {1: 1, 2: 2, 3: 3, 4: 4, 11: 14, 12: 14, 13: 14, 14: 14}
GROUP_LETTERS = {"A": 1, "B": 2, "C": 3, "D": 4, "A/D": 14, "B/D": 14, "C/D": 14, "D/D": 14}
# fixed values: ranges a factor may lie in
FACTOR_RANGES = {"R": (0.0, 30000.0), "K": (0.0, 0.1), "C": (0.0, 1.0), "P": (0.0, 1.0)}
FT = 3.280839895013123


def num(x: float) -> Column:
    return F.lit(float(x))


def lookup(column: Column, values: dict, default: float | None = None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(column == k, num(v)) if out is None else out.when(column == k, num(v))
    return out if default is None else out.otherwise(num(default))


def amc(cn: Column, condition: str) -> Column:
    """Curve number of antecedent condition I or III from II."""
    if condition == "I":
        return 4.2 * cn / (10 - 0.058 * cn)
    return 23 * cn / (10 + 0.13 * cn) if condition == "III" else cn


def kirpich(length_m: Column, slope: Column) -> Column:
    return 0.0195 * F.pow(length_m, num(0.77)) * F.pow(slope, num(-0.385))


def kerby(length_m: Column, n: Column, slope: Column) -> Column:
    return 1.44 * F.pow(length_m * n, num(0.467)) * F.pow(slope, num(-0.235))


def scs_lag(length_m: Column, cn: Column, slope: Column) -> Column:
    lag = F.pow(length_m * FT, num(0.8)) * F.pow(1000 / cn - 9, num(0.7)) / (1900 * F.sqrt(slope * 100))
    return 60 * lag / 0.6


def sheet(length_m: Column, n: Column, p2_mm: Column, slope: Column) -> Column:
    return 60 * 0.007 * F.pow(n * F.least(length_m, num(30)) * FT, num(0.8)) / (F.sqrt(p2_mm / 25.4) * F.pow(slope, num(0.4)))


def shallow(length_m: Column, slope: Column, paved: bool = False) -> Column:
    return length_m * FT / ((20.3282 if paved else 16.1345) * F.sqrt(slope)) / 60


def manning(length_m: Column, radius_m: Column, slope: Column, n: float = 0.035) -> Column:
    return length_m / (F.pow(radius_m, num(2 / 3)) * F.sqrt(slope) / n) / 60


def bransby_williams(length_km: Column, area_km2: Column, slope_m_km: Column) -> Column:
    return 14.6 * length_km / (F.pow(area_km2, num(0.1)) * F.pow(slope_m_km, num(0.2)))


def rainfall_erosivity(map_mm: Column, linear: bool = False) -> Column:
    if linear:
        return 38.46 + 3.48 * map_mm
    return F.when(map_mm <= 850, 0.0483 * F.pow(map_mm, num(1.61))).otherwise(587.8 - 1.219 * map_mm + 0.004105 * map_mm * map_mm)


def given(*values: Column) -> Column:
    """Whether all are there, finite and not negative."""
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))
    return F.coalesce(out, F.lit(False))


def williams_k(sand: Column, silt: Column, clay: Column, oc: Column) -> Column:
    coarse = 0.2 + 0.3 * F.exp(-0.0256 * sand * (1 - silt / 100))
    fine = F.pow(silt / (clay + silt), num(0.3))
    organic = 1 - 0.25 * oc / (oc + F.exp(3.72 - 2.95 * oc))
    s = 1 - sand / 100
    high_sand = 1 - 0.7 * s / (s + F.exp(-5.51 + 22.9 * s))
    return F.when(given(sand, silt, clay, oc) & (silt + clay > 0), coarse * fine * organic * high_sand * 0.1317)


def diameter_k(sand: Column, silt: Column, clay: Column) -> Column:
    """Erodibility from the geometric mean diameter; the fractions are brought to a sum of 100."""
    import math

    log_dg = (clay * math.log(0.001) + silt * math.log(0.026) + sand * math.log(1.025)) / (sand + silt + clay) / math.log(10)
    return F.when(given(sand, silt, clay) & (sand + silt + clay > 0), 0.0034 + 0.0405 * F.exp(-0.5 * F.pow((log_dg + 1.659) / 0.7101, num(2))))


def rock_factor(rock_pct: Column) -> Column:
    return F.when(given(rock_pct), F.exp(-0.053 * rock_pct))


# fixed values: corners (sand, clay), in per cent, of the regions of the texture triangle
TRIANGLE = {
    "sand": ((85, 0), (100, 0), (90, 10)), "loamy sand": ((70, 0), (85, 0), (90, 10), (80, 20)), "sandy loam": ((50, 0), (70, 0), (80, 20), (52, 20), (52, 7), (43, 7)), "loam": ((43, 7), (52, 7), (52, 20), (45, 27), (23, 27)),
    "silt": ((-1, 0), (20, 0), (8, 12), (-1, 12)), "silt loam": ((20, 0), (50, 0), (23, 27), (-1, 27), (-1, 12), (8, 12)), "sandy clay loam": ((52, 20), (80, 20), (65, 35), (45, 35), (45, 27)), "clay loam": ((20, 27), (45, 27), (45, 40), (20, 40)),
    "silty clay loam": ((-1, 27), (20, 27), (20, 40), (-1, 40)), "sandy clay": ((45, 35), (65, 35), (45, 55)), "silty clay": ((-1, 40), (20, 40), (-1, 61)), "clay": ((20, 40), (45, 40), (45, 55), (-1, 101), (-1, 61)),
}


def _inside(x: Column, y: Column, corners: tuple[tuple[int, int], ...]) -> Column:
    """Whether a point lies in a polygon: an odd number of edges to its left. What lies on an edge belongs to the region of less x, or of more y."""
    crossed = []
    for (x0, y0), (x1, y1) in zip(corners, (*corners[1:], corners[0]), strict=True):
        if y0 != y1:
            at = num(x0) + (y - num(y0)) * num(x1 - x0) / num(y1 - y0)
            crossed.append(((y >= min(y0, y1)) & (y < max(y0, y1)) & (at < x)).cast("int"))
    total = crossed[0]
    for c in crossed[1:]:
        total = total + c
    return total % 2 == 1


def usda_texture(sand: Column, silt: Column, clay: Column) -> Column:
    """The class of the USDA triangle in which fractions, brought to 100, lie; loam where rounding leaves none, null without all three."""
    total = sand + silt + clay
    x, y = 100 * sand / total, 100 * clay / total
    named = F.coalesce(*[F.when(_inside(x, y, corners), name) for name, corners in TRIANGLE.items()], F.lit("loam"))
    return F.when(given(sand, silt, clay) & (total > 0), named)


def hsg_of_texture(texture: Column, drainage: Column | None = None) -> Column:
    """Hydrologic soil group; very poor or poor drainage gives D, imperfect drainage lifts A and B to C; null without a texture."""
    group = F.when(texture.isin("sand", "loamy sand"), "A").when(texture.isin("sandy loam", "loam", "silt loam", "silt"), "B").when(texture == "sandy clay loam", "C").when(texture.isNotNull(), "D")
    if drainage is None:
        return group
    letter = F.upper(F.substring(F.trim(drainage), 1, 1))
    return F.when(group.isNotNull() & letter.isin("V", "P"), "D").when((letter == "I") & group.isin("A", "B"), "C").otherwise(group)


def hsg_of_codes(code: Column) -> Column:
    """1 to 4 for A to D, 14 for dual groups, 0 for anything else, from raster codes."""
    return F.coalesce(lookup(code, GROUP_CODES), num(0)).cast("int")


def hsg_of_letters(letters: Column) -> Column:
    """The same from texts such as ``a`` or ``B/D``."""
    return F.coalesce(lookup(F.upper(F.trim(letters)), GROUP_LETTERS), num(0)).cast("int")


def specific_area(acc: Column, cw: float, ch: float) -> Column:
    return (acc + 1) * (cw * ch) / (cw * ch) ** 0.5


def sine(slope: Column) -> Column:
    return slope / F.sqrt(1 + slope * slope)


def slope_exponent(slope: Column) -> Column:
    out = None
    for limit, m in SLOPE_M:
        hit = slope * 100 <= limit
        out = F.when(hit, num(m)) if out is None else out.when(hit, num(m))
    return out.otherwise(num(0.6))


def ls_factor(area: Column, slope: Column, by_slope: bool = False) -> Column:
    """Moore and Burch, on slopes of at least 0.001."""
    s = F.greatest(slope, num(0.001))
    return F.pow(area / 22.13, slope_exponent(s) if by_slope else num(0.4)) * F.pow(sine(s) / 0.0896, num(1.3))


def ls_inflow(inflow_area: Column, slope: Column, cell: float, aspect_sum: Column) -> Column:
    """Desmet and Govers on the area entering a cell; ``aspect_sum`` is |sin| + |cos| of the aspect."""
    s = F.greatest(slope, num(0.001))
    f = (sine(s) / 0.0896) / (3 * F.pow(sine(s), num(0.8)) + 0.56)
    m = f / (1 + f)
    steep = F.when(s < 0.09, 10.8 * sine(s) + 0.03).otherwise(16.8 * sine(s) - 0.5)
    return (F.pow(inflow_area + cell * cell, m + 1) - F.pow(inflow_area, m + 1)) / (F.pow(num(cell), m + 2) * F.pow(aspect_sum, m) * F.pow(num(22.13), m)) * steep


def spi(area: Column, slope: Column) -> Column:
    return area * F.greatest(slope, num(0.001))


def twi(area: Column, slope: Column) -> Column:
    return F.log(area / F.greatest(slope, num(0.001)))


def sti(area: Column, slope: Column, cap: float = 100.0) -> Column:
    return F.pow(F.least(area, num(cap)) / 22.13, num(0.6)) * F.pow(sine(F.greatest(slope, num(0.001))) / 0.0896, num(1.3))


def sediment_delivery(area_km2: Column) -> Column:
    return F.least(num(1), 0.565 * F.pow(area_km2, num(-0.125)))


def classify(x: Column, breaks: list[float]) -> Column:
    """1 + the number of breaks not above x."""
    return F.when(x.isNotNull(), F.lit(1) + sum((F.when(x >= num(b), 1).otherwise(0) for b in breaks), F.lit(0)))


def score_of(code: Column, scores) -> Column:
    """The score of a class number from 1; null without a class."""
    return F.when(code >= 1, F.get(F.array(*[F.lit(int(x)) for x in scores]), code.cast("int") - 1))


def name_of(code: Column, names) -> Column:
    return F.when(code >= 1, F.get(F.array(*[F.lit(x) for x in names]), code.cast("int") - 1))


def combine_scores(a: Column, b: Column, matrix: list[list[int]] | None = None) -> Column:
    """The entry of a 5 x 5 matrix of scores (the greater of both by default); 0 where either is missing or 0."""
    there = (F.coalesce(a, F.lit(0)) > 0) & (F.coalesce(b, F.lit(0)) > 0)
    if matrix is None:
        both = F.greatest(a, b)
    else:
        if len(matrix) != 5 or any(len(r) != 5 or min(r) < 1 or max(r) > 5 for r in matrix):
            raise ValueError("a combination matrix has 5 x 5 scores from 1 to 5")
        both = F.get(F.get(F.array(*[F.array(*[F.lit(x) for x in r]) for r in matrix]), a.cast("int") - 1), b.cast("int") - 1)
    return F.when(there, both).otherwise(0).cast("int")


def composite(spi_score: Column, rusle_score: Column, sediment_score: Column, weights=(0.4, 0.3, 0.3)) -> Column:
    """The weighted mean of the three scores; null if one is missing."""
    parts = (spi_score, rusle_score, sediment_score)
    return sum((x * w for x, w in zip(parts, weights, strict=True)), num(0)) / sum(weights)


def impact_level(score: Column) -> Column:
    return F.when(score <= 2 + 1e-9, 1).when(score <= 3 + 1e-9, 2).when(score <= 4 + 1e-9, 3).when(score.isNotNull(), 4)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone, with the exceptions of Norway and Svalbard; UPS beyond 84 N and 80 S."""
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    zone = F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32).when((lat >= 72) & (lat <= 84) & (lon >= 0) & (lon < 42), F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)).otherwise(zone)
    return F.when(lat > 84, 32661).when(lat < -80, 32761).otherwise(F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """(metres in a degree of longitude, of latitude) on WGS84."""
    p = F.radians(lat)
    return 111412.84 * F.cos(p) - 93.5 * F.cos(3 * p) + 0.118 * F.cos(5 * p), 111132.92 - 559.82 * F.cos(2 * p) + 1.175 * F.cos(4 * p) - 0.0023 * F.cos(6 * p)


def form_factor(area_km2: Column, length_m: Column) -> Column:
    return area_km2 / F.pow(length_m / 1000, num(2))


def elongation(area_km2: Column, length_m: Column) -> Column:
    return 2 * F.sqrt(area_km2 / 3.141592653589793) / (length_m / 1000)


def circularity(area_km2: Column, perimeter_m: Column) -> Column:
    return 4 * 3.141592653589793 * area_km2 / F.pow(perimeter_m / 1000, num(2))


def drainage_density(length_m: Column, area_km2: Column) -> Column:
    return length_m / 1000 / area_km2


def stream_frequency(links: Column, area_km2: Column) -> Column:
    return links / area_km2


def candidate_moved(x: Column, y: Column, outlet_x: Column, outlet_y: Column, cell: float = 30.0) -> Column:
    """Whether a candidate lies more than two cells from its stored outlet, or has none."""
    away = F.sqrt((x - outlet_x) ** 2 + (y - outlet_y) ** 2)
    return F.coalesce(away > 2 * cell, F.lit(True))


def crs_problem(wkt: str | None) -> tuple[int | None, str]:
    """(EPSG code if stated, problem or '') of a coordinate system in well-known text: it must be projected, in metres."""
    import re

    text = (wkt or "").strip()
    if not text:
        return None, "no coordinate system"
    head = text[:12].upper()
    if head.startswith(("GEOGCS", "GEOGCRS", "GEODCRS")):
        return None, "a geographic coordinate system in degrees; a projected one in metres is needed"
    if not head.startswith(("PROJCS", "PROJCRS", "BOUNDCRS")):
        return None, "not a projected coordinate system"
    # the unit of the projection is the last one
    units = re.findall(r'UNIT\s*\[\s*"([^"]+)"', text, re.I)
    if not units or units[-1].lower() not in ("metre", "meter", "m"):
        return None, "not in metres"
    code = re.search(r'(?:AUTHORITY|ID)\s*\[\s*"EPSG"\s*,\s*"?(\d+)"?\s*\]\s*\]\s*$', text, re.I)
    return (int(code[1]) if code else None), ""


def utm_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in the point's UTM zone on WGS84, by the series in the third flattening (to about a millimetre within a zone)."""
    n = 1 / 298.257223563 / (2 - 1 / 298.257223563)
    radius = 6378137 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    zone = utm_epsg(lon, lat) % 100
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return 500000 + 0.9996 * radius * x, F.when(lat < 0, 10000000.0).otherwise(0.0) + 0.9996 * radius * y
