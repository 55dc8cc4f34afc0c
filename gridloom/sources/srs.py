"""Spatial references: the four modes, WKT and proj4 text, and transformations as column expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres to a unit's name.
UNITS = {"m": 1.0, "metre": 1.0, "meter": 1.0, "km": 1000.0, "cm": 0.01, "ft": 0.3048, "foot": 0.3048, "us-ft": 1200 / 3937}

# Ellipsoids (larger half-axis, inverse flattening) and datums (ellipsoid, shifts to WGS 84 in metres, rotations in arc seconds, scale in millionths) by their names in proj4 text.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "bessel": (6377397.155, 299.1528128), "airy": (6377563.396, 299.3249646),
    "intl": (6378388.0, 297.0), "clrk66": (6378206.4, 294.9786982), "krass": (6378245.0, 298.3), "sphere": (6370997.0, 0.0),
}
DATUMS = {
    "WGS84": ("WGS84", (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)), "NAD83": ("GRS80", (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)),
    "potsdam": ("bessel", (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)), "hermannskogel": ("bessel", (577.326, 90.129, 463.919, 5.137, 1.474, 5.297, 2.4232)),
    "OSGB36": ("airy", (446.448, -125.157, 542.06, 0.1502, 0.247, 0.8421, -20.4894)), "carthage": ("clrk80ign", (-263.0, 6.0, 431.0, 0.0, 0.0, 0.0, 0.0)),
}
ELLIPSOIDS["clrk80ign"] = (6378249.2, 293.4660212936269)


def check_mode(work: str | None, fallback: str | None, forced: str | None) -> int:
    """The mode, 1 to 4, of a catalogue; other combinations are refused."""
    if work is None:
        if fallback is not None or forced is not None:
            raise ValueError("a fallback or forced reference needs a working one")
        return 1
    if fallback is not None and forced is not None:
        raise ValueError("fallback and forced references exclude each other")
    return 4 if forced is not None else 3 if fallback is not None else 2


def virtual(stored: Column, fallback: Column | None = None, forced: Column | None = None) -> Column:
    """The reference that a source is taken to have."""
    if forced is not None:
        return F.coalesce(forced, stored)
    return stored if fallback is None else F.coalesce(stored, fallback)


@dataclass(frozen=True)
class Reference:
    """A geographic, Mercator, transverse Mercator or Lambert conformal conic reference.

    ``datum`` is the shift of its geocentric coordinates to WGS 84 by the position vector rule: metres, arc
    seconds, millionths; None where that is not known.
    """

    kind: str = "longlat"
    a: float = 6378137.0
    rf: float = 298.257223563
    lon0: float = 0.0
    lat0: float = 0.0
    lat1: float = 0.0
    lat2: float = 0.0
    k: float = 1.0
    x0: float = 0.0
    y0: float = 0.0
    unit: float = 1.0
    datum: tuple[float, ...] | None = None

    @property
    def e2(self) -> float:
        f = 1 / self.rf if self.rf else 0.0
        return f * (2 - f)


def parse_proj4(text: str) -> Reference:
    p = dict(re.findall(r"\+(\w+)=([^\s]+)", text))
    num = lambda n, d: float(p.get(n, d))
    kind = {"longlat": "longlat", "latlong": "longlat", "tmerc": "tmerc", "lcc": "lcc", "utm": "tmerc", "merc": "merc"}.get(p.get("proj", ""))
    if kind is None:
        raise ValueError(f"no projection {p.get('proj')!r}")
    r = Reference(kind, num("a", 6378137.0), num("rf", 298.257223563), num("lon_0", 0), num("lat_0", 0), num("lat_1", 0), num("lat_2", num("lat_1", 0)), num("k", p.get("k_0", 1)), num("x_0", 0), num("y_0", 0), num("to_meter", UNITS.get(p.get("units", "m"), 1.0)))
    if p.get("proj") == "utm":
        r = replace(r, lon0=int(p["zone"]) * 6 - 183.0, k=0.9996, x0=500000.0, y0=10000000.0 if "+south" in text else 0.0)
    known = DATUMS.get(p["datum"]) if "datum" in p else None
    if "datum" in p and known is None:
        raise ValueError(f"no datum {p['datum']!r}")
    ellipsoid = p.get("ellps", known[0] if known and "a" not in p else None)
    if ellipsoid is not None:
        if ellipsoid not in ELLIPSOIDS:
            raise ValueError(f"no ellipsoid {ellipsoid!r}")
        r = replace(r, a=ELLIPSOIDS[ellipsoid][0], rf=ELLIPSOIDS[ellipsoid][1])
    if p.get("proj") == "merc" and "lat_ts" in p:
        ts = math.radians(num("lat_ts", 0))
        r = replace(r, k=math.cos(ts) / math.sqrt(1 - r.e2 * math.sin(ts) ** 2))
    return replace(r, datum=shift_of(p["towgs84"].split(",")) if "towgs84" in p else known[1] if known else None)


def shift_of(values: Sequence) -> tuple[float, ...]:
    """Three or seven numbers as seven."""
    found = tuple(float(v) for v in values)
    if len(found) not in (3, 7):
        raise ValueError("a shift of datum has three or seven numbers")
    return found + (0.0,) * (7 - len(found))


def parse_wkt(text: str) -> Reference:
    """From WKT 1: projection, parameters, spheroid and linear unit."""
    par = {k.lower(): float(v) for k, v in re.findall(r'PARAMETER\["([^"]+)",\s*([-+.\deE]+)', text)}
    sph = re.search(r'SPHEROID\["[^"]*",\s*([\d.eE+]+),\s*([\d.eE+]+)', text)
    proj = re.search(r'PROJECTION\["([^"]+)"', text)
    kind = "longlat" if proj is None else {"transverse_mercator": "tmerc", "lambert_conformal_conic_2sp": "lcc", "lambert_conformal_conic_1sp": "lcc", "mercator_1sp": "merc"}.get(proj[1].lower())
    if kind is None:
        raise ValueError(f"no projection {proj[1]!r}")
    units = re.findall(r'UNIT\["[^"]*",\s*([\d.eE+-]+)', text)
    unit = float(units[-1]) if proj is not None and units else 1.0
    lat0 = par.get("latitude_of_origin", 0.0)
    lat1 = par.get("standard_parallel_1", lat0)
    a, rf = (float(sph[1]), float(sph[2])) if sph else (6378137.0, 298.257223563)
    shift = re.search(r"TOWGS84\[([^\]]+)\]", text)
    datum = shift_of(shift[1].split(",")) if shift else None
    return Reference(kind, a, rf, par.get("central_meridian", 0.0), lat0, lat1, par.get("standard_parallel_2", lat1), par.get("scale_factor", 1.0), par.get("false_easting", 0.0) * unit, par.get("false_northing", 0.0) * unit, unit, datum)


def parse(text: str) -> Reference:
    return parse_proj4(text) if "+proj" in text else parse_wkt(text)


def same(a: str, b: str) -> bool:
    return parse(a) == parse(b)


def recentred(r: Reference, center: tuple[float, float] | None = None, unit: str | None = None) -> Reference:
    """With another origin, by false easting and northing, or another unit."""
    if center is not None:
        r = replace(r, x0=r.x0 - center[0] * r.unit, y0=r.y0 - center[1] * r.unit)
    return r if unit is None else replace(r, unit=UNITS[unit])


class Numbers:
    """The functions of expressions that the formulas use, for plain numbers."""

    sin, cos, tan, atan, atan2, sqrt, radians, degrees, pow, log, exp = math.sin, math.cos, math.tan, math.atan, math.atan2, math.sqrt, math.radians, math.degrees, math.pow, math.log, math.exp
    lit = staticmethod(lambda v: v)


def _arc(r: Reference, lat, sin):
    e2 = r.e2
    c0 = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256
    c2 = 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024
    c4 = 15 * e2**2 / 256 + 45 * e2**3 / 1024
    c6 = 35 * e2**3 / 3072
    return r.a * (c0 * lat - c2 * sin(2 * lat) + c4 * sin(4 * lat) - c6 * sin(6 * lat))


def forward(r: Reference, lon, lat, m=F) -> tuple:
    """Projected coordinates of degrees: columns, or numbers with ``m=Numbers``."""
    if r.kind == "longlat":
        return lon, lat
    lam, phi = m.radians(lon - r.lon0), m.radians(lat)
    if r.kind == "tmerc":
        e2 = r.e2
        ep = e2 / (1 - e2)
        n = r.a / m.sqrt(1 - e2 * m.sin(phi) ** 2)
        t, c, a = m.tan(phi) ** 2, ep * m.cos(phi) ** 2, m.cos(phi) * lam
        x = r.k * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a**5 / 120)
        y = r.k * (_arc(r, phi, m.sin) - _arc(r, math.radians(r.lat0), math.sin) + n * m.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a**6 / 720))
        return (x + r.x0) / r.unit, (y + r.y0) / r.unit
    if r.kind == "merc":
        e = math.sqrt(r.e2)
        es = e * m.sin(phi)
        y = m.log(m.tan(math.pi / 4 + phi / 2) * m.pow((1 - es) / (1 + es), m.lit(e / 2)))
        return (r.a * r.k * lam + r.x0) / r.unit, (r.a * r.k * y + r.y0) / r.unit
    n, f, rho0, e = _cone(r)
    es = e * m.sin(phi)
    t = m.tan(math.pi / 4 - phi / 2) / m.pow((1 - es) / (1 + es), m.lit(e / 2))
    rho = r.a * f * r.k * m.pow(t, m.lit(n))
    return (rho * m.sin(n * lam) + r.x0) / r.unit, (rho0 - rho * m.cos(n * lam) + r.y0) / r.unit


def _cone(r: Reference) -> tuple[float, float, float, float]:
    e = math.sqrt(r.e2)
    m = lambda p: math.cos(p) / math.sqrt(1 - r.e2 * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p0, p1, p2 = (math.radians(v) for v in (r.lat0, r.lat1, r.lat2))
    n = math.sin(p1) if p1 == p2 else (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    return n, f, r.a * f * r.k * t(p0) ** n, e


def backward(r: Reference, x, y, m=F) -> tuple:
    """Degrees of projected coordinates: columns, or numbers with ``m=Numbers``."""
    if r.kind == "longlat":
        return x, y
    x, y = x * r.unit - r.x0, y * r.unit - r.y0
    e2 = r.e2
    if r.kind == "tmerc":
        ep = e2 / (1 - e2)
        arc = _arc(r, math.radians(r.lat0), math.sin) + y / r.k
        mu = arc / (r.a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
        e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
        p = mu + (1.5 * e1 - 27 * e1**3 / 32) * m.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * m.sin(4 * mu) + 151 * e1**3 / 96 * m.sin(6 * mu) + 1097 * e1**4 / 512 * m.sin(8 * mu)
        s = 1 - e2 * m.sin(p) ** 2
        n, q = r.a / m.sqrt(s), r.a * (1 - e2) / m.pow(s, m.lit(1.5))
        t, c = m.tan(p) ** 2, ep * m.cos(p) ** 2
        d = x / (n * r.k)
        lat = p - n * m.tan(p) / q * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep - 3 * c * c) * d**6 / 720)
        lon = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep + 24 * t * t) * d**5 / 120) / m.cos(p)
        return m.degrees(lon) + r.lon0, m.degrees(lat)
    if r.kind == "merc":
        return m.degrees(x / (r.a * r.k)) + r.lon0, m.degrees(_latitude(e2, math.pi / 2 - 2 * m.atan(m.exp(-y / (r.a * r.k))), m))
    n, f, rho0, e = _cone(r)
    rho = math.copysign(1, n) * m.sqrt(x * x + (rho0 - y) ** 2)
    t = m.pow(rho / (r.a * f * r.k), m.lit(1 / n))
    lam = m.atan2(math.copysign(1, n) * x, math.copysign(1, n) * (rho0 - y)) / n
    return m.degrees(lam) + r.lon0, m.degrees(_latitude(e2, math.pi / 2 - 2 * m.atan(t), m))


def _latitude(e2: float, chi, m):
    """The latitude of a conformal one, all in radians."""
    terms = (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520, 7 * e2**3 / 120 + 81 * e2**4 / 1120, 4279 * e2**4 / 161280)
    return sum((c * m.sin(2 * k * chi) for k, c in enumerate(terms, 1)), chi)


def geocentric(r: Reference, lon, lat, h, m=F) -> tuple:
    """(x, y, z) in metres from the earth's centre."""
    lam, phi = m.radians(lon), m.radians(lat)
    n = r.a / m.sqrt(1 - r.e2 * m.sin(phi) ** 2)
    return (n + h) * m.cos(phi) * m.cos(lam), (n + h) * m.cos(phi) * m.sin(lam), (n * (1 - r.e2) + h) * m.sin(phi)


def geodetic(r: Reference, x, y, z, m=F) -> tuple:
    """(lon, lat, h) of geocentric coordinates, by Bowring's formula; near the earth's surface it is off by less than a micrometre."""
    b = r.a * math.sqrt(1 - r.e2)
    p = m.sqrt(x * x + y * y)
    t = m.atan2(z * r.a, p * b)
    phi = m.atan2(z + r.e2 / (1 - r.e2) * b * m.sin(t) ** 3, p - r.e2 * r.a * m.cos(t) ** 3)
    n = r.a / m.sqrt(1 - r.e2 * m.sin(phi) ** 2)
    # along the axis the distance from it says nothing of the height
    return m.degrees(m.atan2(y, x)), m.degrees(phi), p * m.cos(phi) + z * m.sin(phi) - r.a * r.a / n


def _rotation(datum: Sequence[float]) -> np.ndarray:
    """The matrix of a shift: small rotations and the scale, by the position vector rule."""
    rx, ry, rz = (math.radians(v / 3600) for v in datum[3:6])
    return (1 + datum[6] * 1e-6) * np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]])


def shifted(datum: Sequence[float], xyz: tuple, back: bool = False) -> tuple:
    """Geocentric coordinates of a datum in WGS 84, or ``back`` again, which is exact."""
    m = _rotation(datum)
    if back:
        xyz = tuple(v - float(d) for v, d in zip(xyz, datum[:3]))
        m = np.linalg.inv(m)
    out = tuple(sum((xyz[k] * float(m[i, k]) for k in range(1, 3)), xyz[0] * float(m[i, 0])) for i in range(3))
    return out if back else tuple(v + float(d) for v, d in zip(out, datum[:3]))


def changed_datum(from_: Reference, to: Reference, lon, lat, h, m=F) -> tuple:
    """(lon, lat, h) over another datum; as they are where the datums agree, or where one is not known."""
    if from_.datum is None or to.datum is None or (from_.datum == to.datum and (from_.a, from_.rf) == (to.a, to.rf)):
        return lon, lat, h
    return geodetic(to, *shifted(to.datum, shifted(from_.datum, geocentric(from_, lon, lat, h, m)), back=True), m)


def transform(from_: Reference, to: Reference) -> Callable[[Column, Column], tuple[Column, Column]]:
    """The expression that takes coordinates of one reference to another, over the height 0."""
    if from_ == to:
        return lambda x, y: (x, y)
    return lambda x, y: forward(to, *changed_datum(from_, to, *backward(from_, x, y), F.lit(0.0))[:2])


def transform_points(from_: Reference, to: Reference) -> Callable[[Sequence], np.ndarray]:
    """The function that takes points, in the last dimension (x, y) or (x, y, z), of one reference to another; z is the height, and stays unless the datum changes."""

    def run(points: Sequence) -> np.ndarray:
        a = np.array(points, float)
        if a.shape[-1:] not in ((2,), (3,)):
            raise ValueError("points are (x, y) or (x, y, z)")
        if from_ != to:
            flat = a.reshape(-1, a.shape[-1])
            for p in flat:
                lon, lat, h = changed_datum(from_, to, *backward(from_, p[0], p[1], Numbers), p[2] if len(p) == 3 else 0.0, Numbers)
                p[:2] = forward(to, lon, lat, Numbers)
                p[2:] = h
        return a

    return run


# The parameters of both text forms by the fields of ``Reference``.
WKT_PROJECTION = {"merc": "Mercator_1SP", "tmerc": "Transverse_Mercator", "lcc": "Lambert_Conformal_Conic_2SP"}
WKT_PARAMETERS = {"latitude_of_origin": "lat0", "central_meridian": "lon0", "scale_factor": "k", "standard_parallel_1": "lat1", "standard_parallel_2": "lat2", "false_easting": "x0", "false_northing": "y0"}
PROJ4_PARAMETERS = {"lat_0": "lat0", "lon_0": "lon0", "k": "k", "lat_1": "lat1", "lat_2": "lat2", "x_0": "x0", "y_0": "y0"}


def to_wkt(r: Reference) -> str:
    """WKT 1 that ``parse`` reads back to the same reference."""
    shift = "" if r.datum is None else f",TOWGS84[{','.join(map(repr, r.datum))}]"
    geo = f'GEOGCS["unnamed",DATUM["unknown",SPHEROID["unnamed",{r.a!r},{r.rf!r}]{shift}],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'
    if r.kind == "longlat":
        return geo
    own = {k: getattr(r, f) for k, f in WKT_PARAMETERS.items() if r.kind == "lcc" or not k.startswith("standard")}
    for k in ("false_easting", "false_northing"):
        own[k] /= r.unit
    return f'PROJCS["unnamed",{geo},PROJECTION["{WKT_PROJECTION[r.kind]}"],' + ",".join(f'PARAMETER["{k}",{v!r}]' for k, v in own.items()) + f',UNIT["unnamed",{r.unit!r}]]'


def to_proj4(r: Reference) -> str:
    own = {k: getattr(r, f) for k, f in PROJ4_PARAMETERS.items() if r.kind == "lcc" or r.kind in ("tmerc", "merc") and k not in ("lat_1", "lat_2")}
    return " ".join([f"+proj={r.kind}", *[f"+{k}={v!r}" for k, v in own.items()], f"+a={r.a!r}", f"+rf={r.rf!r}", *([f"+towgs84={','.join(map(repr, r.datum))}"] if r.datum is not None else []), *([f"+to_meter={r.unit!r}"] if r.kind != "longlat" else []), "+no_defs"])


def wkt_of_any(text: str) -> str:
    """WKT of a reference's text, or of the file that it names."""
    from . import files

    if "+proj" not in text and "[" not in text and files.exists(text):
        text = files.read_all(text).decode()
    return to_wkt(parse(text))


def wkt_of_file(path: str, center: tuple[float, float] | None = None, unit: str | None = None) -> str:
    """WKT of the reference of a raster or vector file, with another origin or unit."""
    from . import geojson, geotiff, shapefile

    low = path.lower()
    text = geotiff.read_info(path).wkt if low.endswith((".tif", ".tiff")) else shapefile.read_info(path).wkt if low.endswith(".shp") else geojson.reference(path)
    if text is None:
        raise ValueError(f"{path} names no reference")
    return to_wkt(recentred(parse(text), center, unit))


@dataclass
class Analysis:
    """Whether a transformation can carry footprints over a rectangle, and what speaks against it."""

    finite: bool = False
    inverse: bool = False
    angles: bool = False
    ratio: bool = False
    messages: tuple[str, ...] = ()

    @property
    def ok(self) -> bool:
        return self.finite and self.inverse and self.angles and self.ratio


def analyse(there: Callable, back: Callable, bounds: tuple[float, float, float, float], significant: float = 9.0) -> Analysis:
    """Carry a rectangle (minx, miny, maxx, maxy) there and back: finite, the same again, right angles, and the same proportion, up to precision."""
    from ..footprint import corner_slack, ratio_slack

    a, b, c, d = bounds
    if not a < c or not b < d:
        return Analysis(messages=("the rectangle is empty",))
    first = np.array([(a, d), (a, b), (c, b), (c, d)], float)  # tl, bl, br, tr
    said, out = [], Analysis()
    second = np.array(there(first))[:, :2]
    third = np.array(back(second))[:, :2]
    out.finite = bool(np.isfinite(second).all() and np.isfinite(third).all())
    if not out.finite:
        said.append("a transformed point is not finite")
    else:
        precision = max(1.0, float(np.abs(first).max())) * 10.0**-significant
        off = float(np.abs(first - third).max())
        out.inverse = off <= precision
        if not out.inverse:
            said.append(f"there and back again is off by {off}, beyond {precision}")
        slack = [corner_slack(second[k - 1], second[k], second[(k + 1) % 4], significant) for k in range(4)]
        out.angles = all(lo < 90 < hi for lo, hi in slack)
        if not out.angles:
            said.append(f"corners have angles within {slack}, not 90")
        lo, hi = ratio_slack(first, significant)
        ratio = float(np.linalg.norm(second[3] - second[0]) / np.linalg.norm(second[1] - second[0]))
        out.ratio = lo < ratio < hi
        if not out.ratio:
            said.append(f"the proportion is {ratio}, not within {lo} and {hi}")
    out.messages = tuple(said)
    return out
