"""The engine's queries against DuckDB, tilings against a plain loop, and rules of parameters."""

import itertools
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom import env
from gridloom.footprint import Footprint
from gridloom.functions import footprint as fpx
from gridloom.functions import types as ty
from gridloom.operators import focal, rasterize, tiling
from gridloom.queries import QUERIES, SQL
from gridloom.sources import srs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return repr(float(v) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(SQL[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    got = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in duck.execute(SQL[name]).fetchall())


def starts(n, size, overlap, effect):
    """Offsets and lengths of one direction, one tile after another; None if the effect refuses."""
    out, at = [], 0
    while at + size <= n:
        out.append((at, size))
        at += size - overlap
    end = out[-1][0] + size if out else 0
    if end == n:
        return out
    if effect == "exception" or (effect == "overlap" and n < size):
        return None
    nxt = end - overlap if out else 0
    more = {"extend": (nxt, size), "shrink": (nxt, n - nxt), "overlap": (n - size, size)}.get(effect)
    return out + ([more] if more else [])


def test_offsets_follow_the_effects(spark):
    cases = [(n, s, o) for n, s in itertools.product(range(1, 8), range(1, 6)) for o in range(s)]
    df = spark.createDataFrame(cases, "n int, s int, o int")
    for effect in ("extend", "exclude", "overlap", "shrink"):
        ok = [c for c in cases if starts(*c, effect) is not None]
        d = spark.createDataFrame(ok, df.schema).select("n", "s", "o", tiling.offsets(F.col("n"), F.col("s"), F.col("o"), effect).alias("t"))
        for r in d.collect():
            assert [(t["at"], t["len"]) for t in r["t"]] == starts(r["n"], r["s"], r["o"], effect), (effect, r)


def test_tiles_that_do_not_fit_are_refused(spark):
    one = spark.range(1).select(Footprint.of((0, 5), (5, 5), (5, 5)).lit().alias("fp"))
    for how in ({"size": (2, 2), "effect": "exception"}, {"size": (6, 6), "effect": "overlap"}, {"size": (2, 2), "overlap": (2, 0)}):
        with pytest.raises(Exception):
            tiling.tile(one, **how).collect()


def test_intersection_is_symmetric_and_null_apart(spark):
    a, b, c = (Footprint.of(tl, (4, 4), (4, 4)) for tl in ((0, 4), (2, 6), (10, 4)))
    lit = lambda f: tuple(F.lit(v) for v in f.bounds)
    row = spark.range(1).select(fpx.intersection(a.lit(), lit(b)).alias("ab"), fpx.intersection(b.lit(), lit(a)).alias("ba"), fpx.intersection(a.lit(), lit(c)).alias("ac")).first()
    assert row["ab"] == row["ba"] and row["ab"]["rsx"] == 2 and row["ac"] is None


def test_rings_are_stitched_with_holes(spark):
    grid = ["#####", "#...#", "#.#.#", "#...#", "#####", "..#.."]
    mask = spark.createDataFrame([(x, y) for y, line in enumerate(grid) for x, c in enumerate(line) if c == "#"], "px int, py int")
    got = {r["component"]: r["wkt"] for r in rasterize.find_polygons(mask, Footprint.of((0, 6), (5, 6), (5, 6))).collect()}
    assert len(got) == 2 and got[0].count("(") == 3


def test_parameter_rules():
    assert ty.channel_ids(None, 1) == ([0], True) and ty.channel_ids([-1, 0, 0], 2) == ([1, 0, 0], False) and ty.channel_ids(1, 2) == ([1], True)
    assert ty.field_names("b a", ["a", "b"]) == (["b", "a"], False) and ty.field_names(None, ["a"]) == ([], True) and ty.field_names(-1, ["a", "b"]) == (["a", "b"], False)
    assert ty.pixel_type("uint16") == "int" and ty.geometry_type("wkbpoint25d") == ("Point", True) and ty.mask_names(ty.mask_flags("alpha, nodata")) == "alpha,nodata"
    with pytest.raises(ValueError):
        ty.channels_schema(2, {"nodata": [1, 2, 3]})
    with pytest.raises(ValueError):
        ty.pixel_type("datetime64")
    with env.Env(significant=7):
        assert env.current().significant == 7
    assert env.current().significant == 9


def test_spatial_references(spark):
    assert [srs.check_mode(*m) for m in ((None, None, None), ("w", None, None), ("w", "f", None), ("w", None, "f"))] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        srs.check_mode(None, "f", None)
    ll = srs.Reference()
    for text in ("+proj=utm +zone=31 +ellps=WGS84", "+proj=lcc +lat_1=44 +lat_2=49 +lat_0=46.5 +lon_0=3 +x_0=700000 +y_0=6600000 +ellps=GRS80"):
        r = srs.parse(text)
        xy = srs.forward(r, F.lit(4.0), F.lit(47.0))
        row = spark.range(1).select(*srs.backward(r, *xy), *xy).first()
        assert math.isclose(row[0], 4, abs_tol=1e-7) and math.isclose(row[1], 47, abs_tol=1e-7)
        assert srs.transform(r, r)(1, 2) == (1, 2)
    utm = spark.range(1).select(*srs.forward(srs.parse("+proj=utm +zone=31 +ellps=WGS84"), F.lit(3.0), F.lit(0.0))).first()
    assert math.isclose(utm[0], 500000) and abs(utm[1]) < 1e-6 and ll.kind == "longlat"


def test_tiling_validator_sees_every_footprint(spark, monkeypatch):
    from gridloom.operators import tiling
    from gridloom.queries import QUERIES

    run = lambda: tuple(QUERIES["tiling_validator"](spark, "/root/testdata/sf0.001").first())
    assert run() == (0, 0, 0)
    tile = tiling.tile
    monkeypatch.setattr(tiling, "tile", lambda *a: tile(*a).where("k <> 2"))
    assert run()[0] > 0
    monkeypatch.setattr(tiling, "tile", lambda *a: tile(*a).union(tile(*a).where("k = 3 and row = 0 and col = 0")))
    assert run() == (0, 24, 0)


@pytest.mark.parametrize("side", [8, 16, 24, 256])
def test_focal_blocks_of_every_size(spark, side):
    """Blocks of one tile, of several and of all; a tile is missing in the middle."""
    import numpy as np

    z = np.random.default_rng(1).random((40, 56))
    rows = [(x, y, z[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8].ravel().tolist()) for y in range(5) for x in range(7) if (x, y) != (3, 2)]
    z[16:24, 24:32] = np.nan
    want = focal.slope_array(np.pad(z, 1, constant_values=np.nan), 1.0, -1.0)
    got = focal.over_tiles(spark.createDataFrame(rows, "tx int, ty int, data array<double>"), (8, 8), lambda a: focal.slope_array(a, 1.0, -1.0), side).collect()
    assert len(got) == 34
    for r in got:
        assert np.array_equal(np.array(r["data"]).reshape(8, 8), want[r["ty"] * 8 : r["ty"] * 8 + 8, r["tx"] * 8 : r["tx"] * 8 + 8])


def test_datums():
    """There and back, a published pair of coordinates, and both text forms."""
    import numpy as np

    wgs, brit = srs.parse("+proj=longlat +datum=WGS84"), srs.parse("+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +datum=OSGB36 +units=m +no_defs")
    points = np.array([(-5.0, 50.1, 0.0), (0.3, 52.6, 120.0), (-3.2, 58.5, 900.0), (1.7, 52.6, -20.0)])
    there = srs.transform_points(wgs, brit)(points)
    again = srs.transform_points(brit, wgs)(there)
    # the projection and its inverse are series, good for some millimetres at four degrees from the meridian
    assert np.abs(again[:, :2] - points[:, :2]).max() < 5e-8 and np.abs(again[:, 2] - points[:, 2]).max() < 1e-4
    same = srs.transform_points(srs.parse("+proj=longlat +datum=OSGB36"), srs.parse("+proj=longlat +datum=potsdam"))
    back = srs.transform_points(srs.parse("+proj=longlat +datum=potsdam"), srs.parse("+proj=longlat +datum=OSGB36"))
    # the change of datum itself is exact to a micrometre on the ground, and to less than a tenth of a millimetre in height
    assert np.abs(back(same(points))[:, :2] - points[:, :2]).max() < 1e-10 and np.abs(back(same(points))[:, 2] - points[:, 2]).max() < 1e-4
    # the national survey's worked example of geodetic to geocentric coordinates on Airy's ellipsoid
    airy = srs.parse("+proj=longlat +ellps=airy")
    xyz = srs.geocentric(airy, 1 + 43 / 60 + 4.5177 / 3600, 52 + 39 / 60 + 27.2531 / 3600, 24.700, srs.Numbers)
    assert np.allclose(xyz, (3874938.849, 116218.624, 5047168.208), atol=0.002)
    assert np.allclose(srs.geodetic(airy, *xyz, srs.Numbers), (1.717921583, 52.657570306, 24.700), atol=1e-8)
    for text in ("+proj=merc +lon_0=10 +k=0.999 +datum=potsdam", "+proj=lcc +lat_1=49 +lat_2=44 +lat_0=46.5 +lon_0=3 +towgs84=1,2,3"):
        r = srs.parse(text)
        assert srs.parse(srs.to_wkt(r)) == srs.parse(srs.to_proj4(r)) == r and r.datum is not None
        lon, lat = srs.backward(r, *srs.forward(r, 12.5, 47.25, srs.Numbers), srs.Numbers)
        assert abs(lon - 12.5) < 1e-9 and abs(lat - 47.25) < 1e-9
    assert srs.transform_points(srs.parse("+proj=longlat +ellps=bessel"), wgs)([(7.0, 51.0)]).tolist() == [[7.0, 51.0]]
    for bad in ("+proj=longlat +datum=nowhere", "+proj=longlat +ellps=egg", "+proj=longlat +towgs84=1,2"):
        with pytest.raises(ValueError):
            srs.parse(bad)


def test_centroids(spark):
    """A triangle, a square with a hole off its middle, two parts, rings that turn either way, far from the origin, and a shape without an area."""
    from gridloom.functions import geometry as gm

    far = 1e7
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    shapes = {
        (1.0, 1.0): {"type": "Polygon", "coordinates": [[(0, 0), (3, 0), (0, 3), (0, 0)]]},
        ((16 * 2 - 1 * 3.5) / 15, (16 * 2 - 1 * 3.5) / 15): {"type": "Polygon", "coordinates": [square(0, 0, 4), square(3, 3, 1)]},
        ((1 * 0.5 + 4 * 11) / 5, (1 * 0.5 + 4 * 1) / 5): {"type": "MultiPolygon", "coordinates": [[square(0, 0, 1)], [square(10, 0, 2)[::-1]]]},
        (far + 0.005, far + 0.005): {"type": "Polygon", "coordinates": [square(far, far, 0.01)]},
    }
    rows = [(gm.value_of(g),) for g in shapes.values()] + [(gm.value_of({"type": "Polygon", "coordinates": [[(0, 0), (1, 1), (0, 0)]]}),)]
    got = [r["c"] for r in spark.createDataFrame(rows, f"geom {ty.GEOM.simpleString()}").select(gm.centroid(F.col("geom")).alias("c")).collect()]
    assert got[-1] is None
    for want, c in zip(shapes, got):
        assert math.isclose(c["x"], want[0], abs_tol=1e-8) and math.isclose(c["y"], want[1], abs_tol=1e-8)
