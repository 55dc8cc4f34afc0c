"""Files, the catalogue, recipes, footprints and cuts, against plain versions."""

import json
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.catalogue import Dataset
from gridloom.footprint import Footprint, corner_slack
from gridloom.functions import footprint as fpx
from gridloom.functions import geometry as gm
from gridloom.functions import plane
from gridloom.functions import types as ty
from gridloom.operators import raster, rasterize, recipe, vector
from gridloom.plans.lineage import cut
from gridloom.sources import files, geojson, geotiff, shapefile, srs

UTM = "+proj=utm +zone=31 +ellps=WGS84"


def pattern(h, w, bands=1):
    y, x = np.mgrid[:h, :w]
    return np.stack([x + 100.0 * y + b for b in range(bands)], 2)


# --- rasters -------------------------------------------------------------------------------------


@pytest.mark.parametrize("dtype", ["uint8", "int16", "float32", "float64"])
@pytest.mark.parametrize("compress", [True, False])
def test_geotiff_keeps_pixels_and_header(spark, tmp_path, dtype, compress):
    fp = Footprint(3.0, 0.5, 0.1, 90.0, 0.2, -0.5, 37, 21)
    a = pattern(21, 37, 2) % 200
    channels = ty.channels_schema(2, {"nodata": [7, None], "interpretation": ["redband", "alphaband"], "scale": [2, 1]})
    path = f"{tmp_path}/r.tif"
    from gridloom.catalogue import array_tiles

    geotiff.write(array_tiles(spark, a, (16, 16)), path, fp, dtype, channels, "LOCAL", 16, compress)
    i = geotiff.read_info(path)
    assert (i.fp, i.dtype, i.channels, i.wkt) == (fp, dtype, channels, "LOCAL")
    got = np.zeros_like(a)
    for r in raster.pixels_of_bands(geotiff.read(spark, path), fp, (16, 16)).collect():
        got[r["py"], r["px"], r["band"]] = r["value"]
    assert (got == a.astype(dtype)).all()
    some = geotiff.read(spark, path, (17, 3, 20, 10), [1])
    assert [(r["tx"], r["ty"]) for r in some.collect()] == [(1, 0)] and len(some.first()["data"]) == 1
    assert geotiff.read(spark, path, (5, 5, 5, 9)).count() == 0


def test_geotiff_of_strips(spark, tmp_path):
    """A file as others write it: strips, big endian, horizontal differences, bands apart."""
    a = pattern(10, 12, 2).astype(np.uint16)
    planes = [a[:, :, b] for b in (0, 1)]
    strips = []
    for p in planes:
        for y in range(0, 10, 4):
            rows = p[y : y + 4].astype(np.int64)
            rows[:, 1:] = np.diff(p[y : y + 4].astype(np.int64), axis=1)
            strips.append(zlib.compress((rows % 65536).astype(">u2").tobytes()))
    tags = [(256, 3, [12]), (257, 3, [10]), (258, 3, [16, 16]), (259, 3, [8]), (262, 3, [1]), (273, 4, None), (277, 3, [2]), (278, 3, [4]), (279, 4, [len(s) for s in strips]), (284, 3, [2]), (317, 3, [2])]
    size = {3: ("H", 2), 4: ("I", 4)}
    base = 8 + 2 + 12 * len(tags) + 4
    extra = sum(len(v or strips) * size[k][1] for _, k, v in tags if len(v or strips) * size[k][1] > 4)
    at = base + extra
    offsets = [at + sum(map(len, strips[:n])) for n in range(len(strips))]
    body, rest = struct.pack(">H", len(tags)), b""
    for tag, kind, v in tags:
        v = offsets if v is None else v
        raw = struct.pack(f">{len(v)}{size[kind][0]}", *v)
        body += struct.pack(">HHI", tag, kind, len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">I", base + len(rest)))
        rest += raw if len(raw) > 4 else b""
    (tmp_path / "s.tif").write_bytes(b"MM" + struct.pack(">HI", 42, 8) + body + b"\0" * 4 + rest + b"".join(strips))
    r = Dataset(spark).open_raster("r", f"{tmp_path}/s.tif")
    assert (r.get_data() == a).all() and r.get_data(channels=1).shape == (10, 12) and r.dtype == "uint16"


def test_lzw_and_packbits():
    data = bytes(random.Random(1).choices(b"aab", k=3000))
    table, out, nbits, width = {bytes([k]): k for k in range(256)}, 256, 9, 9
    nxt, word = 258, b""
    for c in data:
        if word + bytes([c]) in table:
            word += bytes([c])
            continue
        out, nbits = out << width | table[word], nbits + width
        table[word + bytes([c])] = nxt
        nxt += 1
        width = 9 if nxt < 512 else 10 if nxt < 1024 else 11 if nxt < 2048 else 12  # as soon as entry 511 is added
        word = bytes([c])
    out, nbits = out << width | table[word], nbits + width
    nxt += 1
    width = 9 if nxt < 512 else 10 if nxt < 1024 else 11 if nxt < 2048 else 12  # as soon as entry 511 is added
    out, nbits = out << width | 257, nbits + width
    pad = -nbits % 8
    assert geotiff.unlzw((out << pad).to_bytes((nbits + pad) // 8, "big")) == data
    assert geotiff.unpackbits(bytes([2, 1, 2, 3, 254, 9, 128, 0, 5])) == bytes([1, 2, 3, 9, 9, 9, 5])


def test_catalogue_of_rasters(spark, tmp_path):
    fp = Footprint.of((100, 110), (10, 10), (10, 10))
    a = pattern(10, 10, 3)
    ds = Dataset(spark, allow_interpolation=True)
    n = ds.wrap_numpy_raster("n", fp, a, {"nodata": 200})
    assert (n.array == a).all() and len(n) == 3 and n.nodata == 200 and n.get_keys() == ["n"] and "n" in ds and n in ds and ds.n is n and len(ds) == 1
    assert (n.get_data(fp.clip(2, 3, 5, 9), [2, 0, -1]) == a[3:9, 2:5][:, :, [2, 0, 2]]).all()
    wide = n.get_data(fp.dilate(2), 0, dst_nodata=-1)
    assert wide.shape == (14, 14) and (wide[2:12, 2:12] == np.where(a[:, :, 0] == 200, -1, a[:, :, 0])).all() and wide[0, 0] == -1
    far = n.get_data(Footprint.of((500, 500), (3, 3), (3, 3)))
    assert far.shape == (3, 3, 3) and (far == 200).all()
    half = n.get_data(Footprint.of((102.5, 107.5), (4, 4), (4, 4)), 1, interpolation="cv_linear", dst_nodata=-1)
    want = (a[2:6, 2:6, 1] + a[2:6, 3:7, 1] + a[3:7, 2:6, 1] + a[3:7, 3:7, 1]) / 4
    near = (a[2:7, 2:7, 1] == 200)
    assert np.allclose(half, want) or near.any()
    with pytest.raises(ValueError):
        ds.wrap_numpy_raster("n", fp, a)
    f = ds.create_raster("f", f"{tmp_path}/f.tif", fp, "float32", 2, {"nodata": -5})
    assert (f.get_data() == -5).all() and f.mode == "w"
    f.fill(1.5, [1])
    f.set_data(pattern(4, 4)[:, :, 0], fp.clip(3, 3, 7, 7), 0)
    f.set_data(np.full((10, 10), 9.0), fp, 1, mask={"type": "Polygon", "coordinates": [[(100, 110), (100, 105), (105, 105), (105, 110), (100, 110)]]})
    got = f.get_data()
    assert (got[3:7, 3:7, 0] == pattern(4, 4)[:, :, 0]).all() and got[0, 0, 0] == -5 and (got[:5, :5, 1] == 9).all() and (got[5:, :, 1] == 1.5).all()
    with pytest.raises(ValueError):
        f.set_data(a[:, :, :2], fp, [0, 0])
    # from another grid: pixels whose neighbours are all there
    m = ds.acreate_raster("", fp, "float64", 1, driver="MEM")
    m.set_data(np.full((4, 4), 3.0), Footprint.of((102.5, 107.5), (4, 4), (4, 4)), interpolation="cv_linear")
    assert (m.array == 3).sum() == 9 and m.array[3, 3] == 3 and m.path is None
    with pytest.raises(RuntimeError):
        ds.create_raster("g", f"{tmp_path}/f.tif", fp, "float32", 1)
    with pytest.raises(RuntimeError):
        n2 = ds.open_raster("r", f"{tmp_path}/f.tif")
        n2.fill(0)
    with f.delete:
        pass
    assert not files.exists(f"{tmp_path}/f.tif") and "f" not in ds
    ds.close()
    assert len(ds) == 0


def test_other_references(spark):
    ds = Dataset(spark, sr_work=UTM, sr_fallback="+proj=utm +zone=31 +ellps=WGS84 +units=km")
    km = Footprint.of((500, 5200), (1, 1), (10, 10))
    m = Footprint.of((500000, 5200000), (1000, 1000), (10, 10))
    r = ds.wrap_numpy_raster("r", m, np.ones((10, 10)))
    assert math.isclose(r.fp_stored.tlx, km.tlx) and math.isclose(r.fp_stored.dx, km.dx) and math.isclose(r.fp.tly, m.tly, rel_tol=1e-9)
    v = ds.create_vector("v", "", "point", driver="Memory")
    v.insert_data({"type": "Point", "coordinates": [500500.0, 5200500.0]})
    stored = v.stored().first()["geom"]["parts"][0][0][0]
    assert abs(stored["x"] - 500.5) < 1e-6 and abs(v.bounds[0] - 500500) < 1e-3
    with pytest.raises(ValueError):
        Dataset(spark, sr_work=UTM).wrap_numpy_raster("r", m, np.ones((10, 10)))


@pytest.mark.parametrize("kind", sorted(raster.KERNELS))
def test_resampling_against_a_loop(spark, kind):
    from gridloom.catalogue import array_tiles

    a = np.random.default_rng(2).random((40, 50, 1))
    a[5, 7, 0] = -1
    src, dst = Footprint.of((0, 40), (50, 40), (50, 40)), Footprint.on_grid((3.3, 38.2), 20, (1.5, -1.25), (30, 24))
    got = np.zeros(dst.shape)
    for r in raster.read_tiles(array_tiles(spark, a, (16, 16)), (16, 16), src, dst, src_nodata=-1, dst_nodata=-9, interpolation=kind, block=8).collect():
        got[r["py"], r["px"]] = r["value"]
    n = raster.KERNELS[kind]
    first = 0 if n == 1 else 1 - n // 2

    def weight(d, f):
        if n == 1:
            return 1.0
        t = abs(d - f)
        if n == 2:
            return max(0.0, 1 - t)
        if n == 4:
            return 1.25 * t**3 - 2.25 * t**2 + 1 if t <= 1 else -0.75 * t**3 + 3.75 * t**2 - 6 * t + 3 if t < 2 else 0.0
        return float(np.sinc(t) * np.sinc(t / 4)) if t < 4 else 0.0

    for py in range(dst.rsy):
        for px in range(dst.rsx):
            u, v = (round(c, 6) for c in src.inverse(*dst.at(px, py)))
            iu, iv = (round(u), round(v)) if n == 1 else (math.floor(u), math.floor(v))
            ws = [(x, y, weight(x, u - iu) * weight(y, v - iv)) for x in range(first, first + n) for y in range(first, first + n)]
            total, out = sum(w for *_, w in ws), 0.0
            for x, y, w in ws:
                if abs(w) > 1e-12:
                    ok = 0 <= iu + x < 50 and 0 <= iv + y < 40 and a[iv + y, iu + x, 0] != -1
                    out = out + w / total * a[iv + y, iu + x, 0] if ok else math.nan
            want = -9 if math.isnan(out) else out
            assert abs(got[py, px] - want) < 1e-9


def test_reads_open_only_tiles_of_the_window(spark, tmp_path):
    t = spark.range(400).select((F.col("id") % 20).cast("int").alias("tx"), F.floor(F.col("id") / 20).cast("int").alias("ty"), F.array_repeat(F.lit(1.0), 64).alias("data"))
    t.write.parquet(f"{tmp_path}/t")
    fp = Footprint.of((0, 160), (160, 160), (160, 160))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = raster.read_tiles(spark.read.parquet(f"{tmp_path}/t"), (8, 8), fp, fp.clip(20, 30, 40, 50))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    filters = re.sub(r"#\d+", "", scan.split("DataFilters: [")[1].split("]")[0])
    assert "GreaterThanOrEqual(tx,2)" in scan and all(f in filters for f in ("(tx >= 2)", "(tx <= 4)", "(ty >= 3)", "(ty <= 6)")), scan


# --- vectors -------------------------------------------------------------------------------------

SHAPES = [
    {"type": "Polygon", "coordinates": [[[0.0, 0.0], [0.0, 9.0], [9.0, 9.0], [9.0, 0.0], [0.0, 0.0]], [[2.0, 2.0], [4.0, 2.0], [4.0, 4.0], [2.0, 4.0], [2.0, 2.0]]]},
    {"type": "MultiPolygon", "coordinates": [[[[0.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 0.0]]], [[[5.0, 5.0], [5.0, 6.0], [6.0, 6.0], [5.0, 5.0]]]]},
    None,
]


@pytest.mark.parametrize("driver, path", [("ESRI Shapefile", "v.shp"), ("GeoJSON", "v.json")])
def test_vector_files(spark, tmp_path, driver, path):
    ds = Dataset(spark, allow_none_geometry=True)
    fields = [{"name": "n", "type": "integer64"}, {"name": "x", "type": "real"}, {"name": "s", "type": "string", "width": 12}]
    v = ds.create_vector("v", f"{tmp_path}/{path}", "polygon", fields, driver=driver, sr=None)
    assert len(v) == 0
    for k, g in enumerate(SHAPES):
        v.insert_data(g, (k * 10**10, k / 3, "né" if k else None))
    v.close()
    w = ds.open_vector("w", f"{tmp_path}/{path}", driver=driver)
    got = list(w.iter_geojson())
    assert [g["geometry"] for g in got] == SHAPES and [g["properties"]["s"] for g in got] == [None, "né", "né"]
    assert [g["properties"]["n"] for g in got] == [0, 10**10, 2 * 10**10] and math.isclose(got[1]["properties"]["x"], 1 / 3, rel_tol=1e-9)
    assert w.bounds == (0, 0, 9, 9) and w.extent == (0, 9, 0, 9) and w.get_data(1, "n")[1] == 10**10
    with pytest.raises(IndexError):
        w.get_data(7)
    with pytest.raises(ValueError):
        ds.open_vector("x", f"{tmp_path}/{path}", layer="other", driver=driver)
    with pytest.raises(RuntimeError):
        ds.create_vector("y", f"{tmp_path}/{path}", "polygon", driver=driver)
    ds.create_vector("y", f"{tmp_path}/{path}", "polygon", driver=driver, ow=True).delete()
    with pytest.raises(RuntimeError):
        ds.open_vector("z", f"{tmp_path}/{path}", driver=driver)


def test_shapefile_records_of_many_tasks(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias("fid"), gm.geom("Point", F.array(gm.point(F.col("id"), -F.col("id")))).alias("geom"), F.col("id").cast("int").alias("n")).repartition(7)
    shapefile.write(df, f"{tmp_path}/p.shp", "Point", wkt="X")
    got = shapefile.read(spark, f"{tmp_path}/p.shp").orderBy("fid").select("fid", "n", F.col("geom.parts")[0][0][0]["x"].alias("x")).collect()
    assert [tuple(r) for r in got] == [(k, k, float(k)) for k in range(5000)] and shapefile.read_info(f"{tmp_path}/p.shp").wkt == "X"


def test_foreign_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"a": 1, "b": "x"}, "geometry": {"type": "LineString", "coordinates": [[0, 0, 5], [1, 1, 6]]}}, {"type": "Feature", "properties": {"a": 2.5}, "geometry": None}]}
    (tmp_path / "f.json").write_text(json.dumps(doc, indent=1))
    got = geojson.read(spark, f"{tmp_path}/f.json").orderBy("fid").collect()
    assert got[0]["geom"]["has_z"] and got[0]["geom"]["parts"][0][0][1]["z"] == 6 and got[1]["geom"] is None and [r["b"] for r in got] == ["x", None] and got[1]["a"] == 2.5


def plain_area(polygons):
    return sum(abs(plane.area(p[0])) - sum(abs(plane.area(h)) for h in p[1:]) for p in polygons)


def test_cuts_against_counted_points():
    rng = random.Random(2)
    star = [(50 + r * math.cos(t), 50 + r * math.sin(t)) for t, r in ((k * math.pi / 12, rng.uniform(10, 45)) for k in range(24))]
    hole = [(50 + 6 * math.cos(t), 50 + 6 * math.sin(t)) for t in (k * math.pi / 4 for k in range(8))][::-1]
    box, tri, ell = [(20, 20), (55, 20), (55, 62), (20, 62)], [(10, 50), (90, 30), (60, 95)], [(20, 20), (80, 20), (80, 40), (45, 40), (45, 80), (20, 80)]
    inside = lambda p, rings: sum(plane.inside(p, r) for r in rings) % 2
    for mask in ([box], [tri], [ell], [ell, [(25, 25), (35, 25), (35, 35), (25, 35)]]):
        got = plane.clipped([[star, hole]], mask)
        n = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(20000)]
        want = [inside(p, [star, hole]) and inside(p, mask) for p in n]
        have = [any(inside(p, g) for g in got) for p in n]
        assert sum(a != b for a, b in zip(want, have)) == 0
    comb = [(0, 0), (90, 0), (90, 50), (80, 50), (80, 10), (50, 10), (50, 50), (40, 50), (40, 10), (10, 10), (10, 50), (0, 50)]
    assert len(plane.clipped([[comb]], [[(0, 20), (100, 20), (100, 60), (0, 60)]])) == 3


def test_predicates_of_all_types(spark):
    rows = [
        (0, {"type": "LineString", "coordinates": [(-5, 5), (5, 5), (5, -5)]}, True, [[(0, 5), (5, 5), (5, 0)]]),
        (1, {"type": "LineString", "coordinates": [(11, -5), (16, 5)]}, False, None),
        (2, {"type": "MultiPoint", "coordinates": [(1, 1), (20, 20)]}, True, [[(1, 1)]]),
        (3, {"type": "Polygon", "coordinates": [[(-5, -5), (15, -5), (15, 15), (-5, 15), (-5, -5)], [(-1, -1), (-1, 11), (11, 11), (11, -1), (-1, -1)]]}, False, None),
        (4, {"type": "Polygon", "coordinates": [[(-5, -5), (15, -5), (15, 15), (-5, 15), (-5, -5)]]}, True, None),
        (5, {"type": "LineString", "coordinates": [(-5, 2), (15, 2), (15, 8), (-5, 8)]}, True, [[(0, 2), (10, 2)], [(10, 8), (0, 8)]]),
        (6, {"type": "Point", "coordinates": (10, 5)}, True, [[(10, 5)]]),
    ]
    df = spark.createDataFrame([(k, gm.value_of(g)) for k, g, *_ in rows], f"fid long, geom {ty.GEOM.simpleString()}")
    got = {r["fid"]: r["geom"] for r in vector.read(df, None, (0, 10, 0, 10), do_clip=True).collect()}
    assert set(got) == {k for k, _, met, _ in rows if met}
    for k, _, met, parts in rows:
        if parts:
            assert [[(p["x"], p["y"]) for p in part[0]] for part in got[k]["parts"]] == [[tuple(map(float, p)) for p in part] for part in parts]
    assert got[5]["type"] == "MultiLineString" and got[2]["type"] == "MultiPoint"


# --- footprints ----------------------------------------------------------------------------------


def test_intersections():
    a, b = Footprint.of((0, 10), (10, 10), (10, 10)), Footprint.of((3.25, 8.25), (4, 4), (8, 8))
    assert (a & b).bounds == (3, 4, 8, 9) and a.intersection(b, scale="highest").pxsize == (0.5, 0.5) and a.intersection(b, scale="highest").tl == (3.25, 8.25)
    assert a.intersection(b, scale=2, alignment=(0.5, 0.5)).bounds == (2.5, 2.5, 8.5, 8.5) and a.intersection(b, alignment="tl").tl == (3.25, 8.25)
    turned = Footprint.on_grid((5, 9), 45, (1, -1), (3, 3))
    both = a & turned
    assert both.angle == 0 and all(both.bounds[k] <= v + 1e-9 for k, v in ((0, 5), (1, turned.bounds[1]))) and (turned & a).angle == pytest.approx(45)
    assert a.intersection({"type": "LineString", "coordinates": [(2.5, -3), (2.5, 20)]}).shape == (10, 1)
    ring = [(math.cos(t) * 3 + 5, math.sin(t) * 1 + 5) for t in (0.3 + k * math.pi / 20 for k in range(40))]
    fit = a.intersection({"type": "Polygon", "coordinates": [[*ring, ring[0]]]}, rotation="fit", scale=0.1)
    assert abs(fit.angle) < 5 and abs(fit.rsx - 60) <= 2 and abs(fit.rsy - 20) <= 2
    for other in (Footprint.of((10, 10), (5, 5), (5, 5)), Footprint.of((30, 10), (5, 5), (5, 5))):
        assert not a.share_area(other)
        with pytest.raises(ValueError):
            a & other
    with pytest.raises(ValueError):
        a.intersection(b, homogeneous=True)
    with pytest.raises(RuntimeError):
        Footprint.of((1e12, 1e12), (1, 1), (10, 10)) & Footprint.of((1e12, 1e12), (1, 1), (10, 10))


def test_moves():
    f = Footprint.of((50000, 50000), (16384, 16384), (16384, 16384))
    assert f.move((1, 2)).tl == (1, 2)
    for k in range(8):
        t = k * math.pi / 4
        turn = lambda p: (p[0] * math.cos(t) - p[1] * math.sin(t) + 1e-6 * (k % 3), p[0] * math.sin(t) + p[1] * math.cos(t))
        m = f.move(*map(turn, (f.tl, f.tr, f.br)), round_coordinates=True, significant=9)
        assert m.pxsize == pytest.approx(f.pxsize, rel=1e-12) and (m.angle - math.degrees(t)) % 360 == pytest.approx(0, abs=1e-6) or (m.angle - math.degrees(t)) % 360 == pytest.approx(360, abs=1e-6)
    flipped = f.move((0, 0), (100, 0), (100, 200))
    assert flipped.dy > 0 and flipped.dx > 0
    with pytest.raises(ValueError):
        f.move((0, 0), (100, 0), (150, 100))
    with pytest.raises(ValueError):
        f.move((0, 0), None, (1, 1))
    lo, hi = corner_slack((0, 1), (0, 0), (1, 0), 9)
    assert lo < 90 < hi
    with pytest.raises(ValueError):
        Footprint.of((0, 5), (5, 5), (5, 5)).conv2d(9)


def test_kernels_wider_than_the_raster_are_refused(spark):
    small = spark.range(1).select(Footprint.of((0, 5), (5, 5), (5, 5)).lit().alias("fp"))
    with pytest.raises(Exception, match="wider"):
        small.select(fpx.conv2d(F.col("fp"), 9)).collect()
    assert small.select(fpx.conv2d(F.col("fp"), 9, padding=2)["rsx"]).first()[0] == 1


def test_analysis_and_text_of_references():
    utm, geo = srs.parse(UTM), srs.Reference()
    there, back = srs.transform_points(geo, utm), srs.transform_points(utm, geo)
    assert not srs.analyse(there, back, (0, 40, 6, 50)).angles
    for r in (utm, geo, srs.parse("+proj=lcc +lat_1=44 +lat_2=49 +lat_0=46.5 +lon_0=3 +x_0=700000 +y_0=6600000 +ellps=GRS80")):
        assert srs.parse(srs.to_wkt(r)) == r == srs.parse(srs.to_proj4(r))
    assert srs.wkt_of_any(UTM) == srs.to_wkt(utm)


# --- recipes -------------------------------------------------------------------------------------


def test_cached_recipe(spark, tmp_path):
    fp = Footprint.of((1000, 1100), (100, 100), (100, 100))
    a = pattern(100, 100)[:, :, 0]
    ds = Dataset(spark, allow_interpolation=True)
    src = ds.wrap_numpy_raster("src", fp, a)
    seen = []

    class Watch:
        def on_tiles_computed(self, r, n):
            seen.append(n)

    def blur(tile, fps, arrays, _):
        z = arrays["z"]
        assert fps["z"] == tile.dilate(1) and z.shape == (tile.rsy + 2, tile.rsx + 2)
        return np.stack([z[1:-1, 1:-1], z[:-2, 1:-1]], 2)

    how = dict(compute_array=blur, queue_data_per_primitive={"z": src.get_data}, convert_footprint_per_primitive={"z": lambda f: f.dilate(1)}, cache_dir=f"{tmp_path}/cache", cache_tiles=(26, 26), computation_tiles=(11, 22))
    r = ds.create_cached_raster_recipe("r", fp, "float64", 2, {"nodata": -1}, observers=[Watch()], **how)
    up = np.vstack([np.full((1, 100), -1.0), a[:-1]])
    windows = [fp.clip(0, 0, 30, 10), fp.clip(90, 90, 100, 100), fp.clip(20, 5, 40, 30)]
    for w, got in zip(windows, r.iter_data(windows)):
        x, y = (round(v) for v in fp.inverse(*w.tl))
        part = np.s_[y : y + w.rsy, x : x + w.rsx]
        assert (got == np.stack([a[part], up[part]], 2)).all()
    assert sum(seen) == 2 + 1 + 2 and r.cache_tiles == (26, 26) and set(r.primitives) == {"z"}
    seen.clear()
    assert (r.get_data(channels=1) == up).all() and seen == [16 - 5]
    again = ds.create_cached_raster_recipe("again", fp, "float64", 2, {"nodata": -1}, observers=[Watch()], **how)
    seen.clear()
    assert (again.get_data(channels=0) == a).all() and not seen
    # a damaged tile is computed anew
    bad = cut(spark.read.schema(recipe.TILES + ", sum long").parquet(how["cache_dir"]).where("tx = 1 and ty = 1").withColumn("sum", F.lit(0).cast("long")))
    bad.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ty", "tx").parquet(how["cache_dir"])
    assert (again.get_data(channels=0) == a).all() and seen == [1]
    with pytest.raises(ValueError):
        ds.create_cached_raster_recipe("wrong", fp, "float32", 2, **how).get_data()
    short = ds.create_raster_recipe("short", fp, "float64", 1, compute_array=lambda f, *_: np.zeros((1, 1)))
    with pytest.raises(Exception, match="returned"):
        short.get_data()


def test_converts_that_depend_on_the_place(spark):
    fp = Footprint.of((0, 40), (40, 40), (40, 40))
    ds = Dataset(spark)
    a = pattern(40, 40)[:, :, 0]
    src = ds.wrap_numpy_raster("s", fp, a)
    flip = lambda f: Footprint(40 - f.tlx - f.rsx, 1.0, 0.0, f.tly, 0.0, -1.0, f.rsx, f.rsy)
    r = ds.create_raster_recipe("r", fp, "float64", 1, compute_array=lambda f, fps, arrays, _: arrays["s"][:, ::-1], queue_data_per_primitive={"s": src.read}, convert_footprint_per_primitive={"s": flip}, computation_tiles=(16, 16))
    assert (r.get_data() == a[:, ::-1]).all()


def test_queues_are_bounded_and_end(spark):
    fp = Footprint.of((0, 8), (8, 8), (8, 8))
    r = recipe.Recipe(fp, lambda f, *_: np.full(f.shape, f.tlx), tile=(4, 4))
    q = r.queue_data(spark, [fp.clip(k, 0, k + 1, 1) for k in range(6)], max_queue_size=2)
    assert q.get(60)[0, 0] == 0
    assert q._queue.maxsize == 2 and q._queue.qsize() <= 2
    q.close()
    assert list(q) == []
    bad = recipe.Recipe(fp, lambda *_: 1 / 0, tile=(4, 4)).queue_data(spark, [fp])
    with pytest.raises(Exception, match="ZeroDivision"):
        bad.get(60)


# --- pixels and lines ----------------------------------------------------------------------------


def test_lines_are_merged(spark):
    grid = ["......#...", "......#...", ".######...", "......#...", "......#.##", "..........", ".##.......", ".##......."]
    mask = spark.createDataFrame([(x, y) for y, line in enumerate(grid) for x, c in enumerate(line) if c == "#"], "px int, py int")
    got = rasterize.find_lines(mask, Footprint.of((0, 8), (10, 8), (10, 8))).collect()
    ends = sorted(r["n"] for r in got)
    assert all(r["wkt"].startswith("LINESTRING (") for r in got) and ends.count(1) >= 1 and max(ends) >= 4
    whole = rasterize.find_lines(mask, Footprint.of((0, 8), (10, 8), (10, 8)), merge=False)
    assert whole.count() == sum(ends)
    loop = spark.createDataFrame([(x, y, x2, y2) for (x, y), (x2, y2) in zip([(0, 0), (1, 0), (1, 1), (0, 1)], [(1, 0), (1, 1), (0, 1), (0, 0)])], "ax int, ay int, bx int, by int")
    assert [r["n"] for r in rasterize.merged_lines(loop, Footprint.of((0, 8), (8, 8), (8, 8))).collect()] == [4]


def test_all_touched_against_fine_steps(spark):
    rng = random.Random(9)
    rows = [(k, gm.value_of({"type": "LineString", "coordinates": [(rng.uniform(-2, 20), rng.uniform(-2, 20)) for _ in range(3)]})) for k in range(20)]
    df = spark.createDataFrame(rows, f"k int, geom {ty.GEOM.simpleString()}")
    fp = Footprint.of((0, 16), (16, 16), (16, 16))
    got = {tuple(r) for r in rasterize.burn_lines(df, fp, "k", all_touched=True).select("k", "px", "py").collect()}
    seen = set()
    for k, g in rows:
        pts = g["parts"][0][0]
        for a, b in zip(pts, pts[1:]):
            for i in range(40001):
                t = i / 40000
                u, v = fp.inverse(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"]))
                if 0 <= u < 16 and 0 <= v < 16:
                    seen.add((k, int(u), int(v)))
    assert seen <= got and len(got - seen) <= 3
    assert rasterize.label_type(255) == "uint8" and rasterize.label_type(256) == "uint16"


def test_type_names():
    assert ty.open_flags("raster, update") == 3 and ty.open_flags_of_mode("r") == 0 and ty.pixel_types_of("smallint") == ["uint8", "int16"]
    with pytest.raises(ValueError):
        ty.downcast("datetime64")
    for name in ("integer", "real", "stringlist", "date"):
        assert ty.field_type_name(ty.field("x", name).dataType) == name


def test_text_and_names(spark):
    turned = Footprint.on_grid((5, 9), 30, (0.5, -0.5), (4, 3))
    one = spark.range(1).select(turned.lit().alias("fp")).select(fpx.text(F.col("fp")).alias("t"), fpx.shape(F.col("fp")).alias("s")).first()
    assert one["t"] == "Footprint(tl=(5.000000, 9.000000), scale=(0.500000, -0.500000), angle=30.000000, rsize=(4, 3))" and one["s"] == [3, 4] == list(turned.shape)
    assert srs.same(UTM, srs.to_wkt(srs.parse(UTM))) and not srs.same(UTM, "+proj=utm +zone=32 +ellps=WGS84")
    with pytest.raises(Exception, match="legal"):
        spark.range(1).select(fpx.checked(turned.lit())["rsx"]).collect()


@pytest.mark.parametrize("effect", ["extend", "exclude", "overlap", "shrink"])
def test_table_function_equals_expressions(spark, effect):
    from gridloom.operators import tiling

    cases = [(n, s, o) for n in range(1, 9) for s in range(1, 6) for o in range(s) if not (effect == "overlap" and n < s)]
    df = spark.createDataFrame(cases, "n int, s int, o int")
    for r in df.select("n", "s", "o", tiling.offsets(F.col("n"), F.col("s"), F.col("o"), effect).alias("t")).collect():
        assert [(t["at"], t["len"]) for t in r["t"]] == tiling.plain_offsets(r["n"], r["s"], r["o"], effect)
