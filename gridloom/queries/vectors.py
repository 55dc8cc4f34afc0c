"""Features: filters, clips, slices, fields, inserts, joins and encodings."""

from pyspark.sql import functions as F

from ..functions import geometry as gm
from ..operators import spatial_join, vector
from ..plans.spread import once
from .base import CUS, PART, customer_points, part_boxes, query, table

BOX = (20.0, 60.0, 30.0, 70.0)  # minx, maxx, miny, maxy
_IN = "maxx >= 20 AND minx <= 60 AND maxy >= 30 AND miny <= 70"


@query(f"WITH {PART} SELECT fid, p_name FROM box WHERE {_IN}")
def vector_filter_extent(spark, sf_dir):
    return vector.read(part_boxes(spark, sf_dir), "p_name", BOX).select("fid", "p_name")


@query(f"WITH {PART} SELECT fid FROM box WHERE maxx >= 0 AND minx <= 64 AND maxy >= 0 AND miny <= 64")
def vector_filter_mask(spark, sf_dir):
    from ..footprint import Footprint

    return vector.read(part_boxes(spark, sf_dir), None, Footprint.of((0, 64), (64, 64), (64, 64))).select("fid")


@query(f"WITH {PART} SELECT fid, greatest(minx, 20) AS minx, greatest(miny, 30) AS miny, least(maxx, 60) AS maxx, least(maxy, 70) AS maxy, (least(maxx, 60) - greatest(minx, 20)) * (least(maxy, 70) - greatest(miny, 30)) AS area FROM box WHERE {_IN}")
def vector_clip_rect(spark, sf_dir):
    c = vector.read(part_boxes(spark, sf_dir), None, BOX, do_clip=True)
    b = gm.bbox(F.col("geom"))
    return c.select("fid", *[x.alias(n) for x, n in zip(b, ("minx", "miny", "maxx", "maxy"))], gm.area(F.col("geom")).alias("area"))


@query(f"WITH {PART}, r AS (SELECT fid, row_number() OVER (ORDER BY fid) - 1 AS i FROM box WHERE {_IN}) SELECT fid FROM r WHERE i >= 2 AND i < 40 AND (i - 2) % 3 = 0")
def vector_slice(spark, sf_dir):
    return vector.read(part_boxes(spark, sf_dir), None, BOX, slicing=slice(2, 40, 3)).select("fid")


@query(f"WITH {PART} SELECT fid FROM box ORDER BY fid LIMIT 7 OFFSET 3")
def vector_slice_step_one(spark, sf_dir):
    return vector.read(part_boxes(spark, sf_dir), None, slicing=slice(3, 10, 1)).select("fid")


@query(f"WITH {PART} SELECT fid, p_size, p_name FROM box")
def vector_fields(spark, sf_dir):
    return vector.read(part_boxes(spark, sf_dir), ["p_size", 0]).select("fid", "p_size", "p_name")


@query(f"WITH {PART} SELECT fid, p_name FROM box WHERE {_IN} ORDER BY fid LIMIT 1 OFFSET 1")
def vector_get_one(spark, sf_dir):
    return vector.get(part_boxes(spark, sf_dir), 1, fields="p_name", mask=BOX).select("fid", "p_name")


@query(f"WITH {PART} SELECT min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM box")
def vector_extent(spark, sf_dir):
    return vector.bounds(part_boxes(spark, sf_dir))


@query(f"WITH {PART} SELECT count(*) AS n FROM box")
def vector_count(spark, sf_dir):
    return part_boxes(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PART} SELECT fid, p_size, minx, maxy FROM box")
def vector_geojson(spark, sf_dir):
    g = vector.geojson(part_boxes(spark, sf_dir))
    j = lambda p: F.get_json_object("feature", p)
    return g.select("fid", j("$.properties.p_size").cast("int").alias("p_size"), j("$.geometry.coordinates[0][0][0]").cast("double").alias("minx"), j("$.geometry.coordinates[0][0][1]").cast("double").alias("maxy"))


@query(f"WITH {PART} SELECT fid, minx, miny, maxx, maxy FROM box")
def geojson_round_trip(spark, sf_dir):
    g = part_boxes(spark, sf_dir).select("fid", gm.from_geojson(gm.to_geojson(F.col("geom"))).alias("geom"))
    return g.select("fid", *[x.alias(n) for x, n in zip(gm.bbox(F.col("geom")), ("minx", "miny", "maxx", "maxy"))])


@query(f"WITH {PART}, t AS (SELECT max(fid) AS top FROM box) SELECT fid, p_name, p_size FROM box UNION ALL SELECT top + 1 + r_regionkey, r_name, NULL FROM region, t")
def insert_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "region").orderBy("r_regionkey").select(F.col("r_name").alias("p_name"))
    return vector.insert(part_boxes(spark, sf_dir), rows).select("fid", "p_name", "p_size")


@query(f"WITH {PART} SELECT fid FROM box WHERE fid % 20 <> 0 AND {_IN}")
def none_geometry_policy(spark, sf_dir):
    p = part_boxes(spark, sf_dir).withColumn("geom", F.when(F.col("fid") % 20 != 0, F.col("geom")))
    return vector.read(p, None, BOX, allow_none=True).select("fid")


@query(f"WITH {CUS}, {PART} SELECT k, fid FROM cus JOIN box ON x >= minx AND x < maxx AND cus.y >= miny AND cus.y < maxy")
def spatial_join_points_polygons(spark, sf_dir):
    p = customer_points(spark, sf_dir).select("k", "x", "y")
    return spatial_join.points_in_polygons(p, part_boxes(spark, sf_dir).select("fid", "geom")).select("k", "fid")


@query("WITH c AS (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS channel, unnest([-32767.0, 0.0, -32767.0])::DOUBLE AS nodata, 'grayindex' AS interpretation, 0.0::DOUBLE AS \"offset\", 2.0::DOUBLE AS scale, 'all_valid' AS mask) SELECT s_suppkey AS k, channel, nodata, interpretation, \"offset\", scale, mask, round(s_acctbal * scale + \"offset\", 4) AS value FROM supplier JOIN c ON channel = s_suppkey % 3")
def channels_schema_broadcast(spark, sf_dir):
    """The suppliers' balances as samples of three channels, scaled as their channel says."""
    from ..functions.types import CHANNEL, channels_schema

    rows = channels_schema(3, {"nodata": [-32767, 0, -32767], "interpretation": "grayindex", "scale": 2})
    df = spark.createDataFrame([(i, tuple(r[f.name] for f in CHANNEL)) for i, r in enumerate(rows)], f"channel int, c {CHANNEL.simpleString()}")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 3).cast("int").alias("channel"), "s_acctbal")
    found = s.join(F.broadcast(df), "channel").select("k", "channel", "c.*", "s_acctbal")
    return found.withColumn("value", F.round(F.col("s_acctbal") * F.col("scale") + F.col("offset"), 4)).drop("s_acctbal")


@query("SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS SMALLINT) AS uint8, CAST(l_extendedprice AS FLOAT) AS float32, CAST(l_linenumber AS BIGINT) AS int64 FROM lineitem")
def type_lattice_cast(spark, sf_dir):
    from ..functions.types import pixel_type

    c = lambda n, t: F.col(n).cast(pixel_type(t)).alias(t)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c("l_quantity", "uint8"), c("l_extendedprice", "float32"), c("l_linenumber", "int64"))


# --- shapes other than rectangles ----------------------------------------------------------------


def _rect(x0, y0, x1, y1, hole: bool = False):
    """A closed ring; holes turn the other way."""
    ring = [(x0, y1), (x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return F.array(*[gm.point(x, y) for x, y in (ring[::-1] if hole else ring)])


def _shape(kind, *parts):
    return F.struct(F.lit(kind).alias("type"), F.lit(False).alias("has_z"), F.array(*[F.array(*p) for p in parts]).alias("parts"))


def _boxes(spark, sf_dir, *fields):
    b = once(part_boxes(spark, sf_dir), **dict(zip(("minx", "miny", "maxx", "maxy"), gm.bbox(F.col("geom")))))
    return b.select("fid", "minx", "miny", "maxx", "maxy", *fields)


def _c(*names):
    return [F.col(n) for n in names]


def frames(spark, sf_dir, *fields):
    """(fid, geom, fields): squares with a hole of half their width."""
    b = _boxes(spark, sf_dir, *fields)
    x0, y0, x1, y1 = _c("minx", "miny", "maxx", "maxy")
    q = (x1 - x0) / 4
    return b.select("fid", _shape("Polygon", [_rect(x0, y0, x1, y1), _rect(x0 + q, y0 + q, x1 - q, y1 - q, True)]).alias("geom"), *fields)


_CUT = "greatest(0, least({x1}, 60) - greatest({x0}, 20)) * greatest(0, least({y1}, 70) - greatest({y0}, 30))"
_whole = _CUT.format(x0="minx", x1="maxx", y0="miny", y1="maxy")
_hole = _CUT.format(x0="minx + h / 2", x1="maxx - h / 2", y0="miny + h / 2", y1="maxy - h / 2")
_H = PART + ", hb AS (SELECT *, (maxx - minx) / 2 AS h FROM box)"


@query(f"WITH {_H} SELECT fid, {_whole} - {_hole} AS area FROM hb WHERE {_IN} AND ({_whole} - {_hole} > 0)")
def vector_clip_holes(spark, sf_dir):
    c = vector.read(frames(spark, sf_dir), None, BOX, do_clip=True).select("fid", gm.area(F.col("geom")).alias("area"))
    return c.where("area > 0")


@query(f"WITH {_H} SELECT fid FROM hb WHERE maxx >= 16.5 AND minx <= 17.5 AND maxy >= 84.5 AND miny <= 85.5 AND NOT (minx + h / 2 < 16.5 AND maxx - h / 2 > 17.5 AND miny + h / 2 < 84.5 AND maxy - h / 2 > 85.5)")
def vector_filter_holes(spark, sf_dir):
    """Of frames around one place, a mask there meets those whose hole does not hold it."""
    return vector.read(frames(spark, sf_dir), None, (16.5, 17.5, 84.5, 85.5)).select("fid")


_up = "greatest(0, least(minx + h, 60) - greatest(minx, 20)) * greatest(0, least(maxy, 70) - greatest(miny + h, 30))"
_low = "greatest(0, least(maxx, 60) - greatest(minx, 20)) * greatest(0, least(miny + h, 70) - greatest(miny, 30))"


@query(f"WITH {_H} SELECT fid, {_up} + {_low} AS area FROM hb WHERE {_up} + {_low} > 0")
def vector_clip_concave(spark, sf_dir):
    """L-shaped polygons: a square without its upper right quarter."""
    x0, y0, x1, y1 = _c("minx", "miny", "maxx", "maxy")
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    ring = F.array(*[gm.point(x, y) for x, y in ((x0, y1), (x0, y0), (x1, y0), (x1, my), (mx, my), (mx, y1), (x0, y1))])
    shapes = _boxes(spark, sf_dir).select("fid", _shape("Polygon", [ring]).alias("geom"))
    c = vector.read(shapes, None, BOX, do_clip=True).select("fid", gm.area(F.col("geom")).alias("area"))
    return c.where("area > 0")


_left = _CUT.format(x0="minx", x1="maxx", y0="miny", y1="maxy")
_right = _CUT.format(x0="minx + 40", x1="maxx + 40", y0="miny", y1="maxy")


@query(f"WITH {_H} SELECT fid, CAST(({_left} > 0) AS INTEGER) + CAST(({_right} > 0) AS INTEGER) AS n, {_left} + {_right} AS area FROM hb WHERE {_left} + {_right} > 0")
def vector_clip_parts(spark, sf_dir):
    """Two squares, 40 apart, that are one feature."""
    x0, y0, x1, y1 = _c("minx", "miny", "maxx", "maxy")
    shapes = _boxes(spark, sf_dir).select("fid", _shape("MultiPolygon", [_rect(x0, y0, x1, y1)], [_rect(x0 + 40, y0, x1 + 40, y1)]).alias("geom"))
    # a part that only touches the mask leaves a part without area
    c = vector.read(shapes, None, BOX, do_clip=True)
    n = F.size(F.filter(c["geom"]["parts"], lambda p: F.abs(gm.ring_area(p[0])) > 0))
    return c.select("fid", n.alias("n"), gm.area(F.col("geom")).alias("area")).where("area > 0")


def lines(spark, sf_dir):
    """(fid, geom): lines to the right of the customers, with a step up in the middle."""
    x, y, n = F.col("x"), F.col("y"), 3 + F.col("k") % 40
    pts = F.array(gm.point(x, y), gm.point(x + n, y), gm.point(x + n, y + 1), gm.point(x + 2 * n, y + 1))
    return customer_points(spark, sf_dir).select(F.col("k").alias("fid"), _shape("LineString", [pts]).alias("geom"))


_LINES = f"{CUS}, ln AS (SELECT k AS fid, x, y, 3 + k % 40 AS n FROM cus), sg AS (SELECT fid, greatest(x, 20) AS a, least(x + n, 60) AS b, y >= 30 AND y < 70 AS inside FROM ln UNION ALL SELECT fid, greatest(x + n, 20), least(x + 2 * n, 60), y + 1 >= 30 AND y + 1 < 70 FROM ln), st AS (SELECT fid, least(y + 1, 70) - greatest(y, 30) AS len FROM ln WHERE x + n > 20 AND x + n < 60)"


@query(f"WITH {_LINES}, u AS (SELECT fid, b - a AS len FROM sg WHERE inside AND b > a UNION ALL SELECT fid, len FROM st WHERE len > 0) SELECT fid, sum(len) AS length FROM u GROUP BY fid")
def vector_clip_lines(spark, sf_dir):
    """What a box leaves of lines, by its length."""
    c = vector.read(lines(spark, sf_dir), None, BOX, do_clip=True)
    step = lambda r: F.aggregate(F.sequence(F.lit(0), F.size(r) - 2), F.lit(0.0), lambda a, i: a + F.abs(F.get(r, i + 1)["x"] - F.get(r, i)["x"]) + F.abs(F.get(r, i + 1)["y"] - F.get(r, i)["y"]))
    total = F.aggregate(F.flatten(c["geom"]["parts"]), F.lit(0.0), lambda a, r: a + step(r))
    return c.select("fid", total.alias("length")).where("length > 0")


@query(f"WITH {_LINES} SELECT DISTINCT fid FROM (SELECT fid FROM sg WHERE inside AND b >= a UNION ALL SELECT fid FROM st WHERE len >= 0)")
def vector_filter_lines(spark, sf_dir):
    return vector.read(lines(spark, sf_dir), None, BOX).select("fid")


@query(f"WITH {CUS} SELECT k AS fid, x, y FROM cus WHERE abs(x - 64) + abs(y - 64) <= 40.125")
def vector_filter_diamond(spark, sf_dir):
    """Points within a polygon that is no box."""
    pts = customer_points(spark, sf_dir).select(F.col("k").alias("fid"), gm.geom("Point", F.array(gm.point(F.col("x"), F.col("y")))).alias("geom"))
    w = 40.125
    mask = {"type": "Polygon", "coordinates": [[(64, 64 + w), (64 - w, 64), (64, 64 - w), (64 + w, 64), (64, 64 + w)]]}
    p = F.col("geom")["parts"][0][0][0]
    return vector.read(pts, None, mask, do_clip=True).select("fid", p["x"].alias("x"), p["y"].alias("y"))


# --- text and files ------------------------------------------------------------------------------


@query(f"WITH {_H} SELECT fid, h * h * 4 - h * h AS area, CAST(2 AS INTEGER) AS rings FROM hb")
def wkt_round_trip(spark, sf_dir):
    g = frames(spark, sf_dir).select("fid", gm.from_wkt(gm.to_wkt(F.col("geom"))).alias("geom"))
    return g.select("fid", gm.area(F.col("geom")).alias("area"), F.size(F.col("geom")["parts"][0]).alias("rings"))


_FILE = f"WITH {_H} SELECT CAST(row_number() OVER (ORDER BY fid) - 1 AS BIGINT) AS fid, h * h * 4 - h * h AS area, p_name, p_size FROM hb"


def _layer(spark, sf_dir):
    """Frames with the fields of their parts, in one pass: a join would broadcast a table that its file's size makes look small."""
    return frames(spark, sf_dir, "p_name", "p_size")


@query(_FILE)
def shapefile_round_trip(spark, sf_dir):
    from ..sources import shapefile
    from .base import shared

    path = shared(spark, "frames.shp")
    shapefile.write(_layer(spark, sf_dir), path, "Polygon")
    return shapefile.read(spark, path).select("fid", gm.area(F.col("geom")).alias("area"), "p_name", "p_size")


@query(f"WITH {_H} SELECT fid, h * h * 4 - h * h AS area, p_name, CAST(p_size AS BIGINT) AS p_size FROM hb")
def geojson_file_round_trip(spark, sf_dir):
    from ..sources import geojson
    from .base import shared

    path = shared(spark, "frames.json")
    geojson.write(_layer(spark, sf_dir), path)
    return geojson.read(spark, path).select("fid", gm.area(F.col("geom")).alias("area"), "p_name", "p_size")


@query(f"WITH {CUS} SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS fid, x, y, c_name FROM cus WHERE x >= 20 AND x <= 60 AND y >= 30 AND y <= 70")
def catalogue_vector(spark, sf_dir):
    """A layer made, filled, closed, opened and read through a catalogue, within a mask."""
    from ..catalogue import Dataset
    from .base import shared

    path = shared(spark, "points.shp")
    rows = customer_points(spark, sf_dir).select(F.col("k").alias("fid"), gm.geom("Point", F.array(gm.point(F.col("x"), F.col("y")))).alias("geom"), "c_name")
    with Dataset(spark) as ds:
        made = ds.create_vector("points", path, "point", [{"name": "c_name", "type": "string"}])
        made.insert(vector.read(rows, -1, BOX))
        made.close()
        v = ds.open_vector("again", path)
        p = F.col("geom")["parts"][0][0][0]
        return v.read("c_name").select("fid", p["x"].alias("x"), p["y"].alias("y"), "c_name")


_FAMILIES = "SELECT unnest(['bool', 'uint8', 'int8', 'int16', 'uint16', 'int32', 'uint32', 'int64', 'uint64', 'float16', 'float32', 'float64', 'float128', 'complex64']) AS name, unnest(['uint8', 'uint8', NULL, 'int16', 'uint16', 'int32', 'uint32', NULL, NULL, NULL, 'float32', 'float64', NULL, 'complex64']) AS equivalent, unnest(['uint8', 'uint8', 'int16', 'int16', 'uint16', 'int32', 'uint32', NULL, NULL, 'float32', 'float32', 'float64', NULL, 'complex64']) AS upcast, unnest(['uint8', 'uint8', 'int16', 'int16', 'uint16', 'int32', 'uint32', 'float64', 'float64', 'float32', 'float32', 'float64', 'float64', 'complex64']) AS downcast"
_TYPES = "bool uint8 int8 int16 uint16 int32 uint32 int64 uint64 float16 float32 float64 float128 complex64".split()


@query(f"WITH f AS ({_FAMILIES}), p AS (SELECT {_TYPES!r}[CAST(p_size % 14 AS INTEGER) + 1] AS name, count(*) AS n FROM part GROUP BY 1) SELECT name, equivalent, upcast, downcast, n FROM p JOIN f USING (name)")
def type_families(spark, sf_dir):
    """What the pixel types that a table names become in files, and how often each is named."""
    from ..functions import types as ty

    to = lambda how, n: getattr(ty, how)(n) if ty.is_file_type(n, how) else None
    families = spark.createDataFrame([(n, to("equivalent", n), to("upcast", n), to("downcast", n)) for n in _TYPES], "name string, equivalent string, upcast string, downcast string")
    named = table(spark, sf_dir, "part").select(F.get(F.array(*map(F.lit, _TYPES)), (F.col("p_size") % 14).cast("int")).alias("name"))
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(families), "name").select("name", "equivalent", "upcast", "downcast", "n")


@query(
    f"WITH {CUS}, top AS (SELECT max(k) AS t FROM cus), s AS (SELECT t + row_number() OVER (ORDER BY s_suppkey) AS fid, s_suppkey + 0.5::DOUBLE AS x, s_nationkey::DOUBLE AS y, s_name AS c_name FROM supplier, top), "
    "a AS (SELECT k AS fid, x, y, c_name FROM cus UNION ALL SELECT fid, x, y, c_name FROM s), o AS (SELECT DISTINCT o_custkey AS fid FROM orders) "
    "SELECT fid, CASE WHEN fid IN (SELECT fid FROM o) THEN -x ELSE x END AS x, y, c_name FROM a WHERE fid NOT IN (SELECT n_nationkey * 10 FROM nation)"
)
def versioned_features(spark, sf_dir):
    """A layer that is written to in place: customers, suppliers numbered after them, customers with orders moved, some features removed."""
    from ..catalogue import Dataset
    from .base import shared

    point = lambda x, y: gm.geom("Point", F.array(gm.point(x, y))).alias("geom")
    cus = customer_points(spark, sf_dir).select(F.col("k").alias("fid"), "x", "y", "c_name")
    v = Dataset(spark).create_vector("v", shared(spark, "layer"), "point", [{"name": "c_name", "type": "string"}], driver="table")
    v.insert(cus.select("fid", point(F.col("x"), F.col("y")), "c_name"))
    s = table(spark, sf_dir, "supplier").orderBy("s_suppkey")
    v.insert(s.select(point((F.col("s_suppkey") + 0.5).cast("double"), F.col("s_nationkey").cast("double")), F.col("s_name").alias("c_name")))
    busy = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("fid")).distinct()
    v.insert(cus.join(busy, "fid", "left_semi").select("fid", point(-F.col("x"), F.col("y")), "c_name"))
    v.remove_rows(table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 10).alias("fid")))
    p = F.col("geom")["parts"][0][0][0]
    return v.read("c_name").select("fid", p["x"].alias("x"), p["y"].alias("y"), "c_name")


# Shifts of two datums to WGS 84, metres, arc seconds, millionths.
_BRITISH, _GERMAN = (446.448, -125.157, 542.06, 0.1502, 0.247, 0.8421, -20.4894), (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)
_AIRY, _BESSEL = (6377563.396, 299.3249646), (6377397.155, 299.1528128)


def _datum_sql() -> str:
    """Geodetic to geocentric, a shift of seven numbers, the inverse of another one, and Bowring's formula."""
    import numpy as np

    from ..sources import srs

    there, back = srs._rotation(_BRITISH), np.linalg.inv(srs._rotation(_GERMAN))
    (a1, f1), (a2, f2) = _AIRY, _BESSEL
    e1, e2 = ((2 - 1 / f) / f for f in (f1, f2))
    b2 = a2 * (1 - e2) ** 0.5
    row = lambda m, k, v: " + ".join(f"({float(m[k, i])!r}::DOUBLE) * {c}" for i, c in enumerate(v))
    return (
        f"WITH {CUS}, d AS (SELECT k, x / 20 - 6 AS lon, 50 + y / 15 AS lat FROM cus), g AS (SELECT k, radians(lon) AS l, radians(lat) AS p FROM d), n AS (SELECT *, {a1!r}::DOUBLE / sqrt(1 - {e1!r}::DOUBLE * sin(p) * sin(p)) AS n FROM g), "
        f"c AS (SELECT k, n * cos(p) * cos(l) AS x, n * cos(p) * sin(l) AS y, n * {1 - e1!r}::DOUBLE * sin(p) AS z FROM n), "
        f"w AS (SELECT k, {row(there, 0, 'xyz')} + {_BRITISH[0]!r}::DOUBLE - {_GERMAN[0]!r}::DOUBLE AS x, {row(there, 1, 'xyz')} + ({_BRITISH[1]!r}::DOUBLE) - {_GERMAN[1]!r}::DOUBLE AS y, {row(there, 2, 'xyz')} + {_BRITISH[2]!r}::DOUBLE - {_GERMAN[2]!r}::DOUBLE AS z FROM c), "
        f"v AS (SELECT k, {row(back, 0, 'xyz')} AS x, {row(back, 1, 'xyz')} AS y, {row(back, 2, 'xyz')} AS z FROM w), "
        f"t AS (SELECT *, sqrt(x * x + y * y) AS r, atan2(z * {a2!r}::DOUBLE, sqrt(x * x + y * y) * {b2!r}::DOUBLE) AS t FROM v) "
        f"SELECT k, round(degrees(atan2(y, x)), 8) AS lon, round(degrees(atan2(z + {e2 / (1 - e2) * b2!r}::DOUBLE * pow(sin(t), 3), r - {e2 * a2!r}::DOUBLE * pow(cos(t), 3))), 8) AS lat FROM t"
    )


@query(_datum_sql())
def datum_change(spark, sf_dir):
    """Points of one datum carried to another, features and all: Airy's ellipsoid to Bessel's by way of WGS 84."""
    from ..sources import srs

    a, b = srs.parse("+proj=longlat +datum=OSGB36 +no_defs"), srs.parse("+proj=longlat +datum=potsdam +no_defs")
    p = customer_points(spark, sf_dir).select("k", gm.geom("Point", F.array(gm.point(F.col("x") / 20 - 6, 50 + F.col("y") / 15))).alias("geom"))
    q = p.select("k", gm.transformed(F.col("geom"), srs.transform(a, b))["parts"][0][0][0].alias("q"))
    return q.select("k", F.round(F.col("q")["x"], 8).alias("lon"), F.round(F.col("q")["y"], 8).alias("lat"))


_COUNTS = f"{_H}, c AS (SELECT floor(round(minx + h * 5 / 6, 6)) AS px, floor(round(128 - (miny + h * 5 / 6), 6)) AS py FROM hb), t AS (SELECT CAST(floor(px / 8) AS INTEGER) AS tx, CAST(floor(py / 8) AS INTEGER) AS ty, count(*) AS n FROM c WHERE px BETWEEN 0 AND 127 AND py BETWEEN 0 AND 127 GROUP BY 1, 2)"


def _tile_counts(spark, sf_dir):
    """Counts by tile of L-shaped polygons, squares without their upper right quarter."""
    from ..footprint import Footprint

    x0, y0, x1, y1 = _c("minx", "miny", "maxx", "maxy")
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    ring = F.array(*[gm.point(x, y) for x, y in ((x0, y1), (x0, y0), (x1, y0), (x1, my), (mx, my), (mx, y1), (x0, y1))])
    shapes = _boxes(spark, sf_dir).select("fid", _shape("Polygon", [ring]).alias("geom"))
    return spatial_join.features_by_tile(shapes, Footprint.of((0, 128), (128, 128), (128, 128)), 8, 8)


@query(f"WITH {_COUNTS} SELECT tx, ty, n FROM t")
def features_by_tile(spark, sf_dir):
    """How many polygons have their middle in each tile."""
    return _tile_counts(spark, sf_dir)


@query(f"WITH {_COUNTS} SELECT tx, ty, n FROM t ORDER BY n DESC, ty, tx LIMIT 10")
def topk_tiles_by_features(spark, sf_dir):
    """The ten tiles with the most polygons."""
    return _tile_counts(spark, sf_dir).orderBy(F.desc("n"), "ty", "tx").limit(10)
