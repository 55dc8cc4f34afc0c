"""Tilings, rasters, focal operators, conversions between pixels and geometries, recipes."""

import math

from pyspark.sql import functions as F

from ..footprint import Footprint
from ..functions import footprint as fpx
from ..operators import focal, raster, rasterize, recipe, spatial_join, tiling
from .base import CUS, MOSAIC, ORD, PART, SUP, customer_points, flat, footprints, fp, mosaic, mosaic_tiles, order_pixels, part_boxes, query, table

MOS_FP = Footprint.of((0, 1000), (128, 1000), (128, 1000))


def _tile(name, effect, locus, sx, sy, ox, oy):
    """SQL of one tiling: offsets in each direction as rows."""
    axes = []
    for n, s, o in (("rsx", sx, ox), ("rsy", sy, oy)):
        inc = s - o
        count = f"(CASE WHEN {n} < {s} THEN 0 ELSE 1 + ({n} - {s}) // {inc} END)"
        gap = f"({n} - {s} - greatest(0, {count} - 1) * {inc})"
        if effect == "exclude":
            total, at, ln = count, "0", str(s)
        else:
            total = f"({count} + CASE WHEN {gap} <> 0 THEN 1 ELSE 0 END)"
            at = f"({n} - {s})" if effect == "overlap" else f"(CASE WHEN {gap} > 0 THEN {n} - {gap} - {o} ELSE 0 END)"
            ln = f"(CASE WHEN {gap} > 0 THEN {gap} + {o} ELSE {n} END)" if effect == "shrink" else str(s)
        axes.append((count, inc, total, at, ln, s))
    (cx, ix, tx, ax, lx, sx), (cy, iy, ty, ay, ly, sy) = axes
    dirx, diry = tiling.LOCI[locus]
    left = "xa" if dirx > 0 else "rsx - xa - xl"
    top = "ya" if diry > 0 else "rsy - ya - yl"
    sql = (
        f"WITH {SUP}, a AS (SELECT *, unnest(range({tx})) AS i FROM fp), b AS (SELECT *, unnest(range({ty})) AS j FROM a), "
        f"c AS (SELECT *, CASE WHEN i < {cx} THEN i * {ix} ELSE {ax} END AS xa, CASE WHEN i < {cx} THEN {sx} ELSE {lx} END AS xl, CASE WHEN j < {cy} THEN j * {iy} ELSE {ay} END AS ya, CASE WHEN j < {cy} THEN {sy} ELSE {ly} END AS yl FROM b) "
        f"SELECT k, CAST(j AS INTEGER) AS row, CAST(i AS INTEGER) AS col, tlx + ({left}) * dx AS tlx, dx, 0.0::DOUBLE AS rx, tly + ({top}) * dy AS tly, 0.0::DOUBLE AS ry, dy, CAST(xl AS INTEGER) AS rsx, CAST(yl AS INTEGER) AS rsy FROM c"
    )

    @query(sql, name)
    def run(spark, sf_dir):
        t = tiling.tile(footprints(spark, sf_dir), (sx, sy), (ox, oy), effect, locus)
        return t.select("k", "row", "col", *flat(F.col("tile")))


for _effect in ("extend", "exclude", "overlap", "shrink"):
    for _locus in ("br", "tl", "tr", "bl"):
        _tile(f"tile_{_effect}_{_locus}", _effect, _locus, 7, 5, 2, 0)


@query(f"WITH {SUP}, a AS (SELECT *, CAST(ceil((rsx + 1 * 2) / 3.0) AS INTEGER) AS w, CAST(ceil(rsy / 2.0) AS INTEGER) AS h FROM fp) SELECT k, CAST(j AS INTEGER) AS row, CAST(i AS INTEGER) AS col, tlx + i * (w - 1) * dx AS tlx, tly + j * h * dy AS tly, w AS rsx, h AS rsy FROM (SELECT *, unnest(range(3)) AS i FROM (SELECT *, unnest(range(2)) AS j FROM a))")
def tile_count(spark, sf_dir):
    t = tiling.tile_count(footprints(spark, sf_dir), (3, 2), (1, 0), "extend")
    g = F.col("tile")
    return t.select("k", "row", "col", g["tlx"].alias("tlx"), g["tly"].alias("tly"), g["rsx"].alias("rsx"), g["rsy"].alias("rsy"))


@query(f"WITH {SUP} SELECT CAST(x AS INTEGER) AS px, CAST(y AS INTEGER) AS py, CAST(count(*) * 4 AS BIGINT) AS n FROM (SELECT *, unnest(range(rsx)) AS x FROM (SELECT *, unnest(range(rsy)) AS y FROM fp)) GROUP BY 1, 2")
def tile_occurrence(spark, sf_dir):
    t = tiling.tile_occurrence(footprints(spark, sf_dir), (4, 6), (2, 2))
    return tiling.pixel_occurrence(t)


@query(f"WITH {SUP} SELECT CAST(x AS INTEGER) AS px, CAST(y AS INTEGER) AS py, count(*) AS n FROM (SELECT *, unnest(range(rsx)) AS x FROM (SELECT *, unnest(range(rsy)) AS y FROM fp)) GROUP BY 1, 2")
def pixel_occurrence(spark, sf_dir):
    return tiling.pixel_occurrence(tiling.tile(footprints(spark, sf_dir), (6, 4), (0, 0), "shrink"))


@query("SELECT CAST(0 AS BIGINT) AS uncovered, CAST(0 AS BIGINT) AS overlapping, CAST(0 AS BIGINT) AS outside")
def tiling_validator(spark, sf_dir):
    all_ = footprints(spark, sf_dir)
    return tiling.is_tiling(tiling.tile(all_, (6, 4), (0, 0), "shrink"), by="k", whole=all_)


@query(f"WITH {SUP}, a AS (SELECT k, rsx, rsy, unnest(range(CAST(ceil(rsx / 6.0) AS BIGINT))) AS i FROM fp), b AS (SELECT *, unnest(range(CAST(ceil(rsy / 4.0) AS BIGINT))) AS j FROM a) SELECT k, CAST(j AS INTEGER) AS row, CAST(i AS INTEGER) AS col, CAST(i * 6 AS INTEGER) AS x, CAST(j * 4 AS INTEGER) AS y, CAST(least(6, rsx - i * 6) AS INTEGER) AS w, CAST(least(4, rsy - j * 4) AS INTEGER) AS h FROM b")
def tile_udtf(spark, sf_dir):
    f = footprints(spark, sf_dir).select("k", fp()["rsx"].alias("rsx"), fp()["rsy"].alias("rsy"))
    name = tiling.register(spark)
    return spark.sql(f"SELECT f.k, t.* FROM {{f}} f, LATERAL {name}(f.rsx, f.rsy, 6, 4, 0, 0, 'shrink') t", f=f)


# --- reads and writes ----------------------------------------------------------------------------


@query(f"WITH {MOSAIC} SELECT px, py, value FROM mosaic")
def mosaic_pixels(spark, sf_dir):
    return mosaic(spark, sf_dir)


@query("SELECT CAST(vec_id % 16 AS INTEGER) AS tx, CAST(vec_id // 16 AS INTEGER) AS ty, CAST(embedding AS DOUBLE[]) AS data FROM embeddings")
def tiles_of_pixels(spark, sf_dir):
    return raster.tiles(mosaic(spark, sf_dir), 8, 8)


@query(f"WITH {MOSAIC} SELECT CAST(px - 20 AS INTEGER) AS px, CAST(py - 30 AS INTEGER) AS py, value FROM mosaic WHERE px >= 20 AND px < 60 AND py >= 30 AND py < 80")
def raster_read_window(spark, sf_dir):
    t = raster.read_tiles(mosaic_tiles(spark, sf_dir, (30, 80)), (8, 8), MOS_FP, MOS_FP.clip(20, 30, 60, 80))
    return t.select("px", "py", "value")


_GRID = "g AS (SELECT CAST(i % {0} AS INTEGER) AS px, CAST(i // {0} AS INTEGER) AS py FROM range({0} * {1}) t(i))"


@query(f"WITH {ORD}, {_GRID.format(80, 80)} SELECT g.px, g.py, CASE WHEN value IS NULL OR value > 300000 THEN -1.0::DOUBLE ELSE value END AS value FROM g LEFT JOIN (SELECT px + 8 AS px, py + 8 AS py, value FROM ord) o ON g.px = o.px AND g.py = o.py")
def raster_read_padded_nodata(spark, sf_dir):
    px = order_pixels(spark, sf_dir)
    px = px.withColumn("value", F.when(F.col("value") > 300000, -9.0).otherwise(F.col("value")))
    src = Footprint.of((0, 64), (64, 64), (64, 64))
    t = raster.tiles_of_bands(px.withColumn("band", F.lit(0)), src, (16, 16), -9.0)
    return raster.read_tiles(t, (16, 16), src, src.dilate(8), src_nodata=-9.0, dst_nodata=-1.0).select("px", "py", "value")


@query(f"WITH {MOSAIC} SELECT unnest([0, 1, 2]) AS channel, px, py, unnest([value * 2, value, value * 2]) AS value FROM mosaic")
def raster_read_channels(spark, sf_dir):
    m = mosaic(spark, sf_dir)
    bands = [F.col("value"), F.col("value") * 2, F.col("value") * 3]
    from ..functions.types import channel_ids

    ids, _ = channel_ids([1, 0, -2], 3)
    return m.select(F.posexplode(F.array(*[bands[i] for i in ids])).alias("channel", "v"), "px", "py").select("channel", "px", "py", F.col("v").alias("value"))


def _resample(name, kind, sql):
    @query(sql, name)
    def run(spark, sf_dir):
        # half a pixel across, a quarter down, on pixels of twice the size
        dst = Footprint.of((10.5, 989.75), (60, 60), (30, 30))
        r = raster.read_tiles(mosaic_tiles(spark, sf_dir, (0, 80)), (8, 8), MOS_FP, dst, dst_nodata=-99.0, interpolation=kind, block=16)
        return r.select("px", "py", F.round("value", 6).alias("value"))


_resample("raster_resample_nearest", "cv_nearest", f"WITH {MOSAIC}, {_GRID.format(30, 30)} SELECT g.px, g.py, round(coalesce(value, -99), 6) AS value FROM g LEFT JOIN mosaic m ON m.px = CAST(round_even(10.5 + 2 * g.px, 0) AS INTEGER) AND m.py = CAST(round_even(10.25 + 2 * g.py, 0) AS INTEGER)")
_LIN = f"WITH {MOSAIC}, {_GRID.format(30, 30)}, n AS (SELECT g.px, g.py, 10 + 2 * g.px + dx AS sx, 10 + 2 * g.py + dy AS sy, 0.5::DOUBLE * (CASE WHEN dy = 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END) AS w FROM g, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) d(dx, dy)) SELECT n.px, n.py, round(CASE WHEN count(value) < 4 THEN -99 ELSE sum(w * value) END, 6) AS value FROM n LEFT JOIN mosaic m ON m.px = n.sx AND m.py = n.sy GROUP BY 1, 2"
_resample("raster_resample_linear", "cv_linear", _LIN)
_resample("raster_resample_area", "cv_area", _LIN)
_KERNEL = f"WITH {MOSAIC}, {_GRID.format(30, 30)}, {{weights}}, n AS (SELECT g.px, g.py, 10 + 2 * g.px + a.d AS sx, 10 + 2 * g.py + b.d AS sy, a.wx * b.wy AS w FROM g, k a, k b) SELECT n.px, n.py, round(CASE WHEN count(value) < {{n}} THEN -99 ELSE sum(w * value) END, 6) AS value FROM n LEFT JOIN mosaic m ON m.px = n.sx AND m.py = n.sy GROUP BY 1, 2"
# weights of the cubic kernel with parameter -0.75 at 0.5 and at 0.25
_CUBIC = "k AS (SELECT * FROM (VALUES (-1, -0.09375::DOUBLE, -0.10546875::DOUBLE), (0, 0.59375, 0.87890625), (1, 0.59375, 0.26171875), (2, -0.09375, -0.03515625)) t(d, wx, wy))"
_LANCZOS = "l AS (SELECT d, 4 * sin(pi() * (0.5::DOUBLE - d)) * sin(pi() * (0.5::DOUBLE - d) / 4) / pow(pi() * (0.5::DOUBLE - d), 2) AS x, 4 * sin(pi() * (0.25::DOUBLE - d)) * sin(pi() * (0.25::DOUBLE - d) / 4) / pow(pi() * (0.25::DOUBLE - d), 2) AS y FROM range(-3, 5) t(d)), k AS (SELECT d, x / sum(x) OVER () AS wx, y / sum(y) OVER () AS wy FROM l)"
_resample("raster_resample_cubic", "cv_cubic", _KERNEL.format(weights=_CUBIC, n=16))
_resample("raster_resample_lanczos", "cv_lanczos4", _KERNEL.format(weights=_LANCZOS, n=64))


@query(f"WITH {ORD} SELECT px, py, 7.0::DOUBLE AS value FROM ord")
def raster_fill(spark, sf_dir):
    return raster.fill(order_pixels(spark, sf_dir), 7)


@query(f"WITH {ORD} SELECT px, py, CASE WHEN px >= 10 AND px < 20 AND py >= 5 AND py < 25 THEN (px - 10) * 100 + (py - 5) ELSE value END::DOUBLE AS value FROM ord")
def raster_set_window(spark, sf_dir):
    from ..plans.grid import grid

    new = grid(spark, 10, 20).withColumn("value", (F.col("px") * 100 + F.col("py")).cast("double"))
    return raster.write(order_pixels(spark, sf_dir), new, at=(10, 5))


@query(f"WITH {ORD} SELECT px, py, CASE WHEN (px + py) % 3 = 0 THEN 0.0::DOUBLE ELSE value END AS value FROM ord")
def raster_set_masked(spark, sf_dir):
    px = order_pixels(spark, sf_dir)
    return raster.write(px, raster.fill(px, 0), mask=px.where((F.col("px") + F.col("py")) % 3 == 0))


@query(f"WITH {ORD} SELECT px, py, CASE WHEN px < 32 THEN -1.0::DOUBLE ELSE value * 0.5 + 10 END AS value FROM ord")
def raster_scaled(spark, sf_dir):
    px = order_pixels(spark, sf_dir).withColumn("value", F.when(F.col("px") < 32, -1.0).otherwise(F.col("value")))
    return raster.scaled(px, 0.5, 10.0, -1.0)


@query(f"WITH {ORD}, m AS (SELECT px, py FROM ord WHERE value > 200000), r AS (SELECT px, py, px - row_number() OVER (PARTITION BY py ORDER BY px) AS g FROM m), u AS (SELECT py, g, min(px) AS x0, max(px) + 1 AS x1 FROM r GROUP BY 1, 2), v AS (SELECT *, py - row_number() OVER (PARTITION BY x0, x1 ORDER BY py) AS h FROM u) SELECT x0, CAST(x1 AS INTEGER) AS x1, min(py) AS y0, CAST(max(py) + 1 AS INTEGER) AS y1 FROM v GROUP BY x0, x1, h")
def mask_to_rectangles(spark, sf_dir):
    return raster.mask_rectangles(order_pixels(spark, sf_dir).where("value > 200000"))


# --- focal ---------------------------------------------------------------------------------------

_NB = "nb AS (SELECT px, py, value, lag(px) OVER r = px - 1 AND lead(px) OVER r = px + 1 AS ok, lag(value) OVER r AS w, lead(value) OVER r AS e FROM mosaic WINDOW r AS (PARTITION BY py ORDER BY px)), f AS (SELECT *, lag(py) OVER c = py - 1 AND lead(py) OVER c = py + 1 AS okc, lag(ok) OVER c AS okn, lead(ok) OVER c AS oks, lag(w) OVER c AS nw, lag(value) OVER c AS n, lag(e) OVER c AS ne, lead(w) OVER c AS sw, lead(value) OVER c AS s, lead(e) OVER c AS se FROM nb WINDOW c AS (PARTITION BY px ORDER BY py))"


def _slopes(name, horn):
    west = "w" if horn else "s"
    sql = f"WITH {MOSAIC}, {_NB} SELECT px, py, CASE WHEN coalesce(ok AND okc AND okn AND oks, false) THEN round(degrees(atan(sqrt(pow(((ne + 2 * e + se) - (nw + 2 * {west} + sw)) / 8, 2) + pow(((sw + 2 * s + se) - (nw + 2 * n + ne)) / -8, 2)))), 6) ELSE 0.0::DOUBLE END AS slope FROM f"

    @query(sql, name)
    def run(spark, sf_dir):
        t = raster.pixels(focal.slope_tiles(mosaic_tiles(spark, sf_dir), (8, 8), 1.0, -1.0, horn), 8, 8)
        return t.select(F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), F.round("value", 6).alias("slope"))


_slopes("slopes", False)
_slopes("slopes_horn", True)


@query(f"WITH {ORD}, a AS (SELECT o.px, o.py, n.value FROM ord o JOIN ord n ON abs(o.px - n.px) + abs(o.py - n.py) <= 1) SELECT px, py, max(value) - min(value) AS span FROM a GROUP BY 1, 2")
def focal_range(spark, sf_dir):
    return focal.focal_range(order_pixels(spark, sf_dir))


# --- pixels and geometries -----------------------------------------------------------------------

BURN_FP = Footprint.of((0, 128), (128, 128), (128, 128))
#: polygons that one task burns; a task groups all their pixels, some 65 a polygon, so its memory follows this and not the table
BURN_ROWS = 2048
_BURN = f"{PART}, burn AS (SELECT b.fid, x AS px, y AS py FROM box b, range(128) u(x), range(128) v(y) WHERE x + 0.5 >= minx AND x + 0.5 < maxx AND 127.5 - y > miny AND 127.5 - y <= maxy)"


@query(f"WITH {_BURN} SELECT fid, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py FROM burn")
def burn_polygons(spark, sf_dir):
    return rasterize.burn_polygons(part_boxes(spark, sf_dir, BURN_ROWS).select("fid", "geom"), BURN_FP, "fid").select("fid", "px", "py")


@query(f"WITH {_BURN} SELECT CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, max(fid) AS label FROM burn GROUP BY px, py")
def burn_polygons_label(spark, sf_dir):
    return rasterize.labelled(rasterize.burn_polygons(part_boxes(spark, sf_dir).select("fid", "geom"), BURN_FP, "fid"), "fid")


@query(f"WITH {CUS}, l AS (SELECT k, x, y, 3 + k % 5 AS n FROM cus) SELECT DISTINCT k, CAST(floor(x) + i AS INTEGER) AS px, CAST(floor(128 - y) + i * (k % 2) AS INTEGER) AS py FROM (SELECT *, unnest(range(n + 1)) AS i FROM l) WHERE floor(x) + i < 128 AND floor(128 - y) + i * (k % 2) < 128")
def burn_lines(spark, sf_dir):
    from ..functions import geometry as gm

    n, k = 3 + F.col("k") % 5, F.col("k")
    pts = customer_points(spark, sf_dir)
    ln = pts.select("k", gm.geom("LineString", F.array(gm.point(F.col("x"), F.col("y")), gm.point(F.col("x") + n, F.col("y") - n * (k % 2)))).alias("geom"))
    return rasterize.burn_lines(ln, BURN_FP, "k").select("k", "px", "py")


@query(f"WITH RECURSIVE {ORD}, m AS (SELECT px, py, py * 64 + px AS id FROM ord WHERE value > 430000), d AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON b.px = a.px AND b.py = a.py + 1 UNION ALL SELECT a.id, b.id FROM m a JOIN m b ON b.py = a.py AND b.px = a.px + 1), e AS (SELECT a, b FROM d UNION ALL SELECT b, a FROM d), r AS (SELECT id, id AS seen FROM m UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen), c AS (SELECT id, min(seen) AS root FROM r GROUP BY id) SELECT CAST(min(px) AS INTEGER) AS x0, CAST(max(px) AS INTEGER) AS x1, CAST(min(py) AS INTEGER) AS y0, CAST(max(py) AS INTEGER) AS y1, count(*) AS n FROM c JOIN m USING (id) GROUP BY root")
def polygonize_components(spark, sf_dir):
    c = rasterize.mask_components(order_pixels(spark, sf_dir).where("value > 430000"))
    return c.groupBy("component").agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"), F.count(F.lit(1)).alias("n")).drop("component")


@query(f"WITH {ORD}, m AS (SELECT px, py FROM ord WHERE value > 200000), s AS (SELECT px, py, side, px + dx AS nx, py + dy AS ny FROM m, (VALUES ('n', 0, -1), ('e', 1, 0), ('s', 0, 1), ('w', -1, 0)) d(side, dx, dy)) SELECT s.px, s.py, side FROM s LEFT JOIN m ON m.px = nx AND m.py = ny WHERE m.px IS NULL")
def polygonize_boundary_edges(spark, sf_dir):
    return rasterize.boundary_edges(order_pixels(spark, sf_dir).where("value > 200000"))


def _rings_sql(least: int, levels: int = 13) -> str:
    """Rings from the sides of pixels, by doubling how far each side sees along its ring."""
    d = "d0 AS MATERIALIZED (SELECT c.node, c.nxt, CASE WHEN p.way <> c.way THEN c.node ELSE 9000000000000000000 END AS m FROM n c JOIN n p ON p.nxt = c.node)"
    for k in range(levels):
        d += f", d{k + 1} AS MATERIALIZED (SELECT a.node, b.nxt, least(a.m, b.m) AS m FROM d{k} a JOIN d{k} b ON b.node = a.nxt)"
    return (
        f"WITH {ORD}, mask AS MATERIALIZED (SELECT px, py FROM ord WHERE value > {least}), w(way, sx, sy, ex, ey, ox, oy) AS (VALUES (0, 0, 0, 1, 0, 0, -1), (1, 1, 0, 1, 1, 1, 0), (2, 1, 1, 0, 1, 0, 1), (3, 0, 1, 0, 0, -1, 0)), "
        "u AS MATERIALIZED (SELECT px, py, way, px + sx AS x, py + sy AS y, px + ex AS x2, py + ey AS y2, CAST(py + sy AS BIGINT) * 8589934592 + (px + sx) * 4 + way AS node FROM mask, w WHERE (px + ox, py + oy) NOT IN (SELECT (px, py) FROM mask)), "
        "n AS MATERIALIZED (SELECT u.*, b.node AS nxt FROM u JOIN u b ON b.x = u.x2 AND b.y = u.y2 QUALIFY row_number() OVER (PARTITION BY u.node ORDER BY CASE WHEN b.way = (u.way + 1) % 4 THEN 0 ELSE 1 END) = 1), "
        f"{d}, r AS (SELECT n.*, d{levels}.m, d0.m < 9000000000000000000 AS corner FROM n JOIN d{levels} USING (node) JOIN d0 USING (node)) "
        "SELECT CAST(min(py * 1000 + px) // 1000 AS INTEGER) AS py, CAST(min(py * 1000 + px) % 1000 AS INTEGER) AS px, CAST(sum(x * y2 - x2 * y) AS DOUBLE) / 2 AS area, count(*) AS length, count(*) FILTER (WHERE corner) AS corners FROM r GROUP BY m"
    )


@query(_rings_sql(200000))
def find_polygon_rings(spark, sf_dir):
    """Of each ring of a mask: its first pixel, area (holes negative), length and corners."""
    m = rasterize.ring_measures(rasterize.polygon_rings(order_pixels(spark, sf_dir).where("value > 200000")))
    return m.select("py", "px", "area", "length", "corners")


def _thin_sql(least: int, rounds: int = 20) -> str:
    """Guo and Hall's rule over and over, then the segments between the pixels that are left."""
    x = {k: f"(s & {1 << (k - 1)} > 0)" for k in range(1, 9)}
    x[9] = x[1]
    one = lambda c: f"CAST({c} AS INTEGER)"
    crossings = " + ".join(one(f"NOT {x[2 * i - 1]} AND ({x[2 * i]} OR {x[2 * i + 1]})") for i in range(1, 5))
    pairs = f"least({' + '.join(one(f'{x[2 * k - 1]} OR {x[2 * k]}') for k in range(1, 5))}, {' + '.join(one(f'{x[2 * k]} OR {x[2 * k + 1]}') for k in range(1, 5))})"
    last = [f"(({x[2]} OR {x[3]} OR NOT {x[8]}) AND {x[1]})", f"(({x[6]} OR {x[7]} OR NOT {x[4]}) AND {x[5]})"]
    steps = f"t0 AS MATERIALIZED (SELECT px, py FROM ord WHERE value > {least})"
    for k in range(2 * rounds):
        steps += (
            f", s{k} AS (SELECT t.px, t.py, CAST(coalesce(sum(b), 0) AS INTEGER) AS s FROM t{k} t LEFT JOIN (SELECT px - dx AS px, py - dy AS py, b FROM t{k}, off) o ON o.px = t.px AND o.py = t.py GROUP BY 1, 2)"
            f", t{k + 1} AS MATERIALIZED (SELECT px, py FROM s{k} WHERE NOT (({crossings}) = 1 AND {pairs} BETWEEN 2 AND 3 AND NOT {last[k % 2]}))"
        )
    return (
        f"WITH {ORD}, off(dx, dy, b) AS (VALUES (1, 0, 1), (1, -1, 2), (0, -1, 4), (-1, -1, 8), (-1, 0, 16), (-1, 1, 32), (0, 1, 64), (1, 1, 128)), {steps}, m AS MATERIALIZED (SELECT * FROM t{2 * rounds}), "
        "s AS (SELECT a.px AS ax, a.py AS ay, b.px AS bx, b.py AS by_ FROM m a, (VALUES (1, 0), (0, 1), (1, 1), (-1, 1)) d(dx, dy), m b WHERE b.px = a.px + dx AND b.py = a.py + dy) "
        'SELECT ax, ay, bx, by_ AS "by" FROM s WHERE ax = bx OR ay = by_ OR ((ax, by_) NOT IN (SELECT (px, py) FROM m) AND (bx, ay) NOT IN (SELECT (px, py) FROM m))'
    )


@query()
def find_polygons(spark, sf_dir):
    return rasterize.find_polygons(order_pixels(spark, sf_dir).where("value > 200000"), Footprint.of((0, 64), (64, 64), (64, 64)))


@query(f"WITH {ORD}, m AS (SELECT px, py FROM ord WHERE value > 300000), s AS (SELECT a.px AS ax, a.py AS ay, b.px AS bx, b.py AS by_ FROM m a, (VALUES (1, 0), (0, 1), (1, 1), (-1, 1)) d(dx, dy), m b WHERE b.px = a.px + dx AND b.py = a.py + dy) SELECT ax, ay, bx, by_ FROM s WHERE ax = bx OR ay = by_ OR ((ax, by_) NOT IN (SELECT (px, py) FROM m) AND (bx, ay) NOT IN (SELECT (px, py) FROM m))")
def find_lines_segments(spark, sf_dir):
    return rasterize.line_segments(order_pixels(spark, sf_dir).where("value > 300000")).withColumnRenamed("by", "by_")


@query()
def find_lines_merged(spark, sf_dir):
    return rasterize.find_lines(order_pixels(spark, sf_dir).where("value > 250000"), Footprint.of((0, 64), (64, 64), (64, 64)))


@query(f"WITH {CUS}, l AS (SELECT k, x, y, 3 + k % 5 AS n FROM cus) SELECT DISTINCT k, CAST(c AS INTEGER) AS px, CAST(r AS INTEGER) AS py FROM (SELECT k, x, y, n, unnest(range(CAST(floor(x) AS BIGINT), CAST(floor(x + n) AS BIGINT) + 1)) AS c, floor(128 - y) AS r FROM l) WHERE c < 128 AND r >= 0 AND r < 128")
def burn_lines_all_touched(spark, sf_dir):
    from ..functions import geometry as gm

    n = 3 + F.col("k") % 5
    ln = customer_points(spark, sf_dir).select("k", gm.geom("LineString", F.array(gm.point(F.col("x"), F.col("y")), gm.point(F.col("x") + n, F.col("y")))).alias("geom"))
    return rasterize.burn_lines(ln, BURN_FP, "k", all_touched=True).select("k", "px", "py")


@query(f"WITH {PART} SELECT fid, CAST(x AS INTEGER) AS px, CAST(y AS INTEGER) AS py FROM box, range(128) u(x), range(128) v(y) WHERE x BETWEEN floor(minx) AND floor(maxx) AND y BETWEEN floor(128 - maxy) AND floor(128 - miny) AND NOT (x = maxx AND y = 128 - miny)")
def burn_polygons_all_touched(spark, sf_dir):
    """A side on the line between two pixels touches the one on the right of it, or below; the lower right corner alone touches none."""
    return rasterize.burn_polygons(part_boxes(spark, sf_dir, BURN_ROWS).select("fid", "geom"), BURN_FP, "fid", all_touched=True).select("fid", "px", "py")


@query(_thin_sql(250000))
def find_lines_thin(spark, sf_dir):
    return rasterize.line_segments(rasterize.thin(order_pixels(spark, sf_dir).where("value > 250000")))


@query(f"WITH {MOSAIC}, {PART}, z AS (SELECT b.fid, value FROM box b JOIN mosaic m ON m.px + 0.5 >= minx AND m.px + 0.5 < maxx AND 127.5 - m.py > miny AND 127.5 - m.py <= maxy WHERE m.py < 128) SELECT fid, count(*) AS n, round(avg(value), 6) AS mean FROM z GROUP BY fid")
def zonal_stats(spark, sf_dir):
    burnt = rasterize.burn_polygons(part_boxes(spark, sf_dir).select("fid", "geom"), BURN_FP, "fid")
    return spatial_join.zonal(mosaic(spark, sf_dir), burnt, "fid").select("fid", "n", F.round("mean", 6).alias("mean"))


# --- tiles and recipes ---------------------------------------------------------------------------

_WIN = f"WITH {SUP}, w AS (SELECT k, CAST(k % 50 AS INTEGER) AS x0, CAST(k % 50 + rsx AS INTEGER) AS x1, CAST(k % 30 AS INTEGER) AS y0, CAST(k % 30 + rsy AS INTEGER) AS y1 FROM fp), t AS (SELECT k, tx, unnest(range(y0 // 8, (y1 - 1) // 8 + 1)) AS ty FROM (SELECT *, unnest(range(x0 // 8, (x1 - 1) // 8 + 1)) AS tx FROM w)) "


def _windows(spark, sf_dir):
    k = F.col("k")
    w = footprints(spark, sf_dir).select("k", (k % 50).cast("int").alias("x0"), (k % 50 + fp()["rsx"]).cast("int").alias("x1"), (k % 30).cast("int").alias("y0"), (k % 30 + fp()["rsy"]).cast("int").alias("y1"))
    return spatial_join.tiles_of_windows(w, 8, 8)


@query(_WIN + "SELECT k, tx, ty FROM t")
def tile_join_overlap(spark, sf_dir):
    return _windows(spark, sf_dir).select("k", "tx", "ty")


@query(_WIN + "SELECT DISTINCT tx, ty FROM t WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id % 16 = tx AND vec_id // 16 = ty AND vec_id % 3 = 0)")
def missing_tiles_antijoin(spark, sf_dir):
    ready = table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select((F.col("vec_id") % 16).alias("tx"), F.floor(F.col("vec_id") / 16).alias("ty"))
    return spatial_join.missing_tiles(_windows(spark, sf_dir), ready, "tx", "ty")


@query(f"WITH {MOSAIC} SELECT px // 32 AS tx, py // 32 AS ty, max(value) AS value, count(*) AS n FROM mosaic GROUP BY 1, 2")
def merge_tiles_max(spark, sf_dir):
    return recipe.merge_tiles(mosaic(spark, sf_dir), (32, 32), lambda v: {"value": F.max(v), "n": F.count(v)})


@query("SELECT vec_id % 16 AS tx, vec_id // 16 AS ty, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))), 6) AS density FROM embeddings ORDER BY density DESC, vec_id LIMIT 10")
def topk_dense_tiles(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    d = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))), 6)
    v = F.col("vec_id")
    return e.select((v % 16).alias("tx"), F.floor(v / 16).alias("ty"), d.alias("density"), "vec_id").orderBy(F.desc("density"), "vec_id").limit(10).drop("vec_id")


@query(f"WITH {SUP} SELECT k, CAST(rsx AS BIGINT) * rsy AS rarea FROM fp ORDER BY rarea DESC, k LIMIT 5")
def topk_area(spark, sf_dir):
    return footprints(spark, sf_dir).select("k", fpx.rarea(fp()).alias("rarea")).orderBy(F.desc("rarea"), "k").limit(5)


@query(_WIN + ", f AS (SELECT tx, ty, min(k) AS prod FROM t GROUP BY 1, 2) SELECT tx, ty, prod, row_number() OVER (ORDER BY prod, -ty, tx) - 1 AS rank FROM f")
def compute_priority_order(spark, sf_dir):
    return recipe.computation_order(_windows(spark, sf_dir))


@query(f"WITH {MOSAIC}, {_NB} SELECT px, py, CASE WHEN coalesce(ok AND okc AND okn AND oks, false) THEN round(degrees(atan(sqrt(pow(((ne + 2 * e + se) - (nw + 2 * s + sw)) / 8, 2) + pow(((sw + 2 * s + se) - (nw + 2 * n + ne)) / -8, 2)))), 5) ELSE 0.0::DOUBLE END AS value FROM f")
def recipe_slopes_halo(spark, sf_dir):
    # the raster ends with the last row of tiles, which is not full
    last = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    rows = (last // 16 + 1) * 8
    fp_ = Footprint.of((0, rows), (128, rows), (128, rows))
    z = recipe.Primitive(mosaic_tiles(spark, sf_dir), fp_, (8, 8))
    r = recipe.Recipe(fp_, recipe.slope_tile, {"z": z}, convert={"z": lambda f: f.dilate(1)}, tile=(32, 32), nodata=math.nan)
    px = r.pixels(spark).where((F.floor(F.col("py") / 8) * 16 + F.floor(F.col("px") / 8)) <= last)
    return px.select("px", "py", F.round("value", 5).alias("value"))


@query(f"WITH {ORD}, {_GRID.format(64, 64)} SELECT g.px, g.py, coalesce(value, 0) * 2 + 1 AS value FROM g LEFT JOIN ord o ON o.px = g.px AND o.py = g.py")
def recipe_derived(spark, sf_dir):
    f = Footprint.of((0, 64), (64, 64), (64, 64))
    r = recipe.Recipe(f, lambda a, b, arrays, _: arrays["v"] * 2 + 1, {"v": order_pixels(spark, sf_dir)}, tile=(16, 16))
    return r.pixels(spark)


@query(f"WITH {ORD}, {_GRID.format(64, 64)} SELECT g.px, g.py, coalesce(value, 0) + 1 AS value FROM g LEFT JOIN ord o ON o.px = g.px AND o.py = g.py")
def recipe_cached_reuse(spark, sf_dir):
    import uuid

    from ..plans.lineage import shared_dir

    f = Footprint.of((0, 64), (64, 64), (64, 64))
    r = recipe.Recipe(f, lambda a, b, arrays, _: arrays["v"] + 1, {"v": order_pixels(spark, sf_dir)}, tile=(16, 16), cache=f"{shared_dir(spark)}/gridloom/recipe-{uuid.uuid4().hex}")
    some = r.tiles(spark).where("tx < 2")
    r.pixels(spark, some).count()
    return r.pixels(spark)


# --- files and the catalogue ---------------------------------------------------------------------

ORD_FP = Footprint.of((0, 64), (64, 64), (64, 64))


def order_tiles(spark, sf_dir, bands: int = 1):
    px = order_pixels(spark, sf_dir)
    px = px.withColumn("band", F.explode(F.array(*[F.lit(b) for b in range(bands)]))).withColumn("value", F.col("value") * (F.col("band") + 1))
    return raster.tiles_of_bands(px, ORD_FP, (16, 16), -1.0, bands)


@query(f"WITH {ORD}, {_GRID.format(64, 64)} SELECT CAST(b AS INTEGER) AS band, g.px, g.py, coalesce(value * (b + 1), -1) AS value FROM g CROSS JOIN range(2) t(b) LEFT JOIN ord o ON o.px = g.px AND o.py = g.py")
def geotiff_round_trip(spark, sf_dir):
    from ..functions.types import channels_schema
    from ..sources import geotiff
    from .base import shared

    path = shared(spark, "orders.tif")
    geotiff.write(order_tiles(spark, sf_dir, 2), path, ORD_FP, "float64", channels_schema(2, {"nodata": -1}), block=16)
    return raster.pixels_of_bands(geotiff.read(spark, path), ORD_FP, (16, 16))


@query(f"WITH {ORD}, g AS (SELECT CAST(i % 12 AS INTEGER) AS px, CAST(i // 12 AS INTEGER) AS py FROM range(12 * 20) t(i)) SELECT g.px, g.py, coalesce(value * 2, -5) AS value FROM g LEFT JOIN ord o ON o.px = g.px + 10 AND o.py = g.py + 25")
def catalogue_raster_window(spark, sf_dir):
    """A window of a file, its second channel, with another value for pixels without data."""
    from ..catalogue import Dataset
    from ..functions.types import channels_schema
    from ..sources import geotiff
    from .base import shared

    path = shared(spark, "orders.tif")
    geotiff.write(order_tiles(spark, sf_dir, 2), path, ORD_FP, "float64", channels_schema(2, {"nodata": -1}), block=16)
    ds = Dataset(spark)
    return ds.open_raster("orders", path).read(ORD_FP.clip(10, 25, 22, 45), -1, -5).select("px", "py", "value")


@query(f"WITH {ORD}, {_GRID.format(64, 64)} SELECT CAST(b AS INTEGER) AS band, g.px, g.py, coalesce(CASE WHEN b = 1 THEN value END, 7)::DOUBLE AS value FROM g CROSS JOIN range(2) t(b) LEFT JOIN ord o ON o.px = g.px AND o.py = g.py")
def catalogue_set_data(spark, sf_dir):
    """A new file of two channels, filled; then pixels of a table are written to the second one."""
    from ..catalogue import Dataset
    from .base import shared

    ds = Dataset(spark)
    r = ds.create_raster("r", shared(spark, "new.tif"), ORD_FP, "float64", 2)
    r.fill(7)
    r.set_pixels(order_pixels(spark, sf_dir).withColumn("band", F.lit(1)))
    return r.read().select("band", "px", "py", "value")


_SET = "cus AS (SELECT CAST(c_custkey * 3 % 64 AS INTEGER) AS px, CAST(c_custkey * 5 % 48 AS INTEGER) AS py, max(c_acctbal) AS bal FROM customer GROUP BY 1, 2)"


@query(
    f"WITH {ORD}, {_SET}, {_GRID.format(64, 64)}, v AS (SELECT g.px, g.py, coalesce(value, -1) AS old, coalesce(bal, value, -1) AS new FROM g LEFT JOIN ord ON ord.px = g.px AND ord.py = g.py LEFT JOIN cus ON cus.px = g.px AND cus.py = g.py) "
    "SELECT CAST(k AS INTEGER) AS version, px, py, CASE WHEN k = 1 THEN old ELSE new END AS value FROM v CROSS JOIN (SELECT unnest([1, 2]) AS k)"
)
def versioned_tiles(spark, sf_dir):
    """A raster that is written to in place: the orders' pixels, then the customers' laid over them, read as it was and as it is."""
    from ..catalogue import Dataset
    from .base import shared

    path = shared(spark, "orders.tiles")
    ds = Dataset(spark)
    r = ds.create_raster("r", path, ORD_FP, "float64", 1, {"nodata": -1}, driver="tiles")
    r.set_pixels(order_pixels(spark, sf_dir).withColumn("band", F.lit(0)))
    k = F.col("c_custkey")
    over = table(spark, sf_dir, "customer").groupBy((k * 3 % 64).alias("px"), (k * 5 % 48).alias("py")).agg(F.max("c_acctbal").alias("value"))
    r.set_pixels(over.withColumn("band", F.lit(0)))
    each = [ds.aopen_raster(path, "tiles", [f"version={v}"]).read().select(F.lit(v).alias("version"), "px", "py", "value") for v in r.store.versions()[1:]]
    return each[0].unionByName(each[1])


_LAST = "rows AS (SELECT (max(vec_id) // 16 + 1) * 8 AS n FROM embeddings)"
_ALL = f"{MOSAIC}, {_LAST}, g AS (SELECT CAST(x AS INTEGER) AS px, CAST(y AS INTEGER) AS py FROM (SELECT unnest(range(n)) AS y FROM rows), range(128) t(x)), m AS (SELECT g.px, g.py, coalesce(value, 0) * 2 AS v FROM g LEFT JOIN mosaic USING (px, py))"


def _mosaic_recipes(spark, sf_dir):
    """The mosaic's footprint, and a recipe that doubles its pixels; those without a tile are 0."""
    last = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    rows = (last // 16 + 1) * 8
    f = Footprint.of((0, rows), (128, rows), (128, rows))
    return f, recipe.Recipe(f, lambda a, b, arrays, _: arrays["m"] * 2, {"m": recipe.Primitive(mosaic_tiles(spark, sf_dir), f, (8, 8))}, tile=(24, 20), computation=(16, 16))


@query(f"WITH {_ALL} SELECT px, py, v + 1 AS value FROM m")
def recipe_of_recipe(spark, sf_dir):
    """A recipe without a cache whose primitive is another recipe, over the whole mosaic; computation tiles lie across cache tiles."""
    from ..catalogue import Dataset, RecipeRaster

    f, base = _mosaic_recipes(spark, sf_dir)
    ds = Dataset(spark)
    first = ds._add("first", RecipeRaster(ds, base, None))
    second = ds.create_raster_recipe("second", f, "float64", 1, compute_array=lambda a, b, arrays, _: arrays["first"] + 1, queue_data_per_primitive={"first": first.queue_data}, computation_tiles=(32, 32))
    return second.read().select("px", "py", "value")


@query(
    f"WITH {_ALL}, b AS (SELECT px, py, v, coalesce(lag(v) OVER r, 0) + coalesce(lead(v) OVER r, 0) AS s FROM m WINDOW r AS (PARTITION BY py ORDER BY px)) "
    "SELECT px, py, round(coalesce(lag(s) OVER c, 0) + coalesce(lead(s) OVER c, 0) + v, 6) AS value FROM b WINDOW c AS (PARTITION BY px ORDER BY py)"
)
def recipe_graph(spark, sf_dir):
    """Three recipes over the whole mosaic, the first one read by both others: sums of left and right neighbours, of these upper and lower ones, and the pixel itself."""
    f, base = _mosaic_recipes(spark, sf_dir)
    wide = lambda fp_: fp_.dilate(1)
    sides = recipe.Recipe(f, lambda a, b, arrays, _: arrays["a"][1:-1, :-2] + arrays["a"][1:-1, 2:], {"a": base.primitive(spark)}, convert={"a": wide}, tile=(16, 16))
    last = recipe.Recipe(f, lambda a, b, arrays, _: arrays["s"][:-2, 1:-1] + arrays["s"][2:, 1:-1] + arrays["a"], {"s": sides.primitive(spark), "a": base.primitive(spark)}, convert={"s": wide}, tile=(32, 32))
    return last.pixels(spark).select("px", "py", F.round("value", 6).alias("value"))
