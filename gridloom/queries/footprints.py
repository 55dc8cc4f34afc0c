"""Footprints: accessors, derivation, predicates, coordinates."""

from pyspark.sql import functions as F

from ..functions import footprint as fpx
from ..operators.spatial_join import footprint_pairs
from ..plans.spread import once
from .base import CUS, SUP, customer_points, flat, footprints, fp, query, table

FLAT = "tlx, dx, 0.0::DOUBLE AS rx, tly, 0.0::DOUBLE AS ry, dy"


@query(f"WITH {SUP} SELECT k, tlx, dx, 0.0::DOUBLE AS rx, tly, 0.0::DOUBLE AS ry, dy, rsx, rsy, rsx * 0.5 AS sizex, rsy * 0.5 AS sizey, rsx * 0.5 * rsy * 0.5 AS area, 2 * (rsx * 0.5 + rsy * 0.5) AS length, least(rsx, rsy) * 0.25 AS semiminor, greatest(rsx, rsy) * 0.25 AS semimajor, 0.5::DOUBLE AS scalex, -0.5::DOUBLE AS scaley, 0.5::DOUBLE AS pxsizex, 0.0::DOUBLE AS angle FROM fp".replace("rsx * 0.5", "rsx * 0.5::DOUBLE").replace("rsy * 0.5", "rsy * 0.5::DOUBLE").replace("0.25", "0.25::DOUBLE"))
def fp_accessors(spark, sf_dir):
    sx, sy = fpx.size(fp())
    lo, hi = fpx.semiaxes(fp())
    cx, cy = fpx.scale(fp())
    return footprints(spark, sf_dir).select("k", *flat(fp()), sx.alias("sizex"), sy.alias("sizey"), fpx.area(fp()).alias("area"), fpx.length(fp()).alias("length"), lo.alias("semiminor"), hi.alias("semimajor"), cx.alias("scalex"), cy.alias("scaley"), fpx.pxsize(fp())[0].alias("pxsizex"), fpx.angle(fp()).alias("angle"))


_CORNERS = {"tl": ("0", "0"), "bl": ("0", "1"), "br": ("1", "1"), "tr": ("1", "0"), "t": ("0.5", "0"), "l": ("0", "0.5"), "b": ("0.5", "1"), "r": ("1", "0.5"), "c": ("0.5", "0.5")}


@query(f"WITH {SUP} SELECT k, " + ", ".join(f"tlx + rsx * {x}::DOUBLE * dx AS {n}_x, tly + rsy * {y}::DOUBLE * dy AS {n}_y" for n, (x, y) in _CORNERS.items()) + " FROM fp")
def fp_corners(spark, sf_dir):
    return footprints(spark, sf_dir).select("k", *[c[i].alias(f"{n}_{'xy'[i]}") for n, c in fpx.corners(fp()).items() for i in (0, 1)])


@query(f"WITH {SUP} SELECT k, minx, miny, maxx, maxy, minx AS e0, maxx AS e1, miny AS e2, maxy AS e3 FROM fp")
def fp_bounds(spark, sf_dir):
    return footprints(spark, sf_dir).select("k", *[c.alias(n) for n, c in zip(("minx", "miny", "maxx", "maxy"), fpx.bounds(fp()))], *[c.alias(f"e{i}") for i, c in enumerate(fpx.extent(fp()))])


_RP = {"rtl": ("0", "0"), "rbl": ("0", "rsy - 1"), "rbr": ("rsx - 1", "rsy - 1"), "rtr": ("rsx - 1", "0"), "rt": ("(rsx - 1) // 2", "0"), "rl": ("0", "(rsy - 1) // 2"), "rb": ("(rsx - 1) // 2", "rsy - 1"), "rr": ("rsx - 1", "(rsy - 1) // 2"), "rc": ("(rsx - 1) // 2", "(rsy - 1) // 2")}


@query(f"WITH {SUP} SELECT k, " + ", ".join(f"CAST({v[i]} AS INTEGER) AS {n}{'xy'[i]}" for n, v in _RP.items() for i in (0, 1)) + ", CAST(least(rsx, rsy) // 2 AS INTEGER) AS rsemiminor, CAST(greatest(rsx, rsy) // 2 AS INTEGER) AS rsemimajor FROM fp")
def fp_raster_indices(spark, sf_dir):
    lo, hi = fpx.rsemiaxes(fp())
    return footprints(spark, sf_dir).select("k", *[v[i].alias(f"{n}{'xy'[i]}") for n, v in fpx.raster_points(fp()).items() for i in (0, 1)], lo.alias("rsemiminor"), hi.alias("rsemimajor"))


@query(f"WITH {SUP} SELECT k, rsx * dx AS lrvec_x, 0.0::DOUBLE AS lrvec_y, 0.0::DOUBLE AS tbvec_x, rsy * dy AS tbvec_y, rsx * dx AS diagvec_x, rsy * dy AS diagvec_y, dx AS pxlrvec_x, 0.0::DOUBLE AS pxlrvec_y, 0.0::DOUBLE AS pxtbvec_x, dy AS pxtbvec_y, dx AS pxvec_x, dy AS pxvec_y FROM fp")
def fp_pixel_vectors(spark, sf_dir):
    return footprints(spark, sf_dir).select("k", *[v[i].alias(f"{n}_{'xy'[i]}") for n, v in fpx.vectors(fp()).items() for i in (0, 1)])


@query(f"WITH {SUP} SELECT k, CAST(rsx AS BIGINT) * rsy AS rarea, CAST(rsx AS BIGINT) * rsy - CAST(greatest(0, rsx - 2) AS BIGINT) * greatest(0, rsy - 2) AS rlength FROM fp")
def fp_rarea_rlength(spark, sf_dir):
    return footprints(spark, sf_dir).select("k", fpx.rarea(fp()).alias("rarea"), fpx.rlength(fp()).alias("rlength"))


@query(f"WITH {SUP}, a AS (SELECT k, CASE WHEN k % 2 = 0 THEN 45 ELSE 90 END AS deg, rsx, rsy FROM fp) SELECT k, CAST(deg AS DOUBLE) AS angle, round(rsx * 0.5::DOUBLE, 6) AS sizex, round(rsy * 0.5::DOUBLE, 6) AS sizey, 0.5::DOUBLE AS scalex, -0.5::DOUBLE AS scaley FROM a")
def fp_rotated_scale_angle(spark, sf_dir):
    t = F.radians(F.when(F.col("k") % 2 == 0, 45.0).otherwise(90.0))
    turned = fpx.make(fp()["tlx"], fp()["dx"] * F.cos(t), -fp()["dy"] * F.sin(t), fp()["tly"], fp()["dx"] * F.sin(t), fp()["dy"] * F.cos(t), fp()["rsx"], fp()["rsy"])
    g = F.col("g")
    r = lambda c: F.round(c, 6)
    s, c = fpx.size(g), fpx.scale(g)
    return footprints(spark, sf_dir).select("k", turned.alias("g")).select("k", r(fpx.angle(g)).alias("angle"), r(s[0]).alias("sizex"), r(s[1]).alias("sizey"), r(c[0]).alias("scalex"), r(c[1]).alias("scaley"))


@query(f"WITH {SUP} SELECT k, CASE WHEN true THEN format('Footprint(tl=({{:.6f}}, {{:.6f}}), scale=({{:.6f}}, {{:.6f}}), rsize=({{}}, {{}}))', tlx, tly, dx, dy, rsx, rsy) END AS text FROM fp")
def fp_text(spark, sf_dir):
    return footprints(spark, sf_dir).select("k", fpx.text(fp()).alias("text"))


@query(f"WITH {SUP} SELECT k, [dx, 0.0::DOUBLE, tlx, 0.0::DOUBLE, dy, tly] AS aff6, [tlx, dx, 0.0::DOUBLE, tly, 0.0::DOUBLE, dy] AS gt FROM fp")
def fp_affine_order(spark, sf_dir):
    return footprints(spark, sf_dir).select("k", fpx.affine(fp()).alias("aff6"), fpx.gt(fp()).alias("gt"))


def _derived(name, sql, make):
    @query(sql, name)
    def run(spark, sf_dir):
        return footprints(spark, sf_dir).select("k", make(fp()).alias("fp")).select("k", *flat(fp()))


_derived("fp_dilate", f"WITH {SUP} SELECT k, tlx - 3 * dx AS tlx, dx, 0.0::DOUBLE AS rx, tly - 1 * dy AS tly, 0.0::DOUBLE AS ry, dy, rsx + 5 AS rsx, rsy + 5 AS rsy FROM fp", lambda f: fpx.dilate(f, 3, 2, 1, 4))
_derived("fp_erode", f"WITH {SUP} SELECT k, tlx + 2 * dx AS tlx, dx, 0.0::DOUBLE AS rx, tly + 1 * dy AS tly, 0.0::DOUBLE AS ry, dy, rsx - 4 AS rsx, rsy - 2 AS rsy FROM fp", lambda f: fpx.erode(f, 2, 1))
_derived("fp_clip", f"WITH {SUP} SELECT k, tlx + 2 * dx AS tlx, dx, 0.0::DOUBLE AS rx, tly + (rsy - 6) * dy AS tly, 0.0::DOUBLE AS ry, dy, CAST(rsx - 5 AS INTEGER) AS rsx, CAST(6 AS INTEGER) AS rsy FROM fp", lambda f: fpx.clip(f, 2, -6, -3, None))
_derived("fp_of_extent", f"WITH {SUP} SELECT k, tlx, (rsx * 0.5::DOUBLE) / (rsx * 2) AS dx, 0.0::DOUBLE AS rx, tly, 0.0::DOUBLE AS ry, -(rsy * 0.5::DOUBLE) / rsy AS dy, CAST(rsx * 2 AS INTEGER) AS rsx, rsy FROM fp", lambda f: fpx.of_extent(*fpx.extent(f), 0.25, 0.5))
_derived("fp_move_translate", f"WITH {SUP} SELECT k, tlx + 10 AS tlx, dx, 0.0::DOUBLE AS rx, tly - 20 AS tly, 0.0::DOUBLE AS ry, dy, rsx, rsy FROM fp", lambda f: fpx.move(f, (f["tlx"] + 10, f["tly"] - 20)))
_derived("fp_move_scale", f"WITH {SUP} SELECT k, tlx, 2 * dx AS dx, 0.0::DOUBLE AS rx, tly, 0.0::DOUBLE AS ry, 4 * dy AS dy, rsx, rsy FROM fp", lambda f: fpx.move(f, (f["tlx"], f["tly"]), (f["tlx"] + f["rsx"] * f["dx"] * 2, f["tly"]), (f["tlx"] + f["rsx"] * f["dx"] * 2, f["tly"] + f["rsy"] * f["dy"] * 4)))
_derived("fp_move_rotate", f"WITH {SUP} SELECT k, tlx, 0.0::DOUBLE AS dx, 0.5::DOUBLE AS rx, tly, 0.5::DOUBLE AS ry, 0.0::DOUBLE AS dy, rsx, rsy FROM fp", lambda f: fpx.move(f, (f["tlx"], f["tly"]), (f["tlx"], f["tly"] + f["rsx"] * f["dx"])))
_C = "WITH {0} SELECT k, {1} AS tlx, {2} AS dx, 0.0::DOUBLE AS rx, {3} AS tly, 0.0::DOUBLE AS ry, {4} AS dy, CAST({5} AS INTEGER) AS rsx, CAST({6} AS INTEGER) AS rsy FROM fp"
# kernel (y 3, x 5), stride (2, 2), padding (1, 2), dilation (2, 1): reach 5 in both directions
_derived("fp_conv2d", _C.format(SUP, "tlx + dx * (-2 + 2)", "dx * 2", "tly + dy * (-1 + 2)", "dy * 2", "1 + (rsx + 4 - 5) // 2", "1 + (rsy + 2 - 5) // 2"), lambda f: fpx.conv2d(f, (3, 5), 2, (1, 2), (2, 1)))
_derived("fp_conv2d_backward", _C.format(SUP, "tlx + dx * (2 - 2) / 2", "dx / 2", "tly + dy * ((1 - 2) / 2::DOUBLE)", "dy / 2", "(rsx - 1) * 2 - 4 + 5", "(rsy - 1) * 2 - 2 + 5"), lambda f: fpx.conv2d(f, (3, 5), 2, (1, 2), (2, 1), backward=True))
_derived("fp_convtranspose2d", _C.format(SUP, "tlx + dx * ((-2 + 2) / 2::DOUBLE)", "dx / 2", "tly + dy * ((-3 + 2) / 2::DOUBLE)", "dy / 2", "rsx + (rsx - 1) + 4 - 4 + 1", "rsy + (rsy - 1) + 6 - 4 + 1"), lambda f: fpx.convtranspose2d(f, (3, 5), 2, (1, 2), (2, 1), 1))
_derived("fp_convtranspose2d_backward", _C.format(SUP, "tlx + dx * (2 - 2)", "dx * 2", "tly + dy * (3 - 2)", "dy * 2", "(rsx + 4 - 1 - 4 + 1) // 2", "(rsy + 4 - 1 - 6 + 1) // 2"), lambda f: fpx.convtranspose2d(f, (3, 5), 2, (1, 2), (2, 1), 1, backward=True))

_PAIRS = f"WITH {SUP}, pairs AS (SELECT a.k AS k1, b.k AS k2, a.tlx, a.tly, a.dx, a.dy, greatest(a.minx, b.minx) AS minx, least(a.maxx, b.maxx) AS maxx, greatest(a.miny, b.miny) AS miny, least(a.maxy, b.maxy) AS maxy FROM fp a, fp b WHERE a.k < b.k AND a.minx < b.maxx AND b.minx < a.maxx AND a.miny < b.maxy AND b.miny < a.maxy) "


@query(_PAIRS + "SELECT k1, k2 FROM pairs")
def fp_share_area(spark, sf_dir):
    return footprint_pairs(footprints(spark, sf_dir), "k").select("k1", "k2")


@query(_PAIRS + ", i AS (SELECT k1, k2, tlx + floor((minx - tlx) / dx) * dx AS x, tly + floor((maxy - tly) / dy) * dy AS y, maxx, miny, dx, dy FROM pairs) SELECT k1, k2, x AS tlx, dx, 0.0::DOUBLE AS rx, y AS tly, 0.0::DOUBLE AS ry, dy, CAST(greatest(1, ceil((maxx - x) / dx)) AS INTEGER) AS rsx, CAST(greatest(1, ceil((miny - y) / dy)) AS INTEGER) AS rsy FROM i")
def fp_intersection_pairs(spark, sf_dir):
    p = footprint_pairs(footprints(spark, sf_dir), "k")
    return p.select("k1", "k2", fpx.intersection(F.col("fp1"), fpx.bounds(F.col("fp2"))).alias("fp")).select("k1", "k2", *flat(fp()))


@query(f"WITH {SUP} SELECT k, min(k) OVER (PARTITION BY (tlx / 0.5) % 1, (tly / 0.5) % 1) AS first, true AS same FROM fp")
def fp_same_grid(spark, sf_dir):
    """The first footprint on each one's grid: groups by pixel vectors and place within a pixel, checked against their first."""
    f = footprints(spark, sf_dir)
    u, v = fpx.grid_fraction(fp())
    keyed = f.select("k", "fp", *[fp()[n].alias(n) for n in ("dx", "rx", "ry", "dy")], u.alias("u"), v.alias("v"))
    keys = ["dx", "rx", "ry", "dy", "u", "v"]
    heads = keyed.groupBy(*keys).agg(F.min("k").alias("first"), F.min_by("fp", "k").alias("head"))
    return keyed.join(heads, keys).select("k", "first", fpx.same_grid(F.col("head"), fp()).alias("same"))


@query(f"WITH {SUP} SELECT a.k, b.k AS other, a.tlx = b.tlx AND a.tly = b.tly AND a.rsx = b.rsx AND a.rsy = b.rsy AS same, a.k % 2 = 0 AS nearly, a.k = b.k AS exact FROM fp a JOIN fp b ON b.k = a.k OR b.k = a.k + 25")
def fp_equality(spark, sf_dir):
    # footprints 25 apart differ in their corner; one of two is shifted by less than the precision
    f = footprints(spark, sf_dir)
    near = fpx.moved(fp(), F.when(F.col("k") % 2 == 0, 1e-8).otherwise(1.0), 0, fp()["rsx"], fp()["rsy"])
    pairs = f.withColumn("other", F.explode(F.array("k", F.col("k") + 25))).join(f.select(F.col("k").alias("other"), F.col("fp").alias("fp2")), "other")
    return pairs.select("k", "other", fpx.equals(fp(), F.col("fp2")).alias("same"), fpx.almost_equals(fp(), near, 7.0).alias("nearly"), (fpx.key(fp()) == fpx.key(F.col("fp2"))).alias("exact"))


@query(f"WITH {SUP} SELECT k, CAST(floor((tlx + 3.3 - tlx) / dx) AS INTEGER) AS col, CAST(floor((tly - 2.2 - tly) / dy) AS INTEGER) AS row FROM fp")
def spatial_to_raster(spark, sf_dir):
    c, r = fpx.spatial_to_raster(fp(), fp()["tlx"] + 3.3, fp()["tly"] - 2.2)
    return footprints(spark, sf_dir).select("k", c.alias("col"), r.alias("row"))


@query(f"WITH {SUP} SELECT k, tlx + 3 * dx AS x, tly + 7 * dy AS y FROM fp")
def raster_to_spatial(spark, sf_dir):
    x, y = fpx.raster_to_spatial(fp(), 3, 7)
    return footprints(spark, sf_dir).select("k", x.alias("x"), y.alias("y"))


def mesh(df):
    """(k, fp, col, row) of all pixels of each footprint."""
    d = df.withColumn("row", F.explode(F.sequence(F.lit(0), fp()["rsy"] - 1)))
    return d.withColumn("col", F.explode(F.sequence(F.lit(0), fp()["rsx"] - 1)))


@query(f"WITH {SUP} SELECT k, col, row, tlx + col * dx AS x, tly + row * dy AS y FROM (SELECT *, CAST(unnest(range(rsx)) AS INTEGER) AS col FROM (SELECT *, CAST(unnest(range(rsy)) AS INTEGER) AS row FROM fp))")
def meshgrid_spatial(spark, sf_dir):
    x, y = fpx.at(fp(), F.col("col"), F.col("row"))
    return mesh(footprints(spark, sf_dir)).select("k", "col", "row", x.alias("x"), y.alias("y"))


@query(f"WITH {SUP} SELECT k, col, row, CAST(floor((col * dx + 2) / (2 * dx)) AS INTEGER) AS ocol, CAST(floor((row * dy - 2) / (2 * dy)) AS INTEGER) AS orow FROM (SELECT *, CAST(unnest(range(rsx)) AS INTEGER) AS col FROM (SELECT *, CAST(unnest(range(rsy)) AS INTEGER) AS row FROM fp))")
def meshgrid_raster_in(spark, sf_dir):
    other = fpx.make(fp()["tlx"] - 2, fp()["dx"] * 2, 0.0, fp()["tly"] + 2, 0.0, fp()["dy"] * 2, fp()["rsx"], fp()["rsy"])
    # what a footprint's pixels share is made once a footprint
    f = once(once(footprints(spark, sf_dir), other=other), dense=fpx.density(F.col("other")))
    c, r = fpx.spatial_to_raster(F.col("other"), *fpx.at(fp(), F.col("col"), F.col("row")), dense=F.col("dense"))
    return mesh(f).select("k", "col", "row", c.alias("ocol"), r.alias("orow"))


@query(f"WITH {SUP} SELECT k, 0 AS x0, CAST(rsx - 3 AS INTEGER) AS x1, CAST(2 AS INTEGER) AS y0, CAST(rsy AS INTEGER) AS y1 FROM fp")
def slice_in_clip(spark, sf_dir):
    a = fpx.moved(fp(), -3, 2, fp()["rsx"], fp()["rsy"])
    return footprints(spark, sf_dir).select("k", *[c.alias(n) for n, c in fpx.slice_in(a, fp(), clip=True).items()])


@query(f"WITH {SUP}, {CUS} SELECT f.k AS k1, c.k AS k2, f.tlx + floor((c.x - f.tlx) / 0.5) * 0.5 AS tlx, f.tly + floor((c.y - f.tly) / -0.5) * -0.5 AS tly FROM fp f JOIN (SELECT k, x, y + 80 AS y FROM cus) c ON c.x > f.minx AND c.x < f.maxx AND c.y > f.miny AND c.y < f.maxy")
def fp_intersection_points(spark, sf_dir):
    from ..plans.quadtree import overlap_join

    a = footprints(spark, sf_dir).select(F.col("k").alias("k1"), "fp")
    b = customer_points(spark, sf_dir).select(F.col("k").alias("k2"), "x", (F.col("y") + 80).alias("y"))
    j = overlap_join(a, b, fpx.bounds(fp()), (F.col("x"), F.col("y"), F.col("x"), F.col("y")), strict=False)
    m = fpx.bounds(fp())
    j = j.where((F.col("x") > m[0]) & (F.col("x") < m[2]) & (F.col("y") > m[1]) & (F.col("y") < m[3]))
    c, r = fpx.spatial_to_raster(fp(), F.col("x"), F.col("y"))
    x, y = fpx.at(fp(), c, r)
    return j.select("k1", "k2", x.alias("tlx"), y.alias("tly"))


@query("SELECT n_nationkey AS k, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 'stored' END, CASE WHEN n_nationkey % 3 = 0 THEN 'fallback' END) AS virtual_fallback, CASE WHEN n_nationkey % 5 = 0 THEN 'forced' ELSE coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 'stored' END, NULL) END AS virtual_forced FROM nation")
def sr_mode_resolution(spark, sf_dir):
    from ..sources.srs import virtual

    k = F.col("n_nationkey")
    stored = F.when(k % 2 == 0, "stored")
    return table(spark, sf_dir, "nation").select(k.alias("k"), virtual(stored, fallback=F.when(k % 3 == 0, "fallback")).alias("virtual_fallback"), virtual(stored, forced=F.when(k % 5 == 0, "forced")).alias("virtual_forced"))


_DIAMOND = f"WITH {SUP}, d AS (SELECT r_regionkey AS r, 40.0::DOUBLE + 60 * r_regionkey AS cx, 176.0::DOUBLE AS cy, 30.25::DOUBLE AS w FROM region), p AS (SELECT f.*, d.*, greatest(0, miny - cy, cy - maxy) AS oy, greatest(0, minx - cx, cx - maxx) AS ox FROM fp f, d), i AS (SELECT k, r, tlx, tly, greatest(minx, cx - (w - oy)) AS x0, least(maxx, cx + (w - oy)) AS x1, greatest(miny, cy - (w - ox)) AS y0, least(maxy, cy + (w - ox)) AS y1 FROM p WHERE ox + oy < w), s AS (SELECT k, r, floor((x0 - tlx) / 0.5) AS a, floor((tly - y1) / 0.5) AS b, ceil((x1 - tlx) / 0.5) AS c, ceil((tly - y0) / 0.5) AS e, tlx, tly FROM i) SELECT k, r, tlx + a * 0.5 AS tlx, tly - b * 0.5 AS tly, CAST(greatest(1, c - a) AS INTEGER) AS rsx, CAST(greatest(1, e - b) AS INTEGER) AS rsy FROM s"


def _diamonds(spark, sf_dir):
    from ..functions import geometry as gm

    x, y, w = 40.0 + 60 * F.col("r_regionkey"), F.lit(176.0), 30.25
    ring = F.array(gm.point(x, y + w), gm.point(x - w, y), gm.point(x, y - w), gm.point(x + w, y), gm.point(x, y + w))
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), ring.alias("ring"))


@query(_DIAMOND)
def fp_intersection_diamonds(spark, sf_dir):
    """Footprints cut by rings that lie across their grid."""
    from ..plans.quadtree import overlap_join

    d = _diamonds(spark, sf_dir)
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    j = overlap_join(footprints(spark, sf_dir), d, fpx.bounds(fp()), (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
    j = j.select("k", "r", fpx.overlap(fp(), F.col("ring")).alias("fp")).where("fp is not null")
    return j.select("k", "r", *[fp()[n].alias(n) for n in ("tlx", "tly", "rsx", "rsy")])


@query(f"WITH {SUP}, t AS (SELECT *, tlx + 5 AS bx0, tlx + 5 + 0.5 * rsx AS bx1 FROM fp) SELECT k, tlx + 4.0 AS tlx, tly - 2.0 AS tly, CAST(10 AS INTEGER) AS rsx, CAST(6 AS INTEGER) AS rsy FROM t")
def fp_intersection_turned(spark, sf_dir):
    """A footprint turned by a quarter: columns run down, rows run right; cut by a box of its own."""
    from ..functions import geometry as gm

    turned = fpx.make(fp()["tlx"], 0.0, 0.5, fp()["tly"], -0.5, 0.0, 40, 40)
    x, y = fp()["tlx"], fp()["tly"]
    ring = gm.box(x + 4.25, y - 7, x + 7, y - 2)["parts"][0][0]
    return footprints(spark, sf_dir).select("k", fpx.overlap(turned, ring).alias("fp")).select("k", *[fp()[n].alias(n) for n in ("tlx", "tly", "rsx", "rsy")])


@query(f"WITH {SUP} SELECT k, rsx * dx * rsy * -dy AS area, 'Polygon' AS kind, tlx AS x0, tly AS y0, tlx + rsx * dx AS x2, tly + rsy * dy AS y2, CAST(5 AS INTEGER) AS points, [rsy, rsx] AS shape FROM fp")
def fp_polygons(spark, sf_dir):
    """Footprints as polygons, and as GeoJSON text."""
    from ..functions import geometry as gm

    p = footprints(spark, sf_dir).select("k", fpx.checked(fp()).alias("fp"))
    p = p.select("k", gm.area(fpx.poly(fp())).alias("area"), fpx.geo_interface(fp()).alias("g"), F.size(fpx.ring(fp())).alias("points"), fpx.shape(fp()).alias("shape"))
    j = lambda path: F.get_json_object("g", path).cast("double")
    return p.select("k", "area", F.get_json_object("g", "$.type").alias("kind"), j("$.coordinates[0][0][0]").alias("x0"), j("$.coordinates[0][0][1]").alias("y0"), j("$.coordinates[0][2][0]").alias("x2"), j("$.coordinates[0][2][1]").alias("y2"), "points", "shape")
