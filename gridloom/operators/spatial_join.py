"""Joins between features, footprints, tiles and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..footprint import Footprint
from ..functions import footprint as fpx
from ..functions import geometry as gm
from ..plans.lineage import cut
from ..plans.quadtree import overlap_join
from ..plans.spread import once


def footprint_pairs(df: DataFrame, key: str, fp: str = "fp") -> DataFrame:
    """(k1, fp1, k2, fp2), k1 < k2, of footprints that share area."""
    a, b = (df.select(F.col(key).alias(f"k{i}"), F.col(fp).alias(f"fp{i}")) for i in (1, 2))
    pairs = overlap_join(a, b, fpx.bounds(F.col("fp1")), fpx.bounds(F.col("fp2")))
    return pairs.where((F.col("k1") < F.col("k2")) & fpx.share_area(F.col("fp1"), F.col("fp2")))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a ring goes round a point an odd number of times; lower and left sides count as inside."""
    side = lambda i: F.transform(F.array(F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b"))), lambda s: ((s["a"]["y"] <= y) != (s["b"]["y"] <= y)) & (x < s["a"]["x"] + (y - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"]) / F.when(s["b"]["y"] == s["a"]["y"], 1.0).otherwise(s["b"]["y"] - s["a"]["y"])))[0]
    n = F.size(F.filter(F.sequence(F.lit(0), F.size(ring) - 2), side))
    return n % 2 == 1


#: rows of a place or a shape that travel as one
TOGETHER = 4096


def gathered(df: DataFrame, by: list[str], rows: str, most: int = TOGETHER) -> DataFrame:
    """(``by``, ``rows``): ``df`` with its rows of equal ``by`` as arrays of structs of its other columns, of about ``most`` at most."""
    rest = [c for c in df.columns if c not in by]
    # counted by hash, as shapes are slow to group by; values that share one get more parts than they need
    many = df.groupBy(F.xxhash64(*by).alias("__h")).agg(F.ceil(F.count(F.lit(1)) / most).alias("__parts")).where("__parts > 1")
    # at most one such value in ``most`` rows, so these are few; parts go by all of a row but what it is gathered by
    d = df.withColumn("__h", F.xxhash64(*by)).join(F.broadcast(many), "__h", "left")
    d = d.withColumn("__part", F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(*rest) if rest else F.monotonically_increasing_id(), "__parts")).otherwise(0))
    each = F.struct(*rest) if rest else F.struct(F.lit(0).alias("__none"))
    return d.groupBy(*by, "__part").agg(F.collect_list(each).alias(rows)).drop("__part")


#: pairs that are unfolded at a time, tasks a core that unfold them, and pairs of a row that is not worth a shuffle
PIECE, TASKS, FEW = 16_384, 8, 64


def unfolded(df: DataFrame, outer: str, inner: str, deal: bool) -> DataFrame:
    """``df`` with a row for each pair of an element of its array ``outer`` and one of its array ``inner``, under their names; the arrays hold no nulls.

    A row stands for up to ``TOGETHER`` squared pairs, so its bytes tell nothing of the work: with ``deal`` rows are dealt to a number of tasks
    that is set here, and not to as few as their bytes would fill.  Slices are made by a lambda, which code is not generated for, so that the
    pairs of one leave before the next is unfolded; one generated loop over both arrays holds all pairs of a row at once.
    """
    if deal:
        df = df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism, F.get(outer, 0), F.get(inner, 0))
    step = F.greatest(F.lit(1), F.floor(F.lit(PIECE) / F.size(inner))).cast("int")
    slices = F.transform(F.sequence(F.lit(1), F.size(outer), step), lambda i: F.slice(outer, i, step))
    rest = [c for c in df.columns if c not in (outer, inner)]
    d = df.select(*rest, inner, F.explode(slices).alias(outer))
    return d.select(*rest, inner, F.explode(outer).alias(outer)).select(*rest, outer, F.explode(inner).alias(inner))


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", geom: str = "geom") -> DataFrame:
    """Pairs of points and polygons that hold them: join on the leaves of a quadtree, then the ring test with holes.

    Points of one place and polygons of one shape are joined together and told apart at the end, so that shapes are not sent and
    tested once for each of their copies.
    """
    px = F.col(x), F.col(y), F.col(x), F.col(y)
    g = F.col(geom)
    names = ["gl_x0", "gl_y0", "gl_x1", "gl_y1"]
    shapes = once(gathered(polygons, [geom], "gl_polygons"), **dict(zip(names, gm.bbox(g))))
    x0, y0, x1, y1 = map(F.col, names)
    ring = F.flatten(g["parts"])[0]
    corners = F.forall(ring, lambda p: ((p["x"] == x0) | (p["x"] == x1)) & ((p["y"] == y0) | (p["y"] == y1)))
    # the box decides for rectangles, and is told apart once a polygon rather than once a pair
    is_box = (F.size(F.flatten(g["parts"])) == 1) & (F.size(ring) == 5) & corners & (F.abs(gm.ring_area(ring)) == (x1 - x0) * (y1 - y0))
    # tables of their own: the tree reads them for its extent and its sample
    shapes, places = cut(once(shapes, gl_box=is_box)), cut(gathered(points, [x, y], "gl_points"))
    pairs = overlap_join(places, shapes, px, (x0, y0, x1, y1), strict=False)
    in_box = (F.col(x) >= x0) & (F.col(x) < x1) & (F.col(y) >= y0) & (F.col(y) < y1)
    odd = F.size(F.filter(F.flatten(g["parts"]), lambda r: in_ring(F.col(x), F.col(y), r))) % 2 == 1
    found = pairs.where(F.when(F.col("gl_box"), in_box).otherwise(odd))
    most = [t.agg(F.max(F.size(r))).first()[0] or 0 for t, r in ((places, "gl_points"), (shapes, "gl_polygons"))]
    found = unfolded(found.select(x, y, geom, "gl_points", "gl_polygons"), "gl_polygons", "gl_points", most[0] * most[1] > FEW)
    return found.select(*[c if c in (x, y) else F.col(f"gl_points.{c}").alias(c) for c in points.columns], *[c if c == geom else F.col(f"gl_polygons.{c}").alias(c) for c in polygons.columns])


def features_by_tile(features: DataFrame, fp: Footprint, width: int, height: int, geom: str = "geom") -> DataFrame:
    """(tx, ty, n): how many polygons have their middle in each tile of ``width`` x ``height`` pixels of a raster; those outside it count nowhere.

    A middle on the line between tiles, up to a millionth of a pixel, belongs to the later one.
    """
    det = fp.dx * fp.dy - fp.rx * fp.ry
    # exploded, so that the middle is made once and not for each use of it
    c = features.select(F.explode(F.array(gm.centroid(F.col(geom)))).alias("c")).select((F.col("c.x") - fp.tlx).alias("x"), (F.col("c.y") - fp.tly).alias("y"))
    u, v = (F.col("x") * fp.dy - F.col("y") * fp.rx) / det, (F.col("y") * fp.dx - F.col("x") * fp.ry) / det
    at = c.select(F.floor(F.round(u, 6)).alias("px"), F.floor(F.round(v, 6)).alias("py")).where(F.col("px").between(0, fp.rsx - 1) & F.col("py").between(0, fp.rsy - 1))
    return at.groupBy(F.floor(F.col("px") / width).cast("int").alias("tx"), F.floor(F.col("py") / height).cast("int").alias("ty")).agg(F.count(F.lit(1)).alias("n"))


def zonal(pixels: DataFrame, burnt: DataFrame, key: str) -> DataFrame:
    """(key, n, mean) of the pixels (px, py, value) under each burnt shape (key, px, py).

    Pixels made of arrays are many more than their table's bytes tell, so they are never broadcast.
    """
    return burnt.join(pixels.hint("merge"), ["px", "py"]).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def tiles_of_windows(windows: DataFrame, width: int, height: int) -> DataFrame:
    """(window columns, tx, ty): tiles of ``width`` x ``height`` pixels that half-open windows (x0, x1, y0, y1) meet."""
    t = windows.withColumn("tx", F.explode(F.sequence(F.floor(F.col("x0") / width), F.floor((F.col("x1") - 1) / width))))
    return t.withColumn("ty", F.explode(F.sequence(F.floor(F.col("y0") / height), F.floor((F.col("y1") - 1) / height))))


def missing_tiles(needed: DataFrame, ready: DataFrame, *keys: str) -> DataFrame:
    """Tiles of ``needed`` that ``ready`` does not hold, each once."""
    return needed.select(*keys).distinct().join(ready.select(*keys), list(keys), "left_anti")
