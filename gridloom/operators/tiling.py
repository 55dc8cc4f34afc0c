"""Tilings of footprints as table-generating operators: a row a tile, numbered by row and column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import footprint as fpx
from ..plans.spread import once

EFFECTS = ("extend", "exclude", "overlap", "shrink", "exception")
LOCI = {"br": (1, 1), "tr": (1, -1), "tl": (-1, -1), "bl": (-1, 1)}


def _error(when: Column, what: str, value: Column) -> Column:
    return F.when(when, F.raise_error(F.lit(what)).cast("int")).otherwise(value)


def offsets(n: Column, size: Column, overlap: Column, effect: str) -> Column:
    """Tiles of one direction as an array of (i, at, len): ``n`` pixels in tiles of ``size`` with ``overlap``."""
    step = size - overlap
    count = F.when(n < size, F.lit(0)).otherwise(F.floor((n - size) / step).cast("int") + 1)
    gap = n - size - F.greatest(F.lit(0), count - 1) * step
    last = F.when(gap > 0, n - gap - overlap).otherwise(F.lit(0))
    some = F.when(gap != 0, count + 1).otherwise(count)
    if effect == "extend":
        at, len_, total = last, size, some
    elif effect == "shrink":
        at, len_, total = last, F.when(gap > 0, gap + overlap).otherwise(n), some
    elif effect == "overlap":
        at, len_, total = n - size, size, _error(gap < 0, "a tile is larger than the raster", some)
    elif effect == "exclude":
        at, len_, total = last, size, count
    elif effect == "exception":
        at, len_, total = last, size, _error(gap != 0, "the tiles do not fit the raster", count)
    else:
        raise ValueError(f"no boundary effect {effect!r}")
    tile_ = lambda i: F.struct(i.alias("i"), F.when(i < count, i * step).otherwise(at).cast("int").alias("at"), F.when(i < count, size).otherwise(len_).cast("int").alias("len"))
    return F.when(total > 0, F.transform(F.sequence(F.lit(0), total - 1), tile_)).otherwise(F.array().cast("array<struct<i:int,at:int,len:int>>"))


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def tile(df: DataFrame, size, overlap=(0, 0), effect: str = "extend", locus: str = "br", fp: str = "fp") -> DataFrame:
    """``df`` with a row for each tile of its footprint: columns ``row``, ``col`` and ``tile``.

    size and overlap are (x, y) in pixels, numbers or columns.  ``locus`` is the corner that the last
    tile reaches: tiling starts at the opposite one.
    """
    w, h, ox, oy = map(_col, (*size, *overlap))
    bad = (w <= 0) | (h <= 0) | (ox < 0) | (oy < 0) | (ox >= w) | (oy >= h)
    dirx, diry = LOCI[locus]
    g = F.col(fp)
    xs, ys = offsets(_error(bad, "illegal tile size or overlap", g["rsx"]), w, ox, effect), offsets(g["rsy"], h, oy, effect)
    rows = df.withColumn("__x", F.explode(xs)).withColumn("__y", F.explode(ys))
    x, y = F.col("__x"), F.col("__y")
    left = x["at"] if dirx > 0 else g["rsx"] - x["at"] - x["len"]
    top = y["at"] if diry > 0 else g["rsy"] - y["at"] - y["len"]
    return rows.select(*df.columns, y["i"].alias("row"), x["i"].alias("col"), fpx.moved(g, left, top, x["len"], y["len"]).alias("tile"))


def tile_count(df: DataFrame, counts, overlap=(0, 0), effect: str = "extend", locus: str = "br", fp: str = "fp") -> DataFrame:
    """Tiles from the number of tiles in a row and in a column."""
    g = F.col(fp)
    sizes = []
    for n, o, rs in zip(map(_col, counts), map(_col, overlap), (g["rsx"], g["rsy"])):
        exact = (rs + o * (n - 1)) / n
        s = (F.floor(exact) if effect == "exclude" else F.ceil(exact)).cast("int")
        if effect == "exception":
            s = _error(exact != s, "the tiles do not fit the raster", s)
        s = _error((s <= o) | (s + (n - 1) * (s - o) - rs >= s - o), "the tiles do not fit the raster", s)
        sizes.append(s)
    out = tile(df.withColumn("__w", sizes[0]).withColumn("__h", sizes[1]), (F.col("__w"), F.col("__h")), overlap, effect, locus, fp)
    out = out.drop("__w", "__h")
    return out.where((F.col("col") < _col(counts[0])) & (F.col("row") < _col(counts[1]))) if effect == "exclude" else out


def tile_occurrence(df: DataFrame, size, occurrence, effect: str = "extend", locus: str = "br", fp: str = "fp") -> DataFrame:
    """Tiles that cover every pixel exactly ``occurrence`` (x, y) times."""
    if effect not in ("extend", "exception"):
        raise ValueError("only extend and exception cover every pixel alike")
    over = []
    for s, n in zip(size, occurrence):
        if n < 1 or s % n:
            raise ValueError("the size is no multiple of the occurrence")
        over.append(s - s // n)
    grown = df.withColumn("__fp", F.col(fp)).withColumn(fp, fpx.dilate(F.col(fp), over[0], over[0], over[1], over[1]))
    return tile(grown, size, tuple(over), effect, locus, fp).withColumn(fp, F.col("__fp")).drop("__fp")


def is_tiling(tiles: DataFrame, boundless: bool = False, fp: str = "fp", by: str | None = None, whole: DataFrame | None = None) -> DataFrame:
    """(uncovered, overlapping, outside) of a tiling with columns ``fp`` and ``tile``: pixels of the footprint
    that no tile holds, pixels that several hold, and tiles that reach out of it.  Counted by rows of pixels.

    With ``by`` the tilings of many footprints are checked, each by itself, and the counts added up;
    ``whole`` (by, fp) has the footprints, which may have no tile."""
    k = F.lit(0) if by is None else F.col(by)
    t = _sliced(tiles.withColumn("k", k), fp).select("k", F.col(fp)["rsx"].alias("w"), F.col(fp)["rsy"].alias("h"), "x0", "x1", "y0", "y1")
    out = t.agg(F.coalesce(F.sum(((F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x1") > F.col("w")) | (F.col("y1") > F.col("h"))).cast("long")), F.lit(0)).alias("outside"))
    # a row of pixels changes only where a tile begins or ends
    zero = F.lit(0)
    inner = t.select("k", F.greatest("x0", zero).alias("x0"), F.least("x1", "w").alias("x1"), F.greatest("y0", zero).alias("y0"), F.least("y1", "h").alias("y1")).where("x1 > x0 and y1 > y0")
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("x"), F.lit(step).alias("step")) for x, step in (("x0", 1), ("x1", -1))]))
    rows = inner.select("k", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), "x0", "x1").select("k", "y", ends.alias("e"))
    w = Window.partitionBy("k", "y").orderBy("x")
    runs = rows.groupBy("k", "y", F.col("e.x").alias("x")).agg(F.sum("e.step").alias("step"))
    runs = runs.select((F.lead("x").over(w) - F.col("x")).cast("long").alias("wide"), F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    held = lambda least: F.coalesce(F.sum(F.when(F.col("n") > least, F.col("wide"))), F.lit(0))
    n = runs.agg(held(0).alias("held"), held(1).alias("overlapping"))
    full = t if whole is None else whole.select(k.alias("k"), F.col(fp)["rsx"].alias("w"), F.col(fp)["rsy"].alias("h"))
    area = full.groupBy("k").agg(F.max(F.col("w").cast("long") * F.col("h")).alias("area")).agg(F.coalesce(F.sum("area"), F.lit(0)).alias("area"))
    return n.crossJoin(area).crossJoin(out).select((F.col("area") - F.col("held")).alias("uncovered"), "overlapping", "outside")


def _sliced(tiles: DataFrame, fp: str, clip: bool = False) -> DataFrame:
    """``tiles`` with the ranges (x0, x1, y0, y1) of pixels of ``fp`` that each holds, made once a tile."""
    dense = once(tiles, __dense=fpx.density(F.col(fp)))
    return once(dense, **fpx.slice_in(F.col("tile"), F.col(fp), clip, F.col("__dense"))).drop("__dense")


def pixel_occurrence(tiles: DataFrame, fp: str = "fp") -> DataFrame:
    """(px, py, n): how many tiles hold each pixel of their footprint."""
    # tiles of one place are counted before they become pixels
    t = _sliced(tiles, fp, True).where("x1 > x0 and y1 > y0").groupBy("x0", "x1", "y0", "y1").agg(F.count(F.lit(1)).alias("n"))
    px = t.withColumn("py", F.explode(F.sequence("y0", F.col("y1") - 1))).withColumn("px", F.explode(F.sequence("x0", F.col("x1") - 1)))
    return px.groupBy("px", "py").agg(F.sum("n").alias("n"))


def plain_offsets(n: int, size: int, overlap: int, effect: str) -> list[tuple[int, int]]:
    """(at, len) of the tiles of one direction, as ``offsets``."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("illegal tile size or overlap")
    step = size - overlap
    count = 0 if n < size else (n - size) // step + 1
    out = [(k * step, size) for k in range(count)]
    gap = n - size - max(0, count - 1) * step
    if gap == 0 or effect == "exclude":
        return out
    at = n - gap - overlap if gap > 0 else 0
    if effect == "exception" or effect == "overlap" and gap < 0:
        raise ValueError("the tiles do not fit the raster")
    return out + [{"extend": (at, size), "overlap": (n - size, size), "shrink": (at, gap + overlap if gap > 0 else n)}[effect]]


@F.udtf(returnType="row int, col int, x int, y int, w int, h int")
class Tiles:
    """The tiles of a raster of (rsx, rsy) pixels as a table function: row, column, corner and size of each."""

    def eval(self, rsx: int, rsy: int, w: int, h: int, ox: int, oy: int, effect: str):
        for j, (y, high) in enumerate(plain_offsets(rsy, h, oy, effect)):
            for i, (x, wide) in enumerate(plain_offsets(rsx, w, ox, effect)):
                yield j, i, x, y, wide, high


def register(spark, name: str = "gridloom_tiles") -> str:
    """Make ``Tiles`` known to SQL: ``SELECT ... FROM t, LATERAL gridloom_tiles(t.rsx, t.rsy, 256, 256, 0, 0, 'shrink')``."""
    spark.udtf.register(name, Tiles)
    return name
