"""Rasters as tables of tiles (tx, ty, data) or of pixels (band, py, px, value) on a footprint's grid.

A pixel without a row lies outside the raster; a pixel whose value is nodata has no data.  Reads from
tiles turn a window into ranges of tile indices, which filter the scan before anything is taken apart:
on the same grid arrays are sliced, on another one blocks of the target gather the tiles that they need,
with a halo for the kernel, and are resampled as arrays.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..footprint import Footprint
from ..plans.grid import grid

KERNELS = {"cv_nearest": 1, "cv_linear": 2, "cv_area": 2, "cv_cubic": 4, "cv_lanczos4": 8}


def pixels(tiles: DataFrame, width: int, height: int, data: str = "data") -> DataFrame:
    """Pixels of a table of tiles (tx, ty, ``data``: row-major array) of ``width`` x ``height`` each."""
    p = tiles.select("tx", "ty", F.posexplode(data).alias("p", "value"))
    return p.select((F.col("tx") * width + F.col("p") % width).alias("px"), (F.col("ty") * height + F.floor(F.col("p") / width).cast("int")).alias("py"), F.col("value").cast("double").alias("value"))


def tiles(px: DataFrame, width: int, height: int) -> DataFrame:
    """The inverse of ``pixels``: one row a tile, its values in row-major order."""
    x, y = F.pmod("px", F.lit(width)), F.pmod("py", F.lit(height))
    t = px.select(F.floor(F.col("px") / width).cast("int").alias("tx"), F.floor(F.col("py") / height).cast("int").alias("ty"), F.struct((y * width + x).alias("p"), "value").alias("v"))
    return t.groupBy("tx", "ty").agg(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["value"]).alias("data"))


def resolve_nodata(dst_nodata, src_nodata) -> float:
    return float(dst_nodata if dst_nodata is not None else src_nodata if src_nodata is not None else 0)


def scaled(px: DataFrame, scale: float, offset: float, nodata: float | None) -> DataFrame:
    """Values times scale plus offset; nodata stays as it is."""
    v = F.col("value") * scale + offset
    return px.withColumn("value", v if nodata is None else F.when(F.col("value") == nodata, F.col("value")).otherwise(v))


def weights(kind: str, f: Column) -> list[Column]:
    """Weights, up to their sum, of the neighbours around a point at fraction ``f`` of a pixel, from the first to the last."""
    if kind == "cv_nearest":
        return [F.lit(1.0)]
    if kind in ("cv_linear", "cv_area"):
        return [1 - f, f]
    if kind == "cv_cubic":
        a = -0.75
        near = lambda t: ((a + 2) * t - (a + 3)) * t * t + 1
        far = lambda t: ((a * t - 5 * a) * t + 8 * a) * t - 4 * a
        return [far(1 + f), near(f), near(1 - f), far(2 - f)]
    sinc = lambda t: F.when(F.abs(t) < 1e-9, 1.0).otherwise(4 * F.sin(math.pi * t) * F.sin(math.pi * t / 4) / (math.pi * math.pi * t * t))
    return [F.when(F.abs(f - k) < 4, sinc(f - k)).otherwise(0.0) for k in range(-3, 5)]


def sum_of(name: str) -> Column:
    return F.aggregate(name, F.lit(0.0), lambda a, x: a + x)


def read(px: DataFrame, src: Footprint, dst: Footprint, src_nodata=None, dst_nodata=None, interpolation: str | None = "cv_area") -> DataFrame:
    """(px, py, value) of every pixel of ``dst``: slice or copy where the grids agree, else interpolation.

    Neighbours outside the source, and neighbours without data that have a weight, make a pixel nodata.
    """
    spark = px.sparkSession
    nodata = resolve_nodata(dst_nodata, src_nodata)
    value = F.col("value") if src_nodata is None else F.when(F.col("value") == float(src_nodata), F.lit(nodata)).otherwise(F.col("value"))
    if src.same_grid(dst):
        u, v = (round(t) for t in src.inverse(dst.tlx, dst.tly))
        window = px.where((F.col("px") >= u) & (F.col("px") < u + dst.rsx) & (F.col("py") >= v) & (F.col("py") < v + dst.rsy))
        got = window.select((F.col("px") - u).cast("int").alias("px"), (F.col("py") - v).cast("int").alias("py"), value.alias("value"))
        return grid(spark, dst.rsx, dst.rsy).join(got, ["px", "py"], "left").select("px", "py", F.coalesce("value", F.lit(nodata)).alias("value"))
    if interpolation not in KERNELS:
        raise ValueError("the grids differ and no interpolation is given")
    n = KERNELS[interpolation]
    first = 0 if n == 1 else -(n // 2 - 1)
    det = src.dx * src.dy - src.rx * src.ry
    x = F.lit(dst.tlx) + F.col("px") * dst.dx + F.col("py") * dst.rx - src.tlx
    y = F.lit(dst.tly) + F.col("px") * dst.ry + F.col("py") * dst.dy - src.tly
    snap = lambda c: F.rint(c * 1e6) / 1e6
    u, v = snap((x * src.dy - y * src.rx) / det), snap((y * src.dx - x * src.ry) / det)
    base = F.rint if n == 1 else F.floor
    at = grid(spark, dst.rsx, dst.rsy).select("px", "py", u.alias("u"), v.alias("v"))
    at = at.select("px", "py", base("u").cast("int").alias("iu"), base("v").cast("int").alias("iv"), "u", "v")
    at = at.select("px", "py", "iu", "iv", F.array(*weights(interpolation, F.col("u") - F.col("iu"))).alias("wu"), F.array(*weights(interpolation, F.col("v") - F.col("iv"))).alias("wv"))
    at = at.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    i, j = F.col("i") % n, F.floor(F.col("i") / n).cast("int")
    need = at.select("px", "py", (F.col("iu") + first + i).alias("sx"), (F.col("iv") + first + j).alias("sy"), (F.get("wu", i) / sum_of("wu") * F.get("wv", j) / sum_of("wv")).alias("w")).where("abs(w) > 1e-12")
    from_ = px.select(F.col("px").cast("int").alias("sx"), F.col("py").cast("int").alias("sy"), F.col("value").alias("s"))
    void = F.col("s").isNull() if src_nodata is None else F.col("s").isNull() | (F.col("s") == float(src_nodata))
    got = need.join(from_, ["sx", "sy"], "left").groupBy("px", "py").agg(F.max(void).alias("void"), F.sum(F.col("w") * F.col("s")).alias("value"))
    return got.select("px", "py", F.when(F.col("void"), F.lit(nodata)).otherwise(F.col("value")).alias("value"))


# --- reads from tiles -----------------------------------------------------------------------------

Size = tuple[int, int]
Window = tuple[int, int, int, int]


def window_of(src: Footprint, dst: Footprint) -> Window:
    """The half-open window (x0, y0, x1, y1) in ``src`` of a footprint on the same grid."""
    u, v = (round(t) for t in src.inverse(dst.tlx, dst.tly))
    return u, v, u + dst.rsx, v + dst.rsy


def window_tiles(tiles_: DataFrame, size: Size, window: Window) -> DataFrame:
    """The tiles that meet a window: two ranges of indices, which a scan can use."""
    x0, y0, x1, y1 = window
    tx, ty = F.col("tx"), F.col("ty")
    return tiles_.where((tx >= x0 // size[0]) & (tx <= (x1 - 1) // size[0]) & (ty >= y0 // size[1]) & (ty <= (y1 - 1) // size[1]))


def _bands(tiles_: DataFrame) -> Column:
    return F.col("data") if "array<array" in tiles_.schema["data"].dataType.simpleString() else F.array("data")


def _void(v: Column, src_nodata) -> Column:
    gone = v.isNull() | F.isnan(v.cast("double"))
    return gone if src_nodata is None or math.isnan(src_nodata) else gone | (v == float(src_nodata))


def copied(tiles_: DataFrame, size: Size, src: Footprint, window: Window, channels: Sequence[int], src_nodata, nodata: float) -> DataFrame:
    """(band, px, py, value) of every pixel of a window, counted from its corner; ``band`` is the place in ``channels``.

    Needed and present tiles meet by their indices, then rows are sliced out of the arrays.
    """
    w, h = size
    x0, y0, x1, y1 = window
    a, b = x0 // w, y0 // h
    nx, ny = (x1 - 1) // w - a + 1, (y1 - 1) // h - b + 1
    i = F.col("id")
    need = tiles_.sparkSession.range(nx * ny).select((i % nx + a).cast("int").alias("tx"), (F.floor(i / nx) + b).cast("int").alias("ty"))
    some = window_tiles(tiles_, size, window).select("tx", "ty", _bands(tiles_).alias("data"))
    t = need.join(some, ["tx", "ty"], "left")
    own_w, own_h = F.least(F.lit(w), F.lit(src.rsx) - F.col("tx") * w), F.least(F.lit(h), F.lit(src.rsy) - F.col("ty") * h)
    left, right = F.greatest(F.lit(x0) - F.col("tx") * w, F.lit(0)), F.least(F.lit(x1) - F.col("tx") * w, F.lit(w))
    top, bottom = F.greatest(F.lit(y0) - F.col("ty") * h, F.lit(0)), F.least(F.lit(y1) - F.col("ty") * h, F.lit(h))
    t = t.select("tx", "ty", "data", own_w.alias("ow"), own_h.alias("oh"), left.alias("l"), right.alias("r"), F.explode(F.sequence(top, bottom - 1)).alias("row"))
    held = F.when(F.col("data").isNotNull() & (F.col("row") < F.col("oh")), F.greatest(F.least("r", "ow") - F.col("l"), F.lit(0))).otherwise(0)
    rows = F.array(*[F.slice(F.get("data", F.lit(c)), F.col("row") * F.col("ow") + F.col("l") + 1, F.col("n")) for c in channels])
    t = t.withColumn("n", held.cast("int")).withColumn("rows", F.when(F.col("n") > 0, rows).otherwise(F.array_repeat(F.array().cast("array<double>"), len(channels))))
    p = t.select("tx", "ty", "row", "l", "r", "n", F.posexplode("rows").alias("band", "v"))
    filled = F.concat(F.col("v").cast("array<double>"), F.array_repeat(F.lit(None).cast("double"), F.col("r") - F.col("l") - F.col("n")))
    p = p.select("tx", "ty", "row", "l", "band", F.posexplode(filled).alias("k", "v"))
    value = F.when(_void(F.col("v"), src_nodata), F.lit(nodata)).otherwise(F.col("v"))
    return p.select("band", (F.col("tx") * w + F.col("l") + F.col("k") - x0).cast("int").alias("px"), (F.col("ty") * h + F.col("row") - y0).cast("int").alias("py"), value.alias("value"))


def kernel_weights(kind: str, f: np.ndarray) -> np.ndarray:
    """``weights`` as an array (points, neighbours) that sums to 1."""
    if kind == "cv_nearest":
        return np.ones((len(f), 1))
    if kind in ("cv_linear", "cv_area"):
        w = np.stack([1 - f, f], 1)
    elif kind == "cv_cubic":
        k = -0.75
        near, far = (lambda t: ((k + 2) * t - (k + 3)) * t * t + 1), (lambda t: ((k * t - 5 * k) * t + 8 * k) * t - 4 * k)
        w = np.stack([far(1 + f), near(f), near(1 - f), far(2 - f)], 1)
    else:
        t = f[:, None] - np.arange(-3, 5)
        w = np.where(np.abs(t) < 4, np.sinc(t) * np.sinc(t / 4), 0.0)
    return w / w.sum(1, keepdims=True)


def snapped(c: np.ndarray) -> np.ndarray:
    return np.rint(c * 1e6) / 1e6


def resample_array(values: np.ndarray, ok: np.ndarray, at: tuple[int, int], u: np.ndarray, v: np.ndarray, kind: str, nodata: float) -> np.ndarray:
    """Bands at the points (u, v), in pixels of a raster of which ``values`` (band, y, x) is the part from pixel ``at`` on.

    A neighbour with a weight that is not ``ok`` makes the point nodata.
    """
    n = KERNELS[kind]
    first = 0 if n == 1 else -(n // 2 - 1)
    base = np.rint if n == 1 else np.floor
    iu, iv = base(u).astype(int), base(v).astype(int)
    wu, wv = kernel_weights(kind, u - iu), kernel_weights(kind, v - iv)
    out, void = np.zeros((len(values), len(u))), np.zeros((len(values), len(u)), bool)
    for j in range(n):
        for i in range(n):
            w = wu[:, i] * wv[:, j]
            x, y = iu + first + i - at[0], iv + first + j - at[1]
            inside = (x >= 0) & (y >= 0) & (x < values.shape[2]) & (y < values.shape[1])
            x, y = np.where(inside, x, 0), np.where(inside, y, 0)
            void |= (np.abs(w) > 1e-12) & ~(inside & ok[:, y, x])
            out += np.where(np.abs(w) > 1e-12, w * np.where(ok[:, y, x], values[:, y, x], 0.0), 0.0)
    return np.where(void, nodata, out)


def resampled(tiles_: DataFrame, size: Size, src: Footprint, dst: Footprint, channels: Sequence[int], src_nodata, nodata: float, kind: str, block: int = 256) -> DataFrame:
    """(band, px, py, value) of every pixel of ``dst``: blocks of it gather the tiles under them and are resampled as arrays."""
    spark = tiles_.sparkSession
    w, h = size
    reach = KERNELS[kind] // 2 + 1
    det = src.dx * src.dy - src.rx * src.ry
    # (u, v) of pixel (px, py) of the target: affine, so a block's range follows from its corners
    fx, fy = src.inverse(dst.tlx, dst.tly)
    ux, uy = (dst.dx * src.dy - dst.ry * src.rx) / det, (dst.rx * src.dy - dst.dy * src.rx) / det
    vx, vy = (dst.ry * src.dx - dst.dx * src.ry) / det, (dst.dy * src.dx - dst.rx * src.ry) / det
    nbx, nby = -(-dst.rsx // block), -(-dst.rsy // block)
    i = F.col("id")
    blocks = spark.range(nbx * nby).select((i % nbx).cast("int").alias("bx"), F.floor(i / nbx).cast("int").alias("by"))
    xa, xb = F.col("bx") * block, F.least((F.col("bx") + 1) * block, F.lit(dst.rsx)) - 1
    ya, yb = F.col("by") * block, F.least((F.col("by") + 1) * block, F.lit(dst.rsy)) - 1

    def span(c: float, cx: float, cy: float, tile: int, most: int) -> tuple[Column, Column]:
        ends = [F.lit(c) + x * cx + y * cy for x in (xa, xb) for y in (ya, yb)]
        lo, hi = F.floor((F.least(*ends) - reach) / tile), F.floor((F.greatest(*ends) + reach) / tile)
        return F.greatest(lo, F.lit(0)), F.least(hi, F.lit(most))

    (tx0, tx1), (ty0, ty1) = span(fx, ux, uy, w, (src.rsx - 1) // w), span(fy, vx, vy, h, (src.rsy - 1) // h)
    run = lambda a, b: F.when(a <= b, F.sequence(a, b))
    need = blocks.withColumn("tx", F.explode_outer(run(tx0, tx1))).withColumn("ty", F.explode_outer(run(ty0, ty1)))
    need = need.select("bx", "by", F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"))
    corners = [src.inverse(*dst.at(x, y)) for x in (0, dst.rsx) for y in (0, dst.rsy)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    window = max(0, math.floor(min(xs)) - reach), max(0, math.floor(min(ys)) - reach), min(src.rsx, math.ceil(max(xs)) + reach), min(src.rsy, math.ceil(max(ys)) + reach)
    bands = _bands(tiles_)
    some = window_tiles(tiles_, size, window).select("tx", "ty", F.array(*[F.get(bands, F.lit(c)).cast("array<double>") for c in channels]).alias("data"))
    rows = need.join(some, ["tx", "ty"], "left")
    n_bands = len(channels)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        bx, by = int(pdf["bx"].iloc[0]), int(pdf["by"].iloc[0])
        px, py = np.arange(bx * block, min((bx + 1) * block, dst.rsx)), np.arange(by * block, min((by + 1) * block, dst.rsy))
        px, py = (g.ravel() for g in np.meshgrid(px, py))
        u, v = snapped(fx + px * ux + py * uy), snapped(fy + px * vx + py * vy)
        got = pdf[pdf["data"].notna()]
        if len(got):
            x0, y0 = int(got["tx"].min()) * w, int(got["ty"].min()) * h
            values = np.zeros((n_bands, (int(got["ty"].max()) + 1) * h - y0, (int(got["tx"].max()) + 1) * w - x0))
            ok = np.zeros(values.shape, bool)
            for tx, ty, data in zip(got["tx"].astype(int), got["ty"].astype(int), got["data"]):
                tw, th = min(w, src.rsx - tx * w), min(h, src.rsy - ty * h)
                for b, band in enumerate(data):
                    a = np.asarray(band, float).reshape(th, tw)
                    at = (b, slice(ty * h - y0, ty * h - y0 + th), slice(tx * w - x0, tx * w - x0 + tw))
                    values[at] = a
                    ok[at] = ~np.isnan(a) if src_nodata is None else ~np.isnan(a) & (a != src_nodata)
            out = resample_array(values, ok, (x0, y0), u, v, kind, nodata)
        else:
            out = np.full((n_bands, len(px)), nodata)
        return pd.DataFrame({"band": np.repeat(np.arange(n_bands), len(px)), "px": np.tile(px, n_bands), "py": np.tile(py, n_bands), "value": out.ravel()})

    return rows.groupBy("bx", "by").applyInPandas(solve, "band int, px int, py int, value double")


def read_tiles(tiles_: DataFrame, size: Size, src: Footprint, dst: Footprint, channels: Sequence[int] = (0,), src_nodata=None, dst_nodata=None, interpolation: str | None = "cv_area", block: int = 256) -> DataFrame:
    """(band, px, py, value) of every pixel of ``dst`` from a table of tiles of ``size``: slices where the grids agree, else interpolation."""
    nodata = resolve_nodata(dst_nodata, src_nodata)
    if src.same_grid(dst):
        return copied(tiles_, size, src, window_of(src, dst), channels, src_nodata, nodata)
    if interpolation not in KERNELS:
        raise ValueError("the grids differ and no interpolation is given")
    return resampled(tiles_, size, src, dst, channels, src_nodata, nodata, interpolation, block)


def read_on_grid(px: DataFrame, src: Footprint, dst: Footprint, interpolation: str | None = "cv_area", size: int = 256) -> DataFrame:
    """Like ``read`` for a table of pixels, and null where a neighbour is missing."""
    t = tiles_of_bands(px.withColumn("band", F.lit(0)), src, (size, size), math.nan)
    r = read_tiles(t, (size, size), src, dst, dst_nodata=math.nan, interpolation=interpolation)
    return r.select("px", "py", F.when(~F.isnan("value"), F.col("value")).alias("value"))


def tiles_of_bands(px: DataFrame, fp: Footprint, size: Size, nodata: float, bands: int = 1) -> DataFrame:
    """(tx, ty, data: bands of row-major values) of pixels (band, px, py, value); pixels without a row hold ``nodata``."""
    w, h = size

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
        tw, th = min(w, fp.rsx - tx * w), min(h, fp.rsy - ty * h)
        a = np.full((bands, th, tw), float(nodata))
        a[pdf["band"].to_numpy(int), pdf["py"].to_numpy(int) - ty * h, pdf["px"].to_numpy(int) - tx * w] = pdf["value"].to_numpy(float)
        return pd.DataFrame({"tx": [tx], "ty": [ty], "data": [[list(b.ravel()) for b in a]]})

    p = px.where((F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") < fp.rsx) & (F.col("py") < fp.rsy))
    p = p.select(F.floor(F.col("px") / w).cast("int").alias("tx"), F.floor(F.col("py") / h).cast("int").alias("ty"), "band", "px", "py", F.col("value").cast("double").alias("value"))
    return p.groupBy("tx", "ty").applyInPandas(fold, "tx int, ty int, data array<array<double>>")


def pixels_of_bands(tiles_: DataFrame, fp: Footprint, size: Size) -> DataFrame:
    """(band, px, py, value) of tiles (tx, ty, data), the inverse of ``tiles_of_bands``."""
    w, h = size
    p = tiles_.select("tx", "ty", F.posexplode(_bands(tiles_)).alias("band", "v")).select("tx", "ty", "band", F.posexplode("v").alias("p", "value"))
    own = F.least(F.lit(w), F.lit(fp.rsx) - F.col("tx") * w)
    return p.select("band", (F.col("tx") * w + F.col("p") % own).cast("int").alias("px"), (F.col("ty") * h + F.floor(F.col("p") / own)).cast("int").alias("py"), F.col("value").cast("double").alias("value"))


def _laid(old: DataFrame, size: Size, fp: Footprint, new: DataFrame, nodata: float, bands: int) -> DataFrame:
    keys = ["band", "px", "py"]
    both = pixels_of_bands(old, fp, size).withColumn("is_new", F.lit(0)).unionByName(new.where("value is not null").select(*keys, "value").withColumn("is_new", F.lit(1)))
    return tiles_of_bands(both.groupBy(*keys).agg(F.max_by("value", "is_new").alias("value")), fp, size, nodata, bands)


def changed_tiles(tiles_: DataFrame, size: Size, fp: Footprint, new: DataFrame, nodata: float, bands: int) -> DataFrame:
    """The tiles that pixels (band, px, py, value) lie in, with these in their place; no other tiles."""
    touched = new.where("value is not null").select(F.floor(F.col("px") / size[0]).cast("int").alias("tx"), F.floor(F.col("py") / size[1]).cast("int").alias("ty")).distinct()
    return _laid(tiles_.join(touched, ["tx", "ty"], "left_semi"), size, fp, new, nodata, bands)


def set_tiles(tiles_: DataFrame, size: Size, fp: Footprint, new: DataFrame, window: Window, nodata: float, bands: int) -> DataFrame:
    """``tiles_`` with pixels (band, px, py, value) of a window in their place; tiles outside the window pass unopened."""
    x0, y0, x1, y1 = window
    tx, ty = F.col("tx"), F.col("ty")
    rest = tiles_.where(~((tx >= x0 // size[0]) & (tx <= (x1 - 1) // size[0]) & (ty >= y0 // size[1]) & (ty <= (y1 - 1) // size[1])))
    return rest.select("tx", "ty", _bands(tiles_).cast("array<array<double>>").alias("data")).unionByName(_laid(window_tiles(tiles_, size, window), size, fp, new, nodata, bands))


def write(px: DataFrame, new: DataFrame, mask: DataFrame | None = None, at: tuple[int, int] = (0, 0)) -> DataFrame:
    """``px`` with the pixels of ``new`` (px, py, value), shifted by ``at``, in their place; ``mask`` (px, py) limits them."""
    if mask is not None:
        new = new.join(mask.select("px", "py").distinct(), ["px", "py"], "left_semi")
    n = new.select((F.col("px") + at[0]).cast("int").alias("px"), (F.col("py") + at[1]).cast("int").alias("py"), F.col("value").alias("__new"))
    return px.join(n, ["px", "py"], "left").select("px", "py", F.coalesce("__new", "value").alias("value"))


def fill(px: DataFrame, value: float) -> DataFrame:
    return px.withColumn("value", F.lit(float(value)))


def mask_rectangles(mask: DataFrame) -> DataFrame:
    """(x0, x1, y0, y1), half-open, of rectangles that partition a mask (px, py): runs of a row, joined down while they repeat."""
    from pyspark.sql import Window

    r = mask.select("px", "py").distinct().withColumn("g", F.col("px") - F.row_number().over(Window.partitionBy("py").orderBy("px")))
    runs = r.groupBy("py", "g").agg(F.min("px").alias("x0"), (F.max("px") + 1).alias("x1"))
    runs = runs.withColumn("h", F.col("py") - F.row_number().over(Window.partitionBy("x0", "x1").orderBy("py")))
    return runs.groupBy("x0", "x1", "h").agg(F.min("py").alias("y0"), (F.max("py") + 1).alias("y1")).select("x0", "x1", "y0", "y1")
