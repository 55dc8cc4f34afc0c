"""Neighbourhood operators.

Over tables of tiles, blocks of tiles get the edges of the tiles around them, so one shuffle of little more
than the raster serves, and arrays do the rest.  Over sparse tables of pixels, neighbours come from two
passes of ``lag`` and ``lead``: along rows, then along columns over the values that the first gathered.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(px: DataFrame, *by: str) -> DataFrame:
    """``px`` plus ``z``: the 3 x 3 values around each pixel, row by row, null where there is no pixel."""
    row = Window.partitionBy(*by, "py").orderBy("px")
    col = Window.partitionBy(*by, "px").orderBy("py")
    side = lambda f, w, c, k, of: F.when(f(of, 1).over(w) == F.col(of) + k, f(c, 1).over(w))
    r = px.withColumn("__r", F.array(side(F.lag, row, "value", -1, "px"), F.col("value"), side(F.lead, row, "value", 1, "px")))
    none = F.array(*[F.lit(None).cast("double")] * 3)
    up, down = side(F.lag, col, "__r", -1, "py"), side(F.lead, col, "__r", 1, "py")
    return r.withColumn("z", F.concat(F.coalesce(up, none), "__r", F.coalesce(down, none))).drop("__r")


def gradient(z: Column, resx: float, resy: float, horn: bool = False) -> tuple[Column, Column]:
    """Slopes in x and y from the nine values ``z``.  Unless ``horn``, the middle weight of the west column is
    taken from the south neighbour, which is what existing results were made with."""
    west = z[3] if horn else z[7]
    dx = ((z[2] + 2 * z[5] + z[8]) - (z[0] + 2 * west + z[6])) / (8 * resx)
    dy = ((z[6] + 2 * z[7] + z[8]) - (z[0] + 2 * z[1] + z[2])) / (8 * resy)
    return dx, dy


def slopes(px: DataFrame, resx: float, resy: float, horn: bool = False, crop: bool = False) -> DataFrame:
    """(px, py, slope) in degrees; pixels with a missing neighbour have slope 0, or are left out with ``crop``."""
    n = neighbours(px)
    dx, dy = gradient(F.col("z"), resx, resy, horn)
    whole = ~F.exists("z", lambda v: v.isNull())
    s = n.select("px", "py", whole.alias("whole"), F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope"))
    return s.where("whole").drop("whole") if crop else s.select("px", "py", F.when(F.col("whole"), F.col("slope")).otherwise(0.0).alias("slope"))


def focal_range(px: DataFrame) -> DataFrame:
    """(px, py, span): largest less smallest value of a pixel and its four neighbours."""
    plus = F.array_compact(F.array(*[F.col("z")[k] for k in (1, 3, 4, 5, 7)]))
    return neighbours(px).select("px", "py", (F.array_max(plus) - F.array_min(plus)).alias("span"))


# --- over tiles ----------------------------------------------------------------------------------


#: pixels of the side of a block, which is a square of tiles that one call of a function sees
BLOCK = 256


def in_blocks(tiles: DataFrame, size: tuple[int, int], k: tuple[int, int]) -> DataFrame:
    """(bx, by, tx, ty, dx, dy, part): each whole tile (0, 0) in its block of ``k`` tiles, and the rows, columns and corners that tiles of other blocks lie next to.

    A part that is sent on names the tile that it borders and the direction (dx, dy) that it lies in.
    """
    w, h = size
    d = F.col("data")
    rows = (F.size(d) / w).cast("int")
    column = lambda x: F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.get(d, r * w + x))
    row = lambda y: F.slice(d, y * w + 1, F.lit(w))
    corner = lambda x, y: F.array(F.get(d, y * w + x))
    last_c, last_r = F.lit(w - 1), rows - 1
    parts = {
        (0, 0): d, (-1, 0): column(last_c), (1, 0): column(F.lit(0)), (0, -1): row(last_r), (0, 1): row(F.lit(0)),
        (-1, -1): corner(last_c, last_r), (1, -1): corner(F.lit(0), last_r), (-1, 1): corner(last_c, F.lit(0)), (1, 1): corner(F.lit(0), F.lit(0)),
    }
    block = lambda dx, dy: [F.floor((F.col(t) - o) / n).cast("int") for t, o, n in (("tx", dx, k[0]), ("ty", dy, k[1]))]
    (ox, oy), sent = block(0, 0), []
    for (dx, dy), v in parts.items():
        bx, by = block(dx, dy)
        s = F.struct(bx.alias("bx"), by.alias("by"), (F.col("tx") - dx).cast("int").alias("tx"), (F.col("ty") - dy).cast("int").alias("ty"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), v.cast("array<double>").alias("part"))
        # tiles of one block need no strips of each other
        sent.append(s if (dx, dy) == (0, 0) else F.when((bx != ox) | (by != oy), s))
    return tiles.select(F.explode(F.array_compact(F.array(*sent))).alias("s")).select("s.*")


def over_tiles(tiles: DataFrame, size: tuple[int, int], f: Callable[[np.ndarray], np.ndarray], side: int = BLOCK) -> DataFrame:
    """(tx, ty, data) of ``f`` applied to full tiles with a border of one pixel, NaN where there is no neighbour.

    ``f`` sees blocks of tiles with such a border and returns an array without it; a pixel's result may
    only depend on its eight neighbours.
    """
    w, h = size
    kx, ky = max(1, side // w), max(1, side // h)

    def run(table: pa.Table) -> pa.Table:
        tx, ty, dx, dy, bx, by = (table.column(c).to_numpy() for c in ("tx", "ty", "dx", "dy", "bx", "by"))
        part = table.column("part").combine_chunks()
        flat, at = part.flatten().to_numpy(), np.r_[0, np.cumsum(part.value_lengths().to_numpy())]
        x, y = tx - bx[0] * kx, ty - by[0] * ky
        a = np.full((ky * h + 2, kx * w + 2), np.nan)
        own = np.flatnonzero((dx == 0) & (dy == 0))
        for i in own:
            a[1 + y[i] * h : 1 + (y[i] + 1) * h, 1 + x[i] * w : 1 + (x[i] + 1) * w] = flat[at[i] : at[i + 1]].reshape(h, w)
        for i in np.flatnonzero((dx != 0) | (dy != 0)):
            rows = slice(1 + y[i] * h, 1 + (y[i] + 1) * h) if dy[i] == 0 else (y[i] * h if dy[i] < 0 else 1 + (y[i] + 1) * h)
            cols = slice(1 + x[i] * w, 1 + (x[i] + 1) * w) if dx[i] == 0 else (x[i] * w if dx[i] < 0 else 1 + (x[i] + 1) * w)
            a[rows, cols] = flat[at[i] : at[i + 1]] if dx[i] == 0 or dy[i] == 0 else flat[at[i]]
        out = f(a).reshape(ky, h, kx, w).swapaxes(1, 2)[y[own], x[own]].reshape(-1)
        data = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * (w * h)), pa.array(out))
        return pa.table({"tx": pa.array(tx[own], pa.int32()), "ty": pa.array(ty[own], pa.int32()), "data": data})

    return in_blocks(tiles, size, (kx, ky)).groupBy("bx", "by").applyInArrow(run, "tx int, ty int, data array<double>")


def slope_array(z: np.ndarray, resx: float, resy: float, horn: bool = False) -> np.ndarray:
    """Slopes in degrees of an array with a border of one pixel; 0 where a neighbour is missing."""
    c = lambda y, x: z[1 + y : z.shape[0] - 1 + y, 1 + x : z.shape[1] - 1 + x]
    west = c(0, -1) if horn else c(1, 0)
    dx = ((c(-1, 1) + 2 * c(0, 1) + c(1, 1)) - (c(-1, -1) + 2 * west + c(1, -1))) / (8 * resx)
    dy = ((c(1, -1) + 2 * c(1, 0) + c(1, 1)) - (c(-1, -1) + 2 * c(-1, 0) + c(-1, 1))) / (8 * resy)
    whole = ~np.isnan(sum(c(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)))
    return np.where(whole, np.degrees(np.arctan(np.hypot(dx, dy))), 0.0)


def slope_tiles(tiles: DataFrame, size: tuple[int, int], resx: float, resy: float, horn: bool = False) -> DataFrame:
    """(tx, ty, data): slopes of tiles, as ``slopes``."""
    return over_tiles(tiles, size, lambda z: slope_array(z, resx, resy, horn))
