"""Recipes: rasters whose pixels a user function computes tile by tile from other rasters.

A recipe is lazy lineage.  Its primitives are tables of tiles.  For each computation tile ``convert`` says
which window of each primitive it needs (a halo widens it); the window's tiles meet the computation tile
by an equi-join on their indices, and the function sees whole arrays.  Computation tiles that lie across
cache tiles are parts of them, which ``merge`` puts together.

A primitive may be a recipe itself, and several recipes may share one.  A read first carries its tiles backwards
through that graph (``Demand``), so that each recipe computes the tiles that something downstream needs, once, and no others.  With a cache, a tile is a partition of a
Parquet table, so writing it twice leaves one; only tiles that are missing or damaged are computed.
"""

from __future__ import annotations

import json
import queue
import threading
import uuid
import weakref
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..footprint import Footprint
from ..functions.types import channels_schema
from ..plans.lineage import cut
from .raster import KERNELS, pixels_of_bands, read_tiles, resample_array, resolve_nodata, snapped, tiles_of_bands
from .spatial_join import missing_tiles

TILES = "tx int, ty int, data array<array<double>>"


def concat_arrays(fp: Footprint, parts: dict[Footprint, np.ndarray], raster=None) -> np.ndarray:
    """Parts pasted into one array at their places; later parts cover earlier ones."""
    some = next(iter(parts.values()))
    out = np.zeros((*fp.shape, *some.shape[2:]), some.dtype)
    for p, a in parts.items():
        x, y = (round(v) for v in fp.inverse(p.tlx, p.tly))
        out[y : y + p.rsy, x : x + p.rsx] = a
    return out


def slope_tile(fp, fps, arrays, raster=None):
    """Slopes in degrees of primitive ``z``, given with a halo of one pixel; 0 where a neighbour is missing."""
    z = arrays["z"]
    c = lambda y, x: z[1 + y : z.shape[0] - 1 + y, 1 + x : z.shape[1] - 1 + x]
    dx = ((c(-1, 1) + 2 * c(0, 1) + c(1, 1)) - (c(-1, -1) + 2 * c(1, 0) + c(1, -1))) / 8
    dy = ((c(1, -1) + 2 * c(1, 0) + c(1, 1)) - (c(-1, -1) + 2 * c(-1, 0) + c(-1, 1))) / -8
    return np.nan_to_num(np.degrees(np.arctan(np.hypot(dx, dy))))


@dataclass
class Primitive:
    """A raster that a recipe reads, and how windows of it are read.

    Its tiles (tx, ty, data) of ``size`` are a table, or come from ``scan``, which takes a half-open window of
    pixels and opens no more than that, or from ``recipe``, which computes those that are needed.
    """

    tiles: DataFrame | None
    fp: Footprint
    size: tuple[int, int]
    channels: Sequence[int] = (0,)
    nodata: float | None = None
    dst_nodata: float | None = None
    interpolation: str | None = "cv_area"
    recipe: "Recipe | None" = None
    scan: Callable[[tuple[int, int, int, int]], DataFrame] | None = None

    def needed(self, need: DataFrame) -> DataFrame:
        """The tiles from which those of ``need`` (tx, ty) are taken."""
        if self.scan is None:
            return self.tiles
        (w, h), b = self.size, need.agg(F.min("tx").alias("l"), F.min("ty").alias("t"), F.max("tx").alias("r"), F.max("ty").alias("b")).first()
        if b["l"] is None:
            return need.sparkSession.createDataFrame([], TILES)
        return self.scan((b["l"] * w, b["t"] * h, min(self.fp.rsx, (b["r"] + 1) * w), min(self.fp.rsy, (b["b"] + 1) * h)))

    @classmethod
    def of_pixels(cls, px: DataFrame, fp: Footprint, size: tuple[int, int] = (256, 256), missing: float = float("nan"), **how) -> "Primitive":
        """From a table of pixels (px, py, value), on the grid of ``fp``; pixels without a row hold no data."""
        return cls(tiles_of_bands(px.withColumn("band", F.lit(0)), fp, size, missing), fp, size, **how)


def _window(prim: dict, got: dict[tuple[int, int], list], window: Footprint, missing: float) -> np.ndarray:
    """(Y, X) or (Y, X, C) of a window of a primitive from the tiles under it."""
    fp, (w, h), n = prim["fp"], prim["size"], len(prim["channels"])
    nodata = missing if prim["dst_nodata"] is None else prim["dst_nodata"]
    out = np.full((n, window.rsy, window.rsx), float(nodata))
    if got:
        x0, y0 = min(t[0] for t in got) * w, min(t[1] for t in got) * h
        x1, y1 = min(fp.rsx, (max(t[0] for t in got) + 1) * w), min(fp.rsy, (max(t[1] for t in got) + 1) * h)
        values = np.full((n, y1 - y0, x1 - x0), np.nan)
        for (tx, ty), data in got.items():
            tw, th = min(w, fp.rsx - tx * w), min(h, fp.rsy - ty * h)
            for k, c in enumerate(prim["channels"]):
                values[k, ty * h - y0 : ty * h - y0 + th, tx * w - x0 : tx * w - x0 + tw] = np.asarray(data[c], float).reshape(th, tw)
        ok = ~np.isnan(values) if prim["nodata"] is None else ~np.isnan(values) & (values != prim["nodata"])
        xs, ys = np.meshgrid(np.arange(window.rsx), np.arange(window.rsy))
        u, v = (snapped(np.asarray(c)) for c in fp.inverse(window.tlx + xs * window.dx + ys * window.rx, window.tly + xs * window.ry + ys * window.dy))
        kind = "cv_nearest" if fp.same_grid(window) else prim["interpolation"]
        if kind not in KERNELS:
            raise ValueError("the grids differ and no interpolation is given")
        out = resample_array(values, ok, (x0, y0), u.ravel(), v.ravel(), kind, nodata).reshape(out.shape)
    return out[0] if n == 1 else np.moveaxis(out, 0, 2)


def _checked(a, fp: Footprint, bands: int, dtype: str | None) -> np.ndarray:
    """A function's result as (band, Y, X), or an error where shape, channels or type are not as declared."""
    a = np.asarray(a)
    if a.ndim == 2:
        a = a[:, :, None]
    if a.shape != (*fp.shape, bands):
        raise ValueError(f"the function returned {a.shape} for a tile of {(*fp.shape, bands)}")
    if dtype is not None and not np.can_cast(a.dtype, np.dtype(dtype), "same_kind"):
        raise ValueError(f"the function returned {a.dtype} for a raster of {dtype}")
    return np.moveaxis(a.astype(dtype or float).astype(float), 2, 0)


class Delivery:
    """Arrays in the order asked for, at most ``max_queue_size`` ahead of the reader.  ``get`` waits for the next.

    Closing it, or letting go of it, cancels what is running.
    """

    def __init__(self, spark: SparkSession, jobs: Sequence[Callable[[], np.ndarray]], max_queue_size: int = 5) -> None:
        if max_queue_size < 1:
            raise ValueError("a queue holds one array at least")
        self._queue: queue.Queue = queue.Queue(max_queue_size)
        self._stop, self._left = threading.Event(), len(jobs)
        group = f"gridloom-{uuid.uuid4().hex}"
        self._end = weakref.finalize(self, Delivery._cancel, spark, group, self._stop)
        threading.Thread(target=Delivery._run, args=(spark, group, list(jobs), self._queue, self._stop), daemon=True).start()

    @staticmethod
    def _cancel(spark: SparkSession, group: str, stop: threading.Event) -> None:
        stop.set()
        if spark.sparkContext._jsc is not None:
            spark.sparkContext.cancelJobGroup(group)

    @staticmethod
    def _run(spark: SparkSession, group: str, jobs: list, out: queue.Queue, stop: threading.Event) -> None:
        spark.sparkContext.setJobGroup(group, "windows of a recipe", True)
        for job in jobs:
            try:
                item = (True, job())
            except Exception as e:  # handed to the reader, who raises it
                item = (False, e)
            while not stop.is_set():
                try:
                    out.put(item, timeout=0.1)
                    break
                except queue.Full:
                    continue
            if stop.is_set() or not item[0]:
                return

    def get(self, timeout: float | None = None) -> np.ndarray:
        if not self._left:
            raise StopIteration("all arrays were taken")
        ok, item = self._queue.get(timeout=timeout)
        self._left -= 1
        if not ok:
            self.close()
            raise item
        return item

    def __iter__(self) -> Iterator[np.ndarray]:
        while self._left:
            yield self.get()

    def close(self) -> None:
        self._left = 0
        self._end()


@dataclass
class Recipe:
    fp: Footprint
    compute: Callable  # (fp, {name: fp}, {name: array}, raster) -> (Y, X) or (Y, X, C) array
    primitives: dict[str, Primitive | DataFrame] = field(default_factory=dict)
    primitive_fps: dict[str, Footprint] = field(default_factory=dict)
    convert: dict[str, Callable] = field(default_factory=dict)
    tile: tuple[int, int] = (512, 512)
    computation: tuple[int, int] | None = None
    merge: Callable = concat_arrays
    cache: str | None = None
    overwrite: bool = False
    nodata: float = 0.0
    dtype: str | None = None
    channels: list[dict] = field(default_factory=lambda: channels_schema(1))
    observers: Sequence = ()

    def __len__(self) -> int:
        return len(self.channels)

    def _tell(self, event: str, *what) -> None:
        for o in self.observers:
            if hasattr(o, f"on_{event}"):
                getattr(o, f"on_{event}")(self, *what)

    def tile_fp(self, tx: int, ty: int) -> Footprint:
        return _part(self.fp, self.tile, tx, ty)

    def tiles(self, spark: SparkSession, window: Footprint | None = None) -> DataFrame:
        """(tx, ty) of the cache tiles, or of those that share a pixel with a window on the recipe's grid."""
        w, h = self.tile
        x0, y0, x1, y1 = 0, 0, self.fp.rsx, self.fp.rsy
        if window is not None:
            corners = [self.fp.inverse(*c) for c in window.corners]
            reach = 0 if self.fp.same_grid(window) else 5
            # a quarter of a pixel inward, so that tiles that only touch the window are left out
            x0, x1 = max(0, int(np.floor(min(c[0] for c in corners) + 0.25)) - reach), min(x1, int(np.ceil(max(c[0] for c in corners) - 0.25)) + reach)
            y0, y1 = max(0, int(np.floor(min(c[1] for c in corners) + 0.25)) - reach), min(y1, int(np.ceil(max(c[1] for c in corners) - 0.25)) + reach)
        if x0 >= x1 or y0 >= y1:
            return spark.createDataFrame([], "tx int, ty int")
        a, b = x0 // w, y0 // h
        nx, ny = -(-x1 // w) - a, -(-y1 // h) - b
        i = F.col("id")
        return spark.range(nx * ny).select((i % nx + a).cast("int").alias("tx"), (F.floor(i / nx) + b).cast("int").alias("ty"))

    def _primitives(self) -> dict[str, Primitive]:
        return {k: p if isinstance(p, Primitive) else Primitive.of_pixels(p, self.primitive_fps.get(k, self.fp), self.tile) for k, p in self.primitives.items()}

    def jobs(self, wanted: DataFrame) -> DataFrame:
        """(cx, cy) of the computation tiles under the tiles ``wanted`` (tx, ty)."""
        fp, (w, h), (cw, ch) = self.fp, self.tile, self.computation or self.tile
        wanted = wanted.select("tx", "ty").distinct()
        if (cw, ch) == (w, h):
            return wanted.select(F.col("tx").alias("cx"), F.col("ty").alias("cy"))
        lo = lambda t, n, c: F.floor(F.col(t) * n / c)
        hi = lambda t, n, c, most: F.floor((F.least((F.col(t) + 1) * n, F.lit(most)) - 1) / c)
        jobs = wanted.select(F.explode(F.sequence(lo("tx", w, cw), hi("tx", w, cw, fp.rsx))).alias("cx"), "ty").select("cx", F.explode(F.sequence(lo("ty", h, ch), hi("ty", h, ch, fp.rsy))).alias("cy"))
        return jobs.select(F.col("cx").cast("int").alias("cx"), F.col("cy").cast("int").alias("cy")).distinct()

    def needs(self, wanted: DataFrame) -> DataFrame:
        """(cx, cy, name, tx, ty): the tiles of each primitive that the computation tiles under ``wanted`` read, and one row with a null name for each of them."""
        fp, comp, convert = self.fp, self.computation or self.tile, dict(self.convert)
        plain = {k: {"fp": p.fp, "size": p.size, "interpolation": p.interpolation} for k, p in self._primitives().items()}

        def needs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for cx, cy in zip(b["cx"], b["cy"]):
                    out.append((cx, cy, None, None, None))
                    for name, p in plain.items():
                        window = convert.get(name, lambda f: f)(_part(fp, comp, cx, cy))
                        reach = 0 if p["fp"].same_grid(window) else KERNELS.get(p["interpolation"], 1) // 2 + 1
                        us, vs = zip(*[p["fp"].inverse(*c) for c in window.corners])
                        xs = range(max(0, int(np.floor(min(us) + 0.25)) - reach) // p["size"][0], (min(p["fp"].rsx, int(np.ceil(max(us) - 0.25)) + reach) - 1) // p["size"][0] + 1)
                        ys = range(max(0, int(np.floor(min(vs) + 0.25)) - reach) // p["size"][1], (min(p["fp"].rsy, int(np.ceil(max(vs) - 0.25)) + reach) - 1) // p["size"][1] + 1)
                        out += [(cx, cy, name, x, y) for x in xs for y in ys]
                got = pd.DataFrame(out, columns=["cx", "cy", "name", "tx", "ty"])
                yield got.astype({"tx": "Int32", "ty": "Int32"})

        return self.jobs(wanted).mapInPandas(needs, "cx int, cy int, name string, tx int, ty int")

    def computed(self, wanted: DataFrame, need: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        """(tx, ty, data) of the tiles in ``wanted``, each computed once, from what ``needs`` says and the primitives' tiles."""
        prims = self._primitives()
        plain = {k: {"fp": p.fp, "size": p.size, "channels": list(p.channels), "nodata": p.nodata, "dst_nodata": p.dst_nodata, "interpolation": p.interpolation} for k, p in prims.items()}
        fp, tile, comp, convert, compute, merge = self.fp, self.tile, self.computation or self.tile, dict(self.convert), self.compute, self.merge
        bands, dtype, missing = len(self.channels), self.dtype, self.nodata
        wanted = wanted.select("tx", "ty").distinct()
        (w, h), (cw, ch) = tile, comp
        rows = need.where("name is null").select("cx", "cy", "name", "tx", "ty", F.lit(None).cast("array<array<double>>").alias("data"))
        for name in prims:
            data = F.col("data") if "array<array" in tables[name].schema["data"].dataType.simpleString() else F.array("data")
            t = tables[name].select("tx", "ty", data.cast("array<array<double>>").alias("data"))
            rows = rows.unionByName(need.where(F.col("name") == name).join(t, ["tx", "ty"]).select("cx", "cy", "name", "tx", "ty", "data"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            cx, cy = int(pdf["cx"].iloc[0]), int(pdf["cy"].iloc[0])
            own, fps, arrays = _part(fp, comp, cx, cy), {}, {}
            for name, p in plain.items():
                fps[name] = convert.get(name, lambda f: f)(own)
                mine = pdf[pdf["name"] == name]
                arrays[name] = _window(p, dict(zip(zip(mine["tx"].astype(int), mine["ty"].astype(int)), mine["data"])), fps[name], missing)
            out = _checked(compute(own, fps, arrays, None), own, bands, dtype)
            return pd.DataFrame({"cx": [cx], "cy": [cy], "data": [[list(b.ravel()) for b in out]]})

        done = rows.groupBy("cx", "cy").applyInPandas(run, "cx int, cy int, data array<array<double>>")
        if comp == tile:
            return done.select(F.col("cx").alias("tx"), F.col("cy").alias("ty"), "data")
        at = lambda c, n, t: F.floor(F.col(c) * n / t)
        to = lambda c, n, t, most: F.floor((F.least((F.col(c) + 1) * n, F.lit(most)) - 1) / t)
        parts = done.withColumn("tx", F.explode(F.sequence(at("cx", cw, w), to("cx", cw, w, fp.rsx)))).withColumn("ty", F.explode(F.sequence(at("cy", ch, h), to("cy", ch, h, fp.rsy))))
        parts = parts.select(F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), "cx", "cy", "data").join(wanted, ["tx", "ty"], "left_semi")

        def put(pdf: pd.DataFrame) -> pd.DataFrame:
            tx, ty = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
            own, given = _part(fp, tile, tx, ty), {}
            for cx, cy, data in sorted(zip(pdf["cx"], pdf["cy"], pdf["data"]), key=lambda r: (r[1], r[0])):
                part = _part(fp, comp, int(cx), int(cy))
                a = np.stack([np.asarray(b, float).reshape(part.shape) for b in data], 2)
                x, y = (round(v) for v in part.inverse(own.tlx, own.tly))
                l, t = max(0, x), max(0, y)
                r, b = min(part.rsx, x + own.rsx), min(part.rsy, y + own.rsy)
                inner = a[t:b, l:r]
                given[part.clip(l, t, r, b)] = inner[:, :, 0] if bands == 1 else inner
            # a single part that is the whole tile needs no merging
            whole = next(iter(given.values())) if len(given) == 1 and next(iter(given)).shape == own.shape else merge(own, given, None)
            out = _checked(whole, own, bands, dtype)
            return pd.DataFrame({"tx": [tx], "ty": [ty], "data": [[list(b.ravel()) for b in out]]})

        return parts.groupBy("tx", "ty").applyInPandas(put, TILES)

    # --- cache -----------------------------------------------------------------------------------

    def _fs(self, spark: SparkSession, path: str):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p

    def _said(self) -> str:
        """What a cache must have been made for."""
        return json.dumps({"fp": asdict(self.fp), "tile": list(self.tile), "dtype": self.dtype, "channels": len(self.channels)}, sort_keys=True)

    def _open_cache(self, spark: SparkSession) -> bool:
        """Whether there is a cache; one of another footprint, tiling, type or number of channels is an error."""
        fs, p = self._fs(spark, self.cache)
        about = f"{self.cache}/_gridloom.json"
        if self.overwrite and fs.exists(p):
            fs.delete(p, True)
        self.overwrite = False
        if fs.exists(self._fs(spark, about)[1]):
            said = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(self._fs(spark, about)[1]), "UTF-8").strip()
            if said != self._said():
                raise ValueError(f"the cache holds {said}, not {self._said()}")
        else:
            fs.mkdirs(p)
            out = fs.create(self._fs(spark, about)[1], True)
            out.write(bytearray(self._said().encode()))
            out.close()
        return any(s.isDirectory() for s in fs.listStatus(p))

    def cached(self, spark: SparkSession) -> DataFrame:
        """The cache's tiles (tx, ty, data, sum)."""
        return spark.read.schema(TILES + ", sum long").parquet(self.cache)

    def ready(self, spark: SparkSession) -> DataFrame | None:
        """(tx, ty) of the cached tiles that are as they were written: whole, and of their checksum."""
        if not self._open_cache(spark):
            return None
        return self.cached(spark).where(F.col("sum") == F.xxhash64("data")).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("tx", "ty")

    def tile_table(self, spark: SparkSession, wanted: DataFrame | None = None) -> DataFrame:
        """(tx, ty, data) of the wanted tiles, all by default; with a cache, missing tiles are computed and kept first."""
        wanted = self.tiles(spark) if wanted is None else wanted.select("tx", "ty").distinct()
        return Demand(spark, self, wanted).table()

    def _kept(self, spark: SparkSession, made: DataFrame) -> None:
        """Write tiles to the cache; a tile is a partition, which replaces the one before."""
        made = made.withColumn("sum", F.xxhash64("data")).repartition("ty", "tx")
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ty", "tx").parquet(self.cache)

    # --- reads -----------------------------------------------------------------------------------

    def pixels(self, spark: SparkSession, wanted: DataFrame | None = None) -> DataFrame:
        """(px, py, value), with more than one channel (band, px, py, value), of the wanted tiles, all by default."""
        px = pixels_of_bands(self.tile_table(spark, wanted), self.fp, self.tile)
        return px.drop("band") if len(self.channels) == 1 else px

    def primitive(self, spark: SparkSession, channels: Sequence[int] = (0,), **how) -> Primitive:
        """This recipe as a primitive of another one."""
        return Primitive(None, self.fp, self.tile, channels, self.channels[0]["nodata"], recipe=self, **how)

    def read(self, spark: SparkSession, window: Footprint, channels: Sequence[int] = (0,), dst_nodata=None, interpolation: str | None = "cv_area") -> DataFrame:
        """(band, px, py, value) of every pixel of a window; tiles under it are computed by need."""
        t = self.tile_table(spark, self.tiles(spark, window))
        return read_tiles(t, self.tile, self.fp, window, channels, self.channels[0]["nodata"], dst_nodata, interpolation)

    def get_data(self, spark: SparkSession, window: Footprint | None = None, channels: Sequence[int] = (0,), dst_nodata=None, interpolation: str | None = "cv_area") -> np.ndarray:
        """(Y, X), for several channels (Y, X, C), of a window; its tiles come to the driver as arrays."""
        window = window or self.fp
        nodata = resolve_nodata(dst_nodata, self.channels[0]["nodata"])
        got = {(r["tx"], r["ty"]): r["data"] for r in self.tile_table(spark, self.tiles(spark, window)).toLocalIterator()}
        self._tell("window_read", window)
        how = {"fp": self.fp, "size": self.tile, "channels": list(channels), "nodata": self.channels[0]["nodata"], "dst_nodata": nodata, "interpolation": interpolation}
        return _window(how, got, window, nodata).astype(self.dtype or float)

    def queue_data(self, spark: SparkSession, windows: Sequence[Footprint], max_queue_size: int = 5, **how) -> Delivery:
        """The windows' arrays in their order, computed ahead of the reader by ``max_queue_size`` at most."""
        return Delivery(spark, [lambda w=w: self.get_data(spark, w, **how) for w in windows], max_queue_size)

    def iter_windows(self, spark: SparkSession, windows: Sequence[Footprint], max_queue_size: int = 5, **how) -> Iterator[np.ndarray]:
        """Arrays of the windows in the order asked for."""
        delivery = self.queue_data(spark, windows, max_queue_size, **how)
        try:
            yield from delivery
        finally:
            delivery.close()


class Demand:
    """What a read of some tiles of a recipe asks of every recipe behind it.

    Recipes are visited from the one that is read to those that it reads, each after all its readers: what they ask of it is put
    together (``asked``), tiles that its cache holds are taken off (``todo``), and the windows of what is left, carried through
    ``convert``, are what it asks of its own primitives (``need``).  Then tiles are made in the opposite order, each once, also where
    several recipes read the same one.  Tables of tile numbers are written, as they are used twice; so are the tiles of a recipe with several readers.
    """

    def __init__(self, spark: SparkSession, target: Recipe, wanted: DataFrame) -> None:
        self.spark, self.target, self.order = spark, target, readers_first(target)
        wants, self.readers = {id(target): [wanted.select("tx", "ty")]}, {}
        self.asked: dict[int, DataFrame] = {}
        self.todo: dict[int, DataFrame] = {}
        self.need: dict[int, DataFrame] = {}
        self.missing: dict[int, int] = {}
        for r in self.order:
            prims = r._primitives()
            alone = len(self.order) == 1 and r.cache is None and all(p.scan is None for p in prims.values())
            keep = (lambda df: df) if alone else cut
            asked = wants[id(r)][0]
            for more in wants[id(r)][1:]:
                asked = asked.unionByName(more)
            asked = todo = keep(asked.distinct())
            if r.cache is not None:
                ready = r.ready(spark)
                todo = asked if ready is None else cut(missing_tiles(asked, ready, "tx", "ty"))
                self.missing[id(r)] = todo.count()
                r._tell("cache_checked", self.missing[id(r)])
            need = keep(r.needs(todo))
            self.asked[id(r)], self.todo[id(r)], self.need[id(r)] = asked, todo, need
            for name, p in prims.items():
                if p.recipe is not None:
                    wants.setdefault(id(p.recipe), []).append(need.where(F.col("name") == name).select("tx", "ty"))
                    self.readers[id(p.recipe)] = self.readers.get(id(p.recipe), 0) + 1

    def table(self) -> DataFrame:
        """(tx, ty, data) of the tiles that were asked for; caches are filled on the way."""
        made: dict[int, DataFrame] = {}
        for r in reversed(self.order):
            k = id(r)
            need = self.need[k]
            tables = {n: made[id(p.recipe)] if p.recipe is not None else p.needed(need.where(F.col("name") == n)) for n, p in r._primitives().items()}
            if r.cache is None:
                out = r.computed(self.todo[k], need, tables)
                made[k] = cut(out) if self.readers.get(k, 0) > 1 else out
                continue
            if self.missing[k]:
                r._kept(self.spark, r.computed(self.todo[k], need, tables))
                r._tell("tiles_computed", self.missing[k])
            made[k] = r.cached(self.spark).join(self.asked[k], ["tx", "ty"], "left_semi").select("tx", "ty", "data")
        return made[id(self.target)]


def readers_first(target: Recipe) -> list[Recipe]:
    """The recipes behind ``target``, itself included, each after all that read it."""
    order: list[Recipe] = []
    done: set[int] = set()
    open_: set[int] = set()

    def visit(r: Recipe) -> None:
        if id(r) in open_:
            raise ValueError("recipes read each other in a circle")
        if id(r) not in done:
            open_.add(id(r))
            for p in r.primitives.values():
                if isinstance(p, Primitive) and p.recipe is not None:
                    visit(p.recipe)
            open_.remove(id(r))
            done.add(id(r))
            order.append(r)

    visit(target)
    return order[::-1]


def _part(fp: Footprint, size: tuple[int, int], tx: int, ty: int) -> Footprint:
    w, h = size
    return fp.clip(int(tx) * w, int(ty) * h, min((int(tx) + 1) * w, fp.rsx), min((int(ty) + 1) * h, fp.rsy))


def computation_order(windows: DataFrame) -> DataFrame:
    """(tx, ty, prod, rank) from (k, tx, ty): tiles in the order in which windows k ask for them, then northern ones last, then from west to east."""
    from ..plans.lineage import ranked

    f = windows.groupBy("tx", "ty").agg(F.min("k").alias("prod")).withColumn("__north", -F.col("ty"))
    return ranked(f, [], ["prod", "__north", "tx"], "rank").select("tx", "ty", "prod", "rank")


def merge_tiles(px: DataFrame, size: tuple[int, int], how: Callable) -> DataFrame:
    """(tx, ty, columns that ``how`` makes) of pixels (px, py, value): ``how`` maps the column of values to aggregates by name."""
    t = px.groupBy(F.floor(F.col("px") / size[0]).cast("int").alias("tx"), F.floor(F.col("py") / size[1]).cast("int").alias("ty"))
    return t.agg(*[c.alias(n) for n, c in how(F.col("value")).items()])
