"""The catalogue: sources of rasters and features by key, over one Spark session.

Opening a source reads its metadata; pixels and features are read by the jobs that need them.  A source
is a handle on a table of tiles or of features, so everything else in the library works on it, and its
own methods return either tables or, for one window, arrays.

References: a catalogue works in ``sr_work``; a source has a stored reference and a virtual one, which the
mode chooses (``srs.check_mode``).  Footprints and features are carried from the virtual reference to the
working one, pixels never are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .footprint import Footprint
from .functions import geometry as gm
from .functions import types as ty
from .operators import raster, rasterize, vector
from .operators import recipe as rc
from .sources import files, geojson, geotiff, shapefile, srs
from .sources.versioned import Versioned

TILE = 256
# Drivers by their names, and how the memory driver is called for either kind.
RASTER_DRIVERS = {"GTiff": "geotiff", "MEM": "memory", "numpy": "memory"}
VECTOR_DRIVERS = {"ESRI Shapefile": "shapefile", "GeoJSON": "geojson", "Memory": "memory"}
#: tables that are written to in place, by the tile or feature
RASTER_DRIVERS["tiles"] = VECTOR_DRIVERS["table"] = "versioned"
TILE_ROW = T.StructType().add("tx", T.IntegerType()).add("ty", T.IntegerType()).add("data", T.ArrayType(T.ArrayType(T.DoubleType())))


class Ending:
    """Called, it ends a source; as a context it ends it on leaving."""

    def __init__(self, end: Callable[[], None]) -> None:
        self._end, self._done = end, False

    def __call__(self) -> None:
        if not self._done:
            self._done = True
            self._end()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self()


class Source:
    """What rasters and vectors share."""

    def __init__(self, ds: "Dataset", driver: str, mode: str, path: str | None, stored: str | None, options: Sequence[str] = ()) -> None:
        if mode not in ("r", "w"):
            raise ValueError("mode is r or w")
        self.dataset, self.driver, self.mode, self.path, self.open_options = ds, driver, mode, path, tuple(options)
        self.wkt_stored = stored
        self.wkt_virtual = ds.virtual(stored)
        self.to_work, self.to_virtual = ds.transforms(self.wkt_virtual)
        self.close = Ending(self._close)
        self.delete = self.remove = Ending(self._delete)

    def get_keys(self) -> list:
        return [k for k, v in self.dataset.items() if v is self]

    proj4_stored = property(lambda self: srs.to_proj4(srs.parse(self.wkt_stored)) if self.wkt_stored else None)
    proj4_virtual = property(lambda self: srs.to_proj4(srs.parse(self.wkt_virtual)) if self.wkt_virtual else None)
    #: files are opened by tasks as they need them, so a source is never held open
    active = property(lambda self: not self.close._done)

    def activate(self) -> None:
        """Nothing to do: see ``active``."""

    deactivate = activate

    def _writable(self) -> None:
        if self.close._done:
            raise RuntimeError("the source is closed")
        if self.mode != "w":
            raise RuntimeError("the source was not opened for writing")

    def _close(self) -> None:
        self.dataset._forget(self)

    def _delete(self) -> None:
        self._writable()
        if self.path is None:
            raise RuntimeError("a source in memory has no file to delete")
        self._delete_files()
        self.close()

    def _delete_files(self) -> None:
        files.delete(self.path)


# --- rasters -------------------------------------------------------------------------------------


class Raster(Source):
    """A raster: ``tiles`` (tx, ty, data: bands of row-major values) of ``size`` on the grid of ``fp_stored``."""

    def __init__(self, ds: "Dataset", driver: str, mode: str, path: str | None, fp: Footprint, dtype: str, channels: list[dict], stored: str | None, tiles: Callable[..., DataFrame], size: tuple[int, int], options: Sequence[str] = ()) -> None:
        super().__init__(ds, driver, mode, path, stored, options)
        self.fp_stored, self.dtype, self.channels, self._tiles, self.size = fp, dtype, channels, tiles, size
        self.fp = fp if self.to_work is None else fp.convert(self.to_work)

    def __len__(self) -> int:
        return len(self.channels)

    nodata = property(lambda self: self.channels[0]["nodata"])

    def get_nodata(self, channel: int = 0):
        return self.channels[channel]["nodata"]

    @property
    def channels_schema(self) -> dict[str, list]:
        return {k: [c[k] for c in self.channels] for k in self.channels[0]}

    def tiles(self, window: tuple[int, int, int, int] | None = None) -> DataFrame:
        """(tx, ty, data) of the tiles that meet a half-open window (x0, y0, x1, y1) of pixels, all by default."""
        return self._tiles(window)

    def read(self, fp: Footprint | None = None, channels=None, dst_nodata=None, interpolation: str | None = "cv_area") -> DataFrame:
        """(band, px, py, value) of every pixel of a footprint in the working reference; ``band`` is the place in ``channels``."""
        fp = fp or self.fp
        ids, _ = ty.channel_ids(channels, len(self))
        if not self.fp.same_grid(fp) and not self.dataset.allow_interpolation:
            raise ValueError("the grids differ, and the catalogue does not allow interpolation")
        nodata = raster.resolve_nodata(dst_nodata, self.nodata)
        if not self.fp.share_area(fp):
            from .plans.grid import grid

            return grid(self.dataset.spark, fp.rsx, fp.rsy).select(F.explode(F.array(*[F.lit(k) for k in range(len(ids))])).alias("band"), "px", "py", F.lit(nodata).alias("value"))
        # only the blocks under the window are opened
        reach = 0 if self.fp.same_grid(fp) else raster.KERNELS.get(interpolation, 1) // 2 + 2
        us, vs = zip(*[self.fp.inverse(*c) for c in fp.corners])
        window = max(0, int(np.floor(min(us))) - reach), max(0, int(np.floor(min(vs))) - reach), min(self.fp.rsx, int(np.ceil(max(us))) + reach), min(self.fp.rsy, int(np.ceil(max(vs))) + reach)
        tiles = self.tiles(window)
        # arrays are scaled before anything is compared with nodata or resampled, files never
        if self.driver == "numpy" and any((c["scale"], c["offset"]) != (1.0, 0.0) for c in self.channels):
            bands = [F.transform(F.get("data", F.lit(k)), lambda v, c=c: v * c["scale"] + c["offset"]) for k, c in enumerate(self.channels)]
            tiles = tiles.withColumn("data", F.array(*bands))
        got = raster.read_tiles(tiles, self.size, self.fp, fp, ids, self.nodata, dst_nodata, interpolation)
        return got

    def get_data(self, fp: Footprint | None = None, channels=None, dst_nodata=None, interpolation: str | None = "cv_area") -> np.ndarray:
        """(Y, X) for one channel asked for by number or a raster of one, else (Y, X, C); the window comes to the driver."""
        fp = fp or self.fp
        ids, flat = ty.channel_ids(channels, len(self))
        out = np.zeros((*fp.shape, len(ids)))
        table = self.read(fp, channels, dst_nodata, interpolation).toArrow()
        b, x, y, v = (table.column(c).to_numpy() for c in ("band", "px", "py", "value"))
        out[y, x, b] = v
        out = out.astype(self.dtype)
        return out[:, :, 0] if flat else out

    def set_data(self, array: np.ndarray, fp: Footprint | None = None, channels=None, interpolation: str | None = "cv_area", mask=None) -> None:
        """Write an array, which lies on ``fp``, where it overlaps the raster.

        ``mask`` limits that: an array of booleans on ``fp``, or a geometry.  On another grid the array is
        resampled, and pixels whose kernel leaves the array or the mask are not written.
        """
        self._writable()
        fp = fp or self.fp
        ids, _ = ty.channel_ids(channels, len(self))
        if len(set(ids)) != len(ids):
            raise ValueError("a channel is written twice")
        a = np.asarray(array, float)
        a = a[:, :, None] if a.ndim == 2 else a
        if a.shape == (*fp.shape, 1) and len(ids) > 1:
            a = np.repeat(a, len(ids), axis=2)
        if a.shape != (*fp.shape, len(ids)):
            raise ValueError(f"an array of {a.shape} for {(*fp.shape, len(ids))}")
        if not self.fp.share_area(fp):
            return
        if not self.fp.same_grid(fp) and not self.dataset.allow_interpolation:
            raise ValueError("the grids differ, and the catalogue does not allow interpolation")
        if isinstance(mask, np.ndarray):
            a = np.where(mask[:, :, None], a, np.nan)
        spark = self.dataset.spark
        size = (TILE, TILE)
        window = self.fp & fp
        x0, y0 = (round(v) for v in self.fp.inverse(*window.tl))
        new = raster.read_tiles(array_tiles(spark, a, size), size, fp, window, list(range(len(ids))), None, float("nan"), interpolation)
        if mask is not None and not isinstance(mask, np.ndarray):
            shape = spark.createDataFrame([(0, gm.value_of(mask))], f"k int, geom {ty.GEOM.simpleString()}")
            new = new.join(rasterize.burn_polygons(shape, window, "k").select("px", "py").distinct(), ["px", "py"], "left_semi")
        place = F.element_at(F.array(*[F.lit(i) for i in ids]), F.col("band") + 1)
        new = new.where(~F.isnan("value")).select(place.alias("band"), (F.col("px") + x0).alias("px"), (F.col("py") + y0).alias("py"), "value")
        self._set(new, (x0, y0, x0 + window.rsx, y0 + window.rsy))

    def set_pixels(self, new: DataFrame) -> None:
        """Write a table of pixels (band, px, py, value) on the raster's own grid; those outside it, and null values, are passed over."""
        from .plans.lineage import cut

        self._writable()
        inside = F.col("px").between(0, self.fp.rsx - 1) & F.col("py").between(0, self.fp.rsy - 1) & F.col("band").between(0, len(self) - 1) & F.col("value").isNotNull()
        new = cut(new.where(inside).select(F.col("band").cast("int").alias("band"), F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), F.col("value").cast("double").alias("value")))
        box = new.agg(F.min("px"), F.min("py"), F.max("px") + 1, F.max("py") + 1).first()
        if box[0] is not None:
            self._set(new, tuple(box))

    def _set(self, new: DataFrame, window: tuple[int, int, int, int]) -> None:
        """Pixels of a window in their place: only their tiles are written where the driver can, else the raster."""
        if RASTER_DRIVERS[self.driver] != "versioned":
            self._write(raster.set_tiles(self.tiles(), self.size, self.fp, new, window, self.nodata or 0.0, len(self)))
            return
        since, _ = self.store.version()
        self.store.write(raster.changed_tiles(self._tiles(window, since), self.size, self.fp, new, self.nodata or 0.0, len(self)), since)

    def fill(self, value: float, channels=None) -> None:
        """Set channels to a value everywhere."""
        self._writable()
        ids, _ = ty.channel_ids(channels, len(self))
        wide, high = F.least(F.lit(self.size[0]), F.lit(self.fp.rsx) - F.col("tx") * self.size[0]), F.least(F.lit(self.size[1]), F.lit(self.fp.rsy) - F.col("ty") * self.size[1])
        bands = [F.array_repeat(F.lit(float(value)), (wide * high).cast("int")) if k in ids else F.get("data", F.lit(k)) for k in range(len(self))]
        self._write(self.tiles().select("tx", "ty", F.array(*bands).alias("data")))

    def _delete_files(self) -> None:
        self.store.delete() if RASTER_DRIVERS[self.driver] == "versioned" else files.delete(self.path)

    def _write(self, tiles: DataFrame) -> None:
        from .plans.lineage import cut

        if RASTER_DRIVERS[self.driver] == "versioned":
            self.store.replace(tiles)
            return
        kept = cut(tiles)
        if RASTER_DRIVERS[self.driver] == "geotiff":
            geotiff.write(kept, self.path, self.fp_stored, self.dtype, self.channels, self.wkt_stored, self.size[0])
        else:
            self._tiles = lambda window=None: kept if window is None else raster.window_tiles(kept, self.size, window)

    @property
    def array(self) -> np.ndarray:
        """The whole raster, brought to the driver: a copy."""
        return self.get_data()


def array_tiles(spark: SparkSession, a: np.ndarray, size: tuple[int, int]) -> DataFrame:
    """(tx, ty, data) of an array (Y, X, C)."""
    w, h = size
    rows = []
    for y in range(0, a.shape[0], h):
        for x in range(0, a.shape[1], w):
            part = np.asarray(a[y : y + h, x : x + w], float)
            rows.append((x // w, y // h, [part[:, :, b].ravel().tolist() for b in range(a.shape[2])]))
    return spark.createDataFrame(rows, "tx int, ty int, data array<array<double>>")


# --- vectors -------------------------------------------------------------------------------------


class Vector(Source):
    """A layer of features: ``features`` (fid, geom, fields)."""

    def __init__(self, ds: "Dataset", driver: str, mode: str, path: str | None, layer: str, type_: str, stored: str | None, schema: T.StructType, features: Callable[[], DataFrame], options: Sequence[str] = ()) -> None:
        super().__init__(ds, driver, mode, path, stored, options)
        self.layer, self.type, self.schema, self._features = layer, type_, schema, features

    @property
    def fields(self) -> list[dict]:
        return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable, **f.metadata} for f in self.schema if f.name not in ("fid", "geom")]

    def stored(self) -> DataFrame:
        return self._features()

    def features(self) -> DataFrame:
        """All features, in the working reference."""
        df = self.stored()
        return df if self.wkt_virtual is None or self.to_work is None else df.withColumn("geom", gm.transformed(F.col("geom"), srs.transform(srs.parse(self.wkt_virtual), srs.parse(self.dataset.sr_work))))

    def read(self, fields=-1, mask=None, clip: bool = False, slicing: slice = slice(0, None, 1)) -> DataFrame:
        """Features in order of fid: those that meet the mask, the slice of them, clipped; see ``vector.read``."""
        return vector.read(self.features(), fields, mask, clip, slicing, self.dataset.allow_none_geometry)

    def iter_data(self, fields=None, geom_type: str = "geojson", mask=None, clip: bool = False, slicing: slice = slice(0, None, 1)) -> Iterator:
        """Features one after another: the geometry alone where ``fields`` is None, else (geometry, *fields)."""
        names, flat = ty.field_names(fields, [f["name"] for f in self.fields])
        encode = {"geojson": gm.to_geojson, "wkt": gm.to_wkt, "coordinates": gm.to_coordinates}[geom_type]
        rows = self.read(fields, mask, clip, slicing).select("fid", encode(F.col("geom")).alias("geom"), *names).orderBy("fid")
        for r in rows.toLocalIterator(prefetchPartitions=True):
            yield r["geom"] if flat else tuple(r[n] for n in ("geom", *names))

    def get_data(self, index: int, fields=-1, geom_type: str = "geojson", mask=None, clip: bool = False):
        """The feature at an index after the filter."""
        for r in self.iter_data(fields, geom_type, mask, clip, slice(index, index + 1, 1)):
            return r
        raise IndexError(f"no feature {index}")

    def iter_geojson(self, mask=None, clip: bool = False, slicing: slice = slice(0, None, 1)) -> Iterator[dict]:
        import json

        for r in vector.geojson(self.read(-1, mask, clip, slicing)).orderBy("fid").toLocalIterator(prefetchPartitions=True):
            yield json.loads(r["feature"])

    def get_geojson(self, index: int, mask=None, clip: bool = False) -> dict:
        for r in self.iter_geojson(mask, clip, slice(index, index + 1, 1)):
            return r
        raise IndexError(f"no feature {index}")

    def __len__(self) -> int:
        return self.stored().count()

    @property
    def bounds_stored(self) -> tuple[float, float, float, float]:
        return tuple(vector.bounds(self.stored()).first())

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """(minx, miny, maxx, maxy); in the working reference the two corners of the stored box are carried over."""
        b = self.bounds_stored
        if self.to_work is None:
            return b
        (x0, y0), (x1, y1) = self.to_work([(b[0], b[1]), (b[2], b[3])])
        return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)

    @property
    def extent(self) -> tuple[float, float, float, float]:
        a, b, c, d = self.bounds
        return a, c, b, d

    @property
    def extent_stored(self) -> tuple[float, float, float, float]:
        a, b, c, d = self.bounds_stored
        return a, c, b, d

    def insert(self, rows: DataFrame) -> None:
        """Append rows (geom in the working reference, fields, optionally fid); see ``vector.insert``."""
        from .plans.lineage import cut

        self._writable()
        if self.to_virtual is not None:
            rows = rows.withColumn("geom", gm.transformed(F.col("geom"), srs.transform(srs.parse(self.dataset.sr_work), srs.parse(self.wkt_virtual))))
        if not self.dataset.allow_none_geometry:
            rows = rows.withColumn("geom", F.when(F.col("geom").isNull(), F.raise_error(F.lit("a geometry is null"))).otherwise(F.col("geom")))
        kind = VECTOR_DRIVERS[self.driver]
        if kind == "versioned":
            # the largest fid is on the list of parts, so no feature is read
            since, said = self.store.version()
            top = max((p["high"]["fid"] for p in said["parts"]), default=-1)
            self.store.write(vector.new_rows(rows, self.schema, top), since)
            return
        kept = cut(vector.insert(self.stored(), rows, self.schema))
        if kind == "shapefile":
            shapefile.delete(self.path)
            name, z = ty.geometry_type(self.type)
            shapefile.write(kept, self.path, name, z, self.wkt_stored)
        elif kind == "geojson":
            geojson.write(kept, self.path, wkt=self.wkt_stored)
        else:
            self._features = lambda: kept

    def remove_rows(self, fids: DataFrame) -> None:
        """Remove the features of a table of fids, from a layer that is written to in place."""
        self._writable()
        if VECTOR_DRIVERS[self.driver] != "versioned":
            raise RuntimeError(f"driver {self.driver!r} removes no features")
        self.store.remove(fids.select("fid"))

    def insert_data(self, geom, fields=(), index: int = -1) -> None:
        """Append one feature, or set the feature id: fields as a sequence in the layer's order or as a dict."""
        names = [f["name"] for f in self.fields]
        values = fields if isinstance(fields, dict) else dict(zip(names, fields))
        if not isinstance(fields, dict) and len(values) not in (0, len(names)):
            raise ValueError(f"{len(values)} values for {len(names)} fields")
        if unknown := set(values) - set(names):
            raise ValueError(f"no fields {sorted(unknown)}")
        own = [f for f in self.schema if f.name in values]
        schema = T.StructType([T.StructField("geom", ty.GEOM), *[T.StructField(f.name, f.dataType) for f in own], *([T.StructField("fid", T.LongType())] if index >= 0 else [])])
        row = (None if geom is None else gm.value_of(geom), *[values[f.name] for f in own], *([index] if index >= 0 else []))
        self.insert(self.dataset.spark.createDataFrame([row], schema))

    def _delete_files(self) -> None:
        if VECTOR_DRIVERS[self.driver] == "versioned":
            self.store.delete()
        else:
            shapefile.delete(self.path) if VECTOR_DRIVERS[self.driver] == "shapefile" else files.delete(self.path)


# --- recipes -------------------------------------------------------------------------------------


class RecipeRaster(Source):
    """A raster that a function computes; see ``operators.recipe``."""

    def __init__(self, ds: "Dataset", recipe: rc.Recipe, sr: str | None) -> None:
        super().__init__(ds, "recipe", "r", None, sr)
        self.recipe, self.fp_stored, self.fp, self.dtype, self.channels = recipe, recipe.fp, recipe.fp, recipe.dtype, recipe.channels

    def __len__(self) -> int:
        return len(self.channels)

    nodata = property(lambda self: self.channels[0]["nodata"])
    channels_schema = Raster.channels_schema
    get_nodata = Raster.get_nodata
    primitives = property(lambda self: dict(self.recipe.primitives))
    cache_tiles = property(lambda self: self.recipe.tile)
    cache_dir = property(lambda self: self.recipe.cache)

    def _how(self, channels, dst_nodata, interpolation) -> tuple[dict, bool]:
        ids, flat = ty.channel_ids(channels, len(self))
        return {"channels": ids, "dst_nodata": dst_nodata, "interpolation": interpolation}, flat

    def read(self, fp: Footprint | None = None, channels=None, dst_nodata=None, interpolation: str | None = "cv_area") -> DataFrame:
        return self.recipe.read(self.dataset.spark, fp or self.fp, **self._how(channels, dst_nodata, interpolation)[0])

    def _shaped(self, a: np.ndarray, flat: bool) -> np.ndarray:
        return a if flat or a.ndim == 3 else a[:, :, None]

    def get_data(self, fp: Footprint | None = None, channels=None, dst_nodata=None, interpolation: str | None = "cv_area") -> np.ndarray:
        how, flat = self._how(channels, dst_nodata, interpolation)
        return self._shaped(self.recipe.get_data(self.dataset.spark, fp or self.fp, **how), flat)

    def queue_data(self, fps: Sequence[Footprint], channels=None, dst_nodata=None, interpolation: str | None = "cv_area", max_queue_size: int = 5) -> rc.Delivery:
        return rc.Delivery(self.dataset.spark, [lambda f=f: self.get_data(f, channels, dst_nodata, interpolation) for f in fps], max_queue_size)

    def iter_data(self, fps: Sequence[Footprint], channels=None, dst_nodata=None, interpolation: str | None = "cv_area", max_queue_size: int = 5) -> Iterator[np.ndarray]:
        d = self.queue_data(fps, channels, dst_nodata, interpolation, max_queue_size)
        try:
            yield from d
        finally:
            d.close()


# --- the catalogue -------------------------------------------------------------------------------


class Dataset:
    """Sources by key; keys are any hashable values, strings that are names can be read as attributes."""

    def __init__(self, spark: SparkSession | None = None, sr_work: str | None = None, sr_fallback: str | None = None, sr_forced: str | None = None, analyse_transformation: bool = True, allow_none_geometry: bool = False, allow_interpolation: bool = False, max_active: float = float("inf"), observers: Sequence = ()) -> None:
        self._sources: dict = {}
        self.sr_mode = srs.check_mode(sr_work, sr_fallback, sr_forced)
        self.spark = spark or SparkSession.active()
        self.sr_work, self.sr_fallback, self.sr_forced = sr_work, sr_fallback, sr_forced
        self.analyse_transformation, self.allow_none_geometry, self.allow_interpolation, self.max_active, self.observers = analyse_transformation, allow_none_geometry, allow_interpolation, max_active, tuple(observers)
        self.close = Ending(self._close)

    # references

    def virtual(self, stored: str | None) -> str | None:
        if self.sr_mode == 1:
            return stored
        found = self.sr_forced if self.sr_mode == 4 else stored if stored is not None else self.sr_fallback
        if found is None:
            raise ValueError("the source has no reference, and the catalogue names none for such sources")
        return found

    def transforms(self, virtual: str | None) -> tuple[Callable | None, Callable | None]:
        """The functions to the working reference and back; None where nothing is to be done."""
        if self.sr_mode == 1 or virtual is None:
            return None, None
        a, b = srs.parse(virtual), srs.parse(self.sr_work)
        return (None, None) if a == b else (srs.transform_points(a, b), srs.transform_points(b, a))

    def _analysed(self, source, bounds) -> None:
        if self.analyse_transformation and source.to_work is not None:
            found = srs.analyse(source.to_work, source.to_virtual, bounds)
            if not (found.finite and found.inverse):
                raise ValueError("; ".join(found.messages))

    # registry

    def _add(self, key, source):
        if key in self._sources:
            source.close._done = True
            raise ValueError(f"the key {key!r} is taken")
        self._sources[key] = source
        return source

    def _free(self, key) -> None:
        if key in self._sources:
            raise ValueError(f"the key {key!r} is taken")

    def _forget(self, source) -> None:
        self._sources = {k: v for k, v in self._sources.items() if v is not source}

    def _close(self) -> None:
        for s in list(self._sources.values()):
            s.close()

    def __getitem__(self, key):
        return self._sources[key]

    def get(self, key, default=None):
        return self._sources.get(key, default)

    def __contains__(self, item) -> bool:
        return any(item is v for v in self._sources.values()) if isinstance(item, Source) else item in self._sources

    def __getattr__(self, name: str):
        if not name.startswith("_") and name in self.__dict__.get("_sources", {}):
            return self._sources[name]
        raise AttributeError(name)

    def __len__(self) -> int:
        return len(self._sources)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    keys = lambda self: self._sources.keys()
    values = lambda self: self._sources.values()
    items = lambda self: self._sources.items()
    active_count = property(lambda self: sum(s.active for s in self._sources.values()))

    def activate_all(self) -> None:
        for s in self._sources.values():
            s.activate()

    def deactivate_all(self) -> None:
        for s in self._sources.values():
            s.deactivate()

    # rasters

    def open_raster(self, key, path: str, driver: str = "GTiff", options: Sequence[str] = (), mode: str = "r") -> Raster:
        self._free(key)
        if RASTER_DRIVERS.get(driver) == "versioned":
            return self._add(key, self._open_tiles(driver, path, options, mode))
        if RASTER_DRIVERS.get(driver) != "geotiff":
            raise ValueError(f"driver {driver!r} opens no file")
        if not files.exists(path):
            raise RuntimeError(f"no file {path}")
        i = geotiff.read_info(path)
        if mode == "w" and (not i.tiled or i.block[0] != i.block[1]):
            raise ValueError("only files of square tiles can be written to")
        found = Raster(self, driver, mode, path, i.fp, i.dtype, i.channels, i.wkt, lambda window=None: geotiff.read(self.spark, path, window), i.block, options)
        self._analysed(found, i.fp.bounds)
        return self._add(key, found)

    def create_raster(self, key, path: str, fp: Footprint, dtype: str, channel_count: int, channels_schema: dict | None = None, driver: str = "GTiff", options: Sequence[str] = (), sr: str | None = None, ow: bool = False) -> Raster:
        """A new raster, of nodata or 0; ``fp`` is in the working reference.  A file that is there is an error unless ``ow``."""
        self._free(key)
        if driver not in RASTER_DRIVERS:
            raise ValueError(f"no driver {driver!r}")
        channels = ty.channels_schema(channel_count, channels_schema)
        ty.pixel_type(dtype)
        _, to_virtual = self.transforms(self.virtual(sr))
        stored = fp if to_virtual is None else fp.convert(to_virtual)
        if RASTER_DRIVERS[driver] == "memory":
            empty = self._blank(stored, channels)
            return self._add(key, Raster(self, driver, "w", None, stored, dtype, channels, sr, empty, (TILE, TILE), options))
        if RASTER_DRIVERS[driver] == "versioned":
            if ow and Versioned(self.spark, path).exists():
                Versioned(self.spark, path).delete()
            about = {"fp": asdict(stored), "dtype": dtype, "channels": channels, "wkt": sr, "size": [TILE, TILE]}
            Versioned.create(self.spark, path, TILE_ROW, ("tx", "ty"), about)
            return self.open_raster(key, path, driver, options, "w")
        if files.exists(path):
            if not ow:
                raise RuntimeError(f"{path} exists")
            files.delete(path)
        geotiff.write(self._blank(stored, channels)(), path, stored, dtype, channels, sr, TILE)
        return self.open_raster(key, path, driver, options, "w")

    def _open_tiles(self, driver: str, path: str, options: Sequence[str], mode: str) -> Raster:
        """A raster of a versioned table; an option ``version=n`` opens an older state, to be read.  Tiles that were never written are blank."""
        store, version = Versioned(self.spark, path), _version_of(options)
        if version is not None and mode == "w":
            raise ValueError("an older version can't be written to")
        about = store.about(version)
        fp, size, channels = Footprint(**about["fp"]), tuple(about["size"]), about["channels"]
        blank = self._blank(fp, channels)

        def tiles(window=None, at: int | None = None) -> DataFrame:
            ranges = None if window is None else {"tx": (window[0] // size[0], (window[2] - 1) // size[0]), "ty": (window[1] // size[1], (window[3] - 1) // size[1])}
            there = store.read(version if at is None else at, ranges).withColumnRenamed("data", "__data")
            return blank(window).join(there, ["tx", "ty"], "left").select("tx", "ty", F.coalesce("__data", "data").alias("data"))

        found = Raster(self, driver, mode, path, fp, about["dtype"], channels, about["wkt"], tiles, size, options)
        found.store = store
        return found

    def _blank(self, fp: Footprint, channels: list[dict]) -> Callable[..., DataFrame]:
        def tiles(window=None) -> DataFrame:
            nx, ny = -(-fp.rsx // TILE), -(-fp.rsy // TILE)
            i = F.col("id")
            t = self.spark.range(nx * ny).select((i % nx).cast("int").alias("tx"), F.floor(i / nx).cast("int").alias("ty"))
            n = F.least(F.lit(TILE), F.lit(fp.rsx) - F.col("tx") * TILE) * F.least(F.lit(TILE), F.lit(fp.rsy) - F.col("ty") * TILE)
            t = t.select("tx", "ty", F.array(*[F.array_repeat(F.lit(float(c["nodata"] or 0)), n.cast("int")) for c in channels]).alias("data"))
            return t if window is None else raster.window_tiles(t, (TILE, TILE), window)

        return tiles

    def wrap_numpy_raster(self, key, fp: Footprint, array: np.ndarray, channels_schema: dict | None = None, sr: str | None = None, mode: str = "w") -> Raster:
        """A raster of an array (Y, X) or (Y, X, C), which is copied."""
        self._free(key)
        a = np.asarray(array)
        if a.ndim not in (2, 3) or a.shape[:2] != fp.shape:
            raise ValueError(f"an array of {a.shape} for a footprint of {fp.shape}")
        channels = ty.channels_schema(1 if a.ndim == 2 else a.shape[2], channels_schema)
        _, to_virtual = self.transforms(self.virtual(sr))
        stored = fp if to_virtual is None else fp.convert(to_virtual)
        held = array_tiles(self.spark, a.reshape(*fp.shape, -1), (TILE, TILE))
        return self._add(key, Raster(self, "numpy", mode, None, stored, a.dtype.name, channels, sr, lambda window=None: held if window is None else raster.window_tiles(held, (TILE, TILE), window), (TILE, TILE)))

    # recipes

    def create_raster_recipe(self, key, fp: Footprint, dtype: str, channel_count: int, channels_schema: dict | None = None, sr: str | None = None, compute_array: Callable | None = None, merge_arrays: Callable = rc.concat_arrays, queue_data_per_primitive: dict | None = None, convert_footprint_per_primitive: dict | None = None, computation_tiles: tuple[int, int] | None = None, observers: Sequence = (), **pools) -> RecipeRaster:
        return self._recipe(key, fp, dtype, channel_count, channels_schema, sr, compute_array, merge_arrays, None, False, queue_data_per_primitive, convert_footprint_per_primitive, computation_tiles or (512, 512), None, observers, pools)

    def create_cached_raster_recipe(self, key, fp: Footprint, dtype: str, channel_count: int, channels_schema: dict | None = None, sr: str | None = None, compute_array: Callable | None = None, merge_arrays: Callable = rc.concat_arrays, cache_dir: str | None = None, ow: bool = False, queue_data_per_primitive: dict | None = None, convert_footprint_per_primitive: dict | None = None, cache_tiles: tuple[int, int] = (512, 512), computation_tiles: tuple[int, int] | None = None, observers: Sequence = (), **pools) -> RecipeRaster:
        if cache_dir is None:
            raise ValueError("a cache needs a folder, which executors share")
        return self._recipe(key, fp, dtype, channel_count, channels_schema, sr, compute_array, merge_arrays, cache_dir, ow, queue_data_per_primitive, convert_footprint_per_primitive, cache_tiles, computation_tiles, observers, pools)

    def _recipe(self, key, fp, dtype, count, schema, sr, compute, merge, cache, ow, primitives, convert, tile, computation, observers, pools) -> RecipeRaster:
        self._free(key)
        if not callable(compute) or not callable(merge):
            raise TypeError("a recipe needs a function")
        #: the names of pools and limits of other engines are taken and have no effect: tasks run where Spark has room
        if unknown := set(pools) - {"computation_pool", "merge_pool", "io_pool", "resample_pool", "max_resampling_size"}:
            raise TypeError(f"unknown {sorted(unknown)}")
        primitives, convert = primitives or {}, convert or {}
        if unknown := set(convert) - set(primitives):
            raise ValueError(f"no primitives {sorted(unknown)}")
        channels = ty.channels_schema(count, schema)
        bound = {}
        for name, p in primitives.items():
            source, how = primitive_of(p)
            if source.dataset is not self:
                raise ValueError("a primitive belongs to another catalogue")
            ids, _ = ty.channel_ids(how.pop("channels", None), len(source))
            if isinstance(source, RecipeRaster):
                bound[name] = source.recipe.primitive(self.spark, ids, **how)
            else:
                bound[name] = rc.Primitive(None, source.fp, source.size, ids, source.nodata, scan=source.tiles, **how)
        recipe = rc.Recipe(fp, compute, bound, {}, dict(convert), tuple(tile), None if computation is None else tuple(computation), merge, cache, ow, channels[0]["nodata"] or 0.0, dtype, channels, (*self.observers, *observers))
        return self._add(key, RecipeRaster(self, recipe, sr))

    # vectors

    def open_vector(self, key, path: str, layer: str | int | None = None, driver: str = "ESRI Shapefile", options: Sequence[str] = (), mode: str = "r") -> Vector:
        self._free(key)
        kind = VECTOR_DRIVERS.get(driver)
        if kind == "versioned":
            store, version = Versioned(self.spark, path), _version_of(options)
            about = store.about(version)
            if layer not in (None, 0, about["layer"]):
                raise ValueError(f"no layer {layer!r}, only {about['layer']!r}")
            if version is not None and mode == "w":
                raise ValueError("an older version can't be written to")
            found = Vector(self, driver, mode, path, about["layer"], about["type"], about["wkt"], T.StructType.fromJson(about["schema"]), lambda: store.read(version), options)
            found.store = store
            return self._add(key, found)
        if kind not in ("shapefile", "geojson"):
            raise ValueError(f"driver {driver!r} opens no file")
        name = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        if layer not in (None, 0, name):
            raise ValueError(f"no layer {layer!r}, only {name!r}")
        there = shapefile.stem(path) + ".shp" if kind == "shapefile" else path
        if not files.exists(there):
            raise RuntimeError(f"no file {path}")
        if kind == "shapefile":
            i = shapefile.read_info(path)
            type_, z = shapefile.SHAPES[i.kind]
            found = Vector(self, driver, mode, path, name, type_ + "25D" * z, i.wkt, i.schema, lambda: shapefile.read(self.spark, path), options)
        else:
            schema = geojson.read(self.spark, path).schema
            fields = T.StructType([f for f in schema if f.name not in ("fid", "geom")])
            found = Vector(self, driver, mode, path, name, "Unknown", geojson.reference(path), schema, lambda: geojson.read(self.spark, path, fields), options)
        return self._add(key, found)

    def create_vector(self, key, path: str, type: str, fields: Sequence[dict] = (), layer: str | None = None, driver: str = "ESRI Shapefile", options: Sequence[str] = (), sr: str | None = None, ow: bool = False) -> Vector:
        """A new layer without features; ``fields`` have name and type, and may have nullable, precision, width and default."""
        self._free(key)
        if driver not in VECTOR_DRIVERS:
            raise ValueError(f"no driver {driver!r}")
        kind, name = VECTOR_DRIVERS[driver], (path or "layer").rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        geometry, z = ty.geometry_type(type)
        own = [ty.field(f["name"], f["type"], f.get("nullable", True), f.get("precision"), f.get("width"), f.get("default")) for f in fields]
        schema = T.StructType([T.StructField("fid", T.LongType()), T.StructField("geom", ty.GEOM), *own])
        empty = self.spark.createDataFrame([], schema)
        self.virtual(sr)
        if kind == "memory":
            return self._add(key, Vector(self, driver, "w", None, layer or name, type, sr, schema, lambda: empty, options))
        if kind == "versioned":
            if ow and Versioned(self.spark, path).exists():
                Versioned(self.spark, path).delete()
            Versioned.create(self.spark, path, schema, ("fid",), {"layer": layer or name, "type": type, "wkt": sr, "schema": schema.jsonValue()})
            return self.open_vector(key, path, None, driver, options, "w")
        there = shapefile.stem(path) + ".shp" if kind == "shapefile" else path
        if files.exists(there):
            if not ow:
                raise RuntimeError(f"{path} exists")
            shapefile.delete(path) if kind == "shapefile" else files.delete(path)
        if kind == "shapefile":
            shapefile.write(empty, path, geometry, z, sr)
        else:
            geojson.write(empty, path, wkt=sr)
        found = self.open_vector(key, path, None, driver, options, "w")
        found.type, found.schema = type, schema
        if kind == "geojson":
            names = T.StructType(own)
            found._features = lambda: geojson.read(self.spark, path, names)
        return found


def _version_of(options: Sequence[str]) -> int | None:
    """The number that an option ``version=n`` names."""
    named = [o.partition("=")[2] for o in options if o.partition("=")[0].lower() == "version"]
    return int(named[-1]) if named else None


def primitive_of(p) -> tuple[Source, dict]:
    """The source and the reading parameters of a primitive: a source, a method of one, or a partial call of such a method."""
    from functools import partial

    how = {}
    while isinstance(p, partial):
        how = {**p.keywords, **how}
        p = p.func
    source = getattr(p, "__self__", p)
    if not isinstance(source, (Raster, RecipeRaster)):
        raise TypeError("a primitive is a raster, or a method of one that reads data")
    how.pop("max_queue_size", None)
    return source, how


def _anonymous(name: str) -> Callable:
    def run(self, *args, **kwargs):
        return getattr(self, name)(f"anonymous-{uuid.uuid4().hex}", *args, **kwargs)

    run.__doc__ = f"``{name}`` without a key."
    return run


for _name in ("open_raster", "create_raster", "wrap_numpy_raster", "open_vector", "create_vector", "create_raster_recipe", "create_cached_raster_recipe"):
    setattr(Dataset, f"a{_name}", _anonymous(_name))


def _shortcut(name: str) -> Callable:
    def run(*args, **kwargs):
        return getattr(Dataset(allow_interpolation=True), f"a{name}")(*args, **kwargs)

    run.__doc__ = f"``Dataset.a{name}`` in a catalogue of its own."
    return run


open_raster, create_raster, wrap_numpy_raster, open_vector, create_vector = map(_shortcut, ("open_raster", "create_raster", "wrap_numpy_raster", "open_vector", "create_vector"))
