"""Features as rows (fid, geom, fields): filtered, clipped, sliced and projected reads, and inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geometry as gm
from ..functions import plane
from ..functions.types import field_names
from ..plans.spread import once

def mask_of(mask) -> gm.Mask | None:
    """The mask's polygon: an extent (minx, maxx, miny, maxy), a footprint, turned or not, a polygon as a GeoJSON-like dict or object, or None."""
    if mask is None or isinstance(mask, gm.Mask):
        return mask
    if hasattr(mask, "corners"):
        return gm.Mask([mask.corners])
    if isinstance(mask, (tuple, list)):
        a, b, c, d = mask
        if a > b or c > d:
            raise ValueError("an extent is (minx, maxx, miny, maxy)")
        return gm.Mask([[(a, c), (b, c), (b, d), (a, d)]])
    g = mask if isinstance(mask, dict) else mask.__geo_interface__
    if g["type"] != "Polygon":
        raise ValueError("a mask is a polygon")
    return gm.Mask([[tuple(p[:2]) for p in r] for r in g["coordinates"]])


def read(features: DataFrame, fields=-1, mask=None, do_clip: bool = False, slicing: slice = slice(0, None, 1), allow_none: bool = False, geom: str = "geom", fid: str = "fid") -> DataFrame:
    """Features in order of fid: those that meet the mask, then the slice of them, then the clip and the fields.

    A null geometry is an error unless allowed, and then meets no mask.
    """
    names = [c for c in features.columns if c not in (geom, fid)]
    wanted, _ = field_names(fields, names)
    where = mask_of(mask)
    g = F.col(geom)
    if not allow_none:
        g = F.when(g.isNull(), F.raise_error(F.lit("a geometry is null"))).otherwise(g)
    if where is not None:
        # the geometry, then its box, so that a filter makes neither again for each of its terms
        features = once(features, **{geom: g})
        features = once(features, __gl_box=F.when(F.col(geom).isNotNull(), F.array(*gm.bbox(F.col(geom)))))
        features = features.where(F.col("__gl_box").isNotNull() & gm.intersects(F.col(geom), where, F.col("__gl_box"))).drop("__gl_box")
    elif not allow_none:
        features = features.withColumn(geom, g)
    start, stop, step = slicing.start or 0, slicing.stop, slicing.step or 1
    if start < 0 or (stop is not None and stop < 0) or step < 1:
        raise ValueError("slices run forward from 0")
    if (start, stop, step) != (0, None, 1):
        if step == 1:  # offset and limit need no rank
            features = features.orderBy(fid).offset(start)
            features = features if stop is None else features.limit(max(0, stop - start))
        else:
            from ..plans.lineage import ranked

            f = ranked(features.withColumn("__one", F.lit(0)), ["__one"], [fid], "__i").drop("__one")
            keep = (F.col("__i") >= start) & ((F.col("__i") - start) % step == 0)
            features = f.where(keep if stop is None else keep & (F.col("__i") < stop)).drop("__i")
    if not do_clip or where is None:
        return features.select(fid, geom, *wanted)
    # convex polygons are cut by a box as expressions; all others go through Arrow batches, where the rest is null
    features = plane.with_cuts(features, gm.to_cut(F.col(geom), where), where.rings, "__gl_cut")
    return features.select(fid, gm.clip(F.col(geom), where, F.col("__gl_cut")).alias(geom), *wanted)


def get(features: DataFrame, index: int, **how) -> DataFrame:
    """The feature at ``index`` after the filter."""
    return read(features, slicing=slice(index, index + 1, 1), **how)


def geojson(features: DataFrame, geom: str = "geom", fid: str = "fid") -> DataFrame:
    """(fid, feature): GeoJSON features with all fields as properties."""
    names = [c for c in features.columns if c not in (geom, fid)]
    props = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    return features.select(fid, F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), F.coalesce(gm.to_geojson(F.col(geom)), F.lit("null")), F.lit("}")).alias("feature"))


def bounds(features: DataFrame, geom: str = "geom") -> DataFrame:
    """(minx, miny, maxx, maxy) over all features."""
    b = gm.bbox(F.col(geom))
    return features.agg(F.min(b[0]).alias("minx"), F.min(b[1]).alias("miny"), F.max(b[2]).alias("maxx"), F.max(b[3]).alias("maxy"))


def new_rows(rows: DataFrame, schema: StructType, top: int, geom: str = "geom", fid: str = "fid") -> DataFrame:
    """``rows`` as a layer of ``schema`` takes them: values are cast, missing fields take their defaults, null in a field that forbids it fails.

    Rows without a fid are numbered after ``top``, by their position in the input.
    """
    cols = []
    for f in schema:
        if f.name in (geom, fid):
            continue
        v = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(f.metadata.get("default")).cast(f.dataType)
        if not f.nullable:
            v = F.when(v.isNull(), F.raise_error(F.lit(f"{f.name} is null")).cast(f.dataType)).otherwise(v)
        cols.append(v.alias(f.name))
    g = F.col(geom) if geom in rows.columns else F.lit(None).cast(schema[geom].dataType)
    if fid in rows.columns:
        return rows.select(F.col(fid).cast("long").alias(fid), g.alias(geom), *cols)
    from ..plans.lineage import ranked

    new = ranked(rows.select(g.alias(geom), *cols).withColumn("__m", F.monotonically_increasing_id()), [], ["__m"], "__n", 1).drop("__m")
    return new.withColumn(fid, F.lit(top) + F.col("__n")).drop("__n")


def insert(features: DataFrame, rows: DataFrame, schema: StructType | None = None, geom: str = "geom", fid: str = "fid") -> DataFrame:
    """``features`` with ``rows`` appended; see ``new_rows``."""
    top = -1 if fid in rows.columns else features.agg(F.coalesce(F.max(fid), F.lit(-1))).first()[0]
    return features.unionByName(new_rows(rows, schema or features.schema, top, geom, fid).select(*features.columns))
