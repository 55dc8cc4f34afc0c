"""Shapefiles as tables of features, read and written by many tasks.

Reading: the index gives each record's place, so a partition is a run of records.  Writing: tasks encode
records into part files, and the driver numbers and joins them, and writes index, attributes and reference.
"""

from __future__ import annotations

import base64
import pickle
import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.types import GEOM
from . import files

# Fixed values of the format: shapes by number (type, has z); a line or a polygon may have several parts.
SHAPES = {1: ("Point", False), 3: ("LineString", False), 5: ("Polygon", False), 8: ("MultiPoint", False), 11: ("Point", True), 13: ("LineString", True), 15: ("Polygon", True), 18: ("MultiPoint", True)}
RECORDS = 20_000
Ring = list[tuple[float, float, float]]


def signed_area(ring: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def inside(p: tuple, ring: Ring) -> bool:
    odd = False
    for a, b in zip(ring, ring[1:]):
        if (a[1] <= p[1]) != (b[1] <= p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
            odd = not odd
    return odd


def polygons(rings: list[Ring]) -> list[list[Ring]]:
    """Rings dealt to polygons: those that turn clockwise are outer ones, the others are holes of the smallest outer ring around them.

    Where no ring turns clockwise, each is a polygon.
    """
    outer, holes = [[r] for r in rings if signed_area(r) <= 0], [r for r in rings if signed_area(r) > 0]
    if not outer:
        return [[r] for r in rings]
    for hole in holes:
        around = [p for p in outer if inside(hole[0], p[0])] or outer[:1]
        min(around, key=lambda p: abs(signed_area(p[0]))).append(hole)
    return outer


def decode(body: bytes) -> dict | None:
    """The geometry struct's value for a record's content."""
    kind = struct.unpack_from("<i", body)[0]
    if kind == 0:
        return None
    name, z = SHAPES[kind]
    if name == "Point":
        x, y, *rest = struct.unpack_from("<3d" if z else "<2d", body, 4)
        parts = [[[(x, y, rest[0] if rest else 0.0)]]]
    else:
        multi = name == "MultiPoint"
        n_parts, n = (1, struct.unpack_from("<i", body, 36)[0]) if multi else struct.unpack_from("<2i", body, 36)
        at = 40 if multi else 44 + 4 * n_parts
        starts = [0] if multi else list(struct.unpack_from(f"<{n_parts}i", body, 44))
        xy = struct.unpack_from(f"<{2 * n}d", body, at)
        zs = struct.unpack_from(f"<{n}d", body, at + 16 * n + 16) if z else (0.0,) * n
        points = list(zip(xy[::2], xy[1::2], zs))
        rings = [points[a:b] for a, b in zip(starts, [*starts[1:], n])]
        if multi:
            parts = [[[p]] for p in points]
        elif name == "Polygon":
            parts = polygons(rings)
            name = "Polygon" if len(parts) == 1 else "MultiPolygon"
        else:
            parts = [[r] for r in rings]
            name = "LineString" if len(parts) == 1 else "MultiLineString"
    return {"type": name, "has_z": z, "parts": [[[dict(zip("xyz", p)) for p in ring] for ring in part] for part in parts]}


def encode(geom, kind: int) -> tuple[bytes, tuple[float, float, float, float] | None]:
    """A record's content and its box."""
    if geom is None or not geom["parts"]:
        return struct.pack("<i", 0), None
    z = SHAPES[kind][1]
    rings = [[(p["x"], p["y"], p["z"] or 0.0) for p in ring] for part in geom["parts"] for ring in part]
    if SHAPES[kind][0] == "Polygon":
        first = {id(r) for r in (part_rings(geom, rings))}
        rings = [r if (signed_area(r) <= 0) == (id(r) in first) else r[::-1] for r in rings]
    points = [p for r in rings for p in r]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    box = min(xs), min(ys), max(xs), max(ys)
    if SHAPES[kind][0] == "Point":
        x, y, h = points[0]
        return struct.pack("<i2d", kind, x, y) + (struct.pack("<2d", h, 0.0) if z else b""), box
    body = struct.pack("<i4d", kind, *box)
    if SHAPES[kind][0] == "MultiPoint":
        body += struct.pack("<i", len(points))
    else:
        starts = [0]
        for r in rings[:-1]:
            starts.append(starts[-1] + len(r))
        body += struct.pack(f"<2i{len(rings)}i", len(rings), len(points), *starts)
    body += struct.pack(f"<{2 * len(points)}d", *[v for p in points for v in p[:2]])
    if z:
        zs = [p[2] for p in points]
        body += struct.pack(f"<{2 + len(zs)}d", min(zs), max(zs), *zs)
        body += struct.pack(f"<{2 + len(zs)}d", 0.0, 0.0, *[0.0] * len(zs))
    return body, box


def part_rings(geom, rings: list[Ring]) -> list[Ring]:
    """The first ring of each part."""
    out, at = [], 0
    for part in geom["parts"]:
        out.append(rings[at])
        at += len(part)
    return out


# --- attributes ----------------------------------------------------------------------------------


@dataclass
class Attribute:
    name: str
    code: str
    width: int
    precision: int

    @property
    def type(self) -> T.DataType:
        if self.code in "NF":
            if self.precision or self.code == "F":
                return T.DoubleType()
            return T.IntegerType() if self.width < 10 else T.LongType() if self.width < 19 else T.DoubleType()
        return T.StringType()

    def value(self, raw: bytes):
        text = raw.decode("utf-8", "replace").rstrip("\0 ") if self.code not in "NF" else raw.decode("ascii", "replace").strip("\0 *")
        if not text:
            return None
        if self.code in "NF":
            return float(text) if isinstance(self.type, T.DoubleType) else int(float(text))
        return text

    def raw(self, value) -> bytes:
        if value is None:
            return b" " * self.width
        if self.code == "N":
            text = f"{value:.{self.precision}f}" if self.precision else str(int(value))
            if len(text) > self.width and self.precision:
                text = f"{value:.{self.width - 8}g}"
            if len(text) > self.width:
                raise ValueError(f"{value} is too wide for field {self.name}")
            return text.rjust(self.width).encode()
        data = str(value).encode()[: self.width]
        return data.decode("utf-8", "ignore").encode().ljust(self.width)


def attribute(f: T.StructField) -> Attribute:
    """How a field is stored: numbers as text of the width and precision of its metadata, all else as text; names keep ten bytes."""
    w, p = f.metadata.get("width"), f.metadata.get("precision")
    if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
        return Attribute(f.name[:10], "N", w or 9, 0)
    if isinstance(f.dataType, T.LongType):
        return Attribute(f.name[:10], "N", w or 18, 0)
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return Attribute(f.name[:10], "N", w or 24, 15 if p is None else p)
    if isinstance(f.dataType, (T.StringType, T.DateType)):
        return Attribute(f.name[:10], "C", w or 80, 0)
    raise ValueError(f"a shapefile has no field of type {f.dataType.simpleString()}")


@dataclass
class Info:
    kind: int
    box: tuple[float, float, float, float]
    count: int
    attributes: list[Attribute]
    head: int  # bytes before the first row of attributes
    width: int  # bytes of such a row
    wkt: str | None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("fid", T.LongType()), T.StructField("geom", GEOM), *[T.StructField(a.name, a.type, True, {"width": a.width, "precision": a.precision}) for a in self.attributes]])


def stem(path: str) -> str:
    return re.sub(r"\.shp$", "", path)


def read_info(path: str) -> Info:
    base = stem(path)
    with files.open_read(base + ".shp") as f:
        head = f.read(100)
    if len(head) < 100 or struct.unpack(">i", head[:4])[0] != 9994:
        raise ValueError(f"{path} is no shapefile")
    with files.open_read(base + ".dbf") as f:
        d = f.read(32)
        first, width = struct.unpack("<HH", d[8:12])
        fields = f.read(first - 32)
    found = []
    for k in range(0, len(fields) - 31, 32):
        e = fields[k : k + 32]
        if e[0] == 0x0D:
            break
        found.append(Attribute(e[:11].split(b"\0")[0].decode("utf-8", "replace"), chr(e[11]), e[16], e[17]))
    wkt = files.read_all(base + ".prj").decode() if files.exists(base + ".prj") else None
    return Info(struct.unpack("<i", head[32:36])[0], struct.unpack("<4d", head[36:68]), (files.size(base + ".shx") - 100) // 8, found, first, width, wkt or None)


# --- Spark ---------------------------------------------------------------------------------------


class Records(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.base, self.info = stem(options["path"]), read_info(options["path"])
        self.step = int(options.get("records", RECORDS))

    def partitions(self) -> Sequence[InputPartition]:
        return [Records(k, min(self.info.count, k + self.step)) for k in range(0, self.info.count, self.step)]

    def read(self, part: Records | None) -> Iterator[tuple]:
        if part is None:  # a file without records
            return
        n, i = part.last - part.first, self.info
        with files.open_read(self.base + ".shx") as f:
            f.seek(100 + 8 * part.first)
            places = struct.unpack(f">{2 * n}i", f.read(8 * n))
        with files.open_read(self.base + ".shp") as shp, files.open_read(self.base + ".dbf") as dbf:
            dbf.seek(i.head + i.width * part.first)
            for k in range(n):
                row = dbf.read(i.width)
                shp.seek(2 * places[2 * k] + 8)
                body = shp.read(2 * places[2 * k + 1])
                if row[:1] == b"*":  # deleted
                    continue
                values, at = [], 1
                for a in i.attributes:
                    values.append(a.value(row[at : at + a.width]))
                    at += a.width
                yield (part.first + k, decode(body), *values)


@dataclass
class Part(WriterCommitMessage):
    shp: str
    dbf: str
    lengths: str
    first: int
    count: int
    box: tuple | None


class _Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.base, self.folder, self.kind, self.wkt = stem(options["path"]), options["parts"], int(options["kind"]), options.get("wkt")
        self.attributes: list[Attribute] = pickle.loads(base64.b64decode(options["attributes"]))

    def write(self, rows: Iterator) -> Part:
        from pyspark import TaskContext

        shp, dbf, lengths = (files.new_part(self.folder) for _ in range(3))
        box, n = None, 0
        with files.open_write(shp) as f, files.open_write(dbf) as g, files.open_write(lengths) as h:
            for r in rows:
                body, own = encode(r[0], self.kind)
                f.write(body)
                h.write(struct.pack(">i", len(body)))
                g.write(b" " + b"".join(a.raw(v) for a, v in zip(self.attributes, r[1:])))
                if own is not None:
                    box = own if box is None else (min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3]))
                n += 1
        return Part(shp, dbf, lengths, TaskContext.get().partitionId(), n, box)

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.first)
        boxes = [m.box for m in parts if m.box] or [(0.0, 0.0, 0.0, 0.0)]
        box = min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)
        count = sum(m.count for m in parts)
        body = sum(files.size(m.shp) for m in parts)

        def head(size: int) -> bytes:
            return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, self.kind, *box, 0, 0, 0, 0)

        with files.open_write(self.base + ".shp") as shp, files.open_write(self.base + ".shx") as shx:
            shp.write(head(100 + body + 8 * count))
            shx.write(head(100 + 8 * count))
            at, number = 100, 0
            for m in parts:
                with files.open_read(m.shp) as f, files.open_read(m.lengths) as h:
                    for _ in range(m.count):
                        n = struct.unpack(">i", h.read(4))[0]
                        number += 1
                        shp.write(struct.pack(">2i", number, n // 2) + f.read(n))
                        shx.write(struct.pack(">2i", at // 2, n // 2))
                        at += 8 + n
        with files.open_write(self.base + ".dbf") as f:
            width = 1 + sum(a.width for a in self.attributes)
            f.write(struct.pack("<4BIHH20x", 3, 100, 1, 1, count, 33 + 32 * len(self.attributes), width))
            for a in self.attributes:
                f.write(a.name.encode()[:10].ljust(11, b"\0") + a.code.encode() + struct.pack("<4xBB14x", a.width, a.precision))
            f.write(b"\r")
            for m in parts:
                for block in files.blocks(m.dbf):
                    f.write(block)
            f.write(b"\x1a")
        files.delete(self.base + ".prj")
        if self.wkt:
            with files.open_write(self.base + ".prj") as f:
                f.write(self.wkt.encode())
        files.delete(self.folder)

    def abort(self, messages: list) -> None:
        files.delete(self.folder)


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom_shapefile"

    def schema(self):
        return read_info(self.options["path"]).schema

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(fid, geom, fields) of a shapefile; fid is the number of the record, from 0."""
    spark.dataSource.register(Shapefile)
    return spark.read.format("gridloom_shapefile").option("path", path).load()


def kind_of(geometry: str, z: bool) -> int:
    bare = geometry.removeprefix("Multi") if geometry != "MultiPoint" else geometry
    return next(k for k, v in SHAPES.items() if v == (bare, z))


def write(features: DataFrame, path: str, geometry: str, z: bool = False, wkt: str | None = None, geom: str = "geom", fid: str = "fid") -> None:
    """Write features in order of fid; records are numbered anew."""
    spark = features.sparkSession
    spark.dataSource.register(Shapefile)
    fields = [f for f in features.schema if f.name not in (geom, fid)]
    rows = features.repartitionByRange(fid).sortWithinPartitions(fid) if fid in features.columns else features
    w = rows.select(geom, *[f.name for f in fields]).write.format("gridloom_shapefile").mode("append").option("path", path).option("kind", kind_of(geometry, z))
    w = w.option("parts", files.parts_folder(stem(path))).option("attributes", base64.b64encode(pickle.dumps([attribute(f) for f in fields])).decode())
    (w.option("wkt", wkt) if wkt else w).save()


def delete(path: str) -> None:
    files.delete(*[stem(path) + s for s in (".shp", ".shx", ".dbf", ".prj", ".cpg")])
