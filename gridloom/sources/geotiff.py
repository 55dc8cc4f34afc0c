"""GeoTIFF files as tables of tiles, read and written by many tasks.

Reading: a file's header is read on the driver; a partition is a run of its rows of blocks, so a window
reads the blocks that it meets and nothing else.  Strips and tiles, bands together or apart, integers
and floats, without compression or with deflate, LZW or PackBits, with or without a predictor.

Writing: tasks encode tiles into part files, and the driver puts header, directory and parts together.
Files beyond 4 GB are written in the form with 64-bit offsets.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..footprint import Footprint
from ..functions.types import channels_schema
from . import files

SCHEMA = "tx int, ty int, x0 int, y0 int, width int, height int, data array<array<double>>"
BLOCK_PIXELS = 256

# Fixed values of the format: field types by number (size, struct code).
FIELD = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
# Fixed values of the format: tags by name.
TAG = {
    "width": 256, "length": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_offsets": 273, "samples": 277, "rows_per_strip": 278, "strip_bytes": 279,
    "planar": 284, "predictor": 317, "tile_width": 322, "tile_length": 323, "tile_offsets": 324, "tile_bytes": 325, "extra_samples": 338, "sample_format": 339,
    "pixel_scale": 33550, "tiepoint": 33922, "transformation": 34264, "geo_keys": 34735, "geo_doubles": 34736, "geo_ascii": 34737, "metadata": 42112, "nodata": 42113,
}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


@dataclass
class Info:
    """What a file's header says; ``blocks`` are (offset, bytes) in order of plane, row and column of blocks."""

    fp: Footprint
    dtype: str
    count: int
    channels: list[dict]
    wkt: str | None = None
    block: tuple[int, int] = (BLOCK_PIXELS, BLOCK_PIXELS)
    blocks: list[tuple[int, int]] = field(default_factory=list)
    compression: int = NONE
    predictor: int = 1
    planar: int = 1
    order: str = "<"
    tiled: bool = True

    @property
    def across(self) -> int:
        return -(-self.fp.rsx // self.block[0])

    @property
    def down(self) -> int:
        return -(-self.fp.rsy // self.block[1])


# --- decoding ------------------------------------------------------------------------------------


def unlzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, the highest bit first."""
    out, bits, n, at, width = bytearray(), 0, 0, 0, 9
    table: list[bytes] = []
    last = b""
    while True:
        while n < width:
            if at >= len(data):
                return bytes(out)
            bits, n, at = (bits << 8 | data[at]) & 0xFFFFFFFF, n + 8, at + 1
        code = bits >> (n - width) & ((1 << width) - 1)
        n -= width
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            return bytes(out)
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def decoded(raw: bytes, info: Info, rows: int) -> np.ndarray:
    """(rows, columns, bands of the block) of a block's bytes; an empty block holds nodata."""
    bands = info.count if info.planar == 1 else 1
    w = info.block[0]
    kind = np.dtype(info.dtype).newbyteorder(info.order)
    if not raw:
        return np.full((rows, w, bands), info.channels[0]["nodata"] or 0, info.dtype)
    data = {NONE: lambda d: d, LZW: unlzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpackbits}[info.compression](raw)
    need = rows * w * bands * kind.itemsize
    data = data[:need].ljust(need, b"\0")
    if info.predictor == 3:
        a = np.frombuffer(data, np.uint8).reshape(rows, w * kind.itemsize * bands)
        a = a.reshape(rows, -1, bands).cumsum(axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, w * bands)
        a = np.ascontiguousarray(a.transpose(0, 2, 1))
        return a.view(kind.newbyteorder(">")).reshape(rows, w, bands).astype(info.dtype)
    a = np.frombuffer(data, kind).reshape(rows, w, bands).astype(info.dtype)
    return a.cumsum(axis=1, dtype=info.dtype) if info.predictor == 2 else a


def read_info(path: str) -> Info:
    """The header of the first image of a file."""
    with files.open_read(path) as f:
        head = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(order + "H", head[2:4])[0] if order else 0
        if version not in (42, 43):
            raise ValueError(f"{path} is no TIFF file")
        big = version == 43
        at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        f.seek(at)
        n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        each = 20 if big else 12
        entries = f.read(n * each)
        tags: dict[int, tuple] = {}
        for k in range(n):
            e = entries[k * each : (k + 1) * each]
            tag, kind = struct.unpack(order + "HH", e[:4])
            count = struct.unpack(order + ("Q" if big else "I"), e[4 : 12 if big else 8])[0]
            if kind not in FIELD:
                continue
            width, code = FIELD[kind]
            value, room = e[12 if big else 8 :], 8 if big else 4
            if width * count > room:
                f.seek(struct.unpack(order + ("Q" if big else "I"), value[:room])[0])
                value = f.read(width * count)
            value = value[: width * count]
            tags[tag] = (value.rstrip(b"\0").decode("utf-8", "replace"),) if code == "s" else struct.unpack(f"{order}{count * len(code)}{code[0]}", value)
    one = lambda name, default=None: tags.get(TAG[name], (default,))[0]
    w, h, count = one("width"), one("length"), one("samples", 1)
    kind = {1: "uint", 2: "int", 3: "float"}[one("sample_format", 1)] + str(one("bits", 1))
    if kind not in ("uint8", "uint16", "uint32", "int8", "int16", "int32", "float32", "float64"):
        raise ValueError(f"{path} has pixels of type {kind}")
    tiled = TAG["tile_width"] in tags
    block = (one("tile_width"), one("tile_length")) if tiled else (w, min(h, one("rows_per_strip", h)))
    spans = list(zip(tags[TAG["tile_offsets" if tiled else "strip_offsets"]], tags[TAG["tile_bytes" if tiled else "strip_bytes"]]))
    notes = one("metadata", "") or ""
    item = lambda name, k, default: (m := re.search(rf'<Item name="{name}" sample="{k}"[^>]*>([^<]*)</Item>', notes)) and unescape(m[1]) or default
    nodata = one("nodata")
    nodata = None if nodata is None else float(nodata)
    given = {"nodata": [], "offset": [], "scale": [], "interpretation": [], "mask": []}
    for k in range(count):
        own = item("NODATA", k, nodata)
        for key, v in (("nodata", None if own in (None, "none") else float(own)), ("offset", float(item("OFFSET", k, 0))), ("scale", float(item("SCALE", k, 1))), ("interpretation", item("COLORINTERP", k, "undefined").lower()), ("mask", item("MASK", k, "all_valid"))):
            given[key].append(v)
    return Info(_footprint(tags, w, h), kind, count, channels_schema(count, given), _reference(tags), block, spans, one("compression", 1), one("predictor", 1), one("planar", 1), order, tiled)


def _footprint(tags: dict, w: int, h: int) -> Footprint:
    if m := tags.get(TAG["transformation"]):
        return Footprint(m[3], m[0], m[1], m[7], m[4], m[5], w, h)
    if TAG["pixel_scale"] in tags and TAG["tiepoint"] in tags:
        (sx, sy), (col, row, _, x, y) = tags[TAG["pixel_scale"]][:2], tags[TAG["tiepoint"]][:5]
        return Footprint(x - col * sx, sx, 0.0, y + row * sy, 0.0, -sy, w, h)
    return Footprint(0.0, 1.0, 0.0, 0.0, 0.0, -1.0, w, h)


def _reference(tags: dict) -> str | None:
    """The reference's text: WKT that a citation holds, or an EPSG code."""
    keys, text = tags.get(TAG["geo_keys"], ()), tags.get(TAG["geo_ascii"], ("",))[0]
    found = {keys[k]: keys[k + 1 : k + 4] for k in range(4, len(keys) - 3, 4)}
    for where, count, start in (found[k] for k in (1026, 3073, 2049) if k in found):
        said = text[start : start + count].rstrip("|") if where == TAG["geo_ascii"] else ""
        if said.startswith("ESRI PE String = "):
            return said.removeprefix("ESRI PE String = ")
    code = next((found[k][2] for k in (3072, 2048) if k in found and found[k][2] not in (0, 32767)), None)
    return None if code is None else f"EPSG:{code}"


# --- encoding ------------------------------------------------------------------------------------


def _entries(info: Info, spans: Sequence[tuple[int, int]], big: bool) -> list[tuple[int, int, int, bytes]]:
    """(tag, field type, count, bytes) of a file's directory."""
    kind = np.dtype(info.dtype)
    where = 16 if big else 4
    pack = lambda code, *v: struct.pack(f"<{len(v)}{code}", *v)
    rgb = info.count in (3, 4) and info.dtype == "uint8"
    out = [
        (TAG["width"], 4, 1, pack("I", info.fp.rsx)), (TAG["length"], 4, 1, pack("I", info.fp.rsy)),
        (TAG["bits"], 3, info.count, pack("H", *[8 * kind.itemsize] * info.count)), (TAG["compression"], 3, 1, pack("H", info.compression)),
        (TAG["photometric"], 3, 1, pack("H", 2 if rgb else 1)), (TAG["samples"], 3, 1, pack("H", info.count)), (TAG["planar"], 3, 1, pack("H", 1)),
        (TAG["tile_width"], 4, 1, pack("I", info.block[0])), (TAG["tile_length"], 4, 1, pack("I", info.block[1])),
        (TAG["tile_offsets"], where, len(spans), pack("Q" if big else "I", *[s[0] for s in spans])), (TAG["tile_bytes"], where, len(spans), pack("Q" if big else "I", *[s[1] for s in spans])),
        (TAG["sample_format"], 3, info.count, pack("H", *[{"u": 1, "i": 2, "f": 3}[kind.kind]] * info.count)),
    ]
    if extra := info.count - (3 if rgb else 1):
        out.append((TAG["extra_samples"], 3, extra, pack("H", *[0] * extra)))
    fp = info.fp
    if fp.rx == fp.ry == 0 and fp.dx > 0 > fp.dy:
        out += [(TAG["pixel_scale"], 12, 3, pack("d", fp.dx, -fp.dy, 0)), (TAG["tiepoint"], 12, 6, pack("d", 0, 0, 0, fp.tlx, fp.tly, 0))]
    else:
        out.append((TAG["transformation"], 12, 16, pack("d", fp.dx, fp.rx, 0, fp.tlx, fp.ry, fp.dy, 0, fp.tly, 0, 0, 0, 0, 0, 0, 0, 1)))
    if info.wkt:
        said = f"ESRI PE String = {info.wkt}|".encode()
        out += [(TAG["geo_keys"], 3, 12, pack("H", 1, 1, 0, 2, 1025, 0, 1, 1, 1026, TAG["geo_ascii"], len(said), 0)), (TAG["geo_ascii"], 2, len(said) + 1, said + b"\0")]
    items = []
    for k, c in enumerate(info.channels):
        for name, v in (("NODATA", "none" if c["nodata"] is None else repr(c["nodata"])), ("OFFSET", repr(c["offset"])), ("SCALE", repr(c["scale"])), ("COLORINTERP", c["interpretation"]), ("MASK", c["mask"])):
            items.append(f'<Item name="{name}" sample="{k}" role="{name.lower()}">{escape(v)}</Item>')
    notes = ("<GDALMetadata>" + "".join(items) + "</GDALMetadata>").encode() + b"\0"
    out.append((TAG["metadata"], 2, len(notes), notes))
    if (v := info.channels[0]["nodata"]) is not None:
        said = repr(v).encode() + b"\0"
        out.append((TAG["nodata"], 2, len(said), said))
    return sorted(out)


def header(info: Info, sizes: Sequence[int]) -> bytes:
    """The bytes before the blocks, which follow in order and have ``sizes``; a size of 0 is a block that is not stored."""
    big = sum(sizes) + 64 * len(sizes) > 4_000_000_000

    def laid(base: int) -> bytes:
        spans, at = [], base
        for n in sizes:
            spans.append((at if n else 0, n))
            at += n
        entries = _entries(info, spans, big)
        room, each, lead = (8, 20, 16) if big else (4, 12, 8)
        start = lead + (8 if big else 2) + each * len(entries) + room
        body, rest = b"", b""
        for tag, kind, count, value in entries:
            body += struct.pack("<HH" + ("Q" if big else "I"), tag, kind, count)
            if len(value) <= room:
                body += value.ljust(room, b"\0")
            else:
                body += struct.pack("<Q" if big else "<I", start + len(rest))
                rest += value + b"\0" * (len(value) % 2)
        first = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)
        return first + struct.pack("<Q" if big else "<H", len(entries)) + body + b"\0" * room + rest

    return laid(len(laid(0)))


def encoded(info: Info, data: np.ndarray) -> bytes:
    """A block's bytes; ``data`` (rows, columns, bands) may be smaller than a block at the raster's edge."""
    full = np.zeros((info.block[1], info.block[0], info.count), info.dtype)
    kind = np.dtype(info.dtype)
    if kind.kind != "f":
        lo, hi = np.iinfo(kind).min, np.iinfo(kind).max
        data = np.clip(np.rint(data), lo, hi)
    full[: data.shape[0], : data.shape[1]] = data
    raw = full.astype(kind.newbyteorder("<")).tobytes()
    return zlib.compress(raw, 6) if info.compression == DEFLATE else raw


# --- Spark ---------------------------------------------------------------------------------------


@dataclass
class BlockRows(InputPartition):
    first: int
    last: int

    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    """Blocks that meet the window of the options x0, y0, x1, y1 (half-open, whole raster by default), of the channels named."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.info = i = read_info(self.path)
        num = lambda name, default: int(options.get(name, default))
        self.x0, self.y0, self.x1, self.y1 = max(0, num("x0", 0)), max(0, num("y0", 0)), min(i.fp.rsx, num("x1", i.fp.rsx)), min(i.fp.rsy, num("y1", i.fp.rsy))
        self.bands = [int(b) for b in options["channels"].split(",")] if options.get("channels") else list(range(i.count))

    def partitions(self) -> Sequence[InputPartition]:
        if self.x0 >= self.x1 or self.y0 >= self.y1:
            return []
        h = self.info.block[1]
        lo, hi = self.y0 // h, -(-self.y1 // h)
        wide = -(-self.x1 // self.info.block[0]) - self.x0 // self.info.block[0]
        step = max(1, (1 << 22) // max(1, self.info.block[0] * h * wide * len(self.bands)))
        return [BlockRows(a, min(hi, a + step)) for a in range(lo, hi, step)]

    def read(self, part: BlockRows | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a window without pixels
            return
        i = self.info
        w, h = i.block
        with files.open_read(self.path) as f:
            for ty in range(part.first, part.last):
                rows = {k: [] for k in ("tx", "ty", "x0", "y0", "width", "height", "data")}
                for tx in range(self.x0 // w, -(-self.x1 // w)):
                    tall = h if i.tiled else min(h, i.fp.rsy - ty * h)
                    planes = []
                    for p in range(1) if i.planar == 1 else sorted(set(self.bands)):
                        at, n = i.blocks[(p * i.down + ty) * i.across + tx]
                        raw = b""
                        if n:
                            f.seek(at)
                            raw = f.read(n)
                        planes.append(decoded(raw, i, tall))
                    a = planes[0][:, :, self.bands] if i.planar == 1 else np.concatenate(planes, axis=2)[:, :, [sorted(set(self.bands)).index(b) for b in self.bands]]
                    a = a[: i.fp.rsy - ty * h, : i.fp.rsx - tx * w].astype(float)
                    for k, v in (("tx", tx), ("ty", ty), ("x0", tx * w), ("y0", ty * h), ("width", a.shape[1]), ("height", a.shape[0])):
                        rows[k].append(v)
                    rows["data"].append([a[:, :, b].ravel() for b in range(a.shape[2])])
                kinds = [pa.int32()] * 6 + [pa.list_(pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], list(rows))


@dataclass
class Parts(WriterCommitMessage):
    path: str
    tiles: list[tuple[int, int, int]]  # (number of the block, offset, bytes)


class _Writer(DataSourceWriter):
    """Tiles (tx, ty, data: bands of row-major values) of the block size; ``info`` is the header without its blocks."""

    def __init__(self, options: dict, columns: list[str]) -> None:
        import base64
        import pickle

        self.path, self.folder = options["path"], options["parts"]
        self.info: Info = pickle.loads(base64.b64decode(options["info"]))
        self.columns = columns

    def write(self, rows: Iterator) -> Parts:
        i, path, tiles, at = self.info, files.new_part(self.folder), [], 0
        with files.open_write(path) as f:
            for r in rows:
                w, h = min(i.block[0], i.fp.rsx - r["tx"] * i.block[0]), min(i.block[1], i.fp.rsy - r["ty"] * i.block[1])
                a = np.array(r["data"], float).reshape(i.count, h, w).transpose(1, 2, 0)
                raw = encoded(i, a)
                f.write(raw)
                tiles.append((r["ty"] * i.across + r["tx"], at, len(raw)))
                at += len(raw)
        return Parts(path, tiles)

    def commit(self, messages: list) -> None:
        i = self.info
        placed = {n: (m.path, at, size) for m in messages if m is not None for n, at, size in m.tiles}
        if sum(len(m.tiles) for m in messages if m is not None) != len(placed):
            files.delete(self.folder)
            raise ValueError("a tile was given twice")
        order = range(i.across * i.down)
        with files.open_write(self.path) as f:
            f.write(header(i, [placed[n][2] if n in placed else 0 for n in order]))
            for n in order:
                if n in placed:
                    for block in files.blocks(*placed[n]):
                        f.write(block)
        files.delete(self.folder)

    def abort(self, messages: list) -> None:
        files.delete(self.folder)


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom_geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema.names)


def read(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, channels: Sequence[int] | None = None) -> DataFrame:
    """The tiles that meet the half-open ``window`` (x0, y0, x1, y1), with the given channels in their order."""
    spark.dataSource.register(GeoTiff)
    r = spark.read.format("gridloom_geotiff").option("path", path)
    if window is not None:
        for k, v in zip(("x0", "y0", "x1", "y1"), window):
            r = r.option(k, str(v))
    if channels is not None:
        r = r.option("channels", ",".join(map(str, channels)))
    return r.load()


def write(tiles: DataFrame, path: str, fp: Footprint, dtype: str, channels: list[dict], wkt: str | None = None, block: int = BLOCK_PIXELS, compress: bool = True) -> None:
    """Write tiles (tx, ty, data) of ``block`` pixels; missing tiles are not stored and read as nodata."""
    import base64
    import pickle

    spark = tiles.sparkSession
    spark.dataSource.register(GeoTiff)
    info = Info(fp, dtype, len(channels), channels, wkt, (block, block), compression=DEFLATE if compress else NONE)
    w = tiles.select("tx", "ty", "data").write.format("gridloom_geotiff").mode("append")
    w.option("path", path).option("parts", files.parts_folder(path)).option("info", base64.b64encode(pickle.dumps(info)).decode()).save()
