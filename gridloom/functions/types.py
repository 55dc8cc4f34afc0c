"""Struct types of footprints, geometries and channels, and the lattice of pixel types."""

from __future__ import annotations

from pyspark.sql import types as T

#: x = tlx + col * dx + row * rx, y = tly + col * ry + row * dy
FP = T.StructType([T.StructField(n, T.DoubleType()) for n in ("tlx", "dx", "rx", "tly", "ry", "dy")] + [T.StructField(n, T.IntegerType()) for n in ("rsx", "rsy")])
POINT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "z")])
#: parts, each of rings, each of points; points and lines have one ring a part
GEOM = T.StructType([T.StructField("type", T.StringType()), T.StructField("has_z", T.BooleanType()), T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(POINT))))])
BBOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("minx", "miny", "maxx", "maxy")])
CHANNEL = T.StructType(
    [T.StructField("nodata", T.DoubleType()), T.StructField("interpretation", T.StringType()), T.StructField("offset", T.DoubleType()), T.StructField("scale", T.DoubleType()), T.StructField("mask", T.StringType())]
)
TILE = T.StructType([T.StructField("raster", T.StringType()), T.StructField("ty", T.IntegerType()), T.StructField("tx", T.IntegerType()), T.StructField("fp", FP), T.StructField("data", T.ArrayType(T.ArrayType(T.DoubleType())))])

# Pixel types by name and the Spark types that hold them without loss.
PIXEL_TYPES = {
    "bool": "boolean", "uint8": "smallint", "int8": "tinyint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint",
    "int64": "bigint", "float16": "float", "float32": "float", "float64": "double", "uint64": "double", "float128": "double",
}
COMPLEX_TYPES = {"complex64": "float", "complex128": "double", "complex256": "double"}
# Field types of vector layers by accepted name.
FIELD_TYPES = {
    "binary": "binary", "bytes": "binary", "date": "date", "datetime": "timestamp_ntz", "time": "string", "integer": "int", "int32": "int",
    "integer64": "bigint", "int": "bigint", "int64": "bigint", "real": "double", "float": "double", "float32": "double", "float64": "double",
    "string": "string", "str": "string", "integerlist": "array<int>", "integer64list": "array<bigint>", "int list": "array<bigint>",
    "reallist": "array<double>", "float list": "array<double>", "stringlist": "array<string>", "str list": "array<string>",
}
# Colour interpretations, mask flags and geometry types by name.
INTERPRETATIONS = (
    "undefined", "grayindex", "paletteindex", "redband", "greenband", "blueband", "alphaband", "hueband", "saturationband", "lightnessband",
    "cyanband", "magentaband", "yellowband", "blackband",
)
MASK_FLAGS = {"all_valid": 1, "per_dataset": 2, "alpha": 4, "nodata": 8}
GEOMETRY_TYPES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection", "Unknown")


def pixel_type(name: str) -> str:
    """The Spark type of a pixel type; types without a number behind them are rejected."""
    if name in COMPLEX_TYPES:
        part = COMPLEX_TYPES[name]
        return f"struct<re:{part},im:{part}>"
    if name not in PIXEL_TYPES:
        raise ValueError(f"no pixel type {name!r}")
    return PIXEL_TYPES[name]


# The types that raster files hold, and those that are widened or narrowed to one of them.
FILE_TYPES = ("uint8", "int16", "int32", "uint16", "uint32", "float32", "float64", "complex64", "complex128")
WIDENED = {"float16": "float32", "int8": "int16"}
NARROWED = {"float128": "float64", "complex256": "complex128", "uint64": "float64", "int64": "float64"}
OPEN_FLAGS = {"raster": 2, "vector": 4, "gnm": 8, "readonly": 0, "update": 1, "shared": 32, "verbose_error": 64, "internal": 128}


def equivalent(name: str) -> str:
    """The file type of a pixel type without any loss or change of width; booleans are stored as bytes."""
    if name == "bool":
        return "uint8"
    if name in FILE_TYPES:
        return name
    raise ValueError(f"no equivalent of {name!r}")


def upcast(name: str) -> str:
    """The file type that holds all values of a pixel type."""
    return WIDENED[name] if name in WIDENED else equivalent(name)


def downcast(name: str) -> str:
    """The file type that holds a pixel type's values best, with loss where it must be."""
    return NARROWED[name] if name in NARROWED else upcast(name)


def is_file_type(name: str, how: str = "equivalent") -> bool:
    """Whether a pixel type has a file type under one of the three rules."""
    try:
        {"equivalent": equivalent, "upcast": upcast, "downcast": downcast}[how](name)
    except ValueError:
        return False
    return True


def pixel_types_of(spark_type: str) -> list[str]:
    """The pixel types that a Spark type holds."""
    return [n for n in (*PIXEL_TYPES, *COMPLEX_TYPES) if pixel_type(n) == spark_type]


def open_flags(text: str) -> int:
    """Bit set of the names of open flags, separated by commas or blanks."""
    out = 0
    for word in text.replace(",", " ").split():
        if word.lower() not in OPEN_FLAGS:
            raise ValueError(f"no open flag {word!r}")
        out |= OPEN_FLAGS[word.lower()]
    return out


def open_flags_of_mode(mode: str) -> int:
    if mode not in ("r", "w"):
        raise ValueError("mode is r or w")
    return OPEN_FLAGS["update" if mode == "w" else "readonly"]


def field_type_name(data_type: T.DataType) -> str:
    """The canonical name of a field type for a Spark type."""
    names = {"int": "integer", "bigint": "integer64", "double": "real", "string": "string", "binary": "binary", "date": "date", "timestamp_ntz": "datetime", "array<int>": "integerlist", "array<bigint>": "integer64list", "array<double>": "reallist", "array<string>": "stringlist"}
    if data_type.simpleString() not in names:
        raise ValueError(f"no field type for {data_type.simpleString()}")
    return names[data_type.simpleString()]


def field(name: str, kind: str, nullable: bool = True, precision: int | None = None, width: int | None = None, default=None) -> T.StructField:
    if kind.lower() not in FIELD_TYPES:
        raise ValueError(f"no field type {kind!r}")
    schema = T._parse_datatype_string(f"x {FIELD_TYPES[kind.lower()]}")
    meta = {k: v for k, v in (("precision", precision), ("width", width), ("default", default)) if v is not None}
    return T.StructField(name, schema[0].dataType, nullable, meta)


def geometry_type(name: str) -> tuple[str, bool]:
    """Canonical name and whether it has z, from a name with or without prefix ``wkb`` and suffix ``25D``, in any case."""
    bare = name.strip().lower().removeprefix("wkb")
    z = bare.endswith("25d")
    for known in GEOMETRY_TYPES:
        if known.lower() == bare.removesuffix("25d"):
            return known, z
    raise ValueError(f"no geometry type {name!r}")


def mask_flags(text: str) -> int:
    """Bit set of mask flags, separated by commas or blanks."""
    out = 0
    for word in text.replace(",", " ").split():
        if word.lower() not in MASK_FLAGS:
            raise ValueError(f"no mask flag {word!r}")
        out |= MASK_FLAGS[word.lower()]
    return out


def mask_names(flags: int) -> str:
    return ",".join(n for n, b in MASK_FLAGS.items() if flags & b)


def channels_schema(count: int, given: dict | None = None) -> list[dict]:
    """One dict a channel: single values apply to all channels, sequences need one value each, other keys are refused."""
    defaults = {"nodata": None, "interpretation": "undefined", "offset": 0.0, "scale": 1.0, "mask": "all_valid"}
    given = given or {}
    if unknown := set(given) - set(defaults):
        raise ValueError(f"unknown channel keys {sorted(unknown)}")
    out = []
    for i in range(count):
        row = {}
        for key, default in defaults.items():
            v = given.get(key, default)
            if isinstance(v, (list, tuple)):
                if len(v) != count:
                    raise ValueError(f"{key} needs {count} values")
                v = v[i]
            row[key] = default if v is None else v
        if row["interpretation"] not in INTERPRETATIONS:
            raise ValueError(f"no interpretation {row['interpretation']!r}")
        row["mask"] = mask_names(mask_flags(row["mask"])) if isinstance(row["mask"], str) else mask_names(row["mask"])
        row["nodata"] = None if row["nodata"] is None else float(row["nodata"])
        row["offset"], row["scale"] = float(row["offset"]), float(row["scale"])
        out.append(row)
    return out


def channel_ids(wanted, count: int) -> tuple[list[int], bool]:
    """Channel numbers in the order asked for, repeats kept, and whether the result has no channel axis."""
    if wanted is None:
        return list(range(count)), count == 1
    if isinstance(wanted, slice):
        return list(range(count))[wanted], False
    flat = isinstance(wanted, int)
    out = []
    for i in [wanted] if flat else wanted:
        if not -count <= i < count:
            raise ValueError(f"no channel {i} of {count}")
        out.append(i % count)
    return out, flat


def field_names(wanted, names: list[str]) -> tuple[list[str], bool]:
    """Fields in the order asked for: None for none and flat, -1 for all, numbers and names mixed, names split at commas and blanks."""
    if wanted is None:
        return [], True
    if isinstance(wanted, str):
        wanted = wanted.replace(",", " ").split()
    elif isinstance(wanted, int):
        wanted = names if wanted == -1 else [wanted]
    out = []
    for w in wanted:
        n = names[w] if isinstance(w, int) else w
        if n not in names:
            raise ValueError(f"no field {n!r}")
        out.append(n)
    if len(set(out)) != len(out):
        raise ValueError("a field is asked for twice")
    return out, False
