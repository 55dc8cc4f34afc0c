"""GeoJSON files as tables of features.

Files that hold a feature a line, alone or within a collection as ``write`` lays them out, are read by
lines, many tasks a file.  Other collections are read whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import geometry as gm
from ..operators.vector import geojson
from ..plans.lineage import ranked
from . import files

HEAD = 1 << 16


def by_lines(path: str) -> bool:
    """Whether a feature lies alone on one of the first lines."""
    with files.open_read(path) as f:
        lines = f.read(HEAD).split(b"\n")
    for line in lines[:3]:
        try:
            if json.loads(line.strip().rstrip(b",")).get("type") == "Feature":
                return True
        except (ValueError, AttributeError):
            continue
    return False


def struct_of(text: str) -> T.StructType:
    """The struct for a description of values of variants; numbers with a point are doubles, unknown types text."""
    text = re.sub(r"DECIMAL\(\d+,(\d+)\)", lambda m: "BIGINT" if m[1] == "0" else "DOUBLE", text).replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")
    kind = T._parse_datatype_string(text.lower().replace("struct<>", "string")) if text.startswith("STRUCT") else T.StructType()
    return kind if isinstance(kind, T.StructType) else T.StructType()


def read(spark: SparkSession, path: str, fields: T.StructType | None = None) -> DataFrame:
    """(fid, geom, fields): fid is a feature's numeric id, else its number in the file, from 0.

    Without ``fields`` one more pass over the properties finds their types.
    """
    if by_lines(path):
        text = spark.read.text(path).select(F.regexp_replace(F.trim("value"), ",$", "").alias("f"), F.col("_metadata.file_block_start").alias("b")).where(F.col("f").startswith("{") & F.col("f").endswith("}"))
    else:
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "features array<string>")["features"].alias("f"))
        text = whole.select(F.explode("f").alias("f"), F.lit(0).cast("long").alias("b"))
    rows = text.select(F.monotonically_increasing_id().alias("m"), "b", F.from_json("f", "type string, id long, properties string, geometry string").alias("f")).where("f.type = 'Feature'")
    if fields is None:
        said = rows.agg(F.schema_of_variant_agg(F.try_parse_json(F.col("f.properties")))).first()[0]
        fields = struct_of(said or "")
    props = F.from_json(F.col("f.properties"), fields) if len(fields) else F.lit(None)
    rows = ranked(rows.select("b", "m", F.col("f.id").alias("id"), props.alias("p"), F.col("f.geometry").alias("g")), [], ["b", "m"], "n")
    return rows.select(F.coalesce("id", "n").alias("fid"), gm.from_geojson(F.col("g")).alias("geom"), *[F.col("p")[f.name].alias(f.name) for f in fields])


@dataclass
class Part(WriterCommitMessage):
    path: str
    number: int


class _Writer(DataSourceWriter):
    """Lines, joined by commas, between a head and a tail."""

    def __init__(self, options: dict) -> None:
        self.path, self.folder, self.head = options["path"], options["parts"], options["head"]

    def write(self, rows: Iterator) -> Part:
        from pyspark import TaskContext

        path = files.new_part(self.folder)
        with files.open_write(path) as f:
            for k, r in enumerate(rows):
                f.write((",\n" if k else "").encode() + r[0].encode())
        return Part(path, TaskContext.get().partitionId())

    def commit(self, messages: list) -> None:
        with files.open_write(self.path) as f:
            f.write(self.head.encode())
            first = True
            for m in sorted((m for m in messages if m is not None), key=lambda m: m.number):
                if files.size(m.path):
                    f.write(b"\n" if first else b",\n")
                    first = False
                    for block in files.blocks(m.path):
                        f.write(block)
            f.write(b"\n]}\n")
        files.delete(self.folder)

    def abort(self, messages: list) -> None:
        files.delete(self.folder)


class GeoJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom_geojson"

    def schema(self) -> str:
        return "feature string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def write(features: DataFrame, path: str, geom: str = "geom", fid: str = "fid", wkt: str | None = None) -> None:
    """One collection, a feature a line, in order of fid, which is kept as the features' id."""
    features.sparkSession.dataSource.register(GeoJson)
    lines = geojson(features.repartitionByRange(fid).sortWithinPartitions(fid), geom, fid)
    lines = lines.select(F.concat(F.lit('{"id":'), F.col(fid).cast("string"), F.lit(","), F.substring("feature", 2, 1 << 30)).alias("feature"))
    crs = f'"crs":{{"type":"name","properties":{{"name":{json.dumps(wkt)}}}}},' if wkt else ""
    head = '{"type":"FeatureCollection",' + crs + '"features":['
    lines.write.format("gridloom_geojson").mode("append").option("path", path).option("parts", files.parts_folder(path)).option("head", head).save()


def reference(path: str) -> str | None:
    """The reference named at the head of a collection."""
    with files.open_read(path) as f:
        head = f.read(HEAD).decode("utf-8", "ignore")
    m = re.search(r'"crs"\s*:\s*\{.*?"name"\s*:\s*("(?:[^"\\]|\\.)*")\s*\}', head, re.S)
    return json.loads(m[1]) if m else None
