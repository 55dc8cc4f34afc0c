"""Tables of tiles or features that are written to in place: versions of immutable parts.

A version is a small file that lists the parts it consists of; a part is a folder of Parquet files with rows by
key (a tile's indices, a feature's id).  A write adds a part with the rows that it sets or removes and a
version that lists it, so the bytes written follow the rows written.  A read takes the newest row of
each key, and opens only the parts whose range of keys meets what is read.  Readers of an older version still see it.

A version's file is created under the next free number, and whoever comes second fails to create it: its write is laid
over the other one if their ranges of keys are apart, and is an error otherwise.  A writer that fails before
that has left a folder that no version lists.  On stores without exclusive creation one writer at a time is up to the caller.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: rows of the newer parts that a read may broadcast, keys and a number each
SMALL = 1 << 20


class Conflict(RuntimeError):
    """Another writer has changed the same range of keys since."""


class Versioned:
    """A table under ``path``; see the module's text.  ``keys`` are integer columns."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- versions ---------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], about: dict | None = None) -> "Versioned":
        """A new table without rows; ``about`` is kept with it."""
        new = cls(spark, path)
        if new.exists():
            raise RuntimeError(f"{path} exists")
        # a schema stored with its table allows nulls anywhere, as removed rows have keys alone
        fields = [{**f.jsonValue(), "nullable": True} for f in schema]
        if not new._commit(0, {"keys": list(keys), "schema": {"type": "struct", "fields": fields}, "about": about or {}, "parts": []}):
            raise Conflict(f"{path} was created by another writer")
        return new

    def _name(self, version: int):
        return self._path(f"{self.path}/versions/{version:010d}.json")

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, version: int) -> dict | None:
        """What a version lists; None while its file is being written, or if that was broken off."""
        f = self._fs.open(self._name(version))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
        finally:
            f.close()
        try:
            return json.loads(text)
        except json.JSONDecodeError:
            return None

    def _commit(self, version: int, said: dict) -> bool:
        """Whether this writer was the first to create the version."""
        try:
            out = self._fs.create(self._name(version), False)
        except Exception as e:
            if self._fs.exists(self._name(version)):
                return False
            raise e
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        return True

    def exists(self) -> bool:
        return bool(self._numbers())

    def versions(self) -> list[int]:
        """The versions that can be read, the oldest first."""
        return [n for n in self._numbers() if self._load(n) is not None]

    def version(self, version: int | None = None) -> tuple[int, dict]:
        """A version, the newest by default, and what it lists."""
        for n in reversed(self._numbers()) if version is None else [version]:
            if n in self._numbers() and (said := self._load(n)) is not None:
                return n, said
        raise ValueError(f"no version {'' if version is None else version} of {self.path}")

    def about(self, version: int | None = None) -> dict:
        return self.version(version)[1]["about"]

    # --- reads ------------------------------------------------------------------------------------

    def read(self, version: int | None = None, ranges: dict[str, tuple[int, int]] | None = None) -> DataFrame:
        """The rows of a version, the newest by default; ``ranges`` (first, last) of keys limit what is opened."""
        _, said = self.version(version)
        return self._rows(said, ranges or {})

    def _rows(self, said: dict, ranges: dict[str, tuple[int, int]]) -> DataFrame:
        keys, schema = said["keys"], T.StructType.fromJson(said["schema"])
        parts = [p for p in said["parts"] if all(p["low"][k] <= hi and lo <= p["high"][k] for k, (lo, hi) in ranges.items())]
        if not parts:
            return self.spark.createDataFrame([], schema)
        within: Callable[[DataFrame], DataFrame] = lambda df: df
        if ranges:
            cond = F.lit(True)
            for k, (lo, hi) in ranges.items():
                cond = cond & F.col(k).between(lo, hi)
            within = lambda df: df.where(cond)
        if len(parts) == 1 and not parts[0]["gone"]:
            return within(self.spark.read.schema(schema).parquet(self._folder(parts[0])))
        # the order of parts, by the folder that a row's file lies in
        number = F.create_map(*[x for i, p in enumerate(parts) for x in (F.lit(p["name"]), F.lit(i))])
        of = F.element_at(number, F.regexp_extract(F.col("_metadata.file_path"), r"/parts/([0-9a-f]{32})/", 1))
        scan = lambda some, columns: within(self.spark.read.schema(schema).parquet(*[self._folder(p) for p in some]).select(*columns, of.alias("__part")))
        newest = scan(parts[1:] or parts, keys).groupBy(*keys).agg(F.max("__part").alias("__newest"))
        if sum(p["rows"] for p in parts[1:]) <= SMALL:
            newest = F.broadcast(newest)
        found = scan(parts, schema.names).join(newest, keys, "left").where(F.col("__part") == F.coalesce("__newest", "__part"))
        gone = [i for i, p in enumerate(parts) if p["gone"]]
        return (found.where(~F.col("__part").isin(gone)) if gone else found).select(*schema.names)

    def _folder(self, part: dict) -> str:
        return f"{self.path}/parts/{part['name']}"

    # --- writes -----------------------------------------------------------------------------------

    def _part(self, rows: DataFrame, keys: Sequence[str], schema: T.StructType, gone: bool) -> dict | None:
        """Write rows as a part that no version lists yet; None if there are none."""
        part: dict = {"name": uuid.uuid4().hex, "gone": gone}
        named = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema if not gone or f.name in keys])
        named.write.parquet(self._folder(part))
        kept = self.spark.read.schema(named.schema).parquet(self._folder(part))
        bounds = [f(k).alias(f"{n}{k}") for k in keys for n, f in (("low", F.min), ("high", F.max), ("n", F.count))]
        got = kept.agg(F.count(F.lit(1)).alias("rows"), *bounds).first()
        if not got["rows"]:
            self._fs.delete(self._path(self._folder(part)), True)
            return None
        if any(got[f"n{k}"] < got["rows"] for k in keys) or not kept.groupBy(*keys).count().where("count > 1").isEmpty():
            self._fs.delete(self._path(self._folder(part)), True)
            raise ValueError(f"each row needs its own {', '.join(keys)}")
        return part | {"rows": got["rows"], "low": {k: got[f"low{k}"] for k in keys}, "high": {k: got[f"high{k}"] for k in keys}}

    def write(self, rows: DataFrame, since: int | None = None) -> int:
        """Set rows, which replace those of the same keys; the new version.  ``since`` is the version that they were made from."""
        return self._add(rows, since, False)

    def remove(self, keys: DataFrame, since: int | None = None) -> int:
        """Remove the rows of ``keys``; keys that have no row are passed over."""
        return self._add(keys, since, True)

    def _add(self, rows: DataFrame, since: int | None, gone: bool) -> int:
        base, said = self.version(since)
        part = self._part(rows, said["keys"], T.StructType.fromJson(said["schema"]), gone)
        if part is None:
            return self.version()[0]
        seen = {p["name"] for p in said["parts"]}
        while True:
            now, said = self.version()
            if now != base:
                names = {p["name"] for p in said["parts"]}
                others = [p for p in said["parts"] if p["name"] not in seen]
                met = any(all(p["low"][k] <= part["high"][k] and part["low"][k] <= p["high"][k] for k in said["keys"]) for p in others)
                if met or not seen <= names:
                    self._fs.delete(self._path(self._folder(part)), True)
                    raise Conflict(f"version {now} of {self.path} has changed the same range since version {base}")
            target = self._numbers()[-1] + 1
            if self._commit(target, said | {"parts": [*said["parts"], part]}):
                return target

    def replace(self, rows: DataFrame) -> int:
        """All rows anew."""
        base, said = self.version()
        part = self._part(rows, said["keys"], T.StructType.fromJson(said["schema"]), False)
        target = self._numbers()[-1] + 1
        if self.version()[0] != base or not self._commit(target, said | {"parts": [part] if part else []}):
            raise Conflict(f"{self.path} was written to since version {base}")
        return target

    def compact(self, whole: bool = False) -> int:
        """A version of fewer parts with the same rows: all newer parts become one, or with ``whole`` all parts, which also forgets removed rows."""
        base, said = self.version()
        parts = said["parts"]
        if len(parts) < (2 if whole else 3):
            return base
        if not whole and any(p["gone"] for p in parts):
            return self.compact(True)
        keep, merge = ([], parts) if whole else (parts[:1], parts[1:])
        part = self._part(self._rows(said | {"parts": merge}, {}), said["keys"], T.StructType.fromJson(said["schema"]), False)
        target = self._numbers()[-1] + 1
        if self.version()[0] != base or not self._commit(target, said | {"parts": [*keep, *([part] if part else [])]}):
            raise Conflict(f"{self.path} was written to since version {base}")
        return target

    def vacuum(self, keep: int = 1) -> None:
        """Forget all but the newest ``keep`` versions, and parts that none of them lists, also those of writers that failed.  No writer may be at work."""
        held = self.versions()[-keep:]
        used = {p["name"] for n in held for p in self._load(n)["parts"]}
        for n in self._numbers():
            if n not in held:
                self._fs.delete(self._name(n), False)
        folder = self._path(f"{self.path}/parts")
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if s.getPath().getName() not in used:
                self._fs.delete(s.getPath(), True)

    def delete(self) -> None:
        self._fs.delete(self._path(self.path), True)
