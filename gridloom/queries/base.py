"""The derived inputs, in Spark and in SQL, and the registry of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import footprint as fpx
from ..functions import geometry as gm
from ..plans.spread import ROWS, spread

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL of the same result."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fp():
    """The column of footprints; made on use, as columns need a session."""
    return F.col("fp")


def footprints(spark, sf_dir: str) -> DataFrame:
    """(k, fp) of the suppliers."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return spread(table(spark, sf_dir, "supplier"), "s_suppkey").select(k.alias("k"), fpx.make(k * 4.0, 0.5, 0.0, 200.0 - n * 2.0, 0.0, -0.5, 20 + k % 7, 10 + n % 5).alias("fp"))


SUP = """sup AS (SELECT s_suppkey AS k, s_suppkey * 4.0::DOUBLE AS tlx, 0.5::DOUBLE AS dx, 200.0::DOUBLE - s_nationkey * 2.0::DOUBLE AS tly, -0.5::DOUBLE AS dy,
  CAST(20 + s_suppkey % 7 AS INTEGER) AS rsx, CAST(10 + s_nationkey % 5 AS INTEGER) AS rsy FROM supplier),
fp AS (SELECT *, tlx AS minx, tlx + rsx * dx AS maxx, tly + rsy * dy AS miny, tly AS maxy FROM sup)"""


def mosaic_tiles(spark, sf_dir: str, rows: tuple[int, int] | None = None) -> DataFrame:
    """(tx, ty, data) of the embeddings read as 8 x 8 tiles, 16 in a row; ``rows`` limits the pixel rows that are read, half-open."""
    t = table(spark, sf_dir, "embeddings")
    if rows is not None:
        t = t.where((F.col("vec_id") >= rows[0] // 8 * 16) & (F.col("vec_id") < -(-rows[1] // 8) * 16))
    return t.select((F.col("vec_id") % 16).cast("int").alias("tx"), F.floor(F.col("vec_id") / 16).cast("int").alias("ty"), F.col("embedding").alias("data"))


def mosaic(spark, sf_dir: str) -> DataFrame:
    """(px, py, value) of all tiles."""
    from ..operators.raster import pixels

    return pixels(mosaic_tiles(spark, sf_dir), 8, 8).select(F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), "value")


MOSAIC = """emb AS (SELECT vec_id, embedding, unnest(range(64)) AS p FROM embeddings),
mosaic AS (SELECT CAST(vec_id % 16 * 8 + p % 8 AS INTEGER) AS px, CAST(vec_id // 16 * 8 + p // 8 AS INTEGER) AS py, CAST(embedding[p + 1] AS DOUBLE) AS value FROM emb)"""


def order_pixels(spark, sf_dir: str) -> DataFrame:
    """(px, py, value): a sparse raster of 64 x 64 pixels."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_orderkey") % 64).cast("int").alias("px"), (F.col("o_custkey") % 64).cast("int").alias("py")).agg(F.max("o_totalprice").alias("value"))


ORD = """ord AS (SELECT CAST(o_orderkey % 64 AS INTEGER) AS px, CAST(o_custkey % 64 AS INTEGER) AS py, max(o_totalprice) AS value FROM orders GROUP BY 1, 2)"""


def customer_points(spark, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return spread(table(spark, sf_dir, "customer"), "c_custkey").select(k.alias("k"), ((k % 128) + 0.25).cast("double").alias("x"), ((k * 7) % 128 + 0.5).cast("double").alias("y"), "c_name", "c_acctbal", "c_mktsegment")


CUS = """cus AS (SELECT c_custkey AS k, (c_custkey % 128) + 0.25::DOUBLE AS x, (c_custkey * 7) % 128 + 0.5::DOUBLE AS y, c_name, c_acctbal, c_mktsegment FROM customer)"""


def part_boxes(spark, sf_dir: str, rows: int = ROWS) -> DataFrame:
    """(fid, geom, p_name, p_size): rectangles around the parts, some ``rows`` a task."""
    k, h = F.col("p_partkey"), F.col("p_size") / 8.0
    x, y = (k % 128).cast("double"), ((k * 5) % 128).cast("double")
    return spread(table(spark, sf_dir, "part"), "p_partkey", rows).select(k.alias("fid"), gm.box(x - h, y - h, x + h, y + h).alias("geom"), "p_name", "p_size")


PART = """prt AS (SELECT p_partkey AS fid, (p_partkey % 128)::DOUBLE AS x, ((p_partkey * 5) % 128)::DOUBLE AS y, p_size / 8.0::DOUBLE AS h, p_name, p_size FROM part),
box AS (SELECT fid, x - h AS minx, x + h AS maxx, y - h AS miny, y + h AS maxy, p_name, p_size FROM prt)"""


def flat(fp, prefix: str = "") -> list:
    """The fields of a footprint as columns."""
    return [fp[n].alias(prefix + n) for n in fpx.FIELDS]


def shared(spark, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    import uuid

    from ..plans.lineage import shared_dir
    from ..sources import files

    folder = f"{shared_dir(spark)}/gridloom/{uuid.uuid4().hex}"
    fs, p = files.at(folder)
    fs.create_dir(p, recursive=True)
    return f"{folder}/{name}"
