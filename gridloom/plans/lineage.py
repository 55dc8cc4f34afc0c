"""The folder all executors see, cut lineage, global ranks and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where that is unset and everything runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    return _LOCAL[app]


def cut(df: DataFrame, dictionary: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that outlive executors.

    Columns of hashes are written and read faster without a ``dictionary``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{uuid.uuid4().hex}"
    with _shuffles_end(spark):
        df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within are deleted as it ends, rather than when the driver happens to collect its garbage."""
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if old is None else spark.conf.set(CLEANUP, old)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a table made by ``cut`` that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
        if "/gridloom/" in folder.toString():
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Null-safe equality of columns that both sides carry under the same names."""
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """``df`` plus ``name``: the gapless rank in ``order`` within each value of ``by``.

    A plain window puts a hot value of ``by`` into one task.  Here rows are range-partitioned on
    ``by`` and ``order``, each partition ranks its own rows, and the rows that precede a partition
    are added from a table with one row for each partition and value.
    """
    part = cut(df.repartitionByRange(*by, *order).withColumn("__gl_p", F.spark_partition_id()))
    keys = ["__gl_p", *by]
    before = part.groupBy(*keys).agg(F.count(F.lit(1)).alias("__gl_n"))
    w = Window.partitionBy(*by).orderBy("__gl_p").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(
        *[F.col(k).alias(f"__gl_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("__gl_n").over(w), F.lit(0)).alias("__gl_before"),
    )
    local = part.withColumn("__gl_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & local[k].eqNullSafe(before[f"__gl_k{i}"])
    return local.join(before, cond).select(
        *[c for c in df.columns],
        (F.col("__gl_before") + F.col("__gl_r") - 1 + start).cast("long").alias(name),
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges`` as (node, root), root the smallest node.

    Distributed union-find by alternating large-star and small-star rounds.  Each round is one
    aggregate and one join on the node; its edges are written to the shared folder, so the lineage
    stays one round long and a lost executor costs at most that round.  Nodes without an edge do not
    appear.  Edges between a node and itself, nulls and repeated edges are ignored.
    """
    spark = edges.sparkSession
    x, y = F.col(a), F.col(b)
    now = cut(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
        .distinct()
    )
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(state) == seen or state["n"] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(state)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        after = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        drop_cut(now)
        drop_cut(large)
        now = after
