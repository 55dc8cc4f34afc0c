"""Copies of points and shapes joined together, pixels of zones."""

from pyspark.sql import functions as F

from gridloom.functions import geometry as gm
from gridloom.operators import spatial_join
from gridloom.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_copies_of_points_and_shapes_are_joined_together(spark, monkeypatch):
    points = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 3 + 0.5).alias("x"), F.lit(0.5).alias("y"))
    c = lambda n: F.lit(float(n))
    shapes = spark.range(50).select(F.col("id").alias("fid"), gm.box(c(0), c(0), F.when(F.col("id") % 2 == 0, 1.0).otherwise(2.0), c(1)).alias("geom"))
    met = []
    join = spatial_join.overlap_join
    monkeypatch.setattr(spatial_join, "overlap_join", lambda a, b, *r, **k: met.append((a.count(), b.count())) or join(a, b, *r, **k))
    got = [tuple(r) for r in spatial_join.points_in_polygons(points, shapes).select("k", "fid", "x").collect()]
    assert met == [(3, 2)]
    assert sorted(got) == [(k, f, k % 3 + 0.5) for k in range(300) for f in range(50) if k % 3 == 0 or (k % 3 == 1 and f % 2)]
    parts = spatial_join.gathered(points, ["x", "y"], "r", 20).select(F.size("r").alias("n")).collect()
    assert sum(r["n"] for r in parts) == 300 and max(r["n"] for r in parts) < 60


def test_pixels_of_zones_are_never_broadcast(spark):
    assert "BroadcastHashJoin" not in QUERIES["zonal_stats"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_copies_are_dealt_to_many_tasks_and_unfolded_in_pieces(spark, monkeypatch):
    """A few rows of few bytes hold all pairs; they were unfolded by one task, all pairs of a row at once."""
    points = spark.range(600).select(F.col("id").alias("k"), (F.col("id") % 6 + 0.5).alias("x"), F.lit(0.5).alias("y"))
    c = lambda n: F.lit(float(n))
    shapes = spark.range(40).select(F.col("id").alias("fid"), gm.box(F.col("id") % 4 + 0.0, c(0), F.col("id") % 4 + 2.0, c(1)).alias("geom"))
    got = spatial_join.points_in_polygons(points, shapes).select("k", "fid")
    sizes = [len(p) for p in got.rdd.mapPartitions(lambda rows: [[tuple(r) for r in rows]]).collect()]
    assert len(sizes) >= 8 and sum(n > 0 for n in sizes) > 2 and max(sizes) < sum(sizes) / 2
    want = sorted((k, f) for k in range(600) for f in range(40) if f % 4 <= k % 6 < f % 4 + 2)
    assert sorted(map(tuple, got.collect())) == want
    slices = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode(transform" in line]
    assert slices and not any("*(" in line for line in slices)
    for piece in (1, 7, 250):
        monkeypatch.setattr(spatial_join, "PIECE", piece)
        assert sorted(map(tuple, spatial_join.points_in_polygons(points, shapes).select("k", "fid").collect())) == want


def test_rows_of_few_pairs_are_not_dealt_again(spark, monkeypatch):
    dealt = []
    unfolded = spatial_join.unfolded
    monkeypatch.setattr(spatial_join, "unfolded", lambda df, a, b, deal: dealt.append(deal) or unfolded(df, a, b, deal))
    points = spark.range(100).select(F.col("id").alias("k"), F.col("id").cast("double").alias("x"), F.lit(0.5).alias("y"))
    shapes = spark.range(50).select(F.col("id").alias("fid"), gm.box(F.col("id") - 0.5, F.lit(0.0), F.col("id") + 0.5, F.lit(1.0)).alias("geom"))
    assert sorted(map(tuple, spatial_join.points_in_polygons(points, shapes).select("k", "fid").collect())) == [(k, k) for k in range(50)]
    assert spatial_join.points_in_polygons(points.limit(0), shapes).count() == 0
    assert dealt == [False, False]
