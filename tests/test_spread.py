"""Rows of small files over all tasks, expressions made once a row."""

import re
from collections import Counter

from pyspark.sql import functions as F

from gridloom.functions import geometry as gm
from gridloom.operators import tiling, vector
from gridloom.plans.spread import once, spread
from gridloom.queries import QUERIES, vectors
from gridloom.queries.base import footprints, part_boxes

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_small_table_is_worked_on_by_all_tasks(spark):
    n = spark.sparkContext.defaultParallelism
    assert footprints(spark, SF).rdd.getNumPartitions() == n and part_boxes(spark, SF).rdd.getNumPartitions() == n
    assert spread(spark.range(1000), "id", 10).rdd.getNumPartitions() == 100


def test_what_a_filter_names_is_made_once(spark):
    d = once(spark.range(4), v=F.array_max(F.transform(F.array("id", F.lit(2)), lambda x: x * 3)))
    assert plan(d.where("v > 6 and v < 20 and v <> 7")).count("array_max") == 1
    frames = plan(vector.read(vectors.frames(spark, SF), None, vectors.BOX))
    assert len(re.findall("array_min", frames)) <= 4 and frames.count("raise_error") <= 2


def test_wkt_is_parsed_once(spark):
    d = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))",), ("MULTIPOINT Z (1 2 3, 4 5 6)",), ("POINT (1 2)",), ("POLYGON EMPTY",), (None,)], "t string")
    g = d.select(gm.from_wkt(F.col("t")).alias("g"))
    assert len(plan(g)) < 20_000
    got = [r["g"] and (r["g"]["type"], r["g"]["has_z"], [len(p) for p in r["g"]["parts"]]) for r in g.collect()]
    assert got == [("Polygon", False, [2]), ("MultiPoint", True, [1, 1]), ("Point", False, [1]), None, None]


def test_the_layer_of_frames_takes_its_fields_along(spark):
    d = vectors._layer(spark, SF)
    assert "Join" not in plan(d) and d.columns == ["fid", "geom", "p_name", "p_size"]


def test_what_the_pixels_of_a_footprint_share_is_made_once_a_footprint(spark):
    d = QUERIES["meshgrid_raster_in"](spark, SF)
    above = plan(d).split("explode(sequence(")[0]
    assert "SQRT" not in above and "transform" not in above


def test_a_tiling_is_checked_by_rows(spark):
    tile = lambda k, x, y, w, h, fw=9, fh=5: (k, (0.0, 1.0, 0.0, 0.0, 0.0, -1.0, fw, fh), (float(x), 1.0, 0.0, float(-y), 0.0, -1.0, w, h))
    few = [tile(1, 0, 0, 5, 3), tile(1, 3, 1, 4, 4), tile(1, 3, 1, 2, 2), tile(1, -2, 4, 4, 3), tile(2, 8, 0, 3, 1), tile(2, 1, 1, 1, 1)]
    kind = "tlx double, dx double, rx double, tly double, ry double, dy double, rsx int, rsy int"
    made = lambda rows: spark.createDataFrame(rows, f"k int, fp struct<{kind}>, tile struct<{kind}>")
    held, outside = Counter(), 0
    for k, f, t in few:
        x, y = int(t[0]), int(-t[3])
        px = [(k, i, j) for i in range(x, x + t[6]) for j in range(y, y + t[7])]
        inside = [p for p in px if 0 <= p[1] < 9 and 0 <= p[2] < 5]
        held.update(inside)
        outside += len(inside) < len(px)
    want = (2 * 45 - len(held), sum(n > 1 for n in held.values()), outside)
    assert tuple(tiling.is_tiling(made(few), by="k").first()) == want
    # two tiles of 150 million columns each, one short of the end
    wide = [tile(1, 0, 0, 150_000_000, 1, 300_000_000, 1), tile(1, 149_999_998, 0, 150_000_000, 1, 300_000_000, 1)]
    assert tuple(tiling.is_tiling(made(wide)).first()) == (2, 2, 0)
    assert tiling.is_tiling(made(few).limit(0)).first()["overlapping"] == 0


def test_tiles_of_one_place_are_counted_before_they_become_pixels(spark):
    d = plan(QUERIES["tile_occurrence"](spark, SF))
    assert d.count("Aggregate [") == 2 and d.count("SQRT") < 40


def test_crossings_are_sorted_without_a_comparator(spark):
    d = plan(QUERIES["burn_lines_all_touched"](spark, SF))
    assert "sort_array" in d and "array_sort" not in d


def test_burning_groups_where_the_rows_were_spread(spark):
    for name in ("burn_polygons_all_touched", "burn_lines"):
        physical = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in physical and "ENSURE_REQUIREMENTS" not in physical


def test_a_task_burns_as_many_polygons_whatever_the_table(spark, tmp_path):
    n, k = 40_000, F.col("id")
    spark.range(n).select(k.alias("p_partkey"), k.cast("string").alias("p_name"), (k % 50 + 1).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("burn_polygons", "burn_polygons_all_touched"):
        assert QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() >= n // 2048, name
