"""Tables that are written to in place: what a write costs, what readers see, and what is left of a writer that fails."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.catalogue import Dataset
from gridloom.footprint import Footprint
from gridloom.sources.versioned import Conflict, Versioned

SCHEMA = "k int, v string"
FP = Footprint.of((0, 4096), (4096, 4096), (4096, 4096))


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    s = Versioned.create(spark, f"{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema, ["k"])
    s.write(spark.createDataFrame([(k, f"a{k}") for k in range(100)], SCHEMA))
    return s


def test_versions_and_removed_rows(spark, store):
    two = store.write(spark.createDataFrame([(3, "b3"), (200, "b200")], SCHEMA))
    three = store.remove(spark.createDataFrame([(4,), (200,), (999,)], "k int"))
    four = store.write(spark.createDataFrame([(4, "c4"), (5, None)], SCHEMA))
    old = {k: f"a{k}" for k in range(100)}
    assert rows(store.read(1)) == sorted(old.items())
    assert rows(store.read(two)) == sorted((old | {3: "b3", 200: "b200"}).items())
    gone = {k: v for k, v in (old | {3: "b3"}).items() if k != 4}
    assert rows(store.read(three)) == sorted(gone.items())
    now = gone | {4: "c4", 5: None}
    assert {r["k"]: r["v"] for r in store.read(four).collect()} == {r["k"]: r["v"] for r in store.read().collect()} == now
    assert rows(store.read(ranges={"k": (3, 4)})) == [(3, "b3"), (4, "c4")]
    for whole in (False, True):
        store.compact(whole)
        assert {r["k"]: r["v"] for r in store.read().collect()} == now
    assert len(store.version()[1]["parts"]) == 1 and rows(store.read(two)) == sorted((old | {3: "b3", 200: "b200"}).items())
    store.vacuum()
    assert store.versions() == [store.version()[0]] and {r["k"]: r["v"] for r in store.read().collect()} == now
    with pytest.raises(ValueError, match="no version"):
        store.read(two)


def test_parts_merge_before_the_base(spark, store):
    for k in range(4):
        store.write(spark.createDataFrame([(k, "x"), (300 + k, "y")], SCHEMA))
    before = rows(store.read())
    store.compact()
    assert len(store.version()[1]["parts"]) == 2 and rows(store.read()) == before


def test_keys_are_unique_and_not_null(spark, store):
    for bad in ([(1, "x"), (1, "y")], [(None, "x")]):
        with pytest.raises(ValueError, match="its own"):
            store.write(spark.createDataFrame(bad, SCHEMA))
    assert store.version()[0] == 1 and store.write(spark.createDataFrame([], SCHEMA)) == 1


def test_a_writer_that_fails_leaves_nothing_that_is_read(spark, store):
    before = rows(store.read())
    broken = spark.createDataFrame([(1, "x"), (2, "y")], SCHEMA).withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        store.write(broken)
    # and one that was stopped while it wrote its list
    open(f"{store.path}/versions/{2:010d}.json", "w").close()
    assert rows(store.read()) == before and store.versions() == [0, 1]
    assert store.write(spark.createDataFrame([(1, "z")], SCHEMA)) == 3 and (1, "z") in rows(store.read())
    store.vacuum()
    assert len(os.listdir(f"{store.path}/parts")) == 2


def test_two_writers(spark, store):
    since = store.version()[0]
    store.write(spark.createDataFrame([(10, "first")], SCHEMA), since)
    store.write(spark.createDataFrame([(20, "second")], SCHEMA), since)  # elsewhere: laid over the other
    with pytest.raises(Conflict):
        store.write(spark.createDataFrame([(10, "third")], SCHEMA), since)
    assert {(10, "first"), (20, "second")} <= set(rows(store.read()))


def test_bytes_follow_the_window(spark, tmp_path):
    """A raster of 16 x 16 tiles of 256 pixels: one pixel costs a tile, and an old reader doesn't see it."""
    path = f"{tmp_path}/r"
    r = Dataset(spark).create_raster("r", path, FP, "float64", 1, driver="tiles")
    assert size(path) == 0
    noise = np.random.default_rng(1).random((512, 512))
    r.set_data(noise, FP.clip(1024, 1024, 1536, 1536))
    four = size(path)
    r.set_data(np.full((1, 1), 5.0), FP.clip(1100, 1100, 1101, 1101))
    assert 0 < size(path) - four < 0.4 * four
    want = noise.copy()
    want[76, 76] = 5.0
    window = FP.clip(1024, 1024, 1536, 1536)
    assert (r.get_data(window, 0) == want).all()
    again = Dataset(spark)
    assert (again.open_raster("old", path, "tiles", ["version=1"]).get_data(window, 0) == noise).all()
    assert (again.open_raster("new", path, "tiles").get_data(window, 0) == want).all()
    assert (again["new"].get_data(FP.clip(0, 0, 20, 30), 0) == 0).all()
    with pytest.raises(ValueError, match="older"):
        again.open_raster("w", path, "tiles", ["version=1"], "w")
    r.delete()
    assert not os.path.exists(path)


def test_a_read_opens_the_parts_under_its_window(spark, tmp_path):
    r = Dataset(spark).create_raster("r", f"{tmp_path}/r", FP, "float64", 1, driver="tiles")
    for k in (0, 1, 2):
        r.set_data(np.ones((10, 10)), FP.clip(1000 * k, 0, 1000 * k + 10, 10))
    assert len(r.store.version()[1]["parts"]) == 3
    assert len({f.split("/parts/")[1][:32] for f in r.tiles((1000, 0, 1010, 10)).inputFiles()}) == 1


def test_features_one_by_one(spark, tmp_path):
    path = f"{tmp_path}/v"
    ds = Dataset(spark)
    v = ds.create_vector("v", path, "point", [{"name": "n", "type": "int32"}], driver="table")
    for k in range(3):
        v.insert_data({"type": "Point", "coordinates": [float(k), 1.0]}, [k])
    v.insert_data({"type": "Point", "coordinates": [9.0, 9.0]}, [7], index=1)
    got = list(ds.open_vector("w", path, driver="table").iter_data(["n"], "wkt"))
    assert [n for _, n in got] == [0, 7, 2] and len(v) == 3 and v.bounds == (0.0, 1.0, 9.0, 9.0)
    v.remove_rows(spark.createDataFrame([(0,)], "fid long"))
    assert len(v) == 2
    with pytest.raises(RuntimeError, match="removes"):
        ds.create_vector("m", "", "point", driver="Memory").remove_rows(spark.createDataFrame([(0,)], "fid long"))
