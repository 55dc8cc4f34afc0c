"""Demand through graphs of recipes: what is computed, how often, and what is not."""

import collections
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.catalogue import Dataset
from gridloom.footprint import Footprint
from gridloom.operators import recipe

SIDE = 64
FP = Footprint.of((0, SIDE), (SIDE, SIDE), (SIDE, SIDE))
GRID = np.arange(SIDE * SIDE, dtype=float).reshape(SIDE, SIDE) % 97


def noted(folder, name, compute):
    """``compute``, which leaves a file for each call."""

    def run(fp, fps, arrays, raster):
        x, y = (round(v) for v in FP.inverse(fp.tlx, fp.tly))
        open(os.path.join(folder, f"{name}-{x // 8}-{y // 8}-{uuid.uuid4().hex}"), "w").close()
        return compute(arrays)

    return run


def calls(folder):
    """Number of calls by recipe and tile."""
    return collections.Counter(tuple(f.split("-")[:3]) for f in os.listdir(folder))


def pixels(spark):
    rows = [(x, y, float(GRID[y, x])) for y in range(SIDE) for x in range(SIDE)]
    return recipe.tiles_of_bands(spark.createDataFrame(rows, "px int, py int, value double").withColumn("band", F.lit(0)), FP, (8, 8), 0.0)


def graph(spark, folder, caches=(None, None, None)):
    """base -> smooth (halo 1) -> top (halo 1), which reads base as well; all of 8 x 8 tiles."""
    wide = lambda f: f.dilate(1)
    base = recipe.Recipe(FP, noted(folder, "base", lambda a: a["m"] + 1), {"m": recipe.Primitive(pixels(spark), FP, (8, 8))}, tile=(8, 8), cache=caches[0])
    smooth = recipe.Recipe(FP, noted(folder, "smooth", lambda a: a["b"][1:-1, :-2] + a["b"][1:-1, 2:]), {"b": base.primitive(spark)}, convert={"b": wide}, tile=(8, 8), cache=caches[1])
    top = recipe.Recipe(FP, noted(folder, "top", lambda a: a["s"][:-2, 1:-1] + a["s"][2:, 1:-1] - a["b"]), {"s": smooth.primitive(spark), "b": base.primitive(spark)}, convert={"s": wide}, tile=(8, 8), cache=caches[2])
    return base, smooth, top


def plain():
    b = np.pad(GRID + 1, 1)
    s = np.pad(b[1:-1, :-2] + b[1:-1, 2:], 1)
    return s[:-2, 1:-1] + s[2:, 1:-1] - (GRID + 1)


def test_only_tiles_under_the_haloes_are_computed_and_each_once(spark, tmp_path):
    _, _, top = graph(spark, tmp_path)
    got = top.get_data(spark, FP.clip(24, 32, 32, 40))
    assert (got == plain()[32:40, 24:32]).all()
    n = calls(tmp_path)
    assert set(n.values()) == {1}, "a tile that two recipes read is computed once"
    by = collections.defaultdict(set)
    for name, x, y in n:
        by[name].add((int(x), int(y)))
    assert by["top"] == {(3, 4)}
    assert by["smooth"] == {(x, y) for x in (2, 3, 4) for y in (3, 4, 5)}
    assert by["base"] == {(x, y) for x in (1, 2, 3, 4, 5) for y in (2, 3, 4, 5, 6)}


def test_the_whole_raster_and_the_edge(spark, tmp_path):
    _, _, top = graph(spark, tmp_path)
    assert (top.get_data(spark) == plain()).all()
    assert set(calls(tmp_path).values()) == {1} and len(calls(tmp_path)) == 3 * 64
    assert (top.get_data(spark, FP.clip(0, 0, 8, 8)) == plain()[:8, :8]).all()


def test_cached_tiles_ask_for_nothing_upstream(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    _, _, top = graph(spark, notes, (f"{tmp_path}/a", f"{tmp_path}/b", None))
    assert not os.listdir(notes), "creating recipes computes nothing"
    window = FP.clip(24, 32, 32, 40)
    first = top.get_data(spark, window)
    n = calls(notes)
    assert (top.get_data(spark, window) == first).all()
    again = calls(notes) - n
    assert {k[0] for k in again} == {"top"}
    # a neighbouring window computes what the caches lack
    assert (top.get_data(spark, FP.clip(32, 32, 40, 40)) == plain()[32:40, 32:40]).all()
    new = {k for k in calls(notes) - n if k[0] != "top"}
    assert {x for name, x, _ in new if name == "smooth"} == {"5"} and {x for name, x, _ in new if name == "base"} == {"6"}


def test_a_file_is_opened_under_the_demand_only(spark, tmp_path, monkeypatch):
    from gridloom.sources import geotiff

    ds = Dataset(spark)
    path = f"{tmp_path}/a.tif"
    r = ds.create_raster("a", path, FP, "float64", 1)
    r.set_data(GRID)
    asked = []
    read = geotiff.read
    monkeypatch.setattr(geotiff, "read", lambda s, p, w=None: asked.append(w) or read(s, p, w))
    up = ds.create_raster_recipe("up", FP, "float64", 1, compute_array=lambda a, b, arrays, _: arrays["r"] * 3, queue_data_per_primitive={"r": r.queue_data if hasattr(r, "queue_data") else r}, computation_tiles=(8, 8))
    assert (up.get_data(FP.clip(8, 8, 16, 16), 0) == GRID[8:16, 8:16] * 3).all()
    assert asked and None not in asked


def test_a_circle_is_an_error(spark):
    one = recipe.Recipe(FP, lambda *a: None, tile=(8, 8))
    two = recipe.Recipe(FP, lambda *a: None, {"o": one.primitive(spark)}, tile=(8, 8))
    one.primitives["t"] = two.primitive(spark)
    with pytest.raises(ValueError, match="circle"):
        one.tile_table(spark)
