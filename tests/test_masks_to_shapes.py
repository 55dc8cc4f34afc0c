"""Rings, thinning and lines of masks against plain versions that hold the whole mask."""

import collections
import random

import numpy as np
import pytest

from gridloom.footprint import Footprint
from gridloom.operators import rasterize
from gridloom.plans import ranking

MASK = "px int, py int"


def table(spark, a):
    return spark.createDataFrame([(int(x), int(y)) for y, x in zip(*np.nonzero(a))], MASK)


def masks():
    rng = np.random.default_rng(4)
    some = [rng.random((12, 15)) < p for p in (0.3, 0.5, 0.7)]
    ring = np.ones((9, 9), bool)
    ring[2:7, 2:7] = False
    ring[4, 4] = True
    return [*some, ring, np.eye(6, dtype=bool)]


def spiral(n):
    a = np.zeros((n, n), bool)
    y, x, dy, dx = 0, 0, 0, 1
    a[0, 0] = True
    free = lambda y, x: 0 <= y < n and 0 <= x < n and not a[y, x]
    while True:
        if not free(y + dy, x + dx) or (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n and a[y + 2 * dy, x + 2 * dx]):
            dy, dx = dx, -dy
            if not free(y + dy, x + dx) or (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n and a[y + 2 * dy, x + 2 * dx]):
                return a
        y, x = y + dy, x + dx
        a[y, x] = True


def plain_rings(a):
    """The corners of all rings by walking along the sides of pixels, turned to begin at the smallest (y, x, way)."""
    h, w = a.shape
    full = lambda x, y: 0 <= x < w and 0 <= y < h and a[y, x]
    moves = [((0, 0), (1, 0), (0, -1)), ((1, 0), (1, 1), (1, 0)), ((1, 1), (0, 1), (0, 1)), ((0, 1), (0, 0), (-1, 0))]
    sides = {(x + s[0], y + s[1], k): (x + e[0], y + e[1]) for y in range(h) for x in range(w) if a[y, x] for k, (s, e, out) in enumerate(moves) if not full(x + out[0], y + out[1])}
    rings = []
    while sides:
        here = next(iter(sides))
        walk = []
        while here in sides:
            walk.append(here)
            x, y = sides.pop(here)
            here = next((c for c in ((x, y, (here[2] + 1) % 4), (x, y, here[2]), (x, y, (here[2] - 1) % 4)) if c in sides), None)
        corners = [p for i, p in enumerate(walk) if p[2] != walk[i - 1][2]]
        k = min(range(len(corners)), key=lambda i: (corners[i][1], corners[i][0], corners[i][2]))
        rings.append(tuple((x, y) for x, y, _ in corners[k:] + corners[:k]))
    return sorted(rings)


@pytest.mark.parametrize("k", range(5))
def test_rings_against_a_walk(spark, k):
    a = masks()[k]
    got = collections.defaultdict(list)
    parts = collections.defaultdict(set)
    for r in rasterize.polygon_rings(table(spark, a)).collect():
        got[r["ring"]].append((r["rank"], r["x"], r["y"]))
        parts[r["ring"]].add(r["component"])
    assert all(len(c) == 1 for c in parts.values())
    assert sorted(tuple((x, y) for _, x, y in sorted(v)) for v in got.values()) == plain_rings(a)


def test_a_ring_over_many_tasks(spark):
    """A spiral: one ring of some hundred corners; ordering it takes no Python and no group of a whole component."""
    a = spiral(33)
    rings = rasterize.polygon_rings(table(spark, a))
    plan = rings._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "collect_list" not in plan
    m = rasterize.ring_measures(rings).collect()
    assert len(m) == 1 and m[0]["area"] == a.sum() and m[0]["corners"] == len(plain_rings(a)[0]) > 50
    wkt = rasterize.find_polygons(table(spark, a), Footprint.of((0, 33), (33, 33), (33, 33))).first()["wkt"]
    assert wkt.startswith("POLYGON ((0.0 33.0, 33.0 33.0, ")


def test_areas_add_up_to_pixels(spark):
    a = masks()[2]
    m = rasterize.ring_measures(rasterize.polygon_rings(table(spark, a))).groupBy("component").agg({"area": "sum"}).collect()
    n = collections.Counter(r["component"] for r in rasterize.mask_components(table(spark, a)).collect())
    assert {r["component"]: r["sum(area)"] for r in m} == dict(n)


def test_list_ranking(spark):
    rng = random.Random(2)
    nodes = list(range(500))
    rng.shuffle(nodes)
    cuts = [0, 1, 3, 40, 41, 300, 500]
    cycles = [nodes[s:e] for s, e in zip(cuts, cuts[1:])]
    links = [(v, c[(i + 1) % len(c)]) for c in cycles for i, v in enumerate(c)]
    got = {r["node"]: (r["root"], r["rank"]) for r in ranking.cycle_ranks(spark.createDataFrame(links, "node long, nxt long")).collect()}
    want = {v: (min(c), (i - c.index(min(c))) % len(c)) for c in cycles for i, v in enumerate(c)}
    assert got == want
    open_ = [(v, c[i + 1] if i + 1 < len(c) else None) for c in cycles for i, v in enumerate(c)]
    got = {r["node"]: (r["end"], r["d"]) for r in ranking.list_ranks(spark.createDataFrame(open_, "node long, nxt long")).collect()}
    assert got == {v: (c[-1], len(c) - 1 - i) for c in cycles for i, v in enumerate(c)}


def plain_thin(a, rounds=None):
    """Guo and Hall's rule, pixel by pixel, as it is published."""
    a = np.pad(a, 1)
    k = 0
    while rounds is None or k < rounds:
        before = a.copy()
        for half in (0, 1):
            gone = []
            for y, x in zip(*np.nonzero(a)):
                p = [None, a[y, x + 1], a[y - 1, x + 1], a[y - 1, x], a[y - 1, x - 1], a[y, x - 1], a[y + 1, x - 1], a[y + 1, x], a[y + 1, x + 1], a[y, x + 1]]
                c = sum((not p[i]) and (p[i + 1] or p[i + 2]) for i in (1, 3, 5, 7))
                n = min(sum(p[i] or p[i + 1] for i in (1, 3, 5, 7)), sum(p[i] or p[i + 1] for i in (2, 4, 6, 8)))
                m = (p[6] or p[7] or not p[4]) and p[5] if half else (p[2] or p[3] or not p[8]) and p[1]
                if c == 1 and 2 <= n <= 3 and not m:
                    gone.append((y, x))
            for q in gone:
                a[q] = False
        k += 1
        if (a == before).all():
            break
    return a[1:-1, 1:-1]


@pytest.mark.parametrize("rounds", [None, 1, 5])
def test_thinning_over_tiles(spark, rounds):
    """Blobs that lie across many tiles, thick enough for several exchanges."""
    rng = np.random.default_rng(6)
    y, x = np.mgrid[:150, :170]
    a = np.zeros((150, 170), bool)
    for _ in range(14):
        cy, cx, ry, rx = rng.uniform(0, 150), rng.uniform(0, 170), rng.uniform(3, 30), rng.uniform(3, 30)
        a |= ((y - cy) / ry) ** 2 + ((x - cx) / rx) ** 2 < 1
    a &= rng.random(a.shape) < 0.995
    got = np.zeros_like(a)
    for r in rasterize.thin(table(spark, a), rounds).collect():
        got[r["py"], r["px"]] = True
    assert (got == plain_thin(a, rounds)).all()


def plain_lines(a):
    """Lines of a thinned mask, as sets of points in order: blocks drawn to their upper left pixel, segments merged where two meet."""
    h, w = a.shape
    on = {(x, y) for y, x in zip(*np.nonzero(a))}
    link = {}
    for y in range(h - 1):
        for x in range(w - 1):
            if all((x + i, y + j) in on for i in (0, 1) for j in (0, 1)):
                link.update({(x + i, y + j): (x, y) for i in (0, 1) for j in (0, 1)})
    paths = []
    for x, y in on:
        for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1)):
            q = (x + dx, y + dy)
            if q not in on or (dx and dy and ((x, q[1]) in on or (q[0], y) in on)) or ((x, y) in link and q in link):
                continue
            path = [link.get((x, y), (x, y)), (x, y), q, link.get(q, q)]
            paths.append([p for i, p in enumerate(path) if not i or p != path[i - 1]])
    while True:
        at = collections.defaultdict(list)
        for i, p in enumerate(paths):
            at[p[0]].append(i)
            at[p[-1]].append(i)
        pair = next(((i, j, p) for p, (i, j) in ((p, v) for p, v in at.items() if len(v) == 2) if i != j), None)
        if pair is None:
            break
        i, j, p = pair
        first = paths[i] if paths[i][-1] == p else paths[i][::-1]
        last = paths[j] if paths[j][0] == p else paths[j][::-1]
        paths = [q for k, q in enumerate(paths) if k not in (i, j)] + [first + last[1:]]
    return sorted(canonical(p) for p in paths)


def canonical(path):
    path = [(int(x), int(y)) for x, y in path]
    if path[0] != path[-1]:
        return tuple(min(path, path[::-1]))
    ring = path[:-1]
    k = ring.index(min(ring))
    turned = ring[k:] + ring[:k]
    return tuple(min([*turned, turned[0]], [turned[0], *turned[:0:-1], turned[0]]))


def loops():
    a = np.zeros((14, 30), bool)
    a[1:6, 1:6] = True
    a[2:5, 2:5] = False  # a closed line
    a[8, 1:12] = a[4:12, 8] = True  # a cross
    a[3:5, 20:22] = True  # a block with three lines
    a[3, 22:26] = a[5:9, 20] = a[2, 15:20] = True
    a[10, 20] = True  # alone
    return a


@pytest.mark.parametrize("k", range(3))
def test_lines_against_plain_merging(spark, k):
    a = [loops(), plain_thin(np.random.default_rng(1).random((24, 24)) < 0.45), plain_thin(np.random.default_rng(2).random((24, 24)) < 0.7)][k]
    pieces = rasterize.collapsed(rasterize.line_segments(table(spark, a)), rasterize.block_links(table(spark, a)))
    found = collections.defaultdict(list)
    for r in rasterize.chains(pieces).orderBy("line", "rank").collect():
        part = [(p["x"], p["y"]) for p in r["path"]]
        assert not found[r["line"]] or found[r["line"]][-1] == part[0]
        found[r["line"]] += part[1:] if found[r["line"]] else part
    assert sorted(canonical(p) for p in found.values()) == plain_lines(a)


def test_burning_on_a_turned_raster(spark):
    """A grid turned by 30 degrees: shapes given in its own pixels burn as on a straight one."""
    import math

    from gridloom.functions import geometry as gm
    from gridloom.functions import types as ty

    c, s = math.cos(math.radians(30)), math.sin(math.radians(30))
    turned, straight = Footprint(100.0, 2 * c, 2 * s, 500.0, 2 * s, -2 * c, 16, 16), Footprint(0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 16, 16)
    rng = random.Random(3)
    shapes = [("LineString", [(2.5, 2.5), (12.5, 2.5)]), ("Polygon", [[(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0), (2.0, 2.0)]])]
    shapes += [("Polygon", [[*(ring := [(rng.uniform(-3, 19), rng.uniform(-3, 19)) for _ in range(5)]), ring[0]]]) for _ in range(8)]
    shapes += [("LineString", [(rng.uniform(-3, 19), rng.uniform(-3, 19)) for _ in range(4)]) for _ in range(8)]
    burnt = []
    for fp in (straight, turned):
        lay = lambda p: [lay(q) for q in p] if isinstance(p, list) else fp.at(*p)  # noqa: E731, B023
        rows = [(k, gm.value_of({"type": t, "coordinates": lay(p)})) for k, (t, p) in enumerate(shapes)]
        df = spark.createDataFrame(rows, f"k int, geom {ty.GEOM.simpleString()}")
        polygons = {k for k, (t, _) in enumerate(shapes) if t == "Polygon"}
        areas, lines = df.where(df["k"].isin(*polygons)), df.where(~df["k"].isin(*polygons))
        burnt.append([{tuple(r) for r in f(d, fp, "k", all_touched=a).select("k", "px", "py").collect()} for f, d in ((rasterize.burn_polygons, areas), (rasterize.burn_lines, lines)) for a in (False, True)])
    assert burnt[0][0] >= {(1, x, y) for x in range(2, 6) for y in range(2, 6)} and {(0, x, 2) for x in range(2, 13)} <= burnt[0][2]
    # a corner or a side on the line between pixels may fall on either side of it
    for a, b in zip(*burnt):
        assert len(a ^ b) <= 0.03 * len(a) + 4
    assert burnt[0][0] == burnt[1][0]
