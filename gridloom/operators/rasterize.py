"""Between pixels and geometries: burning polygons and lines, components, boundaries and lines of masks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..footprint import Footprint
from ..plans.lineage import components, cut, drop_cut


def edges(shapes: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """(key, x1, y1, x2, y2): the sides of all rings of all parts."""
    r = shapes.select(key, F.explode(F.col(geom)["parts"]).alias("part")).select(key, F.explode("part").alias("ring"))
    p = r.select(key, "ring", F.explode(F.sequence(F.lit(0), F.size("ring") - 2)).alias("i")).where(F.size("ring") > 1)
    a, b = F.get("ring", F.col("i")), F.get("ring", F.col("i") + 1)
    return p.select(key, a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def pixel_edges(shapes: DataFrame, fp: Footprint, key: str, geom: str) -> DataFrame:
    """(key, u1, v1, u2, v2): the sides of all rings in pixels from the corner of ``fp``, which may be turned."""
    det = fp.dx * fp.dy - fp.rx * fp.ry

    def place(x: str, y: str) -> tuple[Column, Column]:
        dx, dy = F.col(x) - fp.tlx, F.col(y) - fp.tly
        if fp.rx == 0 and fp.ry == 0:
            return dx / fp.dx, dy / fp.dy
        return (dx * fp.dy - dy * fp.rx) / det, (dy * fp.dx - dx * fp.ry) / det

    (u1, v1), (u2, v2) = place("x1", "y1"), place("x2", "y2")
    return edges(shapes, key, geom).select(key, u1.alias("u1"), v1.alias("v1"), u2.alias("u2"), v2.alias("v2"))


def burn_polygons(shapes: DataFrame, fp: Footprint, key: str, geom: str = "geom", all_touched: bool = False) -> DataFrame:
    """(key, px, py): the pixels of ``fp`` whose centre lies in a polygon, holes left out; with ``all_touched`` also those that a side passes.

    Each side is cut by the centre lines of the rows that it spans; the crossings of a row, in order,
    pair up to spans of pixels.
    """
    e = pixel_edges(shapes, fp, key, geom).where(F.col("v1") != F.col("v2"))
    first, last = F.greatest(F.ceil(F.least("v1", "v2") - 0.5).cast("int"), F.lit(0)), F.least(F.ceil(F.greatest("v1", "v2") - 0.5).cast("int") - 1, F.lit(fp.rsy - 1))
    rows = e.withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("py", F.explode(F.sequence("first", "last")))
    rows = rows.select(key, "py", (F.col("u1") + (F.col("py") + 0.5 - F.col("v1")) * (F.col("u2") - F.col("u1")) / (F.col("v2") - F.col("v1"))).alias("u"))
    w = Window.partitionBy(key, "py").orderBy("u")
    span = rows.withColumn("end", F.lead("u").over(w)).withColumn("n", F.row_number().over(w)).where("n % 2 = 1")
    a, b = F.greatest(F.ceil(F.col("u") - 0.5).cast("int"), F.lit(0)), F.least(F.ceil(F.col("end") - 0.5).cast("int") - 1, F.lit(fp.rsx - 1))
    filled = span.withColumn("a", a).withColumn("b", b).where("a <= b").select(key, F.explode(F.sequence("a", "b")).alias("px"), "py")
    return filled.unionByName(burn_lines(shapes, fp, key, geom, True)).distinct() if all_touched else filled


def labelled(burnt: DataFrame, order: str) -> DataFrame:
    """(px, py, label): of several shapes at a pixel the last one stays."""
    return burnt.groupBy("px", "py").agg(F.max(order).alias("label"))


def label_type(count: int) -> str:
    """The smallest unsigned pixel type that holds labels from 1 to ``count``."""
    return "uint8" if count < 1 << 8 else "uint16" if count < 1 << 16 else "uint32"


def touched(e: DataFrame, fp: Footprint, key: str) -> DataFrame:
    """(key, px, py): every pixel that a side (u1, v1, u2, v2) passes through.

    The side is cut where it crosses columns and rows; the middle of each stretch tells the pixel.
    """

    def crossings(a: str, b: str) -> Column:
        lo, hi = F.least(a, b), F.greatest(a, b)
        first, last = F.floor(lo).cast("int") + 1, F.ceil(hi).cast("int") - 1
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda k: (k - F.col(a)) / (F.col(b) - F.col(a)))).otherwise(F.array().cast("array<double>"))

    ts = F.sort_array(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), crossings("u1", "u2"), crossings("v1", "v2"))))
    t = e.withColumn("ts", ts).select("*", F.posexplode("ts").alias("i", "t0")).withColumn("t1", F.get("ts", F.col("i") + 1)).where("t1 is not null")
    mid = (F.col("t0") + F.col("t1")) / 2
    return t.select(key, F.floor(F.col("u1") + mid * (F.col("u2") - F.col("u1"))).cast("int").alias("px"), F.floor(F.col("v1") + mid * (F.col("v2") - F.col("v1"))).cast("int").alias("py"))


def burn_lines(lines: DataFrame, fp: Footprint, key: str, geom: str = "geom", all_touched: bool = False) -> DataFrame:
    """(key, px, py): the pixels that each side passes, one for each step along its longer direction; with ``all_touched`` all of them."""
    e = pixel_edges(lines, fp, key, geom)
    inside = (F.col("px") >= 0) & (F.col("px") < fp.rsx) & (F.col("py") >= 0) & (F.col("py") < fp.rsy)
    if all_touched:
        return touched(e, fp, key).where(inside).distinct()
    n = F.greatest(F.abs(F.floor("u2") - F.floor("u1")), F.abs(F.floor("v2") - F.floor("v1"))).cast("int")
    e = e.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    t = F.when(F.col("n") == 0, 0.0).otherwise(F.col("i") / F.col("n"))
    p = e.select(key, F.floor(F.col("u1") + t * (F.col("u2") - F.col("u1"))).cast("int").alias("px"), F.floor(F.col("v1") + t * (F.col("v2") - F.col("v1"))).cast("int").alias("py"))
    return p.where(inside).distinct()


def mask_components(mask: DataFrame) -> DataFrame:
    """(px, py, component) of a mask (px, py): 4-connected, numbered by their first pixel in row order.

    Runs of a row are the nodes, so the graph is smaller than the mask; runs of neighbouring rows that
    share a column are linked through their shared pixels.
    """
    wide = 1 << 31
    r = mask.select("px", "py").distinct().withColumn("g", F.col("px") - F.row_number().over(Window.partitionBy("py").orderBy("px")))
    r = r.withColumn("run", F.min(F.col("py").cast("long") * wide + F.col("px")).over(Window.partitionBy("py", "g")))
    below = r.select("px", (F.col("py") - 1).alias("py"), F.col("run").alias("b"))
    links = r.select("px", "py", F.col("run").alias("a")).join(below, ["px", "py"]).select("a", "b").distinct()
    root = components(links)
    return r.join(root, r["run"] == root["node"], "left").select("px", "py", F.coalesce("root", "run").alias("component"))


def boundary_edges(mask: DataFrame) -> DataFrame:
    """(px, py, side) of the pixel sides, n e s w, that face no pixel of the mask."""
    m = mask.select("px", "py").distinct()
    sides = F.array(*[F.struct(F.lit(s).alias("side"), (F.col("px") + x).alias("nx"), (F.col("py") + y).alias("ny")) for s, x, y in (("n", 0, -1), ("e", 1, 0), ("s", 0, 1), ("w", -1, 0))])
    s = m.select("px", "py", F.explode(sides).alias("s")).select("px", "py", "s.side", "s.nx", "s.ny")
    return s.join(m.select(F.col("px").alias("nx"), F.col("py").alias("ny")), ["nx", "ny"], "left_anti").select("px", "py", "side")


def ring_sides(mask: DataFrame) -> DataFrame:
    """(node, nxt, component, x, y, x2, y2, first): the straight sides of all rings of a mask, the mask on the right hand, and the side that follows each.

    Sides of pixels that continue each other are one side, found row by row and column by column.  Where two
    pixels touch at a corner alone the ring turns right, so it stays on its pixel.  ``first`` (py, px) is the first pixel, in row order, along the side.
    """
    sides = boundary_edges(mask).join(mask_components(mask), ["px", "py"])
    flat = F.col("side").isin("n", "s")
    s = sides.select("component", "side", F.when(flat, F.col("py")).otherwise(F.col("px")).alias("line"), F.when(flat, F.col("px")).otherwise(F.col("py")).alias("at"))
    s = s.withColumn("g", F.col("at") - F.row_number().over(Window.partitionBy("side", "line").orderBy("at")))
    s = s.groupBy("side", "line", "g").agg(F.min("at").alias("lo"), (F.max("at") + 1).alias("hi"), F.min("component").alias("component"))
    way = F.array_position(F.array(*map(F.lit, "nesw")), F.col("side")) - 1
    near, far = F.col("line"), F.col("line") + 1
    ends = {"n": ("lo", near, "hi", near), "e": (far, "lo", far, "hi"), "s": ("hi", far, "lo", far), "w": (near, "hi", near, "lo")}
    pick = lambda k: F.coalesce(*[F.when(F.col("side") == w, F.col(e[k]) if isinstance(e[k], str) else e[k]) for w, e in ends.items()]).cast("long")
    first = F.when(F.col("side").isin("n", "s"), F.struct(F.col("line").alias("py"), F.col("lo").alias("px"))).otherwise(F.struct(F.col("lo").alias("py"), F.col("line").alias("px")))
    s = s.select("component", way.alias("way"), *[pick(k).alias(n) for k, n in enumerate(("x", "y", "x2", "y2"))], first.alias("first"))
    s = cut(s.withColumn("node", F.shiftleft(F.col("y"), 33) + F.shiftleft(F.col("x"), 2) + F.col("way")))
    begin = s.groupBy(F.col("x").alias("x2"), F.col("y").alias("y2")).agg(F.min(F.struct("way", "node")).alias("a"), F.max(F.struct("way", "node")).alias("b"))
    right = F.col("a.way") == (F.col("way") + 1) % 4
    return s.join(begin, ["x2", "y2"]).select("node", F.when(right, F.col("a.node")).otherwise(F.col("b.node")).alias("nxt"), "component", "x", "y", "x2", "y2", "first")


def polygon_rings(mask: DataFrame) -> DataFrame:
    """(component, ring, rank, x, y, x2, y2, first): the sides of the rings of a mask (px, py) in their order, as a table.

    A ring is named by one of its sides; ranks count from 0.  No task holds a ring: sides are put in order by list ranking.
    """
    from ..plans.ranking import cycle_ranks

    s = cut(ring_sides(mask))
    return s.join(cycle_ranks(s.select("node", "nxt")), "node").select("component", F.col("root").alias("ring"), "rank", "x", "y", "x2", "y2", "first")


def ring_measures(rings: DataFrame) -> DataFrame:
    """(component, ring, py, px, area, length, corners) of ``polygon_rings``: the first pixel along each ring, its area in pixels, negative for holes, its length and number of corners."""
    area = F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / 2
    length = F.sum(F.abs(F.col("x2") - F.col("x")) + F.abs(F.col("y2") - F.col("y")))
    m = rings.groupBy("component", "ring").agg(F.min("first").alias("f"), area.alias("area"), length.alias("length"), F.count(F.lit(1)).alias("corners"))
    return m.select("component", "ring", F.col("f.py").alias("py"), F.col("f.px").alias("px"), "area", "length", "corners")


def find_polygons(mask: DataFrame, fp: Footprint) -> DataFrame:
    """(component, wkt) of the polygons of a mask, holes included: 4-connected, the outer ring first.

    Rings are ordered as tables (``polygon_rings``); a ring and a polygon are gathered only as the texts of their own rows.
    """
    rings = cut(polygon_rings(mask))
    at = F.concat_ws(" ", *[_text(F.lit(t) + F.col("x") * dx + F.col("y") * dy) for t, dx, dy in ((fp.tlx, fp.dx, fp.rx), (fp.tly, fp.ry, fp.dy))])
    points = F.transform(F.array_sort(F.collect_list(F.struct("rank", at.alias("p")))), lambda v: v["p"])
    area = F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))
    each = rings.groupBy("component", "ring").agg(points.alias("p"), area.alias("area"))
    # the outer ring is the only one of a positive area
    text = F.concat(F.lit("("), F.array_join(F.array_append("p", F.col("p")[0]), ", "), F.lit(")"))
    parts = each.groupBy("component").agg(F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("a"), "ring", text.alias("t")))).alias("r"))
    return parts.select("component", F.concat(F.lit("POLYGON ("), F.array_join(F.transform("r", lambda v: v["t"]), ", "), F.lit(")")).alias("wkt"))


def _text(c: Column) -> Column:
    return c.cast("double").cast("string")


#: pixels of a tile's side while thinning, and of the halo that is sent with it
SIDE, HALO = 64, 8


def removable(half: int) -> np.ndarray:
    """Whether a pixel goes in a half-step (0 or 1) of Guo and Hall's thinning, for each of the 256 states of its neighbours.

    Neighbour k, from the east against the clock, is bit k - 1.
    """
    x = {k: (np.arange(256) >> (k - 1) & 1).astype(bool) for k in range(1, 9)}
    x[9] = x[1]
    crossings = sum((~x[2 * i - 1] & (x[2 * i] | x[2 * i + 1])).astype(int) for i in range(1, 5))
    pairs = np.minimum(sum((x[2 * k - 1] | x[2 * k]).astype(int) for k in range(1, 5)), sum((x[2 * k] | x[2 * k + 1]).astype(int) for k in range(1, 5)))
    last = (x[6] | x[7] | ~x[4]) & x[5] if half else (x[2] | x[3] | ~x[8]) & x[1]
    return (crossings == 1) & (pairs >= 2) & (pairs <= 3) & ~last


def thinned(a: np.ndarray, rounds: int) -> np.ndarray:
    """An array of booleans after ``rounds`` of both half-steps; pixels beyond the edge count as empty."""
    around = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))
    tables = [removable(h) for h in (0, 1)]
    a = np.pad(a.astype(bool), 1)
    for _ in range(rounds):
        before = a
        for gone in tables:
            state = sum(np.left_shift(np.roll(a, (-y, -x), (0, 1)).astype(np.uint8), k) for k, (y, x) in enumerate(around))
            a = a & ~gone[state]
        if (a == before).all():
            break
    return a[1:-1, 1:-1]


def thin(mask: DataFrame, rounds: int | None = None) -> DataFrame:
    """A mask (px, py) thinned to lines of one pixel by Guo and Hall's parallel rule of two half-steps, until nothing changes or for ``rounds``.

    Pixels are packed into tiles of bits.  A tile gets a halo from its neighbours that is wide enough for several rounds, and
    only tiles near one that changed are looked at again.
    """
    import pandas as pd

    bits = "tx int, ty int, bits binary"

    def pack(pdf):
        a = np.zeros((SIDE, SIDE), bool)
        a[pdf["py"].to_numpy(int) % SIDE, pdf["px"].to_numpy(int) % SIDE] = True
        return pd.DataFrame({"tx": pdf["tx"].iloc[:1], "ty": pdf["ty"].iloc[:1], "bits": [np.packbits(a).tobytes()]})

    keyed = mask.select(F.floor(F.col("px") / SIDE).cast("int").alias("tx"), F.floor(F.col("py") / SIDE).cast("int").alias("ty"), "px", "py").distinct()
    now = cut(keyed.groupBy("tx", "ty").applyInPandas(pack, bits).withColumn("changed", F.lit(True)))
    near = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)]))

    def rounds_of(n):
        def run(pdf):
            own = pdf[(pdf["x"] == 0) & (pdf["y"] == 0)]
            if not len(own):
                return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("tx", "ty", "bits", "changed")})
            whole = np.zeros((3 * SIDE, 3 * SIDE), bool)
            for x, y, b in zip(pdf["x"].astype(int), pdf["y"].astype(int), pdf["bits"]):
                # the tile was sent by (x, y), so it lies the other way
                at = slice((1 - y) * SIDE, (2 - y) * SIDE), slice((1 - x) * SIDE, (2 - x) * SIDE)
                whole[at] = np.unpackbits(np.frombuffer(b, np.uint8)).reshape(SIDE, SIDE)
            edge = SIDE - HALO
            inner = thinned(whole[edge : 2 * SIDE + HALO, edge : 2 * SIDE + HALO], n)[HALO:-HALO, HALO:-HALO]
            packed = np.packbits(inner).tobytes()
            return pd.DataFrame({"tx": own["tx"].iloc[:1], "ty": own["ty"].iloc[:1], "bits": [packed], "changed": [packed != own["bits"].iloc[0]]})

        return run

    left = rounds
    while left is None or left > 0:
        n = HALO // 2 if left is None else min(left, HALO // 2)
        sent = now.select("tx", "ty", near.alias("d"), "bits").select((F.col("tx") + F.col("d.x")).alias("tx"), (F.col("ty") + F.col("d.y")).alias("ty"), F.col("d.x").alias("x"), F.col("d.y").alias("y"), "bits")
        again = now.where("changed").select("tx", "ty", near.alias("d")).select((F.col("tx") + F.col("d.x")).alias("tx"), (F.col("ty") + F.col("d.y")).alias("ty")).distinct()
        solved = sent.join(again, ["tx", "ty"], "left_semi").groupBy("tx", "ty").applyInPandas(rounds_of(n), bits + ", changed boolean")
        rest = now.join(again, ["tx", "ty"], "left_anti").select("tx", "ty", "bits", F.lit(False).alias("changed"))
        after = cut(solved.unionByName(rest))
        drop_cut(now)
        now = after
        left = None if left is None else left - n
        if now.where("changed").isEmpty():
            break

    def unpack(batches):
        for b in batches:
            out = []
            for tx, ty, data in zip(b["tx"], b["ty"], b["bits"]):
                y, x = np.nonzero(np.unpackbits(np.frombuffer(data, np.uint8)).reshape(SIDE, SIDE))
                out.append(pd.DataFrame({"px": x + tx * SIDE, "py": y + ty * SIDE}))
            yield pd.concat(out) if out else pd.DataFrame({"px": [], "py": []}, dtype="int32")

    return now.mapInPandas(unpack, "px int, py int")


def line_segments(mask: DataFrame) -> DataFrame:
    """(ax, ay, bx, by): segments between neighbouring pixels of a thinned mask; diagonals only where no corner joins them."""
    m = mask.select("px", "py").distinct()
    ahead = F.array(*[F.struct((F.col("px") + x).alias("bx"), (F.col("py") + y).alias("by")) for x, y in ((1, 0), (0, 1), (1, 1), (-1, 1))])
    s = m.select(F.col("px").alias("ax"), F.col("py").alias("ay"), F.explode(ahead).alias("b")).select("ax", "ay", "b.bx", "b.by")
    s = s.join(m.select(F.col("px").alias("bx"), F.col("py").alias("by")), ["bx", "by"], "left_semi")
    diagonal = (F.col("ax") != F.col("bx")) & (F.col("ay") != F.col("by"))
    c1, c2 = m.select(F.col("px").alias("ax"), F.col("py").alias("by")), m.select(F.col("px").alias("bx"), F.col("py").alias("ay"))
    slant = s.where(diagonal).join(c1, ["ax", "by"], "left_anti").join(c2, ["bx", "ay"], "left_anti")
    return s.where(~diagonal).select("ax", "ay", "bx", "by").unionByName(slant.select("ax", "ay", "bx", "by"))


def block_links(mask: DataFrame) -> DataFrame:
    """(px, py, qx, qy): the pixels of full 2 x 2 blocks of a mask, and the upper left one of their block, of several blocks the last one in row order."""
    m = mask.select("px", "py").distinct()
    block = F.array(*[F.struct((F.col("px") - x).alias("qx"), (F.col("py") - y).alias("qy")) for x in (0, 1) for y in (0, 1)])
    own = m.select("px", "py", F.explode(block).alias("b")).select("px", "py", "b.qx", "b.qy")
    full = own.groupBy("qx", "qy").agg(F.count(F.lit(1)).alias("n")).where("n = 4").select("qx", "qy")
    last = own.join(full, ["qx", "qy"]).groupBy("px", "py").agg(F.max(F.struct("qy", "qx")).alias("b"))
    return last.select("px", "py", F.col("b.qx").alias("qx"), F.col("b.qy").alias("qy"))


def collapsed(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(piece, path): segments (ax, ay, bx, by) as paths of points (x, y), between 2 x 2 blocks.

    Segments between two pixels of blocks are dropped; one that leaves a block begins at its upper left pixel.
    """
    ends = [links.select(F.col("px").alias(f"{e}x"), F.col("py").alias(f"{e}y"), F.struct(F.col("qx").cast("long").alias("x"), F.col("qy").cast("long").alias("y")).alias(f"{e}q")) for e in "ab"]
    s = segments.join(ends[0], ["ax", "ay"], "left").join(ends[1], ["bx", "by"], "left").where("aq is null or bq is null")
    point = lambda e: F.struct(F.col(f"{e}x").cast("long").alias("x"), F.col(f"{e}y").cast("long").alias("y"))
    lead = lambda e: F.when(F.col(f"{e}q").isNotNull() & (F.col(f"{e}q") != point(e)), F.array(F.col(f"{e}q"))).otherwise(F.array().cast("array<struct<x:bigint,y:bigint>>"))
    # a pixel and one of four directions name a segment
    piece = F.shiftleft(F.col("ay").cast("long"), 33) + F.shiftleft(F.col("ax").cast("long"), 2) + (F.col("bx") - F.col("ax") + 1) % 3 + F.when(F.col("by") == F.col("ay"), 1).otherwise(0)
    return s.select(piece.alias("piece"), F.concat(lead("a"), F.array(point("a"), point("b")), lead("b")).alias("path"))


def chains(pieces: DataFrame) -> DataFrame:
    """(line, rank, path): pieces (piece, path) put together to lines, from one end or fork to the next, their paths turned to follow each other.

    Pieces that meet alone at a point continue each other; they are put in order by list ranking, so no task holds a line.  A line begins at the
    smaller of its ends; a closed one at its smallest piece.
    """
    from ..plans.ranking import list_ranks

    p = cut(pieces)
    both = [p.select((F.col("piece") * 2 + k).alias("dart"), "piece", F.col("path")[0 if k == 0 else F.size("path") - 1].alias("a"), F.col("path")[F.size("path") - 1 if k == 0 else 0].alias("b")) for k in (0, 1)]
    darts = cut(both[0].unionByName(both[1]))
    # where two pieces end, a piece that comes in goes on as the other one
    meet = darts.groupBy(F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("dart").alias("d1"), F.max("dart").alias("d2"))
    own = F.col("dart").bitwiseXOR(F.lit(1))
    on = darts.join(meet, "b", "left").select("dart", "piece", "a", F.when((F.col("n") == 2) & (own != F.col("d1")), F.col("d1")).when(F.col("n") == 2, F.col("d2")).alias("nxt"))
    # a piece that is a loop by itself follows itself
    on = cut(on.withColumn("nxt", F.when(F.col("nxt") != own, F.col("nxt"))))
    linked = components(on.where("nxt is not null").select("piece", F.floor(F.col("nxt") / 2).alias("other")), "piece", "other")
    of = cut(on.join(linked, on["piece"] == linked["node"], "left").select("dart", "piece", "a", "nxt", F.coalesce("root", "piece").alias("line")))
    closed = of.groupBy("line").agg(F.count_if(F.col("nxt").isNull()).alias("open"), F.min("dart").alias("first")).where("open = 0").select("line", "first")
    cut_open = of.join(closed, "line", "left").select("dart", "line", "a", "first", F.when(F.col("first").isNull() | ((F.col("nxt") != F.col("first")) & (F.col("dart") != F.col("first").bitwiseXOR(F.lit(1)))), F.col("nxt")).alias("nxt"))
    cut_open = cut(cut_open)
    ranks = cut(list_ranks(cut_open.select(F.col("dart").alias("node"), "nxt")))
    placed = ranks.join(cut_open, ranks["node"] == cut_open["dart"]).select("dart", "line", "a", "first", "end", "d")
    # of the two directions the one that begins at the smaller point, or of a closed line the one that its first piece begins
    begins = placed.groupBy("line", "end").agg(F.max(F.struct("d", "a", "dart")).alias("m"), F.max(F.col("dart") == F.col("first")).alias("mine"))
    chosen = begins.groupBy("line").agg(F.min(F.struct((~F.coalesce("mine", F.lit(False))).alias("other"), F.col("m.a").alias("a"), F.col("m.dart").alias("dart"), "end", F.col("m.d").alias("most"))).alias("c"))
    chosen = chosen.select("line", F.col("c.end").alias("end"), F.col("c.most").alias("most"))
    way = placed.join(chosen, ["line", "end"]).select("line", (F.col("most") - F.col("d")).alias("rank"), F.floor(F.col("dart") / 2).alias("piece"), (F.col("dart") % 2 == 1).alias("back"))
    return way.join(p, "piece").select("line", "rank", F.when(F.col("back"), F.reverse("path")).otherwise(F.col("path")).alias("path"))


def lines_of(chained: DataFrame, fp: Footprint, offset: float = 0.5) -> DataFrame:
    """(line, n, wkt) of ``chains``: n counts the segments; ``offset`` is that of a pixel's point from its corner, in pixels."""
    at = lambda v: F.concat_ws(" ", *[_text(F.lit(t) + (v["x"] + offset) * dx + (v["y"] + offset) * dy) for t, dx, dy in ((fp.tlx, fp.dx, fp.rx), (fp.tly, fp.ry, fp.dy))])
    lead = F.when(F.col("rank") == 0, F.col("path")).otherwise(F.slice("path", F.lit(2), F.size("path")))
    each = chained.withColumn("p", lead).groupBy("line").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "p"))), lambda v: v["p"])).alias("p"))
    return each.select("line", (F.size("p") - 1).cast("long").alias("n"), F.concat(F.lit("LINESTRING ("), F.array_join(F.transform("p", at), ", "), F.lit(")")).alias("wkt"))


def merged_lines(segments: DataFrame, fp: Footprint, offset: float = 0.5) -> DataFrame:
    """(line, n, wkt): segments (ax, ay, bx, by) put together to lines; see ``chains``."""
    none = segments.select(F.col("ax").alias("px"), F.col("ay").alias("py"), F.col("ax").alias("qx"), F.col("ay").alias("qy")).limit(0)
    # a piece's number asks for its ends in row order
    turned = F.struct("by", "bx") < F.struct("ay", "ax")
    s = segments.select(*[F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))])
    return lines_of(chains(collapsed(s, none)), fp, offset)


def find_lines(mask: DataFrame, fp: Footprint, offset: float = 0.5, merge: bool = True) -> DataFrame:
    """(line, n, wkt) of the lines of a mask (px, py): thinned, joined from pixel to pixel, 2 x 2 blocks drawn to one point, merged.  Single pixels make no line."""
    thinned_ = cut(thin(mask))
    pieces = collapsed(line_segments(thinned_), block_links(thinned_))
    return lines_of(chains(pieces) if merge else pieces.select(F.col("piece").alias("line"), F.lit(0).cast("long").alias("rank"), "path"), fp, offset)
