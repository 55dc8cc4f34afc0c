"""Cutting polygons that expressions can't cut: concave ones, with holes, by convex or other masks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

PARTS = "array<array<array<struct<x:double,y:double,z:double>>>>"
Point = tuple[float, float]
Ring = list[Point]


def area(ring: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


def inside(p: Point, ring: Ring) -> bool:
    odd = False
    for a, b in zip(ring, [*ring[1:], ring[0]]):
        if (a[1] <= p[1]) != (b[1] <= p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
            odd = not odd
    return odd


def halved(rings: list[Ring], plane: tuple[float, float, float]) -> list[Ring]:
    """Open rings cut by a half plane a x + b y + c > 0.

    Each ring is broken into the chains that lie inside.  Along the line, chains end and begin at points
    that, in order, bound stretches of the inside by pairs; a chain goes on with the one at the other end
    of its stretch.  So a shape that falls apart becomes several rings, without bridges.
    """
    a, b, c = plane
    side = lambda p: a * p[0] + b * p[1] + c
    along = lambda p: b * p[0] - a * p[1]
    out, chains = [], []
    for ring in rings:
        s = [side(p) > 0 for p in ring]
        if all(s):
            out.append(ring)
            continue
        if not any(s):
            continue
        n, start = len(ring), next(k for k in range(len(ring)) if s[k] and not s[k - 1])
        chain: Ring = []
        for k in range(start, start + n):
            p, q = ring[(k - 1) % n], ring[k % n]
            if s[k % n] != s[(k - 1) % n]:
                sp, sq = side(p), side(q)
                t = sp / (sp - sq)
                hit = (p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1]))
                if s[k % n]:
                    chain = [hit, q]
                else:
                    chains.append([*chain, hit])
                    chain = []
            elif s[k % n]:
                chain.append(q)
        if chain:  # the ring closes where it began
            p, q = ring[(start + n - 1) % n], ring[start % n]
            t = side(p) / (side(p) - side(q)) if side(p) != side(q) else 0.0
            chains.append([*chain, (p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1]))])
    ends = sorted([(along(ch[0]), k, 0) for k, ch in enumerate(chains)] + [(along(ch[-1]), k, 1) for k, ch in enumerate(chains)])
    mate = {}
    for x, y in zip(ends[::2], ends[1::2]):
        mate[x[1:]], mate[y[1:]] = y[1:], x[1:]
    left = set(range(len(chains)))
    while left:
        first = at = min(left)
        ring = []
        while True:
            left.discard(at)
            ring += chains[at]
            nxt, which = mate[at, 1]
            if which == 1 or nxt == first or nxt not in left:
                break
            at = nxt
        out.append([p for k, p in enumerate(ring) if p != ring[k - 1]])
    return [r for r in out if len(r) > 2 and area(r) != 0]


def ears(ring: Ring) -> list[Ring]:
    """A simple ring as triangles."""
    pts = [p for k, p in enumerate(ring) if p != ring[k - 1]]
    if area(pts) < 0:
        pts = pts[::-1]
    turn = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    out = []
    while len(pts) > 3:
        for k in range(len(pts)):
            o, p, q = pts[k - 1], pts[k], pts[(k + 1) % len(pts)]
            if turn(o, p, q) > 0 and not any(turn(o, p, r) >= 0 and turn(p, q, r) >= 0 and turn(q, o, r) >= 0 for r in pts if r not in (o, p, q)):
                out.append([o, p, q])
                del pts[k]
                break
            if turn(o, p, q) == 0:
                del pts[k]
                break
        else:
            raise ValueError("the mask crosses itself")
    return [*out, pts] if len(pts) == 3 and area(pts) else out


def planes(ring: Ring) -> list[tuple[float, float, float]]:
    ring = ring if area(ring) > 0 else ring[::-1]
    return [(p[1] - q[1], q[0] - p[0], p[0] * q[1] - q[0] * p[1]) for p, q in zip(ring, [*ring[1:], ring[0]])]


def assembled(rings: list[Ring]) -> list[list[Ring]]:
    """Polygons from rings that do not cross: a ring inside an odd number of others is a hole of the smallest one around it."""
    depth = [sum(inside(r[0], o) for o in rings if o is not r) for r in rings]
    outer = [[r] for r, d in zip(rings, depth) if d % 2 == 0]
    for r, d in zip(rings, depth):
        if d % 2:
            around = [p for p in outer if inside(r[0], p[0])]
            if around:
                min(around, key=lambda p: abs(area(p[0]))).append(r)
    return outer


def clipped(parts: list[list[Ring]], mask: list[Ring]) -> list[list[Ring]]:
    """Polygons (open rings) within a mask.  A mask that is not convex is taken in triangles, so its result may have seams."""
    mask = [r[:-1] if r[0] == r[-1] else r for r in mask]
    convex = len(mask) == 1 and all(a * x + b * y + c >= -1e-9 * max(1.0, abs(c)) for a, b, c in planes(mask[0]) for x, y in mask[0])
    out = []
    for piece in [mask[0]] if convex else ears(mask[0]):
        for part in parts:
            rings = part
            for p in planes(piece):
                rings = halved(rings, p)
            out += assembled(rings)
    for hole in mask[1:]:
        # what lies outside the hole: beyond each side of each of its triangles, and before the sides so far
        for tri in ears(hole):
            rest = []
            for part in out:
                now = part
                for a, b, c in planes(tri):
                    rest += assembled(halved(now, (-a, -b, -c)))
                    now = halved(now, (a, b, c))
            out = rest
    return out


def with_cuts(df: DataFrame, need: Column, mask: list[Ring], name: str) -> DataFrame:
    """``df`` plus ``name``: what the mask leaves of the parts of polygons in ``need``; null stays null.

    Arrow batches go through a step of their own; as a function's call, the optimizer would move it into
    expressions where no Python runs.
    """

    def one(parts):
        if parts is None:
            return None
        rings = [[[(p["x"], p["y"]) for p in ring][:-1] for ring in part] for part in parts]
        close = lambda r: [{"x": x, "y": y, "z": 0.0} for x, y in [*r, r[0]]]
        return [[close(r) for r in part] for part in clipped(rings, mask)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.list_(pa.struct([(c, pa.float64()) for c in "xyz"]))))
        for b in batches:
            cuts = pa.array([one(x) for x in b.column(b.num_columns - 1).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], cuts], [*b.schema.names[:-1], name])

    schema = T.StructType([*df.schema, T.StructField(name, T._parse_datatype_string(PARTS))])
    return df.withColumn("__gl_need", need).mapInArrow(run, schema)
