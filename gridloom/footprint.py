"""Footprints known at plan time: plain numbers that become literals."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import astuple, dataclass, replace

from pyspark.sql import Column

from .env import current
from .functions import footprint as fpx

Point = tuple[float, float]


@dataclass(frozen=True)
class Footprint:
    tlx: float
    dx: float
    rx: float
    tly: float
    ry: float
    dy: float
    rsx: int
    rsy: int

    def __post_init__(self):
        if self.rsx <= 0 or self.rsy <= 0 or not all(map(math.isfinite, astuple(self))) or self.dx * self.dy == self.rx * self.ry:
            raise ValueError("not a legal footprint")

    @classmethod
    def of(cls, tl, size, rsize) -> "Footprint":
        return cls(float(tl[0]), size[0] / rsize[0], 0.0, float(tl[1]), 0.0, -size[1] / rsize[1], rsize[0], rsize[1])

    def lit(self) -> Column:
        return fpx.make(*astuple(self))

    def at(self, col: float, row: float) -> tuple[float, float]:
        return self.tlx + col * self.dx + row * self.rx, self.tly + col * self.ry + row * self.dy

    def inverse(self, x: float, y: float) -> tuple[float, float]:
        u, v, det = x - self.tlx, y - self.tly, self.dx * self.dy - self.rx * self.ry
        return (u * self.dy - v * self.rx) / det, (v * self.dx - u * self.ry) / det

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        c = [self.at(x, y) for x in (0, self.rsx) for y in (0, self.rsy)]
        return min(p[0] for p in c), min(p[1] for p in c), max(p[0] for p in c), max(p[1] for p in c)

    @property
    def shape(self) -> tuple[int, int]:
        return self.rsy, self.rsx

    def same_grid(self, other: "Footprint", significant: float = 9.0) -> bool:
        eps = max(map(abs, (*self.bounds, *other.bounds))) * 10.0**-significant
        w, h = max(self.rsx, other.rsx), max(self.rsy, other.rsy)
        if any(abs(a - b) * n >= eps for a, b, n in ((self.dx, other.dx, w), (self.ry, other.ry, w), (self.rx, other.rx, h), (self.dy, other.dy, h))):
            return False
        u, v = self.inverse(other.tlx, other.tly)
        x, y = self.at(round(u), round(v))
        return abs(x - other.tlx) < eps and abs(y - other.tly) < eps

    def clip(self, x0: int, y0: int, x1: int, y1: int) -> "Footprint":
        x, y = self.at(x0, y0)
        return Footprint(x, self.dx, self.rx, y, self.ry, self.dy, x1 - x0, y1 - y0)

    def dilate(self, *n: int) -> "Footprint":
        """Pixels added on each side: one number for all, two for x and y, or four for left, right, top and bottom."""
        l, r, t, b = {1: n * 4, 2: (n[0], n[0], n[-1], n[-1]), 4: n}[len(n)]
        return self.clip(-l, -t, self.rsx + r, self.rsy + b)

    def erode(self, *n: int) -> "Footprint":
        return self.dilate(*[-v for v in n])

    # --- measures --------------------------------------------------------------------------------

    @property
    def tl(self) -> Point:
        return self.at(0, 0)

    @property
    def tr(self) -> Point:
        return self.at(self.rsx, 0)

    @property
    def bl(self) -> Point:
        return self.at(0, self.rsy)

    @property
    def br(self) -> Point:
        return self.at(self.rsx, self.rsy)

    @property
    def corners(self) -> list[Point]:
        return [self.tl, self.bl, self.br, self.tr]

    @property
    def pxsize(self) -> Point:
        return math.hypot(self.dx, self.ry), math.hypot(self.rx, self.dy)

    @property
    def angle(self) -> float:
        return math.degrees(math.atan2(self.ry, self.dx))

    @property
    def scale(self) -> Point:
        """Signed pixel sizes along the footprint's own axes."""
        w, h = self.pxsize
        return w, math.copysign(h, self.dx * self.dy - self.rx * self.ry)

    @property
    def __geo_interface__(self) -> dict:
        return {"type": "Polygon", "coordinates": [[*self.corners, self.tl]]}

    def share_area(self, other) -> bool:
        """Whether a footprint or geometry has more in common with this one than an edge."""
        try:
            _shared([self.corners], [] if isinstance(other, Footprint) else [other], [other.corners] if isinstance(other, Footprint) else [])
        except ValueError:
            return False
        return True

    # --- derivation ------------------------------------------------------------------------------

    @classmethod
    def on_grid(cls, tl: Point, angle: float, scale: Point, rsize: tuple[int, int]) -> "Footprint":
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        if angle % 90 == 0:
            c, s = round(c), round(s)
        return cls(tl[0], c * scale[0], -s * scale[1], tl[1], s * scale[0], c * scale[1], *rsize)

    def intersection(self, *objects, scale="self", rotation="auto", alignment="auto", homogeneous: bool = False, significant: float | None = None) -> "Footprint":
        """The footprint that bounds what this one has in common with footprints and geometries.

        ``scale``: self, highest (smallest pixels), lowest, a signed size or a pair.  ``rotation``: auto
        (that of the footprint that gives the scale), fit (smallest rectangle) or degrees.
        ``alignment``: auto (that of the footprint that gives scale and rotation, else tl), tl, or a
        point of the grid.  Of the geometries one at most may be other than a convex polygon.
        """
        if not objects:
            raise ValueError("nothing to intersect with")
        significant = current().significant if significant is None else significant
        fps = [self, *[o for o in objects if isinstance(o, Footprint)]]
        others = [o for o in objects if not isinstance(o, Footprint)]
        if homogeneous and not all(self.same_grid(f, significant) for f in fps):
            raise ValueError("the footprints do not lie on one grid")
        points = _shared([f.corners for f in fps], others)
        by = {"self": self, "highest": min(fps, key=lambda f: math.prod(f.pxsize)), "lowest": max(fps, key=lambda f: math.prod(f.pxsize))}
        giver = by[scale] if isinstance(scale, str) else None
        size = giver.scale if giver else (float(scale), -float(scale)) if isinstance(scale, (int, float)) else tuple(map(float, scale))
        if 0 in size:
            raise ValueError("a pixel has a size")
        if rotation == "fit":
            angle = _fit(points, size)
        else:
            angle = (giver or self).angle if rotation == "auto" else float(rotation)
        frame = Footprint.on_grid((0.0, 0.0), angle, size, (1, 1))
        own = [frame.inverse(x, y) for x, y in points]
        lo, hi = (min(u for u, _ in own), min(v for _, v in own)), (max(u for u, _ in own), max(v for _, v in own))
        if isinstance(alignment, str):
            turned_by_giver = giver is not None and rotation == "auto"
            anchor = giver.tl if alignment == "auto" and turned_by_giver else frame.at(*lo)
        else:
            anchor = tuple(map(float, alignment))
        ends = [frame.at(u, v) for u in (lo[0], hi[0]) for v in (lo[1], hi[1])]
        d = _density(ends, min(map(abs, size)), significant)
        grid = replace(frame, tlx=anchor[0], tly=anchor[1])
        snap = lambda p: tuple(round(v * d) / d for v in p)
        first = tuple(map(math.floor, snap(grid.inverse(*frame.at(*lo)))))
        here = replace(grid, tlx=grid.at(*first)[0], tly=grid.at(*first)[1])
        count = tuple(max(1, math.ceil(v)) for v in snap(here.inverse(*frame.at(*hi))))
        return replace(here, rsx=count[0], rsy=count[1])

    def __and__(self, other) -> "Footprint":
        return self.intersection(other)

    def move(self, tl, tr=None, br=None, round_coordinates: bool = False, significant: float | None = None) -> "Footprint":
        """This footprint with new corners: translated; turned and scaled alike in both directions; or scaled in each.

        The corner at ``tr`` must be a right one, up to precision.  ``round_coordinates`` cancels noise:
        of the footprints near the given corners the one that keeps most of this one's angle, pixel size
        and proportion is taken.
        """
        if br is not None and tr is None or round_coordinates and br is None:
            raise ValueError("corners are given in the order tl, tr, br, and all of them for rounding")
        significant = current().significant if significant is None else significant
        tl = tuple(map(float, tl))
        if tr is None:
            return replace(self, tlx=tl[0], tly=tl[1])
        v = (tr[0] - tl[0]) / self.rsx, (tr[1] - tl[1]) / self.rsx
        if br is None:
            n = self.dx**2 + self.ry**2
            c, s = (v[0] * self.dx + v[1] * self.ry) / n, (v[1] * self.dx - v[0] * self.ry) / n
            return Footprint(tl[0], v[0], c * self.rx - s * self.dy, tl[1], v[1], s * self.rx + c * self.dy, self.rsx, self.rsy)
        w = (br[0] - tr[0]) / self.rsy, (br[1] - tr[1]) / self.rsy
        if round_coordinates:
            v, w = self._rounded(tl, v, w, significant)
        far = max(map(abs, (*tl, *tr, *br)))
        if significant <= -math.log10(min(math.hypot(*v), math.hypot(*w)) / max(far, 1.0)):
            raise RuntimeError("coordinates this large and pixels this small need more significant digits")
        lo, hi = corner_slack(tl, tr, br, significant)
        if not lo < 90 < hi:
            raise ValueError(f"the angle at tr lies within {lo} and {hi} degrees, not around 90")
        # the second direction is turned to the right angle and keeps its length
        n, across = math.hypot(*v), (-v[1], v[0])
        h = math.copysign(math.hypot(*w), w[0] * across[0] + w[1] * across[1]) / n
        return Footprint(tl[0], v[0], h * across[0], tl[1], v[1], h * across[1], self.rsx, self.rsy)

    def _rounded(self, tl: Point, v: Point, w: Point, significant: float) -> tuple[Point, Point]:
        """The pixel vectors nearest to (v, w) in kind: first with this footprint's directions, then with their own; each with this one's pixel sizes, proportion or none."""
        old, new = self.pxsize, (math.hypot(*v), math.hypot(*w))
        unit = lambda p, n: (p[0] / n, p[1] / n)
        mine = unit((self.dx, self.ry), old[0]), unit((self.rx, self.dy), old[1])
        theirs = unit(v, new[0]), unit(w, new[1])
        like = tuple(tuple(math.copysign(a, b) for a, b in zip(p, q)) for p, q in zip(mine, theirs))
        same, alike = old, (new[0], new[0] / old[0] * old[1])
        ends = lambda a, b: [c for p in ((a[0] * self.rsx, a[1] * self.rsx), (a[0] * self.rsx + b[0] * self.rsy, a[1] * self.rsx + b[1] * self.rsy)) for c in p]
        given = ends(v, w)
        eps = max(abs(c) for c in (*tl, tl[0] + given[0], tl[1] + given[1], tl[0] + given[2], tl[1] + given[3])) * 10.0**-significant
        for (i, j), (m, n) in ((like, same), (like, alike), (like, new), (theirs, same), (theirs, alike)):
            a, b = (i[0] * m, i[1] * m), (j[0] * n, j[1] * n)
            if all(abs(p - q) < eps for p, q in zip(ends(a, b), given)):
                return a, b
        return v, w

    def convert(self, transform) -> "Footprint":
        """This footprint carried over by a transformation of points."""
        return self.move(*[tuple(p) for p in transform([self.tl, self.tr, self.br])], round_coordinates=True)

    def conv2d(self, kernel, stride=1, padding=0, dilation=1) -> "Footprint":
        """The footprint after a convolution; parameters are numbers or pairs (y, x)."""
        k, s, p, d = (((v, v) if isinstance(v, int) else tuple(v)[::-1]) for v in (kernel, stride, padding, dilation))
        wide = [1 + (k[i] - 1) * d[i] for i in (0, 1)]
        rs = [n + 2 * p[i] - wide[i] for i, n in enumerate((self.rsx, self.rsy))]
        if min(*k, *s, *d) < 1 or min(p) < 0 or min(rs) < 0:
            raise ValueError("the kernel is wider than the padded raster, or a parameter is too small")
        x, y = self.at(*[(wide[i] - 1) / 2 - p[i] for i in (0, 1)])
        return Footprint(x, self.dx * s[0], self.rx * s[1], y, self.ry * s[0], self.dy * s[1], 1 + rs[0] // s[0], 1 + rs[1] // s[1])


# --- plane geometry at plan time -----------------------------------------------------------------


def _cross(o: Point, a: Point, b: Point) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _area(ring: list[Point]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


def _cut(subject: list[Point], convex: list[Point]) -> list[Point]:
    """A convex ring cut down to another one, both open."""
    if _area(convex) < 0:
        convex = convex[::-1]
    for a, b in zip(convex, [*convex[1:], convex[0]]):
        out = []
        for p, q in zip(subject, [*subject[1:], subject[0]] if subject else []):
            sp, sq = _cross(a, b, p), _cross(a, b, q)
            if sp >= 0:
                out.append(p)
            if sp * sq < 0:
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        subject = out
    return subject


def _rings(geometry) -> tuple[int, list[list[Point]]]:
    """The dimension and the paths of a geometry; rings are open, lines and points are paths."""
    g = geometry if isinstance(geometry, dict) else geometry.__geo_interface__
    kind, c = g["type"], g["coordinates"]
    nest = {"Point": [[c]], "MultiPoint": [[p] for p in c] if kind == "MultiPoint" else 0, "LineString": [c], "MultiLineString": c, "Polygon": c, "MultiPolygon": [r for p in c for r in p] if kind == "MultiPolygon" else 0}[kind]
    dim = 0 if "Point" in kind else 1 if "Line" in kind else 2
    paths = [[tuple(map(float, p[:2])) for p in path] for path in nest]
    return dim, [p[:-1] if dim == 2 and p[0] == p[-1] else p for p in paths]


def _is_convex(ring: list[Point]) -> bool:
    n = len(ring)
    turns = [_cross(ring[k - 2], ring[k - 1], ring[k]) for k in range(n)]
    return n > 2 and (all(t >= 0 for t in turns) or all(t <= 0 for t in turns))


def _shared(convex: list[list[Point]], others: list, more: Sequence = ()) -> list[Point]:
    """Points whose bounds, in any frame, are those of what convex rings and geometries have in common; an error if that has no area."""
    rings, rest = [*convex, *more], []
    for g in others:
        dim, paths = _rings(g)
        if dim == 2 and len(paths) == 1 and _is_convex(paths[0]):
            rings.append(paths[0])
        else:
            rest.append((dim, paths))
    if len(rest) > 1:
        raise NotImplementedError("more than one geometry that is no convex polygon")
    region = rings[0]
    for r in rings[1:]:
        region = _cut(region, r)
    if len(region) < 3 or abs(_area(region)) == 0:
        raise ValueError("they have no area in common")
    if not rest:
        return region
    dim, paths = rest[0]
    if _area(region) < 0:
        region = region[::-1]
    inside = lambda p: all(_cross(a, b, p) >= 0 for a, b in zip(region, [*region[1:], region[0]]))
    found = [p for path in paths for p in path if inside(p)]
    for path in paths:
        for p, q in zip(path, path[1:] + (path[:1] if dim == 2 else [])):
            lo, hi = 0.0, 1.0  # the part of the side that lies in the region
            for a, b in zip(region, [*region[1:], region[0]]):
                sp, sq = _cross(a, b, p), _cross(a, b, q)
                if sp < 0 and sq < 0:
                    lo, hi = 1.0, 0.0
                elif sp < 0:
                    lo = max(lo, sp / (sp - sq))
                elif sq < 0:
                    hi = min(hi, sp / (sp - sq))
            if lo <= hi:
                found += [(p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])) for t in (lo, hi)]
    if dim == 2:
        odd = lambda p: sum((a[1] <= p[1]) != (b[1] <= p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for r in paths for a, b in zip(r, [*r[1:], r[0]])) % 2
        found += [c for c in region if odd(c)]
    flat = not found or dim == 2 and (max(p[0] for p in found) == min(p[0] for p in found) or max(p[1] for p in found) == min(p[1] for p in found))
    if flat:
        raise ValueError("they have no area in common")
    return found


def _fit(points: list[Point], scale: Point) -> float:
    """The angle, nearest to 0, of the smallest rectangle around points."""
    pts = sorted(set(points))
    hull: list[Point] = []
    for side in (pts, pts[::-1]):
        base = len(hull)
        for p in side:
            while len(hull) - base >= 2 and _cross(hull[-2], hull[-1], p) <= 0:
                hull.pop()
            hull.append(p)
        hull.pop()
    best = (math.inf, 0.0)
    for a, b in zip(hull, [*hull[1:], hull[0]]):
        t = math.atan2(b[1] - a[1], b[0] - a[0])
        c, s = math.cos(t), math.sin(t)
        us, vs = [c * x + s * y for x, y in hull], [c * y - s * x for x, y in hull]
        turn = (math.degrees(t) + 45) % 90 - 45
        best = min(best, (round((max(us) - min(us)) * (max(vs) - min(vs)), 9), turn), key=lambda x: (x[0], abs(x[1])))
    return best[1]


def _density(points: list[Point], pixel: float, significant: float) -> float:
    """How finely raster coordinates are snapped before they are floored or ceiled."""
    far = max(1.0, max(abs(c) for p in points for c in p))
    if significant <= -math.log10(pixel / far):
        raise RuntimeError("coordinates this large and pixels this small need more significant digits")
    return float(math.floor(1 / (far * 10.0**-significant / pixel)))


def corner_slack(a: Point, b: Point, c: Point, significant: float) -> tuple[float, float]:
    """The least and the greatest angle at ``b``, in degrees, that the points' precision allows."""
    p, q = (a[0] - b[0], a[1] - b[1]), (c[0] - b[0], c[1] - b[1])
    m, n = math.hypot(*p), math.hypot(*q)
    angle = math.degrees(math.acos(max(-1.0, min(1.0, (p[0] * q[0] + p[1] * q[1]) / (m * n)))))
    eps = max(1.0, *map(abs, (*a, *b, *c))) * 10.0**-significant
    give = math.degrees(math.atan2(2 * math.sqrt(2) * eps, m) + math.atan2(2 * math.sqrt(2) * eps, n))
    return angle - give, angle + give


def ratio_slack(corners, significant: float) -> tuple[float, float]:
    """The least and the greatest proportion, width by height, of a rectangle (tl, bl, br, tr) that its points' precision allows."""
    w, h = math.dist(corners[0], corners[3]), math.dist(corners[0], corners[1])
    eps = 2 * math.sqrt(2) * max(1.0, *[abs(float(c)) for p in corners for c in p]) * 10.0**-significant
    return (w - eps) / (h + eps), (w + eps) / (h - eps) if h > eps else math.inf
