"""Geometries as nested structs: boxes, measures, predicates against boxes, GeoJSON and WKT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(0.0).alias("z"))


def geom(kind: str, *rings: Column) -> Column:
    """A geometry of one part with the given rings (arrays of points)."""
    return F.struct(F.lit(kind).alias("type"), F.lit(False).alias("has_z"), F.array(F.array(*rings)).alias("parts"))


def box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The rectangle's polygon."""
    return geom("Polygon", F.array(point(minx, maxy), point(minx, miny), point(maxx, miny), point(maxx, maxy), point(minx, maxy)))


def points(g: Column) -> Column:
    return F.flatten(F.flatten(g["parts"]))


def bbox(g: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(points(g), lambda p: p["x"]), F.transform(points(g), lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring."""
    cross = lambda p, i: F.when(i > 0, F.get(ring, i - 1)["x"] * p["y"] - p["x"] * F.get(ring, i - 1)["y"]).otherwise(0.0)
    return F.aggregate(F.transform(ring, cross), F.lit(0.0), lambda a, x: a + x) / 2


def area(g: Column) -> Column:
    """Area of polygons: of each part the first ring less the others."""
    part = lambda rings: F.aggregate(F.transform(rings, lambda r, i: F.when(i == 0, F.abs(ring_area(r))).otherwise(-F.abs(ring_area(r)))), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.transform(g["parts"], part), F.lit(0.0), lambda a, x: a + x)


def centroid(g: Column) -> Column:
    """(x, y) of the middle of polygons, of each part the first ring less the others; null without an area.

    Coordinates are taken from the first point, which keeps the digits of small shapes far from the origin.
    """
    origin = points(g)[0]

    def moments(ring: Column, sign: Column) -> Column:
        """(twice the area, and six times its product with x and y), whichever way the ring turns."""

        def step(p: Column, i: Column) -> Column:
            a, b = F.get(ring, i - 1), p
            ax, ay, bx, by = a["x"] - origin["x"], a["y"] - origin["y"], b["x"] - origin["x"], b["y"] - origin["y"]
            c = F.when(i > 0, ax * by - bx * ay).otherwise(0.0)
            return F.struct(c.alias("c"), (c * F.coalesce(ax + bx, F.lit(0.0))).alias("x"), (c * F.coalesce(ay + by, F.lit(0.0))).alias("y"))

        def turned(t: Column) -> Column:
            turn = sign * F.when(t["c"] < 0, -1.0).otherwise(1.0)
            return F.struct(*[(t[k] * turn).alias(k) for k in ("c", "x", "y")])

        # the outer ``transform`` binds the sums, which would otherwise be made for every use of them
        return F.transform(F.array(_summed(F.transform(ring, step))), turned)[0]

    rings = F.flatten(F.transform(g["parts"], lambda part: F.transform(part, lambda r, i: moments(r, F.when(i == 0, 1.0).otherwise(-1.0)))))
    middle = lambda m: F.when(m["c"] != 0, F.struct((origin["x"] + m["x"] / (3 * m["c"])).alias("x"), (origin["y"] + m["y"] / (3 * m["c"])).alias("y")))
    return F.transform(F.array(_summed(rings)), middle)[0]


def _summed(values: Column) -> Column:
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("c", "x", "y")])
    return F.aggregate(values, zero, lambda a, v: F.struct(*[(a[k] + v[k]).alias(k) for k in ("c", "x", "y")]))


def clip_ring(ring: Column, axis: str, bound, keep_above: bool) -> Column:
    """A closed ring cut by a half plane across an axis: each side gives its kept start and its crossing."""
    other = "y" if axis == "x" else "x"
    bound = bound if isinstance(bound, Column) else F.lit(bound)
    inside = lambda p: (p[axis] >= bound) if keep_above else (p[axis] <= bound)

    def side(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        t = (bound - a[axis]) / (b[axis] - a[axis])
        o = a[other] + t * (b[other] - a[other])
        hit = point(bound, o) if axis == "x" else point(o, bound)
        start = F.array(point(a["x"], a["y"]))
        none = F.array().cast("array<struct<x:double,y:double,z:double>>")
        return F.when(inside(a) & inside(b), start).when(inside(a), F.concat(start, F.array(hit))).when(inside(b), F.array(hit)).otherwise(none)

    open_ = F.flatten(F.transform(F.sequence(F.lit(0), F.size(ring) - 2), side))
    closed = F.transform(F.array(open_), lambda r: F.when(F.size(r) > 0, F.concat(r, F.slice(r, 1, 1))).otherwise(r))[0]
    return F.when(F.size(ring) > 1, closed).otherwise(ring)


# --- paths, predicates and clips against a fixed polygon ------------------------------------------


def paths(g: Column) -> Column:
    """All rings, lines and points of a geometry."""
    return F.flatten(g["parts"])


def segments(g: Column) -> Column:
    """(x1, y1, x2, y2) of all sides; a point is a side of no length."""

    def of(path: Column) -> Column:
        a, b = lambda i: F.get(path, i), lambda i: F.get(path, F.least(i + 1, F.size(path) - 1))
        side = lambda i: F.struct(a(i)["x"].alias("x1"), a(i)["y"].alias("y1"), b(i)["x"].alias("x2"), b(i)["y"].alias("y2"))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(path) - 2, F.lit(0))), side)

    return F.flatten(F.transform(F.filter(paths(g), lambda p: F.size(p) > 0), of))


class Mask:
    """A polygon, known at plan time, that features are held against: rings of (x, y), closed."""

    def __init__(self, rings: list[list[tuple[float, float]]]) -> None:
        self.rings = [[(float(x), float(y)) for x, y in r] for r in rings]
        self.rings = [r if r[0] == r[-1] else [*r, r[0]] for r in self.rings]
        xs, ys = [p[0] for r in self.rings for p in r], [p[1] for r in self.rings for p in r]
        self.box = min(xs), min(ys), max(xs), max(ys)

    @property
    def is_box(self) -> bool:
        x0, y0, x1, y1 = self.box
        return len(self.rings) == 1 and len(self.rings[0]) == 5 and set(self.rings[0]) == {(x0, y0), (x0, y1), (x1, y0), (x1, y1)}

    @property
    def half_planes(self) -> list[tuple[float, float, float]] | None:
        """(a, b, c) with a x + b y + c >= 0 inside, if the mask is convex."""
        if len(self.rings) != 1:
            return None
        ring = self.rings[0]
        area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:]))
        ring = ring if area > 0 else ring[::-1]
        planes = [(p[1] - q[1], q[0] - p[0], p[0] * q[1] - q[0] * p[1]) for p, q in zip(ring, ring[1:])]
        return planes if all(a * x + b * y + c >= -1e-9 * max(1.0, abs(c)) for a, b, c in planes for x, y in ring) else None

    def sides(self) -> Column:
        rows = [(*p, *q) for r in self.rings for p, q in zip(r, r[1:])]
        return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, ("x1", "y1", "x2", "y2"))]) for row in rows])


def _cross(a: Column, b: Column, p: Column, q: Column, x: Column, y: Column) -> Column:
    return (p - a) * (y - b) - (q - b) * (x - a)


def _meet(s: Column, m: Column) -> Column:
    """Whether two sides have a point in common, ends included."""
    over = (F.least(s["x1"], s["x2"]) <= F.greatest(m["x1"], m["x2"])) & (F.least(m["x1"], m["x2"]) <= F.greatest(s["x1"], s["x2"])) & (F.least(s["y1"], s["y2"]) <= F.greatest(m["y1"], m["y2"])) & (F.least(m["y1"], m["y2"]) <= F.greatest(s["y1"], s["y2"]))
    of = lambda u, v, k: _cross(u["x1"], u["y1"], u["x2"], u["y2"], v[f"x{k}"], v[f"y{k}"])
    return over & (F.signum(of(m, s, 1)) * F.signum(of(m, s, 2)) <= 0) & (F.signum(of(s, m, 1)) * F.signum(of(s, m, 2)) <= 0)


def _odd(sides: Column, x: Column, y: Column) -> Column:
    """Whether sides go round a point an odd number of times."""
    hit = lambda s: ((s["y1"] <= y) != (s["y2"] <= y)) & (x < s["x1"] + (y - s["y1"]) * (s["x2"] - s["x1"]) / F.when(s["y2"] == s["y1"], 1.0).otherwise(s["y2"] - s["y1"]))
    return F.size(F.filter(sides, hit)) % 2 == 1


def intersects(g: Column, mask: Mask, box: Column | None = None) -> Column:
    """Whether a geometry has a point in common with the mask; ``box`` has its bounds (minx, miny, maxx, maxy), where they are known.

    The boxes decide first.  Else a side of each meets, or the first point of a path of one lies in the other.
    """
    b, (x0, y0, x1, y1) = bbox(g) if box is None else [box[k] for k in range(4)], mask.box
    near = (b[0] <= x1) & (b[2] >= x0) & (b[1] <= y1) & (b[3] >= y0)
    sides = mask.sides()
    own = segments(g)
    crossing = F.exists(own, lambda s: F.exists(sides, lambda m: _meet(s, m)))
    inside = F.exists(F.filter(paths(g), lambda p: F.size(p) > 0), lambda p: _odd(sides, p[0]["x"], p[0]["y"]))
    around = F.lit(False)
    for r in mask.rings:
        around = around | _odd(own, F.lit(r[0][0]), F.lit(r[0][1]))
    return near & (crossing | inside | (g["type"].isin("Polygon", "MultiPolygon") & around))


_POINT = "struct<x:double,y:double,z:double>"


def _lines_within(g: Column, mask: Mask) -> Column:
    """The stretches of lines that lie in the mask, as parts of one path each."""
    sides = mask.sides()

    def stretches(path: Column) -> Column:
        def cut(i: Column) -> Column:
            a, b = F.get(path, i), F.get(path, i + 1)
            dx, dy = b["x"] - a["x"], b["y"] - a["y"]

            def crossing(m: Column) -> Column:
                ex, ey = m["x2"] - m["x1"], m["y2"] - m["y1"]
                det = dx * ey - dy * ex
                t = ((m["x1"] - a["x"]) * ey - (m["y1"] - a["y"]) * ex) / F.when(det == 0, None).otherwise(det)
                u = ((m["x1"] - a["x"]) * dy - (m["y1"] - a["y"]) * dx) / F.when(det == 0, None).otherwise(det)
                return F.when((t > 0) & (t < 1) & (u >= 0) & (u <= 1), t)

            ts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.array_compact(F.transform(sides, crossing)))))
            at = lambda t: F.when(t == 0, a).when(t == 1, b).otherwise(F.struct((a["x"] + t * dx).alias("x"), (a["y"] + t * dy).alias("y"), (a["z"] + t * (b["z"] - a["z"])).alias("z")))
            bound = F.transform(F.array(ts), lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 2), lambda k: F.struct(F.get(v, k).alias("p"), F.get(v, k + 1).alias("q"))))[0]
            mid = lambda s: (s["p"] + s["q"]) / 2
            kept = F.filter(bound, lambda s: _odd(sides, a["x"] + mid(s) * dx, a["y"] + mid(s) * dy))
            return F.transform(kept, lambda s: F.array(at(s["p"]), at(s["q"])).cast(f"array<{_POINT}>"))

        pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.size(path) - 2), cut))

        def grow(done: Column, piece: Column) -> Column:
            n = F.size(done)
            last = F.get(done, n - 1)
            joined = F.concat(F.slice(done, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(last, F.slice(piece, 2, 1))))
            return F.when((n > 0) & (F.get(last, F.size(last) - 1) == piece[0]), joined).otherwise(F.concat(done, F.array(piece)))

        return F.when(F.size(path) > 1, F.aggregate(pieces, F.array().cast(f"array<array<{_POINT}>>"), grow)).otherwise(F.array().cast(f"array<array<{_POINT}>>"))

    return F.transform(F.flatten(F.transform(paths(g), stretches)), lambda p: F.array(p))


def _convex_within(ring: Column, mask: Mask) -> Column:
    """A closed convex ring cut down to a box."""
    x0, y0, x1, y1 = mask.box
    half = lambda axis, bound, above: lambda r: clip_ring(r, axis, bound, above)
    for side in (("x", x0, True), ("x", x1, False), ("y", y0, True), ("y", y1, False)):
        ring = F.transform(F.array(ring), half(*side))[0]
    return ring


def is_convex(ring: Column) -> Column:
    """Whether a closed ring turns one way only."""
    at = lambda i: F.get(ring, i)
    turn = lambda i: F.signum(_cross(at(i)["x"], at(i)["y"], at(i + 1)["x"], at(i + 1)["y"], F.get(ring, F.when(i + 2 < F.size(ring), i + 2).otherwise(F.lit(1)))["x"], F.get(ring, F.when(i + 2 < F.size(ring), i + 2).otherwise(F.lit(1)))["y"]))
    turns = F.transform(F.sequence(F.lit(0), F.greatest(F.size(ring) - 2, F.lit(0))), turn)
    return F.forall(turns, lambda t: t >= 0) | F.forall(turns, lambda t: t <= 0)


def _renamed(kind: Column, parts: Column) -> Column:
    """The type's name for the number of parts."""
    bare = F.regexp_replace(kind, "^Multi", "")
    return F.when(kind.startswith("Multi") | (F.size(parts) > 1), F.concat(F.lit("Multi"), bare)).otherwise(bare)


def _kinds(g: Column, mask: Mask) -> tuple[Column, Column]:
    """Whether a polygon lies in the mask as it is, and whether expressions can cut it: convex rings without holes, by a box."""
    if not mask.is_box:
        return F.lit(False), F.lit(False)
    b, (x0, y0, x1, y1) = bbox(g), mask.box
    whole = (b[0] >= x0) & (b[2] <= x1) & (b[1] >= y0) & (b[3] <= y1)
    return whole, F.forall(g["parts"], lambda p: (F.size(p) == 1) & is_convex(p[0]))


def to_cut(g: Column, mask: Mask) -> Column:
    """The parts of a polygon that ``plane.with_cuts`` must cut; null where nothing or an expression will do."""
    whole, easy = _kinds(g, mask)
    return F.when(g["type"].isin("Polygon", "MultiPolygon") & ~whole & ~easy, g["parts"])


def clip(g: Column, mask: Mask, cut: Column) -> Column:
    """The part of a geometry within the mask: points and lines keep what lies in it, polygons are cut.

    ``cut`` has what ``plane.with_cuts`` made of ``to_cut``.
    """
    sides = mask.sides()
    whole, easy = _kinds(g, mask)
    point = lambda p: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), p["x"].alias("x2"), p["y"].alias("y2"))
    kept = F.filter(g["parts"], lambda p: _odd(sides, p[0][0]["x"], p[0][0]["y"]) | F.exists(sides, lambda m: _meet(point(p[0][0]), m)))
    boxed = F.filter(F.transform(g["parts"], lambda p: F.transform(p, lambda r: _convex_within(r, mask))), lambda p: F.size(p[0]) > 3)
    parts = F.when(whole, g["parts"]).when(g["type"].isin("Point", "MultiPoint"), kept).when(g["type"].isin("LineString", "MultiLineString"), _lines_within(g, mask)).when(easy, boxed).otherwise(cut)
    return F.transform(F.array(parts), lambda p: F.struct(_renamed(g["type"], p).alias("type"), g["has_z"].alias("has_z"), p.alias("parts")))[0]


def transformed(g: Column, move) -> Column:
    """A geometry with its points carried over by ``move``, a function of two columns; z stays."""
    one = lambda p: F.struct(move(p["x"], p["y"])[0].alias("x"), move(p["x"], p["y"])[1].alias("y"), p["z"].alias("z"))
    parts = F.transform(g["parts"], lambda part: F.transform(part, lambda r: F.transform(r, one)))
    return F.when(g.isNotNull(), F.struct(g["type"].alias("type"), g["has_z"].alias("has_z"), parts.alias("parts")))


def value_of(geometry) -> dict:
    """The struct's value, in Python, of a GeoJSON-like dict or an object that offers one."""
    g = geometry if isinstance(geometry, dict) else geometry.__geo_interface__
    kind, c = g["type"], g["coordinates"]
    parts = {"Point": lambda: [[[c]]], "LineString": lambda: [[c]], "MultiPoint": lambda: [[[p]] for p in c], "MultiLineString": lambda: [[x] for x in c], "Polygon": lambda: [c], "MultiPolygon": lambda: c}[kind]()
    pt = lambda p: {"x": float(p[0]), "y": float(p[1]), "z": float(p[2]) if len(p) > 2 else 0.0}
    return {"type": kind, "has_z": any(len(p) > 2 for part in parts for r in part for p in r), "parts": [[[pt(p) for p in r] for r in part] for part in parts]}


# --- text ----------------------------------------------------------------------------------------


def to_coordinates(g: Column) -> Column:
    """The nested lists of coordinates, as JSON text."""
    return F.get_json_object(to_geojson(g), "$.coordinates")


def to_geojson(g: Column) -> Column:
    """GeoJSON text of points, lines, polygons and their multiples, in two dimensions."""
    xy = lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    parts = g["parts"]
    nest = {
        "Point": F.to_json(xy(parts[0][0])[0]),
        "LineString": F.to_json(xy(parts[0][0])),
        "MultiPoint": F.to_json(F.transform(parts, lambda p: xy(p[0])[0])),
        "MultiLineString": F.to_json(F.transform(parts, lambda p: xy(p[0]))),
        "Polygon": F.to_json(F.transform(parts[0], xy)),
        "MultiPolygon": F.to_json(F.transform(parts, lambda p: F.transform(p, xy))),
    }
    coords = F.lit(None).cast("string")
    for k, v in nest.items():
        coords = F.when(g["type"] == k, v).otherwise(coords)
    return F.concat(F.lit('{"type":"'), g["type"], F.lit('","coordinates":'), coords, F.lit("}"))


def to_wkt(g: Column) -> Column:
    """WKT of points, lines and polygons of one part and of their multiples."""
    xy = lambda ring: F.concat(F.lit("("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))
    rings = lambda part: F.concat(F.lit("("), F.array_join(F.transform(part, xy), ", "), F.lit(")"))
    parts = g["parts"]
    body = F.when(g["type"].isin("Point", "LineString"), xy(parts[0][0])).when(g["type"].isin("MultiPoint", "MultiLineString"), F.concat(F.lit("("), F.array_join(F.transform(parts, lambda p: xy(p[0])), ", "), F.lit(")")))
    body = body.when(g["type"] == "Polygon", rings(parts[0])).otherwise(F.concat(F.lit("("), F.array_join(F.transform(parts, rings), ", "), F.lit(")")))
    return F.concat(F.upper(g["type"]), F.lit(" "), body)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is made once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def from_geojson(text: Column) -> Column:
    """The struct for GeoJSON text of points, lines, polygons and their multiples; null for null."""
    return _bound(F.from_json(text, "type string, coordinates string"), _of_geojson)


def _of_geojson(g: Column) -> Column:
    c, kind = g["coordinates"], g["type"]
    read = lambda depth: F.from_json(c, "array<" * depth + "double" + ">" * depth)
    pt = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"), F.coalesce(F.get(p, 2), F.lit(0.0)).alias("z"))
    ring = lambda r: F.transform(r, pt)
    parts = {
        "Point": (1, lambda v: F.array(F.array(F.array(pt(v))))),
        "LineString": (2, lambda v: F.array(F.array(ring(v)))),
        "MultiPoint": (2, lambda v: F.transform(v, lambda p: F.array(F.array(pt(p))))),
        "MultiLineString": (3, lambda v: F.transform(v, lambda r: F.array(ring(r)))),
        "Polygon": (3, lambda v: F.array(F.transform(v, ring))),
        "MultiPolygon": (4, lambda v: F.transform(v, lambda p: F.transform(p, ring))),
    }
    deep = lambda v, depth: F.size(v) > 2 if depth == 1 else F.exists(v, lambda p: deep(p, depth - 1))
    # the numbers are parsed once, for the points and for whether one has a height
    both = lambda depth, of: _bound(read(depth), lambda v: F.struct(deep(v, depth).alias("z"), of(v).alias("parts")))
    out = F.lit(None).cast("struct<z:boolean,parts:array<array<array<struct<x:double,y:double,z:double>>>>>")
    for name, (depth, of) in parts.items():
        out = F.when(kind == name, both(depth, of)).otherwise(out)
    return F.when(kind.isNotNull(), _bound(out, lambda o: F.struct(kind.alias("type"), F.coalesce(o["z"], F.lit(False)).alias("has_z"), o["parts"].alias("parts"))))


def from_wkt(text: Column) -> Column:
    """The struct for WKT of points, lines, polygons and their multiples, with or without Z; null for null or empty geometries.

    Brackets become GeoJSON's, so the text is read by the same parser.
    """
    return _bound(F.trim(F.upper(text)), _of_wkt)


def _of_wkt(t: Column) -> Column:
    kind = F.regexp_extract(t, r"^([A-Z]+)", 1)
    name = F.element_at(F.create_map(*[F.lit(v) for k in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon") for v in (k.upper(), k)]), kind)
    body = F.regexp_replace(F.regexp_extract(t, r"(\(.*\))", 1), r"\s+", " ")
    body = F.regexp_replace(body, r" ?([(),]) ?", "$1")
    # points lose brackets of their own in a multipoint, then each point gets its pair
    multi = lambda b: F.when(kind == "MULTIPOINT", F.concat(F.lit("("), F.regexp_replace(b, r"[()]", ""), F.lit(")"))).otherwise(b)
    return _bound(_bound(body, multi), lambda b: F.when(b != "", _numbers_of_wkt(kind, name, b)))


def _numbers_of_wkt(kind: Column, name: Column, body: Column) -> Column:
    points = F.regexp_replace(body, r"\s*([-+0-9.E]+(?: [-+0-9.E]+)+)\s*", "[$1]")
    numbers = F.replace(points, F.lit(" "), F.lit(","))
    numbers = F.regexp_replace(F.regexp_replace(numbers, r"(?<![0-9])\.", "0."), r"\.(?![0-9])", ".0")
    numbers = F.replace(F.replace(F.replace(numbers, F.lit("("), F.lit("[")), F.lit(")"), F.lit("]")), F.lit("+"), F.lit(""))
    coords = _bound(numbers, lambda n: F.when(kind == "POINT", F.regexp_replace(n, r"^\[(.*)\]$", "$1")).otherwise(n))
    return from_geojson(F.concat(F.lit('{"type":"'), name, F.lit('","coordinates":'), coords, F.lit("}")))
