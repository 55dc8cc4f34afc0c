"""The algebra of footprints as expressions over a struct column of type ``FP``.

Everything here is arithmetic on the struct's fields, so Catalyst prunes the fields that a query does
not use and compiles the rest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..env import current

FIELDS = ("tlx", "dx", "rx", "tly", "ry", "dy", "rsx", "rsy")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def bind(value: Column, f):
    """``f(value)`` with the value computed once: an expression that uses it often would repeat it in the plan."""
    return F.transform(F.array(value), f)[0]


def make(tlx, dx, rx, tly, ry, dy, rsx, rsy) -> Column:
    v = [_c(x).cast("double") for x in (tlx, dx, rx, tly, ry, dy)] + [_c(x).cast("int") for x in (rsx, rsy)]
    return F.struct(*[x.alias(n) for x, n in zip(v, FIELDS)])


def checked(fp: Column, complex_allowed: bool | None = None) -> Column:
    """``fp``, or an error where it has no pixels, no area or, unless allowed, is not north-up."""
    if complex_allowed is None:
        complex_allowed = current().allow_complex_footprint
    ok = (fp["rsx"] > 0) & (fp["rsy"] > 0) & ((fp["dx"] * fp["dy"] - fp["rx"] * fp["ry"]) != 0)
    if not complex_allowed:
        ok = ok & (fp["rx"] == 0) & (fp["ry"] == 0) & (fp["dx"] > 0) & (fp["dy"] < 0)
    return F.when(ok, fp).otherwise(F.raise_error(F.lit("not a legal footprint")).cast("struct<tlx:double,dx:double,rx:double,tly:double,ry:double,dy:double,rsx:int,rsy:int>"))


def of_extent(minx, maxx, miny, maxy, scale_x, scale_y) -> Column:
    """A north-up footprint over a rectangle; the pixel counts are snapped and truncated, the pixels fill the rectangle."""
    nx = F.floor(F.rint((_c(maxx) - _c(minx)) / scale_x * 1e9) / 1e9).cast("int")
    ny = F.floor(F.rint((_c(maxy) - _c(miny)) / scale_y * 1e9) / 1e9).cast("int")
    return make(minx, (_c(maxx) - _c(minx)) / nx, 0.0, maxy, 0.0, -(_c(maxy) - _c(miny)) / ny, nx, ny)


# --- vectors and corners -------------------------------------------------------------------------


def at(fp: Column, col, row) -> tuple[Column, Column]:
    """Coordinates of a point of the raster space."""
    col, row = _c(col), _c(row)
    return fp["tlx"] + col * fp["dx"] + row * fp["rx"], fp["tly"] + col * fp["ry"] + row * fp["dy"]


def corners(fp: Column) -> dict[str, tuple[Column, Column]]:
    w, h = fp["rsx"], fp["rsy"]
    return {"tl": at(fp, 0, 0), "bl": at(fp, 0, h), "br": at(fp, w, h), "tr": at(fp, w, 0), "t": at(fp, w / 2, 0), "l": at(fp, 0, h / 2), "b": at(fp, w / 2, h), "r": at(fp, w, h / 2), "c": at(fp, w / 2, h / 2)}


def bounds(fp: Column) -> tuple[Column, Column, Column, Column]:
    """(minx, miny, maxx, maxy)."""
    c = [corners(fp)[k] for k in ("tl", "bl", "br", "tr")]
    xs, ys = [p[0] for p in c], [p[1] for p in c]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def extent(fp: Column) -> tuple[Column, Column, Column, Column]:
    a, b, c, d = bounds(fp)
    return a, c, b, d


def vectors(fp: Column) -> dict[str, tuple[Column, Column]]:
    lr = fp["dx"] * fp["rsx"], fp["ry"] * fp["rsx"]
    tb = fp["rx"] * fp["rsy"], fp["dy"] * fp["rsy"]
    diag = lr[0] + tb[0], lr[1] + tb[1]
    return {"lrvec": lr, "tbvec": tb, "diagvec": diag, "pxlrvec": (fp["dx"], fp["ry"]), "pxtbvec": (fp["rx"], fp["dy"]), "pxvec": (diag[0] / fp["rsx"], diag[1] / fp["rsy"])}


def angle(fp: Column) -> Column:
    return F.degrees(F.atan2(fp["ry"], fp["dx"]))


def _unrotated(fp: Column) -> tuple[Column, Column]:
    n = F.sqrt(fp["dx"] * fp["dx"] + fp["ry"] * fp["ry"])
    cos, sin = fp["dx"] / n, fp["ry"] / n
    x, y = vectors(fp)["diagvec"]
    return cos * x + sin * y, cos * y - sin * x


def size(fp: Column) -> tuple[Column, Column]:
    x, y = _unrotated(fp)
    return F.abs(x), F.abs(y)


def scale(fp: Column) -> tuple[Column, Column]:
    x, y = _unrotated(fp)
    return x / fp["rsx"], y / fp["rsy"]


def pxsize(fp: Column) -> tuple[Column, Column]:
    x, y = size(fp)
    return x / fp["rsx"], y / fp["rsy"]


def area(fp: Column) -> Column:
    x, y = size(fp)
    return x * y


def length(fp: Column) -> Column:
    x, y = size(fp)
    return 2 * (x + y)


def semiaxes(fp: Column) -> tuple[Column, Column]:
    x, y = size(fp)
    return F.least(x, y) / 2, F.greatest(x, y) / 2


def rarea(fp: Column) -> Column:
    return fp["rsx"].cast("long") * fp["rsy"]


def shape(fp: Column) -> Column:
    """(rsy, rsx), as arrays have it."""
    return F.array(fp["rsy"], fp["rsx"])


def rlength(fp: Column) -> Column:
    inner = F.greatest(F.lit(0), fp["rsx"] - 2).cast("long") * F.greatest(F.lit(0), fp["rsy"] - 2)
    return rarea(fp) - inner


def _half(x: Column) -> Column:
    return F.floor(x / 2).cast("int")


def raster_points(fp: Column) -> dict[str, tuple[Column, Column]]:
    w, h, o = fp["rsx"] - 1, fp["rsy"] - 1, F.lit(0)
    return {"rtl": (o, o), "rbl": (o, h), "rbr": (w, h), "rtr": (w, o), "rt": (_half(w), o), "rl": (o, _half(h)), "rb": (_half(w), h), "rr": (w, _half(h)), "rc": (_half(w), _half(h))}


def rsemiaxes(fp: Column) -> tuple[Column, Column]:
    return _half(F.least(fp["rsx"], fp["rsy"])), _half(F.greatest(fp["rsx"], fp["rsy"]))


def affine(fp: Column, n: int = 6) -> Column:
    v = [fp[k] for k in ("dx", "rx", "tlx", "ry", "dy", "tly")]
    return F.array(*v, *[F.lit(x) for x in (0.0, 0.0, 1.0)][: n - 6])


def gt(fp: Column) -> Column:
    return F.array(*[fp[k] for k in FIELDS[:6]])


def ring(fp: Column) -> Column:
    """The closed ring tl, bl, br, tr, tl."""
    c = corners(fp)
    return F.array(*[F.struct(c[k][0].alias("x"), c[k][1].alias("y"), F.lit(0.0).alias("z")) for k in ("tl", "bl", "br", "tr", "tl")])


def poly(fp: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.lit(False).alias("has_z"), F.array(F.array(ring(fp))).alias("parts"))


def geo_interface(fp: Column) -> Column:
    c = corners(fp)
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*[F.array(*c[k]) for k in ("tl", "bl", "br", "tr", "tl")])).alias("coordinates")))


def text(fp: Column) -> Column:
    s, r = scale(fp), fp
    flat = F.format_string("Footprint(tl=(%f, %f), scale=(%f, %f), rsize=(%d, %d))", r["tlx"], r["tly"], s[0], s[1], r["rsx"], r["rsy"])
    turned = F.format_string("Footprint(tl=(%f, %f), scale=(%f, %f), angle=%f, rsize=(%d, %d))", r["tlx"], r["tly"], s[0], s[1], angle(fp), r["rsx"], r["rsy"])
    return F.when((r["rx"] == 0) & (r["ry"] == 0), flat).otherwise(turned)


def key(fp: Column) -> Column:
    return F.xxhash64(*[fp[k] for k in FIELDS])


# --- precision -----------------------------------------------------------------------------------


def _far(*fps: Column) -> Column:
    return F.greatest(*[F.abs(v) for fp in fps for v in bounds(fp)])


def significant_min(fp: Column) -> Column:
    return -F.log10(F.least(*pxsize(fp)) / F.greatest(_far(fp), F.lit(1.0)))


def density(fp: Column, significant: float | None = None, floor_one: bool = False) -> Column:
    """Density of the abstract grid that values are snapped to before they are floored or ceiled."""
    s = current().significant if significant is None else significant
    far = F.greatest(_far(fp), F.lit(1.0)) if floor_one else _far(fp)
    return F.floor(F.least(*pxsize(fp)) / (far * F.lit(10.0**-s))).cast("double")


# --- coordinates ---------------------------------------------------------------------------------


def inverse(fp: Column, x, y) -> tuple[Column, Column]:
    """Raster coordinates, as doubles, of a point."""
    u, v = _c(x) - fp["tlx"], _c(y) - fp["tly"]
    det = fp["dx"] * fp["dy"] - fp["rx"] * fp["ry"]
    return (u * fp["dy"] - v * fp["rx"]) / det, (v * fp["dx"] - u * fp["ry"]) / det


def spatial_to_raster(fp: Column, x, y, op: str = "floor", dtype: str | None = None, dense: Column | None = None) -> tuple[Column, Column]:
    """Pixel indices of a point; ``op`` is floor, ceil, rint or none, and does not apply to float types.

    ``dense`` is a column that holds ``density(fp)`` where a footprint has many points.
    """
    dtype = dtype or current().default_index_dtype
    d = density(fp) if dense is None else dense
    out = []
    for v in inverse(fp, x, y):
        if dtype in ("float", "double"):
            out.append(v.cast(dtype))
            continue
        rounding = {"floor": F.floor, "ceil": F.ceil, "rint": F.rint, "none": lambda z: z}[op]
        snapped = lambda v, d: rounding(F.rint(v * d) / d)
        out.append((bind(F.struct(v.alias("v"), d.alias("d")), lambda t: snapped(t["v"], t["d"])) if dense is None else snapped(v, d)).cast(dtype))
    return out[0], out[1]


raster_to_spatial = at


def slice_in(fp: Column, other: Column, clip: bool = False, dense: Column | None = None) -> dict[str, Column]:
    """Where ``fp``, on the grid of ``other``, lies in it: half-open ranges of columns and rows; ``dense`` as in ``spatial_to_raster``."""
    x0, y0 = spatial_to_raster(other, fp["tlx"], fp["tly"], "rint", dense=dense)
    v = {"x0": x0, "x1": x0 + fp["rsx"], "y0": y0, "y1": y0 + fp["rsy"]}
    if clip:
        v = {k: F.least(F.greatest(c, F.lit(0)), other["rsx" if k[0] == "x" else "rsy"]) for k, c in v.items()}
    return v


# --- predicates ----------------------------------------------------------------------------------


def equals(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def almost_equals(a: Column, b: Column, significant: float | None = None) -> Column:
    s = current().significant if significant is None else significant
    ca, cb = corners(a), corners(b)
    off = F.greatest(*[F.abs(ca[k][i] - cb[k][i]) for k in ("tl", "bl", "br", "tr") for i in (0, 1)])
    return (a["rsx"] == b["rsx"]) & (a["rsy"] == b["rsy"]) & (off < _far(a, b) * F.lit(10.0**-s))


def same_grid(a: Column, b: Column, significant: float | None = None) -> Column:
    """Whether both lie on one grid: pixel vectors agree over the longer footprint, and the top left corners are whole pixels apart."""
    s = current().significant if significant is None else significant
    w, h = F.greatest(a["rsx"], b["rsx"]), F.greatest(a["rsy"], b["rsy"])
    off = [F.abs(a[k] - b[k]) * n for k, n in (("dx", w), ("ry", w), ("rx", h), ("dy", h))]
    u, v = inverse(a, b["tlx"], b["tly"])
    x, y = at(a, F.rint(u), F.rint(v))
    return F.greatest(*off, F.abs(x - b["tlx"]), F.abs(y - b["tly"])) < _far(a, b) * F.lit(10.0**-s)


def boxes_share_area(a, b) -> Column:
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def share_area(a: Column, b: Column) -> Column:
    """Whether two footprints overlap in more than an edge: no edge direction of either separates them."""
    ca, cb = ([corners(f)[k] for k in ("tl", "bl", "br", "tr")] for f in (a, b))
    ok = F.lit(True)
    for f in (a, b):
        for vx, vy in ((f["dx"], f["ry"]), (f["rx"], f["dy"])):
            pa, pb = ([x * vx + y * vy for x, y in c] for c in (ca, cb))
            ok = ok & (F.least(*pa) < F.greatest(*pb)) & (F.least(*pb) < F.greatest(*pa))
    return ok


# --- derivation ----------------------------------------------------------------------------------


def moved(fp: Column, left, top, rsx, rsy) -> Column:
    """``fp`` from pixel (left, top) on, with a new number of pixels."""
    x, y = at(fp, left, top)
    return make(x, fp["dx"], fp["rx"], y, fp["ry"], fp["dy"], rsx, rsy)


def dilate(fp: Column, left, right=None, top=None, bottom=None) -> Column:
    """Pixels added on each side: one number for all, two for x and y, or four."""
    if right is None:
        left = right = top = bottom = left
    elif top is None:
        left, right, top, bottom = left, left, right, right
    l, r, t, b = map(_c, (left, right, top, bottom))
    return moved(fp, -l, -t, fp["rsx"] + l + r, fp["rsy"] + t + b)


def erode(fp: Column, left, right=None, top=None, bottom=None) -> Column:
    return dilate(fp, *[None if v is None else -_c(v) for v in (left, right, top, bottom)])


def _index(i, n: Column) -> Column:
    i = _c(i)
    return F.least(F.greatest(F.when(i < 0, i + n).otherwise(i), F.lit(0)), n)


def clip(fp: Column, x0=None, y0=None, x1=None, y1=None) -> Column:
    """Pixels in ranges that follow the rules of sequence slices; None is an open end."""
    w, h = fp["rsx"], fp["rsy"]
    a, b = _index(0 if x0 is None else x0, w), _index(0 if y0 is None else y0, h)
    c, d = w if x1 is None else _index(x1, w), h if y1 is None else _index(y1, h)
    return moved(fp, a, b, c - a, d - b)


def intersection(fp: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """The smallest footprint on the grid of the north-up ``fp`` over its intersection with a box (minx, miny, maxx, maxy).

    Null where they share no area.  Values are snapped before they are floored or ceiled.
    """
    a = bounds(fp)
    shared = F.struct(F.greatest(a[0], box[0]).alias("minx"), F.greatest(a[1], box[1]).alias("miny"), F.least(a[2], box[2]).alias("maxx"), F.least(a[3], box[3]).alias("maxy"))

    def place(g: Column) -> Column:
        far = F.greatest(*[F.abs(g[n]) for n in ("minx", "miny", "maxx", "maxy")], F.lit(1.0))
        d = F.floor(F.least(F.abs(fp["dx"]), F.abs(fp["dy"])) / (far * F.lit(10.0**-current().significant))).cast("double")

        def corner(d: Column) -> Column:
            snap = lambda v: F.rint(v * d) / d
            x0, y0 = F.floor(snap((g["minx"] - fp["tlx"]) / fp["dx"])), F.floor(snap((g["maxy"] - fp["tly"]) / fp["dy"]))

            def whole(tl: Column) -> Column:
                w = F.greatest(F.lit(1), F.ceil(snap((g["maxx"] - tl["x"]) / fp["dx"])))
                h = F.greatest(F.lit(1), F.ceil(snap((g["miny"] - tl["y"]) / fp["dy"])))
                return make(tl["x"], fp["dx"], fp["rx"], tl["y"], fp["ry"], fp["dy"], w, h)

            return bind(F.struct((fp["tlx"] + x0 * fp["dx"]).alias("x"), (fp["tly"] + y0 * fp["dy"]).alias("y")), whole)

        return F.when((g["minx"] < g["maxx"]) & (g["miny"] < g["maxy"]), bind(d, corner))

    return bind(shared, place)


def overlap(fp: Column, ring: Column) -> Column:
    """The smallest footprint on the grid of ``fp``, which may be turned, over what it shares with a convex closed ring of points.

    The ring is carried to raster coordinates, cut down to the raster and bounded.  Null where they share
    no area.
    """
    from .geometry import clip_ring

    def place(f: Column) -> Column:
        def carried(p: Column) -> Column:
            u, v = inverse(f, p["x"], p["y"])
            return F.struct(u.alias("x"), v.alias("y"), F.lit(0.0).alias("z"))

        r = F.transform(F.array(F.transform(ring, carried)), lambda x: x)[0]
        cut = lambda axis, end: lambda t: clip_ring(t["r"], axis, t["b"], not end)
        for axis in ("x", "y"):
            for end in (0, 1):
                bound = f["rsx" if axis == "x" else "rsy"].cast("double") if end else F.lit(0.0)
                r = F.transform(F.array(F.struct(r.alias("r"), bound.alias("b"))), cut(axis, end))[0]
        of = lambda k, axis: k(F.transform(r, lambda p: p[axis]))
        box = F.struct(of(F.array_min, "x").alias("x0"), of(F.array_min, "y").alias("y0"), of(F.array_max, "x").alias("x1"), of(F.array_max, "y").alias("y1"), density(f, floor_one=True).alias("d"))

        def whole(b: Column) -> Column:
            snap = lambda c: F.rint(c * b["d"]) / b["d"]
            x0, y0 = F.floor(snap(b["x0"])), F.floor(snap(b["y0"]))
            w, h = F.greatest(F.lit(1), F.ceil(snap(b["x1"])) - x0), F.greatest(F.lit(1), F.ceil(snap(b["y1"])) - y0)
            return F.when((b["x0"] < b["x1"]) & (b["y0"] < b["y1"]), moved(f, x0, y0, w, h))

        return bind(box, whole)

    return bind(fp, place)


def grid_fraction(fp: Column) -> tuple[Column, Column]:
    """Where the nearest grid point before the origin lies, in pixels within [0, 1): equal for footprints on one grid of one pixel size."""
    u, v = inverse(fp, 0.0, 0.0)
    d = density(fp, floor_one=True)
    part = lambda c: bind(F.struct(c.alias("c"), d.alias("d")), lambda t: F.pmod(F.rint(F.pmod(t["c"], F.lit(1.0)) * t["d"]) / t["d"], F.lit(1.0)))
    return part(u), part(v)


def move(fp: Column, tl, tr=None, br=None) -> Column:
    """``fp`` with new corners: translated; turned and scaled alike in both directions; or scaled in each."""
    tlx, tly = map(_c, tl)
    if tr is None:
        return make(tlx, fp["dx"], fp["rx"], tly, fp["ry"], fp["dy"], fp["rsx"], fp["rsy"])
    dx, ry = (_c(tr[0]) - tlx) / fp["rsx"], (_c(tr[1]) - tly) / fp["rsx"]
    if br is not None:
        return make(tlx, dx, (_c(br[0]) - _c(tr[0])) / fp["rsy"], tly, ry, (_c(br[1]) - _c(tr[1])) / fp["rsy"], fp["rsx"], fp["rsy"])
    # the same turn and scale for the other direction: multiplication by (dx + i ry) / (old dx + i old ry)
    n = fp["dx"] * fp["dx"] + fp["ry"] * fp["ry"]
    c, s = (dx * fp["dx"] + ry * fp["ry"]) / n, (ry * fp["dx"] - dx * fp["ry"]) / n
    return make(tlx, dx, c * fp["rx"] - s * fp["dy"], tly, ry, s * fp["rx"] + c * fp["dy"], fp["rsx"], fp["rsy"])


def _pair(v, least: int) -> tuple[int, int]:
    y, x = (v, v) if isinstance(v, int) else v
    if min(x, y) < least:
        raise ValueError(f"at least {least} is needed")
    return x, y


def _stretched(fp: Column, shift, factor, counts) -> Column:
    """Top left moved by ``shift`` pixels, pixel vectors times ``factor``, new counts; all as (x, y)."""
    x, y = at(fp, shift[0], shift[1])
    return make(x, fp["dx"] * factor[0], fp["rx"] * factor[1], y, fp["ry"] * factor[0], fp["dy"] * factor[1], counts[0], counts[1])


def conv2d(fp: Column, kernel, stride=1, padding=0, dilation=1, backward: bool = False) -> Column:
    """The footprint after a convolution, or before one; parameters are numbers or pairs (y, x)."""
    k, s, p, d = _pair(kernel, 1), _pair(stride, 1), _pair(padding, 0), _pair(dilation, 1)
    n, shift, factor = [], [], []
    for i, rs in enumerate((fp["rsx"], fp["rsy"])):
        wide = 1 + (k[i] - 1) * d[i]
        if not backward:
            rs = F.when(rs + 2 * p[i] >= wide, rs).otherwise(F.raise_error(F.lit("the kernel is wider than the padded raster")).cast("int"))
        if backward:
            n.append((rs - 1) * s[i] - 2 * p[i] + wide)
            shift.append((p[i] - (wide - 1) / 2) / s[i])
            factor.append(1 / s[i])
        else:
            n.append(1 + F.floor((rs + 2 * p[i] - wide) / s[i]))
            shift.append(-p[i] + (wide - 1) / 2)
            factor.append(float(s[i]))
    return _stretched(fp, shift, factor, n)


def convtranspose2d(fp: Column, kernel, stride=1, padding=0, dilation=1, output_padding=0, backward: bool = False) -> Column:
    """The footprint after a transposed convolution, or before one."""
    k, s, p, d, o = _pair(kernel, 1), _pair(stride, 1), _pair(padding, 0), _pair(dilation, 1), _pair(output_padding, 0)
    n, shift, factor = [], [], []
    for i, rs in enumerate((fp["rsx"], fp["rsy"])):
        reach = (k[i] - 1) * d[i]
        q = reach - p[i]
        if backward:
            n.append((rs + reach - o[i] - 2 * q + s[i] - 1) / s[i])
            shift.append(q - reach / 2)
            factor.append(float(s[i]))
        else:
            n.append(rs + (rs - 1) * (s[i] - 1) + 2 * q - reach + o[i])
            shift.append((-q + reach / 2) / s[i])
            factor.append(1 / s[i])
    return _stretched(fp, shift, factor, n)
