"""Classes of similar texts from band keys, in DataFrame functions only.

A key's texts are not all paired with each other.  Sketches bound the similarity of two texts: they differ
in no more bits than the sets of shingles differ in hashes, which the similarity limits.  Pairs within
that bound are compared, by the exact Jaccard similarity of the two sets of all shingles.

First each text is compared with its key's hub, the text that shares keys with most others; a class of near copies of one text is joined by that.  In keys
of more than ``SMALL`` texts that are then in several components, texts outside the largest one are
compared with one of its texts and all texts with one outside it; these rounds go on while they join
more than a ``PROGRESS`` of what is outside.  Last, every pair of texts of one key in different
components, one of which at least is outside the key's largest component, is held against the bound.  The
bound is part of the join, so pairs beyond it are no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop_cut

WORDS = 16
SMALL = 32
PROGRESS = 0.05
#: texts of a key that one task holds against as many others
CHUNK = 2048
#: from a text to the array of its distinct shingles' hashes
Shingles = Callable[[Column], Column]


def sketches(texts: DataFrame, shingles: Shingles) -> DataFrame:
    """(h, n, w0, w1, ...) of ``texts`` (h, text): the number of shingles, and the parities of ``64 * WORDS`` classes of their hashes as bits.

    A hash that one of two sets lacks changes one bit, so two sets differ in as many hashes as their
    sketches in bits, or more.
    """
    # arrays are made before they are exploded, as code is generated for a generator of plain columns only;
    # the outer form, as the plain one would add a filter that makes all shingles once more
    x = texts.select("h", shingles(F.col("text")).alias("s")).select("h", F.explode_outer("s").alias("x"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("x", 58).cast("int"))
    words = [F.coalesce(F.bit_xor(F.when(F.pmod("x", F.lit(WORDS)) == k, bit)), F.lit(0)).alias(f"w{k}") for k in range(WORDS)]
    return x.groupBy("h").agg(F.count("x").cast("int").alias("n"), *words)


def alike(x: str, y: str, least: float) -> Column:
    """Whether the sketches whose columns begin with ``x`` and ``y`` allow a Jaccard similarity of ``least``."""
    nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
    apart = sum((F.bit_count(F.col(f"{x}w{k}").bitwiseXOR(F.col(f"{y}w{k}"))) for k in range(WORDS)), F.lit(0))
    return (F.least(nx, ny) >= F.greatest(nx, ny) * least - 1e-9) & (apart <= (nx + ny) * ((1 - least) / (1 + least)) + 1e-9)


def prefixed(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keep])


def possible_pairs(pairs: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b and more) whose sketches in ``marks`` allow a similarity of ``least``."""
    x, y = prefixed(marks, "x"), prefixed(marks, "y")
    return pairs.join(x, F.col("a") == F.col("xh")).join(y, F.col("b") == F.col("yh")).where(alike("x", "y", least)).select(*pairs.columns)


def similar_pairs(pairs: DataFrame, texts: DataFrame, shingles: Shingles, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b and more) of ``texts`` (h, text) whose sets of shingles have a Jaccard similarity of ``least`` or more."""
    x, y = texts.select(F.col("h").alias("a"), F.col("text").alias("ta")), texts.select(F.col("h").alias("b"), F.col("text").alias("tb"))
    full = pairs.join(x, "a").join(y, "b")
    s = full.select(*pairs.columns, shingles(F.col("ta")).alias("x"), shingles(F.col("tb")).alias("y"))
    s = s.select(*pairs.columns, (F.size("x") + F.size("y")).alias("both"), F.size(F.array_intersect("x", "y")).alias("n"))
    return s.where(F.col("n") >= F.lit(least) * (F.col("both") - F.col("n")) - 1e-9).select(*pairs.columns)


def open_rows(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, h, size, score, root, main) of the keys whose texts are in more than one component; ``main`` is the largest one."""
    rows = met.join(roots, "h", "left").select("key", "h", "score", F.coalesce("root", "h").alias("root"))
    parts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    keys = parts.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts"))
    return rows.join(keys.where("parts > 1 and size > 2").drop("parts"), "key")


def hubs(rows: DataFrame, by: Column) -> DataFrame:
    """(key, hub, hub_root): of each key, the text of the highest ``by``."""
    top = rows.groupBy("key").agg(F.max(F.struct(by.alias("by"), "h", "root")).alias("m"))
    return top.select("key", F.col("m.h").alias("hub"), F.col("m.root").alias("hub_root"))


def edges(met: DataFrame) -> DataFrame:
    """(a, b, ra, rb) once for each pair of ``met`` (h, root, hub, hub_root)."""
    return met.select(F.greatest("h", "hub").alias("a"), F.least("h", "hub").alias("b"), F.col("root").alias("ra"), F.col("hub_root").alias("rb")).distinct()


def similar_classes(source: DataFrame, keyed: DataFrame, shingles: Shingles, least: float, known: DataFrame | None = None) -> DataFrame:
    """(h, root) of the texts that are similar to another one; see the module's text.

    ``source`` (h, text) may repeat texts, as may ``keyed`` (h, keys: array of hashes).  ``known`` (h, root)
    has components to start from.
    """
    # both uses need this partitioning, so they share one shuffle
    flat = keyed.select("h", F.explode_outer("keys").alias("key")).where("key is not null").repartition("key")
    many = flat.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("top"), F.count(F.lit(1)).alias("n")).where("low <> top").select("key", "n")
    met = cut(flat.join(many.hint("shuffle_hash"), "key").distinct(), dictionary=False)
    scores = cut(met.groupBy("h").agg(F.sum("n").alias("score")), dictionary=False)
    # every text moves here; the hash join spares sorting them, and a row of ``scores`` is small
    texts = cut(source.join(scores.hint("shuffle_hash"), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text")))
    marks = cut(sketches(texts, shingles), dictionary=False)
    rows = cut(met.select("key", "h").join(scores, "h"), dictionary=False)
    drop_cut(met)
    drop_cut(scores)
    roots = source.sparkSession.createDataFrame([], "h long, root long") if known is None else known

    def join_up(pairs: DataFrame) -> tuple[DataFrame, int]:
        """The roots after the links among ``pairs``, and the number of pairs of components that they join."""
        found = cut(similar_pairs(pairs, texts, shingles, least))
        n = found.select("ra", "rb").distinct().count()
        out = cut(with_links(roots, found))
        drop_cut(found)
        return out, n

    at = rows.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    roots, _ = join_up(possible_pairs(edges(at.join(hubs(at, F.col("score")), "key").where("root <> hub_root")), marks, least))
    number = 0
    while True:
        number += 1
        at = cut(open_rows(rows, roots).where(F.col("size") > SMALL))
        if at.isEmpty():
            drop_cut(at)
            break
        out = at.where("root <> main")
        here = F.xxhash64("h", F.lit(number))
        to_main, to_out = out.join(hubs(at.where("root = main"), here), "key"), at.join(hubs(out, here), "key").where("root <> hub_root")
        names = ["h", "root", "hub", "hub_root"]
        before, left = roots, out.select("root").distinct().count()
        roots, n = join_up(possible_pairs(edges(to_main.select(*names).unionByName(to_out.select(*names))), marks, least))
        drop_cut(before)
        drop_cut(at)
        if n <= PROGRESS * left:
            break
    pairs = cut(open_pairs(open_rows(rows, roots), marks, least))
    drop_cut(rows)
    before, (roots, _) = roots, join_up(pairs)
    for done in (before, pairs, texts, marks):
        drop_cut(done)
    return roots


def open_pairs(at: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """(a, b, ra, rb): the pairs of texts of one key in different components whose sketches allow a similarity of ``least``.

    A key of more than ``CHUNK`` texts is cut into chunks, and each pair of chunks meets on a key of its own.
    """
    at = cut(at.select("key", "h", "root", "main", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")).join(marks, "h"), dictionary=False)
    mine, others = F.pmod(F.xxhash64("h"), F.col("chunks")).cast("int"), F.sequence(F.lit(0), F.col("chunks") - 1)
    left = at.where("root <> main").withColumn("i", mine).withColumn("j", F.explode(others)).drop("main", "chunks")
    right = at.withColumn("j", mine).withColumn("i", F.explode(others)).drop("chunks")
    x, y = prefixed(left, "x", "key", "i", "j"), prefixed(right, "y", "key", "i", "j")
    once = (F.col("yroot") == F.col("ymain")) | (F.col("xh") < F.col("yh"))
    near = (F.col("xroot") != F.col("yroot")) & once & alike("x", "y", least)
    met = (x["key"] == y["key"]) & (x["i"] == y["i"]) & (x["j"] == y["j"])
    return x.join(y, met & near).select(F.greatest("xh", "yh").alias("a"), F.least("xh", "yh").alias("b"), F.col("xroot").alias("ra"), F.col("yroot").alias("rb")).distinct()


def with_links(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots`` (h, root) after the union of the components of ``found`` (ra, rb: roots, texts without one among them)."""
    more = components(found, "ra", "rb")
    old = roots.unionByName(more.join(roots, more["node"] == roots["h"], "left_anti").select(F.col("node").alias("h"), F.col("node").alias("root")))
    return old.join(more.withColumnRenamed("root", "to"), F.col("root") == F.col("node"), "left").select("h", F.coalesce("to", "root").alias("root"))
