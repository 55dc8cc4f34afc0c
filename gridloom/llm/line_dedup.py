"""Fuzzy line dedup by MinHash, in DataFrame functions only.

Lines are trimmed of blanks.  A line's shingles are its windows of ``WIDTH`` characters, hashed.
Signature: one-permutation MinHash over all of them, whatever the line.  Seven bounds are spread over the hashes' range, and the
four hashes that follow a bound make a band's key.  Lines of Jaccard similarity 0.8 agree in a band
with probability 0.8^4, so they meet in some band with 1 - (1 - 0.8^4)^7 = 0.975; at 0.85 with 0.994.

Links are those of all similar pairs that share a key, as far as components tell; ``classes`` says how they
are found without pairing a key's lines with each other.  Every comparison is the exact Jaccard
similarity of the sets of all shingles.  Components of all links are
found by distributed union-find, and the first line of each, by document and line number, stays.  Lines
of ``WIDTH`` characters or fewer have one shingle, so only equal ones are alike.  Blank lines are left alone.
"""

from __future__ import annotations

from functools import reduce
from itertools import pairwise
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classes import similar_classes
from .common import cut, drop_cut, table

WIDTH = 8
BANDS, ROWS = 7, 4
SIMILAR = 0.8


def normal(line: Column) -> Column:
    return F.trim(line)


def hashes(line: Column, width: int = WIDTH) -> Column:
    """The hashes of the character windows of ``line``, repeats included; a line of ``width`` characters or fewer is one window.

    UTF-32 makes a window a slice of bytes; the outer ``transform`` binds the encoded line, which would
    otherwise be encoded again for every window.
    """

    def hashed(wide: Column) -> Column:
        last = F.greatest(F.octet_length(wide) - 4 * width, F.lit(0)) + 1
        return F.transform(F.sequence(F.lit(1), last, F.lit(4)), lambda at: F.xxhash64(F.substr(wide, at, F.lit(4 * width))))

    return F.transform(F.array(F.encode(line, "UTF-32")), hashed)[0]


def shingles(line: Column, width: int = WIDTH) -> Column:
    return F.array_distinct(hashes(line, width))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, line_no, line, blank) of all lines, with the number of the text's lines; a null text is one row without a line."""
    split = docs.select(F.col(id_col).alias("id"), F.split(F.col(text_col), "\n").alias("lines"))
    # the outer form, as the plain one would add a filter that splits all texts once more
    each = split.select("id", F.greatest(F.size("lines"), F.lit(0)).alias("n"), F.posexplode_outer("lines").alias("line_no", "line"))
    each = each.select("id", "n", "line_no", normal(F.col("line")).alias("line"))
    return each.withColumn("blank", ~F.coalesce(F.col("line").rlike(r"\S"), F.lit(False)))


def exploded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line) of the lines that take part."""
    return numbered(docs, id_col, text_col).where("not blank").select("id", "line_no", "line")


def banded(lines: DataFrame) -> DataFrame:
    """``lines`` (line and more) with the line's hash ``h`` and its band keys ``keys`` in place of the line.

    The bounds of the bands are sorted in among the hashes, so a band's key is the hash of the ``ROWS`` different ones
    after its bound; the first elements follow the last ones again.  Bounds alone have no key.
    Repeats of a hash are looked for behind the bounds alone; only a line that has some there, one in twenty or so, is freed of all its repeats.
    """
    at = [b * ((1 << 64) // BANDS) - (1 << 63) for b in range(BANDS)]
    others = [c for c in lines.columns if c != "line"]
    hashed = lines.select(*others, F.xxhash64("line").alias("h"), F.sort_array(F.concat(F.array(*map(F.lit, at)), hashes(F.col("line")))).alias("s"))
    ring = hashed.select(*others, "h", F.concat("s", F.slice("s", 1, ROWS)).alias("s"))
    placed = ring.select(*others, "h", "s", *[F.array_position("s", F.lit(b)).cast("int").alias(f"p{k}") for k, b in enumerate(at)])
    near = [[f"e{b}_{k}" for k in range(ROWS + 1)] for b in range(BANDS)]
    read = placed.select(*others, "h", "s", *[F.get("s", F.col(f"p{b}") + (k - 1)).alias(n) for b, names in enumerate(near) for k, n in enumerate(names)])
    repeats = reduce(or_, [F.col(x) == F.col(y) for names in near for x, y in pairwise(names)])

    def keyed(b: int, after: list[Column]) -> Column:
        # between a bound and the one ROWS further on lie the bounds between them, so what ends there has no hash
        return F.when(after[-1] != at[(b + ROWS) % BANDS], F.xxhash64(*after))

    def freed(s: Column) -> Column:
        own = F.concat(s, F.slice(s, 1, ROWS))
        return F.transform(F.array(own), lambda r: F.array(*[keyed(b, [F.get(r, F.array_position(r, F.lit(at[b])).cast("int") + k) for k in range(ROWS)]) for b in range(BANDS)]))[0]

    quick = F.array(*[keyed(b, [F.col(n) for n in names[1:]]) for b, names in enumerate(near)])
    full = F.transform(F.array(F.array_distinct("s")), freed)[0]
    made = read.select(*others, "h", F.when(repeats, full).otherwise(quick).alias("keys"))
    return made.select(*others, "h", F.array_except("keys", F.array(F.lit(None).cast("long"))).alias("keys"))


def classed(docs: DataFrame, id_col: str, text_col: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(id, line_no, class_id) of each line that is not blank, and (id, n), the number of lines, of each row."""
    first = F.coalesce("line_no", F.lit(0)) == 0
    base = cut(banded(numbered(docs, id_col, text_col).where(~F.col("blank") | first)), dictionary=False)
    counts = cut(base.where(first).select("id", "n"))
    rows = base.where("not blank")
    lines = exploded(docs, id_col, text_col).select(F.xxhash64("line").alias("h"), F.col("line").alias("text"))
    roots = similar_classes(lines, rows.select("h", "keys"), shingles, least)
    at = cut(rows.select("id", "line_no", "h").join(roots, "h", "left").select("id", "line_no", F.coalesce("root", "h").alias("class_id")))
    drop_cut(base)
    return at, counts


def heads(at: DataFrame) -> DataFrame:
    """(class_id, head): the first line of each class."""
    return at.groupBy("class_id").agg(F.min(F.struct("id", "line_no")).alias("head"))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """(id, line_no, class_id, kept) for each line that is not blank.

    class_id is a hash that the lines of one component share; kept is true for the component's first
    line by id and line number.
    """
    at, counts = classed(docs, id_col, text_col, least)
    drop_cut(counts)
    kept = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("line_no") == F.col("head.line_no"))
    return at.join(heads(at), "class_id").select(F.col("id").alias(id_col), "line_no", "class_id", kept.alias("kept"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """(id, n_lines, n_kept, dropped) for each id in ``docs``: line counts, and the numbers, from 0, of the lines to drop.

    A null text has no lines, an empty one has one line.  Rows that repeat an id are one document:
    their counts add up.  A null id is an id.  Very long lines and texts are compared whole.  Of equal
    lines the first by id and line number stays.  Columns other than the two named are not read.
    """
    at, counts = classed(docs, id_col, text_col, least)
    # of lines that are alone in their class nothing more is needed than a count
    several = at.groupBy("class_id").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("class_id")
    some = cut(at.join(several.hint("shuffle_hash"), "class_id"))
    later = ~(F.col("id").eqNullSafe(F.col("head.id")) & (F.col("line_no") == F.col("head.line_no")))
    gone = some.join(heads(some), "class_id").where(later)
    found = gone.groupBy(F.col("id").alias("i")).agg(F.array_sort(F.collect_list("line_no")).alias("dropped"))
    all_ = counts.groupBy(F.col("id").alias(id_col)).agg(F.sum("n").cast("long").alias("n_lines"))
    out = all_.join(found, all_[id_col].eqNullSafe(found["i"]), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return out.select(id_col, "n_lines", (F.col("n_lines") - F.size(dropped)).cast("long").alias("n_kept"), dropped.alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """``docs``, columns unchanged, without the lines that another line of their component stands for."""
    report = line_report(docs, id_col, text_col, least).where(F.size("dropped") > 0).select(F.col(id_col).alias("__gl_i"), F.array_distinct("dropped").alias("__gl_d"))
    out = docs.join(report, docs[id_col].eqNullSafe(report["__gl_i"]), "left")
    lines = F.split(F.col(text_col), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gl_d"))
    text = F.when(F.col("__gl_d").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return out.withColumn(text_col, text).select(*docs.columns)


def op9_fuzzy_lines(spark, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))
