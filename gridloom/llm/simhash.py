"""SimHash near-dedup through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; a segment's bit count is 0, 1 or 2, so a
fingerprint becomes a point with 32 small coordinates.  The Manhattan distance of two points never
exceeds the Hamming distance of their fingerprints.  Coordinates are held in unary (0 -> 00, 1 -> 01,
2 -> 11), which makes the Manhattan distance the bit count of an exclusive or.

Range join: the 32 coordinates are dealt into ``radius + 1`` blocks or, where there are many points,
some more.  Points within ``radius`` agree entirely in all blocks but ``radius``, so each choice of as many
blocks is a grid whose cell is the point's coordinates there, and a range query needs one cell of each
grid.  Inside a cell the Manhattan distance over all
coordinates selects candidates and the Hamming distance decides.  A cell only reports a spanning
forest of its links, never all pairs.  Cells above ``cell_rows`` points are cut into chunks and every
pair of chunks meets in a task of its own, so no task holds more than about two chunks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop_cut

SEED = 42
SHINGLE_WORDS = 4
RADIUS = 4
SEGMENTS = 32
CELL_ROWS = 4096
#: some ten microseconds of comparisons a point and pass
MEETINGS = 4000
_CHUNK = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit number of the bits that are set in over half of ``hashes``."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        some = np.ascontiguousarray(hashes[k : k + _CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def simhash(text: bytes | None) -> int:
    """Signed 64-bit fingerprint of UTF-8 ``text``; 0 if it has no word."""
    words = (text or b"").lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n < SHINGLE_WORDS:
        starts, ends = [0], [len(joined)]
    else:
        stop = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        ends = stop[SHINGLE_WORDS - 1 :].tolist()
        starts = [0, *(stop[: n - SHINGLE_WORDS] + 1).tolist()]
    return majority(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """(id, fingerprint) and the columns ``keep`` for each row of ``docs``; a null text has no words."""
    src = docs.select(F.col(id_col), *keep, F.col(text_col).alias("__gl_text"))
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(names)).cast(pa.binary())
            fp = pa.array((simhash(t.as_py()) for t in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], fp], [*names, "fingerprint"])

    schema = docs.select(id_col, *keep).schema.add("fingerprint", "long")
    return src.mapInArrow(run, schema)


def grids(radius: int, points: int) -> list[int]:
    """Signed bit masks of the coordinates of each grid.

    With the segments dealt into n blocks, points within ``radius`` agree in n - radius of them at least,
    so each choice of that many blocks is a grid.  More blocks make more grids of smaller cells; n is the
    first for which a point meets ``MEETINGS`` others or fewer, were segments of random fingerprints, whose
    counts agree with probability 3/8.
    """
    for n in range(radius + 1, radius + 5):
        agree = n - radius
        met = math.comb(n, agree) * points * 0.375 ** (SEGMENTS * agree / n)
        if met <= MEETINGS:
            break
    per, more = divmod(SEGMENTS, n)
    blocks, at = [], 0
    for k in range(n):
        width = 2 * (per + (k < more))
        blocks.append(((1 << width) - 1) << at)
        at += width
    masks = [sum(chosen) for chosen in itertools.combinations(blocks, agree)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def forest(fp: np.ndarray, unary: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among the points of one cell, as two arrays of fingerprints."""
    n = len(fp)
    label = np.arange(n)
    rows = 256
    for s in range(0, n - 1, rows):
        near = np.bitwise_count(unary[s : s + rows, None] ^ unary[None, s + 1 :]) <= radius
        i, j = np.nonzero(near)
        i, j = i + s, j + s + 1
        ok = j > i
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        cuts = np.flatnonzero(np.diff(i)) + 1
        for k, js in zip(i[np.r_[0, cuts]], np.split(j, cuts)):
            met = np.unique(np.r_[label[k], label[js]])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    child = np.flatnonzero(label != np.arange(n))
    return fp[child], fp[label[child]]


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(m: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero((m[:4, 1:] != m[:4, :-1]).any(axis=0)) + 1
            lo = np.r_[0, edge]
            hi = np.r_[edge, m.shape[1]]
            a, b = [], []
            for s, e in zip(lo, hi):
                if e - s > 1:
                    x, y = forest(m[4, s:e].view(np.uint64), m[5, s:e].view(np.uint64), radius)
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], ["a", "b"])

        held = np.empty((6, 0), np.int64)
        for batch in batches:
            m = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
            if not m.shape[1]:
                continue
            edge = np.flatnonzero((m[:4, 1:] != m[:4, :-1]).any(axis=0)) + 1
            last = int(edge[-1]) if len(edge) else 0
            if last:
                yield from solve(np.ascontiguousarray(m[:, :last]))
            held = np.ascontiguousarray(m[:, last:])
        if held.shape[1]:
            yield from solve(held)

    return run


def links(prints: DataFrame, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints within ``radius``.

    ``prints`` has one row for each distinct fingerprint in column ``fingerprint``.
    """
    x = F.col("fingerprint")
    m = F.lit(0x5555555555555555)
    hi = F.shiftrightunsigned(x, 1)
    unary = x.bitwiseOR(hi).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(hi).bitwiseAND(m), 1))
    cells = prints.select("fingerprint", unary.alias("u")).select(
        F.posexplode(F.array(*[F.col("u").bitwiseAND(F.lit(k)) for k in grids(radius, prints.count())])).alias("blk", "cell"), "fingerprint", "u"
    )
    full = cells.groupBy("blk", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows)
    full = full.select("blk", "cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("chunks"))
    c = F.pmod(F.xxhash64("fingerprint"), F.coalesce("chunks", F.lit(1))).cast("int")
    dealt = (
        cells.join(full, ["blk", "cell"], "left")
        .withColumn("c", c)
        .withColumn("d", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
        .select("blk", "cell", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), "fingerprint", "u")
    )
    keys = ["blk", "cell", "lo", "hi"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_link(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, *keep: str) -> DataFrame:
    """(id, *keep, fingerprint, component_root, component_id) for each row of ``docs``.

    component_id is the smallest id reachable over links of at most ``radius`` differing bits, the
    row's own included; component_root is the smallest fingerprint of the component.  Null and empty
    texts have fingerprint 0 and link like any other.  Rows with a null id take part and never become
    a component's id, which is null if all its ids are.  Repeated rows are kept.  A bit that half of the
    hashes set is 0.  Very long texts are read whole, and other columns are not read.
    """
    marked = cut(fingerprints(docs, id_col, text_col, *keep))
    prints = cut(marked.groupBy("fingerprint").agg(F.min(id_col).alias("__gl_min")))
    roots = components(links(prints, radius))
    rooted = prints.join(roots, prints["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "__gl_min", F.coalesce("root", "fingerprint").alias("component_root")
    )
    rooted = cut(rooted)
    drop_cut(prints)
    ids = rooted.groupBy("component_root").agg(F.min("__gl_min").alias("component_id"))
    known = rooted.join(ids, "component_root").select("fingerprint", "component_root", "component_id")
    return marked.join(known, "fingerprint").select(id_col, *keep, "fingerprint", "component_root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, columns unchanged, with one row of each near-duplicate component: that of the smallest id.

    Rows that repeat that id and text, or a component whose ids are all null, keep one row as well.
    """
    keyed = docs.select(F.col(id_col).alias("__gl_id"), F.col(text_col).alias("__gl_t"), F.xxhash64(text_col).alias("h"))
    return keep_first(docs, near_duplicates(keyed, "__gl_id", "__gl_t", radius, "h"), id_col, F.xxhash64(text_col))


def keep_first(docs: DataFrame, found: DataFrame, id_col: str, text_hash: Column) -> DataFrame:
    """The rows of ``docs`` that stand for the components of ``found`` (__gl_id, h, component_root, component_id), h being their ``text_hash``; names in ``docs`` may be any."""
    first = (
        found.where(F.col("__gl_id").eqNullSafe(F.col("component_id")))
        .groupBy("component_root")
        .agg(F.min(F.struct(F.col("__gl_id").alias("i"), "h")).alias("k"))
        .select(F.col("k.i").alias("__gl_i"), F.col("k.h").alias("__gl_kh"))
    )
    rows = docs.withColumn("__gl_h", text_hash)
    out = rows.join(first, rows[id_col].eqNullSafe(first["__gl_i"]) & (rows["__gl_h"] == first["__gl_kh"]))
    return out.dropDuplicates([id_col, "__gl_h"]).select(*docs.columns)


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
