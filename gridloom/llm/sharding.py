"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group that no shard boundary divides.  Packing runs on two levels.
Groups are dealt by hash into ``parts``; each part sorts its groups by size and packs them into
bundles of a fixed capacity, at most ``bundles`` of that capacity in all: a group goes to the bundle
whose remaining capacity is the tightest that holds it, found in a balanced tree.  Best fit leaves at
most one bundle of a part less than half full, so there are fewer than ``2 * bundles + parts``
bundles whatever the input.  A bundle larger than an equal share of what is left has a shard of its own.
The rest of that bounded list is packed the same way into the other shards, of one capacity, and the
capacity is the smallest, by bisection, for which the shards suffice.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked, table

SHARDS = 8
PARTS = 256
BUNDLES = 2048


class CapacityTree:
    """A balanced tree (B+, two levels) of (remaining capacity, bin)."""

    LEAF = 256

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.least: list[tuple[int, int]] = [(-1, -1)]

    def add(self, left: int, which: int) -> None:
        k = max(0, bisect_left(self.least, (left, which)) - 1)
        leaf = self.leaves[k]
        insort(leaf, (left, which))
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves.insert(k + 1, leaf[half:])
            self.least.insert(k + 1, leaf[half])
            del leaf[half:]

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the entry of least remaining capacity >= ``size``."""
        k = max(0, bisect_left(self.least, (size, -1)) - 1)
        while k < len(self.leaves):
            leaf = self.leaves[k]
            at = bisect_left(leaf, (size, -1))
            if at < len(leaf):
                found = leaf.pop(at)
                if not leaf and len(self.leaves) > 1 and k:
                    del self.leaves[k], self.least[k]
                return found
            k += 1
        return None


def best_fit_decreasing(sizes: Iterable[int], capacity: int) -> Iterator[int]:
    """The bin of each size; sizes come in decreasing order.  A size above the capacity has a bin of its own."""
    tree, bins = CapacityTree(), 0
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            found = (max(capacity, size), bins)
            bins += 1
        left = found[0] - size
        if left > 0:
            tree.add(left, found[1])
        yield found[1]


def fewest_capacity(sizes: list[int], bins: int) -> tuple[int, list[int]]:
    """The smallest capacity found by bisection for which best fit needs at most ``bins`` bins, and the bins."""
    sizes = list(sizes)
    if not sizes:
        return 0, []
    lo, hi = max(sizes[0], -(-sum(sizes) // bins)), max(sizes[0], 2 * -(-sum(sizes) // bins))
    best = list(best_fit_decreasing(sizes, hi))
    while max(best) >= bins:
        hi *= 2
        best = list(best_fit_decreasing(sizes, hi))
    while lo < hi:
        mid = (lo + hi) // 2
        got = list(best_fit_decreasing(sizes, mid))
        if max(got) < bins:
            hi, best = mid, got
        else:
            lo = mid + 1
    return hi, best


def near_equal(sizes: list[int], bins: int) -> list[int]:
    """The bin of each of ``sizes``, which come in decreasing order: one of its own for each above an equal share of it and what follows, best fit for the rest."""
    sizes, alone, rest = list(sizes), 0, sum(sizes)
    while alone < min(bins - 1, len(sizes)) and sizes[alone] * (bins - alone) > rest:
        rest -= sizes[alone]
        alone += 1
    return [*range(alone), *(alone + k for k in fewest_capacity(sizes[alone:], bins - alone)[1])]


def bundled(groups: DataFrame, capacity: int, parts: int = PARTS) -> DataFrame:
    """(gkey, part, bundle, bytes) from (gkey, bytes): each part packed by itself, in one pass over its sorted groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, bins = None, CapacityTree(), 0
        for b in batches:
            out = []
            for p, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p != part:
                    part, tree, bins = p, CapacityTree(), 0
                found = tree.take_tightest(size)
                if found is None:
                    found = (max(capacity, size), bins)
                    bins += 1
                if found[0] > size:
                    tree.add(found[0] - size, found[1])
                out.append(found[1])
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(out, pa.int64()), b.column(1)], ["gkey", "part", "bundle", "bytes"])

    dealt = groups.select(F.pmod("gkey", F.lit(parts)).cast("int").alias("part"), "bytes", "gkey")
    dealt = dealt.repartition("part").sortWithinPartitions("part", F.desc("bytes"), "gkey")
    return dealt.mapInArrow(run, "gkey long, part int, bundle long, bytes long")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", *keep: str, parts: int = PARTS, bundles: int = BUNDLES) -> DataFrame:
    """(id, *keep, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``.

    size is the UTF-8 bytes of the text plus 1.  Law ``bytes``: the shards' sizes are near equal; a
    group of equal texts above an equal share has a shard of its own and the others share the rest.  Null texts form one group of size 1 each and have the
    checksum of an empty text.  Null ids and repeated rows are placed like others; slots are gapless
    from 0 in each shard, in order of id, then size, then checksum.  Groups of equal size are packed in
    order of their hash.  Very long texts are groups like others, and other columns are not read.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    names = [id_col, *keep]
    rows = cut(
        docs.select(
            *names,
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("gkey"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("gkey").agg(F.sum("size").alias("bytes"))
    packed = cut(bundled(groups, max(1, -(-total // bundles)), parts))
    # bounded: fewer than 2 * bundles + parts rows, see the module's docstring
    small = packed.groupBy("part", "bundle").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "part", "bundle").collect()
    bins = near_equal([r["bytes"] for r in small], shards)
    at = spark.createDataFrame([(r["part"], r["bundle"], s) for r, s in zip(small, bins)], "part int, bundle long, shard int")
    home = packed.join(F.broadcast(at), ["part", "bundle"]).select("gkey", "shard")
    placed = rows.join(home, "gkey").select(*names, "size", "text_crc32", "shard")
    placed = ranked(placed, ["shard"], [id_col, "size", "text_crc32"], "slot")
    return placed.select(*names, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_best_fit_shards(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
