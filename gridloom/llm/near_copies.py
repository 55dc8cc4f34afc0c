"""Near copies: SimHash fingerprints and the segment-popcount range join, then the exact similarity.

Documents are compared by the Jaccard similarity of their sets of ``SHINGLE_WORDS``-word shingles, in lower
case; a text with fewer words is one shingle, and texts without words are alike.  Two texts are near
copies at ``SIMILAR`` or more.

First pass: ``simhash.links`` finds fingerprints of the same shingles within ``simhash.RADIUS`` bits; of the
texts of one fingerprint each is paired with the first, and pairs are verified exactly.  At similarity
0.8 fingerprints differ in some ten bits of 64, and a range join that wide compares nearly everything
with everything.  So the rest comes from a second pass: MinHash keys of the same shingles, ``BANDS`` of
``ROWS`` each, which two texts of similarity 0.8 share with probability 1 - (1 - 0.8^5)^14 = 0.997.  It
starts from the first pass's components and compares texts of different ones only (``classes``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .classes import similar_classes, similar_pairs
from .common import components, cut, drop_cut
from .simhash import RADIUS, keep_first, links, majority

SHINGLE_WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 14, 5


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """The hashes of the word windows of UTF-8 ``text``, repeats included."""
    words = (text or b"").lower().split()
    digest, k = xxhash.xxh64_intdigest, SHINGLE_WORDS
    n = max(1, len(words) - k + 1)
    return np.fromiter((digest(b" ".join(words[i : i + k])) for i in range(n)), np.uint64, n)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a one-permutation MinHash of the distinct ``hashes``, sorted: ``ROWS`` hashes from the band's bound on, around the end."""
    bounds = np.arange(BANDS, dtype=np.uint64) * np.uint64((1 << 64) // BANDS)
    at = np.searchsorted(hashes, bounds)[:, None] + np.arange(ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes()) for row in hashes[at % len(hashes)]], np.uint64).view(np.int64)


@F.pandas_udf(ArrayType(LongType()))
def shingle_set(texts: pd.Series) -> pd.Series:
    return pd.Series([np.unique(shingle_hashes(t.encode())).view(np.int64) for t in texts])


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, fingerprint, keys) for each row of ``docs``: the hash of its text, the fingerprint and the band keys of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(t.as_py()) for t in b.column(2).cast(pa.binary())]
            prints = pa.array([majority(h) for h in hashes], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), prints, pa.array([np.unique(band_keys(np.unique(h))) for h in hashes], pa.list_(pa.int64()))], [id_col, "h", "fingerprint", "keys"])

    src = docs.select(id_col, text_hash(text_col).alias("h"), F.col(text_col).alias("__gl_text"))
    return src.mapInArrow(run, docs.select(id_col).schema.add("h", "long").add("fingerprint", "long").add("keys", ArrayType(LongType())))


def text_hash(text_col: str):
    """A null text is an empty one."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """(id, h, component_root, component_id) for each row of ``docs``: the text's hash, the class and the smallest id in it.

    The id may not be named like a column of the result.
    """
    rows = cut(marked(docs, id_col, text_col))
    source = docs.select(text_hash(text_col).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first = cut(rows.groupBy("fingerprint").agg(F.min("h").alias("a")))
    apart = components(links(first.select("fingerprint"), radius))
    # a fingerprint's texts against its first text, and that against the first text of its component's root
    own = rows.join(first, "fingerprint").where("h <> a").select("a", F.col("h").alias("b"))
    to = first.withColumnRenamed("fingerprint", "root").withColumnRenamed("a", "b")
    across = first.join(apart, F.col("fingerprint") == F.col("node")).select("a", "root").join(to, "root").where("a <> b").select("a", "b")
    pairs = cut(own.unionByName(across).distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    texts = cut(source.join(wanted, "h", "left_semi").groupBy("h").agg(F.min("text").alias("text")))
    roots = cut(components(cut(similar_pairs(pairs, texts, shingle_set, least))).select(F.col("node").alias("h"), "root"))
    for done in (first, pairs, texts):
        drop_cut(done)
    roots = similar_classes(source, rows.select("h", "keys"), shingle_set, least, roots)
    found = cut(rows.select(id_col, "h").join(roots, "h", "left").select(id_col, "h", F.coalesce("root", "h").alias("component_root")))
    drop_cut(rows)
    ids = found.groupBy("component_root").agg(F.min(id_col).alias("component_id"))
    return found.join(ids, "component_root").select(id_col, "h", "component_root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, columns unchanged, with one row of each class of near copies: that of the smallest id.

    Null texts are empty ones and all alike.  Of rows that repeat an id and a text one stays; so does one
    row of a class whose ids are all null.  Very long texts are compared whole.
    """
    named = docs.select(F.col(id_col).alias("__gl_id"), F.col(text_col).alias("__gl_t"))
    found = near_classes(named, "__gl_id", "__gl_t", least, radius)
    return keep_first(docs, found, id_col, text_hash(text_col))
