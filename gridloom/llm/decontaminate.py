"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the word windows of the benchmark items.  For patterns of one length m, a shift table
over blocks of ``B`` words tells how far the search may move when a block ends at the current word; a
block that ends some pattern has shift zero and selects a bucket by its suffix, where patterns are
compared directly.  Items shorter than a window are patterns of their own length, and each length has
its own tables, so a short item never shortens the shifts of the others.

The tables travel to the executors in parts of at most ``PART_WINDOWS`` windows.  A benchmark beyond
one part is searched in as many passes, with the rows written in between; what each pass found stays
with the row, so nothing is joined.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import cut, table

WINDOW = 10
PART_WINDOWS = 500_000
_SPAN = StructType([StructField("s", LongType()), StructField("e", LongType())])
_FOUND = [StructField("__gl_n_words", LongType()), StructField("__gl_spans", ArrayType(_SPAN))]
#: letters A-Z to lower case; ASCII other than letters and digits to blanks
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Searcher:
    """Wu-Manber tables for patterns of one length, given as (words, item)."""

    def __init__(self, length: int, patterns: list[tuple[tuple[bytes, ...], int]]) -> None:
        self.length = m = length
        self.block = b = min(2, m)
        self.default = m - b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        for p, item in patterns:
            for end in range(b, m + 1):
                key = p[end - b : end]
                self.shift[key] = min(self.shift.get(key, self.default), m - end)
            self.bucket[p[m - b :]][p].append(item)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of every occurrence in ``words``."""
        m, b, shift, default, n = self.length, self.block, self.shift, self.default, len(words)
        at = m
        while at <= n:
            key = tuple(words[at - b : at])
            move = shift.get(key, default)
            if move:
                at += move
                continue
            items = self.bucket[key].get(tuple(words[at - m : at]))
            if items:
                yield at - m, items
            at += 1


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words) for every window of every item, distinct; an item without words has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, wins = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                w = words_of(t)
                for k in range(max(1, len(w) - WINDOW + 1)) if w else ():
                    ids.append(i)
                    wins.append(b" ".join(w[k : k + WINDOW]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(wins, pa.binary())], ["item", "words"])

    src = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("words"))
    schema = items.select(F.col(id_col).alias("item")).schema.add("words", "binary")
    return src.mapInArrow(run, schema).distinct()


def _searchers(rows) -> list[Searcher]:
    by: dict[int, list] = defaultdict(list)
    known: dict[bytes, bytes] = {}  # a word is held once, however many windows have it
    for words, item in rows:
        p = tuple(known.setdefault(w, w) for w in words.split())
        by[len(p)].append((p, item))
    return [Searcher(m, ps) for m, ps in sorted(by.items())]


#: the tables of the part that this process searched last; a worker process serves many tasks
_BUILT: dict[str, list[Searcher]] = {}


def _tables(name: str, packed) -> list[Searcher]:
    if name not in _BUILT:
        import pickle

        _BUILT.clear()
        _BUILT[name] = _searchers(pickle.loads(packed.value))
    return _BUILT[name]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _parts(found: DataFrame, part: int) -> list[DataFrame]:
    """``found`` in parts of about ``part`` rows, by hash; one part if it is no larger."""
    n = found.count()
    k = max(1, -(-n // part))
    return [found] if k == 1 else [found.where(F.pmod(F.xxhash64("words"), F.lit(2 * k)) == i) for i in range(2 * k)]


def search(docs: DataFrame, items: DataFrame, text_col: str = "text", part: int = PART_WINDOWS, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs``, all columns, plus __gl_n_words, __gl_spans (merged word ranges that are hit) and __gl_items (items found)."""
    import pickle

    spark = docs.sparkSession
    found = cut(windows(items, item_col, item_text))
    kind = found.schema["item"].dataType
    rows = docs
    parts = _parts(found, part)
    for number, some in enumerate(parts):
        # bounded: about ``part`` windows of ten words
        tables = spark.sparkContext.broadcast(pickle.dumps([(bytes(r["words"]), r["item"]) for r in some.collect()]))
        name = uuid.uuid4().hex
        width, first = len(docs.columns), number == 0

        def run(batches: Iterator[pa.RecordBatch], tables=tables, name=name, first=first) -> Iterator[pa.RecordBatch]:
            search_ = _tables(name, tables)
            for b in batches:
                n, spans, got = [], [], []
                olds = None if first else (b.column(width + 1).to_pylist(), b.column(width + 2).to_pylist())
                for k, t in enumerate(b.column(b.schema.names.index(text_col)).cast(pa.binary())):
                    words = words_of(t.as_py())
                    hit = [] if first else [(x["s"], x["e"]) for x in olds[0][k]]
                    who = set() if first else set(olds[1][k])
                    for s in search_:
                        for start, items_ in s.find(words):
                            hit.append((start, start + s.length))
                            who.update(items_)
                    n.append(len(words))
                    spans.append([{"s": s, "e": e} for s, e in _merged(hit)])
                    got.append(sorted(who, key=lambda x: (x is None, x)))
                item_type = b.schema.field(width + 2).type if not first else None
                arrays = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(got, item_type or pa.list_(arrow_item))]
                yield pa.RecordBatch.from_arrays([*b.columns[:width], *arrays], [*b.schema.names[:width], "__gl_n_words", "__gl_spans", "__gl_items"])

        arrow_item = to_arrow_type(kind)
        schema = StructType([*docs.schema, *_FOUND, StructField("__gl_items", ArrayType(kind))])
        rows = rows.mapInArrow(run, schema)
        if number + 1 < len(parts):
            rows = cut(rows)
    return rows


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``.

    Null and empty texts have no words and no hits; items that are null or have no words match
    nothing, as does an empty table of items; repeated items count once for each id.  Items with a null
    id hit like others, count as one item and have no part in the hash.  Repeated rows are judged alike,
    very long texts are searched whole, and other columns are not read.
    """
    s = search(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), items, **how)
    hit = F.aggregate("__gl_spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    names = F.array_sort(F.transform("__gl_items", lambda x: x.cast("string")))
    return s.select(
        F.col("id").alias(id_col),
        F.col("__gl_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__gl_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("__gl_spans") > 0).alias("contaminated"),
    )


def clean_rows(docs: DataFrame, items: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, columns unchanged, in which no benchmark window occurs."""
    return search(docs, items, text_col, **how).where(F.size("__gl_spans") == 0).select(*docs.columns)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = {
    "op7_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM p),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, m WHERE len(w) >= m)),
h AS (SELECT dw.doc_id, dw.i, dw.m, p.item_id FROM dw JOIN p ON dw.s = p.s AND dw.m = p.m),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
}
