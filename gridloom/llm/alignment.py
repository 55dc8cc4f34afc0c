"""Alignment of two tokenizers over the same text, by elementary intervals.

Both tokenizers cut the bytes of a blank and the text.  The union of their end offsets cuts those bytes
into elementary intervals; a binary search in each array of ends finds the token that owns an interval.
Each interval is one overlap of an A token with a B token.  An end that both share closes a group, within
which either side covers the same bytes.  Three relations come out of that: ``overlap`` (an interval each),
``end`` (the owners of a closing interval, whose ranges end together) and ``group`` (all products of a
group's tokens).

Both tokenizers cut before a single blank between two characters that are no white space, so texts are
split there, and a part is encoded and aligned once for as often as a task meets it.

One pass over the texts writes each one's measures and its distinct pairs of ids with their multiples.
From that table pairs are added up over the corpus, within tasks and then by a shuffle on the pair, and
each text gets its sums.  The table of pairs is broadcast where its counted size allows (``LARGEST``);
beyond that, each text's pairs are joined to it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import cut, drop_cut, table

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: parts that a task remembers, and links of such parts
MEMO, MEMO_LINKS = 150_000, 2_000_000
SLICE_BYTES = 4 << 20
#: pairs of ids that a broadcast may hold, at 17 bytes each
LARGEST = 2_000_000
#: a pair is one number: A's id times this plus B's id
WIDE = 1 << 24
SALTS = 32
RELATIONS = ("overlap", "end", "group")
#: how byte-level vocabularies of this kind split texts before merging
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# the blank comes first, so that the search for it is a plain one
_BREAK = re.compile(r" (?=\S)(?<=\S )")


class Alignment:
    """The elementary intervals of two arrays of token ends: their ends, their owners, and whether an interval closes a group."""

    def __init__(self, a_ends: np.ndarray, b_ends: np.ndarray) -> None:
        self.ends = np.union1d(a_ends, b_ends)
        self.a = np.searchsorted(a_ends, self.ends)
        self.b = np.searchsorted(b_ends, self.ends)
        self.closes = (a_ends[self.a] == self.ends) & (b_ends[self.b] == self.ends)

    def pairs(self, relation: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, interval): the linked token positions, and the interval at which each link or its group ends."""
        if relation == "overlap":
            return self.a, self.b, np.arange(len(self.ends))
        last = np.flatnonzero(self.closes)
        if relation == "end":
            return self.a[last], self.b[last], last
        if relation != "group":
            raise ValueError(f"relation must be one of {RELATIONS}")
        n_a, n_b = (np.diff(x[last], prepend=-1) for x in (self.a, self.b))
        n = n_a * n_b
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(n_b, n)
        return np.repeat(self.a[last] + 1 - n_a, n) + at // wide, np.repeat(self.b[last] + 1 - n_b, n) + at % wide, np.repeat(last, n)


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of byte-level vocabularies: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """The two tokenizers, and for any list of parts their ids and alignment.

    A's file holds a byte-level vocabulary and its merges in the order of their ids; with that order the ids
    are the merges' ranks.
    """

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes) -> None:
        import sentencepiece
        import tiktoken

        model, of = json.loads(byte_bpe)["model"], byte_alphabet()
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("the merges of the byte-level vocabulary must be in the order of their ids")
        known = {i: bytes(of[c] for c in t) for t, i in model["vocab"].items() if all(c in of for c in t)}
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={t: i for i, t in known.items()}, special_tokens={})
        self.a_bytes = [known.get(i, b"") for i in range(max(known) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # a blank begins every piece that has one, or parts could not be encoded alone
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # what a token adds to the list of groups, by twice its id and whether it is the last of its side in its group
        self.words = [f"{i}{c}" for i in range(len(self.a_bytes)) for c in ",|"] + [f"{i}{c}" for i in range(len(self.b_bytes)) for c in ",;"]

    def parts(self, text: str) -> list[str]:
        return _BREAK.split(text) if self.splits else [text]

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """A's ids and B's ids of a blank and each part, and whether both give its bytes back."""
        a, b = [self.a.encode_ordinary(" " + p) for p in parts], self.b.encode(parts, num_threads=1)
        whole, good = [b" " + p.encode() for p in parts], np.ones(len(parts), bool)
        for ids, of in ((a, self.a_bytes), (b, self.b_bytes)):
            back = [b"".join([of[i] for i in x]) for x in ids]
            if back != whole:
                good &= np.array([x == y for x, y in zip(back, whole)])
        return a, b, good

    def align(self, a_of: list[list[int]], b_of: list[list[int]], relation: str, with_text: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Ids of the links' A and B tokens, (n_a, n_b, n_groups, n_links, n_overlaps) of each entry, and its groups ``a1,a2|b1;a3|b2;``.

        Entries lie end to end in one alignment; their borders are shared ends, so no group crosses one.
        """
        size = len(a_of)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, size) for x in (a_of, b_of))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a_of, b_of))
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        found = Alignment(a_ends, b_ends)
        border = np.searchsorted(found.ends, a_ends[np.cumsum(n_a) - 1]) + 1
        x, y, at = found.pairs(relation)
        closed = np.flatnonzero(found.closes)
        links, groups = (np.diff(np.searchsorted(k, border), prepend=0) for k in (at, closed))
        counts = np.stack([n_a, n_b, groups, links, np.diff(border, prepend=0)], axis=1)
        if not with_text:
            return a[x], b[y], counts, []
        # a token stands behind those of its side before it and those of the other side in groups before its own; B also behind A's of its own
        a_last, b_last = found.a[closed], found.b[closed]
        a_upto, b_upto = a_last + 1, b_last + 1
        ga, gb = np.searchsorted(a_last, np.arange(len(a))), np.searchsorted(b_last, np.arange(len(b)))
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.r_[0, b_upto][ga]] = 2 * a + (a_last[ga] == np.arange(len(a)))
        code[np.arange(len(b)) + a_upto[gb]] = 2 * (len(self.a_bytes) + b) + (b_last[gb] == np.arange(len(b)))
        said = list(map(self.words.__getitem__, code.tolist()))
        edge = np.cumsum(n_a + n_b).tolist()
        return a[x], b[y], counts, ["".join(said[s:e]) for s, e in zip([0, *edge], edge)]


class Memo:
    """What is known of parts, by their number in the order of meeting: ``good``, ``counts``, ``text`` and the keys of their links."""

    def __init__(self, pair: Pair, relation: str) -> None:
        self.pair, self.relation = pair, relation
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.good = np.zeros(0, bool)
        self.counts = np.zeros((0, 5), np.int64)
        self.text: list[str] = []
        self.keys, self.start = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def rows(self, texts: list[list[str] | None]) -> list[np.ndarray | None]:
        """The numbers of each text's parts; None for a text without tokens."""
        if len(self.number) > MEMO or len(self.keys) > MEMO_LINKS:
            self.clear()
        out = [np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts)) if parts else None for parts in texts]
        new = list(islice(self.number, len(self.good), None))
        if new:
            a_of, b_of, good = self.pair.encode(new)
            counts, text = np.zeros((len(new), 5), np.int64), [""] * len(new)
            if good.any():
                held = np.flatnonzero(good).tolist()
                a, b, counts[good], said = self.pair.align([a_of[k] for k in held], [b_of[k] for k in held], self.relation)
                self.keys = np.concatenate([self.keys, a * WIDE + b])
                for k, t in zip(held, said):
                    text[k] = t
            self.good, self.counts = np.concatenate([self.good, good]), np.concatenate([self.counts, counts])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts[:, 3])])
            self.text += text
        return [r if r is not None and self.good[r].all() else None for r in out]

    def links(self, rows: np.ndarray) -> np.ndarray:
        """The keys of all links of the parts ``rows``."""
        first, n = self.start[rows], self.start[rows + 1] - self.start[rows]
        return self.keys[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def texts_in_slices(column: pa.Array, pair: Pair) -> Iterator[list[list[str] | None]]:
    """The parts of a batch's texts, some ``SLICE_BYTES`` of text at a time; None for null, empty and broken ones."""
    held, size = [], 0
    for t in column.cast(pa.binary()):
        data = t.as_py()
        try:
            held.append(pair.parts(data.decode()) if data else None)
        except UnicodeDecodeError:
            held.append(None)
        size += len(data or b"")
        if size > SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _files(spark, byte_bpe: str, piece_bpe: str):
    data = []
    for path in (byte_bpe, piece_bpe):
        with open(path, "rb") as f:
            data.append(f.read())
    return spark.sparkContext.broadcast(tuple(data))


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")


def encoded(docs: DataFrame, id_col: str, text_col: str, relation: str, digest: bool, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """(id, measures, groups, row, keys, times) for each row of ``docs``: a number of its own, its distinct pairs of ids, and how often each is linked in it.

    A key is A's id times ``WIDE`` plus B's id.
    """
    if relation not in RELATIONS:
        raise ValueError(f"relation must be one of {RELATIONS}")
    files = _files(docs.sparkSession, byte_bpe, piece_bpe)
    names = [id_col, *MEASURES, "groups", "__gl_row", "__gl_keys", "__gl_times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo = Memo(Pair(*files.value), relation)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            at = 0
            for texts in texts_in_slices(batch.column(1), memo.pair):
                out, said, keys, times = np.zeros((len(texts), 5), np.int64), [], [], []
                for k, r in enumerate(memo.rows(texts)):
                    if r is None:
                        r = np.zeros(0, np.int64)
                    out[k] = memo.counts[r].sum(axis=0)
                    groups = "".join([memo.text[i] for i in r.tolist()])[:-1]
                    said.append(hashlib.sha256(groups.encode()).hexdigest() if digest and groups else groups)
                    x, n = np.unique(memo.links(r), return_counts=True)
                    keys.append(x)
                    times.append(n)
                own = pa.array(np.arange(number, number + len(texts)))
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *(pa.array(c) for c in out.T), pa.array(said, pa.string()), own, *lists], names)
                at += len(texts)
                number += len(texts)

    src = docs.select(F.col(id_col), F.col(text_col).alias("__gl_text"))
    schema = src.select(id_col).schema
    for c in MEASURES:
        schema = schema.add(c, "long")
    schema = schema.add("groups", "string").add("__gl_row", "long")
    return src.mapInArrow(run, schema.add("__gl_keys", ArrayType(LongType())).add("__gl_times", ArrayType(LongType())))


def pairs_of(held: DataFrame) -> DataFrame:
    """(__gl_row, key, m): the pairs of ids of each row of ``encoded``, and how often each is linked in it."""
    each = held.select("__gl_row", F.explode(F.arrays_zip("__gl_keys", "__gl_times")).alias("p"))
    return each.select("__gl_row", F.col("p.__gl_keys").alias("key"), F.col("p.__gl_times").alias("m"))


def link_counts(held: DataFrame) -> DataFrame:
    """(key, n, best): how many links of the corpus join each pair of ids, and whether none of its B id's pairs has more."""
    sums = cut(pairs_of(held).groupBy("key").agg(F.sum("m").alias("n")))
    b = F.pmod("key", F.lit(WIDE))
    top = sums.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return sums.join(top, b == F.col("b")).select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    relation: str = "end",
    digest: bool = False,
    byte_bpe: str = BYTE_BPE,
    piece_bpe: str = PIECE_BPE,
    largest: int = LARGEST,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_overlaps, groups, n_best, count_sum) for each row of ``docs``.

    A link is a pair of token occurrences in ``relation``; its count is how many links of the corpus join
    the same two ids.  n_best counts the links whose count is the highest of their B id's, count_sum adds
    the counts up, n_overlaps counts the elementary intervals, and groups lists the ids as
    ``a1,a2|b1;a3|b2`` (with ``digest``, the SHA-256 of that).
    Null and empty texts, broken UTF-8 and texts that a tokenizer doesn't give back have no tokens: zeros and an
    empty ``groups``.  Special tokens in texts are plain text.  Null ids are ids, repeated rows count and are
    counted each time, very long texts are read whole, and other columns are not read.  Both files are read by
    the driver and sent to the executors, 2 MB.  Up to ``largest`` pairs of ids are broadcast; beyond that
    texts and pairs are joined, with the same result.
    """
    spark = docs.sparkSession
    held = cut(encoded(docs, id_col, text_col, relation, digest, byte_bpe, piece_bpe))
    counts = cut(link_counts(held))
    names = [id_col, *MEASURES, "groups"]
    if counts.count() > largest:
        # a pair that most texts have is dealt to SALTS tasks, the table's row to each of them
        copies = counts.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        each = pairs_of(held).withColumn("s", F.pmod(F.xxhash64("__gl_row"), F.lit(SALTS))).join(copies, ["key", "s"])
        sums = each.groupBy("__gl_row").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("x"), F.sum(F.col("m") * F.col("n")).alias("y"))
        full = held.join(sums, "__gl_row", "left")
        return full.select(*names, F.coalesce("x", F.lit(0)).alias("n_best"), F.coalesce("y", F.lit(0)).alias("count_sum"))
    got = counts.orderBy("key").toArrow()
    drop_cut(counts)
    known = spark.sparkContext.broadcast(tuple(got.column(k).to_numpy().astype(np.int64) for k in ("key", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = known.value
        for batch in batches:
            mine, times = (batch.column(len(names) + k) for k in (0, 1))
            at, m = np.searchsorted(keys, mine.flatten().to_numpy()), times.flatten().to_numpy()
            edges = np.r_[0, np.cumsum(mine.value_lengths().to_numpy())]
            sums = [np.diff(np.r_[0, np.cumsum(x[at] * m)][edges]) for x in (best, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *map(pa.array, sums)], [*names, "n_best", "count_sum"])

    return held.select(*names, "__gl_keys", "__gl_times").mapInArrow(run, held.select(*names).schema.add("n_best", "long").add("count_sum", "long"))


def op13_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    found = aligned(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"), "n_overlaps")
