"""A quality classifier from weak labels.

Heuristic labellers, each for one kind of damage, vote bad or nothing on each text.  Several may vote
on one text, and a text may suffer from one kind alone, so silence of a labeller is weak evidence.
Expectation-maximisation treats the quality as hidden and estimates how often each labeller votes on
bad texts and on good ones; it runs on the counts of vote patterns over all documents, of which there
are at most 2 ** 8 however large the corpus.  Posteriors of the patterns are soft labels for a linear scorer over
hashed features (word shapes, neighbouring shapes, short words), trained by logistic regression on
the ``SAMPLE_DOCS`` documents with the smallest hashes.  A text of score 0.5 or more is kept.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

SAMPLE_DOCS = 4000
DIMENSIONS = 1 << 14
FALSE_VOTES = 0.001
SYMBOLS = b"#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = b"abcdefghijklmnopqrstuvwxyz"
#: letters to a or A, digits to 0, bytes of other characters to a
_SHAPE = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c > 127 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
#: stands for the votes on a text without words, which is bad beyond estimation
BLANK = -1
LABELLERS = ("symbols", "capitals", "exclamations", "sentences", "repetition", "bare marks", "word length", "repeated lines")


def votes(data: bytes) -> int:
    """The labellers' votes as bits of a number; a set bit is a vote for bad.  Of a text without words none can say anything."""
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return BLANK
    symbols = size - len(data.translate(None, SYMBOLS))
    upper, lower = (size - len(data.translate(None, x)) for x in (_UPPER, _LOWER))
    shouts = data.count(b"!")
    stops = data.count(b".") + data.count(b"?") + shouts
    bare = sum(not w.translate(None, b"|*#-_=~<>&$%!.,;:") for w in words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    held = sum(map(len, words)) / n
    got = (
        symbols > 0.03 * size and symbols > 3,
        upper > 0.4 * (upper + lower) and upper > 20,
        shouts > 0.1 * n and shouts > 3,
        n >= 100 and stops < 0.003 * n,
        n >= 30 and len(set(zip(words, words[1:]))) < 0.3 * n,
        bare > 0.15 * n and bare > 3,
        not 1.5 < held < 30 and n >= 20,
        len(lines) >= 6 and len(set(lines)) < 0.5 * len(lines),
    )
    return sum(1 << k for k, v in enumerate(got) if v)


def features(data: bytes, dimensions: int = DIMENSIONS) -> tuple[list[int], list[float]]:
    """Hashed features: shapes, pairs of neighbouring shapes, and words of three bytes at most.

    Values are roots of shares; ten words are added to the count, so that a few words say little.
    """
    words = data.split()
    n = len(words)
    if not n:
        return [], []
    shapes = _RUNS.sub(rb"\1", data.translate(_SHAPE)).split()
    got: Counter = Counter()
    for kind, c in ((b"1", Counter(shapes)), (b"2", Counter(zip(shapes, shapes[1:]))), (b"w", Counter(w for w in words if len(w) < 4))):
        for x, k in c.items():
            got[zlib.crc32(kind + (b"\0".join(x) if kind == b"2" else x)) % dimensions] += k
    return list(got), [math.sqrt(k / (n + 10)) for k in got.values()]


def estimate(patterns: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of good for each vote pattern, and P(vote | bad), P(vote | good) by labeller: expectation-maximisation.

    The start takes texts with a vote for bad ones, which fixes which hidden class is which.  A labeller
    is held to vote on ``FALSE_VOTES`` of the good texts at most; without that bound a kind of damage that
    one labeller alone sees would pass for its error.
    """
    keys = sorted(patterns)
    k = len(LABELLERS)
    vote = np.array([[p >> j & 1 for j in range(k)] for p in keys], float).reshape(-1, k)
    weight = np.array([patterns[p] for p in keys], float)
    post = np.where(vote.any(axis=1), 0.1, 0.95)
    rate = np.zeros((2, k))
    for _ in range(rounds):
        mass = np.stack([weight * (1 - post), weight * post])
        prior = (mass.sum(axis=1) + 1) / (weight.sum() + 2)
        rate[0] = (mass[0] @ vote + 1) / (mass[0].sum() + 5)
        rate[1] = np.minimum((mass[1] @ vote + 0.1) / (mass[1].sum() + 100), FALSE_VOTES)
        log = np.log(prior)[:, None] + np.log(rate) @ vote.T + np.log1p(-rate) @ (1 - vote.T)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        done = len(new) == 0 or np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return dict(zip(keys, post.tolist())), rate


def fit_linear(rows: list[tuple[list[int], list[float], float]], dimensions: int = DIMENSIONS, rounds: int = 15, rate: float = 0.3, ridge: float = 1e-5) -> np.ndarray:
    """Weights of a logistic regression on soft labels, the last one the constant; Adagrad over the rows in order."""
    w, g2 = np.zeros(dimensions + 1), np.full(dimensions + 1, 1e-6)
    data = [(np.array([*i, dimensions]), np.array([*v, 1.0]), y) for i, v, y in rows if i]
    for _ in range(rounds):
        for i, v, y in data:
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, float(w[i] @ v)))))
            g = (p - y) * v + ridge * w[i]
            g2[i] += g * g
            w[i] -= rate * g / np.sqrt(g2[i])
    return w


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS) -> tuple[np.ndarray, dict[int, float]]:
    """The scorer's weights and the posteriors of all vote patterns of ``docs``."""
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array((votes(t.as_py() or b"") for t in b.column(1).cast(pa.binary())), pa.int32()), b.column(0)], ["pattern", "h"])

    voted = cut(src.select("h", "t").mapInArrow(vote, "pattern int, h long"))
    counted = {r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted.pop(BLANK, None)  # they would distort the labellers' rates
    posterior, _ = estimate(counted)
    posterior[BLANK] = 0.0
    # the hash below which the sample lies; equal texts are one text
    least = voted.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [t.as_py() or b"" for t in b.column(1).cast(pa.binary())]
            f = [features(d) for d in data]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([votes(d) for d in data], pa.int32()), pa.array([x for x, _ in f], pa.list_(pa.int32())), pa.array([x for _, x in f], pa.list_(pa.float64()))], ["h", "pattern", "i", "v"])

    if least is None:
        return np.zeros(DIMENSIONS + 1), posterior
    some = src.where(F.col("h") <= F.lit(least)).select("h", "t").dropDuplicates(["h"]).mapInArrow(describe, "h long, pattern int, i array<int>, v array<double>")
    rows = sorted(some.collect(), key=lambda r: r["h"])
    return fit_linear([(r["i"], r["v"], posterior[r["pattern"]]) for r in rows]), posterior


def score(data: bytes, weights: np.ndarray) -> float:
    """Probability that the text is good; a text without words has none."""
    i, v = features(data)
    if not i:
        return 0.0
    s = float(weights[i] @ np.array(v)) + float(weights[-1])
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, s))))


def scored(docs: DataFrame, weights: np.ndarray, posterior: dict[int, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, weak, score, kept) for each row of ``docs``: the labellers' posterior, the scorer's probability and the verdict.

    Null, empty and blank texts score 0 and go; they take no part in the estimation.  Repeated rows are
    scored alike, null ids are ids, very long texts are read whole, and other columns are not read.
    Without a document there is nothing to learn, and every weight is 0.
    """
    src = docs.select(F.col(id_col), F.col(text_col).alias("__gl_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weak, s = [], []
            for t in b.column(1).cast(pa.binary()):
                data = t.as_py() or b""
                weak.append(posterior.get(votes(data), 0.0))
                s.append(score(data, weights))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weak, pa.float64()), pa.array(s, pa.float64()), pa.array([x >= 0.5 for x in s], pa.bool_())], [id_col, "weak", "score", "kept"])

    return src.mapInArrow(run, docs.select(id_col).schema.add("weak", "double").add("score", "double").add("kept", "boolean"))


def kept_rows(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, that the scorer keeps."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([score(t.as_py() or b"", weights) >= 0.5 for t in b.column(at).cast(pa.binary())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_weak_label_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights, posterior = train(docs)
    return scored(docs, weights, posterior)
