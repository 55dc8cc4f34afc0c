"""Secret scans by two character Markov models.

Three patterns find what is written like a secret.  Beyond them, every run of key characters is
scored by the log-likelihood ratio of two first-order character chains: one of random strings, one of
ordinary identifiers.  A run whose mean ratio and total are high enough is a span of kind ``random``.

Training.  Random strings are labelled by construction: a seeded generator draws them over the
alphabets that keys use.  Identifiers are the words of a bounded sample of labelled documents, those
of quality 1 with the smallest hashes, ``SAMPLE_DOCS`` at most.  Transition counts are added up on
the executors; the driver sees one row for each pair of character classes, 40 * 40 at most.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

ASSIGN = re.compile(r"""(?ia)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")
SAMPLE_DOCS = 2000
MEAN_RATIO, TOTAL_RATIO = 0.6, 20.0
ALPHABETS = (
    "0123456789abcdef",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches in code points, sorted; kind indexes ``KINDS``."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found)


def pairs(strings) -> Counter:
    """Counts of neighbouring characters, a blank before and after each string."""
    n: Counter = Counter()
    for s in strings:
        s = f" {s} "
        n.update(map("".join, zip(s, s[1:])))
    return n


def random_pairs(count: int = 20_000, seed: int = 42) -> Counter:
    draw = random.Random(seed)
    return pairs("".join(draw.choices(draw.choice(ALPHABETS), k=draw.randint(20, 48))) for _ in range(count))


def identifier_pairs(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> Counter:
    """Pair counts of words, and of words joined as identifiers are, in the sample of labelled documents."""
    good = labels.where("quality = 1").select("doc_id").distinct().withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample)
    rows = docs.join(F.broadcast(good), "doc_id", "left_semi").select(F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                text = t.as_py() or ""
                if ASSIGN.search(text) or ACCESS.search(text):
                    continue
                words = re.findall(r"(?a)[A-Za-z]+", text)
                n += pairs(words)
                n += pairs("_".join(words[k : k + 3]).lower() for k in range(0, len(words), 3))
                n += pairs("".join(w.capitalize() for w in words[k : k + 3]) for k in range(0, len(words), 3))
        yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64())], ["pair", "n"])

    got = rows.mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return Counter({r["pair"]: r["n"] for r in got})


def ratios(random_: Counter, ordinary: Counter, smooth: float = 0.5) -> dict[str, float]:
    """log P(b | a) under the random chain less that under the identifiers' chain, for every pair of key characters."""
    chars = " " + "".join(sorted(set("".join(ALPHABETS)) | set("/=+")))

    def logs(n: Counter) -> dict[str, float]:
        out = {}
        for a in chars:
            total = sum(n[a + b] for b in chars) + smooth * len(chars)
            out.update({a + b: math.log((n[a + b] + smooth) / total) for b in chars})
        return out

    r, o = logs(random_), logs(ordinary)
    return {k: r[k] - o[k] for k in r}


def random_spans(text: str, ratio: dict[str, float], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of key characters that look random and do not overlap a span in ``taken``, which is sorted."""
    starts, reach = [a for a, _, _ in taken], list(accumulate((e for _, _, e in taken), max))
    found = []
    for m in RUN.finditer(text):
        s = m.group()
        total = sum(map(ratio.get, map("".join, zip(s, s[1:]))))
        if total >= TOTAL_RATIO and total >= MEAN_RATIO * (len(s) - 1):
            before = bisect_left(starts, m.end())  # spans that begin before the run ends; one of them may reach into it
            if not before or reach[before - 1] <= m.start():
                found.append((m.start(), 3, m.end()))
    return found


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, ratio: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for each row of ``docs``.

    A null text is an empty one, in which nothing is found.  Repeated rows are scanned alike, null ids
    are ids, very long texts are scanned whole, and other columns are not read.  Where a base pattern
    and a random run overlap, the base pattern stays.
    """
    src = docs.select(F.col(id_col), F.col(text_col).alias("__gl_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, spans = ([], [], []), [], []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                for k in range(3):
                    n[k].append(sum(x[1] == k for x in base))
                sha.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(base + random_spans(text, ratio, base)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(sha), pa.array(spans, pa.string())], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = docs.select(id_col).schema
    for c in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(c, "long")
    return src.mapInArrow(run, schema.add("base_sha256", "string").add("spans", "string"))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratio = ratios(random_pairs(), identifier_pairs(docs, table(spark, sf_dir, "labels")))
    return scan(docs, ratio)
