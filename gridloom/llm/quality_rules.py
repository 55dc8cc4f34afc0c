"""Quality rules with line sequence labelling by a linear-chain conditional random field.

Counting rules reject a text outright.  Of the rest, the field labels every line with words as
content or boilerplate: each line is described by yes/no features, a label has a weight for each
feature, neighbouring labels have a weight for each pair, and Viterbi decoding finds the best
sequence.  A text is kept if content lines hold at least ``SHARE`` of its word characters.

Training: maximum likelihood by gradient ascent over forward-backward marginals, on the labelled
documents with the smallest hashes, ``SAMPLE_DOCS`` at most and ``LINES`` lines of each.  Labels of lines
come from the document's label and from what the line looks like (``line_label``), so one document has
lines of both labels.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from .common import table

SAMPLE_DOCS = 1500
LINES = 2000
SHARE = 0.5
SYMBOLS = b"#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = b"abcdefghijklmnopqrstuvwxyz"
_DIGIT = b"0123456789"
FEATURES = (
    "any", "under 3 words", "under 8 words", "20 words or more", "symbols over 2 %", "symbols over 10 %", "capitals over half",
    "two exclamation marks", "digits over a fifth", "ends a sentence", "two bars", "repeats a line", "long words", "link or tag",
    "starts in lower case", "few different words",
)
CONTENT, BOILERPLATE = 0, 1


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more, all occurrences counted."""
    wins = list(zip(words, words[1:], words[2:]))
    if len(set(wins)) == len(wins):
        return 0
    n = Counter(wins)
    total, covered = 0, 0  # ``covered``: words up to here are counted
    for i, w in enumerate(wins):
        if n[w] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def line_features(line: bytes, words: list[bytes], repeat: bool) -> int:
    """The features of ``line`` as bits of a number."""
    n, size = len(words), len(line)
    symbols = size - len(line.translate(None, SYMBOLS))
    upper, lower, digits = (size - len(line.translate(None, x)) for x in (_UPPER, _LOWER, _DIGIT))
    held = sum(map(len, words))
    yes = (
        True, n < 3, n < 8, n >= 20, symbols > 0.02 * size, symbols > 0.1 * size, upper > lower, line.count(b"!") >= 2, digits > 0.2 * held,
        words[-1][-1:] in b".!?", line.count(b"|") >= 2, repeat, held > 12 * n, b"http" in line or b"www." in line or b"</" in line,
        words[0][:1].islower(), n >= 8 and len(set(words)) < 0.4 * n,
    )
    return sum(1 << k for k, y in enumerate(yes) if y)


def describe(data: bytes) -> tuple[list[int], list[int], list[bytes], int]:
    """Of the lines with words: features, word characters in bytes, the lines; and how many repeat an earlier line."""
    marks, weight, kept, seen, repeats = [], [], [], set(), 0
    for line in data.split(b"\n"):
        words = line.split()
        if words:
            again = line in seen
            repeats += again
            seen.add(line)
            marks.append(line_features(line, words, again))
            weight.append(sum(map(len, words)))
            kept.append(line)
    return marks, weight, kept, repeats


class Field:
    """A linear-chain conditional random field of two labels over feature bits."""

    def __init__(self) -> None:
        self.emit = [[0.0] * len(FEATURES) for _ in range(2)]
        self.move = [[0.0, 0.0], [0.0, 0.0]]
        self.known: dict[int, tuple[float, float]] = {}

    def scores(self, mark: int) -> tuple[float, float]:
        got = self.known.get(mark)
        if got is None:
            on = [k for k in range(len(FEATURES)) if mark >> k & 1]
            got = self.known[mark] = tuple(sum(self.emit[y][k] for k in on) for y in range(2))
        return got

    def decode(self, marks: list[int]) -> list[int]:
        """The best labels; of equal sequences the one with content."""
        if not marks:
            return []
        (m00, m01), (m10, m11) = self.move
        a, b = self.scores(marks[0])
        back = []
        for mark in marks[1:]:
            sa, sb = self.scores(mark)
            from_a, from_b = (0 if a + m00 >= b + m10 else 1), (0 if a + m01 >= b + m11 else 1)
            a, b = max(a + m00, b + m10) + sa, max(a + m01, b + m11) + sb
            back.append((from_a, from_b))
        at = 0 if a >= b else 1
        out = [at]
        for step in reversed(back):
            at = step[at]
            out.append(at)
        return out[::-1]

    def fit(self, sequences: list[tuple[list[int], list[int]]], rounds: int = 40, rate: float = 0.5, ridge: float = 1e-3) -> "Field":
        """Gradient ascent with a step for each weight (Adagrad) on the mean log-likelihood."""
        total = sum(len(m) for m, _ in sequences) or 1
        flat = 2 * len(FEATURES) + 4
        square = [1e-8] * flat

        def lse(x: float, y: float) -> float:
            hi = max(x, y)
            return hi + math.log1p(math.exp(min(x, y) - hi))

        for _ in range(rounds):
            seen: dict[int, list[float]] = {}
            moves = [[0.0, 0.0], [0.0, 0.0]]
            self.known.clear()
            (m00, m01), (m10, m11) = self.move
            for marks, labels in sequences:
                e = [self.scores(m) for m in marks]
                fwd = [e[0]] if e else []
                for s in e[1:]:
                    a, b = fwd[-1]
                    fwd.append((lse(a + m00, b + m10) + s[0], lse(a + m01, b + m11) + s[1]))
                back = (0.0, 0.0)
                z = lse(*fwd[-1]) if e else 0.0
                for t in range(len(e) - 1, -1, -1):
                    p = math.exp(min(0.0, fwd[t][1] + back[1] - z))
                    g = seen.setdefault(marks[t], [0.0, 0.0])
                    g[1] += labels[t] - p
                    g[0] += p - labels[t]
                    if t:
                        c, d = e[t][0] + back[0], e[t][1] + back[1]
                        for y, f in enumerate(fwd[t - 1]):
                            moves[y][0] -= math.exp(min(0.0, f + self.move[y][0] + c - z))
                            moves[y][1] -= math.exp(min(0.0, f + self.move[y][1] + d - z))
                        moves[labels[t - 1]][labels[t]] += 1
                        back = (lse(m00 + c, m01 + d), lse(m10 + c, m11 + d))
            grad = [sum(g[y] for m, g in seen.items() if m >> k & 1) for y in range(2) for k in range(len(FEATURES))] + [x for r in moves for x in r]
            now = [w for r in self.emit for w in r] + [w for r in self.move for w in r]
            for k in range(flat):
                g = grad[k] / total - ridge * now[k]
                square[k] += g * g
                now[k] += rate * g / math.sqrt(square[k])
            n = len(FEATURES)
            self.emit = [now[:n], now[n : 2 * n]]
            self.move = [now[2 * n : 2 * n + 2], now[2 * n + 2 :]]
        self.known.clear()
        return self


BIT = {name: 1 << k for k, name in enumerate(FEATURES)}
_DAMAGE = sum(BIT[n] for n in ("symbols over 10 %", "capitals over half", "two exclamation marks", "few different words"))
_MARKED = BIT["symbols over 2 %"] | BIT["two bars"] | BIT["link or tag"] | _DAMAGE


def line_label(good: bool, mark: int, repeated: bool) -> int:
    """The label that a line is trained with; documents of either kind have lines of both labels.

    A line that several documents of the sample have, or that repeats an earlier one, is boilerplate
    anywhere, and so are menu lines: bars, or a few words that end no sentence.  In a good document all
    else is content.  In a bad one, content is what reads like a sentence of some length without marks of
    damage.
    """
    menu = mark & BIT["two bars"] or mark & BIT["under 3 words"] and not mark & BIT["ends a sentence"]
    if repeated or mark & BIT["repeats a line"] or menu:
        return BOILERPLATE
    if good:
        return CONTENT
    return CONTENT if mark & BIT["ends a sentence"] and not mark & (BIT["under 8 words"] | _MARKED) else BOILERPLATE


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, common: int = 4) -> Field:
    """A field fitted on the labelled sample, see the module's docstring.  Without labels every line is content.

    One row of each labelled doc_id is read, so repeated ids add nothing.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("good").alias("good"), F.min("text").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            marks, hashes = [], []
            for t in b.column(2).cast(pa.binary()):
                m, _, lines, _ = describe(t.as_py() or b"")
                marks.append(m)
                hashes.append([xxhash.xxh32_intdigest(x) for x in lines])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(marks, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "good", "marks", "hashes"])

    schema = rows.select("doc_id", "good").schema.add("marks", ArrayType(IntegerType())).add("hashes", ArrayType(LongType()))
    # bounded by the sample; a stretch of ``LINES`` lines of a longer document stands for it
    described = rows.mapInArrow(run, schema).select("doc_id", "good", *[F.slice(c, 1, LINES).alias(c) for c in ("marks", "hashes")])
    got = sorted(described.collect(), key=lambda r: r["doc_id"])
    often = Counter(h for r in got for h in set(r["hashes"]))
    seqs = [(r["marks"], [line_label(bool(r["good"]), m, often[h] >= common) for m, h in zip(r["marks"], r["hashes"])]) for r in got if r["marks"]]
    return Field().fit(seqs)


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share) for each row of ``docs``.

    Null, empty and blank texts have no words and fail.  Repeated rows are judged alike, null ids are ids,
    very long texts are read whole, and other columns are not read.  Of equally good label sequences the
    one with content is taken.
    """
    src = docs.select(F.col(id_col), F.col(text_col).alias("__gl_text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: list[list[int]] = [[] for _ in counts]
            failed, kept, shares = [], [], []
            for t in b.column(1).cast(pa.binary()):
                data = t.as_py() or b""
                words = data.split()
                joined = b"".join(words)
                chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
                marks, weight, _, repeats = describe(data)
                again = repeated_words(words)
                for into, x in zip(n, (len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), repeats, again)):
                    into.append(x)
                bad = len(words) < 50 or 100 * again > 50 * len(words)
                content = sum(w for w, y in zip(weight, field.decode(marks)) if y == CONTENT)
                shares.append(content / sum(weight) if weight else 0.0)
                failed.append(bad)
                kept.append(not bad and shares[-1] >= share)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(failed), pa.array(kept), pa.array(shares, pa.float64())], [id_col, *counts, "base_failed", "kept", "content_share"])

    schema = docs.select(id_col).schema
    for c in counts:
        schema = schema.add(c, "long")
    return src.mapInArrow(run, schema.add("base_failed", "boolean").add("kept", "boolean").add("content_share", "double"))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
