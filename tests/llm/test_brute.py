"""Each operator against a plain version of itself, over rows with nulls, blanks, repeats, ties and long texts."""

import collections
import itertools
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import classes, line_dedup, mixing, quality_model, quality_rules, quotes, secrets, sharding, simhash, token_counts
from gridloom.llm.classes import similar_classes
from gridloom.plans.lineage import components

from test_llm import SF, docs, empty, local  # noqa: F401  fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def similar(sets, least=0.8):
    """All pairs of sets of that Jaccard similarity."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    bits = [sum({1 << (hash(x) % 1024) for x in s}) for s in sets]
    out = []
    for p, i in enumerate(order):
        for j in order[p + 1 :]:
            if len(sets[i]) < least * len(sets[j]):
                break
            if (bits[i] ^ bits[j]).bit_count() <= (len(sets[i]) + len(sets[j])) / 9 + 1e-9 and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-12:
                out.append((i, j))
    return out


# --- sharding ------------------------------------------------------------------------------------


def plain_fit(sizes, capacity):
    left, out = [], []
    for s in sizes:
        fit = min(((r, k) for k, r in enumerate(left) if r >= s), default=None)
        if fit is None:
            left.append(max(capacity, s))
            fit = (left[-1], len(left) - 1)
        left[fit[1]] -= s
        out.append(fit[1])
    return out


def test_shards_against_plain_packing(docs, local):  # noqa: F811
    got = sharding.shard(docs, parts=4, bundles=40).collect()
    size = lambda t: len((t or "").encode()) + 1
    key = lambda t: 42 if t is None else (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64 if h >= 1 << 63 else 0)
    groups = collections.Counter()
    for r in local:
        groups[key(r["text"])] += size(r["text"])
    capacity = -(-sum(groups.values()) // 40)
    bundles = collections.Counter()
    home = {}
    for part in range(4):
        own = sorted(((b, k) for k, b in groups.items() if k % 4 == part), key=lambda x: (-x[0], x[1]))
        for (b, k), n in zip(own, plain_fit([b for b, _ in own], capacity)):
            home[k] = (part, n)
            bundles[part, n] += b
    order = sorted(bundles, key=lambda x: (-bundles[x], *x))
    sizes = [bundles[x] for x in order]
    alone, rest = 0, sum(sizes)
    while alone < 7 and sizes[alone] * (8 - alone) > rest:
        rest -= sizes[alone]
        alone += 1
    low = next(c for c in range(max(sizes[alone], -(-rest // (8 - alone))), sum(sizes) + 1) if max(plain_fit(sizes[alone:], c)) < 8 - alone)
    load = collections.Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    # the least capacity that any search can find bounds what bisection found within a bundle
    assert max(load[s] for s in range(alone, 8)) <= low + capacity
    text = collections.defaultdict(list)
    for r in local:
        text[r["doc_id"]].append((size(r["text"]), zlib.crc32((r["text"] or "").encode())))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((i, *v) for i, vs in text.items() for v in vs)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


# --- token counts, secrets, quality rules ---------------------------------------------------------


def test_token_counts_against_a_tokenizer(docs, local, empty):  # noqa: F811
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0), *token_counts.vocabulary().items()]
    t = Tokenizer(models.Unigram(pieces, 0, False))

    def tokens(word):
        e = t.encode(token_counts.MARK + word)
        return sum(len(x.encode()) if i == 0 else 1 for i, x in zip(e.ids, e.tokens))

    known = {}
    want = collections.Counter()
    for r in local:
        words = WORD.findall(r["text"] or "")
        want[r["doc_id"], len(words), sum(known.setdefault(w, None) or known.__setitem__(w, tokens(w)) or known[w] for w in words)] += 1
    got = token_counts.token_counts(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_tokens"]) for r in got) == want
    assert token_counts.token_counts(empty).count() == 0


def test_secrets_against_plain_search(docs, local, empty):  # noqa: F811
    words = [w for r in local for w in re.findall("[A-Za-z]+", r["text"] or "")][:4000]
    ratio = secrets.ratios(secrets.random_pairs(3000), secrets.pairs(words))
    rng = random.Random(3)
    key = lambda n: "".join(rng.choices(secrets.ALPHABETS[3], k=n))
    texts = [f"x {key(30)} y", f"token = {key(40)} {key(24)}", "secret:" + "ab" * 30 + key(30), "é" * 40 + key(32), "AKIA" + "Q7" * 9, "a" * 100, " ".join(key(22) for _ in range(3000))]
    df = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(list(enumerate(texts, 5000)), "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in local] + list(enumerate(texts, 5000))
    pats = ((r"(?ai)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 1), (r"AKIA[A-Z0-9]+", 20, 0), (r"[0-9a-f]+", 24, 0))
    want = collections.Counter()
    for i, text in rows:
        base = [(m.start(), k, m.end()) for k, (p, n, g) in enumerate(pats) for m in re.finditer(p, text or "") if len(m.group(g)) >= n]
        more = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text or ""):
            s = m.group()
            score = sum(ratio[s[j : j + 2]] for j in range(len(s) - 1))
            if score >= secrets.TOTAL_RATIO and score >= secrets.MEAN_RATIO * (len(s) - 1) and all(e <= m.start() or a >= m.end() for a, _, e in base):
                more.append((m.start(), 3, m.end()))
        want[(i, *[sum(b[1] == k for b in base) for k in range(3)], ",".join(f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e in sorted(base + more)))] += 1
    got = secrets.scan(df, ratio).collect()
    assert collections.Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) for r in got) == want
    assert any("random" in r["spans"] for r in got) and secrets.scan(empty, ratio).count() == 0


def test_random_strings_are_told_from_identifiers(spark):
    """Held out: strings of another seed, and identifiers made of other documents' words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")  # noqa: F811
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    ratio = secrets.ratios(secrets.random_pairs(), secrets.identifier_pairs(docs, labels.where("doc_id % 2 = 0")))
    rng = random.Random(99)
    keys = ["".join(rng.choices(rng.choice(secrets.ALPHABETS), k=rng.randint(24, 44))) for _ in range(2000)]
    words = [w for r in docs.join(labels.where("doc_id % 2 = 1 and quality = 1"), "doc_id").select("text").collect() for w in re.findall("[a-z]{3,}", r["text"])]
    names = [rng.choice(("_".join, lambda w: "".join(map(str.capitalize, w))))(rng.choices(words, k=5)) for _ in range(2000)]
    names = [n for n in names if len(n) >= 20]
    found = lambda xs: sum(bool(secrets.random_spans(x, ratio, [])) for x in xs) / len(xs)
    assert found(keys) >= 0.9 and found(names) <= 0.02


def test_quality_counts_against_plain_ones(spark, docs, local, empty):  # noqa: F811
    field = quality_rules.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = collections.Counter()
    for r in local:
        text = r["text"] or ""
        words = WORD.findall(text)
        wins = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {k for i in range(len(words) - 2) if wins[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want[r["doc_id"], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed] += 1
    got = quality_rules.judge(docs, field).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_one_document_has_lines_of_both_labels():
    menu = quality_rules.describe(b"Home | News | About | Contact\n")[0][0]
    prose = quality_rules.describe(b"The old bridge was closed in the spring after the river had risen.\n")[0][0]
    for good in (True, False):
        assert quality_rules.line_label(good, menu, False) == quality_rules.BOILERPLATE
        assert quality_rules.line_label(good, prose, False) == quality_rules.CONTENT
        assert quality_rules.line_label(good, prose, True) == quality_rules.BOILERPLATE


# --- the weak-label model ------------------------------------------------------------------------


def test_expectation_maximisation_against_loops():
    rng = random.Random(5)
    k = len(quality_model.LABELLERS)
    patterns = collections.Counter(sum(1 << j for j in range(k) if rng.random() < (0.4 if bad else 0.0005)) for bad in (rng.random() < 0.2 for _ in range(5000)))
    got, _ = quality_model.estimate(dict(patterns))
    post = {p: 0.1 if p else 0.95 for p in patterns}
    for _ in range(100):
        total = sum(patterns.values())
        good = sum(n * post[p] for p, n in patterns.items())
        prior = [(total - good + 1) / (total + 2), (good + 1) / (total + 2)]
        rate = [[0.0] * k, [0.0] * k]
        for j in range(k):
            rate[0][j] = (sum(n * (1 - post[p]) for p, n in patterns.items() if p >> j & 1) + 1) / (total - good + 5)
            rate[1][j] = min((sum(n * post[p] for p, n in patterns.items() if p >> j & 1) + 0.1) / (good + 100), quality_model.FALSE_VOTES)
        new = {}
        for p in patterns:
            like = [prior[y] * math.prod(rate[y][j] if p >> j & 1 else 1 - rate[y][j] for j in range(k)) for y in (0, 1)]
            new[p] = like[1] / sum(like)
        done = max(abs(new[p] - post[p]) for p in post) < 1e-9
        post = new
        if done:
            break
    assert all(abs(got[p] - post[p]) < 1e-6 for p in patterns)


def test_scorer_against_loops():
    rng = random.Random(6)
    rows = [(sorted(rng.sample(range(20), 4)), [rng.random() for _ in range(4)], rng.random()) for _ in range(60)]
    got = quality_model.fit_linear(rows, 20, 5)
    w, g2 = [0.0] * 21, [1e-6] * 21
    for _ in range(5):
        for i, v, y in rows:
            i, v = [*i, 20], [*v, 1.0]
            p = 1 / (1 + math.exp(-sum(w[a] * b for a, b in zip(i, v))))
            g = [(p - y) * b + 1e-5 * w[a] for a, b in zip(i, v)]
            for a, x in zip(i, g):
                g2[a] += x * x
                w[a] -= 0.3 * x / math.sqrt(g2[a])
    assert np.allclose(got, w, atol=1e-9)


def test_quality_model_on_odd_rows(spark, docs, local, empty):  # noqa: F811
    weights, posterior = quality_model.train(docs)
    got = quality_model.scored(docs, weights, posterior).collect()
    assert len(got) == len(local) and all(r["score"] == 0 and not r["kept"] for r in got if r["doc_id"] in (1000, 1001, 1002))
    assert quality_model.kept_rows(docs, weights).columns == docs.columns
    w, p = quality_model.train(empty)
    assert not w.any() and quality_model.scored(empty, w, p).count() == 0
    blanks = spark.createDataFrame([(i, " ") for i in range(5000)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    assert {k: round(v, 9) for k, v in quality_model.train(blanks)[1].items()} == {k: round(v, 9) for k, v in posterior.items()}


# --- lines and near copies ------------------------------------------------------------------------


def test_lines_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")  # noqa: F811
    named = {(r["id"], r["line_no"]): r["line"] for r in line_dedup.exploded(docs, "doc_id", "text").collect()}
    lines = sorted(set(named.values()))
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
    pairs = similar(sets)
    of = {named[r["doc_id"], r["line_no"]]: r["class_id"] for r in line_dedup.line_classes(docs).collect()}
    assert sum(of[lines[a]] == of[lines[b]] for a, b in pairs) >= 0.9 * len(pairs) > 0
    u = Union()
    for a, b in pairs:
        u.join(a, b)
    classes = collections.defaultdict(set)
    for i, x in enumerate(lines):
        classes[of[x]].add(u.find(i))
    assert all(len(c) == 1 for c in classes.values())


def test_stars_of_near_copies_are_one_class_each(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))
    rows = []
    for c in range(3):
        base = [word() for _ in range(48)]
        rows.append((c, " ".join(base)))
        for _ in range(60):
            copy = list(base)
            for i in rng.sample(range(48), 2):
                copy[i] = word()
            rows.append((c, " ".join(copy)))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    of = {r["doc_id"]: r["class_id"] for r in line_dedup.line_classes(df).collect()}
    assert len(set(of.values())) == 3 and len({(c, of[i]) for i, (c, _) in enumerate(rows)}) == 3


@pytest.mark.parametrize("chunk", [2048, 7])
def test_classes_without_a_centre(spark, monkeypatch, chunk):
    """A cloud of texts, some alike and some not, that all share one key: components equal those of all pairs, in one chunk or many."""
    monkeypatch.setattr("gridloom.llm.classes.CHUNK", chunk)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(40)]
    texts = set()
    for _ in range(150):
        t = list(base)
        for i in rng.sample(range(40), rng.randint(1, 8)):
            t[i] = f"x{rng.randrange(10**6)}"
        texts.add(" ".join(t))
    texts = sorted(texts)
    df = spark.createDataFrame([(i, t, [7]) for i, t in enumerate(texts)], "h long, text string, keys array<long>")
    got = {r["h"]: r["root"] for r in similar_classes(df.select("h", "text"), df.select("h", "keys"), line_dedup.shingles, 0.8).collect()}
    u = Union()
    for a, b in similar([{t[i : i + 8] for i in range(len(t) - 7)} for t in texts]):
        u.join(a, b)
    assert {i: got.get(i, i) for i in range(len(texts))} == {i: u.find(i) for i in range(len(texts))}


def test_line_report_of_odd_rows(docs, local):  # noqa: F811
    d = docs.select("doc_id", "text", "shard")
    got = {r["doc_id"]: r for r in line_dedup.line_report(d).collect()}
    n = collections.Counter()
    for r in local:
        n[r["doc_id"]] += 0 if r["text"] is None else r["text"].count("\n") + 1
    assert {k: r["n_lines"] for k, r in got.items()} == dict(n)
    assert all(r["n_kept"] == r["n_lines"] - len(r["dropped"]) for r in got.values())
    assert line_dedup.dedup_lines(d).columns == d.columns


def test_line_counts_need_no_further_look_at_texts(spark, tmp_path):
    rows = [(1, "one line of words\n\n one line of words "), (2, None), (3, ""), (None, "\n \n"), (1, "\t\nlast"), (4, "  \nx")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    report = line_dedup.line_report(docs)
    assert not set(report.inputFiles()) & set(docs.inputFiles())
    got = sorted((r["doc_id"] or 0, r["n_lines"], r["n_kept"], r["dropped"]) for r in report.collect())
    assert got == [(0, 3, 3, []), (1, 5, 4, [2]), (2, 0, 0, []), (3, 1, 1, []), (4, 2, 2, [])]


def test_band_keys_against_plain_ones(spark):
    texts = ["some words that make a line of the usual kind, with ä and 𝄞 in it", "word word word word word word", "short", "exactly8", "一二三四五六七八九十" * 9, "x" * 70 + " y", "a b c d e f g h i j k l m"]

    def signed(n: int) -> int:
        return n - (1 << 64) if n >= 1 << 63 else n

    def hashed(x: bytes, seed: int = 42) -> int:
        return xxhash.xxh64_intdigest(x, seed)

    wanted = {}
    for t in texts:
        marks = {hashed(t[i : i + 8].encode("utf-32-be")) for i in range(max(1, len(t) - 7))}
        bounds = [b * ((1 << 64) // line_dedup.BANDS) - (1 << 63) for b in range(line_dedup.BANDS)]
        ring, keys = sorted(bounds + [signed(m) for m in marks]), set()
        for b in bounds:
            after = [ring[(ring.index(b) + 1 + k) % len(ring)] for k in range(line_dedup.ROWS)]
            if not set(after) <= set(bounds):
                seed = 42
                for x in after:
                    seed = hashed(struct.pack("<q", x), seed)
                keys.add(signed(seed))
        wanted[t] = keys
    df = spark.createDataFrame([(t, t) for t in texts], "id string, line string")
    got = {r["id"]: r["keys"] for r in line_dedup.banded(df).collect()}
    assert {t: set(k) for t, k in got.items()} == wanted
    assert all(len(set(k)) == len(k) for k in got.values())


LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x430, 0x450)))
#: alphabet, shortest and longest word, and the one change between two lines
CHANGES = [
    (LATIN, 3, 7, "character"),
    (CYRILLIC, 6, 9, "character"),
    (CYRILLIC, 6, 8, "word"),
    (CYRILLIC, 6, 9, "blank"),
    (LATIN, 13, 17, "character"),
    (LATIN, 13, 16, "blank"),
    ("".join(map(chr, range(0x4E00, 0x5200))), 20, 60, "character"),
]


@pytest.mark.parametrize("change", CHANGES, ids=lambda c: f"{hex(ord(c[0][0]))}-{c[1]}-{c[3]}")
def test_similar_lines_share_a_key(spark, change):
    """Of pairs of similarity 0.8 to 0.95 nine in ten or more share a key, whatever the script, the words' length and the change."""
    alphabet, least, most, kind = change
    rng = random.Random(11)
    word = lambda: "".join(rng.choices(alphabet, k=rng.randint(least, most)))
    pairs = []
    while len(pairs) < 400:
        words = [word() for _ in range(rng.randint(2, 30))]
        other, i = list(words), rng.randrange(len(words) - 1)
        if kind == "character":
            j = rng.randrange(len(other[i]))
            other[i] = other[i][:j] + rng.choice(alphabet) + other[i][j + 1 :]
        elif kind == "word":
            other.insert(i, word())
        else:
            other[i : i + 2] = [other[i] + other[i + 1]]
        x, y = " ".join(words), " ".join(other)
        a, b = ({t[k : k + 8] for k in range(max(1, len(t) - 7))} for t in (x, y))
        if 0.8 <= len(a & b) / len(a | b) < (1 if least >= 20 else 0.95):
            pairs.append((x, y))
    df = spark.createDataFrame([(2 * k + s, p[s]) for k, p in enumerate(pairs) for s in (0, 1)], "id long, line string")
    keys = {r["id"]: set(r["keys"]) for r in line_dedup.banded(df).collect()}
    assert sum(bool(keys[2 * k] & keys[2 * k + 1]) for k in range(len(pairs))) >= 0.9 * len(pairs)


@pytest.mark.parametrize("size", [10, 20, 40, 80, 160])
def test_recall_by_length_of_line(spark, size):
    """Lines that lost or gained characters at their ends."""
    rng = random.Random(size)
    pairs = []
    while len(pairs) < 400:
        x = " ".join("".join(rng.choices(LATIN, k=rng.randint(2, 9))) for _ in range(40))[: size + 8].strip()
        cut_ = max(1, (len(x) - 7) // 10)
        y = (x[rng.randint(0, cut_) : len(x) - rng.randint(0, cut_)] + rng.choice(["", "x"])).strip()
        a, b = ({t[k : k + 8] for k in range(max(1, len(t) - 7))} for t in (x, y))
        if x != y and len(a & b) >= 0.8 * len(a | b):
            pairs.append((x, y))
    df = spark.createDataFrame([(2 * k + s, p[s]) for k, p in enumerate(pairs) for s in (0, 1)], "id long, line string")
    keys = {r["id"]: set(r["keys"]) for r in line_dedup.banded(df).collect()}
    assert sum(bool(keys[2 * k] & keys[2 * k + 1]) for k in range(len(pairs))) >= 0.9 * len(pairs)


def test_every_grid_choice_finds_all_links(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = sorted({int(b) for b in base} | {int(b) ^ sum(1 << int(k) for k in rng.choice(63, 4, replace=False)) for b in base for _ in range(5)})
    df = spark.createDataFrame([(x,) for x in prints], "fingerprint long")
    u = Union()
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            u.join(a, b)
    want = {x: u.find(x) for x in prints}
    for n, many in ((5, 100), (15, 10**6), (35, 10**7), (70, 10**12)):
        assert len(simhash.grids(4, many)) == n
        monkeypatch.setattr(simhash, "grids", lambda radius, points, own=simhash.grids(4, many): own)
        roots = {r["node"]: r["root"] for r in components(simhash.links(df, 4)).collect()}
        monkeypatch.undo()
        assert {x: roots.get(x, x) for x in prints} == want


# --- conversations --------------------------------------------------------------------------------


def test_quotes_against_sql(spark, empty):  # noqa: F811
    rng = random.Random(11)
    sentence = lambda: " ".join(rng.choice(("River", "bridge,", "old", "was", "CLOSED", "in", "spring", "über", "7", "!")) for _ in range(rng.randint(1, 6)))
    rows = []
    for conv in range(12):
        said = []
        for turn in range(rng.randint(1, 9)):
            lines = [sentence() for _ in range(rng.randint(1, 3))]
            for _ in range(rng.randint(0, 3) if said else 0):
                old = rng.choice(said).split("\n")
                marks = ">" * rng.randint(1, 3) if rng.random() < 0.5 else "> >"
                if rng.random() < 0.3:
                    old = [" ".join(old)]  # the passage, wrapped anew
                lines = [f"{marks} {x.upper() if rng.random() < 0.2 else x}" for x in old] + rng.choice(([], [">"], [""])) + lines
            if rng.random() < 0.3:
                lines.insert(0, "> said by nobody " + sentence())
            text = "\n".join(lines)
            said.append(text)
            rows.append((None if conv == 11 else conv, None if rng.random() < 0.05 else turn, rng.choice(("user", "assistant")), text))
    rows += rng.choices(rows, k=10) + [(3, 99, "user", None), (3, 100, "user", ""), (4, 50, "user", "> " + "w " * 20_000 + "\nx")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.conversations(df.withColumn("k", F.lit(1)).withColumn("line_no", F.lit(0)))
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    rel = c.sql(quotes.SQL["op10_quotation_links"])
    names = rel.columns
    drop = names.index("position")  # rows that are equal but for their role may swap places
    bare = lambda r: tuple(v for k, v in enumerate(r) if k != drop)
    table = [tuple(r) for r in got.select(*names).collect()]
    want = rel.fetchall()
    assert collections.Counter(map(bare, table)) == collections.Counter(map(bare, want))
    assert sorted((r[0] is None, r[0] or 0, r[drop]) for r in table) == sorted((r[0] is None, r[0] or 0, r[drop]) for r in want)
    assert sum(r[names.index("n_linked")] for r in table) > 30
    assert quotes.conversations(df.limit(0)).count() == 0
    # a history in many blocks of turns
    for block in (1, 3):
        a = df.select("conv_id", F.xxhash64("role").alias("hash"), F.col("turn").alias("t")).where("t is not null")
        near = quotes.latest_before(a.distinct().withColumn("n", F.lit(1)), a, block).collect()
        all_ = {tuple(r) for r in a.collect()}
        assert all(r["orig"] == max((t for c_, h, t in all_ if (c_, h) == (r["conv_id"], r["hash"]) and t < r["t"]), default=None) for r in near)


# --- the mix and the pipeline ---------------------------------------------------------------------


def test_stretches_of_the_mix_hold_their_shares(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(5, 60)), f"s{rng.choice('aaaabbc')}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")  # noqa: F811
    target = {s: t for s, t in {(dict(((r[0]), r[2]) for r in rows)[m["doc_id"]], m["target"]) for m in mixing.mix(docs).collect()}}
    got = mixing.mixed_rows(docs).collect()
    total, run = sum(target.values()), collections.Counter()
    sizes = [(r["source"], len(r["text"].split())) for r in got]
    ends = list(itertools.accumulate(n for _, n in sizes))
    for k, (s, n) in enumerate(sizes):
        run[s] += n
        if k % 50 == 0:
            # a few blocks of words, whatever the length of the stretch
            assert all(abs(run[x] - target[x] / total * ends[k]) <= 12 * mixing.BLOCK_WORDS for x in target)
    assert all(abs(run[s] - target[s]) <= 60 for s in target)


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline as p

    table = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9001, None), (9002, ""), (9003, "  "), (None, table.first()["text"])]
    extra = [(i, t, "en", None, 0) for i, t in odd]
    docs = table.unionByName(spark.createDataFrame(extra, table.schema)).unionByName(table.limit(2))  # noqa: F811
    rows = [tuple(r) for r in docs.collect()]
    weights, _ = quality_model.train(docs)
    rows = [r for r in rows if quality_model.score((r[1] or "").encode(), weights) >= 0.5]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.encode().lower().split()] for i in range(max(1, len(w) - 4))}
    u = Union()
    for a, b in similar([shingles(r[1]) for r in rows]):
        u.join(a, b)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[u.find(i)].append(r)
    rows = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    wins = {tuple(w[k : k + 10]) for w in items if w for k in range(max(1, len(w) - 9))}
    lengths = {len(x) for x in wins}
    rows = [r for r in rows if not any(tuple(w[k : k + n]) in wins for w in [words(r[1])] for n in lengths for k in range(len(w) - n + 1))]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = docs
    for _, stage in p.STAGES[:3]:
        out = spark.createDataFrame(stage(spark, out, str(tmp_path)).collect(), table.schema)
    assert collections.Counter(tuple(r) for r in out.collect()) == collections.Counter(rows)
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    rel = c.sql(mixing.SQL["op2_source_mix"])
    at = {n: k for k, n in enumerate(rel.columns)}
    times = collections.Counter()
    for r in rel.fetchall():
        times[r[at["doc_id"]]] += int(r[at["taken"]] / max(1, r[at["size"]]) + 0.5)
    got = p.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in got) == +times
    text = {r[0]: r[1] for r in rows}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in got)
    home = collections.defaultdict(set)
    for r in got:
        home[r["doc_id"]].add(r["shard"])
    assert all(len(s) == 1 for s in home.values())


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as p

    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_repetition_at_every_length_and_shapes_beyond_a_prefix():
    phrase = [f"w{k}".encode() for k in range(3000)]
    bit = 1 << quality_model.LABELLERS.index("repetition")
    assert quality_model.votes(b" ".join(phrase * 5)) & bit and quality_model.votes(b" ".join(phrase[:40] * 5)) & bit
    assert not quality_model.votes(b" ".join(phrase)) & bit
    long = b"a1" * 40
    assert quality_model.features(long + b"!")[0] != quality_model.features(long + b"?")[0]


@pytest.mark.parametrize("name", ["op1_simhash_near_dedup", "op5_secret_scan", "op8_weak_label_quality"])
def test_reruns_agree(spark, name):
    from gridloom.llm import queries

    rows = [sorted(map(str, queries.QUERIES[name](spark, SF).collect())) for _ in range(2)]
    assert rows[0] == rows[1]


def test_signatures_and_sketches_are_made_by_generated_code(spark):
    """Hashes are sorted with their repeats, which no set is made for; the array of shingles stands below the generator, a plain column for it."""
    lines = spark.createDataFrame([("ab" * 40,), ("0123456789" * 30,), ("a" * 200 + "some words after it",), ("short",), ("The rain in Spain stays mainly in the plain. " * 3,)], "line string")
    banded = line_dedup.banded(lines)
    assert "array_union" not in banded._jdf.queryExecution().optimizedPlan().toString()
    bounds = [b * ((1 << 64) // line_dedup.BANDS) - (1 << 63) for b in range(line_dedup.BANDS)]
    signed = lines.select(F.xxhash64("line").alias("h"), F.array_sort(F.array_union(F.array(*map(F.lit, bounds)), line_dedup.hashes(F.col("line")))).alias("ring")).collect()
    got = {r["h"]: r["keys"] for r in banded.collect()}
    for r in signed:
        cut = [[r["ring"][(r["ring"].index(b) + 1 + k) % len(r["ring"])] for k in range(line_dedup.ROWS)] for b in bounds]
        whole = spark.createDataFrame([(c,) for c in cut if not set(c) <= set(bounds)], "c array<long>").select(F.xxhash64("c").alias("k"))
        assert set(got[r["h"]]) == {x["k"] for x in whole.collect()}
    sketches = classes.sketches(lines.select(F.xxhash64("line").alias("h"), F.col("line").alias("text")), line_dedup.shingles)
    generators = [x for x in sketches._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in x]
    assert len(generators) == 1 and "transform" not in generators[0]
