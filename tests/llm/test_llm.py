"""The training-data operators against brute force, on small tables with nulls, ties and clashing names."""

import collections
import hashlib
import itertools
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, line_dedup, mixing, near_copies, quality_model, quality_rules, queries, quotes, secrets, sharding, simhash, token_counts
from gridloom.plans.lineage import components, ranked

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, shard int"


@pytest.fixture(scope="module")
def docs(spark):
    """Real rows plus odd ones; two extra columns clash with names that operators make."""
    rows = [tuple(r) + ("x", 1) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(80).collect()]
    n = 1000
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    odd = [None, "", " \n\t ", "one", "one two three", long, rows[3][1], rows[3][1] + " tail", "a" * 5000, "é" * 30, "password: hunter22"]
    rows += [(n + i, t, "en", None if i % 3 == 0 else "src0", 0, "x", 1) for i, t in enumerate(odd)]
    rows += [(None, rows[5][1], "en", "src1", 0, None, None), rows[7], rows[7]]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def local(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_print(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=4):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_simhash(spark, docs, local, empty):
    prints = [brute_print(r["text"]) for r in local]
    root = brute_components(set(prints))
    least = {}
    for r, p in zip(local, prints):
        if r["doc_id"] is not None:
            least[root[p]] = min(least.get(root[p], 1 << 62), r["doc_id"])
    want = collections.Counter((r["doc_id"], p, least.get(root[p])) for r, p in zip(local, prints))
    got = simhash.near_duplicates(docs).collect()
    assert collections.Counter((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(brute_components(set(prints))[brute_print(r["text"])] for r in kept.collect()) == sorted(set(root.values()))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_links_in_small_cells_and_chunks(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    some = {int(b) for b in base} | {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (12, 2))}
    df = spark.createDataFrame([(x - (1 << 64) if x >= 1 << 63 else x,) for x in some], "fingerprint long")
    want = brute_components(some)
    for cell in (4096, 7):
        pairs = components(simhash.links(df, 4, cell)).collect()
        root = {r["node"] % (1 << 64): r["root"] for r in pairs}
        groups = collections.defaultdict(set)
        for x in some:
            groups[root.get(x, x)].add(x)
        expect = collections.defaultdict(set)
        for x, r in want.items():
            expect[r].add(x)
        # a root may name its group by the signed value
        assert sum(len(g) for g in expect.values() if len(g) > 1) == len(set(root) | {r % (1 << 64) for r in root.values()})
        assert len({frozenset(g) for g in expect.values() if len(g) > 1}) == len(set(root.values()))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rel = c.sql(queries.SQL[name])
    at = [rel.columns.index(x) for x in names]
    got = sorted(map(str, (tuple(r) for r in df.select(*names).collect())))
    assert got == sorted(str(tuple(r[i] for i in at)) for r in c.execute(queries.SQL[name]).fetchall())


def test_mix(spark, docs, local, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(local)
    by = collections.defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(t - target) <= 1 for (_, target), t in by.items())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    goal = mixing.plan(mixing.targets(docs.select(mixing.source_key(F.col("source")).alias("skey"), mixing.word_count(F.col("text")).alias("n")).groupBy("skey").agg(F.sum("n").alias("source_size"))))
    slots = mixing.schedule(goal).orderBy("slot").collect()
    n = {r["skey"]: r["slots"] for r in goal.collect()}
    assert collections.Counter(s["skey"] for s in slots) == {k: v for k, v in n.items() if v}
    half = collections.Counter(s["skey"] for s in slots[: len(slots) // 2])
    assert all(abs(half[k] - v / 2) <= 4 for k, v in n.items())
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_shards(docs, local, empty):
    got = sharding.shard(docs).collect()
    assert len(got) == len(local)
    home, size, slots = collections.defaultdict(set), collections.Counter(), collections.defaultdict(list)
    for r in got:
        home[r["text_crc32"], r["size"]].add(r["shard"])
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in home.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty).count() == 0


def test_best_fit():
    rng = np.random.default_rng(2)
    sizes = sorted(rng.integers(1, 100, 3000).tolist(), reverse=True)
    left, want = [], []
    for s in sizes:
        fit = [(r, k) for k, r in enumerate(left) if r >= s]
        if fit:
            r, k = min(fit)
        else:
            left.append(100)
            k = len(left) - 1
        left[k] -= s
        want.append(k)
    assert len(set(sharding.best_fit_decreasing(sizes, 100))) == len(set(want))
    capacity, bins = sharding.fewest_capacity(sizes, 8)
    assert max(bins) < 8 and capacity <= sum(sizes) / 8 * 1.01


def test_hot_groups_leave_the_rest_near_equal(spark):
    for hot in ([1000], [429], [3000, 700], [10**6] * 9, []):
        sizes = sorted(hot + [1] * 2048, reverse=True)
        got = collections.Counter()
        for s, b in zip(sizes, sharding.near_equal(sizes, 8)):
            got[b] += s
        rest = [n for _, n in got.most_common()][min(len(hot), 7) :]
        assert set(got) <= set(range(8)) and (len(hot) > 7 or (len(got) == 8 and max(rest) - min(rest) <= 0.02 * max(rest)))
    docs = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i:05d}") for i in range(6000)], "doc_id long, text string")
    size = {r["shard"]: r["n"] for r in sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    low = sorted(size.values())[:7]
    assert len(size) == 8 and low[-1] <= 1.05 * low[0]


def test_secrets(spark, docs, local):
    ratio = secrets.ratios(secrets.random_pairs(2000), secrets.pairs(["connectionFactory", "user_name_list", "anotherOrdinaryWord"] * 50))
    text = "é api_key = 'abc12' token:abcdef1 AKIA" + "A1" * 8 + " " + "0f" * 12
    row = secrets.scan(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), ratio).orderBy("doc_id").collect()
    base = []
    for k, (p, least, g) in enumerate(((r"(?ai)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 1), (r"AKIA[A-Z0-9]+", 20, 0), (r"[0-9a-f]+", 24, 0))):
        base += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m.group(g)) >= least]
    want = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base))
    assert (row[0]["n_assign"], row[0]["n_access"], row[0]["n_hex"]) == (1, 1, 1)
    assert row[0]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and row[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secrets.scan(docs, ratio).count() == len(local)


def test_quality_rules(spark, docs, local, empty):
    assert quality_rules.repeated_words(b"a b c x a b c y".split()) == 6 and quality_rules.repeated_words(b"a a a a".split()) == 4
    field = quality_rules.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for marks in ([1, 3, 5], [7] * 4, [33, 1, 2, 4, 9]):
        best = max(itertools.product((0, 1), repeat=len(marks)), key=lambda ys: sum(field.scores(m)[y] for m, y in zip(marks, ys)) + sum(field.move[a][b] for a, b in zip(ys, ys[1:])))
        assert list(best) == field.decode(marks)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, field).collect()}
    assert got[1000]["n_words"] == 0 and not got[1000]["kept"] and quality_rules.judge(empty, field).count() == 0


def test_decontamination(spark, docs, local):
    items = spark.createDataFrame([(1, local[2]["text"]), (2, "one"), (3, None), (4, ""), (10, "two Three"), (10, "two Three"), (None, "one two")], "item_id long, text string")
    got = collections.Counter(map(str, decontaminate.contamination(docs, items).collect()))

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    pats = [(i["item_id"], w[k : k + 10]) for i in items.collect() for w in [words(i["text"])] if w for k in range(max(1, len(w) - 9))]
    hits = {}
    for r in local:
        w, hit, who = words(r["text"]), set(), set()
        for i, p in pats:
            for s in range(len(w) - len(p) + 1):
                if w[s] == p[0] and w[s : s + len(p)] == p:
                    hit.update(range(s, s + len(p)))
                    who.add(i)
        hits[r["doc_id"], r["text"]] = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(map(str, who - {None}))).encode()).hexdigest())
    seen = decontaminate.contamination(docs, items).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in seen) == collections.Counter((r["doc_id"], *hits[r["doc_id"], r["text"]]) for r in local)
    assert got == collections.Counter(map(str, decontaminate.contamination(docs, items, part=3).collect()))
    assert decontaminate.clean_rows(docs, items).columns == docs.columns
    assert any(h[1] and None in h for h in [(r["doc_id"], hits[r["doc_id"], r["text"]][1], None) for r in local])
    assert decontaminate.contamination(docs.limit(0), items).count() == 0 and not any(r["n_hit"] for r in decontaminate.contamination(docs, items.limit(0)).collect())


def test_quality_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weights, posterior = quality_model.train(docs)
    got = quality_model.scored(docs, weights, posterior).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in got if r["quality"]], [r for r in got if not r["quality"]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good) and sum(not r["kept"] for r in bad) >= 0.8 * len(bad)


def test_lines(spark, docs, empty):
    rows = [(1, "The quick brown fox jumps over the lazy dog near the old river bank tonight\nshort\nAnother line that is entirely different from all the others here"), (2, "The quick brown fox jumps over the lazy dog near the old river bank tonighT\nx"), (3, None), (4, ""), (None, "The quick brown fox jumps over the lazy dog near the old river bank tonight")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line_no", F.lit(0))
    got = {r["doc_id"]: (r["n_lines"], r["n_kept"], r["dropped"]) for r in line_dedup.line_report(d).collect()}
    assert got == {1: (3, 2, [0]), 2: (2, 1, [0]), 3: (0, 0, []), 4: (1, 1, []), None: (1, 1, [])}
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(d).collect()}
    assert out[2] == "x" and out[3] is None and out[1].startswith("short\nAnother")
    assert line_dedup.line_report(empty).count() == 0


def test_short_and_blank_lines(spark):
    d = spark.createDataFrame([(1, "Les.\nHome\n\n \t\nHome "), (2, "Les.\n\n\t\nHomes\nx"), (3, "x")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["dropped"]) for r in line_dedup.line_report(d).collect()}
    assert got == {1: (5, [4]), 2: (5, [0]), 3: (1, [0])}


def test_lines_of_one_repeated_phrase(spark):
    d = spark.createDataFrame([(1, "-" * 20), (2, "-" * 80), (3, "ab cd " * 6 + "ab"), (4, "ab cd " * 30 + "ab")], "doc_id long, text string")
    assert {r["doc_id"]: r["dropped"] for r in line_dedup.line_report(d).collect()} == {1: [], 2: [0], 3: [], 4: [0]}


def test_all_links_of_shared_keys(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6))
    lines = []
    for _ in range(150):
        # neighbours of a chain are alike, its ends are not; some chains are long
        w = [word() for _ in range(40)]
        for _ in range(3 if len(lines) < 400 else 40):
            lines.append(" ".join(w))
            at = int(rng.integers(0, 38))
            w[at : at + 2] = [word(), word()]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    of = {r["doc_id"]: r["class_id"] for r in line_dedup.line_classes(df).collect()}
    hashed = df.select("doc_id", F.col("text").alias("line"), F.xxhash64("text").alias("h"))
    met = collections.defaultdict(list)
    for r in hashed.join(line_dedup.banded(hashed.select("line")), "h").select("doc_id", F.explode(F.array_distinct("keys")).alias("key")).collect():
        met[r["key"]].append(r["doc_id"])
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in lines]
    pairs = {p for v in met.values() for p in itertools.combinations(sorted(v), 2)}
    alike = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(alike) > 300 and any(len(v) > 4 for v in met.values())
    assert [p for p in alike if of[p[0]] != of[p[1]]] == []


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there, World!"), (1, 1, "assistant", "> hello there world\nHi."), (1, 2, "user", ">> Hello there, World!\n> Hi.\nGood"), (1, 3, "user", "New topic"), (1, 4, "user", "> not said by anyone\nok"), (2, 0, "user", None), (None, 0, "user", "x"), (1, 5, "assistant", "> Good\nfine"), (1, 5, "assistant", "> Good\nfine")]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    one = sorted((r["position"], r["turn"], r["reply_to"], r["depth"], r["text"]) for r in got if r["conv_id"] == 1)
    assert [r[1:] for r in one] == [(0, None, 0, "Hello there, World!"), (1, 0, 1, "Hi."), (2, 1, 2, "Good"), (5, 2, 3, "fine"), (5, 2, 3, "fine"), (3, None, 0, "New topic"), (4, None, 0, "> not said by anyone\nok")]
    assert [r[0] for r in one] == list(range(7)) and len(got) == len(rows)


def test_ranks(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), (-F.col("id")).alias("o"))
    for r in ranked(df, ["g"], ["o"], "r").groupBy("g").agg(F.sort_array(F.collect_list("r")).alias("r")).collect():
        assert r["r"] == list(range(len(r["r"])))


def test_near_dedup_stage(spark):
    import corpus_pipeline as p

    rng = np.random.default_rng(5)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ["", " ", "one two"]
    for t in [" ".join(f"v{x}" for x in rng.integers(0, 9999, 120)) for _ in range(40)]:
        for _ in range(int(rng.integers(1, 5))):
            w = t.split()
            texts.append(t := " ".join(w[:k] + ["new"] + w[k:]) if (k := int(rng.integers(0, 100))) % 2 else " ".join(w[:k] + ["x", "y"] + w[k + 2 :]))
    words = [t.encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in p.near_dedup(spark, d, SF).collect()}
    assert kept == {find(i) for i in range(len(texts))}


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), docs.schema)
    ids = {r["doc_id"] for r in out.collect()}
    got = p.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == ids and {r["shard"] for r in got} <= set(range(8))


@pytest.mark.parametrize("name", ["h", "size", "fingerprint", "component_id", "key", "block"])
def test_any_names_of_columns(spark, docs, name):
    """Stages that return rows as they are take ids under names that they use inside, and another column of such a name."""
    some = docs.select("doc_id", "text", "source").where("doc_id is not null").limit(60)
    named = some.withColumnRenamed("doc_id", name).withColumn("root" if name != "root" else "h", F.lit(1))
    stages = [
        lambda d, i: near_copies.keep_one(d, i),
        lambda d, i: simhash.keep_one(d, i),
        lambda d, i: mixing.mixed_rows(d, i),
    ]
    for stage in stages:
        got, want = stage(named, name), stage(some, "doc_id")
        assert got.columns == named.columns
        assert collections.Counter(r[0] for r in got.select(name).collect()) == collections.Counter(r[0] for r in want.select("doc_id").collect())
