"""Personal data by weak supervision.

Four patterns find what is written as an e-mail address, an IP address, a card number or a phone number; those base spans
stay as they are.  Beyond them wider patterns propose candidates: addresses with the at sign written out, card
and phone numbers that stand next to other digits, numbers of accounts and persons, names.

Labellers of three families vote on each candidate, for personal data, against it, or not at all: regular expressions (its form,
its check digits), gazetteers (given names, top-level domains, ranges of card issuers, words that are no
names) and its context (words before it, other personal data beside it).  Expectation-maximisation over the
counts of vote patterns, of which there are at most 6 * 3 ** 10, estimates how reliable each labeller is on each kind of span.  The posteriors are soft labels for a
linear span classifier over hashed features of a span and its context, trained on the ``SAMPLE_SPANS``
candidates with the smallest hashes.  Candidates that it gives ``THRESHOLD`` or more are added.

Texts are read once: candidates are written with their votes and features, and scored from that table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

KINDS = ("email", "ip", "card", "phone", "account", "name")
BASE = 4
SAMPLE_SPANS = 20_000
THRESHOLD = 0.9
DIMENSIONS = 1 << 13

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive, and only from the start of a run of digits, so that long runs are read once; looking back comes second, as a
# pattern that begins with a set of characters is searched for faster
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?<![0-9][0-9])(?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: what proposes candidates: the kind, a string or several of which a text must have one, and the pattern
PROPOSERS = [
    (0, (" at ", "at]", "at)", "at ]", "at )"), r"[A-Za-z0-9._%+-](?<![A-Za-z0-9._%+-][A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{0,63}(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{2,63}){1,4}"),
    (1, ".", r"[0-9](?<![0-9.][0-9])[0-9]{0,2}\.(?:[0-9]{1,3}\.){2}[0-9]{1,3}(?![0-9.])"),
    (2, "", r"[0-9](?<![0-9.,+][0-9])(?:[0-9]{3}[\x20-](?:[0-9]{4}[\x20-]){2}[0-9]{1,7}|[0-9]{12,18})(?![0-9])"),
    (3, "+", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[\x20.-][0-9]{2,4}){2,3}(?![0-9])"),
    (3, "(", r"\([0-9]{3}\)(?<![0-9+.,/-]\([0-9]{3}\))\x20?[0-9]{3}[.\x20-][0-9]{4}(?![0-9.,/-])"),
    (3, "", r"[0-9](?<![0-9+.,/(-][0-9])[0-9]{2}[.\x20-][0-9]{3}[.\x20-][0-9]{4}(?![0-9.,/-])"),
    (4, "", r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    (4, "-", r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    (5, "", r"[A-Z](?<![^\W_][A-Z])[a-zà-ÿ]{1,19}(?<!\bMr)(?<!\bMrs)(?<!\bMs)(?<!\bDr)(?<!\bHerr)(?<!\bFrau)(?<!\bSir)(?:\x20[A-Z]\.)?\x20[A-Z][a-zà-ÿ]{1,24}(?![^\W_])"),
]
PROPOSERS = [(kind, (sign,) if isinstance(sign, str) else sign, re.compile(pattern)) for kind, sign, pattern in PROPOSERS]

# Frequent given names of several countries, in the order of the alphabet.
GIVEN = frozenset(
    """ahmed aisha alan albert alice amanda amy ana andrea andrew angela anna anne anthony antonio barbara benjamin betty brian
    bruno carlos carmen carol caroline catherine charles charlotte chen chloe christian christine claire claudia daniel david deborah
    denis diana diego dorothy edward elena elizabeth emily emma eric erik eva fatima felix fernando florian francisco frank
    gabriel george georg gerhard giovanni hans helen helga henri henry ingrid isabel ivan jack jacques james jan jane jean jennifer jessica
    joan john jonas jorge jose joseph juan julia julie karen karl katharina kevin klaus laura lena leon li linda lisa louis lucas lucia luis
    manuel marco margaret maria marie mark markus martha martin mary matthew michael michel miguel mohamed monica nancy
    natalia nicolas nina olga oliver omar pablo pamela patricia patrick paul paula pedro peter petra philippe pierre rachel rafael
    raj richard robert rosa ruth samuel sandra sara sarah sergio simon sofia sophie stefan stephen susan sven sylvie teresa thomas
    ursula victor wei william wolfgang yusuf""".split()
)
# Top-level domains of mail addresses.
TOP_LEVEL = frozenset("com org net edu gov info io de fr es it nl uk us ca br ru cn jp in ch at be eu".split())
# Capitalised words that are no names.
NO_NAMES = frozenset(
    """the and of in for with from this that these those january february march april may june july august september october november
    december monday tuesday wednesday thursday friday saturday sunday new united north south east west street university
    der die das und le la les el los las""".split()
)
# Words that announce personal data, and words that announce other numbers.
CUES = frozenset(
    """account address bank call card cell contact correo credit dr e-mail email fax fon handy herr frau iban konto kreditkarte mail mobile mr mrs ms name
    nombre nom passport phone reach señor señora sir social ssn tarjeta tel telefon telefono teléfono telephone téléphone visa write""".split()
)
OTHER = frozenset("article chapter figure fig id invoice isbn issn item line number order page pages part price ref section serial sum table total version vol volume".split())
#: the labellers, and what is believed beforehand of the chance that one that votes votes for: on other spans, on personal data
BELIEF = {
    "form": (0.1, 0.95),
    "check digits": (0.1, 0.99),
    "plain digits": (0.02, 0.8),
    "given names": (0.03, 0.8),
    "no names": (0.02, 0.8),
    "domains": (0.3, 0.9),
    "issuers": (0.4, 0.9),
    "cues": (0.6, 0.9),
    "other words": (0.1, 0.7),
    "company": (0.6, 0.9),
}
#: a belief's weight, as a multiple of the number of a kind's spans
WEIGHT = 1.0
LABELLERS = tuple(BELIEF)
_NEAR = 48
_WORD = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an international account number's check digits are right."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The address around each at sign: before it the run of characters that may stand there, from the end of the match before on."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the four patterns' matches in code points, sorted; kind indexes ``KINDS``."""
    found = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(map(octet, m.group().split("."))):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                found.append((3, m.start(), m.end()))
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and the proposals that overlap neither one of them nor an earlier proposal."""
    found, taken = list(base), sorted((s, e) for _, s, e in base)
    proposed = sorted((m.start(), k, m.end()) for k, signs, p in PROPOSERS if any(x in text for x in signs) for m in p.finditer(text))
    at, reach = 0, 0
    for s, k, e in proposed:
        while at < len(taken) and taken[at][0] < e:
            reach = max(reach, taken[at][1])
            at += 1
        if s >= reach:
            found.append((k, s, e))
            reach = e
    return sorted(found)


def ballot(text: str, span: tuple[int, int, int], is_base: bool, beside: bool) -> tuple[tuple[int, ...], list[str], list[str]]:
    """The labellers' votes on a span (1 for, -1 against, 0 none), and the words before and after it."""
    kind, start, end = span
    own = text[start:end]
    before = [w.lower() for w in _WORD.findall(text[max(0, start - _NEAR) : start])][-3:]
    after = [w.lower() for w in _WORD.findall(text[end : end + _NEAR])][:2]
    d = digits_of(own)
    form, check, plain = int(is_base), 0, 0
    issuer = given = no_name = domain = 0
    if kind == 0:
        form = 1 if is_base or "(" in own or "[" in own else 0
        last = re.split(r"[^A-Za-z0-9-]+", own.rstrip(")] "))[-1].lower()
        domain = 1 if last in TOP_LEVEL else -1
        plain = -1 if not is_base and "(" not in own and "[" not in own and last not in TOP_LEVEL else 0
    elif kind == 1:
        check = 1 if all(map(octet, own.split("."))) else -1
    elif kind == 2:
        check = 1 if 13 <= len(d) <= 19 and luhn(d) else -1
        issuer = 1 if d[:1] in "3456" and len(d) in (14, 15, 16, 19) else -1
        plain = -1 if len(set(d)) < 3 else 0
    elif kind == 3:
        form = 1 if is_base or own[0] in "+(" or own.count("-") == 2 else 0
        plain = -1 if len(set(d)) < 3 else 0
    elif kind == 4:
        if own[0].isalpha():
            check = 1 if mod97(own.replace(" ", "")) else -1
        else:
            form, plain = 1, -1 if d[:3] in ("000", "666") or d[3:5] == "00" or d[5:] == "0000" else 0
    else:
        parts = [w.lower() for w in own.replace(".", "").split()]
        given = 1 if parts[0] in GIVEN else -1
        no_name = -1 if NO_NAMES.intersection(parts) or parts[-1] in GIVEN and parts[0] not in GIVEN else 0
    cue = 1 if CUES.intersection(before) else 0
    other = -1 if OTHER.intersection(before[-1:]) or kind != 5 and text[max(0, start - 1) : start] in ("$", "€", "£", "#") else 0
    return (form, check, plain, given, no_name, domain, issuer, cue, other, int(beside)), before, after


def packed(kind: int, votes: tuple[int, ...]) -> int:
    """A kind and votes on it as one number, the votes to base 3."""
    return kind * 3 ** len(LABELLERS) + sum((v + 1) * 3**k for k, v in enumerate(votes))


def unpacked(pattern: int) -> tuple[int, list[int]]:
    return pattern // 3 ** len(LABELLERS), [pattern // 3**k % 3 - 1 for k in range(len(LABELLERS))]


def features(text: str, span: tuple[int, int, int], votes: tuple[int, ...], before: list[str], after: list[str]) -> list[int]:
    """Hashed features of a span: kind, shape, lengths, the words around it, and each labeller's vote."""
    kind, start, end = span
    own = text[start:end]
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "0", re.sub(r"[^\W\d_]", "a", own)))
    names = [f"k{kind}", f"s{kind}{shape}", f"l{kind}{min(len(own) // 4, 8)}", f"d{kind}{min(len(digits_of(own)), 20)}"]
    names += [f"b{w}" for w in before] + [f"a{w}" for w in after]
    # a labeller's vote counts for itself, too, so that a rare kind borrows from the others
    names += [f"v{kind}{k}{v}" for k, v in enumerate(votes) if v] + [f"v{k}{v}" for k, v in enumerate(votes) if v]
    return sorted({zlib.crc32(n.encode()) % DIMENSIONS for n in names})


def estimate(patterns: dict[int, int], rounds: int = 60) -> tuple[dict[int, float], dict[int, np.ndarray]]:
    """Posterior of personal data for each vote pattern, and P(for | class, it votes) by kind as arrays (class, labeller): expectation-maximisation.

    Kinds are estimated apart, as a labeller that knows cards may know nothing of names.  Silence says
    nothing.  ``BELIEF`` starts the rounds, which fixes which hidden class is which, and goes on to count as much as
    ``WEIGHT`` of a kind's spans would, at every size of the corpus: without that, two labellers that
    contradict each other could be believed either way.
    """
    posterior, rates = {}, {}
    belief = np.array(list(BELIEF.values())).T
    for kind in range(len(KINDS)):
        keys = sorted(p for p in patterns if unpacked(p)[0] == kind)
        votes = np.array([unpacked(p)[1] for p in keys]).reshape(-1, len(LABELLERS))
        weight = np.array([patterns[p] for p in keys], float)
        held = 10 + WEIGHT * weight.sum()
        rate, prior, post = belief.copy(), np.array([0.5, 0.5]), np.full(len(keys), -1.0)
        for _ in range(rounds):
            log = np.log(prior)[:, None] + np.log(rate) @ (votes == 1).T + np.log1p(-rate) @ (votes == -1).T
            new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
            done = not len(new) or np.abs(new - post).max() < 1e-9
            post = new
            if done:
                break
            mass = np.stack([weight * (1 - post), weight * post])
            prior = (mass.sum(axis=1) + 1) / (weight.sum() + 2)
            rate = (mass @ (votes == 1) + held * belief) / (mass @ (votes != 0) + held)
        posterior.update(zip(keys, post.tolist()))
        rates[kind] = rate
    return posterior, rates


def fit(rows: list[tuple[list[int], float]], rounds: int = 12, rate: float = 0.3, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on soft labels, the last one the constant; Adagrad over the rows in order."""
    w, g2 = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-6)
    data = [(np.array([*f, DIMENSIONS]), y) for f, y in rows]
    for _ in range(rounds):
        for f, y in data:
            g = 1 / (1 + math.exp(-max(-60.0, min(60.0, float(w[f].sum()))))) - y + ridge * w[f]
            g2[f] += g * g
            w[f] -= rate * g / np.sqrt(g2[f])
    return w


def chances(lists: list[list[int]], weights: np.ndarray) -> list[float]:
    return [1 / (1 + math.exp(-max(-60.0, min(60.0, float(weights[f].sum() + weights[-1]))))) for f in lists]


def proposed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base, kinds, starts, ends, patterns, features) for each row of ``docs``: base spans as text, and all candidates."""
    src = docs.select(F.col(id_col), F.col(text_col).alias("__gl_text"))
    names = [id_col, "base", "kinds", "starts", "ends", "patterns", "features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(1).cast(pa.binary()):
                text = (t.as_py() or b"").decode("utf-8", "replace")
                base = base_spans(text)
                all_ = candidates(text, base)
                held, near = set(base), sorted((s, e) for _, s, e in base)
                votes, hashed, at = [], [], 0
                for span in sorted(all_, key=lambda x: x[1]):
                    while at < len(near) and near[at][1] < span[1] - _NEAR:
                        at += 1
                    others = [x for x in near[at : at + 4] if x != span[1:]]
                    beside = any(s - _NEAR <= span[2] and span[1] - _NEAR <= e for s, e in others)
                    v, before, after = ballot(text, span, span in held, beside)
                    votes.append((span, packed(span[0], v)))
                    hashed.append(features(text, span, v, before, after))
                spans = [s for s, _ in votes]
                for col, x in zip(cols, (listed(base), [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans], [p for _, p in votes], hashed)):
                    col.append(x)
            ints = pa.list_(pa.int32())
            kinds = (pa.string(), ints, ints, ints, ints, pa.list_(ints))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return src.mapInArrow(run, src.selectExpr("*", "'' as base", *(f"array(0) as {c}" for c in names[2:6]), "array(array(0)) as features").drop("__gl_text").schema)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def trained(held: DataFrame, sample: int = SAMPLE_SPANS) -> tuple[np.ndarray, dict[int, float], dict[int, np.ndarray]]:
    """The classifier's weights, the posteriors of all vote patterns in ``held`` and the labellers' rates."""
    each = held.select(F.explode(F.arrays_zip("patterns", "features")).alias("c")).select(F.col("c.patterns").alias("pattern"), F.col("c.features").alias("f"))
    counted = {r["pattern"]: r["n"] for r in each.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    posterior, rate = estimate(counted)
    # candidates that look alike are one; of them those of the smallest hashes
    some = each.distinct().withColumn("h", F.xxhash64("pattern", "f")).orderBy("h", "pattern", "f").limit(sample).collect()
    return fit([(list(r["f"]), posterior[r["pattern"]]) for r in some]), posterior, rate


def judged(held: DataFrame, weights: np.ndarray, id_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans, n_added) from the table of ``proposed``."""
    names = [id_col, "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, said, added = ([], [], [], []), [], []
            for base, kinds, starts, ends, hashed in zip(*(b.column(c).to_pylist() for c in ("base", "kinds", "starts", "ends", "features"))):
                own = set(base.split(",")) if base else set()
                spans = list(zip(kinds, starts, ends))
                is_base = [f"{KINDS[k]}:{s}:{e}" in own for k, s, e in spans]
                kept = [x for x, mine, p in zip(spans, is_base, chances(hashed, weights)) if mine or p >= threshold]
                for k in range(BASE):
                    n[k].append(sum(mine and x[0] == k for x, mine in zip(spans, is_base)))
                said.append(listed(kept))
                added.append(len(kept) - len(own))
            cols = [*(pa.array(x, pa.int64()) for x in n), b.column("base"), pa.array(said, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(id_col), *cols], names)

    schema = held.select(id_col).schema
    for c in names[1:5]:
        schema = schema.add(c, "long")
    return held.drop("patterns").mapInArrow(run, schema.add("base", "string").add("spans", "string").add("n_added", "long"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_SPANS, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans, n_added) for each row of ``docs``.

    ``base`` and ``spans`` list kind:start:end by kind and start, in code points.  A null text is an
    empty one, in which nothing is found.  Repeated rows are scanned alike, null ids are ids, very long texts are
    scanned whole, bytes that are no UTF-8 count as the replacement character, and other columns are not read.
    Where candidates overlap the base span stays, then the one that begins first.  Without candidates
    there is nothing to learn and nothing is added.
    """
    held = cut(proposed(docs.select(F.col(id_col).alias("__gl_id"), text_col), "__gl_id", text_col))
    weights, _, _ = trained(held, sample)
    return judged(held, weights, "__gl_id", threshold).withColumnRenamed("__gl_id", id_col)


def op11_personal_data(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
