"""Personal data and secrets by weak supervision.

Labelers propose spans and vote on them: regular expressions with their checks,
a gazetteer of given names and mail hosts, the words around a span, its shape.
A span has a vote from each labeler: 1 for personal, 0 against, or none; what
looks like a number of a kind but fails its check is a span that the rule votes
against. Expectation maximisation over the counted vote patterns estimates,
without labels, how reliable each labeler is and how likely each pattern is
personal data. With those as soft labels a logistic classifier is trained on
features of the spans and their surroundings; it decides over spans that no rule
is certain about. Spans that the four base rules find always stay.

Texts are read once: candidates, votes and features are written as a table
with one row a document, and what follows reads that table alone.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, map_batches, written

#: Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone", "name", "secret")
BASE = 4
#: Labelers, in the order of a span's votes.
LABELERS = ("rule", "loose", "gazetteer", "before", "after", "shape")
FEATURES = 1 << 10
#: Spans that the classifier is fitted on, at most, picked by a hash; the reliabilities come from all spans.
SAMPLE_SPANS = 20_000

EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Further candidates, more loosely written: (kind, pattern).
LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{1,63}){1,8}", re.I)),
    ("phone", re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
)
#: Given names that are frequent in English, French, German and Spanish.
GIVEN = frozenset("James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Jean Pierre Michel Marie Nathalie Isabelle Hans Peter Klaus Stefan Ursula Monika Sabine Carlos Juan Luis Carmen Ana".split())
#: Two capitalised words that a name of the gazetteer, a title or the like introduces.
INTRODUCED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|[Aa]uthor:|[Ss]igned|[Dd]ear|[Cc]ontact:?)\.? ([A-Z][a-z]{1,20} [A-Z][a-z]{1,20})\b")
TITLE = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame)\.? )\Z")
#: What secrets are called, and a value that is assigned to such a word.
SECRET_WORDS = ("token", "secret", "passw", "api_key", "api-key", "apikey", "access_key", "credential", "private_key")
ASSIGNED = re.compile(r"(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|credentials?|private[_-]?key)[\"']?\s{0,3}(?:=|:|=>)\s{0,3}[\"']?([A-Za-z0-9_+/.=-]{8,200})", re.I)
LONG_RUN = re.compile(r"[A-Za-z0-9_+/-]{24,200}")
HINTS = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|to|reach)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|addr|login|from)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|pay|payment|number|no)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|contact|ring)\b", re.I),
    "name": re.compile(r"\b(?:by|author|name|dear|signed|mr|mrs|dr)\b", re.I),
    "secret": re.compile(r"(?:token|secret|passw|api[_-]?key|access[_-]?key|credential|bearer|auth)", re.I),
}
AGAINST = {
    "email": re.compile(r"\b(?:example|version)\b", re.I),
    "ip": re.compile(r"\b(?:version|release|section|v)\b", re.I),
    "card": re.compile(r"\b(?:id|isbn|token|serial|key)\b", re.I),
    "phone": re.compile(r"\b(?:isbn|id|version|token)\b", re.I),
    "name": re.compile(r"\b(?:street|license|avenue|saint)\b", re.I),
    "secret": re.compile(r"(?:sha-?[0-9]|md5|commit|checksum|digest|uuid|https?:|/)", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the base rule: from each @, back over the local part to the last match, and on."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        host = EMAIL_HOST.match(text, at) if start < at else None
        if host:
            yield start, host.end()
            floor = host.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", floor)


def ruled_spans(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(start, kind, end, whether the checks hold) of what the base patterns match."""
    if "@" in text:
        for a, b in emails(text):
            yield a, 0, b, True
    if "." in text:
        for m in IP.finditer(text):
            yield m.start(), 1, m.end(), all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19:
                yield m.start(), 2, m.end(), luhn(digits)
    if "+" in text:
        for m in PHONE.finditer(text):
            yield m.start(), 3, m.end(), 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the base rules, in order."""
    return sorted((a, k, b) for a, k, b, holds in ruled_spans(text) if holds)


def entropy(span: str) -> float:
    """Bits a character."""
    n = len(span)
    return -sum(c / n * math.log2(c / n) for c in Counter(span).values())


def more_spans(text: str, given: re.Pattern) -> Iterator[tuple[int, int, int, int]]:
    """(start, kind, end, the rule's vote) of further candidates, from every labeler that can propose some."""
    for kind, pattern in LOOSE:
        if kind == "phone" or "at" in text:
            for m in pattern.finditer(text):
                yield m.start(), KINDS.index(kind), m.end(), -1
    for m in given.finditer(text):
        yield m.start(), 4, m.end(), -1
    for m in INTRODUCED.finditer(text):
        yield m.start(1), 4, m.end(1), -1
    lower = text.lower()
    if any(w in lower for w in SECRET_WORDS):
        for m in ASSIGNED.finditer(text):
            yield m.start(1), 5, m.end(1), 1
    for m in LONG_RUN.finditer(text):
        span = m[0]
        if any(c.isdigit() for c in span) and any(c.isalpha() for c in span):
            yield m.start(), 5, m.end(), -1


def candidates(text: str, given: re.Pattern) -> list[tuple[int, int, int, bool, int]]:
    """(start, kind, end, by a base rule, the rule's vote), in order; further candidates overlap neither base spans nor each other."""
    base, loose = [], []
    for a, k, b, holds in ruled_spans(text):
        base.append((a, k, b, True, 1)) if holds else loose.append((a, k, b, 0))
    loose += more_spans(text, given)
    out, taken = [], sorted((a, b) for a, _, b, *_ in base)
    starts = [a for a, _ in taken]
    end = 0
    # Of overlapping candidates the first, then one with a rule's vote, then the longest.
    for a, k, b, rule in sorted(set(loose), key=lambda x: (x[0], -x[3], -x[2], x[1])):
        near = bisect.bisect_left(starts, b)
        if a >= end and not any(y > a for _, y in taken[max(0, near - 4) : near]):
            out.append((a, k, b, False, rule))
            end = b
    return sorted(base + out)


def votes(text: str, a: int, k: int, b: int, rule: int, names: frozenset[str]) -> list[int]:
    """By labeler: 1, 0, or -1 for no vote."""
    kind, span = KINDS[k], text[a:b]
    left, right = text[max(0, a - 40) : a], text[b : b + 40]
    digits = sum(c.isdigit() for c in span)
    gazetteer = -1
    if kind == "name":
        gazetteer = 1 if span.split(" ")[0] in names else 0
    elif kind == "email":
        gazetteer = 1 if re.search(r"(?:mail|\.com|\.org|\.net|\.edu)", span, re.I) else -1
    before = 1 if HINTS[kind].search(left) or (kind == "name" and TITLE.search(left)) else 0 if AGAINST[kind].search(left) else -1
    after = 1 if HINTS[kind].search(right) else 0 if AGAINST[kind].search(right) else -1
    if kind == "secret":
        shape = 1 if digits and entropy(span) >= 3 else 0
    else:
        shape = {"email": -1, "name": 1 if span.istitle() else 0}.get(kind, 0 if len(set(span)) <= 2 else 1 if digits >= 0.5 * len(span) else -1)
    edge = (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
    return [rule, 0 if edge else 1, gazetteer, before, after, shape]


def features(text: str, a: int, k: int, b: int, said: list[int]) -> list[int]:
    """Hashed: the kind, the labelers' votes, the span's shape, and the words around it."""
    import zlib

    shape = re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", re.sub(r"[0-9]", "0", text[a:b][:40])))
    words = [f"l:{w.lower()}" for w in text[max(0, a - 40) : a].split()[-3:]] + [f"r:{w.lower()}" for w in text[b : b + 40].split()[:3]]
    return sorted({zlib.crc32(f"{k}|{x}".encode("utf-8", "replace")) % FEATURES for x in ("", f"s:{shape}", *words, *(f"v:{i}:{v}" for i, v in enumerate(said) if v >= 0))})


#: What is known of the rules with checks: true numbers pass them, and of random ones one in ten passes the digits' check.
RULE_HIT, RULE_FALSE = 0.98, 0.2


def maximise(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, checked: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Reliabilities by expectation maximisation over counted vote patterns.

    Returns P(vote 1 | personal), P(vote 1 | not) by labeler, and the share of
    personal spans. checked: the first labeler's votes are of rules with checks,
    so its reliabilities stay within RULE_HIT and RULE_FALSE; without that bound
    labelers that vote 1 on everything would outvote a failed check.
    """
    v = np.array([p for p, _ in patterns], float)
    n = np.array([c for _, c in patterns], float)
    voted = v >= 0
    # It starts from the first labeler, the rules with checks, and where that has no vote from the mean of the others.
    post = np.clip(np.where(voted[:, 0], v[:, 0], np.where(voted, v, 0.5).mean(axis=1)), 0.05, 0.95)
    hit, false, share = np.full(v.shape[1], 0.8), np.full(v.shape[1], 0.3), 0.5
    for _ in range(rounds):
        w = post * n
        share = float(np.clip(w.sum() / n.sum(), 0.01, 0.99))
        ones = np.where(voted, v, 0)
        hit = (w @ ones + 4) / (w @ voted + 5)
        false = ((n - w) @ ones + 1) / ((n - w) @ voted + 4)
        hit, false = np.clip(hit, 0.5, 0.999), np.clip(false, 0.001, 0.9)
        if checked:
            hit[0], false[0] = max(hit[0], RULE_HIT), min(false[0], RULE_FALSE)
        post = posterior(v, hit, false, share)
    return hit, false, share


def posterior(v: np.ndarray, hit: np.ndarray, false: np.ndarray, share: float) -> np.ndarray:
    v = np.asarray(v, float)
    odds = np.where(v > 0, np.log(hit / false), np.where(v == 0, np.log((1 - hit) / (1 - false)), 0.0)).sum(axis=1) + np.log(share / (1 - share))
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def train(rows: list[tuple[list[int], float]], rounds: int = 200, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights (the last is the bias) for hashed features and soft labels."""
    w = np.zeros(FEATURES + 1)
    if not rows:
        return w
    owner = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    which = np.concatenate([np.array(f, int) for f, _ in rows])
    y = np.array([p for _, p in rows])
    square = np.full(FEATURES + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(owner, w[which], len(rows)) + w[-1]
        off = 1 / (1 + np.exp(-z)) - y
        g = np.append(np.bincount(which, off[owner], FEATURES), off.sum()) / len(rows) + decay * w
        square += g * g
        w -= rate * g / np.sqrt(square)
    return w


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_spans: int = SAMPLE_SPANS, threshold: float = 0.5, names: frozenset[str] = GIVEN) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, found.

    found is an array of (kind, start, end, probability); spans the same as text.
    Counts by kind and base_sha256 cover the base rules' spans alone, n_spans all.
    names is the gazetteer of given names. Offsets count code
    points. Null counts as empty; repeated rows are scanned each.
    """
    spark = docs.sparkSession
    span = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("base", T.BooleanType()), T.StructField("votes", T.ArrayType(T.IntegerType())), T.StructField("features", T.ArrayType(T.IntegerType()))])
    kind = T.StructField("doc_id", docs.schema[id_col].dataType)
    scanned = T.StructType([kind, T.StructField("spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("a", pa.int32()), ("k", pa.int32()), ("b", pa.int32()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))]))

    given = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(names))) + r") [A-Z][a-z]{2,20}\b") if names else re.compile(r"(?!)")

    def scan(text: str) -> list[dict]:
        found = [(a, k, b, own, votes(text, a, k, b, rule, names)) for a, k, b, own, rule in candidates(text, given)]
        return [{"a": a, "k": k, "b": b, "base": own, "votes": said, "features": features(text, a, k, b, said)} for a, k, b, own, said in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scan(x) if x else [] for x in batch.column(1).to_pylist()], arrow)], scanned.names)

    table = written(map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, scanned), "spans")
    one = table.select("doc_id", F.explode("spans").alias("s"))
    counted = one.groupBy("s.votes").count().collect()  # 3 to the number of labelers at most
    patterns = sorted((tuple(r.votes), r["count"]) for r in counted)
    hit, false, share = maximise(patterns, checked=True) if patterns else (np.full(len(LABELERS), 0.8), np.full(len(LABELERS), 0.2), 0.5)
    total = sum(c for _, c in patterns)
    part = min(1.0, sample_spans / max(total, 1))
    picked = one.filter(F.pmod(F.xxhash64("doc_id", "s.a"), F.lit(1 << 20)) < part * (1 << 20)).select("s.votes", "s.features").limit(2 * sample_spans).collect()
    sure = posterior([r.votes for r in picked], hit, false, share) if picked else []
    weights = train([(r.features, float(p)) for r, p in sorted(zip(picked, sure), key=lambda x: (x[0].features, x[0].votes))])
    model = Shared(spark, weights)

    def describe(spans: list[dict]) -> tuple:
        w = model.value
        kept = []
        for s in spans:
            p = float(1 / (1 + np.exp(-np.clip(w[s["features"]].sum() + w[-1], -30, 30))))
            if s["base"] or p >= threshold:
                kept.append((s["a"], s["k"], s["b"], s["base"], p))
        base = [x for x in kept if x[3]]
        text = lambda xs: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in xs)
        counts = [sum(x[1] == k for x in base) for k in range(BASE)]
        return *counts, hashlib.sha256(text(base).encode()).hexdigest(), text(kept), len(kept), [{"kind": KINDS[k], "start": a, "end": b, "probability": p} for a, k, b, _, p in kept]

    found = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("probability", T.DoubleType())])
    out = T.StructType([kind, *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:BASE]], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType()), T.StructField("found", T.ArrayType(found))])
    kinds = [pa.int64()] * BASE + [pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [describe(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([g[i] for g in got], t) for i, t in enumerate(kinds)]], out.names)

    return map_batches(table, score, out)
