"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans, expectation-maximisation
estimates how reliable they are, and a span classifier trained on the estimated labels decides which candidates become spans.

Base spans (strict patterns with their checks) always stay. Candidates are the base spans and looser shapes: spelt or
bracketed "at" addresses, any run of hexadecimal groups and colons, card-length numbers that fail the check digit or are parted
by other signs, any run of digit groups of a phone number's length, phone numbers run together with what follows. A run that
goes on with further groups is taken as a whole. Each labeler says yes, no or nothing. Votes
are counted by pattern over all documents, so the estimation sees a table whose size the labelers bound; no labeler's
reliability is given. The classifier does not see the votes: its features are the span's shape, first signs, length, check
digit and parting signs, and the words to its left and right. It is fitted on at most `most` candidates, chosen by a hash,
with the estimated chances as labels, and decides every candidate that is not a base span.

A looser shape that meets a base span gives way to it, so a French phone number with dots whose first four groups read as an
IP address stays that.

Null and empty texts have no spans. Very long texts are searched whole; the context of a span is CONTEXT signs to each side,
as the method has it. Equal votes (a chance of 0.5) count as half a label. Every row is searched for itself, so null or repeated
ids and repeated rows stay. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from ipaddress import AddressValueError, IPv6Address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelseries.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.6
LABELERS = ("check", "gazetteer", "context_for", "context_against", "named", "shape", "alone", "company")
#: Spans that a labeler's reliability is taken to rest on beforehand: yes, no and nothing for personal data, and for the rest.
#: The kind's own test is needed, so its no says more than its yes; context speaks seldom; forms are alike in both.
BEFOREHAND = {
    "check": ((48.0, 1.0, 1.0), (20.0, 28.0, 2.0)), "gazetteer": ((8.0, 1.5, 0.5), (3.0, 6.5, 0.5)), "shape": ((8.0, 1.5, 0.5), (5.0, 4.5, 0.5)), "alone": ((8.0, 1.5, 0.5), (5.0, 4.5, 0.5)),
    **dict.fromkeys(("context_for", "context_against", "named", "company"), ((1.5, 0.25, 8.25), (0.5, 1.25, 8.25))),
}
MAX_TRAIN = 10_000  # candidates that the classifier is fitted on
DIMENSIONS = 512  # of hashed features
CONTEXT = 64
NEAR = 400  # signs within which another base span is company

# fixed values: the contract's patterns, written so that every text is read in linear time
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")  # possessive: no digit is looked at twice
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

AT = re.compile(r" ?[\[({<] ?at ?[\])}>] ?| at (?=[A-Za-z0-9-]+(?:\.| ?[\[({<] ?dot ?[\])}>] ?| dot )[A-Za-z])", re.IGNORECASE)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[\[({<] ?dot ?[\])}>] ?| dot )[A-Za-z0-9-]+)+", re.IGNORECASE)
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
GROUPS = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{5,39}+(?![0-9A-Za-z:])")
PARTED = re.compile(r"(?<![0-9A-Za-z._/-])[0-9]{4}([./_\u2013\u00b7])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])")
DIAL = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
DIGIT_GROUPS = re.compile(r"(?<![0-9A-Za-z+.,:/_(-])(?<![0-9][ ./-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?: ?[ ./-] ?[0-9]{2,8}){1,5}+(?![0-9A-Za-z]|[ .,:/-] ?[0-9])")

# fixed values: common generic top domains (any two letters are taken for a country's), calling codes by their first digits
# (ITU-T E.164), words that announce the kinds in the languages of the corpus
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz name pro dev app io ai co me tv xyz online site cloud blog shop store tech".split())
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
THREE_DIGIT_CODES = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
FOR = {
    "email": "mail email e-mail contact write reach address correo escriba courriel adresse kontakt schreiben".split(),
    "ip": "ip ipv6 ipv4 host server address addr node client gateway dns router ping serveur servidor rechner".split(),
    "card": "card cards visa mastercard amex credit debit payment pay karte kreditkarte carte tarjeta pago paiement".split(),
    "phone": "phone telephone tel call fax mobile cell ring reach telefon anrufen appel appeler llame telefono movil".split(),
}
AGAINST = frozenset("version section release chapter isbn token license article order invoice part serial sku model item build id number no ref reference artikel numero pedido facture".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain: each @ has one possible local part, the run before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Every four numbers in a row of a dotted chain."""
    for m in NUMBERS.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, in order."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    found += [(a, 1, b) for a, b in ips(text)]
    for m in CARD.finditer(text):
        if 12 <= len(m.group()) and 12 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return sorted(found)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the looser shapes that meet no base span, leftmost first for each kind."""
    found: list[tuple[int, int, int]] = []
    for m in AT.finditer(text):
        start = m.start()
        while start and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, m.end()) if start < m.start() else None
        if domain:
            found.append((start, 0, domain.end()))
    if ":" in text:
        found += [(m.start(), 1, m.end()) for m in GROUPS.finditer(text) if m.group().count(":") > 1 and any(map(str.isalnum, m.group()))]
    for m in CARD.finditer(text):
        if 12 <= len(m.group()) and 12 <= len(d := digits_of(m.group())) <= 19 and not luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 2, m.end()) for m in PARTED.finditer(text)]
    dialled = [(m.start(), 3, m.end()) for m in DIAL.finditer(text)] if "+" in text else []
    found += dialled + clear([(m.start(), 3, m.end()) for m in DIGIT_GROUPS.finditer(text) if 8 <= len(digits_of(m.group())) <= 13], dialled)
    out: list[tuple[int, int, int]] = []
    last = [0] * len(KINDS)
    for a, k, e in clear(sorted(found), base):
        if a >= last[k]:
            out.append((a, k, e))
            last[k] = e
    return out


def clear(spans: list[tuple[int, int, int]], of: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that meet none of the others, which are in order."""
    if not of:
        return spans
    starts, ends, highest = [x[0] for x in of], [], 0
    for x in of:
        highest = max(highest, x[2])
        ends.append(highest)
    return [s for s in spans if not (k := bisect_left(starts, s[2])) or ends[k - 1] <= s[0]]


def checked(span: str, kind: int, d: str) -> bool:
    """The kind's own test: a letter domain, numbers in range, the check digit, a numbering plan."""
    if kind == 0:
        return re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]}> "))[-1].isalpha()
    if kind == 1:
        return sixth_version(span) if ":" in span else len(set(span.split("."))) > 2
    if kind == 2:
        return luhn(d)
    return 9 <= len(d) <= 13 and len(set(d)) > 2 and (span[0] == "+" or national(span, d))


def sixth_version(span: str) -> bool:
    try:
        return bool(IPv6Address(span).packed)
    except AddressValueError:
        return False


def national(span: str, d: str) -> bool:
    """Whether digits follow a common numbering plan: a trunk zero and an area, three and seven, or nine by the first digit."""
    groups = tuple(map(len, re.findall("[0-9]+", span)))
    if d[0] == "0":
        return d[1] != "0" and 9 <= len(d) <= 12 and groups[0] <= 5
    return groups == (3, 3, 4) and d[0] != "1" or len(d) == 9 and d[0] in "6789" and groups in ((3, 3, 3), (3, 2, 2, 2), (2, 3, 2, 2))


def listed(span: str, kind: int, d: str) -> bool:
    if kind == 0:
        top = re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]}> "))[-1].lower()
        return top in TOP_DOMAINS or len(top) == 2 and top.isalpha()
    if kind == 1:
        return span[:1] in "23" or span[:2].lower() in ("fc", "fd", "fe") if ":" in span else 0 < int(span.split(".")[0].lstrip("0") or 0) < 240
    if kind == 2:  # issuers' first digits
        return d[0] == "4" or d[:2] in ("30", "34", "35", "36", "37", "38", "50", "56", "57", "58", "62", "64", "65") or "51" <= d[:2] <= "55" or "2221" <= d[:4] <= "2720" or d[:4] == "6011"
    if span[0] == "+":
        return d[0] in "17" or d[:2] in TWO_DIGIT_CODES or d[:2] in THREE_DIGIT_CODES
    return d[0] not in "01" or d[0] == "0" and len(d) >= 10


def around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The lower-case words to the left, nearest first, and to the right."""
    left, right = (re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", x.lower()) for x in (text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]))
    return left[::-1], right


def votes(text: str, start: int, kind: int, end: int, company: bool) -> str:
    """The kind, and one character a labeler: 1 yes, 0 no, - nothing."""
    span, d = text[start:end], digits_of(text[start:end])
    left, right = around(text, start, end)
    near = {*left[1:4], *right[:1]}  # the word just before is another labeler's, so that no word votes twice
    parting = {c for c in span if not c.isalnum()}
    shape = {0: len(span) <= 80 and ".." not in span, 1: len(span) >= 7, 2: len(d) in (15, 16) and len(parting) < 2, 3: 9 <= len(d) <= 12}[kind]
    glued = start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum()
    said = [
        "1" if checked(span, kind, d) else "0",
        "1" if listed(span, kind, d) else "0",
        "1" if near & set(FOR[KINDS[kind]]) else "-",
        "0" if near & AGAINST else "-",
        "1" if left and left[0] in FOR[KINDS[kind]] else "0" if left and left[0] in AGAINST else "-",
        "1" if shape else "0",
        "0" if glued else "1",
        "1" if company else "-",
    ]
    return f"{kind}{''.join(said)}"


def features(text: str, start: int, kind: int, end: int) -> list[int]:
    """Hashed features of a span: what it looks like and what stands beside it."""
    span, d = text[start:end], digits_of(text[start:end])
    shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "9", span))
    left, right = around(text, start, end)
    said = [
        "", f"length {min(len(span) // 4, 12)}", f"digits {min(len(d), 20)}", f"first {d[:1]}", f"two {d[:2]}", f"check {checked(span, kind, d)}", f"listed {listed(span, kind, d)}",
        f"parting {''.join(sorted({c for c in span if not c.isalnum()}))}", f"end {span[-3:].lower() if kind == 0 else ''}", f"left {text[start - 1 : start] if start else '^'}", f"right {text[end : end + 1]}",
        *(f"gram {shape[k : k + 3]}" for k in range(min(len(shape) - 2, 12))), *(f"before {w}" for w in left[:3]), *(f"after {w}" for w in right[:1]),
    ]
    return sorted({zlib.crc32(f"{KINDS[kind]} {x}".encode()) % DIMENSIONS for x in said})


def estimate(patterns: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """Dawid and Skene's model by expectation-maximisation, for each kind: the chance that a pattern's spans are personal
    data. Every labeler has a chance of yes, no and nothing for either class, all of which are estimated; BEFOREHAND gives
    where they start and counts as so many spans."""
    out = {}
    for kind in sorted({p[0] for p in patterns}):
        own = sorted(p for p in patterns if p[0] == kind)
        n = np.array([patterns[p] for p in own], float)
        said = np.array([[[c == v for v in "10-"] for c in p[1:]] for p in own], float)  # pattern, labeler, outcome
        start = np.array([BEFOREHAND[name] for name in LABELERS]).swapaxes(0, 1)  # class, labeler, outcome
        chance = start / start.sum(axis=2, keepdims=True)
        prior = 0.5
        for _ in range(rounds):
            odds = np.log(prior / (1 - prior)) + (said * np.log(chance[0] / chance[1])).sum(axis=(1, 2))
            q = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
            prior = float(np.clip((n @ q + 1) / (n.sum() + 2), 0.01, 0.99))
            counts = np.stack([np.tensordot(n * w, said, 1) for w in (q, 1 - q)]) + start
            chance = counts / counts.sum(axis=2, keepdims=True)
        out |= dict(zip(own, q.tolist()))
    return out


def train_classifier(rows: list[list[int]], chance: np.ndarray, ridge: float = 0.1, rounds: int = 12) -> np.ndarray:
    """Logistic regression on the estimated labels by Newton's method."""
    x = np.zeros((len(rows), DIMENSIONS))
    for k, r in enumerate(rows):
        x[k, r] = 1
    w = np.zeros(DIMENSIONS)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(DIMENSIONS)
        w += np.linalg.solve(h, x.T @ (chance - p) - ridge * w)
    return w


def classify(w: np.ndarray, row: list[int]) -> float:
    return float(1 / (1 + np.exp(-np.clip(w[row].sum(), -30, 30))))


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = "doc_id long, base string, n_email long, n_ip long, n_card long, n_phone long, loose array<string>, patterns array<string>, features array<array<int>>"


def candidates(docs: DataFrame) -> DataFrame:
    """Of each row: base spans and their counts, loose spans (kind:start:end), and votes and features of these, then of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                loose = loose_spans(text, base)
                places = [a for a, _, _ in base]
                every = [*loose, *base]
                near = [bisect_left(places, a + NEAR) - bisect_left(places, a - NEAR) - (k >= len(loose)) > 0 for k, (a, _, _) in enumerate(every)]
                said = [votes(text, *s, c) for s, c in zip(every, near)]
                kinds = [k for _, k, _ in base]
                rows.append((spell(base), *(kinds.count(k) for k in range(4)), [spell([s]) for s in loose], said, [features(text, *s) for s in every]))
            kinds = (pa.string(), *[pa.int64()] * 4, pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], [f.split()[0] for f in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def train(found: DataFrame, most: int = MAX_TRAIN) -> np.ndarray | None:
    """The classifier's weights. Reads the table of patterns (at most 4 kinds times 3 ** 8) and `most` candidates to the driver."""
    each = found.where(F.size("patterns") > 0).select(F.explode(F.arrays_zip("patterns", "features")).alias("c")).select("c.patterns", "c.features")
    patterns = {r[0]: r[1] for r in each.groupBy("patterns").count().collect()}
    if not patterns:
        return None
    chance = estimate(patterns)
    sample = each.orderBy(F.xxhash64("patterns", "features"), "patterns", "features").limit(most).collect()
    return train_classifier([r[1] for r in sample], np.array([chance[r[0]] for r in sample]))


def personal_data(docs: DataFrame, accept: float = ACCEPT, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans (base and added), n_added."""
    found = stored(candidates(docs), "candidates")
    weights = train(found, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, spans, added = [], [], []
            for base, loose, rows in zip(*(b.column(k).to_pylist() for k in (5, 6, 7))):
                digest.append(hashlib.sha256(base.encode()).hexdigest())
                new = [s for s, row in zip(loose, rows) if classify(weights, row) >= accept]
                every = [s.split(":") for s in [*filter(None, base.split(",")), *new]]
                spans.append(spell(sorted((int(a), KINDS.index(k), int(e)) for k, a, e in every)))
                added.append(len(new))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "loose", "features")
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
