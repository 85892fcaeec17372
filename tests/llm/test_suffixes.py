"""Repeated strings against plain sorting, counting of all strings, and the odd rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame, SparkSession

from pixelseries.llm import suffixes


def brute(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans and digest of what is left, by counting every string."""
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=120).map(str.encode), st.integers(1, 50))
def test_two_stages_sort_suffixes(text: bytes, depth: int) -> None:
    n = len(text)
    order = suffixes.two_stage_order(text, [(0, n)] if n else [], n + 1).tolist()
    assert order == sorted(range(n), key=lambda i: text[i:])
    shared = suffixes.common_prefixes(text, np.array(order, np.int64), depth)
    for k in range(1, n):
        a, b = text[order[k - 1] :][:depth], text[order[k] :][:depth]
        assert shared[k] == next((m for m, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab", max_size=40).map(str.encode), st.booleans()), min_size=1, max_size=8), st.integers(2, 9))
def test_starts_that_repeat(regions: list[tuple[bytes, bool]], length: int) -> None:
    many = np.array([m for _, m in regions])
    found = suffixes.repeated_starts([r for r, _ in regions], np.arange(len(regions)), np.zeros(len(regions), np.int64), many, length)
    counts: Counter = Counter()
    for r, m in regions:
        for i in range(len(r) - length + 1):
            counts[r[i : i + length]] += 1 + m
    assert set(zip(*(x.tolist() for x in found))) == {(k, i) for k, (r, m) in enumerate(regions) if not m for i in range(len(r) - length + 1) if counts[r[i : i + length]] > 1}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdefgh", max_size=300).map(str.encode))
def test_every_stretch_has_an_anchor_and_pieces_do_not_matter(text: bytes) -> None:
    cores, regions = suffixes.Rolling(1), suffixes.Rolling(2)
    whole = [x.tolist() for x in suffixes.anchors(text, cores, regions, 20, 9)]
    assert sorted(zip(*whole)) == sorted(zip(*(x.tolist() for x in suffixes.anchors(text, cores, regions, 20, 9, piece=13))))
    covered = {p + m for p, more in zip(*whole[2:]) for m in range(more + 1)}
    assert all(any(i <= p <= i + 11 for p in covered) for i in range(len(text) - 19))


def corpus(seed: int, n: int) -> list[str | None]:
    """Texts of few letters that share passages, some periodic, some equal, some odd."""
    rnd = random.Random(seed)
    some = lambda low, high: " ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(low, high)))
    passages = [some(5, 14) for _ in range(6)]
    texts: list[str | None] = []
    for _ in range(n):
        parts = [some(0, 12)]
        for _ in range(rnd.randint(0, 3)):
            parts += [rnd.choice(passages)[rnd.randint(0, 3) :], some(0, 6)]
        parts += ["ab" * rnd.randint(1, 60)] * (rnd.random() < 0.1) + ["x" * rnd.randint(1, 120)] * (rnd.random() < 0.1)
        texts.append(" ".join(parts))
    return texts + texts[: n // 8] + ["", None, "é漢🙂" * 20] * 2


@pytest.mark.parametrize(("core", "limit"), [(9, 2048), (20, 3)])
def test_what_is_removed_is_what_repeats(spark: SparkSession, core: int, limit: int) -> None:
    """The low limit splits groups of regions again and again."""
    texts = corpus(core, 120)
    rows = suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=24, core=core, limit=limit).collect()
    want = brute([(t or "").encode() for t in texts], 24)
    assert sum(w[1] for w in want) > 5000 and [tuple(r)[1:] for r in sorted(rows)] == want


def test_odd_rows(odd: DataFrame, empty: DataFrame) -> None:
    rows = suffixes.remove_repeats(odd).collect()
    texts = [(r.doc_id, (r.text or "").encode()) for r in odd.collect()]
    want = [(i, *b) for (i, _), b in zip(texts, brute([t for _, t in texts], 400))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert any(r.n_removed for r in rows) and suffixes.remove_repeats(empty).collect() == []
