"""Hard negatives and whitening against dense sums, and rows that are odd."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession

from pixelseries.llm import hard_negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, score double, row long, x string"


def table_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """With extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], label, 0.5, 1, "x") for i, v, label in rows], SCHEMA)


def brute_negatives(rows: list[tuple]) -> list[tuple]:
    """By all scores."""
    use = [(i, np.floor(np.array(v, np.float32).astype(float) * 256), (l + 1) % 10 if i is not None and i % 7 == 0 else l) for i, v, l in rows if l is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    dims = max((len(v) for _, v, _ in use), default=0)
    x = np.array([np.pad(v, (0, dims - len(v))) for _, v, _ in use]).reshape(len(use), dims).astype(np.int64)
    order = lambda row: (-row[0], row[1] is None, row[1] or 0, row[2])
    out = []
    for a, (i, _, label) in enumerate(use):
        if i is None or i % 50:
            continue
        scores = (x @ x[a]).tolist()
        positives = sorted(((scores[b], j, b) for b, (j, _, l) in enumerate(use) if l == label and b != a), key=order)[:5]
        for s, j, _ in positives:
            fits = sorted(((scores[b], m, b) for b, (m, _, l) in enumerate(use) if l != label and 50 * s <= 100 * scores[b] <= 95 * s), key=order)[:3]
            out += [(i, j, k + 1, m, s, t) for k, (t, m, _) in enumerate(fits)]
    return out


def key(row: tuple) -> tuple:
    return tuple((v is None, v or 0) for v in row)


def vectors(seed: int, n: int, d: int = 12, spread: float = 0.3) -> list[tuple]:
    """Clustered, of different lengths, with copies and ties."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, d))
    rows = [(k, (centres[k % 8] + spread * rng.standard_normal(d)) * rng.choice([0.2, 0.5, 1]), int(rng.integers(0, 4))) for k in range(n)]
    copy = rows[3][1]
    return [(k, copy if k % 9 == 0 else v, label) for k, v, label in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_are_those_of_all_scores(spark: SparkSession, seed: int) -> None:
    rows = vectors(seed, 400)
    got = hard_negatives.hard_negatives(table_of(spark, rows), bucket=32, a_task=128, block=3)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_negatives(rows), key=key)


def test_odd_vectors(spark: SparkSession) -> None:
    """Nulls, no numbers, other lengths, repeated anchors, null ids and huge entries."""
    rows = vectors(7, 60, 4) + [(50, [0.5, 0.5, 0, 0], 1)] * 3 + [(None, [0.5, 0.4, 0, 0], 1), (None, [0.5, 0.4, 0, 0], 2), (100, [0.5, 0.1], 2), (150, [], 1), (200, None, 1), (250, [0.1, None, 0, 0], 1), (300, [0.1, float("nan"), 0, 0], 1), (350, [0.1, float("inf"), 0, 0], 1), (400, [0.1, 0.2, 0, 0], None)]
    huge = [(450, [3e38, 0, 0, 0], 1)]  # its scores would not fit a long: no part
    got = hard_negatives.hard_negatives(table_of(spark, rows + huge)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_negatives(rows), key=key) and len(got) > 10
    empty = hard_negatives.hard_negatives(table_of(spark, rows).where("false"))
    assert empty.collect() == [] and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_ranges_hold_all_that_reach_the_cosine() -> None:
    rng = np.random.default_rng(4)
    q, p = (v / np.linalg.norm(v, axis=1)[:, None] for v in rng.standard_normal((2, 3000, 5)))
    cosine = (q * p).sum(axis=1)
    for f in range(5):
        low, high = hard_negatives.feasible(q[:, f], cosine)
        assert ((low <= p[:, f]) & (p[:, f] <= high)).all()


def test_ranges_and_lengths_save_comparisons() -> None:
    """On clustered vectors a small part of the pairs is compared, and the result is that of all of them."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((64, 16)) * 4
    x = np.rint((centres[np.arange(8192) % 64] + 0.05 * rng.standard_normal((8192, 16))) * 64 * rng.choice([0.1, 1], 8192)[:, None]).astype(np.int64)
    x = x[np.argsort(-(x**2).sum(axis=1), kind="stable")]
    ids = labels = np.arange(8192)
    label = labels % 2
    counted = hard_negatives.Counters()
    wanted = [[hard_negatives.Wanted(hard_negatives.NEVER, -hard_negatives.NEVER, 5)] for _ in range(50)]
    buckets = (hard_negatives.Bucket(x[k : k + 512], ids[k : k + 512], label[k : k + 512], ids[k : k + 512]) for k in range(0, 8192, 512))
    hard_negatives.search(buckets, x[:50], label[:50], ids[:50], wanted, True, counters=counted)
    for a in range(50):
        scores = x @ x[a]
        fits = np.flatnonzero((label == label[a]) & (ids != a))
        assert wanted[a][0].ids.tolist() == fits[np.lexsort((fits, -scores[fits]))[:5]].tolist()
    assert counted.possible == 50 * 8192 and counted.verified < 0.2 * counted.possible and counted.left_out > 0.3 * counted.possible


def dense(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Whitened values of all rows, shares, deviations and n, by the covariance itself."""
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return (x - sums / n) @ q / np.sqrt(e), e / np.trace(v), ((n * x - sums) ** 2).sum(axis=1), n


@pytest.mark.parametrize(("d", "n"), [(64, 3000), (20, 500), (3, 200)])
def test_whitening_is_that_of_the_dense_covariance(spark: SparkSession, d: int, n: int) -> None:
    rng = np.random.default_rng(d)
    v = (rng.standard_normal((n, d)) * np.linspace(1, 0.3, d)).astype(np.float32)
    v[::3] = v[0]  # a third of the rows are copies
    got = whitening.whiten(table_of(spark, [(i, r.tolist(), 1) for i, r in enumerate(v)])).toPandas()
    x = np.floor(v.astype(float) * 64).astype(np.int64) + 1_000_000
    white, share, deviation, count = dense(x, min(16, d))
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(table * np.sign((table * white).sum(axis=0)) - white).max() < 1e-8
    assert np.allclose(got[got.vec_id == 0].sort_values("component").explained, share, rtol=1e-9)
    assert (got.n == count).all() and got.identity_error.max() < 1e-9
    assert (got[got.component == 1].sort_values("vec_id").deviation.to_numpy() == deviation).all()


def test_odd_rows_of_whitening(spark: SparkSession) -> None:
    rng = np.random.default_rng(3)
    good = [(k if k else None, rng.standard_normal(3).tolist(), None) for k in range(30)]
    bad = [(90, None, 1), (91, [], 1), (92, [1, None, 2], 1), (93, [1, float("nan"), 2], 1), (94, [1, float("-inf"), 2], 1), (95, [1.0], 1), (96, [3e38, 0, 0], 1)]
    got = whitening.whiten(table_of(spark, good + good[:4] + bad)).collect()
    assert len(got) == 34 * 3 and {r.n for r in got} == {len({tuple(np.floor(np.float32(v).astype(float) * 64)) for _, v, _ in good})} and not {r.vec_id for r in got} & set(range(90, 97))
    flat = [(k, [k / 2, k / 4, 1.0], 1) for k in range(20)]  # of rank one
    assert {r.component for r in whitening.whiten(table_of(spark, flat)).collect()} == {1}
    for rows in ([(1, [1, 2], 1)] * 3, []):
        assert whitening.whiten(table_of(spark, rows)).collect() == []


def test_deviations_are_exact_or_null() -> None:
    x = np.array([[1 << 40, 5], [3, 7]])
    assert whitening.deviations(x, 10**6, [4, 5]) == [None, (3 * 10**6 - 4) ** 2 + (7 * 10**6 - 5) ** 2]
    assert list(whitening.deviations(np.array([[3, 7]]), 2, [4, 5])) == [4 + 81]


def test_parity_maps_never_overstate() -> None:
    """What two maps tell apart is at most what the sets do not share, whole or folded, and close to it for small differences."""
    from pixelseries.llm import neardup

    rng = np.random.default_rng(8)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(0, 3000)), np.uint64))
        b = np.unique(np.concatenate([a[int(rng.integers(0, len(a) + 1)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 500)), np.uint64)]))
        apart, (x, y) = len(np.setxor1d(a, b)), (neardup.parity(a), neardup.parity(b))
        found = neardup.least_apart(x.tobytes(), y.tobytes())
        short = int(np.bitwise_count(neardup.folded(x, 64) ^ neardup.folded(y, 64)).sum())
        assert short <= found <= apart and (found > 0.6 * apart or apart > 0.4 * (len(a) + len(b)))
