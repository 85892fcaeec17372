"""Hard negatives: for each anchor and each of its best positives, the best rows of other labels within a band of the positive's score.

Scores are inner products of whole-number vectors. The search is LEMP's: rows are sorted by length and cut into length
buckets, each with its directions and, for every coordinate, the sorted list of its values. An anchor that needs at least
the score t can reach it in a bucket of greatest length l only with a cosine of c = t / (|anchor| l) or more. For a focus coordinate
(those where the anchor's direction is largest) this leaves a feasible range of values, found in the sorted list by bisection:
    anchor_f * c - r  to  anchor_f * c + r   with   r = sqrt((1 - c * c) * (1 - anchor_f ** 2)),
widened to 1 or -1 where the anchor's own coordinate is beyond c. Rows in the ranges of all focus coordinates are the candidates; they are
verified by exact products. Where the ranges leave most of a bucket, all its rows are candidates, verified by one matrix product.
What an anchor needs rises as better rows are found, so later (shorter) buckets are searched less and at last not at all.

Two searches follow one another: positives (same label, the best few), then negatives (other labels, a band for each positive).
Anchors go in blocks of about `block` (a broadcast with a bound) against all rows, which are never moved for it: a task searches its rows'
buckets for the whole block and returns the best few for each anchor only, whatever the number of equal vectors or the size of a label;
a window over the tasks' few rows picks the result. Lineage ends at each block's written result.

Rows with a null label, a null vector, or any null or non-finite component take no part; nor do those whose squared length is 2**62
or more, as their scores would not fit a long. Shorter vectors count as filled with zeros. vec_id divisible by `shift_by` moves the label on by one
(mod `labels`). Rows with a null vec_id take part, but not as anchors, and come last among ties. Repeated rows are rows of their own:
each copy of an anchor has its own result, and the other copies are among its positives. Ties: the smaller vec_id. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelseries.llm.common import keyed, matrix, stored

SCALE = 256
NO_ID = np.iinfo(np.int64).max
NEVER = -(1 << 62)


@dataclass
class Counters:
    """Rows that were compared exactly, and all rows of the buckets that were opened or left out."""

    verified: int = 0
    possible: int = 0
    left_out: int = 0


@dataclass
class Bucket:
    """Rows of similar length: whole-number vectors x, ids, labels, rows, directions, and for each coordinate its sorted values."""

    x: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    lengths: np.ndarray = field(init=False)
    order: np.ndarray | None = field(init=False, default=None)

    def __post_init__(self) -> None:
        self.lengths = np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1))
        self.longest = float(self.lengths.max(initial=0.0)) * (1 + 1e-12)

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """For each coordinate, the rows by rising value of their directions, and these values."""
        if self.order is None:
            directions = self.x / np.where(self.lengths > 0, self.lengths, 1)[:, None]
            self.order = np.argsort(directions, axis=0, kind="stable")
            self.values = np.take_along_axis(directions, self.order, axis=0)
        return self.order, self.values


def feasible(anchor_f: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest value of a coordinate with which a direction can have the cosine with one whose coordinate is anchor_f."""
    c = np.clip(cosine, -1, 1)
    r = np.sqrt(np.maximum(0, (1 - c * c) * (1 - anchor_f * anchor_f)))
    low = np.where(anchor_f <= -c, -1.0, anchor_f * c - r)
    high = np.where(anchor_f >= c, 1.0, anchor_f * c + r)
    return low - 1e-9, high + 1e-9


def products(a: np.ndarray, b: np.ndarray, exact_in_doubles: bool) -> np.ndarray:
    """Whole inner products of all rows of a with all of b, as longs."""
    if exact_in_doubles:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def candidates(bucket: Bucket, direction: np.ndarray, cosine: float, focus: int, share: float) -> np.ndarray | None:
    """The bucket's rows within the feasible ranges of all focus coordinates; None where a range that leaves less than the share does not exist."""
    if cosine <= 0:
        return None
    at = np.argsort(-np.abs(direction), kind="stable")[:focus]
    low, high = feasible(direction[at], np.full(len(at), cosine))
    order, values = bucket.lists()
    n = len(values)
    spans = [(int(np.searchsorted(values[:, f], lo, "left")), int(np.searchsorted(values[:, f], hi, "right")), f) for f, lo, hi in zip(at, low, high)]
    spans = sorted((s for s in spans if s[1] - s[0] < n), key=lambda s: s[1] - s[0])
    if not spans or spans[0][1] - spans[0][0] > share * n:
        return None
    seen = np.zeros(n, np.int32)
    for start, end, f in spans:
        seen[order[start:end, f]] += 1
    return np.flatnonzero(seen == len(spans))


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, then smaller ids, then rows."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        return near[best(scores[near], ids[near], rows[near], k)] if len(near) < len(scores) else np.lexsort((rows, ids, -scores))[:k]
    return np.lexsort((rows, ids, -scores))[:k]


class Wanted:
    """What one anchor still looks for: the k best rows with low <= score <= high, of its label or of others."""

    __slots__ = ("low", "high", "k", "scores", "ids", "rows")

    def __init__(self, low: int, high: int, k: int) -> None:
        self.low, self.high, self.k = low, high, k
        self.scores = self.ids = self.rows = np.zeros(0, np.int64)

    def need(self) -> int:
        return max(self.low, int(self.scores[-1])) if len(self.scores) == self.k else self.low

    def offer(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        fits = np.flatnonzero((scores >= self.need()) & (scores <= self.high))
        if len(fits):
            s, i, r = (np.concatenate([a, b[fits]]) for a, b in ((self.scores, scores), (self.ids, ids), (self.rows, rows)))
            at = best(s, i, r, self.k)
            self.scores, self.ids, self.rows = s[at], i[at], r[at]


def search(buckets: Iterator[Bucket], x: np.ndarray, labels: np.ndarray, rows: np.ndarray, wanted: list[list[Wanted]], same: bool, focus: int = 4, share: float = 0.25, counters: Counters | None = None) -> None:
    """Offers each anchor (x, label, row) the bucket rows of its label, itself excepted, or of others, as far as they can matter."""
    counters = counters or Counters()
    lengths = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    directions = x / np.where(lengths > 0, lengths, 1)[:, None]
    for bucket in buckets:
        whole: list[int] = []
        in_doubles = bucket.longest * float(lengths.max(initial=0.0)) < 2.0**52
        for a, looks in enumerate(wanted):
            if not looks:
                continue
            need = min(w.need() for w in looks)
            reach = lengths[a] * bucket.longest
            counters.possible += len(bucket.ids)
            if need > reach * (1 + 1e-12) + 1e-6:
                counters.left_out += len(bucket.ids)
                continue
            near = candidates(bucket, directions[a], need / reach * (1 - 1e-12), focus, share) if reach > 0 else None
            if near is None:
                whole.append(a)
                continue
            counters.verified += len(near)
            _offer(looks, products(x[a : a + 1], bucket.x[near], in_doubles)[0], bucket, near, labels[a], rows[a], same)
        everything = np.arange(len(bucket.ids))
        for at in range(0, len(whole), 512):
            part = whole[at : at + 512]
            counters.verified += len(part) * len(everything)
            for a, scores in zip(part, products(x[part], bucket.x, in_doubles)):
                near = np.flatnonzero(scores >= min(w.need() for w in wanted[a]))
                _offer(wanted[a], scores[near], bucket, near, labels[a], rows[a], same)


def _offer(looks: list[Wanted], scores: np.ndarray, bucket: Bucket, near: np.ndarray, label: int, row: int, same: bool) -> None:
    fits = (bucket.labels[near] == label) & (bucket.rows[near] != row) if same else bucket.labels[near] != label
    scores, near = scores[fits], near[fits]
    if len(near):
        for w in looks:
            w.offer(scores, bucket.ids[near], bucket.rows[near])


def usable_rows(rows: DataFrame, scale: int = SCALE, shift_by: int = 7, labels: int = 10) -> DataFrame:
    """(row, vec_id, label, x, squared): the rows that take part; squared is the squared length, as a double."""
    e = F.col("embedding")
    finite = e.isNotNull() & F.forall(e, lambda c: F.coalesce(F.abs(c) < 2.0**40, F.lit(False)) & ~F.isnan(c))
    label = F.when(F.col("vec_id") % shift_by == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    docs = keyed(rows).select("row", *(F.col(f"doc.{c}").alias(c) for c in ("vec_id", "label", "embedding"))).where(F.col("label").isNotNull() & finite)
    out = docs.select("row", F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))
    out = out.withColumn("squared", F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    return out.where(F.col("squared") < 2.0**62)


def _width(x: pa.Array, dims: int) -> np.ndarray:
    """The vectors as a matrix of dims columns, filled with zeros."""
    if len(x) and len(x.flatten()) == len(x) * dims:
        return matrix(x, np.int64)
    out = np.zeros((len(x), dims), np.int64)
    for k, v in enumerate(x.to_pylist()):
        out[k, : len(v)] = v
    return out


def _buckets(batches: Iterator[pa.RecordBatch], dims: int, size: int) -> Iterator[Bucket]:
    """Batches of (row, vec_id, label, x), longest first, as buckets; the first ones are smaller, so that needs rise early."""
    size_now = max(1, size // 16)
    held: list[pa.RecordBatch] = []
    n = 0

    def made(parts: list[pa.RecordBatch]) -> Bucket:
        t = pa.Table.from_batches(parts).combine_chunks()
        ids = t.column(1).combine_chunks().fill_null(NO_ID) if t.num_rows else t.column(1).combine_chunks()
        return Bucket(_width(t.column(3).combine_chunks(), dims), ids.to_numpy(zero_copy_only=False), t.column(2).to_numpy(), t.column(0).to_numpy())

    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, size_now - n)
            held.append(part)
            n, at = n + part.num_rows, at + part.num_rows
            if n == size_now:
                yield made(held)
                held, n, size_now = [], 0, min(size, size_now * 4)
    if n:
        yield made(held)


def _found(rows: DataFrame, dims: int, size: int, anchors: dict[str, np.ndarray], bands: list[list[tuple[int, int, int]]], same: bool) -> DataFrame:
    """(anchor, nth, id, row, score): what each task finds; anchor and nth are places in anchors and in its bands (low, high, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [[Wanted(*band) for band in b] for b in bands]
        search(_buckets(batches, dims, size), anchors["x"], anchors["label"], anchors["row"], wanted, same)
        out = [(a, j, w) for a, looks in enumerate(wanted) for j, w in enumerate(looks) if len(w.ids)]
        counts = [len(w.ids) for _, _, w in out]
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        ids = join(w.ids for _, _, w in out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array([x[k] for x in out], np.int32), counts)) for k in (0, 1)]
            + [pa.array(ids, mask=ids == NO_ID), pa.array(join(w.rows for _, _, w in out)), pa.array(join(w.scores for _, _, w in out))],
            ["anchor", "nth", "id", "row", "score"],
        )

    return rows.select("row", "vec_id", "label", "x").mapInArrow(run, "anchor int, nth int, id long, row long, score long")


def _best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = 32_768, bucket: int = 4096, a_task: int = 65_536, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: anchors are rows whose vec_id is divisible by
    `every`; the negatives have low to high percent of the positive's score."""
    spark = rows.sparkSession
    usable = usable_rows(rows, scale)
    size = stored(usable, "usable")
    about = size.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("anchors"), F.max(F.size("x")).alias("dims")).first()
    parts = max(1, -(-about.n // a_task))
    # longest first inside a task; a task has rows of all lengths, so each can raise what its anchors need
    spread = stored(size.repartition(parts, F.xxhash64("row")).sortWithinPartitions(F.desc("squared"), "row"), "by-length") if parts > 1 else stored(size.repartition(1).sortWithinPartitions(F.desc("squared"), "row"), "by-length")
    of_block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(max(1, -(-about.anchors // block))))
    result = None
    for k in range(-(-about.anchors // block)):
        mine = size.where((F.col("vec_id") % every == 0) & (of_block == k)).select("row", "vec_id", "label", "x").orderBy("vec_id", "row").toArrow().combine_chunks()
        if not mine.num_rows:
            continue
        ids = mine.column("vec_id").to_numpy()
        anchors = {"x": _width(mine.column("x").combine_chunks(), about.dims), "label": mine.column("label").to_numpy(), "row": mine.column("row").to_numpy()}
        first = _best_of(_found(spread, about.dims, bucket, anchors, [[(NEVER, -NEVER, positives)]] * len(ids), True), positives)
        chosen = first.where("score >= 0").orderBy("anchor", "rank").select("anchor", "id", "score").toArrow()  # below zero the band is empty
        bands: list[list[tuple[int, int, int]]] = [[] for _ in ids]
        places: list[int] = []
        for a, s in zip(chosen.column("anchor").to_pylist(), chosen.column("score").to_pylist()):
            places.append(len(bands[a]))
            bands[a].append((-(-low * s // 100), high * s // 100, negatives))
        of = chosen.column("anchor")
        names = spark.createDataFrame(
            pa.table({"anchor": of, "nth": pa.array(places, pa.int32()), "anchor_id": pa.array(ids).take(of), "positive_id": chosen.column("id"), "positive_score": chosen.column("score")}),
            "anchor int, nth int, anchor_id long, positive_id long, positive_score long",
        )
        second = _best_of(_found(spread, about.dims, bucket, anchors, bands, False), negatives)
        made = second.join(names, ["anchor", "nth"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        made = stored(made, "negatives")
        result = made if result is None else result.unionByName(made)
    return result if result is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
