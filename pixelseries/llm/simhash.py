"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by sharded BK-trees, grouped by components.

Distinct fingerprints within `radius` bits of each other share at least one of radius + 1 bit blocks, so every block's
value is a shard key and a shard's links are found by one BK-tree (children keyed by integer Hamming distance to the
parent; a search follows only the edges within the radius). Trees are built in the task that holds the shard and never
sent through the driver: the shards of all documents have no size bound, so they are not broadcast. A shard with more
than `shard_limit` distinct fingerprints is cut again by the blocks of its remaining bits, twice at most, after which a
shard's values differ in 19 bits only. Within a shard only a spanning set of links leaves the task, so groups of copies
never make pairs of all members; connected components are the same.

All copies of a text, and all empty ones, share a fingerprint, and a large component one root. Such keys are on one side of
joins only, the other side having one row a key, so Spark can split them.

Null, empty and blank texts have fingerprint zero, linked like any other. Very long texts are hashed whole, in runs of
bounded size. Ties: a bit that exactly half of the hashes have is 0; equal fingerprints are one node. Rows with a null doc_id get a fingerprint and
a component but never name one; a component of null ids only has a null component_id. Repeated rows stay repeated. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelseries.llm.common import scratch, stored

BITS = 64
SEED = 42


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, size: int = 3) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included; 0 without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    if len(w) <= size:
        return xxhash.xxh64_intdigest(b" ".join(w), seed=SEED)
    n, step, digest = len(w) - size + 1, 1 << 16, xxhash.xxh64_intdigest
    h = np.empty(n, np.uint64)
    for at in range(0, n, step):  # bounded memory for very long texts
        part = w[at : at + step + size - 1]
        h[at : at + step] = [digest(x, SEED) for x in map(b" ".join, zip(*(part[k:] for k in range(size))))]
    return majority(h)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed long with the fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Distinct integers by Hamming distance."""

    def __init__(self) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, x: int, radius: int) -> list[int]:
        """Inserts x and returns the earlier members within the radius."""
        if self.root is None:
            self.root, self.children[x] = x, {}
            return []
        near, todo = [], [self.root]
        while todo:
            y = todo.pop()
            d = (x ^ y).bit_count()
            if d <= radius:
                near.append(y)
            todo += [z for k, z in self.children[y].items() if d - radius <= k <= d + radius]
        at = self.root
        while (nxt := self.children[at].get(d := (x ^ at).bit_count())) is not None:
            at = nxt
        self.children[at][d] = x
        self.children[x] = {}
        return near


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning set of the links among distinct values: (value, the least value of its local component)."""
    tree, up = BKTree(), {v: v for v in values}

    def find(v: int) -> int:
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    for v in values:
        for y in tree.add(v, radius):
            a, b = find(v), find(y)
            if a != b:
                up[max(a, b)] = min(a, b)
    return [(v, find(v)) for v in values if find(v) != v]


def _blocks(bits: int, n: int) -> list[tuple[int, int]]:
    """(shift, width) of n blocks that cover the lowest `bits` bits."""
    cuts = [bits * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _with_keys(rows: DataFrame, rest: Column, free: Column, bits: int, radius: int) -> DataFrame:
    """One row for each block of the `bits` low bits of free: the shard key grows by the block, free loses it."""
    made = []
    for k, (shift, width) in enumerate(_blocks(bits, radius + 1)):
        value = F.shiftrightunsigned(free, shift).bitwiseAND(F.lit((1 << width) - 1))
        low = free.bitwiseAND(F.lit((1 << shift) - 1))
        high = F.shiftleft(F.shiftrightunsigned(free, shift + width), shift) if shift + width < 64 else F.lit(0).cast("long")
        made.append(F.struct(F.concat_ws("/", rest, F.lit(k), value).alias("key"), low.bitwiseOR(high).alias("free"), F.lit(bits - width).alias("bits")))
    return rows.select("fp", F.explode(F.array(*made)).alias("s")).select("fp", "s.key", "s.free", "s.bits")


def _tree_links(shards: DataFrame, radius: int) -> DataFrame:
    """(a, b) links of every shard; shards is (key, fp) with distinct rows of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        last = None

        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            a = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy(zero_copy_only=False)
            fps = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            pairs: list[tuple[int, int]] = []
            for i, j in zip(cuts, cuts[1:]):
                if keys[i] != last:
                    if len(held) > 1:
                        pairs += shard_links(held, radius)
                    held, last = [], keys[i]
                held += fps[i:j].tolist()
            yield out(pairs)
        if len(held) > 1:
            yield out(shard_links(held, radius))

    return shards.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, radius: int = 2, shard_limit: int = 4096) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints which chains of `radius` bits or fewer connect."""
    shards = _with_keys(distinct.select("fp"), F.lit(""), F.col("fp"), BITS, radius)
    found: DataFrame | None = None
    bits = {BITS}
    for depth in range(3):
        shards = stored(shards, "shards") if depth else shards
        if depth < 2:
            large = shards.groupBy("key").count().where(F.col("count") > shard_limit).select("key")
            large = stored(large, "large")
            if large.isEmpty():
                pairs, rest = _tree_links(shards, radius), None
            else:
                pairs = _tree_links(shards.join(large, "key", "left_anti"), radius)
                rest = shards.join(large, "key", "left_semi")
        else:
            pairs, rest = _tree_links(shards, radius), None
        found = pairs if found is None else found.unionByName(pairs)
        if rest is None:
            return found
        bits = {b - w for b in bits for _, w in _blocks(b, radius + 1)}
        parts = [_with_keys(rest.where(F.col("bits") == b), F.col("key"), F.col("free"), b, radius) for b in sorted(bits)]
        shards = parts[0]
        for p in parts[1:]:
            shards = shards.unionByName(p)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of edges (a, b) reaches. Labels jump over the edges and over
    themselves, so the rounds grow with the logarithm of the longest chain; each round's labels are written and read."""
    with scratch(edges.sparkSession) as tables:
        both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        both = stored(both, "edges")
        labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
        while True:
            near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("seen"))
            lower = labels.join(near, labels.node == near.a).select("node", F.least("root", "seen").alias("new"), "root")
            # hook: the old root learns of the lower one too; then every label jumps to its root's label
            hooks = lower.where("new < root").groupBy(F.col("root").alias("h")).agg(F.min("new").alias("hook"))
            hooked = lower.join(hooks, lower.node == hooks.h, "left").select("node", F.least("new", F.coalesce("hook", "new")).alias("new"), "root")
            hooked = stored(hooked, "labels")
            jump = hooked.select(F.col("node").alias("j"), F.col("new").alias("next"))
            after = hooked.join(jump, hooked.new == jump.j, "left").select("node", F.least("new", F.coalesce("next", "new")).alias("next"), "root")
            after = stored(after, "labels")
            labels = after.select("node", F.col("next").alias("root"))
            if after.where("next < root").isEmpty():
                tables.keep(after)
                return labels


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3, shard_limit: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable over links), n_equal (rows with the same fingerprint)."""
    rows = stored(fingerprints(docs, size), "fingerprints")
    own = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_equal")), "distinct")
    roots = components(stored(links(own, radius, shard_limit), "links"))
    grouped = own.join(roots, own.fp == roots.node, "left").select("fp", "least_id", "n_equal", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    linked = grouped.where("linked")
    ids = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = linked.join(ids, "root").select("fp", "n_equal", "component_id").unionByName(grouped.where("not linked").select("fp", "n_equal", F.col("least_id").alias("component_id")))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id", "n_equal")
