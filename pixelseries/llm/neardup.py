"""SimHash near-dedup as a stage: one row of each group of texts whose word shingles have a similarity of 0.8 or more.

The fingerprints and BK-trees of the SimHash operator, over shingles of five words, find the first links, each confirmed by
the similarity of the whole shingle sets. They cannot find all: texts of similarity 0.8 lie up to 17 of 64 bits apart, and
bit blocks that lose no such pair would put everything into one shard. So a prefix filter, which loses none, finds the
rest: with all shingles in one order, two sets of n and m shingles that reach the similarity share one of the first
n - ceil(s n) + 1 of either. The order is that of the number of sets that have a shingle, counted over all of them; those that are
common in a sample come last, uncounted. It decides the work only, as any order is complete. A set with that many shingles of its own
is like no other, so sets are first judged by a third of their shingles, and only those that are left, and all shingles of these, are
looked at further. Groups are the connected components of the confirmed links.

Sets are of 64-bit hashes. Equal sets are one node, so copies never meet in pairs. Of the rows that share a shingle, each is
first compared with a few pivots in turn; the pairs that are not connected by then are compared with each other, where the shingle can be
the first in the order that they share. Candidates are sifted by parity maps: every shingle flips one bit of its set's map, so two maps differ in no more bits than the sets
have unshared shingles, and sets of the similarity have at most a ninth of both sizes together. That loses no pair, whatever the sets. The closing
join tests maps folded to 512 bits before it makes a row, the sift whole ones, and whole sets are only made of the texts that remain.
Texts that share rare shingles, are not connected and lie just below the similarity still cost a test of a few longs for each pair.
Keys that many rows share are counted and joined, never gathered.

Nodes are found again by a row key, so null and repeated doc_ids make no difference. Of a group the row with the least doc_id
stays, rows without one last, ties by the text's hash. Null, empty and blank texts are copies of each other; a text of fewer
words than a shingle has is one shingle; very long texts count whole. An empty table gives an empty result. Extra columns
are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelseries.llm.common import keyed, scratch, small, stored
from pixelseries.llm.simhash import components, links, majority

SIZE = 5
SIMILARITY = (4, 5)  # as a fraction, so that comparisons are exact
RADIUS = 2
SAMPLE_DOCS = 20_000  # texts whose shingles are counted for the order
COMMON = 200_000  # shingles with a place of their own in the order, at most
FOLD = np.uint64(0x9E3779B97F4A7C15)  # odd, so that folding loses nothing
LONGS = 8  # of a folded parity map
MOST_BITS = 1 << 15  # of a whole one
PART = 3  # one shingle in so many tells which sets are like no other
TURNS = 3  # of pivots, unless all are connected before; the pairs that are left are then tested


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Ascending distinct hashes of the word shingles: their words' hashes, folded in order."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    size = min(size, len(w))
    n = len(w) - size + 1
    s = np.full(n, size, np.uint64)
    for k in range(size):
        s = (s ^ h[k : k + n]) * FOLD
        s ^= s >> np.uint64(29)
    return np.unique(s)


def opening(n: Column | int, similarity: tuple[int, int] = SIMILARITY) -> Column | int:
    """How many of its n shingles a set has to look at: in any order, two sets of the similarity share one of the first so many of either."""
    num, den = similarity
    return n * (den - num) // den + 1 if isinstance(n, int) else F.floor(n * (den - num) / den).cast("long") + 1


def parted(s: np.ndarray, common: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set that are not common (ascending), and the common ones by their places."""
    if not len(s) or not len(common):
        return s, s[:0]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    known = common[at] == s
    late, place = s[known], places[at[known]]
    return s[~known], late[np.lexsort((late, place))]


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """(row, s) of (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t.as_py(), size).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["row", "s"])

    return rows.select("row", "text").mapInArrow(run, "row long, s array<long>")


def common_shingles(rows: DataFrame, size: int, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in three or more sampled texts, ascending, and their counts. Reads at most `most` rows to the driver."""
    step = max(1, rows.count() // SAMPLE_DOCS)
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0)
    counts = _sets(sample, size).select(F.explode("s").alias("h")).groupBy("h").count().where("count > 2")
    found = counts.orderBy(F.desc("count"), "h").limit(most).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _marks(rows: DataFrame, size: int, common: np.ndarray) -> DataFrame:
    """(row, doc_id, tie, digest of the set, its fingerprint, its n, one in PART of its shingles that are not common, its parity map, that map folded)."""
    names = ["row", "doc_id", "tie", "digest", "fp", "n", "some", "map", "short"]
    none = np.zeros(len(common), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), size) for t in b.column(3)]
            maps = [parity(s) for s in sets]
            made = [
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64), pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([parted(s[s % np.uint64(PART) == 0], common, none)[0].view(np.int64) for s in sets], pa.list_(pa.int64())),
                pa.array([m.tobytes() for m in maps], pa.binary()),
                pa.array([folded(m, 8 * LONGS).view("<i8") for m in maps], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *made], names)

    given = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return given.mapInArrow(run, "row long, doc_id long, tie long, digest binary, fp long, n long, some array<long>, map binary, short array<long>")


def _like_no_other(nodes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(node) of nodes (node, n, some) with so many shingles of their own that no set reaches the similarity to them."""
    posts = nodes.select(F.explode("some").alias("h"), "node")
    shared = posts.withColumn("sets", F.count("*").over(Window.partitionBy("h"))).where("sets > 1").groupBy("node").agg(F.count("*").alias("shared"))
    own = F.size("some") - F.coalesce("shared", F.lit(0))
    return nodes.select("node", "n", "some").join(shared, "node", "left").where(own >= opening(F.col("n"), similarity)).select("node")


def _openings(rows: DataFrame, size: int, similarity: tuple[int, int], common: np.ndarray, places: np.ndarray) -> DataFrame:
    """(h, node, n, at): of the first shingles of each set of (row, text) those that other sets have too, and their places in the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingle_set(text.as_py(), size)
                rare, late = parted(s, common, places)
                late = late[: max(0, opening(len(s), similarity) - len(rare))]
                h = np.concatenate([rare, late]).view(np.int64)
                at = np.append(np.full(len(rare), -1), np.arange(len(late)) + len(rare))
                columns = [h, np.full(len(h), row), np.full(len(h), len(s)), np.full(len(h), len(rare)), at]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h", "node", "n", "rare", "at"])

    posts = stored(rows.select("row", "text").mapInArrow(run, "h long, node long, n long, rare long, at long"), "posts")
    shared = posts.where("at < 0").withColumn("sets", F.count("*").over(Window.partitionBy("h"))).where("sets > 1")
    of_node = Window.partitionBy("node")
    own = F.col("rare") - F.count("*").over(of_node)  # these come first
    placed = shared.withColumn("place", own + F.row_number().over(of_node.orderBy("sets", "h")) - 1)
    first = placed.where(F.col("place") < opening(F.col("n"), similarity)).select("h", "node", "n", F.col("place").cast("long").alias("at"))
    return first.unionByName(posts.where("at >= 0").select("h", "node", "n", "at"))


def parity(s: np.ndarray) -> np.ndarray:
    """A bit for each residue of the shingles, set if an odd number of them has it: packed, the lowest first. Twice as many bits as shingles
    at least, unless that is more than MOST_BITS; a power of two."""
    bits = min(MOST_BITS, max(64 * LONGS, 1 << (2 * len(s)).bit_length()))
    return np.packbits(np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little")


def folded(p: np.ndarray, size: int) -> np.ndarray:
    """The parity map of the same set with fewer bits, size bytes."""
    return np.bitwise_xor.reduce(p.reshape(-1, size), axis=0)


def least_apart(a: bytes, b: bytes) -> int:
    """The unshared shingles that the sets of two parity maps have at least."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def _alike(n: Column, m: Column, similarity: tuple[int, int]) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    num, den = similarity
    return (n * den >= m * num) & (m * den >= n * num)


def _confirmed(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of distinct nodes whose sets reach the similarity."""
    num, den = similarity

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = (b.column(4).to_numpy() * (den - num)) // (den + num)  # unshared shingles that both may have
            keep = [least_apart(x.as_py(), y.as_py()) <= m for x, y, m in zip(b.column(2), b.column(3), most)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    with scratch(rows.sparkSession) as tables:
        left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("map").alias("x"))
        right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("map").alias("y"))
        alike = pairs.join(left, "a").join(right, "b").where(_alike(F.col("na"), F.col("nb"), similarity))
        near = stored(alike.select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("both")).mapInArrow(sift, "a long, b long"), "near")
        named = stored(near.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "named")
        sets = stored(_sets(rows.join(small(named), "row", "left_semi"), size), "sets")
        both = near.join(sets.select(F.col("row").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("row").alias("b"), F.col("s").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        found = stored(both.where(shared * (num + den) >= (F.size("sa") + F.size("sb")) * num).select("a", "b"), "links")
        tables.keep(found)
    return found


def _fingerprint_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): nodes that equal fingerprints or links of the BK-trees bring together, one partner a node and link."""
    least = stored(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    equal = nodes.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    left, right = least.select(F.col("fp").alias("a"), F.col("least").alias("na")), least.select(F.col("fp").alias("b"), F.col("least").alias("nb"))
    linked = links(least.select("fp"), radius).where("a <> b").join(left, "a").join(right, "b")
    return equal.unionByName(linked.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))).distinct()


def without_near_copies(docs: DataFrame, size: int = SIZE, similarity: tuple[int, int] = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The documents, with all their columns, one row of each group."""
    held = keyed(docs)
    with scratch(docs.sparkSession) as tables:
        gone = _gone(held.select("row", "doc.doc_id", "doc.text"), size, similarity, radius)
        tables.keep(gone)
    return held.join(small(gone), "row", "left_anti").select("doc.*")


def _gone(rows: DataFrame, size: int, similarity: tuple[int, int], radius: int) -> DataFrame:
    """(row) of those of (row, doc_id, text) that a copy stands for."""
    common, places = common_shingles(rows, size)
    marks = stored(_marks(rows, size, common), "marks")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tie", "row"))
    own = stored(marks.groupBy("digest").agg(best.alias("best")).select("digest", "best", F.col("best.row").alias("node")), "distinct")
    copies = stored(marks.select("row", "digest").join(own.select("digest", "node"), "digest").where("row <> node").select("row"), "copies")
    nodes = marks.join(small(copies), "row", "left_anti").withColumnRenamed("row", "node")
    alone = stored(_like_no_other(nodes, similarity), "alone")
    nodes = stored(nodes.select("node", "fp", "n", "map", "short").join(small(alone), "node", "left_anti"), "nodes")

    found = _confirmed(_fingerprint_pairs(nodes, radius), nodes, rows, size, similarity)
    roots = components(found)
    ids = stored(nodes.select(F.col("node").alias("row")), "ids")
    posts = stored(_openings(rows.join(small(ids), "row", "left_semi"), size, similarity, common, places), "openings")
    shared = posts.groupBy("h").count().where("count > 1").select("h")
    runs = stored(posts.join(shared, "h", "left_semi"), "runs")
    for turn in range(TURNS + 1):
        placed = stored(runs.join(roots, "node", "left").select("h", "node", "n", "at", F.coalesce("root", "node").alias("root")), "placed")
        # runs whose nodes are all connected need no more pairs
        open_runs = placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
        runs = stored(placed.join(open_runs, "h", "left_semi"), "runs")
        if turn == TURNS or runs.isEmpty():
            break
        pivots = runs.groupBy("h").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), "node", "n", "root")).alias("p"))
        stars = runs.join(pivots, "h").where((F.col("root") != F.col("p.root")) & _alike(F.col("n"), F.col("p.n"), similarity))
        stars = stars.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
        found = found.unionByName(_confirmed(stars, nodes, rows, size, similarity))
        roots = components(found)
        runs = runs.drop("root")

    num, den = similarity
    short = [F.get("short", F.lit(k)).alias(f"w{k}") for k in range(LONGS)]
    runs = stored(runs.join(nodes.select("node", *short), "node"), "open-runs")
    y = runs.select("h", F.col("node").alias("b"), F.col("n").alias("m"), F.col("at").alias("place"), F.col("root").alias("other"), *(F.col(f"w{k}").alias(f"v{k}") for k in range(LONGS)))
    flips = sum((F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"v{k}"))) for k in range(1, LONGS)), F.bit_count(F.col("w0").bitwiseXOR(F.col("v0"))))
    near = flips * (den + num) <= (F.col("n") + F.col("m")) * (den - num)
    # at the first shingle that two sets share, all before it are unshared
    first = (F.col("at") + F.col("place")) * (den + num) <= (F.col("n") + F.col("m")) * (den - num)
    apart = (F.col("node") < F.col("b")) & (F.col("root") != F.col("other")) & _alike(F.col("n"), F.col("m"), similarity) & first & near
    rest = runs.join(y, "h").where(apart).select(F.col("node").alias("a"), "b").distinct()
    more = _confirmed(rest, nodes, rows, size, similarity)
    if not more.isEmpty():
        roots = components(found.unionByName(more))

    groups = own.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    stay = groups.select("best.row")
    return stored(marks.select("row").join(stay, "row", "left_anti"), "gone")
