"""Removal of long strings that occur more than once, found by suffix sorting in two stages.

Texts are UTF-8 bytes, and matches never cross them. Which strings of `length` bytes repeat is decided by suffix sorting; the rest brings
together the few stretches of text that can match, so that no task ever sorts the corpus:

1. Anchors. Of all strings of `core` bytes inside a stretch of `length` bytes, the one with the least hash is an anchor (all of them where
   several are equal). Equal stretches have equal anchors, so a repeated string shows as a repeated anchor, about one in (length - core) / 2 bytes.
   An anchor's region is all that strings of `length` bytes around it can cover. Anchors are rows of two hashes, a row and a
   place; those whose hash comes once are dropped by counts that are added up before the shuffle.
2. Equal regions repeat as a whole, and one stands for all: groups of copies cost one row a copy and no comparison.
3. Different regions around one anchor are compared by suffix sorting. Only the suffixes that are smaller than their
   successors are sorted directly; the others are induced from them by a scan over the buckets of first bytes: the suffix before an already
   placed one goes behind those already in its bucket. Common prefixes of neighbours then tell the strings that repeat.
   The regions of an anchor meet in one task, up to `limit` of them. Larger groups are split: a string around the anchor reaches
   half of the remaining bytes to its left or else to its right, so each region is cut in two, with the longer core as the new key;
   keys that come once go, equal parts collapse again, and what is still too large is split on, until cores are whole strings.

Overlaps count, and strings are judged on the input, not on what is left. Null and empty texts have no bytes (their digest is
that of nothing). Very long texts are hashed in pieces; their anchors and spans are held together in one row. Rows are told apart by file
and place, so rows that share a doc_id, or have none, are texts of their own, and repeated rows are copies. Ties are settled by content alone.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelseries.llm.common import keyed, scratch, small, stored

LENGTH = 400
CORE = 256
LIMIT = 2048
PIECE = 1 << 20
BATCH = 1 << 18
NOTHING = hashlib.sha256(b"").hexdigest()


class Rolling:
    """Hashes of all substrings of bytes as powers of an odd base, mod 2**64, over random values of the 256 bytes."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + rng.integers(0, 2, 256, np.uint64)
        self.base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
        self.powers = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                p = np.full(n, np.uint64(base & ((1 << 64) - 1)))
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        """Hashes of the stretches from start to end (both slices from 0 on, or both places)."""
        h = (prefix[end] - prefix[start]) * (self.inverse[: len(prefix)][start])
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (else the greatest) of each run of width values."""
    op, fill = (np.minimum, np.uint64((1 << 64) - 1)) if least else (np.maximum, np.uint64(0))
    padded = np.full(-(-len(values) // width) * width, fill)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: len(values) - width + 1], ahead[width - 1 : len(values)])


def anchors(text: bytes, cores: Rolling, regions: Rolling, length: int = LENGTH, core: int = CORE, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """hash, digest (of the region), place, more: anchors of a text. Of overlapping equal ones, as periodic texts have, the first stands
    for all, and more is how far the last is from it."""
    width = length - core + 1  # cores in a string, and strings around a core
    found = []
    for at in range(0, len(text) - length + 1, piece):
        strings = min(piece, len(text) - length + 1 - at)  # those that start in this piece
        left = max(0, at - width)
        data = np.frombuffer(text, np.uint8, min(len(text), at + strings + 2 * length) - left, left)
        sums = cores.prefix(data)
        h = cores.of(sums, slice(0, len(data) - core + 1), slice(core, None))
        mine = h[at - left : at - left + strings + width - 1]
        lowest = sliding(mine, width, True)
        edge = np.zeros(width - 1, np.uint64)
        places = np.flatnonzero(sliding(np.concatenate([edge, lowest, edge]), width, False) == mine) + (at - left)
        whole = regions.prefix(data)
        start, end = np.maximum(places - (width - 1), 0), np.minimum(places + length, len(data))
        shape = np.uint64(0x9E3779B97F4A7C15) * (places - start).astype(np.uint64)  # where in its region the anchor is
        found.append((h[places], regions.of(whole, start, end) ^ shape, places + left))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    h, d, p = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((p, d, h))
    h, d, p = h[order], d[order], p[order]
    fresh = np.ones(len(p), bool)
    same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    fresh[1:] = ~same | (p[1:] - p[:-1] > width)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(p)) - 1
    return h[first].view(np.int64), d[first].view(np.int64), p[first], (p[last] - p[first]).astype(np.int64)


def _anchor_rows(docs: DataFrame, length: int, core: int) -> DataFrame:
    """(row, hash, digest, place, more) of docs (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cores, regions = Rolling(1), Rolling(2)
        for b in batches:
            got = [anchors(t.as_py() or b"", cores, regions, length, core) for t in b.column(1)]
            rows = np.repeat(b.column(0).to_numpy(), [len(g[0]) for g in got])
            if len(rows):
                h, d, p, more = (np.concatenate(x) for x in zip(*got))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows, h, d, p, more)], ["row", "hash", "digest", "place", "more"])

    return docs.mapInArrow(run, "row long, hash long, digest long, place long, more long")


def two_stage_order(text: bytes, ranges: list[tuple[int, int]], depth: int) -> np.ndarray:
    """The suffixes that start in the ranges, in the order of their first depth bytes at least: those smaller than their
    successors are sorted directly, the others induced."""
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    # a suffix of a run of equal bytes is to its successor as the last byte of the run is to the one after it
    change = np.flatnonzero(data[1:] != data[:-1])
    smaller = np.zeros(n, bool)  # the last suffix is greater than the empty one, its successor
    ends = np.append(change, n - 1)
    rises = np.append(data[change] < data[change + 1], False)
    smaller[:] = np.repeat(rises, np.diff(np.concatenate([[-1], ends])))
    # the suffixes to place: those asked for, and their successors up to one that is sorted directly
    direct_at = np.flatnonzero(smaller)
    asked = np.zeros(n + 1, np.int32)
    for start, end in ranges:
        k = np.searchsorted(direct_at, end - 1)
        asked[start] += 1
        asked[(int(direct_at[k]) if k < len(direct_at) else n - 1) + 1] -= 1
    asked = np.cumsum(asked)[:n] > 0
    chars = text.decode("latin-1")
    direct = sorted(np.flatnonzero(asked & smaller).tolist(), key=lambda i: chars[i : i + depth])
    direct = np.array(direct, np.int64)
    cuts = np.searchsorted(data[direct], np.arange(257))
    induced = asked & ~smaller
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and induced[n - 1]:
        pending[data[n - 1]].append(np.array([n - 1]))
    out = []
    for c in np.unique(data).tolist():
        wave = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        waves = []
        while len(wave):  # of a run of equal bytes, each wave takes the suffixes one byte longer
            waves.append(wave)
            before = wave[wave > 0] - 1
            wave = before[induced[before] & (data[before] == c)]
        bucket = np.concatenate([*waves, direct[cuts[c] : cuts[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (data[before] > c)]
        if len(before):
            first = data[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            at = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            for i, j in zip(at, np.append(at[1:], len(first))):
                pending[first[i]].append(before[i:j])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(text: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes each suffix shares with the one before it in order, counted up to depth."""
    data = np.frombuffer(text + bytes(16), np.uint8).astype(np.uint64)
    eights = np.zeros(len(text) + 8, np.uint64)
    for k in range(8):
        eights |= data[k : k + len(eights)] << np.uint64(8 * k)
    shared = np.zeros(len(order), np.int64)
    active = np.arange(1, len(order))
    done = 0
    while len(active) and done < depth:
        a, b = order[active] + done, order[active - 1] + done
        inside = np.maximum(a, b) < len(text)
        differ = np.where(inside, eights[np.minimum(a, len(text))] ^ eights[np.minimum(b, len(text))], np.uint64(1))
        apart = differ != 0
        low = differ[apart] & (~differ[apart] + np.uint64(1))
        shared[active[apart]] = done + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        active = active[~apart]
        done += 8
    shared[active] = depth
    return np.minimum(shared, depth)


def repeated_starts(regions: list[bytes], rows: np.ndarray, starts: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places (region, offset) of regions that stand for themselves only, at which a string of length bytes begins that is also
    somewhere else. A region's row and start say where it is; many: it stands for several."""
    text = b"".join(regions)
    sizes = np.array([len(r) for r in regions], np.int64)
    at = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    order = two_stage_order(text, [(a, a + c) for a, c in zip(at.tolist(), counts.tolist()) if c], length)
    region = np.searchsorted(at, order, "right") - 1
    offset = order - at[region]
    asked = offset < counts[region]
    order, region, offset = order[asked], region[asked], offset[asked]
    if not len(order):
        return region, offset
    fresh = common_prefixes(text, order, length) < length
    fresh[0] = True
    first = np.flatnonzero(fresh)
    row, place = rows[region], starts[region] + offset
    spread = lambda v: np.minimum.reduceat(v, first) != np.maximum.reduceat(v, first)
    repeats = spread(row) | spread(place) | np.logical_or.reduceat(many[region], first)
    hit = np.repeat(repeats, np.diff(np.append(first, len(order)))) & ~many[region]
    return region[hit], offset[hit]


def _spans(region: np.ndarray, offset: np.ndarray, rows: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """row, start, end of the stretches that the strings at these places cover."""
    order = np.lexsort((offset, region))
    region, offset = region[order], offset[order]
    fresh = np.ones(len(region), bool)
    fresh[1:] = (region[1:] != region[:-1]) | (offset[1:] - offset[:-1] > length)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(region)) - 1 if len(first) else first
    return [rows[region[first]], starts[region[first]] + offset[first], starts[region[last]] + offset[last] + length]


def _sorted_spans(regions: DataFrame, length: int, batch: int = BATCH) -> DataFrame:
    """(row, start, end) of what repeats in regions (key, row, at, many, data) of the same key; a key's regions are within the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            rows, starts, many = (t.column(k).to_numpy() for k in (1, 2, 3))
            held.clear()
            found = repeated_starts(t.column(4).to_pylist(), rows, starts, many, length)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _spans(*found, rows, starts, length)], ["row", "start", "end"])

        size, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if size >= batch and keys[i] != last:
                    yield out()
                    size = 0
                part = b.slice(i, j - i)
                held.append(part)
                size += part.column(4).nbytes
                last = keys[i]
        if held:
            yield out()

    dealt = regions.select("key", "row", "at", "many", "data").repartition("key").sortWithinPartitions("key", "row", "at")
    return dealt.mapInArrow(run, "row long, start long, end long")


def _regions(docs: DataFrame, chosen: DataFrame, length: int, core: int) -> DataFrame:
    """(key, row, at, lo, hi, many, data): the stretch of text around each chosen anchor (row, hash, place, many); its core is from lo to hi."""
    reach = length - core
    ids = stored(chosen.select("row").distinct(), "rows-of-regions")
    of_row = chosen.groupBy("row").agg(F.collect_list(F.struct("place", "hash", "many")).alias("a"))
    whole = docs.join(small(ids), "row").join(of_row, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text, a in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                text, a = text.as_py(), a.values
                place, key, many = (a.field(k) for k in range(3))
                place = place.to_numpy()
                at, end = np.maximum(place - reach, 0), np.minimum(place + length, len(text))
                data = pa.array([text[i:j] for i, j in zip(at.tolist(), end.tolist())], pa.binary())
                lo = place - at
                yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(at), row)), pa.array(at), pa.array(lo), pa.array(lo + core), many, data], ["key", "row", "at", "lo", "hi", "many", "data"])

    return whole.select("row", "text", "a").mapInArrow(run, "key long, row long, at long, lo long, hi long, many boolean, data binary")


def _halves(regions: DataFrame, length: int) -> DataFrame:
    """Each region cut in two: strings that reach half of the remaining bytes to the left of the core, and the others."""
    half = F.ceil((length - F.col("hi") + F.col("lo")) / 2).cast("long")
    cut = lambda start, end: F.expr(f"substring(data, cast({start} + 1 as int), cast({end} - {start} as int))")
    regions = regions.where(F.col("hi") - F.col("lo") < length).withColumns({"half": half, "size": F.length("data").cast("long")})
    first = F.col("lo") - F.col("half")  # strings start here at most, or else after it
    left = regions.where(first >= 0).withColumns({"a": F.lit(0).cast("long"), "z": F.least("size", first + length), "low": first, "high": F.col("hi")})
    right = regions.withColumns({"a": F.greatest(F.lit(0).cast("long"), first + 1), "z": F.col("size"), "low": F.col("lo"), "high": first + 1 + length})
    parts = []
    for side, part in enumerate((left, right)):
        part = part.where((F.col("z") - F.col("a") >= length) & (F.col("high") <= F.col("size")))
        key = F.xxhash64("key", F.lit(side), cut("low", "high"))
        parts.append(part.select(key.alias("key"), "row", (F.col("at") + F.col("a")).alias("at"), (F.col("low") - F.col("a")).alias("lo"), (F.col("high") - F.col("a")).alias("hi"), "many", cut("a", "z").alias("data")))
    return parts[0].unionByName(parts[1])


def _collapsed(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, start, end) of the regions that come more than once under their key, and one for all of each kind, where a key has several kinds."""
    regions = stored(regions.withColumn("digest", F.xxhash64("data", "lo")), "halves")
    own = F.struct("row", "at")
    kinds = regions.groupBy("key", "digest").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n"), F.min(own).alias("rep"))
    kinds = stored(kinds, "kinds")
    several = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    both = regions.join(kinds, ["key", "digest"])
    spans = both.where("n > 1 and not many").select("row", F.col("at").alias("start"), (F.col("at") + F.length("data")).alias("end"))
    kept = both.where((F.col("rep.row") == F.col("row")) & (F.col("rep.at") == F.col("at"))).withColumn("many", F.col("n") > 1)
    return spans, kept.join(several, "key", "left_semi").select("key", "row", "at", "lo", "hi", "many", "data")


def repeated_spans(docs: DataFrame, length: int = LENGTH, core: int = CORE, limit: int = LIMIT) -> DataFrame:
    """(row, start, end): stretches, perhaps overlapping, that cover just the bytes to remove. docs is (row, text as bytes)."""
    reach = length - core
    long_ones = docs.where(F.octet_length("text") >= length)
    with scratch(docs.sparkSession) as tables:
        found = stored(_anchor_rows(long_ones, length, core), "anchors")
        twice = F.sum(F.when(F.col("more") > 0, 2).otherwise(1))
        repeated = stored(found.groupBy("hash").agg(twice.alias("n")).where("n > 1").select("hash"), "repeated")
        alike = stored(found.join(repeated, "hash", "left_semi"), "alike")
        tables.keep(alike)
    kinds = stored(alike.groupBy("hash", "digest").agg(twice.alias("n"), F.min(F.struct("row", "place")).alias("rep")), "kinds")
    whole = alike.join(kinds.where("n > 1").select("hash", "digest"), ["hash", "digest"], "left_semi")
    spans = [whole.select("row", F.greatest(F.lit(0), F.col("place") - reach).alias("start"), (F.col("place") + F.col("more") + length).alias("end"))]
    per_key = stored(kinds.groupBy("hash").agg(F.count("*").alias("kinds")).where("kinds > 1"), "groups")
    chosen = kinds.join(per_key.select("hash"), "hash", "left_semi").select("hash", "rep.row", "rep.place", (F.col("n") > 1).alias("many"))
    regions = stored(_regions(docs, chosen, length, core), "regions")
    hot = stored(per_key.where(F.col("kinds") > limit).select(F.col("hash").alias("key")), "hot")
    while not hot.isEmpty():
        spans.append(_sorted_spans(regions.join(small(hot), "key", "left_anti"), length))
        again, regions = _collapsed(_halves(regions.join(small(hot), "key", "left_semi"), length))
        spans.append(again)
        regions = stored(regions, "regions")
        hot = stored(regions.groupBy("key").count().where(F.col("count") > limit).select("key"), "hot")
    spans.append(_sorted_spans(regions, length))
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def removals(docs: DataFrame, length: int = LENGTH, core: int = CORE, limit: int = LIMIT) -> DataFrame:
    """(row, n_removed, spans): for each text that loses bytes, its maximal removed runs in order. docs is (row, text as bytes)."""
    sizes = docs.select("row", F.octet_length("text").cast("long").alias("size"))
    spans = repeated_spans(docs, length, core, limit).groupBy("row", "start").agg(F.max("end").alias("end"))
    above = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("fresh", F.coalesce(F.col("start") > F.max("end").over(above), F.lit(True)).cast("long")).withColumn("nth", F.sum("fresh").over(upto))
    runs = spans.groupBy("row", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end")).join(sizes, "row").withColumn("end", F.least("end", "size"))
    return runs.groupBy("row", "size").agg(F.sum(F.col("end") - F.col("start")).alias("n_removed"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def kept(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(row, kept): what is left of the texts that runs (row, spans) names. docs is (row, text as bytes)."""
    ids = stored(runs.select("row"), "rows-to-cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = []
            for text, spans in zip(b.column(1), b.column(2)):
                text, at, parts = text.as_py(), 0, []
                for start, end in zip(*(spans.values.field(k).to_pylist() for k in range(2))):
                    parts.append(text[at:start])
                    at = end
                left.append(b"".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(left, pa.binary())], ["row", "kept"])

    return docs.join(small(ids), "row").join(runs.select("row", "spans"), "row").select("row", "text", "spans").mapInArrow(run, "row long, kept binary")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): text as bytes."""
    return keyed(docs).select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc.text"), F.lit("")).cast("binary").alias("text"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document. Texts are moved only where a part of them goes."""
    texts = keyed_texts(docs)
    runs = stored(removals(texts.select("row", "text"), length, core, limit), "removals")
    part = runs.where("n_removed < size")
    digests = stored(kept(texts.select("row", "text"), part).select("row", F.sha2("kept", 256).alias("of_rest")), "digests")
    whole = texts.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("of_text"))
    out = whole.join(runs.select("row", "n_removed", F.size("spans").cast("long").alias("n_spans")), "row", "left").join(digests, "row", "left")
    rest = F.when(F.col("n_removed").isNull(), F.col("of_text")).when(F.col("n_removed") == F.col("n_bytes"), F.lit(NOTHING)).otherwise(F.col("of_rest"))
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), rest.alias("kept_sha256"))
