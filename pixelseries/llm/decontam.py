"""Benchmark decontamination: every training passage queries a BM25 index of the benchmark by block-max WAND.

Documents are cut into overlapping passages of twice the longest item's words, at every such length, so that an item
that occurs in one piece lies whole in some passage. A passage's words query an inverted index of the items; scores are
shares of an item's own score (what its own text would score), so one threshold fits items of any length. Of a passage's
words, those with the longest posting lists are set aside as long as their upper bounds stay below a part of the threshold
together; the sparse posting lists of the others, cut into blocks of items with their highest impacts, and the bounds set
aside limit the score of every block from above, and WAND scores the blocks that may reach the threshold. That loses no
item above it. Of the items retrieved, the question (all lines
but the last, or all sentences but the last of a single line) and the answer are each compared with the passage by their
five-word shingles; both must overlap.

The benchmark is the stated query set. It is indexed in parts of at most `part_words` words, of items of similar length; a
part's index has that bound, is built from items that are read one part at a time and broadcast, and the documents are
read once for each part, so once for all usual benchmarks together.

Null and blank texts and items match nothing; items with a null id are left out, of items that share an id each counts,
and the best one is reported, ties by the higher overlaps. Very long texts are searched whole. Rows of documents are searched
one by one, so null or repeated ids and repeated rows give rows of their own. Empty tables give an empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelseries.llm.common import keyed, ragged, small, stored

K1, B = 1.2, 0.75
THRESHOLD = 0.5  # least share of an item's own score
OVERLAP = 0.5  # least share of the question's, and of the answer's shingles
SHINGLE = 5
PART_WORDS = 1_000_000
ALIGN = 2  # items in a block of a posting list
ASIDE = 0.2  # share of the threshold that set-aside words may have together
CELLS = 1 << 20
SLACK = 1e-6  # of added bounds
GROUP_WORDS = 1 << 16  # texts are sifted together up to so many words

WORD = re.compile(r"[^\W_]+")


def text_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[str, str]:
    lines = [x for x in text.split("\n") if x.strip()]
    parts = lines if len(lines) > 1 else [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if x]
    return "\n".join(parts[:-1]), parts[-1] if parts else ""


def shingles(words: Sequence[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    if not words:
        return set()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


@dataclass
class Index:
    """Postings of items by ascending number; impacts are shares of the items' own scores. A term's entries are the blocks of
    ALIGN items that it occurs in, an entry's postings the items."""

    items: list[tuple[int, str]]  # id, text
    terms: dict[str, int]
    passage: int  # words
    highest: np.ndarray  # of a term: its highest impact
    first: np.ndarray  # of a term: its first entry, and the end
    block: np.ndarray  # of an entry
    bound: np.ndarray  # of an entry: its highest impact
    posting: np.ndarray  # of an entry: its first posting, and the end
    item: np.ndarray
    impact: np.ndarray
    by_block: np.ndarray  # entries in the order of their blocks
    block_first: np.ndarray  # of a block: its first entry there, and the end
    opened: dict[int, dict[int, tuple[float, list[int], list[float]]]] = field(default_factory=dict)

    def lists(self, block: int) -> dict[int, tuple[float, list[int], list[float]]]:
        """The block's posting lists by term: upper bound, items, impacts."""
        if block not in self.opened:
            entries = self.by_block[self.block_first[block] : self.block_first[block + 1]]
            terms = np.searchsorted(self.first, entries, "right") - 1
            spans = [slice(*self.posting[e : e + 2]) for e in entries]
            self.opened[block] = {int(t): (float(self.bound[e]), self.item[x].tolist(), self.impact[x].tolist()) for t, e, x in zip(terms, entries, spans)}
        return self.opened[block]


def build_index(items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_words: float) -> Index:
    """df, n_items and mean_words are those of the whole benchmark."""
    terms: dict[str, int] = {}
    rows: list[tuple[int, int, float]] = []
    passage = 2
    for k, (_, text) in enumerate(items):
        words = text_words(text)
        passage = max(passage, 2 * len(words))
        tf = Counter(words)
        norm = K1 * (1 - B + B * len(words) / mean_words)
        weight = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in tf.items()}
        own = math.fsum(weight.values())
        rows += [(terms.setdefault(t, len(terms)), k, w / own) for t, w in weight.items()]
    rows.sort()
    term, item, impact = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
    new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (item[1:] // ALIGN != item[:-1] // ALIGN)])
    entry_term, block = term[new], item[new] // ALIGN
    bound = np.maximum.reduceat(impact, new)
    first = np.searchsorted(entry_term, np.arange(len(terms) + 1))
    order = np.argsort(block, kind="stable")
    n_blocks = -(-len(items) // ALIGN)
    return Index(
        items, terms, passage, np.maximum.reduceat(bound, first[:-1]), first, block, bound, np.append(new, len(rows)), item, impact, order, np.searchsorted(block[order], np.arange(n_blocks + 1))
    )


def wand(lists: list[tuple[float, list[int], list[float]]], least: float) -> list[tuple[int, float]]:
    """(item, score) of the items that reach `least`, from posting lists (upper bound, items, impacts): the first items
    are skipped to the pivot, before which no item's upper bounds add up to it."""
    found, at = [], [0] * len(lists)
    while True:
        order = sorted((lists[k][1][at[k]], k) for k in range(len(lists)) if at[k] < len(lists[k][1]))
        bound, pivot = 0.0, -1
        for item, k in order:
            bound += lists[k][0]
            if bound >= least:
                pivot = item
                break
        if pivot < 0:
            return found
        if order[0][0] == pivot:
            here = [k for item, k in order if item == pivot]
            score = math.fsum(lists[k][2][at[k]] for k in here)
            if score >= least:
                found.append((pivot, score))
            for k in here:
                at[k] += 1
        else:
            for item, k in order:
                while at[k] < len(lists[k][1]) and lists[k][1][at[k]] < pivot:
                    at[k] += 1


def block_max_wand(index: Index, terms: set[int], block: int, threshold: float) -> list[tuple[int, float]]:
    """(item number, score) of the block's items with at least the threshold, for distinct terms of the index."""
    lists = index.lists(block)
    few, many = sorted((terms, lists.keys()), key=len)
    return wand([lists[t] for t in sorted(t for t in few if t in many)], threshold - 1e-9)


def candidates(ids: np.ndarray, counts: np.ndarray, index: Index, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in it, block) of the passages and blocks whose upper bounds add up to the threshold. ids: the term numbers
    of several texts' words, one text after the other, len(index.terms) for other words; counts: words of each text. Passages
    overlap by half, so they are sums of neighbouring halves."""
    half, none, n_blocks = index.passage // 2, len(index.terms), len(index.block_first) - 1
    halves = -(-counts // half)
    base = np.cumsum(halves) - halves
    text_of = np.repeat(np.arange(len(counts)), halves)
    ends = np.r_[text_of[1:] != text_of[:-1], True] if len(text_of) else np.zeros(0, bool)
    starts = np.r_[True, ends[:-1]] if len(ends) else ends
    of = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    there = ids < none
    pairs = np.unique((base[of] + place // half)[there] * none + ids[there])
    g, t = np.divmod(pairs, none)
    up, n = index.highest[t], index.first[t + 1] - index.first[t]
    order = np.lexsort((up, -n, g))
    g, t, up, n = g[order], t[order], up[order], n[order]
    run = np.cumsum(up)
    group = np.searchsorted(g, g)  # where each half begins
    light = run - (run - up)[group] < threshold * ASIDE / 2
    rest = np.bincount(g[light], up[light], len(text_of)).astype(float)
    g, t, n = g[~light], t[~light], n[~light]
    keys: list[np.ndarray] | np.ndarray = []
    # halves are added up in runs whose table of halves by blocks, or whose entries, stay small
    step = max(2, CELLS // n_blocks)
    for at in range(0, len(text_of), step):
        lo, hi = np.searchsorted(g, (at, at + step + 1))  # one half more, for the passages over the seam
        places, rows = ragged(index.first[t[lo:hi]], n[lo:hi]), np.repeat(g[lo:hi] - at, n[lo:hi])
        table = np.bincount(rows * n_blocks + index.block[places], index.bound[places], (step + 1) * n_blocks).astype(float).reshape(step + 1, n_blocks)
        count = min(step, len(text_of) - at)
        after = np.append(rest, 0.0)[at + 1 : at + count + 1]
        last = ends[at : at + count]
        both = table[:count] + np.where(last[:, None], 0.0, table[1 : count + 1]) + (rest[at : at + count] + np.where(last, 0.0, after))[:, None]
        p, block = np.nonzero(both >= threshold - SLACK)
        keys.append((p + at) * n_blocks + block)
    keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    p, block = np.divmod(keys, n_blocks)
    keep = ~ends[p] | starts[p]
    p, block = p[keep], block[keep]
    return text_of[p], (p - base[text_of[p]]) * half, block


def search(texts: list[str], index: Index, threshold: float, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(text number, item id, BM25 share, question overlap, answer overlap) of the items that texts give away."""
    words = list(map(text_words, texts))
    none, get = len(index.terms), index.terms.get
    ids = np.array([get(w, none) for ws in words for w in ws], np.int64)
    counts = np.array([len(w) for w in words], np.int64)
    before = np.cumsum(counts) - counts
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    at, known, there = (-1, -1), set(), {}
    for k, start, block in zip(*(x.tolist() for x in candidates(ids, counts, index, threshold))):
        passage = words[k][start : start + index.passage]
        if at != (k, start):
            at, there = (k, start), {}
            known = set(ids[before[k] + start : before[k] + start + len(passage)].tolist())
        for item, score in block_max_wand(index, known, block, threshold):
            shares = []
            for part in question_and_answer(index.items[item][1]):
                own = shingles(text_words(part))
                n = len(next(iter(own))) if own else 0
                if n and n not in there:
                    there[n] = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
                shares.append(len(own & there[n]) / len(own) if own else 1.0)
            if min(shares) >= overlap:
                key = k, index.items[item][0]
                found[key] = max(found.get(key, (0.0, 0.0, 0.0)), (score, *shares))
    for (k, item_id), v in sorted(found.items()):
        yield k, item_id, *v


def indexes(benchmark: DataFrame, part_words: int = PART_WORDS) -> Iterator[Index]:
    """The benchmark's indexes, one part at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [text_words(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(w) for w in found], pa.int64()), pa.array([sorted(set(w)) for w in found], pa.list_(pa.string()))], ["item_id", "text", "n", "terms"]
            )

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = items.mapInArrow(count, "item_id long, text string, n long, terms array<string>").where("n > 0")
    n_items, mean_words = items.agg(F.count("*"), F.avg("n")).first()
    if not n_items:
        return
    df = items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ordered = items.withColumn("nth", F.monotonically_increasing_id())
    each = ordered.select("item_id", "text", "n", "nth", F.explode("terms").alias("term")).join(df, "term")
    each = each.groupBy("item_id", "text", "n", "nth").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df")).orderBy("n", "item_id", "text")
    held: list[tuple[int, str]] = []
    known: dict[str, int] = {}
    size = 0
    for r in each.select("item_id", "text", "n", "df").toLocalIterator():
        if held and size + r["n"] > part_words:
            yield build_index(held, known, n_items, mean_words)
            held, known, size = [], {}, 0
        held.append((r["item_id"], r["text"]))
        known |= r["df"]
        size += r["n"]
    yield build_index(held, known, n_items, mean_words)


LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, part_words: int = PART_WORDS) -> DataFrame:
    """A row for each document and benchmark item that it contains: doc_id, item_id, score, question_overlap, answer_overlap."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found: DataFrame | None = None
    for index in indexes(benchmark, part_words):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                texts = ["" if t is None else t for t in b.column(1).to_numpy(zero_copy_only=False)]
                group = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // (6 * GROUP_WORDS)
                cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(texts)] if texts else []
                for i, j in zip(cuts, cuts[1:]):
                    hits = list(search(texts[i:j], index, threshold, overlap))
                    columns = [[b.column(0)[i + h[0]].as_py() for h in hits], *([h[k] for h in hits] for k in range(1, 5))]
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = rows.mapInArrow(run, LEAKS)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], LEAKS)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The documents that hold no benchmark item, judged row by row."""
    held = keyed(docs)
    found = leaks(held.select(F.col("row").alias("doc_id"), "doc.text"), benchmark, **options)
    bad = stored(found.select(F.col("doc_id").alias("row")).distinct(), "leaks")
    return held.join(small(bad), "row", "left_anti").select("doc.*")
