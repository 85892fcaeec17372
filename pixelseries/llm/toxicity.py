"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A sentence's features are its words and their beginnings of 3 to 6 letters. Its score is p = sigmoid(w.x - c); a document
is toxic with probability 1 - (1 - leak) * prod(1 - p) over its sentences, the leak standing for label noise. The weights
are fitted to document labels only, by Newton-like steps whose gradients every task sums over its own labelled documents;
the sentence with the highest score then locates the offence.

Training takes at most `most` labelled documents whose crc32(doc_id as text) mod 3 is not 1 (those are held out), one row for
each id, and all features of theirs that are typical of label 1 beyond chance; scoring covers every document, whole. Sums are
of whole numbers (parts of 2 ** -FINE), so that the weights do not depend on how rows are dealt to tasks.

Null and empty texts have no sentence and the score of the leak. A null doc_id is not held out and matches no label.
Very long texts are scored whole, sentence by sentence. Of equally toxic sentences the first is named; equal scores are
equal verdicts. Repeated rows are scored one by one, but train once (the text with the least hash); repeated labels of a
document count once, the toxic one first. Without labels of both kinds all weights are 0. An empty table gives an empty
result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelseries.llm.common import stored

MAX_TRAIN = 20_000
FINE = 30
PREFIXES = range(3, 7)
#: Least half likelihood-ratio statistic of a feature: of a million features without any bearing about one passes.
LEAST_GAIN = 12.0
CLEAN_LOGIT = 9.0  # c: a sentence without any feature has a score of 0.0001
ROUNDS = 10
RIDGE = 0.5
CUT = 0.7
CACHED_WORDS = 1 << 19
FLUSH = 200_000

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of each sentence with a word; offsets in code points."""
    for m in SENTENCE.finditer(text):
        if found := WORD.findall(m.group().lower()):
            yield m.start(), m.end(), found


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """(toxic, text) of at most `most` labelled documents that are not held out, chosen by a hash of the id."""
    ids = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")  # at most `most` ids
    one = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    return stored(one.select("toxic", "text"), "toxicity-training")


def feature_weights(train: DataFrame) -> dict[str, float]:
    """The features that are typical of label 1 by the likelihood ratio of their document counts, with log odds. As many as
    the training documents, of bounded number, have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], ["feature", "clean", "toxic"])
            seen.clear()
            return batch

        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f in {f for w in set(WORD.findall(t.lower())) for f in word_features(w)}:
                    seen[f][y] += 1
                if len(seen) > FLUSH:
                    yield out()
        yield out()

    n0, n1 = train.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    if not n0 or not n1:
        return {}
    counts = train.select("toxic", "text").mapInArrow(count, "feature string, clean long, toxic long")
    counts = counts.groupBy("feature").agg(F.sum("clean").alias("a0"), F.sum("toxic").alias("a1")).where("a1 >= 3")
    p1, p0 = (F.col("a1") + 0.5) / (n1 + 1), (F.col("a0") + 0.5) / (n0 + 1)
    pooled = (F.col("a0") + F.col("a1") + 1.0) / (n0 + n1 + 2)
    gain = F.col("a1") * F.ln(p1 / pooled) + F.col("a0") * F.ln(p0 / pooled)
    chosen = counts.where(p1 > 3 * p0).withColumn("gain", gain).where(F.col("gain") >= LEAST_GAIN)
    return {r["feature"]: r["odds"] for r in chosen.select("feature", F.ln(p1 / p0).alias("odds")).collect()}


def bags(train: DataFrame, index: dict[str, int]) -> DataFrame:
    """(toxic, blank, sentences): each document's sentences as sorted feature numbers; blank ones are only counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blank, rows = [], []
            for t in b.column(1).to_pylist():
                found = [sorted({index[f] for w in set(ws) for f in word_features(w) if f in index}) for _, _, ws in sentences(t)]
                rows.append([x for x in found if x])
                blank.append(len(found) - len(rows[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blank, pa.int32()), pa.array(rows, pa.list_(pa.list_(pa.int32())))], ["toxic", "blank", "sentences"])

    return stored(train.select("toxic", "text").mapInArrow(run, "toxic int, blank int, sentences array<array<int>>"), "toxicity-bags")


def fit(bag_rows: DataFrame, start: np.ndarray, rounds: int = ROUNDS, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and leak. Each round, every task sends its sums for the model's features to the driver."""
    weights, leak, size = start.copy(), 0.01, len(start)
    unit = float(1 << FINE)
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], w: np.ndarray = weights, leak: float = leak) -> Iterator[pa.RecordBatch]:
            g, h, own = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(2, np.int64)
            quiet = math.log1p(-1 / (1 + math.exp(CLEAN_LOGIT)))
            for b in batches:
                for y, blank, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    p = np.array([1 / (1 + math.exp(min(60.0, CLEAN_LOGIT - w[x].sum()))) for x in found])
                    none = math.exp(blank * quiet + np.log1p(-np.minimum(p, 1 - 1e-12)).sum())
                    whole = max(1 - (1 - leak) * none, 1e-12)
                    share = (1 - whole) / whole if y else -1.0
                    for x, q in zip(found, p):
                        # for label 1, q / whole is the chance that this sentence is to blame
                        blame = min(1.0, q / whole) if y else 0.0
                        g[x] += round(unit * min(1e6, share * q))
                        h[x] += round(unit * (q * (1 - q) + (blame * (1 - blame) * q if y else 0.0)))
                    own += round(unit * (leak / whole)) if y else 0, 1
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([own, g, h]).tobytes()], pa.binary())], ["sums"])

        parts = bag_rows.mapInArrow(sums, "sums binary").collect()
        total = np.sum([np.frombuffer(r["sums"], np.int64) for r in parts], axis=0) if parts else np.zeros(2 + 2 * size, np.int64)
        g, h = total[2 : 2 + size] / unit - ridge * (weights - start), total[2 + size :] / unit + ridge
        weights = np.maximum(0.0, weights + np.clip(g / h, -1.0, 1.0))
        leak = float(np.clip(total[0] / unit / total[1], 1e-4, 0.3)) if total[1] else leak
    return weights, leak


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> tuple[dict[str, float], float]:
    """(weight of each feature, leak): the model, of bounded size."""
    rows = training_rows(docs, labels, most)
    odds = feature_weights(rows)
    names = sorted(odds)
    if not names:
        return {}, 0.01
    weights, leak = fit(bags(rows, {f: k for k, f in enumerate(names)}), np.array([odds[f] for f in names]))
    return {f: float(w) for f, w in zip(names, weights) if w > 0}, leak


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted, and of the most toxic sentence worst_start, worst_end (code points; null without
    a sentence that has features) and worst_score."""
    model, leak = train(docs, labels, most)
    quiet = math.log1p(-1 / (1 + math.exp(CLEAN_LOGIT)))

    def score(text: str, known: dict[str, tuple[str, ...]]) -> tuple[float, int | None, int | None, float]:
        if len(known) > CACHED_WORDS:
            known.clear()
        all_words = WORD.findall(text.lower())
        for w in {w for w in all_words if w not in known}:
            known[w] = tuple(f for f in word_features(w) if f in model)
        if not any(known[w] for w in set(all_words)):
            n = sum(1 for m in SENTENCE.finditer(text) if WORD.search(m.group()))
            return 1 - (1 - leak) * math.exp(n * quiet), None, None, 0.0
        none, worst = 0.0, (0.0, None, None)
        for start, end, ws in sentences(text):
            z = sum(model[f] for f in {f for w in ws for f in (known[w] if w in known else [f for f in word_features(w) if f in model])})
            p = 1 / (1 + math.exp(min(60.0, CLEAN_LOGIT - z)))
            none += math.log1p(-min(p, 1 - 1e-12))
            if z and p > worst[0]:
                worst = p, start, end
        return 1 - (1 - leak) * math.exp(none), worst[1], worst[2], worst[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for b in batches:
            found = [score(t.as_py() or "", known) for t in b.column(1)]
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.float64(), pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "score", "worst_start", "worst_end", "worst_score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, worst_start int, worst_end int, worst_score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score")
