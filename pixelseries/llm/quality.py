"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Every document is a bag of hashed word unigrams and bigrams. Two multinomials over the buckets are estimated, one from
trusted documents (labels.quality = 1) and one from all documents. A document's score is the mean log ratio of its
n-grams; documents below a fixed threshold, or failing the base rules, are rejected. DataFrame functions only.

Null and empty texts have no words: all counts 0, score null, base_failed true, kept false. Very long texts are judged whole. A score that equals the threshold is kept. Repeated rows, null ids and
equal texts are judged row by row; an empty table gives an empty result. Extra columns are ignored by the query and kept by the stage, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelseries.llm.common import SPACE_CHARS, words

BUCKETS = 16381  # prime: every bit of a hash matters
MAX_TRUSTED = 20000  # the target multinomial is fitted on at most so many labelled documents
THRESHOLD = -0.08
SCALE = 1_000_000  # log ratios are kept as integers of a millionth, so that sums do not depend on their order
WINDOW = 8


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _buckets(h: Column) -> Column:
    """Unigrams, then bigrams, as bucket numbers."""
    pairs = F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.shiftleft(a, 1).bitwiseXOR(b))
    grams = F.concat(h, F.slice(pairs, 1, F.greatest(F.size(h) - 1, F.lit(0))))
    return F.transform(grams, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))


def trusted_ids(labels: DataFrame, most: int = MAX_TRUSTED) -> DataFrame:
    ids = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def bucket_counts(docs: DataFrame, labels: DataFrame, most: int = MAX_TRUSTED) -> DataFrame:
    """(bucket, raw, trusted): n-gram counts over all documents and over the trusted ones. At most BUCKETS rows."""
    ids = F.broadcast(trusted_ids(labels, most).withColumn("trusted", F.lit(1)))  # bounded by `most` ids
    rows = docs.select("doc_id", "text").join(ids, "doc_id", "left").select(F.col("trusted"), _hashes(F.col("text")).alias("h"))
    grams = rows.select("trusted", F.explode(_buckets(F.col("h"))).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("trusted"))


def log_ratios(counts: DataFrame, smooth: float = 1.0) -> list[int]:
    """The model: one scaled log ratio for each bucket. Reads at most BUCKETS rows to the driver."""
    raw, trusted = [0] * BUCKETS, [0] * BUCKETS
    for b, r, t in counts.collect():
        raw[b], trusted[b] = r, t
    if not sum(trusted):
        return [0] * BUCKETS
    n, m = sum(raw) + smooth * BUCKETS, sum(trusted) + smooth * BUCKETS
    return [round(SCALE * (math.log((t + smooth) / m) - math.log((r + smooth) / n))) for r, t in zip(raw, trusted)]


def base_features(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns, the base counts and h (word hashes) of each row."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    rows = docs.select(*carry, F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        *carry,
        F.length(F.translate("text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        _hashes(F.col("text")).alias("h"),
    )
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    n = F.size("h")
    spans = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("h", i, WINDOW)))
    rows = rows.withColumn("wins", F.when(n >= WINDOW, spans).otherwise(F.array().cast("array<bigint>")))
    twice = F.size(F.array_distinct("wins")) < F.size("wins")
    placed = F.array_sort(F.transform("wins", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(twice, placed)).drop("wins")
    other = lambda s, j: F.coalesce(F.get("placed", j)["x"] == s["x"], F.lit(False))
    starts = F.transform(F.filter("placed", lambda s, j: other(s, j - 1) | other(s, j + 1)), lambda s: s["i"])
    rows = rows.withColumn("starts", F.sort_array(starts)).drop("placed")
    # a repeated window covers the words up to the next one's start, WINDOW at most
    cover = F.transform("starts", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", j + 1) - x, F.lit(WINDOW))))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(cover, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    return rows.select(*carry, n.cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "h")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MAX_TRUSTED, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score (mean log ratio), kept."""
    model = log_ratios(bucket_counts(docs, labels, most))
    weight = F.split(F.lit(",".join(map(str, model))), ",").cast("array<bigint>")  # folded to one literal array
    total = F.aggregate(_buckets(F.col("h")), F.lit(0).cast("long"), lambda a, b: a + F.get(weight, b))
    grams = 2 * F.size("h") - 1
    rows = base_features(docs, carry).withColumn("score", F.when(grams > 0, total / (grams * F.lit(float(SCALE)))))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    # the row number is always there; with it, a filter on the verdict stays above the features it is made of, instead of
    # repeating all their expressions below
    verdict = F.coalesce(F.col("score") >= threshold, F.lit(False)) & (F.monotonically_increasing_id() >= 0)
    return rows.withColumn("kept", ~F.col("base_failed") & verdict).drop("h")


def kept_documents(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """The documents, with all their columns, that pass the rules."""
    whole = docs.select("doc_id", "text", F.struct(*(docs[c] for c in docs.columns)).alias("__row"))
    return quality(whole, labels, carry=("__row",), **options).where("kept").select("__row.*")
