"""Stages and streams do the whole job: near copies, rows without or with repeated ids, folders of part files."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from brute import brute_groups
from pyspark.sql import DataFrame, SparkSession

from pixelseries.llm import decontam, mixing, neardup
from pixelseries.llm.common import table


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def test_near_copies_by_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for k in range(25):  # copies with more and more changed words, some in chains, behind a common line
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 60, 200]))]
        for step in range(5):
            rows.append((None if rng.random() < 0.3 else len(rows) // 2, " ".join(words) if k % 3 else "one line that very many of them share . " + " ".join(words), "a"))
            for _ in range(rng.choice([0, 1, 2])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(400)}"
    rows += [(500, None, "a"), (501, " \n", "a"), (None, "", "a")]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    roots = brute_groups([r[1] for r in rows])
    assert 30 < len(set(roots)) < len(rows) - 30
    out = neardup.without_near_copies(frame(spark, rows)).collect()
    group = {r[1] or "": g for r, g in zip(rows, roots)}
    assert sorted(group[r["text"] or ""] for r in out) == sorted(set(roots))
    for r in out:  # the least id of its group
        assert r["doc_id"] == rows[roots.index(group[r["text"] or ""])][0]


def test_long_texts_with_a_common_passage_are_no_candidates(spark, monkeypatch):
    """Parity maps of their size tell nothing, and the sample does not show that the passage is common: only its count over all texts does."""
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(600)]
    rows = [(k, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(1400)]), "a") for k in range(40)]
    rows += [(100, rows[3][1] + " end", "a"), (101, rows[5][1].replace("p9 ", "q9 "), "a")]
    monkeypatch.setattr(neardup, "SAMPLE_DOCS", 1)
    tested, confirmed = [], neardup._confirmed
    monkeypatch.setattr(neardup, "_confirmed", lambda pairs, *rest: tested.append(pairs.count()) or confirmed(pairs, *rest))
    out = neardup.without_near_copies(frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(40))
    assert sum(tested) <= 20


def test_openings_are_the_first_shingles_by_their_counts(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(6)}" for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    texts += [t + " x" for t in texts[:20]]
    sets = [neardup.shingle_set(t, 2).view("int64").tolist() for t in texts]
    counts = Counter(h for s in sets for h in s)
    common = sorted(counts, key=lambda h: h % 2**64)[::7]
    places = [counts[h] for h in common]
    place = dict(zip(common, places))
    want = set()
    for k, s in enumerate(sets):
        order = sorted(s, key=lambda h: (h in place, place.get(h, 0), h % 2**64) if h in place else (False, counts[h], h))
        first = order[: neardup.opening(len(s))]
        want |= {(h, k, len(s), i) for i, h in enumerate(first) if h in place or counts[h] > 1}
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = neardup._openings(rows, 2, neardup.SIMILARITY, np.array(common, np.int64).view(np.uint64), np.array(places))
    assert {tuple(r) for r in got.collect()} == want


def test_pipeline_drops_near_copies(spark, small):
    import corpus_pipeline

    docs = table(spark, small, "documents")
    rows = sorted(map(tuple, docs.select("doc_id", "text").collect()))
    want = {rows[r][0] for r in brute_groups([t for _, t in rows])}
    out = corpus_pipeline.STAGES[1][1](spark, docs, small)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(want)


def test_stages_judge_rows_not_ids(spark):
    item = "the quick brown fox jumps over the lazy dog while nine.\nother animals look on from the quiet side"
    clean = "nothing of that kind stands in this text of some eleven words"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = frame(spark, [(1, item, "a"), (1, clean, "a"), (None, item, "b"), (None, clean, "b")])
    out = decontam.without_leaks(docs, bench)
    assert sorted(out.collect(), key=str) == sorted(docs.where(docs.text == clean).collect(), key=str)


def test_mix_meets_targets_without_ids(spark):
    rows = [(None if k % 3 else k // 30, f"w{k} b c d e", "abc"[k % 3 if k < 300 else 2]) for k in range(900)]
    docs = frame(spark, rows)
    taken = Counter()
    for r in mixing.mixed_documents(docs).collect():
        taken[r["source"]] += 5
    for r in mixing.mix(docs).select("source", "target").distinct().collect():
        assert abs(taken[r["source"]] - r["target"]) <= 5


def test_row_keys_are_of_their_own(spark, small):
    from pyspark.sql import functions as F

    from pixelseries.llm.common import keyed

    docs = table(spark, small, "documents")
    twice = docs.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    for df in (docs, docs.where("doc_id % 3 = 0").select("doc_id", "text"), twice, docs.unionByName(docs), docs.repartition(3)):
        held = keyed(df)
        assert held.select("row").distinct().count() == held.count() == df.count()
        first = {r["row"]: r["doc_id"] for r in held.select("row", "doc.doc_id").collect()}
        assert first == {r["row"]: r["doc_id"] for r in held.where("doc.doc_id >= 0").select("row", "doc.doc_id", "doc.text").collect()}
