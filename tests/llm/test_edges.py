"""Every operator on odd rows and on empty tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pixelseries.llm import decontam, mixing, neardup, pii, quality, sharding, simhash, token_counts, token_output, toxicity, url_filter


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, "the quick brown fox jumps over the lazy dog while nine.\nother animals look on from the quiet side"), (2, None), (None, "x y z"), (3, " "), (1, "unrelated words entirely. nothing here")]
    return spark.createDataFrame(rows, "item_id long, text string")


def runs(docs, labels, bench):
    return {
        "toxicity": lambda: toxicity.toxicity(docs, labels),
        "mixing": lambda: mixing.mix(docs),
        "token_output": lambda: token_output.token_output(docs, block=64),
        "pii": lambda: pii.personal_data(docs),
        "decontam": lambda: decontam.leaks(docs, bench),
        "sharding": lambda: sharding.place(docs),
        "token_counts": lambda: token_counts.token_counts(docs, chunk=50),
        "quality": lambda: quality.quality(docs, labels),
        "simhash": lambda: simhash.near_duplicates(docs),
    }


NAMES = list(runs(None, None, None))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(empty, odd_labels, bench, name):
    assert runs(empty, odd_labels.where("false"), bench.where("false"))[name]().count() == 0


@pytest.mark.parametrize("name", [n for n in NAMES if n != "decontam"])
def test_one_row_for_each(odd, odd_labels, bench, name):
    out = runs(odd, odd_labels, bench)[name]()
    got, want = Counter(r["doc_id"] for r in out.select("doc_id").collect()), Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    assert got == want


def test_toxicity_defaults(odd, odd_labels):
    out = toxicity.toxicity(odd, odd_labels).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    assert {r["held_out"] for r in out if r["doc_id"] is None} == {False}
    for r in out:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_mixing_nulls(odd):
    out = mixing.mix(odd).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    assert {r["size"] for r in out if r["doc_id"] in (3, 4, 5)} == {0}
    assert sum(r["size"] for r in out if r["source"] is None) == 0


def test_tokens_of_odd_rows(odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.DEFAULT)
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"] is not None}
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    for r in token_counts.token_counts(odd, chunk=50).where("doc_id is not null").collect():
        assert (r["n_tokens"], r["n_bytes"]) == (want[r["doc_id"]], len(texts[r["doc_id"]].encode())) and r["over_limit"] == (r["n_tokens"] > 2048)
    out = sorted(token_output.token_output(odd, block=64).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [None, None, 1, 2, 2, *range(3, 10)]
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(out, out[1:]))
    assert all(r["n_tokens"] == want[r["doc_id"]] + 1 for r in out if r["doc_id"] is not None)


def test_sharding_odd(odd):
    out = sharding.place(odd, cell_rows=1).collect()
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert {r["size"] for r in out if r["doc_id"] in (3, 4)} == {16} and {r["text_crc32"] for r in out if r["doc_id"] == 3} == {0}


def test_quality_of_odd_rows(odd, odd_labels):
    out = {r["doc_id"]: r for r in quality.quality(odd, odd_labels).where("doc_id is not null").collect()}
    for i in (3, 4, 5):
        assert (out[i]["n_words"], out[i]["word_chars"], out[i]["base_failed"], out[i]["kept"], out[i]["score"]) == (0, 0, True, False, None)
    kept = quality.kept_documents(odd, odd_labels)
    assert kept.columns == odd.columns and 1 in {r["doc_id"] for r in kept.collect()}


def test_simhash_of_odd_rows(odd):
    out = simhash.near_duplicates(odd).collect()
    assert {r["fingerprint"] for r in out if r["doc_id"] in (3, 4, 5)} == {"0" * 16}
    assert {r["component_id"] for r in out if r["doc_id"] in (3, 4, 5)} == {3}
    assert {r["component_id"] for r in out if r["doc_id"] in (1, 2, 9)} == {1}  # only A-Z differ
    kept = neardup.without_near_copies(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert len({(r["text"] or "").lower().strip() for r in rows}) == len(rows)


def test_leaks_of_odd_rows(odd, bench):
    out = Counter((r["doc_id"], r["item_id"]) for r in decontam.leaks(odd, bench).collect())
    assert out == {(1, 1): 1, (2, 1): 2, (9, 1): 1, (None, 1): 1}
    kept = decontam.without_leaks(odd, bench)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([None, 3, 4, 5, 6, 7, 8])


def test_mixed_documents_keep_columns(odd):
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    assert set(Counter(r["doc_id"] for r in out.where("doc_id <> 2").collect()).values()) <= {1, 2}


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET", "x://NET/", "http://example.net/en/", "http://a.example.net/en/x?q", "http://example.net/e", "https://www.example.com/de/1#x", "http://example.com/DE/", "http://b.org/fr/", "http://org/fr", "http://xnet/", "http://example.net:80/en/", "http://a.example.com/de/://b.net/", "http://" + "a." * 3000 + "net/" + "p/" * 50_000, "http://a.example.com/de" + "/de" * 30_000]
    rows = [(k, u, "x", "r") for k, u in enumerate(urls)] + [(None, "http://a.net/", "x", "r"), (4, "HTTP://A.NET", "x", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")

    def brute(url):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")

    got = sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in url_filter.judge(pages).collect())
    assert got == sorted((str(i), *(lambda b: (b[0], b[1], str(b[2]), b[3]))(brute(u))) for i, u, _, _ in rows)
    assert url_filter.judge(pages.where("false")).count() == 0


def test_pii_odd(odd):
    assert {r["spans"] for r in pii.personal_data(odd).where(F.col("doc_id").isin(3, 4, 5)).collect()} == {""}


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_and_empty_tables(spark, odd, empty, odd_labels, bench, tmp_path, k):
    """Each stage keeps the columns, clashing names too; the last one adds its own."""
    import corpus_pipeline

    for name, df in (("labels", odd_labels), ("benchmark", bench)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, empty, str(tmp_path)).count() == 0
    out = stage(spark, odd, str(tmp_path))
    assert set(odd.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns))
    if k < 4:
        assert out.columns == odd.columns
    else:  # what the documents had under the names of results is still there
        assert {(r["given_size"], r["given_shard"]) for r in out.collect()} == {(9, 3)}
    rows = {tuple(r[c] for c in ("doc_id", "text", "source", "__row", "h")) for r in odd.collect()}
    assert {tuple(r[c] for c in ("doc_id", "text", "source", "__row", "h")) for r in out.collect()} <= rows
