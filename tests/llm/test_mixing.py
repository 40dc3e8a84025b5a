import math

import pytest
from pyspark.sql import functions as F

from folioscope.llm import mixing as X
from folioscope.llm import tokens

TARGETS = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.0, 1), ("absent", 0.0, 5)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "word " * (1 + i % 40), "a" if i % 10 < 6 else "b" if i % 10 < 9 else "c", None) for i in range(3000)]
    rows += [(9000, None, "a", "x"), (9001, "", "b", "x"), (9002, "lost", None, "x"), (9003, "other", "no target", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy_no string")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame(TARGETS, "source_name string, target_share double, max_repeats int")


@pytest.mark.parametrize("bucket_rows", [100_000, 50])
def test_systematic(docs, targets, bucket_rows, monkeypatch):
    """Copies of a document differ by at most one from its expected copies, within max_repeats; the
    number of rows of a source is its expected number, rounded; shares come out near the targets."""
    monkeypatch.setattr(X, "BUCKET_ROWS", bucket_rows)
    sample = X.mix(docs, targets)
    per_doc = sample.groupBy("source", "doc_id").count().collect()
    sized = {r.doc_id: r for r in X.sized(docs).collect()}
    tokens_of = {s: sum(r.n_tokens for r in sized.values() if r.source == s) for s in "abc"}
    share = {n: s for n, s, _ in TARGETS}
    size = min(m * tokens_of[n] / s for n, s, m in TARGETS if n in "abc")
    for s, cap in (("a", 1), ("b", 2), ("c", 3)):
        c = min(cap, share[s] * size / tokens_of[s])
        counts = [r["count"] for r in per_doc if r.source == s]
        n = sum(1 for r in sized.values() if r.source == s)
        assert set(counts) <= {math.floor(c), math.ceil(c)} - {0} and max(counts) <= cap
        assert abs(sum(counts) - n * c) <= 1
    report = {r.source: r for r in X.mix_shares(sample, targets).collect()}
    assert all(abs(report[s].actual_share - share[s]) < 0.01 for s in "abc")
    assert report["none"].rows == 0 and report["absent"].tokens == 0
    assert {r.source for r in per_doc} == {"a", "b", "c"}


def test_buckets_change_nothing_but_order(docs, targets):
    a = X.mix(docs, targets).groupBy("source").count().collect()
    b = X.mix(docs.repartition(7), targets).groupBy("source").count().collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    same = X.mix(docs, targets).select("doc_id", "copy_no").collect()
    again = X.mix(docs.repartition(3, "text"), targets).select("doc_id", "copy_no").collect()
    assert sorted(map(str, same)) == sorted(map(str, again))


def test_given_size_caps(docs, targets):
    sample = X.mix(docs, targets, total_tokens=10**9)
    counts = {r.source: r.m for r in sample.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("m")).collect()}
    assert counts == {"a": 1, "b": 2, "c": 3}


def test_empty(docs, targets):
    assert X.mix(docs.limit(0), targets).count() == 0 and X.mix(docs, targets.limit(0)).count() == 0


def test_tokens(spark):
    texts = ["Hello world", "", None, "<|endoftext|>", "naïve 漢字", "a" * 250_000, "word " * 60_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in df.select("i", tokens.token_count("t").alias("n")).orderBy("i").collect()]
    enc = tokens.encoding(tokens.RANKS)
    assert got[:5] == [len(enc.encode_ordinary(t or "")) for t in texts[:5]] and got[3] > 1
    assert got[6] == len(enc.encode_ordinary(texts[6])) and got[5] > 1000
    assert "".join(tokens.pieces(texts[6])) == texts[6]
