import random

import pytest

from folioscope.llm import contamination as K

rng = random.Random(8)
VOCAB = [f"{a}{b}{c}" for a in ("kar", "bel", "tor", "mis", "ven") for b in ("lo", "ni", "ra", "du") for c in ("n", "x", "sh", "p", "m")]


def words(n):
    return [rng.choice(VOCAB) for _ in range(n)]


ITEMS = {i: words(60) for i in range(5)}
BOILER = words(14)


def build():
    docs = {}
    fill = lambda: words(80)
    docs[0] = (fill() + ITEMS[0] + fill(), {0})
    docs[1] = (fill() + ITEMS[1][10:34] + fill(), {1})
    docs[2] = (fill() + ITEMS[2][:12] + fill() + ITEMS[2][40:52] + fill(), {2})
    noisy = [w if k % 9 else "zzzz" for k, w in enumerate(ITEMS[3])]
    docs[3] = (fill() + [w.upper() if k % 2 else w + "," for k, w in enumerate(noisy)] + fill(), {3})
    docs[4] = (fill() + [w[:-1] + "q" if k % 5 == 0 else w for k, w in enumerate(ITEMS[4]) if k % 13] + fill(), {4})
    docs[5] = (fill() + ITEMS[0][:8] + fill(), set())
    docs[6] = (fill() + ITEMS[1] + ITEMS[2], {1, 2})
    docs[7] = (words(20_000) + ITEMS[0] + words(20_000), {0})
    for d in range(8, 60):
        docs[d] = (fill() + BOILER, set())
    return docs


@pytest.fixture(scope="module")
def frames(spark):
    docs = build()
    d = spark.createDataFrame([(i, " ".join(w), None) for i, (w, _) in docs.items()] + [(100, None, "x"), (101, "", "x"), (102, "two words", "x")], "doc_id long, text string, seed string")
    items = spark.createDataFrame([(i, " ".join(w[:30]) + "\n" + " ".join(w[30:]), 1) for i, w in ITEMS.items()] + [(50, None, 1), (51, "", 1), (52, " ".join(BOILER + words(40)), 1)], "item_id long, text string, n_words int")
    return d, items, {(i, k) for i, (_, hit) in docs.items() for k in hit}


def test_found(frames):
    d, items, want = frames
    assert {(r.doc_id, r.item_id) for r in K.find_leaks(d, items).collect()} == want


def test_repeated_rows(frames):
    d, items, want = frames
    got = K.find_leaks(d.unionByName(d), items.unionByName(items)).collect()
    assert len(got) == len(want)


def test_empty(frames):
    d, items, _ = frames
    assert K.find_leaks(d.limit(0), items).count() == 0 and K.find_leaks(d, items.limit(0)).count() == 0


def test_alignment():
    item = ITEMS[0]
    assert K.held_words(item, words(9) + item + words(9)) == (60, 1)
    assert K.held_words(item, words(5)) == (0, 0)
    held, used = K.held_words(item, item[:20] + words(50) + item[30:50])
    assert used == 2 and 38 <= held <= 44
    held, used = K.held_words(item, item[30:50] + words(50) + item[:20])
    assert used == 1
    assert K.is_like("invoice", "invoce") and K.is_like("total", "totol") and not K.is_like("abc", "abd") and not K.is_like("total", "tutil")


def found(spark, docs, items):
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    e = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in K.find_leaks(d, e).collect()}


def test_many_halves_and_a_few_wholes(spark):
    half = {i: words(30) + ITEMS[0][:30] + words(30) for i in range(30)}
    assert found(spark, half, ITEMS) == {(i, 0) for i in half}
    whole = {100 + i: words(30) + ITEMS[0] + words(30) for i in range(5)}
    assert found(spark, half | whole, ITEMS) == {(i, 0) for i in half | whole}


def test_boilerplate_of_items_tells_nothing(spark):
    stamp = words(25)
    items = {i: stamp + words(40) for i in range(4)}
    docs = {1: words(30) + stamp + words(30), 2: words(30) + items[2] + words(30)}
    assert found(spark, docs, items) == {(2, 2)}
    versions = {i: ITEMS[0][:50] + words(10) for i in range(4)}  # of one item: all of them leak
    assert found(spark, {1: words(10) + ITEMS[0][:50]}, versions) == {(1, i) for i in versions}


def test_short_items(spark):
    items = {n: words(n) for n in range(1, 8)}
    docs = {n: words(20) + w + words(20) for n, w in items.items()} | {10: words(9) + items[7][:4] + words(2) + items[7][4:]}
    assert found(spark, docs, items) == {(n, n) for n in range(3, 8)}


def test_without_broadcast(spark, frames, monkeypatch):
    d, items, want = frames
    for bound in ("BROADCAST_SEEDS", "BROADCAST_ITEMS", "BROADCAST_PAIRS"):
        monkeypatch.setattr(K, bound, 0)
    assert {(r.doc_id, r.item_id) for r in K.find_leaks(d, items).collect()} == want


def test_alignment_of_batches_is_that_of_single_documents():
    docs = [words(rng.randrange(0, 200)) + ITEMS[1][a : a + 30] + words(rng.randrange(200)) + ITEMS[1][:a] for a in range(0, 60, 7)] + [[], words(3)]
    assert K.held_in(ITEMS[1], docs) == [K.held_words(ITEMS[1], x) for x in docs]
    got = [h for h, _ in K.held_in(ITEMS[1], docs)]
    assert all(h >= 30 or a > 30 for h, a in zip(got, range(0, 60, 7))) and got[-2:] == [0, 0]


def test_long_item_by_parts(monkeypatch):
    item = words(500)
    monkeypatch.setattr(K, "LONGEST", 100)
    assert K.held_words(item, words(50) + item + words(50))[0] >= 490
