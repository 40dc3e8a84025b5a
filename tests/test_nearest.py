"""The neighbour search against a comparison of all pairs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.operators import nearest
from folioscope.operators import spans as S

SCHEMA = "doc_id long, span_idx int, text string, x0 double, y0 double, x1 double, y1 double"


def make(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for doc, n in enumerate(sizes):
        for i in range(n):
            x, y = rng.choice([50.0, 60.0, 200.0, 330.5]), rng.randrange(0, 40 + 10 * n) * 1.0
            w, h = rng.choice([-8.0, 0.0, 12.0, 90.0, 400.0]), rng.choice([-4.0, 8.0, 12.0])
            rows.append((doc, i, f"t{i}", x, y, x + w, y + h))
    return rows


def brute(rows):
    out = set()
    for a in rows:
        for d in S.DIRECTIONS:
            best = None
            for b in rows:
                if a[0] != b[0] or a[1] == b[1]:
                    continue
                across = b[4] >= a[4] - 5 and b[6] <= a[6] + 5
                upright = b[3] >= a[3] - 5 and b[5] <= a[5] + 5
                if {"right": across and b[3] >= a[5], "left": across and b[5] <= a[3], "top": upright and b[4] >= a[6], "bottom": upright and b[6] <= a[4]}[d]:
                    d2 = ((b[3] + b[5]) / 2 - (a[3] + a[5]) / 2) ** 2 + ((b[4] + b[6]) / 2 - (a[4] + a[6]) / 2) ** 2
                    best = min(best, (d2, b[1])) if best else (d2, b[1])
            if best:
                out.add((a[0], a[1], d, best[1]))
    return out


def found(df):
    return {(r.doc_id, r.span_idx, r.direction, r.neighbour_idx) for r in df.collect()}


@pytest.mark.parametrize("seed,sizes", [(1, [1, 2, 3, 30, 64, 65]), (2, [150, 5, 220]), (3, [90])])
def test_same_as_all_pairs(spark, seed, sizes):
    rows = make(seed, sizes)
    assert found(S.neighbours(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_long_documents_by_join(spark, monkeypatch):
    rows = make(4, [40, 3, 70])
    monkeypatch.setattr(S, "SPANS_A_TASK", 30)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(S.neighbours(df)) == brute(rows)
    g = {(r.doc_id, r.span_idx, d, int(r[d][1:])) for r in S.graph(df).collect() for d in S.DIRECTIONS if r[d] is not None}
    assert g == brute(rows) and S.graph(df).count() == len(rows)


def test_only_wanted_spans(spark):
    rows = make(5, [80, 10])
    got = S.beside_texts(spark.createDataFrame(rows, SCHEMA), F.col("span_idx") % 3 == 0, ("right",), []).where("right_idx IS NOT NULL")
    assert {(r.doc_id, r.span_idx, "right", r.right_idx) for r in got.collect()} == {e for e in brute(rows) if e[2] == "right" and e[1] % 3 == 0}


def test_small_windows_and_chunks(spark, monkeypatch):
    for name, value in (("PAIR_ALL", 0), ("WINDOW", 4.0), ("PAIRS", 7)):
        monkeypatch.setattr(nearest, name, value)
    rows = make(6, [40, 25])
    table = pa.table([pa.array(c) for c in zip(*((r[0], r[1], *r[3:], True) for r in rows))], names=["d", "i", "x0", "y0", "x1", "y1", "w"])
    out = set()

    def give(t, best, dist):
        docs, idx = t.column(0).to_pylist(), t.column(1).to_pylist()
        for d in S.DIRECTIONS:
            out.update((docs[k], idx[k], d, idx[b]) for k, b in enumerate(best[d].tolist()) if b >= 0)
        return iter(())

    for size in (1, 7, 33, 100):
        out.clear()
        assert list(nearest.with_nearest(iter(table.to_batches(max_chunksize=size)), S.DIRECTIONS, give)) == []
        assert out == brute(rows)
