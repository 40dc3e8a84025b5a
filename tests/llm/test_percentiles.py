import math
import random

import pytest
from pyspark.sql import functions as F

from folioscope.llm import percentiles as P

PS = [0.0, 0.01, 0.5, 0.9, 0.99, 1.0]


def exact(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(round(p * len(v), 9))) - 1]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", None]), rng.choice([rng.gauss(0, 1e3), rng.expovariate(1e-9), float(rng.randrange(5)), -0.0, 1e308, 5e-324, -1e-310])) for _ in range(4000)]
    return rows + [("one", 7.0), ("none", None), ("nan", float("nan")), ("inf", float("inf")), ("inf", float("-inf"))]


def test_exact(spark, data):
    df = spark.createDataFrame([(*r, 1) for r in data], "g string, value double, digit int")
    got = {(r.g, r.p): (r.n, r.value) for r in P.percentiles(df, ["g"], PS).collect()}
    groups = {g for g, v in data if v is not None and not math.isnan(v)}
    assert {g for g, _ in got} == groups
    for g in groups:
        values = [v for h, v in data if h == g and v is not None]
        for p in PS:
            assert got[g, p] == (len(values), exact(values, p)), (g, p)


@pytest.mark.parametrize("passes", [1, 2, 3])
def test_error_bound(spark, data, passes):
    df = spark.createDataFrame([r for r in data if r[1] is not None and 1e-300 < abs(r[1]) < 1e300], "g string, value double")
    rows = df.collect()
    for r in P.percentiles(df, ["g"], [0.1, 0.5, 0.99], passes).collect():
        want = exact([x.value for x in rows if x.g == r.g], r.p)
        assert abs(r.value - want) <= P.error_bound(passes) * abs(want) * (1 + 1e-12)


def test_days_combine(spark, data):
    df = spark.createDataFrame([(*r, i % 5) for i, r in enumerate(data) if r[1] is not None and not math.isnan(r[1])], "g string, value double, day int")
    whole = P.histogram(df, ["g"])
    days = P.combine(P.histogram(df, ["g"], ["day"]), ["g"])
    assert sorted(map(str, whole.collect())) == sorted(map(str, days.select(*whole.columns).collect()))
    read = {(r.g, r.p): r.value for r in P.from_histogram(days, ["g"], [0.5]).collect()}
    one = {(r.g, r.p): r.value for r in P.percentiles(df, ["g"], [0.5], 1).collect()}
    assert all(math.isclose(read[k], one[k], rel_tol=1e-9, abs_tol=1e-300) or abs(one[k]) < 1e-300 for k in one)


def test_order_keys(spark):
    rng = random.Random(9)
    xs = [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), 1.0, 2.0, 4.0, 0.1] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(500)]
    xs += [-x for x in xs]
    rows = spark.createDataFrame([(x,) for x in xs], "v double").select("v", P.double_key(F.col("v")).alias("k")).withColumn("b", P.key_value(F.col("k"))).collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.k)] == sorted(xs) and all(r.b == r.v for r in rows)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, value double")
    assert P.percentiles(df, ["g"], [0.5]).count() == 0


def test_sources(spark):
    calls = spark.createDataFrame([(1, "m", None, 5, 10), (1, "m", None, 5, 20), (2, "m", None, -1, 1), (3, None, None, None, 1)], "call_id long, model string, log_date date, latency_ms long, ingested_at long")
    assert [r.value for r in P.call_latencies(calls).collect()] == [5.0]
