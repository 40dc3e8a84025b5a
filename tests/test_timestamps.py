import datetime as dt
import random
from zoneinfo import ZoneInfo

from folioscope.operators import timestamps as T

SCHEMA = "src string, ref_id long, field_name string, text string, zone string, grp string, ingested_at timestamp, extra string"


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.ref_id: r for r in T.normalise(df).collect()}


def row(i, text, zone=None, grp="g", at=None, src="call"):
    return (src, i, "f", text, zone, grp, at or dt.datetime(2025, 6, 1, 12, tzinfo=dt.timezone.utc), None)


def test_verdicts(spark):
    cases = [
        ("2025-03-30 02:30:00", "Europe/Berlin", "gap"), ("2025-10-26 02:30:00", "Europe/Berlin", "fold"), ("2025-10-26 02:30:00+01:00", "Europe/Berlin", "plain"),
        ("2025-10-26 02:30:00 CET", "Europe/Berlin", "plain"), ("2024-03-10T02:15:00", "America/New_York", "gap"), ("2024-11-03 01:15", "America/New_York", "fold"),
        ("2025-06-01 23:30:00", "America/New_York", "shifted"), ("2025-06-01T00:10:00+02:00[Europe/Berlin]", None, "shifted"), ("Mon, 02 Jun 2025 00:10:00 +0200", None, "shifted"),
        ("2025-06-01 12:00:00", None, "unknown"), ("2025-02-30 10:00:00", "UTC", "unknown"), ("2025-13-01T00:00:00Z", None, "unknown"), ("", "UTC", "unknown"), ("n/a", "UTC", "unknown"),
        ("25:61 yesterday", "UTC", "unknown"), ("0000-00-00 00:00:00", "UTC", "unknown"), ("2025-06-01", "UTC", "unknown"), ("2025-06-01 12:00:00", "Nowhere/Town", "unknown"),
        ("1748779200", None, "plain"), ("1748779200123", None, "plain"), ("1748779200123456", None, "plain"), ("1748779200.5", None, "plain"), ("20250601T133201Z", None, "plain"),
        ("12. März 2025 01:14", "UTC", "plain"), ("8 avril 2024 01:09", "Asia/Tokyo", "shifted"), ("23 mayo 2025 23:24", "UTC", "plain"), ("06-May-2024 14:24", "UTC", "plain"),
        ("2025-06-01T12:00:00+99:00", "UTC", "plain"), ("2025-04-06 01:45:00", "Australia/Lord_Howe", "fold"), ("2025-06-01 12:60:00", "UTC", "unknown"), ("x" * 100_000, "UTC", "unknown"),
        ("24. Foo 2025 10:00", "UTC", "unknown"), ("2025-06-01 00:00:00.123456789", "UTC", "plain"), ("5 juin 2025 12:00", "UTC", "plain"),
    ]
    got = run(spark, [row(i, t, z) for i, (t, z, _) in enumerate(cases)])
    assert [(t[:40], got[i].verdict) for i, (t, _, _) in enumerate(cases)] == [(t[:40], v) for t, _, v in cases]
    assert got[18].utc == got[19].utc.replace(microsecond=0) == dt.datetime(2025, 6, 1, 12)
    assert run(spark, [row(0, None, "UTC"), row(1, "1748779200", None)]).keys() == {1}


def test_against_zoneinfo(spark):
    rng = random.Random(5)
    zones = ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "UTC"]
    rows, want = [], {}
    for i in range(300):
        z = rng.choice(zones)
        local = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(2 * 365 * 86400) // 900 * 900)
        if i % 3 == 0:
            local = rng.choice([dt.datetime(2024, 3, 31, 1), dt.datetime(2024, 10, 27, 1), dt.datetime(2024, 3, 10, 1), dt.datetime(2024, 11, 3, 0), dt.datetime(2024, 4, 7, 1), dt.datetime(2024, 10, 6, 1)]) + dt.timedelta(minutes=15 * rng.randrange(12))
        a, b = (local.replace(tzinfo=ZoneInfo(z), fold=f).astimezone(dt.timezone.utc) for f in (0, 1))
        real = a.astimezone(ZoneInfo(z)).replace(tzinfo=None) == local
        want[i] = "gap" if not real else "fold" if a != b else "shifted" if a.date() != local.date() else "plain"
        rows.append(row(i, local.strftime("%Y-%m-%d %H:%M:%S"), z))
    got = run(spark, rows)
    assert {i: got[i].verdict for i in want} == want


def test_day_first(spark):
    rows = [row(0, "13/02/2025 10:00:00", "UTC", "eu"), row(1, "02/03/2025 10:00:00", "UTC", "eu"), row(2, "02/13/2025 1:00:00 PM", "UTC", "us"), row(3, "02/03/2025 12:05:00 AM", "UTC", "us"),
            row(4, "05/06/2025 10:00:00", "UTC", "near", dt.datetime(2025, 5, 6, 11, tzinfo=dt.timezone.utc)), row(5, "05/06/2025 10:00:00", "UTC", None)]
    got = run(spark, rows)
    assert got[1].utc == dt.datetime(2025, 3, 2, 10) and got[3].utc == dt.datetime(2025, 2, 3, 0, 5) and got[2].utc == dt.datetime(2025, 2, 13, 13)
    assert got[4].utc == dt.datetime(2025, 5, 6, 10) and got[5].verdict == "plain"


def test_missing_zones(spark):
    """Times of one machine without zone; ingestion follows within the hour, so only its zone fits."""
    rng, rows, i = random.Random(2), [], 0
    for zone, lost in (("Asia/Tokyo", True), ("America/New_York", False), ("Asia/Tokyo", False), ("UTC", False)):
        for day in range(1, 11):
            for _ in range(5):
                i += 1
                u = dt.datetime(2025, 3, day, rng.randrange(24), rng.randrange(60), tzinfo=dt.timezone.utc)
                text = u.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S")
                rows.append(row(i, text, None if lost else zone, f"{zone}{lost}", u + dt.timedelta(minutes=rng.randrange(1, 60))))
    got = run(spark, rows)
    guesses = [got[k].zone_guess for k in range(1, 51)]
    assert guesses.count("Asia/Tokyo") == 50 and got[1].verdict == "unknown" and got[1].utc is None and got[1].utc_guess is not None
    assert all(got[k].zone_guess is None for k in range(51, 200))


def test_empty(spark):
    assert run(spark, []) == {}


def test_hidden_zones_are_found(spark):
    rng, rows, i = random.Random(3), [], 0
    for zone in ("Asia/Tokyo", "America/New_York", "UTC"):
        for day in range(1, 8):
            for _ in range(4):
                i += 1
                u = dt.datetime(2025, 3, day, rng.randrange(24), rng.randrange(60), tzinfo=dt.timezone.utc)
                rows.append(row(i, u.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S"), zone, zone, u + dt.timedelta(minutes=rng.randrange(1, 60))))
    texts = spark.createDataFrame(rows, SCHEMA)
    got = T.zone_accuracy(texts).collect()[0]
    assert got.n == got.n_guessed == i and got.n_same_utc >= 0.95 * i
    assert T.zone_accuracy(texts.limit(0)).count() == 0
