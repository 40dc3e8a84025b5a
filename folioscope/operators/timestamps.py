"""Problem 5: timestamps in mixed formats and time zones, brought to one UTC instant.

Texts are taken apart and converted by built-in expressions. Whether a group writes day or month
first is decided by its own unambiguous dates, then by which order fits the ingestion times better.
Missing zones are estimated: local times are aligned with ingestion times under every zone named in
the data, and per group and day the history of zones is chosen that violates least what is known of the
source: how long texts wait for their ingestion, how common each zone is and how often the zone changes
from one text to the next. Estimates don't touch the verdict, which
says what the text itself leaves open; how good they are is measured by hiding the zones that are known
(``zone_accuracy``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.text import once
from folioscope.session import broadcast_if_small, materialize

#: Delays from a time to its ingestion that are told apart, in quarters of an hour; longer and shorter ones
#: count as these.
EARLIEST, LATEST = -100, 200
#: The same for the distance between local time and ingestion.
FARTHEST = 400
#: Times that something never seen counts as seen.
RARE = 0.1
NO_GROUP = "\x00"
BROADCAST_ROWS = 200_000
#: Seconds of a quarter of an hour: delays are counted in such steps.
STEP = 900

# Month names in English, German, French and Spanish, as abbreviations and in full.
MONTHS = (
    ("jan", "january", "januar", "jänner", "janvier", "janv", "enero", "ene"),
    ("feb", "february", "februar", "février", "fevrier", "févr", "febrero"),
    ("mar", "march", "märz", "maerz", "mär", "mrz", "mars", "marzo"),
    ("apr", "april", "avril", "avr", "abril", "abr"),
    ("may", "mai", "mayo"),
    ("jun", "june", "juni", "juin", "junio"),
    ("jul", "july", "juli", "juillet", "juil", "julio"),
    ("aug", "august", "août", "aout", "agosto", "ago"),
    ("sep", "sept", "september", "septembre", "septiembre"),
    ("oct", "october", "oktober", "okt", "octobre", "octubre"),
    ("nov", "november", "novembre", "noviembre"),
    ("dec", "december", "dezember", "dez", "décembre", "decembre", "déc", "diciembre", "dic"),
)
# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "ACST": 570,
    "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_ZONE = r"(Z|z|[+-]\d{2}(?::?\d{2})?|[A-Z]{2,5})?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
#: Each pattern is rewritten to year|month|day|hour|minute|second|fraction|zone|region|am or pm.
_ISO = rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[Tt ]{_TIME} ?{_ZONE}(?:\[([A-Za-z0-9_/+\-]+)\])?$"
_COMPACT = rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}}){_ZONE}$"
_NAMED = rf"^(?:\p{{L}}+\.?,? +)?(\d{{1,2}})(?:\. ?| |-)(\p{{L}}+)\.?[ -](\d{{4}}),? +{_TIME} ?{_ZONE}$"
_SLASHES = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? +{_TIME} ?([AaPp][Mm])?$"
_EPOCH = r"^-?\d{9,19}(?:\.\d{1,9})?$"


def java_zones(spark: SparkSession) -> list[str]:
    """Zone names the JVM knows; about 600, whatever the data."""
    return sorted(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())


def _parts(text: Column) -> Column:
    iso = F.regexp_replace(text, _ISO, "$1|$2|$3|$4|$5|$6|$7|$8|$9|")
    compact = F.regexp_replace(text, _COMPACT, "$1|$2|$3|$4|$5|$6||$7||")
    named = F.regexp_replace(text, _NAMED, "$3|$2|$1|$4|$5|$6|$7|$8||")
    slashes = F.regexp_replace(text, _SLASHES, "$3|$1/|$2|$4|$5|$6|$7|||$8")
    how = (
        F.when(text.rlike(r"^\d{4}-"), iso)
        .when(text.rlike(r"^\d{8}T"), compact)
        .when(text.rlike(r"^\d{1,2}/"), slashes)
        .when(text.rlike(r"^(?:\p{L}|\d{1,2}[. -])"), named)
    )
    return F.split(how, r"\|", 10)


def _month(name: Column) -> Column:
    numbers = F.create_map(*(F.lit(x) for no, names in enumerate(MONTHS, 1) for n in names for x in (n, no)))
    return F.try_element_at(numbers, F.lower(name))


def _time(p: Column) -> Column:
    """Microseconds since midnight; null where there is no such time."""
    h, mi = p[3].try_cast("int"), p[4].try_cast("int")
    s = F.when(p[5] == "", 0).otherwise(p[5].try_cast("int"))
    half = F.lower(p[9])
    hour = F.when(half == "", h).when((h < 1) | (h > 12), None).otherwise(h % 12 + F.when(half == "pm", 12).otherwise(0))
    micros = F.rpad(F.substring(p[6], 1, 6), 6, "0").cast("int")
    return F.when(hour.between(0, 23) & mi.between(0, 59) & s.between(0, 59), (hour * 3600 + mi * 60 + s).cast("long") * 1_000_000 + micros)


def _instant(y: Column, m: Column, d: Column, time: Column) -> Column:
    """The written local time as if it were UTC; null where there is no such date or time."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    longest = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    day = F.when((y >= 1) & m.between(1, 12) & d.between(1, longest), F.make_date(y, m, d))
    return F.timestamp_micros(F.unix_date(day).cast("long") * 86_400_000_000 + time)


def parse(texts: DataFrame) -> DataFrame:
    """Adds to texts(..., text): ``epoch`` (instant of a number since 1970), ``local`` (written time
    as if UTC, for slashes with the day first), ``local_mdy`` (slashes with the month first), ``offset``
    (minutes, where the text has one) and ``region`` (a zone name in the text)."""
    t = F.trim(F.col("text"))
    whole = F.length(F.regexp_extract(t, r"^-?(\d+)", 1))
    scale = F.when(whole <= 11, 1_000_000).when(whole <= 14, 1_000).when(whole <= 17, 1)
    is_number = t.rlike(_EPOCH)
    number = F.when(is_number, t).try_cast("decimal(29,9)")
    micros = F.when(whole > 17, F.floor(number / 1000)).otherwise(number * scale).cast("decimal(38,0)").cast("long")
    rows = once(texts, p=_parts(t), epoch=F.when(is_number, F.timestamp_micros(micros)))
    rows = once(rows, p=F.when(F.size("p") == 10, F.col("p")))
    p = F.col("p")
    fit = p.isNotNull()
    slash = p[1].endswith("/")
    first = F.when(slash, F.regexp_replace(p[1], "/", "")).when(p[1].rlike("^[0-9]"), p[1]).try_cast("int")
    rows = once(rows, y=p[0].try_cast("int"), a=F.coalesce(first, _month(p[1])), b=p[2].try_cast("int"), time=_time(p), by_slash=fit & slash)
    slash, y, a, b = F.col("by_slash"), F.col("y"), F.col("a"), F.col("b")
    zone = F.upper(p[7])
    digits = F.regexp_replace(p[7], ":", "")
    signed = F.substring(digits, 2, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 4, 2).try_cast("int"), F.lit(0))
    abbreviation = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    offset = (
        F.when(~fit | (p[7] == ""), None).when(zone == "Z", 0).when(p[7].startswith("-"), -signed).when(p[7].startswith("+"), signed)
        .otherwise(F.try_element_at(abbreviation, zone))
    )
    offset = F.when(F.abs(offset) <= 18 * 60, offset)
    return once(
        rows,
        local=_instant(y, F.when(slash, b).otherwise(a), F.when(slash, a).otherwise(b), F.col("time")),
        local_mdy=F.when(slash, _instant(y, a, b, F.col("time"))),
        slash=F.when(slash, F.struct(a.alias("a"), b.alias("b"))),
        offset=offset,
        region=F.when(fit & (p[8] != ""), p[8]),
    ).drop("p", "y", "a", "b", "time", "by_slash")


def _day_first(parsed: DataFrame) -> DataFrame:
    """(src, grp, day_first) of groups that write dates with slashes."""
    known = F.col("slash").isNotNull()
    late = lambda c: F.count_if(F.abs(F.unix_seconds(c) - F.unix_seconds("ingested_at")) > 3 * 86_400)
    per = parsed.where(known).groupBy("src", "grp").agg(
        F.count_if(F.expr("slash.a > 12")).alias("dmy"), F.count_if(F.expr("slash.b > 12")).alias("mdy"),
        late(F.col("local")).alias("far_dmy"), late(F.col("local_mdy")).alias("far_mdy"),
    )
    return per.select(
        "src", "grp", F.when(F.col("dmy") != F.col("mdy"), F.col("dmy") > F.col("mdy")).otherwise(F.col("far_dmy") <= F.col("far_mdy")).alias("day_first")
    )


def _histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The zone of each step so that a day's history of zones costs least (dynamic programme over the
    day's steps; ties go to the first zone in the alphabet). Rows come sorted by src, grp, day and step."""
    kinds = (pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.string())
    key, steps = None, []

    def history() -> list[tuple]:
        cost, back = None, []
        for s in steps:
            fit = s["n"] * np.array(s["cost"])
            if cost is None:
                cost = fit + np.array(s["prior"])
            else:
                stay, move = cost + s["stay"], cost.min() + s["move"] + np.array(s["prior"])
                back.append(np.where(stay <= move, np.arange(len(cost)), int(cost.argmin())))
                cost = fit + np.minimum(stay, move)
        at, picked = int(cost.argmin()), []
        for i in range(len(steps) - 1, -1, -1):
            s = steps[i]
            picked.append((s["src"], s["grp"], s["hour"], s["wait"], s["zones"][at]))
            if i:
                at = int(back[i - 1][at])
        return picked

    for batch in batches:
        out = []
        for s in batch.to_pylist():
            k = (s["src"], s["grp"], s["day"])
            if k != key and steps:
                out += history()
                steps = []
            key = k
            steps.append(s)
        if out:
            yield _columns(out, kinds)
    if steps:
        yield _columns(history(), kinds)


def _columns(rows: list[tuple], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["src", "grp", "hour", "wait", "zone_guess"])


def verdicts(texts: DataFrame) -> DataFrame:
    """One row per row of texts(src, ref_id, field_name, text, zone, grp, ingested_at), without null texts:
    (src, ref_id, field_name, grp, named, local, utc, ingested_at, verdict).

    verdict: 'unknown' (no real date and time, or no zone anywhere), 'gap', 'fold', 'shifted' (the UTC
    date isn't the one written) or 'plain'. ``utc`` is the instant, null for 'unknown'; a time in a gap
    is moved on by the gap, of two times of a fold the first is taken. Zone names the JVM doesn't know
    count as none. Between day and month first, dates with slashes follow their group.
    """
    spark = texts.sparkSession
    valid = java_zones(spark)
    texts = materialize(texts.where("text IS NOT NULL"), "p5-texts")  # read for the order of dates and again for all
    order = materialize(_day_first(parse(texts.where(F.trim("text").rlike(r"^\d{1,2}/")))), "p5-order")
    parsed = parse(texts).join(broadcast_if_small(order, BROADCAST_ROWS), ["src", "grp"], "left")
    local = F.when(F.col("slash").isNotNull() & ~F.col("day_first"), F.col("local_mdy")).otherwise(F.col("local"))
    named = F.coalesce(F.when(F.col("region").isin(*valid), F.col("region")), F.when(F.col("zone").isin(*valid), F.col("zone")))
    rows = once(parsed, local=local, named=named)
    by_zone = F.to_utc_timestamp("local", F.col("named"))
    u = (
        F.when(F.col("epoch").isNotNull(), F.col("epoch"))
        .when(F.col("offset").isNotNull(), F.timestamp_micros(F.unix_micros("local") - F.col("offset").cast("long") * 60_000_000))
        .when(F.col("named").isNotNull(), by_zone)
    )
    rows = once(rows, utc=u)
    in_zone = F.col("epoch").isNull() & F.col("offset").isNull() & F.col("named").isNotNull() & F.col("local").isNotNull()
    back = lambda minutes: F.from_utc_timestamp(F.timestamp_micros(F.unix_micros("utc") + F.lit(minutes * 60_000_000).cast("long")), F.col("named"))
    twice = reduce(lambda a, b: a | b, [back(m) == F.col("local") for m in (60, -60, 30, -30)])
    verdict = (
        F.when(F.col("utc").isNull(), "unknown")
        .when(in_zone & (F.from_utc_timestamp("utc", F.col("named")) != F.col("local")), "gap")
        .when(in_zone & twice, "fold")
        .when(F.col("epoch").isNull() & (F.to_date("utc") != F.to_date("local")), "shifted")
        .otherwise("plain")
    )
    return once(rows, verdict=verdict).select(
        "src", "ref_id", "field_name", "grp", F.when(in_zone, F.col("named")).alias("named"), "local", "utc", "ingested_at", "verdict"
    )


def normalise(texts: DataFrame) -> DataFrame:
    """(src, ref_id, field_name, verdict, utc, zone_guess, utc_guess) of the rows of ``verdicts``.
    ``utc_guess`` is ``utc`` or, for a time without zone, that under the estimated zone."""
    rows = materialize(verdicts(texts), "p5-rows")
    guessed = _guess(rows, F.col("utc").isNull())
    final = F.coalesce("utc", F.to_utc_timestamp("local", F.col("zone_guess")))
    return guessed.select("src", "ref_id", "field_name", "verdict", "utc", "zone_guess", final.alias("utc_guess"))


def zone_accuracy(texts: DataFrame) -> DataFrame:
    """(src, n, n_guessed, n_same_zone, n_same_utc): how often the estimate finds a zone that is known.
    All texts whose zone is a name are taken as if they had none; usual delays and the names of zones come
    from the whole data, as they do for texts truly without zone."""
    rows = materialize(verdicts(texts), "p5-rows")
    guessed = _guess(rows, F.col("named").isNotNull()).where("named IS NOT NULL")
    right = F.to_utc_timestamp("local", F.col("zone_guess")) == F.col("utc")
    return guessed.groupBy("src").agg(
        F.count("*").alias("n"), F.count("zone_guess").alias("n_guessed"), F.count_if(F.col("zone_guess") == F.col("named")).alias("n_same_zone"),
        F.count_if(right).alias("n_same_utc"),
    )


def _facts(rows: DataFrame) -> DataFrame:
    """(src, zones, prior, usual, stay, move), a row a source, from the rows whose instant is known: names of
    zones and the cost of each, the cost of each delay in quarters of an hour, and what it costs to stay
    in a zone from one text of a group's day to the next or to move to another."""
    known = rows.where("utc IS NOT NULL AND ingested_at IS NOT NULL")
    waits = known.groupBy("src", _delay(F.floor((F.unix_seconds("ingested_at") - F.unix_seconds("utc")) / STEP)).alias("i")).agg(F.count("*").alias("n"))
    waits = waits.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"), F.sum("n").alias("all"))  # a delay is clipped: 302 at most
    n_delays = LATEST - EARLIEST + 1
    part = lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0)) + RARE) / (F.col("all") + RARE * n_delays)
    waits = waits.select("src", F.transform(F.sequence(F.lit(0), F.lit(n_delays - 1)), lambda i: -F.ln(part(i.cast("long")))).alias("usual"))
    zones = rows.where("named IS NOT NULL").groupBy("src", "named").agg(F.count("*").alias("n"))
    zones = zones.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("named", "n"))).alias("z"), F.sum("n").alias("all"))
    zones = zones.select("src", F.col("z.named").alias("zones"), F.transform("z.n", lambda n: -F.ln(n / F.col("all"))).alias("prior"))
    day = Window.partitionBy("src", "grp", F.to_date("local")).orderBy("local", "ref_id")
    moved = F.lag("named").over(day) != F.col("named")
    moves = rows.where("named IS NOT NULL").select("src", moved.alias("moved")).where("moved IS NOT NULL").groupBy("src").agg(
        ((F.count_if("moved") + RARE) / (F.count("*") + 2 * RARE)).alias("p")
    )
    p = F.coalesce("p", F.lit(0.5))
    return waits.join(zones, "src").join(moves, "src", "left").select("src", "zones", "prior", "usual", (-F.ln(1 - p)).alias("stay"), (-F.ln(p)).alias("move"))


def _delay(quarters: Column) -> Column:
    """Position of a delay in a list of costs."""
    return (F.greatest(F.lit(EARLIEST), F.least(F.lit(LATEST), quarters)) - EARLIEST).cast("long")


def _guess(rows: DataFrame, hidden: Column) -> DataFrame:
    """Adds ``zone_guess`` to the ``hidden`` rows that have a local time and a time of ingestion."""
    facts = materialize(_facts(rows), "p5-facts")
    open_ = hidden & F.col("local").isNotNull() & F.col("ingested_at").isNotNull()
    # offsets of zones are whole quarters of an hour and change at full hours, so rows of one hour whose delay
    # lies in the same quarter cost the same under every zone: they are counted before the zones are tried
    wait = F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.floor((F.unix_seconds("ingested_at") - F.unix_seconds("local")) / STEP)))
    rows = rows.withColumn("hour", F.when(open_, F.date_trunc("hour", "local"))).withColumn("wait", F.when(open_, wait))
    steps = rows.where("hour IS NOT NULL").groupBy("src", "grp", "hour", "wait").agg(F.count("*").alias("n"))
    offset = lambda z: ((F.unix_seconds("hour") - F.unix_seconds(F.to_utc_timestamp("hour", z))) / STEP).cast("long")
    cost = F.transform("zones", lambda z: F.get("usual", _delay(F.col("wait") + offset(z)).cast("int")))
    tried = steps.join(broadcast_if_small(facts, BROADCAST_ROWS), "src").select(
        "src", "grp", F.to_date("hour").alias("day"), "hour", "wait", "n", "zones", "prior", "stay", "move", cost.alias("cost")
    )
    sorted_ = tried.repartition("src", "grp", "day").sortWithinPartitions("src", "grp", "day", "hour", "wait")
    history = materialize(sorted_.mapInArrow(_histories, "src string, grp string, hour timestamp, wait long, zone_guess string"), "p5-history")
    at = ["src", "grp", "hour", "wait"]
    # a group without name is one as well
    named = history.withColumn("grp", F.coalesce("grp", F.lit(NO_GROUP)))
    found = rows.withColumn("g", F.coalesce("grp", F.lit(NO_GROUP))).join(broadcast_if_small(named, BROADCAST_ROWS).withColumnRenamed("grp", "g"), ["src", "g", "hour", "wait"], "left")
    return found.drop(*at[2:], "g")


def timestamp_texts(calls: DataFrame, records: DataFrame) -> DataFrame:
    """The timestamp texts of calls (each call once, as first ingested) and of readable records."""
    first = calls.groupBy("call_id").agg(F.min_by(F.struct("call_timestamp", "tz", "collector", "ingested_at"), "ingested_at").alias("c"))
    a = first.select(
        F.lit("call").alias("src"), F.col("call_id").alias("ref_id"), F.lit("call_timestamp").alias("field_name"),
        F.col("c.call_timestamp").alias("text"), F.col("c.tz").alias("zone"), F.col("c.collector").alias("grp"),
        F.col("c.ingested_at").alias("ingested_at"),
    )
    read = records.select("record_id", "layout_id", "extracted_at", F.try_parse_json("fields_json").alias("v"))
    b = read.select(
        F.lit("record").alias("src"), F.col("record_id").alias("ref_id"), F.lit("printed_at").alias("field_name"),
        F.try_variant_get("v", "$.printed_at", "string").alias("text"), F.try_variant_get("v", "$.time_zone", "string").alias("zone"),
        F.col("layout_id").alias("grp"), F.col("extracted_at").alias("ingested_at"),
    )
    return a.unionByName(b.where("text IS NOT NULL").dropDuplicates(["ref_id"]))
