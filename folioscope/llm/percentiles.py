"""Problem 3: percentiles of very large numeric columns by radix selection.

Values become 64-bit integers in the same order; each pass histograms the next ``DIGIT`` bits of
the values whose higher bits lead to a wanted rank, and follows the digit that holds it. Histograms
of partitions or days are added up, so results can be combined. After all passes the value is
exact; after ``passes`` passes its relative error is at most ``error_bound(passes)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import broadcast_if_small, materialize

DIGIT = 16
PASSES = 64 // DIGIT
#: Bits of a digit that tell the digits of one block apart.
BLOCK_BITS = 12
#: Targets (groups times percentiles) up to which they are broadcast to the next pass.
BROADCAST_TARGETS = 200_000


def error_bound(passes: int) -> float:
    """Largest relative error when ``passes`` digits are known: a double has one sign bit, eleven
    exponent bits and then bits of its fraction, and the middle of the interval is returned."""
    fraction = passes * DIGIT - 12
    return 0.0 if passes >= PASSES else 2.0 ** -(max(0, fraction) + 1)


def double_key(x: Column) -> Column:
    """IEEE bits of a double rebuilt from its exponent and fraction, as a signed order-preserving
    integer: sign * (exponent << 52 | fraction). Exact for all doubles but NaN."""
    a = F.abs(x)
    e0 = F.greatest(F.floor(F.log2(F.when(a > 0, a))).cast("int"), F.lit(-1022))
    # log2 may round up or down at powers of two
    e1 = e0 + F.when(_pow2(e0 + 1) <= a, 1).when(_pow2(e0) > a, -1).otherwise(0)
    e = F.greatest(e1, F.lit(-1022))
    normal = a >= F.lit(2.2250738585072014e-308)
    fraction = F.when(normal, (_scale(a, e) - 1.0) * F.lit(4503599627370496.0)).otherwise(
        a / F.lit(4.9e-324)
    )
    magnitude = F.when(a == 0, F.lit(0).cast("long")).when(a == F.lit(float("inf")), F.lit(2047 << 52)).otherwise(
        F.shiftleft(F.when(normal, e + 1023).otherwise(0).cast("long"), 52) + fraction.cast("long")
    )
    return F.when(x < 0, -magnitude).otherwise(magnitude)


def _pow2(e: Column) -> Column:
    return F.pow(F.lit(2.0), e.cast("double"))


def _scale(a: Column, e: Column) -> Column:
    """a / 2**e without overflow."""
    half = F.floor(e / 2)
    return a / _pow2(half) / _pow2(e - half)


def key_value(k: Column) -> Column:
    """The double of an order key."""
    m = F.abs(k)
    e = F.shiftright(m, 52)
    fraction = m.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    half = F.floor((e - 1023) / 2)
    normal = (1.0 + fraction / F.lit(4503599627370496.0)) * _pow2(half) * _pow2(e - 1023 - half)
    v = F.when(e == 0, fraction * F.lit(4.9e-324)).otherwise(normal)
    return F.when(k < 0, -v).otherwise(v)


def _prefix(key: Column, passes: int) -> Column:
    """The first ``passes`` digits of the key."""
    return F.shiftright(key, 64 - DIGIT * passes)


def histogram(values: DataFrame, group: list[str], by: list[str] | None = None, digits: int = 1) -> DataFrame:
    """Histogram of values(*group, *by, value) by their first ``digits`` digits: (*group, *by, digit, n).
    Histograms of different days or partitions are combined by adding ``n`` per group and digit. One digit
    makes a small table; with two, what is read off is within ``error_bound(2)``, 2**-21 of the value."""
    keyed = values.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    return keyed.groupBy(*group, *(by or []), _prefix(double_key(F.col("value").cast("double")), digits).alias("digit")).agg(
        F.count("*").alias("n")
    )


def combine(histograms: DataFrame, group: list[str]) -> DataFrame:
    return histograms.groupBy(*group, "digit").agg(F.sum("n").alias("n"))


def from_histogram(histograms: DataFrame, group: list[str], ps: list[float], digits: int = 1) -> DataFrame:
    """(*group, p, n, value) read off combined histograms (*group, digit, n), within ``error_bound(digits)``;
    ``percentiles`` follows the digits further and is exact. The digits of a group are as many as its values
    are apart; where they are more than one task should sort, blocks of 2**BLOCK_BITS digits are summed up first."""
    block = F.shiftright("digit", BLOCK_BITS)
    blocks = materialize(histograms.groupBy(*group, block.alias("block")).agg(F.sum("n").alias("in_block")), "p3-blocks")
    up_to = Window.partitionBy(*group).orderBy("block")
    blocks = blocks.withColumn("before", F.sum("in_block").over(up_to) - F.col("in_block")).withColumn("total", F.sum("in_block").over(Window.partitionBy(*group)))
    wanted = blocks.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in ps)))).withColumn(
        "rank", F.greatest(F.lit(1).cast("long"), F.ceil(F.round(F.col("p") * F.col("total"), 9)).cast("long"))
    )
    in_block = wanted.where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("in_block")))
    theirs = in_block.select(*(F.col(g).alias(f"t_{g}") for g in group), F.col("block").alias("t_block"), "p", "total", (F.col("rank") - F.col("before")).alias("rank"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"t_{g}")) for g in group], block == F.col("t_block"))
    few = broadcast_if_small(theirs, BROADCAST_TARGETS, blocks.count() * len(ps))
    inside = histograms.withColumn("upto", F.sum("n").over(Window.partitionBy(*group, block).orderBy("digit"))).join(few, same)
    hit = inside.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    shift = 64 - DIGIT * digits
    low = F.shiftleft(F.col("digit"), shift)
    middle = key_value(low + F.lit(1 << (shift - 1)))
    return hit.select(*group, "p", F.col("total").alias("n"), F.when(F.col("digit") == 0, 0.0).otherwise(middle).alias("value"))


def percentiles(values: DataFrame, group: list[str], ps: list[float], passes: int = PASSES) -> DataFrame:
    """(*group, p, n, value) with the smallest value whose share of values up to it is at least
    ``p``, exactly or, with fewer passes, within ``error_bound(passes)``.

    values(*group, value): null and NaN values don't count; a null group is a group; groups without
    values don't come out. Ties and repeated rows count as they are.
    """
    keys = values.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).select(
        *(F.col(g) for g in group), double_key(F.col("value").cast("double")).alias("key")
    )
    safe = [f"g{i}" for i in range(len(group))]
    keys = materialize(keys.toDF(*safe, "key"), "p3-keys")  # each pass reads it again
    hist = materialize(keys.groupBy(*safe, _prefix(F.col("key"), 1).alias("digit")).agg(F.count("*").alias("n")), "p3-hist")
    up_to = Window.partitionBy(*safe).orderBy("digit")
    whole = Window.partitionBy(*safe)
    cum = hist.withColumn("upto", F.sum("n").over(up_to)).withColumn("total", F.sum("n").over(whole))
    wanted = cum.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in ps)))).withColumn(
        "rank", F.greatest(F.lit(1).cast("long"), F.ceil(F.round(F.col("p") * F.col("total"), 9)).cast("long"))
    )
    target = wanted.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))).select(
        *safe, "p", "total", F.col("digit").alias("prefix"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")
    )
    target = materialize(target, "p3-target")
    for k in range(2, passes + 1):
        n_targets = target.count()
        theirs = target.toDF(*(f"t_{c}" for c in target.columns))
        wanted_prefix = theirs.select(*(f"t_{g}" for g in safe), "t_prefix").distinct()
        same = reduce(
            lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"t_{g}")) for g in safe], _prefix(F.col("key"), k - 1) == F.col("t_prefix")
        )
        wanted_prefix = broadcast_if_small(wanted_prefix, BROADCAST_TARGETS, n_targets)
        inside = keys.join(wanted_prefix, same, "left_semi")
        hist = inside.groupBy(*safe, _prefix(F.col("key"), k).alias("digit")).agg(F.count("*").alias("n"))
        hist = hist.withColumn("prefix", F.shiftright("digit", DIGIT))
        up_to = Window.partitionBy(*safe, "prefix").orderBy("digit")
        cum = hist.withColumn("upto", F.sum("n").over(up_to))
        same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"t_{g}")) for g in safe], F.col("prefix") == F.col("t_prefix"))
        hit = cum.join(broadcast_if_small(theirs, BROADCAST_TARGETS, n_targets), same).where(
            (F.col("t_rank") <= F.col("upto")) & (F.col("t_rank") > F.col("upto") - F.col("n"))
        )
        target = hit.select(
            *safe, F.col("t_p").alias("p"), F.col("t_total").alias("total"), F.col("digit").alias("prefix"),
            (F.col("t_rank") - F.col("upto") + F.col("n")).alias("rank"),
        )
        target = materialize(target, "p3-target")
    shift = 64 - DIGIT * passes
    low = F.shiftleft(F.col("prefix"), shift)
    middle = low if shift == 0 else low + F.lit(1 << (shift - 1))
    return target.select(
        *(F.col(s).alias(g) for s, g in zip(safe, group)), "p", F.col("total").alias("n"), key_value(middle).alias("value")
    )


def call_latencies(calls: DataFrame) -> DataFrame:
    """(model, log_date, value): one row per call (the first delivery), without calls that got no
    answer (null or negative latency)."""
    first = calls.groupBy("call_id").agg(F.min_by(F.struct("model", "log_date", "latency_ms"), "ingested_at").alias("c"))
    return first.where("c.latency_ms >= 0").select("c.model", "c.log_date", F.col("c.latency_ms").cast("double").alias("value"))


def entry_durations(entries: DataFrame) -> DataFrame:
    """(layout_id, was_cached, value): one row per batch entry, without missing or negative durations."""
    first = entries.groupBy("entry_id").agg(
        F.min_by(F.struct("layout_id", "was_cached", "duration_ms"), "finished_at").alias("c")
    )
    return first.where("c.duration_ms >= 0").select("c.layout_id", "c.was_cached", F.col("c.duration_ms").cast("double").alias("value"))
