"""Problem 8: mixing sources to target weights by systematic sampling.

Each document's expected copies are summed up in a random order within its source; with one random
offset a document comes out once for each whole number that its stretch crosses. The prefix sums
are made in two levels, so no source is ever gathered into one task: counts per bucket, then the
position inside the bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.tokens import RANKS, token_count
from folioscope.session import broadcast_if_small, materialize

#: Rows aimed at in a bucket, the unit that is sorted in one task.
BUCKET_ROWS = 100_000
BROADCAST_SOURCES = 100_000
SEED = 17


def sized(documents: DataFrame, tokenizer: str = RANKS) -> DataFrame:
    """(doc_id, source, n_tokens), one row per document; null texts have no tokens."""
    return documents.select("doc_id", "source", token_count(F.col("text"), tokenizer).alias("n_tokens"))


def rates(totals: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, copies): expected copies of each document so that every source reaches its share of
    ``total_tokens``. Without it the total is the largest that all sources can serve within their
    ``max_repeats``. With it, a source that can't serve its share gives ``max_repeats`` copies.
    Sources without target, with a share of 0 or without tokens give none. targets has one row a
    source; repeated rows must agree."""
    t = targets.groupBy(F.col("source_name").alias("source")).agg(
        F.max("target_share").alias("share"), F.max("max_repeats").alias("max_repeats")
    )
    b = t.join(totals, "source").where("share > 0 AND max_repeats > 0 AND tokens > 0")
    everything = Window.partitionBy()
    size = F.min(F.col("max_repeats") * F.col("tokens") / F.col("share")).over(everything) if total_tokens is None else F.lit(float(total_tokens))
    return b.withColumn("size", size).select(
        "source", F.least(F.col("max_repeats").cast("double"), F.col("share") * F.col("size") / F.col("tokens")).alias("copies")
    )


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, tokenizer: str = RANKS) -> DataFrame:
    """(doc_id, source, n_tokens, copy_no): the sample, a document with k copies in k rows, copy_no
    from 1. Documents without source, or of a source without target, don't come out. The order of
    the sum follows document length (in powers of two) and then a hash of doc_id and seed, which
    spreads the sample over short and long documents; ties of the hash fall back on doc_id."""
    docs = materialize(sized(documents.where("source is not null"), tokenizer), "p8-sized")
    totals = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    totals = materialize(totals, "p8-totals")
    rate = materialize(rates(totals, targets, total_tokens), "p8-rates")
    n_buckets = F.greatest(F.lit(1), F.ceil(F.col("rows") / BUCKET_ROWS)).cast("int")
    per_source = materialize(totals.select("source", n_buckets.alias("n_buckets")).join(rate, "source"), "p8-sources")  # a row a source
    per_source = broadcast_if_small(per_source, BROADCAST_SOURCES)
    h = F.xxhash64(F.lit(seed), "doc_id")
    placed = (
        docs.join(per_source, "source")
        .withColumn("h", h)
        .withColumn("stratum", F.floor(F.log2(F.col("n_tokens") + 1)).cast("int"))
        .withColumn("bucket", F.pmod(F.shiftright("h", 8), F.col("n_buckets")).cast("int"))
    )
    counts = placed.groupBy("source", "stratum", "bucket").agg(F.count("*").alias("n_in"))
    before = Window.partitionBy("source").orderBy("stratum", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n_in").over(before), F.lit(0))).drop("n_in")
    inside = Window.partitionBy("source", "stratum", "bucket").orderBy("h", "doc_id")
    ranked = placed.join(starts, ["source", "stratum", "bucket"]).withColumn(
        "pos", F.col("before") + F.row_number().over(inside) - 1
    )
    offset = F.pmod(F.xxhash64(F.lit(seed), "source", F.lit("offset")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    crossed = F.floor((F.col("pos") + 1) * F.col("copies") + offset) - F.floor(F.col("pos") * F.col("copies") + offset)
    return (
        ranked.withColumn("n_copies", crossed.cast("int"))
        .where("n_copies > 0")
        .select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"))
    )


def mix_shares(sample: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, docs, rows, tokens, actual_share, most_copies) of a sample,
    one row a target source; sources that gave nothing have zeros."""
    s = sample.groupBy("source").agg(
        F.countDistinct("doc_id").alias("docs"), F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"),
        F.max("copy_no").alias("most_copies"),
    )
    t = targets.groupBy(F.col("source_name").alias("source")).agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("docs", "rows", "tokens", "most_copies")]
    out = t.join(s, "source", "left").select("source", "target_share", "max_repeats", *zero)
    return out.withColumn("actual_share", F.coalesce(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), F.lit(0.0)))
