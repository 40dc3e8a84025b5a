"""Figures of extraction runs: calls, costs, batches, latencies and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T


def first_calls(calls: DataFrame) -> DataFrame:
    """Each call once, as first ingested."""
    names = [c for c in calls.columns if c != "call_id"]
    one = calls.groupBy("call_id").agg(F.min_by(F.struct(*names), "ingested_at").alias("c"))
    return one.select("call_id", "c.*")


def call_summary(calls: DataFrame) -> DataFrame:
    u = "token_usage"
    return calls.agg(
        F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"),
        F.sum(f"{u}.input_tokens").alias("input_tokens"), F.sum(f"{u}.output_tokens").alias("output_tokens"),
        F.sum(f"{u}.estimated_cost_cents").alias("cost_cents"), F.coalesce(F.avg(F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))), F.lit(0.0)).alias("mean_latency_ms"),
    )


def cost_per_layout(calls: DataFrame) -> DataFrame:
    """Usage per layout and, with layout_id null, over all."""
    u = "token_usage"
    return calls.where("layout_id IS NOT NULL").rollup("layout_id").agg(
        F.count("*").alias("calls"), F.sum(f"{u}.input_tokens").alias("input_tokens"), F.sum(f"{u}.output_tokens").alias("output_tokens"), F.sum(f"{u}.estimated_cost_cents").alias("cost_cents")
    )


def budget_cutoff(calls: DataFrame, max_cents: int = 50) -> DataFrame:
    """(call_id, layout_id, spent, over): cost of a layout's calls up to and with each, in order of
    call_id, and whether it exceeds the budget. The sums are made per block of calls first, so a
    layout with very many calls isn't one task."""
    c = calls.where("layout_id IS NOT NULL").select("layout_id", "call_id", F.col("token_usage.estimated_cost_cents").cast("long").alias("cents"))
    c = c.withColumn("block", F.floor(F.col("call_id") / 4096))
    blocks = c.groupBy("layout_id", "block").agg(F.sum("cents").alias("sum"))
    before = Window.partitionBy("layout_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("layout_id", "block", F.coalesce(F.sum("sum").over(before), F.lit(0).cast("long")).alias("before"))
    inside = Window.partitionBy("layout_id", "block").orderBy("call_id")
    out = c.join(blocks, ["layout_id", "block"]).withColumn("spent", F.col("before") + F.coalesce(F.sum("cents").over(inside), F.lit(0)))
    return out.select("call_id", "layout_id", "spent", (F.col("spent") > max_cents).alias("over"))


def recent_calls(calls: DataFrame, n: int = 20) -> DataFrame:
    return calls.orderBy(F.desc("call_id")).limit(n)


def batch_summary(entries: DataFrame) -> DataFrame:
    e = entries.groupBy("entry_id").agg(F.min_by(F.struct("batch_no", "success", "was_cached"), "finished_at").alias("e"))
    ok = F.col("e.success")
    s = e.groupBy("e.batch_no").agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count_if(ok & F.col("e.was_cached")).alias("cached"))
    return s.withColumn("new", F.greatest(F.lit(0), F.col("succeeded") - F.col("cached")))


def dead_letters(entries: DataFrame) -> DataFrame:
    """(entry_id, path, error) of failed entries, each once."""
    e = entries.where("NOT success").groupBy("entry_id").agg(F.min_by(F.struct("path", "error"), "finished_at").alias("e"))
    return e.select("entry_id", "e.path", "e.error")


def latency_by_index(values: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, p50, p95, p99, mean): values at positions n/2, 0.95n and 0.99n of the sorted values
    (from 0). Positions come from counts of equal values, so no group is gathered as a list."""
    v = values.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    v = v.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("n") * share), F.col("v")))
    return v.groupBy(group).agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))


def field_scores(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, n_found, n_expected, hits, precision, recall, f1) of field names per document (0 for
    empty sides)."""
    f = found.select("doc_id", "field").distinct().withColumn("f", F.lit(1))
    e = expected.select("doc_id", "field").distinct().withColumn("e", F.lit(1))
    j = f.join(e, ["doc_id", "field"], "full").groupBy("doc_id").agg(F.count("f").alias("n_found"), F.count("e").alias("n_expected"), F.count_if(F.col("f").isNotNull() & F.col("e").isNotNull()).alias("hits"))
    p = F.when(F.col("n_found") > 0, F.col("hits") / F.col("n_found")).otherwise(0.0)
    r = F.when(F.col("n_expected") > 0, F.col("hits") / F.col("n_expected")).otherwise(0.0)
    j = j.withColumn("precision", p).withColumn("recall", r)
    return j.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def pair_hits(pairs: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, n_expected, hits): expected (doc_id, label, value) that some detected pair of the
    document contains, labels in any case."""
    d = pairs.select("doc_id", F.col("label").alias("p_label"), F.col("value").alias("p_value"))
    hit = (F.contains(F.lower("p_label"), F.lower("label"))) & F.contains(F.col("p_value"), F.col("value"))
    j = expected.join(d, "doc_id", "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
    per = j.groupBy("doc_id", "label", "value").agg(F.max(F.col("hit").cast("int")).alias("hit"))
    return per.groupBy("doc_id").agg(F.count("*").alias("n_expected"), F.sum("hit").alias("hits"))


def token_estimates(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


def record_counts(records: DataFrame, key: str) -> DataFrame:
    """(key, n_scalars, n_structured, n_transactions) of records(key, fields map of variants): what a summary counts.
    Records without any field are left out."""
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    n = F.size(F.filter(F.map_values("fields"), lambda v: kind(v).startswith("OBJECT") | kind(v).startswith("ARRAY")))
    list_ = F.to_json(F.try_element_at("fields", F.lit("transactions")))
    rows = F.coalesce(F.json_array_length(F.when(list_.startswith("["), list_)), F.lit(0))
    out = records.where(F.size("fields") > 0)
    return out.select(key, (F.size("fields") - n).cast("long").alias("n_scalars"), n.cast("long").alias("n_structured"), rows.cast("long").alias("n_transactions"))


def fallback_usage(sent: Column, received: Column, price_in: float, price_out: float) -> list[Column]:
    """input_tokens, output_tokens and cents of a call, estimated from its texts."""
    a, b = T.token_estimate(sent), T.token_estimate(received)
    return [a.alias("input_tokens"), b.alias("output_tokens"), T.cost_cents(a, b, price_in, price_out).alias("cents")]
