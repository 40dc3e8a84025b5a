"""Queries of this subpackage and, where SQL can say the same, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import confusables, contamination, mixing, mojibake, percentiles, repetition
from folioscope.session import table

Query = Callable[[SparkSession, str], DataFrame]
PS = [0.5, 0.9, 0.99]


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.text_pieces(table(spark, d, "spans"), table(spark, d, "text_quality_reports"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return confusables.label_texts(table(spark, d, "spans"), table(spark, d, "anchors"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_garbled(_pieces(spark, d))


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    out = mojibake.repair(_pieces(spark, d))
    return out.withColumn("chains", F.array_join("chains", " "))


def p1_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How many clean texts come back after they were damaged, by chain of encodings."""
    return mojibake.accuracy(_pieces(spark, d))


def p3_latency(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(percentiles.call_latencies(table(spark, d, "llm_calls")), ["model"], PS)


def p3_duration(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(percentiles.entry_durations(table(spark, d, "batch_entries")), ["layout_id", "was_cached"], PS)


def p3_days(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of two digits per model and day; adding them up per model gives that of any set of days."""
    return percentiles.histogram(percentiles.call_latencies(table(spark, d, "llm_calls")), ["model"], ["log_date"], digits=2)


def p3_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per model read off the added-up daily histograms, within 2**-21 of their value."""
    return percentiles.from_histogram(percentiles.combine(p3_days(spark, d), ["model"]), ["model"], PS, digits=2)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    labels = _labels(spark, d)
    # the pieces hold the spans as well
    garbled = mojibake.find_garbled(labels, vocabulary=_pieces(spark, d).unionByName(labels.where("src = 'anchor'")))
    return confusables.find_variants(labels, garbled)


def p6_labels(spark: SparkSession, d: str) -> DataFrame:
    """Anchor labels in their one form: how many rows and ways of writing each has."""
    anchors = table(spark, d, "anchors").select("doc_id", "anchor_no", "text").distinct()
    out = confusables.normalise(anchors)
    return out.groupBy("canonical").agg(F.count("*").alias("n_rows"), F.countDistinct("text").alias("n_written"))


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text of spans and anchors with its one form."""
    texts = _labels(spark, d).select("src", "doc_id", "pos", "text").distinct()
    return confusables.normalise(texts).select("src", "doc_id", "pos", "text", "canonical")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation item: documents that hold it and the largest share held; 0 for clean items."""
    items = table(spark, d, "eval_items").select("item_id", "set_name").distinct()
    found = contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where(
        F.col("held") >= contamination.HELD_SHARE * F.col("n_words")
    )
    per_item = found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max(F.col("held") / F.col("n_words")).alias("most_held"))
    return items.join(per_item, "item_id", "left").fillna({"n_docs": 0, "most_held": 0.0})


def p8_sample(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(p8_sample(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.find_repetitive(table(spark, d, "documents"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.measure(table(spark, d, "documents")).select("doc_id", "n_words", "n_repeated", "run_share")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    """Shares of words in repeated lines and in repeated paragraphs."""
    return repetition.measure(table(spark, d, "documents")).select("doc_id", "line_share", "paragraph_share")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_restored, p1_accuracy, p3_latency, p3_duration, p3_days, p3_combined, p6_found, p6_labels, p6_texts,
        p7_found, p7_items, p8_sample, p8_shares, p9_found, p9_shares, p9_levels,
    )
}


def _percentile_sql(source: str, group: str) -> str:
    return f"""
    WITH v AS ({source}),
    r AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY x) AS rn, count(*) OVER (PARTITION BY {group}) AS n FROM v),
    p AS (SELECT unnest([{', '.join(f'{p}::DOUBLE' for p in PS)}]) AS p)
    SELECT {group}, p.p, n, x AS value FROM r, p WHERE rn = greatest(1, ceil(round(p.p * n, 9)))
    """


_SHARES = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') AS ws FROM documents),
    g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
    k AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS gram FROM g),
    f AS (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, gram) < i AS again FROM k),
    c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 5)) AS word_at FROM f WHERE again),
    n AS (SELECT doc_id, count(*) AS n_repeated FROM c GROUP BY doc_id)
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_repeated, 0)::BIGINT AS n_repeated,
      CASE WHEN len(ws) = 0 THEN 0.0 ELSE coalesce(n_repeated, 0)::DOUBLE / len(ws) END AS run_share
    FROM w LEFT JOIN n USING (doc_id)
    """

_DIGITS = """WITH c AS (SELECT call_id, arg_min(model, ingested_at) AS model, arg_min(log_date, ingested_at) AS log_date, arg_min_null(latency_ms, ingested_at)::DOUBLE AS x FROM llm_calls GROUP BY call_id),
    e AS (SELECT model, log_date, x, floor(log2(x)) AS e FROM c WHERE x > 0),
    h AS (SELECT model, log_date, ((e + 1023) * 1048576 + floor((x / pow(2.0, e) - 1) * 1048576))::BIGINT AS digit, count(*) AS n FROM e GROUP BY ALL
      UNION ALL SELECT model, log_date, 0, count(*) FROM c WHERE x = 0 GROUP BY ALL)"""


def _repeated_sql(cut: str) -> str:
    """Words in repeated parts of each text."""
    return rf"""p AS (SELECT doc_id, unnest({cut}) AS part, unnest(range(0, len({cut}))) AS i FROM documents),
    w AS (SELECT doc_id, i, regexp_extract_all(lower(part), '\p{{L}}+') AS ws FROM p),
    r AS (SELECT doc_id, len(ws) AS n, row_number() OVER (PARTITION BY doc_id, ws ORDER BY i) > 1 AS again FROM w)
    SELECT doc_id, CASE WHEN sum(n) = 0 THEN 0.0 ELSE coalesce(sum(n) FILTER (again), 0)::DOUBLE / sum(n) END AS share FROM r GROUP BY doc_id"""


ORACLE: dict[str, str] = {
    "p3_days": f"{_DIGITS} SELECT model, log_date, digit, n FROM h",
    "p3_combined": f"""{_DIGITS}, s AS (SELECT model, digit, sum(n) AS n FROM h GROUP BY ALL),
    u AS (SELECT *, sum(n) OVER (PARTITION BY model ORDER BY digit) AS upto, sum(n) OVER (PARTITION BY model) AS total FROM s),
    r AS (SELECT *, greatest(1, ceil(round(p * total, 9))) AS rank FROM u, (SELECT unnest([{', '.join(f'{p}::DOUBLE' for p in PS)}]) AS p))
    SELECT model, p, total::BIGINT AS n, CASE WHEN digit = 0 THEN 0.0 ELSE pow(2.0, digit // 1048576 - 1023) * (1 + (digit % 1048576 + 0.5) / 1048576) END AS value FROM r WHERE rank <= upto AND rank > upto - n""",
    "p9_levels": f"""WITH l AS (WITH {_repeated_sql("string_split(coalesce(text, ''), chr(10))")}), g AS (WITH {_repeated_sql(r"regexp_split_to_array(coalesce(text, ''), '\n\s*\n')")})
    SELECT doc_id, l.share AS line_share, g.share AS paragraph_share FROM l JOIN g USING (doc_id)""",
    "p3_latency": _percentile_sql(
        "SELECT any_value(model) AS model, any_value(latency_ms)::DOUBLE AS x FROM llm_calls GROUP BY call_id HAVING any_value(latency_ms) >= 0",
        "model",
    ),
    "p3_duration": _percentile_sql(
        """SELECT first(layout_id) AS layout_id, first(was_cached) AS was_cached, any_value(duration_ms)::DOUBLE AS x
        FROM batch_entries GROUP BY entry_id HAVING any_value(duration_ms) >= 0""",
        "layout_id, was_cached",
    ),
    "p9_shares": _SHARES,
    "p9_found": f"SELECT DISTINCT doc_id FROM ({_SHARES}) WHERE n_words > 0 AND n_repeated >= 0.35 * n_words - 1e-9",
}
