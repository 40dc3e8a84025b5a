"""Rules for showing records: names, numbers, order of columns, CSV text, and clean-up of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T

# Titles of usual columns, the names they go by (the first present one counts), and
# whether they hold numbers.
USUAL_COLUMNS = (
    ("Date", ("date", "txn_date", "transaction_date", "posted_date", "value_date", "dated"), False),
    ("Narration", ("narration", "description", "details", "remarks", "memo", "particulars", "note", "txn_narration"), False),
    ("Amount", ("amount", "value", "debit", "credit", "amount_inr", "amt", "txn_amount"), True),
    ("Units", ("units", "qty", "quantity", "count", "shares", "nav_units"), True),
    ("Price", ("price", "rate", "unit_price", "price_per_unit", "nav"), True),
    ("Balance", ("balance", "closing_balance", "running_balance", "bal", "balance_inr"), True),
)


def pretty_name(name: Column) -> Column:
    """Words apart (at changes of case, underscores and hyphens), each with a capital."""
    apart = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " ")
    words = F.split(apart, " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ")


def cell_number(value: Column) -> Column:
    """The number in a cell, whatever else it has; null where that isn't one."""
    return F.nullif(F.regexp_replace(value, "[^0-9.-]", ""), F.lit("")).try_cast("double")


def is_negative(value: Column) -> Column:
    return F.coalesce(cell_number(value) < 0, F.lit(False))


def shown_columns(names: list[str]) -> list[tuple[str, str, bool]]:
    """(name, title, holds numbers): the usual columns first, the rest as they come."""
    out = []
    for title, aliases, numeric in USUAL_COLUMNS:
        hit = next((a for a in aliases if a in names), None)
        if hit:
            out.append((hit, title, numeric))
    seen = {n for n, _, _ in out}
    return out + [(n, n, False) for n in names if n not in seen]


def strip_fences(answer: Column) -> Column:
    """An answer without code fences around it."""
    return T.trim(F.regexp_replace(T.trim(answer), r"^(?:```json)*(?:```)*|(?:```)+\z", ""))


def code_block(answer: Column, language: str = "rust") -> Column:
    """The first fenced block of a language, else the first fenced block, else the whole answer."""
    def fenced(opening: str) -> Column:
        return F.when(answer.rlike(f"(?s){opening}.*?```"), T.trim(F.regexp_extract(answer, f"(?s){opening}(.*?)```", 1)))

    return F.coalesce(fenced("```" + language), fenced("```"), T.trim(answer))


def split_confidence(records: DataFrame, json_col: str) -> DataFrame:
    """JSON records as ``fields`` (key to JSON text or string) and ``confidence`` (texts only), the
    latter taken out of the former; null for records that aren't JSON objects."""
    whole = F.from_json(F.when(F.try_parse_json(json_col).isNotNull(), F.col(json_col)), "map<string,string>")
    sure = F.from_json(F.get_json_object(json_col, "$._confidence"), "map<string,string>")
    return records.withColumn("fields", F.map_filter(whole, lambda k, v: k != "_confidence")).withColumn(
        "confidence", F.when(F.col("fields").isNotNull(), F.coalesce(sure, F.create_map().cast("map<string,string>")))
    )


def record_csv(records: DataFrame) -> DataFrame:
    """(doc_id, csv) of records(doc_id, fields map, arrays map of lists of maps): names and values of the
    scalars, then each array of objects under its name. Keys are in order; quotes are doubled."""
    quoted = lambda v: F.concat(F.lit('"'), F.replace(F.coalesce(v, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    keys = F.array_sort(F.map_keys("fields"))
    head = F.when(F.size(keys) > 0, F.array(F.array_join(keys, ","), F.array_join(F.transform(keys, lambda k: quoted(F.col("fields")[k])), ","))).otherwise(F.array().cast("array<string>"))

    def table(entry: Column) -> Column:
        names = F.array_sort(F.array_distinct(F.flatten(F.transform(entry["value"], lambda o: F.map_keys(o)))))
        rows = F.transform(entry["value"], lambda o: F.array_join(F.transform(names, lambda k: quoted(F.try_element_at(o, k))), ","))
        return F.concat(F.array(F.lit(""), entry["key"], F.array_join(names, ",")), rows)

    tables = F.flatten(F.transform(F.array_sort(F.filter(F.map_entries("arrays"), lambda e: F.size(e["value"]) > 0), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)), table))
    return records.select("doc_id", F.array_join(F.concat(head, tables), "\n").alias("csv"))


def layout_notes(pairs: DataFrame, transactions: DataFrame, columns: DataFrame) -> DataFrame:
    """(doc_id, notes): what the deterministic analyses found, as a text for a schema provider."""
    def section(df: DataFrame, title: str, order: str, line: Column) -> DataFrame:
        g = df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("s"))
        return g.select("doc_id", F.lit(title).alias("title"), F.concat(F.lit(f"{title}:\n"), F.array_join("s.l", "\n")).alias("text"))

    kv = section(pairs, "key_value_pairs", "pair_no", F.concat(F.lit("  "), F.col("label"), F.lit(" -> "), F.col("value")))
    tx = section(transactions, "transaction_columns", "col_no", F.concat(F.lit("  "), F.col("label"), F.lit(" (key="), F.col("key"), F.lit(")")))
    cols = section(columns, "table_columns", "col_no", F.format_string("  %s (x0=%.0f, x1=%.0f)", "header", F.bround("x0", 0), F.bround("x1", 0)))
    every = kv.withColumn("at", F.lit(0)).unionByName(tx.withColumn("at", F.lit(1))).unionByName(cols.withColumn("at", F.lit(2)))
    g = every.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("s"))
    return g.select("doc_id", F.array_join("s.text", "\n\n").alias("notes"))
