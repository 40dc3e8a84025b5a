"""Schema inference from spans."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import quality, rows
from folioscope.operators.schema_drift import manifest_fields
from folioscope.session import materialize

TYPE_TOLERANCE = 14.0
FALLBACK = {"invoice_number": "string", "date": "string", "total": "string"}


def right_value_types(spans: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, span_idx, kind) of labels(doc_id, span_idx, x1, c, label_text): type of the nearest
    span to the right whose centre lies within 14 points; ties by band, then span_idx."""
    k = F.floor(F.col("c") / TYPE_TOLERANCE).cast("int")
    a = labels.withColumn("near", F.explode(F.array(k - 1, k, k + 1)))
    o = spans.select("doc_id", F.col("span_idx").alias("o_idx"), F.col("x0").alias("o_x0"), ((F.col("y0") + F.col("y1")) / 2).alias("o_c"), T.trim("text").alias("o_text"))
    o = o.withColumn("near", F.floor(F.col("o_c") / TYPE_TOLERANCE).cast("int"))
    j = a.join(o, ["doc_id", "near"]).where((F.col("o_x0") >= F.col("x1")) & (F.col("o_text") != F.col("label_text")) & (F.abs(F.col("c") - F.col("o_c")) <= TYPE_TOLERANCE))
    best = j.groupBy("doc_id", "span_idx").agg(F.min_by("o_text", F.struct(F.col("o_x0") - F.col("x1"), "near", "o_idx")).alias("v"))
    return best.select("doc_id", "span_idx", T.field_type(F.col("v")).alias("kind"))


def colon_fields(spans: DataFrame) -> DataFrame:
    """(doc_id, span_idx, name, kind): labels before a colon, first of equal names, prose left out."""
    s = quality.with_rarity(spans).withColumn("t", T.trim("text")).withColumn("label", T.colon_label(F.col("t"))).where("label IS NOT NULL")
    prose = ~F.col("is_bold") & (F.col("font_size") > 0) & (F.abs(F.col("font_size") - F.col("common_size")) < 0.5) & (F.col("rarity") < 0.4) & (F.length("t") > 40)
    s = s.where(T.is_label(F.col("label")) & ~prose).withColumn("name", T.snake_name(F.col("label"))).withColumn("inline", T.colon_value(F.col("t")))
    s = s.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("span_idx"))).where("k = 1")
    at_hand = (F.col("inline") != "") & (F.octet_length("inline") <= 80)
    labels = s.where(~at_hand).select("doc_id", "span_idx", "x1", ((F.col("y0") + F.col("y1")) / 2).alias("c"), F.col("t").alias("label_text"))
    right = right_value_types(spans, labels)
    out = s.join(right, ["doc_id", "span_idx"], "left")
    return out.select("doc_id", "span_idx", "name", F.when(at_hand, T.field_type(F.col("inline"))).otherwise(F.coalesce("kind", F.lit("string"))).alias("kind"))


def inferred_fields(spans: DataFrame) -> DataFrame:
    """(doc_id, name, kind): colon fields, then key-value pairs with new names. Documents without any
    have the three fallback fields."""
    spans = materialize(spans, "infer-spans")  # read by each of the ways
    a = colon_fields(spans).select("doc_id", "name", "kind", F.lit(0).alias("pass"), F.col("span_idx").alias("at"))
    kv = rows.key_values(spans).withColumn("name", T.snake_name(F.col("label"))).where("name != ''")
    b = kv.select("doc_id", "name", F.when(F.octet_length("value") <= 80, T.field_type(F.col("value"))).otherwise("string").alias("kind"), F.lit(1).alias("pass"), F.col("pair_no").alias("at"))
    every = a.unionByName(b).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("pass", "at"))).where("k = 1")
    bare = spans.select("doc_id").distinct().join(every.select("doc_id").distinct(), "doc_id", "left_anti")
    fallback = bare.select("doc_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, FALLBACK)), F.array(*map(F.lit, FALLBACK.values())))).alias("name", "kind"))
    return every.select("doc_id", "name", "kind").unionByName(fallback)


def inferred_schemas(spans: DataFrame) -> DataFrame:
    """(doc_id, schema_json) with the names in order."""
    f = inferred_fields(spans).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("name", "kind"))).alias("f"))
    return f.select("doc_id", F.to_json(F.map_from_entries("f")).alias("schema_json"))


def discovered_fields(spans: DataFrame) -> DataFrame:
    """(doc_id, name, kind, columns): inferred fields plus ``transactions`` with its columns (label to key)."""
    t = rows.transaction_columns(spans).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "key")))).alias("columns"))
    arrays = t.select("doc_id", F.lit("transactions").alias("name"), F.lit("array").alias("kind"), "columns")
    found = materialize(inferred_fields(spans), "inferred-fields")
    plain = found.where("name != 'transactions'").withColumn("columns", F.lit(None).cast("map<string,string>"))
    clash = found.where("name = 'transactions'").join(t.select("doc_id"), "doc_id", "left_anti").withColumn("columns", F.lit(None).cast("map<string,string>"))
    return plain.unionByName(clash).unionByName(arrays)


def parse_schema(schema_json: str) -> list[dict]:
    """[{name, kind, columns: [(label, key)]}] of a schema, fields by name, columns by label. A schema
    that isn't a JSON object, or is empty, gives the three fallback fields."""
    try:
        schema = json.loads(schema_json)
    except ValueError:
        schema = None
    if not isinstance(schema, dict) or not schema:
        schema = FALLBACK
    out = []
    for name, spec in sorted(schema.items()):
        if isinstance(spec, dict):
            columns = spec.get("columns")
            out.append({"name": name, "kind": spec.get("type", "string"), "columns": sorted(columns.items()) if isinstance(columns, dict) else []})
        else:
            out.append({"name": name, "kind": str(spec), "columns": []})
    return out


def declared_fields(schemas: DataFrame, key: str) -> DataFrame:
    """(key, field, kind, label) of the fields declared by schemas(key, schema_json) in any of their JSON shapes;
    columns of array fields are ``array.key`` without kind and with their label. Unreadable schemas give nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *f) for i, text in enumerate(batch.column(1).to_pylist()) for f in manifest_fields(text) or ()]
            at, *columns = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in columns)], names=[key, "field", "kind", "label"]
            )

    return schemas.select(key, "schema_json").mapInArrow(read, f"{key} {dict(schemas.dtypes)[key]}, field string, kind string, label string")
