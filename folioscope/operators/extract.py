"""Extraction of records by a schema: the plan is compiled to column expressions per layout."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import rows, spans as S
from folioscope.operators.schema import FALLBACK, declared_fields, inferred_fields, parse_schema
from folioscope.session import broadcast_if_small, materialize

UNKNOWN = "Unknown"
NO_LAYOUT = "\x00"
#: Rows up to which layouts, and their labels, are broadcast.
BROADCAST_LAYOUTS, BROADCAST_LABELS = 200_000, 500_000
#: Gives (doc_id, name, kind) of the fields of documents from their spans: what stands in for a schema
#: provider of any kind, such as a language model behind a service.
Discover = Callable[[DataFrame], DataFrame]


def label_values(spans: DataFrame, labels: list[str]) -> DataFrame:
    """(doc_id, label, value, how): value of each label in each document, null where there is none.

    First the right neighbour of the first span equal to the label in lower case ('exact'), then of
    any such span, then the rest of the first span that starts with the label and has text after its
    colon ('heuristic'). Neighbours are looked up for the spans equal to a label only."""
    given = F.array(*(F.lit(x) for x in labels))
    spans = T.once(spans, low=F.lower(T.trim("text")))
    low = F.col("low")
    equal = low.isin(*[x.strip().lower() for x in labels])
    starts = reduce(lambda a, b: a | b, [low.startswith(x.strip().lower()) for x in labels])
    kept = spans.withColumn("line", equal | (starts & F.col("text").contains(":"))).withColumn("t", F.when(F.col("line"), T.trim("text")))
    # one pass over the documents; spans that may be labels stay, the rest only tells which documents there are
    lines = S.beside_texts(kept, equal, ("right",), ["t"]).withColumn("right", F.nullif("right", F.lit("")))
    key = lambda x: F.lower(T.trim(x))
    fit = F.filter(given, lambda x: F.startswith(F.lower("t"), key(x)))
    lines = materialize(lines.select("doc_id", "span_idx", "t", "right", F.when(F.col("t").isNotNull(), fit).alias("fit")), "label-lines")
    docs = lines.select("doc_id").distinct().withColumn("label", F.explode(given))
    cand = lines.where("t IS NOT NULL").select("doc_id", "span_idx", "t", "right", F.explode("fit").alias("label"))
    cand = cand.withColumn("same", F.lower("t") == key("label")).withColumn("inline", F.nullif(T.colon_value(F.col("t")), F.lit("")))
    best = cand.groupBy("doc_id", "label").agg(
        F.min_by(F.struct("right"), F.when(F.col("same"), F.col("span_idx"))).alias("first"),
        F.min_by("right", F.when(F.col("same") & F.col("right").isNotNull(), F.col("span_idx"))).alias("any"),
        F.min_by("inline", F.when(F.col("inline").isNotNull(), F.col("span_idx"))).alias("inline"),
    )
    exact = F.coalesce("first.right", "any")
    return docs.join(best, ["doc_id", "label"], "left").select(
        "doc_id", "label", F.coalesce(exact, F.col("inline")).alias("value"), F.when(exact.isNotNull(), "exact").when(F.col("inline").isNotNull(), "heuristic").alias("how")
    )


def compile_schema(schema_json: str) -> tuple[list[tuple[str, str]], list[dict]]:
    """([(field, label)] of scalar fields, array fields with their columns)."""
    fields = parse_schema(schema_json)
    scalars = [(f["name"], " ".join(w[:1].upper() + w[1:] for w in f["name"].replace("_", " ").split(" ")) + ":") for f in fields if f["kind"] != "array"]
    return scalars, [f for f in fields if f["kind"] == "array"]


def scalar_fields(spans: DataFrame, schema_json: str) -> DataFrame:
    """(doc_id, field, value, confidence) of the schema's scalar fields; 'Unknown' without value."""
    scalars, _ = compile_schema(schema_json)
    names = F.create_map(*(F.lit(x) for field, label in scalars for x in (label, field)))
    v = label_values(spans, [label for _, label in scalars])
    return v.select("doc_id", names[F.col("label")].alias("field"), F.coalesce("value", F.lit(UNKNOWN)).alias("value"), F.coalesce("how", F.lit("fuzzy")).alias("confidence"))


def table_cells(nodes: DataFrame, columns: list[tuple[str, str]], tolerance: float = 2.0) -> DataFrame:
    """(doc_id, row_no, key, value): for each transaction row and column the cell whose centre is
    nearest to the header's, 'Unknown' for columns without header."""
    listed = F.explode(F.array(*(F.struct(F.lit(label).alias("label"), F.lit(key).alias("key")) for label, key in columns)))
    heads = nodes.where(F.col("text").isin(*[label for label, _ in columns])).groupBy("doc_id", F.col("text").alias("label")).agg(
        F.min_by((F.col("x0") + F.col("x1")) / 2, "span_idx").alias("hx")
    )
    r = rows.transaction_rows(nodes, tolerance).join(nodes.select("doc_id", "span_idx", "text", ((F.col("x0") + F.col("x1")) / 2).alias("cx")), ["doc_id", "span_idx"])
    r = materialize(r.select("doc_id", "row_no", "span_idx", "text", "cx"), "transaction-rows")
    wanted = r.select("doc_id", "row_no").distinct().withColumn("c", listed).select("doc_id", "row_no", "c.label", "c.key")
    near = r.join(heads, "doc_id").groupBy("doc_id", "row_no", "label").agg(F.min_by("text", F.struct(F.abs(F.col("cx") - F.col("hx")), "span_idx")).alias("value"))
    return wanted.join(near, ["doc_id", "row_no", "label"], "left").select("doc_id", "row_no", "key", F.coalesce("value", F.lit(UNKNOWN)).alias("value"))


def records(spans: DataFrame, schema_json: str) -> DataFrame:
    """(doc_id, fields, arrays, confidence): a map of scalars, a map of arrays of objects, and how
    sure each scalar is."""
    nodes = materialize(spans, "extract-spans")  # read by scalars and by each array
    scalars, arrays = compile_schema(schema_json)
    out = nodes.select("doc_id").distinct()
    if scalars:
        f = scalar_fields(nodes, schema_json).groupBy("doc_id").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "confidence")))).alias("confidence"),
        )
        out = out.join(f, "doc_id", "left")
    else:
        out = out.withColumn("fields", F.create_map().cast("map<string,string>")).withColumn("confidence", F.create_map().cast("map<string,string>"))
    listed = F.create_map().cast("map<string,array<map<string,string>>>")
    for a in arrays:
        cells = table_cells(nodes, a["columns"]) if a["columns"] else None
        if cells is None:
            continue
        objects = cells.groupBy("doc_id", "row_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("o"))
        one = objects.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", F.to_json("o").alias("j")))), lambda x: F.from_json(x["j"], "map<string,string>")).alias(f"_{a['name']}"))
        out = out.join(one, "doc_id", "left")
        empty = F.array().cast("array<map<string,string>>")
        listed = F.map_concat(listed, F.create_map(F.lit(a["name"]), F.coalesce(F.col(f"_{a['name']}"), empty)))
    return out.select("doc_id", "fields", listed.alias("arrays"), "confidence")


def label_of(name: Column) -> Column:
    """The label that a field is looked up by: its words with capitals, and a colon."""
    return F.concat(T.display_label(name), F.lit(":"))


def route(spans: DataFrame, docs: DataFrame, manifests: DataFrame, discover: Discover | None = None) -> DataFrame:
    """(layout_id, was_cached, field) of the scalar fields by which the documents of each layout are read: those of
    the layout's latest manifest or, for layouts without one, those that ``discover`` gives for the layout's
    first document. docs(doc_id, layout_id); manifests(layout_id, manifest_no, schema_json). A schema that
    can't be read or has no field, and documents without layout, have the three fallback fields."""
    discover = discover or inferred_fields
    last = manifests.where("layout_id IS NOT NULL").groupBy("layout_id").agg(F.max_by("schema_json", "manifest_no").alias("schema_json"))
    last = materialize(last, "routes")
    declared = declared_fields(last, "layout_id").where("label = '' AND kind != 'array' AND NOT contains(field, '.')").select("layout_id", "field")
    new = docs.where("layout_id IS NOT NULL").join(broadcast_if_small(last.select("layout_id"), BROADCAST_LAYOUTS), "layout_id", "left_anti")
    first = materialize(new.groupBy("layout_id").agg(F.min("doc_id").alias("doc_id")), "new-layouts")
    few = broadcast_if_small(first, BROADCAST_LAYOUTS)
    found = discover(spans.join(few.select("doc_id"), "doc_id", "left_semi")).where("kind != 'array'").select("doc_id", F.col("name").alias("field"))
    found = found.join(first, "doc_id").select("layout_id", "field")
    cached = last.select("layout_id", F.lit(True).alias("was_cached"))
    layouts = cached.unionByName(first.select("layout_id", F.lit(False).alias("was_cached"))).unionByName(
        docs.where("layout_id IS NULL").select("layout_id", F.lit(False).alias("was_cached")).distinct()
    )
    fields = declared.unionByName(found).distinct().withColumnRenamed("layout_id", "l")
    usual = F.explode(F.array(*(F.lit(x) for x in FALLBACK)))
    own = layouts.join(fields, F.col("layout_id") == F.col("l"), "left").drop("l")
    return own.where("field IS NOT NULL").unionByName(own.where("field IS NULL").withColumn("field", usual))


def routed_fields(spans: DataFrame, docs: DataFrame, routes: DataFrame) -> DataFrame:
    """(doc_id, layout_id, was_cached, field, value, confidence): every document of docs(doc_id, layout_id) read by
    the fields of its own layout, as ``label_values`` does for one list of labels. Labels end in their only colon."""
    routes = materialize(routes, "routes")
    n_routes = routes.count()
    same_layout = F.coalesce("layout_id", F.lit(NO_LAYOUT))
    by_label = routes.groupBy(same_layout.alias("l"), F.lower(T.trim(label_of(F.col("field")))).alias("key")).agg(F.collect_set("field").alias("fields"))
    t = T.trim("text")
    marked = spans.withColumn("tt", t).withColumn("key", F.when(F.col("tt").contains(":"), F.lower(F.concat(F.substring_index("tt", ":", 1), F.lit(":")))))
    marked = marked.join(docs.select("doc_id", same_layout.alias("l")), "doc_id").join(broadcast_if_small(by_label, BROADCAST_LABELS, n_routes), ["l", "key"], "left")
    marked = marked.withColumn("t", F.when(F.col("fields").isNotNull(), F.col("tt")))
    same = F.lower("t") == F.col("key")
    lines = S.beside_texts(marked, same, ("right",), ["t", "key", "fields"]).where("fields IS NOT NULL")
    cand = lines.select(
        "doc_id", "span_idx", F.nullif("right", F.lit("")).alias("right"), same.alias("same"), F.nullif(T.colon_value(F.col("t")), F.lit("")).alias("inline"), F.explode("fields").alias("field")
    )
    best = cand.groupBy("doc_id", "field").agg(
        F.min_by(F.struct("right"), F.when(F.col("same"), F.col("span_idx"))).alias("first"),
        F.min_by("right", F.when(F.col("same") & F.col("right").isNotNull(), F.col("span_idx"))).alias("any"),
        F.min_by("inline", F.when(F.col("inline").isNotNull(), F.col("span_idx"))).alias("inline"),
    )
    exact = F.coalesce("first.right", "any")
    best = best.select("doc_id", "field", F.coalesce(exact, F.col("inline")).alias("value"), F.when(exact.isNotNull(), "exact").when(F.col("inline").isNotNull(), "heuristic").alias("how"))
    wanted = docs.withColumn("l", same_layout).join(
        broadcast_if_small(routes.select(same_layout.alias("l"), "was_cached", "field"), BROADCAST_LABELS, n_routes), "l"
    )
    return wanted.join(best, ["doc_id", "field"], "left").select(
        "doc_id", "layout_id", "was_cached", "field", F.coalesce("value", F.lit(UNKNOWN)).alias("value"), F.coalesce("how", F.lit("fuzzy")).alias("confidence")
    )


def within(records_: DataFrame, json_col: str, max_bytes: int = 10 * 1024 * 1024) -> tuple[DataFrame, DataFrame]:
    """Records whose JSON has at most so many bytes, and the others as dead letters (with ``error``)."""
    size = F.coalesce(F.octet_length(json_col), F.lit(0))
    over = records_.where(size > max_bytes)
    return records_.where(size <= max_bytes), over.select(*[c for c in over.columns if c != json_col], F.format_string("result of %d bytes is over %d", size, F.lit(max_bytes)).alias("error"))


def union_table(fields: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One wide table of fields(doc_id, field, value): a text column for every field name of any
    document, in order, null where a document lacks it. The names are the schema's; when not given
    they are read from the data."""
    if names is None:
        names = sorted(r.field for r in fields.select("field").distinct().collect())
    return fields.groupBy("doc_id").pivot("field", names).agg(F.first("value"))


def union_records(records_: DataFrame) -> DataFrame:
    """records(doc_id, fields_json) as one wide table over the union of all top-level keys, in order;
    each readable record once, also where it has no value."""
    one = records_.where(F.try_parse_json("fields_json").isNotNull()).dropDuplicates(["doc_id"])
    one = materialize(one.select("doc_id", F.from_json("fields_json", "map<string,string>").alias("fields")), "union-records")
    fields = one.select("doc_id", F.explode("fields").alias("field", "value"))
    return one.select("doc_id").join(union_table(fields), "doc_id", "left")


def json_columns(values: DataFrame, json_col: str, columns: list[str]) -> DataFrame:
    """The listed keys of JSON objects as text columns; missing and null are null."""
    whole = F.when(F.try_parse_json(json_col).isNotNull(), F.col(json_col))
    return values.select(*[c for c in values.columns if c != json_col], *(F.get_json_object(whole, f"$['{c}']").alias(c) for c in columns))


def is_blank(value: Column) -> Column:
    return value.isNull() | (T.trim(value) == "") | (F.lower(T.trim(value)) == "unknown")


def validation(records_: DataFrame, schema_json: str) -> DataFrame:
    """(doc_id, matches, is_empty, missing): whether a record has every field and every row every key,
    whether all its scalars are blank, and which fields are missing."""
    scalars, arrays = compile_schema(schema_json)
    want = F.array(*(F.lit(n) for n, _ in scalars)) if scalars else F.array().cast("array<string>")
    missing = F.array_except(want, F.map_keys("fields"))

    def complete(a: dict) -> Column:
        keys = F.array(*(F.lit(k) for _, k in a["columns"]))
        return F.coalesce(F.forall(F.col("arrays")[a["name"]], lambda o: F.size(F.array_except(keys, F.map_keys(o))) == 0), F.lit(False))

    rows_ok = [complete(a) for a in arrays if a["columns"]]
    whole = reduce(lambda a, b: a & b, rows_ok, F.size(missing) == 0)
    blank = F.forall(F.map_values("fields"), is_blank) if scalars else F.lit(False)
    return records_.select("doc_id", whole.alias("matches"), blank.alias("is_empty"), missing.alias("missing"))


def csv_rows(fields: DataFrame) -> DataFrame:
    """(doc_id, line): each record's values as one CSV line, fields in order, quotes doubled."""
    quoted = F.concat(F.lit('"'), F.replace("value", F.lit('"'), F.lit('""')), F.lit('"'))
    cells = fields.select("doc_id", "field", F.when(F.col("value").rlike('[",\n]'), quoted).otherwise(F.coalesce("value", F.lit(""))).alias("cell"))
    g = cells.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("field", "cell"))).alias("c"))
    return g.select("doc_id", F.array_join("c.cell", ",").alias("line"))


def first_per_label(pairs: DataFrame) -> DataFrame:
    """Rows (doc_id, seq, label, ...) with the first of equal labels, in any case."""
    w = Window.partitionBy("doc_id", F.lower("label")).orderBy("seq")
    return pairs.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
