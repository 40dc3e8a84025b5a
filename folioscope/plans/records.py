"""Queries over extracted records: schema drift, nested objects, timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import nested, schema_drift, timestamps
from folioscope.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(table(spark, d, "layout_manifests"), table(spark, d, "extracted_records"))


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    """All records under the latest names of their layout's fields."""
    return schema_drift.unify(table(spark, d, "extracted_records"), p2_found(spark, d))


def p2_schemas(spark: SparkSession, d: str) -> DataFrame:
    """One schema of each layout over all its manifests, and over all its record files."""
    fields, profile = schema_drift.profiles(table(spark, d, "layout_manifests"), table(spark, d, "extracted_records"))
    return schema_drift.unified_schema(fields, schema_drift.changes_between(fields, profile))


def p2_accounted(spark: SparkSession, d: str) -> DataFrame:
    """Whether each readable record has the same values before and after its fields were renamed."""
    return schema_drift.account(table(spark, d, "extracted_records"), p2_unified(spark, d)).select("record_id", "same")


def _objects(spark: SparkSession, d: str, values: bool, keys: bool) -> DataFrame:
    records = nested.json_records(table(spark, d, "extracted_records"), table(spark, d, "batch_entries"))
    return nested.read_objects(records, values, keys)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.elements(_objects(spark, d, values=False, keys=False))


def p4_variants(spark: SparkSession, d: str) -> DataFrame:
    return nested.variants(_objects(spark, d, values=False, keys=True))


def p4_supertypes(spark: SparkSession, d: str) -> DataFrame:
    return nested.supertypes(_objects(spark, d, values=False, keys=True))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Every object with its parent: what the flat tables are joined by."""
    return _objects(spark, d, values=False, keys=False).select("src", "ref_id", "field", "node_path", "parent_path", "is_element")


def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every object of records and batch entries with its values, by field and variant."""
    return nested.flat_tables(_objects(spark, d, values=True, keys=False))


def p4_items(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the records' line items."""
    columns = {"description": "string", "qty": "bigint", "unit_price": "double", "amount": "double"}
    out = nested.flat_table(_objects(spark, d, values=True, keys=False), "record", "items", columns)
    return out.withColumn("rest", F.to_json("rest"))


def p4_typed(spark: SparkSession, d: str) -> DataFrame:
    """The values of all flat tables by type, with the variant each belongs to."""
    return nested.typed_values(_objects(spark, d, values=True, keys=False))


def p4_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Whether the flat tables of each record give the record back."""
    records = nested.json_records(table(spark, d, "extracted_records"), table(spark, d, "batch_entries"))
    return nested.compare_rebuilt(records, _objects(spark, d, values=True, keys=False)).select("src", "ref_id", "same")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.timestamp_texts(table(spark, d, "llm_calls"), table(spark, d, "extracted_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.verdicts(_texts(spark, d)).where("verdict != 'plain'").select("src", "ref_id", "field_name", "verdict")


def p5_instants(spark: SparkSession, d: str) -> DataFrame:
    """One UTC instant per timestamp text, or the reason why there is none, with the estimate for missing zones."""
    return timestamps.normalise(_texts(spark, d))


def p5_zones(spark: SparkSession, d: str) -> DataFrame:
    """How often the estimate finds the zones that are known, when they are hidden."""
    return timestamps.zone_accuracy(_texts(spark, d))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_unified, p2_schemas, p2_accounted, p4_found, p4_variants, p4_supertypes, p4_links, p4_tables, p4_items, p4_typed, p4_rebuilt, p5_found, p5_instants, p5_zones)
}
# An array kept as JSON text is read as the array; \x01 field \x02 marks an object alone in a field, until it is known which
# fields hold arrays.
_INNER = "CASE WHEN json_type(v) = 'VARCHAR' AND ltrim(v->>'$') LIKE '[%' AND json_valid(v->>'$') THEN (v->>'$')::JSON ELSE v END"
_NODES = f"""base AS (SELECT DISTINCT 'record' AS src, record_id AS ref_id, fields_json::JSON AS j FROM extracted_records WHERE json_valid(fields_json)
      UNION ALL SELECT DISTINCT 'entry', entry_id, fields_json::JSON FROM batch_entries WHERE json_valid(fields_json)),
    n AS (SELECT src, ref_id, '' AS path, '' AS field, '' AS owner, j, coalesce(json_type(j), 'NULL') AS kind, true AS root, false AS elem FROM base
      UNION ALL SELECT src, ref_id, CASE WHEN key IS NULL THEN path || '[' || i || ']' ELSE CASE WHEN root THEN key ELSE path || '.' || key END || CASE WHEN json_type(v) = 'OBJECT' THEN chr(1) || sub || chr(2) ELSE '' END END,
        sub, CASE WHEN up = 'OBJECT' THEN path ELSE owner END, v, json_type(v), false, key IS NULL
      FROM (SELECT * EXCLUDE (v), CASE WHEN key IS NULL THEN field WHEN root AND field = '' THEN key ELSE field || '.' || key END AS sub, {_INNER} AS v FROM
        (SELECT src, ref_id, path, field, owner, root, kind AS up, c.key AS key, c.i AS i, json_extract(j, CASE WHEN c.key IS NULL THEN '$[' || c.i || ']' ELSE '$."' || c.key || '"' END) AS v FROM
          (SELECT *, unnest(CASE WHEN kind = 'OBJECT' THEN list_transform(json_keys(j), lambda k: {{'key': k, 'i': NULL::BIGINT}}) ELSE list_transform(range(json_array_length(j)::BIGINT), lambda x: {{'key': NULL::VARCHAR, 'i': x}}) END) AS c
           FROM n WHERE kind IN ('OBJECT', 'ARRAY')))) WHERE json_type(v) IN ('OBJECT', 'ARRAY')),
    arr AS (SELECT src, list(DISTINCT field) AS fields FROM n WHERE kind = 'ARRAY' GROUP BY src),
    ob AS (SELECT n.*, coalesce(fields, []) AS fields FROM n LEFT JOIN arr USING (src) WHERE kind = 'OBJECT' OR root)"""


def _path_sql(marked: str) -> str:
    parts = f"string_split({marked}, chr(1))"
    rest = f"list_transform({parts}[2:], lambda p: CASE WHEN list_contains(fields, split_part(p, chr(2), 1)) THEN '[0]' ELSE '' END || split_part(p, chr(2), 2))"
    return f"{parts}[1] || coalesce(array_to_string({rest}, ''), '')"


_ELEMENT = "NOT root AND (elem OR list_contains(fields, field))"
ORACLE: dict[str, str] = {
    "p4_found": f"WITH RECURSIVE {_NODES} SELECT src, ref_id, {_path_sql('path')} AS node_path FROM ob WHERE {_ELEMENT}",
    "p4_links": f"WITH RECURSIVE {_NODES} SELECT src, ref_id, field, {_path_sql('path')} AS node_path, CASE WHEN NOT root THEN {_path_sql('owner')} END AS parent_path, {_ELEMENT} AS is_element FROM ob",
    "p2_accounted": "SELECT DISTINCT record_id, true AS same FROM extracted_records WHERE json_valid(fields_json)",
    "p4_rebuilt": """SELECT DISTINCT 'record' AS src, record_id AS ref_id, true AS same FROM extracted_records WHERE json_valid(fields_json)
    UNION ALL SELECT DISTINCT 'entry', entry_id, true FROM batch_entries WHERE json_valid(fields_json)""",
}
