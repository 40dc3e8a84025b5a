"""Queries of the display rules and the remaining scalar rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import display
from folioscope.functions import text as T
from folioscope.operators import extract, rows
from folioscope.operators import spans as S
from folioscope.plans.extraction import _GROUPS, _INVOICE, _PAIRS, _ROWS, _SCHEMA, _STATEMENT, _TABLES, _TCOLS, _TROWS, _THREE, _statements, field_scores, invoices
from folioscope.plans.extraction import ORACLE as EXTRACTION
from folioscope.plans.layout import BASE, _spans, q_trim
from folioscope.session import materialize, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
SCORES = EXTRACTION["field_scores"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {BASE}, p AS (SELECT doc_id, span_idx AS point_no, (x0 + x1) / 2 AS x, y0 AS y FROM s) SELECT p.doc_id * 1000 + point_no AS point_id, min(s.span_idx) AS span_idx FROM p JOIN s ON p.doc_id = s.doc_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL")
def hit_test(spark: SparkSession, d: str) -> DataFrame:
    """The first span under the middle of each span's lower edge."""
    s = _spans(spark, d)
    points = s.select((F.col("doc_id") * 1000 + F.col("span_idx")).alias("point_id"), "doc_id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y0").alias("y"))
    return S.hit_test(points, s)


@query(f"WITH {BASE}, v AS (SELECT doc_id, span_idx, try_cast(nullif(regexp_replace(text, '[^0-9.-]', '', 'g'), '') AS DOUBLE) AS v FROM s) SELECT doc_id, span_idx, v AS number, coalesce(v < 0, false) AS negative FROM v")
def cell_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("doc_id", "span_idx", display.cell_number(F.col("text")).alias("number"), display.is_negative(F.col("text")).alias("negative"))


@query(
    """WITH k AS (SELECT DISTINCT unnest(json_keys(fields_json::JSON)) AS name FROM extracted_records WHERE json_valid(fields_json)),
    a AS (SELECT name, string_split(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g'), ' ') AS w FROM k)
    SELECT name, array_to_string(list_transform(w, lambda x: upper(x[1:1]) || x[2:]), ' ') AS title FROM a"""
)
def pretty_names(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "extracted_records").where(F.try_parse_json("fields_json").isNotNull())
    names = r.select(F.explode(F.json_object_keys("fields_json")).alias("name")).distinct()
    return names.select("name", display.pretty_name(F.col("name")).alias("title"))


@query(
    """WITH r AS (SELECT DISTINCT record_id, fields_json::JSON AS j, confidence FROM extracted_records WHERE json_valid(fields_json))
    SELECT record_id, len(json_keys(j))::BIGINT AS n_fields, coalesce(cardinality(confidence), 0)::BIGINT AS n_confidence FROM r"""
)
def split_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Records written with their confidence inside and taken apart again."""
    r = table(spark, d, "extracted_records").dropDuplicates(["record_id"]).where(F.try_parse_json("fields_json").isNotNull())
    inside = F.concat(F.lit('{"_confidence":'), F.coalesce(F.to_json("confidence"), F.lit("{}")), F.when(F.trim("fields_json") != "{}", ",").otherwise(""), F.substring(F.ltrim("fields_json"), 2, 1 << 30))
    out = display.split_confidence(r.select("record_id", inside.alias("j")), "j")
    return out.select("record_id", F.size("fields").cast("long").alias("n_fields"), F.size("confidence").cast("long").alias("n_confidence"))


@query(
    f"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '```json\n' || title || '\n```' WHEN 1 THEN 'Here: ```rust\n' || title || '``` and ```x```' WHEN 2 THEN '```' || title || '``` end' ELSE title END AS a FROM documents WHERE title IS NOT NULL)
    SELECT doc_id, {q_trim(f"regexp_replace({q_trim('a')}, '^(?:```json)*(?:```)*|(?:```)+\\z', '', 'g')")} AS cleaned,
      {q_trim("CASE WHEN regexp_matches(a, '```rust.*?```', 's') THEN regexp_extract(a, '```rust(.*?)```', 1, 's') WHEN regexp_matches(a, '```.*?```', 's') THEN regexp_extract(a, '```(.*?)```', 1, 's') ELSE a END")} AS code FROM t"""
)
def answer_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Answers made of every title, fenced in four ways."""
    t, k = F.col("title"), F.col("doc_id") % 4
    answer = F.when(k == 0, F.concat(F.lit("```json\n"), t, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here: ```rust\n"), t, F.lit("``` and ```x```"))).when(k == 2, F.concat(F.lit("```"), t, F.lit("``` end"))).otherwise(t)
    docs = table(spark, d, "documents").where("title IS NOT NULL").select("doc_id", answer.alias("a"))
    return docs.select("doc_id", display.strip_fences(F.col("a")).alias("cleaned"), display.code_block(F.col("a")).alias("code"))


@query(f"WITH {_INVOICE} SELECT doc_id, 'date,invoice_number,total' || chr(10) || '\"' || dat || '\",\"' || inv || '\",\"' || tot || '\"' AS csv FROM o")
def record_csv(spark: SparkSession, d: str) -> DataFrame:
    return display.record_csv(extract.records(invoices(spark, d), _THREE))


@query(
    f"""WITH {_STATEMENT}, {_TROWS}, k AS (SELECT * FROM (VALUES ('date', 46.5), ('narration', 187.0), ('amount', 356.0)) k(key, hx)),
    n AS (SELECT doc_id, row_no, key, arg_min(text, (abs((x0 + x1) / 2 - hx), span_idx)) AS value FROM tr, k GROUP BY ALL),
    ln AS (SELECT doc_id, row_no, {" || ',' || ".join(f"chr(34) || max(value) FILTER (key = '{x}') || chr(34)" for x in ("amount", "date", "narration"))} || ',' || chr(34) || 'Unknown' || chr(34) AS line FROM n GROUP BY ALL),
    al AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY row_no) AS lines FROM ln GROUP BY doc_id)
    SELECT doc_id, array_to_string(['client_name,segment', chr(34) || c_name || '","' || c_mktsegment || chr(34), '', 'transactions', 'amount,date,narration,units', lines], chr(10)) AS csv FROM al JOIN customer ON c_custkey = doc_id"""
)
def statement_csv(spark: SparkSession, d: str) -> DataFrame:
    """CSV of records with an array of transactions."""
    return display.record_csv(extract.records(_statements(spark, d), _SCHEMA))


@query(
    f"""WITH RECURSIVE {BASE}, {_PAIRS}, {_TCOLS}, {_GROUPS.removeprefix(_ROWS + ", ")}, {_TABLES},
    parts AS (SELECT doc_id, 0 AS part, 'key_value_pairs:' || chr(10) || string_agg('  ' || label || ' -> ' || value, chr(10) ORDER BY pair_no) AS text FROM kv GROUP BY doc_id
      UNION ALL SELECT doc_id, 1, 'transaction_columns:' || chr(10) || string_agg('  ' || label || ' (key=' || key || ')', chr(10) ORDER BY col_no) FROM tc GROUP BY doc_id
      UNION ALL SELECT doc_id, 2, 'table_columns:' || chr(10) || string_agg(printf('  %s (x0=%.0f, x1=%.0f)', header, x0, x1), chr(10) ORDER BY col_no) FROM hd JOIN ext USING (doc_id, col_no) WHERE lettered > 0 GROUP BY doc_id)
    SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY part) AS notes FROM parts GROUP BY doc_id"""
)
def layout_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes of the documents' pairs, transaction columns and table columns."""
    s = materialize(_spans(spark, d), "notes-spans")
    return display.layout_notes(rows.key_values(s), rows.transaction_columns(s), rows.table_columns(s))


@query(f"SELECT avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, count(*) AS n FROM ({SCORES})")
def mean_field_scores(spark: SparkSession, d: str) -> DataFrame:
    s = field_scores(spark, d)
    return s.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.count("*").alias("n"))


