"""Queries of the row, schema, extraction and run operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import extract, rows, runs, schema
from folioscope.plans.layout import _FONTS, BASE, GRAPH, NEAREST, WS, _spans, q_trim
from folioscope.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- rows and pairs

_ROWS = f"""o AS (SELECT doc_id, span_idx, (y0 + y1) / 2 AS c, row_number() OVER (PARTITION BY doc_id ORDER BY y0, span_idx) AS rn FROM s),
  f AS (SELECT doc_id, rn, span_idx, c AS first, 0 AS row_no FROM o WHERE rn = 1 UNION ALL
    SELECT o.doc_id, o.rn, o.span_idx, CASE WHEN abs(o.c - f.first) <= 4 THEN f.first ELSE o.c END, CASE WHEN abs(o.c - f.first) <= 4 THEN f.row_no ELSE f.row_no + 1 END FROM f JOIN o ON o.doc_id = f.doc_id AND o.rn = f.rn + 1),
  r AS (SELECT s.*, f.row_no FROM s JOIN f USING (doc_id, span_idx))"""


@query(f"WITH RECURSIVE {BASE}, {_ROWS} SELECT doc_id, span_idx, row_no FROM r")
def visual_rows(spark: SparkSession, d: str) -> DataFrame:
    return rows.visual_rows(_spans(spark, d))


@query(
    f"""WITH RECURSIVE {BASE}, o AS (SELECT doc_id, span_idx, y0 AS c, row_number() OVER (PARTITION BY doc_id ORDER BY y0, span_idx) AS rn FROM s WHERE y0 > 500),
    f AS (SELECT doc_id, rn, span_idx, c AS first, 0 AS row_no FROM o WHERE rn = 1 UNION ALL
      SELECT o.doc_id, o.rn, o.span_idx, CASE WHEN abs(o.c - f.first) <= 2 THEN f.first ELSE o.c END, CASE WHEN abs(o.c - f.first) <= 2 THEN f.row_no ELSE f.row_no + 1 END FROM f JOIN o ON o.doc_id = f.doc_id AND o.rn = f.rn + 1)
    SELECT doc_id, span_idx, row_no FROM f"""
)
def rows_above_500(spark: SparkSession, d: str) -> DataFrame:
    """Rows past a given height, by their lower edge."""
    return rows.rows_below(_spans(spark, d), 500.0, 2.0)


_LETTER = r"\p{L}"
_PAIRS = f"""{_ROWS}, g AS (SELECT *, {q_trim('text')} AS t, count(*) OVER (PARTITION BY doc_id, row_no) AS n, row_number() OVER w AS pos, lead(x0) OVER w - x1 AS gap FROM r WINDOW w AS (PARTITION BY doc_id, row_no ORDER BY x0, y0, span_idx)),
  lone AS (SELECT doc_id, row_no, {q_trim("split_part(text, ':', 1)")} AS label, {q_trim("substr(text, strpos(text, ':') + 1)")} AS value FROM g WHERE n = 1 AND contains(text, ':')),
  cut AS (SELECT doc_id, row_no, arg_max(pos, (gap, -pos)) AS cut, max(gap) AS gap FROM g WHERE n > 1 AND gap IS NOT NULL GROUP BY ALL),
  wide AS (SELECT doc_id, row_no, {q_trim("regexp_replace(coalesce(string_agg(t, ' ' ORDER BY pos) FILTER (t <> '' AND pos <= cut.cut), ''), ':+$', '')")} AS label, coalesce(string_agg(t, ' ' ORDER BY pos) FILTER (t <> '' AND pos > cut.cut), '') AS value
    FROM g JOIN cut USING (doc_id, row_no) WHERE cut.gap >= 10 GROUP BY ALL),
  pr AS (SELECT *, false AS toc FROM lone WHERE label <> '' AND strlen(label) <= 40 AND regexp_matches(label, '{_LETTER}') AND value <> ''
    UNION ALL SELECT *, regexp_matches({q_trim('value')}, '^[0-9]{{1,4}}\\z') AND NOT suffix(label, ':') FROM wide),
  kv AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY row_no) AS pair_no, label, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(label) ORDER BY row_no) AS k FROM pr WHERE NOT toc) WHERE k = 1)"""


@query(f"WITH RECURSIVE {BASE}, {_PAIRS} SELECT doc_id, pair_no, label, value FROM kv")
def key_values(spark: SparkSession, d: str) -> DataFrame:
    return rows.key_values(_spans(spark, d))


_CONTENTS = """s AS (SELECT s_suppkey AS doc_id, (i * 2 + k)::INT AS span_idx,
    CASE WHEN k = 0 THEN CASE i % 5 WHEN 0 THEN 'Introduction' WHEN 1 THEN 'Chapter ' || i WHEN 2 THEN 'Total:' WHEN 3 THEN 'Printed' ELSE s_name END
      ELSE CASE i % 5 WHEN 3 THEN '2026-05-23' ELSE ((s_suppkey * 7 + i * 1301) % 12000)::VARCHAR END END AS text,
    (CASE WHEN k = 0 THEN 50 ELSE 400 END)::DOUBLE AS x0, (i * 20)::DOUBLE AS y0, (CASE WHEN k = 0 THEN 150 ELSE 430 END)::DOUBLE AS x1, (i * 20 + 12)::DOUBLE AS y1, 1 AS page, 10.0 AS font_size, false AS is_bold
  FROM supplier, range(12) t(i), range(2) u(k))"""


def _contents(spark: SparkSession, d: str) -> DataFrame:
    """A table of contents of each supplier: titles and numbers, some of them no page numbers."""
    i, k = F.col("i"), F.col("k")
    title = F.when(i % 5 == 0, "Introduction").when(i % 5 == 1, F.concat(F.lit("Chapter "), i.cast("string"))).when(i % 5 == 2, "Total:").when(i % 5 == 3, "Printed").otherwise(F.col("s_name"))
    number = F.when(i % 5 == 3, F.lit("2026-05-23")).otherwise(((F.col("s_suppkey") * 7 + i * 1301) % 12000).cast("string"))
    lines = table(spark, d, "supplier").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    left, y = k == 0, (i * 20).cast("double")
    return lines.select(
        F.col("s_suppkey").alias("doc_id"), (i * 2 + k).alias("span_idx"), F.when(left, title).otherwise(number).alias("text"), F.when(left, 50.0).otherwise(400.0).alias("x0"), y.alias("y0"),
        F.when(left, 150.0).otherwise(430.0).alias("x1"), (y + 12).alias("y1"), F.lit(1).alias("page"), F.lit(10.0).alias("font_size"), F.lit(False).alias("is_bold"),
    )


@query(f"WITH RECURSIVE {_CONTENTS}, {_PAIRS} SELECT doc_id, row_no, label, value FROM pr WHERE toc")
def toc_entries(spark: SparkSession, d: str) -> DataFrame:
    return rows.all_pairs(_contents(spark, d)).where("toc").drop("toc")


_GROUPS = f"""{_ROWS}, z AS (SELECT *, {q_trim('text')} AS t, row_number() OVER w AS pos, coalesce(x0 - lag(x1) OVER w >= 10, true) AS starts FROM r WINDOW w AS (PARTITION BY doc_id, row_no ORDER BY x0, y0, span_idx)),
  b AS (SELECT doc_id, row_no, list(greatest(0, floor(x0 + 0.5))::INT ORDER BY pos) FILTER (starts) AS boundaries FROM z GROUP BY ALL HAVING count(*) FILTER (starts) >= 2)"""


@query(f"WITH RECURSIVE {BASE}, {_GROUPS} SELECT doc_id, row_no, array_to_string(boundaries, ' ') AS boundaries FROM b")
def row_boundaries(spark: SparkSession, d: str) -> DataFrame:
    b = rows.row_boundaries(_spans(spark, d))
    return b.select("doc_id", "row_no", F.array_join(F.transform("boundaries", lambda x: x.cast("string")), " ").alias("boundaries"))


_TABLES = f"""m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row_no) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM b),
    ff AS (SELECT doc_id, k, row_no, [boundaries] AS heads, 1 AS cluster FROM m WHERE k = 1 AND n >= 3 UNION ALL
      SELECT m.doc_id, m.k, m.row_no, CASE WHEN fit IS NULL THEN list_append(heads, m.boundaries) ELSE heads END, coalesce(fit, len(heads) + 1)
      FROM (SELECT m.*, ff.heads, list_filter(range(1, len(heads) + 1), lambda i: len(heads[i]) = len(m.boundaries) AND len(list_filter(range(1, len(m.boundaries) + 1), lambda j: abs(heads[i][j] - m.boundaries[j]) > 6)) = 0)[1] AS fit
        FROM ff JOIN m ON m.doc_id = ff.doc_id AND m.k = ff.k + 1) m),
    sz AS (SELECT doc_id, cluster, count(*) AS n, min(row_no) AS head FROM ff GROUP BY ALL HAVING count(*) >= 3),
    best AS (SELECT doc_id, arg_max(cluster, (n, -cluster)) AS cluster, arg_max(head, (n, -cluster)) AS head FROM sz GROUP BY doc_id),
    cells AS (SELECT z.*, pos - 1 AS col_no, head FROM z JOIN ff USING (doc_id, row_no) JOIN best ON best.doc_id = z.doc_id AND best.cluster = ff.cluster),
    ext AS (SELECT doc_id, col_no, min(x0) AS x0, max(x1) AS x1 FROM cells GROUP BY ALL),
    hd AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY y0, pos) - 1 AS col_no, t AS header, count(*) FILTER (regexp_matches(t, '{_LETTER}')) OVER (PARTITION BY doc_id) AS lettered FROM cells WHERE row_no = head)"""


@query(f"WITH RECURSIVE {BASE}, {_GROUPS}, {_TABLES} SELECT doc_id, col_no::INT AS col_no, header, x0, x1 FROM hd JOIN ext USING (doc_id, col_no) WHERE lettered > 0")
def table_columns(spark: SparkSession, d: str) -> DataFrame:
    return rows.table_columns(_spans(spark, d)).withColumn("col_no", F.col("col_no").cast("int"))


# ---------------------------------------------------------------- statements made from orders

_MON = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"
_STATEMENT = f"""ord AS (SELECT o_custkey AS doc_id, o_orderkey, o_orderdate, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY o_custkey) AS cnt FROM orders),
  ok AS (SELECT * FROM ord WHERE cnt >= 3),
  sheets AS (SELECT DISTINCT doc_id, n // 20 AS page FROM ok),
  heads AS (SELECT * FROM (VALUES (0, 'Date', 28.0, 65.0), (1, 'Transaction', 74.0, 300.0), (2, 'Amount', 340.0, 372.0), (3, 'Balance', 538.0, 566.0)) h(i, label, hx0, hx1)),
  sp AS (SELECT doc_id, page * 1000 + i AS span_idx, label AS text, hx0 AS x0, 500.0 + page * 1000 AS y0, hx1 AS x1, 512.0 + page * 1000 AS y1, page + 1 AS page, 10.0 AS font_size, true AS is_bold FROM sheets, heads
    UNION ALL SELECT doc_id, (n // 20) * 1000 + 10 + (n % 20) * 4 + i, CASE i WHEN 0 THEN lpad(day(o_orderdate)::VARCHAR, 2, '0') || '-' || {_MON}[month(o_orderdate)] || '-' || (year(o_orderdate) + 25)::VARCHAR
        WHEN 1 THEN 'Order ' || o_orderkey::VARCHAR WHEN 2 THEN floor(o_totalprice)::BIGINT::VARCHAR ELSE (n + 1)::VARCHAR END, hx0, 480.0 - 10 * (n % 20) + (n // 20) * 1000, hx1, 488.0 - 10 * (n % 20) + (n // 20) * 1000, n // 20 + 1, 10.0, false FROM ok, heads
    UNION ALL SELECT doc_id, 900000, 'Client Name:', 28.0, 700.0, 100.0, 712.0, 1, 10.0, true FROM (SELECT DISTINCT doc_id FROM ok)
    UNION ALL SELECT c_custkey, 900001, c_name, 110.0, 700.0, 200.0, 712.0, 1, 10.0, false FROM customer WHERE c_custkey IN (SELECT doc_id FROM ok)
    UNION ALL SELECT c_custkey, 900002, 'Segment: ' || c_mktsegment, 28.0, 680.0, 150.0, 692.0, 1, 10.0, false FROM customer WHERE c_custkey IN (SELECT doc_id FROM ok)),
  s AS (SELECT doc_id, span_idx::INT AS span_idx, text, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, page::INT AS page, font_size::DOUBLE AS font_size, is_bold FROM sp)"""


def _statements(spark: SparkSession, d: str) -> DataFrame:
    """Account statements as spans: one document a customer with three orders or more."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_orderdate", "o_totalprice",
        (F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")) - 1).alias("n"), F.count("*").over(w).alias("cnt"),
    ).where("cnt >= 3").withColumn("sheet", F.floor(F.col("n") / 20).cast("int"))
    months = F.array(*(F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()))
    date = F.concat(F.lpad(F.day("o_orderdate").cast("string"), 2, "0"), F.lit("-"), F.element_at(months, F.month("o_orderdate")), F.lit("-"), (F.year("o_orderdate") + 25).cast("string"))
    heads = ((0, "Date", 28.0, 65.0, date), (1, "Transaction", 74.0, 300.0, F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))),
             (2, "Amount", 340.0, 372.0, F.floor("o_totalprice").cast("string")), (3, "Balance", 538.0, 566.0, (F.col("n") + 1).cast("string")))
    cell = lambda i, text, x0, y0, x1, h, bold: F.struct(
        i.cast("int").alias("span_idx"), text.alias("text"), F.lit(x0).alias("x0"), y0.alias("y0"), F.lit(x1).alias("x1"), (y0 + h).alias("y1"),
        (F.col("sheet") + 1).alias("page"), F.lit(10.0).alias("font_size"), F.lit(bold).alias("is_bold"))
    y = F.lit(480.0) - 10 * (F.col("n") % 20) + F.col("sheet") * 1000
    body = F.array(*(cell(F.col("sheet") * 1000 + 10 + (F.col("n") % 20) * 4 + i, text, x0, y, x1, 8.0, False) for i, _, x0, x1, text in heads))
    lines = o.select("doc_id", F.explode(body).alias("s"))
    top = F.lit(500.0) + F.col("sheet") * 1000
    titles = o.select("doc_id", "sheet").distinct().select("doc_id", F.explode(F.array(*(cell(F.col("sheet") * 1000 + i, F.lit(label), x0, top, x1, 12.0, True) for i, label, x0, x1, _ in heads))).alias("s"))
    people = table(spark, d, "customer").join(o.select("doc_id").distinct(), F.col("c_custkey") == F.col("doc_id"), "left_semi").withColumn("sheet", F.lit(0))
    about = F.array(cell(F.lit(900000), F.lit("Client Name:"), 28.0, F.lit(700.0), 100.0, 12.0, True), cell(F.lit(900001), F.col("c_name"), 110.0, F.lit(700.0), 200.0, 12.0, False),
                    cell(F.lit(900002), F.concat(F.lit("Segment: "), F.col("c_mktsegment")), 28.0, F.lit(680.0), 150.0, 12.0, False))
    facts = people.select(F.col("c_custkey").alias("doc_id"), F.explode(about).alias("s"))
    return lines.unionByName(titles).unionByName(facts).select("doc_id", "s.*")


_KEYS = "CASE lower(text) WHEN 'date' THEN 'date' WHEN 'transaction' THEN 'narration' WHEN 'amount' THEN 'amount' WHEN 'balance' THEN 'balance' END"
_ISDATE = r"regexp_matches(text, '^\p{N}{1,2}-\p{L}{3}-\p{N}{4}\z')"


@query(
    f"""WITH {_STATEMENT}, top AS (SELECT doc_id, max(y0) AS top FROM s WHERE {_ISDATE} GROUP BY doc_id),
    h AS (SELECT doc_id, text AS label, {_KEYS} AS key, y0, span_idx, row_number() OVER (PARTITION BY doc_id, {_KEYS} ORDER BY y0, span_idx) AS k FROM s JOIN top USING (doc_id) WHERE y0 > top AND y0 <= top + 40 AND x0 >= 20 AND {_KEYS} IS NOT NULL)
    SELECT doc_id, label, key, row_number() OVER (PARTITION BY doc_id ORDER BY y0, span_idx) AS col_no FROM h WHERE k = 1"""
)
def transaction_columns(spark: SparkSession, d: str) -> DataFrame:
    return rows.transaction_columns(_statements(spark, d))


_TROWS = f"""dt AS (SELECT doc_id, y0 AS band FROM s WHERE {_ISDATE}),
  cl AS (SELECT s.*, band FROM s JOIN dt ON dt.doc_id = s.doc_id AND abs(s.y0 - band) <= 2),
  tr AS (SELECT doc_id, span_idx, text, x0, x1, dense_rank() OVER (PARTITION BY doc_id ORDER BY floor(band / 1000), band DESC) AS row_no FROM cl)"""


@query(f"WITH {_STATEMENT}, {_TROWS} SELECT doc_id, row_no::INT AS row_no, span_idx FROM tr")
def transaction_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows in reading order; the pages of the statements are 1000 points apart."""
    return rows.transaction_rows(_statements(spark, d))


_SCHEMA = '{"client_name": "string", "segment": "string", "transactions": {"type": "array", "columns": {"Date": "date", "Transaction": "narration", "Amount": "amount", "Units": "units"}}}'


@query(
    f"""WITH {_STATEMENT}, {_TROWS}, k AS (SELECT * FROM (VALUES ('date', 46.5), ('narration', 187.0), ('amount', 356.0)) k(key, hx)),
    n AS (SELECT doc_id, row_no, key, arg_min(text, (abs((x0 + x1) / 2 - hx), span_idx)) AS value FROM tr, k GROUP BY ALL)
    SELECT doc_id, row_no::INT AS row_no, key, value FROM n UNION ALL SELECT DISTINCT doc_id, row_no::INT, 'units', 'Unknown' FROM tr"""
)
def statement_cells(spark: SparkSession, d: str) -> DataFrame:
    """Array fields of a schema: the cells of each transaction; a column without header is 'Unknown'."""
    s = _statements(spark, d)
    columns = extract.compile_schema(_SCHEMA)[1][0]["columns"]
    return extract.table_cells(s, columns)


@query(
    f"""WITH {_STATEMENT}, n AS (SELECT doc_id, count(*) AS rows FROM s WHERE {_ISDATE} GROUP BY doc_id)
    SELECT n.doc_id, c_name AS client_name, c_mktsegment AS segment, n.rows AS n_rows, true AS matches FROM n JOIN customer ON c_custkey = doc_id"""
)
def extract_statement(spark: SparkSession, d: str) -> DataFrame:
    r = extract.records(_statements(spark, d), _SCHEMA)
    ok = extract.validation(r, _SCHEMA).select("doc_id", "matches")
    return r.join(ok, "doc_id").select("doc_id", F.col("fields")["client_name"].alias("client_name"), F.col("fields")["segment"].alias("segment"), F.size(F.col("arrays")["transactions"]).cast("long").alias("n_rows"), "matches")


# ---------------------------------------------------------------- invoices made from orders

_MOVE = "((o_custkey % 7) * 10)::DOUBLE AS dx, ((o_custkey % 5) * 20)::DOUBLE AS dy"
_INVOICE = f"""o AS (SELECT o_orderkey AS doc_id, {_MOVE}, 'INV-' || o_orderkey::VARCHAR AS inv, (year(o_orderdate) + 25)::VARCHAR || '-' || lpad(month(o_orderdate)::VARCHAR, 2, '0') || '-' || lpad(day(o_orderdate)::VARCHAR, 2, '0') AS dat, '$' || o_totalprice::DECIMAL(18,2)::VARCHAR AS tot FROM orders)"""
_INVOICE_ROWS = ((0, "'INVOICE'", 50, 750, 100, 20), (1, "'Invoice Number:'", 50, 700, 100, 15), (2, "inv", 180, 700, 100, 15), (3, "'Date:'", 50, 680, 50, 15), (4, "dat", 180, 680, 90, 15), (5, "'Total:'", 400, 400, 50, 15), (6, "tot", 500, 400, 55, 15))


def invoices(spark: SparkSession, d: str) -> DataFrame:
    """Invoices as spans: one document an order, moved about the page by customer."""
    orders = table(spark, d, "orders").repartition("o_orderkey")  # a row becomes seven, so spread them first
    o = orders.select(
        F.col("o_orderkey").alias("doc_id"), ((F.col("o_custkey") % 7) * 10).cast("double").alias("dx"), ((F.col("o_custkey") % 5) * 20).cast("double").alias("dy"),
        F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("inv"),
        F.format_string("%d-%02d-%02d", F.year("o_orderdate") + 25, F.month("o_orderdate"), F.day("o_orderdate")).alias("dat"),
        F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("tot"),
    )
    text = lambda t: F.lit(t[1:-1]) if t[0] == "'" else F.col(t)
    cells = [
        F.struct(F.lit(i).alias("span_idx"), text(t).alias("text"), (F.col("dx") + x).alias("x0"), (F.col("dy") + y).alias("y0"), (F.col("dx") + x + w).alias("x1"), (F.col("dy") + y + h).alias("y1"))
        for i, t, x, y, w, h in _INVOICE_ROWS
    ]
    s = o.select("doc_id", F.explode(F.array(*cells)).alias("s")).select("doc_id", "s.*")
    return s.select("*", F.lit(1).alias("page"), F.lit(10.0).alias("font_size"), F.lit(False).alias("is_bold"))


_THREE = '{"invoice_number": "string", "date": "date", "total": "number"}'


@query(f"WITH {_INVOICE} SELECT doc_id, dat AS date, inv AS invoice_number, tot AS total FROM o")
def extract_invoice(spark: SparkSession, d: str) -> DataFrame:
    """Number, date and total of every invoice by nearest-right lookup, as one wide table."""
    f = extract.scalar_fields(invoices(spark, d), _THREE)
    return extract.union_table(f, ["date", "invoice_number", "total"])


@query(f"WITH {_INVOICE} SELECT doc_id, tot AS total, dat || ',' || inv || ',' || tot AS line FROM o")
def invoice_csv(spark: SparkSession, d: str) -> DataFrame:
    f = extract.scalar_fields(invoices(spark, d), _THREE)
    return extract.csv_rows(f).join(f.where("field = 'total'").select("doc_id", F.col("value").alias("total")), "doc_id")


@query("SELECT count(*)::BIGINT AS n_docs, count(*)::BIGINT AS n_exact, 1::BIGINT AS n_layouts FROM orders")
def invoice_layouts(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint doesn't follow the place on the page: all invoices share one layout."""
    from folioscope.operators import layout

    s = invoices(spark, d)
    ids = layout.layout_ids(s).agg(F.count("*").alias("n_docs"), F.countDistinct("layout_id").alias("n_layouts"))
    sure = extract.scalar_fields(s, _THREE).where("field = 'date' AND confidence = 'exact'").agg(F.count("*").alias("n_exact"))
    return ids.withColumn("k", F.lit(1)).join(sure.withColumn("k", F.lit(1)), "k").drop("k")


_LABELS = ["Total:", "Date:", "Bill To:", "Client Name:", "Department:"]
_LIST = "[" + ", ".join(f"'{x}'" for x in _LABELS) + "]"


@query(
    f"""WITH {GRAPH}, lb AS (SELECT unnest({_LIST}) AS label), c AS (SELECT doc_id, span_idx, label, {q_trim('text')} AS t, nullif(right_t, '') AS right_t FROM g, lb),
    v AS (SELECT doc_id, label, arg_min_null(right_t, span_idx) FILTER (lower(t) = lower(label)) AS a, arg_min(right_t, span_idx) FILTER (lower(t) = lower(label) AND right_t IS NOT NULL) AS b,
      arg_min(nullif({q_trim("substr(t, strpos(t, ':') + 1)")}, ''), span_idx) FILTER (starts_with(lower(t), lower(label)) AND contains(t, ':') AND {q_trim("substr(t, strpos(t, ':') + 1)")} <> '') AS i FROM c GROUP BY ALL)
    SELECT doc_id, label, coalesce(a, b, i) AS value, CASE WHEN coalesce(a, b) IS NOT NULL THEN 'exact' WHEN i IS NOT NULL THEN 'heuristic' END AS how FROM v"""
)
def label_values(spark: SparkSession, d: str) -> DataFrame:
    return extract.label_values(_spans(spark, d), _LABELS)


# ---------------------------------------------------------------- schemas


def q_type(x: str) -> str:
    return f"""CASE WHEN {x} = '' OR strlen({x}) > 100 THEN 'string'
      WHEN regexp_matches({x}, '^20[2-9][0-9]-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])\\z') OR regexp_matches({x}, '^0*([1-9]|1[0-2])/0*([1-9]|[12][0-9]|3[01])/0*20[2-9][0-9]\\z') THEN 'date'
      WHEN length({x}) > 1 AND (regexp_matches({x}, '^\\$[\\p{{N}},]*\\.?[\\p{{N}},]*\\z') OR regexp_matches({x}, '^[\\p{{N}},]*\\.?[\\p{{N}},]*%\\z')) THEN 'number'
      WHEN regexp_matches({x}, '\\p{{N}}') AND length(regexp_replace({x}, '\\p{{N}}', '', 'g')) <= 3 AND NOT regexp_matches({x}, '\\p{{L}}') AND length({x}) - length(replace({x}, '-', '')) <= 1 AND length({x}) - length(replace({x}, '.', '')) <= 1 THEN 'number'
      ELSE 'string' END"""


@query(f"WITH {BASE}, t AS (SELECT doc_id, span_idx, {q_trim('text')} AS t FROM s) SELECT doc_id, span_idx, {q_type('t')} AS kind FROM t")
def field_types(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("doc_id", "span_idx", T.field_type(F.col("text")).alias("kind"))


def q_snake(x: str) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}} ]', '', 'g'), '[{WS}]+'), lambda w: w <> ''), '_')"


_INFER = f"""{_FONTS}, {_PAIRS},
  q AS (SELECT *, {q_trim('text')} AS t, (y0 + y1) / 2 AS c FROM rr), q1 AS (SELECT *, {q_trim("split_part(t, ':', 1)")} AS label, {q_trim("substr(t, strpos(t, ':') + 1)")} AS inline FROM q WHERE contains(t, ':')),
  q2 AS (SELECT *, {q_snake('label')} AS name FROM q1 WHERE label <> '' AND strlen(label) <= 40 AND regexp_matches(label, '{_LETTER}')
    AND NOT (NOT is_bold AND font_size > 0 AND abs(font_size - common_size) < 0.5 AND rarity < 0.4 AND length(t) > 40)),
  q3 AS (SELECT *, inline <> '' AND strlen(inline) <= 80 AS at_hand FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY span_idx) AS k FROM q2) WHERE k = 1),
  rt AS (SELECT a.doc_id, a.span_idx, arg_min(b.t, (b.x0 - a.x1, floor(b.c / 14), b.span_idx)) AS v FROM q3 a JOIN q b ON a.doc_id = b.doc_id AND b.x0 >= a.x1 AND b.t <> a.t AND abs(a.c - b.c) <= 14 WHERE NOT a.at_hand GROUP BY ALL),
  cf AS (SELECT q3.doc_id, q3.span_idx, name, CASE WHEN at_hand THEN {q_type('inline')} ELSE coalesce(CASE WHEN v IS NOT NULL THEN {q_type('v')} END, 'string') END AS kind FROM q3 LEFT JOIN rt USING (doc_id, span_idx)),
  al AS (SELECT doc_id, name, kind, 0 AS pass, span_idx AS pos FROM cf UNION ALL SELECT doc_id, {q_snake('label')}, CASE WHEN strlen(value) <= 80 THEN {q_type(q_trim('value'))} ELSE 'string' END, 1, pair_no FROM kv WHERE {q_snake('label')} <> ''),
  ev AS (SELECT doc_id, name, kind FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY pass, pos) AS k FROM al) WHERE k = 1),
  inf AS (SELECT * FROM ev UNION ALL SELECT doc_id, unnest(['invoice_number', 'date', 'total']), 'string' FROM (SELECT DISTINCT doc_id FROM s) dd WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.doc_id = dd.doc_id))"""


@query(f"WITH RECURSIVE {_INFER} SELECT doc_id, span_idx, name, kind FROM cf")
def colon_fields(spark: SparkSession, d: str) -> DataFrame:
    return schema.colon_fields(_spans(spark, d))


@query(f"WITH RECURSIVE {_INFER} SELECT doc_id, name, kind FROM inf")
def inferred_fields(spark: SparkSession, d: str) -> DataFrame:
    return schema.inferred_fields(_spans(spark, d))


@query(f"WITH RECURSIVE {_INFER} SELECT doc_id, '{{' || string_agg('\"' || name || '\":\"' || kind || '\"', ',' ORDER BY name) || '}}' AS schema_json FROM inf GROUP BY doc_id")
def inferred_schemas(spark: SparkSession, d: str) -> DataFrame:
    return schema.inferred_schemas(_spans(spark, d))


_LOW = f"array_to_string(list_filter(regexp_split_to_array(lower(label), '[{WS}]+'), lambda w: w <> ''), ' ')"
_KEY = f"CASE low {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.HEADER_KEYS.items())} ELSE array_to_string(list_filter(regexp_split_to_array(low, '[^\\p{{L}}\\p{{N}}]'), lambda w: w <> ''), '_') END"
_TCOLS = f"""dts AS (SELECT doc_id, x0, y0, span_idx FROM s WHERE {_ISDATE}),
    fx AS (SELECT doc_id, arg_min(x0, span_idx) AS first_x FROM dts GROUP BY doc_id HAVING count(*) >= 3),
    tops AS (SELECT doc_id, max(y0) AS top FROM dts JOIN fx USING (doc_id) WHERE abs(x0 - first_x) < 20 GROUP BY doc_id HAVING count(*) >= 3),
    th0 AS (SELECT doc_id, y0, span_idx, {q_trim('text')} AS label FROM s JOIN tops USING (doc_id) WHERE y0 > top AND y0 <= top + 40 AND x0 >= 20),
    th1 AS (SELECT doc_id, y0, span_idx, label, {_KEY} AS key FROM (SELECT *, {_LOW} AS low FROM th0 WHERE label <> '')),
    th2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY y0, span_idx) AS k FROM th1 WHERE key IN {T.TRANSACTION_KEYS!r}),
    th3 AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, bool_or(key = 'date') OVER (PARTITION BY doc_id) AS dated FROM th2 WHERE k = 1),
    tc AS (SELECT doc_id, label, key, row_number() OVER (PARTITION BY doc_id ORDER BY y0, span_idx) AS col_no FROM th3 WHERE n >= 3 AND dated)"""


@query(
    f"""WITH RECURSIVE {_INFER}, {_TCOLS}, ta AS (SELECT doc_id, string_agg(key, ' ' ORDER BY key) AS keys FROM tc GROUP BY doc_id)
    SELECT doc_id, name, kind, '' AS keys FROM inf WHERE name <> 'transactions' OR doc_id NOT IN (SELECT doc_id FROM ta) UNION ALL SELECT doc_id, 'transactions', 'array', keys FROM ta"""
)
def discovered_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every field found in the spans: labels, pairs, and transactions with their columns."""
    f = schema.discovered_fields(_spans(spark, d))
    return f.select("doc_id", "name", "kind", F.coalesce(F.array_join(F.array_sort(F.map_values("columns")), " "), F.lit("")).alias("keys"))


@query(
    f"""WITH RECURSIVE {_STATEMENT}, {_TCOLS} SELECT doc_id, string_agg(label || '=' || key, ' ' ORDER BY col_no) AS columns FROM tc GROUP BY doc_id"""
)
def statement_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the statements' transactions, in their order."""
    t = rows.transaction_columns(_statements(spark, d))
    g = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("col_no", F.concat("label", F.lit("="), "key").alias("c")))).alias("c"))
    return g.select("doc_id", F.array_join("c.c", " ").alias("columns"))


# declared fields of a table ``given``(id, j) of schemas, in all their shapes
_DECLARED = """df1 AS (SELECT id, unnest(json_keys(j)) AS name, j FROM given WHERE json_type(j) = 'OBJECT'),
    df2 AS (SELECT id, name, json_extract(j, '$."' || name || '"') AS spec FROM df1 UNION ALL SELECT id, e->>'$.name', e FROM (SELECT id, unnest(json_extract(j, '$[*]')) AS e FROM given WHERE json_type(j) = 'ARRAY')),
    df3 AS (SELECT DISTINCT id, name, lower(trim(CASE WHEN json_type(spec) = 'OBJECT' THEN coalesce(spec->>'$.type', '') ELSE spec->>'$' END)) AS kind, CASE WHEN json_type(spec) = 'OBJECT' THEN json_extract(spec, '$.columns') END AS cols FROM df2),
    df4 AS (SELECT id, name, cols, unnest(json_keys(cols)) AS label FROM df3 WHERE json_type(cols) = 'OBJECT'),
    declared AS (SELECT id, name AS field, kind, '' AS label FROM df3 UNION ALL SELECT id, name || '.' || json_extract_string(cols, '$."' || label || '"'), '', label FROM df4)"""


@query(f"WITH given AS (SELECT DISTINCT manifest_id AS id, schema_json::JSON AS j FROM layout_manifests WHERE json_valid(schema_json)), {_DECLARED} SELECT id AS manifest_id, field, kind, label FROM declared")
def manifest_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the manifests' schemas in all their shapes, with the columns of array fields."""
    m = table(spark, d, "layout_manifests").select("manifest_id", "schema_json").distinct()
    return schema.declared_fields(m, "manifest_id")


#: Layouts compiled before this time are known when the documents come in.
_KNOWN = "created_at < '2024-07-01'"
_ROUTES = f"""lay AS (SELECT doc_id, min(layout_id) AS layout_id FROM spans GROUP BY doc_id),
    known AS (SELECT layout_id, arg_max(schema_json, manifest_no) AS schema_json FROM layout_manifests WHERE {_KNOWN} GROUP BY layout_id),
    given AS (SELECT layout_id AS id, schema_json::JSON AS j FROM known WHERE json_valid(schema_json)), {_DECLARED},
    fresh AS (SELECT layout_id, min(doc_id) AS doc_id FROM lay WHERE layout_id NOT IN (SELECT layout_id FROM known) GROUP BY layout_id),
    lf AS (SELECT id AS layout_id, true AS was_cached, field FROM declared WHERE label = '' AND kind <> 'array' UNION ALL SELECT fresh.layout_id, false, name FROM fresh JOIN inf USING (doc_id)),
    lb AS (SELECT *, array_to_string(list_transform(string_split(replace(field, '_', ' '), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') || ':' AS label FROM lf)"""


def _routes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = _spans(spark, d)
    docs = table(spark, d, "spans").groupBy("doc_id").agg(F.min("layout_id").alias("layout_id"))
    return s, docs, extract.route(s, docs, table(spark, d, "layout_manifests").where(_KNOWN))


@query(f"WITH RECURSIVE {_INFER}, {_ROUTES} SELECT layout_id, was_cached, field FROM lf")
def layout_routes(spark: SparkSession, d: str) -> DataFrame:
    """The fields each layout is read by: of its manifest where it is known, else of its first document."""
    return _routes(spark, d)[2]


_RIGHT = f"nx AS (SELECT e.doc_id, e.span_idx, t.text AS right_t FROM ({NEAREST['right']}) e JOIN s t ON t.doc_id = e.doc_id AND t.span_idx = e.neighbour_idx)"


@query(
    f"""WITH RECURSIVE {_INFER}, {_RIGHT}, {_ROUTES},
    lc AS (SELECT s.doc_id, s.span_idx, lb.field, lb.label, {q_trim('s.text')} AS t, nullif(right_t, '') AS right_t FROM s LEFT JOIN nx USING (doc_id, span_idx) JOIN lay ON lay.doc_id = s.doc_id JOIN lb USING (layout_id)),
    lv AS (SELECT doc_id, field, arg_min_null(right_t, span_idx) FILTER (lower(t) = lower(label)) AS a, arg_min(right_t, span_idx) FILTER (lower(t) = lower(label) AND right_t IS NOT NULL) AS b,
      arg_min(nullif({q_trim("substr(t, strpos(t, ':') + 1)")}, ''), span_idx) FILTER (starts_with(lower(t), lower(label)) AND {q_trim("substr(t, strpos(t, ':') + 1)")} <> '') AS i FROM lc GROUP BY ALL)
    SELECT lay.doc_id, lay.layout_id, was_cached, lb.field, coalesce(a, b, i, 'Unknown') AS value, CASE WHEN coalesce(a, b) IS NOT NULL THEN 'exact' WHEN i IS NOT NULL THEN 'heuristic' ELSE 'fuzzy' END AS confidence
    FROM lay JOIN lb USING (layout_id) LEFT JOIN lv ON lv.doc_id = lay.doc_id AND lv.field = lb.field"""
)
def routed_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every document read by the schema of its own layout."""
    return extract.routed_fields(*_routes(spark, d))


# ---------------------------------------------------------------- records


@query(
    """WITH r AS (SELECT DISTINCT record_id, fields_json::JSON AS j FROM extracted_records WHERE json_valid(fields_json))
    SELECT record_id, j->>'$.invoice_number' AS invoice_number, j->>'$.date' AS "date", j->>'$.currency' AS currency FROM r"""
)
def record_columns(spark: SparkSession, d: str) -> DataFrame:
    """An explicit list of columns from JSON records; missing and null values are null."""
    r = table(spark, d, "extracted_records").select("record_id", "fields_json").distinct().where(F.try_parse_json("fields_json").isNotNull())
    return extract.json_columns(r, "fields_json", ["invoice_number", "date", "currency"])


@query()
def records_union(spark: SparkSession, d: str) -> DataFrame:
    """All readable records in one table over the union of all their top-level fields."""
    return extract.union_records(table(spark, d, "extracted_records").select(F.col("record_id").alias("doc_id"), "fields_json"))


@query(
    """WITH r AS (SELECT DISTINCT record_id, fields_json::JSON AS j FROM extracted_records WHERE json_valid(fields_json)), k AS (SELECT record_id, j, unnest(json_keys(j)) AS name FROM r WHERE json_type(j) = 'OBJECT')
    SELECT name, count(*) AS n_records, count(*) FILTER (json_type(json_extract(j, '$."' || name || '"')) <> 'NULL') AS n_filled FROM k GROUP BY name"""
)
def records_union_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the union of all records, in how many records each is and in how many it is filled."""
    r = table(spark, d, "extracted_records").select("record_id", "fields_json").distinct().where(F.try_parse_json("fields_json").isNotNull())
    f = r.select(F.explode(F.from_json("fields_json", "map<string,string>")).alias("name", "value"))
    return f.groupBy("name").agg(F.count("*").alias("n_records"), F.count("value").alias("n_filled"))


@query(
    """WITH r AS (SELECT DISTINCT record_id, fields_json::JSON AS j FROM extracted_records WHERE json_valid(fields_json)), k AS (SELECT record_id, j, unnest(json_keys(j)) AS name FROM r WHERE json_type(j) = 'OBJECT'),
    t AS (SELECT record_id, json_type(json_extract(j, '$."' || name || '"')) AS kind FROM k)
    SELECT record_id, count(*) FILTER (kind NOT IN ('OBJECT', 'ARRAY')) AS n_scalars, count(*) FILTER (kind IN ('OBJECT', 'ARRAY')) AS n_structured, coalesce((SELECT json_array_length(j, '$.transactions') FROM r WHERE r.record_id = t.record_id), 0)::BIGINT AS n_transactions FROM t GROUP BY record_id"""
)
def record_counts(spark: SparkSession, d: str) -> DataFrame:
    """Scalars, structured fields and transactions of each record."""
    r = table(spark, d, "extracted_records").select("record_id", "fields_json").distinct().where(F.try_parse_json("fields_json").isNotNull())
    kinds = F.from_json("fields_json", "map<string,variant>")
    return runs.record_counts(r.withColumn("fields", kinds), "record_id")


@query(
    """WITH r AS (SELECT DISTINCT record_id, fields_json::JSON AS j FROM extracted_records WHERE json_valid(fields_json)),
    p AS (SELECT record_id, list_filter(['invoice_number', 'date', 'total'], lambda k: NOT list_contains(json_keys(j), k)) AS miss, [j->>'$.invoice_number', j->>'$.date', j->>'$.total'] AS v FROM r)
    SELECT record_id AS doc_id, len(miss) = 0 AS matches, len(list_filter(v, lambda x: NOT (x IS NULL OR trim(x) = '' OR lower(trim(x)) = 'unknown'))) = 0 AS is_empty, array_to_string(miss, ' ') AS missing FROM p"""
)
def extraction_validation(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "extracted_records").select(F.col("record_id").alias("doc_id"), "fields_json").distinct().where(F.try_parse_json("fields_json").isNotNull())
    names = ("invoice_number", "date", "total")
    raw = F.from_json("fields_json", "map<string,string>")
    r = r.withColumn("fields", F.map_filter(raw, lambda k, v: k.isin(*names))).withColumn("arrays", F.create_map().cast("map<string,array<map<string,string>>>"))
    out = extract.validation(r, _THREE)
    ordered = F.array_join(F.filter(F.array(*(F.lit(n) for n in names)), lambda n: F.array_contains("missing", n)), " ")
    return out.withColumn("missing", ordered)


# ---------------------------------------------------------------- runs

_CALLS = "c AS (SELECT DISTINCT ON (call_id) * FROM llm_calls ORDER BY call_id, ingested_at)"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return runs.first_calls(table(spark, d, "llm_calls"))


@query(
    f"""WITH {_CALLS} SELECT count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, sum(token_usage.input_tokens)::BIGINT AS input_tokens, sum(token_usage.output_tokens)::BIGINT AS output_tokens,
    sum(token_usage.estimated_cost_cents)::BIGINT AS cost_cents, coalesce(avg(latency_ms) FILTER (latency_ms >= 0), 0) AS mean_latency_ms FROM c"""
)
def call_summary(spark: SparkSession, d: str) -> DataFrame:
    return runs.call_summary(_calls(spark, d))


@query(
    f"""WITH {_CALLS} SELECT layout_id, count(*) AS calls, sum(token_usage.input_tokens)::BIGINT AS input_tokens, sum(token_usage.output_tokens)::BIGINT AS output_tokens, sum(token_usage.estimated_cost_cents)::BIGINT AS cost_cents
    FROM c WHERE layout_id IS NOT NULL GROUP BY ROLLUP (layout_id)"""
)
def cost_per_layout(spark: SparkSession, d: str) -> DataFrame:
    return runs.cost_per_layout(_calls(spark, d))


@query(f"WITH {_CALLS}, w AS (SELECT call_id, layout_id, coalesce(sum(token_usage.estimated_cost_cents) OVER (PARTITION BY layout_id ORDER BY call_id), 0)::BIGINT AS spent FROM c WHERE layout_id IS NOT NULL) SELECT *, spent > 50 AS over FROM w".replace(" AS over ", ' AS "over" '))
def budget_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return runs.budget_cutoff(_calls(spark, d))


@query(f"WITH {_CALLS} SELECT call_id, model, call_type FROM c ORDER BY call_id DESC LIMIT 20")
def recent_calls(spark: SparkSession, d: str) -> DataFrame:
    return runs.recent_calls(_calls(spark, d)).select("call_id", "model", "call_type")


@query(
    """WITH e AS (SELECT DISTINCT entry_id, batch_no, success, was_cached FROM batch_entries)
    SELECT batch_no, count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, count(*) FILTER (success AND was_cached) AS cached, greatest(0, count(*) FILTER (success) - count(*) FILTER (success AND was_cached)) AS "new" FROM e GROUP BY batch_no"""
)
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return runs.batch_summary(table(spark, d, "batch_entries"))


@query("SELECT DISTINCT entry_id, path, error FROM batch_entries WHERE NOT success")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    return runs.dead_letters(table(spark, d, "batch_entries"))


@query(
    f"""WITH {_CALLS}, l AS (SELECT model, list(latency_ms ORDER BY latency_ms) AS a, avg(latency_ms) AS mean FROM c WHERE latency_ms >= 0 GROUP BY model)
    SELECT model, len(a)::BIGINT AS n, a[floor(len(a) * 0.5)::INT + 1] AS p50, a[floor(len(a) * 0.95)::INT + 1] AS p95, a[floor(len(a) * 0.99)::INT + 1] AS p99, mean FROM l"""
)
def latency_by_index(spark: SparkSession, d: str) -> DataFrame:
    return runs.latency_by_index(_calls(spark, d).where("latency_ms >= 0"), "model", "latency_ms")


@query(
    """WITH t AS (SELECT doc_id, text, length(regexp_replace(text, '[\\x{0000}-\\x{2E80}]', '', 'g')) AS cjk FROM documents)
    SELECT doc_id, ((length(text) - cjk) // 4 + cjk // 2)::BIGINT AS tokens FROM t"""
)
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return runs.token_estimates(table(spark, d, "documents"))


_EST = "((length(x) - cjk) // 4 + cjk // 2)::BIGINT"


@query(
    f"""WITH t AS (SELECT doc_id, x, length(regexp_replace(x, '[\\x{{0000}}-\\x{{2E80}}]', '', 'g')) AS cjk, k FROM (SELECT doc_id, coalesce(text, '') AS x, 1 AS k FROM documents UNION ALL SELECT doc_id, coalesce(title, ''), 2 FROM documents)),
    u AS (SELECT doc_id, sum({_EST}) FILTER (k = 1)::BIGINT AS input_tokens, sum({_EST}) FILTER (k = 2)::BIGINT AS output_tokens FROM t GROUP BY doc_id)
    SELECT *, round((input_tokens * 14.0::DOUBLE + output_tokens * 28.0::DOUBLE) / 1e6 * 100)::BIGINT AS cents FROM u"""
)
def fallback_usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage of calls whose answer tells none, estimated from what was sent and received."""
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("sent"), F.coalesce("title", F.lit("")).alias("received"))
    return t.select("doc_id", *runs.fallback_usage(F.col("sent"), F.col("received"), 14.0, 28.0))


@query(
    f"""WITH {_CALLS} SELECT call_id, round((token_usage.input_tokens * 0.14 + token_usage.output_tokens * 0.28) / 1e6 * 100)::BIGINT AS cents, least(8000, 500 * pow(2, least(greatest(call_id % 7 - 1, 0), 4)))::INT AS backoff_ms,
    (400 + call_id % 110) IN (429, 500, 502, 503, 504) AS retry FROM c"""
)
def call_costs(spark: SparkSession, d: str) -> DataFrame:
    u = "token_usage"
    return _calls(spark, d).select(
        "call_id", T.cost_cents(F.col(f"{u}.input_tokens"), F.col(f"{u}.output_tokens"), 0.14, 0.28).alias("cents"),
        T.retry_backoff_ms((F.col("call_id") % 7).cast("int")).alias("backoff_ms"), T.is_retryable(400 + F.col("call_id") % 110).alias("retry"),
    )


@query(
    f"""WITH {_CALLS}, m AS (SELECT call_id, lower(error_message) AS m FROM c WHERE error_message IS NOT NULL)
    SELECT call_id, CASE WHEN regexp_matches(m, '401|unauthorized|auth') THEN 'auth' WHEN regexp_matches(m, '429|rate limit|too many requests') THEN 'rate_limit' WHEN regexp_matches(m, 'timeout|timed out|timedout') THEN 'timeout' WHEN regexp_matches(m, 'invalid type|parse error|expected') THEN 'parse_error' ELSE 'other' END AS kind FROM m"""
)
def call_errors(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).where("error_message IS NOT NULL").select("call_id", T.error_kind(F.col("error_message")).alias("kind"))


@query("SELECT DISTINCT manifest_id, layout_id, cache_version = 3 AS is_current, regexp_matches(layout_id, '^[0-9A-Fa-f]{64}\\z') AS valid_id, substr(layout_id, 1, 16) AS display_id FROM layout_manifests")
def manifest_checks(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "layout_manifests").select("manifest_id", "layout_id", "cache_version").distinct()
    return m.select("manifest_id", "layout_id", (F.col("cache_version") == 3).alias("is_current"), T.is_layout_id(F.col("layout_id")).alias("valid_id"), F.substring("layout_id", 1, 16).alias("display_id"))


# ---------------------------------------------------------------- scores


@query(
    f"""WITH RECURSIVE {_INFER}, t AS (SELECT unnest(['date', 'total', 'invoice_number', 'bill_to']) AS field), dd AS (SELECT DISTINCT doc_id FROM s),
    x AS (SELECT dd.doc_id, (SELECT count(*) FROM inf WHERE inf.doc_id = dd.doc_id) AS n_found, 4::BIGINT AS n_expected, (SELECT count(*) FROM inf WHERE inf.doc_id = dd.doc_id AND inf.name IN (SELECT field FROM t)) AS hits FROM dd),
    y AS (SELECT *, CASE WHEN n_found > 0 THEN hits / n_found ELSE 0 END AS precision, hits / n_expected AS recall FROM x)
    SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM y"""
)
def field_scores(spark: SparkSession, d: str) -> DataFrame:
    """Inferred field names against the four fields of an English invoice."""
    s = _spans(spark, d)
    found = schema.inferred_fields(s).select("doc_id", F.col("name").alias("field"))
    want = s.select("doc_id").distinct().withColumn("field", F.explode(F.array(*(F.lit(x) for x in ("date", "total", "invoice_number", "bill_to")))))
    return runs.field_scores(found, want)


@query(ORACLE["field_scores"])
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """The scores in order of their documents."""
    return field_scores(spark, d).orderBy("doc_id")


@query(f"WITH {_INVOICE} SELECT doc_id, 3::BIGINT AS n_expected, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 3 END::BIGINT AS hits FROM o")
def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """Detected pairs of the invoices against the truth, in which every tenth total is wrong."""
    s = invoices(spark, d)
    truth = s.where("span_idx IN (2, 4, 6)").select(
        "doc_id", F.when(F.col("span_idx") == 2, "Invoice Number").when(F.col("span_idx") == 4, "Date").otherwise("Total").alias("label"),
        F.when((F.col("doc_id") % 10 == 0) & (F.col("span_idx") == 6), F.lit("none")).otherwise(F.col("text")).alias("value"),
    )
    return runs.pair_hits(rows.key_values(s), truth)

