from pyspark.sql import functions as F

from folioscope.functions import display
from folioscope.operators import extract, rows, runs
from folioscope.operators import spans as S

SPAN = "doc_id long, span_idx int, text string, x0 double, y0 double, x1 double, y1 double, page int, font_size double, is_bold boolean, is_italic boolean"


def span_rows(spark, cells):
    return S.clean_spans(spark.createDataFrame([(1, i, t, float(x0), float(y0), float(x1), float(y1), 1, 10.0, False, False) for i, (t, x0, y0, x1, y1) in enumerate(cells)], SPAN))


def test_columns_in_order():
    assert display.shown_columns(["memo", "qty", "x", "date"]) == [("date", "Date", False), ("memo", "Narration", False), ("qty", "Units", True), ("x", "x", False)]


def test_csv_with_tables(spark):
    df = spark.createDataFrame([(1, {"b": 'say "hi"', "a": None}, {"t": [{"q": "1"}, {"p": "x", "q": "2"}], "none": []}), (2, {}, {})], "doc_id long, fields map<string,string>, arrays map<string,array<map<string,string>>>")
    got = {r.doc_id: r.csv for r in display.record_csv(df).collect()}
    assert got == {1: 'a,b\n"","say ""hi"""\n\nt\np,q\n"","1"\n"x","2"', 2: ""}


def test_confidence(spark):
    df = spark.createDataFrame([(1, '{"_confidence":{"a":"exact"},"a":"x","n":{"k":1}}'), (2, '{"a":'), (3, "{}"), (4, None)], "i int, j string")
    got = {r.i: (r.fields, r.confidence) for r in display.split_confidence(df, "j").collect()}
    assert got == {1: ({"a": "x", "n": '{"k":1}'}, {"a": "exact"}), 2: (None, None), 3: ({}, {}), 4: (None, None)}


def test_row_grouping(spark):
    s = span_rows(spark, [("a", 0, y, 9, y) for y in (100, 103, 106, 120)])
    assert [r.row_no for r in rows.visual_rows(s, 4.0).orderBy("span_idx").collect()] == [0, 0, 1, 2]


def test_pairs(spark):
    s = span_rows(spark, [("Name:", 0, 0, 30, 10), ("Ann", 60, 0, 80, 10), ("Qty:", 0, 20, 30, 30), ("10", 60, 20, 70, 30), ("Intro", 0, 40, 30, 50), ("5", 90, 40, 95, 50),
                          ("City: Rome", 0, 60, 60, 70), ("name", 0, 80, 30, 90), ("Bob", 60, 80, 80, 90), ("close", 0, 100, 30, 110), ("by", 35, 100, 50, 110), ("7: x", 0, 120, 20, 130)])
    assert [(r.label, r.value) for r in rows.key_values(s).orderBy("pair_no").collect()] == [("Name", "Ann"), ("City", "Rome")]
    assert rows.all_pairs(s).where("toc").count() == 2


def test_table(spark):
    grid = [(t, x + (r % 3), 20 * r, x + 20, 20 * r + 10) for r, line in enumerate((["Item", "Qty", "Price"], ["a", "1", "2"], ["b", "3", "4"])) for t, x in zip(line, (0, 120, 240))]
    got = rows.table_columns(span_rows(spark, grid)).orderBy("col_no").collect()
    assert [(r.header, r.x0, r.x1) for r in got] == [("Item", 0.0, 20.0), ("Qty", 120.0, 140.0), ("Price", 240.0, 260.0)]
    assert rows.table_columns(span_rows(spark, grid[:6])).count() == 0
    assert rows.table_columns(span_rows(spark, [(str(i), *c[1:]) for i, c in enumerate(grid)])).count() == 0


def test_two_page_statement(spark):
    cells = [("Date", 28, 500, 65, 512), ("Balance", 538, 500, 566, 512), ("Amount", 340, 500, 372, 512)]
    for y, day, amount in ((480, "26-Jun-2025", "1"), (470, "24-Jul-2025", "2"), (1480, "01-Jan-2026", "3")):
        cells += [(day, 28, y, 80, y + 8), (amount, 340, y, 360, y + 8)]
    s = span_rows(spark, cells)
    got = extract.table_cells(s, [("Date", "date"), ("Amount", "amount"), ("Units", "units")]).where("key = 'date'").orderBy("row_no").collect()
    assert [r.value for r in got] == ["26-Jun-2025", "24-Jul-2025", "01-Jan-2026"]
    assert {r.value for r in extract.table_cells(s, [("Units", "units")]).collect()} == {"Unknown"}


def test_validation(spark):
    schema = '{"a":"string","t":{"type":"array","columns":{"K":"k"}}}'
    df = spark.createDataFrame([(1, {"a": "Unknown"}, {"t": []}), (2, {"a": "x"}, {"t": [{"k": "v"}]}), (3, {"b": "x"}, {"t": [{"z": "v"}]}), (4, {"a": "x"}, {})], "doc_id long, fields map<string,string>, arrays map<string,array<map<string,string>>>")
    got = {r.doc_id: (r.matches, r.is_empty) for r in extract.validation(df, schema).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, False), 4: (False, False)}


def test_union_and_empty(spark):
    f = spark.createDataFrame([(1, "x", "1"), (2, "y", "2")], "doc_id long, field string, value string")
    assert extract.union_table(f).columns == ["doc_id", "x", "y"] and extract.union_table(f).count() == 2
    none = span_rows(spark, [("a", 0, 0, 1, 1)]).limit(0)
    for df in (S.graph(none), S.grid_lines(none), rows.key_values(none), rows.table_columns(none), rows.transaction_rows(none), extract.records(none, "{}")):
        assert df.count() == 0


def test_scores(spark):
    found = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "doc_id long, field string")
    want = spark.createDataFrame([(1, "a"), (1, "c"), (3, "q")], "doc_id long, field string")
    got = {r.doc_id: round(r.f1, 3) for r in runs.field_scores(found, want).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 0.0}


def test_inclusive_edges_and_ties(spark):
    s = span_rows(spark, [("a", 0, 0, 10, 10), ("b", 10, -5, 20, 15), ("c", 10, -5, 20, 15), ("d", 10, -6, 20, 15)])
    assert [r.neighbour_idx for r in S.neighbours(s).where("span_idx = 0 AND direction = 'right'").collect()] == [1]
    assert S.hit_test(spark.createDataFrame([(1, 1, 10.0, 0.0), (2, 1, 99.0, 0.0)], "point_id int, doc_id int, x double, y double"), s).collect() == [(1, 0)]


def test_names(spark):
    rows_ = spark.createDataFrame([("unit_priceUSD",), ("a-b",)], "n string").select(display.pretty_name(F.col("n")).alias("v")).collect()
    assert [r.v for r in rows_] == ["Unit Price USD", "A B"]
