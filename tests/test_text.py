"""Literal expectations of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import layout, quality


def values(spark, texts, rule):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", rule(F.col("t")).alias("v")).orderBy("i").collect()]


def test_field_types(spark):
    samples = {
        "2026-05-23": "date", "01/15/2026": "date", "$500.50": "number", "$1,000.50": "number", "42": "number", "99.9%": "number", "Acme Corp": "string", "": "string",
        "2019-01-01": "string", "1/2/2019": "number", "12:30": "number", "+919045473158": "number", "2026-13-01": "string", "x" * 101: "string", "$": "string",
    }
    got = dict(zip(samples, values(spark, list(samples), T.field_type)))
    assert got == samples


def test_anchors(spark):
    texts = ["Invoice Number:", "INVOICE", "Total", "Acme Corp", "INV-2026-001", "", "  ", "bill to someone", "Subtotal"]
    assert values(spark, texts, layout.is_anchor) == [True, True, True, False, False, False, False, True, False]
    more = lambda c: layout.is_anchor(c, keywords=("vendor", "po"), patterns=("^X-", "(["))
    assert values(spark, ["Vendor Name", "PO 12", "totality", "X-9a"], more) == [True, True, False, True]


def test_toc_and_dates(spark):
    pairs = [("Introduction", "5"), ("Chapter 2", "12"), ("Total:", "500"), ("Date", "2026-05-23")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    assert [r.v for r in rows.select("i", T.is_toc_entry(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()] == [True, True, False, False]
    assert values(spark, ["26-Jun-2025", "1-Jan-2025", "2026-05-23", "Total", ""], T.is_table_date) == [True, True, False, False, False]


def test_compact_line(spark):
    texts = ["Chapter 1 ........ 5", "3.14 is pi.txt", "a··b", "a .. b", "___"]
    assert values(spark, texts, T.compact_line) == ["Chapter 1  5", "3.14 is pi.txt", "a b", "a .. b", ""]


def test_names_and_keys(spark):
    assert values(spark, ["invoice_number", "PO box_no", ""], T.display_label) == ["Invoice Number", "PO Box No", ""]
    assert values(spark, ["Invoice  Number!", " Bill-To ", "№ 5"], T.snake_name) == ["invoice_number", "billto", "5"]
    assert values(spark, ["Closing  Balance", "Unit-Price", "Paid In"], T.header_key) == ["balance", "unit_price", "deposit"]
    assert values(spark, ["a" * 64, "a" * 63, "g" * 64, None], T.is_layout_id) == [True, False, False, None]
    assert values(spark, ["a/b", "a/../b", "", ".."], T.is_safe_path) == [True, False, False, False]


def test_issues(spark):
    texts = ["A real sentence about invoices.", "ab�� cd", "$".join(["pay"] * 14), "\ue000\ue001\ue002x", "ab\x82\x93cd", "~^" * 40, "", None]
    assert values(spark, texts, T.span_issue) == [None, "replacement", "strong", "strong", "strong", "strong", None, None]


def test_errors_and_costs(spark):
    assert values(spark, ["HTTP 401", "Too many requests", "timed out", "expected value at line 1", "boom"], T.error_kind) == ["auth", "rate_limit", "timeout", "parse_error", "other"]
    assert values(spark, ["abcdefgh", "漢字漢字", "", None], T.token_estimate) == [2, 2, 0, None]
    rows = spark.range(1, 9).select(F.col("id").alias("i"), T.retry_backoff_ms(F.col("id").cast("int")).alias("v")).orderBy("i").collect()
    assert [r.v for r in rows] == [500, 1000, 2000, 4000, 8000, 8000, 8000, 8000]


@pytest.mark.parametrize("total,n,pages", [(100, 4, [1, 33, 65, 100]), (5, 8, [1, 2, 3, 4, 5]), (9, 1, [1]), (9, 0, []), (1, 8, [1]), (9, 2, [1, 9])])
def test_page_sampling(spark, total, n, pages):
    assert spark.range(1).select(quality.sample_pages(F.lit(total), n).alias("p")).first().p == pages
