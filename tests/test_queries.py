"""Every query of the core against its SQL on the smallest tables."""

import pytest

import compare
from folioscope.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows_as_sql(spark, sf, con, name):
    assert compare.compare(spark, catalogue.QUERIES[name], catalogue.ORACLE[name], sf, con) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs_with_unique_columns(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "extract_invoice" in e.queries()


def test_records_union_holds_all_fields_and_records(spark):
    from folioscope.operators import extract

    rows = [(1, '{"a":1,"b":{"c":[2]}}'), (1, '{"a":1,"b":{"c":[2]}}'), (2, '{"d":"x"}'), (3, "{}"), (4, '{"e":null}'), (5, '{"cut'), (6, None)]
    got = extract.union_records(spark.createDataFrame(rows, "doc_id long, fields_json string"))
    assert got.columns == ["doc_id", "a", "b", "d", "e"]
    assert sorted(map(tuple, got.collect())) == [(1, "1", '{"c":[2]}', None, None), (2, None, None, "x", None), (3, None, None, None, None), (4, None, None, None, None)]


def test_layout_notes_have_all_sections(spark, sf):
    notes = [r.notes for r in catalogue.QUERIES["layout_notes"](spark, sf).collect()]
    for title in ("key_value_pairs:", "transaction_columns:", "table_columns:"):
        assert any(n.startswith(title) or f"\n\n{title}" in n for n in notes)


@pytest.mark.parametrize("name", ["toc_entries", "cached_documents", "uncached_documents", "pdf_spans", "routed_fields", "p4_rebuilt"])
def test_has_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).limit(1).count() == 1


def test_routes_of_known_and_new_layouts(spark, sf):
    rows = catalogue.QUERIES["routed_fields"](spark, sf).collect()
    assert {r.was_cached for r in rows} == {True, False} and {r.confidence for r in rows} >= {"exact", "fuzzy"}


def test_pages_of_files(spark, sf):
    kinds = {r.pdf_type for r in catalogue.QUERIES["pdf_pages"](spark, sf).collect()}
    assert "text" in kinds


def test_records_over_the_size_limit_are_dead_letters(spark):
    from folioscope.operators import extract

    df = spark.createDataFrame([(1, "x" * 20), (2, "y" * 21), (3, None)], "doc_id long, j string")
    good, bad = extract.within(df, "j", 20)
    assert sorted(r.doc_id for r in good.collect()) == [1, 3]
    assert [(r.doc_id, r.error) for r in bad.collect()] == [(2, "result of 21 bytes is over 20")]
