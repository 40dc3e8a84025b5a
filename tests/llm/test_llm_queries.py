import pytest

import compare
from folioscope.llm import queries


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, sf, con, name):
    assert compare.compare(spark, queries.QUERIES[name], queries.ORACLE[name], sf, con) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns) and rows


def test_p6_texts_of_spans_and_anchors(spark, sf):
    df = queries.p6_texts(spark, sf)
    for src, name, pos in (("span", "spans", "span_idx"), ("anchor", "anchors", "anchor_no")):
        keys = spark.read.parquet(f"{sf}/{name}.parquet").select("doc_id", pos, "text").distinct()
        assert df.where(f"src = '{src}'").count() == keys.count() > 0
    assert df.where("text != canonical").count() > 0 and df.where("text IS NOT NULL AND canonical IS NULL").count() == 0


@pytest.mark.parametrize("name,columns", [("p1_found", ["src", "doc_id", "pos"]), ("p6_found", ["src", "doc_id", "pos"]), ("p7_found", ["doc_id", "item_id"]), ("p9_found", ["doc_id"])])
def test_result_columns(spark, sf, name, columns):
    df = queries.QUERIES[name](spark, sf)
    assert df.columns == columns and df.count() == df.distinct().count()
