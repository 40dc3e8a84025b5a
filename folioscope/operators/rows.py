"""Visual rows, key-value pairs and table columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.session import materialize

ROW_TOLERANCE = 4.0
GAP = 10.0
BOUNDARY = 6


def greedy_groups(points: DataFrame, tolerance: float) -> DataFrame:
    """(doc_id, span_idx, row_no) of points(doc_id, span_idx, sort_key, at): in order of sort_key and
    span_idx, a point joins the open row when it lies within ``tolerance`` of the row's FIRST point.

    A fold over sorted partitions: one pass, a few numbers of state, so the length of a document
    doesn't matter."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, first, row = None, 0.0, 0
        for b in batches:
            rows = []
            for d, at in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if d != doc:
                    doc, first, row = d, at, 0
                elif abs(at - first) > tolerance:
                    first, row = at, row + 1
                rows.append(row)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.int32())], names=["doc_id", "span_idx", "row_no"])

    ordered = points.repartition("doc_id").sortWithinPartitions("doc_id", "sort_key", "span_idx")
    return ordered.select(F.col("doc_id").cast("long"), F.col("span_idx").cast("int"), "at").mapInArrow(fold, "doc_id long, span_idx int, row_no int")


def visual_rows(spans: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    points = spans.select("doc_id", "span_idx", F.col("y0").alias("sort_key"), ((F.col("y0") + F.col("y1")) / 2).alias("at"))
    return greedy_groups(points, tolerance)


def rows_below(spans: DataFrame, above_y: float, tolerance: float) -> DataFrame:
    """Rows of the spans that start above a height, by their lower edge."""
    points = spans.where(F.col("y0") > above_y).select("doc_id", "span_idx", F.col("y0").alias("sort_key"), F.col("y0").alias("at"))
    return greedy_groups(points, tolerance)


def _in_rows(spans: DataFrame) -> DataFrame:
    return spans.join(visual_rows(spans), ["doc_id", "span_idx"])


def key_values(spans: DataFrame) -> DataFrame:
    """(doc_id, pair_no, label, value): pairs split at a row's widest gap of at least ten points, or
    at the colon of a lone span; page numbers of tables of contents are left out; the first of
    equal labels (in any case) stays. pair_no follows ascending y."""
    pairs = all_pairs(spans).where("NOT toc")
    first = Window.partitionBy("doc_id", F.lower("label")).orderBy("row_no")
    kept = pairs.withColumn("k", F.row_number().over(first)).where("k = 1")
    return kept.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("row_no")).alias("pair_no"), "label", "value")


def all_pairs(spans: DataFrame) -> DataFrame:
    """(doc_id, row_no, label, value, toc) of all rows that split, repeated labels included."""
    r = _in_rows(spans)
    row = Window.partitionBy("doc_id", "row_no")
    # equal x0 keep the order of the row, which is by y0 and span_idx
    x = row.orderBy("x0", "y0", "span_idx")
    r = r.withColumn("n", F.count("*").over(row)).withColumn("gap", F.lead("x0").over(x) - F.col("x1")).withColumn("pos", F.row_number().over(x))
    t = F.col("text")
    label, value = T.colon_label(t), T.colon_value(t)
    lone = r.where("n = 1").select("doc_id", "row_no", label.alias("label"), value.alias("value"), F.lit(False).alias("toc")).where(
        F.coalesce(T.is_label(F.col("label")) & (F.col("value") != ""), F.lit(False))
    )
    grouped = r.where("n > 1").groupBy("doc_id", "row_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", T.trim("text").alias("t")))).alias("cells"),
        F.max_by(F.struct("pos", "gap"), F.struct("gap", -F.col("pos"))).alias("cut"),
    )
    joined = lambda test: F.array_join(F.filter(F.transform(F.filter("cells", test), lambda c: c["t"]), lambda s: s != ""), " ")
    wide = grouped.where(F.col("cut.gap") >= GAP).select(
        "doc_id", "row_no", T.trim(F.regexp_replace(joined(lambda c: c["pos"] <= F.col("cut.pos")), ":+$", "")).alias("label"),
        joined(lambda c: c["pos"] > F.col("cut.pos")).alias("value"),
    )
    return lone.unionByName(wide.withColumn("toc", T.is_toc_entry(F.col("label"), F.col("value"))))


def row_boundaries(spans: DataFrame) -> DataFrame:
    """(doc_id, row_no, boundaries, cells) of rows with at least two groups of spans that gaps of ten
    points part; boundaries are the rounded left edges, cells the spans by x."""
    r = _in_rows(spans)
    x = Window.partitionBy("doc_id", "row_no").orderBy("x0", "y0", "span_idx")
    r = r.withColumn("starts", F.coalesce((F.col("x0") - F.lag("x1").over(x)) >= GAP, F.lit(True))).withColumn("pos", F.row_number().over(x))
    g = r.groupBy("doc_id", "row_no").agg(
        F.array_sort(F.collect_list(F.when(F.col("starts"), F.struct("pos", F.greatest(F.lit(0), F.floor(F.col("x0") + 0.5).cast("int")).alias("b"))))).alias("b"),
        F.array_sort(F.collect_list(F.struct("pos", "x0", "x1", "y0", T.trim("text").alias("t")))).alias("cells"),
    )
    return g.where(F.size("b") >= 2).select("doc_id", "row_no", F.col("b.b").alias("boundaries"), "cells")


def first_fit(boundaries: DataFrame) -> DataFrame:
    """(doc_id, row_no, cluster) of boundaries(doc_id, row_no, boundaries): rows in order join the
    first cluster whose first row has as many boundaries, each within reach. A fold over sorted
    partitions that keeps the heads of one document's clusters."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, heads = None, []
        for batch in batches:
            out = []
            for d, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if d != doc:
                    doc, heads = d, []
                k = next((i for i, h in enumerate(heads) if len(h) == len(b) and all(abs(p - q) <= BOUNDARY for p, q in zip(h, b))), len(heads))
                if k == len(heads):
                    heads.append(b)
                out.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=["doc_id", "row_no", "cluster"])

    ordered = boundaries.repartition("doc_id").sortWithinPartitions("doc_id", "row_no")
    return ordered.select(F.col("doc_id").cast("long"), F.col("row_no").cast("int"), "boundaries").mapInArrow(fold, "doc_id long, row_no int, cluster int")


def table_columns(spans: DataFrame) -> DataFrame:
    """(doc_id, col_no, header, x0, x1) of the largest cluster of at least three aligned rows (the
    first of equals); its lowest row has the headers, which need a letter among them."""
    c = materialize(row_boundaries(spans), "row-boundaries")
    many = c.withColumn("k", F.count("*").over(Window.partitionBy("doc_id"))).where("k >= 3")
    clusters = first_fit(many.select("doc_id", "row_no", "boundaries"))
    sizes = clusters.groupBy("doc_id", "cluster").agg(F.count("*").alias("n"), F.min("row_no").alias("head"))
    best = sizes.where("n >= 3").groupBy("doc_id").agg(F.max_by(F.struct("cluster", "head"), F.struct("n", -F.col("cluster"))).alias("b"))
    rows = c.join(clusters, ["doc_id", "row_no"]).join(best, "doc_id").where("cluster = b.cluster")
    cells = rows.select("doc_id", "row_no", "b.head", F.posexplode("cells").alias("col_no", "c"))
    # header cells follow their height; equal heights keep the order by x
    heads = cells.where("row_no = head").withColumn("col_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("c.y0", "c.pos")) - 1)
    heads = heads.select("doc_id", "col_no", F.col("c.t").alias("header"), F.count_if(T.has_letter(F.col("c.t"))).over(Window.partitionBy("doc_id")).alias("lettered"))
    extents = cells.groupBy("doc_id", "col_no").agg(F.min("c.x0").alias("x0"), F.max("c.x1").alias("x1"))
    out = heads.where("lettered > 0").join(extents, ["doc_id", "col_no"])
    return out.select("doc_id", "col_no", "header", "x0", "x1")


# ---------------------------------------------------------------- transactions


def transaction_columns(spans: DataFrame) -> DataFrame:
    """(doc_id, label, key, col_no): headers of a list of transactions, found within 40 points above
    the topmost of at least three aligned date cells; the date and two more known headers are needed."""
    dates = spans.where(T.is_table_date(F.col("text")))
    first = dates.groupBy("doc_id").agg(F.min_by("x0", "span_idx").alias("first_x"), F.count("*").alias("n")).where("n >= 3")
    top = dates.join(first, "doc_id").where(F.abs(F.col("x0") - F.col("first_x")) < 20).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("y0").alias("top")).where("n >= 3")
    near = spans.join(top, "doc_id").where((F.col("y0") > F.col("top")) & (F.col("y0") <= F.col("top") + 40) & (F.col("x0") >= 20))
    near = near.select("doc_id", "y0", "span_idx", T.trim("text").alias("label")).where("label != ''").withColumn("key", T.header_key(F.col("label")))
    known = near.where(F.col("key").isin(*T.TRANSACTION_KEYS)).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("y0", "span_idx"))).where("k = 1")
    whole = Window.partitionBy("doc_id")
    known = known.withColumn("n", F.count("*").over(whole)).withColumn("dated", F.max((F.col("key") == "date").cast("int")).over(whole)).where("n >= 3 AND dated = 1")
    return known.select("doc_id", "label", "key", F.row_number().over(whole.orderBy("y0", "span_idx")).alias("col_no"))


def transaction_rows(spans: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(doc_id, row_no, span_idx): lines in the band of each date cell, rows in reading order (pages
    up, top first within a page; a jump of more than 100 points starts a page)."""
    dates = spans.where(T.is_table_date(T.trim("text"))).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("span_idx", "y0"))).alias("d"))
    keep = F.aggregate("d", F.array().cast("array<double>"), lambda acc, x: F.when(F.exists(acc, lambda b: F.abs(b - x["y0"]) <= tolerance), acc).otherwise(F.concat(acc, F.array(x["y0"]))))
    bands = dates.select("doc_id", F.posexplode(keep).alias("band_no", "band_y"))
    grid = lambda c: F.floor(c / (2 * tolerance)).cast("int")
    b = bands.withColumn("cell", F.explode(F.sequence(grid(F.col("band_y") - tolerance), grid(F.col("band_y") + tolerance))))
    s = spans.select("doc_id", "span_idx", "y0").withColumn("cell", grid(F.col("y0")))
    claimed = s.join(b, ["doc_id", "cell"]).where(F.abs(F.col("y0") - F.col("band_y")) <= tolerance)
    heads = claimed.groupBy("doc_id", "band_no").agg(F.min_by("y0", "span_idx").alias("head_y"))
    up = Window.partitionBy("doc_id").orderBy("head_y", "band_no")
    heads = heads.withColumn("jump", F.coalesce((F.abs(F.col("head_y") - F.lag("head_y").over(up)) > 100).cast("int"), F.lit(0)))
    heads = heads.withColumn("sheet", F.sum("jump").over(up)).withColumn("rise", F.row_number().over(up))
    heads = heads.withColumn("row_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("sheet", F.desc("rise"))))
    return claimed.join(heads.select("doc_id", "band_no", "row_no"), ["doc_id", "band_no"]).select("doc_id", "row_no", "span_idx")
