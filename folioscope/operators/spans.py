"""The span table and the spatial graph over it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import nearest
from folioscope.operators.nearest import DIRECTIONS, TOLERANCE
from folioscope.session import broadcast_if_small, materialize

#: Heights and widths of the bands that spans of very long documents are joined by.
BAND_Y, BAND_X = 64.0, 256.0
#: Spans of a document up to which one task compares them (coordinates and texts in memory).
SPANS_A_TASK = 200_000
BROADCAST_DOCS = 200_000
_PLACE = ("span_idx", "x0", "y0", "x1", "y1")
_INPUT = ("doc_id", *_PLACE, "wanted")
COLUMNS = ("doc_id", "span_idx", "text", "x0", "y0", "x1", "y1", "page", "font_size", "is_bold", "is_italic")


def clean_spans(spans: DataFrame) -> DataFrame:
    """Each (doc_id, span_idx) once; rows without key or coordinates are left out, missing font
    size, style and text become 0, false and ''."""
    out = spans.select(*COLUMNS).where("doc_id IS NOT NULL AND span_idx IS NOT NULL AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL")
    out = out.fillna({"text": "", "font_size": 0.0, "is_bold": False, "is_italic": False})
    return out.dropDuplicates(["doc_id", "span_idx"])


def spans_from_json(docs: DataFrame, json_col: str = "spans_json") -> DataFrame:
    """Spans of documents that come as a JSON array, with the defaults of missing fields."""
    kind = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double,page:int,font_size:double,is_bold:boolean,is_italic:boolean>>"
    s = docs.select("doc_id", F.posexplode(F.from_json(json_col, kind)).alias("span_idx", "s")).select("doc_id", "span_idx", "s.*")
    return s.fillna({"font_size": 0.0, "is_bold": False, "is_italic": False})


def truncate(spans: DataFrame, max_spans: int) -> DataFrame:
    """The first spans of each document in list order."""
    return spans.where(F.col("span_idx") < max_spans)


def _band(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("int")


def _paired(s: DataFrame, directions: tuple[str, ...]) -> DataFrame:
    """Neighbours in documents of any length, as a join by document and bands of position: (doc_id,
    span_idx, direction, neighbour_idx, distance). For documents too long for one task; hot ones are
    split by the engine."""
    a = s.where("wanted").select("doc_id", *(F.col(c).alias(f"a_{c}") for c in _PLACE))
    b = s.select("doc_id", *(F.col(c).alias(f"b_{c}") for c in _PLACE))
    dx = (F.col("b_x0") + F.col("b_x1")) / 2 - (F.col("a_x0") + F.col("a_x1")) / 2
    dy = (F.col("b_y0") + F.col("b_y1")) / 2 - (F.col("a_y0") + F.col("a_y1")) / 2
    beyond = {
        "right": F.col("b_x0") >= F.col("a_x1"), "left": F.col("b_x1") <= F.col("a_x0"),
        "top": F.col("b_y0") >= F.col("a_y1"), "bottom": F.col("b_y1") <= F.col("a_y0"),
    }

    def along(lo: str, size: float, wanted: list[str]) -> DataFrame:
        hi = lo.replace("0", "1")
        bands = F.sequence(_band(F.col(f"a_{lo}") - TOLERANCE, size), _band(F.greatest(F.col(f"a_{lo}"), F.col(f"a_{hi}")) + TOLERANCE, size))
        left = a.withColumn("band", F.explode(bands))
        right = b.withColumn("band", _band(F.col(f"b_{lo}"), size))
        inside = (F.col(f"b_{lo}") >= F.col(f"a_{lo}") - TOLERANCE) & (F.col(f"b_{hi}") <= F.col(f"a_{hi}") + TOLERANCE)
        reached = reduce(lambda p, q: p | q, [beyond[d] for d in wanted])
        pairs = left.join(right, ["doc_id", "band"]).where(inside & reached & (F.col("a_span_idx") != F.col("b_span_idx")))
        # the nearest of each direction as a conditional minimum: no row per pair and direction
        c = F.named_struct(F.lit("d2"), dx * dx + dy * dy, F.lit("i"), F.col("b_span_idx"))
        best = pairs.groupBy("doc_id", F.col("a_span_idx").alias("span_idx")).agg(*(F.min(F.when(beyond[d], c)).alias(d) for d in wanted))
        listed = F.explode(F.array(*(F.named_struct(F.lit("direction"), F.lit(d), F.lit("c"), F.col(d)) for d in wanted)))
        return best.select("doc_id", "span_idx", listed.alias("n")).where("n.c IS NOT NULL")

    across, upright = [d for d in directions if d in ("right", "left")], [d for d in directions if d in ("top", "bottom")]
    parts = ([along("y0", BAND_Y, across)] if across else []) + ([along("x0", BAND_X, upright)] if upright else [])
    out = reduce(DataFrame.unionByName, parts)
    return out.select("doc_id", "span_idx", "n.direction", F.col("n.c.i").alias("neighbour_idx"), F.sqrt("n.c.d2").alias("distance"))


def _wide_reader(directions: tuple[str, ...], texts: bool):
    """Every span's rest columns and, per direction, the neighbour's index (and text) and distance."""
    rest = 7 + texts

    def give(t: pa.Table, best: dict, dist: dict) -> Iterator[pa.RecordBatch]:
        columns, names = [t.column(c) for c in (0, 1, *range(rest, t.num_columns))], [t.column_names[c] for c in (0, 1, *range(rest, t.num_columns))]
        for d in directions:
            at = pa.array(best[d], mask=best[d] < 0)
            columns.append(t.column(1).take(at))
            names.append(f"{d}_idx")
            if texts:
                columns.append(t.column(7).take(at))
                names.append(d)
            else:
                columns.append(pa.array(dist[d], mask=best[d] < 0))
                names.append(f"{d}_distance")
        yield from pa.table(columns, names=names).combine_chunks().to_batches(max_chunksize=50_000)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return nearest.with_nearest(batches, directions, give)

    return read


def _nearest(spans: DataFrame, directions: tuple[str, ...], texts: bool, keep: list[str]) -> DataFrame:
    """(doc_id, span_idx, keep..., and per direction D: D_idx, and D, the neighbour's text, or D_distance)
    of spans(doc_id, span_idx, x0, y0, x1, y1, wanted, text, keep...)."""
    kinds = dict(spans.dtypes)
    s = materialize(spans.select(*_INPUT, *(["text"] if texts else []), *(F.col(c).alias(f"k_{c}") for c in keep)), "spans")
    long_ = s.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > SPANS_A_TASK).select("doc_id")
    n_long = long_.count()
    if n_long:
        long_ = broadcast_if_small(materialize(long_, "long-documents"), BROADCAST_DOCS, n_long)
    short = s.join(long_, "doc_id", "left_anti") if n_long else s
    columns = [f"doc_id {kinds['doc_id']}, span_idx {kinds['span_idx']}", *(f"`k_{c}` {kinds[c]}" for c in keep)]
    columns += [f"{d}_idx {kinds['span_idx']}, {d} string" if texts else f"{d}_idx {kinds['span_idx']}, {d}_distance double" for d in directions]
    out = short.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_wide_reader(directions, texts), ", ".join(columns))
    if n_long:
        rows = s.join(long_, "doc_id", "left_semi")
        edges = _paired(rows, directions).groupBy("doc_id", "span_idx").agg(
            *(F.max(F.when(F.col("direction") == d, F.struct("neighbour_idx", "distance"))).alias(f"_{d}") for d in directions)
        )
        far = rows.join(edges, ["doc_id", "span_idx"], "left")
        for d in directions:
            far = far.withColumn(f"{d}_idx", F.col(f"_{d}.neighbour_idx")).withColumn(f"{d}_distance", F.col(f"_{d}.distance"))
            if texts:
                named = rows.select("doc_id", F.col("span_idx").alias(f"{d}_idx"), F.col("text").alias(d))
                far = far.join(named, ["doc_id", f"{d}_idx"], "left")
        out = out.unionByName(far.select(*out.columns))
    return out.withColumnsRenamed({f"k_{c}": c for c in keep})


def neighbours(spans: DataFrame, directions: tuple[str, ...] = DIRECTIONS) -> DataFrame:
    """(doc_id, span_idx, direction, neighbour_idx, distance): the nearest span fully inside the
    corridor of each direction; ties go to the lowest span_idx."""
    wide = _nearest(spans.withColumn("wanted", F.lit(True)), directions, False, [])
    edge = lambda d: F.struct(F.lit(d).alias("direction"), F.col(f"{d}_idx").alias("i"), F.col(f"{d}_distance").alias("distance"))
    out = wide.select("doc_id", "span_idx", F.explode(F.array(*(edge(d) for d in directions))).alias("n")).where("n.i IS NOT NULL")
    return out.select("doc_id", "span_idx", "n.direction", F.col("n.i").alias("neighbour_idx"), "n.distance")


def beside_texts(spans: DataFrame, wanted: Column, directions: tuple[str, ...], keep: list[str]) -> DataFrame:
    """(doc_id, span_idx, keep..., and per direction D: D_idx and D, the neighbour's text) of all spans;
    neighbours are looked up for the ``wanted`` ones only, among all."""
    return _nearest(spans.withColumn("wanted", F.coalesce(wanted, F.lit(False))), directions, True, keep)


def graph(spans: DataFrame) -> DataFrame:
    """Spans with the text of their neighbours: right, left, top, bottom (null: none)."""
    keep = [c for c in spans.columns if c not in ("doc_id", "span_idx")]
    wide = beside_texts(spans, F.lit(True), DIRECTIONS, keep)
    return wide.select(*spans.columns, *DIRECTIONS)


def flat_graph(nodes: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): text|top|bottom|left|right|x0|y0|x1|y1 of each node."""
    parts = [F.coalesce(T.without_breaks(F.col(c)), F.lit("None")) for c in ("text", "top", "bottom", "left", "right")]
    return nodes.select(
        "doc_id", F.col("span_idx").alias("line_no"), F.concat_ws("|", *parts, *(F.col(c).cast("string") for c in ("x0", "y0", "x1", "y1"))).alias("line")
    )


def flat_graph_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, flat_graph): one text per document."""
    lines = flat_graph(nodes).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return lines.select("doc_id", F.array_join("l.line", "\n").alias("flat_graph"))


def parse_flat_graph(texts: DataFrame) -> DataFrame:
    """Lines of texts(doc_id, flat_graph) with at least five parts: (doc_id, span_idx, text, top,
    bottom, left, right, x0, y0, x1, y1). 'None' becomes null, missing coordinates 0."""
    lines = texts.select("doc_id", F.posexplode(F.split("flat_graph", "\n")).alias("span_idx", "line"))
    p = lines.withColumn("p", F.split("line", r"\|", 9)).where(F.size("p") >= 5)
    cells = [F.nullif(F.get("p", F.lit(i)), F.lit("None")).alias(c) for i, c in ((1, "top"), (2, "bottom"), (3, "left"), (4, "right"))]
    xy = [F.coalesce(T.trim(F.get("p", F.lit(i))).try_cast("double"), F.lit(0.0)).alias(c) for i, c in ((5, "x0"), (6, "y0"), (7, "x1"), (8, "y1"))]
    return p.select("doc_id", "span_idx", F.get("p", F.lit(0)).alias("text"), *cells, *xy)


def beside(nodes: DataFrame, text: str, direction: str) -> DataFrame:
    """(doc_id, value): neighbour of the first span with exactly this text; only that span counts."""
    return nodes.where(F.col("text") == text).groupBy("doc_id").agg(F.min_by(F.col(direction), "span_idx").alias("value"))


def bounds(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.min("x0").alias("min_x"), F.min("y0").alias("min_y"), F.max("x1").alias("max_x"), F.max("y1").alias("max_y"))


def page_offsets(spans: DataFrame) -> DataFrame:
    """(doc_id, page, height, y_offset): pages stacked with 50 points between those with spans."""
    pages = spans.where("page IS NOT NULL").groupBy("doc_id", "page").agg((F.greatest(F.lit(0.0), F.max("y1")) - F.min("y0")).alias("height"))
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("height") > 0, F.col("height") + 50.0).otherwise(0.0)
    return pages.withColumn("y_offset", F.coalesce(F.sum(step).over(before), F.lit(0.0)))


# ---------------------------------------------------------------- grid


def grid_lines(spans: DataFrame, x_bucket: float = 8.0, y_bucket: float = 15.0) -> DataFrame:
    """(doc_id, row_no, line): the text grid of each document, one sign a cell, later spans over
    earlier ones, cut at the right edge; blanks at the right and empty rows are dropped."""
    b = bounds(spans)
    s = spans.join(b, "doc_id").withColumn("cols", (F.ceil((F.col("max_x") - F.col("min_x")) / x_bucket) + 1).cast("int"))
    s = s.withColumn("row_no", F.floor((F.col("max_y") - F.col("y1")) / y_bucket).cast("int")).withColumn(
        "col0", F.floor((F.col("x0") - F.col("min_x")) / x_bucket).cast("int")
    )
    # each row's spans are laid over one another in their order, so no sign has a row of its own
    rows = s.where("text != ''").groupBy("doc_id", "row_no", "cols").agg(F.array_sort(F.collect_list(F.struct("span_idx", "col0", "text"))).alias("laid"))

    def lay(line: Column, span: Column) -> Column:
        wide = F.rpad(line, F.greatest(F.char_length(line), span["col0"]), " ")
        return F.overlay(wide, span["text"], span["col0"] + 1, F.char_length(span["text"]))

    line = F.substring(F.aggregate("laid", F.lit(""), lay), F.lit(1), F.col("cols"))
    out = rows.select("doc_id", "row_no", F.rtrim(line, F.lit(T.WHITE)).alias("line"))
    return out.where("line != ''")


def compact_grid(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", T.compact_line(F.col("line"))).where("line != ''")


def markdown_rows(lines: DataFrame) -> DataFrame:
    """Grid lines as rows of a Markdown table, one cell a sign."""
    cells = F.transform(F.split("line", ""), lambda c: F.when(c == "|", "\\|").otherwise(c))
    kept = F.filter(cells, lambda c: c != "")
    return lines.select("doc_id", "row_no", F.concat(F.lit("| "), F.array_join(kept, " | "), F.lit(" |")).alias("line"))


def hit_test(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(point_id, span_idx): the first span of the document that holds a point(point_id, doc_id, x, y);
    edges count. Points and spans meet by document and height band."""
    band = lambda c: _band(c, BAND_Y)
    s = spans.select("doc_id", "span_idx", "x0", "x1", "y0", "y1", F.explode(F.sequence(band(F.least("y0", "y1")), band(F.greatest("y0", "y1")))).alias("band"))
    p = points.withColumn("band", band(F.col("y")))
    hits = p.join(s, ["doc_id", "band"]).where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    return hits.groupBy("point_id").agg(F.min("span_idx").alias("span_idx"))
