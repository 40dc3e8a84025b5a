"""Queries of the span, layout, quality, row, schema, extraction and run operators, each with the SQL
that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import layout, quality
from folioscope.operators import spans as S
from folioscope.session import materialize, table
from folioscope.sources import pdf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return S.clean_spans(table(spark, d, "spans"))


# ---------------------------------------------------------------- pieces of SQL

WS = T.WHITE


def q_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+\\z', '', 'g')"


BASE = """s AS (SELECT DISTINCT doc_id, span_idx, coalesce(text, '') AS text, x0, y0, x1, y1, page,
  coalesce(font_size, 0.0) AS font_size, coalesce(is_bold, false) AS is_bold FROM spans
  WHERE doc_id IS NOT NULL AND span_idx IS NOT NULL AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL)"""
_PAIR = """(pow((b.x0 + b.x1) / 2 - (a.x0 + a.x1) / 2, 2) + pow((b.y0 + b.y1) / 2 - (a.y0 + a.y1) / 2, 2))"""
_ACROSS = "b.y0 >= a.y0 - 5 AND b.y1 <= a.y1 + 5"
_UPRIGHT = "b.x0 >= a.x0 - 5 AND b.x1 <= a.x1 + 5"


def _nearest(direction: str, where: str) -> str:
    return f"""SELECT a.doc_id, a.span_idx, '{direction}' AS direction, arg_min(b.span_idx, ({_PAIR}, b.span_idx)) AS neighbour_idx, sqrt(min({_PAIR})) AS distance
    FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.span_idx <> b.span_idx AND {where} GROUP BY ALL"""


NEAREST = {
    "right": _nearest("right", f"b.x0 >= a.x1 AND {_ACROSS}"),
    "left": _nearest("left", f"b.x1 <= a.x0 AND {_ACROSS}"),
    "top": _nearest("top", f"b.y0 >= a.y1 AND {_UPRIGHT}"),
    "bottom": _nearest("bottom", f"b.y1 <= a.y0 AND {_UPRIGHT}"),
}
GRAPH = f"""{BASE}, e AS ({' UNION ALL '.join(NEAREST.values())}),
  w AS (SELECT e.doc_id, e.span_idx, {', '.join(f"max(t.text) FILTER (direction = '{d}') AS {d}_t" for d in NEAREST)}
    FROM e JOIN s t ON t.doc_id = e.doc_id AND t.span_idx = e.neighbour_idx GROUP BY ALL),
  g AS (SELECT s.*, right_t, left_t, top_t, bottom_t FROM s LEFT JOIN w USING (doc_id, span_idx))"""


# ---------------------------------------------------------------- graph


def _direction(name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return S.neighbours(_spans(spark, d)).where(F.col("direction") == name).drop("direction")

    run.__name__ = f"nearest_{name}"
    query(f"WITH {BASE} SELECT doc_id, span_idx, neighbour_idx, distance FROM ({NEAREST[name]})")(run)


for _d in S.DIRECTIONS:
    _direction(_d)


@query(f"WITH {GRAPH} SELECT doc_id, span_idx, right_t AS \"right\", left_t AS \"left\", top_t AS top, bottom_t AS bottom FROM g")
def spatial_graph(spark: SparkSession, d: str) -> DataFrame:
    return S.graph(_spans(spark, d)).select("doc_id", "span_idx", *S.DIRECTIONS)


_LINE = "concat_ws('|', " + ", ".join(f"coalesce(replace(replace({c}, '|', ''), chr(10), ''), 'None')" for c in ("text", "top_t", "bottom_t", "left_t", "right_t")) + ", x0::VARCHAR, y0::VARCHAR, x1::VARCHAR, y1::VARCHAR)"


@query(f"WITH {GRAPH} SELECT doc_id, string_agg({_LINE}, chr(10) ORDER BY span_idx) AS flat_graph FROM g GROUP BY doc_id")
def flat_graph(spark: SparkSession, d: str) -> DataFrame:
    return S.flat_graph_text(S.graph(_spans(spark, d)))


@query(
    f"""WITH {GRAPH}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY span_idx) - 1 AS pos FROM g)
    SELECT doc_id, pos::INT AS span_idx, replace(replace(text, '|', ''), chr(10), '') AS text, nullif(replace(replace(right_t, '|', ''), chr(10), ''), 'None') AS "right",
      nullif(replace(replace(bottom_t, '|', ''), chr(10), ''), 'None') AS bottom, x0, y1 FROM n"""
)
def flat_graph_round_trip(spark: SparkSession, d: str) -> DataFrame:
    back = S.parse_flat_graph(S.flat_graph_text(S.graph(_spans(spark, d))))
    return back.select("doc_id", "span_idx", "text", "right", "bottom", "x0", "y1")


@query(
    """WITH m AS (SELECT DISTINCT manifest_id, flat_graph FROM layout_manifests WHERE flat_graph IS NOT NULL),
    l AS (SELECT manifest_id, unnest(string_split(flat_graph, chr(10))) AS line, generate_subscripts(string_split(flat_graph, chr(10)), 1) - 1 AS pos FROM m),
    p AS (SELECT manifest_id, pos, string_split(line, '|') AS c FROM l)
    SELECT manifest_id AS doc_id, pos::INT AS span_idx, c[1] AS text, nullif(c[2], 'None') AS top, nullif(c[3], 'None') AS bottom, nullif(c[4], 'None') AS "left", nullif(c[5], 'None') AS "right"
    FROM p WHERE len(c) >= 5"""
)
def manifest_graphs(spark: SparkSession, d: str) -> DataFrame:
    """The flat graphs stored with manifests, read back (the replay of a stored layout)."""
    m = table(spark, d, "layout_manifests").where("flat_graph IS NOT NULL").dropDuplicates(["manifest_id"])
    return S.parse_flat_graph(m.select(F.col("manifest_id").alias("doc_id"), "flat_graph")).select("doc_id", "span_idx", "text", "top", "bottom", "left", "right")


@query(f"WITH {GRAPH} SELECT doc_id, arg_min_null(right_t, span_idx) AS value FROM g WHERE text = 'Total:' GROUP BY doc_id")
def right_of_total(spark: SparkSession, d: str) -> DataFrame:
    return S.beside(S.graph(_spans(spark, d)), "Total:", "right")


@query(f"WITH {BASE} SELECT doc_id, min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) AS max_y FROM s GROUP BY doc_id")
def bounding_box(spark: SparkSession, d: str) -> DataFrame:
    return S.bounds(_spans(spark, d))


@query(
    f"""WITH {BASE}, p AS (SELECT doc_id, page, greatest(0.0, max(y1)) - min(y0) AS height FROM s WHERE page IS NOT NULL GROUP BY ALL)
    SELECT doc_id, page, height, coalesce(sum(CASE WHEN height > 0 THEN height + 50 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS y_offset FROM p"""
)
def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    return S.page_offsets(_spans(spark, d))


@query(f"WITH {BASE} SELECT doc_id, count(*) AS n, max(span_idx) AS last FROM s WHERE span_idx < 12 GROUP BY doc_id")
def truncated_spans(spark: SparkSession, d: str) -> DataFrame:
    """The span cap of a document keeps its first spans in list order (here 12)."""
    return S.truncate(_spans(spark, d), 12).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("span_idx").alias("last"))


@query(f"WITH {BASE} SELECT doc_id, span_idx, text, x0, y1, page, font_size, is_bold FROM s")
def spans_from_json(spark: SparkSession, d: str) -> DataFrame:
    """Spans written to one JSON array per document and read back."""
    s = _spans(spark, d)
    packed = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("span_idx", "text", "x0", "y0", "x1", "y1", "page", "font_size", "is_bold"))).alias("a"))
    back = S.spans_from_json(packed.select("doc_id", F.to_json(F.transform("a", lambda x: x.dropFields("span_idx"))).alias("spans_json"), F.col("a.span_idx").alias("at")).drop("at"))
    order = s.select("doc_id", "span_idx", (F.row_number().over(Window.partitionBy("doc_id").orderBy("span_idx")) - 1).alias("at"))
    back = back.withColumnRenamed("span_idx", "at").join(order, ["doc_id", "at"])
    return back.select("doc_id", "span_idx", "text", "x0", "y1", "page", "font_size", "is_bold")


# ---------------------------------------------------------------- grid

_GRID = f"""{BASE}, b AS (SELECT doc_id, min(x0) AS mx, max(x1) AS xx, max(y1) AS my FROM s GROUP BY doc_id),
  c AS (SELECT doc_id, span_idx, floor((my - y1) / 15)::INT AS row_no, floor((x0 - mx) / 8)::INT AS c0, ceil((xx - mx) / 8)::INT + 1 AS cols, text FROM s JOIN b USING (doc_id) WHERE text <> ''),
  ch AS (SELECT doc_id, row_no, cols, span_idx, c0 + k AS c, k, substr(text, k + 1, 1) AS ch FROM (SELECT *, unnest(range(0, length(text)))::INT AS k FROM c)),
  cell AS (SELECT doc_id, row_no, c, arg_max(ch, (span_idx, k)) AS ch FROM ch WHERE c < cols GROUP BY ALL),
  full_row AS (SELECT doc_id, row_no, unnest(range(0, max(c) + 1))::INT AS c FROM cell GROUP BY doc_id, row_no),
  line AS (SELECT doc_id, row_no, regexp_replace(string_agg(coalesce(ch, ' '), '' ORDER BY c), '[{WS}]+\\z', '') AS line FROM full_row LEFT JOIN cell USING (doc_id, row_no, c) GROUP BY ALL)"""


@query(f"WITH {_GRID} SELECT doc_id, row_no, line FROM line WHERE line <> ''")
def ascii_grid(spark: SparkSession, d: str) -> DataFrame:
    return S.grid_lines(_spans(spark, d))


_COMPACT = f"regexp_replace(regexp_replace(line, ' ?([._·]{{3,}}|·[._·]|[._]·)', ' ', 'g'), '[{WS}]+\\z', '')"


@query(f"WITH {_GRID} SELECT doc_id, row_no, {_COMPACT} AS line FROM line WHERE line <> '' AND {_COMPACT} <> ''")
def compact_grid(spark: SparkSession, d: str) -> DataFrame:
    return S.compact_grid(S.grid_lines(_spans(spark, d)))


@query(
    f"""WITH {_GRID}, x AS (SELECT doc_id, row_no, line, unnest(range(1, length(line) + 1)) AS k FROM line WHERE line <> '')
    SELECT doc_id, row_no, '| ' || string_agg(CASE WHEN substr(line, k, 1) = '|' THEN '\\|' ELSE substr(line, k, 1) END, ' | ' ORDER BY k) || ' |' AS line FROM x GROUP BY doc_id, row_no"""
)
def markdown_grid(spark: SparkSession, d: str) -> DataFrame:
    return S.markdown_rows(S.grid_lines(_spans(spark, d)))


# ---------------------------------------------------------------- anchors and layouts

_SINGLE = "['invoice', 'total', 'date', 'amount', 'quantity', 'description']"
_ANCHORS = f"""{BASE}, t AS (SELECT *, {q_trim('text')} AS t FROM s),
  a AS (SELECT doc_id, span_idx, t AS text, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, coalesce(page, 0) AS real_page FROM t WHERE t <> '' AND (
    suffix(t, ':') OR (regexp_matches(t, '\\p{{L}}') AND NOT regexp_matches(t, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') AND NOT regexp_matches(t, '\\p{{N}}'))
    OR list_has_any(regexp_split_to_array(lower(t), '[{WS}]+'), {_SINGLE}) OR contains(lower(t), 'bill to') OR contains(lower(t), 'ship to') OR contains(lower(t), 'unit price'))),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y DESC, x, text, span_idx) AS rn FROM a),
  d AS (SELECT doc_id, rn, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY rn))"""


@query(f"WITH {_ANCHORS} SELECT doc_id, rn, text, x, y, span_idx FROM r")
def anchors(spark: SparkSession, d: str) -> DataFrame:
    return layout.anchors(_spans(spark, d)).select("doc_id", "rn", "text", "x", "y", "span_idx")


@query(f"WITH {_ANCHORS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY real_page, y DESC, x, text, span_idx) AS rn, text, real_page AS page, span_idx FROM a")
def anchors_by_page(spark: SparkSession, d: str) -> DataFrame:
    return layout.anchors(_spans(spark, d), multi_page=True).select("doc_id", "rn", "text", "page", "span_idx")


@query(f"WITH {_ANCHORS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY y DESC, x, text, span_idx) AS rn, text, span_idx FROM a WHERE real_page <= 1")
def anchors_first_page(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of first pages; spans without page count as such."""
    return layout.anchors(_spans(spark, d), first_page_only=True).select("doc_id", "rn", "text", "span_idx")


_MORE = ("rechnung", "factura", "net 30")
_PATTERNS = (r"^INV-\d", "(")


@query(
    f"""WITH {_ANCHORS.replace("contains(lower(t), 'unit price')", "contains(lower(t), 'unit price') OR list_has_any(regexp_split_to_array(lower(t), '[" + WS + "]+'), ['rechnung', 'factura']) OR contains(lower(t), 'net 30') OR regexp_matches(t, '^INV-[0-9]')")}
    SELECT doc_id, rn, text, span_idx FROM r"""
)
def anchors_custom(spark: SparkSession, d: str) -> DataFrame:
    """Anchors with more keywords and a pattern; the pattern that doesn't compile is ignored."""
    return layout.anchors(_spans(spark, d), keywords=_MORE, patterns=_PATTERNS).select("doc_id", "rn", "text", "span_idx")


@query(f"WITH {_ANCHORS} SELECT doc_id, rn, dx, dy FROM d WHERE dx IS NOT NULL")
def anchor_deltas(spark: SparkSession, d: str) -> DataFrame:
    return layout.anchor_deltas(layout.anchors(_spans(spark, d)))


_LAYOUT = f"""{_ANCHORS}, p AS (SELECT doc_id, string_agg(printf('%.2f,%.2f;', dx, dy), '' ORDER BY rn) AS print FROM d WHERE rn < 5 AND dx IS NOT NULL GROUP BY doc_id),
  w AS (SELECT doc_id, sum(strlen(text))::BIGINT AS n_bytes, count(*) AS n, arg_min(x0, span_idx) AS ax, arg_min(y0, span_idx) AS ay, arg_max(x0, span_idx) AS zx, arg_max(y0, span_idx) AS zy FROM s GROUP BY doc_id),
  ids AS (SELECT doc_id, sha256(coalesce(print, printf('fallback|%d|%d|%.2f,%.2f|%.2f,%.2f', n_bytes, n, ax, ay, zx, zy))) AS layout_id FROM w LEFT JOIN p USING (doc_id))"""


@query(f"WITH {_LAYOUT} SELECT doc_id, layout_id FROM ids")
def layout_ids(spark: SparkSession, d: str) -> DataFrame:
    return layout.layout_ids(_spans(spark, d))


@query(f"WITH {_LAYOUT} SELECT layout_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM ids GROUP BY layout_id")
def new_layouts(spark: SparkSession, d: str) -> DataFrame:
    """What a warm-up of the cache would compile: each layout once, with its first document."""
    return layout.layout_ids(_spans(spark, d)).groupBy("layout_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


#: The manifests that are in the cache when the documents come in.
_KNOWN = "created_at < '2024-07-01'"
_CURRENT = f"""cur AS (SELECT layout_id, arg_max(cache_version, manifest_no) AS v, max(manifest_no) AS manifest_no FROM layout_manifests WHERE {_KNOWN} GROUP BY layout_id),
  docs AS (SELECT DISTINCT doc_id, layout_id FROM spans)"""


@query("WITH cur AS (SELECT layout_id, arg_max(cache_version, manifest_no) AS v, max(manifest_no) AS manifest_no FROM layout_manifests GROUP BY layout_id) SELECT layout_id, manifest_no FROM cur WHERE v = 3")
def current_layouts(spark: SparkSession, d: str) -> DataFrame:
    return layout.current_layouts(table(spark, d, "layout_manifests"))


def _cached(spark: SparkSession, d: str) -> DataFrame:
    return layout.current_layouts(table(spark, d, "layout_manifests").where(_KNOWN))


def _doc_layouts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spans").select("doc_id", "layout_id").distinct()


@query(f"WITH {_CURRENT} SELECT doc_id, layout_id FROM docs WHERE EXISTS (SELECT 1 FROM cur WHERE cur.layout_id = docs.layout_id AND v = 3)")
def cached_documents(spark: SparkSession, d: str) -> DataFrame:
    return layout.cache_split(_doc_layouts(spark, d), _cached(spark, d))[0].select("doc_id", "layout_id")


@query(f"WITH {_CURRENT} SELECT doc_id, layout_id FROM docs WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.layout_id = docs.layout_id AND v = 3)")
def uncached_documents(spark: SparkSession, d: str) -> DataFrame:
    return layout.cache_split(_doc_layouts(spark, d), _cached(spark, d))[1].select("doc_id", "layout_id")


@query(
    f"""WITH {_LAYOUT}, {_CURRENT}, seen AS (SELECT ids.layout_id FROM ids JOIN docs USING (doc_id) JOIN cur ON cur.layout_id = docs.layout_id AND v = 3)
    SELECT layout_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM ids WHERE layout_id NOT IN (SELECT layout_id FROM seen) GROUP BY layout_id"""
)
def warm_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints that no document of a cached layout has, with the document each would be compiled from."""
    ids = layout.layout_ids(_spans(spark, d))
    seen = ids.join(cached_documents(spark, d).select("doc_id"), "doc_id", "left_semi")
    return layout.cache_split(ids, seen.select("layout_id").distinct())[1].groupBy("layout_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query(r"SELECT DISTINCT path, trim(path) <> '' AND NOT list_contains(regexp_split_to_array(path, '[/\\]'), '..') AS safe FROM (SELECT path FROM batch_entries UNION ALL SELECT '../' || path FROM batch_entries UNION ALL SELECT source_file FROM extracted_records)")
def safe_paths(spark: SparkSession, d: str) -> DataFrame:
    """Whether the paths of files, and the same a folder up, may be used as a cache folder."""
    b = table(spark, d, "batch_entries").select("path")
    every = b.unionByName(b.select(F.concat(F.lit("../"), "path").alias("path"))).unionByName(table(spark, d, "extracted_records").select(F.col("source_file").alias("path")))
    return every.distinct().select("path", T.is_safe_path(F.col("path")).alias("safe"))


_ARTIFACTS = """art AS (
  SELECT layout_id, 'manifest' AS kind, 1 AS size FROM layout_manifests WHERE layout_id IS NOT NULL
  UNION ALL SELECT layout_id, 'module', CASE WHEN success THEN duration_ms ELSE 0 END FROM batch_entries WHERE layout_id <> ''
  UNION ALL SELECT layout_id, 'source', 1 FROM llm_calls WHERE call_type = 'code_generation' AND success AND layout_id IS NOT NULL
  UNION ALL SELECT layout_id, 'entry', 1 FROM batch_entries WHERE was_cached AND layout_id <> ''),
  h AS (SELECT layout_id, coalesce(bool_or(kind = 'module' AND size > 0), false) AS has_module, bool_or(kind = 'manifest') AS has_manifest, bool_or(kind = 'source') AS has_source, bool_or(kind = 'entry') AS has_entry FROM art GROUP BY layout_id)"""


def _artifacts(spark: SparkSession, d: str) -> DataFrame:
    m, b, c = table(spark, d, "layout_manifests"), table(spark, d, "batch_entries"), table(spark, d, "llm_calls")
    row = lambda kind, size: [F.lit(kind).alias("kind"), size.cast("long").alias("size")]
    named = b.where("layout_id != ''")
    parts = [
        m.where("layout_id IS NOT NULL").select("layout_id", *row("manifest", F.lit(1))),
        named.select("layout_id", *row("module", F.when(F.col("success"), F.col("duration_ms")).otherwise(0))),
        c.where("call_type = 'code_generation' AND success AND layout_id IS NOT NULL").select("layout_id", *row("source", F.lit(1))),
        named.where("was_cached").select("layout_id", *row("entry", F.lit(1))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {_ARTIFACTS} SELECT *, has_module AND has_manifest AND has_source AND has_entry AS healthy FROM h")
def layout_health(spark: SparkSession, d: str) -> DataFrame:
    return layout.health(_artifacts(spark, d))


@query(f"WITH {_ARTIFACTS} SELECT layout_id, CASE WHEN has_module AND has_entry THEN 'none' WHEN has_entry THEN 'restore_module' WHEN has_module THEN 'restore_entry' ELSE 'purge' END AS action FROM h")
def layout_repair(spark: SparkSession, d: str) -> DataFrame:
    return layout.repair(layout.health(_artifacts(spark, d)))


@query(
    """WITH k AS (SELECT DISTINCT layout_id FROM batch_entries WHERE layout_id <> ''),
    m AS (SELECT layout_id, arg_max(model, manifest_no) AS model, arg_max(cache_version, manifest_no) AS cache_version FROM layout_manifests GROUP BY layout_id)
    SELECT layout_id, coalesce(model, '?') AS model, coalesce(cache_version, 0) AS cache_version FROM k LEFT JOIN m USING (layout_id)"""
)
def cache_listing(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "batch_entries").where("layout_id != ''").select("layout_id").distinct()
    m = table(spark, d, "layout_manifests").groupBy("layout_id").agg(F.max_by(F.struct("model", "cache_version"), "manifest_no").alias("m"))
    return k.join(m, "layout_id", "left").select("layout_id", F.coalesce("m.model", F.lit("?")).alias("model"), F.coalesce("m.cache_version", F.lit(0)).alias("cache_version"))


# ---------------------------------------------------------------- fonts and quality

_FONTS = f"""{BASE}, fh AS (SELECT doc_id, floor(font_size * 10)::INT AS size10, count(*) AS n FROM s WHERE font_size >= 9 GROUP BY ALL),
  fs AS (SELECT doc_id, coalesce(arg_min(size10, (-n, size10)) / 10, 12.0) AS common_size, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT doc_id FROM s) LEFT JOIN fh USING (doc_id) GROUP BY doc_id),
  rr AS (SELECT s.*, common_size, CASE WHEN total = 0 THEN 0.0 ELSE 1.0 - coalesce(n, 0)::DOUBLE / total END AS rarity FROM s JOIN fs USING (doc_id) LEFT JOIN fh ON fh.doc_id = s.doc_id AND fh.size10 = floor(s.font_size * 10)::INT)"""


@query(f"WITH {_FONTS} SELECT doc_id, size10, n FROM fh")
def font_histogram(spark: SparkSession, d: str) -> DataFrame:
    return quality.font_histogram(_spans(spark, d)).drop("total")


@query(f"WITH {_FONTS} SELECT doc_id, common_size, total FROM fs")
def font_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.font_stats(_spans(spark, d))


@query(f"WITH {_FONTS} SELECT doc_id, span_idx, rarity FROM rr")
def font_rarity(spark: SparkSession, d: str) -> DataFrame:
    return quality.with_rarity(_spans(spark, d)).select("doc_id", "span_idx", "rarity")


@query(
    f"""WITH {_FONTS}, t AS (SELECT *, {q_trim('text')} AS t FROM rr)
    SELECT doc_id, span_idx, text FROM t WHERE t <> '' AND (is_bold OR (font_size > 0 AND rarity >= 0.4) OR (suffix(t, ':') AND length(t) <= 40 AND regexp_matches(t, '\\p{{L}}')))"""
)
def likely_labels(spark: SparkSession, d: str) -> DataFrame:
    return quality.likely_labels(_spans(spark, d))


_TIERS = f"""z AS (SELECT DISTINCT doc_id, font_size, font_size / common_size >= 1.2 AS big, is_bold AND font_size / common_size >= 1.05 AS bold FROM rr WHERE regexp_matches(text, '\\p{{L}}')),
    pick AS (SELECT doc_id, font_size FROM z WHERE big UNION SELECT doc_id, font_size FROM z WHERE bold AND NOT EXISTS (SELECT 1 FROM z y WHERE y.doc_id = z.doc_id AND y.big)),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY font_size DESC) AS rn FROM pick),
    f AS (SELECT doc_id, rn, [font_size] AS kept FROM o WHERE rn = 1 UNION ALL
      SELECT f.doc_id, o.rn, CASE WHEN len(list_filter(kept, lambda k: abs(k - o.font_size) < 0.5)) > 0 THEN kept ELSE list_append(kept, o.font_size) END FROM f JOIN o ON o.doc_id = f.doc_id AND o.rn = f.rn + 1),
    e AS (SELECT doc_id, arg_max(kept, rn)[1:4] AS kept FROM f GROUP BY doc_id)"""


@query(f"WITH RECURSIVE {_FONTS}, {_TIERS} SELECT doc_id, (generate_subscripts(kept, 1) - 1)::INT AS tier_no, unnest(kept) AS size FROM e")
def heading_tiers(spark: SparkSession, d: str) -> DataFrame:
    return quality.heading_tiers(_spans(spark, d))


@query(
    f"""WITH RECURSIVE {_FONTS}, {_TIERS} SELECT fs.doc_id, '--font-stats--' || chr(10) || 'most_common_size: ' || printf('%.1f', common_size)
      || CASE WHEN len(kept) > 0 THEN chr(10) || 'heading_tiers: [' || array_to_string(list_transform(kept, lambda x: printf('%.1f', x)), ', ') || ']' ELSE '' END AS footer FROM fs LEFT JOIN e USING (doc_id)"""
)
def grid_footers(spark: SparkSession, d: str) -> DataFrame:
    return quality.font_footer(_spans(spark, d))


_PUA = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"
_NOT_PUA = _PUA.replace("[", "[^", 1)


def _left(x: str, drop: str) -> str:
    return f"length(regexp_replace({x}, '{drop}', '', 'g'))"


_NOWS = f"regexp_replace(t, '[{WS}]', '', 'g')"
_SOUP = f"regexp_replace(regexp_replace(t, '\\.{{3,}}|_{{3,}}|·{{3,}}', '', 'g'), '[{WS}#*|\\-]', '', 'g')"
_ISSUE = f"""{BASE}, t0 AS (SELECT doc_id, span_idx, coalesce(page, 0) AS page, text, {q_trim('text')} AS t FROM s),
  t1 AS (SELECT *, {_NOWS} AS x, {_SOUP} AS soup, length(t) - length(replace(t, '$', '')) AS dollars,
    len(list_filter(range(2, length(t)), lambda i: t[i] = '$' AND regexp_matches(t[i-1], '[A-Za-z]') AND regexp_matches(t[i+1], '[A-Za-z]'))) AS between_letters FROM t0),
  t2 AS (SELECT *, length(x) AS total, {_left('x', '[^\\x{80}-\\x{9F}]')} AS c1, {_left("replace(x, '·', '')", '[^\\x{A0}-\\x{FF}]')} AS high, {_left('t', '[^A-Za-z]')} AS az,
    {_left('x', _NOT_PUA)} AS pua, length(t) - length(replace(t, '�', '')) AS repl,
    coalesce(list_max(list_transform(string_split_regex(t, '[^�]+'), lambda r: length(r))), 0) AS run FROM t1),
  i AS (SELECT *, CASE WHEN t = '' THEN NULL
    WHEN (dollars > 10 AND (between_letters > 20 OR between_letters * 2 > dollars))
      OR regexp_matches(t, '{_PUA}{{3,}}') OR (total >= 5 AND pua >= 2 AND pua * 2 >= total)
      OR (length(soup) >= 50 AND {_left('soup', '[^\\p{L}\\p{N}]')} * 2 < length(soup))
      OR (total >= 5 AND ((c1 >= 2 AND c1 * 20 >= total) OR (total >= 20 AND high * 5 >= total * 2 AND az * 3 < total)))
      OR len(list_filter(regexp_split_to_array(t, '[{WS}]+'), lambda w: length(w) >= 5 AND {_left('w', '[^\\x{80}-\\x{9F}]')} >= 2 AND {_left('w', '[^\\x{80}-\\x{9F}]')} * 20 >= length(w))) > 0 THEN 'strong'
    WHEN run >= 2 OR repl >= 3 THEN 'replacement' END AS issue FROM t2)"""


@query(f"WITH {_ISSUE} SELECT doc_id, span_idx, page, issue FROM i WHERE issue IS NOT NULL")
def span_issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.span_issues(_spans(spark, d))


_EVIDENCE = f"""{_ISSUE}, e AS (SELECT doc_id, page, count(*) AS n_spans, sum(total)::BIGINT AS chars, count(*) FILTER (issue = 'strong') AS n_strong, count(*) FILTER (issue = 'replacement') AS n_repl_spans,
  sum(CASE WHEN issue = 'replacement' THEN repl ELSE 0 END)::BIGINT AS n_replacement, max(CASE WHEN issue = 'replacement' THEN run ELSE 0 END) AS longest_run FROM i GROUP BY ALL)"""


@query(f"WITH {_EVIDENCE} SELECT * FROM e")
def page_evidence(spark: SparkSession, d: str) -> DataFrame:
    return quality.page_evidence(_spans(spark, d))


_EN = "[" + ", ".join(f"{x}::DOUBLE" for x in quality.ENGLISH) + "]"
_CIPHER = f"""c0 AS (SELECT doc_id, coalesce(page, 0) AS page, text, {_left('text', '[^A-Za-z]')} AS az, {_left('text', '[^aeiouAEIOU]')} AS vo,
    {_left('text', '[^\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}\\x{1E00}-\\x{1EFF}]')} AS ext, {_left('text', '\\P{L}')} AS every,
    len(regexp_extract_all(text, '[A-Za-z]+')) AS runs, len(regexp_extract_all(text, '[a-z][A-Z]')) AS shifts FROM s),
  c1 AS (SELECT doc_id, page, sum(az)::BIGINT AS letters, sum(vo)::BIGINT AS vowels, sum(ext)::BIGINT AS latin_ext, sum(every - az - ext)::BIGINT AS non_latin, sum(az - runs)::BIGINT AS bigrams, sum(shifts)::BIGINT AS case_shifts,
    [{', '.join(f"sum(len(regexp_extract_all(text, '[{c}{c.upper()}]')))::DOUBLE" for c in quality.LETTERS)}] AS h FROM c0 GROUP BY ALL),
  c2 AS (SELECT * EXCLUDE (h), CASE WHEN letters = 0 THEN 1.0 ELSE list_cosine_similarity(h, {_EN}) END AS cosine,
    CASE WHEN letters = 0 THEN 1.0 ELSE list_cosine_similarity(list_reverse_sort(h), list_reverse_sort({_EN})) END AS shape_cosine FROM c1),
  ciph AS (SELECT *, letters >= 200 AND non_latin <= letters + latin_ext AND vowels <= 0.30 * letters AND ((bigrams >= 100 AND case_shifts >= bigrams * 0.10) OR (cosine < 0.60 AND shape_cosine >= 0.90)) AS garbled FROM c2)"""


@query(f"WITH {BASE}, {_CIPHER} SELECT doc_id, page, letters, vowels, latin_ext, non_latin, bigrams, case_shifts, round(cosine, 6) AS cosine, round(shape_cosine, 6) AS shape_cosine, garbled FROM ciph")
def cipher_stats(spark: SparkSession, d: str) -> DataFrame:
    s = quality.cipher_stats(_spans(spark, d))
    return s.withColumn("cosine", F.round("cosine", 6)).withColumn("shape_cosine", F.round("shape_cosine", 6))


_PAGE_QUALITY = f"""{_EVIDENCE}, {_CIPHER}, pq AS (SELECT doc_id, page, CASE WHEN n_strong > 0 THEN n_strong WHEN garbled OR (n_replacement > 0 AND (
    (chars <= 80 AND longest_run >= 2) OR (n_replacement >= 12 AND n_replacement * 10000 // greatest(chars, 1) >= 500) OR (n_repl_spans >= 3 AND n_replacement * 10000 // greatest(chars, 1) >= 250)
    OR (longest_run >= 8 AND n_replacement * 10000 // greatest(chars, 1) >= 250))) THEN 1 ELSE 0 END AS n_reasons FROM e JOIN ciph USING (doc_id, page))"""


@query(f"WITH {_PAGE_QUALITY} SELECT doc_id, page, n_reasons::BIGINT AS n_reasons FROM pq WHERE n_reasons > 0")
def page_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.page_quality(_spans(spark, d))


@query(f"WITH {_PAGE_QUALITY}, f AS (SELECT doc_id, string_agg(page::VARCHAR, ' ' ORDER BY page) AS pages FROM pq WHERE n_reasons > 0 GROUP BY doc_id) SELECT doc_id, pages IS NOT NULL AS has_encoding_issues, coalesce(pages, '') AS pages FROM (SELECT DISTINCT doc_id FROM s) LEFT JOIN f USING (doc_id)")
def quality_reports(spark: SparkSession, d: str) -> DataFrame:
    r = quality.quality_report(_spans(spark, d))
    return r.select("doc_id", "has_encoding_issues", F.array_join(F.transform("pages_needing_ocr", lambda p: p.cast("string")), " ").alias("pages"))


# ---------------------------------------------------------------- classification


@query(
    f"""WITH {BASE}, dd AS (SELECT DISTINCT doc_id FROM text_quality_reports), p AS (SELECT doc_id, count(DISTINCT coalesce(page, 1)) AS n, coalesce(max(page), 1) AS mx, list(DISTINCT coalesce(page, 1)) AS seen FROM s GROUP BY doc_id)
    SELECT dd.doc_id, CASE WHEN n IS NULL THEN 'scanned' ELSE 'text' END AS pdf_type, CASE WHEN n IS NULL THEN 0.6 ELSE n / mx END AS confidence, coalesce(mx, 1)::INT AS max_page, coalesce(n, 0) AS pages_with_text,
      CASE WHEN n IS NULL THEN '1' ELSE coalesce(list_aggregate(list_filter(range(1, mx + 1), lambda x: NOT list_contains(seen, x)), 'string_agg', ' '), '') END AS pages
    FROM dd LEFT JOIN p ON p.doc_id = dd.doc_id"""
)
def classify_spans(spark: SparkSession, d: str) -> DataFrame:
    """Reports name the documents; those without any span are scans."""
    c = quality.classify_spans(table(spark, d, "text_quality_reports"), _spans(spark, d))
    return c.withColumn("pages", F.array_join(F.transform("pages_needing_ocr", lambda p: p.cast("string")), " ")).drop("pages_needing_ocr")


def _page_table(spark: SparkSession, d: str) -> DataFrame:
    """Page counters made up from document ids, so that every branch of the ladder occurs."""
    docs = table(spark, d, "documents").select("doc_id")
    p = docs.select("doc_id", F.explode(F.sequence(F.lit(1), (1 + F.col("doc_id") % 12).cast("int"))).alias("page"))
    k, n = (F.col("doc_id") % 9), F.col("page")
    return p.select(
        "doc_id", "page", F.when(k.isin(0, 3), 0).when(k == 1, 2 + n % 3).when(k == 2, 40 + n).otherwise(20 + (F.col("doc_id") + n) % 30).cast("int").alias("text_ops"),
        F.when(k == 4, 80).when(k.isin(0, 2), 1).when(k == 5, n % 2).otherwise(0).cast("int").alias("images"),
        F.coalesce(k.isin(0, 2, 4) | ((k == 5) & (n % 2 == 1)), F.lit(False)).alias("has_images"), ((k == 2) & (n % 2 == 0)).alias("has_template"),
        F.when(k.isin(0, 3), 0).when(k == 1, 3).otherwise(10 + n).cast("int").alias("unique_chars"), F.when(k == 2, 4 + n % 4 * 10).when(k == 6, 12).otherwise(20).cast("int").alias("unique_alnum"),
        F.when((k == 6) & (n % 3 != 1), 20000).otherwise(5).cast("int").alias("path_ops"), ((k == 7) & (n % 4 == 0)).alias("identity_h"), ((k == 8) & (n % 5 == 0)).alias("type3_only"), (k != 2).alias("decodable"),
    )


_PAGES = """pg AS (SELECT doc_id, unnest(range(1, 2 + doc_id % 12))::INT AS page, doc_id % 9 AS k FROM documents),
  p0 AS (SELECT doc_id, page, (CASE WHEN k IN (0, 3) THEN 0 WHEN k = 1 THEN 2 + page % 3 WHEN k = 2 THEN 40 + page ELSE 20 + (doc_id + page) % 30 END)::INT AS text_ops,
    (CASE WHEN k = 4 THEN 80 WHEN k IN (0, 2) THEN 1 WHEN k = 5 THEN page % 2 ELSE 0 END)::INT AS images, k IN (0, 2, 4) OR (k = 5 AND page % 2 = 1) AS has_images, k = 2 AND page % 2 = 0 AS has_template,
    CASE WHEN k IN (0, 3) THEN 0 WHEN k = 1 THEN 3 ELSE 10 + page END AS unique_chars, CASE WHEN k = 2 THEN 4 + page % 4 * 10 WHEN k = 6 THEN 12 ELSE 20 END AS unique_alnum,
    CASE WHEN k = 6 AND page % 3 <> 1 THEN 20000 ELSE 5 END AS path_ops, k = 7 AND page % 4 = 0 AS identity_h, k = 8 AND page % 5 = 0 AS type3_only, k <> 2 AS decodable FROM pg),
  p1 AS (SELECT *, path_ops >= 1000 AND path_ops > 200 * text_ops AND unique_alnum < 30 AS vector, images > 10 AND images > 3 * text_ops AS dominated,
    images <= 1 AND text_ops < 50 AND unique_alnum < 10 AND NOT (decodable AND text_ops >= 10) AS scan_like, max(page) OVER (PARTITION BY doc_id) AS total FROM p0),
  fl AS (SELECT *, text_ops >= (CASE WHEN has_images OR images > 0 THEN 10 ELSE 3 END) AND NOT dominated AND unique_chars >= 5 AND NOT vector AND NOT type3_only AS with_text, has_template AND scan_like AS template_page,
    (text_ops < 3 OR dominated OR unique_chars < 5) AND (has_images OR has_template) AS stop, (has_template AND scan_like) OR vector OR (text_ops < 3 AND has_images) AS mixed_ocr, identity_h OR type3_only AS undecodable FROM p1)"""
_SAMPLED = "sel AS (SELECT * FROM fl WHERE total <= 8 OR page = 1 OR page = total OR list_contains(list_transform(range(1, 7), lambda i: 1 + ((total - 2) // 7) * i), page))"
_EARLY = "sel AS (SELECT f.* FROM fl f LEFT JOIN (SELECT doc_id, min(page) AS cut FROM fl WHERE stop GROUP BY doc_id) c USING (doc_id) WHERE cut IS NULL OR page <= cut)"
_CLASSES = """ag AS (SELECT doc_id, max(total) AS page_count, count(*) AS n, count(*) FILTER (with_text) AS wt, count(*) FILTER (has_images) AS wi, count(*) FILTER (template_page) AS tp, count(*) FILTER (vector) AS vt, sum(text_ops) AS ops FROM sel GROUP BY doc_id),
  cl AS (SELECT doc_id, CASE WHEN tp > 0 AND wt > 0 THEN 'mixed' WHEN wt / n >= 0.6 THEN 'text' WHEN wt = 0 AND (wi > 0 OR vt > 0) THEN CASE WHEN ops = 0 AND vt = 0 THEN 'scanned' ELSE 'image' END
      WHEN wt > 0 AND (wi > 0 OR vt > 0) THEN 'mixed' WHEN ops = 0 THEN 'scanned' ELSE 'text' END AS pdf_type,
    CASE WHEN tp > 0 AND wt > 0 THEN 0.5 + 0.3 * (1.0 - tp / n) WHEN wt / n >= 0.6 THEN wt / n WHEN wt = 0 AND (wi > 0 OR vt > 0) THEN CASE WHEN ops = 0 AND vt = 0 THEN 0.95 ELSE 0.8 END
      WHEN wt > 0 AND (wi > 0 OR vt > 0) THEN 0.7 WHEN ops = 0 THEN 0.9 ELSE greatest(wt / n, 0.5) END AS confidence, page_count, n AS pages_sampled, wt AS pages_with_text,
    (tp > 0 AND wt > 0) OR (wt / n < 0.6 AND (wi > 0 OR vt > 0 OR ops = 0)) AS ocr_recommended FROM ag)"""


@query(f"WITH {_PAGES}, {_SAMPLED}, {_CLASSES} SELECT * FROM cl")
def classify_pages(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify_pages(_page_table(spark, d))


@query(f"WITH {_PAGES}, {_EARLY}, {_CLASSES} SELECT * FROM cl")
def classify_early_exit(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify_pages(_page_table(spark, d), strategy="early_exit")


@query(f"WITH {_PAGES}, sel AS (SELECT * FROM fl), {_CLASSES} SELECT * FROM cl")
def classify_full(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify_pages(_page_table(spark, d), strategy="full")


@query(f"WITH {_PAGES}, sel AS (SELECT * FROM fl WHERE page IN (1, 3)), {_CLASSES} SELECT * FROM cl")
def classify_chosen(spark: SparkSession, d: str) -> DataFrame:
    """By the first and third page."""
    return quality.classify_pages(_page_table(spark, d), strategy="pages", chosen=[1, 3])


@query(
    f"""WITH {_PAGES}, {_SAMPLED}, {_CLASSES}, j AS (SELECT fl.*, cl.pdf_type, pdf_type = 'mixed' OR sel.page IS NOT NULL AS known FROM fl JOIN cl USING (doc_id) LEFT JOIN sel ON sel.doc_id = fl.doc_id AND sel.page = fl.page),
    nd AS (SELECT * FROM j WHERE pdf_type IN ('scanned', 'image') OR (pdf_type = 'mixed' AND mixed_ocr) OR (known AND undecodable))
    SELECT doc_id, page, 'suspected_garbled_text' AS reason FROM nd WHERE known AND undecodable UNION ALL SELECT doc_id, page, 'vector_text' FROM nd WHERE known AND vector
    UNION ALL SELECT doc_id, page, CASE WHEN known AND NOT (text_ops > 0 AND unique_chars > 0) AND NOT has_images AND NOT has_template THEN 'no_text' ELSE 'scanned' END FROM nd WHERE NOT known OR NOT (undecodable OR vector)"""
)
def ocr_reasons(spark: SparkSession, d: str) -> DataFrame:
    pages = _page_table(spark, d)
    return quality.ocr_pages(pages, quality.classify_pages(pages))


@query("SELECT doc_id, CASE WHEN n <= 8 THEN array_to_string(range(1, n + 1), ' ') ELSE array_to_string(list_sort(list_distinct(list_concat([1, n], list_filter(list_transform(range(1, 7), lambda i: 1 + ((n - 2) // 7) * i), lambda p: p > 1 AND p < n)))), ' ') END AS pages FROM (SELECT doc_id, 1 + doc_id % 40 AS n FROM documents)")
def page_sampling(spark: SparkSession, d: str) -> DataFrame:
    pages = F.transform(quality.sample_pages(1 + F.col("doc_id") % 40), lambda p: p.cast("string"))
    return table(spark, d, "documents").select("doc_id", F.array_join(pages, " ").alias("pages"))


# ---------------------------------------------------------------- pages of real files


def _pdfs(spark: SparkSession, d: str) -> DataFrame:
    """A PDF file of each document: 45 lines a page, the first in bold, and every third page of every fourth document blank."""
    docs = table(spark, d, "documents").repartition("doc_id")
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    cell = lambda n: F.struct(
        F.lit(50.0).alias("x"), (750.0 - 15 * n.cast("double")).alias("y"), F.lit(10.0).alias("size"), F.col("line").alias("text"), (F.col("i") == 0).alias("bold")
    )
    at = lines.select("doc_id", (1 + F.floor(F.col("i") / 45)).cast("int").alias("sheet"), "i", cell(F.col("i") % 45).alias("s"))
    blank = (F.col("doc_id") % 4 == 0) & (F.col("sheet") % 3 == 0)
    pages = at.groupBy("doc_id", "sheet").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("l"))
    pages = pages.select("doc_id", F.col("sheet").alias("page"), F.when(blank, F.array().cast("array<struct<x:double,y:double,size:double,text:string,bold:boolean>>")).otherwise(F.col("l.s")).alias("spans"))
    return pdf.made_pdfs(pages, "doc_id")


_SIMPLE = "[^\\x00-\\x7f\\xa0-\\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
_LINES = f"""ln AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
  kept AS (SELECT doc_id, i, (1 + i // 45)::INT AS page, regexp_replace(line, '{_SIMPLE}', '?', 'g') AS text FROM ln WHERE NOT (doc_id % 4 = 0 AND (1 + i // 45) % 3 = 0))"""


@query(
    f"""WITH {_LINES} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS span_idx, page, text, i = 0 AS is_bold FROM kept WHERE {q_trim('text')} <> ''"""
)
def pdf_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans read from PDF files of all documents. Signs that the files' fonts don't have are question marks."""
    s = pdf.parse_files(_pdfs(spark, d)).where("error IS NULL")
    return s.select(F.col("path").cast("long").alias("doc_id"), "span_idx", "page", "text", "is_bold")


@query()
def pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    """Kind of each document's PDF file, from what its pages' content streams hold."""
    pages = pdf.parse_files(_pdfs(spark, d), "pages").where("error IS NULL").withColumnRenamed("path", "doc_id").drop("error")
    return quality.classify_pages(pages)


@query()
def pdf_quality(spark: SparkSession, d: str) -> DataFrame:
    """Spans of PDF files scanned and their pages rated in one go."""
    s = pdf.parse_files(_pdfs(spark, d)).where("error IS NULL").withColumn("doc_id", F.col("path").cast("long")).drop("path", "error")
    r = quality.quality_report(materialize(s, "pdf-spans"))
    return r.select("doc_id", "has_encoding_issues", F.array_join(F.transform("pages_needing_ocr", lambda p: p.cast("string")), " ").alias("pages"))
