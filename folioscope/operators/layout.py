"""Anchors, layout fingerprints and the table of known layouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

MAX_ANCHORS = 5
CACHE_VERSION = 3
# Words that mark an anchor wherever they stand.
KEYWORDS = ("invoice", "total", "date", "bill to", "ship to", "amount", "quantity", "unit price", "description")


def is_anchor(text: Column, keywords: tuple[str, ...] = (), patterns: tuple[str, ...] = ()) -> Column:
    """Ends with a colon, or is all upper case without digits, or matches a pattern, or has a
    keyword. ``keywords`` are added to the usual ones; patterns that don't compile are ignored."""
    import re

    t = T.trim(text)
    low = F.lower(t)
    every = (*KEYWORDS, *(k.lower() for k in keywords))
    single = [k for k in every if " " not in k]
    several = [k for k in every if " " in k]
    tests = [
        t.endswith(":"),
        T.has_letter(t) & ~t.rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]") & ~t.rlike(r"\p{N}"),
        F.arrays_overlap(T.words(low), F.array(*(F.lit(k) for k in single))),
        *(low.contains(k) for k in several),
    ]
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        tests.append(t.rlike(p))
    return (t != "") & reduce(lambda a, b: a | b, tests)


def anchors(spans: DataFrame, multi_page: bool = False, first_page_only: bool = False, **detector) -> DataFrame:
    """(doc_id, rn, text, x, y, page, span_idx): anchors from the top, numbered from 1 per document.
    By default all pages count as page 0; ``multi_page`` sorts by the real page."""
    a = spans.where(is_anchor(F.col("text"), **detector))
    if first_page_only:
        a = a.where(F.coalesce("page", F.lit(1)) == 1)
    page = F.coalesce("page", F.lit(0)) if multi_page else F.lit(0)
    a = a.select("doc_id", "span_idx", T.trim("text").alias("text"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), page.alias("page"))
    order = Window.partitionBy("doc_id").orderBy("page", F.desc("y"), "x", "text", "span_idx")
    return a.withColumn("rn", F.row_number().over(order))


def anchor_deltas(found: DataFrame) -> DataFrame:
    """(doc_id, rn, dx, dy) between one anchor and the next."""
    order = Window.partitionBy("doc_id").orderBy("rn")
    return found.select("doc_id", "rn", (F.lead("x").over(order) - F.col("x")).alias("dx"), (F.lead("y").over(order) - F.col("y")).alias("dy")).where("dx IS NOT NULL")


def layout_ids(spans: DataFrame) -> DataFrame:
    """(doc_id, layout_id): SHA-256 of the offsets between the first five anchors; documents with
    fewer than two anchors hash their text length, span count and outer corners."""
    top = anchors(spans).where(F.col("rn") <= MAX_ANCHORS)
    deltas = anchor_deltas(top).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rn", "dx", "dy"))).alias("d"))
    print_ = F.array_join(F.transform("d", lambda s: F.format_string("%.2f,%.2f;", s["dx"], s["dy"])), "")
    whole = spans.groupBy("doc_id").agg(
        F.sum(F.octet_length("text")).alias("n_bytes"), F.count("*").alias("n"),
        F.min_by(F.struct("x0", "y0"), "span_idx").alias("a"), F.max_by(F.struct("x0", "y0"), "span_idx").alias("z"),
    )
    corner = F.format_string("fallback|%d|%d|%.2f,%.2f|%.2f,%.2f", "n_bytes", "n", "a.x0", "a.y0", "z.x0", "z.y0")
    return whole.join(deltas, "doc_id", "left").select("doc_id", F.sha2(F.coalesce(print_, corner), 256).alias("layout_id"))


def current_layouts(manifests: DataFrame, version: int = CACHE_VERSION) -> DataFrame:
    """(layout_id, manifest_no): layouts whose latest manifest has the current version."""
    last = manifests.groupBy("layout_id").agg(F.max_by(F.struct("cache_version", "manifest_no"), "manifest_no").alias("m"))
    return last.where(F.col("m.cache_version") == version).select("layout_id", "m.manifest_no")


def cache_split(docs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, layout_id) of known layouts and of new ones."""
    return docs.join(known.select("layout_id"), "layout_id", "left_semi"), docs.join(known.select("layout_id"), "layout_id", "left_anti")


def health(artifacts: DataFrame) -> DataFrame:
    """(layout_id, has_module, has_manifest, has_source, has_entry, healthy) of artifact rows
    (layout_id, kind, size); an empty module counts as missing."""
    flag = lambda kind, test: F.coalesce(F.bool_or((F.col("kind") == kind) & test), F.lit(False))
    h = artifacts.groupBy("layout_id").agg(
        flag("module", F.col("size") > 0).alias("has_module"), flag("manifest", F.lit(True)).alias("has_manifest"),
        flag("source", F.lit(True)).alias("has_source"), flag("entry", F.lit(True)).alias("has_entry"),
    )
    return h.withColumn("healthy", F.col("has_module") & F.col("has_manifest") & F.col("has_source") & F.col("has_entry"))


def repair(checked: DataFrame) -> DataFrame:
    """What to do with each layout: restore the module from the entry, the entry from the module, purge, or nothing."""
    return checked.select(
        "layout_id",
        F.when(F.col("has_module") & F.col("has_entry"), "none").when(F.col("has_entry"), "restore_module")
        .when(F.col("has_module"), "restore_entry").otherwise("purge").alias("action"),
    )
