"""Text quality per span and page, font statistics, and page classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

LETTERS = "abcdefghijklmnopqrstuvwxyz"
# Fixed value: frequencies of English letters in percent, a to z.
ENGLISH = (
    8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.8, 4.0, 2.4,
    6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.15, 2.0, 0.07,
)
REASON_GARBLED, REASON_SCANNED, REASON_NO_TEXT, REASON_VECTOR = "suspected_garbled_text", "scanned", "no_text", "vector_text"
DEFAULT_SIZE = 12.0


# ---------------------------------------------------------------- quality


def span_issues(spans: DataFrame) -> DataFrame:
    """(doc_id, span_idx, page, issue) of spans with a 'strong' or 'replacement' issue; page 0 for none."""
    return spans.select("doc_id", "span_idx", F.coalesce("page", F.lit(0)).alias("page"), T.span_issue(F.col("text")).alias("issue")).where("issue IS NOT NULL")


def letter_stats(spans: DataFrame) -> DataFrame:
    """(doc_id, page, letters, vowels, latin_ext, non_latin, bigrams, case_shifts, histogram): sums
    over spans; pairs of letters don't cross spans."""
    t = F.col("text")
    low = F.translate(t, LETTERS.upper(), LETTERS)
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    ext = F.length(F.regexp_replace(t, r"[^\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{1E00}-\x{1EFF}]", ""))
    every = F.length(F.regexp_replace(t, r"\P{L}", ""))
    s = spans.select(
        "doc_id", F.coalesce("page", F.lit(0)).alias("page"), letters.alias("letters"),
        F.length(F.regexp_replace(t, "[^aeiouAEIOU]", "")).alias("vowels"), ext.alias("latin_ext"),
        (every - letters - ext).alias("non_latin"), (letters - F.regexp_count(t, F.lit("[A-Za-z]+"))).alias("bigrams"),
        F.regexp_count(t, F.lit("[a-z][A-Z]")).alias("case_shifts"),
        *((F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).alias(f"n_{c}") for c in LETTERS),
    )
    sums = [F.sum(c).alias(c) for c in s.columns[2:8]]
    hist = F.array(*(F.sum(f"n_{c}").cast("double") for c in LETTERS)).alias("histogram")
    return s.groupBy("doc_id", "page").agg(*sums, hist)


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cipher_stats(spans: DataFrame) -> DataFrame:
    """Letter statistics with the cosines to English (as it is, and of the sorted profiles) and ``garbled``."""
    english = F.array(*(F.lit(x) for x in ENGLISH))
    s = letter_stats(spans)
    share = F.transform("histogram", lambda n: n / F.col("letters"))
    none = F.col("letters") == 0
    s = s.withColumn("cosine", F.when(none, 1.0).otherwise(_cosine(share, english))).withColumn(
        "shape_cosine", F.when(none, 1.0).otherwise(_cosine(F.sort_array(share, False), F.sort_array(english, False)))
    )
    shifted = (F.col("bigrams") >= 100) & (F.col("case_shifts") >= F.col("bigrams") * 0.10)
    permuted = (F.col("cosine") < 0.60) & (F.col("shape_cosine") >= 0.90)
    garbled = (
        (F.col("letters") >= 200) & (F.col("non_latin") <= F.col("letters") + F.col("latin_ext"))
        & (F.col("vowels") <= 0.30 * F.col("letters")) & (shifted | permuted)
    )
    return s.withColumn("garbled", garbled).drop("histogram")


def page_evidence(spans: DataFrame) -> DataFrame:
    """(doc_id, page, n_spans, chars, n_strong, n_replacement, longest_run): mergeable per-page counts."""
    t = T.trim("text")
    s = spans.select("doc_id", F.coalesce("page", F.lit(0)).alias("page"), t.alias("t"), T.span_issue(F.col("text")).alias("issue"))
    repl = F.col("issue") == "replacement"
    return s.groupBy("doc_id", "page").agg(
        F.count("*").alias("n_spans"), F.sum(F.length(F.regexp_replace("t", f"[{T.WHITE}]", ""))).alias("chars"),
        F.count_if(F.col("issue") == "strong").alias("n_strong"), F.count_if(repl).alias("n_repl_spans"),
        F.sum(F.when(repl, T.replacement_count(F.col("t"))).otherwise(0)).alias("n_replacement"),
        F.max(F.when(repl, T.replacement_run(F.col("t"))).otherwise(0)).alias("longest_run"),
    )


def page_quality(spans: DataFrame) -> DataFrame:
    """(doc_id, page, n_reasons) of pages that need OCR: one reason per strong span, else one when the
    replacement characters or the letter statistics say so."""
    e = page_evidence(spans).join(cipher_stats(spans).select("doc_id", "page", "garbled"), ["doc_id", "page"])
    n, run, chars = F.col("n_replacement"), F.col("longest_run"), F.col("chars")
    per_10k = F.when(chars > 0, F.floor(n * 10000 / chars)).otherwise(0)
    replaced = (n > 0) & (
        ((chars <= 80) & (run >= 2)) | ((n >= 12) & (per_10k >= 500)) | ((F.col("n_repl_spans") >= 3) & (per_10k >= 250)) | ((run >= 8) & (per_10k >= 250))
    )
    reasons = F.when(F.col("n_strong") > 0, F.col("n_strong")).when(replaced | F.col("garbled"), 1).otherwise(0)
    return e.select("doc_id", "page", reasons.cast("long").alias("n_reasons")).where("n_reasons > 0")


def quality_report(spans: DataFrame) -> DataFrame:
    """(doc_id, has_encoding_issues, pages_needing_ocr, reasons_by_page), one row a document."""
    flagged = page_quality(spans).groupBy("doc_id").agg(
        F.sort_array(F.collect_set("page")).alias("pages_needing_ocr"),
        F.map_from_entries(F.collect_list(F.struct("page", F.array_repeat(F.lit(REASON_GARBLED), F.col("n_reasons").cast("int"))))).alias("reasons_by_page"),
    )
    return spans.select("doc_id").distinct().join(flagged, "doc_id", "left").select(
        "doc_id", F.col("pages_needing_ocr").isNotNull().alias("has_encoding_issues"),
        F.coalesce("pages_needing_ocr", F.array().cast("array<int>")).alias("pages_needing_ocr"), "reasons_by_page",
    )


# ---------------------------------------------------------------- fonts


def font_histogram(spans: DataFrame) -> DataFrame:
    """(doc_id, size10, n, total): spans per font size in tenths; sizes under 9 don't count."""
    h = spans.where("font_size >= 9").groupBy("doc_id", F.floor(F.col("font_size") * 10).cast("int").alias("size10")).agg(F.count("*").alias("n"))
    return h.withColumn("total", F.sum("n").over(Window.partitionBy("doc_id")))


def font_stats(spans: DataFrame) -> DataFrame:
    """(doc_id, common_size, total): most common size, the smaller of equals; 12 without any."""
    best = font_histogram(spans).groupBy("doc_id").agg(F.min_by("size10", F.struct(-F.col("n"), "size10")).alias("s"), F.max("total").alias("total"))
    return spans.select("doc_id").distinct().join(best, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("s") / 10, F.lit(DEFAULT_SIZE)).alias("common_size"), F.coalesce("total", F.lit(0)).alias("total")
    )


def with_rarity(spans: DataFrame) -> DataFrame:
    """spans with ``rarity`` (share of the document's sized spans that have another size), ``common_size``."""
    h = font_histogram(spans).select("doc_id", "size10", "n")
    s = spans.withColumn("size10", F.floor(F.col("font_size") * 10).cast("int")).join(h, ["doc_id", "size10"], "left").join(font_stats(spans), "doc_id")
    rarity = F.when(F.col("total") == 0, 0.0).otherwise(1.0 - F.coalesce("n", F.lit(0)) / F.col("total"))
    return s.withColumn("rarity", rarity).drop("n", "size10", "total")


def likely_labels(spans: DataFrame) -> DataFrame:
    t = T.trim("text")
    structural = F.col("is_bold") | ((F.col("font_size") > 0) & (F.col("rarity") >= 0.4)) | (
        t.endswith(":") & (F.length(t) <= 40) & T.has_letter(t)
    )
    return with_rarity(spans).where((t != "") & structural).select("doc_id", "span_idx", "text")


def heading_tiers(spans: DataFrame) -> DataFrame:
    """(doc_id, tier_no, size): at most four heading sizes, largest first. Sizes within half a point
    of a kept one are dropped; bold sizes stand in where no size is large enough."""
    s = spans.join(font_stats(spans), "doc_id").where(T.has_letter(F.col("text")) & (F.col("common_size") > 0))
    ratio = F.col("font_size") / F.col("common_size")
    sizes = s.groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.when(ratio >= 1.2, F.col("font_size"))), False).alias("large"),
        F.sort_array(F.collect_set(F.when(F.col("is_bold") & (ratio >= 1.05), F.col("font_size"))), False).alias("bold"),
    )
    keep = lambda a: F.aggregate(
        a, F.array().cast("array<double>"), lambda acc, x: F.when(F.exists(acc, lambda t: F.abs(t - x) < 0.5), acc).otherwise(F.concat(acc, F.array(x)))
    )
    tiers = F.slice(keep(F.when(F.size("large") > 0, F.col("large")).otherwise(F.col("bold"))), 1, 4)
    return sizes.select("doc_id", F.posexplode(tiers).alias("tier_no", "size"))


def font_footer(spans: DataFrame) -> DataFrame:
    """(doc_id, footer): the lines on fonts that may follow a document's grid."""
    one = lambda size: F.format_string("%.1f", size)
    tiers = heading_tiers(spans).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tier_no", "size"))).alias("t"))  # four at most
    f = font_stats(spans).join(tiers, "doc_id", "left")
    head = F.concat(F.lit("--font-stats--\nmost_common_size: "), one(F.col("common_size")))
    listed = F.concat(F.lit("\nheading_tiers: ["), F.array_join(F.transform("t.size", one), ", "), F.lit("]"))
    return f.select("doc_id", F.concat(head, F.coalesce(listed, F.lit(""))).alias("footer"))


# ---------------------------------------------------------------- classification


def classify_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, pdf_type, confidence, max_page, pages_with_text, pages_needing_ocr) of docs(doc_id);
    documents without spans are scans. Spans without page count as page 1."""
    p = spans.groupBy("doc_id").agg(
        F.countDistinct(F.coalesce("page", F.lit(1))).alias("pages_with_text"), F.coalesce(F.max("page"), F.lit(1)).alias("max_page"),
        F.collect_set(F.coalesce("page", F.lit(1))).alias("seen"),
    )
    d = docs.select("doc_id").distinct().join(p, "doc_id", "left")
    none = F.col("seen").isNull()
    return d.select(
        "doc_id", F.when(none, "scanned").otherwise("text").alias("pdf_type"),
        F.when(none, 0.6).otherwise(F.col("pages_with_text") / F.col("max_page")).alias("confidence"),
        F.coalesce("max_page", F.lit(1)).alias("max_page"), F.coalesce("pages_with_text", F.lit(0)).alias("pages_with_text"),
        F.when(none, F.array(F.lit(1))).otherwise(F.array_sort(F.array_except(F.sequence(F.lit(1), F.col("max_page")), F.col("seen")))).alias("pages_needing_ocr"),
    )


def sample_pages(total: Column, n: int = 8) -> Column:
    """Page numbers spread over a document, first and last included."""
    if n <= 0:
        return F.array().cast("array<int>")
    t = total.cast("int")
    whole = F.when(t >= 1, F.sequence(F.lit(1), F.greatest(t, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    if n == 1:
        return F.when(t <= 1, whole).otherwise(F.array(F.lit(1)))
    step = F.floor((t - 2) / (n - 1)).cast("int")
    inner = F.transform(F.sequence(F.lit(1), F.lit(max(1, n - 2))), lambda i: 1 + step * i) if n > 2 else F.array().cast("array<int>")
    inner = F.filter(inner, lambda p: (p > 1) & (p < t))
    return F.when(t <= n, whole).otherwise(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1), t), inner))))


def page_flags(pages: DataFrame, min_text_ops: int = 3) -> DataFrame:
    """pages(doc_id, page, text_ops, images, has_images, has_template, unique_chars, unique_alnum,
    path_ops, identity_h, type3_only, decodable) with the tests on each page."""
    c = F.col
    dominated = (c("images") > 10) & (c("images") > c("text_ops") * 3)
    least = F.when(c("has_images") | (c("images") > 0), max(min_text_ops, 10)).otherwise(min_text_ops)
    vector = (c("path_ops") >= 1000) & (c("path_ops") > c("text_ops") * 200) & (c("unique_alnum") < 30)
    low = (c("unique_alnum") < 10) & ~(c("decodable") & (c("text_ops") >= 10))
    scan_like = (c("images") <= 1) & (c("text_ops") < 50) & low
    p = pages.withColumn("vector", vector)
    return (
        p.withColumn("with_text", (c("text_ops") >= least) & ~dominated & (c("unique_chars") >= 5) & ~c("vector") & ~c("type3_only"))
        .withColumn("template_page", c("has_template") & scan_like)
        .withColumn("stop", ((c("text_ops") < min_text_ops) | dominated | (c("unique_chars") < 5)) & (c("has_images") | c("has_template")))
        .withColumn("mixed_ocr", (c("has_template") & scan_like) | c("vector") | ((c("text_ops") < min_text_ops) & c("has_images")))
        .withColumn("undecodable", c("identity_h") | c("type3_only"))
    )


def scanned_pages(flags: DataFrame, strategy: str = "sample", n: int = 8, chosen: list[int] | None = None) -> DataFrame:
    """The pages a strategy looks at: 'full', 'early_exit' (up to the first stop), 'sample' or 'pages'."""
    if strategy == "full":
        return flags
    if strategy == "pages":
        return flags.where(F.col("page").isin(*(chosen or [])))
    whole = Window.partitionBy("doc_id")
    if strategy == "early_exit":
        first = F.min(F.when(F.col("stop"), F.col("page"))).over(whole)
        return flags.withColumn("_stop", first).where("_stop IS NULL OR page <= _stop").drop("_stop")
    return flags.withColumn("_n", F.max("page").over(whole)).where(F.array_contains(sample_pages(F.col("_n"), n), F.col("page"))).drop("_n")


def classify_pages(pages: DataFrame, strategy: str = "sample", n: int = 8, text_share: float = 0.6, chosen: list[int] | None = None) -> DataFrame:
    """(doc_id, pdf_type, confidence, page_count, pages_sampled, pages_with_text, ocr_recommended)."""
    flags = page_flags(pages)
    count = lambda c: F.count_if(F.col(c))
    a = scanned_pages(flags, strategy, n, chosen).groupBy("doc_id").agg(
        F.count("*").alias("pages_sampled"), count("with_text").alias("pages_with_text"), count("has_images").alias("w_images"),
        count("template_page").alias("w_template"), count("vector").alias("w_vector"), F.sum("text_ops").alias("ops"),
    )
    a = flags.groupBy("doc_id").agg(F.max("page").alias("page_count")).join(a, "doc_id", "left").fillna(0)
    c = F.col
    share = F.when(c("pages_sampled") > 0, c("pages_with_text") / c("pages_sampled")).otherwise(0.0)
    template = F.when(c("pages_sampled") > 0, c("w_template") / c("pages_sampled")).otherwise(0.0)
    pictures = (c("w_images") > 0) | (c("w_vector") > 0)
    ladder = [
        ((c("w_template") > 0) & (c("pages_with_text") > 0), "mixed", 0.5 + 0.3 * (1.0 - template), True),
        (share >= text_share, "text", share, False),
        ((c("pages_with_text") == 0) & pictures & (c("ops") == 0) & (c("w_vector") == 0), "scanned", F.lit(0.95), True),
        ((c("pages_with_text") == 0) & pictures, "image", F.lit(0.8), True),
        ((c("pages_with_text") > 0) & pictures, "mixed", F.lit(0.7), True),
        (c("ops") == 0, "scanned", F.lit(0.9), True),
    ]
    pick = lambda i, other: reduce(lambda acc, r: acc.when(r[0], r[i]), ladder[1:], F.when(ladder[0][0], ladder[0][i])).otherwise(other)
    return a.select(
        "doc_id", pick(1, "text").alias("pdf_type"), pick(2, F.greatest(share, F.lit(0.5))).alias("confidence"), "page_count", "pages_sampled",
        "pages_with_text", pick(3, False).alias("ocr_recommended"),
    )


def ocr_pages(pages: DataFrame, classified: DataFrame, **how) -> DataFrame:
    """(doc_id, page, reason): pages that need OCR and each reason why. Pages that weren't looked at
    count as scans; undecodable fonts are known for looked-at pages only."""
    flags = page_flags(pages)
    seen = scanned_pages(flags, **how).select("doc_id", "page", F.lit(True).alias("seen"))
    j = flags.join(seen, ["doc_id", "page"], "left").join(classified.select("doc_id", "pdf_type"), "doc_id")
    c = F.col
    known = F.coalesce("seen", F.lit(False)) | (c("pdf_type") == "mixed")
    needs = c("pdf_type").isin("scanned", "image") | ((c("pdf_type") == "mixed") & c("mixed_ocr")) | (known & c("undecodable"))
    empty = ~((c("text_ops") > 0) & (c("unique_chars") > 0)) & ~c("has_images") & ~c("has_template")
    reasons = F.array_compact(F.array(F.when(c("undecodable"), REASON_GARBLED), F.when(c("vector"), REASON_VECTOR)))
    reasons = F.when(~known, F.array(F.lit(REASON_SCANNED))).when(F.size(reasons) > 0, reasons).when(empty, F.array(F.lit(REASON_NO_TEXT))).otherwise(F.array(F.lit(REASON_SCANNED)))
    return j.where(needs).select("doc_id", "page", F.explode(reasons).alias("reason"))
