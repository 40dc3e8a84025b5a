"""Problem 6: one form for texts that read the same but differ in their characters.

Each Arrow batch is handed to DuckDB, which applies one embedded SQL expression: invisible
characters go, blanks and hyphens become the plain ones, compatibility forms are mapped, parts are
joined (``nfc_normalize``), and look-alike letters of another alphabet become those of the word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters that can't be seen.
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f"
    "\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069"
    "\u206a\u206b\u206c\u206d\u206e\u206f\ufeff\ufff9\ufffa\ufffb"
)
# Ranges of variation selectors and tags, which can't be seen either.
UNSEEN = ((0xFE00, 0xFE0F), (0xE0000, 0xE007F), (0xE0100, 0xE01EF))
# Scripts in which the joiner and the non-joiner change what is read; between symbols they make one of two.
JOINED = (
    "Arabic", "Syriac", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala",
    "Khmer", "Mongolian",
)
# Blanks other than the plain one.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Signs drawn like ASCII punctuation, and the ASCII sign. Long dashes and curly quotes stay.
SIGNS = {
    "\u2010": "-", "\u2011": "-", "\u2043": "-", "\u2212": "-", "\ufe63": "-",
    "\u2024": ".", "\ufe52": ".", "\ufe50": ",", "\ufe54": ";", "\ufe55": ":",
    "\u037e": ";", "\u0589": ":", "\u2236": ":", "\ua789": ":",
    "\u2044": "/", "\u2215": "/", "\u2217": "*", "\u02bc": "'", "\u01c3": "!", "\u01c0": "|", "\u223c": "~",
}
# Letters drawn alike in Cyrillic, Greek and Latin.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјкорсухһԁԛԝӏӀҮ"
CYRILLIC_AS = "ABESIJKMHOPCTYXaesijkopcyxhdqwlIY"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXaikvopuxcj"
# Letters drawn like Latin ones in Armenian, Cherokee and phonetic script.
OTHER = "օոսհյցզՏՍՕԼᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏕᏙᏞᏟᏢᏦᏴɡɑ"
OTHER_AS = "onuhjgqSUOLDRTAJEWMHGZSVLCPKBga"
# The Cyrillic and Greek letters that Latin letters are mistaken for inside such words.
LATIN_IN_CYRILLIC = ("ABEKMHOPCTYXaekopcyx", "АВЕКМНОРСТУХаекорсух")
LATIN_IN_GREEK = ("ABEZHIKMNOPTYXov", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον")


# Code ranges of joined letters, ligatures, wide and narrow forms, and styled letters.
RANGES = ((0x0132, 0x0134), (0x01C4, 0x01CD), (0xFB00, 0xFB07), (0xFF01, 0xFFE7), (0x1D400, 0x1D800))


@lru_cache(maxsize=None)
def compatibility() -> tuple[str, str, dict[str, str]]:
    """Compatibility forms that look like plain signs: single ones (from, to) and joined ones."""
    single, joined = {}, {}
    for low, high in RANGES:
        for code in range(low, high):
            ch = chr(code)
            plain = unicodedata.normalize("NFKC", ch)
            if plain != ch and plain.strip() == plain:
                (single if len(plain) == 1 else joined)[ch] = plain
    single |= SIGNS
    return "".join(single), "".join(single.values()), joined


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@lru_cache(maxsize=None)
def embedded_sql() -> str:
    """SQL over the Arrow table ``batch`` with a column ``text``: adds ``plain`` (the same reading
    in one form, blanks kept) and ``canonical`` (blanks collapsed and trimmed as well)."""
    from_, to, joined = compatibility()
    odd = "[" + "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in RANGES) + "".join(SIGNS) + "]"
    unseen = INVISIBLE + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSEEN)
    joined_by = "[" + "".join(rf"\p{{{x}}}" for x in JOINED) + "\\p{So}\\p{Sk}\ufe0f]"
    # joiners that are read are put aside while the others go
    kept = f"regexp_replace(regexp_replace(text, '({joined_by})\u200d', '\\1\ufdd0', 'g'), '({joined_by})\u200c', '\\1\ufdd1', 'g')"
    kept = f"CASE WHEN regexp_matches(text, '{joined_by}[\u200c\u200d]') THEN {kept} ELSE text END"
    t = f"translate(regexp_replace({kept}, '[{unseen}]', '', 'g'), '\ufdd0\ufdd1', '\u200d\u200c')"
    t = f"translate({t}, {_q(BLANKS)}, {_q(' ' * len(BLANKS))})"
    # the long tables only for the texts that need them
    mapped = f"translate(bare, {_q(from_)}, {_q(to)})"
    for ch, plain in joined.items():
        mapped = f"replace({mapped}, {_q(ch)}, {_q(plain)})"
    cyr, grk = f"[{CYRILLIC}]", f"[{GREEK}]"
    word = f"""CASE
      WHEN regexp_matches(w, '[{OTHER}]') AND regexp_matches(w, '[A-Za-z]') AND NOT regexp_matches(w, '[\\p{{Cyrillic}}\\p{{Greek}}]') THEN translate(w, {_q(OTHER)}, {_q(OTHER_AS)})
      WHEN NOT regexp_matches(w, '[\\p{{Cyrillic}}\\p{{Greek}}]') THEN w
      WHEN regexp_matches(regexp_replace(w, '{cyr}', '', 'g'), '\\p{{Cyrillic}}') THEN translate(w, {_q(LATIN_IN_CYRILLIC[0])}, {_q(LATIN_IN_CYRILLIC[1])})
      WHEN regexp_matches(regexp_replace(w, '{grk}', '', 'g'), '\\p{{Greek}}') THEN CASE WHEN regexp_matches(w, '[A-Za-z]') AND length(w) > 2 THEN translate(w, {_q(LATIN_IN_GREEK[0])}, {_q(LATIN_IN_GREEK[1])}) ELSE w END
      WHEN regexp_matches(w, '\\p{{Latin}}') OR NOT regexp_matches(o, '[\\p{{Cyrillic}}\\p{{Greek}}]') THEN translate(w, {_q(CYRILLIC + GREEK)}, {_q(CYRILLIC_AS + GREEK_AS)})
      ELSE w END"""
    return f"""
    WITH cut AS (SELECT *, CASE WHEN regexp_matches(text, '[^\\x20-\\x7e]') THEN {t} ELSE text END AS bare FROM batch),
    base AS (SELECT * EXCLUDE (bare), CASE WHEN bare IS NULL THEN NULL WHEN regexp_matches(bare, {_q(odd)}) THEN nfc_normalize({mapped}) ELSE nfc_normalize(bare) END AS folded FROM cut),
    other AS (SELECT *, regexp_replace(folded, '[{CYRILLIC}{GREEK}]', '', 'g') AS o FROM base),
    spelt AS (SELECT * EXCLUDE (o, folded), CASE WHEN regexp_matches(folded, '[\\p{{Cyrillic}}\\p{{Greek}}{OTHER}]') THEN
        array_to_string(list_transform(regexp_extract_all(folded, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda w: {word}), '')
        ELSE folded END AS plain FROM other)
    SELECT *, trim(regexp_replace(plain, '[ \\t\\r\\n]+', ' ', 'g')) AS canonical FROM spelt
    """


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    sql = f"SELECT plain, canonical FROM ({embedded_sql()}) ORDER BY i"
    for batch in batches:
        # only the text goes to DuckDB, so other columns may have any name and type
        con.register("batch", pa.table({"text": batch.column("text"), "i": pa.array(range(batch.num_rows), pa.int64())}))
        out = con.sql(sql).to_arrow_table().combine_chunks()
        con.unregister("batch")
        columns = [out.column(c).cast(pa.string()) for c in ("plain", "canonical")]
        whole = [c.chunk(0) if c.num_chunks else pa.array([], pa.string()) for c in columns]
        yield pa.RecordBatch.from_arrays([*batch.columns, *whole], names=[*batch.schema.names, "plain", "canonical"])
    con.close()


def normalise(texts: DataFrame) -> DataFrame:
    """texts(..., text) with ``plain`` and ``canonical``. Null stays null, empty stays empty; other
    columns pass unchanged, but may not be called ``plain`` or ``canonical`` (they are replaced)."""
    texts = texts.drop("plain", "canonical")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInArrow(_normalise, f"{schema}, plain string, canonical string")


def label_texts(spans: DataFrame, anchors: DataFrame) -> DataFrame:
    a = spans.select(F.lit("span").alias("src"), "doc_id", F.col("span_idx").alias("pos"), "text")
    b = anchors.select(F.lit("anchor").alias("src"), "doc_id", F.col("anchor_no").alias("pos"), "text")
    return a.unionByName(b)


def find_variants(texts: DataFrame, garbled: DataFrame | None = None) -> DataFrame:
    """Distinct (src, doc_id, pos) of texts written with other characters that look alike.
    ``garbled`` holds keys of texts whose odd characters come from a wrong encoding."""
    # nothing else can change in a text of printable ASCII signs
    odd = texts.where(F.col("text").rlike(r"[^\x20-\x7e]"))
    found = normalise(odd).where(F.col("plain") != F.col("text")).select("src", "doc_id", "pos").distinct()
    return found if garbled is None else found.join(garbled, ["src", "doc_id", "pos"], "left_anti")
