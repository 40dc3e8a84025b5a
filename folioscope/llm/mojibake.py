"""Problem 1: text decoded with the wrong character encoding.

Every distinct corpus word with a non-ASCII sign is turned into the forms it would take if its
bytes (written in one encoding) had been read in another one, up to three times. The forms are
joined with the corpus' own distinct words, so what remains is a small table
``garbled word -> original word``. Document words are then hash-joined with it.
"""

from __future__ import annotations

import codecs
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import broadcast_if_small, materialize

# Names of character encodings in Python's codecs.
WRITTEN_IN = (
    "utf-8", "cp1252", "iso8859-15", "cp437", "cp850", "mac_roman",
    "cp1250", "iso8859-2", "cp852", "mac_latin2",
    "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic",
    "cp1253", "cp1254", "cp1257",
    "shift_jis", "euc_jp", "gbk", "big5", "euc_kr",
)
READ_AS = (
    "cp1252", "latin-1", "cp437", "cp850", "mac_roman",
    "cp1250", "iso8859-2", "cp852", "cp1251", "koi8-r", "cp866", "iso8859-5",
)
#: Codecs through which UTF-8 bytes are read a second time.
READ_TWICE_AS = ("cp1252", "latin-1", "cp1251", "cp437", "mac_roman", "cp850")
#: Codecs through which UTF-8 bytes are read three times.
READ_THRICE_AS = ("cp1252", "latin-1")
#: Readers that take bytes in pairs.
READ_AS_PAIRS = ("gbk", "shift_jis", "big5", "euc_jp", "euc_kr")
#: Readers that leave bytes undefined; those bytes stay as control characters, vanish or become U+FFFD.
PARTIAL = ("cp1252", "cp1250", "cp1251")
#: A form from a single-byte chain counts as damage only when it is this much rarer than the original
#: word: forms of one or two signs, which can arise by chance, and longer ones. The short ones count
#: only under chains that also explain longer words of the corpus.
RARITY_SHORT, RARITY = 20, 2
#: Words up to which a table of words is broadcast; some words are in a large part of all texts.
BROADCAST_WORDS = 300_000
#: Tasks that the texts with one garbled word are spread over where the words are too many to broadcast.
SALTS = 16
#: Words whose forms one task makes.
WORDS_A_TASK = 5_000
WORD_BREAK = r"[ \t\r\n0-9]+"
_EDGE = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"
FORM_SCHEMA = "form string, word string, n_word long, chain string, rank int, strict boolean, lossless boolean"


@lru_cache(maxsize=None)
def _reader(codec: str, undefined: str) -> tuple[str, bytes]:
    """The character of each byte under a single-byte codec, and the bytes to leave out."""
    signs, none = [], []
    for b in range(256):
        try:
            signs.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            signs.append("\ufffd" if undefined == "mark" else chr(b))
            none.append(b)
    return "".join(signs), bytes(none) if undefined == "drop" else b""


def _read(data: bytes, codec: str, undefined: str = "keep") -> str:
    signs, out = _reader(codec, undefined)
    return codecs.charmap_decode(data.translate(None, out) if out else data, "strict", signs)[0]


def garbled_forms(word: str, known: frozenset[str] | None = None) -> dict[tuple[str, str], tuple[int, bool, bool]]:
    """All wrong readings of ``word``: (form, chain) -> (rank, strict, lossless), the likelier
    chains first. ``strict`` forms come from UTF-8 bytes and hardly arise by chance; ``lossless`` ones
    lead back to the word. A chain that differs from an earlier one in what it does with bytes that the
    reader doesn't define is left out where there are none. With ``known``, only forms among these words."""
    out: dict[tuple[str, str], tuple[int, bool, bool]] = {}
    rank = 0

    def put(form: str, chain: str, strict: bool, lossless: bool) -> None:
        nonlocal rank
        rank += 1
        if form and form != word and (known is None or form in known):
            out[form, chain] = (rank, strict, lossless)

    for enc in WRITTEN_IN:
        try:
            data = word.encode(enc)
        except UnicodeEncodeError:
            continue
        utf8 = enc == "utf-8"
        for dec in READ_AS:
            if dec == enc:
                continue
            once = _read(data, dec)
            put(once, f"{enc}>{dec}", utf8, True)
            if utf8 and "\xa0" in once:  # the no-break space was later taken for a blank
                put(once.replace("\xa0", ""), f"{enc}>{dec}-blank", False, False)
            if dec in PARTIAL:
                for how in ("drop", "mark"):
                    form = _read(data, dec, how)
                    if form != once:
                        put(form, f"{enc}>{dec}-{how}", utf8, False)
            if utf8:
                again = once.encode("utf-8")
                for dec2 in READ_TWICE_AS:
                    twice = _read(again, dec2)
                    put(twice, f"{enc}>{dec}>utf-8>{dec2}", True, True)
                    if dec2 in PARTIAL:
                        form = _read(again, dec2, "drop")
                        if form != twice:
                            put(form, f"{enc}>{dec}>utf-8>{dec2}-drop", True, False)
                    if dec == dec2 and dec in READ_THRICE_AS:
                        put(_read(twice.encode("utf-8"), dec), f"{enc}>{dec}>utf-8>{dec}>utf-8>{dec}", True, True)
        if utf8:
            put(data.decode("ascii", "replace"), "utf-8>ascii", True, False)
        else:
            form = data.decode("utf-8", "replace")
            put(form, f"{enc}>utf-8", "\ufffd" in form, False)
        if utf8 or enc in READ_AS_PAIRS:
            for dec in READ_AS_PAIRS:
                if dec != enc:
                    form = data.decode(dec, "replace")
                    back = form.encode(dec, "replace") == data
                    # one or two signs of these large sets may stand for themselves
                    put(form, f"{enc}>{dec}", utf8 and len(form) > 2, back)
    return out


def _forms(known: Broadcast | None):
    """Reader of (word, n) that gives the forms of each word, of those ``known`` where they are given."""
    schema = pa.schema(
        [("form", pa.string()), ("word", pa.string()), ("n_word", pa.int64()), ("chain", pa.string()),
         ("rank", pa.int32()), ("strict", pa.bool_()), ("lossless", pa.bool_())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_known = known.value if known is not None else None
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(words), 500):
                rows = [
                    (form, w, n, chain, *how)
                    for w, n in zip(words[at : at + 500], counts[at : at + 500])
                    for (form, chain), how in garbled_forms(w, words_known).items()
                ]
                cols = list(zip(*rows)) if rows else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)

    return read


def words_of(text: Column) -> Column:
    """Distinct words with a sign outside printable ASCII, each also without ASCII punctuation at its ends."""
    raw = F.filter(F.split(text, WORD_BREAK), lambda w: w.rlike(r"[^\x20-\x7e]"))
    bare = F.transform(raw, lambda w: F.regexp_replace(w, _EDGE, ""))
    return F.array_distinct(F.concat(raw, bare))


def with_words(texts: DataFrame, *keep: str) -> DataFrame:
    """(src, doc_id, pos, word) of texts(src, doc_id, pos, text)."""
    return texts.where(F.col("text").rlike(r"[^\x20-\x7e]")).select(
        "src", "doc_id", "pos", *keep, F.explode(words_of(F.col("text"))).alias("word")
    )


def garbled_words(words: DataFrame) -> DataFrame:
    """(form, word, chain, lossless, strict, rank, n_word, again): the corpus' garbled words with their
    possible originals. ``again`` marks originals that are garbled words themselves.

    words(word) holds one row per occurrence. The result is written to the shared folder; its
    size follows the number of distinct damaged words, not the number of texts.
    """
    counts = materialize(words.groupBy("word").agg(F.count("*").alias("n")), "p1-words")
    n_words = counts.count()
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, n_words // WORDS_A_TASK)
    # a word has hundreds of forms, few of which occur: the words are spread and, unless they are too many, go along
    # with every task, so that only forms that occur leave it
    sc = words.sparkSession.sparkContext
    known = sc.broadcast(frozenset(counts.select("word").toArrow().column(0).to_pylist())) if n_words <= BROADCAST_WORDS else None
    forms = counts.select("word", "n").repartition(tasks, "word").mapInArrow(_forms(known), FORM_SCHEMA)
    seen = broadcast_if_small(counts.select(F.col("word").alias("form"), F.col("n").alias("n_form")), BROADCAST_WORDS, n_words)
    hits = forms.join(seen, "form").where(
        F.col("strict")
        | (F.col("n_form") * F.when(F.length("form") <= 2, RARITY_SHORT).otherwise(RARITY) <= F.col("n_word"))
    )
    hits = materialize(hits, "p1-hits")
    # one or two signs prove little: their chain must have garbled longer words as well
    short = (F.length("form") <= 2) & ~F.col("strict")
    likeliest = hits.where(F.length("form") > 2).groupBy("form", "word").agg(F.min_by("chain", "rank").alias("chain"))
    at_work = likeliest.select("chain").distinct()
    at_work = materialize(at_work, "p1-chains")
    hits = hits.where(~short).unionByName(hits.where(short).join(broadcast_if_small(at_work, BROADCAST_WORDS), "chain", "left_semi").select(*hits.columns))
    damaged = hits.select(F.col("form").alias("word")).distinct().withColumn("again", F.lit(1))
    return hits.join(damaged, "word", "left")


def text_pieces(spans: DataFrame, reports: DataFrame) -> DataFrame:
    """texts(src, doc_id, pos, text) of span texts and of the reasons in quality reports."""
    a = spans.select(F.lit("span").alias("src"), "doc_id", F.col("span_idx").alias("pos"), "text")
    pages = reports.select("doc_id", F.explode("reasons_by_page").alias("pos", "reasons"))
    b = pages.select(F.lit("report").alias("src"), "doc_id", "pos", F.explode("reasons").alias("text"))
    return a.unionByName(b)


def find_garbled(texts: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Distinct (src, doc_id, pos) of the texts that hold a garbled word.

    texts(src, doc_id, pos, text); null and empty texts give nothing; repeated rows give one.
    ``vocabulary`` may hold more texts from which clean words are learnt.
    """
    occurrences = with_words(texts)
    pool = occurrences if vocabulary is None else with_words(vocabulary)
    bad = materialize(garbled_words(pool.select("word")).select(F.col("form").alias("word")).distinct(), "p1-bad")
    hit = occurrences.join(broadcast_if_small(bad, BROADCAST_WORDS), "word", "left_semi")
    return hit.select("src", "doc_id", "pos").distinct()


def repair(texts: DataFrame) -> DataFrame:
    """(src, doc_id, pos, text, restored, n_garbled, chains) of the texts with garbled words.

    Where a word has several possible originals, the chain that explains most words of its text
    wins. ``restored`` is null where some word has no sure original. One row per distinct text row.
    """
    key = ["src", "doc_id", "pos", "text"]
    occurrences = with_words(texts.distinct(), "text").withColumnRenamed("word", "form")
    bad = materialize(garbled_words(occurrences.select(F.col("form").alias("word"))), "p1-originals")
    n_bad = bad.count()
    if n_bad <= BROADCAST_WORDS:
        cand = occurrences.join(F.broadcast(bad), "form")
    else:
        # a garbled word may be in a large part of all texts: spread its texts, and repeat its originals
        spread = bad.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        cand = occurrences.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS))).join(spread, ["form", "salt"]).drop("salt")
    same_chain = Window.partitionBy(*key, "chain")
    best = Window.partitionBy(*key, "form").orderBy(
        F.col("again").asc_nulls_first(), F.desc("explained"), F.desc("strict"), F.desc("lossless"), "rank",
        F.desc("n_word"), "word", "chain",
    )
    chosen = (
        cand.withColumn("explained", F.count("*").over(same_chain)).withColumn("rk", F.row_number().over(best)).where("rk = 1")
    )
    per_text = chosen.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("form", "word"))).alias("fixes"),
        F.bool_and("lossless").alias("sure"),
        F.sort_array(F.collect_set("chain")).alias("chains"),
        F.count("*").alias("n_garbled"),
    )
    pieces = F.split("text", r"(?<=[ \t\r\n0-9])|(?=[ \t\r\n0-9])")

    def fixed(piece: Column) -> Column:
        inner = F.regexp_replace(piece, _EDGE, "")
        head = F.regexp_extract(piece, r"^([!-/:-@\[-`{-~]*)", 1)
        tail = F.regexp_extract(piece, r"([!-/:-@\[-`{-~]*)$", 1)
        return F.coalesce(
            F.col("fixes")[piece],
            F.when(inner != "", F.concat(head, F.col("fixes")[inner], tail)),
            piece,
        )

    whole = F.array_join(F.transform(pieces, fixed), "")
    return per_text.select(
        "src", "doc_id", "pos", "text", F.when(F.col("sure"), whole).alias("restored"), "n_garbled", "chains"
    )


#: Chains that ``accuracy`` damages texts by: written in, read as.
TRIALS = (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("utf-8", "gbk"), ("cp1252", "cp850"), ("cp1251", "cp1252"))


def _damage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for no, text in enumerate(batch.column("text").to_pylist()):
            fit = []
            for written, read in TRIALS:
                try:
                    data = text.encode(written)
                except UnicodeEncodeError:
                    continue
                form = data.decode(read, "replace") if read in READ_AS_PAIRS else _read(data, read)
                if form != text:
                    fit.append((no, f"{written}>{read}", form))
            if fit:
                out.append(fit[zlib.crc32(text.encode("utf-8", "replace")) % len(fit)])
        rows, chains, forms = zip(*out) if out else ((), (), ())
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("text").take(at), pa.array(chains, pa.string()), pa.array(forms, pa.string())], names=["original", "chain", "text"])


def accuracy(texts: DataFrame) -> DataFrame:
    """(chain, n, n_found, n_sure, n_restored): every distinct text of ``texts`` that has no garbled word is damaged
    by one of the ``TRIALS`` that can hold it, chosen by a hash of the text, and repaired among all texts. ``n_found`` counts the damaged
    texts in which damage is seen, ``n_sure`` those with a restored text and ``n_restored`` those whose restored
    text is the original."""
    clean = texts.where(F.col("text").rlike(r"[^\x20-\x7e]")).join(find_garbled(texts), ["src", "doc_id", "pos"], "left_anti").select("text").distinct()
    made = clean.mapInArrow(_damage, "original string, chain string, text string")
    made = materialize(made.select("*", F.xxhash64("chain").alias("doc_id"), F.xxhash64("original").alias("pos")), "p1-trials")
    trial = made.select(F.lit("trial").alias("src"), "doc_id", "pos", "text")
    known = texts.select("src", F.col("doc_id").cast("long"), F.col("pos").cast("long"), "text")
    fixed = repair(known.unionByName(trial)).where("src = 'trial'").select("doc_id", "pos", "text", "restored", F.lit(True).alias("seen"))
    both = made.join(fixed, ["doc_id", "pos", "text"], "left")
    return both.groupBy("chain").agg(
        F.count("*").alias("n"), F.count("seen").alias("n_found"), F.count("restored").alias("n_sure"), F.count_if(F.col("restored") == F.col("original")).alias("n_restored")
    )
