"""Problem 7: evaluation passages inside training documents.

Spaced seeds: a window of ``SPAN`` words is hashed under fixed masks that leave some positions
out, so a hash survives a changed word. Hashes of the evaluation items are joined with those of all
documents, whatever the number of documents a hash is in, and every pair with enough of an item's
words under hits is verified by local alignment, which tolerates changed, missing and added words
and letters. Whether a document holds an item depends on its own text and the items alone, not on
how many other documents hold parts of it.

Boilerplate is told by the items: a run of words in at least ``SHARED_ITEMS`` items of different text
says of none of them that it leaked, so it speaks for no pair. Items that consist of such runs by half or
more are versions of one another; their runs count in full.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import broadcast_if_small, materialize

#: Masks over a window of eight words; 1 marks the words that are hashed.
MASKS = ("11101011", "11011101", "10110111", "11110110")
SPAN = 8
#: Items of fewer words than a window are found where all their words stand in a row; items below
#: this many words are quotes of a few words wherever they stand, and give nothing.
FEWEST = 3
#: Evaluation seeds up to which they go along with the tasks that read documents and are broadcast in
#: the join; beyond it every seed of every document is shuffled.
BROADCAST_SEEDS = 1_000_000
#: Evaluation items (with their words) and pairs up to which they are broadcast.
BROADCAST_ITEMS, BROADCAST_PAIRS = 20_000, 200_000
#: Tasks that a seed's documents are spread over where seeds are too many to broadcast.
SALTS = 16
#: Pairs that one task aligns.
PAIRS_A_TASK = 20_000
#: Words of a document that are aligned at a time, and cells of one step over a batch of documents.
BLOCK, CELLS = 4096, 60_000
#: Words of an item that are aligned at a time; longer items are held by their parts.
LONGEST = 12_000
#: Items of different text that make a shared run of words boilerplate, and the part of an item's words
#: in such runs from which they count all the same.
SHARED_ITEMS, SHARED_SHARE = 3, 0.5
#: Part of an item's words under seed hits (outside boilerplate) from which a pair is verified.
CANDIDATE_SHARE = 0.18
#: Part of an item's words that must be held, in at most two passages of at least PASSAGE words.
HELD_SHARE, PASSAGE = 1 / 3, 6


def words_of(text: Column) -> Column:
    """Words in lower case, letters and digits only; words cut by a hyphen at a line end are joined,
    and digits are read as the letters that scans take them for."""
    whole = F.regexp_replace(F.lower(text), r"(\p{L})-[ \t]*\r?\n[ \t]*(\p{L})", "$1$2")
    return F.regexp_extract_all(F.translate(whole, "015", "ols"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


# ---------------------------------------------------------------- seeds


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _seeds(codes: np.ndarray, ends: np.ndarray, at: np.ndarray, positions: tuple[int, ...], salt: int, length: int, known: np.ndarray | None):
    """(seed, row, at) of the windows of ``length`` words under one mask. ``codes`` are the hashes of
    all words of all texts, ``at`` each word's place in its text and ``ends`` the end of its text;
    with ``known``, only windows all of whose hashed words are known."""
    starts = np.nonzero(ends - np.arange(len(codes)) >= length)[0]
    if known is not None:
        for p in positions:
            starts = starts[known[starts + p]]
    h = np.full(len(starts), salt + 1, np.uint64)
    for p in positions:
        h = _mixed(h * np.uint64(0x100000001B3) + codes[starts + p].astype(np.uint64))
    return h.astype(np.int64), starts, at[starts]


def _flat(column: pa.Array):
    """(hashes of all words, row of each word, place in its row, end of its row) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    codes = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.repeat(np.arange(len(sizes)), sizes)
    last = np.cumsum(sizes)
    return codes, rows, np.arange(len(codes)) - np.repeat(last - sizes, sizes), np.repeat(last, sizes)


_MASKED = [(tuple(i for i, m in enumerate(mask) if m == "1"), no, SPAN) for no, mask in enumerate(MASKS)]


def _whole(n: int) -> tuple[tuple[int, ...], int, int]:
    return tuple(range(n)), 100 + n, n


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, n_words, seed, at) of (item_id, codes)."""
    for batch in batches:
        codes, rows, at, ends = _flat(batch.column(1))
        sizes = np.bincount(rows, minlength=batch.num_rows)
        for positions, salt, length in [*_MASKED, *map(_whole, range(FEWEST, SPAN))]:
            seed, start, place = _seeds(codes, ends, at, positions, salt, length, None)
            if length < SPAN:
                short = sizes[rows[start]] == length
                seed, start, place = seed[short], start[short], place[short]
            row = rows[start]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(sizes[row], pa.int32()), pa.array(seed), pa.array(place, pa.int32())],
                names=["item_id", "n_words", "seed", "at"],
            )


def _document_seeds(words: np.ndarray | None, seeds: np.ndarray | None, short: list[int]):
    """Reader of (doc_id, codes) that gives (doc_id, seed): each document's seeds that occur in an item,
    or all of them where the items' sorted ``words`` and ``seeds`` are too many to go along."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, rows, at, ends = _flat(batch.column(1))
            known = None if words is None else _among(codes, words)
            found, where = [], []
            for positions, salt, length in [*_MASKED, *map(_whole, short)]:
                seed, start, _ = _seeds(codes, ends, at, positions, salt, length, known)
                if seeds is not None:
                    hit = _among(seed, seeds)
                    seed, start = seed[hit], start[hit]
                found.append(seed)
                where.append(rows[start])
            seed, row = np.concatenate(found), np.concatenate(where)
            order = np.lexsort((seed, row))
            seed, row = seed[order], row[order]
            new = np.ones(len(seed), bool)
            new[1:] = (seed[1:] != seed[:-1]) | (row[1:] != row[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[new])), pa.array(seed[new])], names=["doc_id", "seed"])

    return read


def _among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_, values)
    at[at == len(sorted_)] = 0
    return sorted_[at] == values


# ---------------------------------------------------------------- alignment

# A cell of the alignment is one number: score, words held, and where in the item and in the document
# the alignment began, from the high bits to the low ones. The larger number is the better alignment.
_HELD, _ROW, _SCORE = 31, 17, 45
_LOW = (1 << 14) - 1
_MATCH, _LIKE, _MISS = (2 << _SCORE) + (1 << _HELD), (1 << _SCORE) + (1 << _HELD), -(2 << _SCORE)


def _passages(item: np.ndarray, like: dict[int, list[int]], docs: np.ndarray, lo_i: np.ndarray, hi_i: np.ndarray) -> np.ndarray:
    """Best local alignment of the item with each row of ``docs`` (word codes, -1 beyond the end), using
    the item's words from lo_i to hi_i: rows of (words held, item from, item to, document from, document to).
    Match 2 (like words 1), mismatch -2, gap -2; each row of the item is one step for all documents."""
    n_docs, m = docs.shape
    places = np.arange(m + 1, dtype=np.int64)
    gaps = (2 * places) << _SCORE
    last = np.broadcast_to(places, (n_docs, m + 1)).copy()
    best, best_i, best_j = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    for i in range(int(lo_i.min(initial=0)), int(hi_i.max(initial=0))):
        code = item[i]
        same = docs == code
        step = np.where(same, _MATCH, _MISS)
        for other in like.get(int(code), ()):
            step[docs == other] = _LIKE
        step[(i < lo_i) | (i >= hi_i)] = _MISS
        start = places + ((i + 1) << _ROW)
        row = last - (2 << _SCORE)
        np.maximum(row[:, 1:], last[:, :-1] + step, out=row[:, 1:])
        np.maximum(row, start, out=row)
        row += gaps
        np.maximum.accumulate(row, axis=1, out=row)
        row -= gaps
        np.copyto(row, start, where=row < (1 << _SCORE))
        top = row.max(axis=1)
        more = top > np.maximum(best, (1 << _SCORE) - 1)
        if more.any():
            best[more], best_i[more] = top[more], i + 1
            best_j[more] = row[more].argmax(axis=1)
        last = row
    found = best > 0
    out = np.stack([(best >> _HELD) & _LOW, (best >> _ROW) & _LOW, best_i, best & ((1 << _ROW) - 1), best_j], axis=1)
    out[~found] = 0
    return out


def _blocks(length: int, n: int) -> list[tuple[int, int]]:
    """Blocks that overlap by more than an alignment of the item can span (each of its words pays for
    at most one gap)."""
    overlap = 4 * n
    return [(at, min(length, at + BLOCK + overlap)) for at in range(0, max(1, length - overlap), BLOCK)]


def _best(item: np.ndarray, like: dict, docs: list[np.ndarray], bounds: np.ndarray) -> np.ndarray:
    """The best passage of each document, over blocks of any number; ``bounds`` has rows of item from,
    item to, document from, document to."""
    out = np.zeros((len(docs), 5), np.int64)
    parts = []
    for d, (lo_i, hi_i, lo_j, hi_j) in enumerate(bounds.tolist()):
        if hi_i - lo_i >= PASSAGE and hi_j - lo_j >= PASSAGE:
            parts += [(b - a, d, lo_j + a, lo_j + b) for a, b in _blocks(hi_j - lo_j, len(item))]
    parts.sort()
    at = 0
    while at < len(parts):
        size = 1
        while at + size < len(parts) and (size + 1) * parts[at + size][0] <= CELLS:
            size += 1
        group = parts[at : at + size]
        width = group[-1][0]
        table = np.full((size, width), -1, np.int32)
        for r, (w, d, a, b) in enumerate(group):
            table[r, :w] = docs[d][a:b]
        which = np.array([d for _, d, _, _ in group])
        got = _passages(item, like, table, bounds[which, 0], bounds[which, 1])
        for r, (_, d, a, _) in enumerate(group):
            if got[r, 0] > out[d, 0]:
                out[d] = got[r] + np.array([0, 0, 0, a, a])
        at += size
    return out


class _Likeness:
    """Words of an item by what is left when a letter is taken out or overlooked."""

    def __init__(self, words: list[str]):
        self.words: dict[str, list[str]] = defaultdict(list)
        for w in words:
            if len(w) >= 4:
                for key in _variants(w):
                    self.words[key].append(w)

    def of(self, word: str) -> set[str]:
        """Words of the item that differ from ``word`` by one letter, both of four letters or more."""
        out: set[str] = set()
        if len(word) >= 4:
            for key in _variants(word):
                if key in self.words:
                    out.update(self.words[key])
        return out


def _variants(word: str) -> list[str]:
    """The word itself as the longer or shorter one, without each letter, and with each overlooked."""
    cut = [word[:k] + word[k + 1 :] for k in range(len(word))]
    return [f"={word}", *(f"={c}" for c in cut), *(f"{word[:k]}\0{word[k + 1 :]}" for k in range(len(word)))]


def is_like(a: str, b: str) -> bool:
    """One letter differs, is missing or was added, in words of four letters or more."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def held_in(item: list[str], docs: list[list[str]]) -> list[tuple[int, int]]:
    """(words of the item held in its order, passages used) of each document."""
    if len(item) < SPAN:
        return [(len(item), 1) if _stands_in(item, d) else (0, 0) for d in docs]
    if len(item) > LONGEST:
        parts = [held_in(item[a : a + LONGEST], docs) for a in range(0, len(item), LONGEST)]
        return [(sum(h for h, _ in p), max(u for _, u in p)) for p in zip(*parts)]
    codes: dict[str, int] = {}
    a = np.array([codes.setdefault(w, len(codes)) for w in item], np.int32)
    known = len(codes)
    arrays = [np.array([codes.setdefault(w, len(codes)) for w in d], np.int32) for d in docs]
    near, like = _Likeness(list(codes)[:known]), defaultdict(list)
    for w, code in list(codes.items())[known:]:
        for v in near.of(w):
            if is_like(v, w):
                like[codes[v]].append(code)
    n, ends = len(a), np.array([len(d) for d in arrays], np.int64)
    zero = np.zeros(len(docs), np.int64)
    first = _best(a, like, arrays, np.stack([zero, zero + n, zero, ends], axis=1))
    held, used = first[:, 0], (first[:, 0] >= PASSAGE).astype(int)
    before = np.stack([zero, first[:, 1], zero, first[:, 3]], axis=1)
    after = np.stack([first[:, 2], zero + n, first[:, 4], ends], axis=1)
    before[used == 0] = after[used == 0] = 0
    second = np.maximum(_best(a, like, arrays, before)[:, 0], _best(a, like, arrays, after)[:, 0])
    more = second >= PASSAGE
    total = np.where(used == 1, held, 0) + np.where(more, second, 0)
    return [(int(t), int(u)) for t, u in zip(total, used + more)]


def _stands_in(item: list[str], doc: list[str]) -> bool:
    n = len(item)
    return n > 0 and any(doc[k] == item[0] and doc[k : k + n] == item for k in range(len(doc) - n + 1))


def held_words(item: list[str], doc: list[str]) -> tuple[int, int]:
    return held_in(item, [doc])[0]


_VERIFIED = "doc_id long, item_id long, n_words int, n_covered int, held int, passages int"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aligns an item with all its documents of a batch at once; equal texts are aligned once."""
    for batch in batches:
        by_item: dict[int, list[int]] = defaultdict(list)
        for k, item_id in enumerate(batch.column("item_id").to_pylist()):
            by_item[item_id].append(k)
        held, used = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
        items, docs = batch.column("item_words"), batch.column("doc_words")
        for rows in by_item.values():
            item = items[rows[0]].as_py()
            texts: dict[tuple, list[int]] = defaultdict(list)
            for k in rows:
                texts[tuple(docs[k].as_py())].append(k)
            for (h, u), same in zip(held_in(item, [list(t) for t in texts]), texts.values()):
                held[same], used[same] = h, u
        kept = [batch.column(c) for c in ("doc_id", "item_id", "n_words", "n_covered")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(held), pa.array(used)], names=["doc_id", "item_id", "n_words", "n_covered", "held", "passages"]
        )


# ---------------------------------------------------------------- operator


def _codes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _covered(ats: Column | str, n_words: Column) -> Column:
    """Words of the item under windows that begin at ``ats``."""
    width = F.least(n_words, F.lit(SPAN))
    return F.size(F.array_distinct(F.flatten(F.transform(ats, lambda a: F.sequence(a, a + width - 1)))))


def telling_seeds(seeds: DataFrame, evals: DataFrame) -> DataFrame:
    """The rows of seeds(item_id, n_words, seed, at) outside boilerplate."""
    texts = evals.select("item_id", F.xxhash64("item_words").alias("same"))
    shared = seeds.join(texts, "item_id").groupBy("seed").agg(F.countDistinct("same").alias("n_texts")).where(F.col("n_texts") >= SHARED_ITEMS)
    common = seeds.join(shared.select("seed"), "seed")
    part = common.groupBy("item_id", "n_words").agg(F.collect_set("at").alias("ats"))
    partly = part.where(_covered("ats", F.col("n_words")) < SHARED_SHARE * F.col("n_words")).select("item_id")
    return seeds.join(common.join(partly, "item_id", "left_semi").select("item_id", "seed").distinct(), ["item_id", "seed"], "left_anti")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered, held, passages) of all verified candidate pairs, whatever their share.

    documents(doc_id, text), items(item_id, text); null and empty texts give nothing; repeated rows
    of either side give one pair, and of several texts under one doc_id the one that holds most counts.
    Items of fewer than eight words are held where all their words stand in a row; items of one or
    two words give nothing. Of several texts under one item_id the first in order is the item.
    """
    spark = documents.sparkSession
    docs = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    evals = items.where("text IS NOT NULL").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    evals = materialize(evals.select("item_id", words_of(F.col("text")).alias("item_words")), "p7-items")
    n_items = evals.count()
    seeds = evals.select("item_id", _codes(F.col("item_words")).alias("codes")).mapInArrow(
        _item_seeds, "item_id long, n_words int, seed long, at int"
    )
    seeds = materialize(telling_seeds(materialize(seeds, "p7-seeds"), evals).select("item_id", "n_words", "seed", "at"), "p7-telling")
    n_seeds = seeds.count()
    small = n_seeds <= BROADCAST_SEEDS
    words = known = None
    if small:
        words, known = (
            np.sort(np.array(df.toArrow().column(0).to_numpy(), np.int64))
            for df in (evals.select(F.explode(_codes(F.col("item_words")))).distinct(), seeds.select("seed").distinct())
        )
    short = [r.n_words for r in seeds.where(F.col("n_words") < SPAN).select("n_words").distinct().collect()]  # five at most
    hits = docs.select("doc_id", _codes(words_of(F.col("text"))).alias("codes")).mapInArrow(
        _document_seeds(words, known, sorted(short)), "doc_id long, seed long"
    )
    if small:
        joined = hits.join(F.broadcast(seeds), "seed")
    else:
        # a seed may be in a third of all documents: spread its documents, and repeat the item's side
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
        spread = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = hits.withColumn("salt", salt).join(spread, ["seed", "salt"])
    covered = _covered("ats", F.col("n_words"))
    pairs = (
        joined.groupBy("doc_id", "item_id", "n_words").agg(F.collect_set("at").alias("ats"))
        .select("doc_id", "item_id", "n_words", covered.cast("int").alias("n_covered"))
        .where(F.col("n_covered") >= CANDIDATE_SHARE * F.col("n_words"))
    )
    pairs = materialize(pairs, "p7-pairs")
    n_pairs = pairs.count()
    with_items = pairs.join(broadcast_if_small(evals, BROADCAST_ITEMS, n_items), "item_id")
    held = docs.join(broadcast_if_small(pairs.select("doc_id").distinct(), BROADCAST_PAIRS, n_pairs), "doc_id", "left_semi")
    held = held.distinct().select("doc_id", words_of(F.col("text")).alias("doc_words"))
    # pairs of one item lie together so that they are aligned together, but no more of them than a task should have
    parts = max(1, n_pairs // PAIRS_A_TASK)
    tasks = max(spark.sparkContext.defaultParallelism, parts)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    joined = with_items.join(held, "doc_id").repartition(tasks, "item_id", part).sortWithinPartitions("item_id")
    verified = joined.select("doc_id", "item_id", "n_words", "n_covered", "item_words", "doc_words").mapInArrow(_verify, _VERIFIED)
    most = F.max(F.struct("held", "passages", "n_covered")).alias("m")
    return verified.groupBy("doc_id", "item_id", "n_words").agg(most).select("doc_id", "item_id", "n_words", "m.n_covered", "m.held", "m.passages")


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the document holds at least a third of the item's words."""
    return leaks(documents, items).where(F.col("held") >= HELD_SHARE * F.col("n_words") - 1e-9).select("doc_id", "item_id")
