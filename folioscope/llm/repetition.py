"""Problem 9: repetition inside a single document.

The exact measure (share of words inside a run of five words that already began earlier in the
text) is the last rule of a short-circuit cascade. The rules before it are necessary conditions
for a share of at least the threshold, so none can reject a document wrongly. Their cost and
selectivity are measured on a bounded sample, and they run in order of rejection per cost; the
order changes the time only, never the result.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 5
THRESHOLD = 0.35
SAMPLE_ROWS = 256  # documents on which the rules' cost and selectivity are estimated
SAMPLE_CHARS = 20_000  # of each sampled document; the estimate only, never the result


def _letters() -> str:
    """A class of letters only: word signs without digits, the underscore and other numerals."""
    other, low = [], None
    for code in range(0x110000 + 1):
        ch = chr(code) if code < 0x110000 else " "
        numeral = ch.isalnum() and not ch.isalpha()
        if numeral and low is None:
            low = code
        elif not numeral and low is not None:
            other.append(f"{re.escape(chr(low))}-{re.escape(chr(code - 1))}")
            low = None
    return rf"[^\W\d_{''.join(other)}]+"


_WORDS = re.compile(_letters())


class Doc:
    """A text whose words and codes are made at most once, when a rule first needs them."""

    __slots__ = ("text", "_words", "_codes")

    def __init__(self, text: str):
        self.text, self._words, self._codes = text, None, None

    @property
    def words(self) -> list[str]:
        if self._words is None:
            self._words = _WORDS.findall(self.text.lower())
        return self._words

    @property
    def codes(self) -> np.ndarray:
        if self._codes is None:
            seen: dict[str, int] = {}
            self._codes = np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, len(self.words))
        return self._codes


def _ranks(a: np.ndarray) -> np.ndarray:
    return np.unique(a, return_inverse=True)[1].astype(np.int64)


def repeated_words(codes: np.ndarray, run: int = RUN) -> int:
    """Number of words inside a run of ``run`` words that began before. Runs are compared exactly:
    they are ranked by pairs of ranks of shorter runs, without hashing."""
    n = len(codes)
    if n <= run:
        return 0
    grams, length = codes, 1
    while length < run:
        step = min(length, run - length)
        left, right = grams[: n - length - step + 1], grams[step : step + n - length - step + 1]
        grams, length = _ranks(left * (int(grams.max()) + 1) + right), length + step
    first = np.full(int(grams.max()) + 1, -1, np.int64)
    first[grams[::-1]] = np.arange(len(grams) - 1, -1, -1)
    again = np.flatnonzero(first[grams] < np.arange(len(grams)))
    if not len(again):
        return 0
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + run, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def share(text: str | None) -> float:
    if not text:
        return 0.0
    doc = Doc(text)
    return repeated_words(doc.codes) / len(doc.words) if doc.words else 0.0


def _long_enough(doc: Doc, least: float) -> bool:
    """Six words and the signs between them are the least that can repeat a run of five."""
    return len(doc.text) >= 2 * RUN + 1


def _vocabulary(doc: Doc, least: float) -> bool:
    """A repeated word is no first occurrence, so distinct words make up at most the rest."""
    n = len(doc.words)
    return n > RUN and len(set(doc.words)) <= n - least * n + 1e-9


def _pairs(doc: Doc, least: float) -> bool:
    """Repeated words lie in stretches of at least five, which hold at least 4/5 as many pairs,
    all of which began before."""
    n, c = len(doc.words), doc.codes
    if n <= RUN:
        return False
    return len(np.unique(c[:-1] * n + c[1:])) <= (n - 1) - least * n * (RUN - 1) / RUN + 1e-9


def _exact(doc: Doc, least: float) -> bool:
    return len(doc.words) > 0 and repeated_words(doc.codes) >= least * len(doc.words) - 1e-9


RULES: dict[str, Callable[[Doc, float], bool]] = {"long_enough": _long_enough, "vocabulary": _vocabulary, "pairs": _pairs}


def plan_cascade(texts: list[str], least: float = THRESHOLD) -> list[tuple[str, float, float]]:
    """(rule, cost in seconds a document, share rejected), best rejection per cost first."""
    out = []
    for name, rule in RULES.items():
        docs = [Doc(t) for t in texts]
        began = time.perf_counter()
        rejected = sum(not rule(d, least) for d in docs)
        cost = (time.perf_counter() - began) / max(1, len(docs))
        out.append((name, cost, rejected / max(1, len(docs))))
    return sorted(out, key=lambda x: (-(x[2] / max(x[1], 1e-9)), x[0]))


def cascade_for(documents: DataFrame, least: float = THRESHOLD) -> list[tuple[str, float, float]]:
    sample = documents.where("text is not null").select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(SAMPLE_ROWS)
    return plan_cascade([r.text for r in sample.collect()], least)


def find_repetitive(documents: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """Distinct doc_id of documents(doc_id, text) with a repeated share of at least ``least``.
    Null and empty texts, and texts of five words or fewer, are never found."""
    rules = [RULES[name] for name, _, rejected in cascade_for(documents, least) if rejected > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc = Doc(text.as_py())
                if all(rule(doc, least) for rule in rules) and _exact(doc, least):
                    keep.append(doc_id)
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64())], names=["doc_id"])

    rows = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long").distinct()


def measure(documents: DataFrame) -> DataFrame:
    """One row per row of documents(doc_id, text): number of words, words in repeated runs of five
    and their share, and the shares of words in repeated lines and in repeated paragraphs (each
    after its first occurrence). Null texts have no words and shares of 0."""

    def units(text: str, cut: str) -> float:
        seen, again, total = set(), 0, 0
        for part in re.split(cut, text):
            words = tuple(_WORDS.findall(part.lower()))
            total += len(words)
            if words:
                again += len(words) if words in seen else 0
                seen.add(words)
        return again / total if total else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                doc = Doc(text.as_py() or "")
                n = len(doc.words)
                r = repeated_words(doc.codes) if n else 0
                rows.append((n, r, r / n if n else 0.0, units(doc.text, r"\n"), units(doc.text, r"\n\s*\n")))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=["doc_id", "n_words", "n_repeated", "run_share", "line_share", "paragraph_share"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_repeated long, run_share double, line_share double, paragraph_share double"
    )
