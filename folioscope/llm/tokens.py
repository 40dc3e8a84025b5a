"""Token counts by a public tokenizer, given as a file of byte-pair ranks."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("FOLIOSCOPE_TOKENIZERS", "/opt/tokenizers")
RANKS = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of these ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest piece handed to the tokenizer at once; longer texts are cut at line ends or blanks near it.
PIECE = 100_000
_sent: dict[str, set[str]] = {}


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    if not os.path.exists(path):  # on a machine without the folder, the copy that came with the job
        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> list[str]:
    """Whole text in pieces; a cut is made before a blank that follows a sign which is none, where
    the splitting pattern cuts as well, so the count is that of the text in one piece."""
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut > at + 1 and not (text[cut].isspace() and not text[cut - 1].isspace()):
            cut -= 1
        if cut == at + 1:
            cut = at + PIECE
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def token_count(text: Column | str, path: str = RANKS) -> Column:
    """Number of tokens of the whole text; 0 for null and empty texts. The file of ranks goes along with the job."""
    spark = SparkSession.getActiveSession()
    if spark is not None and os.path.exists(path) and path not in _sent.setdefault(spark.sparkContext.applicationId, set()):
        spark.sparkContext.addFile(path)
        _sent[spark.sparkContext.applicationId].add(path)

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for s in texts:
            yield pd.Series([sum(len(enc.encode_ordinary(x)) for x in pieces(t)) if t else 0 for t in s], dtype="int64")

    return count(text)
