"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public vocabularies, and the rank file used unless another is asked for.
TOKENIZER_DIR = "/opt/tokenizers"
RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Fixed value, from the vocabulary's public description: the pattern that splits text before the merges.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are encoded in stretches of about this many characters, so that no call grows with a text.
STRETCH = 50_000
# after a letter before what is none, or a number before what is none, the pattern always ends a piece
_PIECE_END = regex.compile(r"\p{L}(?=\P{L})|\p{N}(?=\P{N})")


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """Cuts a long text only where the pattern cuts too, so the tokens of the stretches are those of the text.

    A stretch is longer than the size where one piece of the pattern is.
    """
    at = 0
    while len(text) - at > size and (m := _PIECE_END.search(text, at + size - 1)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def token_count(text: Column, path: str = f"{TOKENIZER_DIR}/{RANK_FILE}") -> Column:
    """Tokens of a text; 0 for an empty one, null for null. path: a rank file in every worker's file system, else an error.

    Counting costs far more than a comparison, so Spark is told not to repeat it for a filter on the count.
    """

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoding(path)
        for s in batches:
            yield pd.Series([None if t is None else sum(len(e.encode_ordinary(x)) for x in stretches(t)) if len(t) > STRETCH else len(e.encode_ordinary(t)) for t in s], dtype="Int64")

    return count.asNondeterministic()(text)
