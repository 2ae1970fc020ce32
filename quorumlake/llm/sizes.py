"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name of the vocabulary file among the installed public tokenizers, or a path of a file of the same kind.
VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY):
    """A byte-pair encoder without special tokens: their strings in a text are ordinary text."""
    import public_tokenizers as public
    import tiktoken

    path = vocabulary if "/" in vocabulary else public.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space of such a length is a piece by itself: the pattern of the tokenizer can't pass over runs of any length.
_RUN = re.compile(r"(?<=\S)(?=\s{1000})")
_FRONT = re.compile(r"\s{1000,}")


def n_tokens(enc, text: str) -> int:
    """Number of tokens of the whole text, whatever its length.

    The pattern never takes what stands before white space together with it, so a text may be cut there; of a run of white
    space it takes all but the last character before a word, which belongs to what follows."""
    total = 0
    for part in _RUN.split(text) if len(text) > 1000 else [text]:
        if run := _FRONT.match(part):
            end = run.end() - (run.end() < len(part))
            total += len(enc._encode_single_piece(part[:end]))
            part = part[end:]
        total += len(enc.encode_ordinary(part))
    return total


def token_sizes(df: DataFrame, key: str, text: str, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, keep, n_tokens (bigint); null and empty texts have none. Texts are encoded whole, in Arrow batches."""

    @F.pandas_udf("long")
    def size(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary)
        for s in texts:
            yield pd.Series([0 if t is None else n_tokens(enc, t) for t in s], dtype="int64")

    return df.select(F.col(key), *[F.col(k) for k in keep], size(F.col(text)).alias("n_tokens"))
