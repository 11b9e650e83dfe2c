"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that tokenizer divides text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, key_cols: list[str], text_col: str, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key_cols`` and ``n_tokens`` (bigint): 0 for null and empty texts. Whole texts are tokenised, however long;
    ``vocabulary`` is the tokenizer file, which every worker must be able to read. One pass without shuffle."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key_cols).schema), "n_tokens bigint"])

    def run(batches):
        encode = encoder(vocabulary).encode_ordinary
        for b in batches:
            out = b[key_cols].copy()
            out["n_tokens"] = [len(encode(t)) if t else 0 for t in b["_text"]]
            yield out

    return df.select(*key_cols, F.col(text_col).alias("_text")).mapInPandas(run, schema)
