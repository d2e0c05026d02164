"""Token counts with public vocabularies read from a folder.

An encoding is mapped to a vocabulary file and the result names the file, so that a count is never taken for that of an
encoding whose vocabulary isn't there. The mapping and the folder are parameters.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"

# The stand-in for each encoding.
VOCABULARIES = {
    "o200k_base": "byte_bpe_multi_50k.tiktoken",
    "cl100k_base": "byte_bpe_50k.tiktoken",
    "p50k_base": "byte_bpe_50k.tiktoken",
    "p50k_edit": "byte_bpe_50k.tiktoken",
    "r50k_base": "byte_bpe_50k.tiktoken",
}

# Fixed value: the public pre-tokenising pattern of these byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_of(encoding: str, vocabularies: dict[str, str] = VOCABULARIES) -> str:
    if encoding not in vocabularies:
        raise ValueError(f"no vocabulary is named for the encoding {encoding!r}")
    return vocabularies[encoding]


@lru_cache(maxsize=8)
def load(vocabulary: str, folder: str = TOKENIZER_DIR):
    """The encoder, once for each Python worker."""
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(texts: list[str | None], vocabulary: str, folder: str = TOKENIZER_DIR) -> list[int]:
    """Tokens of each whole text; 0 for null and empty ones. Strings of special tokens are ordinary text."""
    enc = load(vocabulary, folder)
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def token_counts(df: DataFrame, keep: list[str], vocabularies: list[str], text: str = "text", folder: str = TOKENIZER_DIR) -> DataFrame:
    """The kept columns and one row for each vocabulary: vocabulary, n_tokens."""
    slim = df.select(*keep, F.col(text).alias("_qm_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b.pop("_qm_text").tolist()
            yield pd.concat([b.assign(vocabulary=v, n_tokens=count(texts, v, folder)) for v in vocabularies])

    schema = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInPandas(run, f"{schema}, vocabulary string, n_tokens long")
