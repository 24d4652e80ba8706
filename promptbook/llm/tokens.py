"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files of public tokenizers are; a parameter, never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Where a byte-level BPE cuts a text before merging: the published pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The first sentence or line of a text is its prompt and bears no loss.
PROMPT = re.compile(r"[^\n.!?]*[\n.!?]?")

_loaded: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The tokenizer of the file, loaded once in a worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def _sizes(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            texts = b.column(1).to_pylist()
            total = [len(enc.encode_ordinary(t)) for t in texts]
            prompt = [len(enc.encode_ordinary(PROMPT.match(t).group())) for t in texts]
            loss = [max(0, a - p) for a, p in zip(total, prompt)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int32()), pa.array(loss, pa.int32())], names=["id", "n_tokens", "n_loss"])

    return run


def token_sizes(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY) -> DataFrame:
    """``(id, n_tokens, n_loss)`` of every row with a text; null texts give no row, empty ones have no token."""
    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").mapInArrow(_sizes(path), f"id {kind}, n_tokens int, n_loss int")
