"""Vectors of texts. The model is pluggable; the default needs none."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptbook import config
from promptbook.functions.text import prompt

#: A model is made once in each task: it takes texts and gives a matrix with a row for each.
Model = Callable[[], Callable[[list[str]], np.ndarray]]


def hashing_model(dim: int = 64) -> Model:
    """Signed hashed term counts, damped: deterministic, without weights. Its vectors are no language model's."""

    def make():
        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    out[i, h % dim] += 1.0 if h >> 31 else -1.0
            return np.sign(out) * np.log1p(np.abs(out))

        return embed

    return make


def last_token_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The state of the last token of each text: ``states(texts, tokens, dim)``, ``mask(texts, tokens)`` 1 for tokens
    and 0 for padding, which may stand on either side. A text of padding only gives its last state."""
    states, mask = np.asarray(states), np.asarray(mask).astype(bool)
    length = mask.shape[1]
    last = length - 1 - np.argmax(mask[:, ::-1], axis=1)
    return states[np.arange(len(states)), last]


def pooled_model(load: Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray]]]) -> Model:
    """A model from one that gives hidden states and mask: its vectors are those of the last tokens."""

    def make():
        states_of = load()
        return lambda texts: last_token_pool(*states_of(texts))

    return make


#: How a text is cut into tokens and put together again: white space by default, a tokenizer's pair otherwise.
Tokens = Callable[[], tuple[Callable[[str], list], Callable[[list], str]]]


def white_space() -> tuple[Callable[[str], list], Callable[[list], str]]:
    return str.split, " ".join


def embed(documents: DataFrame, id_col: str, text_col: str, model: Model | None = None, instruction: str = config.EMBED_INSTRUCTION, max_tokens: int = config.EMBED_MAX_TOKENS, tokens: Tokens = white_space) -> DataFrame:
    """``(id, embedding, n_tokens, truncated)``: the unit vector of each text with its instruction, one row per document.

    Tokens are counted once, by ``tokens`` (the model's own tokenizer, made once in each task; white space by
    default); a text beyond ``max_tokens`` is truncated to them and marked so. A null text has only its instruction.
    """
    make = model or hashing_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, (split, join) = make(), tokens()
        for b in batches:
            texts = b.column(1).to_pylist()
            words = [split(t) for t in texts]
            x = vectors([t if len(w) <= max_tokens else join(w[:max_tokens]) for t, w in zip(texts, words)]).astype(np.float64)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(norm > 0, norm, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())), pa.array([len(w) for w in words], pa.int32()), pa.array([len(w) > max_tokens for w in words], pa.bool_())], names=["id", "embedding", "n_tokens", "truncated"])

    kind = dict(documents.dtypes)[id_col]
    return documents.select(F.col(id_col).alias("id"), prompt(F.col(text_col), instruction).alias("t")).mapInArrow(run, f"id {kind}, embedding array<float>, n_tokens int, truncated boolean")


def run_metadata(embedded: DataFrame, model: str, dim: int, max_tokens: int = config.EMBED_MAX_TOKENS, instruction: str = config.EMBED_INSTRUCTION) -> DataFrame:
    """One row that describes a run, counted from its result."""
    return embedded.agg(F.count("*").alias("n_rows"), F.count_if("truncated").alias("truncated_count")).select(F.lit(model).alias("model"), F.lit(dim).alias("dim"), "n_rows", F.lit(max_tokens).alias("max_tokens"), "truncated_count", F.lit(instruction).alias("instruction"))


