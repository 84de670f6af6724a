"""Text to vectors: hashed terms, and model plug-ins chosen by name."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F, types as T

from abstracta.schema import TERM

TERM_BUCKETS = 4096
# Fixed pattern: what separates two tokens of lower-cased text.
TOKEN_SEPARATOR = r"[^\p{L}\p{N}]+"
_SLICE_BYTES = 2 * 1024 * 1024


def hashed_tokens(texts: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of each token, bucket of each token) for a batch of texts, repeats included.

    A token is a lower-cased run of letters and digits; its bucket is the first 32 bits of
    its md5, modulo ``dim``. Each distinct token of the batch is hashed once.
    """
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), TOKEN_SEPARATOR)
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    digests = b"".join([hashlib.md5(word).digest() for word in words])
    buckets = (np.frombuffer(digests, ">u4")[::4] % dim).astype(np.int64)
    codes = coded.indices.to_numpy()
    # Separators at the ends of a text leave empty pieces.
    filled = np.array([bool(word) for word in words], bool)[codes]
    return rows[filled], buckets[codes[filled]]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive slices of a batch with a bounded amount of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + _SLICE_BYTES, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def _terms(texts: pa.Array, dim: int) -> pa.Array:
    """Sparse vectors ``list<struct<bucket, weight>>``, buckets ascending in each row."""
    parts = [_slice_terms(part, dim) for part in _slices(texts)]
    return pa.concat_arrays(parts) if parts else _slice_terms(texts, dim)


def _slice_terms(texts: pa.Array, dim: int) -> pa.Array:
    rows, buckets = hashed_tokens(texts, dim)
    cells, counts = np.unique(rows * dim + buckets, return_counts=True)
    per_row = np.bincount(cells // dim, minlength=len(texts))
    offsets = np.r_[0, np.cumsum(per_row)].astype(np.int32)
    terms = pa.StructArray.from_arrays(
        [pa.array((cells % dim).astype(np.int32)), pa.array(counts.astype(np.float64))], ["bucket", "weight"]
    )
    return pa.ListArray.from_arrays(pa.array(offsets), terms)


def evaluated_once(function):
    """Keep a costly function from being copied into filters that Spark infers and pushes down.

    Such a filter (not NULL, not empty) would call the function a second time; Spark leaves
    functions marked as non-deterministic where they are.
    """
    return function.asNondeterministic()


def embed_text(docs: DataFrame, text: str, dim: int = TERM_BUCKETS, name: str = "terms") -> DataFrame:
    """Add the sparse vector of ``text`` as ``array<struct<bucket, weight>>``.

    All terms of a row are in the row, so they are counted where the row lies: no explode,
    no shuffle. NULL text gives an empty vector.
    """

    @F.arrow_udf(T.ArrayType(TERM))
    def terms(texts: pa.Array) -> pa.Array:
        return _terms(texts, dim)

    return docs.withColumn(name, evaluated_once(terms)(text))


def explode_terms(embedded: DataFrame, *keep: str, terms: str = "terms") -> DataFrame:
    """Sparse vectors in long form: ``(keep..., bucket, weight)``."""
    return embedded.select(*keep, F.inline(terms))


@dataclass(frozen=True)
class EmbeddingModel:
    """A dense model: ``load()`` runs once per Python worker and returns a batch function
    from an array of texts to an array of shape ``(n, dim)``."""

    name: str
    dim: int
    load: Callable[[], Callable[[np.ndarray], np.ndarray]]
    batch_size: int = 1024
    needs_key: bool = False


_MODELS: dict[str, EmbeddingModel] = {}


def register_model(model: EmbeddingModel) -> EmbeddingModel:
    _MODELS[model.name] = model
    return model


def get_model(name: str, api_key: str = "") -> EmbeddingModel:
    """Look a model up; unknown names and a missing key of a gated model are errors."""
    if name not in _MODELS:
        raise ValueError(f"Unknown model: {name}")
    model = _MODELS[name]
    if model.needs_key and not api_key.strip():
        raise ValueError(f"Model {name} needs an API key")
    return model


def embedding_function(model: EmbeddingModel) -> Callable[[Column | str], Column]:
    """Column function that applies a registered model in Arrow batches."""
    return evaluated_once(
        predict_batch_udf(model.load, return_type=T.ArrayType(T.FloatType()), batch_size=model.batch_size)
    )


def hashed_dense_model(dim: int) -> EmbeddingModel:
    """Built-in dense model: hashed term counts scaled to unit length."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        def embed(texts: np.ndarray) -> np.ndarray:
            rows, buckets = hashed_tokens(pa.array(texts, pa.string()), dim)
            counts = np.bincount(rows * dim + buckets, minlength=len(texts) * dim).reshape(-1, dim)
            lengths = np.sqrt((counts.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
            return np.divide(counts, lengths, out=np.zeros(counts.shape), where=lengths > 0)

        return embed

    return EmbeddingModel(f"hashed-{dim}", dim, load)
