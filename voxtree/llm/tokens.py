"""Sizes of texts in tokens of a public tokenizer, and where they lie among the others."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: A byte-level BPE vocabulary as ranks: base64 of the bytes and the id on every line.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which that vocabulary's texts were cut into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Buckets that tokens are hashed into, dimensions they are projected to, and bits of each.
BUCKETS, DIMENSIONS, BITS = 256, 4, 12


@cache
def encoder(path: str):
    """The tokenizer of a ranks file, loaded once in a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def _at_hand(path: str) -> str:
    """The ranks file in a worker: in its own folder, or as the driver sent it."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows) with ``bits`` bits a coordinate, by Skilling's
    transposition (AIP Conf. Proc. 707, 381, 2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(set_, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@cache
def _projection() -> np.ndarray:
    return np.random.default_rng(20040707).normal(size=(BUCKETS, DIMENSIONS))


def _hashed(ids: list[int]) -> np.ndarray:
    """Square roots of the counts of hashed tokens."""
    mixed = (np.array(ids, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    return np.sqrt(np.bincount(mixed.astype(np.int64), minlength=BUCKETS))


def _places(vectors: np.ndarray) -> np.ndarray:
    """Places on the curve of vectors (rows); those without tokens have none."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    at = (vectors / np.maximum(length, 1e-12)) @ _projection()
    # a projected unit vector has coordinates of about one: two to each side are enough
    return hilbert_key(np.clip((at + 2) / 4 * (1 << BITS), 0, (1 << BITS) - 1))


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER, curve: bool = False, *keep: str) -> DataFrame:
    """``keep`` columns and n_tokens (0 for null and empty texts); ``curve`` adds ``place``, the text's
    place on the Hilbert curve through its projected vector of hashed tokens (null without tokens)."""
    kept = [c for c in documents.columns if c in keep]
    types = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "n_tokens bigint", *(["place bigint"] if curve else [])])

    if os.path.exists(tokenizer):
        documents.sparkSession.sparkContext.addFile(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(_at_hand(tokenizer)).encode_ordinary
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            vectors = np.zeros((batch.num_rows if curve else 0, BUCKETS), np.float32)
            for i, text in enumerate(batch["text"]):
                ids = encode(text.as_py() or "")
                sizes[i] = len(ids)
                if curve:
                    vectors[i] = _hashed(ids)
            columns = [batch[c] for c in kept] + [pa.array(sizes)] + ([pa.array(_places(vectors), mask=sizes == 0)] if curve else [])
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_tokens", *(["place"] if curve else [])])

    return documents.select(*kept, "text").mapInArrow(run, schema)
