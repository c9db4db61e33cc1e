"""Vectorised tokenising for Arrow batches: words, dictionary codes, per-document sums."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a Python worker.
CHUNK_BYTES = 8_000_000


@dataclass
class Words:
    """Words of a block of texts. codes index vocab; document i owns codes[offsets[i]:offsets[i + 1]]."""

    codes: np.ndarray
    offsets: np.ndarray
    vocab: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece stay below ``limit`` bytes (or are one row)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _texts(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "")


def split_words(texts: pa.Array, lower_ascii: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text (null: none) and their offsets."""
    texts = _texts(texts)
    if lower_ascii:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))]).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.asarray(full.to_numpy(zero_copy_only=False), dtype=bool)
    if not kept.all():
        flat = flat.filter(full)
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets].astype(np.int64)
    return flat, offsets


def encode_words(texts: pa.Array, lower_ascii: bool = False) -> Words:
    flat, offsets = split_words(texts, lower_ascii)
    coded = flat.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets, coded.dictionary)


def raw(array: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a string array without nulls, and where each value starts and ends in them; nothing is copied."""
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, kind)
    return memoryview(data) if data is not None else memoryview(b""), ends


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each document's stretch of ``values`` (1-d or 2-d), empty stretches included."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=np.float64)
    return out


def owners(offsets: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; x is uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_ngrams(vocab: pa.Array, orders: range, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte n-grams of each word with a boundary mark on both sides, hashed to ``bits`` bits.

    Returns (word index, bucket) pairs. N-grams never span two words. Orders start at 2.
    """
    if not len(vocab):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = np.frombuffer(b" " + " ".join(vocab.to_pylist()).encode() + b" ", dtype=np.uint8)
    space = joined == 32
    owner = np.cumsum(space, dtype=np.int32) - 1
    wide = joined.astype(np.uint32) + np.uint32(1)
    who, what = [], []
    for n in orders:
        m = len(joined) - n + 1
        if m <= 0:
            continue
        h = wide[:m] * np.uint32(0x9E3779B1) + np.uint32(n)
        inner = np.zeros(m, bool)
        for j in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + wide[j : j + m]
            if j < n - 1:
                inner |= space[j : j + m]
        if n == 2:
            inner = space[:m] & space[1:]
        keep = np.flatnonzero(~inner)
        h = h[keep] * np.uint32(0xC2B2AE3D)
        who.append(owner[keep])
        what.append(((h ^ (h >> np.uint32(16))) >> np.uint32(32 - bits)).astype(np.int32) if bits < 32 else h)
    return np.concatenate(who), np.concatenate(what)


def vocab_sums(vocab: pa.Array, orders: range, bits: int, weights: np.ndarray, slice_words: int = 60_000) -> tuple[np.ndarray, np.ndarray]:
    """For each word the sum of its n-grams' rows of ``weights`` and their number."""
    width = weights.shape[1]
    sums, number = np.zeros((len(vocab), width), np.float32), np.zeros(len(vocab), np.int64)
    for a in range(0, len(vocab), slice_words):
        part = vocab.slice(a, slice_words)
        who, what = byte_ngrams(part, orders, bits)
        number[a : a + len(part)] = np.bincount(who, minlength=len(part))
        for k in range(width):
            sums[a : a + len(part), k] = np.bincount(who, weights=weights[:, k][what], minlength=len(part))
    return sums, number
