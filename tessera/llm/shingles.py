"""Hashed word shingles of whole texts, computed on arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Odd, so that its powers have inverses modulo 2**64.
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_STATE: dict = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _MIX[0]
    x = (x ^ x >> np.uint64(27)) * _MIX[1]
    return x ^ x >> np.uint64(31)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_STATE.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            _STATE[name] = p
    return _STATE["up"], _STATE["down"]


def byte_values() -> np.ndarray:
    if "bytes" not in _STATE:
        _STATE["bytes"] = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    return _STATE["bytes"]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of value(raw[k]) * base**k over i <= k < j."""
    up, _ = powers(len(raw) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_values()[raw] * up[: len(raw)], dtype=np.uint64)])


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, where A-Z count as a-z and words stand between ASCII white space."""
    if not raw:
        return np.zeros(0, np.uint64)
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    edge = np.diff(np.concatenate([[True], _SPACE[b], [True]]).astype(np.int8))
    start, stop = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    h = prefix_hashes(b)
    _, down = powers(len(b) + 1)
    return mixed((h[stop] - h[start]) * down[start] + (stop - start).astype(np.uint64))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of strings, one after another, and where each begins (and the last ends). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words_of(raw: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() of the texts raw[at[i]:at[i + 1]] together, and where each text's begin (and the last's end). Unless `lower`, case counts."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    b = _LOWER[raw] if lower else raw
    inside = ~_SPACE[b]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(b))]
    begins[edge], ends[edge - 1] = inside[edge], inside[edge - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = prefix_hashes(b)
    _, down = powers(len(b) + 1)
    return mixed((h[stop] - h[start]) * down[start] + (stop - start).astype(np.uint64)), np.searchsorted(start, at)


def sets_of(column: pa.Array, k: int, piece: int = 1 << 18) -> Iterator[np.ndarray]:
    """shingles() of each text of a column, computed for about `piece` bytes of texts at once."""
    raw, at = texts_of(column)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + piece, "right")) - 1)
        w, cut = words_of(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        n = len(w) - k + 1
        if n > 0:
            x = np.full(n, k, np.uint64)
            for o in range(k):
                x = mixed(x * np.uint64(_BASE) + w[o : o + n])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a < k:
                yield joined(w[a:b], k)
                continue
            g = np.sort(x[a : b - k + 1])
            yield g[np.concatenate([[True], g[1:] != g[:-1]])]
        i = j


def shingles(raw: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of fewer words, that of all; of none, none."""
    return joined(word_hashes(raw), k)


def joined(w: np.ndarray, k: int) -> np.ndarray:
    """The same of word hashes."""
    if not len(w):
        return w
    n = max(1, len(w) - k + 1)
    x = np.full(n, len(w) if len(w) < k else k, np.uint64)
    for i in range(min(k, len(w))):
        x = mixed(x * np.uint64(_BASE) + w[i : i + n])
    return np.unique(x)
