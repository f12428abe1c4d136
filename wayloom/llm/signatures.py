"""One-permutation MinHash with optimal densification (numpy part)."""

from __future__ import annotations

import numpy as np

from wayloom.llm.textvec import fmix

EMPTY = np.uint32(0xFFFFFFFF)


def one_permutation(h: np.ndarray, offs: np.ndarray, bins: int) -> np.ndarray:
    """(texts, bins) least value a bin; one hash of a shingle gives both its bin and its value.

    An empty bin copies the bin that a hash of (bin, attempt) names, at the
    first attempt that meets a filled one (the same attempts for every text).
    Rows of empty texts stay EMPTY.
    """
    n = len(offs) - 1
    sig = np.full(n * bins, EMPTY, np.uint32)
    text = np.repeat(np.arange(n), np.diff(offs))
    spot = text * bins + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(sig, spot, np.minimum(h.astype(np.uint32), EMPTY - np.uint32(1)))
    sig = sig.reshape(n, bins)
    filled = sig != EMPTY
    todo_r, todo_c = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    out, attempt = sig.copy(), 0
    while len(todo_r):
        attempt += 1
        mixed = fmix(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))
        source = (mixed % np.uint64(bins)).astype(np.int64)[todo_c]
        hit = filled[todo_r, source]
        out[todo_r[hit], todo_c[hit]] = sig[todo_r[hit], source[hit]]
        todo_r, todo_c = todo_r[~hit], todo_c[~hit]
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """(texts, bins / rows) int64 keys; the band's number is mixed in."""
    n, bins = sig.shape
    parts = sig.reshape(n, bins // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bins // rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for j in range(rows):
        key = fmix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, j] + np.uint64(j + 1))
    return key.view(np.int64)
