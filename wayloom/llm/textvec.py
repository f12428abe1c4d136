"""Vectorised text primitives shared by the corpus operators.

Arrow hands a string column to Python as one byte buffer plus offsets.  The
helpers below work on those two arrays, so splitting into words and hashing
costs a few numpy passes a byte and no Python object per word.

Conventions: a word is a maximal run of bytes outside ``20 09-0D`` (hex), which
for UTF-8 equals the code point class ``[^\\x20\\x09-\\x0D]``; null texts count
as empty; hashes are 64 bit and depend only on the bytes of a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WS_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_WS = np.zeros(256, dtype=bool)
IS_WS[list(WS_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: A slice holds about so many text bytes; one longer text makes a longer slice.
SLICE_BYTES = 2_000_000

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        _powers[name] = have = np.cumprod(have)
    return have[:n]


def fmix(h: np.ndarray) -> np.ndarray:
    """A 64 bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (n + 1) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    n, kind = len(col), np.int64 if pa.types.is_large_string(col.type) else np.int32
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts."""
    buf, offs = buffers(col)
    n, at = len(offs) - 1, 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, buf[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes) of all words, and the index of each text's first word (n + 1)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    ws = IS_WS[buf]
    on = ~ws
    first, last = on.copy(), on.copy()
    first[1:] &= ws[:-1]
    last[:-1] &= ws[1:]
    full = offs[:-1][offs[1:] > offs[:-1]]
    first[full] = on[full]
    ends = offs[1:][offs[1:] > offs[:-1]] - 1
    last[ends] = on[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64 bit hash a word, from differences of a running polynomial."""
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power("r", _R, len(buf)), out=run[1:])
    h = (run[ends] - run[starts]) * _power("ri", _RINV, len(buf) + 1)[starts]
    return fmix(h + (ends - starts).astype(np.uint64))


def shingle_hashes(h: np.ndarray, woffs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and their bounds by text (n + 1).

    A text with 1 to k - 1 words has its whole sequence as its one shingle.
    """
    n_words = np.diff(woffs)
    count = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    offs = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(count)), count)
    at = woffs[:-1][text] + (np.arange(offs[-1]) - offs[:-1][text])
    out = np.zeros(len(at), np.uint64)
    last = woffs[1:][text]
    short = n_words[text] < k
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    for j in range(k):
        part = fmix(padded[at + j] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        if short.any():
            part = np.where(at + j < last, part, np.uint64(0))
        out += part * np.uint64((0xD6E8FEB86659FD93 * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
    return fmix(out + np.where(short, n_words[text], k).astype(np.uint64)), offs


def sorted_sets(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted without repeats, and the new bounds."""
    out = h.copy()
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[offs[:-1][offs[1:] > offs[:-1]]] = True
    run = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], run[offs]


def string_array(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow string column."""
    size = ends - starts
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    at = np.repeat(starts - offs[:-1], size) + np.arange(offs[-1])
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(buf[at])))


def sum_by(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring bounds; 0 for empty ranges."""
    run = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=run[1:])
    return run[offs[1:]] - run[offs[:-1]]
