"""Words and word shingles of a column of texts, as hashes, in vectorised numpy over Arrow's own buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ._common import chunks

SHINGLE = 5
#: Odd multipliers of the rolling hash and of the words in a shingle.
_RADIX = 0x9E3779B97F4A7C15
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_EXACT = _LOWER.copy()
_LOWER[0x41:0x5B] += np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, held: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  kept between calls
    """The radix and its inverse to the powers 0 to n, modulo 2**64."""
    if n not in held:
        held.clear()
        up, down = np.full(n + 1, _RADIX, np.uint64), np.full(n + 1, pow(_RADIX, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        held[n] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return held[n]


def word_hashes(col: pa.Array, fold: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of rows: first row, hashes of all words, each row's first word (and an end), words' byte starts and ends.

    Words are runs of bytes other than space and 0x09 to 0x0D; with `fold`, A-Z count as a-z. Byte positions count
    from the start of the chunk's first text.
    """
    if not len(col):
        return
    every = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    table = _LOWER if fold else _EXACT
    for a, b in chunks(col):
        offsets = every[a : b + 1] - every[a]
        raw = data[every[a] : every[b]]
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = ~_SPACE[raw]
        cut = np.zeros(len(raw) + 1, bool)  # a text begins here
        cut[offsets] = True
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        starts = starts[starts < len(raw)]
        up, down = powers(1 << max(20, len(raw).bit_length()))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(table[raw] * up[: len(raw)], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        yield a, hashes, np.searchsorted(starts, offsets), starts, ends


def rolled(words: np.ndarray, width: int, places: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all runs of `width` words (texts' bounds not regarded); empty if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if width == SHINGLE and places is None:
        places = _PLACES
    elif places is None:
        places = mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_RADIX)) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += words[k : k + n] * places[k]
    return mixed(out)


def shingle_sets(col: pa.Array) -> Iterator[np.ndarray]:
    """For each row the sorted, distinct hashes of its five-word shingles.

    A row of one to four words has its whole sequence as one shingle; a row without words has none.
    """
    for _, words, bounds, _, _ in word_hashes(col):
        runs = rolled(words, SHINGLE)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= SHINGLE:
                got = np.sort(runs[a : b - SHINGLE + 1])
                keep = np.empty(len(got), bool)
                keep[0] = True
                np.not_equal(got[1:], got[:-1], out=keep[1:])
                yield got[keep]
            elif b > a:
                yield mixed((words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
