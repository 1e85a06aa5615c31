"""A compressed FM-index over integer symbols: backward search on a wavelet matrix of packed bits, in numpy."""

from __future__ import annotations

import numpy as np


class _Bits:
    """A bit vector with ranks: a 64-bit word and a running count for each 64 places."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
        counts = np.bitwise_count(packed).astype(np.int32)
        self.words, self.before = packed, np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int32)
        self.zeros = len(bits) - int(counts.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class FMIndex:
    """Counts occurrences of patterns of up to `depth` symbols; suffixes are sorted by so many symbols only.

    A place of the text may stand for several equal ones (`times`): occurrences are then counted with them.
    """

    def __init__(self, text: np.ndarray, depth: int, times: np.ndarray | None = None) -> None:
        rank, k = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        while k < depth:
            key = rank << np.int64(32)
            key[: len(rank) - k] |= rank[k:] + 1
            rank, k = np.unique(key, return_inverse=True)[1].astype(np.int64), 2 * k
        order = np.argsort(rank, kind="stable")
        mass = np.ones(len(text), np.int64) if times is None else times[order]
        self.mass = np.concatenate(([0], np.cumsum(mass)))
        last = text[order - 1]  # the Burrows-Wheeler transform; the text is taken as a circle
        self.n, symbols = len(text), int(text.max()) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols)))).astype(np.int64)
        self.levels = []
        for shift in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            bits = ((last >> shift) & 1).astype(np.uint8)
            self.levels.append((shift, _Bits(bits)))
            last = np.concatenate([last[bits == 0], last[bits == 1]])
        every = np.arange(symbols)
        self.start = self._mapped(every, np.zeros(symbols, np.int64))

    def _mapped(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> shift) & 1, bits.zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol before them."""
        base = self.first[symbol] - self.start[symbol]
        return base + self._mapped(symbol, lo), base + self._mapped(symbol, hi)


def matching_statistics(index: FMIndex, text: np.ndarray, ends: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each place the length, `most` at the greatest, of the longest run of symbols ending there that occurs elsewhere too.

    A place of the text is streamed through backward search: each step puts one more symbol before the match, until only the
    occurrence at the place itself is left. All places go on in step.
    """
    out = np.zeros(len(ends), np.int64)
    alive = np.flatnonzero(most > 0)
    lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), index.n, np.int64)
    length = 0
    while len(alive):
        lo, hi = index.extend(text[ends[alive] - length], lo, hi)
        more = index.mass[hi] - index.mass[lo] > 1
        alive, lo, hi = alive[more], lo[more], hi[more]
        length += 1
        out[alive] = length
        further = most[alive] > length
        alive, lo, hi = alive[further], lo[further], hi[further]
    return out


def repeated_windows(index: FMIndex, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of documents (document, first and last window) whose windows of `width` symbols occur elsewhere too.

    Documents are runs of the text. The matching statistic at a document's end tells of all windows that it covers. Before
    those, windows are taken from the left; a match of length m < width ending at a window's end means that no window holds the
    m + 1 last symbols of this one, so the next to be looked at starts behind the first of them.
    """
    tail = matching_statistics(index, text, starts + lengths - 1, lengths)
    doc = np.flatnonzero(tail >= width)
    found = [(doc, lengths[doc] - tail[doc], lengths[doc] - width)]
    last = np.minimum(lengths - tail - 1, lengths - width - (tail < width))  # the last window that isn't decided
    at, lane = np.zeros(len(starts), np.int64), np.arange(len(starts))
    while True:
        lane = lane[at[lane] <= last[lane]]
        if not len(lane):
            break
        m = matching_statistics(index, text, starts[lane] + at[lane] + width - 1, np.full(len(lane), width))
        hit = lane[m == width]
        found.append((hit, at[hit], at[hit]))
        at[lane] += np.where(m == width, 1, width - m)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
