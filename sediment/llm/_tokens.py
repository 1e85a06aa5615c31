"""Token ids of many texts: distinct stretches of text are encoded once and gathered.

Texts are cut only where the tokenizers used here never join or look across:
  before a space that follows a character other than white space;
  between an ASCII letter, a digit and an ASCII sign (quotes and bars aside: they begin contractions and special strings);
  around a single newline between such characters.
So the ids of a text are those of its stretches, one after another.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of stretches and ids that a worker keeps, and the longest stretch that it keeps.
HELD_BYTES, LONGEST = 96 << 20, 256
#: Bytes of text cut at a time (a longer text stands alone).
CUT_BYTES = 4 << 20
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[[ord("'"), ord("|")]] = 0
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER


def tokenizer_file(name: str) -> str:
    """Where the public tokenizers' files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _after_white_space(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each byte position is white space, in UTF-8 of any width."""
    c = raw[np.maximum(at - 1, 0)]
    out = (c <= 0x20) | (c == 0x7F)
    wide = np.flatnonzero(c >= 0x80)
    if len(wide):
        a, b, c = raw[np.maximum(at[wide] - 3, 0)], raw[np.maximum(at[wide] - 2, 0)], c[wide]
        two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
        three = ((a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        general = (a == 0xE2) & (((b == 0x80) & (((c >= 0x80) & (c <= 0x8B)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        out[wide] = two | three | general
    return out


def stretches(col: pa.Array, fold: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct stretches of space+text over all rows, the number of each stretch in turn, and each row's first (and an end).

    With `fold`, A-Z become a-z, for tokenizers that do so themselves: not before a character beyond ASCII, which may
    combine with the letter, and not in rows beside a special string, which begins with <|.
    """
    col = pc.binary_join_element_wise(pa.scalar(" "), col, pa.scalar(""))
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2], np.uint8)[: offsets[-1]]
    kind = _CLASS[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    known = kind > 0
    cut[1:-1] |= (kind[1:] != kind[:-1]) & known[1:] & known[:-1]
    line = np.flatnonzero(raw == 0x0A)
    line = line[(line > 0) & (line + 1 < len(raw))]
    line = line[known[line - 1] & known[line + 1]]
    cut[line] = cut[line + 1] = True
    at = np.flatnonzero(raw == 0x20)
    cut[at[~_after_white_space(raw, at)]] = True
    data = col.buffers()[2]
    if fold and not ((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)).any():
        upper = (raw >= 0x41) & (raw <= 0x5A)
        upper[:-1] &= raw[1:] < 0x80
        data = pa.py_buffer(raw + (upper.view(np.uint8) << 5))
    cuts = np.flatnonzero(cut).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), data).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(cuts, offsets)


class Encoder:
    """What `encode` (a list of stretches to a list of values) gives for stretches, kept between batches within bounds."""

    def __init__(self, encode: Callable[[list[str]], list], size: Callable[[object], int] = len) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.encode, self.size_of, self.held, self.size = encode, size, {}, 0

    def of(self, texts: list[str]) -> list:
        if self.size > HELD_BYTES:
            self.held, self.size = {}, 0
        got = list(map(self.held.get, texts))
        missing = [k for k, x in enumerate(got) if x is None]
        for k, x in zip(missing, self.encode([texts[k] for k in missing]), strict=True):
            got[k] = x
            if len(texts[k]) <= LONGEST:
                self.held[texts[k]] = x
                self.size += self.size_of(x) + 2 * len(texts[k]) + 150
        return got


def gather_index(sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the members of the coded lists stand in the lists' concatenation, and the running ends of the result."""
    of = sizes[codes]
    ends = np.concatenate(([0], np.cumsum(of)))
    first = np.concatenate(([0], np.cumsum(sizes)))[codes]
    return np.repeat(first - ends[:-1], of) + np.arange(ends[-1]), ends


def gathered(values: list[bytes], kind: np.dtype, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that the codes name, one after another, and each row's first (and an end)."""
    sizes = np.array(list(map(len, values)), np.int64) // np.dtype(kind).itemsize
    index, ends = gather_index(sizes, codes)
    return np.frombuffer(b"".join(values), kind)[index], ends[bounds]
