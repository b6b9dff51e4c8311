"""Looking up many short byte strings at once.

A unit (a word or a part of one) of at most 16 bytes without a zero byte is its
own key: its bytes, filled with zeros, as two 64-bit integers. ``KeyTable`` is a
hash table on such keys whose lookups and insertions run over whole arrays, so
cutting and looking up a megabyte of text costs a few dozen numpy calls. Keys
are compared in full; hashes only choose where to look.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of a unit that its key holds.
KEY_BYTES = 16
#: Bytes of text that are cut and looked up together.
CHUNK = 1 << 20
_PAD = bytes(KEY_BYTES)
_U = np.uint64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_SPACES = b" \t\n\v\f\r"
SPACE = np.zeros(256, bool)
SPACE[list(_SPACES)] = True


def keys_of(padded: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the keys of units of 1 to 16 bytes; ``padded`` has 16 more bytes behind the last unit."""
    eight = np.ndarray(len(padded) - 7, "<u8", padded.data, strides=(1,))
    first = eight[start] & _MASK[np.minimum(length, 8)]
    return first, eight[start + 8] & _MASK[np.clip(length - 8, 0, 8)]


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = (first ^ (second * _U(0xC2B2AE3D27D4EB4F))) * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(32)
    return x * _U(0xD6E8FEB86659FD93)


class KeyTable:
    """Keys to numbers from 0; open addressing with linear probing, at most about two thirds full."""

    def __init__(self, bits: int):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.first = np.zeros(1 << self.bits, np.uint64)
        self.second = np.zeros(1 << self.bits, np.uint64)
        self.number = np.zeros(1 << self.bits, np.int32)  # plus one; 0 is a free place

    def _place(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (mixed(first, second) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is missing."""
        at = self._place(first, second)
        out = self.number[at] - 1
        left = np.flatnonzero((out >= 0) & ((self.first[at] != first) | (self.second[at] != second)))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            n = self.number[at] - 1
            out[left] = n
            on = (n >= 0) & ((self.first[at] != first[left]) | (self.second[at] != second[left]))
            left, at = left[on], at[on]
        return out

    def add(self, first: np.ndarray, second: np.ndarray, number: np.ndarray) -> None:
        """Enter keys that are missing and differ, with numbers that differ."""
        at, left = self._place(first, second), np.arange(len(first))
        while len(left):
            free = self.number[at] == 0
            self.number[at[free]] = number[left[free]] + 1  # of several keys that claim a place one gets it
            won = free & (self.number[at] == number[left] + 1)
            self.first[at[won]], self.second[at[won]] = first[left[won]], second[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)


def distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of one of each key, and for each key which of these it equals."""
    _, at, same = np.unique(mixed(first, second), return_index=True, return_inverse=True)
    if (first[at][same] == first).all() and (second[at][same] == second).all():
        return at, same
    _, at, same = np.unique(np.stack([first, second], axis=1), axis=0, return_index=True, return_inverse=True)
    return at, same.ravel()


def _slices(text: bytes, most: int) -> Iterator[bytes]:
    """A long text in slices that end at ASCII white space."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(c, at, at + most) for c in (b" ", b"\n", b"\t", b"\r"))
        if cut <= at:
            nexts = [i for i in (text.find(c, at + most) for c in (b" ", b"\n", b"\t", b"\r")) if i >= 0]
            if not nexts:
                break
            cut = min(nexts)
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def chunks(texts: Iterable[bytes], most: int = CHUNK) -> Iterator[tuple[bytes, list[int], bool]]:
    """Texts in chunks of about ``most`` bytes: the joined bytes, where each text ends, and whether the last text goes on in the next chunk.

    A line break stands behind every text, 16 zero bytes behind a chunk.
    """
    have: list[bytes] = []
    size = 0

    def joined(go_on: bool = False) -> tuple[bytes, list[int], bool]:
        ends, at = [], -1
        for x in have:
            at += len(x) + 1
            ends.append(at)
        return b"\n".join(have) + b"\n" + _PAD, ends, go_on

    for text in texts:
        if len(text) > most:
            if have:
                yield joined()
            parts = list(_slices(text, most))
            for i, x in enumerate(parts):
                have = [x]
                yield joined(i + 1 < len(parts))
            have, size = [], 0
            continue
        have.append(text)
        size += len(text) + 1
        if size >= most:
            yield joined()
            have, size = [], 0
    if have:
        yield joined()
