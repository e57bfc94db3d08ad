"""Hashes of all words of a batch of texts, from their bytes in Arrow's buffers.

Words are ``[^\\x20\\x09-\\x0D]+``, or runs of other bytes that a caller names. One running sum over the bytes gives the hash of every word: a polynomial modulo
2**64 whose start is divided out, then mixed. Two different words share one with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from oddsloom.llm.pretokens import FACTOR, INVERSE, powers

#: Bytes that are worked on together; a longer text is worked on alone.
SLICE = 1 << 19
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``; all bytes of a character beyond ASCII count alike.
TERM = np.array([chr(b).isascii() and chr(b).isalpha() or b > 0x7F for b in range(256)])
LOWER_OR_DIGIT = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F for b in range(256)])
#: A fixed random 64-bit value for each byte.
VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the SplitMix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    #: Rows of the batch: from, to.
    first: int
    last: int
    #: The texts' bytes, each with one separator behind; where each text begins, and one end more.
    data: np.ndarray
    at: np.ndarray
    #: Bounds in bytes of each word; words of row ``first + i`` are those from ``bounds[i]`` to ``bounds[i + 1]``.
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def owner(self) -> np.ndarray:
        """Row (from 0) of each word."""
        return np.repeat(np.arange(self.last - self.first), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(VALUES[self.data] * powers(FACTOR, len(self.data)), out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * powers(INVERSE, len(self.data))[self.starts])


def scan(column: pa.Array, lower: bool = False, of: np.ndarray | None = None, size: int = SLICE) -> Iterator[Words]:
    """Slices of about ``size`` bytes of a column of texts, null as empty; ``of`` are the bytes of words if not all that are not white."""
    of = ~WHITE if of is None else of
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        sizes = np.diff(offsets[first : last + 1])
        at = np.append(0, np.cumsum(sizes + 1))
        data = np.insert(raw[offsets[first] : offsets[last]], np.cumsum(sizes), 10)
        if lower:
            data = LOWER[data]
        black = of[data]
        change = np.flatnonzero(np.diff(black, prepend=False, append=False))
        starts, ends = change[::2], change[1::2]
        yield Words(first, last, data, at, starts, ends, np.append(0, np.searchsorted(starts, at[1:])))
        first = last
