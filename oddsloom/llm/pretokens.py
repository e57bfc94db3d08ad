"""Pre-tokens of two public byte-pair vocabularies, found in whole batches of texts at once.

A text becomes an array of character classes (white space, letter, number, other); pre-tokens are runs of one class
with a few rules on top, so array operations find them all without a regular expression. ``scan`` gives the same
spans as these patterns:

* ``spaced``: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
* ``bare``: ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+`` (white space is left out)
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

SPACE, LETTER, NUMBER, OTHER, BREAK = range(5)
KINDS = {SPACE: r"\s+", LETTER: r"\p{L}+", NUMBER: r"\p{N}+"}
#: Endings that an apostrophe starts.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Characters that are scanned together; a longer text is scanned alone.
SLICE = 1 << 21


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point as the library's own expressions have it, whatever Unicode Python itself knows."""
    from tokenizers import Regex, pre_tokenizers

    points = np.delete(np.arange(sys.maxunicode + 1), np.arange(0xD800, 0xE000))
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, pattern in KINDS.items():
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            kinds[points[a:b]] = kind
    return kinds


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``SLICE`` characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def scan(texts: list[str], pattern: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """``joined, starts, ends, bounds``: pre-token k is ``joined[starts[k]:ends[k]]``; text i has those from ``bounds[i]`` to ``bounds[i + 1]``."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    after = np.cumsum(lengths)
    kinds = _classes()[codes]
    kinds[after - 1] = BREAK
    edge = np.empty(len(kinds), bool)
    edge[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:])
    edge[after - 1] = True  # two empty texts in a row
    if pattern == "bare":
        edge |= kinds == NUMBER
    # A contraction stands where an "other" run begins with an apostrophe that no space is attached to.
    quote = np.flatnonzero((codes == 39) & edge & (kinds == OTHER))
    if pattern == "spaced":
        quote = quote[(quote == 0) | (codes[quote - 1] != 32) | (kinds[quote - 1] != SPACE)]
    if len(quote):
        quote = quote[kinds[np.minimum(quote + 1, len(kinds) - 1)] == LETTER]
        for q in quote.tolist():
            for e in ENDINGS:
                if joined.startswith(e, q + 1):
                    edge[q + 1] = False
                    edge[q + 1 + len(e)] = True
                    break
    if pattern == "spaced":
        # The last character of a white run goes with what follows: a space is attached, another stands alone.
        tail = np.flatnonzero(edge[1:] & (kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & (kinds[1:] != BREAK))
        edge[tail] = True
        edge[tail[codes[tail] == 32] + 1] = False
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(kinds))
    first = kinds[starts]
    keep = first != BREAK if pattern == "spaced" else (first != BREAK) & (first != SPACE)
    starts, ends = starts[keep], ends[keep]
    bounds = np.append(0, np.searchsorted(starts, after))
    return joined, starts, ends, bounds


def words(texts: list[str], pattern: str) -> tuple[list[str], list[int]]:
    """All pre-tokens in order, and the bounds of each text's."""
    joined, starts, ends, bounds = scan(texts, pattern)
    return [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], bounds.tolist()


#: An odd factor and its inverse modulo 2**64, for hashes of all substrings from one running sum.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


@functools.lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(20, int(n - 1).bit_length()))[:n]


@dataclass
class Distinct:
    """The different pre-tokens of some texts."""

    #: UTF-8 of pre-token k is ``data[begin[k]:begin[k] + size[k]]``; it has ``chars[k]`` characters.
    data: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    chars: np.ndarray
    #: Which of them the pre-tokens are, in order; text i has those from ``bounds[i]`` to ``bounds[i + 1]``.
    which: np.ndarray
    bounds: np.ndarray

    def words(self) -> list[str]:
        raw = self.data.tobytes()
        return [raw[a : a + n].decode() for a, n in zip(self.begin.tolist(), self.size.tolist(), strict=True)]


def distinct(texts: list[str], pattern: str) -> Distinct:
    """Equal pre-tokens are found by hash and then compared character by character."""
    joined, starts, ends, bounds = scan(texts, pattern)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    data = np.frombuffer(joined.encode(), np.uint8)
    if len(data) == len(codes):
        place = np.arange(len(codes) + 1)
    else:
        place = np.append(0, np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint32(1)).astype(np.uint64) * powers(FACTOR, len(codes)), out=sums[1:])
    which, _ = pd.factorize((sums[ends] - sums[starts]) * powers(INVERSE, len(codes))[starts])

    def firsts() -> np.ndarray:
        first = np.empty(which.max(initial=-1) + 1, np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        return first

    first, size = firsts(), ends - starts
    model = first[which]
    same = np.array_equal(size, size[model])
    if same:
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = np.array_equal(codes[np.repeat(starts, size) + at], codes[np.repeat(starts[model], size) + at])
    if not same:
        which, _ = pd.factorize(np.array([joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], object))
        first = firsts()
    begin = place[starts[first]]
    return Distinct(data, begin, place[ends[first]] - begin, size[first], which, bounds)


def spread(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[begin[k]:begin[k] + size[k]] for k in which`` as one array, and where each begins (one more at the end)."""
    mine = size[which]
    at = np.append(0, np.cumsum(mine))
    return flat[np.arange(at[-1]) + np.repeat(begin[which] - at[:-1], mine)], at
