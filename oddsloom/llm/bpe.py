"""Exact byte-pair merging of single pre-tokens with a vocabulary file of the public tokenizers."""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Vocabulary:
    #: Id of each byte, and of each byte that ends a word.
    of_byte: list[int]
    of_last: list[int]
    #: ``left << 32 | right`` to ``rank << 32 | merged id``.
    merges: dict[int, int]
    #: Bytes of every id, one after the other; where each begins, and its length.
    flat: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    #: Special strings, which are ids of their own wherever they stand in a text.
    special: dict[str, int]


@functools.cache
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@functools.cache
def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids, chars = spec["model"]["vocab"], byte_chars()
    back = {c: i for i, c in enumerate(chars)}
    merges: dict[int, int] = {}
    for rank, (a, b) in enumerate(spec["model"]["merges"]):
        merges.setdefault(ids[a] << 32 | ids[b], rank << 32 | ids[a + b])
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    tokens = [b""] * (1 + max(*ids.values(), *special.values()))
    for t, i in ids.items():
        tokens[i] = bytes(map(back.__getitem__, t))
    for t, i in special.items():
        tokens[i] = t.encode()
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = spec["model"]["end_of_word_suffix"] or ""
    return Vocabulary([ids[c] for c in chars], [ids[c + end] for c in chars], merges, np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size, special)


NONE = 1 << 62


def merge(vocabulary: Vocabulary, word: bytes) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank, leftmost first, is merged until no pair has a rank."""
    rank_of = vocabulary.merges.get
    ids = [*(vocabulary.of_byte[b] for b in word[:-1]), *(vocabulary.of_last[b] for b in word[-1:])]
    if len(ids) > LONG:
        return _merge_long(vocabulary, ids)
    pairs = [rank_of(a << 32 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
    while pairs:
        best = min(pairs)
        if best == NONE:
            break
        i = pairs.index(best)
        ids[i : i + 2] = [best & 0xFFFFFFFF]
        del pairs[i]
        if i:
            pairs[i - 1] = rank_of(ids[i - 1] << 32 | ids[i], NONE)
        if i < len(pairs):
            pairs[i] = rank_of(ids[i] << 32 | ids[i + 1], NONE)
    return ids


#: Above so many bytes a heap over a linked list replaces the scan, which takes time by the square of the length.
LONG = 200


def _merge_long(vocabulary: Vocabulary, ids: list[int]) -> list[int]:
    import heapq

    rank_of, n = vocabulary.merges.get, len(ids)
    after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
    heap = [(r >> 32, i, r & 0xFFFFFFFF, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of(ids[i] << 32 | ids[i + 1], NONE)) != NONE]
    heapq.heapify(heap)
    while heap:
        _, i, new, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = new, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else -1
            if right >= 0 and (r := rank_of(ids[left] << 32 | ids[right], NONE)) != NONE:
                heapq.heappush(heap, (r >> 32, left, r & 0xFFFFFFFF, ids[left], ids[right]))
    return [x for x, ok in zip(ids, alive, strict=True) if ok]


#: Bytes up to which words are merged together in one matrix per group of lengths; longer ones are merged alone.
GROUPS = (6, 9, 12, 16, 24, 40)
EMPTY = 0xFFFFFFFF


@functools.cache
def _ranks(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The merges as a hash table with open places: pairs ``left << 16 | right``, and what ``merges`` has for them."""
    merges = load(path).merges
    keys = np.fromiter(merges, np.int64, len(merges))
    keys = (keys >> 32 << 16 | keys & 0xFFFF).astype(np.uint32)
    values = np.fromiter(merges.values(), np.int64, len(merges))
    pairs, found = np.full(1 << BITS, EMPTY, np.uint32), np.full(1 << BITS, NONE, np.int64)
    place, left = _place(keys), np.arange(len(keys))
    while len(left):
        free = left[pairs[place[left]] == EMPTY]
        pairs[place[free]] = keys[free]
        left = left[pairs[place[left]] != keys[left]]
        place[left] = (place[left] + 1) & (1 << BITS) - 1
    found[place] = values
    return pairs, found


BITS = 18


def _place(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint32(2654435769) >> np.uint32(32 - BITS)).astype(np.int64)


def _lookup(table: tuple[np.ndarray, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    pairs, found = table
    keys = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
    place = _place(keys)
    at = pairs[place]
    out = np.where(at == keys, found[place], NONE)
    open_ = np.flatnonzero((at != keys) & (at != EMPTY))
    while len(open_):
        place[open_] = (place[open_] + 1) & (1 << BITS) - 1
        at = pairs[place[open_]]
        hit = open_[at == keys[open_]]
        out[hit] = found[place[hit]]
        open_ = open_[(at != keys[open_]) & (at != EMPTY)]
    return out


def merge_many(path: str, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the pre-tokens ``flat[begin[k]:begin[k] + size[k]]`` in order, and where each one's begin (one more at the end).

    Each round merges the best pair of every pre-token that still has one.
    """
    vocabulary, table = load(path), _ranks(path)
    of_byte, of_last = np.array(vocabulary.of_byte, np.int64), np.array(vocabulary.of_last, np.int64)
    done_ids: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = np.zeros(len(size), np.int64)
    least = 0
    for most in GROUPS:
        group = np.flatnonzero((size > least) & (size <= most))
        least = most
        if not len(group):
            continue
        columns = np.arange(most)
        n = size[group]
        ids = of_byte[flat[np.minimum(begin[group, None] + columns, len(flat) - 1)]]
        ids[np.arange(len(group)), n - 1] = of_last[flat[begin[group] + n - 1]]
        ranks = _lookup(table, ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(group), most - 1)
        ranks[columns[:-1] >= n[:, None] - 1] = NONE
        while len(group):
            where = ranks.argmin(1)
            rows = np.arange(len(group))
            best = ranks[rows, where]
            done = best == NONE
            if done.any():
                count[group[done]] = n[done]
                done_ids.append((group[done], n[done], ids[done][columns < n[done][:, None]].astype(np.uint32)))
                group, ids, ranks, n, where, best = group[~done], ids[~done], ranks[~done], n[~done], where[~done], best[~done]
                rows = rows[: len(group)]
            past = columns[:-1] > where[:, None]
            ids[:, :-1] = np.where(past, ids[:, 1:], ids[:, :-1])
            past[rows, where] = True
            ranks[:, :-1] = np.where(past[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            ids[rows, where] = best & 0xFFFFFFFF
            n -= 1
            left = np.flatnonzero(where > 0)
            ranks[left, where[left] - 1] = _lookup(table, ids[left, where[left] - 1], ids[left, where[left]])
            right = np.flatnonzero(where < n - 1)
            ranks[right, where[right]] = _lookup(table, ids[right, where[right]], ids[right, where[right] + 1])
    for k in np.flatnonzero(size > least).tolist():
        alone = np.array(merge(vocabulary, flat[begin[k] : begin[k] + size[k]].tobytes()), np.uint32)
        count[k] = len(alone)
        done_ids.append((np.array([k]), count[k : k + 1], alone))
    at = np.append(0, np.cumsum(count))
    out = np.empty(at[-1], np.uint32)
    for group, n, ids in done_ids:
        out[np.arange(len(ids)) + np.repeat(at[group] - np.cumsum(n) + n, n)] = ids
    return out, at


def merge_words(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, words), np.int64, len(words))
    return merge_many(path, np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
