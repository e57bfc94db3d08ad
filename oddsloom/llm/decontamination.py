"""Benchmark passages in documents, by suffix arrays of the documents' words.

A shard is a slice of a partition's documents. Its words become numbers, and all its word positions are sorted by the
words that follow: first by as many words as one 64-bit number holds, then by doubling, going on only with positions
that are still equal, up to the length of the longest test suffix. Every test suffix is then found by binary search,
which gives the range of positions where it occurs. Documents never leave their partition and are not shuffled.

Test items come in blocks of ``BLOCK`` words, one broadcast and one pass over the documents for each block, whatever
their number; between passes the rows lie in the shared folder. Words are told apart by 64-bit hashes. A wrong hit
would need ten equal hashes of other words in a row, or one for an item of one word: about 5e-5 for 10**9 words of
documents and 10**6 of tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm import words
from oddsloom.llm.tables import in_batches, written

#: Words of a window; an item of fewer is one window.
WINDOW = 10
#: Bytes of text in a shard, at least if the partition has them; a longer text is a shard of its own.
SHARD = 4 << 20
#: Words of test items that are broadcast at once, and of a piece that a longer item is cut into.
BLOCK, PIECE = 1 << 20, 1 << 16


class SuffixArray:
    """All word positions of some documents in the order of the words that follow, as far as ``need`` words or the document's end."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, need: int) -> None:
        codes, known = pd.factorize(hashes)
        order = np.argsort(known)
        number = np.empty(len(known), np.int64)
        number[order] = np.arange(1, len(known) + 1)
        self.known = known[order]
        self.bits = max(1, int(len(known)).bit_length())
        self.per = 62 // self.bits
        size = np.diff(bounds)
        #: Document of each word; position of each word, as each document is followed by one 0; words from there to the document's end.
        self.owner = np.repeat(np.arange(len(size)), size)
        self.at = np.arange(len(hashes)) + self.owner
        ends = bounds[1:] + np.arange(len(size))
        n = len(hashes) + len(size)
        seq, left = np.zeros(n + self.per, np.int64), np.zeros(n + 1, np.int64)
        seq[self.at] = number[codes]
        left[self.at] = ends[self.owner] - self.at
        self.keys = np.zeros(n + 1, np.int64)
        for j in range(self.per):
            self.keys[:n] = (self.keys[:n] << self.bits) | np.where(left[:n] > j, seq[j : j + n], 0)
        first = self.keys[self.at]
        by = np.argsort(first)
        self.order = self.at[by]
        self._double(first[by], left, need)

    def _double(self, first: np.ndarray, left: np.ndarray, need: int) -> None:
        order, depth, at = self.order, self.per, np.arange(len(self.order))
        rank = np.full(len(left), -1, np.int64)
        new = np.diff(first, prepend=-1) != 0
        while True:
            run = np.cumsum(new) - 1
            rank[order[at]] = at[np.flatnonzero(new)][run]
            at = at[(np.bincount(run, minlength=1)[run] > 1) & (left[order[at]] >= depth)]
            if depth >= need or not len(at):
                return
            mine = order[at]
            head, tail = rank[mine], rank[mine + depth]
            again = np.lexsort((tail, head))
            order[at], head, tail = mine[again], head[again], tail[again]
            new = (np.diff(head, prepend=-2) != 0) | (np.diff(tail, prepend=-2) != 0)
            depth *= 2

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word here, 0 for those that do not occur."""
        if not len(self.known):
            return np.zeros(hashes.shape, np.int64)
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[place] == hashes, place + 1, 0)

    def _bound(self, lo: np.ndarray, hi: np.ndarray, skip: int, least: np.ndarray) -> np.ndarray:
        """In each range the first place whose key, ``skip`` words on, is ``least`` or more."""
        lo, hi = lo.copy(), hi.copy()
        while (lo < hi).any():
            open_, mid = lo < hi, (lo + hi) // 2
            less = self.keys[np.where(open_, self.order[np.minimum(mid, len(self.order) - 1)] + skip, 0)] < least
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        return lo

    def narrow(self, lo: np.ndarray, hi: np.ndarray, skip: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of equal ``skip`` words, cut to where the next are ``numbers`` (a row each, at most ``per``)."""
        key = np.zeros(len(numbers), np.int64)
        for column in numbers.T:
            key = (key << self.bits) | column
        shift = self.bits * (self.per - numbers.shape[1])
        return self._bound(lo, hi, skip, key << shift), self._bound(lo, hi, skip, (key + 1) << shift)

    def find(self, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of ``order`` in which each suffix (a row of hashes) occurs."""
        numbers = self.numbers(suffixes)
        have = np.flatnonzero((numbers > 0).all(axis=1))
        lo, hi = np.zeros(len(have), np.int64), np.full(len(have), len(self.order))
        for k in range(0, numbers.shape[1], self.per):
            lo, hi = self.narrow(lo, hi, k, numbers[have, k : k + self.per])
        out = np.zeros((2, len(numbers)), np.int64)
        out[:, have] = lo, hi
        return out[0], out[1]

    def longest(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many words of each suffix ``text[starts:ends]`` (hashes) occur in a row, and the range of ``order`` where they do."""
        numbers = np.append(self.numbers(text), 0)
        n, lo, hi = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order))
        going, k = np.arange(len(starts)), 0
        while len(going):
            going = going[(starts[going] + k < ends[going]) & (numbers[np.minimum(starts[going] + k, len(text))] > 0)]
            skip = k - k % self.per
            a, b = self.narrow(lo[going], hi[going], skip, numbers[starts[going][:, None] + np.arange(skip, k + 1)])
            going, a, b = going[a < b], a[a < b], b[a < b]
            lo[going], hi[going], k = a, b, k + 1
            n[going] = k
        return n, lo, hi


class Block:
    """Some test items: their words' hashes one after the other, and the different windows with the items that have each."""

    def __init__(self, items: list[tuple[str | None, int, np.ndarray]]) -> None:
        self.ids = list(dict.fromkeys(i for i, _, _ in items))
        code = {i: k for k, i in enumerate(self.ids)}
        self.item = np.array([code[i] for i, _, _ in items], np.int64)
        self.first = np.array([at for _, at, _ in items], np.int64)
        self.text = np.concatenate([h for _, _, h in items]) if items else np.zeros(0, np.uint64)
        self.bounds = np.append(0, np.cumsum([len(h) for _, _, h in items])).astype(np.int64)
        self.need = max([WINDOW, *np.diff(self.bounds).tolist()])
        #: By length: windows (a row of hashes each), where the items of each begin, and the items.
        self.windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, (_, _, h) in enumerate(items):
            n = min(WINDOW, len(h))
            found.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(h, n), self.item[k]))
        for n, views in found.items():
            rows = np.ascontiguousarray(np.concatenate([v for v, _ in views]))
            of = np.repeat([k for _, k in views], [len(v) for v, _ in views])
            which, first = pd.factorize(np.array([r.tobytes() for r in rows], object))
            pairs = np.unique(which * len(self.ids) + of)
            window, item = np.divmod(pairs, len(self.ids))
            different = np.frombuffer(b"".join(first), np.uint64).reshape(-1, n)
            self.windows.append((different, np.searchsorted(window, np.arange(len(different) + 1)), item))

    def hits(self, shard: SuffixArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word of the shard lies in a window, and pairs of a document and an item (its code) with a window in it."""
        edge, pairs = np.zeros(len(shard.keys) + 1, np.int64), [np.zeros(0, np.int64)]
        word = np.full(len(shard.keys), -1, np.int64)
        word[shard.at] = np.arange(len(shard.at))
        for windows, begin, item in self.windows:
            lo, hi = shard.find(windows)
            n = hi - lo
            window = np.repeat(np.arange(len(n)), n)
            place = shard.order[np.arange(n.sum()) + np.repeat(lo - np.append(0, np.cumsum(n))[:-1], n)]
            edge += np.bincount(place, minlength=len(edge)) - np.bincount(place + windows.shape[1], minlength=len(edge))
            seen = np.unique(shard.owner[word[place]] * len(windows) + window)
            doc, window = np.divmod(seen, len(windows))
            many = begin[window + 1] - begin[window]
            of = item[np.arange(many.sum()) + np.repeat(begin[window] - np.append(0, np.cumsum(many))[:-1], many)]
            pairs.append(np.repeat(doc, many) * len(self.ids) + of)
        doc, of = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.ids)))
        return np.cumsum(edge)[shard.at] > 0, doc, of


def pieces(items: DataFrame) -> DataFrame:
    """``item, at, words``: the hashes of an item's words from word ``at``; pieces of long items overlap by a window less one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for w in words.scan(batch.column(1), lower=True, of=words.LOWER_OR_DIGIT):
                h = w.hashes()
                for k in range(w.last - w.first):
                    own = h[w.bounds[k] : w.bounds[k + 1]]
                    for at in range(0, max(min(1, len(own)), len(own) - WINDOW + 1), PIECE - WINDOW + 1):
                        part = own[at : at + PIECE]
                        yield pa.RecordBatch.from_arrays([pa.array([ids[w.first + k]], pa.string()), pa.array([at], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["item", "at", "words"])

    return in_batches(items.select(F.col("item_id").cast("string"), F.col("text").cast("string")), run, "item string, at long, words binary")


def blocks(items: DataFrame) -> Iterator[Block]:
    """Blocks of test items, one at a time; at least one."""
    held: list = []
    size = given = 0
    for r in pieces(items).toLocalIterator():
        held.append((r.item, r.at, np.frombuffer(r.words, np.uint64)))
        size += len(held[-1][2])
        if size >= BLOCK:
            yield Block(held)
            held, size, given = [], 0, given + 1
    if held or not given:
        yield Block(held)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SHARD:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def search(docs: DataFrame, items: DataFrame, *carried: str) -> DataFrame:
    """``row`` (the columns ``carried``), ``n_words``, ``n_hit``, ``items`` of every row of ``docs``; ``items`` are distinct identifiers as strings."""
    rows = docs.select(F.struct(*carried).alias("row"), F.col("text").cast("string").alias("text"), F.lit(None).cast("binary").alias("cover"), F.lit(None).cast("array<string>").alias("items"))
    kind = f"row {rows.schema['row'].dataType.simpleString()}"
    ahead = blocks(items)
    block = next(ahead)
    while block is not None:
        after = next(ahead, None)
        shared = docs.sparkSession.sparkContext.broadcast(block)
        rows = in_batches(rows, _pass(shared, after is None), f"{kind}, {'n_words long, n_hit long' if after is None else 'text string, cover binary'}, items array<string>")
        rows, block = rows if after is None else written(rows, "decontamination-pass"), after
    return rows


def _pass(shared, last: bool):
    """Adds the hits of one block; ``cover`` has one bit a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for table in _shards(batches):
            text = _one(table, "text").cast(pa.large_string())
            before, had = _one(table, "cover").to_pylist(), _one(table, "items").to_pylist()
            n_words, n_hit, cover, found = [], [], [], [list(x or ()) for x in had]
            for w in words.scan(text, lower=True, of=words.LOWER_OR_DIGIT, size=SHARD):
                shard = SuffixArray(w.hashes(), w.bounds, min(WINDOW, block.need))
                hit, doc, item = block.hits(shard)
                for d, i in zip(doc.tolist(), item.tolist()):
                    found[w.first + d].append(block.ids[i])
                for k in range(w.last - w.first):
                    own = hit[w.bounds[k] : w.bounds[k + 1]]
                    if before[w.first + k]:
                        own = own | np.unpackbits(np.frombuffer(before[w.first + k], np.uint8), count=len(own)).astype(bool)
                    n_words.append(len(own))
                    n_hit.append(int(own.sum()))
                    cover.append(None if last else np.packbits(own).tobytes())
            names = pa.array([list(dict.fromkeys(x)) for x in found], pa.list_(pa.string()))
            middle = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64())] if last else [text.cast(pa.string()), pa.array(cover, pa.binary())]
            yield pa.RecordBatch.from_arrays([_one(table, "row"), *middle, names], ["row", *(("n_words", "n_hit") if last else ("text", "cover")), "items"])

    return run


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs``.

    ``items`` has ``item_id, text``. Null and empty texts have no words; items without words have no window. Rows of
    ``items`` with one ``item_id`` are one item, and null is an item whose name is ''. Repeated documents have a row
    each. Without items, or documents, nothing is hit, or there is no row. Other columns are ignored. A text is held
    whole by its task, with about 40 times its size.
    """
    name = F.transform("items", lambda x: F.coalesce(x, F.lit("")))
    return search(docs, items, id_col).select(
        F.col(f"row.{id_col}").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(name), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no window of ``items`` occurs in, with all their columns, whatever their names."""
    return search(docs, items, *docs.columns).filter("n_hit = 0").select("row.*")


def longest_matches(docs: DataFrame, items: DataFrame, least: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """For each suffix of a test item its longest verbatim match of ``least`` words or more: ``item_id, item_word, n_words, doc_id, doc_word, n_places``.

    Words count from 0. ``n_places`` is how often the longest occurs in all documents, and of these the smallest
    ``doc_id`` (null first) and word are given. Matches end at the end of a piece of ``PIECE`` words of an item.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    parts = []
    for block in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            size = np.diff(block.bounds)
            piece = np.repeat(np.arange(len(size)), size)
            starts, ends = np.arange(len(block.text)), block.bounds[1:][piece]
            word = block.first[piece] + starts - block.bounds[piece]
            names = pa.array([block.ids[k] for k in block.item[piece]], pa.string())
            for table in _shards(batches):
                ids = _one(table, id_col)
                for w in words.scan(_one(table, "text").cast(pa.large_string()), lower=True, of=words.LOWER_OR_DIGIT, size=SHARD):
                    shard = SuffixArray(w.hashes(), w.bounds, block.need)
                    n, lo, hi = shard.longest(block.text, starts, ends)
                    for k in np.flatnonzero(n >= least).tolist():
                        at = np.searchsorted(shard.at, shard.order[lo[k] : hi[k]])
                        doc = shard.owner[at]
                        many = pa.RecordBatch.from_arrays([names.slice(k, 1).take(pa.array(np.zeros(len(at), np.int64))), pa.array(np.full(len(at), word[k])), pa.array(np.full(len(at), n[k])), ids.take(pa.array(w.first + doc)), pa.array(at - w.bounds[doc])], ["item_id", "item_word", "n_words", "doc_id", "doc_word"])
                        yield many

        parts.append(in_batches(docs.select(id_col, F.col("text").cast("string").alias("text")), run, f"item_id string, item_word long, n_words long, doc_id {kind}, doc_word long"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    by = every.groupBy("item_id", "item_word", "n_words").agg(F.min(F.struct("doc_id", "doc_word")).alias("place"), F.count("*").alias("n_places"))
    best = by.groupBy("item_id", "item_word").agg(F.max(F.struct("n_words", "place", "n_places")).alias("best"))
    return best.select("item_id", "item_word", "best.n_words", "best.place.doc_id", "best.place.doc_word", "best.n_places")
