"""LM scoring by context-tree weighting over bytes.

A text is scored as its token stream: words in lower case (A-Z), one space between them, one line feed at the end.
Each byte is decomposed into binary decisions along a Huffman tree; a decision's context is the decisions of its byte so
far and the last ``0 .. DEPTH`` bytes. A node of the tree has the Krichevsky-Trofimov estimate ``Pe`` of its own counts and
the weighted ``Pw = (Pe + product of the children's Pw) / 2``. What the whole tree predicts at a path is a mixture of
the estimates of all depths; it only depends on the last ``DEPTH`` bytes and the next one, so a trained tree is a table
from (context, byte) to a code length, and a text's score is the sum over its bytes.

Training is a count of (context, byte) windows and words over all texts, dealt out by key. The tree's deep parts are
worked out in tasks that each hold all contexts with the same last three bytes; of nodes of depth two there are 2**24 at
most, whatever the corpus, which Spark sums and every task gets; nodes of depth one and nought (at most 65 536 + 256)
meet on the driver. Windows that only texts outside the training set have are nodes
with no counts, so scoring never misses. A text's score is a sum over its words and windows, so the tables are dealt
by key into blocks of about ``BLOCK_ROWS`` rows, and each block is broadcast in turn and adds what it knows: one pass
over the texts for each block, however many there are. Between passes the texts lie with their sums in the shared folder.

Words are told apart by 63 bits of their hashes: among 10**9 different words two share one with a chance of about 5 %,
which would count them as one word.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.llm import words
from oddsloom.llm.tables import in_batches, release, written

DEPTH = 5
#: Rows of the model that a worker holds at once: about 72 MB.
BLOCK_ROWS = 6_000_000
#: Windows and words that a task holds before it sends them on.
HELD = 2_000_000
GRAM, WORD = 0, 1
END_WORD = np.uint64(1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
NO_KEY = np.uint64(0xFFFFFFFFFFFFFFFF)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def stream(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """The token streams of a slice's texts, and their bounds."""
    data = w.data.copy()
    keep = ~words.WHITE[data]
    keep[w.ends] = True
    data[w.ends] = 0x20
    n = np.diff(w.bounds)
    data[w.ends[w.bounds[1:][n > 0] - 1]] = 0x0A
    lone = w.at[1:][n == 0] - 1
    keep[lone], data[lone] = True, 0x0A
    return data[keep], np.append(0, np.cumsum(keep)[w.at[1:] - 1])


def windows(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte, last byte, the one before it ... from the low end, for each place; before a text lie line feeds."""
    keys = data.astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    for j in range(1, DEPTH + 1):
        before = np.empty(len(data), np.uint64)
        before[j:], before[:j] = data[:-j] if len(data) > j else data[:0], 0x0A
        before[place < j] = 0x0A
        keys |= before << np.uint64(8 * j)
    return keys


def word_keys(w: words.Words) -> np.ndarray:
    return w.hashes() | np.uint64(2)  # never the end's key


class _Counts:
    """Sums of counts by key, in bounded memory."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append(summed(keys, n))
        self.size += len(self.parts[-1][0])

    def squeeze(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.parts, self.size = [(keys, n)], len(keys)
        return keys, n


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of ``n`` of each."""
    if not len(keys):
        return keys, n
    if (n == n[0]).all():
        ordered = np.sort(keys)
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        return ordered[first], np.diff(first, append=len(keys)) * n[0]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n[order], first)


def count(docs: DataFrame) -> DataFrame:
    """``kind, key, n``: how often each window and word occurs in the training texts; 0 for those of other texts alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {GRAM: _Counts(), WORD: _Counts()}

        def sent(kind: int) -> pa.RecordBatch:
            keys, n = found[kind].squeeze()
            found[kind] = _Counts()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])

        for batch in batches:
            out = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for w in words.scan(batch.column(0), lower=True):
                learnt = (~out[w.first : w.last]).astype(np.int64)
                data, bounds = stream(w)
                keys, owner = windows(data, bounds), np.repeat(learnt, np.diff(bounds))
                for flag in (0, 1):
                    mine = keys[owner == flag]
                    found[GRAM].add(mine, np.full(len(mine), flag, np.int64))
                mine = word_keys(w)[np.repeat(learnt, np.diff(w.bounds)) == 1]
                found[WORD].add(np.append(mine, np.full(int(learnt.sum()), END_WORD)), np.ones(len(mine) + int(learnt.sum()), np.int64))
                for kind, x in found.items():
                    if x.size > HELD and len(x.squeeze()[0]) > HELD // 2:
                        yield sent(kind)
        for kind, x in found.items():
            if x.size:
                yield sent(kind)

    rows = in_batches(docs.select("text", held_out(F.col("doc_id")).alias("out")), run, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after six steps of the recurrence; x > 0."""
    product = x.copy()
    for k in range(1, 6):
        product *= x + k
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def log_estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov estimate of a sequence with ``n0`` zeros and ``n1`` ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Level:
    """All nodes of one depth: their counts, estimates and, from the children's sums, their weighted probabilities."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.keys, self.n0, self.n1 = keys, n0, n1
        self.pe = log_estimate(n0, n1)
        self.pw = self.pe if below is None else np.log(0.5) + np.logaddexp(self.pe, below)
        self.stop = np.ones(len(keys)) if below is None else np.exp(np.log(0.5) + self.pe - self.pw)

    def parents(self, depth: int) -> tuple[Level, np.ndarray]:
        """The level above, whose contexts have ``depth`` bytes, and each node's parent there."""
        mask = np.uint64((1 << 8 * depth + 8) - 1)
        keys, up = np.unique(self.keys & mask, return_inverse=True)
        total = lambda x: np.bincount(up, x, len(keys))
        return Level(keys, total(self.n0), total(self.n1), total(self.pw)), up

    def descend(self, so_far: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mixture of the chance of a one down to here, and the weight that is left for what lies deeper."""
        one = (self.n1 + 0.5) / (self.n0 + self.n1 + 1.0)
        return so_far + left * self.stop * one, left * (1 - self.stop)


class Code:
    """Binary decomposition of bytes: a Huffman tree over their training counts (each one more, so that all have a path).

    Frequent bytes take few decisions, so a context that was seen a few times has little to learn. ``node`` and ``bit``
    hold each byte's path, from ``begin`` on, ``size`` long; inner nodes are numbered from 0 at the root.
    """

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, k, k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        children: dict[int, tuple[int, int]] = {}
        for k in range(256, 511):
            (x, _, a), (y, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            children[k] = a, b
            heapq.heappush(heap, (x + y, k, k))
        paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        open_: list[tuple[int, list[tuple[int, int]]]] = [(510, [])]
        while open_:
            k, path = open_.pop()
            if k < 256:
                paths[k] = path
            else:
                open_ += [(child, [*path, (510 - k, bit)]) for bit, child in enumerate(children[k])]
        self.size = np.array([len(p) for p in paths])
        self.begin = np.cumsum(self.size) - self.size
        self.node, self.bit = np.array([x for p in paths for x in p]).T.copy()


def leaves(keys: np.ndarray, n: np.ndarray, code: Code) -> tuple[Level, np.ndarray, np.ndarray, np.ndarray]:
    """The deepest level; for each decision of each window its node there and its bit, and where each window's decisions begin."""
    byte, context = (keys & np.uint64(255)).astype(np.int64), keys >> np.uint64(8)
    size = code.size[byte]
    begin = np.cumsum(size) - size
    step = np.arange(size.sum()) + np.repeat(code.begin[byte] - begin, size)
    bit = code.bit[step]
    at = np.repeat(context << np.uint64(8), size) | code.node[step].astype(np.uint64)
    distinct, where = np.unique(at, return_inverse=True)
    each = np.repeat(n.astype(float), size)
    n1 = np.bincount(where, each * bit, len(distinct))
    n0 = np.bincount(where, each * (1 - bit), len(distinct))
    return Level(distinct, n0, n1, None), where, bit, begin


def _grams(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    rows = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches if len(b)]
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*rows, strict=True))


def _up(keys: np.ndarray, n: np.ndarray, code: Code) -> tuple[list[Level], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Levels DEPTH .. 3 of the contexts in this task."""
    level, where, bit, begin = leaves(keys, n, code)
    levels, ups = [level], []
    for depth in range(DEPTH - 1, 2, -1):
        level, up = level.parents(depth)
        levels.append(level)
        ups.append(up)
    return levels, ups, where, bit, begin


SUMMED = ("n0", "n1", "pw")


def _parents(level: Level, depth: int) -> pa.RecordBatch:
    """What the nodes of a level, as far as they are here, add to those of ``depth`` bytes above them."""
    node, up = np.unique(level.keys & np.uint64((1 << 8 * depth + 8) - 1), return_inverse=True)
    total = lambda x: pa.array(np.bincount(up, x, len(node)))
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), total(level.n0), total(level.n1), total(level.pw)], names=["node", *SUMMED])


def _level(node: np.ndarray, n0: np.ndarray, n1: np.ndarray, pw: np.ndarray) -> Level:
    return Level(node.astype(np.uint64), n0, n1, pw)


def train(counts: DataFrame) -> DataFrame:
    """``key, value``: log10 of what the tree gives the window's byte in the window's context."""
    spark = counts.sparkSession
    grams = counts.filter(F.col("kind") == GRAM).select("key", "n").repartition(F.expr("(key >> 8) & 16777215"))
    met = lambda df: df.groupBy("node").agg(*(F.sum(c).alias(c) for c in SUMMED))
    sums = "node long, n0 double, n1 double, pw double"

    bytes_ = np.zeros(256, np.int64)
    for r in grams.groupBy((F.col("key").bitwiseAND(255)).alias("byte")).agg(F.sum("n").alias("n")).collect():  # 256 rows at most
        bytes_[r["byte"]] = r["n"]
    code = Code(bytes_)

    def deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = _grams(batches)
        if len(keys):
            yield _parents(_up(keys, n, code)[0][-1], 2)

    def middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _parents(_level(*(c.to_numpy() for c in b.columns)), 1)

    pairs = written(met(grams.mapInArrow(deep, sums)), "pairs")
    # One row for each last byte and bit path: 65 536 at most.
    top = met(pairs.mapInArrow(middle, sums)).orderBy("node").toPandas()
    one = _level(*(top[c].to_numpy() for c in ("node", *SUMMED)))
    root, up = one.parents(0)
    so_far, left = root.descend(np.zeros(len(root.keys)), np.ones(len(root.keys)))
    so_far, left = one.descend(so_far[up], left[up])
    dense = np.zeros((2, 1 << 16))
    dense[:, one.keys.astype(np.int64)] = so_far, left
    above = spark.sparkContext.broadcast(dense)  # 1 MB, always

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                level = _level(*(c.to_numpy() for c in b.columns))
                mixed = level.descend(*above.value[:, (level.keys & np.uint64(0xFFFF)).astype(np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (level.keys, *mixed)], names=["node", "so_far", "left"])

    # One row for each two last bytes and bit path: 2**24 of 24 bytes at most whatever the corpus, some 100 000 in texts.
    found = pairs.mapInArrow(down, "node binary, so_far binary, left binary").collect()
    whole = lambda c, kind: np.frombuffer(b"".join(r[c] for r in found), kind)
    order = np.argsort(whole("node", np.uint64))
    shared = spark.sparkContext.broadcast(tuple(x[order] for x in (whole("node", np.uint64), whole("so_far", float), whole("left", float))))
    del found

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = _grams(batches)
        if len(keys):
            levels, ups, where, bit, begin = _up(keys, n, code)
            nodes, so_far, left = shared.value
            at = np.searchsorted(nodes, levels[-1].keys & np.uint64(0xFFFFFF))
            so_far, left = levels[-1].descend(so_far[at], left[at])
            for level, up in zip(levels[-2::-1], ups[::-1], strict=True):
                so_far, left = level.descend(so_far[up], left[up])
            chance = np.where(bit == 1, so_far[where], 1 - so_far[where])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.add.reduceat(np.log10(chance), begin).astype(np.float32))], names=["key", "value"])

    return grams.mapInArrow(lengths, "key long, value float")


class Table:
    """A map from 64-bit keys to numbers as arrays; the hash table is made in the worker that first asks."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.slots: tuple[np.ndarray, np.ndarray] | None = None

    def _build(self) -> None:
        self.bits = max(4, int(2 * len(self.keys)).bit_length())
        at, found = np.full(1 << self.bits, NO_KEY), np.zeros(1 << self.bits, self.values.dtype)
        place, left = self._place(self.keys), np.arange(len(self.keys))
        while len(left):
            free = left[at[place[left]] == NO_KEY]
            at[place[free]] = self.keys[free]
            left = left[at[place[left]] != self.keys[left]]
            place[left] = (place[left] + 1) & (1 << self.bits) - 1
        found[place] = self.values
        self.slots = at, found
        self.keys = self.values = np.zeros(0)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * GOLDEN >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, 0 where there is no such key."""
        if self.slots is None:
            self._build()
        at, found = self.slots
        place = self._place(keys)
        have = at[place]
        out = np.where(have == keys, found[place], found.dtype.type(0))
        open_ = np.flatnonzero((have != keys) & (have != NO_KEY))
        while len(open_):
            place[open_] = (place[open_] + 1) & (1 << self.bits) - 1
            have = at[place[open_]]
            hit = open_[have == keys[open_]]
            out[hit] = found[place[hit]]
            open_ = open_[(have != keys[open_]) & (have != NO_KEY)]
        return out


def _collected(table: DataFrame, dtype: str) -> Table:
    """A checked table's rows as arrays, a binary pair from each task."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().tobytes()], pa.binary()), pa.array([b.column(1).to_numpy().astype(dtype).tobytes()], pa.binary())], names=["k", "v"])

    rows = table.mapInArrow(packed, "k binary, v binary").collect()
    return Table(np.frombuffer(b"".join(r["k"] for r in rows), np.uint64), np.frombuffer(b"".join(r["v"] for r in rows), dtype))


def _totals(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of each text's values, in their order."""
    return np.bincount(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), value, len(bounds) - 1)


SUMS = "n_known long, logs double, score double"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def _blocks(vocabulary: DataFrame, lengths: DataFrame, n: int, most: int) -> Iterator[tuple[Broadcast, bool]]:
    """The words' counts and the windows' code lengths, broadcast a block of both at a time, ``most`` in all, and whether it is the last."""
    for k in range(most):
        mine = F.pmod(F.xxhash64("key"), F.lit(most)) == k
        tables = _collected(vocabulary.filter(mine), "<u4" if n < 1 << 32 else "<u8"), _collected(lengths.filter(mine), "<f4")
        shared = vocabulary.sparkSession.sparkContext.broadcast(tables)
        del tables
        yield shared, k == most - 1


def _added(shared: Broadcast, last: tuple[int, int] | None):
    """Adds what a block knows of each text; with ``last``, the numbers of training words and of different ones, it gives the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tree = shared.value
        for batch in batches:
            for w in words.scan(batch.column(0), lower=True):
                data, bounds = stream(w)
                c = seen.get(word_keys(w)).astype(np.int64)
                end = int(seen.get(np.array([END_WORD]))[0])
                text, doc, out, *before = (x.slice(w.first, w.last - w.first) for x in batch.columns)
                known, logs, score = (x.to_numpy() for x in before)
                known = known + (_totals(c > 0, w.bounds) + (end > 0)).astype(np.int64)
                logs = logs + _totals(np.log10(c + 1.0), w.bounds) + np.log10(end + 1.0)
                score = score + _totals(tree.get(windows(data, bounds)), bounds)
                if last is None:
                    yield pa.RecordBatch.from_arrays([text, doc, out, *map(pa.array, (known, logs, score))], names=["text", "doc_id", "held_out", "n_known", "logs", "score"])
                    continue
                (n, v), tokens, size = last, np.diff(w.bounds) + 1, np.diff(bounds)
                base = logs - tokens * np.log10(n + 1.0 * (v + 1))
                result = tokens, known, np.full(len(tokens), n, np.int64), base, score, size.astype(np.int64), -score / np.log10(2) / size
                yield pa.RecordBatch.from_arrays([doc, out, *map(pa.array, result)], names=[c.split()[0] for c in OUT.split(", ")])

    return run


def score(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``docs``: its words' base score and its score by the tree, with code length per byte.

    Null and empty texts are the end alone, one token and one byte. Without any training text the tree gives every
    decision 1/2. Identifiers are whole numbers; null ones belong to the training texts. Repeated rows count each; other
    columns are ignored; an empty table gives no rows.
    """
    counts = written(count(docs), "counts", "kind")
    vocabulary = counts.filter((F.col("kind") == WORD) & (F.col("n") > 0)).select("key", "n")
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    lengths = written(train(counts), "lengths")
    none = [F.lit(0).cast(kind).alias(name) for name, kind in (x.split() for x in SUMS.split(", "))]
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), *none)
    passes, passed = max(1, -(-(v + lengths.count()) // block_rows)), None
    for shared, last in _blocks(vocabulary, lengths, n, passes):
        if last:
            break
        rows = written(in_batches(rows, _added(shared, None), f"text string, doc_id long, held_out boolean, {SUMS}"), "score-pass")
        shared.destroy()
        if passed is not None:
            release(passed)
        passed = rows
    return in_batches(rows, _added(shared, (n, v)), OUT)
