"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Frequent pre-tokens are compiled on the driver into an automaton whose states are shared by all words with the same
endings. Its transitions carry numbers that add up to the word's place in the lexicon, and that place has the word's
ids: the automaton is a transducer from bytes to ids. It is one file of a few MB (bounded by ``LEXICON_WORDS``) that
Spark hands to every executor and that workers map into memory. Words outside it are merged exactly, pair by pair.

The lexicon's words are the most frequent of all documents; it sets the speed only, as ids are the same with any lexicon.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import re
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsloom.llm import bpe, pretokens
from oddsloom.llm.tables import in_batches, release, written

VOCABULARY = "byte_bpe_50k.json"
LEXICON_WORDS = 1 << 16
#: Different words that a task counts before it sends them on.
HELD = 500_000


def compile_lexicon(words: Iterable[str], vocabulary: str) -> bytes:
    """The transducer as bytes: counts, then sorted transitions, their targets and outputs, final states, and ids by place.

    Words come in any order and may repeat. They are added in byte order; as soon as the next word leaves a branch, its
    states are looked up among those already built, so equal endings are stored once.
    """
    entries = sorted({w.encode() for w in words if w})
    register: dict[tuple, int] = {}
    transitions: list[tuple[int, int, int]] = []
    counts: list[int] = []
    finals: list[bool] = []
    path: list[list] = [[False, []]]  # per depth: is a word's end; (byte, state) of finished branches
    last = b""

    def finish(node: list) -> int:
        key = (node[0], *node[1])
        if (state := register.get(key)) is None:
            state = register[key] = len(counts)
            finals.append(node[0])
            total = int(node[0])
            for byte, target in node[1]:
                transitions.append((state << 8 | byte, target, total))
                total += counts[target]
            counts.append(total)
        return state

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], finish(done)))

    for word in entries:
        shared = len(os.path.commonprefix((last, word)))
        close(shared)
        path.extend([False, []] for _ in range(len(word) - shared))
        path[-1][0] = True
        last = word
    close(0)
    start = finish(path[0])
    table = np.array(sorted(transitions), np.int64).reshape(-1, 3)
    ids, at = bpe.merge_words(vocabulary, entries)
    head = np.array([len(table), len(finals), len(entries), len(ids), start], np.int64)
    return b"".join(x.tobytes() for x in (head, table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), at, np.array(finals, np.int64), ids.astype(np.int64)))


class Lexicon:
    """A transducer file mapped into memory."""

    def __init__(self, path: str):
        data = np.memmap(path, np.int64, "r")
        n, states, words, ids, self.start = data[:5].tolist()
        parts = np.split(data[5:], np.cumsum([n, n, n, words + 1, states]))
        self.keys, self.targets, self.outputs, self.begin, self.finals, self.ids = parts
        assert len(self.ids) == ids

    def find(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Place of each word ``flat[begin[k]:begin[k] + size[k]]`` in the lexicon, -1 where it is not in it; all words walk the automaton together."""
        state, place = np.full(len(size), self.start, np.int64), np.zeros(len(size), np.int64)
        if not len(self.keys):
            return np.full(len(size), -1, np.int64)
        walking, step = np.flatnonzero(size > 0), 0
        while len(walking):
            key = state[walking] << 8 | flat[begin[walking] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            state[walking[~ok]] = -1
            walking, at, step = walking[ok], at[ok], step + 1
            state[walking] = self.targets[at]
            place[walking] += self.outputs[at]
            walking = walking[size[walking] > step]
        found = (state >= 0) & (self.finals[np.maximum(state, 0)] == 1)
        return np.where(found, place, -1)


class Coder:
    """Encodes and decodes whole batches of texts; one lives in each worker."""

    def __init__(self, lexicon: Lexicon | None, path: str):
        self.lexicon, self.path, self.vocabulary = lexicon, path, bpe.load(path)
        vocabulary = self.vocabulary
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None

    def ids_of(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``ids, at, n``: those of word k are ``ids[at[k]:at[k] + n[k]]``, from the lexicon or merged."""
        if not self.lexicon:
            ids, at = bpe.merge_many(self.path, flat, begin, size)
            return ids, at[:-1], np.diff(at)
        place = self.lexicon.find(flat, begin, size)
        unseen = np.flatnonzero(place < 0)
        merged, cut = bpe.merge_many(self.path, flat, begin[unseen], size[unseen])
        at, n = self.lexicon.begin[place], self.lexicon.begin[place + 1] - self.lexicon.begin[place]
        at[unseen], n[unseen] = len(self.lexicon.ids) + cut[:-1], np.diff(cut)
        return np.concatenate([self.lexicon.ids, merged]).astype(np.uint32), at, n

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the bounds of each text's."""
        pieces, owner, marks = texts, None, []
        if self.special and any(s in t for t in texts for s in self.vocabulary.special):
            pieces, owner = [], []
            for i, t in enumerate(texts):
                parts, cuts = self.special.split(t), self.special.findall(t)
                pieces += parts
                owner += [i] * len(parts)
                marks += [*cuts, ""]
        d = pretokens.distinct(pieces, "spaced")
        ids, at = pretokens.spread(*self.ids_of(d.data, d.begin, d.size), d.which)
        bounds = d.bounds
        cut = at[bounds]
        if owner is None:
            return ids, cut
        out, sizes = [], np.zeros(len(texts), np.int64)
        for k, i in enumerate(owner):
            out.append(ids[cut[k] : cut[k + 1]])
            if marks[k]:
                out.append(np.array([self.vocabulary.special[marks[k]]], np.uint32))
            sizes[i] += len(out[-1]) + (len(out[-2]) if marks[k] else 0)
        return np.concatenate(out), np.append(0, np.cumsum(sizes))

    def decode(self, ids: np.ndarray, cut: np.ndarray) -> list[str]:
        """Texts again; bytes that are no UTF-8 become U+FFFD."""
        v = self.vocabulary
        data, at = pretokens.spread(v.flat, v.begin, v.size, ids)
        raw, bounds = data.tobytes(), at[cut].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]


_coders: dict[tuple[str, str], Coder] = {}


def _coder(file: str, vocabulary: str) -> Coder:
    if (file, vocabulary) not in _coders:
        _coders.clear()
        _coders[file, vocabulary] = Coder(Lexicon(SparkFiles.get(file)), vocabulary)
    return _coders[file, vocabulary]


def frequent_words(docs: DataFrame, n: int = LEXICON_WORDS) -> list[str]:
    """The ``n`` most frequent pre-tokens of all texts; ties go by the word.

    Words are first told apart by their level, a 64th of a doubling of the count: those of lower levels than the n-th
    word's, which are nearly all, are not sorted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in pretokens.slices(texts):
                d = pretokens.distinct(texts[a:b], "spaced")
                seen.update(dict(zip(d.words(), np.bincount(d.which, minlength=len(d.size)).tolist(), strict=True)))
            if len(seen) > HELD:
                yield pa.RecordBatch.from_pydict({"word": list(seen.keys()), "n": list(seen.values())})
                seen.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    counts = written(in_batches(docs.select("text"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    level = F.floor(F.log2("n") * 64)
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()  # 4096 rows at most
    least, above = 0, 0
    for row in sizes:
        least, above = row["level"], above + row["words"]
        if above >= n:
            break
    best = counts.filter(level >= least).orderBy(F.desc("n"), "word").limit(n).select("word")
    words = [r["word"] for r in best.toLocalIterator()]
    release(counts)
    return words


def fit(docs: DataFrame, vocabulary: str | None = None, n: int = LEXICON_WORDS) -> str:
    """Compiles the lexicon and hands it to all executors; returns the name of its file there.

    The driver keeps the file, a few MB, for executors that start later, and removes it when it ends.
    """
    spark = docs.sparkSession
    words = frequent_words(docs, n)
    data = compile_lexicon(words, vocabulary or public_tokenizers.path(VOCABULARY))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="lexicon-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data)
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def encode(docs: DataFrame, file: str, vocabulary: str | None = None) -> DataFrame:
    """Adds ``ids`` (array of int) to ``docs``. Null and empty texts have no ids; other columns stay, also one named ``ids`` is replaced."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rest = [c for c in docs.columns if c != "ids"]
    at = rest.index("text")
    schema = docs.select(*rest).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(file, path)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in pretokens.slices(texts):
                ids, cut = coder.encode(texts[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(cut.astype(np.int32), ids.astype(np.int32))], names=[*rest, "ids"])

    return in_batches(docs.select(*rest), run, schema)


def digests(docs: DataFrame, file: str, vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, of the encoded text and of what decoding gives back.

    Null counts as empty: no tokens and the digests of nothing. An empty table gives no rows; repeated rows come as
    often as they are there; other columns are ignored.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(file, path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in pretokens.slices(texts):
                ids, cut = coder.encode(texts[a:b])
                raw, ends = memoryview(ids.astype("<u4").tobytes()), (cut * 4).tolist()
                sha = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(ends, ends[1:], strict=False)]
                back = [hashlib.sha256(t.encode()).hexdigest() for t in coder.decode(ids, cut)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(cut), pa.int64()), pa.array(sha), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
