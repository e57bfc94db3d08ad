"""Token ids as binary shards whose document boundaries and identifiers are Elias-Fano coded.

A shard is one byte string in a row of a Parquet table, so it survives any store that Spark writes to:

=========  ======================================================================================
part       content
=========  ======================================================================================
head       magic ``OLID``, version, width of an id in bytes; numbers of documents, of documents
           without identifier and of ids; the smallest identifier; bytes of each part that follows
ends       the place behind each document's last id: high bits, low bits, samples
documents  the identifiers, less the smallest: high bits, low bits, samples
ids        the ids, end to end, little-endian
=========  ======================================================================================

Numbers that grow, ``n`` of them up to ``u``, are kept as ``l`` low bits each and unary codes of the high ones, which
takes about ``2 + log2(u / n)`` bits a number; ``select`` finds any of them from the sample before it and a short scan.
Shards hold at most ``SHARD_IDS`` ids (a longer document has one of its own), so their offsets need no 64 bits; a
shard's place in the whole corpus is a column.
"""

from __future__ import annotations

import functools
import os
import struct
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.llm import bpe, pretokens
from oddsloom.llm.tables import in_batches, written

VOCABULARY, END = "word_bpe_49k.json", 1
SHARD_IDS = 1 << 20
EVERY = 64
HEAD = struct.Struct("<4sBBIIIq7I")
MAGIC, VERSION = b"OLID", 2
SHARD_SCHEMA = "part int, shard int, first_doc long, last_doc long, n_docs long, n_ids long, ids_before long, blob binary"
NO_ID = -(1 << 63)
#: Set bits of each byte, and the place of the j-th of them from the top.
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)
PLACES = np.array([[*np.flatnonzero(np.unpackbits(np.uint8(b)))] + [0] * (8 - ONES[b]) for b in range(256)])


class Growing:
    """Whole numbers from 0 that never fall, Elias-Fano coded in three byte strings."""

    def __init__(self, parts: list[bytes], n: int):
        self.n = n
        self.low_bits = parts[1][0] if n else 0
        self.high, self.low, self.samples = np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], np.uint8)[1:], np.frombuffer(parts[2], "<u4")

    @staticmethod
    def coded(values: np.ndarray) -> list[bytes]:
        n = len(values)
        if not n:
            return [b"", b"", b""]
        low_bits = max(0, int(values[-1] // n).bit_length() - 1)
        at = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1, np.uint8)
        high[at] = 1
        low = (values[:, None] >> np.arange(low_bits)) & 1
        return [np.packbits(high).tobytes(), bytes([low_bits]) + np.packbits(low.astype(np.uint8).ravel()).tobytes(), at[::EVERY].astype("<u4").tobytes()]

    def select(self, k: np.ndarray) -> np.ndarray:
        """The k-th numbers, from 0."""
        at = self.samples[k // EVERY].astype(np.int64)
        left, byte = k % EVERY, at // 8
        bits = self.high[byte] & (0xFF >> (at % 8)).astype(np.uint8)
        open_ = np.flatnonzero(left >= ONES[bits])
        while len(open_):
            left[open_] -= ONES[bits[open_]]
            byte[open_] += 1
            bits[open_] = self.high[byte[open_]]
            open_ = open_[left[open_] >= ONES[bits[open_]]]
        high = byte * 8 + PLACES[bits, left] - k
        low = np.zeros(len(k), np.int64)
        for j in range(self.low_bits):
            bit = k * self.low_bits + j
            low |= ((self.low[bit // 8] >> (7 - bit % 8)) & 1).astype(np.int64) << j
        return high << self.low_bits | low


def pack(who: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard of documents with identifiers ``who``, in order, that have ``sizes[k]`` ids each. ``NO_ID`` is none."""
    none = int((who == NO_ID).sum())
    known = who[none:]
    first = int(known[0]) if len(known) else 0
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    parts = [*Growing.coded(np.cumsum(sizes).astype(np.int64)), *Growing.coded(known - first), ids.astype(f"<u{width}").tobytes()]
    return HEAD.pack(MAGIC, VERSION, width, len(sizes), none, len(ids), first, *map(len, parts)) + b"".join(parts)


class Shard:
    """A shard read back: ``n`` documents, their boundaries ``ends``, ``ids``."""

    def __init__(self, data: bytes):
        magic, version, width, self.n, self.none, self.u, self.first, *sizes = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of token ids")
        cut = np.append(HEAD.size, HEAD.size + np.cumsum(sizes)).tolist()
        if cut[-1] != len(data):
            raise ValueError("a shard is cut short")
        part = [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        self.ends, self.known = Growing(part[:3], self.n), Growing(part[3:6], self.n - self.none)
        self.ids = np.frombuffer(part[6], f"<u{width}")

    def bounds(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Where documents ``first .. last - 1`` begin, and where the last of them ends."""
        last = self.n if last is None else last
        before = self.ends.select(np.arange(max(first - 1, 0), last))
        return before if first else np.append(0, before)

    def document(self, k: int) -> np.ndarray:
        a, b = self.bounds(k, k + 1).tolist()
        return self.ids[a:b]

    def identifiers(self) -> np.ndarray:
        return np.append(np.full(self.none, NO_ID), self.first + self.known.select(np.arange(self.n - self.none)))


class WordCoder:
    """The library's ids of whole texts: pre-tokens of whole batches, each different one merged once.

    Texts that hold a special string, or a character that Python's Unicode may treat otherwise, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _odd(self, texts: list[str]) -> list[int]:
        odd = {k for k, t in enumerate(texts) if any(s in t for s in self.special)}
        wide = [k for k, t in enumerate(texts) if not t.isascii()]
        if wide:
            codes = np.frombuffer("".join(texts[k] for k in wide).encode("utf-32-le"), np.uint32)
            ends = np.cumsum([len(texts[k]) for k in wide])
            odd.update(wide[i] for i in np.searchsorted(ends, np.flatnonzero(unsure()[codes]), side="right").tolist())
        return sorted(odd)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the bounds of each text's."""
        odd = self._odd(texts)
        plain = list(texts)
        for k in odd:
            plain[k] = ""
        d = pretokens.distinct([lower(t) for t in plain], "bare")
        ids, at = bpe.merge_many(self.path, d.data, d.begin, d.size)
        ids, at = pretokens.spread(ids, at[:-1], np.diff(at), d.which)
        cut = at[d.bounds]
        if odd:
            parts = np.split(ids, cut[1:-1])
            for k in odd:
                parts[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, np.uint32)
            ids, cut = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return ids, cut


@functools.cache
def unsure() -> np.ndarray:
    """Code points that Python's tables may treat otherwise than the library's: those unknown to Python, and marks that the library does not put in order."""
    from tokenizers import normalizers

    last, nfc = "\u0345", normalizers.NFC()  # the mark that all others go before
    out = np.zeros(sys.maxunicode + 1, bool)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        out[c] = unicodedata.category(x) == "Cn" or (unicodedata.combining(x) > 0 and nfc.normalize_str(last + x) != unicodedata.normalize("NFC", last + x))
    return out


def lower(text: str) -> str:
    """NFC and lower case of each character by itself (a final sigma like any other)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


_coders: dict[str, WordCoder] = {}


def write_shards(docs: DataFrame, vocabulary: str | None = None, end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes ``docs`` as shards in ascending order of ``doc_id`` to a table in the shared folder, and returns that table.

    Columns: ``part, shard`` (in order), ``first_doc``, ``last_doc``, ``n_docs``, ``n_ids``, ``ids_before`` (in its part)
    and ``blob``, the shard. Ranges of identifiers are dealt out to all executors. Null and empty texts have the end id alone;
    null identifiers come first, stored as the smallest 64-bit number; rows that repeat an identifier stay, in any order among themselves.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coders.get(path) or _coders.setdefault(path, WordCoder(path))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        part, shard, n, before = None, 0, 0, 0

        def shut() -> pa.RecordBatch:
            nonlocal held, shard, n, before
            who, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            row = {"part": [part], "shard": [shard], "first_doc": [int(who[0])], "last_doc": [int(who[-1])], "n_docs": [len(who)], "n_ids": [len(ids)], "ids_before": [before], "blob": [pack(who, sizes, ids)]}
            held, shard, n, before = [], shard + 1, 0, before + len(ids)
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("shard", pa.int32()), *((c, pa.int64()) for c in ("first_doc", "last_doc", "n_docs", "n_ids", "ids_before")), ("blob", pa.binary())]))

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            part = batch.column(2)[0].as_py() if len(batch) else part
            who = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in pretokens.slices(texts):
                ids, cut = coder.encode(texts[a:b])
                ids = np.insert(ids, cut[1:], end)
                cut = cut + np.arange(len(cut))
                while a < b:
                    first = len(cut) - 1 - (b - a)
                    last = int(np.searchsorted(cut, cut[first] + shard_ids - n, side="right")) - 1
                    if last <= first and n:
                        yield shut()
                        continue
                    last = max(last, first + 1)
                    held.append((who[a : a + last - first], np.diff(cut[first : last + 1]), ids[cut[first] : cut[last]]))
                    n, a = n + int(cut[last] - cut[first]), a + last - first
                    if n >= shard_ids:
                        yield shut()
        if held:
            yield shut()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())
    return written(in_batches(dealt, run, SHARD_SCHEMA), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """One row per document from the shards' bytes: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` is the number of ids of all documents before it: of the shards before in its part, and of all parts before.
    Parts are the ranges that the shards were dealt out by, so their totals are a few thousand rows at most and are broadcast.
    """
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before_part = F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = shards.join(F.broadcast(parts.select("part", before_part.alias("before"))), "part").withColumn("base", F.col("before") + F.col("ids_before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, base in zip(batch.column(0), batch.column(1), strict=True):
                shard, base = Shard(blob.as_py()), base.as_py()
                bounds, ids = shard.bounds(), shard.identifiers()
                raw, at = memoryview(shard.ids.astype("<u4").tobytes()), (4 * bounds).tolist()
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return in_batches(placed.select("blob", "base"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
