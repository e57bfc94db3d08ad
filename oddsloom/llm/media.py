"""Media columns: motion-JPEG in AVI files, read through their RIFF index and cut into timed clips.

``store`` puts bytes into frames of 32 x 18 JPEG blocks, one byte a block: a block is flat, so it is its DC
coefficient alone, and with a DC quantiser of 8 that coefficient is the byte itself. Every baseline decoder gives the
byte back in all 64 samples of the block; the files are lossless by construction.

``read`` walks a file's RIFF chunks to its index, takes the frames that the index names, decodes their DC differences
(all frames of a batch side by side: step k decodes block k of every frame) and compares the histograms of
neighbouring frames. A shot ends where the difference passes what the last ``WINDOW`` differences lead one to expect.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.tables import in_batches

BLOCKS_WIDE, BLOCKS_HIGH = 32, 18
FRAME = BLOCKS_WIDE * BLOCKS_HIGH
RATE = 25
BINS = 16
#: Differences that a shot's end is held against, how many deviations it takes, and the least difference.
WINDOW, DEVIATIONS, LEAST = 8, 3.0, 0.08
#: Payload bytes that are worked on together; a longer file is worked on alone.
SLICE = 1 << 20

#: The standard's code lengths for luminance DC differences (number of codes of 1, 2, ... 16 bits).
DC_LENGTHS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
#: One code of one bit: end of block.
AC_LENGTHS, AC_SYMBOLS = bytes([1] + [0] * 15), bytes([0])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0, 8] + [1] * 63))
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, BLOCKS_HIGH * 8, BLOCKS_WIDE * 8, 1, 1, 0x11, 0))
    + _segment(0xC4, bytes([0x00]) + DC_LENGTHS + DC_SYMBOLS)
    + _segment(0xC4, bytes([0x10]) + AC_LENGTHS + AC_SYMBOLS)
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)
TAIL = b"\xff\xd9"


def _codes(lengths: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Symbol to (code, bits), in the canonical order of a JPEG Huffman table."""
    out, code, k = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            out[symbols[k]] = code, bits
            code, k = code + 1, k + 1
        code <<= 1
    return out


@functools.cache
def _encoder() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference from -255 on, the end of block included."""
    codes, (eob, eob_bits) = _codes(DC_LENGTHS, DC_SYMBOLS), _codes(AC_LENGTHS, AC_SYMBOLS)[0]
    value, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        code, bits = codes[c]
        extra = d if d >= 0 else d + (1 << c) - 1
        value[d + 255] = (code << c | extra) << eob_bits | eob
        size[d + 255] = bits + c + eob_bits
    return value, size


@functools.cache
def _decoder(dc_lengths: bytes, dc_symbols: bytes, ac_lengths: bytes, ac_symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """DC difference and bits used for each window of 16 bits; 0 bits where it is no flat block."""
    codes, (eob, eob_bits) = _codes(dc_lengths, dc_symbols), _codes(ac_lengths, ac_symbols)[0]
    diff, size = np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.int64)
    for c, (code, bits) in codes.items():
        total = bits + c + eob_bits
        if total > 16:
            continue
        for extra in range(1 << c):
            d = extra if not c or extra >> (c - 1) else extra - (1 << c) + 1
            first = ((code << c | extra) << eob_bits | eob) << (16 - total)
            diff[first : first + (1 << (16 - total))] = d
            size[first : first + (1 << (16 - total))] = total
    return diff, size


def encode_frames(samples: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded data of frames (rows of ``samples``), and where each begins (one more at the end)."""
    value, size = _encoder()
    q = samples.astype(np.int16)
    d = np.diff(q, axis=1, prepend=np.int16(128)).ravel().astype(np.int64) + 255
    v, n = value[d], size[d]
    ends = np.cumsum(n).reshape(samples.shape)
    bits = np.diff(ends[:, -1], prepend=0)
    length = -(-bits // 8)
    begin = np.cumsum(length) - length
    at = ends.ravel() - n + np.repeat(begin * 8 - (ends[:, -1] - bits), samples.shape[1])
    v <<= 24 - (at & 7) - n
    at >>= 3
    total = int(length.sum())
    out = sum(np.bincount(at + k, (v >> (16 - 8 * k)) & 255, total + 2) for k in range(3))[:total].astype(np.uint8)
    out[begin + length - 1] |= ((1 << (length * 8 - bits)) - 1).astype(np.uint8)
    marks = out == 0xFF
    stuffed = np.repeat(out, 1 + marks)
    place = np.arange(total) + np.cumsum(marks) - marks
    stuffed[place[marks] + 1] = 0
    return stuffed.tobytes(), np.append(place[begin], len(stuffed))


def decode_frames(scans: list[bytes], tables: tuple[np.ndarray, np.ndarray], blocks: int) -> np.ndarray:
    """The bytes of frames from their entropy-coded data."""
    diff, size = tables
    raw = np.frombuffer(b"".join(scans) + b"\0\0\0\0", np.uint8)
    keep = np.append(True, (raw[1:] != 0) | (raw[:-1] != 0xFF))
    keep[-4:] = True
    starts = np.append(0, np.cumsum([len(s) for s in scans]))
    place = np.cumsum(keep) - 1
    raw = raw[keep].astype(np.int32)
    window = np.zeros(len(raw), np.int32)
    window[:-2] = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    at = place[starts[:-1]] * 8
    last = (place[starts[1:] - 1] + 1) * 8
    out = np.empty((blocks, len(scans)), np.int16)
    for k in range(blocks):
        w = (window[at >> 3] >> (8 - (at & 7))) & 0xFFFF
        used = size[w]
        out[k] = diff[w]
        at = np.minimum(at + used, last)
        if not used.all():
            raise ValueError("a frame holds more than flat blocks")
    if (last - at >= 8).any():
        raise ValueError("a frame is longer than its blocks")
    return (np.cumsum(out, axis=0, dtype=np.int16).T + 128).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes]) -> bytes:
    """An AVI file of motion-JPEG frames, with its index."""
    wide, high, most = BLOCKS_WIDE * 8, BLOCKS_HIGH * 8, max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, wide, high, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, wide, high)
    form = struct.pack("<IiiHH4sIiiII", 40, wide, high, 1, 24, b"MJPG", wide * high * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    parts, index, at = [b"movi"], [], 4
    for f in frames:
        parts.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(parts[-1])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"".join(parts)) + _chunk(b"idx1", b"".join(index)))


INDEX = np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])


def indexed(data: bytes) -> tuple[list[bytes], int]:
    """The frames that a file's index names, and its microseconds a frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, pace = None, None, 1_000_000 // RATE
    open_ = [(12, 8 + struct.unpack_from("<I", data, 4)[0])]
    while open_:
        at, end = open_.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
                movi = at + 8
            elif name == b"LIST":
                open_.append((at + 12, at + 8 + size))
            elif name == b"avih":
                pace = struct.unpack_from("<I", data, at + 8)[0]
            elif name == b"idx1":
                index = np.frombuffer(data, INDEX, size // INDEX.itemsize, at + 8)
            at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("an AVI file without frames or index")
    index = index[index["name"] == b"00dc"]
    return [data[movi + a + 8 : movi + a + 8 + n] for a, n in zip(index["at"].tolist(), index["size"].tolist(), strict=True)], pace


@functools.lru_cache(64)
def _parsed(head: bytes) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """Decoding tables and number of blocks of a JPEG header, start of scan included."""
    tables: dict[int, tuple[bytes, bytes]] = {}
    blocks, quantiser, at = 0, 0, 2
    while at < len(head):
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if marker == 0xDB:
            quantiser = body[1]
        elif marker == 0xC0:
            high, wide = struct.unpack_from(">HH", body, 1)
            blocks = -(-high // 8) * -(-wide // 8)
        elif marker == 0xC4:
            tables[body[0]] = body[1:17], body[17:]
        at += 2 + size
    if quantiser != 8 or not blocks:
        raise ValueError("not a frame of flat blocks")
    return _decoder(*tables[0x00], *tables[0x10]), blocks


def payload(text: bytes) -> bytes:
    """``text`` and bytes 255, up to whole frames."""
    return text + b"\xff" * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def cuts(frames: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True at frames that begin a shot; ``first`` marks the first frame of each file."""
    n = len(frames)
    slot = np.arange(n)[:, None] * BINS + (frames >> 4)
    h = np.bincount(slot.ravel(), minlength=n * BINS).reshape(n, BINS)
    # Differences are whole numbers, so running sums are exact and a file's cuts do not depend on the files before it.
    d = np.append(0, np.abs(np.diff(h, axis=0)).sum(1))
    d[first] = 0
    whole = 2 * frames.shape[1]
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    low = np.maximum(begin + 1, np.arange(n) - WINDOW)
    count = np.maximum(np.arange(n) - low, 0)
    low = np.minimum(low, np.arange(n))
    s1, s2 = np.append(0, np.cumsum(d)), np.append(0, np.cumsum(d * d))
    many, total, squares = np.maximum(count, 1), s1[:-1] - s1[low], s2[:-1] - s2[low]
    limit = np.where(count > 0, (total + DEVIATIONS * np.sqrt(many * squares - total * total)) / many + LEAST * whole, 3 * LEAST * whole)
    return first | (d > limit)


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, media``: each whole text as an AVI file. Null counts as empty, which is one frame of bytes 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [payload((t or "").encode()) for t in batch.column(1).to_pylist()]
            for a, b in _slices([len(t) for t in texts]):
                data, at = encode_frames(np.frombuffer(b"".join(texts[a:b]), np.uint8).reshape(-1, FRAME))
                at, files, k = at.tolist(), [], 0
                for t in texts[a:b]:
                    n = len(t) // FRAME
                    files.append(avi([HEAD + data[at[i] : at[i + 1]] + TAIL for i in range(k, k + n)]))
                    k += n
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(files, pa.binary())], names=["doc_id", "media"])

    return in_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, media binary")


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def frames_of(files: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """All frames of some files as rows of bytes, where each file's begin (one more at the end), and each file's microseconds a frame."""
    scans, heads, at, paces = [], [], [0], []
    for f in files:
        frames, pace = indexed(f)
        paces.append(pace)
        for j in frames:
            cut = j.index(b"\xff\xda") + 2
            cut += struct.unpack_from(">H", j, cut)[0]
            if j[-2:] != TAIL:
                raise ValueError("a frame is cut short")
            heads.append(j[:cut])
            scans.append(j[cut:-2])
        at.append(len(scans))
    if not np.diff(at).all():
        raise ValueError("a file without frames")
    kinds = sorted(set(heads))
    if len({_parsed(h)[1] for h in kinds}) != 1:
        raise ValueError("frames differ in size")
    out = np.empty((len(scans), _parsed(kinds[0])[1]), np.uint8)
    for h in kinds:
        mine = [k for k, x in enumerate(heads) if x == h] if len(kinds) > 1 else range(len(heads))
        out[np.asarray(mine)] = decode_frames([scans[k] for k in mine], *_parsed(h))
    return out, np.array(at), paces


CLIP = "struct<start_s: double, end_s: double, frames: int, mean: double>"
READ = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<{CLIP}>"

CLIPS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("mean", pa.float64())]))
NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"]


def _readable(files: list[bytes | None], first: int = 0) -> Iterator[tuple[int, int, tuple | None]]:
    """Ranges of files with their frames, or with None for a file that cannot be read; a range with such a file is halved."""
    try:
        if None in files:
            raise ValueError("no file")
        yield first, first + len(files), frames_of(files)
    except (ValueError, LookupError, struct.error):
        if len(files) == 1:
            yield first, first + 1, None
        else:
            half = len(files) // 2
            yield from _readable(files[:half], first)
            yield from _readable(files[half:], first + half)


def read(media: DataFrame) -> DataFrame:
    """Reads files back: sizes and digests of what they hold, and their clips as timed rows.

    Of what is no such file, is cut short, has no frame or frames of other than flat blocks, only ``media_bytes`` and
    ``media_sha256`` are given; clips and all else are null. A null file has null for these too. Repeated rows are read
    each; an empty table gives no rows; columns beside ``doc_id`` and ``media`` are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            files = batch.column(1).to_pylist()
            for x, y in _slices([len(f or b"") for f in files]):
                for a, b, found in _readable(files[x:y], x):
                    ids = batch.column(0).slice(a, b - a)
                    if found is None:
                        f = files[a]
                        row = (None, None, None, None, None if f is None else len(f), None if f is None else hashlib.sha256(f).hexdigest(), None)
                        yield pa.RecordBatch.from_arrays([ids, *(pa.array([v], t) for v, t in zip(row, (*kinds, CLIPS), strict=True))], names=NAMES)
                        continue
                    frames, at, paces = found
                    first = np.zeros(len(frames), bool)
                    first[at[:-1]] = True
                    begins = np.flatnonzero(cuts(frames, first))
                    many = np.diff(begins, append=len(frames))
                    mean = np.round(np.add.reduceat(frames.sum(1, dtype=np.int64), begins) / (many * frames.shape[1]), 6)
                    own = np.searchsorted(begins, at)
                    pace = np.repeat(np.array(paces) / 1e6, np.diff(own))
                    start = (begins - np.repeat(at[:-1], np.diff(own))) * pace
                    clips = pa.StructArray.from_arrays([pa.array(start), pa.array(start + many * pace), pa.array(many.astype(np.int32)), pa.array(mean)], names=["start_s", "end_s", "frames", "mean"])
                    rows = []
                    for k, f in enumerate(files[a:b]):
                        held = frames[at[k] : at[k + 1]].tobytes()
                        rows.append((len(held.rstrip(b"\xff")), len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-32:]), len(f), hashlib.sha256(f).hexdigest()))
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids, *columns, pa.ListArray.from_arrays(own.astype(np.int32), clips)], names=NAMES)

    return in_batches(media.select("doc_id", "media"), run, READ)
