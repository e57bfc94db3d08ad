import hashlib
import zlib

import numpy as np
import odd
import pytest

from oddsloom.llm import media, quality


@pytest.mark.parametrize("rows", [np.random.default_rng(1).integers(0, 256, (20, 576)), np.full((3, 576), 255), np.tile([0, 255], (2, 288)), np.zeros((1, 576))])
def test_frames_are_lossless(rows):
    rows = rows.astype(np.uint8)
    data, at = media.encode_frames(rows)
    file = media.avi([media.HEAD + data[a:b] + media.TAIL for a, b in zip(at, at[1:])])
    frames, begins, _ = media.frames_of([file, file])
    assert np.array_equal(frames, np.concatenate([rows, rows])) and begins.tolist() == [0, len(rows), 2 * len(rows)]
    with pytest.raises(ValueError):
        media.indexed(b"RIFF0000WAVE")


def test_shots_end_where_histograms_jump():
    rng = np.random.default_rng(2)
    frames = np.concatenate([rng.integers(0, 60, (12, 576)), rng.integers(150, 250, (12, 576))]).astype(np.uint8)
    first = np.zeros(24, bool)
    first[0] = True
    assert np.flatnonzero(media.cuts(frames, first)).tolist() == [0, 12]


def test_files_that_cannot_be_read(spark):
    stored = {r.doc_id: bytes(r.media) for r in media.store(spark.createDataFrame([(k, "text " * k) for k in range(1, 400, 40)], "doc_id long, text string")).collect()}
    good = stored[361]
    other = bytearray(good)
    other[good.index(b"\xff\xdb") + 5] = 9  # another quantiser
    cut = bytearray(good)
    cut[-40:-20] = b"\xff" * 20
    bad = {900: None, 901: b"", 902: b"RIFF", 903: b"no file", 904: good[: len(good) // 2], 905: bytes(other), 906: media.avi([b"none"]), 907: good.replace(b"idx1", b"none"), 908: bytes(cut)}
    rows = spark.createDataFrame([*stored.items(), *bad.items()], "doc_id long, media binary").coalesce(1)
    got = {r.doc_id: r for r in media.read(rows).collect()}
    assert got.keys() == stored.keys() | bad.keys()
    for d, f in bad.items():
        r = got[d]
        assert (r.media_bytes, r.media_sha256) == ((None, None) if f is None else (len(f), hashlib.sha256(f).hexdigest()))
        assert r.clips is None and r.n_bytes is None and r.payload_sha256 is None and r.tail_crc32 is None
    for d, f in stored.items():
        held = media.payload(b"text " * d)
        assert got[d].payload_sha256 == hashlib.sha256(held).hexdigest() and got[d].clips and got[d].media_bytes == len(f)


def test_media_rows(spark):
    got = media.read(media.store(odd.docs(spark))).collect()
    assert len(got) == len(odd.ROWS) and media.read(media.store(odd.docs(spark, []))).collect() == []
    want = {}
    for d, t, *_ in odd.ROWS:
        p = media.payload((t or "").encode())
        want[d] = (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id]
        assert sum(c.frames for c in r.clips) * 576 == r.payload_bytes and r.clips[0].start_s == 0
    one = {r.media_sha256 for r in got if r.doc_id in (2, 3)}
    assert len(one) == 1


def test_quality_learns_and_takes_odd_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model).join(labels, "doc_id").filter(quality.held_out(labels["doc_id"]))
    rows = [(r.score >= quality.THRESHOLD, r.quality == 1) for r in scored.select("score", "quality").collect()]
    assert sum(a == b for a, b in rows) / len(rows) > 0.93
    assert all(a for a, b in rows if b)
    odd_rows = quality.score(odd.docs(spark), model)
    assert odd_rows.columns == [c for c in odd.docs(spark).columns if c != "score"] + ["score"]
    assert all(0 <= r.score <= 1 for r in odd_rows.collect()) and odd_rows.count() == len(odd.ROWS)
    none = quality.fit(docs, labels.filter("false"))
    assert {r.score for r in quality.score(odd.docs(spark), none).select("score").collect()} == {0.5}
