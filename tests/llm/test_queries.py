"""Each query over a folder of odd rows, held against plain loops and the tokenizers library; the pipeline's stages likewise."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import odd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_exact_and_mix import fill, norm
from test_near_dedup import brute
from tokenizers import Tokenizer

from oddsloom.llm import media, quality, queries, words
from oddsloom.llm.tables import read, written

EXTRA = [(20 + k, f"text number {k} with some words of its own {k * k}", "en", "ab"[k % 2], k, 0.0) for k in range(12)]
ROWS = [*odd.ROWS, *EXTRA]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    odd.docs(spark, ROWS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(32)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    chats = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "a </turn>\nb"), (None, 0, "user", "x"), (2, None, None, "word " * 50_000), (2, 0, "assistant", "")]
    spark.createDataFrame([(*c, 7) for c in chats], "conv_id long, turn long, role string, text string, msg int").repartition(2).write.parquet(f"{base}/conversations.parquet")
    odd.docs(spark, []).write.parquet(f"{base}/empty/documents.parquet")
    return base


def plain(rows=ROWS):
    return [(r[0], r[1] or "") for r in rows]


def ids_of(path, texts):
    library = Tokenizer.from_file(public_tokenizers.path(path))
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def key(r):
    return tuple((x is not None, x) for x in r)


def same(got, want):
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_op1(spark, folder):
    got = {r.conv_id: r for r in queries.op1_chat_formatting(spark, folder).collect()}
    assert sorted(got, key=lambda x: (x is not None, x)) == [None, -7, 1, 2]
    turns = {1: [("user", "hi"), ("assistant", ""), ("assistant", "a </turn>\nb")], None: [("user", "x")], 2: [("", "word " * 50_000), ("assistant", "")], -7: [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]}
    for c, r in got.items():
        said = "".join(t for role, t in turns[c] if role == "assistant")
        assert r.n_turns == len(turns[c]) and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.turns_sha256 in {hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in order).encode()).hexdigest() for order in (turns[c], turns[c][::-1])}


def test_op2(spark, folder):
    got = queries.op2_lm_scoring(spark, folder).collect()
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    split = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    seen = Counter(w for d, t in plain() if not out(d) for w in [*split(t), "\0end"])
    n, v = sum(seen.values()), len(seen)
    want = defaultdict(list)
    for d, t in plain():
        tokens = [*split(t), "\0end"]
        want[d].append((out(d), len(tokens), sum(seen[w] > 0 for w in tokens), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens)))
    assert len(got) == len(ROWS)
    for r in got:
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == x[:4] and r.base_score == pytest.approx(x[4]) for x in want[r.doc_id]) and r.score < 0


def test_op3(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    want = []
    for d, t in plain():
        n, u = len(t), t
        at = n // 2
        u = u[:at] + " was re-written" + u[at + 8 :]
        u = "Draft: " + u
        at = min(n + 13, len(u))
        u = u[:at] + "!" + u[at + 1 :]
        want.append((d, count(t), 3, count(u), len(u)))
    same([tuple(r)[:5] for r in queries.op3_token_counts(spark, folder).collect()], want)


def shots(frames):
    """First frames of the shots of one file, one frame at a time."""
    hist = [np.bincount(f >> 4, minlength=media.BINS) for f in frames]
    d = [0, *(int(np.abs(a - b).sum()) for a, b in zip(hist, hist[1:]))]
    whole, out = 2 * len(frames[0]), [0]
    for k in range(1, len(frames)):
        past = d[max(1, k - media.WINDOW) : k]
        limit = 3 * media.LEAST * whole
        if past:
            limit = sum(past) / len(past) + media.DEVIATIONS * float(np.std(past)) + media.LEAST * whole
        if d[k] > limit + 1e-6 * whole:
            out.append(k)
    return out


def test_op4(spark, folder):
    got = queries.op4_media(spark, folder).collect()
    want = []
    for d, t in plain():
        p = media.payload(t.encode())
        frames = np.frombuffer(p, np.uint8).reshape(-1, 576)
        begins = shots(list(frames))
        ends = [*begins[1:], len(frames)]
        pace = 1_000_000 // media.RATE / 1e6
        mean = frames[: ends[0]].mean()
        feature = f"clips={len(begins)} ends={','.join('%.2f' % (e * pace) for e in ends)} mean={mean:.3f}"
        want.append((d, len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), feature))
    same([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in got], want)


def test_op5(spark, folder):
    got = queries.op5_near_dedup(spark, folder).collect()
    groups = brute([(-(1 << 63) if d is None else d, t) for d, t in plain()])
    same([(r.doc_id, r.class_id, r.class_size) for r in got], [(d, g[0], len(g)) for g in groups for d in g])


def test_op6(spark, folder):
    rows = queries.op6_mixing(spark, folder).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    same([(r.doc_id, r["size"]) for r in rows], [(r[0], size(r[1])) for r in ROWS])
    placed = [r.position for r in rows if r.position is not None]
    assert placed == sorted(placed) and all(r.position is None for r in rows[len(placed) :])
    assert all(r.taken == r["size"] * ((r.position is not None) + (r.position_again is not None)) for r in rows)


def test_op7(spark, folder):
    want = [(d, len(i), hashlib.sha256(raw(i)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for (d, t), i in zip(plain(), ids_of("byte_bpe_50k.json", [t for _, t in plain()]))]
    same(queries.op7_bpe_coding(spark, folder).collect(), want)


def test_op8(spark, folder):
    groups = defaultdict(list)
    for d, t in plain():
        groups[norm(t)].append(d)
    got = queries.op8_exact_dedup(spark, folder).collect()
    first = lambda g: min((d for d in g if d is not None), default=None)
    same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], [(d, first(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g])
    assert sum(r.kept for r in got) == len(groups)


def test_op9(spark, folder):
    got = sorted(queries.op9_binary_ids(spark, folder).collect(), key=lambda r: r.start)
    want = sorted((key((d, len(i) + 1, zlib.crc32(raw([*i, 1])))) for (d, t), i in zip(plain(), ids_of("word_bpe_49k.json", [t for _, t in plain()]))))
    assert sorted(key((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)]).tolist()[:-1]


def vector(t):
    w = next(words.scan(pa.array([t], pa.string())))
    _, place, value = quality.features(w)
    return [*zip(place.tolist(), value.tolist()), (1 << quality.BITS, 1.0)]


def ftrl(vectors, labels):
    """Follow the regularised leader, one weight at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if abs(z[k]) <= quality.L1:
            return 0.0
        return -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    rng = np.random.default_rng(1)
    for _ in range(max(quality.EPOCHS, -(-quality.UPDATES // len(labels)))):
        for i in rng.permutation(len(labels)).tolist():
            w = {k: weight(k) for k, _ in vectors[i]}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[k] * x for k, x in vectors[i])))))
            for k, x in vectors[i]:
                g = (p - labels[i]) * x
                step = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA
                z[k] += g - step * w[k]
                n[k] += g * g
    return {k: weight(k) for k in z}


def test_op10(spark, folder):
    got = queries.op10_quality(spark, folder).collect()
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
    docs = spark.createDataFrame([(d, t) for d, t in plain() if d is not None and not out(d)], "doc_id long, text string")
    order = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "text").collect()
    w = ftrl([vector(r.text) for r in order], [r.doc_id % 2 for r in order])
    want = defaultdict(list)
    for d, t in plain():
        want[d].append(1 / (1 + math.exp(-sum(w.get(k, 0.0) * x for k, x in vector(t)))))
    assert len(got) == len(ROWS)
    for r in got:
        assert r.held_out == out(r.doc_id) and min(abs(r.score - x) for x in want[r.doc_id]) < 1e-4
        assert r.predicted == int(r.score >= 0.3)


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if not n.startswith(("op1_", "op10", "op11", "op12"))))
def test_empty_tables(spark, folder, name):
    assert queries.QUERIES[name](spark, f"{folder}/empty").collect() == []


def test_empty_conversations_and_labels(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    odd.docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    (only,) = queries.op1_chat_formatting(spark, str(tmp_path)).collect()
    assert (only.conv_id, only.n_turns) == (-7, 2)
    assert queries.op10_quality(spark, str(tmp_path)).collect() == []
    docs = odd.docs(spark)
    assert {r.score for r in quality.score(docs, quality.fit(docs, read(spark, str(tmp_path), "labels"))).collect()} == {0.5}


def run_stages(spark, docs, sf):
    """Each stage's input and output."""
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf), f"test-{name}")
        yield name, docs.collect(), out
        docs = out


@pytest.mark.parametrize("which", ["odd", "real"])
def test_stages_equal_plain_loops(spark, folder, which):
    sf = folder if which == "odd" else "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    columns = docs.columns
    for name, before, out in run_stages(spark, docs, sf):
        after = out.collect()
        if name != "bpe":
            assert out.columns == columns
        if name == "quality":
            again = {(r.doc_id, r.text): r.score for r in quality.score(docs, quality.fit(docs, read(spark, sf, "labels"))).collect()}
            assert sorted(map(str, after)) == sorted(str(r) for r in before if again[r.doc_id, r.text] >= quality.THRESHOLD)
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for r in before:
                groups[norm(r.text)].append(r.doc_id)
            assert sorted(norm(r.text) for r in after) == sorted(groups)
            assert all(r.doc_id == min((d for d in groups[norm(r.text)] if d is not None), default=None) for r in after)
        elif name == "near_dedup":
            none = -(1 << 63)
            groups = brute([(none if r.doc_id is None else r.doc_id, r.text) for r in before])
            assert sorted(none if r.doc_id is None else r.doc_id for r in after) == sorted(g[0] for g in groups)
        elif name == "mixing":
            size = lambda r: len((r.text or "").split())
            sizes, taken, times = defaultdict(int), defaultdict(int), Counter((r.doc_id, r.text) for r in after)
            for r in before:
                sizes[r.source] += size(r)
            for r in after:
                taken[r.source] += size(r)
            names = [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
            target = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2)
            largest = max(map(size, before))
            assert max(times.values()) <= 2 and all(abs(taken[s] - target[s]) <= largest for s in names)
        else:
            want = ids_of("byte_bpe_50k.json", [r.text or "" for r in before])
            same([(r.doc_id, r.n_tokens, tuple(r.ids)) for r in after], [(r.doc_id, len(i), tuple(i)) for r, i in zip(before, want)])
