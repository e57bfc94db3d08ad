"""Context-tree weighting against a direct recursion over the tree."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from oddsloom.llm import ctw

SCHEMA = "doc_id long, text string, lang string"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def rendered(text):
    return " ".join(tokens(text)).encode() + b"\n"


def brute(rows):
    """doc_id -> (n_tokens, n_known, train_tokens, base, score)."""
    train = [t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    nodes = defaultdict(lambda: [0, 0])

    code = ctw.Code(np.bincount(np.frombuffer(b"".join(map(rendered, train)), np.uint8), minlength=256))

    def path(s, i):
        """For each decision of byte i: its contexts, shallow to deep, and its bit."""
        before = (b"\n" * ctw.DEPTH + s)[i : i + ctw.DEPTH]
        for k in range(code.begin[s[i]], code.begin[s[i]] + code.size[s[i]]):
            yield [(before[ctw.DEPTH - d :], code.node[k]) for d in range(ctw.DEPTH + 1)], int(code.bit[k])

    children = defaultdict(set)
    for t in train:
        s = rendered(t)
        for i in range(len(s)):
            for steps, bit in path(s, i):
                for up, down in zip(steps, steps[1:], strict=False):
                    children[up].add(down)
                for x in steps:
                    nodes[x][bit] += 1

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def pw(x):
        if x not in nodes:
            return 0.0
        if x not in memo:
            e = kt(*nodes[x])
            if len(x[0]) == ctw.DEPTH:
                memo[x] = e
            else:
                below = sum(pw(c) for c in children[x])
                hi = max(e, below)
                memo[x] = math.log(0.5) + hi + math.log(math.exp(e - hi) + math.exp(below - hi))
        return memo[x]

    def one(steps):
        x = steps[0]
        if x not in nodes:
            return 0.5
        a, b = nodes[x]
        mine = (b + 0.5) / (a + b + 1)
        if len(steps) == 1:
            return mine
        stop = math.exp(math.log(0.5) + kt(a, b) - pw(x))
        return stop * mine + (1 - stop) * one(steps[1:])

    c = Counter(w for t in train for w in [*tokens(t), None])
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        ts, s = [*tokens(t), None], rendered(t)
        score = 0.0
        for i in range(len(s)):
            for steps, bit in path(s, i):
                p = one(steps)
                score += math.log10(p if bit else 1 - p)
        out.append((d, len(ts), sum(c[w] > 0 for w in ts), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts), score))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()), key=repr)


def texts():
    rng = random.Random(4)
    words = ["the", "The", "a", "été", "x1", "of,", "中文", "..."]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40])))) for i in range(40)]
    return [*rows, (100, None), (101, ""), (102, " \t\n"), (103, "the\n\nthe  a "), (103, "the\n\nthe  a "), (None, "zz the"), (5, "only here: qqq")]


@pytest.mark.parametrize("limit", [ctw.BLOCK_ROWS, 700, 150])
def test_scores_equal_the_recursion(spark, limit):
    rows = texts()
    df = spark.createDataFrame([(d, t, "xx") for d, t in rows], SCHEMA).repartition(3)
    got, want = rows_of(ctw.score(df, block_rows=limit)), brute(rows)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], rel=1e-5, abs=1e-6)


def test_empty_table_and_no_training_text(spark):
    assert ctw.score(spark.createDataFrame([], SCHEMA)).collect() == []
    out_id = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = ctw.score(spark.createDataFrame([(out_id, "ab", "x")], SCHEMA)).collect()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0
    assert row.score == pytest.approx(sum(ctw.Code(np.zeros(256, np.int64)).size[list(b'ab\n')]) * math.log10(0.5), rel=1e-6)


def test_held_out_texts_are_compressed(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = ctw.score(df).filter("held_out").selectExpr("-sum(score) / log10(2) / sum(n_bytes) AS bits").first()
    assert r.bits < 2.4


def test_every_byte_has_a_path_and_paths_are_a_prefix_code():
    counts = np.zeros(256, np.int64)
    counts[[97, 98, 32]] = 1000, 10, 500
    code = ctw.Code(counts)
    assert sum(2.0 ** -code.size) == 1 and code.size[97] == 1 and len(set(code.node.tolist())) == 255
