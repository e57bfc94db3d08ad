import random
from collections import Counter, defaultdict

import numpy as np
import odd
import pyarrow as pa
import pytest

from oddsloom.llm import near_dedup, tables, words


def bag(t):
    w = (t or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def brute(rows, least=0.8):
    bags = [bag(t) for _, t in rows]
    home = list(range(len(rows)))

    def find(k):
        while home[k] != k:
            k = home[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] == bags[j] or jaccard(bags[i], bags[j]) >= least:
                home[find(i)] = find(j)
    groups = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        groups[find(k)].append(d)
    return sorted(sorted(g) for g in groups.values())


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_signatures_estimate_the_overlap_without_bias():
    rng = random.Random(5)
    pairs = []
    for _ in range(300):
        t = rng.choices([f"w{i}" for i in range(rng.choice([2, 60]))], k=rng.choice([1, 4, 6, 40, 300]))
        u = list(t)
        for _ in range(rng.choice([0, 1, 3])):
            u[rng.randrange(len(u))] = "x"
        pairs.append((" ".join(t), " ".join(u + u[: rng.choice([0, len(u) // 4])])))
    a, b = (pa.array(x) for x in zip(*pairs))
    want = np.array([jaccard(bag(x), bag(y)) for x, y in pairs])
    assert np.allclose(near_dedup.overlap(a, b), want)
    sign = lambda c: np.concatenate([near_dedup.signatures(*near_dedup.weighted(near_dedup.bags(w)), w.last - w.first) for w in words.scan(c)])
    error = (sign(a) == sign(b)).mean(1) - want
    assert abs(error.mean()) < 0.01 and np.abs(error).max() < 0.25


@pytest.mark.parametrize("block", [(2048, 16 << 20), (7, 3000)])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)  # leave work for the blocks
    monkeypatch.setattr(near_dedup, "BLOCK", block[0])
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", block[1])
    if block[0] == 7:  # all buckets of some rows are hot, and wanted texts are joined
        monkeypatch.setattr(tables, "HOT_ROWS", 3)
        monkeypatch.setattr(near_dedup, "BROADCAST_KEYS", 0)
    rng = random.Random(7)
    texts = []
    for k in range(6):
        base = [f"b{k}.{i}" for i in range(rng.choice([12, 60, 200]))]
        texts += family(rng, base, rng.choice([1, 2, 30]), rng.choice([1, 4, 12]))
    rows = [(10 + i, t) for i, t in enumerate(texts)] + [(5000 + i, "same few words") for i in range(20)]
    df = spark.createDataFrame([(d, t, None, None, 0, 0.0) for d, t in rows], odd.SCHEMA).repartition(4)
    got = defaultdict(list)
    for r in near_dedup.classes(df).collect():
        got[r.class_id].append(r.doc_id)
        assert r.class_id <= r.doc_id
    assert sorted(sorted(g) for g in got.values()) == brute(rows)
    kept = near_dedup.dedup(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(got) and kept.columns == df.columns


def test_odd_rows(spark):
    got = near_dedup.classes(odd.docs(spark)).collect()
    assert len(got) == len(odd.ROWS)
    of = {r.doc_id: r.class_id for r in got}
    assert of[2] == of[3] == of[6] == 2 and of[1] == 1
    assert near_dedup.classes(odd.docs(spark, [])).collect() == []
    assert sorted(r.doc_id or -1 for r in near_dedup.dedup(odd.docs(spark)).collect()) == [-1, 1, 2, 4, 7]


def test_rows_without_or_with_repeated_identifiers_keep_their_own_classes(spark):
    rng = random.Random(11)
    texts = [" ".join(t) for t in ([f"c{k}.{i}" for i in range(40)] for k in range(8))]
    edited = [t.replace(".39", ".x") for t in texts[:3]]  # a near copy of each of three texts
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (7, texts[4]), (7, texts[5]), (7, texts[5]), (8, texts[6]), (9, texts[7])]
    rows += [(None, edited[0]), (7, edited[1]), (8, edited[2])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, None, None, 0, 0.0) for d, t in rows], odd.SCHEMA).repartition(3)
    none = -(1 << 63)
    sizes = sorted((r.doc_id, r.class_id, r.class_size) for r in near_dedup.classes(df).collect())
    assert sizes == sorted([(none, none, 2)] * 6 + [(7, none, 2), (8, none, 2), (7, 7, 1), (7, 7, 2), (7, 7, 2), (8, 8, 1), (9, 9, 1)])
    kept = near_dedup.dedup(df).collect()
    home = {**{t: t for t in texts}, **dict(zip(edited, texts))}
    assert sorted(home[r.text] for r in kept) == sorted(texts)
    least = {t: min(none if d is None else d for d, u in rows if home[u] == t) for t in texts}
    assert all((none if r.doc_id is None else r.doc_id) == least[home[r.text]] for r in kept)


def test_components_have_fewer_links_each_round(spark, monkeypatch):
    """What a round of components joins must not be all links again: large groups have many, and rounds add up."""
    sizes = []

    def written(df, name):
        out = tables.written(df, name)
        if name == "links":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "written", written)
    rng = random.Random(3)
    groups = [rng.sample(range(-(10**6), 10**6), n) for n in (1, 2, 40, 200)]
    links = [(x, rng.choice(g)) for g in groups for x in g for _ in range(5)] + [(x, y) for g in groups for x, y in zip(g, g[1:])]
    path = sorted(rng.sample(range(2 * 10**6, 3 * 10**6), 100))
    links += list(zip(path, path[1:]))
    got = {r.id: r.comp for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: min(g) for g in [*groups, path] for x in g}
    assert sizes[0] == len({(max(p), min(p)) for p in links if p[0] != p[1]}) and sum(sizes[1:]) < sizes[0]
