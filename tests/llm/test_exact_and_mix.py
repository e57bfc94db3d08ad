import hashlib
import re
from collections import defaultdict

import numpy as np
import odd
import pytest

from oddsloom.llm import exact_dedup, mixing


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_groups_and_keepers(spark):
    rows = odd.ROWS + [(100 + i, "same\ttext", "en", "a", 0, 0.0) for i in range(50)]
    got = exact_dedup.assign(odd.docs(spark, rows)).collect()
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[norm(t)].append(d)
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    texts = {(d, norm(t)) for d, t, *_ in rows}
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        ids = groups[by_sha[r.text_sha256]]
        assert (r.doc_id, by_sha[r.text_sha256]) in texts
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_rounds_do_not_matter(spark, monkeypatch, least):
    monkeypatch.setattr(exact_dedup, "LEAST_ROUNDS", least)
    monkeypatch.setattr(exact_dedup, "SHARE", 40)
    rows = [((i * 37) % 500 if i % 11 else None, f"text {i % 90}", "en", "a", 0, 0.0) for i in range(700)]
    got = exact_dedup.assign(odd.docs(spark, rows).repartition(9)).collect()
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[t].append(d)
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == 700 and sum(r.kept for r in got) == 90
    for r in got:
        ids = sha[r.text_sha256]
        assert (r.group_size, r.keep_id) == (len(ids), min((i for i in ids if i is not None), default=None))


def test_merges_tell_digests_of_one_beginning_apart():
    """Eight equal bytes, then others, or all equal and another length."""
    entries = [((1, k % 3, 0, k % 2), k % 5, 0, 0, 100 - k, k, 1) for k in range(60)] + [((1, 0, 0, 0), 0, 0, 1, 0, 99, 1)]
    runs = [np.array(entries[k::4], exact_dedup.ENTRY) for k in range(4)]
    got = exact_dedup.merged(runs)
    want = {}
    for sha, n, h, none, id_, rid, _ in entries:
        want.setdefault((sha, n, h), []).append((none, id_, rid))
    assert [(tuple(map(int, e["sha"])), int(e["n"]), int(e["h"])) for e in got] == sorted(want)
    for e in got:
        mine = want[tuple(map(int, e["sha"])), int(e["n"]), int(e["h"])]
        assert (int(e["none"]), int(e["id"]), int(e["rid"])) == min(mine) and e["rows"] == len(mine)


def test_dedup_keeps_columns_and_one_of_each(spark):
    out = exact_dedup.dedup(odd.docs(spark))
    assert out.columns == odd.docs(spark).columns
    assert sorted(norm(r.text) for r in out.collect()) == sorted({norm(t) for _, t, *_ in odd.ROWS})
    assert exact_dedup.assign(odd.docs(spark, [])).collect() == []


def fill(sizes, weights, demand, most):
    """Water filling by repeated clamping."""
    free, target = set(sizes), {}
    while True:
        left = demand - sum(target.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            free.discard(s)


def test_targets_and_passes(spark):
    rows = [(i, "w " * (i % 7), "en", f"s{i % 4}" if i % 9 else None, 0, 0.0) for i in range(200)] + [(900 + i, "w " * 50, "en", "s0", 0, 0.0) for i in range(40)]
    got = mixing.plan(odd.docs(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += len(t.split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, taken = fill(sizes, weights, 1.5 * sum(sizes.values()), 2), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 2 * r.size and all(0 <= p <= 1 for p in r.positions) and r.taken == len(r.positions) * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 50
    again = mixing.plan(odd.docs(spark, rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_follows_the_schedule(spark):
    rows = [(i, "w " * 10, "en", "ab"[i % 2], 0, 0.0) for i in range(400)]
    df = odd.docs(spark, rows)
    mixed = mixing.mix(df, weights=(1, 1), share=1.0, ramps=(1.0, -1.0))
    order = [r.source for r in mixed.collect()]
    assert mixed.columns == df.columns and len(order) == 400
    assert order[:100].count("b") > 70 and order[-100:].count("a") > 70


def test_odd_rows_mix(spark):
    got = mixing.plan(odd.docs(spark)).collect()
    assert len(got) == len(odd.ROWS) and mixing.plan(odd.docs(spark, [])).collect() == []
    per_id = defaultdict(int)
    for r in got:
        per_id[r.doc_id] += len(r.positions)
    counts = defaultdict(int)
    for r in mixing.mix(odd.docs(spark)).collect():
        counts[r.doc_id] += 1
    assert dict(counts) == {k: v for k, v in per_id.items() if v}
