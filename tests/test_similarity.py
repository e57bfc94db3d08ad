"""The metric join of vectors against all pairs, on clustered and on scattered vectors, whatever cells and tiles are used."""

import numpy as np
import pytest

from oddsloom.operators import similarity


def rows(kind, n=900, d=8, seed=0):
    r = np.random.default_rng(seed)
    if kind == "clusters":
        centres = r.standard_normal((12, d))
        vec = centres[r.integers(0, 12, n)] + 0.08 * r.standard_normal((n, d))
    else:
        vec = r.standard_normal((n, d))
    vec[:3] = 0
    vec[3:6] = vec[6]  # ties
    vec[7] = -vec[8]
    return [(k, ["big", "small", None][min(2, k % 17 // 15)], k % 3, [float(np.float32(x)) for x in v]) for k, v in enumerate(vec)]


def all_pairs(table):
    out = []
    vec = np.array([r[3] for r in table])
    size = np.linalg.norm(vec, axis=1)
    vec /= np.where(size > 0, size, 1)[:, None]
    cosine = vec @ vec.T
    for i, a in enumerate(table):
        for j in range(i + 1, len(table)):
            b = table[j]
            if a[1] is not None and a[1] == b[1] and a[2] != b[2]:
                out.append((a[0], b[0], a[1], cosine[i, j]))
    return out


@pytest.fixture(params=["whole", "cells", "tiles", "cells, tiles and slices"])
def sizes(request, monkeypatch):
    if "cells" in request.param:
        monkeypatch.setattr(similarity, "CELL", 40)
    if "tiles" in request.param:
        monkeypatch.setattr(similarity, "VALUES", 512)
        monkeypatch.setattr(similarity, "PRODUCTS", 1000)
    if "slices" in request.param:
        monkeypatch.setattr(similarity, "VISITORS", 2)
    return request.param


def frame(spark, table):
    return spark.createDataFrame(table, "id long, category string, platform long, vec array<float>").repartition(3)


@pytest.mark.parametrize("kind, least", [("clusters", 0.9), ("clusters", 0.3), ("scattered", 0.65), ("scattered", -0.5)])
def test_pairs_are_all_pairs(spark, sizes, kind, least):
    table = rows(kind)
    got = {(r.id, r.b_id, r.category): r.similarity for r in similarity.cosine_pairs(frame(spark, table), least).collect()}
    want = {p[:3]: p[3] for p in all_pairs(table) if abs(p[3] - least) > 1e-9 and p[3] > least}
    near = {p[:3] for p in all_pairs(table) if abs(p[3] - least) <= 1e-9}
    assert set(want) <= set(got) and set(got) - set(want) <= near
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_best_and_counts(spark, sizes, monkeypatch):
    monkeypatch.setattr(similarity, "PROBED", 300)
    table = rows("clusters", 400)
    every = [(round(p[3], 6) + 0.0, *p[:3]) for p in all_pairs(table)]
    got = [(r.similarity, r.id, r.b_id, r.category) for r in similarity.cosine_top(frame(spark, table), 15).collect()]
    assert got == sorted(every, key=lambda p: (-p[0], p[1], p[2]))[:15]
    counts = {r.similarity: r.n for r in similarity.cosine_counts(frame(spark, table)).collect()}
    assert sum(counts.values()) == len(every) and abs(sum(k * n for k, n in counts.items()) - sum(p[0] for p in every)) < 1e-2


def test_fewer_pairs_than_asked_for(spark):
    got = similarity.cosine_top(frame(spark, [(1, "a", 0, [1.0, 0.0]), (2, "a", 1, [1.0, 1.0]), (3, "b", 1, [1.0, 1.0])]), 5).collect()
    assert [(r.id, r.b_id, r.similarity) for r in got] == [(1, 2, 0.707107)]


def test_clusters_meet_few(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CELL", 40)
    table = frame(spark, rows("clusters", 3000))
    (big, small) = sorted(similarity.compared(table, 0.9).collect(), key=lambda r: r.category)
    assert big.compared < 0.25 * big.pairs and big.copies < 4
    assert small.vectors < big.vectors and small.compared <= small.pairs
    everything = {r.category: r for r in similarity.compared(table, -1.0).collect()}
    assert everything["big"].compared == everything["big"].pairs


def test_no_vectors(spark):
    none = frame(spark, [])
    assert similarity.cosine_pairs(none, 0.5).collect() == [] and similarity.cosine_top(none, 3).collect() == [] and similarity.compared(none, 0.5).collect() == []


def test_counts_are_exact_however_few_are_counted_at_once(spark, monkeypatch):
    monkeypatch.setattr(similarity, "COUNTED", 50)
    table = rows("clusters", 150)
    want = {}
    for p in all_pairs(table):
        want[round(p[3], 6) + 0.0] = want.get(round(p[3], 6) + 0.0, 0) + 1
    assert {r.similarity: r.n for r in similarity.cosine_counts(frame(spark, table)).collect()} == want


def test_small_cells_share_a_tile(spark, monkeypatch):
    """A vector that visits all cells is sent to each tile once, not to each cell."""
    monkeypatch.setattr(similarity, "CELL", 40)
    big = max(similarity.compared(frame(spark, rows("scattered")), 0.1).collect(), key=lambda r: r.vectors)
    assert big.copies <= 2


def test_pairs_of_opportunities_stay_in_their_tasks(spark):
    from oddsloom.plans import registry, rule_queries  # noqa: F401

    plan = registry.QUERIES["similar_opportunities"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("FlatMapGroupsInArrow")[0]
    assert above != plan and "Join" not in above and "Sort" not in above
