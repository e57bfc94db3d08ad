"""Whitening, decontamination and source divergence over odd rows and small tables, against plain loops."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import odd
import pytest

from oddsloom.llm import decontamination, divergence, qdwh, queries, whitening

# --- whitening --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 5, 40])
@pytest.mark.parametrize("kind", ["random", "graded", "equal", "two values", "zero"])
def test_eigenvectors_equal_numpys(n, kind):
    r = np.random.default_rng(n)
    q = np.linalg.qr(r.standard_normal((n, n)))[0]
    values = {"random": r.uniform(0, 1, n), "graded": 10.0 ** -np.arange(n), "equal": np.ones(n), "two values": np.repeat([5.0, 1.0], [n // 2, n - n // 2]), "zero": np.zeros(n)}[kind]
    a = (q * values) @ q.T
    got, vecs = qdwh.eigenvectors((a + a.T) / 2, n)
    assert np.abs(got - np.sort(values)[::-1]).max() < 1e-13 * max(1, n)
    assert np.abs(vecs @ vecs.T - np.eye(n)).max() < 1e-13
    assert np.abs(a @ vecs.T - vecs.T * got).max() < 1e-13 * max(1, n)


@pytest.mark.parametrize("bits", [3, 20, 45])
def test_products_of_whole_numbers_are_exact(bits):
    y = np.random.default_rng(bits).integers(-(2**bits), 2**bits, (300, 4))
    assert (whitening.gram(y) == y.astype(object).T @ y.astype(object)).all()


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, n int").repartition(3)


def test_whitening_equals_a_plain_version(spark):
    r = np.random.default_rng(5)
    rows = [(k, [float(np.float32(v)) for v in r.standard_normal(12) * np.arange(1, 13)]) for k in range(200)]
    odd_ones = [(300, None), (301, [1.0] * 11 + [None]), (302, [1.0] * 11 + [math.inf]), (303, [math.nan] * 12), (304, [1.0]), (305, []), (306, [3e38] * 12)]
    again = [(7, rows[7][1]), (None, rows[8][1])]
    got = whitening.whiten(vectors(spark, rows + odd_ones + again)).collect()
    kept = rows + again
    x = np.floor(1024 * np.array([v for _, v in kept])).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    v = np.array([[float(Fraction(int(n * (x[:, i].astype(object) @ x[:, j]) - int(sums[i]) * int(sums[j])), n * n)) for j in range(12)] for i in range(12)])
    values, vecs = np.linalg.eigh(v)
    values, vecs = values[::-1][:8], vecs[:, ::-1][:, :8]
    w = ((x - sums / n) @ vecs) / np.sqrt(values)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    assert len(got) == 8 * n and Counter(r.vec_id for r in got) == Counter(d for d, _ in kept for _ in range(8))
    sign = [np.sign(next(r.whitened for r in got if r.vec_id == 0 and r.component == k + 1) * w[0, k]) for k in range(8)]
    place = {d: k for k, (d, _) in enumerate(kept)}
    for r in got:
        k, c = place[r.vec_id], r.component - 1
        assert abs(r.whitened - sign[c] * w[k, c]) < 1e-9 and r.deviation == deviation[k] and r.n == n
        assert abs(r.explained - values[c] / np.trace(v)) < 1e-12 and r.identity_error < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_vectors_without_variance_have_no_components(spark, rows):
    assert whitening.whiten(vectors(spark, rows)).collect() == []


def test_fewer_components_than_asked_for(spark):
    got = whitening.whiten(vectors(spark, [(1, [0.0, 1.0]), (2, [2.0, 1.0])])).collect()
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 9)), r.explained) for r in got) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_deviations_beyond_a_long_are_null(spark):
    got = whitening.whiten(vectors(spark, [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [0.0, 0.0])])).collect()
    assert {r.vec_id for r in got if r.deviation is None} == {1, 2} and all(math.isfinite(r.whitened) for r in got)


# --- decontamination --------------------------------------------------------------------------------------------------


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
ITEMS = [(1, PASSAGE), (2, None), (3, "Short item"), (4, "--- "), (5, PASSAGE.upper()), (10, "x x x x x x x x x x x x"), (None, "naïve 中文 endoftext"), (3, "word word word word word word word word word word tail"), (6, PASSAGE + " xi " + PASSAGE)]
DOCS = [
    *[r[:2] for r in odd.ROWS],
    (30, f"before {PASSAGE} after"),
    (31, f"{PASSAGE.replace(' ', ', ')}! {PASSAGE} and a short   ITEM."),
    (32, " ".join(PASSAGE.split()[1:]) + " " + " ".join(PASSAGE.split()[:9])),
    (33, "x " * 30),
    (34, "short"),
    (35, "item short item"),
]


def plain_report(docs, items):
    windows = defaultdict(set)
    for i, text in items:
        t = tokens(text)
        n = min(10, len(t))
        for k in range(len(t) - n + 1 if t else 0):
            windows[tuple(t[k : k + n])].add("" if i is None else str(i))
    out = []
    for d, text in docs:
        t = tokens(text)
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(t) - n + 1):
                if w := windows.get(tuple(t[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= w
        out.append((d, len(t), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def contaminated_tables(spark, docs=DOCS, items=ITEMS):
    d = spark.createDataFrame([(*r, 1, None) for r in docs], "doc_id long, text string, items int, row string").repartition(3)
    return d, spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, words int").repartition(2)


@pytest.mark.parametrize("block", [None, 12])
def test_decontamination_equals_a_plain_loop(spark, monkeypatch, block):
    if block:  # several passes
        monkeypatch.setattr(decontamination, "BLOCK", block)
    docs, items = contaminated_tables(spark)
    got = decontamination.report(docs, items).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, plain_report(DOCS, ITEMS)))
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(str((d, t)) for (d, t), r in zip(DOCS, plain_report(DOCS, ITEMS)) if not r[5])


def test_long_items_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 14)
    r = np.random.default_rng(1)
    text = " ".join(r.choice(list("abc"), 100))
    docs = [(k, " ".join(text.split()[k : k + 12 + k % 3])) for k in range(60)] + [(90, "a " * 20)]
    got = decontamination.report(*contaminated_tables(spark, docs, [(1, text)])).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_report(docs, [(1, text)]))


def test_longest_matches(spark):
    docs, items = contaminated_tables(spark)
    got = {(r.item_id, r.item_word): (r.n_words, r.doc_id, r.doc_word, r.n_places) for r in decontamination.longest_matches(docs, items, least=5).collect()}
    want = {}
    for i, text in ITEMS:
        t = tokens(text)
        for a in range(len(t)):
            found = []
            for d, doc in DOCS:
                words = tokens(doc)
                for p in range(len(words)):
                    n = 0
                    while a + n < len(t) and p + n < len(words) and t[a + n] == words[p + n]:
                        n += 1
                    found.append((n, (d is not None, d), p))
            best = max(n for n, _, _ in found)
            places = sorted(x[1:] for x in found if x[0] == best)
            if best >= 5 and best >= want.get((None if i is None else str(i), a), (0,))[0]:
                want[None if i is None else str(i), a] = (best, places[0][0][1], places[0][1], len(places))
    assert got == want


@pytest.mark.parametrize("docs, items", [([], ITEMS), (DOCS, []), ([], [])])
def test_empty_tables_of_decontamination(spark, docs, items):
    got = decontamination.report(*contaminated_tables(spark, docs, items)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, plain_report(docs, items)))


# --- divergence -------------------------------------------------------------------------------------------------------


def plain_audit(rows, least, top):
    term = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, words = lang or "", source or "", term(text)
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs.update((lang, w) for w in set(words))
    out = []
    for lang, sources in groups.items():
        kept = [w for (of, w), n in docs.items() if of == lang and n >= least]
        total = {s: sum(counts[lang, s][w] for w in kept) for s in sources}
        share = lambda n, of: 1 + 1_000_000_000 * (n + 5) // (of + 5 * len(kept))
        p = {s: {w: share(counts[lang, s][w], total[s]) for w in kept} for s in sources}
        q = {w: share(sum(counts[lang, s][w] for s in sources), sum(total.values())) for w in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s]
            terms = [(q[w] - p[s][w], w.encode(), w) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)]
    return out


AUDITED = [
    *[(r[1], r[2], r[3]) for r in odd.ROWS],
    ("The the END end of it", "en", "c"),
    ("abcdefgh abcdefghi abcdefghij abcdefgh1x ABCDEFGH", "en", "b"),
    ("éa é eé 中文中文中文中文 中文", "xx", "a"),
    *[(f"one two {'three ' * k} word", "en", "abc"[k % 3]) for k in range(9)],
    *[(f"w{'abcdefgh' * (k % 4)} tail{'x' * k}", "de", f"s{k % 5}") for k in range(20)],
]


def audited(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n int, term string").repartition(3)


@pytest.mark.parametrize("least, top", [(1, 50), (2, 3), (100, 50)])
def test_audit_equals_a_plain_loop(spark, least, top):
    got = [tuple(r) for r in divergence.audit(audited(spark, AUDITED), least, top).collect()]
    assert sorted(got) == sorted(plain_audit(AUDITED, least, top))


def test_audit_in_small_blocks(spark, monkeypatch):
    """Several shards a partition, blocks of few terms, and pairs of sources that never meet in a block of sources."""
    monkeypatch.setattr(divergence, "TERMS", 3)
    monkeypatch.setattr(divergence, "SOURCES", 2)
    monkeypatch.setattr(divergence, "SHARD", 64)
    got = [tuple(r) for r in divergence.audit(audited(spark, AUDITED), 1, 50).collect()]
    assert sorted(got) == sorted(plain_audit(AUDITED, 1, 50))


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(audited(spark, [])).collect() == []


def test_counts_of_any_size_are_exact(spark):
    rows = spark.createDataFrame([(9_000_000_000_000_000_000 // 2, 9_000_000_000_000_000_000 // 2 + 17, 1000)], "n long, total long, kept long")
    r = rows.select(divergence._parts(rows.n, rows.total, rows.kept).alias("p"), "*").first()
    assert r.p == 1 + 1_000_000_000 * (r.n + 5) // (r.total + 5 * r.kept)


def test_queries_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd.docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op11_embedding_whitening", "op12_decontamination", "op13_source_divergence"):
        assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []
