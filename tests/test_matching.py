import itertools
import re

import pytest

from oddsloom.operators import matching
from oddsloom.plans import queries, registry  # noqa: F401
from oddsloom.plans import relations as rel

SF = "/root/testdata/sf0.01"


@pytest.fixture(params=[7, 512])
def block(request, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", request.param)


def race(title):
    """State, office and year of the templates' two kinds of political titles."""
    if re.search(r"\b(vs|at|game|championship)\b", title, re.I) or not re.search(r"\b(Senate|Governor|party)\b", title):
        return None
    state = re.search("Ohio|Iowa|Texas|Nevada|New York|Utah", title)
    office, year = re.search("Senate|Governor", title), re.search("20(24|25|26)", title)
    return tuple(x and x[0] for x in (state, office, year))


def test_entity_matches_cover_all_markets(spark, block):
    rows = [(r.id, r.platform, race(r.title)) for r in rel.relation(spark, SF, rel.MARKET).collect()]
    rows = sorted(r for r in rows if r[2] and r[2][0])
    want = {(a[0], b[0], 100) for a, b in itertools.combinations(rows, 2) if a[1] != b[1] and a[2] == b[2]}
    got = [tuple(r) for r in registry.QUERIES["entity_match_score_all"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert max(b for _, b, _ in got) > 1500
    assert {tuple(r) for r in registry.QUERIES["entity_match_score"](spark, SF).collect()} == want


def test_entity_pairs_with_missing_parts(spark, block):
    states, offices, years = [None, "Ohio", "ohio", "Utah"], [None, "Senate", "House", "US House of Representatives", "Representative"], [None, "2024", "2026"]
    rows = [(k, k, "AB"[k % 2], title, *x) for k, (title, *x) in enumerate(itertools.product(["President", "Race", "Primary race"], states, offices, years))]
    df = spark.createDataFrame(rows, "ord long, id long, platform string, title string, state string, office string, year string")
    b = df.select(*(df[c].alias(f"b_{c}") for c in df.columns))
    side = lambda p: {c: matching.F.col(p + c) for c in ("title", "state", "office", "year")}
    every = df.crossJoin(b).filter("ord < b_ord AND platform <> b_platform").withColumn("score", matching.political_score(side(""), side("b_"))).filter("score >= 55")
    want = sorted(tuple(r) for r in every.select("id", "b_id", "score").collect())
    got = sorted(tuple(r) for r in matching.entity_pairs(df, 55).select("id", "b_id", "score").collect())
    assert got == want and len(want) > 500


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances_of_all_pairs_of_names(spark, block):
    names = sorted(r.name for r in spark.read.parquet(f"{SF}/part.parquet").selectExpr("p_name AS name").distinct().collect())
    want = [(a, b, edits(a, b), round(1 - edits(a, b) / max(len(a), len(b)), 6)) for a, b in itertools.combinations(names, 2)]
    got = sorted(tuple(r) for r in registry.QUERIES["levenshtein_pairs_all"](spark, SF).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=2e-6)
    assert any(a[0] != b[0] for a, b, *_ in got)
    assert sorted(tuple(r) for r in registry.QUERIES["levenshtein_pairs"](spark, SF).collect()) == got
