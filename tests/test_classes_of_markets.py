"""Pairs of markets are worked out for classes of equal markets, and their members become pairs at the end."""

import itertools

import pytest
from pyspark.sql import functions as F

from oddsloom.operators import matching, sports
from oddsloom.plans import queries, registry, rule_queries  # noqa: F401

SF = "/root/testdata/sf0.01"


@pytest.fixture
def met(monkeypatch):
    """Joins that were made, so that a test can count their rows."""
    found, real = [], matching.dealt_join
    monkeypatch.setattr(matching, "dealt_join", lambda *a: found.append(real(*a)) or found[-1])
    monkeypatch.setattr(matching, "BLOCK", 16)
    return found


def markets(spark, titles, n=120):
    rows = [(k, f"m{k}", "ABC"[k * 7 % 3], titles[k % len(titles)]) for k in range(n)]
    return rows, spark.createDataFrame(rows, "ord long, id string, platform string, title string")


def every(rows):
    return {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[2] != b[2]}


def held(got, rows, met=None):
    got = [(r.id, r.b_id) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == every(rows)
    assert met is None or [df.count() for df in met] and sum(df.count() for df in met) <= 16


def test_markets_of_one_event_meet_by_title(spark, met):
    rows, df = markets(spark, ["Saints vs Rams", "Rams at Saints"])
    found = df.withColumns({"signature": F.lit("rams-saints-2025-03-02"), "teams": F.array(F.lit("saints"), F.lit("rams"))})
    held(sports.same_event_pairs(found), rows, met)


@pytest.mark.parametrize("name", ["category_title_pairs", "subject_text_pairs"])
def test_pairs_of_titles_are_not_joined_again(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "b_ord" not in plan and "__rows" in plan


def test_questions_meet_by_what_they_say(spark, met):
    rows, df = markets(spark, [f"Will it {w} {k}?" for k in range(40) for w in ("rise", "fall")])
    asked = df.withColumns({"signature": F.lit("price_above"), "subject": F.lit("it"), "outcome": F.lit("yes"), "timeframe": F.lit(None).cast("string")})
    held(matching.question_pairs(asked), rows, met)


def test_races_meet_by_what_is_scored(spark, met):
    rows, df = markets(spark, [f"Ohio Senate race {k}" for k in range(40)])
    races = df.withColumns({"state": F.lit("Ohio"), "office": F.lit("Senate"), "year": F.lit("2024")})
    held(matching.entity_pairs(races), rows, met)


def test_games_meet_by_what_gives_confidence(spark, met):
    rows, df = markets(spark, ["NFL: Saints vs Rams", "NFL: Rams at Saints"])
    games = df.withColumns({"teams": F.array(F.lit("saints"), F.lit("rams")), "sport": F.lit("NFL")})
    held(sports.confident_pairs(games), rows, met)


def test_markets_of_two_teams_become_pairs_from_lists(spark, met):
    rows, df = markets(spark, ["x"])
    games = df.withColumn("teams", F.when(F.col("ord") % 2 == 0, F.array(F.lit("saints"), F.lit("rams"))).otherwise(F.array(F.lit("rams"), F.lit("saints"))))
    found = matching.team_set_pairs(games)
    held(found, rows)
    assert not met and "__rows" in found._jdf.queryExecution().optimizedPlan().toString()


def test_games_of_a_band_become_pairs_from_lists(spark, monkeypatch):
    import datetime

    monkeypatch.setattr(matching, "BLOCK", 16)
    day = lambda k: None if k % 3 == 0 else datetime.date(1970, 1, 1 + k % 5)
    rows = [(k, None if k % 17 == 0 else ["saints-rams", "heat-lakers"][k % 7 == 0], day(k), k % 2) for k in range(300)]
    games = spark.createDataFrame(rows, "id long, signature string, day date, venue int")
    for days in (1, 2):
        found = matching.band_pairs(games.filter("venue = 0"), games.filter("venue = 1"), "signature", "day", days)
        assert found.columns == ["id", "signature", "day", "venue", "b_id", "b_signature", "b_day", "b_venue"]
        near = lambda x, y: x == y if x is None or y is None else abs((x - y).days) <= days  # noqa: B023, E731
        want = {a + b for a in rows for b in rows if a[3] == 0 and b[3] == 1 and a[1] == b[1] and a[1] is not None and near(a[2], b[2])}
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert "__b_rows" in found._jdf.queryExecution().optimizedPlan().toString()


def test_lists_without_a_pair_in_order_do_not_meet(spark, met):
    rows, df = markets(spark, ["x"], 400)
    of = matching.classed(df, t=F.lit("x"))
    pairs = of.select("cls", F.col("cls").alias("b_cls")).distinct()
    lists = matching.met_lists(of, pairs).select(F.size("__rows").alias("n"), F.size("b___rows").alias("m")).collect()
    assert max(max(r) for r in lists) <= 16
    assert sum(r.n * r.m for r in lists) < 1.3 * len(every(rows))
    held(matching.members(of, pairs), rows)


def test_members_in_any_order_of_numbers(spark, met):
    ords = [k * 7919 % 1009 * 10 ** (k % 3) for k in range(150)]
    rows = [(o, f"m{o}", "ABC"[k % 3]) for k, o in enumerate(sorted(set(ords)))]
    df = spark.createDataFrame([(*r, "x") for r in reversed(rows)], "ord long, id string, platform string, title string")
    of = matching.classed(df, t=F.lit("x"))
    held(matching.members(of, of.select("cls", F.col("cls").alias("b_cls")).distinct()), rows)


@pytest.mark.parametrize("name", ["question_same_pairs", "subject_text_pairs", "category_title_pairs"])
def test_what_titles_say_is_worked_out_once_a_title(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = [k for k, line in enumerate(plan) if "RepartitionByExpression [title" in line]
    assert dealt
    # Nothing of a title is worked out by what reads the markets, below the step that deals their titles.
    for k in dealt:
        depth = len(plan[k]) - len(plan[k].lstrip(" :+-"))
        below = []
        for line in plan[k + 1 :]:
            if len(line) - len(line.lstrip(" :+-")) <= depth:
                break
            below.append(line)
        assert below and not any("rlike" in line.lower() or "regexp" in line.lower() for line in below)


def test_titles_are_joined_back_to_all_markets(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "A b"), (3, None), (4, "")], "id long, title string")
    got = matching.by_titles(df, low=F.lower("title"), n=F.when(F.col("title") == "", None).otherwise(F.length("title")))
    assert sorted(map(tuple, got.select("id", "title", "low", "n").collect())) == [(1, "A b", "a b", 3), (2, "A b", "a b", 3), (4, "", "", None)]
