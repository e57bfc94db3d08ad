"""Many searches in one job against one search after the other."""

import random

import pytest
from pyspark.sql import functions as F

from oddsloom.functions import text
from oddsloom.operators import ranking
from oddsloom.operators.search import search_many

WORDS = "nfl NFL football footballs superbowl super bowl saints bitcoin btc eth ethereum method the of will election elections senate a1 100k nba_x naïve basketball game team win rain x-ray".split()
QUERIES = ["NFL Saints", "bitcoin", "the of", "super bowl", "eth", "  Election 2024? ", "nba", "win", "rain", "football game", "x-ray!", "naïve", "100k", "saints saints", "", "?!", None, "senate rain btc team", "in", "crypto", "of"]


def markets(spark):
    r = random.Random(7)
    rows = [(k, " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 7))), [r.choice(["Yes", "No", "Saints", "over 100K"]) for _ in range(r.randrange(3))], r.choice(["$12K", None, "3 m", "x"])) for k in range(250)]
    rows += [(900, None, [], None), (901, "", ["Yes"], "$1"), (902, "Will the of be?", [], None), (903, "(NFL) saints_", ["a"], None)]
    return spark.createDataFrame(rows, "id long, title string, outcomes array<string>, volume_text string").repartition(3)


def test_equal_to_single_searches(spark):
    m = markets(spark)
    got = {}
    for r in search_many(m, spark.createDataFrame(list(enumerate(QUERIES)), "qid int, query string")).collect():
        assert (r.qid, r.id) not in got
        got[r.qid, r.id] = round(r.score, 6)
    want = {}
    for k, q in enumerate(QUERIES):
        if q and any(c.isascii() and c.isalnum() for c in q):
            want |= {(k, r.id): round(r.score, 6) for r in text.search(m, q).collect()}
    assert got == want and len(want) > 1000


def test_empty_tables(spark):
    none = spark.createDataFrame([], "qid int, query string")
    assert search_many(markets(spark), none).collect() == []
    assert search_many(markets(spark).limit(0), spark.createDataFrame([(1, "nfl")], "qid int, query string")).collect() == []


@pytest.mark.parametrize("query", ["NFL Saints", "football basketball bitcoin ethereum election hockey baseball"])
def test_a_search_compiles(spark, query, capfd):
    """Its code must not grow beyond what Spark compiles."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        found = text.search(markets(spark), query)
        best = ranking.top_per(found.withColumn("one", F.lit(1)), ["one"], 3, F.desc("score"), "id").collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert len(best) == 3 and "grows beyond 64 KB" not in capfd.readouterr().err


def test_common_words_are_met_in_parts(spark):
    """No task holds all markets of a word or category, and what is found is dealt by market."""
    plan = search_many(markets(spark), spark.createDataFrame([(1, "nfl saints")], "qid int, query string"))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and ("word#" in line or "token#" in line or "term#" in line or "category#" in line)]
    assert any("__part" in line for line in joins) and "RepartitionByExpression [id#" in plan
    assert all("__part" in line for line in joins if "category#" in line)
