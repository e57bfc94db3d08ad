"""The best pair of a game is among the first outcomes of each team and price."""

from pyspark.sql import functions as F

from oddsloom.operators import sports


def games(spark, n):
    rows = []
    for k in range(n):
        kalshi, price = k % 2 == 0, 0.3 + k % 4 / 50
        rows.append((k, str(k), "Kalshi" if kalshi else "Polymarket", "Saints vs Rams", ["saints", "rams"], "nfl", "rams-saints", None, "$2K", "$1K", [("Saints", price, None), ("Rams", price + 0.1, None)]))
    schema = "ord long, id string, platform string, title string, teams array<string>, sport string, signature string, group_day date, volume_text string, liquidity_text string, outcomes array<struct<name: string, price: double, teamName: string>>"
    return spark.createDataFrame(rows, schema)


def test_first_outcomes_have_the_best_pair(spark):
    df = games(spark, 200)
    every, firsts = (sports.opportunities(sports.outcome_pairs(df, firsts=f)) for f in (False, True))
    best = lambda found: found.orderBy(F.desc("max_spread"), "k_ord", "p_ord", "k_place", "p_place").first()
    assert best(every) == best(firsts) and firsts.count() == 8 < every.count()
