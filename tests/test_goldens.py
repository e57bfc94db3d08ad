"""Golden rows of the functions, one table each: input, expected."""

import datetime

import pytest
from pyspark.sql import functions as F

from oddsloom.functions import numbers, rules, teams, text
from oddsloom.operators import arbitrage, matching, ranking, snapshots
from oddsloom.sources import venues


def rows(spark, values, schema):
    return spark.createDataFrame([(k, *v) for k, v in enumerate(values)], f"k int, {schema}")


def found(df, *columns):
    return [tuple(r)[0] if len(columns) == 1 else tuple(r) for r in df.orderBy("k").select(*columns).collect()]


def test_volumes_and_labels(spark):
    golden = {"$35 vol": 35, "$1.2M": 1200000, "M$ 500K": 500000, "300K Shares": 300000, "N/A": 0, None: 0, "$1,234": 1, "35 markets": 35000000}
    assert found(rows(spark, [(x,) for x in golden], "x string"), numbers.parse_volume(F.col("x"))) == list(golden.values())
    df = rows(spark, [(1500.0,), (2500000.0,), (0.0,)], "x double")
    assert found(df, numbers.currency_label(F.col("x"))) == ["$1.5K", "$2.5M", "$0"]
    assert found(df, numbers.currency_label(F.col("x"), "N/A"))[2] == "N/A"
    assert found(df, numbers.cents(F.col("x"))) == [15, 25000, 0]


def test_feed_fields(spark):
    prices = {'["0.72","0.28"]': [0.72, 0.28], "0.4": [0.4], "oops": [0], None: [0]}
    assert found(rows(spark, [(x,) for x in prices], "x string"), venues.outcome_prices(F.col("x"))) == list(prices.values())
    df = rows(spark, [("KXNBAGAME-25DEC20BOSTOR",), ("FED",)], "x string")
    assert found(df, venues.series_of(F.col("x"))) == ["KXNBAGAME", "FED"]
    df = rows(spark, [("Will the Lakers win?",), ("Best Picture Winner",)], "x string")
    assert found(df, venues.short_name(F.col("x"))) == ["Lakers", "Picture Winner"]
    assert found(rows(spark, [("Professional Basketball Game!",)], "x string"), venues.slugify(F.col("x"))) == ["professional-basketball-game"]


def test_queries_and_categories(spark):
    assert text.query_terms("Will the NFL, game be on?") == ["nfl", "game", "on"]
    df = rows(spark, [("Will the NFL, game be on?",)], "x string")
    assert found(df, text.query_terms_of(F.col("x"))) == [["nfl", "game", "on"]]
    golden = {"Will Bitcoin trade at $100k?": "sports", "Ohio Senate primary": "politics", "BTC price 100k": "economics"}
    assert found(rows(spark, [(x,) for x in golden], "x string"), text.title_category(F.col("x"))) == list(golden.values())
    m = rows(spark, [("Rams vs Seahawks", "Kalshi", ["Yes", "No"])], "title string, platform string, outcomes array<string>")
    assert found(m, text.relevance(F.col("title"), F.col("platform"), F.col("outcomes"), "rams seahawks")) == [11]
    m = rows(spark, [("NFL: Rams vs Seahawks", ["Yes", "No"], "$20K")], "title string, outcomes array<string>, volume_text string")
    assert [r.score for r in text.search(m, "nfl").collect()] == [402]


def test_dates(spark):
    golden = {"nfl-la-sea-2025-12-18": "2025-12-18", "25dec18": "2025-12-18", "12/18/25": "2025-12-18", "Dec 18, 2025": "2025-12-18", "KXNFLGAME-25DEC27BALGB": None, "Dec 5": "2031-12-05"}
    assert found(rows(spark, [(x,) for x in golden], "x string"), text.extract_date(F.col("x"), 2031)) == list(golden.values())


def test_teams(spark):
    golden = {
        "Rams vs Seahawks": ["seahawks", "rams"], "Minnesota at Milwaukee Winner?": ["timberwolves", "bucks"], "No": ["saints"], "Niners vs Ravens game": ["49ers", "ravens"],
        "Min Arctic sea ice": [], "Penn State Nittany Lions at Duke Blue Devils": ["penn state", "duke", "devils", "lions", "nittany lions", "blue devils"], None: [],
    }
    assert found(rows(spark, [(x,) for x in golden], "x string"), teams.teams_from_text(F.col("x"))) == list(golden.values())
    two = ["bucks", "timberwolves"]
    golden = {("Yes", "Minnesota Winner?", None): "bucks", ("No", "Minnesota Winner?", None): "saints", ("Yes", "x", "Milwaukee"): "bucks", ("Yes", "x", "Minnesota"): "vikings", ("Maybe", "x", None): None}
    df = rows(spark, [(*x[:2], two, x[2]) for x in golden], "o string, t string, e array<string>, n string")
    assert found(df, teams.outcome_team(*map(F.col, "oten"))) == list(golden.values())
    df = rows(spark, [(["rams", "bills"],), (["rams", "heat"],), (["rams"],)], "x array<string>")
    assert found(df, teams.valid_for(F.col("x"), "nfl"), teams.valid_for(F.col("x"), "chess")) == [(True, True), (False, True), (False, False)]


def test_titles_and_similarities(spark):
    golden = {"Will the Saints beat the Buccaneers?": "new orleans beat tampa bay", "$100k by 50%?": "100k 50 percent"}
    assert found(rows(spark, [(x,) for x in golden], "x string"), text.normalise_title(F.col("x"))) == list(golden.values())
    golden = {("bitcoin above 100k", "bitcoin reach 100k"): 2 / 3, ("abc", "abc def"): 3 / 7 * 0.9, ("x", "x"): 1.0}
    df = rows(spark, golden, "a string, b string")
    assert found(df, text.text_similarity(F.col("a"), F.col("b"))) == pytest.approx(list(golden.values()))
    df = rows(spark, [("stale", "least"), ("heat", "heater")], "a string, b string")
    assert found(df, text.word_similarity(F.col("a"), F.col("b"))) == [1.0, 0.8]
    both = [("Ohio Senate election 2026", "Ohio Senate race 2026"), ("Ohio Senate election 2026", "Iowa Senate race 2026")]
    df = rows(spark, both, "a string, b string")
    side = lambda c: {"title": F.col(c), **{k: text.entity(F.col(c), k) for k in ("state", "office", "year")}}
    assert found(df, matching.political_score(side("a"), side("b"))) == [100, 0]


def test_arbitrage(spark):
    df = rows(spark, [(0.4, 0.5), (0.6, 0.5), (0.5, 0.4)], "a double, b double")
    got = df.withColumns(arbitrage.stakes(F.col("a"), F.col("b"), F.lit(1000.0), arbitrage.fee_rate(F.lit("Kalshi")), arbitrage.fee_rate(F.lit("Polymarket")))).orderBy("k").collect()
    one = got[0]
    assert [one.investment1, one.investment2, one.payout, one.total_fees, one.net_profit, one.roi] == pytest.approx([444.444444, 555.555556, 1111.111111, 8.888889, 102.222222, 10.222222])
    assert one.is_valid and not got[1].is_valid and [got[1].net_profit, got[1].roi] == pytest.approx([-101.818182, -10.181818])
    assert found(df, arbitrage.signed_spread(F.col("a"), F.col("b")))[::2] == pytest.approx([25, -25])
    df = rows(spark, [(0.40, 0.55), (0.40, 0.40)], "a double, b double")
    assert found(df, arbitrage.first_outcome_spread(F.col("a"), F.col("b"))) == pytest.approx([15, 0])
    tiers = lambda c, *t: found(rows(spark, c, "x double"), numbers.confidence_tier(F.col("x"), *t))
    assert tiers([(95.0,), (85.0,), (70.0,)], 90, 80) == tiers([(0.76,), (0.72,), (0.66,)], 0.75, 0.70, False) == ["high", "medium", "low"]
    d = rows(spark, [(2.0, 10.0), (3.0, 20.0), (5.0, 30.0)], "s double, v double")
    assert tuple(arbitrage.dashboard(d, "s", "v").first()) == (3, 5.0, 2, 60.0)
    side = lambda p: rows(spark, [("e", "Yes", p, 0)], "key string, name string, price double, k_ int").select("key", "name", "price", F.col("k_").alias("k"))
    from oddsloom.operators import sports

    best = sports.outcome_matches(side(0.4), side(0.5), "key").first()
    assert [best.spread, best.max_spread, best.first_buys] == [pytest.approx(10), pytest.approx(25), True]


def test_ranking(spark):
    m = spark.createDataFrame([("p1", "P", 3.0), ("p2", "P", 2.0), ("p3", "P", 1.0), ("k1", "K", 9.0), ("i1", "I", 2.0), ("i2", "I", 1.0)], "id string, platform string, volume double")
    mix = lambda n: [r.id for r in ranking.round_robin(m, "platform", ["P", "K", "I"], n, F.desc("volume"), "id").orderBy("place").collect()]
    assert mix(4) == ["p1", "k1", "i1", "p2"] and mix(10) == ["p1", "k1", "i1", "p2", "i2", "p3"]
    d = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "id string, ord int")
    assert sorted(map(tuple, ranking.dedupe_first(d.withColumn("v", F.col("ord")), "id").select("id", "v").collect())) == [("a", 1), ("b", 2)]
    assert sorted(map(tuple, ranking.dedupe_last(d.withColumn("v", F.col("ord")), "id").select("id", "v", "first_ord").collect())) == [("a", 3, 1), ("b", 2, 2)]


def test_snapshots(spark):
    o = [(10.0, 0, "a", 0.1), (60.0, 1, "b", 0.6), (20.0, 2, "c", 0.2), (5.0, 3, "d", 0.05)]
    m = spark.createDataFrame([("m", 2000.0, o)], "id string, volume double, outcomes array<struct<percentage:double,k:int,name:string,price:double>>")
    got = sorted((-1 if r.outcome_index is None else r.outcome_index, r.outcome_name, r.price, r.outcome_percentage, r.volume) for r in snapshots.snapshot_rows(m).collect())
    assert got == [(-1, None, 0.6, None, 2000), (0, "b", 0.6, 60, 2000), (1, "c", 0.2, 20, 2000), (2, "a", 0.1, 10, 2000)]
    t = lambda k: datetime.datetime(2024, 1, k)
    s = [("m", t(2), 0, "A", 60.0, None), ("m", t(1), 0, "B", None, 0.5), ("m", t(1), 1, None, None, 0.25), ("m", t(1), 1, "C", None, None)]
    s = spark.createDataFrame(s, "market_id string, recorded_at timestamp, outcome_index int, outcome_name string, outcome_percentage double, outcome_price double")
    got = sorted((r.outcome_index, r.outcome_name, [(p.recorded_at.day, p.value) for p in r.data]) for r in snapshots.series_arrays(snapshots.outcome_series(s)).collect())
    assert got == [(0, "B", [(1, 50), (2, 60)]), (1, "Outcome 2", [(1, 25)])]
    s = spark.createDataFrame([("m", t(k), k, p) for k, p in enumerate([0.4, 1.0, 45.0, None], 1)], "market_id string, recorded_at timestamp, event_id int, price double")
    assert [r.value for r in snapshots.legacy_series(s).orderBy("event_id").collect()] == [40, 100, 45, 0]
    s = spark.createDataFrame([(t(30 - d),) for d in (1, 19, 21)], "recorded_at timestamp")
    as_of = F.lit("2024-01-30").cast("timestamp")
    assert tuple(snapshots.retention_report(s, as_of, 20).first())[:2] == (1, 2) and snapshots.survivors(s, as_of, 20).count() == 2
    with pytest.raises(ValueError):
        snapshots.survivors(s, as_of, 0)


def test_similarity_reports(spark):
    counts = spark.createDataFrame([(0.1, 1), (0.2, 1), (0.3, 1), (0.4, 1)], "similarity double, n long")
    assert tuple(matching.similarity_stats(counts).first()) == (4, 0.1, 0.25, 0.4, 0.3)
    counts = spark.createDataFrame([(0.1, 1), (0.2, 1), (0.65, 1), (-0.3, 1)], "similarity double, n long")
    assert {r.band: r.n for r in matching.similarity_histogram(counts).collect()} == {"0-20%": 2, "20-40%": 1, "60-80%": 1}


def test_rules(spark):
    titles = ["Lakers at Heat", "nfl: Dallas vs Trail Blazers", "Panthers vs Jets", "Florida Panthers vs Jets", "Rams vs Chargers", "Rain", "New York Jets @ Buffalo Bills"]
    got = found(rows(spark, [(x,) for x in titles], "x string"), rules.title_teams(F.col("x")))
    assert got == [["los angeles", "miami"], ["dallas", "portland"], [], ["florida", "new york"], [], [], ["new york", "buffalo"]]
    golden = {"Will BTC reach 100k at the Fed?": "sports", "Rockets": "sports", "Which party wins": "politics", "eth above 5k": "crypto", "Rain": "other"}
    assert found(rows(spark, [(x,) for x in golden], "x string"), rules.vector_category(F.col("x"))) == list(golden.values())
    golden = {"Will the BTC price win": "bitcoin price win", "Houston Rockets": "rockets rockets", "Trail Blazers": "trail trail trail blazers"}
    assert found(rows(spark, [("Will the BTC price win",), ("Houston Rockets",)], "x string"), rules.vector_title(F.col("x"))) == list(golden.values())[:2]
    golden = {"Combo": False, "Rain": False, "Kalshi Market 1": False, "Kalshi Market 1234567": True, None: False, "Ravens": True}
    assert found(rows(spark, [(x,) for x in golden], "x string"), rules.usable_title(F.col("x"))) == list(golden.values())
    golden = {("Milan at Turin", "Turin at Rome"): True, ("Milan at Turin", "Rome at Bari"): False, ("Milan vs Turin", "x"): True}
    assert found(rows(spark, golden, "a string, b string"), rules.sports_agree(F.col("a"), F.col("b"))) == list(golden.values())
    golden = {("Ohio Senate", "Senate"): True, ("Ohio Senate", "Iowa House"): False, ("Ohio race", "Texas race"): False, ("Republican primary", "General"): False, ("Republican Senate primary", "Democratic primary"): False, ("Democratic primary", "Democrati  house primary"): True}
    assert found(rows(spark, golden, "a string, b string"), rules.politics_agree(F.col("a"), F.col("b"))) == list(golden.values())
    golden = {("Rams vs Bills", ("Yes", "No")): True, ("Player points", ("Yes",)): False, ("Rams vs Bills", ("Over 45", "80+")): False, ("Rams vs Bills", ("Over 45", "Rams")): True, ("Rams vs Bills", ("over",)): True, ("Rams vs Bills", ()): True}
    df = rows(spark, [(a, list(b)) for a, b in golden], "a string, b array<string>")
    assert found(df, rules.team_win(F.col("a"), F.col("b"))) == list(golden.values())
    df = rows(spark, [("Rams vs Bills", "25dec18"), ("Rams", "25dec18"), ("Bills at Rams", "x")], "t string, i string")
    assert found(df, rules.event_signature(F.col("t"), F.col("i"), F.lit(None).cast("string"), 2025)) == ["bills-rams-2025-12-18", None, "bills-rams"]
    side = lambda t, teams_, s: {"title": F.lit(t), "teams": F.array(*map(F.lit, teams_)), "sport": F.lit(s)}
    one = side("A vs B", ["a", "b"], "NFL")
    scores = [rules.sports_confidence(one, side(*x)) for x in (("B at A", ["b", "a"], "nfl"), ("B", ["b", "c"], "NBA"), ("C vs D", ["c", "d"], "NFL"))]
    assert tuple(spark.range(1).select(*(x.alias(f"c{k}") for k, x in enumerate(scores))).first()) == (100, 35, 0)
