"""Feeds read from JSON files, snapshots appended, rewritten and streamed."""

import datetime
import json

from pyspark.sql import functions as F

from oddsloom.operators import snapshots
from oddsloom.sources import venues
from oddsloom.streaming import snapshots as streaming


def feed(spark, tmp_path, rows, schema):
    path = tmp_path / "feed.json"
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return venues.read_feed(spark, str(path), schema)


def outcomes(r):
    return [(o.name, o.percentage, o.price, o.teamName) for o in r.outcomes]


def test_polymarket(spark, tmp_path):
    events = [
        {"id": "1", "title": "Two", "volume": "1500", "endDate": "2025-12-18T00:00:00Z", "markets": [{"groupItemTitle": "A", "outcomePrices": '["0.25","0.75"]', "slug": "s"}, {"question": "B?", "outcomePrices": '["0.5"]'}, {"question": "C?"}]},
        {"id": "2", "question": "One", "volumeNum": 0, "volume": "oops", "slug": "own", "markets": [{"outcomePrices": "0.4"}]},
        {"id": "3", "title": "None"},
        {"title": "No identifier"},
        "not json",
    ]
    got = {r.id: r for r in venues.polymarket(feed(spark, tmp_path, events, venues.POLYMARKET)).collect()}
    assert sorted(got) == ["polymarket:1", "polymarket:2", "polymarket:3"]
    one, two, three = (got[f"polymarket:{k}"] for k in "123")
    assert outcomes(one) == [("B?", 50, 0.5, None), ("A", 25, 0.25, None)] and (one.volume, one.volume_text, one.date, one.link, one.markets) == (1500, "$1.5K", "2025-12-18", "https://polymarket.com/event/s", 3)
    assert outcomes(two) == [("No", 60, 0.6, None), ("Yes", 40, 0.4, None)] and (two.title, two.volume, two.link) == ("One", 0, "https://polymarket.com/event/own")
    assert outcomes(three) == [("Yes", 50, 0.5, None), ("No", 50, 0.5, None)]


def test_kalshi(spark, tmp_path):
    markets = [
        {"event_ticker": "KXNFLGAME-25A", "ticker": "a", "yes_bid": 19, "yes_sub_title": "Rams", "no_sub_title": "Bills", "volume": 1000, "title": "Combo", "subtitle": "long enough title"},
        {"event_ticker": "FED", "ticker": "b", "yes_bid": 0, "last_price": 30, "volume": 50},
        {"event_ticker": "FED", "ticker": "c", "yes_bid": 70},
        {"event_ticker": "E", "ticker": "d"},
        {"ticker": "no event"},
    ]
    m = feed(spark, tmp_path, markets, venues.KALSHI)
    series = spark.createDataFrame([("FED", "Federal Reserve rate", None, None)], "ticker string, title string, question string, sub_title string")
    got = {r.id: r for r in venues.kalshi(m, None, series).collect()}
    game, fed, e = got["kalshi:KXNFLGAME-25A"], got["kalshi:FED"], got["kalshi:E"]
    assert outcomes(game) == [("No", 81, 0.81, "Bills"), ("Yes", 19, 0.19, "Rams")] and (game.title, game.volume) == ("long enough title", 10)
    assert game.link == "https://kalshi.com/markets/kxnflgame/kxnflgame-25a"
    assert outcomes(fed) == [("Yes", 70, 0.7, None), ("Yes", 30, 0.3, None)] and fed.title == "Federal Reserve rate"
    assert outcomes(e) == [("Yes", 50, 0.5, None), ("No", 50, 0.5, None)] and e.title == "Market E"


def test_predictit_and_matches(spark, tmp_path):
    markets = [{"id": 7, "name": "Who?", "url": "u", "contracts": [{"name": "A", "bestBuyYesCost": 0.3, "totalSharesTraded": 5, "dateEnd": "2025-12-08T00:00:00"}, {"name": "B", "lastTradePrice": 0.6, "totalSharesTraded": 2}]}, {"id": 8, "name": "Empty"}]
    got = {r.id: r for r in venues.predictit(feed(spark, tmp_path, markets, venues.PREDICTIT)).collect()}
    one = got["predictit:7"]
    assert outcomes(one) == [("B", 60, 0.6, None), ("A", 30, 0.3, None)] and (one.volume, one.date) == (7, "Dec 8")
    assert got["predictit:8"].volume_text == "N/A" and got["predictit:8"].outcomes == []
    side = lambda i, p: {"marketId": i, "yesPrice": p}
    rows = [{"matchId": k, "polymarket": side("p", a), "kalshi": side("k", b), "spread": 0.1, "spreadPercent": 20, "combinedVolume": 5} for k, (a, b) in enumerate([(0.4, 0.5), (0.5, 0.4), (0.5, 0.5)])]
    got = venues.matches(feed(spark, tmp_path, rows, venues.MATCHES)).orderBy("id").collect()
    assert [(r.buy_market_id, r.buy_platform, r.buy_price, r.sell_market_id, r.sell_price) for r in got] == [("p", "Polymarket", 0.4, "k", 0.5), ("k", "Kalshi", 0.4, "p", 0.5), ("k", "Kalshi", 0.5, "p", 0.5)]
    assert {(r.spread, r.max_spread) for r in got} == {(10.0, 20.0)}


def test_lookup_and_front_page(spark):
    m = spark.createDataFrame([(f"{p.lower()}:{k}", p, float(k)) for p in ("Polymarket", "Kalshi", "PredictIt") for k in range(60)], "id string, platform string, volume double")
    assert [r.id for r in venues.market(m, "kalshi:7").collect()] == ["kalshi:7"] and venues.market(m, "other:7").collect() == []
    page = venues.front_page(m, 55)
    assert {r.platform: r["count"] for r in page.groupBy("platform").count().collect()} == {"Polymarket": 55, "Kalshi": 55, "PredictIt": 50}
    assert page.agg(F.min("volume")).first()[0] == 5


def snapshot_rows(spark, days):
    at = lambda d: datetime.datetime(2024, 1, d, 10, 30)
    return spark.createDataFrame([("m", 0, k, at(d), float(d)) for k, d in enumerate(days)], "market_id string, outcome_index int, event_id int, recorded_at timestamp, value double")


def test_append_and_retention(spark, tmp_path):
    path, out = str(tmp_path / "table"), str(tmp_path / "kept")
    for d in (1, 9, 30):
        snapshots.append(snapshot_rows(spark, [d]).drop("recorded_at"), path, F.lit(f"2024-01-{d:02d} 10:30:00").cast("timestamp"))
    assert {r.day.day for r in spark.read.parquet(path).collect()} == {1, 9, 30}
    report = snapshots.rewrite_survivors(spark, path, out, F.lit("2024-01-30 00:00:00").cast("timestamp"), 20)
    assert tuple(report.first())[:2] == (2, 1)
    assert [r.day.day for r in spark.read.parquet(out).collect()] == [30]


def test_stream(spark, tmp_path):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for days in ([1, 1, 2], [2, 3]):  # the second of January comes again
        snapshot_rows(spark, days).write.mode("append").parquet(source)
    schema = "market_id string, outcome_index int, event_id int, recorded_at timestamp, value double"
    for _ in range(2):  # a second run finds nothing new
        q = streaming.append_to(streaming.deduplicated(streaming.read_stream(spark, source, schema)), sink, check)
        q.awaitTermination()
    got = spark.read.parquet(sink)
    assert sorted(r.recorded_at.day for r in got.collect()) == [1, 2, 3]
    hours = streaming.hourly_last(streaming.read_stream(spark, source, schema))
    q = hours.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.hour.day, r.last_value, r.n) for r in spark.table("hours").collect()) == [(1, 1.0, 2), (2, 2.0, 2), (3, 3.0, 1)]


def test_search_of_a_feed(spark):
    events = spark.createDataFrame([(3, "KXNFL-1", "Saints at Rams"), (1, "KXNFL-2", "The nfl draft"), (2, None, "NFLX price"), (4, "nfl", None)], "ord int, ticker string, title string")
    ids = lambda q, n=20: [r.ord for r in venues.search_kalshi(events, q, n).collect()]
    assert ids("NFL") == [1, 4] and ids("will the kxnfl") == [1, 3] and ids("kxnfl", 1) == [1] and ids("the of") == [] and ids("saints draft") == []


def test_events_in_listed_order(spark):
    events = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "b"), ("x", 1, "x")], "ticker string, ord int, title string")
    listed = spark.createDataFrame([("b", 5), ("missing", 1), ("a", 9), (None, 0), ("x", 10)], "ticker string, place int")
    got = [(r.ticker, r.rank, r.title) for r in venues.in_listed_order(events, listed, "ticker", 3).collect()]
    assert got == [("b", 2, "b"), ("a", 3, "new")]


def test_a_feed_is_parsed_once_a_row(spark):
    from oddsloom.plans import venue_queries

    found = venue_queries.venue_union(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    parsed = [line for line in plan.splitlines() if "from_json(" in line]
    assert len(parsed) == 3 and all(line.count("from_json(") == 1 and "Generate" in line for line in parsed)


def test_a_front_page_comes_by_limits(spark):
    from oddsloom.plans import venue_queries

    plan = venue_queries.front_page(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("GlobalLimit") == 3
