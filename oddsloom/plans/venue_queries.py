"""Queries on the venues' feeds: events as JSON made from the test tables, mapped, searched, looked up, and their histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.functions import text
from oddsloom.functions.expressions import once
from oddsloom.operators import histories, ranking, sports
from oddsloom.plans import relations as rel
from oddsloom.plans.queries import label_sql
from oddsloom.plans.registry import query, table
from oddsloom.sources import pages, venues

# --- feeds ------------------------------------------------------------------------------------------------------------

_KEY = "l_partkey * 10 + l_linenumber"


def _read(rows: DataFrame, schema: str) -> DataFrame:
    """Structs written as JSON and read by the feed's own schema."""
    return once(rows.select(F.to_json(F.struct("*")).alias("text")), e=F.from_json("text", schema)).select("e.*")


def _children(spark: SparkSession, sf_dir: str, child: Column) -> DataFrame:
    """Per order its lines as an array in order of part and line."""
    li = table(spark, sf_dir, "lineitem")
    listed = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.expr(_KEY).alias("k"), "l_suppkey", child.alias("c")))).alias("cs"))
    return listed.select("l_orderkey", F.transform("cs", lambda x: x.c).alias("children"))


def polymarket_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.format_string('["%.2f", "0.5"]', 0.1 + F.col("l_quantity") / 100)
    shaped = F.when(F.col("l_linenumber") == 2, F.format_string("%.2f", 0.1 + F.col("l_quantity") / 100)).when(F.col("l_linenumber") == 3, "oops").otherwise(price)
    child = F.struct(
        F.concat(F.lit("slug-"), F.col("l_partkey")).alias("slug"),
        F.concat(F.lit("Q"), F.col("l_linenumber")).alias("question"),
        F.when(F.col("l_linenumber") == 1, F.lit("")).otherwise(F.col("l_returnflag")).alias("groupItemTitle"),
        shaped.alias("outcomePrices"),
    )
    o = table(spark, sf_dir, "orders").join(_children(spark, sf_dir, child), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return _read(
        o.select(
            F.when(F.col("o_orderkey") % 50 > 0, F.col("o_orderkey").cast("string")).alias("id"),
            F.when(F.col("o_orderkey") % 7 > 0, F.concat(F.lit("Event "), F.col("o_orderkey"))).alias("title"),
            F.lit("Asked").alias("question"),
            F.col("o_totalprice").cast("string").alias("volume"),
            F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") * 64).when(F.col("o_orderkey") % 3 == 1, 0.0).alias("volumeNum"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("endDate"),
            F.concat(F.lit("event-"), F.col("o_orderkey")).alias("slug"),
            F.when(F.col("o_orderkey") % 11 > 0, F.col("children")).alias("markets"),
        ),
        venues.POLYMARKET,
    )


def _shown(m: DataFrame) -> DataFrame:
    outcomes = F.array_join(F.transform("outcomes", lambda o: F.concat(o["name"], F.lit(":"), o.percentage.cast("int"))), ",")
    return m.select("id", "platform", "title", outcomes.alias("outcomes"), F.round("volume", 4).alias("volume"), "volume_text", "date", "link", F.col("markets").cast("int").alias("markets"))


_NAMED = "string_agg(name || ':' || CAST(percentage AS INTEGER), ',' ORDER BY percentage DESC, k)"
_POLYMARKET = f"""
    WITH c AS (SELECT l_orderkey AS o, {_KEY} AS k, l_suppkey, l_linenumber, 'slug-' || l_partkey AS slug, CASE WHEN l_linenumber = 1 THEN 'Q1' ELSE l_returnflag END AS name,
        CASE WHEN l_linenumber = 3 THEN 0 ELSE round(0.1 + l_quantity / 100, 2) END AS price FROM lineitem WHERE l_orderkey % 11 <> 0),
      n AS (SELECT *, count(*) OVER (PARTITION BY o) AS n, row_number() OVER (PARTITION BY o ORDER BY k, l_suppkey) AS place, first_value(slug) OVER (PARTITION BY o ORDER BY k, l_suppkey) AS first_slug FROM c),
      e AS (SELECT o, n, first_slug, place AS k, name, floor(price * 100 + 0.5) AS percentage FROM n WHERE n > 1
        UNION ALL SELECT o, n, first_slug, u, CASE u WHEN 0 THEN 'Yes' ELSE 'No' END, floor(CASE u WHEN 0 THEN price ELSE 1 - price END * 100 + 0.5) FROM n, unnest([0, 1]) t(u) WHERE n = 1
        UNION ALL SELECT o_orderkey, 0, NULL, u, CASE u WHEN 0 THEN 'Yes' ELSE 'No' END, 50 FROM orders, unnest([0, 1]) t(u) WHERE o_orderkey NOT IN (SELECT o FROM c)),
      g AS (SELECT o, max(n) AS n, max(first_slug) AS slug, {_NAMED} AS outcomes FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY percentage DESC, k) AS r FROM e) r WHERE r <= 2 GROUP BY o),
      p AS (SELECT *, CASE WHEN o % 3 = 0 THEN o_totalprice * 64 ELSE o_totalprice END AS v FROM g JOIN orders ON o_orderkey = o WHERE o % 50 <> 0)
    SELECT 'polymarket:' || o AS id, 'Polymarket' AS platform, CASE WHEN o % 7 <> 0 THEN 'Event ' || o ELSE 'Asked' END AS title, outcomes, round(v, 4) AS volume, {label_sql} AS volume_text,
      strftime(o_orderdate, '%Y-%m-%d') AS date, 'https://polymarket.com/event/' || coalesce(slug, 'event-' || o) AS link, CAST(n AS INTEGER) AS markets FROM p
"""


@query(_POLYMARKET)
def polymarket_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(venues.polymarket(polymarket_feed(spark, sf_dir)))


def polymarket_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events fifty orders a page, in turn a bare list, under ``data``, under ``events``, an error and a text that breaks off, with bad entries."""
    e = polymarket_feed(spark, sf_dir).withColumn("o", F.regexp_extract("slug", r"(\d+)$", 1).cast("long"))
    text = F.to_json(F.struct(*(c for c in e.columns if c != "o")))
    listed = e.groupBy(F.floor(F.col("o") / 50).alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("o", text.alias("t")))).alias("es"))
    bad = ['"oops"', "17", "null", '{"id": null}', '{"title": "No identifier", "volumeNum": "many"}']
    rows = F.concat(F.lit("["), F.array_join(F.concat(F.array(*map(F.lit, bad)), F.transform("es", lambda x: x.t)), ","), F.lit("]"))
    kind = F.col("page_id") % 5
    page = (
        F.when(kind == 0, rows)
        .when(kind == 1, F.concat(F.lit('{"data": '), rows, F.lit(', "events": 3}')))
        .when(kind == 2, F.concat(F.lit('{"data": {}, "events": '), rows, F.lit("}")))
        .when(kind == 3, F.concat(F.lit('{"error": "busy", "data": null}')))
        .otherwise(F.expr("substring(rows, 1, length(rows) - 9)"))
    )
    return listed.withColumn("rows", rows).select("page_id", page.alias("page"))


@query(f"SELECT * FROM ({_POLYMARKET}) p WHERE CAST(floor(CAST(split_part(id, ':', 2) AS BIGINT) / 50) AS BIGINT) % 5 < 3")
def polymarket_trending_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(venues.polymarket(pages.events(polymarket_pages(spark, sf_dir), venues.POLYMARKET)))


@query(
    """SELECT ['array', 'data', 'events', 'other', 'corrupt'][k + 1] AS shape, count(*) AS pages, CAST(sum(CASE WHEN k < 3 THEN n + 5 ELSE 0 END) AS BIGINT) AS events,
      CAST(sum(CASE WHEN k < 3 THEN gone + 5 ELSE 0 END) AS BIGINT) AS dropped
    FROM (SELECT CAST(floor(o_orderkey / 50) AS BIGINT) % 5 AS k, count(*) AS n, count(*) FILTER (o_orderkey % 50 = 0) AS gone FROM orders GROUP BY k, floor(o_orderkey / 50)) p GROUP BY k"""
)
def polymarket_page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.report(polymarket_pages(spark, sf_dir), venues.POLYMARKET)


def kalshi_feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Markets, events and series."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    ticker = F.concat(F.lit("KX"), F.element_at(F.array(F.lit("NFL"), F.lit("NBA")), (F.col("l_orderkey") % 2 + 1).cast("int")), F.lit("GAME-"), F.col("l_orderkey"))
    markets = li.select(
        F.when(F.col("l_suppkey") % 97 > 0, ticker).alias("event_ticker"),
        F.format_string("T%010d-%d", F.expr(_KEY), F.col("l_suppkey")).alias("ticker"),
        F.when(F.col("l_linenumber") % 3 == 0, 0.0).otherwise(F.col("l_quantity")).alias("yes_bid"),
        F.when(F.col("l_linenumber") % 2 == 0, 40.0).alias("last_price"),
        F.floor(F.col("l_extendedprice")).cast("double").alias("volume"),
        F.lit("Combo").alias("event_title"),
        F.concat(F.lit("Market title "), F.col("l_linenumber") * 0).alias("title"),
        F.lit("2025-12-18T00:00:00Z").alias("expiration_time"),
    )
    key = F.concat(F.lit("KX"), F.element_at(F.array(F.lit("NFL"), F.lit("NBA")), (F.col("o_orderkey") % 2 + 1).cast("int")), F.lit("GAME-"), F.col("o_orderkey"))
    none = F.lit(None).cast("string")
    events = o.filter("o_orderkey % 3 = 0").select(key.alias("ticker"), F.when(F.col("o_orderkey") % 2 == 0, "short").otherwise(F.concat(F.lit("Event number "), F.col("o_orderkey"))).alias("title"), none.alias("question"), none.alias("event_title"), none.alias("sub_title"))
    series = spark.createDataFrame([("KXNFLGAME", "Professional Football Game", None, None)], "ticker string, title string, question string, sub_title string")
    return _read(markets, venues.KALSHI), events, series


_KALSHI = f"""
    WITH m AS (SELECT l_orderkey AS o, printf('T%010d-%d', {_KEY}, l_suppkey) AS ticker, CASE WHEN l_linenumber % 3 <> 0 AND l_quantity <> 0 THEN l_quantity WHEN l_linenumber % 2 = 0 THEN 40 END AS price, floor(l_extendedprice) AS volume
        FROM lineitem WHERE l_suppkey % 97 <> 0),
      n AS (SELECT *, count(*) OVER (PARTITION BY o) AS n FROM m),
      e AS (SELECT o, n, volume, ticker, 0 AS k, 'Yes' AS name, floor(coalesce(price, CASE WHEN n = 1 THEN 50 ELSE 0 END) / 100 * 100 + 0.5) AS percentage FROM n
        UNION ALL SELECT o, n, 0, ticker, 1, 'No', floor((100 - coalesce(price, 50)) / 100 * 100 + 0.5) FROM n WHERE n = 1),
      r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY percentage DESC, ticker, k) AS r FROM e),
      g AS (SELECT o, max(n) AS n, sum(volume) / 100 AS v, string_agg(name || ':' || CAST(percentage AS INTEGER), ',' ORDER BY r) FILTER (r <= 5) AS outcomes FROM r GROUP BY o),
      t AS (SELECT *, CASE WHEN o % 2 = 0 THEN 'KXNFLGAME' ELSE 'KXNBAGAME' END AS series FROM g)
    SELECT 'kalshi:' || series || '-' || o AS id, 'Kalshi' AS platform,
      CASE WHEN o % 3 = 0 AND o % 2 = 1 AND length('Event number ' || o) > 10 THEN 'Event number ' || o WHEN o % 2 = 0 THEN 'Professional Football Game' ELSE 'Market title 0' END AS title,
      outcomes, round(v, 4) AS volume, {label_sql} AS volume_text, '2025-12-18' AS date, 'https://kalshi.com/markets/' || lower(series) || '/' || lower(series) || '-' || o AS link, CAST(n AS INTEGER) AS markets FROM t
"""


@query(_KALSHI)
def kalshi_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(venues.kalshi(*kalshi_feed(spark, sf_dir)))


def predictit_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = F.struct(
        F.col("l_partkey").alias("id"),
        F.concat(F.col("l_returnflag"), F.col("l_linenumber")).alias("name"),
        F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity") / 64).alias("bestBuyYesCost"),
        F.when(F.col("l_linenumber") % 2 > 0, 0.25).alias("lastTradePrice"),
        F.floor("l_extendedprice").alias("totalSharesTraded"),
        F.lit("2025-12-08T00:00:00").alias("dateEnd"),
    )
    o = table(spark, sf_dir, "orders").join(_children(spark, sf_dir, child), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = o.select(F.when(F.col("o_orderkey") % 40 > 0, F.col("o_orderkey")).alias("id"), F.concat(F.lit("Market "), F.col("o_orderkey")).alias("name"), F.concat(F.lit("https://predictit.example/"), F.col("o_orderkey")).alias("url"), F.col("children").alias("contracts"))
    return _read(rows, venues.PREDICTIT)


_PREDICTIT = f"""
    WITH c AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_KEY}, l_suppkey) AS k, l_returnflag || l_linenumber AS name, floor(l_extendedprice) AS shares,
        floor(coalesce(CASE WHEN l_linenumber % 3 > 0 AND l_quantity <> 0 THEN l_quantity / 64 END, CASE WHEN l_linenumber % 2 > 0 THEN 0.25 END, 0) * 100 + 0.5) AS percentage FROM lineitem),
      g AS (SELECT o, count(*) AS n, sum(shares) AS shares, {_NAMED} AS outcomes FROM c GROUP BY o),
      p AS (SELECT o_orderkey AS o, coalesce(n, 0) AS n, coalesce(shares, 0)::DOUBLE AS v, coalesce(outcomes, '') AS outcomes FROM orders LEFT JOIN g ON o_orderkey = o WHERE o_orderkey % 40 <> 0)
    SELECT 'predictit:' || o AS id, 'PredictIt' AS platform, 'Market ' || o AS title, outcomes, v AS volume, replace({label_sql}, '$0', CASE WHEN v = 0 THEN 'N/A' ELSE '$0' END) AS volume_text,
      CASE WHEN n > 0 THEN 'Dec 8' END AS date, 'https://predictit.example/' || o AS link, CAST(n AS INTEGER) AS markets FROM p
"""


@query(_PREDICTIT)
def predictit_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(venues.predictit(predictit_feed(spark, sf_dir)))


def all_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (q(spark, sf_dir) for q in (polymarket_markets, kalshi_markets, predictit_markets)))


_ALL = f"SELECT * FROM ({_POLYMARKET}) a UNION ALL SELECT * FROM ({_KALSHI}) b UNION ALL SELECT * FROM ({_PREDICTIT}) c"


@query(f"SELECT platform, count(*) AS n, round(sum(volume), 2) AS volume, sum(markets)::BIGINT AS markets FROM ({_ALL}) u GROUP BY platform")
def venue_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_venues(spark, sf_dir).groupBy("platform").agg(F.count("*").alias("n"), F.round(F.sum("volume"), 2).alias("volume"), F.sum("markets").alias("markets"))


@query(
    f"""SELECT platform, id, round(volume, 4) AS volume FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY volume DESC, id) AS r FROM ({_ALL}) u) r
    WHERE r <= CASE platform WHEN 'Polymarket' THEN 300 WHEN 'Kalshi' THEN 300 ELSE 50 END"""
)
def front_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return venues.front_page(all_venues(spark, sf_dir), 300).select("platform", "id", "volume")


@query(f"SELECT id, title, outcomes FROM ({_ALL}) u WHERE id IN ('polymarket:12', 'predictit:17', 'kalshi:KXNFLGAME-14')")
def market_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = all_venues(spark, sf_dir)
    found = (venues.market(every, i) for i in ("polymarket:12", "predictit:17", "kalshi:KXNFLGAME-14"))
    return reduce(DataFrame.unionByName, found).select("id", "title", "outcomes")


@query(f"SELECT id, volume FROM ({_PREDICTIT}) p ORDER BY volume DESC, id LIMIT 200")
def predictit_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictit_markets(spark, sf_dir).orderBy(F.desc("volume"), "id").limit(200).select("id", "volume")


@query(f"SELECT id, title FROM ({_PREDICTIT}) p WHERE contains(lower(title), 'market') AND regexp_matches(lower(title), '\\b12\\b') ORDER BY id LIMIT 20")
def predictit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = predictit_markets(spark, sf_dir)
    return m.filter(text.all_terms(F.col("title"), text.query_terms("The market 12"))).orderBy("id").limit(20).select("id", "title")


_SERIES = "SELECT id, volume FROM ({k}) k WHERE starts_with(id, 'kalshi:KXNFLGAME') ORDER BY volume DESC, id LIMIT 500"


@query(_SERIES.format(k=_KALSHI))
def kalshi_by_sport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's markets of one series, grouped and mapped."""
    markets, events, series = kalshi_feed(spark, sf_dir)
    of_series = markets.filter(venues.series_of(F.col("event_ticker")) == "KXNFLGAME")
    return _shown(venues.kalshi(of_series, events, series)).orderBy(F.desc("volume"), "id").limit(500).select("id", "volume")


_CHILD = "struct<slug: string, question: string, title: string>"


def sport_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events, repeated by customer; slugs, titles or child markets name a sport."""
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    child = F.struct(F.when(k % 5 == 3, "x/nba/y").alias("slug"), F.when(k % 5 == 4, "").alias("question"), F.when(k % 5 == 4, "See /sports/nba/ now").alias("title"))
    return table(spark, sf_dir, "orders").select(
        k.alias("ord"),
        F.col("o_custkey").alias("id"),
        F.when(k % 5 == 0, F.concat(F.lit("NBA-la-bos-"), k)).otherwise(none).alias("slug"),
        F.when(k % 5 == 1, "On /nba/ tonight").otherwise("None").alias("title"),
        F.when(k % 10 == 2, "all of nba-").otherwise(none).alias("description"),
        none.alias("question"),
        F.when(k % 4 > 0, F.array(child)).otherwise(F.array().cast(f"array<{_CHILD}>")).alias("markets"),
    )


@query(
    """SELECT o_custkey AS id, o AS ord FROM (SELECT o_custkey, max(o_orderkey) AS o, min(o_orderkey) AS f FROM orders GROUP BY o_custkey) e
    WHERE o % 4 <> 0 AND (o % 5 IN (0, 1, 3, 4) OR o % 10 = 2) ORDER BY f LIMIT 500"""
)
def polymarket_by_sport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sports.by_sport(sport_events(spark, sf_dir), "nba", 500).select("id", "ord")


@query(
    r""", u AS (SELECT *, 0 AS part FROM x WHERE id % 40 = 0 UNION ALL SELECT *, 1 FROM x WHERE id % 30 = 0 UNION ALL SELECT *, 2 FROM x),
    f AS (SELECT *, (contains(lower(title), 'governor'))::INT + (contains(lower(title), 'ohio'))::INT AS found FROM u),
    d AS (SELECT * FROM f WHERE found = 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY volume DESC, part) = 1)
    SELECT id, volume FROM d ORDER BY volume DESC, id LIMIT 40""",
    rel.MARKET,
)
def polymarket_search(m: DataFrame) -> DataFrame:
    """Two search results and the pages behind them, filtered by the query's tokens; of one event the first counts."""
    parts = [m.filter("id % 40 = 0"), m.filter("id % 30 = 0"), m]
    rows = reduce(DataFrame.unionByName, (p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)))
    found, needed = text.token_match_counts(F.array("title"), ["governor", "ohio"])
    hits = rows.filter(found >= needed).withColumn("place", F.struct((-F.col("volume")).alias("v"), "part"))
    return ranking.dedupe_first(hits.select("id", "volume", "place"), "id", "place").orderBy(F.desc("volume"), "id").limit(40).select("id", "volume")


# --- histories and chains of lookups ----------------------------------------------------------------------------------


@query(
    f"""WITH m AS (SELECT l_orderkey AS o, CAST(l_partkey AS VARCHAR) AS token, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, {_KEY}, l_suppkey) AS r FROM lineitem)
    SELECT o AS id, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) * 1000 AS time, round(value / 500 * 100, 6) AS value FROM m JOIN events ON CAST(user_id AS VARCHAR) = token WHERE r = 1"""
)
def polymarket_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = F.struct(F.col("l_extendedprice").cast("string").alias("volume"), F.array(F.col("l_partkey").cast("string"), F.lit("other")).alias("clobTokenIds"))
    events = _children(spark, sf_dir, child).select(F.col("l_orderkey").alias("id"), F.col("children").alias("markets"))
    points = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("token"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("value") / 500).alias("p"))
    return histories.polymarket_history(events, points).select("id", "time", F.round("value", 6).alias("value"))


_CANDLES = ("end_period_ts", "timestamp", "time", "start_period_ts", "price_close", "price", "close_price", "close", "last_price")


@query(
    f"""WITH m AS (SELECT l_orderkey AS o, {_KEY} * 1000 + l_suppkey AS k, l_extendedprice AS volume, epoch_us(l_shipdate) / 1000 + 631152000000 AS ms, l_linenumber AS n, l_quantity AS q FROM lineitem),
      r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY volume DESC, k) AS r FROM m WHERE n % 3 > 0)
    SELECT o AS event_ticker, 'T' || k AS ticker, CAST(ms AS BIGINT) + u * 3600000 AS time, CASE WHEN n % 2 = 0 THEN 0 ELSE q + u END AS value FROM r, unnest([0, 1]) t(u) WHERE r = 1"""
)
def kalshi_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are markets, and some of an order share a ticker; those of every third number have no candles, times are in seconds or milliseconds."""
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.expr(f"{_KEY} * 1000 + l_suppkey"))
    ticker = F.concat(F.lit("T"), F.col("k"))
    line = F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("line")
    markets = li.select(F.col("l_orderkey").alias("event_ticker"), ticker.alias("ticker"), line, F.col("l_extendedprice").alias("volume"), F.col("k").alias("ord"))
    # Twenty years on, as times are told apart by their size.
    seconds, n = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6 + 631152000).cast("double"), F.col("l_linenumber")

    def candle(hour: int) -> Column:
        at, price = seconds + 3600 * hour, F.when(n % 2 == 1, F.col("l_quantity") + hour).otherwise(0.0)
        own = {"timestamp": F.when(n % 4 < 2, at), "start_period_ts": F.when(n % 4 >= 2, at * 1000), "close_price": price}
        return F.struct(*(own.get(c, F.lit(None)).cast("double").alias(c) for c in _CANDLES))

    candles = F.when(n % 3 > 0, F.array(candle(0), candle(1))).otherwise(F.slice(F.array(candle(0)), 1, 0))
    return histories.kalshi_history(markets, li.select(F.col("l_orderkey").alias("event_ticker"), ticker.alias("market_ticker"), line, candles.alias("candlesticks")), "line")


@query(
    f"""WITH f AS (SELECT l_orderkey AS o, l_partkey AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_KEY}, l_suppkey) AS r FROM lineitem)
    SELECT o AS id, strftime(l_shipdate, '%Y-%m-%d') AS date, round(l_discount * 100, 6) AS value FROM f JOIN lineitem ON l_orderkey = o AND l_partkey = c WHERE r = 1"""
)
def predictit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    markets = _children(spark, sf_dir, F.struct(F.col("l_partkey").alias("id"))).select(F.col("l_orderkey").alias("id"), F.col("children").alias("contracts"))
    li = table(spark, sf_dir, "lineitem")
    chart = li.select(F.col("l_orderkey").alias("market_id"), F.col("l_partkey").alias("contract_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_discount").alias("closePrice"))
    return histories.predictit_history(markets, chart).select("id", "date", F.round("value", 6).alias("value"))


@query(
    """WITH o AS (SELECT o_custkey AS c, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) FILTER (o_orderkey % 2 = 0) AS even,
        string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) FILTER (o_orderkey % 3 = 0) AS third,
        string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS every FROM orders GROUP BY o_custkey),
      a AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 3 = 0 THEN o.even END AS a, CASE WHEN c_custkey % 3 = 1 THEN o.every END AS b, CASE WHEN c_custkey % 6 = 2 THEN o.third END AS c1, CASE WHEN c_custkey % 6 = 5 THEN p.every END AS d
        FROM customer LEFT JOIN o ON o.c = c_custkey LEFT JOIN o p ON p.c = c_custkey - 1)
    SELECT CAST(c AS VARCHAR) AS ticker, CASE WHEN a IS NOT NULL THEN 'event' WHEN b IS NOT NULL THEN 'listed' WHEN c1 IS NOT NULL THEN 'fallback' ELSE 'fallback listed' END AS source, coalesce(a, b, c1, d) AS markets
    FROM a WHERE coalesce(a, b, c1, d) IS NOT NULL"""
)
def kalshi_event_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tickers; their orders are markets that the event itself, the list or the fallback has."""
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("ticker"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("string").alias("ticker"))

    def of(rows: DataFrame) -> DataFrame:
        each = rows.groupBy(F.col("o_custkey").cast("string").alias("ticker")).agg(F.collect_list(F.struct("ticker")).alias("markets"))
        return asked.select("c_custkey", "ticker").join(each, "ticker", "left")

    events = of(orders.filter("o_orderkey % 2 = 0")).filter("c_custkey % 3 = 0").select("ticker", "markets")
    listed = orders.filter("o_custkey % 3 = 1").select(F.col("o_custkey").cast("string").alias("event_ticker"), "ticker")
    other = of(orders.filter("o_orderkey % 3 = 0")).filter("c_custkey % 3 = 2")
    own = F.when(F.col("c_custkey") % 2 == 1, (F.col("c_custkey") - 1).cast("string")).otherwise("")
    empty = F.array().cast("array<struct<ticker:string>>")
    fallback = other.select("ticker", own.alias("own"), F.when(F.col("c_custkey") % 2 == 0, F.col("markets")).otherwise(empty).alias("markets"))
    found = histories.event_markets(asked.select("ticker"), events, listed, fallback)
    return found.select("ticker", "source", F.array_join("markets", ",").alias("markets"))


# --- the venues' own lists --------------------------------------------------------------------------------------------


@query(
    """SELECT ticker, title FROM (SELECT o_orderkey AS ord, 'KX' || CASE WHEN o_orderkey % 2 = 0 THEN 'NFL' ELSE 'NBA' END || 'GAME-' || o_orderkey AS ticker, CASE WHEN o_orderkey % 2 = 0 THEN 'short' ELSE 'Event number ' || o_orderkey END AS title
      FROM orders WHERE o_orderkey % 3 = 0) e
    WHERE contains(lower(title || ' ' || ticker), 'number') AND contains(lower(title || ' ' || ticker), 'kxnbagame') ORDER BY ord LIMIT 20"""
)
def kalshi_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty events of Kalshi's own feed that have all terms."""
    events = kalshi_feed(spark, sf_dir)[1].withColumn("ord", F.regexp_extract("ticker", r"(\d+)$", 1).cast("long"))
    return venues.search_kalshi(events, "the number of KXNBAGAME!").select("ticker", "title")


_MATCHED = "SELECT l_partkey * 10 + l_linenumber AS id, l_orderkey, 0.30 + 4 * l_discount AS kalshi, 0.25 + 5 * l_tax AS poly, l_extendedprice AS volume FROM lineitem"


@query(
    f"""SELECT id, CASE WHEN poly < kalshi THEN 'Polymarket' ELSE 'Kalshi' END AS buy_platform, round(least(poly, kalshi), 6) AS buy_price, round(greatest(poly, kalshi), 6) AS sell_price,
      round(abs(poly - kalshi) * 100, 6) AS spread, round(volume, 2) AS total_volume
    FROM (SELECT *, row_number() OVER (ORDER BY round(volume, 2) DESC, id) AS r FROM ({_MATCHED}) m WHERE volume >= 5000) r WHERE r <= 200"""
)
def external_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two hundred matches of another service with the largest volume, as opportunities."""
    m = table(spark, sf_dir, "lineitem").select(F.expr("l_partkey * 10 + l_linenumber").alias("matchId"), (0.30 + 4 * F.col("l_discount")).alias("k"), (0.25 + 5 * F.col("l_tax")).alias("p"), F.round("l_extendedprice", 2).alias("combinedVolume"))
    side = lambda price: F.struct(F.lit("m").alias("marketId"), F.col(price).alias("yesPrice"))
    fed = _read(m.select("matchId", side("p").alias("polymarket"), side("k").alias("kalshi"), F.abs(F.col("p") - F.col("k")).alias("spread"), F.lit(0.0).alias("spreadPercent"), "combinedVolume"), venues.MATCHES)
    top = venues.top_matches(fed, 200, 5000, "volume")
    return top.select("id", "buy_platform", F.round("buy_price", 6).alias("buy_price"), F.round("sell_price", 6).alias("sell_price"), F.round("spread", 6).alias("spread"), "total_volume")
