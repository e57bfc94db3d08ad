"""Price histories of the venues, and the chains of lookups by which an event's markets are found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.functions.numbers import truthy


def polymarket_history(events: DataFrame, points: DataFrame) -> DataFrame:
    """``id, time`` (ms), ``value`` (percent): prices of the first token of each event's largest market.

    ``events``: ``id, markets`` (array of ``volume, clobTokenIds``); ``points``: ``token, t`` (seconds)``, p``. Of markets
    of one volume the first counts; events without markets or token have no history.
    """
    market = F.explode(F.transform("markets", lambda m, i: F.struct(F.coalesce(m.volume.try_cast("double"), F.lit(0.0)).alias("volume"), (-i).alias("k"), m.clobTokenIds.alias("tokens"))))
    main = events.select("id", market.alias("m")).groupBy("id").agg(F.max("m").alias("m"))
    tokens = main.select("id", F.get("m.tokens", F.lit(0)).alias("token")).filter(F.length("token") > 0)
    return points.join(tokens, "token").select("id", (F.col("t") * 1000).alias("time"), (F.col("p") * 100).alias("value"))


def candle_time(candle: Column) -> Column:
    """Milliseconds of the first time that a candle has; above 10**12 it is in milliseconds already, else in seconds."""
    at = F.coalesce(*(truthy(candle[c].cast("double")) for c in ("end_period_ts", "timestamp", "time", "start_period_ts")), F.lit(0.0))
    return F.when(at > 1e12, at).otherwise(at * 1000)


def candle_price(candle: Column) -> Column:
    return F.coalesce(*(truthy(candle[c].cast("double")) for c in ("price_close", "price", "close_price", "close", "last_price")), F.lit(0.0))


def kalshi_history(markets: DataFrame, candles: DataFrame, *own: str) -> DataFrame:
    """``event_ticker, ticker, time, value``: candles of each event's largest market that has any.

    ``markets``: ``event_ticker, ticker, volume, ord``; ``candles``: ``event_ticker, market_ticker, candlesticks`` (array).
    Of markets of one volume the first counts. Markets of an event that share a ticker are told apart by the columns
    ``own``, which both tables have; of rows of candles with one ticker, and equal in these, the smallest counts.
    """
    key = ["event_ticker", "ticker", *own]
    some = candles.filter(F.size("candlesticks") > 0).withColumnRenamed("market_ticker", "ticker").groupBy(*key).agg(F.min("candlesticks").alias("candlesticks"))
    listed = markets.filter(F.length("ticker") > 0).join(some, key)
    best = F.row_number().over(Window.partitionBy("event_ticker").orderBy(F.desc(F.coalesce("volume", F.lit(0.0))), "ord"))
    first = listed.withColumn("__k", best).filter("__k = 1")
    each = first.select("event_ticker", "ticker", F.explode("candlesticks").alias("c"))
    return each.select("event_ticker", "ticker", candle_time(F.col("c")).cast("long").alias("time"), candle_price(F.col("c")).alias("value"))


def predictit_history(markets: DataFrame, chart: DataFrame) -> DataFrame:
    """``id, date, value``: closing prices in percent of each market's first contract. ``markets``: ``id, contracts``; ``chart``: ``market_id, contract_id, date, closePrice``."""
    first = markets.select("id", F.get("contracts", F.lit(0)).id.alias("contract_id")).filter("contract_id IS NOT NULL")
    rows = chart.join(first, (chart["market_id"] == first["id"]) & (chart["contract_id"] == first["contract_id"]))
    return rows.select("id", "date", (F.col("closePrice") * 100).alias("value"))


def event_markets(asked: DataFrame, events: DataFrame, markets: DataFrame, fallback: DataFrame) -> DataFrame:
    """``ticker, source, markets`` of each asked ``ticker``: of the event itself, else listed under it, else of the fallback event or listed under that one's ticker.

    ``events``: ``ticker, markets`` (array of ``ticker``); ``markets``: ``event_ticker, ticker``; ``fallback``: ``ticker,
    own`` (the ticker it has itself)``, markets``. Each array is in order of tickers. Tickers that nothing is found for are left out.
    """
    names = lambda c: F.array_sort(F.transform(c, lambda m: m.ticker))
    listed = markets.groupBy("event_ticker").agg(F.array_sort(F.collect_list("ticker")).alias("tickers"))
    of = lambda key, name: listed.select(F.col("event_ticker").alias(key), F.col("tickers").alias(name))
    rows = asked.join(events.select("ticker", names("markets").alias("a")), "ticker", "left").join(of("ticker", "b"), "ticker", "left")
    other = fallback.select("ticker", F.coalesce(F.nullif("own", F.lit("")), "ticker").alias("own"), names("markets").alias("c"))
    rows = rows.join(other, "ticker", "left").join(of("own", "d"), "own", "left")
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    source = F.when(F.size("a") > 0, "event").when(F.size("b") > 0, "listed").when(F.size("c") > 0, "fallback").when(F.size("d") > 0, "fallback listed")
    return rows.select("ticker", source.alias("source"), F.coalesce(*map(some, "abcd")).alias("markets")).filter("source IS NOT NULL")
