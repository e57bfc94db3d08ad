"""Venue feeds (JSON) as one market model: ``id, platform, title, outcomes, volume, volume_text, date, link, markets``.

Schemas are given, never inferred; a row that does not fit is null in what does not fit, and rows without an
identifier are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.functions.numbers import cents, currency_label, round_half_up, truthy

POLYMARKET = (
    "id string, title string, question string, slug string, image string, description string, volume string, volumeNum double, liquidity string,"
    " liquidityNum double, endDate string, markets array<struct<id: string, slug: string, question: string, title: string, groupItemTitle: string,"
    " outcomePrices: string, volume: string, volumeNum: double, liquidity: string, clobTokenIds: array<string>>>"
)
KALSHI = (
    "event_ticker string, series_ticker string, ticker string, title string, subtitle string, yes_sub_title string, no_sub_title string,"
    " series_title string, event_title string, yes_bid double, no_ask double, last_price double, volume double, liquidity double, expiration_time string"
)
PREDICTIT = (
    "id long, name string, image string, url string, contracts array<struct<id: long, name: string, bestBuyYesCost: double, bestBuyNoCost: double,"
    " lastTradePrice: double, totalSharesTraded: long, dateEnd: string>>"
)
MATCHES = (
    "matchId long, similarityScore double, confidenceTier string, polymarket struct<marketId: string, title: string, yesPrice: double, volume: double>,"
    " kalshi struct<marketId: string, title: string, yesPrice: double, volume: double>, spread double, spreadPercent double, combinedVolume double"
)


def read_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def outcome_prices(raw: Column) -> Column:
    """Prices given as an array, as text of one, or as one number; 0 for what is none of them."""
    listed = F.from_json(raw, "array<string>")
    numbers = F.transform(listed, lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))
    return F.coalesce(numbers, F.array(F.coalesce(raw.try_cast("double"), F.lit(0.0))))


def number(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def outcome(name: Column, price: Column, team: Column | None = None, ticker: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(name.alias("name"), round_half_up(price * 100).cast("double").alias("percentage"), price.alias("price"), (none if team is None else team).alias("teamName"), (none if ticker is None else ticker).alias("marketTicker"))


def by_percentage(outcomes: Column, most: int) -> Column:
    """The ``most`` likeliest outcomes; equals stay in the feed's order."""
    numbered = F.transform(outcomes, lambda o, i: F.struct((-o.percentage).alias("p"), i.alias("i"), o.alias("o")))
    return F.slice(F.transform(F.array_sort(numbered), lambda x: x.o), 1, most)


def polymarket(events: DataFrame) -> DataFrame:
    """An outcome for each child market (its group title or question at its first price); one child is Yes and No, none 50 to 50."""
    e = events.filter("id IS NOT NULL")
    child = F.coalesce("markets", F.array().cast(events.schema["markets"].dataType))
    first = lambda m: F.get(outcome_prices(m.outcomePrices), F.lit(0))
    one = F.coalesce(first(F.get(child, F.lit(0))), F.lit(0.0))
    half = F.lit(0.5)
    outcomes = (
        F.when(F.size(child) > 1, F.transform(child, lambda m: outcome(F.coalesce(truthy_text(m.groupItemTitle), m.question), F.coalesce(first(m), F.lit(0.0)))))
        .when(F.size(child) == 1, F.array(outcome(F.lit("Yes"), one), outcome(F.lit("No"), 1 - one)))
        .otherwise(F.array(outcome(F.lit("Yes"), half), outcome(F.lit("No"), half)))
    )
    volume = F.coalesce(truthy(F.col("volumeNum")), number(F.col("volume")))
    slug = F.coalesce(truthy_text(F.get(child, F.lit(0)).slug), truthy_text(F.col("slug")), F.col("id"))
    return e.select(
        F.concat(F.lit("polymarket:"), "id").alias("id"),
        F.lit("Polymarket").alias("platform"),
        F.coalesce(truthy_text(F.col("title")), F.col("question")).alias("title"),
        by_percentage(outcomes, 2).alias("outcomes"),
        volume.alias("volume"),
        currency_label(volume).alias("volume_text"),
        F.date_format(F.expr("try_to_timestamp(endDate)"), "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("https://polymarket.com/event/"), slug).alias("link"),
        F.size(child).alias("markets"),
    )


def truthy_text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def valid_title(c: Column) -> Column:
    return F.when((F.length(c) > 10) & (c != "Combo"), c)


def series_of(ticker: Column) -> Column:
    """Letters before the first dash and digit, else the whole ticker."""
    return F.coalesce(truthy_text(F.regexp_extract(ticker, r"^([A-Z]+?)(?:-\d)", 1)), ticker)


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def short_name(title: Column) -> Column:
    """``X`` of ``Will (the) X win``, else the last two words."""
    asked = truthy_text(F.regexp_extract(title, r"(?i)will (?:the )?(.+?) win", 1))
    return F.coalesce(asked, F.array_join(F.slice(F.split(F.trim(title), r"\s+"), -2, 2), " "), title)


def kalshi(markets: DataFrame, events: DataFrame | None = None, series: DataFrame | None = None) -> DataFrame:
    """Markets grouped by event. A single market is Yes at ``yes_bid``, else ``last_price``, else 50 cents, and No; several are a Yes each (else 0).

    Titles come from the event, its series, the first market's fields, else the ticker; one needs more than 10 letters.
    """
    m = markets.filter("event_ticker IS NOT NULL").withColumn("series", F.coalesce(truthy_text(F.col("series_ticker")), series_of(F.col("event_ticker"))))
    fields = ["ticker", "title", "subtitle", "yes_sub_title", "no_sub_title", "series_title", "event_title", "yes_bid", "last_price", "volume", "expiration_time"]
    g = m.groupBy("event_ticker", "series").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("ms"), F.count("*").cast("int").alias("n"), F.sum(F.coalesce("volume", F.lit(0.0))).alias("raw_volume"))
    titles = []
    for df, key, names in ((events, "event_ticker", ("title", "question", "event_title", "sub_title")), (series, "series", ("title", "question", "sub_title"))):
        if df is not None:
            own = df.select(F.col("ticker").alias(key), F.struct(*names).alias(f"__{key}")).dropDuplicates([key])
            g = g.join(own, key, "left")
            titles += [valid_title(F.col(f"__{key}.{n}")) for n in names]
    first = F.get("ms", F.lit(0))
    titles += [valid_title(first[n]) for n in ("event_title", "series_title", "title", "subtitle")]
    price = lambda x, default: F.coalesce(truthy(x.yes_bid), truthy(x.last_price), F.lit(default))
    one = price(first, 50.0)
    outcomes = F.when(
        F.col("n") == 1,
        F.array(outcome(F.lit("Yes"), one / 100, first.yes_sub_title, first.ticker), outcome(F.lit("No"), (100 - one) / 100, first.no_sub_title, first.ticker)),
    ).otherwise(F.transform("ms", lambda x: outcome(F.lit("Yes"), price(x, 0.0) / 100, x.yes_sub_title, x.ticker)))
    volume = cents(F.col("raw_volume"))
    return g.select(
        F.concat(F.lit("kalshi:"), "event_ticker").alias("id"),
        F.lit("Kalshi").alias("platform"),
        F.coalesce(*titles, F.concat(F.lit("Market "), "event_ticker")).alias("title"),
        by_percentage(outcomes, 5).alias("outcomes"),
        volume.alias("volume"),
        currency_label(volume).alias("volume_text"),
        F.date_format(F.expr("try_to_timestamp(ms[0].expiration_time)"), "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("https://kalshi.com/markets/"), F.lower("series"), F.lit("/"), F.lower("event_ticker")).alias("link"),
        F.col("n").alias("markets"),
    )


def predictit(markets: DataFrame) -> DataFrame:
    """An outcome for each contract at its best cost, else its last price; volume is the number of shares."""
    m = markets.filter("id IS NOT NULL")
    contracts = F.coalesce("contracts", F.array().cast(markets.schema["contracts"].dataType))
    price = lambda c: F.coalesce(truthy(c.bestBuyYesCost), truthy(c.lastTradePrice), F.lit(0.0))
    volume = F.aggregate(contracts, F.lit(0).cast("long"), lambda s, c: s + F.coalesce(c.totalSharesTraded, F.lit(0).cast("long"))).cast("double")
    return m.select(
        F.concat(F.lit("predictit:"), F.col("id").cast("string")).alias("id"),
        F.lit("PredictIt").alias("platform"),
        F.col("name").alias("title"),
        by_percentage(F.transform(contracts, lambda c: outcome(c["name"], price(c))), 1 << 20).alias("outcomes"),
        volume.alias("volume"),
        currency_label(volume, "N/A").alias("volume_text"),
        F.date_format(F.expr("try_to_timestamp(contracts[0].dateEnd)"), "MMM d").alias("date"),
        F.col("url").alias("link"),
        F.size(contracts).alias("markets"),
    )


def matches(rows: DataFrame) -> DataFrame:
    """External matches as opportunities: the cheaper Yes is bought, the Kalshi one if they are equal."""
    poly_buys = F.col("polymarket.yesPrice") < F.col("kalshi.yesPrice")
    side = lambda f, buys: F.when(poly_buys if buys else ~poly_buys, F.col(f"polymarket.{f}")).otherwise(F.col(f"kalshi.{f}"))
    return rows.select(
        F.col("matchId").alias("id"),
        side("marketId", True).alias("buy_market_id"),
        side("yesPrice", True).alias("buy_price"),
        F.when(poly_buys, "Polymarket").otherwise("Kalshi").alias("buy_platform"),
        side("marketId", False).alias("sell_market_id"),
        side("yesPrice", False).alias("sell_price"),
        (F.col("spread") * 100).alias("spread"),
        F.col("spreadPercent").alias("max_spread"),
        F.col("combinedVolume").alias("total_volume"),
        "confidenceTier",
        "similarityScore",
    )


def market(markets: DataFrame, market_id: str) -> DataFrame:
    """Point lookup; the part of the identifier before the first colon names the venue, so other venues' rows are pruned."""
    venues = {"polymarket": "Polymarket", "kalshi": "Kalshi", "predictit": "PredictIt"}
    venue = venues.get(market_id.split(":", 1)[0])
    return markets.filter((F.col("platform") == venue) & (F.col("id") == market_id))


def front_page(markets: DataFrame, n: int = 300) -> DataFrame:
    """The largest markets of each venue up to its cap. A venue's come by a limit, so a task holds no more than its cap of them."""
    wide = n >= 1000
    caps = {"Polymarket": min(n, 2000 if wide else 500), "Kalshi": 500 if wide else min(n, 500), "PredictIt": 50 if wide else min(n, 50)}
    largest = (markets.filter(F.col("platform") == p).orderBy(F.desc("volume"), "id").limit(c) for p, c in caps.items())
    return reduce(DataFrame.unionByName, largest)


def search_kalshi(events: DataFrame, query: str, n: int = 20, order: str = "ord") -> DataFrame:
    """The first ``n`` events, in the feed's order, whose title and ticker have all terms of a query; none for a query without terms.

    ``events`` has ``ticker, title`` and ``order``. Terms of up to three letters count as whole words only.
    """
    from oddsloom.functions.text import all_terms, query_terms

    terms = query_terms(query)
    text = F.concat_ws(" ", F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("ticker", F.lit(""))))
    return events.filter(all_terms(text, terms) if terms else F.lit(False)).orderBy(order).limit(n)


def top_matches(rows: DataFrame, n: int = 20, least_volume: float = 5000, by: str = "spread") -> DataFrame:
    """External matches (``MATCHES``) of ``least_volume`` or more, the ``n`` with the largest ``spread`` or ``volume``, as opportunities."""
    column = {"spread": "spread", "volume": "combinedVolume"}[by]
    return matches(rows.filter(F.col("combinedVolume") >= least_volume).orderBy(F.desc(column), "matchId").limit(n))


def in_listed_order(events: DataFrame, listed: DataFrame, key: str, most: int = 120) -> DataFrame:
    """The events that a list names, in the list's order: adds ``rank`` from 1. ``listed`` has the key and ``place``, of which the first ``most`` count.

    Only the listed keys leave the list; the last event of a key that comes more than once is taken, by ``ord``.
    """
    first = listed.filter(F.col(key).isNotNull()).orderBy("place").limit(most)
    # The list is short by its bound, so its order is found in one row.
    one = first.agg(F.array_sort(F.collect_list(F.struct("place", key))).alias("keys"))
    ranked = one.select(F.posexplode("keys").alias("at", "k")).select(F.col(f"k.{key}").alias(key), (F.col("at") + 1).cast("long").alias("rank"))
    rest = [c for c in events.columns if c != key]
    last = events.join(ranked, key, "left_semi").groupBy(key).agg(F.max_by(F.struct(*rest), "ord").alias("event"))
    return ranked.join(last, key).select(key, "rank", "event.*").orderBy("rank")
