"""Games across two venues: markets of a sport, grouped by event, their outcomes held against each other, the best pair of each game."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.functions import rules, teams
from oddsloom.functions.expressions import once
from oddsloom.functions.numbers import parse_volume
from oddsloom.functions.text import extract_date
from oddsloom.operators import arbitrage, matching, ranking, similarity

KALSHI, POLYMARKET = "Kalshi", "Polymarket"


def of_sports(markets: DataFrame) -> DataFrame:
    """The markets of both venues that are games, once for each ``sport`` that they are of, with their ``teams`` (two).

    ``markets``: ``platform, id, title, link``.
    """
    own = F.array_compact(F.array(*(F.when(rules.in_sport(s, F.col("id"), F.col("title"), F.col("link")), s) for s in rules.SPORTS)))
    rows = once(markets.filter(F.col("platform").isin(KALSHI, POLYMARKET)), sports=own).filter(F.size("sports") > 0)
    rows = once(rows, teams=rules.game_teams(F.col("platform"), F.col("title"), F.col("link"))).filter(F.size("teams") == 2)
    return rows.withColumn("sport", F.explode("sports")).drop("sports")


def grouped(games: DataFrame, as_of_year: int) -> DataFrame:
    """Adds ``signature`` (teams in order) and ``group_day``, the first date of the event's group; undated games meet undated ones.

    A date is that of the link, the identifier or the market, in this order. ``games``: ``ord, id, link, date, teams,
    sport``; games of different sports never meet.
    """
    day = F.coalesce(*(extract_date(F.col(c), as_of_year) for c in ("link", "id", "date")))
    dated = once(games, day=day.try_cast("date")).withColumn("signature", F.array_join(F.array_sort("teams"), "-"))
    keyed = dated.select("ord", "id", F.concat_ws(":", "sport", "signature").alias("signature"), "day")
    homes = matching.greedy_groups(keyed).select("ord", F.substring_index("signature", ":", 1).alias("sport"), "group_day")
    return dated.join(homes, ["ord", "sport"])


def outcome_pairs(events: DataFrame, firsts: bool = False) -> DataFrame:
    """Each outcome of a Kalshi market with each of a Polymarket one of the same event, unless both stand for the same team.

    ``events`` has ``sport, signature, group_day`` and markets' ``ord, title, teams, outcomes`` (array of ``name, price,
    teamName``), ``volume_text, liquidity_text``. Markets on anything but who wins are left out. With ``firsts``, of a
    side's outcomes of one event, team and price only the first by market and place goes out.
    """
    rows = events.filter(rules.team_win(F.col("title"), F.transform("outcomes", lambda o: o["name"])))
    pair = F.array_sort("teams")
    each = once(rows.select("*", F.posexplode("outcomes").alias("place", "o")), team=teams.outcome_team(F.col("o.name"), F.col("title"), pair, F.col("o.teamName")))

    def side(platform: str, p: str) -> DataFrame:
        fields = {"ord": "ord", "id": "id", "place": "place", "name": "o.name", "price": "o.price", "team": "team", "volume": "volume_text", "liquidity": "liquidity_text"}
        keys = ["sport", "signature", F.coalesce(F.col("group_day").cast("string"), F.lit("")).alias("group_day")]
        rows = each.filter(F.col("platform") == platform).select(*keys, *(F.col(c).alias(f"{p}_{k}") for k, c in fields.items()))
        if not firsts:
            return rows
        w = Window.partitionBy("sport", "signature", "group_day", F.trim(F.lower(f"{p}_team")), f"{p}_price").orderBy(f"{p}_ord", f"{p}_place")
        return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")

    pairs = matching.dealt_join(side(KALSHI, "k"), side(POLYMARKET, "p"), ["sport", "signature", "group_day"], "k_ord", "p_ord", merged=firsts)
    return pairs.filter(~F.coalesce(F.trim(F.lower("k_team")) == F.trim(F.lower("p_team")), F.lit(False)))


def opportunities(pairs: DataFrame, investment: float = 1000.0, least_roi: float = 0.0) -> DataFrame:
    """Pairs that pay off after fees: return, signed spread, buy and sell sides, volume and mean liquidity."""
    k, p = F.col("k_price"), F.col("p_price")
    rows = pairs.withColumns(arbitrage.stakes(k, p, F.lit(investment), arbitrage.fee_rate(F.lit(KALSHI)), arbitrage.fee_rate(F.lit(POLYMARKET))))
    rows = rows.filter(F.col("is_valid") & (F.col("roi") >= least_roi))
    cheap = k <= p
    return rows.withColumns({
        "max_spread": arbitrage.signed_spread(k, p),
        "buy_platform": F.when(cheap, KALSHI).otherwise(POLYMARKET),
        "buy_price": F.least(k, p),
        "sell_price": F.greatest(k, p),
        "total_volume": parse_volume(F.coalesce("k_volume", F.lit(""))) + parse_volume(F.coalesce("p_volume", F.lit(""))),
        "avg_liquidity": (parse_volume(F.coalesce("k_liquidity", F.lit(""))) + parse_volume(F.coalesce("p_liquidity", F.lit("")))) / 2,
        "tier": F.lit("high"),
    })


def best_of_games(markets: DataFrame, as_of_year: int, least_roi: float = 0.0) -> DataFrame:
    """The best opportunity of each game of each sport: largest signed spread, of equals the first by markets and outcomes.

    ``sport_ord`` is the key to sort by. What an opportunity is worth depends on prices, and which are held against each
    other on teams, so the first outcomes of each team and price have the best one. The join is a merge: its rows come in
    order of events, so the best of each is found as they come, and none but that one is kept.
    """
    found = opportunities(outcome_pairs(grouped(of_sports(markets), as_of_year), firsts=True), least_roi=least_roi)
    value = F.col("max_spread")
    rank = (value.isNull().alias("none"), (~F.isnan(value)).alias("number"), (-value).alias("less"), "k_ord", "p_ord", "k_place", "p_place")
    event = found.groupBy("sport", "signature", "group_day").agg(F.min(F.struct(*rank, F.struct(*found.columns).alias("row"))).alias("m"))
    best = event.groupBy("sport", "signature").agg(F.min("m").alias("m")).select("m.row.*")
    return best.withColumn("sport_ord", F.array_position(F.array(*map(F.lit, rules.SPORTS)), F.col("sport")))


def repaired(events: DataFrame, markets: DataFrame, slugs: DataFrame) -> DataFrame:
    """The Polymarket market of one-sided events: by a slug that exists, else of the same teams and less than two days away.

    ``events``: ``id, sport, team_a, team_b`` (as slugs have them)``, teams, day``; ``markets``: ``ord, id, teams, day``;
    ``slugs``: ``slug, slug_id``. Of several by teams the first in order counts. A third step, fetching the slug's event
    from the venue, is the lookup in ``slugs`` with all its slugs.
    """
    by_slug = matching.slug_hits(events.drop("teams"), slugs).select("id", F.col("slug_id").alias("market_id"), F.lit("slug").alias("by"))
    rest = events.join(by_slug.select("id"), "id", "left_anti").withColumn("signature", F.array_join(F.array_sort("teams"), "-"))
    other = markets.select("ord", F.col("id").alias("market_id"), F.array_join(F.array_sort("teams"), "-").alias("signature"), "day")
    near = matching.band_pairs(rest.select("id", "signature", "day").filter("day IS NOT NULL"), other.filter("day IS NOT NULL"), "signature", "day", 1)
    first = near.groupBy("id").agg(F.min_by("b_market_id", "b_ord").alias("market_id"))
    return by_slug.unionByName(first.select("id", "market_id", F.lit("teams").alias("by")))


def by_sport(events: DataFrame, sport: str, limit: int) -> DataFrame:
    """Events of a feed that are of a sport by slug, title or description, or by those of any of their markets; at most ``limit``.

    ``events``: ``ord, id, slug, title, description, question, markets``. Of rows with one identifier the last counts, in
    the place of the first. Events without markets are left out.
    """
    patterns = [f"{sport}-", f"/{sport}/", f"/sports/{sport}/", *(["cwbb-", "/cwbb/"] if sport == "cbb" else [])]
    one = ranking.dedupe_last(events.withColumn("__ord", F.col("ord")), "id", "ord")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    has = lambda text: reduce(lambda a, b: a | b, (text.contains(p) for p in patterns))
    own = has(low(F.col("slug"))) | has(low(F.col("title"))) | has(F.concat_ws(" ", low(F.col("description")), low(F.col("question"))))
    child = F.exists("markets", lambda m: has(low(m.slug)) | has(low(F.coalesce(F.nullif(m.question, F.lit("")), m.title))))
    return one.filter((F.size("markets") > 0) & (own | child)).orderBy("first_ord").limit(limit).drop("__ord")


def slug_ids(markets: DataFrame) -> DataFrame:
    """``slug, slug_id`` of a feed's events; the last of equal slugs counts. ``markets``: ``ord, id, slug``."""
    return markets.filter("slug IS NOT NULL").groupBy("slug").agg(F.max_by("id", "ord").alias("slug_id"))


def outcome_matches(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The pair of outcomes of two markets with the largest relative spread, of outcomes that name the same thing.

    ``a``, ``b``: ``key, name, price, k``. Names match if they are equal, if both hold ``yes`` or both hold ``no``, or if
    they are similar by more than 0.75 (0.7 where one is ``yes`` or ``no``). Null spreads count as 0; if none is above 0
    the first pair in order counts.
    """
    from oddsloom.functions.text import text_similarity

    low = lambda c: F.trim(F.lower(c))
    right = b.select(key, F.col("name").alias("name_b"), F.col("price").alias("price_b"), F.col("k").alias("k_b"))
    pairs = a.join(right, key)
    x, y = low(F.col("name")), low(F.col("name_b"))
    binary = x.isin("yes", "no") | y.isin("yes", "no")
    both = lambda w: x.contains(w) & y.contains(w)
    pairs = pairs.filter((x == y) | both("yes") | both("no") | (text_similarity(x, y) > F.when(binary, 0.7).otherwise(0.75)))
    buy, sell = F.least("price", "price_b"), F.greatest("price", "price_b")
    pairs = pairs.withColumns({"buy": buy, "sell": sell, "gain": F.greatest(F.coalesce(arbitrage.relative_spread(buy, sell), F.lit(0.0)), F.lit(0.0))})
    best = pairs.withColumn("__first", F.struct("k", "k_b"))
    best = arbitrage.best_per(best, [key], "gain", "__first").drop("__first")
    return best.withColumns({"spread": (F.col("sell") - F.col("buy")) * 100, "max_spread": F.col("gain"), "first_buys": F.col("price") < F.col("price_b")})


def similar_opportunities(vectors: DataFrame, markets: DataFrame, least: float = 0.65, least_points: float = 0.5) -> DataFrame:
    """Pairs of markets of two venues that their vectors, the rules of their category and their prices make an opportunity.

    ``vectors``: ``id, vec``; ``markets``: ``id, platform, title, price`` (of the first outcome). Markets without a usable
    title or without a vector are left out. What the rules and the spread need goes with the vectors, so pairs are neither
    joined nor moved: ``id, b_id, category, similarity, price, b_price, spread, tier``.
    """
    usable = markets.filter(rules.usable_title(F.col("title"))).withColumn("category", rules.vector_category(F.col("title")))
    place = F.create_map(*(F.lit(x) for i, p in enumerate((POLYMARKET, KALSHI, "PredictIt")) for x in (p, i)))
    of = lambda category, value: F.when(F.col("category") == category, value)
    more = F.struct("price", of("sports", rules.side_words(F.col("title"))).alias("sides"), of("politics", rules.race_of(F.col("title"))).alias("race"))
    rows = usable.join(vectors, "id").select("id", "category", F.element_at(place, F.col("platform")).alias("platform"), "vec", more.alias("more"))
    pairs = similarity.cosine_pairs(rows, least).select("id", "b_id", "category", "similarity", *(F.col(f"{p}more.{c}").alias(f"{p}{c}") for p in ("", "b_") for c in ("price", "sides", "race")))
    pairs = pairs.withColumn("spread", arbitrage.first_outcome_spread(F.col("price"), F.col("b_price"))).filter(F.col("spread") > least_points)
    agree = F.when(F.col("category") == "sports", rules.sides_agree(F.col("sides"), F.col("b_sides"))).when(F.col("category") == "politics", rules.races_agree(F.col("race"), F.col("b_race"))).otherwise(True)
    tier = F.when(F.col("similarity") > 0.75, "high").when(F.col("similarity") > 0.70, "medium").otherwise("low")
    return pairs.filter(agree).drop("sides", "b_sides", "race", "b_race").withColumn("tier", tier)


def without_vector(markets: DataFrame, vectors: DataFrame) -> DataFrame:
    """Markets whose vector is still to be made."""
    return markets.join(vectors.select("id"), "id", "left_anti")


def by_similarity(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("similarity"), "id", "b_id")


def by_choice(found: DataFrame, key: str, limit: int | None = None, *ties: Column | str) -> DataFrame:
    """Opportunities by ``spread`` or ``volume``, the largest first."""
    column = {"spread": "max_spread", "volume": "total_volume"}[key]
    rows = found.orderBy(F.desc_nulls_last(column), *ties)
    return rows if limit is None else rows.limit(limit)


def confident_pairs(markets: DataFrame, least: int = 70) -> DataFrame:
    """Pairs of markets of different platforms by the confidence that they are one game, ``least`` or more: ``id, b_id, confidence``.

    ``markets``: ``ord, id, platform, title, teams, sport``, two teams or none. One team of two in common gives 65 at
    most, so for more than that both are the same, and markets meet by their pair of teams.
    """
    if least <= 65:
        raise ValueError("a confidence over 65 is needed")
    fields = ("title", "teams", "sport")
    pair = F.array_join(F.array_sort(F.transform("teams", lambda t: F.lower(F.trim(t)))), "|")
    rows = matching.classed(markets.filter(F.size("teams") == 2), *fields, pair=pair)
    one, other = matching.class_sides(rows)
    met = matching.dealt_join(one, other.withColumnRenamed("b_pair", "pair"), ["pair"], "cls", "b_cls")
    side = lambda p: {c: F.col(p + c) for c in fields}
    met = met.select("cls", "b_cls", rules.sports_confidence(side(""), side("b_")).alias("confidence"))
    return matching.members(rows, met.filter(F.col("confidence") >= least))


def same_event_pairs(markets: DataFrame) -> DataFrame:
    """Pairs of markets of different platforms with one event signature, and whether the first's Yes and the second's No stand for its two teams.

    ``markets``: ``ord, id, platform, title, signature, teams``; those without a signature have no partner. What faces
    what is worked out once for two titles of an event: ``id, b_id, signature, opposing``.
    """
    rows = matching.classed(markets.filter("signature IS NOT NULL"), "signature", "title", "teams")
    first, second = matching.class_sides(rows)
    met = matching.dealt_join(first, second.withColumnRenamed("b_signature", "signature"), ["signature"], "cls", "b_cls")
    of = lambda name, title: teams.outcome_team(F.lit(name), F.col(title), F.col("teams"), F.lit(None).cast("string"))
    met = once(met, one=of("Yes", "title"), two=of("No", "b_title"))
    facing = rules.opposing(F.col("one"), F.col("two"), teams.teams_from_text(F.lit("Yes")), teams.teams_from_text(F.lit("No")), F.col("teams"))
    return matching.members(rows, met.select("cls", "b_cls", "signature", facing.alias("opposing")))
