"""Queries on the rules that match markets: teams and cities of titles, categories and titles for vectors, similar opportunities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.functions import display, questions, rules, teams, text
from oddsloom.functions.expressions import once
from oddsloom.operators import matching, ranking, similarity, sports, text_joins
from oddsloom.plans import relations as rel
from oddsloom.plans.queries import normal_sql, similarity_sql, title_case_sql
from oddsloom.plans.registry import query, r6, table

# --- teams of titles --------------------------------------------------------------------------------------------------


def _city_sql(side: str) -> str:
    s = rf"regexp_replace(trim(lower({side})), '^(nhl|nba|nfl|mlb|ncaa|ahl|shl|ufc):\s*', '')"
    nicknames = " ".join(rf"WHEN regexp_matches({s}, '\b{n}\b') THEN '{rules.GAME_NICKNAMES[n]}'" for n in rules.longest_first(rules.GAME_NICKNAMES))
    return rf"coalesce(nullif(regexp_extract({s}, '^({'|'.join(rules.GAME_CITIES)})(?: |$)', 1), ''), CASE {nicknames} END)"


_SIDES = r"regexp_extract(trim(lower(title)), '^(.+?)\s+(?:vs\.?|versus|at|@)\s+(.+?)$', {k})"
_CITIES = f""", t AS (SELECT id, platform, {_city_sql(_SIDES.format(k=1))} AS p, {_city_sql(_SIDES.format(k=2))} AS q FROM x)
  , k AS (SELECT id, platform, CASE WHEN p <> q THEN p || '|' || q ELSE '' END AS teams, least(p, q) || '|' || greatest(p, q) AS pair FROM t) """


@query(_CITIES + "SELECT id, teams FROM k", rel.MARKET)
def structured_teams(m: DataFrame) -> DataFrame:
    return m.select("id", F.array_join(rules.title_teams(F.col("title")), "|").alias("teams"))


@query(
    _CITIES + """SELECT a.id, b.id AS b_id, a.pair, 100 AS confidence FROM k a JOIN k b ON a.pair = b.pair AND a.teams <> '' AND a.id < b.id AND a.platform <> b.platform""",
    rel.MARKET,
)
def structured_team_pairs(m: DataFrame) -> DataFrame:
    return matching.team_set_pairs(m.withColumn("teams", rules.title_teams(F.col("title"))))


@query(
    _CITIES + """, s AS (SELECT a.id, b.id AS b_id, a.title AS ta, b.title AS tb, string_split(ka.teams, '|') AS xa, string_split(kb.teams, '|') AS xb
      FROM x a JOIN k ka ON ka.id = a.id JOIN x b ON b.id = a.id + 9 JOIN k kb ON kb.id = b.id WHERE ka.teams <> '' AND kb.teams <> '')
    SELECT id, b_id, n * 35.0::DOUBLE + CASE WHEN regexp_matches(ta, '\\bNFL\\b') AND regexp_matches(tb, '\\bNFL\\b') THEN 20 ELSE 0 END + 10 AS confidence
    FROM (SELECT *, len(list_intersect(xa, xb)) AS n FROM s) c WHERE n > 0""",
    rel.MARKET,
)
def sports_confidence(m: DataFrame) -> DataFrame:
    """Markets nine apart, which have one kind of title."""
    sides = m.select("id", "title", rules.title_teams(F.col("title")).alias("teams"), text.entity(F.col("title"), "sport").alias("sport"))
    other = sides.select((F.col("id") - 9).alias("id"), F.col("id").alias("b_id"), *(F.col(c).alias(f"b_{c}") for c in ("title", "teams", "sport")))
    side = lambda p: {c: F.col(p + c) for c in ("title", "teams", "sport")}
    rows = sides.join(other, "id").withColumn("confidence", rules.sports_confidence(side(""), side("b_")))
    return rows.filter("confidence > 0").select("id", "b_id", "confidence")


@query(relation=rel.MARKET)
def event_signatures(m: DataFrame) -> DataFrame:
    """Signature of every market, the same event as its neighbour nine further, and whether their first outcomes oppose; tests hold it against plain loops."""
    sign = rules.event_signature(F.col("title"), F.lit("2025-03-02"), F.lit(None).cast("string"), 2025)
    found = once(m.select("id", "title"), signature=sign, teams=teams.teams_from_text(F.col("title")))
    other = found.select((F.col("id") - 9).alias("id"), *(F.col(c).alias(f"b_{c}") for c in ("title", "signature", "teams")))
    none = F.lit(None).cast("string")
    of = lambda name, p: teams.outcome_team(F.lit(name), F.col(f"{p}title"), F.col("teams"), none)
    rows = once(found.join(other, "id"), one=of("Yes", ""), two=of("No", "b_"))
    same = rules.same_event(F.col("signature"), F.col("b_signature"))
    facing = same & rules.opposing(F.col("one"), F.col("two"), teams.teams_from_text(F.lit("Yes")), teams.teams_from_text(F.lit("No")), F.col("teams"))
    return rows.select("id", "signature", same.alias("same_event"), facing.alias("opposing"))


@query(
    _CITIES + """SELECT a.id, b.id AS b_id, 70.0::DOUBLE + CASE WHEN regexp_matches(xa.title, '\\bNFL\\b') AND regexp_matches(xb.title, '\\bNFL\\b') THEN 20 ELSE 0 END + 10 AS confidence
    FROM k a JOIN k b ON a.pair = b.pair AND a.teams <> '' AND b.teams <> '' AND a.id < b.id AND a.platform <> b.platform JOIN x xa ON xa.id = a.id JOIN x xb ON xb.id = b.id""",
    rel.MARKET,
)
def sports_confidence_pairs(m: DataFrame) -> DataFrame:
    """All pairs of two venues' markets that are one game by a confidence of 70."""
    sides = m.select("ord", "id", "platform", "title", rules.title_teams(F.col("title")).alias("teams"), text.entity(F.col("title"), "sport").alias("sport"))
    return sports.confident_pairs(sides)


@query(relation=rel.MARKET)
def same_event_pairs(m: DataFrame) -> DataFrame:
    """All pairs of two venues' markets with one event signature; tests hold it against a plain loop."""
    sign = rules.event_signature(F.col("title"), F.lit("2025-03-02"), F.lit(None).cast("string"), 2025)
    return sports.same_event_pairs(once(m.select("ord", "id", "platform", "title"), signature=sign, teams=teams.teams_from_text(F.col("title"))))


_PARSED = ", ".join(f"nullif(regexp_extract(title, '{p}', 1), '') AS {k}" for k, p in text.ENTITIES.items())


@query(
    f""", p AS (SELECT id, {title_case_sql} AS category, {_PARSED}, {normal_sql('title')} AS normal FROM x)
    SELECT p.*, p.category = q.category AS same_category FROM p JOIN p q ON q.id = p.id + 9""",
    rel.MARKET,
)
def parsed_markets(m: DataFrame) -> DataFrame:
    """What every title holds, and whether the market nine further is of its category."""
    p = text.parsed(m.select("id", "title")).drop("title")
    other = p.select((F.col("id") - 9).alias("id"), F.col("category").alias("b_category"))
    return p.join(other, "id").withColumn("same_category", F.col("category") == F.col("b_category")).drop("b_category")


# --- vectors ----------------------------------------------------------------------------------------------------------


def _words_sql(x: str, words: dict[str, str], order: list[str]) -> str:
    for k in order:
        x = rf"regexp_replace({x}, '\b{k}\b', '{words[k]}', 'g')"
    return x


_VECTOR_TITLE = _words_sql(_words_sql(_words_sql("lower(title)", rules.VECTOR_SHORT, list(rules.VECTOR_SHORT)), rules.VECTOR_CITIES, rules.longest_first(rules.VECTOR_CITIES)), rules.VECTOR_TEAMS, list(rules.VECTOR_TEAMS))
_VECTOR_TITLE = rf"trim(regexp_replace(regexp_replace({_VECTOR_TITLE}, '\b(will|does|the|a|an)\b', ' ', 'g'), '\s+', ' ', 'g'))"
_NAMES = " OR ".join(rf"regexp_matches(lower(title), '\b{n}\b')" for n in rules.VECTOR_CITIES)
_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(title, '(?i){p}')" + (f" OR {_NAMES}" if k == "sports" else "") + f" THEN '{k}'" for k, p in rules.VECTOR_CATEGORIES) + " ELSE 'other' END"


@query(f"SELECT id, {_VECTOR_TITLE} AS normal FROM x", rel.MARKET)
def vector_titles(m: DataFrame) -> DataFrame:
    return m.select("id", rules.vector_title(F.col("title")).alias("normal"))


@query(f"SELECT id, {_CATEGORY} AS category FROM x", rel.MARKET)
def vector_categories(m: DataFrame) -> DataFrame:
    return m.select("id", rules.vector_category(F.col("title")).alias("category"))


_CUT = "CASE WHEN id % 7 = 0 THEN left(title, 4) WHEN id % 11 = 0 THEN 'Unknown Market' WHEN id % 13 = 0 THEN 'Kalshi Market ' || k ELSE title END"


@query(f"SELECT id FROM (SELECT id, {_CUT} AS t FROM x) c WHERE length(t) >= 5 AND t <> 'Unknown Market' AND NOT (starts_with(t, 'Kalshi Market ') AND length(t) < 20)", rel.MARKET)
def usable_titles(m: DataFrame) -> DataFrame:
    return m.withColumn("t", F.expr(_CUT)).filter(rules.usable_title(F.col("t"))).select("id")


_PRICE = "(5 + id * 37 % 89) / 100.0"
_WORDS = r"list_concat(string_split(trim(regexp_extract({t}, '{p}', 1)), ' '), string_split(trim(regexp_extract({t}, '{p}', 2)), ' '))"
# Fixed value: the pattern of titles that are read as two sides.
_READ = r"^([^@vs]+)(?:\s+(?:at|vs|@)\s+)([^@vs]+)$"
_OFFICE = "CASE WHEN contains({t}, 'senate') THEN 1 WHEN contains({t}, 'house') THEN 2 WHEN contains({t}, 'governor') THEN 3 WHEN contains({t}, 'presidential') THEN 4 END"
_STATE = "CASE " + " ".join(f"WHEN contains({{t}}, '{s}') THEN '{s}'" for s in rules.POLL_STATES) + " END"
# Fixed value: the pattern of a primary.
_KIND = r"\s+(?:senate|house|gubernatorial)?\s*primary"
_PRIMARY = rf"CASE WHEN regexp_matches({{t}}, 'republican{_KIND}') THEN 1 WHEN regexp_matches({{t}}, 'democratic?{_KIND}') THEN 2 END"


def _both(f: str) -> tuple[str, str]:
    return f.format(t="ta", p=_READ), f.format(t="tb", p=_READ)


_SPORTS_OK = f"(NOT (regexp_matches(ta, '{_READ}') AND regexp_matches(tb, '{_READ}')) OR len(list_filter(list_intersect({_both(_WORDS)[0]}, {_both(_WORDS)[1]}), lambda w: length(w) > 3)) > 0)"
_POLITICS_OK = f"(coalesce({_both(_OFFICE)[0]} = {_both(_OFFICE)[1]}, true) AND coalesce({_both(_STATE)[0]} = {_both(_STATE)[1]}, true) AND {_both(_PRIMARY)[0]} IS NOT DISTINCT FROM {_both(_PRIMARY)[1]})"


@query(
    f"""WITH x AS ({rel.MARKET}), v AS ({rel.VECTOR}),
    c AS (SELECT id, platform, lower(title) AS t, {_CATEGORY} AS category, {_PRICE}::DOUBLE AS price FROM x WHERE length(title) >= 5),
    p AS (SELECT a.id, b.id AS b_id, a.category, a.t AS ta, b.t AS tb, (greatest(a.price, b.price) - least(a.price, b.price)) * 100 AS spread,
        list_cosine_similarity(va.vec::DOUBLE[], vb.vec::DOUBLE[]) AS s
      FROM c a JOIN c b ON a.category = b.category AND a.id < b.id AND a.platform <> b.platform JOIN v va ON va.id = a.id JOIN v vb ON vb.id = b.id)
    SELECT id, b_id, category, round(s, 6) AS similarity, round(spread, 6) AS spread, CASE WHEN s > 0.75 THEN 'high' WHEN s > 0.70 THEN 'medium' ELSE 'low' END AS tier
    FROM p WHERE s > 0.2 AND spread > 0.5 AND CASE category WHEN 'sports' THEN {_SPORTS_OK} WHEN 'politics' THEN {_POLITICS_OK} ELSE true END"""
)
def similar_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets with the vector of the same number, in no order: to sort them all would move each pair."""
    m = rel.relation(spark, sf_dir, rel.MARKET).withColumn("price", F.expr(_PRICE).cast("double"))
    found = sports.similar_opportunities(rel.relation(spark, sf_dir, rel.VECTOR).select("id", "vec"), m.select("id", "platform", "title", "price"), least=0.2)
    return found.select("id", "b_id", "category", r6("similarity").alias("similarity"), r6("spread").alias("spread"), "tier")


@query(f"SELECT x.id FROM ({rel.MARKET}) x WHERE NOT EXISTS (SELECT 1 FROM ({rel.VECTOR}) v WHERE v.id = x.id)")
def markets_without_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sports.without_vector(rel.relation(spark, sf_dir, rel.MARKET), rel.relation(spark, sf_dir, rel.VECTOR)).select("id")


_SUBJECTS = "CASE " + " ".join(f"WHEN contains(lower(title), '{s}') THEN '{display.ALIASES.get(s, s)}'" for s in display.SUBJECTS) + " ELSE lower(coalesce(list_filter(string_split(title, ' '), lambda w: w <> '' AND w[1] = upper(w[1]))[1], 'unknown')) END"


@query(f"SELECT id, {_SUBJECTS} AS subject FROM x", rel.MARKET)
def title_subjects(m: DataFrame) -> DataFrame:
    return m.select("id", display.subject(F.col("title")).alias("subject"))


@query(
    f"""WITH s AS (SELECT m.id, {_SUBJECTS} AS category, platform, vec FROM ({rel.MARKET}) m JOIN ({rel.VECTOR.replace('vec_id % 3 AS platform, ', '')}) v ON v.id = m.id)
    SELECT a.id, b.id AS b_id, a.category, round(list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]), 6) AS similarity
    FROM s a JOIN s b ON a.category = b.category AND a.id < b.id AND a.platform <> b.platform WHERE list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]) > 0.3"""
)
def subject_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rel.relation(spark, sf_dir, rel.MARKET).select("id", display.subject(F.col("title")).alias("category"), F.crc32("platform").alias("platform"))
    v = rel.relation(spark, sf_dir, rel.VECTOR).select("id", "vec")
    return similarity.cosine_pairs(m.join(v, "id"), 0.3).withColumn("similarity", r6("similarity"))


_SIDE = lambda k: rf"trim(regexp_replace(trim(regexp_extract(low, '([^atvs]+)\s+(?:at|vs|v\.?|versus)\s+(.+)', {k})), '\s+({display.SIDE_NAMES})\s*$', ''))"
_MAIN = (
    "CASE " + " ".join(f"WHEN contains(low, '{s}') THEN '{display.ALIASES.get(s, s)}'" for s in display.MAIN_SUBJECTS)
    + f" WHEN {_SIDE(1)} <> '' AND {_SIDE(2)} <> '' THEN left({_SIDE(1)} || '_' || {_SIDE(2)}, 50)"
    + " ELSE coalesce(lower(list_filter(string_split(title, ' '), lambda w: w <> '' AND w[1] = upper(w[1]))[1]), list_filter(string_split(low, ' '), lambda w: length(w) > 3)[1], 'unknown') END"
)


@query(
    f""", n AS (SELECT id, ord, platform, title, lower(title) AS low, {normal_sql('title')} AS normal FROM x),
    m AS (SELECT *, {_MAIN} AS subject FROM n),
    d AS (SELECT DISTINCT subject, normal FROM m),
    s AS (SELECT a.subject, a.normal AS a, b.normal AS b, CASE WHEN a.normal = b.normal THEN 1 ELSE {similarity_sql('a.normal', 'b.normal')} END AS similarity FROM d a JOIN d b ON a.subject = b.subject)
    SELECT a.id, b.id AS b_id, a.subject, round(similarity * 100, 6) AS confidence FROM m a JOIN s ON s.subject = a.subject AND s.a = a.normal JOIN m b ON b.subject = s.subject AND b.normal = s.b
    WHERE a.ord < b.ord AND a.platform <> b.platform AND similarity >= 0.9""",
    rel.MARKET,
)
def subject_text_pairs(m: DataFrame) -> DataFrame:
    """Titles of two venues with one main subject that are similar by 0.9."""
    title = F.col("title")
    rows = matching.by_titles(m.select("ord", "id", "platform", "title"), normal=text.normalise_title(title), subject=display.main_subject(title))
    pairs = text_joins.similar_markets(rows, "subject", "normal", 0.9)
    return pairs.select("id", "b_id", "subject", r6(F.col("similarity") * 100).alias("confidence"))


@query("SELECT DISTINCT title FROM x", rel.MARKET)
def distinct_titles(m: DataFrame) -> DataFrame:
    return m.select("title").distinct()


# --- opportunities of games -------------------------------------------------------------------------------------------

_NFL = ["Saints", "Rams", "Seahawks", "Chiefs", "Bills", "Jets", "Bears"]


def _at(k: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, _NFL)), (F.pmod(k, F.lit(len(_NFL))) + 1).cast("int"))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as games of two venues: 21 pairs of teams, a date by the order's, outcomes priced by the order's number."""
    o = table(spark, sf_dir, "orders").withColumns({"k": F.col("o_custkey") % 42, "kalshi": F.col("o_orderkey") % 2 == 0})
    a, b = _at(F.col("k")), _at(F.col("k") + 1 + F.pmod(F.floor(F.col("k") / 7), F.lit(6)))
    title = F.when(F.col("o_orderkey") % 10 == 0, F.concat(a, F.lit(" rebounds vs "), b)).otherwise(F.concat(a, F.lit(" vs "), b))
    day = F.when(F.col("o_orderkey") % 13 > 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    first, second = 0.05 + 0.9 * (F.col("o_orderkey") * 31 % 83) / 83, 0.05 + 0.9 * (F.col("o_orderkey") * 17 % 79) / 79
    none = F.lit(None).cast("string")
    outcome = lambda name, price: F.struct(name.alias("name"), price.alias("price"), none.alias("teamName"))
    outcomes = F.when(F.col("kalshi"), F.array(outcome(F.lit("Yes"), first), outcome(a, second))).otherwise(F.array(outcome(a, first), outcome(b, second)))
    return o.select(
        F.col("o_orderkey").alias("ord"),
        F.when(F.col("kalshi"), F.concat(F.lit("kalshi:KXNFLGAME-"), F.col("o_orderkey"))).otherwise(F.concat(F.lit("polymarket:"), F.col("o_orderkey"))).alias("id"),
        F.when(F.col("kalshi"), "Kalshi").otherwise("Polymarket").alias("platform"),
        title.alias("title"),
        F.when(F.col("kalshi"), none).otherwise(F.lit("https://polymarket.com/event/nfl-game")).alias("link"),
        day.alias("date"),
        outcomes.alias("outcomes"),
        F.lit("$2K").alias("volume_text"),
        F.lit("$1.5K").alias("liquidity_text"),
    )


@query()
def sports_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best opportunity of each game of all sports, by sport; tests hold it against plain loops."""
    found = sports.best_of_games(games(spark, sf_dir), 2025, least_roi=0.5)
    return found.orderBy("sport_ord", "signature").select("sport", "signature", "k_ord", "p_ord", "k_place", "p_place", r6("roi").alias("roi"), r6("max_spread").alias("max_spread"), "buy_platform", "total_volume", "avg_liquidity")


_HITS = """, s AS (SELECT 'nfl-' || replace(signature, '-', '.') || '-b-' || strftime(day, '%Y-%m-%d') AS slug, max(id) AS slug_id FROM x WHERE venue = 1 AND day IS NOT NULL AND id % 3 = 0 GROUP BY slug),
    t AS (SELECT id, 'nfl-' || replace(signature, '-', '.') || '-b-' AS head, day, signature FROM x WHERE venue = 0 AND day IS NOT NULL),
    c AS (SELECT id, 0 AS k, head || strftime(day, '%Y-%m-%d') AS slug FROM t UNION ALL SELECT id, 1, head || strftime(day - 1, '%Y-%m-%d') FROM t WHERE dayofmonth(day) > 1
      UNION ALL SELECT id, 2, head || strftime(day + 1, '%Y-%m-%d') FROM t WHERE dayofmonth(day) < 28),
    h AS (SELECT id, slug_id FROM c JOIN s USING (slug) QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) = 1) """


@query(
    _HITS + """SELECT id, slug_id AS market_id, 'slug' AS "by" FROM h UNION ALL
    SELECT t.id, arg_min(m.id, m.id), 'teams' FROM t JOIN x m ON m.venue = 1 AND m.signature = t.signature AND abs(date_diff('day', m.day, t.day)) <= 1
    WHERE t.id NOT IN (SELECT id FROM h) GROUP BY t.id""",
    rel.GAME,
)
def sports_repair(g: DataFrame) -> DataFrame:
    """A third of the venue's markets has a slug; the others are found by teams and date."""
    rows = g.withColumn("team_a", F.replace("signature", F.lit("-"), F.lit("."))).filter("day IS NOT NULL")
    listed = rows.filter("venue = 1").select("ord", "id", F.array("signature", F.lit("b")).alias("teams"), "day", F.concat_ws("-", F.lit("nfl"), "team_a", F.lit("b"), F.date_format("day", "yyyy-MM-dd")).alias("slug"))
    events = rows.filter("venue = 0").select("id", F.lit("nfl").alias("sport"), "team_a", F.lit("b").alias("team_b"), F.array("signature", F.lit("b")).alias("teams"), "day")
    return sports.repaired(events, listed.select("ord", "id", "teams", "day"), sports.slug_ids(listed.filter("id % 3 = 0")))


_NAMED = "CASE CAST(floor(line / 2) AS INT) % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN name || ' wins' ELSE 'heater' || name END"


@query(
    f""", n AS (SELECT *, {_NAMED} AS label, lower({_NAMED}) AS low FROM x),
    d AS (SELECT DISTINCT low FROM n),
    s AS (SELECT a.low AS a, b.low AS b, a.low = b.low OR (contains(a.low, 'yes') AND contains(b.low, 'yes')) OR (contains(a.low, 'no') AND contains(b.low, 'no'))
      OR {similarity_sql('a.low', 'b.low')} > CASE WHEN a.low IN ('yes', 'no') OR b.low IN ('yes', 'no') THEN 0.7 ELSE 0.75 END AS alike FROM d a, d b),
    p AS (SELECT a.event, a.ord AS k, b.ord AS k_b, a.kalshi AS u, b.poly AS v, least(a.kalshi, b.poly) AS buy, greatest(a.kalshi, b.poly) AS sell
      FROM n a JOIN n b ON a.event = b.event AND a.line % 2 = 1 AND b.line % 2 = 0 JOIN s ON s.a = a.low AND s.b = b.low WHERE alike)
    SELECT event, k, k_b, round((sell - buy) * 100, 6) AS spread, round(greatest((sell - buy) / buy * 100, 0), 6) AS max_spread, u < v AS first_buys
    FROM p QUALIFY row_number() OVER (PARTITION BY event ORDER BY greatest((sell - buy) / buy * 100, 0) DESC, k, k_b) = 1""",
    rel.PRICES,
)
def outcome_match_spread(p: DataFrame) -> DataFrame:
    """Odd lines of an event as one market and even ones as the other, matched by name."""
    rows = p.withColumn("label", F.expr(_NAMED))
    side = lambda odd, price: rows.filter(F.col("line") % 2 == odd).select("event", F.col("label").alias("name"), F.col(price).alias("price"), F.col("ord").alias("k"))
    best = sports.outcome_matches(side(1, "kalshi"), side(0, "poly"), "event")
    return best.select("event", "k", "k_b", r6("spread").alias("spread"), r6("max_spread").alias("max_spread"), "first_buys")


_RANKED = "SELECT event, line, round((poly - kalshi) / least(kalshi, poly) * 100, 6) AS max_spread, volume AS total_volume FROM x"


@query(_RANKED + " ORDER BY max_spread DESC, event, line, ord LIMIT 100", rel.PRICES)
def opportunities_by_spread(p: DataFrame) -> DataFrame:
    from oddsloom.operators.arbitrage import signed_spread

    rows = p.select("event", "line", "ord", r6(signed_spread(F.col("kalshi"), F.col("poly"))).alias("max_spread"), F.col("volume").alias("total_volume"))
    return sports.by_choice(rows, "spread", 100, "event", "line", "ord").drop("ord")


@query(_RANKED + " ORDER BY total_volume DESC, event, line, ord LIMIT 100", rel.PRICES)
def opportunities_by_volume(p: DataFrame) -> DataFrame:
    from oddsloom.operators.arbitrage import signed_spread

    rows = p.select("event", "line", "ord", r6(signed_spread(F.col("kalshi"), F.col("poly"))).alias("max_spread"), F.col("volume").alias("total_volume"))
    return sports.by_choice(rows, "volume", 100, "event", "line", "ord").drop("ord")


# --- mixes of venues --------------------------------------------------------------------------------------------------

_TURN = "CASE platform WHEN 'Polymarket' THEN 0 WHEN 'Kalshi' THEN 1 ELSE 2 END"
_VENUES = ["Polymarket", "Kalshi", "PredictIt"]


@query(
    f"""SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY tail, k) AS place FROM (
        SELECT id, 0 AS tail, row_number() OVER (ORDER BY round, o) AS k FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY volume DESC, id) AS round, {_TURN} AS o FROM x WHERE platform <> 'PredictIt') r
        UNION ALL SELECT id, 1, row_number() OVER (ORDER BY volume DESC, id) FROM x WHERE platform = 'PredictIt') u) p WHERE place <= (SELECT count(*) FROM x) - 5""",
    rel.MARKET,
)
def round_robin_with_tail(m: DataFrame) -> DataFrame:
    """Two venues in turn and the third behind them, all but the last five rows."""
    return ranking.round_robin_tail(m.select("id", "platform", "volume"), "platform", _VENUES[:2], m.count() - 5, F.desc("volume"), "id")


@query(
    f""", r AS (SELECT id, {_TURN} AS turn, row_number() OVER (PARTITION BY platform ORDER BY volume DESC, id) AS r FROM x),
    n AS (SELECT least(50, ceil(max(n) / 3.0)) AS rounds FROM (SELECT count(*) AS n FROM x GROUP BY platform) c)
    SELECT id, CAST(turn AS INTEGER) AS turn, CASE WHEN r > rounds THEN 1 ELSE 0 END AS phase, CAST(CASE WHEN r > rounds THEN r - rounds ELSE r END AS BIGINT) AS round FROM r, n""",
    rel.MARKET,
)
def platform_interleave(m: DataFrame) -> DataFrame:
    out = ranking.interleaved(m.select("id", "platform", "volume"), "platform", _VENUES, 50, -F.col("volume"), "id")
    return out.select("id", "turn", "phase", F.col("round").cast("long").alias("round"))


# --- what titles ask --------------------------------------------------------------------------------------------------


def _kind_sql(x: str, kinds: dict[str, list[str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f"""contains({x}, '{w}')""" for w in words)} THEN '{name}'" for name, words in kinds.items()) + f" ELSE {default} END"


_OBJECTS = " ".join(rf"WHEN regexp_matches(title, '(?i){p}') THEN " + (rf"lower(regexp_extract(title, '(?i){p}'))" if name is None else f"'{name}'") for p, name in questions.OBJECTS)
_TIMES = rf"coalesce(nullif(regexp_extract(normal, '\b(20\d\d)\b', 1), ''), {_kind_sql('normal', {m: [m] for m in text.LONG_MONTHS}, 'NULL')}, nullif(regexp_extract(normal, 'q[1-4]'), ''), CASE WHEN contains(normal, 'eoy') OR contains(normal, 'end of year') THEN 'end of year' WHEN contains(normal, 'this year') THEN 'this year' WHEN contains(normal, 'next year') THEN 'next year' END)"
_ASKED = f"""SELECT id, id AS ord, platform, title, {_kind_sql('lower(title)', questions.SIGNATURES, "'unknown'")} AS signature, {_kind_sql('normal', questions.EVENTS, "'event'")} AS event_type,
      {_kind_sql('normal', questions.ACTIONS, "'unknown'")} AS action, {_kind_sql('normal', questions.OUTCOMES, "'unknown'")} AS outcome, CASE {_OBJECTS} ELSE '' END AS object,
      {_kind_sql("(' ' || lower(title))", {w: [f' {w} '] for w in questions.ASKED}, "'unknown'")} AS question_type, {_TIMES} AS timeframe,
      coalesce(lower(nullif(regexp_extract(title, '(?i)\\$[\\d.]+[kmb]?'), '')), nullif(regexp_extract(title, '\\b(20\\d\\d)\\b', 1), ''), nullif(regexp_extract(title, '\\d+%'), '')) AS target,
      array_to_string(list_filter(string_split(normal, ' '), lambda w: length(w) > 2 AND NOT list_contains([{', '.join(f"'{w}'" for w in questions.NO_KEYWORD)}], w))[:5], '|') AS keywords
    FROM (SELECT *, {normal_sql('title')} AS normal FROM x) n"""


@query(f"SELECT id, signature, event_type, action, outcome, object, question_type, timeframe, target, keywords FROM ({_ASKED}) a", rel.MARKET)
def question_components(m: DataFrame) -> DataFrame:
    c = questions.components(m.select("id", "title"))
    return c.select("id", "signature", "event_type", "action", "outcome", "object", "question_type", "timeframe", "target", F.array_join("keywords", "|").alias("keywords"))


_YEAR = lambda side: rf"CAST(nullif(regexp_extract({side}.timeframe, '^20\d\d$'), '') AS INTEGER)"
_SAME = " AND ".join(f"(contains(lower(a.title), '{w}') = contains(lower(b.title), '{w}') OR (contains(lower(b.title), '{w}') AND contains(lower(a.title), 'winner')))" for w in questions.DIRECTIONS)


@query(
    f""", q AS ({_ASKED})
    SELECT a.id, b.id AS b_id, a.signature FROM q a JOIN q b ON a.signature = b.signature AND a.object = b.object AND a.ord < b.ord AND a.platform <> b.platform
    WHERE a.signature <> 'unknown' AND (a.timeframe IS NULL OR b.timeframe IS NULL OR {_YEAR('a')} IS NULL OR {_YEAR('b')} IS NULL OR abs({_YEAR('a')} - {_YEAR('b')}) <= 1)
      AND {_SAME} AND (a.outcome = b.outcome OR a.outcome = 'unknown' OR b.outcome = 'unknown') AND a.id % 4 = b.id % 4""",
    rel.MARKET,
)
def question_same_pairs(m: DataFrame) -> DataFrame:
    """Markets of two venues with one kind of question about one object (and one of four groups, in place of a subject)."""
    title, normal = F.col("title"), text.normalise_title(F.col("title"))
    asked = {"signature": questions.signature(title), "object": questions.named_object(title), "outcome": questions.outcome(normal), "timeframe": questions.timeframe(normal)}
    c = matching.by_titles(m.select("id", "ord", "platform", "title"), **asked).withColumn("subject", F.concat_ws("|", "object", F.col("id") % 4))
    return matching.question_pairs(c).select("id", "b_id", "signature")
