"""Rules on titles and outcomes that decide which markets may be about the same event, beyond equal words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from oddsloom.functions.expressions import bound, lookup
from oddsloom.functions.rewriting import replaced
from oddsloom.functions.teams import names_in, teams_from_text
from oddsloom.functions.text import extract_date

# Nicknames and the city that each stands for in a title that is compared by its vector; some cities stand for a team.
VECTOR_CITIES = {
    "saints": "new orleans", "buccaneers": "tampa bay", "bucs": "tampa bay", "packers": "green bay", "chiefs": "kansas city",
    "49ers": "san francisco", "niners": "san francisco", "bills": "buffalo", "bengals": "cincinnati", "ravens": "baltimore",
    "patriots": "new england", "cowboys": "dallas", "eagles": "philadelphia", "rams": "los angeles", "chargers": "los angeles",
    "giants": "new york", "jets": "new york", "bears": "chicago", "dolphins": "miami", "falcons": "atlanta", "broncos": "denver",
    "lions": "detroit", "texans": "houston", "colts": "indianapolis", "jaguars": "jacksonville", "vikings": "minnesota",
    "raiders": "las vegas", "seahawks": "seattle", "titans": "tennessee", "commanders": "washington", "panthers": "carolina",
    "cardinals": "arizona", "steelers": "pittsburgh", "browns": "cleveland", "celtics": "boston", "bucks": "milwaukee",
    "nuggets": "denver", "hornets": "charlotte", "knicks": "new york", "nets": "brooklyn", "lakers": "los angeles",
    "clippers": "los angeles", "warriors": "golden state", "heat": "miami", "suns": "phoenix", "mavericks": "dallas", "mavs": "dallas",
    "rockets": "houston", "spurs": "san antonio", "thunder": "oklahoma city", "trail blazers": "portland", "blazers": "portland",
    "kings": "sacramento", "pelicans": "new orleans", "grizzlies": "memphis", "timberwolves": "minnesota", "wolves": "minnesota",
    "jazz": "utah", "wizards": "washington", "raptors": "toronto", "76ers": "philadelphia", "sixers": "philadelphia",
    "pacers": "indiana", "cavaliers": "cleveland", "cavs": "cleveland", "pistons": "detroit", "magic": "orlando", "hawks": "atlanta",
    "avalanche": "colorado", "bruins": "boston", "blackhawks": "chicago", "hurricanes": "carolina", "canes": "carolina",
    "blues": "st louis", "blue jackets": "columbus", "capitals": "washington", "caps": "washington", "canucks": "vancouver",
    "flames": "calgary", "flyers": "philadelphia", "islanders": "new york", "lightning": "tampa bay", "maple leafs": "toronto",
    "leafs": "toronto", "oilers": "edmonton", "penguins": "pittsburgh", "pens": "pittsburgh", "predators": "nashville",
    "preds": "nashville", "rangers": "new york", "red wings": "detroit", "wings": "detroit", "sharks": "san jose",
    "wild": "minnesota", "stars": "dallas", "ducks": "anaheim", "sabres": "buffalo", "devils": "new jersey", "senators": "ottawa",
    "sens": "ottawa", "kraken": "seattle", "golden knights": "vegas", "knights": "vegas",
    "portland": "trail blazers", "memphis": "grizzlies", "new orleans": "pelicans", "golden state": "warriors",
    "oklahoma city": "thunder", "utah": "jazz", "sacramento": "kings", "phoenix": "suns", "san antonio": "spurs",
    "indiana": "pacers", "orlando": "magic", "toronto": "raptors",
}
# Short forms and what they stand for, then cities that stand for a team, in the order in which they are replaced.
VECTOR_SHORT = {"btc": "bitcoin", "eth": "ethereum", "nfl": "football game", "nba": "basketball game", "nhl": "hockey game", "mlb": "baseball game", "ncaa": "college game"}
VECTOR_TEAMS = {
    "oklahoma city": "thunder", "los angeles": "lakers clippers", "philadelphia": "sixers", "houston": "rockets", "utah": "jazz",
    "seattle": "kraken", "portland": "trail blazers", "memphis": "grizzlies", "new orleans": "pelicans",
}
# Patterns of the categories in which vectors are compared, first match wins; a nickname or city above is sports.
VECTOR_CATEGORIES = [
    ("sports", r"\b(vs|at|@|game|match|playoff|championship|super bowl|nfl|nba|nhl|mlb|ncaa)\b"),
    ("politics", r"\b(election|senate|house|governor|primary|nomination|party|republican|democrat|presidential|president)\b"),
    ("crypto", r"\b(bitcoin|btc|ethereum|eth|crypto|cryptocurrency|price|stock|market|gdp|inflation|fed|federal reserve)\b"),
]
# States that two political titles must share, in the order in which they are looked for.
POLL_STATES = [
    "nebraska", "minnesota", "virginia", "ohio", "michigan", "colorado", "washington", "california", "new york", "texas",
    "florida", "pennsylvania", "north carolina", "south carolina", "georgia", "arizona", "wisconsin", "nevada", "new hampshire",
]
# Cities that a side of a game is known by, in the order in which they are looked for.
GAME_CITIES = [
    "new orleans", "tampa bay", "green bay", "kansas city", "san francisco", "buffalo", "cincinnati", "baltimore", "dallas",
    "philadelphia", "los angeles", "new york", "chicago", "miami", "atlanta", "denver", "detroit", "houston", "indianapolis",
    "jacksonville", "minnesota", "las vegas", "seattle", "tennessee", "washington", "carolina", "arizona", "pittsburgh",
    "cleveland", "new england", "boston", "milwaukee", "charlotte", "brooklyn", "golden state", "phoenix", "san antonio",
    "oklahoma city", "portland", "sacramento", "memphis", "utah", "toronto", "indiana", "orlando", "colorado", "st louis",
    "vancouver", "calgary", "edmonton", "nashville", "san jose", "anaheim", "new jersey", "ottawa", "florida", "vegas", "columbus",
]
#: Nicknames of a game's sides: those of vectors without the cities and two names, and one more.
GAME_NICKNAMES = {n: c for n, c in VECTOR_CITIES.items() if n not in {"niners", "panthers", *GAME_CITIES}} | {"florida panthers": "florida"}
# Words that make a market of a game one on players; slugs, tickers and title words of the sports.
PROPS = ["player", "yards", "touchdowns", "rebounds", "assists", "goals", "saves"]
SPORTS = ["nfl", "nba", "nhl", "cbb", "cfb"]
TICKERS = {"nfl": "KXNFLGAME", "nba": "KXNBAGAME", "nhl": "KXNHLGAME", "cfb": "KXNCAAFGAME", "cbb": "KXNCAAMBGAME"}
LINKS = {"nfl": "/event/nfl-", "nba": "/event/nba-", "nhl": "/event/nhl-", "cfb": "/event/cfb-", "cbb": "/event/(cbb|cwbb)-"}
TITLES = {"nfl": r"\b(nfl|football)\b", "nba": r"\b(nba|basketball)\b", "nhl": r"\b(nhl|hockey)\b", "cfb": r"\b(cfb|college football)\b", "cbb": r"\b(cbb|college basketball)\b|\(w\)"}
NOT_TITLES = {"nfl": r"\b(college|ncaa|cfb)\b", "nba": r"\b(college|ncaa)\b"}


def longest_first(table: dict[str, str]) -> list[str]:
    return sorted(table, key=lambda k: -len(k))


def vector_title(title: Column) -> Column:
    """A title as it is turned into a vector: short forms spelt out, cities for nicknames and back for some, without fillers.

    Names are replaced one after the other, the longest first, so a city that was put in may be replaced again.
    """
    steps = [*VECTOR_SHORT.items(), *((k, VECTOR_CITIES[k]) for k in longest_first(VECTOR_CITIES)), *VECTOR_TEAMS.items()]
    out = replaced(F.lower(F.coalesce(title, F.lit(""))), [*steps, *((w, " ") for w in ("will", "does", "the", "a", "an"))])
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def vector_category(title: Column) -> Column:
    """Category in which vectors are compared: ``sports`` by pattern or any name, else ``politics``, ``crypto``, ``other``."""
    names = "|".join(map(re.escape, VECTOR_CITIES))
    (sports, first), *rest = VECTOR_CATEGORIES
    out = F.when(title.rlike(f"(?i){first}") | title.rlike(rf"(?i)\b({names})\b"), sports)
    for name, pattern in rest:
        out = out.when(title.rlike(f"(?i){pattern}"), name)
    return out.otherwise("other")


def usable_title(title: Column) -> Column:
    """Five letters or more, no placeholder and no short generic title; false for null."""
    generic = title.startswith("Kalshi Market ") & (F.length(title) < 20)
    return F.coalesce((F.length(title) >= 5) & ~title.isin("Combo", "Unknown", "Unknown Market") & ~generic, F.lit(False))


def sports_agree(a: Column, b: Column) -> Column:
    """False only if both titles are read as ``X at Y`` and share no word of more than three letters.

    The sides' class leaves out the letters v and s, so most such titles are not read and pass.
    """
    return sides_agree(side_words(a), side_words(b))


def side_words(title: Column) -> Column:
    """The words of more than three letters of a title that is read as two sides; null if it is not."""
    # Fixed value: the pattern of two sides.
    sides = r"^([^@vs]+)(?:\s+(?:at|vs|@)\s+)([^@vs]+)$"
    t = F.lower(F.coalesce(title, F.lit("")))
    words = F.concat(*(F.split(F.trim(F.regexp_extract(t, sides, k)), r"\s+") for k in (1, 2)))
    return F.when(t.rlike(sides), F.filter(words, lambda w: F.length(w) > 3))


def sides_agree(a: Column, b: Column) -> Column:
    """``sports_agree`` of two ``side_words``."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(True))


def politics_agree(a: Column, b: Column) -> Column:
    """Office, state and primary party are equal or missing in one; a primary never meets a general election."""
    return races_agree(race_of(a), race_of(b))


def race_of(title: Column) -> Column:
    """``office, state, primary`` of a political title, each null if it names none."""
    t = F.lower(F.coalesce(title, F.lit("")))

    def office(t: Column) -> Column:
        return F.when(t.contains("senate"), "senate").when(t.contains("house"), "house").when(t.contains("governor"), "governor").when(t.contains("presidential"), "president")

    def state(t: Column) -> Column:
        return F.coalesce(*(F.when(t.contains(s), s) for s in POLL_STATES))

    def primary(t: Column) -> Column:
        # Fixed value: the pattern of a party's primary.
        kind = r"\s+(?:senate|house|gubernatorial)?\s*primary"
        return F.when(t.rlike(f"republican{kind}"), "republican").when(t.rlike(f"democratic?{kind}"), "democratic")

    return F.struct(office(t).alias("office"), state(t).alias("state"), primary(t).alias("primary"))


def races_agree(a: Column, b: Column) -> Column:
    """``politics_agree`` of two ``race_of``."""
    apart = lambda f: F.coalesce(a[f] != b[f], F.lit(False))
    return ~apart("office") & ~apart("state") & a["primary"].eqNullSafe(b["primary"])


def city_of(side: Column) -> Column:
    """The city of one side of a game: the city that it begins with, else that of the longest nickname in it; null if it has none."""
    # Fixed value: leagues that a side may begin with.
    s = F.regexp_replace(F.trim(F.lower(side)), r"^(nhl|nba|nfl|mlb|ncaa|ahl|shl|ufc):\s*", "")
    city = F.nullif(F.regexp_extract(s, rf"^({'|'.join(GAME_CITIES)})(?: |\z)", 1), F.lit(""))
    nickname = F.get(names_in(s, GAME_NICKNAMES, longest_first(GAME_NICKNAMES)), F.lit(0))
    return F.coalesce(city, F.try_element_at(lookup(GAME_NICKNAMES), nickname))


def title_teams(title: Column) -> Column:
    """The two cities of ``X vs Y``, ``X at Y`` or ``X @ Y``; none unless both are known and differ."""
    t = F.trim(F.lower(title))
    cities = (city_of(F.regexp_extract(t, r"^(.+?)\s+(?:vs\.?|versus|at|@)\s+(.+?)$", k)) for k in (1, 2))
    return bound(lambda one, two: F.when(one != two, F.array(one, two)).otherwise(F.array().cast("array<string>")), *cities)


def team_score(a: Column, b: Column) -> Column:
    """Share of ``a``'s teams that ``b`` has too, of the larger number of teams; 0 where one has none."""
    low = lambda x: F.transform(x, lambda t: F.lower(F.trim(t)))
    both = F.size(F.filter(low(a), lambda t: F.array_contains(low(b), t)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.greatest(F.size(a), F.size(b)))


def sports_confidence(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """70 for the teams (by ``team_score``, 0 below a half), 20 for the same sport, 10 if both titles name a game. ``a``, ``b``: ``title, teams, sport``."""
    score = team_score(a["teams"], b["teams"])
    sport = F.when(F.lower(a["sport"]) == F.lower(b["sport"]), 20).otherwise(0)
    game = lambda c: c.rlike(r"(?i)\b(?:vs\.?|at|@|versus)\b")
    return F.when(score >= 0.5, score * 70 + sport + F.when(game(a["title"]) & game(b["title"]), 10).otherwise(0)).otherwise(0.0)


def team_win(title: Column, names: Column) -> Column:
    """A market on who wins: no word on players in its title, and an outcome without number or spread, or none with a digit."""
    plain = lambda n: ~n.rlike(r"\d|spread|over|under|o/u")
    low = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.lower(F.coalesce(n, F.lit(""))))
    return ~F.lower(title).rlike("|".join(PROPS)) & (F.exists(low, plain) | ~F.exists(low, lambda n: n.rlike(r"\d")))


def game_teams(platform: Column, title: Column, link: Column) -> Column:
    """Teams of a game: for Polymarket the two of the slug, else of the title; for Kalshi of the title, else two of the link."""
    link = F.lower(F.coalesce(link, F.lit("")))
    slug = F.replace(link, F.lit("https://polymarket.com/event/"), F.lit(""))
    # Fixed value: the form of a game's slug.
    pattern = r"^(nfl|nba|nhl|cbb|cfb|cwbb)-([a-z]+)-([a-z]+)-(\d{4}-\d{2}-\d{2})"
    of_slug = F.when(slug.rlike(pattern), F.array(F.regexp_extract(slug, pattern, 2), F.regexp_extract(slug, pattern, 3)))

    def chosen(of_title: Column, of_link: Column) -> Column:
        kalshi = F.when((F.size(of_title) != 2) & (F.size(of_link) == 2), of_link).otherwise(of_title)
        return F.when(platform == "Polymarket", F.coalesce(of_slug, of_title)).otherwise(kalshi)

    return bound(chosen, teams_from_text(title), teams_from_text(link))


def in_sport(sport: str, market_id: Column, title: Column, link: Column) -> Column:
    """A market of the sport by its ticker, its link or its title."""
    ticker = F.upper(F.regexp_replace(F.coalesce(market_id, F.lit("")), "(?i)^kalshi:", ""))
    t = F.lower(F.coalesce(title, F.lit("")))
    named = t.rlike(TITLES[sport])
    if sport in NOT_TITLES:
        named = named & ~t.rlike(NOT_TITLES[sport])
    return ticker.contains(TICKERS[sport]) | F.lower(F.coalesce(link, F.lit(""))).rlike(LINKS[sport]) | named


def event_signature(title: Column, market_id: Column, date: Column, as_of_year: int) -> Column:
    """``team-team`` in order, with the date of title, identifier or market behind it; null unless the title names two teams."""
    day = F.coalesce(*(extract_date(c, as_of_year) for c in (title, market_id, date)))
    return bound(lambda teams, day: F.when(F.size(teams) == 2, F.concat_ws("-", F.array_join(teams, "-"), day)), F.array_sort(teams_from_text(title)), day)


def same_event(a: Column, b: Column) -> Column:
    """Equal signatures; false where one has none. A date in one alone makes them differ."""
    return F.coalesce(a == b, F.lit(False))


def opposing(team_a: Column, team_b: Column, named_a: Column, named_b: Column, event: Column) -> Column:
    """Two outcomes for different teams of one event of two teams.

    ``team_*`` is what each outcome stands for; where one is unknown, the first teams that their names hold (``named_*``) count.
    """
    known = team_a.isNotNull() & team_b.isNotNull()
    a, b = (F.when(known, t).otherwise(F.get(n, F.lit(0))) for t, n in ((team_a, named_a), (team_b, named_b)))
    return F.coalesce((F.size(event) == 2) & (a != b) & F.array_contains(event, a) & F.array_contains(event, b), F.lit(False))
