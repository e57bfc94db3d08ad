"""Text functions for titles and queries: terms, categories, entities, dates, normal forms and similarities."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions.expressions import bound, once
from oddsloom.functions.numbers import parse_volume
from oddsloom.functions.rewriting import replaced

# Words that a query's terms leave out.
STOP_WORDS = "the a an and or but in on at to for of with by will be is are was were".split()
SEARCH_STOP_WORDS = [*STOP_WORDS, "before", "after", "when"]

# Keywords of a market's category, first match wins.
POLITICS = ["president", "election", "senate", "congress", "trump", "biden", "democrat", "republican", "vote", "poll", "political"]
LEAGUES = ["nfl", "nba", "mlb", "nhl", "soccer", "football", "basketball", "baseball", "hockey", "super bowl", "championship", "playoff", "win", "team", "game"]
NFL_TEAMS = (
    "chiefs bills cowboys eagles patriots packers 49ers ravens dolphins steelers browns bengals jets giants commanders bears"
    " lions vikings falcons panthers saints buccaneers cardinals rams seahawks titans colts jaguars texans broncos raiders chargers"
).split()
CRYPTO = ["bitcoin", "btc", "ethereum", "eth", "crypto", "blockchain", "defi", "nft", "coin", "token"]
ENTERTAINMENT = ["movie", "film", "oscar", "award", "celebrity", "actor", "actress", "music", "album", "tv", "show"]
TECHNOLOGY = ["tech", "ai", "artificial intelligence", "apple", "google", "microsoft", "meta", "tesla", "software", "hardware"]
ECONOMY = ["economy", "gdp", "inflation", "unemployment", "fed", "federal reserve", "stock", "market", "recession"]
WORLD = ["war", "ukraine", "russia", "china", "europe", "asia", "middle east", "international", "global"]
API_CATEGORIES = [("Politics", POLITICS), ("Sports", LEAGUES + NFL_TEAMS), ("Crypto", CRYPTO)]
HOME_CATEGORIES = [("Politics", POLITICS), ("Sports", LEAGUES), ("Crypto", CRYPTO), ("Entertainment", ENTERTAINMENT), ("Technology", TECHNOLOGY), ("Economy", ECONOMY), ("World", WORLD)]

# Patterns of a title's category, first match wins.
TITLE_CATEGORIES = [
    ("sports", r"\bvs\b|\bat\b|@|\b(NFL|NBA|NHL|MLB|NCAA|game|match|playoff|championship|super bowl)\b"),
    ("politics", r"\b(election|senate|house|governor|primary|nomination|party|republican|democrat|democratic|gop|presidential)\b"),
    ("entertainment", r"\b(oscar|emmy|grammy|award|movie|album|release|actor|actress)\b"),
    ("economics", r"\b(price|stock|market|GDP|inflation|rate|fed|federal reserve|bitcoin|btc|ethereum|eth|crypto)\b"),
    ("weather", r"\b(temperature|rain|snow|hurricane|weather|storm|flood)\b"),
]

# Names that a title's entities are found by.
STATES = (
    "Alabama|Alaska|Arizona|Arkansas|California|Colorado|Connecticut|Delaware|Florida|Georgia|Hawaii|Idaho|Illinois|Indiana|Iowa"
    "|Kansas|Kentucky|Louisiana|Maine|Maryland|Massachusetts|Michigan|Minnesota|Mississippi|Missouri|Montana|Nebraska|Nevada"
    "|New Hampshire|New Jersey|New Mexico|New York|North Carolina|North Dakota|Ohio|Oklahoma|Oregon|Pennsylvania|Rhode Island"
    "|South Carolina|South Dakota|Tennessee|Texas|Utah|Vermont|Virginia|Washington|West Virginia|Wisconsin|Wyoming"
)
ENTITIES = {
    "state": rf"(?i)\b({STATES})\b",
    "office": r"(?i)\b(Senate|House|Governor|Presidential|President|Congress|Representative)\b",
    "party": r"(?i)\b(Republican|Democratic|Democrat|GOP)\b",
    "year": r"\b(2024|2025|2026|2027|2028|2029|2030)\b",
    "sport": r"(?i)\b(NFL|NBA|NHL|MLB|NCAA|NCAAB|NCAAM|NCAAMBB)\b",
}

# Synonyms that widen a search.
SYNONYMS = {
    "nfl": ["football", "nfl game", "national football league", "nfl team", "nfl championship", "super bowl"],
    "football": ["nfl", "nfl game", "football game", "nfl team"],
    "nba": ["basketball", "nba game", "national basketball association"],
    "basketball": ["nba", "nba game"],
    "mlb": ["baseball", "mlb game", "major league baseball"],
    "baseball": ["mlb", "mlb game"],
    "nhl": ["hockey", "nhl game", "national hockey league"],
    "hockey": ["nhl", "nhl game"],
    "crypto": ["bitcoin", "btc", "ethereum", "eth", "cryptocurrency"],
    "bitcoin": ["btc", "crypto", "cryptocurrency"],
    "btc": ["bitcoin", "crypto"],
    "ethereum": ["eth", "crypto"],
    "eth": ["ethereum", "crypto"],
    "politics": ["election", "president", "senate", "congress", "trump", "biden"],
    "election": ["politics", "president", "senate", "congress"],
}

# The city that stands for a team in a normalised title, and the words that it drops.
TITLE_CITIES = {
    "saints": "new orleans", "buccaneers": "tampa bay", "bucs": "tampa bay", "packers": "green bay", "chiefs": "kansas city",
    "49ers": "san francisco", "bills": "buffalo", "bengals": "cincinnati", "ravens": "baltimore", "patriots": "new england",
    "cowboys": "dallas", "eagles": "philadelphia", "rams": "los angeles", "chargers": "los angeles", "giants": "new york",
    "jets": "new york", "bears": "chicago", "dolphins": "miami", "falcons": "atlanta", "broncos": "denver", "lions": "detroit",
    "texans": "houston", "colts": "indianapolis", "jaguars": "jacksonville", "vikings": "minnesota", "raiders": "las vegas",
    "seahawks": "seattle", "titans": "tennessee", "commanders": "washington", "panthers": "carolina", "cardinals": "arizona",
    "steelers": "pittsburgh", "browns": "cleveland",
}
FILLERS = "will|does|is|the|a|an|by|in|on|at|to|for|of|with|from|and|or|but|this|that|be|are|was|were"


def has_any(text: Column, keywords: list[str]) -> Column:
    return text.rlike("|".join(map(re.escape, keywords)))


def keyword_category(text: Column, classes: list[tuple[str, list[str]]], default: str) -> Column:
    """First class with a keyword anywhere in the lower-case text."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    out = F
    for name, words in classes:
        out = out.when(has_any(lower, words), name)
    return out.otherwise(default)


def title_category(title: Column) -> Column:
    out = F
    for name, pattern in TITLE_CATEGORIES:
        out = out.when(title.rlike(f"(?i){pattern}"), name)
    return out.otherwise("other")


def entity(title: Column, kind: str) -> Column:
    """First entity of ``kind`` as the title writes it, null if there is none."""
    return F.nullif(F.regexp_extract(title, ENTITIES[kind], 1), F.lit(""))


def query_terms(query: str, stop_words: list[str] = STOP_WORDS) -> list[str]:
    """Terms of a query. Stop words go before punctuation does, so ``on?`` stays as ``on``."""
    kept = (t for t in query.lower().split() if len(t) > 1 and t not in stop_words)
    return [t for t in (re.sub(r"[^a-z0-9]", "", t) for t in kept) if t]


def query_terms_of(query: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """The same for a column of queries."""
    words = F.filter(F.split(F.trim(F.lower(query)), r"\s+"), lambda t: (F.length(t) > 1) & ~t.isin(stop_words))
    return F.filter(F.transform(words, lambda t: F.regexp_replace(t, "[^a-z0-9]", "")), lambda t: t != "")


def whole_word(text: Column, term: str) -> Column:
    return text.rlike(rf"(?i)\b{re.escape(term)}\b")


def term_matches(text: Column, term: str) -> Column:
    """Terms of up to three letters only as whole words, longer ones anywhere."""
    return whole_word(text, term) if len(term) <= 3 else whole_word(text, term) | text.contains(term)


def all_terms(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (term_matches(F.lower(text), t) for t in terms), F.lit(True))


def _count(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (f.cast("int") for f in flags), F.lit(0))


def _matcher(term: str) -> Callable[[Column], Column]:
    return lambda field: term_matches(F.lower(field), term)


def _holder(term: str) -> Callable[[Column], Column]:
    return lambda field: F.lower(field).contains(term)


def token_match_counts(fields: Column, tokens: list[str]) -> tuple[Column, Column]:
    """How many tokens some field of an array has, and how many it needs: all of one or two, else 70 %."""
    found = [F.exists(fields, _matcher(t)) for t in tokens]
    return _count(found), F.lit(len(tokens) if len(tokens) <= 2 else math.ceil(len(tokens) * 0.7))


def relevance(title: Column, platform: Column, outcomes: Column, query: str) -> Column:
    """Per word of the query: 5 if the title begins with it, 3 if it has it, 1 for the platform's name, 2 for any outcome."""
    t, p = F.lower(title), F.lower(platform)
    each = [
        F.when(t.startswith(w), 5).otherwise(0) + F.when(t.contains(w), 3).otherwise(0) + F.when(p.contains(w), 1).otherwise(0) + F.when(F.exists(outcomes, _holder(w)), 2).otherwise(0)
        for w in query.lower().split()
    ]
    return reduce(lambda a, b: a + b, each, F.lit(0))


def search(markets: DataFrame, query: str) -> DataFrame:
    """Adds ``score`` and leaves out what is no match: exact phrase, then a ladder from category to single words.

    ``markets`` has ``title``, ``outcomes`` (array of names) and ``volume_text``. Which terms and synonyms a market has
    is worked out once, in a flag for each.
    """
    q = query.strip().lower()
    plain = lambda x: re.sub(r"[^a-z0-9\s]", "", x)
    terms = query_terms(q, SEARCH_STOP_WORDS)
    originals = list(dict.fromkeys(terms)) or [plain(q)]
    synonyms = list(dict.fromkeys(plain(s) for t in terms for s in SYNONYMS.get(t, []) if plain(s) not in terms))
    asked = next((name for name, words in API_CATEGORIES if any(k in f"{q} " for k in words)), "Other")
    wanted = [*originals, *synonyms]
    text = F.concat_ws(" ", F.lower(F.coalesce("title", F.lit(""))), F.lower(F.array_join("outcomes", " ")))
    # Flags are worked out once a row, as arrays: an expression for each use of each flag is too much code to compile.
    m = once(markets, __text=text)
    m = once(m, __whole=F.array(*(whole_word(F.col("__text"), t) for t in wanted)))
    m = once(m, __hit=F.array(*(F.get("__whole", F.lit(k)) | (F.lit(len(t) > 3) & F.col("__text").contains(t)) for k, t in enumerate(wanted))))
    count = lambda flags: F.size(F.filter(flags, lambda x: x))
    of_asked = F.lit(asked != "Other") & (keyword_category(F.col("__text"), API_CATEGORIES, "Other") == asked)
    m = once(m, __c=F.struct(
        count("__hit").alias("n"),
        count("__whole").alias("w"),
        count(F.slice("__hit", len(originals) + 1, len(wanted))).alias("s"),
        F.forall(F.slice("__hit", 1, len(originals)), lambda x: x).alias("every"),
        of_asked.alias("of_asked"),
        F.lower("title").contains(q).alias("exact"),
    )).select(*markets.columns, *(F.col(f"__c.{c}").alias(f"__{c}") for c in ("n", "w", "s", "every", "of_asked", "exact")))
    n, w, s, every = (F.col(f"__{c}") for c in ("n", "w", "s", "every"))
    ladder = (
        F.when(F.col("__of_asked"), 100 + F.when(every, 100).otherwise(n * 20) + s * 10)
        .when(every, 150 + w * 20 + s * 10)
        .when(n >= math.ceil(len(originals) * 0.7), n * 15 + s * 5)
        .when(F.lit(len(originals) == 1) & (n > 0), 50 + s * 5)
    )
    m = m.withColumn("__ladder", ladder).filter("__ladder IS NOT NULL OR __exact")
    score = F.coalesce("__ladder", F.lit(0)) + F.when(F.col("__exact"), 200).otherwise(0) + F.least(parse_volume(F.col("volume_text")) / 10000, F.lit(5.0))
    return m.select(*markets.columns, score.alias("score"))


def normalise_title(title: Column) -> Column:
    """Lower case, cities for teams, without fillers and punctuation; amounts and percentages in words."""
    out = replaced(F.lower(F.coalesce(title, F.lit(""))), [*TITLE_CITIES.items(), *((w, " ") for w in FILLERS.split("|"))])
    for pattern, put in ((r"\$(\d+)([kmb]?)", "$1$2"), (r"(\d+)%", "$1 percent"), (r"[?!.,;:()\[\]{}'\"]", " "), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, put)
    return F.trim(out)


def parsed(markets: DataFrame) -> DataFrame:
    """Adds what structured matching compares: ``category``, the entities and ``normal``, the normal form of each title."""
    title = F.col("title")
    return markets.withColumns({"category": title_category(title), **{k: entity(title, k) for k in ENTITIES}, "normal": normalise_title(title)})


def word_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.8 if one holds the other, else shared distinct letters over the larger number of them."""
    letters = lambda x: F.array_distinct(F.split(x, ""))
    shared = F.size(F.array_intersect(letters(a), letters(b))) / F.greatest(F.size(letters(a)), F.size(letters(b)))
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.8).otherwise(shared)


def text_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.9 of the length ratio if one holds the other, else the best of word overlap and fuzzy long-word overlap."""

    def overlap(wx: Column, wy: Column) -> Column:
        long_ = lambda words: F.filter(words, lambda w: F.length(w) > 3)
        common = F.size(F.filter(wx, lambda w: F.array_contains(wy, w)))

        def best(dice: Column, lx: Column, ly: Column) -> Column:
            like = F.size(F.filter(lx, lambda p: F.exists(ly, lambda q: p.contains(q) | q.contains(p) | (word_similarity(p, q) > 0.7))))
            key = like / F.greatest(F.size(lx), F.size(ly), F.lit(1))
            return bound(lambda k: F.greatest(dice, k * 0.85, dice * 0.6 + k * 0.4), key)

        return bound(best, common * 2 / (F.size(wx) + F.size(wy)), long_(wx), long_(wy))

    def of(x: Column, y: Column) -> Column:
        words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
        shorter, longer = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
        return F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).when(x.contains(y) | y.contains(x), shorter / longer * 0.9).otherwise(bound(overlap, words(x), words(y)))

    return bound(of, F.trim(F.lower(a)), F.trim(F.lower(b)))


# Names of months.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
LONG_MONTHS = "january february march april may june july august september october november december".split()


def _month(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for x in (m, f"{i + 1:02d}")))
    return F.try_element_at(table, F.substring(F.lower(name), 1, 3))


def extract_date(text: Column, as_of_year: int) -> Column:
    """``YYYY-MM-DD`` from ISO, ``25dec18``, ``12/18/25`` or ``Dec 18, 2025`` forms, tried in this order.

    The calendar is not checked; a month without a year is in ``as_of_year``.
    """

    def parts(pattern: str, n: int) -> list[Column]:
        return [F.regexp_extract(text, pattern, k + 1) for k in range(n)]

    def iso(y: Column, m: Column, d: Column) -> Column:
        return F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))

    century = lambda yy: F.concat(F.when(yy.try_cast("int") < 50, "20").otherwise("19"), yy)
    y, m, d = parts(r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", 3)
    first = F.when(y != "", iso(y, m, d))
    y, m, d = parts(r"(?i)\b(\d{2})([a-z]{3})(\d{2})\b", 3)
    second = F.when(y != "", iso(century(y), _month(m), d))
    m, d, y = parts(r"\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b", 3)
    third = F.when(y != "", iso(F.when(F.length(y) == 2, century(y)).otherwise(y), m, d))
    m, d, y = parts(rf"(?i)\b({'|'.join(LONG_MONTHS + MONTHS)})\s+(\d{{1,2}})(?:,?\s+(\d{{4}}))?\b", 3)
    fourth = F.when(m != "", iso(F.when(y != "", y).otherwise(F.lit(str(as_of_year))), _month(m), d))
    return F.coalesce(first, second, third, fourth)
