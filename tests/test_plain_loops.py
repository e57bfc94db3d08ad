"""Queries without SQL against plain loops over the same rows."""

import datetime
import itertools
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from oddsloom.functions import display, rules, teams, text
from oddsloom.operators import matching, sports
from oddsloom.plans import queries, registry, rule_queries, venue_queries  # noqa: F401
from oddsloom.plans import relations as rel

SF = "/root/testdata/sf0.001"


def has(word, t):
    return re.search(rf"\b{re.escape(word)}\b", t, re.I | re.A)


def teams_in(t):
    if re.search(teams.NO_SPORT, t) and not re.search(teams.SPORT, t):
        return []
    found = list(dict.fromkeys(teams.NICKNAMES[n] for n in sorted(teams.NICKNAMES, key=lambda n: -len(n)) if has(n, t)))
    for city, team in teams.CITIES.items():
        if not has(city, t) or set(found) & set(teams.SHARED_CITIES.get(city, [])):
            continue
        if city in ("minnesota", "min"):
            if set(found) & set(teams.MINNESOTA):
                continue
            team = "timberwolves"
            if not set(found) & set(teams.SPORTS["nba"]):
                team = "vikings" if set(found) & set(teams.VIKINGS_RIVALS) else "wild" if set(found) & set(teams.WILD_RIVALS) else team
        if team not in found:
            found.append(team)
    return found


def team_of(outcome, title, event, name):
    if name:
        own = name.lower().strip()
        return teams.CITIES.get(own, own)
    if named := teams_in(outcome):
        return named[0]
    if outcome.lower() != "yes":
        return None
    asked = teams_in(title)
    if len(asked) == 2:
        return min(asked, key=title.lower().find)
    if len(asked) != 1 or not event or len(event) != 2:
        return None
    q, one = asked[0], [t.lower().strip() for t in event]
    near = lambda a, b: a in b or b in a
    first = {}
    for c, t in teams.CITIES.items():
        first.setdefault(t, c)
    home = [t for t in one if any(near(t, x) for x in teams.HOMES.get(q, []))]
    same = home or [t for t in one if near(t, q) or teams.CITIES.get(q) == t or first.get(t) == q]
    for t, raw in zip(one, event):
        if (t != same[0]) if same else not near(t, q):
            return raw
    return None


def phrases(n):
    rng = random.Random(4)
    names = [*teams.NICKNAMES, *teams.CITIES, "vs", "at", "Min", "MIN", "minimum", "climate", "game", "Yes", "x", "la-sea", "(texas a&m)", "The", "Winner?", "é"]
    return [" ".join(rng.choices(names, k=rng.choice([1, 2, 3, 6]))) for _ in range(n)]


def test_teams(spark):
    batch = phrases(3000)
    df = spark.createDataFrame(list(enumerate(batch)), "k int, t string")
    got = [r.x for r in df.select("k", teams.teams_from_text(F.col("t")).alias("x")).orderBy("k").collect()]
    assert got == [teams_in(t) for t in batch]


def test_outcome_teams(spark):
    rng, batch = random.Random(8), phrases(3000)
    names = [*teams.NICKNAMES.values(), *teams.CITIES, "Lakers ", "washington", "miami"]
    rows = [(k, rng.choice(["Yes", "yes", "No", "Maybe", rng.choice(batch)]), rng.choice([t, rng.choice(names)]), rng.choices(names, k=rng.choice([1, 2, 2, 2, 2, 3])), rng.choice([None, None, None, "", "Milwaukee", "Texas A&M"])) for k, t in enumerate(batch)]
    df = spark.createDataFrame(rows, "k int, o string, t string, e array<string>, n string")
    got = [r.x for r in df.select("k", teams.outcome_team(*map(F.col, "oten")).alias("x")).orderBy("k").collect()]
    want = [team_of(o, t, e, n) for _, o, t, e, n in rows]
    assert got == want and sum(x is not None for x in want) > 500


def test_team_queries(spark):
    m = rel.relation(spark, SF, rel.MARKET).select("id", "k", "title").collect()
    got = {r.id: r.teams for r in registry.QUERIES["teams_from_text"](spark, SF).collect()}
    assert got == {r.id: "|".join(teams_in(r.title)) for r in m}
    got = {r.id: (r.yes_team, r.no_team, r.nfl_game) for r in registry.QUERIES["outcome_team"](spark, SF).collect()}
    for r in m:
        of = teams_in(r.title)
        name = ["Minnesota", "Milwaukee", "Rams"][r.k % 3] if r.id % 4 == 0 else None
        assert got[r.id] == (team_of("Yes", r.title, of, name), team_of("No", r.title, of, name), len(of) == 2 and set(of) <= set(teams.SPORTS["nfl"]))


def walk(rows):
    """``ord -> group day`` of rows ``ord, signature, day`` in order."""
    opened, out, one = defaultdict(set), {}, datetime.timedelta(days=1)
    for ord_, signature, day in sorted(rows):
        home = None
        if day is not None:
            home = next((d for d in (day, day - one, day + one) if d in opened[signature]), None)
            if home is None:
                home = day
                opened[signature].add(day)
        out[ord_] = home
    return out


def test_greedy_groups(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a-b", "c-d"]), rng.choice([None, datetime.date(2024, 1, rng.randint(1, 25))])) for k in range(600)]
    df = spark.createDataFrame([(k, k, s, d) for k, s, d in rows], "ord long, id long, signature string, day date").repartition(5)
    got = {r.ord: r.group_day for r in matching.greedy_groups(df).collect()}
    assert got == walk(rows)
    g = rel.relation(spark, SF, rel.GAME).collect()
    want = walk([(r.ord, r.signature, r.day) for r in g])
    got = {r.id: r.group_day for r in registry.QUERIES["event_signature_groups"](spark, SF).collect()}
    assert got == {k: None if d is None else str(d) for k, d in want.items()}


def test_event_signatures(spark):
    m = {r.id: r.title for r in rel.relation(spark, SF, rel.MARKET).collect()}
    sign = lambda t: "-".join([*sorted(teams_in(t)), "2025-03-02"]) if len(teams_in(t)) == 2 else None
    got = registry.QUERIES["event_signatures"](spark, SF).collect()
    assert len(got) == len([k for k in m if k + 9 in m])
    for r in got:
        a, b = m[r.id], m[r.id + 9]
        assert r.signature == sign(a) and r.same_event == (sign(a) is not None and sign(a) == sign(b))
        x, y = team_of("Yes", a, teams_in(a), None), team_of("No", b, teams_in(a), None)
        x, y = (x, y) if x and y else (None, "saints")
        assert r.opposing == (r.same_event and x is not None and x != y and {x, y} <= set(teams_in(a)))


def test_same_event_pairs(spark):
    LARGER = "/root/testdata/sf0.01"  # in fewer markets no game comes twice
    m = sorted((r.ord, r.id, r.platform, r.title) for r in rel.relation(spark, LARGER, rel.MARKET).collect())
    groups = defaultdict(list)
    for ord_, id_, platform, title in m:
        if len(teams_in(title)) == 2:
            groups["-".join([*sorted(teams_in(title)), "2025-03-02"])].append((id_, platform, title))
    want = {}
    for sign, rows in groups.items():
        for i, (a, p, t) in enumerate(rows):
            for b, q, u in rows[i + 1 :]:
                if p != q:
                    x, y = team_of("Yes", t, teams_in(t), None), team_of("No", u, teams_in(t), None)
                    x, y = (x, y) if x and y else (None, "saints")
                    want[a, b] = (sign, x is not None and x != y and {x, y} <= set(teams_in(t)))
    got = {(r.id, r.b_id): (r.signature, r.opposing) for r in registry.QUERIES["same_event_pairs"](spark, LARGER).collect()}
    assert got == want and any(v[1] for v in want.values()) and len(want) > 500


def test_sports_opportunities(spark):
    games = [r.asDict(True) for r in rule_queries.games(spark, SF).collect()]
    kept = []
    for g in games:
        pair = teams_in(g["title"])
        ticker = "KXNFLGAME" in g["id"].upper() or "/event/nfl-" in (g["link"] or "")
        if ticker and len(pair) == 2:
            day = g["date"] and datetime.date.fromisoformat(g["date"])
            if g["id"].startswith("kalshi:"):
                day = day  # identifiers hold no date
            kept.append({**g, "teams": pair, "signature": "-".join(sorted(pair)), "day": day})
    home = walk([(g["ord"], g["signature"], g["day"]) for g in kept])
    groups = defaultdict(lambda: {"Kalshi": [], "Polymarket": []})
    for g in sorted(kept, key=lambda g: g["ord"]):
        if "rebounds" not in g["title"]:
            groups[g["signature"], home[g["ord"]]][g["platform"]].append(g)
    best = {}
    for (signature, _), both in groups.items():
        for k, p in itertools.product(both["Kalshi"], both["Polymarket"]):
            for (i, x), (j, y) in itertools.product(enumerate(k["outcomes"]), enumerate(p["outcomes"])):
                tx, ty = team_of(x["name"], k["title"], sorted(k["teams"]), None), team_of(y["name"], p["title"], sorted(p["teams"]), None)
                if tx and ty and tx == ty:
                    continue
                a, b = x["price"], y["price"]
                net = 1000 / (a + b) - 1000 - 1000 * a / (a + b) * 0.02
                if net > 0 and net / 10 >= 0.5:
                    spread = (b - a) / min(a, b) * 100
                    row = (-spread, k["ord"], p["ord"], i, j)
                    best.setdefault(signature, []).append((row, net / 10, spread, a <= b))
    got = registry.QUERIES["sports_opportunities"](spark, SF).collect()
    assert len(got) == len(best) > 5
    for r in got:
        row, roi, spread, cheap = min(best[r.signature])
        assert (r.sport, r.k_ord, r.p_ord, r.k_place, r.p_place) == ("nfl", *row[1:])
        assert (r.roi, r.max_spread) == (pytest.approx(roi, abs=2e-6), pytest.approx(spread, abs=2e-6))
        assert (r.buy_platform, r.total_volume, r.avg_liquidity) == ("Kalshi" if cheap else "Polymarket", 4000, 1500)


def similar_words(a, b):
    return 1.0 if a == b else 0.8 if a in b or b in a else len(set(a) & set(b)) / max(len(set(a)), len(set(b)))


def similar(a, b):
    a, b = a.lower().strip(), b.lower().strip()
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if a in b or b in a:
        return min(len(a), len(b)) / max(len(a), len(b)) * 0.9
    x, y = a.split(), b.split()
    dice = 2 * sum(w in y for w in x) / (len(x) + len(y))
    long_x, long_y = [w for w in x if len(w) > 3], [w for w in y if len(w) > 3]
    key = sum(any(p in q or q in p or similar_words(p, q) > 0.7 for q in long_y) for p in long_x) / max(len(long_x), len(long_y), 1)
    return max(dice, key * 0.85, dice * 0.6 + key * 0.4)


def test_outcome_match_spread(spark):
    events = defaultdict(lambda: ([], []))
    for r in rel.relation(spark, SF, rel.PRICES).collect():
        name = ["Yes", "No", f"{r.name} wins", f"heater{r.name}"][r.line // 2 % 4]
        events[r.event][1 - r.line % 2].append((r.ord, name.lower(), r.kalshi if r.line % 2 else r.poly))
    want = {}
    for e, (a, b) in events.items():
        pairs = []
        for (k, x, p), (j, y, q) in itertools.product(a, b):
            limit = 0.7 if {x, y} & {"yes", "no"} else 0.75
            if x == y or ("yes" in x and "yes" in y) or ("no" in x and "no" in y) or similar(x, y) > limit:
                pairs.append((-max(0.0, (max(p, q) - min(p, q)) / min(p, q) * 100), k, j, abs(p - q) * 100))
        if pairs:
            want[e] = min(pairs)
    got = registry.QUERIES["outcome_match_spread"](spark, SF).collect()
    assert {r.event for r in got} == set(want)
    for r in got:
        gain, k, j, spread = want[r.event]
        assert (r.k, r.k_b) == (k, j) and [r.spread, r.max_spread] == pytest.approx([spread, -gain], abs=2e-6)


def test_subject_text_pairs(spark):
    """Normal forms and subjects by the library's own expressions, pairs by a loop."""
    rows = rel.relation(spark, SF, rel.MARKET).select("id", "platform", text.normalise_title(F.col("title")).alias("n"), display.main_subject(F.col("title")).alias("s")).orderBy("id").collect()
    want = {(a.id, b.id): similar(a.n, b.n) * 100 for a, b in itertools.combinations(rows, 2) if a.platform != b.platform and a.s == b.s and similar(a.n, b.n) * 100 >= 90}
    got = {(r.id, r.b_id): r.confidence for r in registry.QUERIES["subject_text_pairs"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_subjects(spark):
    golden = {
        "Donald Trump wins": ("trump", "trump"), "ETH above 5k": ("ethereum", "ethereum"), "will Rain come": ("rain", "rain"),
        "Ducks x Bulls": ("ducks", "ducks"), "hi": ("unknown", "unknown"), "will come": ("unknown", "will"), "Bronx Bills at Miami Jets": ("bronx", "bronx"), "Go Duke at Miami Jets": ("go", "go duke_miami"),
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(golden)], "k int, t string")
    got = [tuple(r)[1:] for r in df.select("k", display.subject(F.col("t")), display.main_subject(F.col("t"))).orderBy("k").collect()]
    assert got == list(golden.values())


def test_of_sport(spark):
    rows = [
        (1, "Kalshi", "kalshi:KXNBAGAME-1", "Lakers at Heat", None), (2, "Kalshi", "kalshi:X", "NBA: Lakers at Heat", None), (3, "Kalshi", "kalshi:X", "College basketball: Lakers at Heat", None),
        (4, "Polymarket", "polymarket:1", "x", "https://polymarket.com/event/nba-la-bos-2025-01-02"), (5, "PredictIt", "predictit:1", "NBA: Lakers at Heat", None), (6, "Kalshi", "kalshi:KXNBAGAME-2", "Lakers", "https://x/lakers-heat"),
    ]
    df = spark.createDataFrame(rows, "ord long, platform string, id string, title string, link string")
    games = [(r.sport, r.ord, sorted(r.teams)) for r in sports.of_sports(df).collect()]
    assert {o: t for s, o, t in games if s == "nba"} == {1: ["heat", "lakers"], 2: ["heat", "lakers"], 4: ["bos", "la"], 6: ["heat", "lakers"]}
    assert [o for s, o, _ in games if s == "cbb"] == [3] and {s for s, _, _ in games} == {"nba", "cbb"}
    assert rules.SPORTS == ["nfl", "nba", "nhl", "cbb", "cfb"]
