"""Matching markets across venues. Every join has an equi key; what the feeds give no key for is blocked first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.functions import questions
from oddsloom.functions.text import text_similarity
from oddsloom.operators.similarity import cosine_counts, cosine_pairs, cosine_top, similarity_histogram, similarity_stats  # noqa: F401  (also found here)

#: Rows of one key that meet others in one task; keys with more are dealt into blocks.
BLOCK = 512
# Words of titles of political races.
PRESIDENT, PRIMARY, GENERAL = "presidential|president", "primary|nomination", "which party|party will win|general election"


def dealt_join(a: DataFrame, b: DataFrame, keys: list[str], a_id: str, b_id: str, merged: bool = False) -> DataFrame:
    """Rows of ``a`` and ``b`` with equal keys, each two once; keys are not null and other columns have names of their own.

    The rows of a key are dealt by the hash of their identifiers into blocks of about ``BLOCK``, and the join is on key,
    block of ``a`` and block of ``b``: rows of a large key are repeated for each block of the other side, and its pairs
    are spread over all tasks. Sizes are joined for keys of more than one block only. With ``merged``, rows come in order
    of their keys, so that what is aggregated by them need not be sorted.
    """
    count = lambda rows, n, m: rows.groupBy(*keys).agg(F.count("*").alias(n)).withColumn(m, F.lit(0).cast("long"))
    sizes = count(a, "__m", "__n").unionByName(count(b, "__n", "__m")).groupBy(*keys).agg(F.sum("__m").alias("__m"), F.sum("__n").alias("__n"))
    sizes = sizes.filter(F.greatest("__m", "__n") > BLOCK).select(*keys, *(F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).alias(c) for c in ("__m", "__n")))

    def dealt(rows: DataFrame, by: str, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        rows = rows.join(sizes, keys, "left")
        rows = rows.withColumn(own[1], F.pmod(F.xxhash64(by), F.coalesce(own[0], F.lit(1))))
        return rows.withColumn(other[1], F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other[0], F.lit(1)) - 1))).drop("__m", "__n")

    left = dealt(a, a_id, ("__m", "__row"), ("__n", "__column"))
    right = dealt(b, b_id, ("__n", "__column"), ("__m", "__row"))
    return left.join(right.hint("merge") if merged else right, [*keys, "__row", "__column"]).drop("__row", "__column")


def by_titles(markets: DataFrame, **work: Column) -> DataFrame:
    """``markets`` and columns that are worked out of their ``title``, once a title; those without one are left out.

    Titles are dealt to a fixed number of tasks before: a table of markets is a few bytes, which one task reads, and what
    is worked out of a title costs far more than to read it. It comes as a row of a list, as filters on it would
    otherwise be worked out by the tasks that read, for each market.
    """
    tasks = int(markets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    titles = markets.select("title").filter("title IS NOT NULL").repartition(tasks, "title").distinct()
    said = F.inline(F.array(F.struct(*(c.alias(k) for k, c in work.items()))))
    return markets.join(titles.select("title", said), "title")


def classed(markets: DataFrame, *of: str, **more: Column) -> DataFrame:
    """``ord, id, platform`` of markets and ``cls``, what decides on their pairs; markets equal in it are one class."""
    return markets.select("ord", "id", "platform", F.struct(*of, *(c.alias(k) for k, c in more.items())).alias("cls"))


def class_sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of ``classed`` rows with their columns, and the same for the second side, with the prefix ``b_``."""
    each = rows.select("cls").distinct().select("cls", "cls.*")
    return each, each.withColumnsRenamed({c: f"b_{c}" for c in each.columns})


def met_lists(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lists of ``ord, id`` of members of two classes and different platforms, ``__rows`` and ``b___rows``, that hold a pair in its order, and the columns of ``pairs``.

    The members of a class and platform are cut by rank into lists of ``BLOCK``, so that of two lists nearly always all
    pairs are in order or none is, and those of none do not meet. Ranks come from one sort of a class and platform that
    may spill; a task holds only lists.
    """
    key = ["cls", "platform", "__block"]
    rows = rows.filter("ord IS NOT NULL AND platform IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("cls", "platform").orderBy("ord", "id"))
    ranked = rows.withColumn("__block", F.floor((rank - 1) / BLOCK))
    lists = ranked.groupBy(*key).agg(F.collect_list(F.struct("ord", "id")).alias("__rows"))
    # Read from the lists, so that both have one shuffle of the rows.
    places = lists.select(*key, F.array_min("__rows").ord.alias("__lo"), F.array_max("__rows").ord.alias("__hi"))
    second = lambda df: df.withColumnsRenamed({c: f"b_{c}" for c in df.columns})
    met = pairs.join(places, "cls").join(second(places), "b_cls").filter("platform <> b_platform AND __lo < b___hi")
    met = met.drop("__lo", "__hi", "b___lo", "b___hi").join(lists, key)
    # By a fixed number, as the few bytes of two lists are many pairs.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    b_key = [f"b_{c}" for c in key]
    return met.repartition(tasks, *b_key).join(second(lists), b_key)


def members(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, b_id`` and the columns of ``pairs`` for members of two classes, of different platforms and in their order.

    ``rows``: ``ord, id, platform, cls``; ``pairs``: ``cls, b_cls``, in both orders and each once, and columns of their own.
    What decides on a pair is worked out for two classes, not for two markets, and only numbers of blocks meet: two lists
    become pairs in the task that gets them. So what is moved grows with the pairs over ``BLOCK``, and the pairs of a
    large class are spread over all tasks.
    """
    own = [c for c in pairs.columns if c not in ("cls", "b_cls")]
    # A row with a list, then its pairs: by a lambda, so that code of one loop does not hold all pairs of two lists at once.
    first = F.explode(F.transform("__rows", lambda r: F.struct(r.alias("x"), F.lit(True).alias("met")))).alias("x")
    each = met_lists(rows, pairs).select(*own, "b___rows", first).select(*own, "x.x", F.explode("b___rows").alias("y"))
    return each.filter("x.ord < y.ord").select(F.col("x.id").alias("id"), F.col("y.id").alias("b_id"), *own)


def political_score(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Confidence that two political titles are one race. ``a`` and ``b``: ``title, state, office, year``.

    50 for the same state (30 if neither has one and both are presidential), office 30, 25 or 10, year 15, type 5;
    0 where state, office or year differ or one is a primary and the other a general election.
    """
    low = lambda c: F.lower(F.trim(c))
    like = lambda c, p: c.rlike(f"(?i){p}")
    president, primary, general = PRESIDENT, PRIMARY, GENERAL
    both_none = a["state"].isNull() & b["state"].isNull()
    state = F.when(low(a["state"]) == low(b["state"]), 50).when(both_none & like(a["title"], president) & like(b["title"], president), 30)
    x, y = low(a["office"]), low(b["office"])
    house = (x.contains("house") & y.contains("representative")) | (y.contains("house") & x.contains("representative"))
    office = F.when(x.isNull() | y.isNull(), 10).when(x == y, 30).when(house, 25)
    year = F.when(a["year"].isNull() | b["year"].isNull(), 0).when(a["year"] == b["year"], 15)
    crossed = (like(a["title"], primary) & like(b["title"], general)) | (like(b["title"], primary) & like(a["title"], general))
    kind = F.when(crossed, None).when(like(a["title"], primary) == like(b["title"], primary), 5).otherwise(0)
    return F.coalesce(state + office + year + kind, F.lit(0))


def entity_pairs(markets: DataFrame, least: int = 70) -> DataFrame:
    """Pairs of political markets of different platforms with a score of ``least`` or more: ``id, b_id, score``.

    ``markets`` has ``ord, id, platform, title, state, office, year``. A score needs equal states (or none, and both
    presidential), and offices and years that are equal or missing. So races meet by state and by those of office and
    year that both have: each goes out once for every choice of the two that the other may have.
    """
    low = lambda c: F.lower(F.trim(c))
    office = F.when(low("office").rlike("house|representative"), "house").otherwise(low("office"))
    has = F.when(F.col("office").isNull(), 0).otherwise(1) + F.when(F.col("year").isNull(), 0).otherwise(2)
    # Of a title only the words that a score looks for count.
    words = {"president": PRESIDENT, "primary": PRIMARY, "general election": GENERAL}
    said = F.concat_ws("|", *(F.when(F.col("title").rlike(f"(?i){p}"), w) for w, p in words.items()))
    rows = classed(markets.filter(F.col("state").isNotNull() | F.col("title").rlike(f"(?i){PRESIDENT}")), "state", "office", "year", title=said)
    races, others = class_sides(rows)

    def keyed(side: DataFrame, own: str, other: str, p: str = "") -> DataFrame:
        side = side.withColumns({"state": F.col(f"{p}state"), "office": F.col(f"{p}office"), "year": F.col(f"{p}year")}) if p else side
        side = side.select(*(c for c in side.columns if not p or c.startswith(p)), has.alias(own), F.explode(F.array(*map(F.lit, range(4)))).alias(other), F.coalesce(low("state"), F.lit("")).alias("__state"), office.alias("__office"), F.col(f"{p}year").alias("__year"))
        both = F.col(own).bitwiseAND(F.col(other))
        return side.withColumn("__office", F.when(both.bitwiseAND(1) > 0, F.col("__office")).otherwise("")).withColumn("__year", F.when(both.bitwiseAND(2) > 0, F.col("__year")).otherwise(""))

    pairs = dealt_join(keyed(races, "__a", "__b"), keyed(others, "__b", "__a", "b_"), ["__state", "__office", "__year", "__a", "__b"], "cls", "b_cls")
    side = lambda p: {c: F.col(p + c) for c in ("title", "state", "office", "year")}
    pairs = pairs.select("cls", "b_cls", political_score(side(""), side("b_")).alias("score")).filter(F.col("score") >= least)
    return members(rows, pairs)


def team_set_pairs(markets: DataFrame) -> DataFrame:
    """Pairs of markets of different platforms about the same two teams, in any order. ``markets``: ``ord, id, platform, teams``."""
    rows = classed(markets.filter(F.size(F.array_distinct("teams")) == 2), pair=F.array_join(F.array_sort("teams"), "|"))
    games, _ = class_sides(rows.filter("cls.pair IS NOT NULL"))
    pairs = games.select("cls", F.col("cls").alias("b_cls"), "pair", F.lit(100).alias("confidence"))
    return members(rows, pairs)


def similar_pairs(items: DataFrame, block: str, text: str, least: float) -> DataFrame:
    """Pairs within a block whose texts are similar by ``least`` or more. ``items``: ``ord``, the block and the text."""
    b = items.select(block, F.col("ord").alias("b_ord"), F.col(text).alias("b_text"))
    pairs = dealt_join(items, b, [block], "ord", "b_ord").filter(F.col("ord") < F.col("b_ord"))
    return pairs.withColumn("similarity", text_similarity(F.col(text), F.col("b_text"))).filter(F.col("similarity") >= least)


def band_pairs(a: DataFrame, b: DataFrame, key: str, day: str, days: int = 1) -> DataFrame:
    """Rows of ``a`` and ``b`` with the same key and dates at most ``days`` apart; undated rows meet undated rows.

    Columns of ``b`` get the prefix ``b_``. The rows of a key and day are dealt into lists of about ``BLOCK``, and lists
    meet, by key, day and block of ``b``: those of ``a`` are repeated for each day of the band and block, and two lists
    become pairs in the task that gets them. So what is moved grows with the pairs over ``BLOCK``, and the pairs of a
    large key are spread over all tasks.
    """
    at = ["__key", "__dated", "__day"]

    def lists(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        held = F.struct(*(c for c in rows.columns if c not in (key, day)))
        rows = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(day).isNotNull().alias("__dated"), F.coalesce(day, F.lit("1970-01-01").cast("date")).alias("__day"), F.xxhash64(*rows.columns).alias("__h"), held.alias("__row"))
        sizes = rows.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).alias("__blocks"))
        dealt = rows.join(sizes.filter("__blocks > 1"), at, "left").withColumn("__block", F.pmod("__h", F.coalesce("__blocks", F.lit(1))))
        return dealt.groupBy(*at, "__block").agg(F.collect_list("__row").alias(name)), sizes

    (left, _), (right, sizes) = lists(a, "__rows"), lists(b, "__b_rows")
    near = F.when(F.col("__dated"), F.transform(F.sequence(F.lit(-days), F.lit(days)), lambda k: F.date_add(F.col("__own"), k))).otherwise(F.array("__own"))
    left = left.drop("__block").withColumnRenamed("__day", "__own").withColumn("__day", F.explode(near))
    met = left.join(sizes, at).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1))).drop("__blocks")
    # By a fixed number, as the few bytes of two lists are many pairs.
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(tasks, *at, "__block").join(right, [*at, "__block"])
    # A row of ``a`` with a list, then its pairs: by a lambda, so that code of one loop does not hold all pairs of two lists at once.
    first = F.explode(F.transform("__rows", lambda r: F.struct(r.alias("x"), F.lit(True).alias("met")))).alias("x")
    each = met.select(*at, "__own", "__b_rows", first).select(*at, "__own", "x.x", F.explode("__b_rows").alias("y"))
    dated = lambda c: F.when(F.col("__dated"), F.col(c))
    of = lambda c, row, own: F.col("__key") if c == key else dated(own) if c == day else F.col(f"{row}.{c}")
    return each.select(*(of(c, "x", "__own").alias(c) for c in a.columns), *(of(c, "y", "__day").alias(f"b_{c}") for c in b.columns))


def greedy_groups(markets: DataFrame) -> DataFrame:
    """Groups of one team pair in order of arrival: a market joins the group of its own date, else of the day before, else after.

    ``markets``: ``ord, id, signature, day`` (null if undated). Adds ``group_day``, the first date of the group. A day
    opens a group only with its first market, so the days of a pair with their first ``ord`` are all that has to be
    walked in order; then each market takes the first group that was open when it came.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        opened: set = set()
        one = pd.Timedelta(days=1).to_pytimedelta()
        for d in pdf["day"]:
            if opened.isdisjoint((d - one, d + one)):
                opened.add(d)
        return pdf[pdf["day"].isin(list(opened))]

    rows = markets.select("ord", "id", "signature", "day")
    first = rows.filter("day IS NOT NULL AND signature IS NOT NULL").groupBy("signature", "day").agg(F.min("ord").alias("ord"))
    opened = first.groupBy("signature").applyInPandas(walk, "signature string, day date, ord long")
    seen = F.explode(F.array(*(F.struct(F.lit(rank).alias("rank"), F.date_add("day", shift).alias("day")) for rank, shift in enumerate((0, 1, -1)))))
    seen = opened.select("signature", "ord", F.col("day").alias("group_day"), seen.alias("s"))
    homes = seen.groupBy("signature", F.col("s.day").alias("day")).agg(F.array_sort(F.collect_list(F.struct("s.rank", "ord", "group_day"))).alias("homes"))
    home = F.get(F.filter("homes", lambda x: x.ord <= F.col("ord")), F.lit(0)).group_day
    return rows.join(homes, ["signature", "day"], "left").select("ord", "id", "signature", "day", home.alias("group_day"))


def slug_hits(events: DataFrame, slugs: DataFrame) -> DataFrame:
    """First slug that exists for a one-sided event: both team orders, its date, the day before, the day after.

    ``events``: ``id, sport, team_a, team_b, day``; ``slugs``: ``slug, slug_id``. Neighbouring days stay in the month:
    there is no day before the 1st and none after the 27th. Later rows win among equal slugs.
    """
    day, shift = F.dayofmonth("day"), lambda k: F.date_format(F.date_add("day", k), "yyyy-MM-dd")
    dates = F.array_compact(F.array(shift(0), F.when(day > 1, shift(-1)), F.when(day < 28, shift(1))))
    named = lambda x, y: F.transform(dates, lambda d: F.concat_ws("-", "sport", x, y, d))
    tried = events.select("id", F.posexplode(F.concat(named("team_a", "team_b"), named("team_b", "team_a"))).alias("priority", "slug"))
    known = slugs.groupBy("slug").agg(F.max("slug_id").alias("slug_id"))
    found = tried.join(known, "slug")
    return found.groupBy("id").agg(F.min(F.struct("priority", "slug", "slug_id")).alias("x")).select("id", "x.*")


def question_pairs(markets: DataFrame) -> DataFrame:
    """Pairs of markets of different platforms that ask the same: ``id, b_id, signature, subject``.

    They have one signature and subject, and times and outcomes that agree. ``markets``: ``ord, id, platform, title,
    signature, subject, outcome, timeframe``; titles without a signature are left out. A question with a year meets
    those of its year and the years beside it, and those without one: it goes out for each, so that all meet by equal
    keys, and times of years far apart never do.
    """
    known = markets.filter("signature != 'unknown' AND subject IS NOT NULL")
    rows = classed(known, "signature", "subject", "outcome", said=questions.directions(F.col("title")), year=questions.year_of(F.col("timeframe")))
    asked, others = class_sides(rows)
    dated, undated = F.lit(-1), F.lit(-2)
    # Where a question stands: at its year, and with all that have one; those without stand together. And where it looks.
    stands = F.when(F.col("b_year").isNull(), F.array(undated)).otherwise(F.array(F.col("b_year"), dated))
    year = F.col("year")
    looks = F.when(year.isNull(), F.array(undated, dated)).otherwise(F.array(year - 1, year, year + 1, undated))
    right = others.withColumn("__key", F.explode(stands)).withColumnsRenamed({"b_signature": "signature", "b_subject": "subject"})
    pairs = dealt_join(asked.withColumn("__key", F.explode(looks)), right, ["signature", "subject", "__key"], "cls", "b_cls")
    pairs = pairs.filter(questions.same_outcome(F.col("said"), F.col("b_said"), F.col("outcome"), F.col("b_outcome")))
    return members(rows, pairs.select("cls", "b_cls", "signature", "subject"))
