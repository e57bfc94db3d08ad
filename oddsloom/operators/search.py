"""Many searches in one job: an index from tokens to markets is joined to a table of queries.

What a query finds, and the score, is what ``functions.text.search`` gives for it. A term can only be in a text if its
longest run of letters and digits is in one of the text's runs. So terms meet the different runs of all texts, not the
texts; the markets that have such a run are candidates, and each is verified against its text once for each term,
however many queries ask for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions.expressions import lookup, once
from oddsloom.functions.numbers import parse_volume
from oddsloom.functions.text import API_CATEGORIES, SEARCH_STOP_WORDS, SYNONYMS, keyword_category, query_terms_of

RUN = "[a-z0-9]+"
#: Parts of the markets that one word, category or token meets in: what a task holds of a common one.
PARTS = 32


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"[^a-z0-9\s]", "")


def _longest_run(text: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda r: F.struct((-F.length(r)).alias("n"), r.alias("run")))
    return F.get(F.array_sort(runs), F.lit(0)).run


def _met(markets: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Rows of markets (with ``id``) and of what is asked with an equal ``key``.

    Few words, categories and tokens are in most markets. So markets are dealt into ``PARTS`` by their identifiers, and
    what is asked, which has no market in it, goes to each part.
    """
    each = asked.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return markets.withColumn("__part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).join(each, [key, "__part"]).drop("__part")


def parsed_queries(queries: DataFrame) -> DataFrame:
    """``qid, q, originals, synonyms, asked`` of queries (``qid, query``) that have a letter or digit.

    ``originals`` are the terms, or the whole query where all of its words are left out; ``asked`` is the category whose
    keyword the query has, else ``Other``.
    """
    q = once(queries.select("qid", F.trim(F.lower("query")).alias("q")).filter(F.col("q").rlike("[a-z0-9]")), terms=F.array_distinct(query_terms_of(F.col("q"), SEARCH_STOP_WORDS)))
    wider = F.flatten(F.transform("terms", lambda t: F.coalesce(F.try_element_at(lookup(SYNONYMS), t), F.array().cast("array<string>"))))
    wider = F.filter(F.array_distinct(F.transform(wider, _plain)), lambda s: ~F.array_contains("terms", s))
    originals = F.when(F.size("terms") > 0, F.col("terms")).otherwise(F.array(_plain(F.col("q"))))
    return q.select("qid", "q", originals.alias("originals"), wider.alias("synonyms"), keyword_category(F.concat("q", F.lit(" ")), API_CATEGORIES, "Other").alias("asked"))


def _held(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, word`` for each wanted ``word`` (with ``run`` and ``whole``, whether the run must stand alone) whose run is in a run of the market's text."""
    vocabulary = postings.select("token").distinct()
    inside = wanted.filter("NOT whole")
    # The parts of a token that are as long as some wanted run.
    sizes = inside.agg(F.collect_set(F.length("run")).alias("sizes")).scalar()
    parts = vocabulary.withColumn("sizes", F.coalesce(sizes, F.array().cast("array<int>"))).select("token", F.explode("sizes").alias("size")).filter(F.length("token") >= F.col("size"))
    parts = parts.select("token", F.explode(F.sequence(F.lit(1), F.length("token") - F.col("size") + 1)).alias("at"), "size")
    parts = parts.select("token", F.expr("substring(token, at, size)").alias("run")).distinct()
    by_part = parts.join(inside.select("run", "word"), "run").select("token", "word")
    by_token = vocabulary.join(wanted.filter("whole").select(F.col("run").alias("token"), "word"), "token").select("token", "word")
    return _met(postings, by_part.unionByName(by_token).distinct(), "token").select("id", "word").distinct()


def search_many(markets: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, id, score`` of all markets that each query finds.

    ``markets`` has ``id`` (unique), ``title``, ``outcomes`` (array of names) and ``volume_text``; ``queries`` has ``qid``
    (unique) and ``query``. Queries without a letter or digit find nothing.
    """
    text = F.concat_ws(" ", F.lower(F.coalesce("title", F.lit(""))), F.lower(F.array_join("outcomes", " ")))
    docs = once(markets.select("id", "title", "volume_text", text.alias("text")), category=keyword_category(F.col("text"), API_CATEGORIES, "Other"))
    asked = parsed_queries(queries)
    terms = asked.select("qid", F.explode(F.concat(F.transform("originals", lambda t: F.struct(t.alias("term"), F.lit(True).alias("own"))), F.transform("synonyms", lambda t: F.struct(t.alias("term"), F.lit(False).alias("own"))))).alias("t"), F.size("originals").alias("terms")).select("qid", "terms", "t.term", "t.own")
    postings = docs.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)))).alias("token"))

    words = terms.select(F.col("term").alias("word")).distinct().select("word", _longest_run(F.col("word")).alias("run"))
    words = words.filter("run IS NOT NULL").withColumn("whole", (F.length("word") <= 3) & (F.col("word") == F.col("run")))
    met = _held(postings, words).join(docs.select("id", "text"), "id")
    alone = F.array_contains(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{Nd}_]+"), F.lit(0)), F.col("word"))
    whole = F.when(F.col("word").rlike(f"^{RUN}$"), alone).otherwise(F.expr(r"text RLIKE concat('\\b', word, '\\b')"))
    hits = met.withColumn("whole", whole).filter(F.col("whole") | ((F.length("word") > 3) & F.contains("text", "word")))
    none = {c: F.lit(0) for c in ("n", "w", "s", "o")} | {c: F.lit(False) for c in ("of_asked", "exact")}
    found = lambda df, **has: df.select("qid", "id", "terms", *((has.get(c, v)).alias(c) for c, v in none.items()))
    by_term = _met(hits.select("id", F.col("word").alias("term"), "whole"), terms, "term")
    by_term = found(by_term, n=F.lit(1), w=F.col("whole").cast("int"), s=(~F.col("own")).cast("int"), o=F.col("own").cast("int"))

    of_category = asked.filter("asked != 'Other'").select("qid", F.size("originals").alias("terms"), F.col("asked").alias("category"))
    by_category = found(_met(docs.select("id", "category"), of_category, "category"), of_asked=F.lit(True))

    phrases = asked.select(F.col("q").alias("word")).distinct().select("word", _longest_run(F.col("word")).alias("run"), F.lit(False).alias("whole"))
    exact = _held(postings, phrases).join(docs.select("id", "title"), "id").filter(F.contains(F.lower("title"), "word"))
    exact = found(_met(exact.select("id", F.col("word").alias("q")), asked.select("qid", F.size("originals").alias("terms"), "q"), "q"), exact=F.lit(True))

    # By market, as the next join is, and by a fixed number: partitions of few bytes are not put together, and what a task adds up stays small.
    tasks = int(markets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = by_term.unionByName(by_category).unionByName(exact).repartition(tasks, "id").groupBy("qid", "id").agg(F.max("terms").alias("terms"), *(F.sum(c).alias(c) for c in ("n", "w", "s", "o")), F.bool_or("of_asked").alias("of_asked"), F.bool_or("exact").alias("exact"))
    n, w, s, every = F.col("n"), F.col("w"), F.col("s"), F.col("o") == F.col("terms")
    ladder = (
        F.when(F.col("of_asked"), 100 + F.when(every, 100).otherwise(n * 20) + s * 10)
        .when(every, 150 + w * 20 + s * 10)
        .when(n >= F.ceil(F.col("terms") * 0.7), n * 15 + s * 5)
        .when((F.col("terms") == 1) & (n > 0), 50 + s * 5)
    )
    rows = rows.select("qid", "id", ladder.alias("ladder"), "exact").filter("ladder IS NOT NULL OR exact").join(docs.select("id", "volume_text"), "id")
    score = F.coalesce("ladder", F.lit(0)) + F.when(F.col("exact"), 200).otherwise(0) + F.least(parse_volume(F.col("volume_text")) / 10000, F.lit(5.0))
    return rows.select("qid", "id", score.alias("score"))
