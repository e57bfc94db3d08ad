"""Queries of the library over the test tables, each with the SQL of an independent oracle where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.functions import numbers, teams, text
from oddsloom.functions.expressions import once
from oddsloom.operators import arbitrage, matching, ranking, search, similarity, snapshots, text_joins
from oddsloom.plans import relations as rel
from oddsloom.plans.registry import query, r6, table
from oddsloom.sources import venues
from oddsloom.streaming import snapshots as streaming

AS_OF = "2024-01-31 00:00:00"
PLATFORMS = ["Polymarket", "Kalshi", "PredictIt"]
PLATFORM_ORD = "CASE platform WHEN 'Polymarket' THEN 0 WHEN 'Kalshi' THEN 1 ELSE 2 END"


# --- ranking and sets -------------------------------------------------------------------------------------------------


@query("SELECT id, platform, volume FROM x ORDER BY volume DESC, id LIMIT 50", rel.MARKET)
def market_volume_topk(m: DataFrame) -> DataFrame:
    return m.orderBy(F.desc("volume"), "id").limit(50).select("id", "platform", "volume")


@query(
    f"""SELECT id, platform, round, row_number() OVER (ORDER BY round, o) AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY platform ORDER BY volume DESC, id) AS round, {PLATFORM_ORD} AS o FROM x) r
    QUALIFY place <= 50""",
    rel.MARKET,
)
def platform_round_robin_mix(m: DataFrame) -> DataFrame:
    return ranking.round_robin(m, "platform", PLATFORMS, 50, F.desc("volume"), "id").select("id", "platform", "round", "place")


@query(
    """SELECT id, platform, round((row_number() OVER (PARTITION BY platform ORDER BY volume DESC, id) - 0.5::DOUBLE)
      / count(*) OVER (PARTITION BY platform), 6) AS share FROM x""",
    rel.MARKET,
)
def platform_proportional_merge(m: DataFrame) -> DataFrame:
    return ranking.proportional_merge(m, "platform", -F.col("volume"), "id").select("id", "platform", r6("share").alias("share"))


@query("SELECT market_id, event_id, price FROM x QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY event_id) = 1", rel.SNAPSHOT)
def dedupe_keep_first(s: DataFrame) -> DataFrame:
    return ranking.dedupe_first(s.select("market_id", "event_id", "price"), "market_id", "event_id")


@query(
    """SELECT market_id, event_id, price, min(event_id) OVER (PARTITION BY market_id) AS first_ord FROM x
    QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY event_id DESC) = 1""",
    rel.SNAPSHOT,
)
def dedupe_keep_last(s: DataFrame) -> DataFrame:
    return ranking.dedupe_last(s.select("market_id", "event_id", "price"), "market_id", "event_id")


@query("SELECT platform, count(*) AS n, count(DISTINCT p_name) AS names FROM x GROUP BY platform", rel.MARKET)
def market_counts_by_platform(m: DataFrame) -> DataFrame:
    return m.groupBy("platform").agg(F.count("*").alias("n"), F.count_distinct("p_name").alias("names"))


@query(
    """SELECT id, CASE WHEN volume >= 10000 THEN 'high' WHEN volume >= 1000 THEN 'medium' WHEN volume > 0 THEN 'low' END AS bucket
    FROM x WHERE platform IN ('Kalshi', 'PredictIt')""",
    rel.MARKET,
)
def volume_bucket_filter(m: DataFrame) -> DataFrame:
    return m.filter(F.col("platform").isin("Kalshi", "PredictIt")).select("id", ranking.volume_bucket(F.col("volume")).alias("bucket"))


@query(
    """, s AS (SELECT id, volume, 5 AS score FROM x WHERE title LIKE '%Bitcoin%' AND p_name < 'd')
    SELECT id, volume, score, tail FROM (
      SELECT id, volume, score, 0 AS tail FROM s UNION ALL SELECT id, volume, 0, 1 FROM x WHERE id NOT IN (SELECT id FROM s)) u
    ORDER BY tail, score DESC, volume DESC, id LIMIT 40""",
    rel.MARKET,
)
def filler_anti_join(m: DataFrame) -> DataFrame:
    scored = m.filter(F.col("title").contains("Bitcoin") & (F.col("p_name") < "d")).select("id", "volume", F.lit(5).alias("score"))
    return ranking.with_fillers(scored, m, 40)


@query(
    """SELECT c_custkey AS ticker, rank, o_orderkey AS event FROM (
      SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) c
    JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey WHERE rank <= 120"""
)
def ranked_lookup_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), F.struct((-F.col("c_acctbal")).alias("a"), "c_custkey").alias("place"))
    events = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("ord"))
    return venues.in_listed_order(events, listed, "ticker").select("ticker", "rank", F.col("ord").alias("event"))


@query(
    """SELECT s_suppkey, coalesce(CASE WHEN s_acctbal > 5000 THEN s_name END, CASE WHEN n_nationkey % 3 = 0 THEN n_name END, r_name, 'none') AS title
    FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 2"""
)
def lookup_enrich_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r.filter("r_regionkey <> 2"), n.n_regionkey == r.r_regionkey, "left")
    title = F.coalesce(F.when(F.col("s_acctbal") > 5000, F.col("s_name")), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")), F.col("r_name"), F.lit("none"))
    return joined.select("s_suppkey", title.alias("title"))


# --- numbers and labels -----------------------------------------------------------------------------------------------


@query(
    r"""SELECT id, coalesce(try_cast(regexp_extract(volume_text, '(?i)([0-9.]+)\s*([KMB]?)', 1) AS DOUBLE)
      * CASE upper(regexp_extract(volume_text, '(?i)([0-9.]+)\s*([KMB]?)', 2)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1 END, 0) AS parsed FROM x""",
    rel.MARKET,
)
def parse_volume_text(m: DataFrame) -> DataFrame:
    return m.select("id", numbers.parse_volume(F.col("volume_text")).alias("parsed"))


def _fixed_sql(x: str, digits: int) -> str:
    """Rounds the exact binary value, ties up: half a unit is added exactly where the number is a tie."""
    step = 2 if digits else 1
    tie = f"(({x}) * {2 * step} % 2 = 1)"
    return f"printf('%.{digits}f', CASE WHEN {tie} THEN ({x}) + {0.001 if digits else 0.01} ELSE ({x}) END)"


label_sql = f"""CASE WHEN v = 0 THEN '$0' WHEN v >= 1e9 THEN '$' || {_fixed_sql('v / 1e9', 1)} || 'B' WHEN v >= 1e6 THEN '$' || {_fixed_sql('v / 1e6', 1)} || 'M'
  WHEN v >= 1e3 THEN '$' || {_fixed_sql('v / 1e3', 1)} || 'K' ELSE '$' || {_fixed_sql('v', 0)} END"""


@query(f"SELECT o_orderkey, {label_sql} AS label FROM (SELECT o_orderkey, o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 64 ELSE 0.001 END AS v FROM orders) o")
def format_currency_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    v = F.col("o_totalprice") * F.when(k == 0, 0.0).when(k == 1, 1.0).when(k == 2, 64.0).otherwise(0.001)
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.currency_label(v).alias("label"))


@query(
    """SELECT l_orderkey AS event, count(*) AS n, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE), 2) AS volume,
      string_agg(l_returnflag || ':' || l_linenumber, ',' ORDER BY l_quantity DESC, l_linenumber, l_returnflag) AS children FROM lineitem GROUP BY l_orderkey"""
)
def child_rollup_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    child = F.struct((-F.col("l_quantity")).alias("q"), F.col("l_linenumber").alias("n"), "l_returnflag")
    g = li.groupBy(F.col("l_orderkey").alias("event")).agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("volume"), F.array_sort(F.collect_list(child)).alias("c"))
    return g.select("event", "n", F.round("volume", 2).alias("volume"), F.array_join(F.transform("c", lambda c: F.concat(c.l_returnflag, F.lit(":"), c.n)), ",").alias("children"))


# --- arbitrage --------------------------------------------------------------------------------------------------------

_STAKES = """(1000 * kalshi / (kalshi + poly)) AS investment1, (1000 * poly / (kalshi + poly)) AS investment2, 1000 / (kalshi + poly) AS payout,
  (1000 * kalshi / (kalshi + poly)) * 0.02 AS fee1"""
_NET = "SELECT *, payout - 1000 - fee1 AS net FROM (SELECT *, " + _STAKES + " FROM x) a"


def _staked(p: DataFrame) -> DataFrame:
    return p.withColumns(arbitrage.stakes(F.col("kalshi"), F.col("poly"), F.lit(1000.0), arbitrage.fee_rate(F.lit("Kalshi")), arbitrage.fee_rate(F.lit("Polymarket"))))


@query(
    f"""SELECT event, line, round(investment1, 6) AS investment1, round(investment2, 6) AS investment2, round(payout, 6) AS payout,
      round(fee1, 6) AS total_fees, round(net, 6) AS net_profit, round(net / 10, 6) AS roi, net > 0 AS is_valid FROM ({_NET}) n""",
    rel.PRICES,
)
def arbitrage_calc(p: DataFrame) -> DataFrame:
    cols = ("investment1", "investment2", "payout", "total_fees", "net_profit", "roi")
    return _staked(p).select("event", "line", *(r6(c).alias(c) for c in cols), "is_valid")


@query(
    f"""SELECT event, line, round(net / 10, 6) AS roi, round((poly - kalshi) / least(kalshi, poly) * 100, 6) AS max_spread, volume,
      'high' AS tier FROM ({_NET}) n WHERE net > 0
    QUALIFY row_number() OVER (PARTITION BY event ORDER BY round((poly - kalshi) / least(kalshi, poly) * 100, 6) DESC, ord) = 1""",
    rel.PRICES,
)
def arbitrage_pairs_best_per_game(p: DataFrame) -> DataFrame:
    rows = _staked(p).filter("is_valid").withColumn("max_spread", r6(arbitrage.signed_spread(F.col("kalshi"), F.col("poly"))))
    return arbitrage.best_per(rows, ["event"], "max_spread", "ord").select("event", "line", r6("roi").alias("roi"), "max_spread", "volume", F.lit("high").alias("tier"))


@query(
    """, p AS (SELECT a.event, a.name, a.ord AS ord_a, b.ord AS ord_b,
      (greatest(a.kalshi, b.poly) - least(a.kalshi, b.poly)) / least(a.kalshi, b.poly) * 100 AS gain
      FROM x a JOIN x b ON a.event = b.event AND a.name = b.name WHERE a.line % 2 = 1 AND b.line % 2 = 0)
    SELECT event, name, ord_a, ord_b, round(gain, 6) AS gain FROM p QUALIFY row_number() OVER (PARTITION BY event ORDER BY gain DESC, ord_a, ord_b) = 1""",
    rel.PRICES,
)
def outcome_pair_best_spread(p: DataFrame) -> DataFrame:
    side = lambda odd, price: p.filter(F.col("line") % 2 == odd).select("event", "name", F.col(price).alias("price"), F.col("ord").alias("k"))
    best = arbitrage.best_outcome_pair(side(1, "kalshi"), side(0, "poly"), "event")
    return best.select("event", "name", F.col("k").alias("ord_a"), F.col("k_b").alias("ord_b"), r6("gain").alias("gain"))


@query("SELECT event, line, round((greatest(kalshi, poly) - least(kalshi, poly)) * 100, 6) AS spread FROM x", rel.PRICES)
def price_spread_first_outcome(p: DataFrame) -> DataFrame:
    return p.select("event", "line", r6(arbitrage.first_outcome_spread(F.col("kalshi"), F.col("poly"))).alias("spread"))


@query(
    """SELECT count(*) AS opportunities, coalesce(max(s), 0) AS max_spread, count(*) FILTER (s >= 3) AS at_least_3,
      round(CAST(sum(CAST(volume AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total_volume
    FROM (SELECT *, round((poly - kalshi) / least(kalshi, poly) * 100, 6) AS s FROM x) a WHERE s >= 0.01 AND kalshi_liquidity >= 10""",
    rel.PRICES,
)
def opportunity_filter_metrics(p: DataFrame) -> DataFrame:
    rows = p.withColumn("s", r6(arbitrage.signed_spread(F.col("kalshi"), F.col("poly")))).filter("s >= 0.01")
    rows = rows.filter(arbitrage.liquid(F.col("kalshi_liquidity"), F.lit(0.0), 10)).withColumn("v", F.col("volume").cast("decimal(18,2)"))
    return arbitrage.dashboard(rows.withColumn("v", F.col("v")), "s", "v").withColumn("total_volume", F.round(F.col("total_volume").cast("double"), 2))


@query(
    """SELECT CASE WHEN s >= 90 THEN 'high' WHEN s >= 80 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n
    FROM (SELECT 60 + l_quantity AS s FROM lineitem) l GROUP BY tier"""
)
def confidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(numbers.confidence_tier(60 + F.col("l_quantity"), 90, 80).alias("tier")).agg(F.count("*").alias("n"))


# --- snapshots --------------------------------------------------------------------------------------------------------


@query(
    """SELECT id, outcome_index, outcome_name, price, outcome_percentage, volume FROM (
      SELECT l_orderkey AS id, CAST(row_number() OVER w - 1 AS INTEGER) AS outcome_index, l_returnflag || l_linenumber AS outcome_name,
        0.30 + 4 * l_discount AS price, l_quantity AS outcome_percentage, o_totalprice AS volume
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey * 10 + l_linenumber)) a WHERE outcome_index < 3
    UNION ALL SELECT l_orderkey, -1, NULL, arg_min(0.30 + 4 * l_discount, (-l_quantity, l_partkey * 10 + l_linenumber)), NULL, max(o_totalprice)
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey"""
)
def outcome_topn_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    o = F.struct(F.col("l_quantity").alias("percentage"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("k"), F.concat("l_returnflag", "l_linenumber").alias("name"), (0.30 + 4 * F.col("l_discount")).alias("price"))
    m = li.groupBy("l_orderkey").agg(F.collect_list(o).alias("outcomes")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = snapshots.snapshot_rows(m.select(F.col("l_orderkey").alias("id"), F.col("o_totalprice").alias("volume"), "outcomes"))
    return rows.withColumn("outcome_index", F.coalesce("outcome_index", F.lit(-1)))


_SERIES = """, r AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY recorded_at, outcome_index) AS rn FROM x WHERE outcome_index IS NOT NULL),
  v AS (SELECT *, coalesce(outcome_percentage, outcome_price * 100) AS value FROM r WHERE rn <= 2500),
  s AS (SELECT market_id, outcome_index, recorded_at, round(value, 6) AS value,
    coalesce(first_value(outcome_name) OVER (PARTITION BY market_id, outcome_index ORDER BY rn), 'Outcome ' || (outcome_index + 1)) AS outcome_name
    FROM v WHERE value IS NOT NULL) """


def _series(s: DataFrame) -> DataFrame:
    return snapshots.outcome_series(s).withColumn("value", r6("value"))


@query(_SERIES + "SELECT * FROM s", rel.SNAPSHOT)
def snapshot_history_multi(s: DataFrame) -> DataFrame:
    return _series(s)


@query(_SERIES + "SELECT market_id, outcome_index, outcome_name, recorded_at, value FROM s QUALIFY outcome_index = min(outcome_index) OVER (PARTITION BY market_id)", rel.SNAPSHOT)
def snapshot_history_first(s: DataFrame) -> DataFrame:
    return snapshots.first_outcome(_series(s))


@query(
    """, r AS (SELECT *, coalesce(price, 0) AS p, row_number() OVER (PARTITION BY market_id ORDER BY recorded_at, event_id) AS rn FROM x)
    SELECT market_id, event_id, recorded_at, round(CASE WHEN p > 1 THEN p ELSE p * 100 END, 6) AS value FROM r WHERE rn <= 500""",
    rel.SNAPSHOT,
)
def snapshot_legacy_rescale(s: DataFrame) -> DataFrame:
    return snapshots.legacy_series(s).withColumn("value", r6("value"))


@query(f"SELECT event_id, market_id FROM x WHERE recorded_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY", rel.SNAPSHOT)
def history_timeframe(s: DataFrame) -> DataFrame:
    return snapshots.since(s, F.lit(AS_OF).cast("timestamp"), "7 DAYS").select("event_id", "market_id")


@query("SELECT market_id, event_id, price FROM x QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY recorded_at DESC, event_id DESC) = 1", rel.SNAPSHOT)
def latest_snapshot_per_market(s: DataFrame) -> DataFrame:
    return snapshots.latest(s).select("market_id", "event_id", "price")


@query(f"SELECT event_id FROM x WHERE recorded_at >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY", rel.SNAPSHOT)
def retention_survivors(s: DataFrame) -> DataFrame:
    return snapshots.survivors(s, F.lit(AS_OF).cast("timestamp"), 20).select("event_id")


@query(
    f"""SELECT count(*) FILTER (recorded_at < c) AS deleted, count(*) FILTER (recorded_at >= c) AS remaining, CAST(max(c) AS VARCHAR) AS cutoff
    FROM (SELECT *, TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY AS c FROM x) a""",
    rel.SNAPSHOT,
)
def retention_report(s: DataFrame) -> DataFrame:
    return snapshots.retention_report(s, F.lit(AS_OF).cast("timestamp"), 20).withColumn("cutoff", F.date_format("cutoff", "yyyy-MM-dd HH:mm:ss"))


@query(
    f"""SELECT count(*) AS n, count(DISTINCT market_id) AS markets, min(recorded_at) AS first_at, max(recorded_at) AS last_at,
      CAST(ceil((epoch_us(max(recorded_at)) - epoch_us(min(recorded_at))) / 86400e6) AS BIGINT) AS days,
      count(*) FILTER (recorded_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS older_than_week FROM x""",
    rel.SNAPSHOT,
)
def snapshot_stats(s: DataFrame) -> DataFrame:
    return snapshots.stats(s, F.lit(AS_OF).cast("timestamp"))


@query("SELECT strftime(recorded_at, '%Y-%m-%d') AS day, count(*) AS n FROM x GROUP BY day ORDER BY day DESC LIMIT 7", rel.SNAPSHOT)
def snapshots_per_day(s: DataFrame) -> DataFrame:
    return snapshots.per_day(s).withColumn("day", F.col("day").cast("string"))


@query(
    """, b AS (SELECT avg(length(data) * 1.2::DOUBLE + 200) AS row_bytes,
      count(*) / greatest(ceil((epoch_us(max(recorded_at)) - epoch_us(min(recorded_at))) / 86400e6), 1) AS per_day FROM x),
    o AS (SELECT *, CAST(floor(floor(471859200::DOUBLE / row_bytes) / per_day) AS BIGINT) AS max_days FROM b)
    SELECT DISTINCT days, round(row_bytes, 4) AS row_bytes, round(per_day, 6) AS rows_per_day, max_days, round(days * per_day * row_bytes, 0) AS option_bytes
    FROM (SELECT *, unnest([1, 3, 7, 14, 30, max_days]) AS days FROM o) d""",
    rel.SNAPSHOT,
)
def retention_capacity(s: DataFrame) -> DataFrame:
    c = snapshots.capacity(s)
    return c.select("days", F.round("row_bytes", 4).alias("row_bytes"), r6("rows_per_day").alias("rows_per_day"), "max_days", F.round("option_bytes", 0).alias("option_bytes"))


@query(
    """, p AS (SELECT market_id, event_id, epoch_us(recorded_at) / 1e6 AS x1, price AS y1 FROM x WHERE price IS NOT NULL),
    n AS (SELECT *, lead(x1) OVER w AS x2, lead(y1) OVER w AS y2, coalesce(lag(x1) OVER w, x1) AS x0, coalesce(lag(y1) OVER w, y1) AS y0,
      coalesce(lead(x1, 2) OVER w, lead(x1) OVER w) AS x3, coalesce(lead(y1, 2) OVER w, lead(y1) OVER w) AS y3
      FROM p WINDOW w AS (PARTITION BY market_id ORDER BY x1, event_id))
    SELECT market_id, event_id, round(x1 + (x2 - x0) / 6, 3) AS c1x, round(x2 - (x3 - x1) / 6, 3) AS c2x,
      round(y1 + (y2 - y0) / 6, 6) AS c1y, round(y2 - (y3 - y1) / 6, 6) AS c2y FROM n WHERE x2 IS NOT NULL""",
    rel.SNAPSHOT,
)
def chart_spline_controls(s: DataFrame) -> DataFrame:
    p = s.filter("price IS NOT NULL").select("market_id", "event_id", (F.unix_micros("recorded_at") / 1e6).alias("t"), "price")
    c = snapshots.spline_controls(p, ["market_id"], "t", "price")
    return c.select("market_id", "event_id", *(F.round(k, 3).alias(k) for k in ("c1x", "c2x")), *(r6(k).alias(k) for k in ("c1y", "c2y")))


@query(
    """, e AS (SELECT epoch_us(min(recorded_at)) AS lo, epoch_us(max(recorded_at)) AS hi FROM x)
    SELECT CAST(i AS INTEGER) AS tick, CAST(floor(lo + (hi - lo) * i / 6.0::DOUBLE) AS BIGINT) AS at_micros FROM e, range(7) t(i)""",
    rel.SNAPSHOT,
)
def time_axis_ticks(s: DataFrame) -> DataFrame:
    return snapshots.time_ticks(s, "recorded_at")


@query("""SELECT event_id, '{"k":"' || json_extract_string(data, '$.k') || '"}' AS data FROM x""", rel.SNAPSHOT)
def payload_project_json(s: DataFrame) -> DataFrame:
    return s.select("event_id", snapshots.slim(F.col("data"), ["k"]).alias("data"))


@query(
    """SELECT date_trunc('hour', recorded_at) AS hour, market_id, outcome_index, arg_max(value, (recorded_at, event_id)) AS last_value, count(*) AS n
    FROM (SELECT *, round(coalesce(outcome_percentage, outcome_price * 100), 6) AS value FROM x) v
    WHERE outcome_index IS NOT NULL AND value IS NOT NULL GROUP BY ALL""",
    rel.SNAPSHOT,
)
def hourly_last_value(s: DataFrame) -> DataFrame:
    rows = s.withColumn("value", r6(F.coalesce("outcome_percentage", F.col("outcome_price") * 100))).filter("outcome_index IS NOT NULL AND value IS NOT NULL")
    return streaming.hourly_last(rows)


# --- text -------------------------------------------------------------------------------------------------------------


def _classes_sql(x: str, classes: list[tuple[str, list[str]]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{'|'.join(words)}') THEN '{name}'" for name, words in classes) + f" ELSE '{default}' END"


@query(f"SELECT id, {_classes_sql('lower(title)', text.API_CATEGORIES, 'Other')} AS category FROM x", rel.MARKET)
def category_keywords_api(m: DataFrame) -> DataFrame:
    return m.select("id", text.keyword_category(F.col("title"), text.API_CATEGORIES, "Other").alias("category"))


@query(f"SELECT id, {_classes_sql('lower(title)', text.HOME_CATEGORIES, 'All')} AS category FROM x", rel.MARKET)
def category_keywords_home(m: DataFrame) -> DataFrame:
    return m.select("id", text.keyword_category(F.col("title"), text.HOME_CATEGORIES, "All").alias("category"))


title_case_sql = "CASE " + " ".join(f"WHEN regexp_matches(title, '(?i){p}') THEN '{n}'" for n, p in text.TITLE_CATEGORIES) + " ELSE 'other' END"


@query(f"SELECT id, {title_case_sql} AS category FROM x", rel.MARKET)
def category_regex_first(m: DataFrame) -> DataFrame:
    return m.select("id", text.title_category(F.col("title")).alias("category"))


@query(r"SELECT id, title FROM x WHERE regexp_matches(lower(title), '\bnfl\b') AND contains(lower(title), 'saints')", rel.MARKET)
def query_terms_filter(m: DataFrame) -> DataFrame:
    terms = text.query_terms("Will the NFL, Saints be")
    return m.filter(text.all_terms(F.col("title"), terms)).select("id", "title")


@query(
    r"""SELECT id, found FROM (SELECT id, CAST((regexp_matches(lower(title), '\bwin\b'))::INT + (contains(lower(title), 'championship'))::INT + (contains(lower(title), 'party') OR contains(lower(p_name), 'party'))::INT
      + (contains(lower(title), 'race') OR contains(lower(p_name), 'race'))::INT AS INTEGER) AS found, volume FROM x) f WHERE found >= 3 ORDER BY found DESC, volume DESC, id LIMIT 60""",
    rel.MARKET,
)
def event_token_filter_score(m: DataFrame) -> DataFrame:
    found, needed = text.token_match_counts(F.array("title", "p_name"), ["win", "championship", "party", "race"])
    return m.withColumn("found", found).filter(F.col("found") >= needed).orderBy(F.desc("found"), F.desc("volume"), "id").limit(60).select("id", "found")


_relevance = " + ".join(
    f"CASE WHEN starts_with(lower(title), '{w}') THEN 5 ELSE 0 END + CASE WHEN contains(lower(title), '{w}') THEN 3 ELSE 0 END"
    f" + CASE WHEN contains(lower(platform), '{w}') THEN 1 ELSE 0 END + CASE WHEN contains(lower(p_name), '{w}') OR '{w}' = 'yes' THEN 2 ELSE 0 END"
    for w in ("rams", "kalshi", "yes")
)


@query(f"SELECT id, {_relevance} AS score FROM x", rel.MARKET)
def relevance_score(m: DataFrame) -> DataFrame:
    return m.select("id", text.relevance(F.col("title"), F.col("platform"), F.array("p_name", F.lit("Yes")), "Rams Kalshi yes").alias("score"))


_hit = {t: f"(regexp_matches(t, '\\b{t}\\b') OR ({len(t)} > 3 AND contains(t, '{t}')))::INT" for t in ("nfl", "saints", *text.SYNONYMS["nfl"])}
_n, _s = " + ".join(_hit.values()), " + ".join(_hit[t] for t in text.SYNONYMS["nfl"])
_w = " + ".join(f"regexp_matches(t, '\\b{t}\\b')::INT" for t in _hit)


@query(
    f""", t AS (SELECT *, lower(title) || ' yes no' AS t FROM x),
    c AS (SELECT *, {_n} AS n, {_s} AS s, {_w} AS w, {_hit['nfl']} + {_hit['saints']} = 2 AS every, {_classes_sql('t', text.API_CATEGORIES, 'Other')} AS category FROM t),
    l AS (SELECT *, CASE WHEN category = 'Sports' THEN 100 + CASE WHEN every THEN 100 ELSE n * 20 END + s * 10
      WHEN every THEN 150 + w * 20 + s * 10 WHEN n >= 2 THEN n * 15 + s * 5 END AS ladder FROM c)
    SELECT id, round(coalesce(ladder, 0) + CASE WHEN contains(lower(title), 'nfl saints') THEN 200 ELSE 0 END + least(
      coalesce(try_cast(regexp_extract(volume_text, '(?i)([0-9.]+)\\s*([KMB]?)', 1) AS DOUBLE) * CASE upper(regexp_extract(volume_text, '(?i)([0-9.]+)\\s*([KMB]?)', 2))
        WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1 END, 0) / 10000, 5), 6) AS score
    FROM l WHERE ladder IS NOT NULL OR contains(lower(title), 'nfl saints')""",
    rel.MARKET,
)
def search_ladder_score(m: DataFrame) -> DataFrame:
    found = text.search(m.withColumn("outcomes", F.array(F.lit("Yes"), F.lit("No"))), "NFL Saints")
    return found.select("id", r6("score").alias("score"))


#: Queries made of titles: their first two words and their last two.
_SEARCHES = """SELECT min(id) AS qid, query FROM (
    SELECT id * 2 AS id, regexp_extract(title, '^([^ ]+ [^ ]+)', 1) AS query FROM x UNION ALL SELECT id * 2 + 1, regexp_extract(title, '([^ ]+ [^ ]+)$', 1) FROM x) w WHERE query <> '' GROUP BY query"""
_stops = ", ".join(f"'{w}'" for w in text.SEARCH_STOP_WORDS)
_wider = ", ".join(f"('{t}', '{s}')" for t, many in text.SYNONYMS.items() for s in many)


@query(
    f""", q AS (SELECT qid, lower(query) AS q, {_classes_sql("lower(query) || ' '", text.API_CATEGORIES, 'Other')} AS asked FROM ({_SEARCHES}) s),
    w AS (SELECT DISTINCT qid, regexp_replace(w, '[^a-z0-9]', '', 'g') AS term FROM (SELECT qid, unnest(string_split(q, ' ')) AS w FROM q) u WHERE length(w) > 1 AND w NOT IN ({_stops}) AND regexp_matches(w, '[a-z0-9]')),
    o AS (SELECT qid, term, TRUE AS own FROM w UNION ALL SELECT qid, regexp_replace(q, '[^a-z0-9\\s]', '', 'g'), TRUE FROM q WHERE qid NOT IN (SELECT qid FROM w)),
    y AS (SELECT DISTINCT qid, syn AS term, FALSE AS own FROM w JOIN (VALUES {_wider}) v(t, syn) ON t = term WHERE (qid, syn) NOT IN (SELECT (qid, term) FROM w)),
    t AS (SELECT * FROM o UNION ALL SELECT * FROM y),
    d AS (SELECT *, lower(title) || ' yes no' AS t, regexp_extract_all(lower(title) || ' yes no', '[a-z0-9_]+') AS runs, {_classes_sql("(lower(title) || ' yes no')", text.API_CATEGORIES, 'Other')} AS category FROM x),
    h AS (SELECT id, term, CASE WHEN contains(term, ' ') THEN contains(t, term) AND regexp_matches(t, '\\b' || term || '\\b') ELSE list_contains(runs, term) END AS whole, length(term) > 3 AND contains(t, term) AS part
      FROM d, (SELECT DISTINCT term FROM t) a),
    c AS (SELECT qid, id, count(*) FILTER (whole OR part) AS n, count(*) FILTER (whole) AS w, count(*) FILTER ((whole OR part) AND NOT own) AS s,
      bool_and(whole OR part) FILTER (own) AS every, count(*) FILTER (own) AS terms FROM h JOIN t USING (term) GROUP BY qid, id),
    l AS (SELECT c.*, contains(lower(title), q) AS exact, volume_text, CASE WHEN asked <> 'Other' AND asked = category THEN 100 + CASE WHEN every THEN 100 ELSE n * 20 END + s * 10
      WHEN every THEN 150 + w * 20 + s * 10 WHEN n >= ceil(terms * 0.7::DOUBLE) THEN n * 15 + s * 5 WHEN terms = 1 AND n > 0 THEN 50 + s * 5 END AS ladder
      FROM c JOIN q USING (qid) JOIN d USING (id))
    SELECT qid, id, round(coalesce(ladder, 0) + CASE WHEN exact THEN 200 ELSE 0 END + least(
      coalesce(try_cast(regexp_extract(volume_text, '(?i)([0-9.]+)\\s*([KMB]?)', 1) AS DOUBLE) * CASE upper(regexp_extract(volume_text, '(?i)([0-9.]+)\\s*([KMB]?)', 2))
        WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1 END, 0) / 10000, 5), 6) AS score FROM l WHERE ladder IS NOT NULL OR exact""",
    rel.MARKET,
)
def search_many_scores(m: DataFrame) -> DataFrame:
    """What each of many queries finds, by one job over an index of tokens."""
    head, tail = (m.select((F.col("id") * 2 + k).alias("id"), F.regexp_extract("title", p, 1).alias("query")) for k, p in enumerate(("^([^ ]+ [^ ]+)", "([^ ]+ [^ ]+)$")))
    asked = head.unionByName(tail).filter("query != ''").groupBy("query").agg(F.min("id").alias("qid"))
    markets = m.select("id", "title", "volume_text", F.array(F.lit("Yes"), F.lit("No")).alias("outcomes"))
    return search.search_many(markets, asked).select("qid", "id", r6("score").alias("score"))


def normal_sql(x: str) -> str:
    out = f"lower({x})"
    for team, city in text.TITLE_CITIES.items():
        out = f"regexp_replace({out}, '\\b{team}\\b', '{city}', 'g')"
    steps = ((f"\\b({text.FILLERS})\\b", " "), ("\\$(\\d+)([kmb]?)", "\\1\\2"), ("(\\d+)%", "\\1 percent"), ("[?!.,;:()\\[\\]{{}}''\"]".replace("{{", "{").replace("}}", "}"), " "), ("\\s+", " "))
    for pattern, put in steps:
        out = f"regexp_replace({out}, '{pattern}', '{put}', 'g')"
    return f"trim({out})"


@query(f"SELECT id, {normal_sql('title')} AS normal FROM x", rel.MARKET)
def title_normalize(m: DataFrame) -> DataFrame:
    return m.select("id", text.normalise_title(F.col("title")).alias("normal"))


_NAMES = "SELECT DISTINCT p_name AS name FROM part"


@query(
    """, n AS (SELECT name, row_number() OVER (ORDER BY name) AS ord FROM x)
    SELECT a.name AS a, b.name AS b, CAST(levenshtein(a.name, b.name) AS INTEGER) AS distance,
      round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) AS similarity FROM n a JOIN n b ON a.ord < b.ord""",
    _NAMES,
)
def levenshtein_pairs(n: DataFrame) -> DataFrame:
    """All pairs of distinct names. They share one key, which is dealt into blocks that meet two by two."""
    return _distances(n.withColumn("c", F.lit("")))


def _distances(n: DataFrame) -> DataFrame:
    pairs = matching.dealt_join(n.withColumnRenamed("name", "a"), n.withColumnRenamed("name", "b"), ["c"], "a", "b").filter("a < b")
    d = F.levenshtein("a", "b")
    return pairs.select("a", "b", d.alias("distance"), r6(1 - d / F.greatest(F.length("a"), F.length("b"))).alias("similarity"))


@query(
    """SELECT a.name AS a, b.name AS b, CAST(levenshtein(a.name, b.name) AS INTEGER) AS distance,
      round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) AS similarity FROM x a JOIN x b ON a.name < b.name""",
    _NAMES,
)
def levenshtein_pairs_all(n: DataFrame) -> DataFrame:
    """The same as ``levenshtein_pairs``, by the name that it had while that one was cut."""
    return _distances(n.withColumn("c", F.lit("")))


_wsim = """CASE WHEN p = q THEN 1 WHEN contains(p, q) OR contains(q, p) THEN 0.8
  ELSE len(list_intersect(list_distinct(string_split(p, '')), list_distinct(string_split(q, '')))) / greatest(len(list_distinct(string_split(p, ''))), len(list_distinct(string_split(q, '')))) END"""


def similarity_sql(a: str, b: str) -> str:
    """The similarity of two different, trimmed texts in lower case without double spaces; neither is empty."""
    wa, wb = (f"string_split({t}, ' ')" for t in (a, b))
    la, lb = (f"list_filter({w}, lambda v: length(v) > 3)" for w in (wa, wb))
    dice = f"(2 * len(list_filter({wa}, lambda v: list_contains({wb}, v))) / (len({wa}) + len({wb})))"
    key = f"((SELECT count(*) FROM (SELECT unnest({la}) AS p) u WHERE EXISTS (SELECT 1 FROM (SELECT unnest({lb}) AS q) z WHERE ({_wsim}) > 0.7)) / greatest(len({la}), len({lb}), 1))"
    return f"""CASE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN least(length({a}), length({b})) / greatest(length({a}), length({b})) * 0.9
      ELSE greatest({dice}, {key} * 0.85, {dice} * 0.6 + {key} * 0.4) END"""


@query(
    f""", n AS (SELECT lower(name) AS name, string_split(lower(name), ' ') AS w, row_number() OVER (ORDER BY name) AS ord FROM x),
    p AS (SELECT a.name AS a, b.name AS b, a.w AS wa, b.w AS wb, list_filter(a.w, lambda v: length(v) > 3) AS la, list_filter(b.w, lambda v: length(v) > 3) AS lb
      FROM n a JOIN n b ON a.ord < b.ord),
    k AS (SELECT *, 2 * len(list_filter(wa, lambda v: list_contains(wb, v))) / (len(wa) + len(wb)) AS dice,
      (SELECT count(*) FROM (SELECT unnest(la) AS p) u WHERE EXISTS (SELECT 1 FROM (SELECT unnest(lb) AS q) z WHERE ({_wsim}) > 0.7 )) / greatest(len(la), len(lb), 1) AS key FROM p)
    SELECT * FROM (SELECT a, b, round(CASE WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / greatest(length(a), length(b)) * 0.9
      ELSE greatest(dice, key * 0.85, dice * 0.6 + key * 0.4) END, 6) AS similarity FROM k) r WHERE similarity >= 0.5""",
    _NAMES,
)
def text_similarity_pairs(n: DataFrame) -> DataFrame:
    items = n.select(F.lower("name").alias("name"), F.lit("other").alias("category")).withColumn("ord", F.col("name"))
    pairs = matching.similar_pairs(items, "category", "name", 0.0).withColumn("similarity", r6("similarity"))
    return pairs.filter("similarity >= 0.5").select(F.col("name").alias("a"), F.col("b_text").alias("b"), "similarity")


@query(
    """SELECT a.name AS a, b.name AS b, CAST(levenshtein(a.name, b.name) AS INTEGER) AS distance
    FROM x a JOIN x b ON a.name < b.name WHERE levenshtein(a.name, b.name) <= 3""",
    _NAMES,
)
def levenshtein_close_pairs(n: DataFrame) -> DataFrame:
    """Pairs of distinct names at a distance of at most three."""
    return text_joins.edit_pairs(n, most=3)


@query(
    """SELECT a.name AS a, b.name AS b, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) AS similarity
    FROM x a JOIN x b ON a.name < b.name WHERE levenshtein(a.name, b.name) <= floor(0.25::DOUBLE * greatest(length(a.name), length(b.name)))""",
    _NAMES,
)
def levenshtein_similar_pairs(n: DataFrame) -> DataFrame:
    """Pairs of distinct names of which at most a quarter differs."""
    pairs = text_joins.edit_pairs(n, least=0.75)
    return pairs.select("a", "b", r6(1 - F.col("distance") / F.greatest(F.length("a"), F.length("b"))).alias("similarity"))


_FUZZY = ["entertainment", "economics", "weather", "other"]


@query(
    f""", n AS (SELECT id, platform, {title_case_sql} AS category, {normal_sql('title')} AS normal FROM x),
    t AS (SELECT DISTINCT category, normal, string_split(normal, ' ') AS w, list_filter(string_split(normal, ' '), lambda v: length(v) > 3) AS l FROM n
      WHERE category IN ({', '.join(f"'{c}'" for c in _FUZZY)})),
    p AS (SELECT a.category, a.normal AS a, b.normal AS b, a.w AS wa, b.w AS wb, a.l AS la, b.l AS lb FROM t a JOIN t b ON a.category = b.category),
    k AS (SELECT *, 2 * len(list_filter(wa, lambda v: list_contains(wb, v))) / (len(wa) + len(wb)) AS dice,
      (SELECT count(*) FROM (SELECT unnest(la) AS p) u WHERE EXISTS (SELECT 1 FROM (SELECT unnest(lb) AS q) z WHERE ({_wsim}) > 0.7 )) / greatest(len(la), len(lb), 1) AS key FROM p),
    s AS (SELECT category, a, b, CASE WHEN a = b THEN 1 WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / greatest(length(a), length(b)) * 0.9
      ELSE greatest(dice, key * 0.85, dice * 0.6 + key * 0.4) END AS similarity FROM k)
    SELECT a.id, b.id AS b_id, category, round(similarity * 100, 6) AS confidence FROM n a JOIN s USING (category) JOIN n b USING (category)
    WHERE a.normal = s.a AND b.normal = s.b AND similarity >= 0.9 AND a.id < b.id AND a.platform <> b.platform""",
    rel.MARKET,
)
def category_title_pairs(m: DataFrame) -> DataFrame:
    """Markets of two venues in one of the four categories without a matcher of their own, whose titles are similar by 0.9."""
    title = F.col("title")
    rows = matching.by_titles(m.select("ord", "id", "platform", "title"), category=text.title_category(title), normal=text.normalise_title(title)).filter(F.col("category").isin(_FUZZY))
    pairs = text_joins.similar_markets(rows, "category", "normal", 0.9)
    return pairs.select("id", "b_id", "category", r6(F.col("similarity") * 100).alias("confidence"))


_DATES = """SELECT o_orderkey AS id, CASE o_orderkey % 6
    WHEN 0 THEN 'nfl-la-sea-' || strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN lower(strftime(o_orderdate, '%y%b%d'))
    WHEN 2 THEN 'on ' || strftime(o_orderdate, '%m/%d/%y') WHEN 3 THEN strftime(o_orderdate, '%b %d, %Y') || ' game'
    WHEN 4 THEN strftime(o_orderdate, 'KXNFLGAME-%y%b%dBALGB') ELSE strftime(o_orderdate, '%B %d') END AS t, o_orderdate FROM orders"""


@query(f"SELECT id, CASE id % 6 WHEN 4 THEN NULL WHEN 5 THEN '2025' || strftime(o_orderdate, '-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM ({_DATES}) d")
def extract_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    f = lambda p: F.date_format("o_orderdate", p)
    k = F.col("o_orderkey") % 6
    written = (
        F.when(k == 0, F.concat(F.lit("nfl-la-sea-"), f("yyyy-MM-dd")))
        .when(k == 1, F.lower(f("yyMMMdd")))
        .when(k == 2, F.concat(F.lit("on "), f("MM/dd/yy")))
        .when(k == 3, F.concat(f("MMM dd, yyyy"), F.lit(" game")))
        .when(k == 4, F.concat(F.lit("KXNFLGAME-"), F.upper(f("yyMMMdd")), F.lit("BALGB")))
        .otherwise(f("MMMM dd"))
    )
    return o.select(F.col("o_orderkey").alias("id"), text.extract_date(written, 2025).alias("day"))


@query("SELECT id, state, office, party, year, sport FROM (SELECT id, " + ", ".join(f"nullif(regexp_extract(title, '{p}', 1), '') AS {k}" for k, p in text.ENTITIES.items()) + " FROM x) e", rel.MARKET)
def title_entities(m: DataFrame) -> DataFrame:
    return m.select("id", *(text.entity(F.col("title"), k).alias(k) for k in text.ENTITIES))


# --- matching ---------------------------------------------------------------------------------------------------------


_ENTITIES = rf""", e AS (SELECT id, platform, title, lower(nullif(regexp_extract(title, '{text.ENTITIES['state']}', 1), '')) AS state,
      lower(nullif(regexp_extract(title, '{text.ENTITIES['office']}', 1), '')) AS office, nullif(regexp_extract(title, '{text.ENTITIES['year']}', 1), '') AS year FROM x
      WHERE regexp_matches(title, '(?i){text.TITLE_CATEGORIES[1][1]}') AND NOT regexp_matches(title, '(?i){text.TITLE_CATEGORIES[0][1]}')),
    p AS (SELECT a.id, b.id AS b_id, 50 + CASE WHEN a.office IS NULL OR b.office IS NULL THEN 10 ELSE 30 END + CASE WHEN a.year = b.year THEN 15 ELSE 0 END + 5 AS score
      FROM e a JOIN e b ON a.state = b.state AND a.id < b.id AND a.platform <> b.platform
      WHERE (a.office IS NULL OR b.office IS NULL OR a.office = b.office) AND (a.year IS NULL OR b.year IS NULL OR a.year = b.year))
    SELECT id, b_id, score FROM p WHERE score >= 70"""


@query(_ENTITIES, rel.MARKET)
def entity_match_score(m: DataFrame) -> DataFrame:
    return _entity_matches(m)


def _entity_matches(m: DataFrame) -> DataFrame:
    politics = m.filter(text.title_category(F.col("title")) == "politics")
    e = politics.select("ord", "id", "platform", "title", *(text.entity(F.col("title"), k).alias(k) for k in ("state", "office", "year")))
    return matching.entity_pairs(e).select("id", "b_id", "score")


@query(_ENTITIES, rel.MARKET)
def entity_match_score_all(m: DataFrame) -> DataFrame:
    """The same as ``entity_match_score``, by the name that it had while that one was cut."""
    return _entity_matches(m)


@query(
    """, t AS (SELECT id, platform, regexp_extract(title, '^(\\w+) vs (\\w+)$', 1) AS p, regexp_extract(title, '^(\\w+) vs (\\w+)$', 2) AS q FROM x),
    k AS (SELECT id, platform, least(p, q) || '|' || greatest(p, q) AS pair FROM t WHERE p <> '' AND p <> q)
    SELECT a.id, b.id AS b_id, a.pair, 100 AS confidence FROM k a JOIN k b ON a.pair = b.pair AND a.id < b.id AND a.platform <> b.platform""",
    rel.MARKET,
)
def team_pair_set_join(m: DataFrame) -> DataFrame:
    part = lambda k: F.regexp_extract("title", r"^(\w+) vs (\w+)$", k)
    t = m.withColumn("teams", F.array(part(1), part(2))).filter(part(1) != "")
    return matching.team_set_pairs(t.withColumn("platform", F.col("platform")))


@query(
    """SELECT a.id, b.id AS b_id, a.signature FROM x a JOIN x b ON a.signature = b.signature AND a.venue = 0 AND b.venue = 1
      AND (abs(date_diff('day', a.day, b.day)) <= 1 OR (a.day IS NULL AND b.day IS NULL))""",
    rel.GAME,
)
def event_signature_band_join(g: DataFrame) -> DataFrame:
    rows = g.select("id", "signature", "day", "venue")
    pairs = matching.band_pairs(rows.filter("venue = 0"), rows.filter("venue = 1"), "signature", "day")
    return pairs.select("id", "b_id", "signature")


@query(
    """, f AS (SELECT signature, day, min(ord) AS ord, row_number() OVER (PARTITION BY signature ORDER BY min(ord)) AS k FROM x WHERE day IS NOT NULL AND signature IS NOT NULL GROUP BY signature, day),
    o AS (SELECT * FROM (WITH RECURSIVE w AS (
        SELECT signature, k, day, ord, [day] AS opened, TRUE AS opens FROM f WHERE k = 1
        UNION ALL SELECT f.signature, f.k, f.day, f.ord, CASE WHEN list_has_any(opened, [f.day - 1, f.day + 1]) THEN opened ELSE list_append(opened, f.day) END, NOT list_has_any(opened, [f.day - 1, f.day + 1])
        FROM w JOIN f ON f.signature = w.signature AND f.k = w.k + 1) SELECT * FROM w WHERE opens) r)
    SELECT x.id, x.signature, CAST(arg_min(o.day, CASE WHEN o.day = x.day THEN 0 WHEN o.day < x.day THEN 1 ELSE 2 END) AS VARCHAR) AS group_day
    FROM x LEFT JOIN o ON o.signature = x.signature AND o.ord <= x.ord AND o.day BETWEEN x.day - 1 AND x.day + 1 GROUP BY x.id, x.signature""",
    rel.GAME,
)
def event_signature_groups(g: DataFrame) -> DataFrame:
    """Greedy in order of arrival."""
    return matching.greedy_groups(g).select("id", "signature", F.col("group_day").cast("string").alias("group_day"))


@query(
    """, s AS (SELECT 'nfl-' || replace(signature, '-', '.') || '-b-' || strftime(day, '%Y-%m-%d') AS slug, max(id) AS slug_id FROM x WHERE venue = 1 AND day IS NOT NULL GROUP BY slug),
    t AS (SELECT id, 'nfl-' || replace(signature, '-', '.') || '-b-' AS head, day FROM x WHERE venue = 0 AND day IS NOT NULL),
    c AS (SELECT id, 0 AS k, head || strftime(day, '%Y-%m-%d') AS slug FROM t UNION ALL SELECT id, 1, head || strftime(day - 1, '%Y-%m-%d') FROM t WHERE dayofmonth(day) > 1
      UNION ALL SELECT id, 2, head || strftime(day + 1, '%Y-%m-%d') FROM t WHERE dayofmonth(day) < 28)
    SELECT id, slug, slug_id FROM c JOIN s USING (slug) QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) = 1""",
    rel.GAME,
)
def slug_candidate_lookup(g: DataFrame) -> DataFrame:
    named = g.withColumn("team_a", F.replace("signature", F.lit("-"), F.lit("."))).filter("day IS NOT NULL")
    slugs = named.filter("venue = 1").select(F.concat_ws("-", F.lit("nfl"), "team_a", F.lit("b"), F.date_format("day", "yyyy-MM-dd")).alias("slug"), F.col("id").alias("slug_id"))
    events = named.filter("venue = 0").select("id", F.lit("nfl").alias("sport"), "team_a", F.lit("b").alias("team_b"), "day")
    return matching.slug_hits(events, slugs).select("id", "slug", "slug_id")


_COSINE = """, p AS (SELECT a.id, b.id AS b_id, a.category, round(list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]), 6) AS similarity
  FROM x a JOIN x b ON a.category = b.category AND a.id < b.id AND a.platform <> b.platform) """


@query(_COSINE + "SELECT * FROM p WHERE similarity > 0.3", rel.VECTOR)
def embedding_cosine_pairs(v: DataFrame) -> DataFrame:
    return similarity.cosine_pairs(v, 0.2999).withColumn("similarity", r6("similarity")).filter("similarity > 0.3")


@query(
    _COSINE + """, r AS (SELECT similarity, row_number() OVER (ORDER BY similarity) AS k, count(*) OVER () AS n FROM p)
    SELECT CAST(count(*) AS BIGINT) AS pairs, min(similarity) AS lo, round(avg(similarity), 4) AS mean, max(similarity) AS hi, min(similarity) FILTER (k > n // 2) AS median FROM r""",
    rel.VECTOR,
)
def embedding_similarity_stats(v: DataFrame) -> DataFrame:
    return similarity.similarity_stats(similarity.cosine_counts(v))


@query(
    _COSINE + """SELECT CASE WHEN similarity < 0.2 THEN '0-20%' WHEN similarity < 0.4 THEN '20-40%' WHEN similarity < 0.6 THEN '40-60%' WHEN similarity < 0.8 THEN '60-80%' ELSE '80-100%' END AS band,
      count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS share FROM p GROUP BY band""",
    rel.VECTOR,
)
def embedding_similarity_histogram(v: DataFrame) -> DataFrame:
    return similarity.similarity_histogram(similarity.cosine_counts(v))


@query(_COSINE + "SELECT * FROM p ORDER BY similarity DESC, id, b_id LIMIT 20", rel.VECTOR)
def embedding_topk(v: DataFrame) -> DataFrame:
    return similarity.cosine_top(v, 20)


@query(relation=rel.MARKET)
def teams_from_text(m: DataFrame) -> DataFrame:
    """Tests hold it against golden rows and a plain loop."""
    return m.select("id", F.array_join(teams.teams_from_text(F.col("title")), "|").alias("teams"))


@query(relation=rel.MARKET)
def outcome_team(m: DataFrame) -> DataFrame:
    """Both outcomes of every market, every fourth with the feed's own name of the team; tests hold it against golden rows and a plain loop."""
    found = once(m.select("id", "k", "title"), teams=teams.teams_from_text(F.col("title")))
    named = F.when(F.col("id") % 4 == 0, F.element_at(F.array(*map(F.lit, ["Minnesota", "Milwaukee", "Rams"])), (F.col("k") % 3 + 1).cast("int")))
    team = lambda name: teams.outcome_team(F.lit(name), F.col("title"), F.col("teams"), named)
    return found.select("id", team("Yes").alias("yes_team"), team("No").alias("no_team"), teams.valid_for(F.col("teams"), "nfl").alias("nfl_game"))
