"""Markets, outcomes and snapshots made from the test tables, in SQL that Spark and the oracle both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def _pick(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


TEAMS = ["Saints", "Rams", "Seahawks", "Lakers", "Celtics", "Wild", "Bruins", "Chiefs", "Bills", "Heat", "Jets"]
STATES = ["Ohio", "Iowa", "Texas", "Nevada", "New York", "Utah"]
TEAM, OTHER, STATE, YEAR = "t.word", "o.word", "s.word", "CAST(2024 + (k + p_size) % 3 AS VARCHAR(4))"


def _words(values: list[str], name: str) -> str:
    rows = " UNION ALL ".join(f"SELECT {i} AS place, '{v}' AS word" for i, v in enumerate(values))
    return f"({rows}) {name}"


SIZE = "CAST(p_size AS VARCHAR(10))"

#: id, ord, platform, title, volume, volume_text, p_name, k
MARKET = f"""
SELECT id, id AS ord, k, {_pick('k', ['Polymarket', 'Kalshi', 'PredictIt'])} AS platform, p_name,
  CASE id % 9
    WHEN 0 THEN 'Will Bitcoin reach $' || {SIZE} || 'k by December?'
    WHEN 1 THEN {TEAM} || ' vs ' || {OTHER}
    WHEN 2 THEN {STATE} || ' Senate election ' || {YEAR}
    WHEN 3 THEN 'Will the ' || {TEAM} || ' win the championship?'
    WHEN 4 THEN 'Which party will win the ' || {STATE} || ' Governor race in ' || {YEAR} || '?'
    WHEN 5 THEN 'Fed rate above ' || {SIZE} || '% (in ' || {YEAR} || ')?'
    WHEN 6 THEN 'Oscar award for "' || p_name || '"'
    WHEN 7 THEN 'Rain or snow in ' || {STATE} || ': ' || p_name
    ELSE 'NFL game: ' || {OTHER} || ' at ' || {TEAM} END AS title,
  volume,
  CASE id % 6
    WHEN 0 THEN '$' || CAST(CAST(floor(volume / 1000) AS BIGINT) AS VARCHAR(20)) || 'K'
    WHEN 1 THEN '$' || CAST(CAST(floor(volume) AS BIGINT) AS VARCHAR(20)) || ' vol'
    WHEN 2 THEN CAST(CAST(floor(volume / 1000) AS BIGINT) AS VARCHAR(20)) || 'k Shares'
    WHEN 3 THEN 'M$ ' || {SIZE} || '.5 m'
    WHEN 4 THEN 'N/A'
    ELSE {SIZE} || ' markets' END AS volume_text
FROM (
  SELECT p_partkey AS id, CAST(floor(p_partkey / 9.0) AS BIGINT) AS k, p_name, p_size, coalesce(volume, 0.0) AS volume
  FROM part LEFT JOIN (
    SELECT l_partkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS volume FROM lineitem GROUP BY l_partkey
  ) v ON l_partkey = p_partkey
) p
JOIN {_words(TEAMS, 't')} ON t.place = k % {len(TEAMS)}
JOIN {_words(TEAMS, 'o')} ON o.place = (k + 1 + k % 4) % {len(TEAMS)}
JOIN {_words(STATES, 's')} ON s.place = (k + k % 5) % {len(STATES)}
"""

#: Two prices of one game: event (order), line, ord (part and line), prices between 0.25 and 0.75, volumes.
PRICES = """
SELECT l_orderkey AS event, l_linenumber AS line, l_partkey * 10 + l_linenumber AS ord, l_returnflag AS name,
  0.30 + 4 * l_discount AS kalshi, 0.25 + 5 * l_tax AS poly, l_quantity AS kalshi_liquidity, l_extendedprice AS volume
FROM lineitem
"""

#: event_id, market_id, outcome_index, outcome_name, recorded_at, price, outcome_price, outcome_percentage, data
SNAPSHOT = """
SELECT event_id, user_id AS market_id, CAST(ts AS TIMESTAMP) AS recorded_at,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 END AS outcome_index,
  CASE WHEN event_id % 7 <> 0 THEN event_type END AS outcome_name,
  CASE WHEN event_id % 5 <> 0 THEN value / 500 END AS price,
  CASE WHEN event_id % 11 <> 0 THEN value / 500 END AS outcome_price,
  CASE WHEN event_id % 3 <> 0 THEN value / 5 END AS outcome_percentage, props AS data
FROM events
"""

#: Vectors of two venues with a category.
VECTOR = "SELECT vec_id AS id, label AS category, vec_id % 3 AS platform, embedding AS vec FROM embeddings"

#: Dated games of two venues: sides of every order.
GAME = f"""
SELECT o_orderkey AS id, o_orderkey AS ord, {_pick('o_custkey', ['saints-rams', 'bills-jets', 'heat-lakers', 'bruins-wild', 'chiefs-colts'])}
    || '-' || CAST(o_custkey % 40 AS VARCHAR(10)) AS signature,
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, o_orderkey % 2 AS venue
FROM orders
"""


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the Parquet tables that it names."""
    names = {t for t in re.findall(r"(?:FROM|JOIN) (\w+)", sql) if t in TABLES}
    named = re.sub(r"(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in names else m[0], sql)
    return spark.sql(named, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})
